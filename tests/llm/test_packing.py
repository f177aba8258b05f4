import zlib

import numpy as np
from tokenizers import Tokenizer

from flowquarry.llm import packing
from flowquarry.llm.queries import op8_packing


def brute(rows):
    """{(doc_id, text)...} to the pieces that each text must have."""
    t = Tokenizer.from_file(packing.default_vocabulary())
    out = []
    for doc_id, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        n, at = len(ids) // 4, 0
        while at < n:
            size = min(4096, 1 << (n - at).bit_length() - 1)
            out.append((doc_id, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), n))
            at += size
    return sorted(out, key=str)


def check(rows, docs):
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows), key=str) == brute(docs)
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    lengths = [r.length for r in sorted(rows, key=lambda r: r.sequence_id)]
    assert lengths == sorted(lengths, reverse=True)
    assert all(r.offset == 0 and r.length & (r.length - 1) == 0 for r in rows)


def test_query_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check(op8_packing(spark, sf_dir).collect(), docs)


def test_odd_rows(spark, odd_docs, no_docs):
    check(packing.pack(odd_docs).collect(), [(r.doc_id, r.text) for r in odd_docs.collect()])
    assert packing.pack(no_docs).count() == 0
    assert {r.length for r in packing.pack(odd_docs, longest=1).limit(50).collect()} == {1}


def test_words_are_tokenized_as_in_whole_texts():
    w = packing.WordTokenizer(packing.default_vocabulary())
    for text in ("a<|endoftext|>b", "É ÀÖ×÷ª it's I'LL 'd", "Å İ ΣΑΣ x\u0085y\x1cz ﬁ é", "A|b. c|| 12a ²½", "日本 語 😀"):
        assert w.ids(text) == np.array(w.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
