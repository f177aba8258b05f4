"""Alignment against whole-text encoding, plain loops over byte ranges and plain counts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowquarry.llm import alignment
from flowquarry.llm.queries import op12_alignment

CHARACTERS = ["a", "b", " ", "  ", "\n", "\t", "é", "日", "😀", "the", "The", "ing", "'s", "12", "3", ".", "<|endoftext|>", "</s>", "<unk>", "<0x41>", " ", " ", "\x1c", "\x00", "　", "ﬁ", "​", "é", "\x85", "\r\n", "x" * 70]


@pytest.fixture(scope="module")
def tokenizers():
    return alignment.Tokenizers(*alignment.default_paths())


def plain(tokenizers, text):
    """(n_a, n_b, n_groups, n_links, n_shared, digest, Counter of linked pairs, links by place) from the whole text at once."""
    none = (0, 0, 0, 0, 0, "", Counter(), [])
    if not text:
        return none
    whole = (" " + text).encode()
    a, b = tokenizers.first.encode(" " + text, add_special_tokens=False).ids, tokenizers.second.encode(text)
    ends = []
    for ids, known in ((a, tokenizers.first_bytes), (b, tokenizers.second_bytes)):
        if b"".join(known[i] for i in ids) != whole:
            return none
        at = 0
        ends.append([at := at + len(known[i]) for i in ids])
    owner_b = [j for j, (lo, hi) in enumerate(zip([0, *ends[1]], ends[1])) for _ in range(hi - lo)]
    links = Counter((i, j) for i, (lo, hi) in enumerate(zip([0, *ends[0]], ends[0])) for j in owner_b[lo:hi])
    cuts = sorted(set(ends[0]) & set(ends[1]))
    groups, sides = [], [list(zip(ids, own)) for ids, own in zip((a, b), ends)]
    at = [0, 0]
    for cut in cuts:
        both = []
        for s in (0, 1):
            first = at[s]
            while at[s] < len(sides[s]) and sides[s][at[s]][1] <= cut:
                at[s] += 1
            both.append([str(i) for i, _ in sides[s][first : at[s]]])
        groups.append(both)
    said = ";".join(",".join(x) + "|" + ",".join(y) for x, y in groups)
    pairs = Counter(a[i] * tokenizers.base + b[j] for i, j in links)
    return len(a), len(b), len(cuts), len(links), sum(len(x) * len(y) for x, y in groups), hashlib.sha256(said.encode()).hexdigest(), pairs, sorted((i, j, n) for (i, j), n in links.items())


def same(found, tokenizers, text):
    expected = plain(tokenizers, text)
    assert found[:6] == expected[:6], repr(text)
    assert dict(zip(found[6].tolist(), found[7].tolist(), strict=True)) == expected[6], repr(text)


def test_odd_texts_cut_into_words_equal_whole_texts(tokenizers):
    random.seed(7)
    texts = ["".join(random.choices(CHARACTERS, k=random.randint(0, 30))) for _ in range(1500)]
    texts += [None, "", " ", "  ", "a ", " a", "a \n b", "\n\n", "▁", "a▁b", "x" * 5000, "aaaa " * 300, "a" + " " * 2000 + "b"]
    for text, found in zip(texts, alignment.WordAlignments(tokenizers).of_texts(texts), strict=True):
        same(found, tokenizers, text)


def test_words_are_forgotten_within_the_bound(tokenizers, monkeypatch):
    monkeypatch.setattr(alignment, "KEPT_WORDS", 3)
    store = alignment.WordAlignments(tokenizers)
    for text in ["one two three four", "five six", "one seven", ""]:
        (found,) = store.of_texts([text])
        same(found, tokenizers, text)
        assert len(store.places) <= 3 + 4


def test_row_products_are_matrix_products_in_any_step():
    rng = np.random.default_rng(1)
    for _ in range(20):
        left, right = rng.integers(0, 2, (7, 9)), rng.integers(0, 2, (9, 5))
        csr = [alignment.Csr(np.concatenate(([0], np.cumsum(m.sum(axis=1)))), np.nonzero(m)[1], m.shape[1]) for m in (left, right)]
        for cells in (1, 4, 1000):
            made = np.zeros((7, 5), int)
            for rows, columns, value in alignment.row_products(*csr, cells=cells):
                made[rows, columns] += value
            assert (made == left @ right).all()
        back = csr[0].transposed()
        assert [back.indices[back.indptr[i] : back.indptr[i + 1]].tolist() for i in range(9)] == [np.nonzero(left[:, i])[0].tolist() for i in range(9)]


def expected_rows(tokenizers, rows):
    done = [(doc_id, plain(tokenizers, text)) for doc_id, text in rows]
    counts = Counter(p for _, x in done for p in x[6])
    most: dict[int, int] = {}
    for p, n in counts.items():
        most[p // tokenizers.base] = max(most.get(p // tokenizers.base, 0), n)
    return [
        (d, *x[:5], sum(k for p, k in x[6].items() if counts[p] == most[p // tokenizers.base]), sum(k * counts[p] for p, k in x[6].items()), x[5]) for d, x in done
    ]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_group_links", "n_best", "count_sum", "groups_sha256"]


def key(row):
    return tuple((x is None, x) for x in row)


def test_query_equals_plain_counts(spark, sf_dir, tokenizers):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = [tuple(r[c] for c in COLUMNS) for r in op12_alignment(spark, sf_dir).collect()]
    assert sorted(found, key=key) == sorted(expected_rows(tokenizers, rows), key=key)


@pytest.mark.parametrize("frequent", [0, 40, 1 << 20])
def test_rare_pairs_come_by_a_join(spark, odd_docs, tokenizers, frequent):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    found = [tuple(r[c] for c in COLUMNS) for r in alignment.align_corpus(odd_docs, frequent=frequent).collect()]
    assert sorted(found, key=key) == sorted(expected_rows(tokenizers, rows), key=key)


def test_empty_table(spark, no_docs):
    assert alignment.align_corpus(no_docs).collect() == []
    assert alignment.token_links(no_docs).collect() == []


def test_links_of_every_token(spark, odd_docs, tokenizers):
    docs = odd_docs.where("doc_id in (1, 2, 3, 7, 8)").unionByName(odd_docs.where("doc_id = 9 and lang = 'fr'"))
    found: dict = {}
    for r in alignment.token_links(docs).collect():
        found.setdefault(r.doc_id, []).append((r.a_at, r.b_at, r.bytes))
    for r in docs.collect():
        assert sorted(found.get(r.doc_id, [])) == plain(tokenizers, r.text)[7]


def test_extra_columns_and_other_names(spark, odd_docs):
    other = odd_docs.select(F.col("doc_id").alias("id"), F.col("text").alias("body"), F.lit("x").alias("pairs"), F.lit(1).alias("row"))
    assert sorted(map(key, alignment.align_corpus(other, id_col="id", text_col="body").collect())) == sorted(map(key, alignment.align_corpus(odd_docs).collect()))
