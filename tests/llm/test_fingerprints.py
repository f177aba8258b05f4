import hashlib

import numpy as np
import pytest

from flowquarry.llm import fingerprints as fp
from flowquarry.llm.queries import op2_document_fingerprints


def test_query_against_brute_force(spark, sf_dir):
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()))
    got = {r.doc_id: r for r in op2_document_fingerprints(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for i, (doc_id, text) in enumerate(docs):
        following = docs[(i + 1) % len(docs)][1]
        k = len(text) // 4
        changed = text[: len(text) - k] + following[:k]
        r = got[doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.fingerprint == fp.written(fp.sketch(text)) and r.edited_fingerprint == fp.written(fp.sketch(changed))
        assert r.near_next == fp.likeness(fp.sketch(text), fp.sketch(following))


def exact(a: str, b: str) -> tuple[float, float]:
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split())]
    both = len(sets[0] & sets[1])
    return both / len(sets[0] | sets[1]), both / len(sets[0])


def test_estimates_are_near_the_exact_shares():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(5000)]
    text = lambda n: " ".join(rng.choice(words, n))
    small, rest = text(4000), text(40_000)
    long = f"{small} {rest}"
    a, b = fp.sketch(small), fp.sketch(long)
    assert fp.containment(a, b) == pytest.approx(exact(small, long)[1], abs=0.05)
    assert fp.likeness(a, b) == pytest.approx(exact(small, long)[0], abs=0.03)
    merged = fp.merged(a, fp.sketch(rest))
    assert fp.likeness(merged, b) > 0.95
    assert fp.read(fp.written(a))[0] == a[0] and (fp.read(fp.written(a))[1] == a[1]).all()


def test_short_and_empty_texts():
    e, one = fp.sketch(""), fp.sketch("one two")
    assert fp.likeness(e, e) == 1 and fp.likeness(e, one) == 0 and fp.likeness(one, one) == 1 and fp.containment(e, one) == 1


def test_odd_rows(spark, odd_docs, no_docs):
    rows = fp.fingerprint_documents(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert [r.n_chars for r in rows if r.doc_id == 2] == [0]
    assert fp.fingerprint_documents(no_docs).count() == 0
    assert fp.fingerprint_documents(odd_docs.where("doc_id = 7")).first().near_next == 1.0
