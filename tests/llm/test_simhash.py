import random

import numpy as np
import xxhash

from flowquarry.llm import simhash
from flowquarry.llm.queries import op9_simhash


def fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, radius=2):
    """{doc_id: smallest id reachable} by comparing all pairs."""
    ids = sorted(prints)
    v = np.array([prints[i] for i in ids], np.uint64)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in np.nonzero(np.bitwise_count(v[i + 1 :] ^ v[i]) <= radius)[0] + i + 1:
            a, b = sorted((find(i), find(int(j))))
            root[b] = a
    return {ids[i]: ids[find(i)] for i in range(len(ids))}


def test_query_against_brute_force(spark):
    path = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    prints = {i: fingerprint(t) for i, t in docs.items()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op9_simhash(spark, path).collect()}
    want = components(prints)
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in docs}
    assert len(set(want.values())) < len(docs)


def test_links_against_brute_force_with_dense_and_chunked_tiles(spark, monkeypatch):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = set(base) | {0, 1, 2**64 - 1, 2**63}
    for b in base[:20]:
        for _ in range(12):
            b ^= 1 << rng.randrange(64)
            prints.add(b)
    prints |= {b ^ (1 << i) ^ (1 << j) for b in base[:2] for i in range(64) for j in range(i)}
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    want = components({s: s % 2**64 for s in signed})
    for rows in (simhash.CHUNK_ROWS, 1):
        monkeypatch.setattr(simhash, "CHUNK_ROWS", rows)
        got = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
        assert {s: got.get(s, s) for s in signed} == want


def test_long_chains(spark):
    pairs = [(i, i + 1) for i in range(300)] + [(1000 + i, 1000) for i in range(1, 50)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert set(got.values()) == {0, 1000} and len(got) == 300 + 49


def test_odd_rows(spark, odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r.component_id for r in rows if r.doc_id is not None}
    assert by[2] == by[3] == 2 and by[6] == 0 and by[5] == 5
    assert [r.component_id for r in rows if r.doc_id is None] == [0]
    kept = simhash.keep_one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns and 6 not in {r.doc_id for r in kept.collect()} and 3 not in {r.doc_id for r in kept.collect()}
    assert simhash.near_duplicates(no_docs).count() == 0
