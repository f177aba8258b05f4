import hashlib
import random
import shutil

import numpy as np

from flowquarry.llm import substring_index as si


def brute(docs):
    docs = [(i, (t or "").encode().split()) for i, t in docs]
    first = {}
    for i, w in docs:
        for s in range(len(w) - 12):
            key = tuple(w[s : s + 13])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in docs:
        gone = {p for s in range(len(w) - 12) if first[tuple(w[s : s + 13])] < i for p in range(s, s + 13)}
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def brute_texts(docs):
    """(doc_id, text) of what is left of each document, without those that lose everything; null ids take no part."""
    first, out = {}, []
    split = lambda t: (t or "").encode().split()
    for i, t in docs:
        w = split(t)
        for s in range(len(w) - 12) if i is not None else ():
            key = tuple(w[s : s + 13])
            first[key] = min(first.get(key, i), i)
    for i, t in docs:
        w = split(t)
        gone = {p for s in range(len(w) - 12) if i is not None and first[tuple(w[s : s + 13])] < i for p in range(s, s + 13)}
        if len(gone) < len(w) or not gone:
            out.append((i, b" ".join(x for p, x in enumerate(w) if p not in gone).decode() if gone else t))
    return out


def corpus(n=120, seed=3):
    rng = random.Random(seed)
    shared = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([12, 13, 14, 40]))) for _ in range(12)]
    word = lambda: rng.choice("abcdefghijklmnop") * rng.choice([1, 2, 3])
    docs = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 30))) for _ in range(3)]
        docs.append((i * 7, f"{parts[0]} {rng.choice(shared)}\t{parts[1]}\n{rng.choice(shared)} {parts[2]}"))
    return docs + [(n * 7, docs[0][1]), (n * 7 + 1, docs[0][1]), (n * 7 + 2, ""), (n * 7 + 3, None)]


def test_against_brute_force_in_batches_and_with_compaction(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for batches, runs in ((1, 2), (3, 1), (5, 2)):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in si.deduplicate(df, batches=batches, max_runs=runs).collect()}
        assert got == brute(docs)


def test_runs_are_compacted(spark):
    df = spark.createDataFrame(corpus(40), "doc_id long, text string")
    index = si.SubstringIndex(spark, max_runs=1)
    for k in range(3):
        index.add(df.where(f"doc_id % 3 = {k}"))
        assert len(index.runs) == 1
    table = spark.table(index.runs[0])
    assert table.count() == table.select("fp").distinct().count()
    index.drop()


def test_filter_on_fingerprints_of_windows():
    """Fingerprints are minima, so far from uniform: segments must fill alike and false positives stay rare."""
    rng = np.random.default_rng(5)
    h = rng.integers(0, 2**64, 120_000, dtype=np.uint64)
    fp = np.unique(si._windows(h, np.array([0, len(h)]), si.WINDOW, si.GRAM)[2])
    inside, outside = fp[::2], fp[1::2]
    counts = np.bincount(si._segment(inside), minlength=si.SEGMENTS)
    assert counts.max() < 2 * counts.mean() and counts.min() > counts.mean() / 2
    segment_bits = 1 << int(16 * len(inside) // si.SEGMENTS).bit_length()
    segments = {}
    for k in range(si.SEGMENTS):
        bits = np.zeros(segment_bits, bool)
        for place in si.BitFilter.places(inside[si._segment(inside) == k], segment_bits):
            bits[place] = True
        segments[k] = np.packbits(bits, bitorder="little").tobytes()
    f = si.BitFilter(segment_bits, segments)
    assert f.has(inside).all() and f.has(outside).mean() < 0.02


def test_filter_is_built_without_false_negatives(spark):
    x = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 5000)
    f = si.bit_filter(spark.createDataFrame([(int(v),) for v in x], "fp long"))
    assert f.has(x.view(np.uint64)).all()


def test_later_batches_need_no_earlier_texts(spark, tmp_path):
    docs = corpus(60)
    expected = brute(docs)
    index = si.SubstringIndex(spark, max_runs=2)
    got = {}
    for k, part in enumerate((docs[:25], docs[25:30], docs[30:])):
        path = str(tmp_path / str(k))
        spark.createDataFrame(part, "doc_id long, text string").write.parquet(path)
        got |= {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in index.add(spark.read.parquet(path)).collect()}
        shutil.rmtree(path)
    assert got == expected
    index.drop()
    assert not index.runs and not index.passages


def test_a_full_filter_loses_nothing(spark):
    docs = corpus(40)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in si.deduplicate(df, most_bits=si.SEGMENTS * 64).collect()}
    assert got == brute(docs)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = si.deduplicate(odd_docs.select("doc_id", "text")).collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].n_removed == 60 and by[0][0].n_removed == 0 and by[6][0].n_removed == 0
    assert [r.n_removed for r in by[5]] == [0, 0] and by[None][0].n_removed == 0
    kept = si.strip_repeats(odd_docs)
    assert kept.columns == odd_docs.columns
    one = kept.where("doc_id = 1").first()
    assert one.text == "Intro here. and the end" and one.n_chars == len(one.text) and one.fingerprint == "clash"
    assert si.deduplicate(no_docs.select("doc_id", "text")).count() == 0
