import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest

from flowquarry.llm import mixing


def targets_by_hand(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    wanted, full, target = 1.5 * sum(sizes.values()), set(), {}
    while True:
        free = [s for s in names if s not in full]
        rest = wanted - sum(2 * sizes[s] for s in full)
        target = {s: 2.0 * sizes[s] if s in full else rest * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] > 2 * sizes[s]}
        if not over:
            return target
        full |= over


def brute_mix(rows):
    """(doc_id, text) of every taking, from (doc_id, text, source)."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, _ in rows]
    sizes = Counter()
    for (_, _, source), w in zip(rows, words, strict=True):
        sizes[source] += len(w)
    out = []
    for source, target in targets_by_hand(sizes).items():
        own = sorted((hashlib.md5(("" if i is None else str(i)).encode()).hexdigest(), -1 if i is None else i, len(w), i, t, w) for (i, t, s), w in zip(rows, words, strict=True) if s == source)
        for begin in (0, sizes[source]):
            for _, _, n, i, text, w in own:
                take = max(0, min(n, math.floor(target + 0.5) - begin))
                begin += n
                if take:
                    out.append((i, text if take == n else " ".join(w[:take])))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 500, None: 40}, {"a": 5}, {"a": 1, "b": 1, "c": 1, "d": 90_000}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    df = df.selectExpr("coalesce(concat('s', source), 't') source", "source_size")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = targets_by_hand(sizes)
    assert got == {("t" if s is None else f"s{s}"): pytest.approx(t) for s, t in want.items()}


def test_taken_words_meet_targets_and_order_follows_positions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.mixture(docs, keep=["source"]).collect()
    sizes = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()}
    by = defaultdict(list)
    for r in rows:
        assert r.size == sizes[r.doc_id] and 0 <= r.taken <= 2 * r.size
        by[r.source].append(r)
    for own in by.values():
        assert sum(r.taken for r in own) == pytest.approx(own[0].target, abs=1)
    seen = [r.position for r in rows if r.position is not None]
    assert seen == sorted(seen)
    again = {(r.doc_id, r.taken, r.position) for r in mixing.mixture(docs.repartition(3)).collect()}
    assert again == {(r.doc_id, r.taken, r.position) for r in rows}


def test_mix_repeats_and_cuts_texts(spark, odd_docs, no_docs):
    mixed = mixing.mix(odd_docs).collect()
    plan = mixing.plan(odd_docs).collect()
    words = Counter()
    for r in mixed:
        words[r.doc_id] += len((r.text or "").encode().split())
        assert r.fingerprint == "clash" and r.n_chars == len(r.text)
    want = Counter()
    for r in plan:
        want[r.doc_id] += r.taken
    assert {k: v for k, v in want.items() if v} == dict(words)
    assert sorted(((r.doc_id, r.text) for r in mixed), key=str) == brute_mix([(r.doc_id, r.text, r.source) for r in odd_docs.collect()])
    assert mixing.mix(no_docs).count() == 0 and mixing.mixture(no_docs).count() == 0


def test_sources_all_null(spark):
    docs = spark.createDataFrame([(i, "a b c " * i, None) for i in range(5)], "doc_id long, text string, source string")
    rows = mixing.plan(docs).collect()
    assert {r.source_size for r in rows} == {30} and {r.target for r in rows} == {45.0} and sum(r.taken for r in rows) == 45
    assert sorted(((r.doc_id, r.text) for r in mixing.mix(docs).collect()), key=str) == brute_mix([(r.doc_id, r.text, r.source) for r in docs.collect()])
