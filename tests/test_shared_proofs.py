"""Proofs that share their siblings: verdicts as with whole paths, and little stored for each receipt."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from flowquarry.operators import audit
from flowquarry.plans import catalogue


@pytest.mark.parametrize("size", [2, 4, 4096])
def test_verdicts_are_those_of_whole_paths(spark, size):
    rows = [(i, [5.0, 70.0, 70.0, 300.0, 301.0][i % 5], None if i % 3 else "s", f"10.0.0.{i}", "DDoS") for i in range(90)]
    a = spark.createDataFrame(rows, "id long, ts double, sensor string, src string, threat_class string")
    sealed = audit.build_receipts(a.where("id < 80"), evidence=["src"], decision=["threat_class"])
    blocks, shared = audit.seal(sealed, seconds=60, size=size)
    assert sorted(blocks.collect()) == sorted(audit.checkpoint_blocks(sealed, seconds=60).collect())
    later = audit.build_receipts(a, evidence=["src"], decision=["threat_class"])  # 80 and above came after the seal
    now = later.withColumn("evidence_digest", F.when(F.col("id") % 11 == 3, "changed").otherwise(F.col("evidence_digest")))
    known = blocks.where("window_start <> 60")
    forged = lambda p: p.where("id % 7 <> 2").unionByName(p.where("id = 15").withColumn("id", F.lit(85).cast("long")))
    paths = forged(audit.inclusion_proofs(sealed, seconds=60))
    want = sorted(audit.inclusion(now, known, paths).collect())
    got = sorted(audit.inclusion(now, known, shared._replace(places=forged(shared.places))).collect())
    assert got == want and {v for _, v in want} == {"PASS", "FAIL", "UNVERIFIABLE"} and len(want) == 90


def test_receipts_follow_each_other_over_ranges(spark):
    rows = [(i, i * 1.5 if i % 9 else None, [None, "a", "b"][i % 3], f"10.0.0.{i}", "DDoS") for i in range(400)]
    a = spark.createDataFrame(rows, "id long, ts double, sensor string, src string, threat_class string").repartition(5)
    receipts = audit.build_receipts(a, evidence=["src"], decision=["threat_class"], keep=["src"]).collect()
    for sensor in (None, "a", "b"):
        own = sorted((r for r in receipts if r.sensor == sensor), key=lambda r: r.seq)
        assert [r.seq for r in own] == list(range(1, len(own) + 1)) and len(own) == sum(r[2] == sensor for r in rows)
        assert own[0].previous == audit.GENESIS and all(b.previous == a.digest for a, b in zip(own, own[1:]))
        assert all(r.src == f"10.0.0.{r.id}" for r in own)


@pytest.mark.parametrize("name", ["au1_verify_alerts", "jn12_inclusion"])
def test_little_is_stored_for_each_receipt(spark, sf_dir, name):
    root = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    stored = lambda: sum(p.stat().st_size for p in root.rglob("part-*"))
    before = stored()
    df = catalogue.queries()[name](spark, sf_dir.replace("0.001", "0.01"))
    assert df.count() == 10_000 and stored() - before < 250 * 10_000
