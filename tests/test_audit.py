"""Receipts that were changed after their block was sealed."""

import hashlib

import pytest
from pyspark.sql import functions as F

from flowquarry.operators import audit

EVIDENCE = ["src"]


@pytest.mark.parametrize("size", [1, 4, 4096])
def test_sibling_paths_lead_to_the_roots(spark, size):
    rows = [(b * 100 + i, b, i) for b, n in enumerate((1, 2, 3, 7, 8, 13)) for i in range(n)]
    leaves = spark.createDataFrame(rows, "id long, block long, seq long").withColumn("leaf", audit.leaf_hash(F.col("id").cast("string")))
    proofs = leaves.join(audit.sibling_paths(leaves, size=size), ["id", "block"]).join(audit.merkle_roots(leaves), "block")
    got = audit.verify_inclusion(proofs).collect()
    assert len(got) == len(rows) and all(r.valid for r in got)


def plain_root(x):
    """The root of a tree that is split at the largest power of two below its size."""
    if len(x) == 1:
        return x[0]
    k = 1 << (len(x) - 1).bit_length() - 1
    return hashlib.sha256(b"\x01" + plain_root(x[:k]) + plain_root(x[k:])).digest()


def test_roots_over_several_levels_equal_the_plain_tree(spark):
    rows = [(b * 1000 + i, b, i, hashlib.sha256(b"%d %d" % (b, i)).hexdigest()) for b in range(1, 71) for i in range(b)]
    leaves = spark.createDataFrame([*rows, (-1, None, 0, "00")], "id long, block long, seq long, leaf string").repartition(7)
    want = {b: (plain_root([bytes.fromhex(r[3]) for r in rows if r[1] == b]).hex(), b) for b in range(1, 71)}
    assert {r.block: (r.root, r.n) for r in audit.merkle_roots(leaves, size=4).collect()} == want
    proofs = leaves.join(audit.sibling_paths(leaves, size=4), ["id", "block"]).join(audit.merkle_roots(leaves, size=8), "block")
    assert proofs.count() == len(rows) and all(r.valid for r in audit.verify_inclusion(proofs).collect())
    assert audit.merkle_roots(leaves.where("id < -1")).collect() == []


def test_one_block_is_many_tasks(spark):
    leaves = spark.range(0, 60_000, numPartitions=8).select("id", F.lit(3).cast("long").alias("block"), F.col("id").alias("seq"), audit.leaf_hash(F.col("id").cast("string")).alias("leaf"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would join partitions as small as these
    try:
        dealt = audit._dealt(audit._numbered(leaves, ["seq"]), 1024)
        per = [r.n for r in dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(per) > 1 and max(per) < 30_000
    (got,) = audit.merkle_roots(leaves, size=1024).collect()
    assert (got.n, got.root) == (60_000, plain_root([hashlib.sha256(b"\0%d" % i).digest() for i in range(60_000)]).hex())


def test_altered_and_added_receipts_are_not_included(spark):
    a = spark.createDataFrame([(i, i * 10.0, "s", f"10.0.0.{i}", "DDoS", 0.9) for i in range(20)], "id long, ts double, sensor string, src string, threat_class string, confidence double")
    first = a.where("id < 18")
    sealed = audit.build_receipts(first, evidence=EVIDENCE, decision=["threat_class"])
    blocks, proofs = audit.checkpoint_blocks(sealed, seconds=60), audit.inclusion_proofs(sealed, seconds=60)
    later = audit.build_receipts(a, evidence=EVIDENCE, decision=["threat_class"])  # 18 and 19 came after the seal
    fields = later.withColumn("decision_digest", F.when(F.col("id") == 3, "changed").otherwise(F.col("decision_digest")))
    with_digest = fields.withColumn("digest", F.when(F.col("id") == 7, "changed").otherwise(F.col("digest")))  # what a digest says does not count
    forged = proofs.unionByName(proofs.where("id = 17").withColumn("id", F.lit(18).cast("long")))
    replayed = a.select("id", F.lit("PASS").alias("verdict"), F.lit(False).alias("drift"))
    v = {r.id: r for r in audit.verify_alerts(a, with_digest, blocks, replayed, evidence=EVIDENCE, seconds=60, proofs=forged).collect()}
    assert {i: r.inclusion for i, r in v.items()} == {i: "FAIL" if i in (3, 18) else "UNVERIFIABLE" if i == 19 else "PASS" for i in range(20)}
    assert not v[3].holds and not v[18].holds
    bare = audit.verify_alerts(a, later, blocks, replayed, evidence=EVIDENCE, seconds=60).collect()
    assert {r.inclusion for r in bare} == {"UNVERIFIABLE"}


def test_removed_reordered_and_doubled_receipts_break_the_chain(spark):
    rows = [(i, i * 10.0, None if i % 2 else "s", f"10.0.0.{i}", "DDoS", 0.9) for i in range(40)]
    a = spark.createDataFrame(rows, "id long, ts double, sensor string, src string, threat_class string, confidence double")
    whole = audit.build_receipts(a, evidence=EVIDENCE, decision=["threat_class"])
    replayed = a.select("id", F.lit("PASS").alias("verdict"), F.lit(False).alias("drift"))
    blocks = audit.checkpoint_blocks(whole, seconds=60)
    claims = lambda receipts: {r.id: (r.chain, r.sequence) for r in audit.verify_alerts(a, receipts, blocks, replayed, evidence=EVIDENCE, seconds=60).collect()}
    good = ("PASS", "PASS")
    assert set(claims(whole).values()) == {good}
    removed = claims(whole.where("id <> 10"))  # 12 is the sensor's next
    assert removed.pop(10) == ("UNVERIFIABLE",) * 2 and removed.pop(12) == ("FAIL", "FAIL") and set(removed.values()) == {good}
    seq = F.when(F.col("id") == 20, 12).when(F.col("id") == 22, 11).otherwise(F.col("seq"))  # 20 and 22 change places
    moved = claims(whole.withColumn("seq", seq))
    assert [moved.pop(i)[0] for i in (20, 22, 24)] == ["FAIL"] * 3 and {m for m in moved.values()} == {good}
    doubled = claims(whole.unionByName(whole.where("id = 31").withColumn("id", F.lit(33).cast("long"))).where("not (id = 33 and seq = 17)"))
    assert doubled[31][1] == "FAIL" and doubled[33][1] == "FAIL"
