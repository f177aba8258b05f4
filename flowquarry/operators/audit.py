"""Audit: receipts, Merkle roots, chains of blocks, replay and verification."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ordered
from ..sources.corpus import shared_path
from . import alerts as alert_ops

GENESIS = "0" * 64


def leaf_hash(text: Column) -> Column:
    return F.sha2(F.concat(F.unhex(F.lit("00")), text.cast("binary")), 256)


def node_hash(left: Column, right: Column) -> Column:
    """The hash, in hex, of two hashes in hex."""
    return F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex(left), F.unhex(right)), 256)


class TreeHead:
    """The root of an ordered stream of leaf hashes: one pending subtree for each power of two."""

    def __init__(self):
        self.stack: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        size, h = 1, leaf
        while self.stack and self.stack[-1][0] == size:
            h = hashlib.sha256(b"\x01" + self.stack.pop()[1] + h).digest()
            size *= 2
        self.stack.append((size, h))

    def root(self) -> bytes:
        if not self.stack:
            return hashlib.sha256(b"").digest()
        h = self.stack[-1][1]
        for _, left in reversed(self.stack[:-1]):
            h = hashlib.sha256(b"\x01" + left + h).digest()
        return h


def _numbered(leaves: DataFrame, order: list[str]) -> DataFrame:
    """leaves with ``at``, a leaf's number in its block from 0, found in two levels."""
    return ordered.running_total(leaves.where("block is not null"), F.lit(1), order, by=["block"], name="at").withColumn("at", F.col("at") - 1)


def _dealt(nodes: DataFrame, size: int) -> DataFrame:
    """Nodes with ``part``, the aligned subtree of ``size`` nodes that they are in, each subtree in order in one task."""
    return nodes.withColumn("part", F.expr(f"at div {size}")).repartition("block", "part").sortWithinPartitions("block", "part", "at")


def _written(df: DataFrame, tag: str) -> str:
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return path


def _stored(df: DataFrame, tag: str) -> DataFrame:
    return df.sparkSession.read.parquet(_written(df, tag))


def merkle_roots(leaves: DataFrame, *, order: list[str] | None = None, size: int = 4096) -> DataFrame:
    """(block, root, n) from (block, leaf hash in hex, the columns of ``order``, of which the first is a number).

    A block is cut into aligned subtrees of ``size`` leaves (a power of two, from 2), which any tasks take; their heads are
    the leaves of the next level, up to one node a block. A task holds one hash for each power of two of a subtree. Leaves
    without a block are left out.
    """
    return _roots(_numbered(leaves, order or ["seq"]).select("block", "at", "leaf", F.lit(1).cast("long").alias("n")), max(size, 2))


def _roots(nodes: DataFrame, size: int) -> DataFrame:
    """(block, root, n) from nodes (block, at, leaf, n), which are numbered in their block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, head, n = None, TreeHead(), 0
        for batch in batches:
            out = []
            for b, part, leaf, below in batch[["block", "part", "leaf", "n"]].itertuples(index=False):
                if (b, part) != at:
                    if at is not None:
                        out.append((*at, head.root().hex(), n))
                    at, head, n = (b, part), TreeHead(), 0
                head.add(bytes.fromhex(leaf))
                n += below
            if out:
                yield pd.DataFrame(out, columns=["block", "at", "leaf", "n"])
        if at is not None:
            yield pd.DataFrame([(*at, head.root().hex(), n)], columns=["block", "at", "leaf", "n"])

    while True:
        nodes = _stored(_dealt(nodes, size).select("block", "part", "leaf", "n").mapInPandas(run, "block long, at long, leaf string, n long"), "subtrees")
        if not nodes.agg(F.max("at")).first()[0]:
            return nodes.select("block", F.col("leaf").alias("root"), "n")


def _levels(hashes: list[bytes]) -> list[list[bytes]]:
    """A tree from its leaves to its root; the last node of an odd level moves up as it is."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([hashlib.sha256(b"\x01" + x[i] + x[i + 1]).digest() if i + 1 < len(x) else x[i] for i in range(0, len(x), 2)])
    return levels


def _siblings(levels: list[list[bytes]], at: int) -> list[tuple[str, str]]:
    """(hash in hex, side) of the siblings from a leaf up to the root."""
    out = []
    for x in levels[:-1]:
        if at ^ 1 < len(x):
            out.append((x[at ^ 1].hex(), "L" if at & 1 else "R"))
        at >>= 1
    return out


SIBLINGS = "array<struct<hash:string,side:string>>"


def sibling_paths(leaves: DataFrame, *, order: list[str] | None = None, size: int = 4096) -> DataFrame:
    """(id, block, siblings) from (id, block, leaf hash in hex, the columns of ``order``), for verify_inclusion.

    Subtrees are those of merkle_roots: each level's siblings are found in subtrees of ``size`` nodes, and a leaf's are
    its own, then those of the subtree that it is in, and so on up.
    """
    return _paths(_numbered(leaves, order or ["seq"]), max(size, 2))


def _paths(nodes: DataFrame, size: int) -> DataFrame:
    """(id, block, siblings) of nodes (id, block, at, leaf), which are numbered in their block."""
    kind = nodes.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def subtree() -> pd.DataFrame:
            levels = _levels([bytes.fromhex(x) for _, _, x in held])
            rows = [(i, *now, at, levels[-1][0].hex(), _siblings(levels, j)) for j, (i, at, _) in enumerate(held)]
            return pd.DataFrame(rows, columns=["id", "block", "part", "at", "head", "low"])

        now, held = None, []
        for batch in batches:
            for i, b, part, at, leaf in batch[["id", "block", "part", "at", "leaf"]].itertuples(index=False):
                if held and (b, part) != now:
                    yield subtree()
                    held = []
                now = (b, part)
                held.append((i, at, leaf))
        if held:
            yield subtree()

    levels = []
    while not levels or levels[-1].agg(F.max("part")).first()[0]:
        dealt = _dealt(nodes, size).select("id", "block", "part", "at", "leaf")
        levels.append(_stored(dealt.mapInPandas(run, f"id {kind}, block long, part long, at long, head string, low {SIBLINGS}"), "siblings"))
        # a subtree's head stands by each of its nodes; the first one's is taken
        nodes = levels[-1].where(F.col("at") % size == 0).select("id", "block", F.col("part").alias("at"), F.col("head").alias("leaf"))
    found = levels.pop().select("id", "block", "at", F.col("low").alias("siblings"))
    while levels:
        above = found.select("block", F.col("at").alias("part"), F.col("siblings").alias("high"))
        found = levels.pop().join(above, ["block", "part"]).select("id", "block", "at", F.concat("low", "high").alias("siblings"))
    return found.select("id", "block", "siblings")


def verify_inclusion(proofs: DataFrame) -> DataFrame:
    """valid: whether the leaf hash and its siblings (hash in hex, side L or R) lead to the root."""
    fold = F.aggregate("siblings", F.col("leaf"), lambda h, s: F.when(s["side"] == "L", node_hash(s["hash"], h)).otherwise(node_hash(h, s["hash"])))
    return proofs.withColumn("valid", fold == F.col("root"))


def block_hash() -> Column:
    """The hash of a block (idx, stamp, unix_seconds, root, prev_hash, n)."""
    return F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in ("idx", "stamp", "unix_seconds", "root", "prev_hash", "n")]).cast("binary"), 256)


def build_chain(rows: DataFrame, *, chain: str = "chain") -> DataFrame:
    """Blocks (chain, idx, stamp, unix_seconds, root, prev_hash, n) from rows (chain, seq, stamp, unix_seconds, root, n):
    each block names the hash of the one before, which is all that is held of a chain."""

    def step(state: dict, stamp: str, at: int, root: str, n: int) -> tuple:
        idx, before = state["idx"], state["hash"]
        # as concat_ws in block_hash(), which leaves nulls out
        text = "|".join(str(x) for x in (idx, stamp, at, root, before, n) if x is not None)
        state.update(idx=idx + 1, hash=hashlib.sha256(text.encode()).hexdigest())
        return idx, before

    typed = rows.select(chain, "seq", F.col("stamp").cast("string").alias("stamp"), F.col("unix_seconds").cast("long").alias("unix_seconds"), "root", F.col("n").cast("long").alias("n"))
    out = ordered.folded(typed, [chain], ["seq"], needs=["stamp", "unix_seconds", "root", "n"], start=lambda: {"idx": 0, "hash": GENESIS}, step=step, adds={"idx": "long", "prev_hash": "string"})
    return out.select(chain, "idx", "stamp", "unix_seconds", "root", "prev_hash", "n")


def verify_chain(blocks: DataFrame, *, chain: str = "chain") -> DataFrame:
    """Per chain: the first block that does not name the hash of the one before (null if all do), and its blocks."""
    own = blocks.withColumn("hash", block_hash())
    before = own.select(chain, (F.col("idx") + 1).alias("idx"), F.col("hash").alias("expected"))
    linked = own.join(before, [chain, "idx"], "left")
    wrong = F.when(F.col("idx") == 0, F.col("prev_hash") != GENESIS).otherwise(F.coalesce(F.col("prev_hash") != F.col("expected"), F.lit(True)))
    return linked.groupBy(chain).agg(F.min(F.when(wrong, F.col("idx"))).alias("first_bad"), F.count("*").alias("blocks"))


def build_receipts(alerts: DataFrame, *, evidence: list[str], decision: list[str], keep: list[str] | None = None) -> DataFrame:
    """A receipt for each alert: digests of its evidence and decision, its sensor's sequence number and the digest of
    the receipt before, and the columns ``keep`` of the alert. A receipt's own digest leaves the chain out, so no fold is
    needed. Digests are dealt and stored as bytes, and a receipt's own is worked out as it is read."""
    keep = keep or []
    digests = {"evidence": alert_ops.canonical_digest(evidence), "decision": alert_ops.canonical_digest(decision)}
    base = alerts.select("id", "sensor", "ts", *keep, *[F.unhex(F.substring(d, len(TAG) + 1, 64)).alias(f"__{n}") for n, d in digests.items()])
    numbered = ordered.running_total(base, F.lit(1), ["ts", "id"], by=["sensor"], name="seq", before=["__evidence", "__decision"])
    own = lambda seq, e, d: receipt_digest(seq, tagged(F.col(e)), tagged(F.col(d)))
    earlier = F.unhex(own(F.col("seq") - 1, "before___evidence", "before___decision"))
    path = _written(numbered.select(*base.columns, F.col("seq").cast("int").alias("seq"), "opens", "closes", F.when(~F.col("opens"), earlier).alias("__previous")), "receipts")
    numbered = alerts.sparkSession.read.parquet(path)
    # the first receipt of a range follows the last one of another; these few are written beside the others
    last = numbered.where("closes").select(F.col("sensor").alias("__sensor"), (F.col("seq") + 1).alias("__seq"), F.unhex(own(F.col("seq"), "__evidence", "__decision")).alias("__last"))
    opening = numbered.where("opens and seq > 1").join(last, F.col("sensor").eqNullSafe(F.col("__sensor")) & (F.col("seq") == F.col("__seq")))
    beside = _written(opening.withColumn("__previous", F.col("__last")).select(*numbered.columns), "receipts")
    linked = alerts.sparkSession.read.schema(numbered.schema).parquet(path, beside).where("seq = 1 or __previous is not null")
    typed = linked.select("*", tagged(F.col("__evidence")).alias("evidence_digest"), tagged(F.col("__decision")).alias("decision_digest"))
    return typed.select("id", "sensor", "ts", "seq", "evidence_digest", "decision_digest", receipt_digest().alias("digest"), F.coalesce(F.lower(F.hex("__previous")), F.lit(GENESIS)).alias("previous"), *keep)


TAG = "sha256:"


def tagged(digest: Column) -> Column:
    """A digest's bytes as text."""
    return F.concat(F.lit(TAG), F.lower(F.hex(digest)))


def _short(text: Column, tag: str = "") -> Column:
    """Texts that are digests as their bytes, others longer than those, so that only equal texts are equal."""
    return F.when(text.rlike(f"^{tag}[0-9a-f]{{64}}$"), F.unhex(F.substring(text, len(tag) + 1, 64))).otherwise(F.concat(F.lit(" " * 33).cast("binary"), text.cast("binary")))


def receipt_digest(seq: Column | str = "seq", evidence: Column | str = "evidence_digest", decision: Column | str = "decision_digest") -> Column:
    """A receipt's own digest, from its fields."""
    number = F.col(seq) if isinstance(seq, str) else seq
    return F.sha2(F.concat_ws("|", "sensor", number.cast("string"), evidence, decision).cast("binary"), 256)


def _block_leaves(receipts: DataFrame, seconds: int) -> DataFrame:
    return receipts.select("id", (F.floor(F.col("ts") / seconds)).alias("block"), "ts", leaf_hash(F.col("digest")).alias("leaf"))


def inclusion_proofs(receipts: DataFrame, *, seconds: int = 60) -> DataFrame:
    """(id, window_start, siblings): what is kept of each receipt when its block is sealed."""
    return sibling_paths(_stored(_block_leaves(receipts, seconds), "leaves"), order=["ts", "id"]).select("id", (F.col("block") * seconds).alias("window_start"), "siblings")


def checkpoint_blocks(receipts: DataFrame, *, seconds: int = 60) -> DataFrame:
    """A block for each window of time from the first receipt to the last, empty ones too: root and count."""
    leaves = _stored(_block_leaves(receipts, seconds), "leaves")  # read for the cuts, the numbers and the spine
    return _all_blocks(leaves, merkle_roots(leaves, order=["ts", "id"]), seconds)


def _all_blocks(rows: DataFrame, roots: DataFrame, seconds: int) -> DataFrame:
    spine = rows.agg(F.min("block").alias("lo"), F.max("block").alias("hi")).where("lo is not null").select(F.explode(F.sequence("lo", "hi")).alias("block"))
    empty = hashlib.sha256(b"").hexdigest()
    return spine.join(roots, "block", "left").select((F.col("block") * seconds).alias("window_start"), F.coalesce("root", F.lit(empty)).alias("root"), F.coalesce("n", F.lit(0)).alias("n"))


class SharedProofs(NamedTuple):
    """Proofs of all receipts of blocks, which share their siblings: kept with each receipt they would take a hash for each
    level of the tree, here they take one leaf. ``places``: (id, window_start, at), what is kept for each receipt.
    ``subtrees``: (window_start, part, leaves), aligned subtrees' leaf hashes as bytes. ``above``: (window_start, part,
    siblings), each subtree's own path."""

    places: DataFrame
    subtrees: DataFrame
    above: DataFrame
    size: int


def seal(receipts: DataFrame, *, seconds: int = 60, size: int = 4096) -> tuple[DataFrame, SharedProofs]:
    """What checkpoint_blocks returns, and the proofs that are kept, from one numbering of the receipts (which are read
    three times). A task holds a subtree of ``size`` leaves (a power of two, from 2)."""
    size = max(size, 2)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def subtree() -> pd.DataFrame:
            row = (*now, _levels(leaves)[-1][0].hex(), len(ids), ids, b"".join(leaves))
            return pd.DataFrame([row], columns=["block", "part", "head", "n", "ids", "leaves"])

        now, ids, leaves = None, [], []
        for batch in batches:
            for i, b, part, leaf in batch[["id", "block", "part", "leaf"]].itertuples(index=False):
                if ids and (b, part) != now:
                    yield subtree()
                    ids, leaves = [], []
                now = (b, part)
                ids.append(i)
                leaves.append(bytes(leaf))
        if ids:
            yield subtree()

    kind = receipts.schema["id"].dataType.simpleString()
    numbered = _numbered(_block_leaves(receipts, seconds).withColumn("leaf", F.unhex("leaf")), ["ts", "id"])
    dealt = _dealt(numbered.select("id", "block", "at", "leaf"), size).select("id", "block", "part", "leaf")
    kept = _stored(dealt.mapInPandas(run, f"block long, part long, head string, n long, ids array<{kind}>, leaves binary"), "sealed")
    heads = kept.select("block", F.col("part").alias("at"), F.col("head").alias("leaf"), F.col("part").alias("id"), "n")
    blocks = _all_blocks(kept, _roots(heads, size), seconds)
    start = (F.col("block") * seconds).alias("window_start")
    places = kept.select(start, "part", F.posexplode("ids").alias("i", "id")).select("id", "window_start", (F.col("part") * size + F.col("i")).alias("at"))
    above = _paths(heads, size).select(start, F.col("id").alias("part"), "siblings")
    return blocks, SharedProofs(places, kept.select(start, "part", "leaves"), above, size)


def _led(levels: list[list[bytes]], at: int, h: bytes) -> bytes:
    """Where a hash in the place of leaf ``at`` leads to with that leaf's siblings."""
    for x in levels[:-1]:
        if at ^ 1 < len(x):
            h = hashlib.sha256(b"\x01" + (x[at ^ 1] + h if at & 1 else h + x[at ^ 1])).digest()
        at >>= 1
    return h


def _shared_verdicts(receipts: DataFrame, blocks: DataFrame, proofs: SharedProofs) -> DataFrame:
    """(id, inclusion) of the receipts that have a place: each is taken to its subtree, and from there up to the root."""
    kind, size = receipts.schema["id"].dataType.simpleString(), proofs.size

    def run(claims: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"id": claims["id"], "valid": False})
        if not len(claims) or not len(trees):
            return out
        data, hashes, sides, root = trees[["leaves", "hashes", "sides", "root"]].iloc[0]
        leaves = [data[i : i + 32] for i in range(0, len(data), 32)]
        levels = _levels(leaves)

        def included(h: bytes) -> bool:
            for i, side in enumerate(sides):
                s = hashes[32 * i : 32 * i + 32]
                h = hashlib.sha256(b"\x01" + (s + h if side == "L" else h + s)).digest()
            return h.hex() == root

        unchanged = included(levels[-1][0])  # where a leaf that is as it was leads to
        places = zip(claims["at"] % size, claims["leaf"], strict=True)
        out["valid"] = [at < len(leaves) and (unchanged if h == leaves[at] else included(_led(levels, at, h))) for at, h in places]
        return out

    mine = receipts.select("id", F.unhex(leaf_hash(receipt_digest())).alias("leaf"))
    claims = mine.join(proofs.places, "id").select("id", "leaf", "window_start", "at", F.expr(f"at div {size}").alias("part"))
    path = [F.unhex(F.array_join(F.transform("siblings", lambda s: s["hash"]), "")).alias("hashes"), F.array_join(F.transform("siblings", lambda s: s["side"]), "").alias("sides")]
    above = proofs.above.select("window_start", "part", *path).join(blocks.select("window_start", "root"), "window_start")
    trees = proofs.subtrees.join(above, ["window_start", "part"])
    at = ("window_start", "part")
    found = claims.groupBy(*at).cogroup(trees.groupBy(*at)).applyInPandas(run, f"id {kind}, valid boolean")
    return found.select("id", F.when(F.col("valid"), "PASS").otherwise("FAIL").alias("inclusion"))


def replay_alerts(alerts: DataFrame, digests: DataFrame) -> DataFrame:
    """Recomputes each alert's class and confidence, in parts per million, from its stored inputs (JSON in
    replay_inputs); verdict is PASS, FAIL or UNVERIFIABLE, and drift tells of a changed parameter digest."""
    from ..functions import stats

    i = F.from_json("replay_inputs", "rule string, rate double, share double, out_bytes double, ratio double, nx_rate double, nx double")
    one = F.lit(1.0)
    flood = 0.6 + 0.2 * stats.clamp01(F.log10(F.greatest(one, F.col("i.rate") / 100))) + 0.2 * stats.clamp01((F.col("i.share") - 0.8) / 0.2)
    exfil = 0.6 + 0.2 * stats.clamp01(F.log10(F.col("i.ratio") / 10)) + 0.2 * stats.clamp01(F.log10(F.col("i.out_bytes") / 5e6))
    burst = 0.6 + 0.25 * F.least(one, (F.col("i.nx_rate") - 0.5) / 0.5) + 0.15 * F.least(one, F.col("i.nx") / 80)
    again = F.when(F.col("i.rule") == "flood", flood).when(F.col("i.rule") == "exfil", exfil).when(F.col("i.rule") == "nx_burst", burst)
    threat = F.when(F.col("i.rule") == "flood", "DDoS").when(F.col("i.rule") == "exfil", "Data Exfiltration").when(F.col("i.rule") == "nx_burst", "DGA")
    out = alerts.withColumn("i", i).withColumns({"again_ppm": alert_ops.to_ppm(again), "again_class": threat}).join(
        F.broadcast(digests.select("rule", F.col("digest").alias("known_digest"))), F.col("i.rule") == F.col("rule"), "left",
    )  # a row a rule
    same = (F.col("again_class") == F.col("threat_class")) & (F.abs(F.col("again_ppm") - alert_ops.to_ppm(F.col("confidence"))) <= 1)
    return out.withColumns({
        "verdict": F.when(F.col("again_ppm").isNull(), "UNVERIFIABLE").when(same, "PASS").otherwise("FAIL"),
        "drift": F.col("known_digest").isNotNull() & (F.col("known_digest") != F.col("params_digest")),
    }).drop("i", "rule")


def inclusion(receipts: DataFrame, blocks: DataFrame, proofs: DataFrame | SharedProofs | None) -> DataFrame:
    """(id, inclusion) of each receipt: PASS if its digest, worked out anew, and the siblings kept when its block was sealed
    lead to the block's root, FAIL if not or if there is no such block, UNVERIFIABLE without siblings."""
    if proofs is None:
        return receipts.select("id", F.lit("UNVERIFIABLE").alias("inclusion"))
    if isinstance(proofs, SharedProofs):
        lost = receipts.select("id").join(proofs.places.select("id"), "id", "left_anti")
        return _shared_verdicts(receipts, blocks, proofs).unionByName(lost.select("id", F.lit("UNVERIFIABLE").alias("inclusion")))
    kept = proofs.select("id", F.col("window_start").alias("__window"), "siblings")
    found = receipts.select("id", leaf_hash(receipt_digest()).alias("leaf")).join(kept, "id", "left").join(blocks.select(F.col("window_start").alias("__window"), "root"), "__window", "left")
    verdict = F.when(F.col("siblings").isNull(), "UNVERIFIABLE").when(F.col("valid"), "PASS").otherwise("FAIL")
    return verify_inclusion(found).select("id", verdict.alias("inclusion"))


CLAIMS = ("schema", "evidence", "feature_source", "model_weights", "decision", "policy", "inclusion", "chain", "sequence")


def _links(receipts: DataFrame, *, piece: int = 4096) -> DataFrame:
    """receipts' (id, evidence, chain, sequence): whether each names the one before, which there is, and has its number
    alone. A sensor's receipts are dealt in pieces by number; the last number of a piece also goes to the next one."""
    c = F.col
    rows = receipts.select("id", "sensor", "seq", _short(c("evidence_digest"), TAG).alias("evidence"), _short(c("previous")).alias("previous"), _short(c("digest")).alias("digest"), F.expr(f"seq div {piece}").alias("at"))
    again = F.when(c("seq") % piece == piece - 1, F.array(c("at"), c("at") + 1)).otherwise(F.array("at"))
    dealt = rows.withColumn("piece", F.explode(again))
    w = Window.partitionBy("sensor", "piece").orderBy("seq")
    beside = dealt.withColumns({"before": F.min("digest").over(w.rangeBetween(-1, -1)), "many": F.count("*").over(w.rangeBetween(0, 0))}).where("piece = at or piece is null")
    known = c("seq").isNotNull()
    named = known & (c("previous") == F.when(c("seq") == 1, _short(F.lit(GENESIS))).otherwise(c("before")))
    return beside.select("id", "evidence", named.alias("chain"), (known & ((c("seq") == 1) | c("before").isNotNull()) & (c("many") == 1)).alias("sequence"))


def verify_alerts(alerts: DataFrame, receipts: DataFrame, blocks: DataFrame, replayed: DataFrame, *, evidence: list[str], seconds: int = 60, proofs: DataFrame | SharedProofs | None = None) -> DataFrame:
    """Nine claims for each alert, each PASS, FAIL or UNVERIFIABLE, and whether none fails. What is not kept, the source
    of features and the weights of models, is never verifiable; nor is the inclusion of a receipt without one of the
    proofs (inclusion_proofs, seal) that were kept when its block was sealed."""
    c = F.col
    say = lambda known, ok: F.when(known, F.when(ok, "PASS").otherwise("FAIL")).otherwise("UNVERIFIABLE")
    # what is dealt by id is short: bytes of digests and what was found
    sound = c("confidence").between(0, 1) & c("threat_class").isNotNull()
    own = alerts.select("id", sound.alias("__sound"), _short(alert_ops.canonical_digest(evidence), TAG).alias("__evidence"))
    links = _links(receipts).withColumnsRenamed({"evidence": "__receipt", "chain": "__chain", "sequence": "__sequence"})
    verdicts = _shared_verdicts(receipts, blocks, proofs) if isinstance(proofs, SharedProofs) else inclusion(receipts, blocks, proofs)
    j = own.join(links, "id", "left").join(verdicts.select("id", c("inclusion").alias("__sealed")), "id", "left").join(replayed.select("id", "verdict", "drift"), "id", "left")
    have = c("__receipt").isNotNull()
    claims = {
        "schema": say(F.lit(True), c("__sound")),
        "evidence": say(have, c("__receipt") == c("__evidence")),
        "feature_source": F.lit("UNVERIFIABLE"),
        "model_weights": F.lit("UNVERIFIABLE"),
        "decision": F.coalesce("verdict", F.lit("UNVERIFIABLE")),
        "policy": say(c("drift").isNotNull(), ~c("drift")),
        "inclusion": F.coalesce("__sealed", F.lit("UNVERIFIABLE")),
        "chain": say(have, c("__chain")),
        "sequence": say(have, c("__sequence")),
    }
    out = j.withColumns(claims)
    return out.withColumn("holds", ~F.array_contains(F.array(*CLAIMS), "FAIL")).select("id", *CLAIMS, "holds")
