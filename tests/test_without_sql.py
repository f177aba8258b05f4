"""Queries that SQL does not express, against plain loops, numpy, or properties that their results must have."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowquarry.functions import text
from flowquarry.operators import evaluate, models
from flowquarry.plans import audits, catalogue, streams, views
from test_ordered import trailing

#: What is tested here or, for ml5_host_baseline, in test_embeddings.
COVERED = {
    "win3_throttle", "win21_guarded_threshold", "mth6_fft_prominence_capped", "mth7_fft_features", "hsh1_merkle_roots", "ev6_boot_auc", "ml1_train_flood", "ml2_train_scan_tree",
    "ml3_train_domain_model", "ml4_lexical_anomaly", "ml5_host_baseline", "stm7_stream_calibrate", "stm8_stream_lifecycle",
}


def rows_of(name, spark, sf_dir):
    return catalogue.queries()[name](spark, sf_dir).collect()


@pytest.fixture(scope="module")
def flows(spark, sf_dir):
    return views.flows(spark, sf_dir).collect()


def test_all_are_covered():
    assert catalogue.queries().keys() - catalogue.oracle_sql().keys() == COVERED


def assembled(flows, idle=7200.0, active=86_400.0, linger=10.0, probe=300.0):
    packets = defaultdict(list)
    for f in flows:
        flags = f.syn * 2 + f.ack * 16 + f.rst * 4 + f.fin
        ends = sorted([f"{f.src}|40000", f"{f.dst}|{f.dport}"])
        key = f"{ends[0]}|{ends[1]}|{f.proto}"
        packets[key].append((f.ts, f.src, 40000, flags, f.fwd_bytes))
        if f.bwd_pkts > 0:
            packets[key].append((f.ts + 1, f.dst, f.dport, 16, f.bwd_bytes))
    out = []
    for key, own in packets.items():
        flow, closed = None, None
        for ts, src, sport, flags, size in sorted(own, key=lambda p: p[0]):
            if flow is None and closed is not None and ts - closed <= linger and not (flags & 2 and not flags & 16):
                continue
            if flow and ts - flow["last"] > (probe if sum(flow["pkts"]) == 1 else idle):
                out.append((key, flow, "probe" if sum(flow["pkts"]) == 1 else "idle"))
                flow = None
            flow = flow or {"first": ts, "src": (src, sport), "pkts": [0, 0], "bytes": [0, 0]}
            back = (src, sport) != flow["src"]
            flow["pkts"][back] += 1
            flow["bytes"][back] += size
            flow["last"] = ts
            why = "fin" if flags & 1 else "rst" if flags & 4 else "active" if ts - flow["first"] > active else None
            if why:
                out.append((key, flow, why))
                closed = ts if why != "active" else None
                flow = None
        if flow:
            out.append((key, flow, "end"))
    return out


def test_flows(spark, sf_dir, flows):
    times = Counter((f.src, f.dst, f.dport, f.proto, t) for f in flows for t in ([f.ts, f.ts + 1] if f.bwd_pkts else [f.ts]))
    assert max(times.values()) == 1  # no two packets of a key at one time, so their order is known
    want = sorted((k, f["first"], f["last"], *f["pkts"], *f["bytes"], why, sum(f["pkts"]) == 1) for k, f, why in assembled(flows))
    got = rows_of("ses1_assemble_flows", spark, sf_dir)
    assert sorted((r.key, r.first_ts, r.last_ts, r.fwd_pkts, r.bwd_pkts, r.fwd_bytes, r.bwd_bytes, r.ended, r.stub) for r in got) == want


def test_throttled_evaluations(spark, sf_dir, flows):
    n = {i: s[0] for i, s in trailing([(f.event_id, f.dst, f.ts, None, 0) for f in flows], 7200.0).items()}
    state, want = {}, set()
    for f in sorted(flows, key=lambda f: (f.ts, f.event_id)):
        last, judged = state.get(f.dst, (-1e18, 0))
        m = n[f.event_id]
        if f.ts - last >= 3600 or m >= 2 * judged and m - judged >= 5:
            state[f.dst] = (f.ts, m)
            want.add((f.event_id, f.dst, m))
    assert {tuple(r) for r in rows_of("win3_throttle", spark, sf_dir)} == want


def test_guarded_thresholds(spark, sf_dir, flows):
    by = defaultdict(list)
    for f in sorted(flows, key=lambda f: f.event_id):
        by[f.dst].append((f.event_id, f.value, f.k % 10 != 0))
    want = {}
    for key, own in by.items():
        limit, ring, row, frozen = float("inf"), [], 0, False
        for i, (seq, score, eligible) in enumerate(own, 1):
            alert = score > limit
            want[seq] = (key, limit, alert, frozen)
            row = row + 1 if alert else 0
            frozen |= row >= 8
            if eligible and not alert:
                ring.append(score)
            if i % 50 == 0 and len(ring) >= 50 and not frozen:
                x = np.array(ring[-5000:])
                aim, most = np.quantile(x, 0.99), 0.5 * 1.4826 * np.median(np.abs(x - np.median(x)))
                limit = aim if limit == float("inf") else limit + min(most, max(-most, aim - limit))
    got = rows_of("win21_guarded_threshold", spark, sf_dir)
    assert len(got) == len(want)
    for r in got:
        key, limit, alert, frozen = want[r.seq]
        assert (r.key, r.alert, r.frozen) == (key, alert, frozen) and r.threshold == pytest.approx(limit)


def gaps_of(flows):
    by = defaultdict(list)
    for f in sorted(flows, key=lambda f: (f.ts, f.event_id)):
        by[f.user_id].append(f.ts)
    return {u: np.diff(t) for u, t in by.items()}


def spectrum(x):
    """Magnitudes of a discrete Fourier transform, written out, without the constant."""
    n = len(x)
    return np.array([abs(sum(v * np.exp(-2j * np.pi * f * i / n) for i, v in enumerate(x))) for f in range(1, n // 2 + 1)])


def test_spectra(spark, sf_dir, flows):
    gaps = gaps_of(flows)
    capped = {r.user_id: r.prominence for r in rows_of("mth6_fft_prominence_capped", spark, sf_dir)}
    features = {r.user_id: r for r in rows_of("mth7_fft_features", spark, sf_dir)}
    assert capped.keys() == features.keys() == gaps.keys()
    for user, x in gaps.items():
        f = features[user]
        if len(x) < 4:
            assert capped[user] == 0 and (f.score, f.entropy) == (0, 1)
            continue
        a = spectrum(x[:128] - x[:128].mean())
        assert capped[user] == pytest.approx(min(1, a.max() / a.mean() / len(x[:128])), abs=1e-5)
        p = spectrum(x - x.mean()) ** 2
        at = p.argmax()
        share = p / p.sum()
        assert f.score == pytest.approx(share.max(), abs=1e-6) and f.frequency == pytest.approx((at + 1) / len(x))
        assert f.entropy == pytest.approx(-(share * np.log2(share)).sum() / np.log2(max(2, len(share))), abs=1e-6)
        assert f.harmonic_ratio == pytest.approx((p[at] + sum(p[i] for i in range(2 * at + 1, len(p), at + 1))) / p.sum(), abs=1e-6)


def test_merkle_roots(spark, sf_dir):
    def root(x):
        if len(x) < 2:
            return x[0] if x else hashlib.sha256(b"").digest()
        k = 1 << (len(x) - 1).bit_length() - 1
        return hashlib.sha256(b"\x01" + root(x[:k]) + root(x[k:])).digest()

    leaves = defaultdict(list)
    for r in sorted(audits._receipts(spark, sf_dir).collect(), key=lambda r: (r.ts, r.id)):
        leaves[int(r.ts // 86_400) * 86_400].append(hashlib.sha256(b"\0" + r.digest.encode()).digest())
    got = {r.window_start: (r.root, r.n) for r in rows_of("hsh1_merkle_roots", spark, sf_dir)}
    assert set(got) == set(range(min(leaves), max(leaves) + 1, 86_400))
    assert got == {w: (root(leaves[w]).hex(), len(leaves[w])) for w in got}


def test_bootstrap(spark, sf_dir):
    (r,) = rows_of("ev6_boot_auc", spark, sf_dir)
    auc = evaluate.roc_auc(views.scores(spark, sf_dir)).first().auc
    assert r.low < r.mean < r.high and r.low <= auc <= r.high and abs(r.mean - auc) < 0.05
    assert rows_of("ev6_boot_auc", spark, sf_dir) == [r]


def test_models_learn_what_tells_the_classes_apart(spark, sf_dir, flows):
    error = {f.event_id: f.event_type == "error" for f in flows}
    got = {r.event_id: r.flood for r in rows_of("ml1_train_flood", spark, sf_dir)}
    assert got.keys() == error.keys() and sum(got[i] == error[i] for i in got) / len(got) > 0.99
    silent = Counter((f.src, int(f.ts // 86_400)) for f in flows if f.bwd_pkts == 0)
    days = {(f.src, int(f.ts // 86_400)) for f in flows}
    assert {(r.src, r.day): r.prediction for r in rows_of("ml2_train_scan_tree", spark, sf_dir)} == {d: float(silent[d] >= 2) for d in days}


def test_domain_model(spark, sf_dir):
    got = rows_of("ml3_train_domain_model", spark, sf_dir)
    assert len({r.page_id for r in got}) == views.dns(spark, sf_dir).count() and {r.prediction for r in got} <= {0.0, 1.0}
    rng = np.random.default_rng(3)
    make = lambda letters: "".join(rng.choice(list(letters), 12)) + ".com"
    names = spark.createDataFrame([(make("qxzjkvw0123"), 1.0) for _ in range(60)] + [(make("aeiourstln"), 0.0) for _ in range(60)], "name string, label double")
    model = models.train_domain_model(names)
    fresh = spark.createDataFrame([(make("qxzjkvw0123"), 1.0) for _ in range(20)] + [(make("aeiourstln"), 0.0) for _ in range(20)], "name string, label double")
    assert model.transform(fresh.withColumn("grams", models.name_grams(F.col("name")))).where("prediction = label").count() == 40


def test_lexical_anomaly(spark, sf_dir):
    feats = text.dns_lexical(F.col("name"))
    d = views.dns(spark, sf_dir).select("page_id", *[v.cast("double").alias(k) for k, v in feats.items()]).toPandas().set_index("page_id")
    x = d[list(feats)].to_numpy()
    std = x.std(axis=0, ddof=1)
    z = (x - x.mean(axis=0)) / np.where(std > 0, std, 1)
    z[:, std == 0] = 0
    _, vectors = np.linalg.eigh(np.cov(z.T))
    part = z @ vectors[:, -4:]
    mse = dict(zip(d.index, ((z**2).sum(axis=1) - (part**2).sum(axis=1)) / z.shape[1], strict=True))
    got = rows_of("ml4_lexical_anomaly", spark, sf_dir)
    assert {r.page_id for r in got} == set(mse)
    for r in got:
        own = d.loc[r.page_id]
        assert r.mse == pytest.approx(mse[r.page_id], abs=1e-5)
        sure = 1 - np.exp(-(r.mse - 0.7) / 0.7) if r.mse > 0.7 else 0.0
        assert r.confidence == pytest.approx(max(0.75, sure) if own.entropy > 4 and own.len > 30 else sure, abs=1e-4)


def test_streamed_states(spark, sf_dir, flows):
    cuts = sorted(views.flows(spark, sf_dir).approxQuantile("ts", [i / streams.PARTS for i in range(1, streams.PARTS)], 0.01))
    part = lambda f: sum(f.ts >= c for c in cuts)
    state, want = defaultdict(lambda: "COMMISSIONING"), {}
    for f in sorted(flows, key=lambda f: (part(f), f.event_id)):
        s = state[f.user_id]
        ready = f.k % 2 == 0
        match f.event_type:
            case "purchase":
                s = "INCIDENT_HOLD"
            case "signup" if s == "INCIDENT_HOLD":
                s = "RECOMMISSIONING"
            case "error" if s != "INCIDENT_HOLD":
                s = "RECOMMISSIONING"
            case "view" if s == "SENTRY_PRIMARY":
                s = "ESCALATED"
            case "click" if s == "ESCALATED" or ready and s in ("COMMISSIONING", "RECOMMISSIONING"):
                s = "SENTRY_PRIMARY"
        state[f.user_id] = s
        want[f.event_id] = (f.user_id, s)
    assert {r.seq: (r.host, r.state) for r in rows_of("stm8_stream_lifecycle", spark, sf_dir)} == want

    errors, cells, thresholds = defaultdict(list), defaultdict(set), {}
    for k in range(streams.PARTS):
        own = [f for f in flows if part(f) == k]
        for f in own:
            if f.dst not in thresholds:
                errors[f.dst].append(f.value)
                cells[f.dst].add((f.src, int(f.ts // 3600)))
        for net in {f.dst for f in own} - thresholds.keys():
            if len(cells[net]) >= 24 and len({h % 24 for _, h in cells[net]}) >= 6:
                thresholds[net] = (pytest.approx(max(10.0, np.quantile(errors[net], 0.99))), len(cells[net]))
    assert {r.network: (r.threshold, r.device_hours) for r in rows_of("stm7_stream_calibrate", spark, sf_dir)} == thresholds
