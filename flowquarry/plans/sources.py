"""Queries of the readers and sinks: each writes what it derives from the given tables and reads that back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import behaviour
from ..operators import evaluate as ev
from ..sources import capture, capture_source, corpus, logs
from .registry import query
from .views import alerts, conns, dns, flows, from_wire, read, seconds, wired


def _put(df, fmt: str, **options) -> str:
    path = corpus.shared_path(df.sparkSession, fmt)
    df.write.options(**options).format(fmt).save(path)
    return path


def u(n: int, x) -> F.Column:
    """An unsigned big-endian number of n bytes."""
    return F.unhex(F.lpad(F.hex(x.cast("long")), 2 * n, "0"))


def _ip(col):
    p = F.split(col, r"\.")
    return F.concat(*[u(1, p[i]) for i in range(4)])


def little(n: int, x):
    h = F.lpad(F.hex(x.cast("long")), 2 * n, "0")
    return F.unhex(F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(n))]))


def _captures(f):
    """pcap files of 2,000 flows each: a UDP packet of eight bytes for each flow."""
    lit = lambda h: F.unhex(F.lit(h))
    udp = F.concat(u(2, F.col("sport")), u(2, F.col("dport")), u(2, F.lit(16)), u(2, F.lit(0)), F.encode(F.lpad(F.col("event_id").cast("string"), 8, "0"), "utf-8"))
    ip = F.concat(lit("4500"), u(2, F.lit(36)), lit("0000000040110000"), _ip(F.col("src")), _ip(F.col("dst")), udp)
    frame = F.concat(lit("000000000001000000000002" + "0800"), ip)
    micros = F.round((F.col("ts") - F.floor("ts")) * 1e6)
    record = F.concat(little(4, F.floor("ts")), little(4, micros), little(4, F.lit(50)), little(4, F.lit(50)), frame)
    per = f.groupBy(F.expr("event_id div 2000").alias("capture")).agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", F.hex(record).alias("r")))).alias("rs"))
    head = "d4c3b2a1020004000000000000000000ffff000001000000"
    return per.select("capture", F.unhex(F.concat(F.lit(head), F.array_join(F.transform("rs", lambda x: x["r"]), ""))).alias("content"))


@query("SELECT src, dst, 17 AS proto, sport, dport, 16 AS payload_size, 8 AS l4_len, count(*) AS n FROM flows GROUP BY ALL")
def src1_read_captures(spark, sf_dir):
    path = corpus.shared_path(spark, "captures")
    # The text writer puts bytes out as they are; the line feed it adds to a file is a cut-off record to the reader.
    _captures(wired(flows(spark, sf_dir))).select("capture", F.col("content").cast("string").alias("value")).write.partitionBy("capture").text(path)
    p = capture_source.read_capture_ranges(spark, path, split_bytes=32 << 10)
    return p.groupBy(from_wire(F.col("src")).alias("src"), "dst", "proto", "sport", "dport", (F.col("payload_size") - 0).alias("payload_size"), "l4_len").agg(F.count("*").alias("n"))


@query("SELECT page_id, name, qtype, true AS is_response, rcode, 1 AS answers, '203.0.113.' || (page_id % 250) AS answer_ip FROM dns")
def src2_dns_messages(spark, sf_dir):
    lit = lambda h: F.unhex(F.lit(h))
    d = dns(spark, sf_dir)
    labels = F.aggregate(F.split("name", r"\."), F.lit(b""), lambda a, x: F.concat(a, u(1, F.length(x)), F.encode(x, "utf-8")))
    head = F.concat(u(2, F.col("page_id") % 65536), F.unhex(F.lit("81")), u(1, F.col("rcode") + 128), lit("0001000100000000"))
    payload = F.concat(head, labels, lit("00"), u(2, F.col("qtype")), lit("0001"), lit("c00c000100010000003c0004cb0071"), u(1, F.col("page_id") % 250))
    p = d.select("ts", F.concat(F.lit("p"), "page_id").alias("src"), F.lit("r").alias("dst"), F.lit(53).alias("sport"), F.lit(4000).alias("dport"), F.lit(17).alias("proto"), payload.alias("payload"))
    m = capture.dns_messages(p)
    return m.select(F.substring("src", 2, 20).cast("long").alias("page_id"), "name", "qtype", "is_response", "rcode", "answers", F.col("answer_ips")[0].alias("answer_ip"))


@query("SELECT event_id::VARCHAR AS uid, src AS orig_h, dst AS resp_h, CASE WHEN k % 5 = 0 THEN NULL ELSE fwd_bytes END AS orig_bytes FROM flows")
def src3_read_zeek(spark, sf_dir):
    f = flows(spark, sf_dir)
    head = spark.createDataFrame([(i, x) for i, x in enumerate(["#separator \\x09", "#fields\tts\tuid\tid.orig_h\tid.resp_h\torig_bytes"])], "i int, value string")
    row = F.concat_ws("\t", F.col("ts").cast("string"), F.col("event_id").cast("string"), "src", "dst", F.when(F.col("k") % 5 == 0, "-").otherwise(F.col("fwd_bytes").cast("string")))
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    heads = head.crossJoin(spark.range(files).select(F.col("id").cast("int").alias("file")))  # two lines a log file
    lines = heads.unionByName(f.select(F.lit(2).alias("i"), row.alias("value"), F.pmod(F.xxhash64("event_id"), F.lit(files)).cast("int").alias("file")))
    dealt = lines.repartitionById(files, "file").sortWithinPartitions("file", "i").select("value")
    z = logs.read_zeek(spark, _put(dealt, "text", compression="gzip"), ["uid", "id.orig_h", "id.resp_h", "orig_bytes"])
    return z.select("uid", F.col("`id.orig_h`").alias("orig_h"), F.col("`id.resp_h`").alias("resp_h"), F.col("orig_bytes").cast("long").alias("orig_bytes"))


@query("SELECT src, dst, count(*) AS n, sum(fwd_bytes)::BIGINT AS bytes FROM flows WHERE k % 10 <> 0 GROUP BY ALL")
def src4_read_flow_csv(spark, sf_dir):
    f = flows(spark, sf_dir)
    bad = F.col("k") % 10 == 0
    t = f.select(
        F.when(bad, "x").otherwise(F.floor("ts").cast("string")).alias("a"), F.lit(0).alias("b"), "src", F.concat(F.lit("N"), "sport").alias("c"), "dst", "dport",
        F.lit("6").alias("d"), "fwd_pkts", "fwd_bytes",
    )
    return logs.read_flow_csv(spark, _put(t, "csv", compression="gzip")).groupBy("src", "dst").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query("SELECT floor(ts)::BIGINT AS time, 'u' || user_id AS user, src, dst FROM flows WHERE event_type = 'error'")
def src5_read_labels(spark, sf_dir):
    f = flows(spark, sf_dir).where("event_type = 'error'")
    return logs.read_labels(spark, _put(f.select(F.floor("ts").alias("t"), F.concat(F.lit("u"), "user_id", F.lit("@dom")).alias("u"), "src", "dst"), "csv"))


@query(
    "SELECT src, dst, (syn)::INT AS syn, (ack)::INT AS ack, round((CASE WHEN k % 3 = 0 THEN (k + 1) * 1000000 WHEN k % 3 = 1 THEN (k + 1) * 1000 ELSE k + 1 "
    "END)::DOUBLE, 3) AS bytes, CASE WHEN k % 4 = 0 THEN 'normal' ELSE 'attacker' END AS class, count(*) AS n FROM flows GROUP BY ALL"
)
def src6_read_labelled_flows(spark, sf_dir):
    f = flows(spark, sf_dir)
    k = F.col("k")
    size = F.concat((k + 1).cast("string"), F.when(k % 3 == 0, ".0 M").when(k % 3 == 1, " K").otherwise(""))
    flags = F.concat(F.lit("."), F.when(F.col("ack") == 1, "A").otherwise("."), F.lit("."), F.lit("."), F.when(F.col("syn") == 1, "S").otherwise("."), F.lit("."))
    t = f.select(
        F.date_format(F.timestamp_seconds(F.floor("ts")), "yyyy-MM-dd HH:mm:ss.SSS").alias("Date first seen"), F.lit(" TCP ").alias("Proto"), F.col("src").alias("Src IP Addr"), F.col("sport").alias("Src Pt"), F.col("dst").alias("Dst IP Addr"), F.col("dport").alias("Dst Pt"),
        F.lit("1").alias("Packets"), size.alias("Bytes"), flags.alias("Flags"), F.when(k % 4 == 0, "victim").otherwise("attacker").alias("class"), F.lit("-").alias("attackType"),
    )
    g = logs.read_labelled_flows(spark, _put(t, "csv", header="true"))
    return g.groupBy("src", "dst", "syn", "ack", F.round("bytes", 3).alias("bytes"), "class").agg(F.count("*").alias("n"))


@query("SELECT src, floor(ts)::DOUBLE AS ts, floor(ts) + k / 1000000.0 AS last_seen, CASE WHEN k % 6 = 0 THEN 0.0 ELSE value END AS flow_bytes_s FROM flows")
def src7_read_feature_csv(spark, sf_dir):
    f = flows(spark, sf_dir)
    k = F.col("k")
    fmt = F.when(k % 2 == 0, F.date_format(F.timestamp_seconds(F.floor("ts")), "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(F.timestamp_seconds(F.floor("ts")), "dd/MM/yyyy HH:mm:ss"))
    t = f.select(F.col("src").alias(" Src IP "), fmt.alias("Timestamp"), k.alias(" Flow Duration"), F.when(k % 6 == 0, "inf").otherwise(F.col("value").cast("string")).alias("Flow Bytes/s"))
    r = logs.read_feature_csv(spark, _put(t, "csv", header="true", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false"))
    return r.select(F.col("src_ip").alias("src"), "ts", "last_seen", "flow_bytes_s")


@query("SELECT 'orders' AS day_tag, count(*) AS n FROM orders")
def src8_read_flow_parquet(spark, sf_dir):
    return logs.read_flow_parquet(spark, f"{sf_dir}/orders.parquet").groupBy(F.lit("orders").alias("day_tag")).agg(F.count("*").alias("n"))


@query("SELECT cls, family, name AS domain FROM (SELECT CASE WHEN page_id % 2 = 0 THEN 'dga' ELSE 'legit' END AS cls, 'f' || (page_id % 7) AS family, name FROM dns WHERE page_id % 9 <> 0)")
def src9_read_domains(spark, sf_dir):
    d = dns(spark, sf_dir)
    t = d.select(
        F.when(F.col("page_id") % 2 == 0, "dga").otherwise("legit").alias("c"), F.concat(F.lit("f"), F.col("page_id") % 7).alias("f"),
        F.when(F.col("page_id") % 9 != 0, F.col("name")).alias("d"),
    )
    return logs.read_domains(spark, _put(t, "csv"))


@query("SELECT event_id, src, ts FROM flows WHERE k % 8 <> 0")
def src10_read_events_json(spark, sf_dir):
    f = flows(spark, sf_dir)
    line = F.when(F.col("k") % 8 == 0, F.lit('"no object"')).otherwise(F.to_json(F.struct("event_id", "src", "ts")))
    return logs.read_events_json(spark, _put(f.select(line.alias("value")), "text"), "event_id long, src string, ts double")


@query("SELECT ts, src, fwd_bytes AS bytes FROM flows")
def src11_read_conns(spark, sf_dir):
    t = flows(spark, sf_dir).select(F.to_json(F.array(F.col("ts").cast("string"), "src", F.col("fwd_bytes").cast("string"))).alias("value"))
    return logs.read_conns(spark, _put(t, "text", compression="gzip"), "ts double, src string, bytes long")


@query(
    r"SELECT 'host' AS what, dst AS a, NULL::INT AS b FROM (SELECT DISTINCT dst FROM flows) UNION ALL SELECT DISTINCT 'net', regexp_replace(dst, '\d+$', '0'), 24 FROM flows UNION "
    "ALL SELECT DISTINCT 'port', dst, dport FROM flows"
)
def src12_load_network_info(spark, sf_dir):
    """A file for each site, a network of 256 addresses."""
    ports = flows(spark, sf_dir).groupBy("dst").agg(F.sort_array(F.collect_set("dport")).alias("p"))  # at most all ports
    site = F.concat(F.substring_index("dst", ".", 3), F.lit(".0/24"))
    per = ports.groupBy(site.alias("cidr")).agg(F.sort_array(F.collect_list("dst")).alias("known_hosts"), F.map_from_entries(F.collect_list(F.struct("dst", "p"))).alias("known_open_ports"))
    path = corpus.shared_path(spark, "networks")
    per.select(F.translate("cidr", "/", "-").alias("site"), F.array("cidr").alias("internal_subnets"), "known_hosts", "known_open_ports").write.partitionBy("site").json(path)
    nets, hosts, opened, _ = logs.load_network_info(spark, path)
    none = F.lit(None).cast("int").alias("b")
    return hosts.select(F.lit("host").alias("what"), F.col("host").alias("a"), none).union(nets.select(F.lit("net"), "net", "bits")).union(opened.select(F.lit("port"), "host", "port"))


@query("SELECT DISTINCT 'j' || (k % 7) AS fingerprint, 'f' || (k % 7) AS label FROM flows")
def src13_load_blocklist(spark, sf_dir):
    pairs = flows(spark, sf_dir).select(F.struct(F.concat(F.lit("J"), F.col("k") % 7).alias("key"), F.concat(F.lit("f"), F.col("k") % 7).alias("value")).alias("e")).distinct()
    text = pairs.agg(F.to_json(F.map_concat(F.map_from_entries(F.collect_list("e")), F.create_map(F.lit("_note"), F.lit("x")))).alias("value"))
    return logs.load_blocklist(spark, _put(text, "text"))


def _windows(spark, sf_dir):
    c = conns(spark, sf_dir).withColumn("lhour", F.floor(F.col("ts") / 3600).cast("long"))
    return c.groupBy("host", "lhour", "cat").agg(F.count("*").alias("n")).withColumn("flagged", F.lit(False))


WIN = "w AS (SELECT host, floor(ts / 3600)::BIGINT AS lhour, cat, count(*) AS n FROM conns GROUP BY ALL)"


@query(f"WITH {WIN} SELECT host, lhour, cat, CASE WHEN host % 3 = 0 THEN n + 100 ELSE n END AS n FROM w")
def snk1_upsert_windows(spark, sf_dir):
    path = corpus.shared_path(spark, "windows")
    w = _windows(spark, sf_dir)
    corpus.upsert_windows(w, path, version=1)
    corpus.upsert_windows(w.where("host % 3 = 0").withColumn("n", F.col("n") + 100), path, version=2)
    return spark.read.parquet(path).select("host", "lhour", "cat", "n")


@query(f"WITH {WIN} SELECT host, lhour, cat, n FROM w WHERE lhour >= 473424 AND lhour < 473500 AND host < 50 AND host % 7 <> 0")
def snk2_read_windows(spark, sf_dir):
    path = corpus.shared_path(spark, "windows")
    corpus.upsert_windows(_windows(spark, sf_dir).withColumn("flagged", F.col("host") % 7 == 0), path, version=1)
    return corpus.read_windows(spark, path, low=473424, high=473500, hosts=list(range(50))).select("host", "lhour", "cat", "n")


@query(f"WITH {WIN}, p AS (SELECT DISTINCT host, lhour FROM w WHERE cat = 'error') SELECT host, lhour, cat, p.host IS NOT NULL AS flagged FROM w LEFT JOIN p USING (host, lhour)".replace("p.host IS NOT NULL", "(host, lhour) IN (SELECT (host, lhour) FROM p)").replace(" LEFT JOIN p USING (host, lhour)", ""))
def snk3_mark_flagged(spark, sf_dir):
    w = _windows(spark, sf_dir)
    return corpus.mark_flagged(w, w.where("cat = 'error'")).select("host", "lhour", "cat", "flagged")


@query(
    f"WITH {WIN}, m AS (SELECT 'a/' || host AS host, lhour, cat, n FROM w WHERE host % 2 = 0 UNION ALL SELECT 'b/' || host, lhour, cat, n FROM w WHERE host % 2 = 1), d "
    f"AS (SELECT *, dense_rank() OVER (ORDER BY host) AS r FROM m) SELECT 'site-' || CASE WHEN r < 10 THEN '0' || r ELSE r::VARCHAR END AS host, lhour, cat, n FROM d"
)
def snk4_export_pseudonymised(spark, sf_dir):
    w = _windows(spark, sf_dir)
    merged = corpus.merge_corpora({"a": w.where("host % 2 = 0"), "b": w.where("host % 2 = 1")})
    return corpus.export_pseudonymised(merged).select("host", "lhour", "cat", "n")


@query("SELECT id, threat_class FROM alerts ORDER BY ts DESC, id LIMIT 100")
def snk5_recent_alerts(spark, sf_dir):
    a = alerts(spark, sf_dir).select("id", "threat_class", "ts")
    path = corpus.shared_path(spark, "alerts")
    corpus.write_alerts(a.where("id % 2 = 0"), path)
    corpus.write_alerts(a.where("id % 2 = 1"), path)
    return corpus.recent_alerts(spark, path, a.schema, n=100).select("id", "threat_class")


@query("SELECT 'a/' || host AS host, count(*) AS n FROM conns GROUP BY 1 UNION ALL SELECT 'b/' || host, count(*) FROM conns GROUP BY 1")
def set2_merge_corpora(spark, sf_dir):
    c = conns(spark, sf_dir).select("host", "ts")
    return corpus.merge_corpora({"a": c, "b": c}).groupBy("host").agg(F.count("*").alias("n"))


@query("SELECT 'extendedprice' AS feature, 0 AS side, count(*) AS n FROM lineitem UNION ALL SELECT 'extendedprice', 1, count(*) FROM lineitem WHERE l_quantity > 10")
def set3_align_columns(spark, sf_dir):
    from ..operators.capture import align_columns

    li = read(spark, sf_dir, "lineitem")
    a = li.select(F.col("l_extendedprice").alias("Extended Price"), F.col("l_tax").alias("tax"))
    b = li.where("l_quantity > 10").select(F.col("l_extendedprice").alias("ExtendedPrice"), F.col("l_discount").alias("discount"))
    both, _, _ = align_columns(a, b)
    return both.groupBy("feature", "side").agg(F.count("*").alias("n"))


@query(
    "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.vec_id, b.vec_id AS o, "
    "list_sum(list_transform(range(1, 65), lambda i: (a.e[i] - b.e[i]) * (a.e[i] - b.e[i]))) AS d1, list_sum(list_transform(range(1, 33), lambda i: (a.e[i] - "
    "b.e[i]) * (a.e[i] - b.e[i]))) AS d2 FROM v a JOIN v b ON a.vec_id <> b.vec_id), "
    "r AS (SELECT vec_id, o, row_number() OVER (PARTITION BY vec_id ORDER BY d1, o) AS r1, row_number() OVER (PARTITION BY vec_id ORDER BY d2, o) AS r2 FROM p) "
    "SELECT vec_id, sum((r1 <= 5 AND r2 <= 5)::INT)::INT AS shared FROM r GROUP BY 1"
)
def ev12_knn_overlap(spark, sf_dir):
    from ..operators.embeddings import knn_overlap

    return knn_overlap(read(spark, sf_dir, "embeddings"), first=32, k=5).select("vec_id", "shared")


FEATURES = "WITH p AS (SELECT user_id, k % 2 = 0 AS fwd, fwd_bytes AS size, ts, event_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap, syn, ack, fin FROM flows)"


@query(
    FEATURES + " SELECT user_id, count(*) FILTER (WHERE fwd) AS tot_fwd_pkts, count(*) FILTER (WHERE NOT fwd) AS tot_bwd_pkts, coalesce(sum(size) FILTER (WHERE fwd), 0)::BIGINT AS fwd_bytes, round((max(ts) - min(ts)) * 1e6, 0) AS duration_us, round(avg(gap) * 1e6, 0) AS iat_mean_us, round(stddev_pop(gap) * 1e6, 0) AS iat_std_us, round(stddev_pop(size), 4) AS pkt_len_std, max(size) AS pkt_len_max, max(syn) AS syn_flag, max(fin) AS fin_flag FROM p GROUP BY 1"
)
def ag1_cic_features(spark, sf_dir):
    from ..operators.features import cic_features

    p = flows(spark, sf_dir).select("user_id", (F.col("k") % 2 == 0).alias("forward"), F.col("fwd_bytes").alias("size"), "ts", "event_id", "syn", "ack", "fin", "rst")
    c = cic_features(p, ["user_id"])
    return c.select(
        "user_id", "tot_fwd_pkts", "tot_bwd_pkts", "fwd_bytes", *[F.round(x, 0).alias(x) for x in ("duration_us", "iat_mean_us", "iat_std_us")],
        F.round("pkt_len_std", 4).alias("pkt_len_std"), "pkt_len_max", "syn_flag", "fin_flag",
    )


@query(
    FEATURES + " SELECT user_id, round(coalesce(sum(size) FILTER (WHERE fwd), 0) / greatest(1, coalesce(sum(size) FILTER (WHERE NOT fwd), 0)), 6) AS byte_ratio, round(stddev_pop(size) / avg(size), 6) AS size_cv, round(ln(1 + sum(size)), 6) AS log_bytes, round(stddev_pop(gap) / avg(gap), 6) AS iat_cv FROM p GROUP BY 1"
)
def ag2_ett_features(spark, sf_dir):
    from ..operators.features import ett_features

    p = flows(spark, sf_dir).select("user_id", (F.col("k") % 2 == 0).alias("forward"), F.col("fwd_bytes").alias("size"), "ts", "event_id", "syn", "ack", "fin", "rst")
    e = ett_features(p, ["user_id"])
    return e.select("user_id", *[F.round(x, 6).alias(x) for x in ("byte_ratio", "size_cv", "log_bytes", "iat_cv")])
