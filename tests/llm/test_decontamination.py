"""Decontamination against plain n-gram sets and DuckDB."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from flowquarry.llm import decontamination
from flowquarry.llm.queries import op13_decontamination, oracle_sql

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(docs, items, width=10):
    held: dict = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - width, 0) + 1 if w else 0):
            held.setdefault(tuple(w[i : i + width]), set()).add(item)
    sizes, out = {len(k) for k in held}, []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (own := held.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= own
        found = sorted(str(x) for x in found if x is not None)
        out.append((doc_id, len(w), len(hit), len(found), ",".join(found), bool(hit)))
    return sorted(out, key=key)


def key(row):
    return tuple((x is None, x) for x in row)


def rows(df):
    return sorted([(r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r["items"]), r.contaminated) for r in df.collect()], key=key)


ITEMS = "item_id long, text string, words int, row string"


@pytest.fixture(scope="module")
def odd_items(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    given = [
        (10, "intro here word0"), (2, " ".join(f"WORD{i}" for i in range(5, 17))), (3, None), (4, ""), (5, "... !!!"), (6, "two"), (7, "no such words at all in any of the documents here"), (8, passage), (8, "cafÉ café"),
        (None, "w1 x1 w2 x2"), (9, " ".join(f"w{i % 977} x{i}" for i in range(600, 640))), (11, "日本 語"), (12, "café été"), (13, "word0 word1"), (2, passage),
    ]
    return spark.createDataFrame([(*x, 1, "clash") for x in given], ITEMS)


@pytest.mark.parametrize("options", [{}, {"width": 4}, {"width": 1}, {"shingle": 1}, {"shingle": 6}, {"block_bytes": 400}])
def test_odd_rows(spark, odd_docs, odd_items, options):
    found = rows(decontamination.decontaminate(odd_docs, odd_items, **options))
    assert found == plain([(r.doc_id, r.text) for r in odd_docs.collect()], [(r.item_id, r.text) for r in odd_items.collect()], options.get("width", 10))


def test_pieces_meet_over_their_ends(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "PIECE_WORDS", 7)
    text = " ".join(f"v{i % 23} u{i}" for i in range(80))
    docs = spark.createDataFrame([(1, text), (2, "a " + text), (3, "a " * 5 + text[: len(text) // 2])], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(text.split()[i : i + 13])) for i in range(0, 140, 9)] + [(200, "a a a")], "item_id long, text string")
    assert rows(decontamination.decontaminate(docs, items)) == plain([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()])


def test_a_passage_that_all_share(spark):
    passage = " ".join(f"s{i}" for i in range(12))
    docs = spark.createDataFrame([(i, f"{passage} t{i} {passage if i % 3 else ''}") for i in range(300)], "doc_id long, text string").repartition(5)
    items = spark.createDataFrame([(i, f"{passage} r{i}") for i in range(50)], "item_id long, text string")
    assert rows(decontamination.decontaminate(docs, items)) == plain([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()])


def test_empty_tables(spark, odd_docs, no_docs, odd_items):
    assert decontamination.decontaminate(no_docs, odd_items).collect() == []
    for none in (odd_items.where("false"), odd_items.where("item_id in (3, 4, 5)")):
        found = decontamination.decontaminate(odd_docs, none).collect()
        assert len(found) == odd_docs.count() and not any(r.contaminated or r.n_hit or r.n_items or r["items"] for r in found)


def test_clean_keeps_the_others_whole(spark, odd_docs, odd_items):
    kept = decontamination.clean(odd_docs, odd_items)
    dirty = {r.text for r in odd_docs.collect() if any(x[5] for x in plain([(0, r.text)], [(i.item_id, i.text) for i in odd_items.collect()]))}
    assert kept.columns == odd_docs.columns
    assert sorted(map(key, kept.collect())) == sorted(key(r) for r in odd_docs.collect() if r.text not in dirty)


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    expected = con.execute(oracle_sql()["op13_decontamination"]).fetchall()
    found = op13_decontamination(spark, sf_dir).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted(map(tuple, found.collect())) == sorted(expected) and any(r[5] for r in expected)
    assert hashlib.sha256(b"").hexdigest() in {r[4] for r in expected}


def test_no_python_runs_in_the_plan(spark, odd_docs, odd_items):
    plan = decontamination.decontaminate(odd_docs, odd_items)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval|CartesianProduct", plan)


def test_the_search_is_one_stage_of_compiled_code(spark, odd_docs, odd_items):
    """A row a word must not copy its piece: between the scan and the join nothing leaves the compiled code."""
    texts = decontamination.pieces(odd_docs)
    kept = decontamination.windows(odd_items).select("window_key", "window").distinct()
    found = decontamination.places(texts, decontamination.rarest_shingles(texts, kept)).where(F.col("length") == 10)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for line in plan.splitlines():
        if "posexplode(words" in line or ("BroadcastHashJoin" in line and "place" in line):
            assert re.search(r"\*\(\d+\)", line), line
