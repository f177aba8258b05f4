import corpus_pipeline
from test_language_id import brute as brute_languages
from test_mixing import brute_mix
from test_packing import brute as brute_pieces
from test_simhash import components, fingerprint
from test_substring_index import brute_texts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def follows(name, rows, kept):
    """Whether a stage made of rows what a brute-force version makes of them."""
    if name == "language_id":
        found = brute_languages([(r.text, r.lang) for r in rows if r.lang is not None and r.text is not None], [r.text for r in rows])
        sure = [(r, score) for r, (lang, score) in zip(rows, found, strict=True) if lang != "und" and score >= 0.4999]
        assert {r for r, score in sure if score >= 0.5001} <= set(kept) <= {r for r, _ in sure}
        return
    if name == "simhash_near_dedup":
        of = components({r.doc_id: fingerprint(r.text) for r in rows if r.doc_id is not None})
        want = [r for r in rows if r.doc_id is None or of[r.doc_id] == r.doc_id]
    elif name == "substring_dedup":
        want = [(i, t) for i, t in brute_texts([(r.doc_id, r.text) for r in rows])]
        kept = [(r.doc_id, r.text) for r in kept]
    elif name == "mixing":
        want = brute_mix([(r.doc_id, r.text, r.source) for r in rows])
        kept = [(r.doc_id, r.text) for r in kept]
    else:
        want = brute_pieces([(r.doc_id, r.text) for r in rows])
        kept = [(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in kept]
    assert sorted(map(str, kept)) == sorted(map(str, want)), name


def through(spark, docs, sf_dir):
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        docs = corpus_pipeline.saved(stage(spark, docs, sf_dir), name)
        assert i == 4 or docs.columns == columns
        follows(name, before, docs.collect())
    return docs


def test_stages_and_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert docs.columns == COLUMNS
    last = through(spark, docs, sf_dir)
    final = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, final.select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(map(tuple, last.select("doc_id", "start", "length", "ids_crc32").collect()))


def test_odd_rows_and_an_empty_table(spark, odd_docs, no_docs, tmp_path):
    assert through(spark, odd_docs, "").count() > 0
    assert through(spark, no_docs, "").count() == 0
    odd_docs.where("doc_id in (2, 3, 4)").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_entry_works_without_the_pipeline():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(corpus_pipeline.__file__).parent
    code = "import sys; sys.modules['flowquarry.llm'] = None; import __spark_entry__ as e; assert not [q for q in e.queries() if q.startswith('op')]; print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert out.returncode == 0 and int(out.stdout) > 100
