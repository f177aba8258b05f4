import math
from collections import Counter, defaultdict

import pytest
import regex
from pyspark.sql import functions as F

from flowquarry.llm import language_id
from flowquarry.llm.queries import op1_language_id


def brute(labelled, texts, vocabulary=10_000):
    """(language, score) of each text, by counts and sums in plain Python."""
    words_of = lambda t: regex.findall(r"\p{L}+", (t or "").lower())
    parts = lambda w, n: [w] if n == 0 else [f"<{w}>"[i : i + n] for i in range(len(w) + 3 - n)]
    counts = defaultdict(Counter)
    for text, lang in labelled:
        for w in words_of(text):
            for n in range(6):
                counts[n, lang].update(parts(w, n))
    languages = sorted({lang for _, lang in labelled})
    kept = {k: dict(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:vocabulary]) for k, c in counts.items()}
    keys = {n: {g for lang in languages for g in kept.get((n, lang), {})} for n in range(6)}

    def figure(n, g, lang):
        own = kept.get((n, lang), {})
        return math.log((own.get(g, 0) + 0.5) / (sum(own.values()) + 0.5 * len(keys[n]) + 1))

    def row(w):
        for n in (0, 5, 4, 3, 2, 1):
            known = [g for g in parts(w, n) if g in keys[n]]
            if known:
                return [sum(figure(n, g, lang) for g in known) / len(known) for lang in languages]
        return [0.0] * len(languages)

    rows, out = {}, []
    for text in texts:
        words = words_of(text)
        if not words or not languages:
            out.append(("und", 0.0))
            continue
        for w in words:
            if w not in rows:
                rows[w] = row(w)
        sums = [sum(rows[w][i] for w in words) / len(words) * min(8, len(words)) for i in range(len(languages))]
        share = [math.exp(x - max(sums)) for x in sums]
        best = share.index(max(share))
        out.append((languages[best], share[best] / sum(share)))
    return out


@pytest.mark.parametrize("vocabulary", [10_000, 40])
def test_model_and_scores_against_brute_force(spark, sf_dir, vocabulary):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", language_id_held_out())
    rows = docs.select("doc_id", "text", "lang", "held_out").collect()
    want = brute([(r.text, r.lang) for r in rows if not r.held_out and r.lang is not None and r.text is not None], [r.text for r in rows], vocabulary)
    if vocabulary == 10_000:
        got = op1_language_id(spark, sf_dir)
    else:
        got = language_id.predict(docs, language_id.fit(docs.where("not held_out"), vocabulary=vocabulary), keep=["doc_id"])
    got = {r.doc_id: (r.lang_pred, r.score) for r in got.collect()}
    assert len(got) == len(rows)
    for r, (lang, score) in zip(rows, want, strict=True):
        assert got[r.doc_id][0] == lang and got[r.doc_id][1] == pytest.approx(score, abs=1e-4), r.doc_id


def language_id_held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def test_no_language_is_left_out_and_size_is_enforced(spark):
    rows = [(i, f"{chr(0x4E00 + i)}{chr(0x5E00 + i)} {chr(0x4E00 + i)}", f"l{i:03}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.predict(docs, language_id.fit(docs), keep=["doc_id", "lang"])
    assert got.where("lang = lang_pred").count() == 300
    with pytest.raises(ValueError, match="lower vocabulary"):
        language_id.fit(docs, most_bytes=10_000)


def test_held_out_accuracy_on_the_given_documents(spark):
    got = op1_language_id(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = got.where("held_out").join(docs, "doc_id")
    right, n = held.agg(F.count_if(F.col("lang_pred") == F.col("lang")), F.count("*")).first()
    assert n > 150 and right / n > 0.97
    assert got.count() == docs.count()


def test_backoff_goes_to_shorter_grams():
    import numpy as np

    table = np.array([[0.0, -9.0], [-9.0, 0.0]], np.float32)
    model = language_id.BackoffModel(["x", "y"], {"known": 0}, {5: {"<unse": 1}, 4: {}, 3: {}, 2: {"q>": 0}, 1: {}}, table)
    assert (model.word_row("known") == table[0]).all()
    assert (model.word_row("unseen") == table[1]).all()
    assert (model.word_row("zzq") == table[0]).all()
    assert (model.word_row("kkk") == 0).all()


def test_odd_rows_have_defined_results(spark, odd_docs, no_docs):
    model = language_id.fit(odd_docs)
    rows = language_id.predict(odd_docs, model, keep=["doc_id", "fingerprint"]).collect()
    assert len(rows) == odd_docs.count() and all(r.fingerprint == "clash" and 0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert [by[i].lang_pred for i in (2, 3, 4)] == ["und"] * 3 and by[2].score == 0
    assert language_id.predict(no_docs, language_id.fit(no_docs), keep=["doc_id"]).count() == 0
    assert {r.lang_pred for r in language_id.predict(odd_docs, language_id.fit(no_docs), keep=["doc_id"]).collect()} == {"und"}
    kept = language_id.keep_identified(odd_docs)
    assert kept.columns == odd_docs.columns and {2, 3, 4}.isdisjoint({r.doc_id for r in kept.collect()})
