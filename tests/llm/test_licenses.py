import math
import re

import pytest

from flowquarry.llm import licenses
from flowquarry.llm.queries import op5_license_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    words = WORD.findall((text or "").translate(LOWER))
    places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def same(rows, docs):
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows), key=str)
    return got == sorted(((i, *brute(t)) for i, t in docs), key=str)


def scanned(docs):
    """(labels, score) of each text by the method, in plain Python: rarity over all texts, then starts that agree."""
    words_of = [WORD.findall((t or "").translate(LOWER)) for _, t in docs]
    templates = licenses.templates()
    filed = {n: [(words[p], p) for p in licenses.index_places(words)] for n, _, _, words, _, _ in templates}
    index = {w for own in filed.values() for w, _ in own}
    places = [{} for _ in docs]
    for found, words in zip(places, words_of, strict=True):
        for i, w in enumerate(words):
            if w in index:
                found.setdefault(w, []).append(i)
    idf = {w: math.log((len(docs) + 1) / (sum(w in p for p in places) + 1)) for w in index}
    ranked = {n: sorted(own, key=lambda x: (-idf[x[0]], x)) for n, own in filed.items()}
    out = []
    for found, words in zip(places, words_of, strict=True):
        labels, best = set(), 0.0
        for n, label, base, _, phrase, at in templates:
            whole = sum(idf[w] + 1e-9 for w, _ in ranked[n][:4])
            own = [(w, p) for w, p in ranked[n][: 1 if base else None] if w in found][: 1 if base else 4]
            starts = {}
            for w, p in own:
                for i in found[w]:
                    starts[i - p] = starts.get(i - p, 0.0) + idf[w] + 1e-9
            for start, weight in starts.items():
                share = 1.0 if base else min(1.0, weight / whole)
                if start + at >= 0 and words[start + at : start + at + len(phrase)] == phrase and (base or share >= 0.5):
                    labels.add(label)
                    best = max(best, share)
        out.append((",".join(sorted(labels)), best))
    return out


def same_labels(rows, docs):
    got = sorted(((str(r.doc_id), r.labels, r.score) for r in rows))
    want = sorted((str(i), labels, score) for (i, _), (labels, score) in zip(docs, scanned(docs), strict=True))
    return [x[:2] for x in got] == [x[:2] for x in want] and all(g[2] == pytest.approx(w[2], abs=1e-5) for g, w in zip(got, want, strict=True))


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    rows = op5_license_scan(spark, "/root/testdata/sf0.01").collect()
    assert same(rows, docs) and same_labels(rows, docs)
    for r in rows:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_planted_phrases(spark, odd_docs, no_docs):
    texts = [
        "GNU General Public License gnu general public license", "the mit license mit MIT-License cc-by CC BY cc by", "mit\nlicense apache\tlicense ÉMIT license KK license", "general public license", "cc by" * 3, "Licensed under CC BY-NC 4.0.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "apache " * 400 + "apache license", None, "",
    ]
    docs = list(enumerate(texts))
    rows = licenses.scan(spark.createDataFrame(docs, "doc_id int, text string")).collect()
    assert same(rows, docs)
    labels = {r.doc_id: r.labels for r in rows}
    assert labels[5] == "cc-by,cc-by-nc" and labels[6] == "mit-grant" and labels[8] == ""
    assert same_labels(rows, docs)
    odd = licenses.scan(odd_docs).collect()
    assert len(odd) == odd_docs.count() and {r.doc_id: r.labels for r in odd}[8] == "apache,apache-2.0,mit"
    assert licenses.scan(no_docs).count() == 0


def test_plan_has_no_python(spark, odd_docs):
    plan = licenses.scan(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_whole_license_texts(spark):
    """Each is found with its own label, in upper case and with other text before and after; without its key phrase it is not."""
    docs = [(i, f"Some words, (c) 2020 the MIT license team. {text.upper()}. And more") for i, (_, text, _) in enumerate(licenses.TEXTS)]
    docs += [(10 + i, text.replace(key, key.replace(" ", " x ", 1))) for i, (_, text, key) in enumerate(licenses.TEXTS)]
    docs += [(20 + i, f"nothing of the kind {i}") for i in range(20)]
    rows = {r.doc_id: set(r.labels.split(",")) for r in licenses.scan(spark.createDataFrame(docs, "doc_id int, text string")).collect()}
    for i, (label, _, _) in enumerate(licenses.TEXTS):
        assert label in rows[i] and label not in rows[10 + i]
        assert not {x for x in rows[i] if x.endswith("-text")} - {label}
    assert {x for i in range(20, 40) for x in rows[i]} == {""}


def test_a_long_text_of_index_words(spark):
    text = " ".join(["apache license software gnu mit"] * 20_000)
    (r,) = licenses.scan(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    assert (r.n_words, r.n_base, r.first_word, r.base_labels) == (100_000, 20_000, 0, "apache")
