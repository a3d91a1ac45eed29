"""Language ID, toxicity, licences, importance resampling: accuracy, invariants, edge cases."""

from __future__ import annotations

import numpy as np
import pytest

from winnower.llm import common, crf, language_id, license_scan, quality_sampling, toxicity
from winnower.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_chain_equals_enumeration():
    rng = np.random.default_rng(1)
    T = np.exp(rng.normal(size=(3, 3)))
    for n in (1, 2, 5):
        e = rng.random((n, 3)) + 0.1
        m, _, _ = crf._chain(e, np.array([0, n]), T)
        want = np.zeros((n, 3))
        for path in np.ndindex(*(3,) * n):
            p = sum(T[k, path[0]] for k in range(3)) * e[0, path[0]]
            for i in range(1, n):
                p *= T[path[i - 1], path[i]] * e[i, path[i]]
            for i in range(n):
                want[i, path[i]] += p
        assert np.allclose(m, want / want.sum(1, keepdims=True))


def test_long_chains_equal_plain_recursion():
    rng = np.random.default_rng(2)
    T = np.exp(rng.normal(size=(2, 2)))
    offsets = np.array([0, 0, 7, 300, 300, 431])
    e = rng.random((431, 2)) + 0.01
    m, _, _ = crf._chain(e, offsets, T)
    for a, b in zip(offsets[:-1], offsets[1:]):
        f, back = [], [np.ones(2)]
        v = np.full(2, 0.5)
        for i in range(a, b):
            v = (v @ T) * e[i]
            v /= v.sum()
            f.append(v)
        for i in range(b - 1, a, -1):
            w = T @ (back[0] * e[i])
            back.insert(0, w / w.sum())
        if b > a:
            want = np.array(f) * np.array(back)
            assert np.allclose(m[a:b], want / want.sum(1, keepdims=True))


def test_language_held_out_accuracy(spark):
    got = QUERIES["op1_language_id"](spark, SF).toPandas()
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(truth)
    assert len(got) == len(truth) and got.score.between(0, 1).all()
    assert (both.lang_pred == both.lang)[both.held_out].mean() > 0.97
    assert both.held_out.tolist() == [common.held_out_id(i) for i in both.doc_id]


def test_language_of_code_switched_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs, per_label=120)
    rows = {r["lang"]: r["text"] for r in docs.where("doc_id % 5 = 1 and n_chars > 400").collect()}
    text = " ".join(rows["de"].split()[5:25]) + " " + " ".join(rows["es"].split()[5:25])
    labels = [lang for _, _, lang, _ in language_id.word_languages(model, text)]
    half = len(labels) // 2
    assert labels[:half].count("de") > 0.8 * half and labels[half:].count("es") > 0.8 * half


def test_language_edge_cases(awkward, clashing, nothing):
    model = language_id.train(awkward)
    got = {r["doc_id"]: r for r in language_id.predict(awkward, model).collect()}
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (1, 2, 3, 13))
    assert got[12]["lang_pred"] in model.labels and language_id.predict(clashing, model).count() == awkward.count()
    assert language_id.predict(nothing, language_id.train(nothing)).count() == 0
    untrained = language_id.predict(awkward, language_id.train(nothing)).collect()
    assert {r["lang_pred"] for r in untrained} == {"und"}


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = QUERIES["op5_toxicity"](spark, d).toPandas().merge(spark.read.parquet(f"{d}/labels.parquet").toPandas())
    held = got[got.held_out]
    assert ((held.predicted == 1) & (held.toxic == 1)).sum() > 0.8 * (held.toxic == 1).sum()
    assert ((held.predicted == 1) & (held.toxic == 0)).sum() < 0.03 * (held.toxic == 0).sum()
    assert (got.predicted == (got.score >= 0.5)).all()


def test_toxicity_edge_cases(spark, awkward, clashing, nothing):
    labels = spark.createDataFrame([(k, 0, k % 2) for k in range(20, 60)] + [(21, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(awkward, labels)
    got = toxicity.predict(awkward, model).collect()
    assert len(got) == awkward.count() and all(0 <= r["score"] <= 1 for r in got)
    for r in got:
        if r["doc_id"] in (1, 2, 3, 13):
            assert r["spans"] == [] and r["n_toxic"] == 0
    assert toxicity.predict(clashing, model).count() == len(got)
    assert toxicity.predict(nothing, model).count() == 0
    none = toxicity.train(awkward, labels.where("toxic = 0"))
    assert {r["score"] for r in toxicity.predict(awkward, none).collect()} == {0.0}


def test_spans_point_at_words(spark):
    text = "quiet words here " * 5
    # copies count once, so each text has a word of its own
    own = ["".join(chr(97 + int(c)) for c in str(k)) for k in range(400)]
    rows = [(k, f"{own[k]} {text}" + ("grumble zorgon" if k % 2 else "nothing bad")) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(k, k % 2) for k in range(400)], "doc_id long, toxic int"))
    for r in toxicity.predict(docs, model).where("doc_id < 20").collect():
        found = " ".join(rows[r["doc_id"]][1].encode()[s["first"] : s["end"]].decode() for s in r["spans"])
        assert found == ("grumble zorgon" if r["doc_id"] % 2 else "")
        assert (r["score"] >= 0.5) == bool(r["doc_id"] % 2)


def test_licences(spark, nothing):
    model = license_scan.trained()
    assert model.held_accuracy > 0.8
    rows = [(k, "Some prose first.\n" + t + "\nAnd more.") for k, t in enumerate(t for ts in license_scan.TEMPLATES.values() for t in ts)]
    rows += [(900, None), (901, ""), (902, "She renewed her fishing license last year."), (903, "nothing at all"), (903, "nothing at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS family", "1 AS paragraph")
    got = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    want = [f for f, ts in license_scan.TEMPLATES.items() for _ in ts]
    right = sum(got[k]["family"] == f and got[k]["confirmed"] and got[k]["paragraph"] == 1 for k, f in enumerate(want))
    assert right >= 0.9 * len(want)
    assert got[902]["family"] == "unknown" and not got[902]["confirmed"]
    assert not {900, 901, 903} & set(got)
    assert license_scan.scan(nothing).count() == 0


def test_licence_probabilities_equal_the_model(spark):
    model = license_scan.trained()
    text = "Licensed under the MIT license or something near"
    x = model._matrix([license_scan.tokens(text)])
    p = model._softmax((x @ model.weights + model.bias) / model.temperature)[0]
    r = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r["family"] == model.families[int(p.argmax())] and abs(r["probability"] - p.max()) < 1e-9


def test_resampling(spark, awkward, clashing, nothing):
    targets = spark.createDataFrame([(6,), (7,), (8,), (None,)], "doc_id long")
    got = quality_sampling.resample(awkward, targets, 0.4).collect()
    n = awkward.count()
    assert len(got) == n and sum(r["selected"] for r in got) == round(0.4 * n)
    assert min(r["gumbel_key"] for r in got if r["selected"]) >= max(r["gumbel_key"] for r in got if not r["selected"])
    again = quality_sampling.resample(clashing, targets, 0.4).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert quality_sampling.resample(nothing, targets).count() == 0
    none = quality_sampling.resample(awkward, targets.limit(0)).collect()
    assert {r["log_weight"] for r in none} == {0.0}


def test_log_weights_by_hand(awkward):
    from pyspark.sql import functions as F

    marked = awkward.withColumn("t", F.col("doc_id").isin(6, 8))
    raw, goal = quality_sampling.bucket_counts(marked, "t", 64)
    texts = awkward.collect()
    import pyarrow as pa

    counts = np.zeros((2, 64))
    per = []
    for r in texts:
        ((_, _, data, off),) = common.text_chunks(pa.array([r["text"]], pa.string()))
        own = np.bincount(quality_sampling.gram_buckets(data, off, 64)[1], minlength=64)
        per.append((r["doc_id"], own))
        counts[0] += own
        counts[1] += own * (r["doc_id"] in (6, 8))
    assert (raw == counts[0]).all() and (goal == counts[1]).all()
    ratio = np.log((goal + 1) / (goal.sum() + 64)) - np.log((raw + 1) / (raw.sum() + 64))
    want = sorted((str(i), round(float(own @ ratio), 6)) for i, own in per)
    assert sorted((str(r["doc_id"]), round(r["log_weight"], 6)) for r in quality_sampling.log_weights(awkward, raw, goal).collect()) == want


@pytest.mark.parametrize("k", [1, 7, 50])
def test_kth_largest(spark, k):
    values = [(int(v),) for v in np.random.default_rng(4).integers(-(1 << 62), 1 << 62, 49)] + [(5,), (5,), (-3,)]
    rows = spark.createDataFrame(values, "v long")
    value, ties = quality_sampling.kth_largest(rows, "v", k)
    ordered = sorted((v[0] for v in values), reverse=True)
    assert value == ordered[k - 1] and ties == ordered[:k].count(value)


def test_licences_against_brute_force(spark):
    """Every paragraph that holds a template's word: family, probability, similarity and template by hand."""
    import random

    model = license_scan.trained()
    rng = random.Random(3)
    made = [t for ts in license_scan.TEMPLATES.values() for t in ts] + list(license_scan.OTHER_TEXT)
    made += ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND", "warranty", "nothing to see here", ""]
    made += [" ".join(w for w in t.split() if rng.random() > 0.3) for t in made[:40]]
    rows = [(k, "\n".join(made[i] for i in range(k, len(made), 7))) for k in range(7)]
    rows += [(None, made[0]), (None, made[1]), (6, rows[6][1]), (50, None), (51, "")]
    want = set()
    sizes = {}
    for name, family, gram in model.template_rows:
        sizes.setdefault((name, family), set()).add(gram)
    for i, text in set(rows):
        for at, line in enumerate((text or "").split("\n")):
            w = license_scan.tokens(line)
            if not set(w) & set(model.anchors):
                continue
            p = model._softmax((model._matrix([w]) @ model.weights + model.bias) / model.temperature)[0]
            family = model.families[int(p.argmax())]
            held = license_scan.grams(w)
            near = max((len(g & held) / len(g) for (_, f), g in sizes.items() if f == family), default=0.0)
            want.add((str(i), at, family, round(float(p.max()), 6), round(near, 6), family != license_scan.UNKNOWN and near >= 0.6, line))
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(want)
    assert {(str(r["doc_id"]), r["paragraph"], r["family"], round(r["probability"], 6), round(r["similarity"], 6), r["confirmed"], r["text"]) for r in got} == want
    assert any("WARRANTY" in r["text"] for r in got) and sum(r["doc_id"] is None for r in got) == 2


def test_sample_is_bounded_whatever_repeats(spark):
    rows = [(7, f"text {k}", "en") for k in range(500)] + [(k, "word " * 9000, "de") for k in range(20)] + [(None, "x", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = crf.labelled_sample(docs, docs.selectExpr("doc_id", "lang as label"), 10, 1000)
    assert sum(r[2] == "en" for r in got) <= 1 and 1 <= sum(r[2] == "de" for r in got) <= 10 and all(len(r[1]) <= 1000 for r in got)
    assert [r for r in got if r[2] == "de"]


def test_hashes_tell_patterned_texts_apart():
    """The words of Thue and Morse, on which polynomials modulo a power of two collide."""
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    texts = [word.encode(), word.translate(str.maketrans("ab", "ba")).encode()]
    hashes = set()
    for t in texts:
        data = np.frombuffer(t, np.uint8)
        starts, ends, _ = common.words_of(data, np.array([0, len(data)]))
        hashes |= {int(common.word_hashes(data, starts, ends)[0]), int(common.run_hashes(data, starts, ends)[0])}
    assert len(hashes) == 4


def test_training_gives_memory_back(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(common, "release_memory", lambda: calls.append(1))
    language_id.train(spark.createDataFrame([(k, "some words " * 9, "ab"[k % 2]) for k in range(40)], "doc_id long, text string, lang string"))
    assert calls
    monkeypatch.undo()
    common.release_memory()
