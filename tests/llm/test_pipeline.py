from __future__ import annotations

import re
from collections import Counter

import pytest

from winnower.llm import common


def pipeline():
    return pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf):
    p = pipeline()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = []
    for name, stage in p.STAGES[:-1]:
        before = docs
        docs = common.spool(stage(spark, docs, sf), "stage")
        assert docs.columns == p.COLUMNS, name
        seen.append((before, docs))
    raw, languages, lines, distinct, mixed = seen[0][0], *(d for _, d in seen)
    assert languages.count() > 0.95 * raw.count()
    assert lines.join(languages, "doc_id", "left_anti").count() == 0
    assert distinct.count() == distinct.select("doc_id").distinct().count() < lines.count()
    size = {r["doc_id"]: len(re.findall(common.WORD, r["text"])) for r in distinct.collect()}
    taken = Counter()
    for r in mixed.collect():
        taken[r["doc_id"]] += len(re.findall(common.WORD, r["text"]))
    assert set(taken) <= set(size) and all(n <= 3 * size[i] for i, n in taken.items())
    packed = p.STAGES[-1][1](spark, mixed, sf).toPandas()
    assert (packed.groupby("sequence_id").length.sum() <= 4096).all()


def test_awkward_documents(spark, awkward, sf):
    docs = awkward
    for _, stage in pipeline().STAGES:
        docs = common.spool(stage(spark, docs, sf), "stage")
    assert docs.count() > 0


def test_jaccard_stage_loses_no_other_text(spark, sf):
    """Against brute force: one row of each group of linked texts stays, whatever their ids."""
    base = [f"w{k}" for k in range(60)]
    near = " ".join(base[:-2] + ["tail", "end"])
    rows = [(None, "alone without an id but with several words"), (7, " ".join(base)), (7, near), (7, "the same id and quite another text here"), (8, " ".join(base)), (8, " ".join(base)),
            (9, None), (10, ""), (None, "a second one without an id and other words")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(pipeline().STAGES)["ngram_jaccard_join"](spark, docs, sf).collect()
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} if t else set()
    linked = lambda a, b: a and b and 4 * len(a & b) >= 3 * len(a | b)
    assert len(kept) == 6 and len({r["text"] for r in kept if r["text"]}) == 4
    texts = [r["text"] for r in kept]
    assert not any(linked(grams(a), grams(b)) for i, a in enumerate(texts) for b in texts[i + 1 :])
    assert all(any(t == k or linked(grams(t), grams(k)) for k in texts) for _, t in rows)
