"""Toxic spans and document scores from a linear-chain CRF.

Labels are given per document only, so training tokens are labelled from them: a word of a toxic document is toxic if
it, or one of its affixes, occurs in many distinct toxic documents and hardly any other (smoothed log odds above a
threshold); words of other documents are not.  The CRF learns from those tokens and labels words it never saw by
their affixes, n-grams and neighbours.  A document's marginals give the expected number of toxic words and the largest
marginal; a logistic curve over these, fitted on training documents that the CRF did not see, makes the score.

Edge cases: null, empty or wordless text gets the score of a text without toxic words and no spans; with no labelled
rows of either kind, all scores are 0; a very long text is one sequence; repeated rows are scored separately;
extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnower.llm import common, crf

_RUN = re.compile(r"[A-Za-z\x80-\U0010ffff]+")


def _keys(word: str) -> set[str]:
    """A word and its affixes of 3 to 5 characters."""
    return {word, *(word[:k] + "-" for k in (3, 4, 5) if len(word) > k), *("-" + word[-k:] for k in (3, 4, 5) if len(word) > k)}


def toxic_keys(sample: list[tuple[int, str, int]], least_docs: int = 5, odds: float = 3.0) -> set[str]:
    """Words and affixes that mark toxic documents: in ``least_docs`` distinct ones, log odds over ``odds``."""
    distinct = {t: y for _, t, y in sample}
    counts, n = (Counter(), Counter()), [0, 0]
    for text, y in distinct.items():
        n[y] += 1
        counts[y].update(set().union(*map(_keys, set(_RUN.findall(text.lower())))) if text else ())
    return {k for k, c in counts[1].items() if c >= least_docs and math.log((c + 0.5) / (n[1] + 1)) - math.log((counts[0][k] + 0.5) / (n[0] + 1)) > odds}


@dataclass
class Model:
    """The CRF (labels 0 and 1) and the curve over (log of expected toxic words, largest marginal)."""

    crf: crf.Crf | None
    curve: np.ndarray

    def score(self, expected: np.ndarray, largest: np.ndarray) -> np.ndarray:
        if self.crf is None:
            return np.zeros(len(expected))
        z = self.curve[0] + self.curve[1] * np.log1p(expected) + self.curve[2] * largest
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _aggregate(model: crf.Crf, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, crf.Words, np.ndarray]:
    """(expected toxic words, largest marginal) of each row, its words and their toxic marginals."""
    rows = len(offsets) - 1
    w = crf.words(data, offsets)
    p = model.marginals(w)[:, 1]
    row = np.repeat(np.arange(rows), np.diff(w.first))
    largest = np.zeros(rows)
    np.maximum.at(largest, row, p)
    # marginals under a half are background: they would add up over a long text
    return np.bincount(row, weights=np.where(p >= 0.5, p, 0), minlength=rows), largest, w, p


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 0.05) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        b = b + np.linalg.solve(h, x.T @ (y - p) - ridge * b)
    return b


def train(docs: DataFrame, labels: DataFrame, per_label: int = 900, max_chars: int = 20_000, window: int = 160, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on at most ``per_label`` toxic and as many other documents, none held out."""
    own = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).where("label in (0, 1)")
    sample = crf.labelled_sample(docs, own, per_label, max_chars, doc_id, text)
    if {s[2] for s in sample} != {0, 1}:
        return Model(None, np.zeros(3))
    keys = toxic_keys(sample)
    texts, golds = [], []
    unseen = [s for k, s in enumerate(sample) if k % 3 == 0]
    for k, (i, t, y) in enumerate(sample):
        if k % 3 == 0:
            continue
        words = _RUN.findall(t)
        marks = np.array([int(bool(y) and not _keys(w.lower()).isdisjoint(keys)) for w in words], np.int64)
        hits = np.flatnonzero(marks)
        at = int(hits[i % len(hits)]) - window // 2 if len(hits) else i * 7919 % max(1, len(words) - window + 1)
        at = max(0, min(at, len(words) - window))
        if y and not len(hits):
            continue  # nothing in it is known to be toxic: no tokens to learn from
        texts.append(" ".join(words[at : at + window]))
        golds.append(marks[at : at + window])
    model = crf.train(texts, golds, [0, 1])
    ((_, _, data, offsets),) = common.text_chunks(pa.array([s[1] for s in unseen], pa.large_string()), 1 << 62)
    expected, largest, _, _ = _aggregate(model, data, offsets)
    truth = np.array([s[2] for s in unseen])
    curve = _logistic(np.column_stack([np.log1p(expected), largest]), truth)
    # the sample holds more toxic documents than the labelled rows do: move the curve to their share
    known = {r["label"]: r["n"] for r in own.where(~common.held_out("doc_id")).groupBy("label").agg(F.count("*").alias("n")).collect()}
    if 0 < truth.mean() < 1 and known.get(0) and known.get(1):
        curve[0] += math.log(known[1] / known[0]) - math.log(truth.mean() / (1 - truth.mean()))
    return Model(model, curve)


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", spans: bool = True) -> DataFrame:
    """``doc_id, score, n_toxic`` and, if asked, ``spans``: offending (first, end, probability) in UTF-8 bytes.

    Neighbouring words with marginals of a half or more make one span.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at, to, data, offsets in common.text_chunks(batch.column(1), 1 << 19):
                rows = to - at
                keys = batch.column(0).slice(at, rows)
                count = np.zeros(rows, np.int64)
                found: list[list[dict]] = [[] for _ in range(rows)]
                expected, largest = np.zeros(rows), np.zeros(rows)
                if model.crf is not None and len(data):
                    expected, largest, w, p = _aggregate(model.crf, data, offsets)
                    hot = np.flatnonzero(p >= 0.5)
                    row = np.searchsorted(w.first, hot, "right") - 1
                    count = np.bincount(row, minlength=rows)
                    if spans:
                        joined = np.r_[False, (hot[1:] == hot[:-1] + 1) & (row[1:] == row[:-1])] if len(hot) else np.zeros(0, bool)
                        for h, r, more in zip(hot.tolist(), row.tolist(), joined.tolist()):
                            end = int(w.ends[h] - offsets[r])
                            if more:
                                found[r][-1]["end"] = end
                                found[r][-1]["probability"] = max(found[r][-1]["probability"], float(p[h]))
                            else:
                                found[r].append({"first": int(w.starts[h] - offsets[r]), "end": end, "probability": float(p[h])})
                arrays = [keys, pa.array(model.score(expected, largest)), pa.array(count, pa.int64())]
                if spans:
                    kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))
                    arrays.append(pa.array(found, kind))
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "score", "n_toxic", "spans"][: len(arrays)])

    schema = "doc_id long, score double, n_toxic long" + ", spans array<struct<first:long,end:long,probability:double>>" * spans
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
