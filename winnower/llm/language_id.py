"""Language identification of words in code-switched text, and of documents.

A linear-chain CRF labels every word of a text with a language; its marginals, weighted by letters, make the
document's language and score.  It is trained on a bounded sample of labelled documents.  To learn
transitions, training sequences switch between documents of different languages now and then, at a stated rate.

Edge cases: null text or text without letters of any script is ``und`` with score 0; with nothing to learn from, all
documents are ``und``; a very long text is one sequence; repeated rows are labelled separately; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnower.llm import common, crf

UNKNOWN = "und"


def _window(text: str, size: int, seed: int) -> list[str]:
    """``size`` words from a place in the text chosen by the seed."""
    words = text.split()
    at = seed * 7919 % max(1, len(words) - size + 1)
    return words[at : at + size]


def sequences(sample: list[tuple[int, str, str]], labels: list[str], size: int = 120, switch: float = 0.08, seed: int = 11) -> tuple[list[str], list[np.ndarray]]:
    """Training texts and the label of each of their words.

    Documents' windows are dealt out in runs of 3 to 20 words; each next run stays in its document but for the share
    ``switch``, which goes on with another document, whatever its language.
    """
    rng = np.random.default_rng(seed)
    queues = [(_window(t, size, i), labels.index(lang)) for i, t, lang in sample]
    open_ = [k for k, (w, _) in enumerate(queues) if w]
    at = [0] * len(queues)
    texts, golds, now, gold = [], [], [], []
    k = open_[int(rng.integers(len(open_)))] if open_ else -1
    while open_:
        words, label = queues[k]
        run = words[at[k] : at[k] + int(rng.integers(3, 21))]
        at[k] += len(run)
        now += run
        gold += [label] * len(run)
        if at[k] >= len(words):
            open_[open_.index(k)] = open_[-1]
            open_.pop()
        if open_ and (at[k] >= len(words) or rng.random() < switch):
            k = open_[int(rng.integers(len(open_)))]
        if len(now) >= size or not open_:
            texts.append(" ".join(now))
            golds.append(np.array(gold))
            now, gold = [], []
    # a blank-separated token may hold no or several letter runs: give each run its token's label
    out = []
    for text, gold in zip(texts, golds):
        column = pa.array([text], pa.large_string())
        ((_, _, data, offsets),) = common.text_chunks(column, 1 << 62)
        token, _, _ = common.words_of(data, offsets)
        starts, _, _ = common.words_of(data, offsets, crf._BLANK)
        out.append(gold[np.searchsorted(token, starts, "right") - 1])
    return texts, out


def train(docs: DataFrame, per_label: int = 250, max_chars: int = 20_000, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> crf.Crf:
    """Fit on at most ``per_label`` documents of each language, none held out."""
    labels = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("label"))
    sample = crf.labelled_sample(docs, labels, per_label, max_chars, doc_id, text)
    names = sorted({s[2] for s in sample})
    texts, golds = sequences(sample, names)
    model = crf.train(texts, golds, names)
    del sample, texts, golds
    common.release_memory()
    return model


def predict(docs: DataFrame, model: crf.Crf, doc_id: str = "doc_id", text: str = "text", extra: list[str] | None = None) -> DataFrame:
    """``doc_id, lang_pred, score, n_switches`` (and the columns named in ``extra``) from the text alone.

    ``score`` is the mean probability of ``lang_pred`` over the letters; ``n_switches`` counts changes of the likeliest
    language from word to word.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    extra = extra or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.labels, UNKNOWN], object)
        for batch in batches:
            for at, to, data, offsets in common.text_chunks(batch.column(1), 1 << 19):
                w = crf.words(data, offsets)
                lang, score, switches = np.full(to - at, len(model.labels)), np.zeros(to - at), np.zeros(to - at, np.int64)
                if model.labels and len(w.starts):
                    m = model.marginals(w)
                    row = np.repeat(np.arange(to - at), np.diff(w.first))
                    letters = (w.ends - w.starts).astype(float)
                    mass = np.stack([np.bincount(row, weights=m[:, k] * letters, minlength=to - at) for k in range(m.shape[1])], 1)
                    ok = crf.has_letters(data, offsets) & (mass.sum(1) > 0)
                    lang[ok] = mass[ok].argmax(1)
                    score[ok] = np.clip(mass[ok].max(1) / mass[ok].sum(1), 0, 1)
                    best = m.argmax(1)
                    changed = (best[1:] != best[:-1]) & (row[1:] == row[:-1])
                    switches = np.bincount(row[1:][changed], minlength=to - at)
                arrays = [batch.column(0).slice(at, to - at), pa.array(names[lang].tolist(), pa.string()), pa.array(score), pa.array(switches)]
                arrays += [batch.column(2 + k).slice(at, to - at) for k in range(len(extra))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "lang_pred", "score", "n_switches", *extra])

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("_text"), *extra)
    schema = "doc_id long, lang_pred string, score double, n_switches long"
    for c in extra:
        schema += f", `{c}` {given.schema[c].dataType.simpleString()}"
    return given.mapInArrow(run, schema)


def word_languages(model: crf.Crf, text: str) -> list[tuple[int, int, str, float]]:
    """(first byte, last byte + 1, language, probability) of each word of one text."""
    data = np.frombuffer(text.encode(), np.uint8)
    w = crf.words(data, np.array([0, len(data)]))
    m = model.marginals(w)
    return [(int(a), int(b), model.labels[int(p.argmax())], float(p.max())) for a, b, p in zip(w.starts, w.ends, m)]
