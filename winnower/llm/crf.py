"""A linear-chain conditional random field over words, with hashed features, trained here with NumPy.

Words are runs of letters, lower-cased.  Features: the word itself (lexicon), its first and last 1 to 5 bytes (affixes)
and its byte n-grams.  Forward-backward is exact over sequences of any length: sequences are cut into blocks, the
transfer matrices of all blocks are multiplied out side by side, a short scan over blocks gives each block's
boundary messages, and the blocks are then filled in side by side.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from winnower.llm import common

BITS = 18
AFFIX = (1, 2, 3, 4, 5)
GRAMS = (2, 3, 4)
_BLOCK = 64

#: Bytes that are not part of a word: ASCII other than letters.
_BLANK = np.zeros(256, bool)
_BLANK[:128] = True
_BLANK[65:91] = _BLANK[97:123] = False


def lowered(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case."""
    low = common._LOWER[data]
    c3 = np.flatnonzero(data[:-1] == 0xC3)
    second = data[c3 + 1]
    low[c3[(second >= 0x80) & (second <= 0x9E) & (second != 0x97)] + 1] += 0x20
    return low


def has_letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each row holds a letter of any script."""
    ascii_ = np.concatenate([[0], np.cumsum(~_BLANK[data] & (data < 128))])
    high = np.concatenate([[0], np.cumsum(data >= 128)])
    found = ascii_[offsets[1:]] > ascii_[offsets[:-1]]
    for k in np.flatnonzero(~found & (high[offsets[1:]] > high[offsets[:-1]])):
        found[k] = any(c.isalpha() for c in data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace"))
    return found


@dataclass
class Words:
    """The words of some rows: their places, distinct forms and which form each word is."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    form_starts: np.ndarray
    form_ends: np.ndarray
    which: np.ndarray
    low: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    low = lowered(data)
    starts, ends, first = common.words_of(data, offsets, _BLANK)
    _, at, which = np.unique(common.run_hashes(low, starts, ends), return_index=True, return_inverse=True)
    return Words(starts, ends, first, starts[at], ends[at], which, low)


def _slots(h: np.ndarray, salt: int) -> np.ndarray:
    return (common.mix(h + np.uint64(salt * 0xD1342543DE82EF95 % (1 << 64))) >> np.uint64(64 - BITS)).astype(np.int64)


def features(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[tuple[np.ndarray, np.ndarray]]]:
    """Hash slots of the distinct forms: [(form, slot)] with weight one, and [(form, slot)] whose weights are averaged."""
    sizes = ends - starts
    single = [(np.arange(len(starts)), _slots(common.run_hashes(low, starts, ends), 1))]
    for k in AFFIX:
        at = np.flatnonzero(sizes > k)
        single.append((at, _slots(common.run_hashes(low, starts[at], starts[at] + k), 10 + k)))
        single.append((at, _slots(common.run_hashes(low, ends[at] - k, ends[at]), 20 + k)))
    form = np.repeat(np.arange(len(starts)), sizes)
    place = np.arange(len(form)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    body = low[np.repeat(starts, sizes) + place]
    shared = []
    value = common._EVERY[body]
    for n in GRAMS:
        at = np.flatnonzero(place + n <= np.repeat(sizes, sizes))
        h = np.zeros(len(at), np.uint64)
        factor = np.uint64(1)
        with np.errstate(over="ignore"):
            for j in range(n):
                h += value[at + j] * factor
                factor = factor * common._PRIME
        shared.append((form[at], _slots(h, 30 + n)))
    return single, shared


def _chain(emit: np.ndarray, offsets: np.ndarray, T: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginals, forward, backward) of each word, rows scaled; ``emit`` holds exp scores, ``T`` exp transitions."""
    n, K = emit.shape
    if not n:
        return emit, emit, emit
    sizes = np.diff(offsets)
    blocks = -(-sizes // _BLOCK)
    lead = np.concatenate([[0], np.cumsum(blocks)])
    B = int(lead[-1])
    row = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(n) - offsets[:-1][row]
    b, t = lead[row] + inside // _BLOCK, inside % _BLOCK
    e = np.ones((_BLOCK, B, K))
    live = np.zeros((_BLOCK, B), bool)
    e[t, b] = emit
    live[t, b] = True
    whole = np.broadcast_to(np.eye(K), (B, K, K)).copy()
    for s in range(_BLOCK):
        step = (whole @ T) * e[s][:, None, :]
        step /= step.sum((1, 2), keepdims=True)
        whole = np.where(live[s][:, None, None], step, whole)
    # boundary messages, one step over blocks for all rows at once
    into = np.full((B, K), 1.0 / K)
    out = np.ones((B, K))
    most = int(blocks.max())
    for s in range(1, most):
        rows_ = np.flatnonzero(blocks > s)
        at = lead[rows_] + s
        v = np.einsum("bk,bkl->bl", into[at - 1], whole[at - 1])
        into[at] = v / v.sum(1, keepdims=True)
    for s in range(most - 1, 0, -1):
        rows_ = np.flatnonzero(blocks > s)
        at = lead[rows_] + s
        v = np.einsum("bkl,bl->bk", whole[at], out[at])
        out[at - 1] = v / v.sum(1, keepdims=True)
    ahead, back = np.empty((_BLOCK, B, K)), np.empty((_BLOCK, B, K))
    v = into
    for s in range(_BLOCK):
        step = (v @ T) * e[s]
        step /= step.sum(1, keepdims=True)
        v = np.where(live[s][:, None], step, v)
        ahead[s] = v
    v = out
    for s in range(_BLOCK - 1, -1, -1):
        back[s] = v
        step = (v * e[s]) @ T.T
        step /= step.sum(1, keepdims=True)
        v = np.where(live[s][:, None], step, v)
    f, g = ahead[t, b], back[t, b]
    m = f * g
    return m / m.sum(1, keepdims=True), f, g


@dataclass
class Crf:
    """Weights per hash slot and label, and transition scores."""

    labels: list
    weights: np.ndarray
    transitions: np.ndarray

    def scores(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Emission scores of distinct forms."""
        out = np.zeros((len(starts), len(self.labels)), np.float64)
        single, shared = features(low, starts, ends)
        return _score(out, self.weights, single, shared)

    def marginals(self, w: Words) -> np.ndarray:
        """Probability of each label for each word, by forward-backward."""
        if not len(w.starts):
            return np.zeros((0, len(self.labels)))
        s = self.scores(w.low, w.form_starts, w.form_ends)
        s = np.exp(s - s.max(1, keepdims=True))
        return _chain(np.maximum(s, 1e-30)[w.which], w.first, np.exp(self.transitions))[0]


def _score(out: np.ndarray, weights: np.ndarray, single, shared) -> np.ndarray:
    for form, slot in single:
        out[form] += weights[slot]
    for form, slot in shared:
        if len(form):
            begin = np.flatnonzero(np.r_[True, form[1:] != form[:-1]])
            count = np.diff(np.r_[begin, len(form)])
            out[form[begin]] += np.add.reduceat(weights[slot].astype(np.float64), begin, axis=0) / count[:, None]
    return out


def train(texts: list[str], word_labels: list[np.ndarray], labels: list, rounds: int = 30, rate: float = 0.4, decay: float = 1e-4) -> Crf:
    """Maximise the conditional likelihood of the labelled sequences by AdaGrad over the whole (bounded) sample."""
    if not texts:
        return Crf(labels, np.zeros((1 << BITS, len(labels)), np.float32), np.zeros((len(labels), len(labels))))
    ((_, _, data, offsets),) = common.text_chunks(pa.array(texts, pa.large_string()), 1 << 62)
    w = words(data, offsets)
    gold = np.concatenate(word_labels)
    K = len(labels)
    single, shared = features(w.low, w.form_starts, w.form_ends)
    shares = [(f, s, 1.0 / np.bincount(f, minlength=len(w.form_starts))[f]) for f, s in shared]
    weights, squares = np.zeros((1 << BITS, K)), np.full((1 << BITS, K), 1e-8)
    trans, tsquares = np.zeros((K, K)), np.full((K, K), 1e-8)
    n = max(1, len(gold))
    target = np.zeros((n if len(gold) else 0, K))
    target[np.arange(len(gold)), gold] = 1
    begins = np.zeros(len(gold), bool)
    begins[w.first[:-1][np.diff(w.first) > 0]] = True
    inner = np.flatnonzero(~begins)
    for _ in range(rounds):
        s = _score(np.zeros((len(w.form_starts), K)), weights, single, shared)
        e = np.maximum(np.exp(s - s.max(1, keepdims=True)), 1e-30)[w.which]
        T = np.exp(trans)
        m, f, g = _chain(e, w.first, T)
        pair = f[inner - 1][:, :, None] * T[None] * (e[inner] * g[inner])[:, None, :]
        pair /= pair.sum((1, 2), keepdims=True)
        seen = np.zeros((K, K))
        np.add.at(seen, (gold[inner - 1], gold[inner]), 1)
        grad = target - m
        per_form = np.stack([np.bincount(w.which, weights=grad[:, k], minlength=len(w.form_starts)) for k in range(K)], 1)
        step = np.zeros_like(weights)
        for k in range(K):
            for form, slot in single:
                step[:, k] += np.bincount(slot, weights=per_form[form, k], minlength=1 << BITS)
            for form, slot, share in shares:
                step[:, k] += np.bincount(slot, weights=per_form[form, k] * share, minlength=1 << BITS)
        step = step / n - decay * weights
        squares += step * step
        weights += rate * step / np.sqrt(squares)
        step = (seen - pair.sum(0)) / n - decay * trans
        tsquares += step * step
        trans += rate * step / np.sqrt(tsquares)
    return Crf(labels, weights.astype(np.float32), trans)


def labelled_sample(docs: DataFrame, labels: DataFrame, per_label: int, max_chars: int, doc_id: str = "doc_id", text: str = "text") -> list[tuple[int, str, object]]:
    """At most ``per_label`` documents of each value of ``labels`` (doc_id, label), by hash order of the id: training only.

    Held-out documents, null ids and null labels never enter.  Of a text over ``max_chars`` a window of that length is taken, at a
    place that the id's hash chooses; of several texts of one id the least.  Ids are ranked once each and without their texts;
    only the chosen ids' texts, one each, come to the driver.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("label").alias("_label")).where("_label is not null and _id is not null")
    own = own.where(~common.held_out("_id")).distinct()
    order = Window.partitionBy("_label").orderBy(F.xxhash64("_id"), "_id")
    chosen = own.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_label).drop("_r")
    begin = F.pmod(F.xxhash64("_id", F.lit(7)), F.greatest(F.length("_text") - int(max_chars), F.lit(0)) + 1).cast("int") + 1
    texts = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("string").alias("_text")).where("_text is not null")
    texts = texts.join(F.broadcast(chosen), "_id").select("_id", "_label", F.substring("_text", begin, F.lit(int(max_chars))).alias("_text"))
    rows = texts.groupBy("_id", "_label").agg(F.min("_text").alias("_text")).collect()
    return sorted(((r["_id"], r["_text"], r["_label"]) for r in rows), key=lambda r: (r[0], r[1], str(r[2])))
