"""Quality rules as a short-circuit cascade.

Each rule's cost (seconds per row) and selectivity (share of rows rejected) are measured on a sample of rows; rules
then run in order of rejection per cost, each only on the rows that all earlier ones let through.  The verdict is a
conjunction, so the order changes the time taken and never the result.

Edge cases: null or empty text has no words (rejected as too short); a text of one very long line or word is one
row like any other; repeated rows are judged separately; extra columns are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnower.llm import common
from winnower.llm.common import Block

#: The symbols that count, the window of the repetition rule.
SYMBOLS = "#*$%&|<>"
WINDOW = 5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ASCII = _UPPER.copy()
_ASCII[97:123] = True


def word_chars(block: Block) -> np.ndarray:
    """Code points in words."""
    return block.per_row(~common._SPACE[block.data] & ((block.data & 0xC0) != 0x80))


def symbols(block: Block) -> np.ndarray:
    return block.per_row(_SYMBOL[block.data])


def duplicate_lines(block: Block) -> np.ndarray:
    """Lines with a word that equal an earlier line of their row."""
    if not len(block.data):
        return np.zeros(block.rows, np.int64)
    breaks = np.flatnonzero(block.data == 0x0A)
    edges = np.unique(np.concatenate([breaks + 1, block.offsets]))
    starts, ends = edges[:-1], edges[1:].copy()
    ends[block.data[ends - 1] == 0x0A] -= 1
    full = np.concatenate([[0], np.cumsum(~common._SPACE[block.data])])
    has = full[ends] > full[starts]
    starts, ends = starts[has], ends[has]
    row = np.searchsorted(block.offsets, starts, "right") - 1
    key = common.mix(common.run_hashes(block.data, starts, ends) ^ common.mix(row.astype(np.uint64) + np.uint64(1)))
    _, first = np.unique(key, return_index=True)
    lines = np.bincount(row, minlength=block.rows)
    return lines - np.bincount(row[first], minlength=block.rows)


def repeated_words(block: Block) -> np.ndarray:
    """Words inside windows of ``WINDOW`` words that occur twice or more in their row, first occurrence included."""
    row = block.word_row
    n = len(row) - WINDOW + 1
    if n <= 0:
        return np.zeros(block.rows, np.int64)
    whole = row[:n] == row[WINDOW - 1 :]
    key = common.windows_of(block.hashes, WINDOW) ^ common.mix(row[:n].astype(np.uint64) + np.uint64(1))
    at = np.flatnonzero(whole)
    _, which, count = np.unique(key[at], return_inverse=True, return_counts=True)
    at = at[count[which] > 1]
    cover = np.zeros(len(row) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    return np.bincount(row[np.cumsum(cover[:-1]) > 0], minlength=block.rows)


def neighbour_repeats(block: Block) -> np.ndarray:
    """Words equal to the word before them."""
    same = (block.hashes[1:] == block.hashes[:-1]) & (block.word_row[1:] == block.word_row[:-1])
    return np.bincount(block.word_row[1:][same], minlength=block.rows)


@dataclass(frozen=True)
class Rule:
    """``rejects`` maps a block to one verdict per row."""

    name: str
    rejects: Callable[[Block], np.ndarray]


def _too_short(b: Block) -> np.ndarray:
    return b.n_words < 10


def _repetitive(b: Block) -> np.ndarray:
    return 100 * repeated_words(b) > 20 * b.n_words


def _symbol_heavy(b: Block) -> np.ndarray:
    return 10 * symbols(b) > 2 * b.n_words


def _shouting(b: Block) -> np.ndarray:
    return 2 * b.per_row(_UPPER[b.data]) > b.per_row(_ASCII[b.data])


def _stuttering(b: Block) -> np.ndarray:
    return 10 * neighbour_repeats(b) > 3 * b.n_words


def _odd_words(b: Block) -> np.ndarray:
    chars = word_chars(b)
    return (chars < 2 * b.n_words) | (chars > 25 * b.n_words)


BASE = (Rule("too_short", _too_short), Rule("repetitive", _repetitive))
RULES = (
    *BASE,
    Rule("symbol_heavy", _symbol_heavy),
    Rule("shouting", _shouting),
    Rule("stuttering", _stuttering),
    Rule("odd_words", _odd_words),
)


def measure_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000, text: str = "text", doc_id: str = "doc_id") -> dict[str, tuple[float, float]]:
    """{rule: (seconds per row, share rejected)} on about ``sample_rows`` rows chosen by hash.

    Rules are timed on the executors, each on a fresh block so that none profits from another's work; only one row
    per rule and task comes back.
    """
    total = docs.count()
    every = max(1, total // sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in common.text_chunks(batch.column(0)):
                rows = []
                for rule in rules:
                    block = Block(data, offsets)
                    began = time.perf_counter()
                    rejected = int(rule.rejects(block).sum())
                    rows.append((rule.name, time.perf_counter() - began, block.rows, rejected))
                names = ["rule", "seconds", "n", "rejected"]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)

    chosen = docs.where(F.pmod(F.xxhash64(doc_id), F.lit(every)) == 0).select(F.col(text).cast("string"))
    timed = chosen.mapInArrow(run, "rule string, seconds double, n long, rejected long").groupBy("rule")
    rows = timed.agg(F.sum("seconds").alias("s"), F.sum("n").alias("n"), F.sum("rejected").alias("r")).collect()
    return {r["rule"]: (r["s"] / r["n"], r["r"] / r["n"]) for r in rows}


def ordered(rules: tuple[Rule, ...], measured: dict[str, tuple[float, float]]) -> tuple[Rule, ...]:
    """By rejection per cost, best first; rules without a measurement last, in the order given."""

    def worth(rule: Rule) -> float:
        seconds, share = measured.get(rule.name, (1.0, 0.0))
        return share / max(seconds, 1e-12)

    return tuple(sorted(rules, key=worth, reverse=True))


def judge(block: Block, rules: tuple[Rule, ...]) -> np.ndarray:
    """Index of the rule that rejects each row, -1 for rows that pass all; later rules see survivors only."""
    verdict = np.full(block.rows, -1, np.int32)
    alive, view, within = np.arange(block.rows), block, np.arange(block.rows)  # row of block, and its place in view
    for k, rule in enumerate(rules):
        if not len(alive):
            break
        if len(alive) < 0.7 * view.rows:  # worth a copy of the survivors' bytes
            view, within = view.take(within), np.arange(len(alive))
        bad = rule.rejects(view)[within]
        verdict[alive[bad]] = k
        alive, within = alive[~bad], within[~bad]
    return verdict


def apply_rules(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, order: tuple[Rule, ...] | None = None, text: str = "text", doc_id: str = "doc_id", measures: bool = True
) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by``.

    With ``measures=False`` only ``doc_id, kept, rejected_by``, for use as a plain filter.
    """
    order = order or ordered(rules, measure_rules(docs, rules, text=text, doc_id=doc_id))
    names = pa.array([r.name for r in order] + [None], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in common.text_chunks(batch.column(1)):
                block = Block(data, offsets)
                keys = batch.column(0).slice(at, to - at)
                verdict = judge(block, order)
                by = names.take(pa.array(np.where(verdict < 0, len(order), verdict), pa.int32()))
                if not measures:
                    yield pa.RecordBatch.from_arrays([keys, pa.array(verdict < 0), by], names=["doc_id", "kept", "rejected_by"])
                    continue
                repeats = repeated_words(block)
                failed = (block.n_words < 10) | (100 * repeats > 20 * block.n_words)
                out = [block.n_words, word_chars(block), symbols(block), duplicate_lines(block), repeats]
                yield pa.RecordBatch.from_arrays(
                    [keys, *(pa.array(c.astype(np.int64)) for c in out), pa.array(failed), pa.array(verdict < 0), by],
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"],
                )

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"
    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, schema if measures else "doc_id long, kept boolean, rejected_by string")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
tok AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
win AS (SELECT rid, i, lead(word, 4) OVER (PARTITION BY rid ORDER BY i) IS NOT NULL AS whole,
        concat_ws(chr(10), word, lead(word, 1) OVER (PARTITION BY rid ORDER BY i), lead(word, 2) OVER (PARTITION BY rid ORDER BY i),
                  lead(word, 3) OVER (PARTITION BY rid ORDER BY i), lead(word, 4) OVER (PARTITION BY rid ORDER BY i)) AS k FROM tok),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM win WHERE whole) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + j) AS n FROM twice, range(0, 5) r(j) GROUP BY rid),
stut AS (SELECT rid, count(*) AS n FROM (SELECT rid, word = lag(word) OVER (PARTITION BY rid ORDER BY i) AS same FROM tok) WHERE same GROUP BY rid),
ln AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM d)
       WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT w.rid, w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
      len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(ln.n, 0)::BIGINT AS n_dup_lines,
      coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(stut.n, 0) AS stutter,
      len(regexp_extract_all(text, '[A-Z]')) AS upper_n, len(regexp_extract_all(text, '[A-Za-z]')) AS ascii_n
      FROM w LEFT JOIN rep USING (rid) LEFT JOIN ln USING (rid) LEFT JOIN stut USING (rid)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 2 * n_words OR 2 * upper_n > ascii_n OR 10 * stutter > 3 * n_words
            OR word_chars < 2 * n_words OR word_chars > 25 * n_words) AS kept
FROM f
"""
