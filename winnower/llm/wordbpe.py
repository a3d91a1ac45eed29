"""Token ids of many texts at once, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``.

For a lower-casing byte-level BPE with word ends (NFC, white space dropped), each pre-token is encoded on its own.
The texts' bytes are cut into pre-tokens with array operations, distinct ones are encoded together by applying the
merge of lowest rank in all of them at once, and the results are kept.  White-space-separated runs that hold
anything but ASCII and Latin-1 letters, or apostrophes, go through the library itself, as do whole texts
of a tokenizer of any other kind.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from winnower.llm import common

_NONE = np.int64(1) << 40
#: Pre-tokens kept by one worker; the store starts anew beyond it.
KEEP = 1_500_000

_LETTER, _DIGIT, _OTHER, _BLANK = 1, 2, 3, 0
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[common._SPACE] = _BLANK
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[128:192] = _LETTER  # second bytes of the only two-byte letters that stay on the fast path
_CLASS[0xC3] = _LETTER
_ODD = np.ones(256, bool)
_ODD[33:127] = _ODD[128:192] = _ODD[0xC3] = False
_ODD[common._SPACE] = False
_ODD[0x27] = True


def _gather(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges start..start+count."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


class WordBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, norm = spec["model"], spec.get("normalizer") or {}
        kinds = [x.get("type") for x in norm.get("normalizers", [])]
        self.fast = (
            model.get("type") == "BPE"
            and model.get("end_of_word_suffix") == "</w>"
            and not model.get("continuing_subword_prefix")
            and not model.get("dropout")
            and not model.get("ignore_merges")
            and kinds == ["NFC", "Replace", "Lowercase"]
        )
        if not self.fast:
            return
        vocab = model["vocab"]
        letter = self._byte_letters()
        self.base = np.array([vocab[letter[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[letter[b] + "</w>"] for b in range(256)], np.int64)
        self.size = np.int64(max(vocab.values()) + 1)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * int(self.size) + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self._reset()

    @staticmethod
    def _byte_letters() -> dict[int, str]:
        """The public byte-level alphabet: printable bytes stand for themselves, others for U+0100 onwards."""
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = (b for b in range(256) if b not in plain)
        return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}

    # ---- distinct pre-tokens -> ids

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def _merge(self, body: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for units whose bytes lie one after another in ``body``."""
        units = len(counts)
        ends = np.cumsum(counts)
        symbol = self.base[body]
        symbol[ends - 1] = self.last[body[ends - 1]]
        owner = np.repeat(np.arange(units), counts)
        rank = np.full(len(symbol), _NONE)
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inside] = self._rank(symbol[inside], symbol[inside + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.r_[first, len(symbol)])
            live = least < _NONE
            if not live.all():
                stay = np.repeat(live, sizes)
                done.append((owner[~stay], symbol[~stay]))
                symbol, owner, rank = symbol[stay], owner[stay], rank[stay]
                if not len(symbol):
                    break
                least, sizes = least[live], sizes[live]
            hit = rank == np.repeat(least, sizes)
            at = np.flatnonzero(hit)
            if len(at) > 1 and (at[1:] == at[:-1] + 1).any():  # "aaa": left to right, without overlap
                run = np.r_[True, at[1:] != at[:-1] + 1]
                begin = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - begin) % 2 == 0]
            symbol[at] = self.made[rank[at]]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            new = np.cumsum(keep) - 1
            symbol, owner, rank = symbol[keep], owner[keep], rank[keep]
            at = new[at]
            again = np.unique(np.r_[at, at[at > 0] - 1])
            again = again[again < len(symbol) - 1] if len(symbol) else again
            rank[at] = _NONE
            pair = owner[again] == owner[again + 1]
            rank[again[~pair]] = _NONE
            again = again[pair]
            rank[again] = self._rank(symbol[again], symbol[again + 1])
        owner = np.concatenate([o for o, _ in done]) if done else np.zeros(0, np.int64)
        symbol = np.concatenate([s for _, s in done]) if done else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        return symbol[order].astype(np.uint32), np.bincount(owner, minlength=units)

    # ---- kept results

    def _reset(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.fresh: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def _settle(self) -> None:
        """Move newly encoded pre-tokens into the sorted store."""
        if not self.fresh:
            return
        if len(self.known) > KEEP:
            self.known, self.at, self.count, self.ids = self.known[:0], self.at[:0], self.count[:0], self.ids[:0]
        h = np.concatenate([self.known, *(f[0] for f in self.fresh)])
        count = np.concatenate([self.count, *(f[2] for f in self.fresh)])
        base, at = len(self.ids), [self.at]
        for _, ids, c in self.fresh:
            at.append(base + np.cumsum(c) - c)
            base += len(ids)
        at = np.concatenate(at)
        self.ids = np.concatenate([self.ids, *(f[1] for f in self.fresh)])
        self.known, first = np.unique(h, return_index=True)
        self.at, self.count, self.fresh = at[first], count[first], []

    # ---- texts -> ids

    def encode_rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows one after another, number of ids before each row and at the end)."""
        rows = len(offsets) - 1
        if not self.fast:
            raw = data.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])]
            ids = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
            total = np.zeros(rows + 1, np.int64)
            total[1:] = np.cumsum([len(x) for x in ids])
            return np.array([i for x in ids for i in x], np.uint32), total
        starts, ends, _ = common.words_of(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(rows + 1, np.int64)
        low = common._LOWER[data]
        c3 = np.flatnonzero(data == 0xC3)
        c3 = c3[c3 + 1 < len(data)]
        second = data[c3 + 1]
        upper = (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
        low[c3[upper] + 1] += 0x20
        odd = _ODD[data]
        odd[c3[(second == 0x97) | (second == 0xB7)]] = True
        lead = np.zeros(len(data) + 1, bool)  # a byte 80..BF not after C3 belongs to another character
        lead[c3 + 1] = True
        high = (data >= 0x80) & (data < 0xC0)
        odd |= high & ~lead[:-1]
        mark = np.flatnonzero(data[:-1] == 0x3C)
        odd[mark[data[mark + 1] == 0x7C]] = True
        seen = np.r_[0, np.cumsum(odd)]
        rare = seen[ends] > seen[starts]
        kind = _CLASS[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        cut[starts] = True
        cut[ends] = True
        if rare.any():
            inside = np.zeros(len(data) + 1, np.int64)
            np.add.at(inside, starts[rare], 1)
            np.add.at(inside, ends[rare], -1)
            whole = np.cumsum(inside)[:-1] > 0
            cut[:-1][whole] = False
            cut[starts[rare]] = True
            cut[ends[rare]] = True
        blank = kind == _BLANK
        a = np.flatnonzero(cut[:-1] & ~blank)
        b = np.flatnonzero(cut[1:] & ~blank) + 1
        h = common.word_hashes(low, a, b, lower=False)
        slow = np.zeros(len(a), bool)
        if rare.any():  # these are hashed as they stand, apart from the others
            slow = whole[a]
            raw_h = common.word_hashes(data, a, b, lower=False)
            h = np.where(slow, common.mix(raw_h + np.uint64(7)), h)
        distinct, first, which = np.unique(h, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, distinct), max(0, len(self.known) - 1))
        have = self.known[at] == distinct if len(self.known) else np.zeros(len(distinct), bool)
        at_ids, count = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        pool = self.ids
        at_ids[have], count[have] = self.at[at[have]], self.count[at[have]]
        for want in (~have & ~slow[first], ~have & slow[first]):
            k = np.flatnonzero(want)
            if not len(k):
                continue
            i = first[k]
            if slow[i[0]]:
                raw = data.tobytes()
                lists = [self.library.encode(raw[a[x] : b[x]].decode("utf-8", "replace"), add_special_tokens=False).ids for x in i]
                c = np.array([len(x) for x in lists], np.int64)
                ids = np.array([y for x in lists for y in x], np.uint32)
            else:
                c0 = b[i] - a[i]
                ids, c = self._merge(low[_gather(a[i], c0)], c0)
            at_ids[k], count[k] = len(pool) + np.cumsum(c) - c, c
            pool = np.concatenate([pool, ids])
            self.fresh.append((distinct[k], ids, c))
        counts = count[which]
        out = pool[_gather(at_ids[which], counts)]
        total = np.r_[0, np.cumsum(counts)][np.searchsorted(a, offsets)]
        if sum(len(f[0]) for f in self.fresh) > max(100_000, len(self.known) // 4):
            self._settle()
        return out, total


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    """One encoder for each file and worker process."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode_column(path: str, column: pa.Array):
    """Yield (first row, last row + 1, ids, offsets) over an Arrow text column."""
    encoder = loaded(path)
    for at, to, data, offsets in common.text_chunks(column, 2 << 20):
        yield at, to, *encoder.encode_rows(data, offsets)
