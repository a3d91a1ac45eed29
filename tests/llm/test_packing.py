from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from winnower.llm import packing, wordbpe
from winnower.llm.queries import QUERIES, tokenizer_path


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def check(index, docs, capacity):
    tok = library()
    want = Counter()
    for d in docs:
        ids = tok.encode(d["text"] or "", add_special_tokens=False).ids + [1]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            want[d["doc_id"], piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in index) == want
    by = {}
    for r in index:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("capacity", [50, 4096])
def test_round_trip(awkward, capacity):
    _, index, found = packing.pack_documents(awkward, tokenizer_path(), capacity)
    assert check(index.collect(), awkward.collect(), capacity) == found.sequences


def test_clashing_columns_and_empty(clashing, nothing):
    assert packing.pack_documents(clashing, tokenizer_path())[1].count() == packing.pack_documents(clashing.select("doc_id", "text"), tokenizer_path())[1].count()
    assert packing.pack_documents(nothing, tokenizer_path())[1].count() == 0


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert check(QUERIES["op2_packing"](spark, sf).collect(), docs, 4096) > 0


def brute(sizes: list[int], capacity: int) -> int:
    best = [len(sizes)]
    sizes = sorted(sizes, reverse=True)

    def go(k: int, bins: list[int]) -> None:
        if len(bins) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + sizes[k] <= capacity and bins[i] not in bins[:i]:
                bins[i] += sizes[k]
                go(k + 1, bins)
                bins[i] -= sizes[k]
        go(k + 1, [*bins, sizes[k]])

    go(0, [])
    return best[0]


def test_bin_completion_is_optimal_on_small_cases():
    rng = random.Random(2)
    for _ in range(60):
        capacity = rng.randint(10, 40)
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 11))]
        found = packing.bin_completion(Counter(sizes), capacity)
        used = Counter()
        for pattern, times in found.patterns:
            assert sum(pattern) <= capacity
            for s in pattern:
                used[s] += times
        assert used == Counter(sizes)
        assert found.bound <= brute(sizes, capacity) <= found.sequences
        assert found.sequences == brute(sizes, capacity)


def test_bad_lengths():
    with pytest.raises(ValueError):
        packing.bin_completion({5: 1}, 4)


def test_encoder_equals_library():
    import pyarrow as pa

    texts = ["", "aaaa aaaa'll THE théâtre × ÷ 12 3x <|endoftext|>a <|startoftext|", "é́ İ ß \x1c\x85 a", "[[x]] #*$%& !!?"]
    got = []
    for a, b, ids, off in wordbpe.encode_column(tokenizer_path(), pa.array(texts)):
        got += [ids[off[k] : off[k + 1]].tolist() for k in range(b - a)]
    assert got == [library().encode(t, add_special_tokens=False).ids for t in texts]
