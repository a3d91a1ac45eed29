"""Line dedup and quality rules against brute force, vectors against SQL and brute force."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np

from winnower.llm import line_dedup, quality_rules, vector_dedup
from winnower.llm.queries import ORACLE, QUERIES

from ..oracle import answer, assert_same


def normal(line):
    return re.sub(r"[^a-z0-9 \x80-\U0010ffff]+", "", line.lower()).replace("  ", " ").replace("  ", " ").strip(" ")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_lines(docs):
    """Kept text of each document, from edit distances alone."""
    lines, first = defaultdict(list), {}
    for d in docs:
        for i, line in enumerate((d[1] or "").split("\n")):
            n = normal(line)
            if len(n.split()) >= line_dedup.MIN_WORDS or len(n) >= line_dedup.MIN_CHARS:
                lines[n].append((d[0], i))
    parent = {n: n for n in lines}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    fuzzy = [n for n in lines if len(n.split()) >= 5]
    for i, a in enumerate(fuzzy):
        for b in fuzzy[i + 1 :]:
            most = int(line_dedup.EDITS * max(len(a), len(b)))
            if abs(len(a) - len(b)) <= most and sum((Counter(a) - Counter(b)).values()) <= most and distance(a, b) <= most:
                parent[find(a)] = find(b)
    for n, places in lines.items():
        first[find(n)] = min([*places, first.get(find(n), places[0])])
    gone = {p for n, places in lines.items() for p in places if p != first[find(n)]}
    return {d[0]: "\n".join(x for i, x in enumerate((d[1] or "").split("\n")) if (d[0], i) not in gone) for d in docs}, len(gone)


def documents():
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(200)]
    pool = [" ".join(rng.choice(vocabulary, rng.integers(3, 90))) for _ in range(30)]
    out = []
    for k in range(40):
        text = []
        for _ in range(rng.integers(1, 5)):
            words = str(rng.choice(pool)).split()
            if rng.random() < 0.5:
                words[rng.integers(len(words))] = str(rng.choice(["abcde", "zzzzz"]))
            text.append(" ".join(words).capitalize() + rng.choice([".", "!", ""]))
        out.append((k, "\n".join(text)))
    return out + [(100, None), (101, ""), (102, "\n\n"), (103, "short line")]


def test_lines_against_brute_force(spark):
    from pyspark.sql import functions as F

    docs = documents()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"line": F.lit(1), "key": F.lit(2), "doc": F.lit(3)})
    want, gone = brute_lines(docs)
    got = line_dedup.dedup_lines(df)
    assert {"line", "key", "doc", "n_lines", "n_removed"} <= set(got.columns)
    rows = got.collect()
    assert len(rows) == len(docs) and sum(r["n_removed"] for r in rows) == gone
    assert {r["doc_id"]: r["text"] or "" for r in rows} == want


def edited(size, rng):
    """A line of ``size`` words and the same after some words were replaced, dropped, added or misspelt."""

    def word():
        return "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 10)))

    a = [word() for _ in range(size)]
    b = list(a)
    for _ in range(rng.integers(1, max(2, size // 14) + 1)):
        at, kind = int(rng.integers(len(b))), rng.integers(4)
        if kind == 0:
            b[at] = word()
        elif kind == 1:
            del b[at]
        elif kind == 2:
            b.insert(at, word())
        else:
            b[at] = b[at][:-1] + "z"
    return " ".join(a), " ".join(b)


def test_recall_of_edited_lines(spark):
    """Of the pairs within a tenth of their characters, by edit distance alone: nine in ten at every length, 95 in 100 of all."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(31)
    made = [(size, *edited(size, rng)) for size in (6, 10, 15, 25, 32, 50, 64, 90, 140, 260) for _ in range(120)]
    pairs = spark.createDataFrame([(k, *m) for k, m in enumerate(made)], "pair long, size int, a string, b string")
    near = pairs.where("a <> b and levenshtein(a, b) <= floor(greatest(length(a), length(b)) * 0.1)").cache()
    tried = {r["size"]: r["count"] for r in near.groupBy("size").count().collect()}
    rows = near.select((2 * F.col("pair")).alias("doc_id"), "size", F.col("a").alias("text")).unionAll(near.select(2 * F.col("pair") + 1, "size", "b"))
    got = {r["size"]: r["count"] for r in line_dedup.dedup_lines(rows).where("n_removed > 0").groupBy("size").count().collect()}
    share = {size: round(got.get(size, 0) / n, 3) for size, n in tried.items()}
    assert min(share.values()) >= 0.9 and sum(got.values()) >= 0.95 * sum(tried.values()), (share, tried)


def test_unlike_lines_that_share_blocks_stay_few_pairs(spark):
    """A family of lines with half their words in common: at most two pairs for each member of a list (and eight lists a line),
    never the square of a list, and all stay."""
    rng = np.random.default_rng(4)
    shared = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(30)]
    for n in (50, 400):
        docs = spark.createDataFrame([(k, " ".join(shared + ["".join(rng.choice(list("ijklmnop"), 6)) for _ in range(20)])) for k in range(n)], "doc long, text string")
        lists = line_dedup.meeting_lists(line_dedup.voted_lines(line_dedup.lines(docs)), spark.createDataFrame([], "line long, first decimal(38,0)"))
        made = line_dedup.star_pairs(lists).count()
        assert made <= 2 * lists.count() and made <= 8 * n
        assert line_dedup.dedup_lines(docs.withColumnRenamed("doc", "doc_id")).where("n_removed > 0").count() == 0


def test_votes_by_hand(spark):
    from pyspark.sql import functions as F

    text = " ".join(f"word{k % 40}" if k % 9 else "the" for k in range(70))
    rows = spark.createDataFrame([(1, 2, 0, text)], "doc long, own long, pos int, norm string")
    hashes = [r["h"] & ((1 << 64) - 1) for r in spark.createDataFrame([(w,) for w in text.split()], "w string").select(F.xxhash64("w").alias("h")).collect()]
    got = {r["part"]: r for r in line_dedup.voted_lines(rows).collect()}
    for part, own in ((0, range(64)), (1, range(64, 70))):
        assert got[part]["n"] == len(own) and got[part]["len"] == len(text)
        for k in range(8):
            assert got[part][f"b{k}"] == sum(((hashes[i] >> 3) & line_dedup.LANES) + line_dedup.VOTER for i in own if i % 9 and hashes[i] % 8 == k)


def test_keys_are_small_code_and_turns_find_the_same_lists(spark):
    """Java leaves methods of over 8000 bytes uncompiled; each turn shuffles its keys once, and all turns find what one does."""
    rng = np.random.default_rng(12)
    made = [(k, i, 0, text) for k in range(120) for i, text in enumerate(edited(int(rng.integers(4, 90)), rng))]
    parts = line_dedup.voted_lines(spark.createDataFrame(made, "doc long, own long, pos int, norm string")).cache()
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    held = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        text = line_dedup.meeting_keys(parts)._jdf.queryExecution().explainString(mode)
        turn = line_dedup.meeting_lists(parts, None, 1, 2)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", held)
    assert 0 < max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)) < 8000
    assert turn.count("ReusedExchange") == 1
    one = {tuple(r) for r in line_dedup.meeting_lists(parts).collect()}
    assert one and {tuple(r) for t in range(2) for r in line_dedup.meeting_lists(parts, None, t, 2).collect()} == one


def test_one_occurrence_of_a_line_votes(spark):
    """Also where rows are equal in id and text: their votes are never added up."""
    from pyspark.sql import functions as F

    rows = [(k, c, c, 7, 0, f"line number {c} of some words", k) for k, c in enumerate([1, 1, 2, 3, 3, 3])]
    found = spark.createDataFrame(rows, "row long, line long, check long, own long, pos int, norm string, doc long")
    firsts = found.groupBy("line", "check").agg(F.min("doc").alias("first"), F.min("row").alias("voter"), F.count("*").alias("n"))
    got = [sorted(r["line"] for r in line_dedup.voters(found, firsts, t, 2).collect()) for t in range(2)]
    assert got == [[2], [1, 3]]


def test_lines_of_null_and_repeated_ids(spark):
    line = "the quick brown fox jumps over the lazy dog again"
    rows = [(None, line), (None, line + "\nmore"), (None, None), (3, line), (3, line), (3, line + "\nother")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 6
    assert sum(r["n_removed"] for r in got) == 4  # one occurrence stays: that of a row without an id


def test_line_edge_cases(awkward, nothing):
    rows = line_dedup.dedup_lines(awkward).collect()
    assert len(rows) == awkward.count()
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert by[1][0]["text"] is None and by[2][0]["text"] == "" and by[14][0]["n_removed"] == 0
    assert by[7][0]["text"] == "" and by[6][0]["n_removed"] == 0  # the same line but for case
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_rules_query(spark, sf):
    assert_same(QUERIES["op8_quality_rules"](spark, sf).toPandas(), answer(ORACLE["op8_quality_rules"], sf))


def by_hand(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    cover = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover)


def test_rules_edge_cases(awkward, clashing, nothing):
    want = sorted((str(r["doc_id"]), *by_hand(r["text"])) for r in awkward.collect())
    for docs in (awkward, clashing):
        got = quality_rules.apply_rules(docs).collect()
        assert sorted((str(r["doc_id"]), *(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))) for r in got) == want
        for r in got:
            assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and not (r["kept"] and r["base_failed"])
    assert quality_rules.apply_rules(nothing).count() == 0


def test_order_changes_nothing_but_the_reason(awkward):
    a = quality_rules.apply_rules(awkward, order=quality_rules.RULES).collect()
    b = quality_rules.apply_rules(awkward, order=quality_rules.RULES[::-1]).collect()
    assert sorted((str(r["doc_id"]), r["kept"]) for r in a) == sorted((str(r["doc_id"]), r["kept"]) for r in b)
    measured = {"too_short": (1.0, 0.1), "symbol_heavy": (0.1, 0.5), "shouting": (1.0, 0.0)}
    assert [r.name for r in quality_rules.ordered(quality_rules.RULES, measured)][0] == "symbol_heavy"


def test_vectors_query(spark, sf):
    assert_same(QUERIES["op6_vector_dedup"](spark, sf).toPandas(), answer(ORACLE["op6_vector_dedup"], sf))


def vectors():
    rng = np.random.default_rng(6)
    out = [(1, None, 0), (2, [], 0), (3, [0.0] * 8, 0), (4, [float("nan")] + [1.0] * 7, 0), (5, [1.0] * 7 + [None], 0), (6, [float("inf")] + [1.0] * 7, 0), (7, [1.0] * 8, None)]
    out += [(8, [1e-30] * 8, 0), (9, [1e30] * 8, 0), (10, [1.0] * 8, 0), (10, [1.0] * 8, 0), (11, [-0.0, 1.0] + [0.0] * 6, 1), (12, [0.0, 1.0] + [0.0] * 6, 1), (13, [1.0, 2.0], 1)]
    base = rng.normal(size=(6, 8))
    for k in range(300):
        v = base[k % 6] + rng.normal(size=8) * rng.choice([0.05, 0.2, 0.6])
        out.append((100 + k, [float(x) for x in v], int(k % 2) if k % 6 else 3))
    return out


def brute_vectors(rows):
    ok = [(i, np.array(v, float), y) for i, v, y in rows if v and y is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = [(i, v / np.abs(v).max(), y) for i, v, y in ok]
    unit = [(i, v / np.linalg.norm(v), y) for i, v, y in unit]
    links, parent = Counter(), {r[0]: r[0] for r in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(unit)):
        for b in range(len(unit)):
            if a != b and unit[a][2] == unit[b][2] and len(unit[a][1]) == len(unit[b][1]) and unit[a][1] @ unit[b][1] >= 0.93:
                links[a] += 1
                x, y = find(unit[a][0]), find(unit[b][0])
                parent[max(x, y)] = min(x, y)
    n = {unit[a][0]: c for a, c in links.items()}
    return sorted((r[0], n.get(r[0], 0), find(r[0]), find(r[0]) == r[0]) for r in rows)


def test_vectors_against_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame([(i, v, y, "x", 1) for i, v, y in rows], "vec_id long, embedding array<double>, label int, node string, shards int")
    want = brute_vectors(rows)
    for options in ({}, {"shard_rows": 40}, {"shard_rows": 40, "max_shard": 16}):
        out, audited = vector_dedup.near_duplicates(df, **options)
        assert sorted(map(tuple, out.collect())) == want and audited["recall"] >= 0.99
    assert vector_dedup.near_duplicates(df.limit(0))[0].count() == 0


def test_lines_that_no_leader_meets_are_linked(spark):
    words = ["the quick brown fox jumps over the lazy dog today", "seven green apples fell from one old tree nearby yes", "seven green apples fell from one old tree nearby yeah",
             "nothing here resembles any other line in this list"]
    texts = spark.createDataFrame([(i, i, t) for i, t in enumerate(words)], "line long, check long, norm string")
    lists = spark.createDataFrame([(7, 1, i, len(t), 0, 3, len(words[0]), len(words[3])) for i, t in enumerate(words)],
                                  "key long, run long, line long, len int, lo long, hi long, lo_len int, hi_len int")
    assert {tuple(r) for r in line_dedup.groups_of(lists, texts).select("node", "component").collect()} == {(2, 1)}


def test_pairs_left_open_never_become_rows(spark, monkeypatch):
    """Lines that share most words and are unlike, and one pair that is near: no table grows with the square of their number, and the pair is found."""
    rng = np.random.default_rng(9)
    shared = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(40)]
    n, sizes, spool = 400, {}, line_dedup.common.spool
    texts = [" ".join(shared + ["".join(rng.choice(list("ijklmnopqrstuvwx"), 6)) for _ in range(12)]) for _ in range(n)]
    texts.append(texts[200][:-2] + "zz")

    def counted(df, name, *codec):
        out = spool(df, name, *codec)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(line_dedup.common, "spool", counted)
    got = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("n_removed > 0").collect()
    assert [r["doc_id"] for r in got] == [n]
    assert max(sizes.values()) <= 16 * n, sizes


def test_texts_of_lines_are_stored_once_and_shuffled_once(spark, monkeypatch):
    """Unlike lines, some repeated: one stored table holds texts, each occurrence once; votes are counted where the texts were sent."""
    rng = np.random.default_rng(12)
    texts = ["".join(rng.choice(list("abcdefgh"), 6)) + " " + " ".join("".join(rng.choice(list("ijklmnop"), 7)) for _ in range(9)) for _ in range(60)]
    texts += texts[:20]
    held, plans, spool = {}, {}, line_dedup.common.spool

    def counted(df, name, *args):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        out = spool(df, name, *args)
        if "norm" in out.columns:
            held[name] = out.count()
        return out

    monkeypatch.setattr(line_dedup.common, "spool", counted)
    got = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in got if r["n_removed"]) == list(range(60, 80))
    assert held.pop("lines") == 80 and sum(held.values()) <= 2, held
    assert plans["line-votes"].count("Exchange hashpartitioning") == 1, plans["line-votes"]
