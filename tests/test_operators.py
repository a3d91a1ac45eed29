"""Rules, expressions, readers, writers, structures and streams on small literal tables."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from winnower.functions import columns, structures
from winnower.operators import decisions, expressions, margins, matching, rules, selection, tolerance
from winnower.operators.rules import Profile, Rule
from winnower.sources import sinks, tables


@pytest.fixture(scope="module")
def df(spark):
    rows = [(1, 10.0, "a", True), (2, float("nan"), "b", False), (3, None, None, None), (4, 30.0, "", True)]
    return columns.without_nan(spark.createDataFrame(rows, "record_id long, x double, s string, flag boolean"))


def values(df, column):
    return [r["v"] for r in df.select(column.alias("v"), "record_id").orderBy("record_id").collect()]


@pytest.mark.parametrize(
    ("rule", "want"),
    [
        (Rule("r", "x", "<", 20), [True, False, False, False]), (Rule("r", "x", ">=", 10), [True, False, False, True]), (Rule("r", "x", "!=", 10), [False, False, False, True]),
        (Rule("r", "x", "between_exclusive", (10, 40)), [False, False, False, True]), (Rule("r", "s", "not_in", ("a",)), [False, True, False, True]),
        (Rule("r", "s", "<", 5), [False] * 4), (Rule("r", "flag", "contains_substructure"), [True, False, False, True]),
        (Rule("r", "flag", "does_not_contain_substructure"), [False, True, True, False]),
    ],
)
def test_missing_fails_closed(df, rule, want):
    assert values(df, rule.satisfied()) == want


def test_bad_rules():
    for bad in ({"operator": "like"}, {"operator": "between_inclusive", "threshold": (3, 1)}, {"operator": "in", "threshold": 3}, {"operator": "<", "threshold": 1, "severity": "odd"}):
        with pytest.raises(ValueError):
            Rule("r", "x", **bad)
    rule = Rule("r", "x", "<", 1)
    for args in (("p", ()), ("p", (rule, rule)), ("p", (rule,), 5)):
        with pytest.raises(ValueError):
            Profile(*args)


def test_missing_column_is_an_error(df):
    with pytest.raises(ValueError, match="zzz"):
        rules.evaluate(df, [Profile("p", (Rule("r", "zzz", "<", 1),))])


def test_many_rules_have_no_mask(df):
    p = Profile("p", tuple(Rule(f"r{k}", "x", "<", k) for k in range(70)))
    assert rules.evaluate(df, [p]).select("p__mask").first()[0] is None
    assert rules.evaluate(df, [Profile("q", p.rules[:63])]).where("record_id = 3").first()["q__mask"] == (1 << 63) - 1


def test_profiles_from_files(tmp_path):
    spec = {"id": "lipinski", "rules": [{"id": "a", "descriptor": "x", "operator": "between_inclusive", "threshold": [1, 2]}], "policy": {"type": "all_rules"}}
    (tmp_path / "one.json").write_text(json.dumps(spec))
    assert rules.load_profiles(str(tmp_path))["lipinski"].rules[0].bounds == (1.0, 2.0)
    (tmp_path / "two.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        rules.load_profiles(str(tmp_path))
    assert len(rules.BUILT_IN) == 11 and rules.BUILT_IN["lipinski"].max_violations == 1


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("x > 5 AND flag", [True, False, False, True]), ("NOT (x > 5)", [False, True, True, False]), ("5 < X <= 10 or s == 'b'", [True, True, False, False]),
        ("s == 'or'", [False] * 4), ("x - 1 > 2", None), ("__import__('os')", None), ("nope == 1", None), ("x >", None), ("x", [True, False, False, True]), ("x > -1", [True, False, False, True]),
    ],
)
def test_expressions(df, text, want):
    if want is None:
        with pytest.raises(expressions.ExpressionError):
            expressions.compile_expression(df, text)
    else:
        assert values(df, expressions.compile_expression(df, text)) == want


def test_consensus_shares_weights(df):
    assert values(df, decisions.consensus_score(F.lit(1.0), F.lit(None).cast("double")))[0] == 1.0
    assert values(df, decisions.consensus_score(F.lit(None).cast("double")))[0] is None
    assert abs(values(df, decisions.consensus_score(F.lit(1.0), F.lit(0.0), F.lit(9)))[0] - 0.5) < 1e-12


def test_strict_roles(df):
    out = df.withColumns({"p__passed": F.lit(False)})
    assert decisions.decide(out, decisions.Policy({"p": "exclusion"})).where("selected").count() == 4
    assert decisions.decide(out, decisions.Policy({"p": "exclusion"}, strict_roles=True)).where("selected").count() == 0


def test_margins_of_missing_values(df):
    got = {r["record_id"]: r for r in margins.margins(df, [Rule("r", "x", "<=", 20)]).collect()}
    assert got[3]["margin"] is None and got[3]["status"] == "ROBUST_FAIL"
    got = {r["record_id"]: r["x2"] for r in df.select("record_id", columns.number("x").alias("x2")).collect()}
    assert got[2] is None


def test_similarity_join_by_size_equals_all_pairs(spark):
    rows = spark.range(120).select("id", F.array((F.col("id") * 2654435761 % (1 << 32)), (F.col("id") * 40503 % (1 << 31))).alias("words"))
    a, b = rows.where("id % 2 = 0"), rows.where("id % 2 = 1")
    want = {tuple(r) for r in matching.similarities(a, b, "id", "id", least=0.4).collect()}
    got = {tuple(r) for r in matching.similarities(a, b, "id", "id", least=0.4, broadcast_rows=3).collect()}
    assert got == want and want
    with pytest.raises(ValueError):
        matching.similarities(a, b, "id", "id", broadcast_rows=3)


def test_largest_remainder():
    assert selection.largest_remainder({"a": 1, "b": 1, "c": 1}, 4) == {"a": 2, "b": 1, "c": 1}
    assert selection.largest_remainder({"a": 0}, 4) == {"a": 0}


def test_guards(spark):
    rows = spark.range(20).select(F.col("id").alias("record_id"), F.array(F.col("id"), F.col("id")).alias("words"))
    with pytest.raises(ValueError):
        selection.butina(rows, most=10)
    assert selection.maxmin(rows.limit(0), 3).count() == 0


def test_prediction_sets_and_state(spark):
    one = spark.range(1)
    sets = tolerance.prediction_set(F.lit(0.5), F.lit(0.6), F.lit(0.6))
    assert one.select(sets.alias("s")).first()["s"] == [0, 1]
    state = tolerance.state(F.lit(False), F.lit(True), F.lit(None).cast("double"), 0.5)
    assert one.select(state.alias("s")).first()["s"] == "excluded"


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ID;SMILES;n\nx;CCO;01\n;c1ccccc1;2\ny; ;3\n")
    (tmp_path / "b.smi").write_text("# comment\nCCN amine more\n\nCCC\n")
    assert tables.delimiter("a;b;c,d") == ";" and tables.delimiter("abc") == ","
    assert tables.guess_mapping(["Name", "Canonical_SMILES"]) == ("Canonical_SMILES", "Name")
    a = tables.read_table(spark, str(tmp_path / "a.csv"))
    assert a.columns == ["ID", "SMILES", "n"] and a.first()["n"] == "01"
    rows = tables.load_records(spark, [tables.Source(str(tmp_path / "a.csv")), tables.Source(str(tmp_path / "b.smi"))]).orderBy("record_id").collect()
    assert [(r["record_id"], r["molecule_id"], r["source_row"]) for r in rows] == [(1, "x", 2), (2, "REC0000002", 3), (3, "y", 4), (4, "amine", 2), (5, "REC0000005", 3)]
    with pytest.raises(ValueError):
        tables.read_table(spark, str(tmp_path / "c.xyz"))


def test_evidence_classes(spark):
    rows = [("1", "", "=", "7.1", "AAA"), ("1;0", "1", "=", "7", "AAA"), ("1", "", ">", "7", "AAA"), ("1", "", "=", "x", "AAA"), ("1", "", "=", "7", "A")]
    got = tables.classify_evidence(spark.createDataFrame(rows, "ki string, kd string, rel string, v string, id string"), {"ki": "Ki", "kd": "KD"}, "rel", "v", "id", "[A-Z]{3}")
    assert [r["evidence"] for r in got.collect()] == ["kept", "mixed", "censored", "other", "other"]


def test_bundle_round_trip(spark, df, tmp_path):
    folder = str(tmp_path / "bundle")
    sinks.write_bundle(df, folder, {"name": "x"})
    back, manifest = sinks.read_bundle(spark, folder)
    assert manifest["name"] == "x" and back.count() == 4
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_bundle(df, folder, {})
    df.limit(1).write.mode("overwrite").parquet(f"{folder}/records")
    with pytest.raises(ValueError, match="match"):
        sinks.read_bundle(spark, folder)


def test_run_folder_and_export(spark, df, tmp_path):
    folder = str(tmp_path / "run")
    sinks.write_run(folder, {"records": df}, {"a": 1})
    sinks.register_run(spark, folder, ["records", "config"])
    assert spark.sql("SELECT count(*) AS n FROM records").first()["n"] == 4
    out = sinks.wide_export(df.withColumns({"p__passed": F.col("flag"), "selected": F.lit(True), "exclusion_reasons": F.lit(""), "s": F.lit("=1+1")}), ["p"], ["record_id", "s"])
    r = out.orderBy("record_id").collect()
    assert r[0]["s"] == "'=1+1" and [x["p_status"] for x in r] == ["PASS", "FAIL", "N/A", "PASS"]
    assert sinks.fingerprint({"a": 1, "b": 2}) == sinks.fingerprint({"b": 2, "a": 1})


def test_hand_off(df):
    assert [r["record_id"] for r in sinks.hand_off(df, [2, 1], "s").collect()] == [2, 1]
    with pytest.raises(ValueError):
        sinks.hand_off(df, [1, 4], "s")


def test_structures(spark):
    rows = spark.createDataFrame([(1, "CC(=O)Oc1ccccc1C(=O)O"), (2, None), (3, "C1CC"), (4, "C[C@H](N)C(=O)[O-].[Na+]")], "record_id long, smiles string")
    got = {r["record_id"]: r for r in structures.described(rows, "smiles").collect()}
    assert round(got[1]["mol_wt"], 2) == 180.16 and got[1]["rotatable_bonds"] == 3 and got[1]["tpsa"] is None
    assert got[2]["invalid_reason"] == "empty" and not got[3]["valid"]
    assert got[4]["fragment_count"] == 2 and got[4]["formal_charge"] == 0 and got[4]["specified_centres"] == 1
    flags = structures.preparability(structures.described(rows, "smiles"), "record_id", ["C", "N", "O", "H"], {"fragment_count": 1}).collect()
    assert sorted((r["record_id"], r["flag"]) for r in flags) == [(4, "MANY_FRAGMENT_COUNT"), (4, "UNCOMMON_ELEMENT")]


def test_stream_equals_batch(spark, sf, tmp_path):
    from winnower.streaming import events as E

    table = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = str(tmp_path / "events")
    table.repartition(3).write.parquet(folder)
    stream = E.windowed(E.read_events(spark, folder, late="400 days"), "1 day")
    q = stream.writeStream.outputMode("update").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["start"], r["event_type"]): r["n"] for r in spark.sql("SELECT start, event_type, max(n) AS n FROM windows GROUP BY 1, 2").collect()}
    want = {(r["start"], r["event_type"]): r["n"] for r in E.windowed(table, "1 day").collect()}
    assert got == want


def test_global_positions(spark):
    got = columns.spread_ranked(spark.range(500).withColumn("v", F.col("id") % 37), [F.desc("v"), F.asc("id")], "at").orderBy("at").collect()
    assert [r["at"] for r in got] == list(range(1, 501))
    assert [(r["v"], r["id"]) for r in got] == sorted(((r["v"], r["id"]) for r in got), key=lambda t: (-t[0], t[1]))
