"""Errors, files and kernels of the operators whose queries are checked against SQL elsewhere."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from winnower.operators import evidence, joining, preparing, reports, rules, selection, trials
from winnower.operators.evidence import Action
from winnower.sources import hexcodec, sinks, stages, tables, workbooks


def test_joins_refuse_repeated_and_missing_keys(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k long, x string")
    for rows in ([(1, 1.0), (1, 2.0)], [(None, 1.0)]):
        with pytest.raises(ValueError, match="not unique"):
            joining.one_to_one(left, spark.createDataFrame(rows, "k long, y double"), "k")
    with pytest.raises(ValueError, match="both sides"):
        joining.score_join(left, left, left, "k")
    with pytest.raises(ValueError, match="twice"):
        joining.library_mapping(["a", "b", "a"])
    assert joining.library_mapping(["a", "b"]) == {"a": 0, "b": 1}


def test_actions_need_support():
    full = dict(learned=True, molecules=20, positives=5, negatives=15, scaffolds=5, documents=3, source="s")
    assert Action("r", "exclude", **full).supported
    for key, value in (("molecules", 19), ("positives", 4), ("scaffolds", 4), ("documents", 2), ("source", " ")):
        assert not Action("r", "exclude", **(full | {key: value})).supported
    with pytest.raises(ValueError):
        Action("r", "delete")


def test_scaling_rejects_empty_features_and_keeps_constants(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None)], "a double, b double")
    with pytest.raises(ValueError, match="without a value"):
        preparing.fit_scaling(df, ["a", "b"])
    fitted = preparing.fit_scaling(df.withColumn("c", F.lit(2.0)), ["a", "c"])
    assert fitted.scale == {"a": 1.0, "c": 1.0} and fitted.mean == {"a": 2.0, "c": 2.0}


def test_platt_against_brute_force(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * z - 0.5)))).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(z, y)], "z double, y int")
    a, b = preparing.platt(df, "z", "y")
    loss = lambda p, q: np.logaddexp(0, -(2 * y - 1) * (p * z + q)).sum()
    assert all(loss(a, b) <= loss(a + d, b + e) + 1e-9 for d in (-0.01, 0, 0.01) for e in (-0.01, 0, 0.01))
    assert preparing.platt(df.where("y = 1"), "z", "y") == (1.0, 0.0)


def test_metrics_refuse_to_shrink_the_baseline(spark):
    df = spark.createDataFrame([(1, True, False, 1, "g")], "i long, b boolean, a boolean, y int, g string")
    with pytest.raises(ValueError):
        trials.filter_metrics(df, "b", "a", "y", "g")
    assert trials.equal_capacity(df.withColumns({"s": F.lit(1.0), "ok": F.lit(True)}), "b", ("s", "ok"), ("s", "ok"), "y", "i", 0.5).count() == 0


def by_hand(rows, n, most, least, pins, out):
    """Row by row: pins, one of each uncovered group, then in order."""
    rows = [r for r in rows if r["record_id"] not in out]
    order = sorted(rows, key=lambda r: (r["pareto_rank"] is None, r["pareto_rank"] or 0, -(r["qed"] or 0) if r["qed"] is not None else 9, r["record_id"]))
    used, chosen = {}, []

    def take(r):
        chosen.append(r["record_id"])
        if r["murcko_scaffold"] is not None:
            used[r["murcko_scaffold"]] = used.get(r["murcko_scaffold"], 0) + 1

    for r in sorted(rows, key=lambda r: r["record_id"]):
        if r["record_id"] in pins:
            take(r)
    for cover in (True, False):
        for r in order:
            g = r["murcko_scaffold"]
            if r["record_id"] in chosen or len(chosen) >= n:
                continue
            if cover and (len(used) >= least or g is None or g in used):
                continue
            if g is not None and used.get(g, 0) >= most:
                continue
            take(r)
    return chosen


def test_constrained_selection_by_hand(spark):
    rng = np.random.default_rng(7)
    for trial in range(6):
        rows = [{"record_id": i, "pareto_rank": int(rng.integers(1, 4)), "qed": [None, 0.25, 0.5, 0.75][rng.integers(4)], "murcko_scaffold": [None, "", "a", "b", "c", "d"][rng.integers(6)]} for i in range(60)]
        pins, out = set(map(int, rng.integers(0, 60, 4))), set(map(int, rng.integers(0, 60, 4)))
        df = spark.createDataFrame([tuple(r.values()) for r in rows], "record_id long, pareto_rank int, qed double, murcko_scaffold string")
        ids = lambda s: spark.createDataFrame([(i,) for i in s], "record_id long")
        got = selection.constrained_selection(df, 12 + trial, "manual_assisted", most=2, least_groups=trial, pinned=ids(pins), excluded=ids(out))
        chosen = [r["record_id"] for r in got.where("selected").orderBy("position").collect()]
        assert chosen == by_hand(rows, 12 + trial, 2, trial, pins - out, out)


def test_selection_input_is_checked(spark):
    df = spark.createDataFrame([(1, True, None, 0.5, 7), (2, True, True, 0.4, 7)], "record_id long, eligible boolean, valid boolean, priority_score double, identity long")
    with pytest.raises(ValueError, match="valid"):
        selection.select_priority(df, 1, group="identity")
    with pytest.raises(ValueError, match="identity"):
        selection.select_priority(df.withColumn("valid", F.lit(True)), 1, group="identity")
    with pytest.raises(ValueError, match="qed_only"):
        selection.constrained_selection(df.withColumns({"qed": F.lit(2.0), "murcko_scaffold": F.lit("a")}), 1, "qed_only")


def test_null_groups_have_no_quota(spark):
    rows = [(i, None, None) for i in range(40)] + [(100 + i, "x", "y") for i in range(9)]
    df = spark.createDataFrame([(i, a, b, float(-i)) for i, a, b in rows], "record_id long, a string, b string, s double")
    got = selection.select_crossed_quotas(df, 30, "a", "b", 3, 12, [F.desc("s")])
    assert got.count() == 30


def test_dispatch_prefers_zones_then_strategies(spark):
    df = spark.createDataFrame([(i, float(i), "a") for i in range(9)], "record_id long, similarity double, murcko_scaffold string")
    assert [r["record_id"] for r in selection.dispatch(df, {"n": 3}).orderBy("position").collect()] == [0, 1, 2]
    assert [r["record_id"] for r in selection.dispatch(df, {"novelty": {"column": "similarity", "n": 2}, "n": 5}).orderBy("position").collect()] == [0, 1]
    assert selection.dispatch(df, {"strategy": {"n": 4, "strategy": "pareto_first", "most": 2}}).count() == 2


def test_hex_round_trip_is_strict(spark):
    df = spark.createDataFrame([("00000001ffffffff",), ("xyz",), ("00000001",), (None,)], "h string")
    got = [r[0] for r in df.select(hexcodec.decode(F.col("h"), 2)).collect()]
    assert got == [[1, 0xFFFFFFFF], None, None, None]


def test_workbook_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "=cmd", 2.5, True, None), (2, "a & <b>", None, False, "x")], "i long, t string, d double, b boolean, n string")
    path = str(tmp_path / "book.xlsx")
    workbooks.write_workbook(spark, path, workbooks.report_sheets({"First": df, "Second": df.select("i", F.array("t").alias("l"))}))
    assert workbooks.sheet_names(spark, path) == ["First", "Second"] and workbooks.sheet_names(spark, "x.csv") == []
    rows = workbooks.read_sheet(spark, path).collect()
    assert [tuple(r) for r in rows] == [("1", "'=cmd", "2.5", "TRUE", None), ("2", "a & <b>", None, "FALSE", "x")]
    assert workbooks.read_sheet(spark, path, "Second").first()["l"] == '["=cmd"]'
    assert tables.read_table(spark, path).count() == 2
    with pytest.raises(Exception):
        workbooks.write_workbook(spark, path, {"First": df})


def test_stage_runs_once_per_signature(spark, tmp_path):
    runs = []

    def work(df):
        runs.append(1)
        return df.withColumn("y", F.col("x") * 2)

    df = spark.createDataFrame([(1,), (2,)], "x long")
    for config in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert stages.stage(df, config, str(tmp_path / "s"), "double", work).agg(F.sum("y")).first()[0] == 6
    stages.stage(df.union(df), {"a": 1}, str(tmp_path / "s"), "double", work)
    assert len(runs) == 3
    assert stages.resume(df, df.where("x = 1"), "x").count() == 1
    with pytest.raises(FileExistsError):
        stages.publish(df, str(tmp_path / "s"))


def test_cache_keeps_the_first_and_checks_hits(spark, tmp_path):
    folder = str(tmp_path / "cache")
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    assert stages.cache_fetch(spark, folder, keys, "k")[1].count() == 3
    stages.cache_store(spark, folder, spark.createDataFrame([("a", 1), ("a", 2), ("b", -1)], "k string, v int"), "k")
    stages.cache_store(spark, folder, spark.createDataFrame([("a", 9)], "k string, v int"), "k")
    hits, rest = stages.cache_fetch(spark, folder, keys, "k", "v > 0")
    assert [tuple(r) for r in hits.collect()] == [("a", 1)] and sorted(r[0] for r in rest.collect()) == ["b", "c"]


def test_poison_rows_are_found(spark):
    def work(frame: pd.DataFrame) -> pd.DataFrame:
        if (frame["x"] == 13).any():
            raise ValueError("thirteen")
        return frame.assign(y=frame["x"] * 2)

    df = spark.range(50).select(F.col("id").alias("record_id"), F.col("id").alias("x"))
    good, bad = stages.isolated(df, work, "record_id long, y long", "record_id")
    assert good.count() == 49 and good.agg(F.sum("y")).first()[0] == 2 * (sum(range(50)) - 13)
    assert [tuple(r) for r in bad.collect()] == [(13, "ValueError: thirteen")]


def test_chunks_adapt():
    assert stages.next_chunk(100, 0.1) == 150 and stages.next_chunk(100, 6) == 50 and stages.next_chunk(100, 1) == 100
    assert stages.next_chunk(30, 9) == 25 and stages.next_chunk(1900, 0.1) == 2000 and stages.next_chunk(100, 0.1, crashed=True) == 50


def test_artefacts_and_sessions(spark, tmp_path):
    path = str(tmp_path / "recipe")
    stages.save_artefact(spark, path, "recipe", {"n": 3})
    assert stages.load_artefact(spark, path, "recipe") == {"n": 3}
    for options in ({"kind": "preset"}, {"kind": "recipe", "versions": ("9",)}, {"kind": "recipe", "most_bytes": 3}):
        with pytest.raises(ValueError):
            stages.load_artefact(spark, path, **options)
    df = spark.createDataFrame([(1, float("nan")), (2, None), (3, float("inf"))], "i long, x double")
    study = {"study": {"n": 2}, "digest": sinks.table_digest(df.where("i <= 2"))}
    assert stages.replayed(study, lambda s: df.where(F.col("i") <= s["n"])).count() == 2
    with pytest.raises(ValueError, match="no longer"):
        stages.replayed(study, lambda s: df)
    folder = str(tmp_path / "session")
    stages.save_session(folder, {"t": df}, {"seed": 1})
    found, settings = stages.restore_session(spark, folder)
    assert settings == {"seed": 1} and sinks.table_digest(found["t"]) == sinks.table_digest(df)
    df.limit(1).write.mode("overwrite").parquet(f"{folder}/t")
    with pytest.raises(ValueError, match="changed"):
        stages.restore_session(spark, folder)


def test_measurement_scan_and_engine(spark):
    df = spark.createDataFrame([("T", "IC50", None, "high"), ("T", "IC50", True, "high"), ("T", "Ki", False, "high"), ("T", "IC50", False, "low")], "target_id string, endpoint string, mixed_endpoint boolean, quality string")
    assert stages.scan_measurements(df, "T", "IC50").count() == 1
    for options in ({"target": "X", "endpoint": "IC50"}, {"target": "T", "endpoint": "IC50", "most": 1, "qualities": ("high", "low")}):
        with pytest.raises(ValueError):
            stages.scan_measurements(df, **options)
    fine = {"id": "v", "name": "V", "version": "1", "common_elements": ["C", "N"], "flags": [{"id": "MACRO", "severity": "warn", "threshold": 12}]}
    assert stages.engine_profile(fine)["thresholds"] == {"MACRO": 12}
    with pytest.raises(ValueError, match="version"):
        stages.engine_profile({k: v for k, v in fine.items() if k != "version"})


def test_roles_guess_and_built_in_codes():
    assert tables.guess_mapping(["CID", "Smile"]) == ("Smile", "CID") and tables.guess_mapping(["x", "y"]) == ("x", None)
    muegge = rules.BUILT_IN["muegge"]
    assert len(muegge.rules) == 11 and {"MUE_MW_LOW", "MUE_MW_HIGH", "MUE_LOGP_LOW"} <= {r.code for r in muegge.rules}
    assert len(rules.BUILT_IN["cns_like"].rules) == 7 and len(rules.BUILT_IN["beyond_ro5"].rules) == 7 and len(rules.BUILT_IN["lead_like"].rules) == 4


def test_reports_on_outcomes(spark):
    rows = [(1, True, 1, "pinned", 0.5), (2, False, None, "group quota", 0.25), (3, True, 2, "strategy order", 0.75)]
    out = spark.createDataFrame(rows, "record_id long, selected boolean, position long, reason string, score double")
    why = {r["record_id"]: r["why"] for r in reports.explanations(out).collect()}
    assert why == {1: "taken at place 1: pinned", 2: "left out: group quota", 3: "taken at place 2: strategy order"}
    assert [r["record_id"] for r in reports.sort_panel(out, "best_score").collect()] == [3, 1, 2]
    assert [r["record_id"] for r in reports.sort_panel(out, "closest").collect()] == [r[0] for r in rows]
    m = reports.manifest(out, 3, {"n": 3})
    assert m["count"] == 2 and m["shortfall"] == 1 and m["digest"] == reports.manifest(out.repartition(3), 3, {"n": 3})["digest"]
    assert m["digest"] != reports.manifest(out.withColumn("position", 3 - F.col("position")), 3, {"n": 3})["digest"]
    fronts = spark.createDataFrame([(1, 1, 0.5, 0.1, 1.0), (2, 1, 0.9, 0.9, 0.0), (3, 2, 9.0, 0.0, 1.0), (4, 1, 0.5, 0.1, 2.0)], "record_id long, pareto_rank int, crowding double, ideal_distance double, d0 double")
    assert [r["record_id"] for r in fronts.orderBy(*reports.front_order(fronts, {"d0": 1.0})).collect()] == [2, 4, 1, 3]
    final, reserve = reports.selected_and_reserve(out.withColumn("selection_status", F.when(F.col("selected"), "final").otherwise("reserve")))
    assert final.count() == 2 and reserve.count() == 1
    joined = reports.session_export(out, spark.createDataFrame([(1, 9.0, "C")], "record_id long, score double, smiles string"))
    assert joined.columns.count("score") == 1 and joined.where("smiles = 'C'").count() == 1


def test_sealed_decisions_are_replayed(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i)) for i in range(9)], "record_id long, s double")
    run = lambda d, settings: d.orderBy(F.desc("s")).limit(settings["n"])
    folder = str(tmp_path / "sealed")
    stages.seal(folder, df, {"n": 3}, run)
    assert stages.verify(spark, folder, run).count() == 3
    with pytest.raises(ValueError, match="reproduced"):
        stages.verify(spark, folder, lambda d, s: d.orderBy("s").limit(3))
    df.limit(2).write.mode("overwrite").parquet(f"{folder}/decision")
    with pytest.raises(ValueError, match="changed"):
        stages.verify(spark, folder, run)


def test_thresholds_hold_for_their_scope_only():
    from winnower.operators.tolerance import calibration_fits

    fitted = {"criteria": ["a", "b"], "contexts": [{"t": 1}, {"t": 2}]}
    assert calibration_fits(fitted, {"criteria": ["b", "a"], "contexts": [{"t": 2}, {"t": 1}]})
    assert not calibration_fits(fitted, {"criteria": ["a"], "contexts": fitted["contexts"]})
    assert not calibration_fits(fitted, {"criteria": ["a", "b"], "contexts": [{"t": 1}]})


def test_splits_need_dates(spark):
    df = spark.createDataFrame([(1, "a", None)], "i long, g string, d date")
    with pytest.raises(ValueError, match="date"):
        trials.assign_splits(df, "g", date="d")
