"""Event-sourced selection state: an append-only log with undo, replayed into baskets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What an action does to a record's selection.
EFFECTS = {"select": "selected", "reserve": "reserve", "exclude": "excluded", "reset": "undecided"}


def effective(events: DataFrame, session: str, seq: str, action: str) -> DataFrame:
    """Events that are in force: neither undone nor an undo or redo themselves.

    ``undo`` takes back the latest event in force, ``redo`` brings the latest undone one back, and any other event drops
    what could be redone.  Within a session this is a stack, so one ordered pass of a bounded log per session decides it.
    """
    import pandas as pd

    kind = events.schema[seq].dataType.simpleString()

    def replay(key: tuple, log: pd.DataFrame) -> pd.DataFrame:
        done: list = []
        undone: list = []
        for s, a in zip(log[seq], log[action]):
            if a == "undo":
                if done:
                    undone.append(done.pop())
            elif a == "redo":
                if undone:
                    done.append(undone.pop())
            else:
                done.append(s)
                undone.clear()
        return pd.DataFrame({seq: done}, dtype=log[seq].dtype).assign(**{session: key[0]})[[session, seq]]

    own = events.select(session, seq, action)
    ordered = own.groupBy(session).applyInPandas(lambda k, log: replay(k, log.sort_values(seq)), f"{session} {events.schema[session].dataType.simpleString()}, {seq} {kind}")
    return events.join(ordered, [session, seq], "left_semi")


def basket(events: DataFrame, record_id: str, seq: str, action: str, upto: int | None = None) -> DataFrame:
    """State of each record: the last selecting event and the last pin win: ``status, pinned, changes``."""
    rows = events if upto is None else events.where(F.col(seq) <= upto)
    status: Column = F.lit(None).cast("string")
    for a, s in EFFECTS.items():
        status = F.when(F.col(action) == a, s).otherwise(status)
    pin = F.when(F.col(action) == "pin", True).when(F.col(action) == "unpin", False)
    rows = rows.select(record_id, F.col(seq).alias("_q"), status.alias("_s"), pin.alias("_p"))
    out = rows.groupBy(record_id).agg(
        F.max(F.when(F.col("_s").isNotNull(), F.struct("_q", "_s"))).alias("s"), F.max(F.when(F.col("_p").isNotNull(), F.struct("_q", "_p"))).alias("p"), F.count("*").alias("changes"))
    return out.select(record_id, F.coalesce("s._s", F.lit("undecided")).alias("status"), F.coalesce("p._p", F.lit(False)).alias("pinned"), "changes")


def counters(state: DataFrame) -> DataFrame:
    """``records, selected, reserve, excluded, undecided, pinned``."""
    return state.agg(F.count("*").alias("records"), *(F.count_if(F.col("status") == s).alias(s) for s in ("selected", "reserve", "excluded", "undecided")), F.count_if("pinned").alias("pinned"))


def replaced(state: DataFrame, proposal: DataFrame, record_id: str) -> DataFrame:
    """An automatic selection replaces the basket, but pinned records stay as they are."""
    new = proposal.select(record_id).distinct().withColumn("_in", F.lit(True))
    out = state.join(new, record_id, "full_outer")
    status = F.when(F.coalesce("pinned", F.lit(False)), F.col("status")).when(F.col("_in"), "selected").otherwise("undecided")
    return out.select(record_id, status.alias("status"), F.coalesce("pinned", F.lit(False)).alias("pinned"))


def unjustified(state: DataFrame, verdicts: DataFrame, notes: DataFrame, record_id: str, passed: str) -> DataFrame:
    """Selected records that failed their rules and carry no note."""
    failed = verdicts.where(~F.col(passed)).select(record_id)
    return state.where("status = 'selected'").select(record_id).join(failed, record_id, "left_semi").join(notes.select(record_id), record_id, "left_anti")


def content_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """``rows, content, content2, content3``: sums of three 32-bit parts of the rows' MD5, whatever their order; equal tables have equal sums."""
    # DuckDB and Spark agree on MD5 of text, so the hash can be checked outside Spark
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns))
    part = lambda k: F.sum(F.conv(F.substring(F.md5(text), 8 * k + 1, 8), 16, 10).cast("long"))
    return df.agg(F.count("*").alias("rows"), part(0).alias("content"), part(1).alias("content2"), part(2).alias("content3"))


def last_seen(events: DataFrame, key: str, ts: str) -> DataFrame:
    """Gap to the event before of the same key, in seconds."""
    order = Window.partitionBy(key).orderBy(ts, "event_id")
    return events.withColumn("gap", (F.col(ts).cast("timestamp").cast("double") - F.lag(ts).over(order).cast("timestamp").cast("double")))
