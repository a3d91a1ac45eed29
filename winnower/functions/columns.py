"""Column functions shared by the operators: missing values, ranks, bits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec


def number(value: Column | str) -> Column:
    """A double, NULL where it can't be read as one and where it is NaN."""
    text = F.col(value) if isinstance(value, str) else value
    cast = text.try_cast("double")
    return F.when(~F.isnan(cast), cast)


def without_nan(df: DataFrame) -> DataFrame:
    """NaN to NULL in every floating column: Spark orders NaN above all numbers, the rules treat it as missing."""
    floating = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floating}) if floating else df


def closed(predicate: Column) -> Column:
    """NULL counts as false."""
    return F.coalesce(predicate, F.lit(False))


def count_true(flags: list[Column]) -> Column:
    """How many of the conditions hold, NULL counting as no."""
    return reduce(lambda a, b: a + b, [closed(f).cast("int") for f in flags], F.lit(0))


def all_of(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, flags, F.lit(True))


def any_of(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags, F.lit(False))


def clip(value: Column, low: float, high: float) -> Column:
    """NULL stays NULL."""
    return F.when(value.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value)))


def sigmoid(z: Column) -> Column:
    """Stable for large arguments of either sign."""
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def shortest_rank(value: str, by: list[str] | None = None, descending: bool = True) -> Column:
    """1-based rank, ties share the best, missing values have none."""
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    return F.when(F.col(value).isNotNull(), F.rank().over(Window.partitionBy(*(by or [])).orderBy(order)))


def percent_rank(value: str, by: list[str] | None = None) -> Column:
    """Average rank of ties over the number of values, in (0, 1]; missing values have none."""
    part = Window.partitionBy(*(by or []))
    below = F.rank().over(part.orderBy(F.col(value).asc_nulls_last()))
    ties = F.count(value).over(Window.partitionBy(*(by or []), value))
    return F.when(F.col(value).isNotNull(), (below + (ties - 1) / 2) / F.count(value).over(part))


def settled(df: DataFrame) -> DataFrame:
    """The same rows over one set of tasks: every plan made of the result reads the same partitions.

    Range bounds come from a sample that differs from plan to plan, and Spark doesn't always share the shuffle of two branches
    that look alike; a partition's number means the same rows in both only if they read one and the same shuffle.
    """
    rows = df._jdf.queryExecution().toRdd()
    return DataFrame(df.sparkSession._jsparkSession.internalCreateDataFrame(rows, df._jdf.schema(), False), df.sparkSession)


def spread_ranked(df: DataFrame, order: list[Column], name: str, sums: dict[str, str] | None = None) -> DataFrame:
    """Add the 1-based position of each row in a total order without one task sorting all rows; ``sums`` maps columns to the names of
    their running sums, the row's own value included.

    Rows are range-partitioned by the order, once, when this is called; positions and sums are those within a partition plus those
    of the partitions before, a table with one row per partition.
    """
    sums = sums or {}
    ranged = settled(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    own: WindowSpec = Window.partitionBy("_part").orderBy(*order)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    ranged = ranged.withColumns({"_at": F.row_number().over(own), **{f"_s_{out}": F.sum(c).over(upto) for c, out in sums.items()}})
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"), *(F.sum(c).alias(f"_n_{out}") for c, out in sums.items()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    sizes = sizes.select("_part", ahead("_n").alias("_before"), *(ahead(f"_n_{out}").alias(f"_b_{out}") for out in sums.values()))
    out_ = ranged.join(F.broadcast(sizes), "_part").withColumns({name: F.col("_at") + F.col("_before"), **{out: F.col(f"_s_{out}") + F.col(f"_b_{out}") for out in sums.values()}})
    return out_.drop("_part", "_at", "_before", *(f"_s_{out}" for out in sums.values()), *(f"_b_{out}" for out in sums.values()))


def value_places(df: DataFrame, value: str, descending: bool = False) -> DataFrame:
    """``value, before, ties, known``: per distinct value the number of rows before it, equal to it and in all; NULL has none.

    Rows are counted per value first, so only distinct values are sorted, and those in many tasks.
    """
    cells = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("ties"))
    order = F.col(value).desc() if descending else F.col(value).asc()
    cells = spread_ranked(cells, [order], "_p", {"ties": "_run"})
    total = cells.agg(F.sum("ties").alias("known"))
    return cells.crossJoin(F.broadcast(total)).select(value, (F.col("_run") - F.col("ties")).alias("before"), "ties", "known")


def with_rank(df: DataFrame, value: str, name: str, descending: bool = True) -> DataFrame:
    """``df`` with the 1-based rank over all rows: ties share the best, missing values have none."""
    places = value_places(df, value, descending).select(F.col(value).alias("_v"), (F.col("before") + 1).cast("int").alias(name))
    return df.join(places, F.col(value) == F.col("_v"), "left").drop("_v")


def with_percentile(df: DataFrame, value: str, name: str) -> DataFrame:
    """``df`` with the average rank of ties over the number of values, in (0, 1]; missing values have none."""
    share = (F.col("before") + 1 + (F.col("ties") - 1) / 2) / F.col("known")
    places = value_places(df, value).select(F.col(value).alias("_v"), share.alias(name))
    return df.join(places, F.col(value) == F.col("_v"), "left").drop("_v")


def sign_words(embedding: str = "embedding", bits: int = 64) -> Column:
    """Signs of a vector as 32-bit words in an array of longs: bit i of word w is x[32 w + i] > 0."""

    def word(first: int) -> Column:
        part = F.slice(F.col(embedding), first + 1, 32)
        flags = F.transform(part, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(flags, F.lit(0).cast("long"), lambda a, b: a + b)

    return F.array(*(word(k) for k in range(0, bits, 32)))


def bits_set(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda a, w: a + F.bit_count(w))


def tanimoto(a: Column, b: Column, words: int = 2) -> Column:
    """Shared bits over bits in either; 0 for two empty fingerprints.  Unrolled, so it stays inside generated code."""
    shared = reduce(lambda x, y: x + y, [F.bit_count(a[i].bitwiseAND(b[i])) for i in range(words)])
    either = reduce(lambda x, y: x + y, [F.bit_count(a[i].bitwiseOR(b[i])) for i in range(words)])
    return F.when(either > 0, shared / either).otherwise(F.lit(0.0))
