"""Readers: delimited and structure files, several sources with provenance, libraries, evidence."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Column names taken for structures and ids, in order of preference, in lower case.
STRUCTURE_NAMES = ("smiles", "smile", "canonical_smiles", "isomeric_smiles", "structure", "smi", "molecule")
ID_NAMES = ("id", "molecule_id", "compound_id", "cid", "name", "title", "catalog_id", "chembl_id", "zinc_id")
_DELIMITERS = (",", ";", "\t", "|")


@dataclass(frozen=True)
class Source:
    """A file and which of its columns hold the structure and the id."""

    path: str
    structure: str | None = None
    ident: str | None = None


def delimiter(header: str) -> str:
    """The most frequent of comma, semicolon, tab and bar in a header line; comma if there is none."""
    best = max(_DELIMITERS, key=header.count)
    return best if header.count(best) else ","


def _suffix(path: str) -> str:
    name = path.lower().rstrip("/")
    for packed in (".gz", ".bz2", ".zst"):
        name = name.removesuffix(packed)
    return name.rsplit(".", 1)[-1]


def read_table(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """Any delimited, structure, workbook, Parquet, ORC or JSON-lines file; delimited values stay text, blanks stay blank."""
    kind = _suffix(path)
    if kind in ("csv", "tsv", "txt"):
        first = spark.read.text(path).head()
        sep = "\t" if kind == "tsv" else delimiter(first[0] if first else "")
        df = spark.read.csv(path, header=True, sep=sep, inferSchema=False, nullValue="\0", emptyValue="", multiLine=False)
    elif kind in ("smi", "smiles"):
        df = read_structures(spark, path)
    elif kind == "parquet":
        df = spark.read.parquet(path)
    elif kind == "orc":
        df = spark.read.orc(path)
    elif kind in ("xlsx", "xlsm"):
        from winnower.sources.workbooks import read_sheet

        df = read_sheet(spark, path)
    elif kind in ("jsonl", "ndjson"):
        df = spark.read.json(path)
    else:
        raise ValueError(f"can't read {path}: unknown kind {kind!r}")
    return df.limit(rows) if rows else df


def read_structures(spark: SparkSession, path: str) -> DataFrame:
    """Lines of ``SMILES [ID] ...`` without a header; blank lines and ``#`` comments are left out."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' and not startswith(line, '#')")
    parts = F.split("line", r"\s+")
    return lines.select(parts[0].alias("SMILES"), F.get(parts, 1).alias("ID"))


def guess_mapping(columns: Sequence[str]) -> tuple[str | None, str | None]:
    """(structure column, id column) by well-known names in any case; without one, the first column holds the structure."""
    by_name = {c.strip().lower(): c for c in reversed(list(columns))}
    pick = lambda names: next((by_name[n] for n in names if n in by_name), None)
    structure = pick(STRUCTURE_NAMES) or next(iter(columns), None)
    ident = pick(ID_NAMES)
    return structure, ident if ident != structure else None


def preview_columns(spark: SparkSession, path: str) -> list[str]:
    return read_table(spark, path, 20).columns


def load_records(spark: SparkSession, sources: Sequence[Source], first: int | None = None) -> DataFrame:
    """All sources as one table: ``record_id`` 1.. by source and row, ids made up where missing, provenance kept.

    Rows get their place from the reader's order within each file; the numbering then is one offset per task, so no task
    sorts a whole source.
    """
    parts = []
    for k, s in enumerate(sources):
        df = read_table(spark, s.path)
        structure, ident = s.structure, s.ident
        if structure is None:
            structure, guessed = guess_mapping(df.columns)
            ident = ident or guessed
        if structure is None:
            raise ValueError(f"{s.path}: no structure column among {df.columns}")
        parts.append(df.select(F.lit(k).alias("_source"), F.monotonically_increasing_id().alias("_row"), F.col(f"`{structure}`").cast("string").alias("original_smiles"),
                               (F.col(f"`{ident}`") if ident else F.lit(None)).cast("string").alias("_id"), F.lit(s.path).alias("source_file")))
    rows = numbered(reduce(DataFrame.unionByName, parts), ["_source", "_row"], "record_id")
    first_of = Window.partitionBy("_source")
    rows = rows.withColumn("source_row", F.col("record_id") - F.min("record_id").over(first_of) + 2)
    made_up = F.format_string("REC%07d", "record_id")
    out = rows.select("record_id", F.coalesce(F.nullif(F.trim("_id"), F.lit("")), made_up).alias("molecule_id"), "original_smiles", "source_file", "source_row")
    if first is None:
        return out
    capped = out.where(F.col("record_id") <= first)
    if capped.isEmpty():
        raise ValueError("no records to read")
    return capped


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add 1.. in the given order: positions within range partitions plus the sizes of those before."""
    from winnower.functions.columns import spread_ranked

    return spread_ranked(df, [F.col(c) for c in order], name).withColumn(name, F.col(name).cast("long"))


def canonical_text(value: Column) -> Column:
    """White space collapsed, lower case; blank text has none."""
    return F.nullif(F.lower(F.regexp_replace(F.trim(value), r"\s+", " ")), F.lit(""))


def libraries(parts: dict[str, tuple[DataFrame, str]], key: str, ident: str | None = None) -> DataFrame:
    """{library id: (table, role)} as one table ``library_id, role, reference_id, canonical, valid, invalid_reason``."""
    out = []
    for name, (df, role) in parts.items():
        if role not in ("candidate", "reference", "background"):
            raise ValueError(f"{name}: unknown role {role!r}")
        canonical = canonical_text(F.col(key))
        made_up = F.concat(F.lit(f"{name}_"), F.lpad((F.monotonically_increasing_id() + 1).cast("string"), 7, "0"))
        ref = F.coalesce(F.col(ident).cast("string"), made_up) if ident else made_up
        out.append(df.select(F.lit(name).alias("library_id"), F.lit(role).alias("role"), ref.alias("reference_id"), canonical.alias("canonical"),
                             canonical.isNotNull().alias("valid"), F.when(canonical.isNull(), "empty").alias("invalid_reason")))
    return reduce(DataFrame.unionByName, out)


def classify_evidence(df: DataFrame, flags: dict[str, str], relation: str, value: str, identity: str, identity_pattern: str) -> DataFrame:
    """Add ``endpoint`` and ``evidence``: kept, mixed (several endpoints), censored, or other.

    ``flags`` maps one-hot columns (lists split by ``;``) to endpoint names.
    """
    on = {c: F.array_contains(F.split(F.coalesce(F.col(c), F.lit("")), ";"), "1") for c in flags}
    endpoints = F.filter(F.array(*(F.when(on[c], F.lit(name)) for c, name in flags.items())), lambda x: x.isNotNull())
    number = F.col(value).try_cast("double")
    relations = F.array_distinct(F.split(F.col(relation), ";"))
    fine = F.col(identity).rlike(f"^(?:{identity_pattern})$") & number.isNotNull() & ~F.isnan(number)
    kind = F.when(F.size(endpoints) > 1, "mixed").when(~F.coalesce(relations == F.array(F.lit("=")), F.lit(False)), "censored").when(F.coalesce(fine & (F.size(endpoints) == 1), F.lit(False)), "kept")
    return df.withColumns({"endpoint": F.get(endpoints, 0), "evidence": kind.otherwise("other")})


def import_evidence(df: DataFrame, folder: str, target: str, target_id: str, qualities: tuple[str, ...], quality: str) -> dict[str, int]:
    """Write the kept rows of one target as a table and return the counts; refuses to overwrite."""
    wanted = df.where((F.col(target) == target_id) & F.col(quality).isin(list(qualities)))
    wanted.where("evidence = 'kept'").write.mode("errorifexists").parquet(folder)
    counts = wanted.groupBy("evidence").agg(F.count("*").alias("n")).collect()
    return {r["evidence"]: r["n"] for r in counts}


def cached(df: DataFrame, cache: DataFrame, text: str, signature: str, wanted: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with their cached descriptors, rows still to compute): a hit has the signature and every wanted descriptor."""
    key = F.sha2(F.concat_ws("\x1f", F.col(text), F.lit(signature)), 256)
    full = reduce(lambda a, b: a & b, [F.map_contains_key("descriptors", F.lit(w)) for w in wanted], F.lit(True))
    hits = cache.where(full).select(F.col("cache_key"), "descriptors")
    keyed = df.withColumn("cache_key", key)
    return keyed.join(hits, "cache_key").drop("cache_key"), keyed.join(hits.select("cache_key"), "cache_key", "left_anti").drop("cache_key")


RECORD_SCHEMA = T.StructType([
    T.StructField("record_id", T.LongType()), T.StructField("molecule_id", T.StringType()), T.StructField("original_smiles", T.StringType()),
    T.StructField("source_file", T.StringType()), T.StructField("source_row", T.LongType()),
])
