"""Readers and writers: delimited surveillance files, wide matrices, nested JSON, keyed upserts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import number_from_text

# How the publishers write a missing value.
MISSING = ("NA", "na", "N/A", "NaN", "nan", "-", "")


def read_delimited(spark: SparkSession, path: str, sep: str = "\t", encoding: str = "UTF-8", numbers: list[str] = (), days: dict[str, str] | None = None, flags: list[str] = (), missing: tuple[str, ...] = MISSING) -> DataFrame:
    """A delimited file with a header, every column text at first: missing marks become null, numbers are
    read with either decimal mark, days by their pattern, flags from ja/nein; what can't be read is null."""
    df = spark.read.csv(path, sep=sep, header=True, encoding=encoding, multiLine=encoding.upper().startswith("UTF-16"))
    out = {}
    for c in df.columns:
        text = F.trim(F.col(f"`{c}`"))
        text = F.when(~text.isin(*missing), text)
        if c in numbers:
            out[c] = number_from_text(text)
        elif days and c in days:
            out[c] = F.try_to_timestamp(text, F.lit(days[c])).cast("date")
        elif c in flags:
            out[c] = F.when(F.lower(text).isin("ja", "yes", "true", "1"), True).when(F.lower(text).isin("nein", "no", "false", "0"), False)
        else:
            out[c] = text
    return df.withColumns(out)


def read_matrix(spark: SparkSession, path: str, keys: list[str], name: str, value: str, sep: str = "\t", encoding: str = "UTF-16") -> DataFrame:
    """A wide matrix (key columns, then one column per item) as long rows; cells that aren't numbers go."""
    df = spark.read.csv(path, sep=sep, header=True, encoding=encoding, multiLine=True)
    long = df.unpivot([F.col(f"`{k}`").alias(k) for k in keys], [F.col(f"`{c}`") for c in df.columns if c not in keys], name, "__text")
    return long.withColumn(value, number_from_text(F.col("__text"))).drop("__text").where(F.col(value).isNotNull())


def read_folder(spark: SparkSession, pattern: str, sep: str = ";") -> DataFrame:
    """All files of a folder named YYYY_WW.csv, with the week from each file's name."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"(\d{4})_(\d{1,2})\.csv$", 0)
    df = spark.read.csv(pattern, sep=sep, header=True)
    return df.select("*", F.nullif(F.regexp_extract(name, r"^(\d{4})", 1), F.lit("")).cast("int").alias("file_year"), F.nullif(F.regexp_extract(name, r"_(\d{1,2})\.", 1), F.lit("")).cast("int").alias("file_week"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], earliest: list[str] = (), kept: list[str] = ()) -> DataFrame:
    """New rows over old ones by null-safe key. Null new values don't overwrite; `earliest` columns keep the
    lesser value, `kept` ones the old value where there is one. Of new rows of one key the last by all values
    counts. One shuffle by key carries both sides."""
    values = [c for c in old.columns if c not in keys]
    both = old.withColumn("__new", F.lit(0)).unionByName(new.select(*old.columns).withColumn("__new", F.lit(1)))
    w = Window.partitionBy(*keys, "__new").orderBy(*[F.col(c).desc_nulls_last() for c in values])
    one = both.withColumn("__n", F.row_number().over(w)).where("__n = 1")
    pick = lambda c, side: F.max(F.when(F.col("__new") == side, F.col(c)))
    out = []
    for c in values:
        a, b = pick(c, 0), pick(c, 1)
        out.append((F.least(a, b) if c in earliest else F.coalesce(a, b) if c in kept else F.coalesce(b, a)).alias(c))
    return one.groupBy(*keys).agg(*out).select(*old.columns)


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Overwrite only the partitions that the table has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_snapshot(df: DataFrame, path: str, as_of: Column) -> None:
    """Append rows under their issue date and a batch id; earlier snapshots are never touched."""
    df.withColumn("as_of", as_of).withColumn("batch", F.lit(uuid.uuid4().hex)).write.mode("append").partitionBy("as_of").parquet(path)


def issues(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Each row with the codes of the rules it breaks; an unknown outcome counts as broken."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in rules.items()]), lambda c: c.isNotNull())
    return df.withColumn("issues", broken)


def flag_repeats(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A flag on second and later rows of a key."""
    return df.withColumn("repeated", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1)


def read_cube(spark: SparkSession, path: str, row: str, schema: str) -> DataFrame:
    """Rows of an XML export, by row tag and schema."""
    return spark.read.format("xml").option("rowTag", row).schema(schema).load(path)


def nested_horizons(df: DataFrame, body: str, levels: tuple[str, str], into: str) -> DataFrame:
    """A two-level JSON map as long rows."""
    outer = df.select("*", F.explode(F.from_json(body, "map<string, map<string, string>>")).alias(levels[0], "__inner"))
    return outer.select("*", F.explode("__inner").alias(levels[1], into)).drop("__inner", body)


def wide_records(df: DataFrame, keys: list[str], name: str, value: str, order: list[str], names: list[str]) -> DataFrame:
    """Named observations as one record per key: a column for each name with its last value by the order."""
    last = [F.max_by(F.when(F.col(name) == n, F.col(value)), F.when(F.col(name) == n, F.struct(*order))).alias(n) for n in names]
    return df.groupBy(*keys).agg(*last)


def not_held(new: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """New rows whose keys a store doesn't have yet, null-safe."""
    mine = held.select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct()
    match = F.lit(True)
    for k in keys:
        match &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return new.join(mine, match, "left_anti")


def pick_columns(df: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """The columns of a table of unknown layout: for each name wanted, the first of its candidates that is there,
    in any case; null where none is."""
    there = {c.lower(): c for c in df.columns}
    found = {name: next((there[c.lower()] for c in candidates if c.lower() in there), None) for name, candidates in wanted.items()}
    return df.select(*(F.col(f"`{c}`").alias(name) if c else F.lit(None).alias(name) for name, c in found.items()))


def separator_of(spark: SparkSession, path: str, candidates: tuple[str, ...] = (";", ",", "\t", "|"), encoding: str = "UTF-8") -> str:
    """The separator that a file's header has most often; of equals the first candidate."""
    head = spark.read.option("encoding", encoding).text(path).first()
    return max(candidates, key=lambda s: head[0].count(s) if head else 0)
