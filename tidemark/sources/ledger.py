"""Batches that may come again: a keyed store fed by whole batches, each once.

A batch's rows go to a folder named by its source, id and content, which a second writing only replaces; then one row
in the ledger makes them count. Readers see rows that the ledger names, so a failure between the two leaves nothing behind, and the
next try finishes the work. One writer at a time is assumed, as a stream's `foreachBatch` gives it.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import issues

LEDGER = "seq long, source string, batch string, digest string, entry string, mode string, rows_in long, accepted long, rejected long, repeated long, inserted long, updated long, unchanged long"


def digest(df: DataFrame) -> str:
    """A digest of a table's rows in any order, repeats counted: from their number and the sum and exclusive or of their hashes."""
    h = F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0000")) for c in sorted(df.columns)], *[F.col(f"`{c}`").isNull() for c in sorted(df.columns)])
    r = df.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x")).first()
    return hashlib.sha256(f"{sorted(df.columns)}|{r.n}|{r.s}|{r.x}".encode()).hexdigest()


@dataclass
class Store:
    """Records by key at a path. schema: keys and values as a DDL string. rules: conditions that a row must meet, by code."""

    spark: SparkSession
    path: str
    schema: str
    keys: list[str]
    rules: dict[str, Column] = field(default_factory=dict)

    @property
    def values(self) -> list[str]:
        return [f.name for f in T.StructType.fromDDL(self.schema).fields if f.name not in self.keys]

    def _read(self, name: str, schema: str) -> DataFrame:
        """A table of the store, empty before its first writing."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def ledger(self) -> DataFrame:
        return self._read("ledger", LEDGER)

    def current(self) -> DataFrame:
        """The records: of each value the last one written. A merged batch's nulls leave a value as it was; a replacing
        batch's nulls count."""
        rows = self._read("rows", f"{self.schema}, entry string").join(self.ledger().select("entry", "seq", "mode"), "entry")
        last = lambda c: F.max_by(F.when(self._counts(c), F.struct(c)), F.when(self._counts(c), F.col("seq")))[c].alias(c)
        return rows.groupBy(*self.keys).agg(*[last(c) for c in self.values])

    @staticmethod
    def _counts(c: str) -> Column:
        return F.col(c).isNotNull() | (F.col("mode") == "replace")

    def checked(self, df: DataFrame, order: list[str] = ()) -> DataFrame:
        """The rows of a batch with `issues`: codes of broken rules, of null keys, and of keys that the batch repeats (all
        but the first in the order)."""
        keyed = reduce(lambda a, k: a & F.col(k).isNotNull(), self.keys, F.lit(True))
        found = issues(df, {**self.rules, "key_missing": keyed})
        w = Window.partitionBy(*self.keys, F.size("issues") == 0).orderBy(*(order or [F.xxhash64(*[F.col(c).cast("string") for c in self.values])]))
        again = (F.size("issues") == 0) & (F.row_number().over(w) > 1)
        return found.withColumn("issues", F.when(again, F.array(F.lit("repeated_in_batch"))).otherwise(F.col("issues")))

    def ingest(self, df: DataFrame, source: str, batch: str, mode: str = "merge", validate_only: bool = False, order: list[str] = ()) -> dict:
        """Take a batch in once and account for it: rows_in, accepted, rejected, repeated, and of those accepted inserted, updated
        and unchanged keys.

        A batch that the ledger knows by source and id changes nothing and returns its first accounting with `replay`, and `changed`
        if it came with other content. validate_only: the accounting that it would have, with nothing written.
        """
        if mode not in ("merge", "replace"):
            raise ValueError(f"no such mode: {mode}")
        wanted = df.select(*self.keys, *self.values).persist()
        try:
            own = digest(wanted)
            before = self.ledger().where((F.col("source") == source) & (F.col("batch") == batch)).first()
            if before is not None:
                return {**before.asDict(), "replay": True, "changed": before.digest != own or before.mode != mode}
            rows = self.checked(wanted, order).persist()
            try:
                return self._take(rows, source, batch, mode, own, validate_only)
            finally:
                rows.unpersist()
        finally:
            wanted.unpersist()

    def _take(self, rows: DataFrame, source: str, batch: str, mode: str, own: str, validate_only: bool) -> dict:
        good = rows.where(F.size("issues") == 0).drop("issues")
        held = self.current().select(*self.keys, *[F.col(c).alias(f"__{c}") for c in self.values], F.lit(True).alias("__held"))
        same = reduce(lambda a, c: a & (F.col(c).eqNullSafe(F.col(f"__{c}")) | (F.col(c).isNull() & F.lit(mode == "merge"))), self.values, F.lit(True))
        n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
        seen = good.join(held, self.keys, "left").agg(n(F.lit(1)).alias("accepted"), n(F.col("__held").isNull()).alias("inserted"), n(F.col("__held").isNotNull() & ~same).alias("updated"), n(F.col("__held").isNotNull() & same).alias("unchanged")).first().asDict()
        told = rows.agg(F.count("*").alias("rows_in"), n((F.size("issues") > 0) & ~F.array_contains("issues", "repeated_in_batch")).alias("rejected"), n(F.array_contains("issues", "repeated_in_batch")).alias("repeated")).first().asDict()
        seq = (self.ledger().agg(F.max("seq")).first()[0] or 0) + 1
        entry = hashlib.sha256(f"{source}\0{batch}\0{mode}\0{own}".encode()).hexdigest()[:24]
        account = {"seq": seq, "source": source, "batch": batch, "digest": own, "entry": entry, "mode": mode, **told, **seen}
        if not validate_only:
            self._write(good, entry)
            self._commit(account)
        return {**account, "replay": False, "changed": False, "validate_only": validate_only}

    def _write(self, good: DataFrame, entry: str) -> None:
        good.write.mode("overwrite").parquet(f"{self.path}/rows/entry={entry}")

    def _commit(self, account: dict) -> None:
        names = [c.split()[0] for c in LEDGER.split(", ")]
        self.spark.createDataFrame([tuple(account[c] for c in names)], LEDGER).coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")

    def ingest_stream(self, stream: DataFrame, source: str, checkpoint: str, mode: str = "merge"):
        """Feed a stream's micro-batches, each under its number; one that is run again is a replay. Returns the writer."""
        return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, number: self.ingest(df, source, str(number), mode) and None)
