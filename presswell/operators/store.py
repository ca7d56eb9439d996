"""Scans for work to be done, upserts and logs over Parquet tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from presswell.operators.current import newest_rows
from presswell.sources.commits import CommitLog


def unprocessed(raw: DataFrame, processed: DataFrame) -> DataFrame:
    """Raw rows without a processed row, or whose processed row FAILED."""
    settled = processed.where("processing_status is null or processing_status <> 'FAILED'").select(F.col("article_id").alias("id"))
    return raw.join(settled, "id", "left_anti")


def by_ids(raw: DataFrame, ids: list[int], key: str = "id") -> DataFrame:
    """The rows with these ids; the filter reaches the scan. NULL ids and those that are not there give no row."""
    return raw.where(F.col(key).isin([i for i in ids if i is not None]))


def insert_new(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` and those of ``rows`` whose key it lacks, once each: a repeated seed changes nothing."""
    return existing.unionByName(rows.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def needing(processed: DataFrame, child: DataFrame) -> DataFrame:
    """COMPLETED articles without a row in a table of enrichments."""
    return processed.where("processing_status = 'COMPLETED'").join(child.select("article_id"), "article_id", "left_anti")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of ``new`` in place of those with the same key; columns that ``new`` lacks become NULL.

    If ``new`` has a key more than once, the row with the greatest ``order`` counts.
    """
    fresh = newest_rows(new, keys, order) if order else new.dropDuplicates(keys)
    fresh = fresh.select(*(F.col(c) if c in fresh.columns else F.lit(None).cast(existing.schema[c].dataType).alias(c) for c in existing.columns))
    return existing.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


class VersionedTable:
    """A table with key columns that is changed atomically and survives a crash at any point.

    ::

        <path>/commits/<n>          manifest: base folder, change folders, last batch
        <path>/data/<n>-<attempt>/  parquet

    A change writes its rows into a folder of its own and then publishes a
    manifest that names it. Nothing that the last manifest names is ever
    deleted or overwritten, so a writer that dies leaves the table as it was.
    An upsert writes its own rows only; after ``compact_every`` of them the
    table is written as one base again.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: list[str], compact_every: int = 16, keep: int = 100):
        self.spark, self.keys, self.compact_every = spark, keys, compact_every
        self.schema = spark.createDataFrame([], schema).schema
        self.log = CommitLog(spark, path, keep)

    def _frame(self, folders: list[str]) -> DataFrame:
        paths = [self.log.files.path(f) for f in folders]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _read(self, manifest: dict) -> DataFrame:
        base, changes = self._frame(manifest.get("base", [])), manifest.get("changes", [])
        if not changes:
            return base
        # changes are few and small beside the base, which is neither sorted nor shuffled if their keys can be broadcast
        numbered = [self._frame([f]).withColumn("__at", F.lit(k)) for k, f in enumerate(changes)]
        latest = newest_rows(reduce(DataFrame.unionByName, numbered), self.keys, "__at").drop("__at")
        return base.join(latest.select(*self.keys), self.keys, "left_anti").unionByName(latest)

    def read(self) -> DataFrame:
        """The table as of the last commit; empty if there is none."""
        return self._read(self.log.latest()[1])

    def _write(self, df: DataFrame, number: int) -> str:
        folder = f"data/{number:012d}-{uuid.uuid4().hex[:8]}"
        columns = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema]
        df.select(*columns).write.mode("overwrite").option("compression", "zstd").parquet(self.log.files.path(folder))
        return folder

    def _commit(self, make, tries: int = 20) -> int:
        for _ in range(tries):
            number, manifest = self.log.latest()
            changed = make(number + 1, manifest)
            if changed is None:
                return number
            if self.log.publish(number + 1, changed):
                self.log.purge(lambda m: [*m["base"], *m["changes"]])
                return number + 1
        raise RuntimeError("the table is too busy")

    def replace(self, df: DataFrame) -> int:
        """Put ``df``, which may read the table, in place of all rows."""
        return self._commit(lambda number, old: {"base": [self._write(df, number)], "changes": [], "batch": old.get("batch", -1)})

    def upsert(self, rows: DataFrame, batch: int | None = None) -> int:
        """Rows in place of those with the same key; ``rows`` has each key once.

        ``batch`` is the number of a stream's micro-batch: one that was
        committed before is left out, so a batch run again changes nothing.
        """

        def make(number: int, old: dict) -> dict | None:
            if batch is not None and batch <= old.get("batch", -1):
                return None
            changes = [*old.get("changes", []), self._write(rows, number)]
            new = {"base": old.get("base", []), "changes": changes, "batch": old.get("batch", -1) if batch is None else batch}
            if len(changes) > self.compact_every:
                new = new | {"base": [self._write(self._read(new), number)], "changes": []}
            return new

        return self._commit(make)


def stage_log(rows: DataFrame) -> DataFrame:
    """One log row per stage an article went through.

    ``rows`` has article_id, reason, date_raw, date_parse_status and
    duplicate_status; a row with a reason stops after validation.
    """
    valid, dated = F.col("reason") == "", F.col("date_parse_status") == "OK"
    raw_date = F.concat(F.lit("raw='"), F.coalesce("date_raw", F.lit("")), F.lit("'"))

    def stage(step: int, name: str, fine, message):
        return F.struct(F.lit(step).alias("step"), F.lit(name).alias("stage"), F.when(fine, "SUCCESS").otherwise("FAILED").alias("status"), message.alias("message"))

    stages = F.array(
        stage(1, "VALIDATION", valid, F.col("reason")),
        stage(2, "DATE_NORMALIZATION", dated, F.when(dated, "").otherwise(raw_date)),
        stage(3, "CLEANING", F.lit(True), F.lit("")),
        stage(4, "DEDUPLICATION", F.lit(True), F.coalesce("duplicate_status", F.lit(""))),
    )
    kept = F.when(valid, stages).otherwise(F.slice(stages, 1, 1))
    return rows.select("article_id", F.explode(kept).alias("s")).select("article_id", "s.*")


def append_new_links(existing: DataFrame, scraped: DataFrame) -> DataFrame:
    """Scraped rows whose link is new; one row per link, the least id; 'N/A' and NULL links are left out."""
    known = existing.select("link").where("link is not null")
    first = scraped.where("link is not null and link <> 'N/A'").groupBy("link").agg(F.min("id").alias("id"))
    return scraped.join(first, ["link", "id"], "left_semi").dropDuplicates(["link"]).join(known, "link", "left_anti")
