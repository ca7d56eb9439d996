"""Problem 1: only new, changed or unfinished articles, through the ledger."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswell.operators.current import fingerprint, newest_values
from presswell.operators.ledger import StaleLease, WorkLedger, utc_now
from presswell.session import materialize, scratch_path
from presswell.sources.tables import read_table


def source_versions(scraped: DataFrame) -> DataFrame:
    """(item_id, version) of each article's current raw row; texts are hashed before any shuffle."""
    rows = scraped.select("id", "scraped_at", fingerprint("title", "content", "date").alias("version"))
    return newest_values(rows, ["id"], "scraped_at", [F.col("version")]).withColumnRenamed("id", "item_id")


def finished_versions(processed: DataFrame) -> DataFrame:
    """(item_id, version) of each article whose current processed row is COMPLETED."""
    version = fingerprint("title_original", "content_original", "date_raw")
    rows = processed.select("article_id", "processing_timestamp", "processing_status", version.alias("version"))
    newest = newest_values(rows, ["article_id"], "processing_timestamp", [F.col("processing_status"), F.col("version")])
    return newest.where("processing_status = 'COMPLETED'").select(F.col("article_id").alias("item_id"), "version")


def first_versions(scraped: DataFrame) -> DataFrame:
    """(item_id, version) of each article as it was scraped first."""
    rows = scraped.where("id is not null").select("id", "scraped_at", fingerprint("title", "content", "date").alias("version"))
    first = F.min(F.struct("scraped_at", "version")).alias("first")
    return rows.groupBy(F.col("id").alias("item_id")).agg(first).select("item_id", "first.version")


def opened(spark: SparkSession, folder: str, clock=utc_now) -> WorkLedger:
    """A fresh ledger that knows what was processed before it and has taken up everything the raw table has beyond."""
    ledger = WorkLedger(spark, scratch_path(spark, "ledger"), clock=clock)
    ledger.adopt(finished_versions(read_table(spark, folder, "processed_news")))
    ledger.sync(source_versions(read_table(spark, folder, "scraped_news")))
    return ledger


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """What a run has to process, after a run before it has leased all of it and died, and after a repeated sync."""
    now = [datetime(2026, 1, 1)]
    ledger = opened(spark, folder, clock=lambda: now[0])
    ledger.lease(seconds=60)
    now[0] = datetime(2026, 1, 1, 1)
    ledger.sync(source_versions(read_table(spark, folder, "scraped_news")))
    return ledger.pending().select(F.col("item_id").alias("article_id"))


def p1_delivered(spark: SparkSession, folder: str) -> DataFrame:
    """What several runs deliver in all, though one dies, one is late and one is repeated.

    Run A leases half of the items, writes and dies; its lease runs out. Run B
    gets everything, A's half included, writes its output twice and completes.
    A then wakes up, writes and tries to complete, and is refused. A second
    sync finds nothing more. Each article must come out once.
    """
    now = [datetime(2026, 1, 1)]
    ledger = opened(spark, folder, clock=lambda: now[0])
    dead = ledger.lease(seconds=60, part=F.col("item_id") % 2 == 0)
    late_output = ledger.leased(dead)
    ledger.write_output(dead, late_output)
    now[0] = datetime(2026, 1, 1, 1)
    token = ledger.lease(seconds=900)
    work = ledger.leased(token)
    ledger.write_output(token, work)
    ledger.write_output(token, work)
    ledger.complete(token)
    for late in (lambda: ledger.write_output(dead, late_output), lambda: ledger.complete(dead)):
        try:
            late()
            raise AssertionError("a stale writer was not refused")
        except StaleLease:
            pass
    done = ledger.outputs()
    if done is None:
        return spark.createDataFrame([], "article_id bigint, deliveries bigint")
    return done.groupBy(F.col("item_id").alias("article_id")).agg(F.count("*").alias("deliveries"))


def p1_runs(spark: SparkSession, folder: str) -> DataFrame:
    """(article_id, run, deliveries) of two increments: the articles as scraped first, then as they are now.

    In the first, worker A writes half of the items and dies; B leases all,
    is slow, and loses a third of them to C, which completes before B does;
    B then completes the rest. Each version of each article that is new to
    the run must be delivered once, by whichever worker completed it.
    """
    now = [datetime(2026, 1, 1)]
    later = lambda hours: now.__setitem__(0, datetime(2026, 1, 1, hours))
    scraped = read_table(spark, folder, "scraped_news")
    ledger = WorkLedger(spark, scratch_path(spark, "ledger"), clock=lambda: now[0])
    ledger.adopt(finished_versions(read_table(spark, folder, "processed_news")))
    ledger.sync(first_versions(scraped))
    a = ledger.lease(seconds=60, part=F.col("item_id") % 2 == 0)
    ledger.write_output(a, ledger.leased(a))
    later(1)
    b = ledger.lease(seconds=60)
    ledger.write_output(b, ledger.leased(b))
    later(2)
    c = ledger.lease(seconds=900, part=F.col("item_id") % 3 == 0)
    ledger.write_output(c, ledger.leased(c))
    ledger.complete(c)
    ledger.complete(b)
    first = materialize(ledger.output_of(b).unionByName(ledger.output_of(c)), "delivered").withColumn("run", F.lit(1))
    ledger.sync(source_versions(scraped))
    ledger.sync(source_versions(scraped))
    d = ledger.lease(seconds=900)
    ledger.write_output(d, ledger.leased(d))
    ledger.complete(d)
    rows = first.unionByName(ledger.output_of(d).withColumn("run", F.lit(2)))
    return rows.groupBy(F.col("item_id").alias("article_id"), "run", "version").agg(F.count("*").alias("deliveries")).drop("version")
