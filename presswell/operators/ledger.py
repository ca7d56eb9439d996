"""A work-item ledger: each run gets only what is new, changed or unfinished.

State lives in a log of commits below one folder of the shared file system::

    <path>/commits/<n>             manifest: the change folders that make up the state
    <path>/changes/<n>-<attempt>/  parquet: the items a commit changed
    <path>/work/fence=<n>/         what the holder of lease n has written so far
    <path>/output/fence=<n>/       the same once the lease is completed

A commit is published under its number at once or not at all, so of two
writers racing for one number exactly one wins and the other starts over from
the new state; a writer that dies leaves nothing that is read. An item is
*pending*, *leased* or *done*; its state is that of its newest commit. A lease
carries the number of the commit that made it as fencing token: ``complete``
and ``write_output`` accept only items that still carry the token, so a writer
whose lease ran out and was given to another is refused. A retry under the
same token overwrites the same folder.

What counts as delivered is decided by item, not by folder: every item keeps
the version and the token with which it was last done, and ``outputs`` joins
each written row with them. So an item that was taken over, or changed while
it was leased, comes out once, from the lease that completed it.
"""

from __future__ import annotations

import uuid
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswell.operators.current import newest_values
from presswell.sources.commits import CommitLog

SCHEMA = T.StructType(
    [
        T.StructField("item_id", T.LongType()),
        T.StructField("version", T.LongType()),
        T.StructField("state", T.StringType()),
        T.StructField("fence", T.LongType()),
        T.StructField("lease_until", T.TimestampNTZType()),
        T.StructField("done_version", T.LongType()),
        T.StructField("done_fence", T.LongType()),
        T.StructField("commit", T.LongType()),
    ]
)


def utc_now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


class StaleLease(RuntimeError):
    """The lease's items now belong to a newer lease, or are done."""


class WorkLedger:
    """``compact_every`` change folders are merged into one; ``keep`` commits stay readable behind the last."""

    def __init__(self, spark: SparkSession, path: str, clock=utc_now, compact_every: int = 64, keep: int = 100):
        self.spark, self.path, self.clock, self.compact_every = spark, path.rstrip("/"), clock, compact_every
        self.log = CommitLog(spark, self.path, keep)
        self.files = self.log.files

    # -- the log ---------------------------------------------------------
    def _commit(self, make, tries: int = 20) -> int:
        """``make(state, number)`` gives the changed items; retried from the newest state."""
        for _ in range(tries):
            number, manifest = self.log.latest()
            number, folders = number + 1, manifest.get("folders", [])
            folder = f"changes/{number:012d}-{uuid.uuid4().hex[:8]}"
            state = self._state(folders)
            changed = make(state, number).withColumn("commit", F.lit(number).cast("long")).select(*SCHEMA.fieldNames())
            full = len(folders) >= self.compact_every
            if full:
                changed = state.join(changed.select("item_id"), "item_id", "left_anti").select(*SCHEMA.fieldNames()).unionByName(changed)
            changed.write.mode("overwrite").parquet(self.files.path(folder))
            if self.log.publish(number, {"folders": [folder] if full else [*folders, folder]}):
                if full:
                    self.log.purge(lambda m: m["folders"])
                return number
            self.files.delete(folder)
        raise RuntimeError("the ledger is too busy")

    def _state(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        log = self.spark.read.schema(SCHEMA).parquet(*(self.files.path(f) for f in folders))
        return newest_values(log, ["item_id"], "commit", [F.col(c) for c in SCHEMA.fieldNames() if c != "item_id"])

    def state(self) -> DataFrame:
        """One row per known item."""
        return self._state(self.log.latest()[1].get("folders", []))

    # -- operations ------------------------------------------------------
    def adopt(self, finished: DataFrame) -> int:
        """Take (item_id, version) over as done: what was processed before there was a ledger.

        Items that are leased or done in another version are left alone.
        """

        def make(state: DataFrame, _: int) -> DataFrame:
            rows = finished.where("item_id is not null").groupBy("item_id").agg(F.max("version").alias("version"))
            rows = rows.join(state.where("state <> 'pending'").select("item_id"), "item_id", "left_anti")
            return rows.select(
                "item_id", "version", F.lit("done").alias("state"), F.lit(0).cast("long").alias("fence"), F.lit(None).cast("timestamp_ntz").alias("lease_until"),
                F.col("version").alias("done_version"), F.lit(0).cast("long").alias("done_fence"),
            )

        return self._commit(make)

    def sync(self, source: DataFrame, finished: DataFrame | None = None) -> int:
        """Take up what ``source`` (item_id, version) has beyond ``finished`` and the ledger.

        ``finished`` (item_id, version) holds what downstream already has in
        its newest version. An item becomes pending if neither ``finished``
        nor the ledger itself has its version as done or leased. Items that
        are already pending in this version are left alone, so repeating a
        sync, also after a failure, changes nothing. Rows with a NULL item_id
        are dropped, repeated rows count once.
        """

        def make(state: DataFrame, _: int) -> DataFrame:
            wanted = source.where("item_id is not null").groupBy("item_id").agg(F.max("version").alias("version"))
            if finished is not None:
                wanted = wanted.join(finished.select("item_id", "version"), ["item_id", "version"], "left_anti")
            known = state.select("item_id", F.col("version").alias("known_version"), "done_version", "done_fence")
            new = wanted.join(known, "item_id", "left").where("known_version is null or known_version <> version")
            return new.select(
                "item_id", "version", F.lit("pending").alias("state"), F.lit(0).cast("long").alias("fence"),
                F.lit(None).cast("timestamp_ntz").alias("lease_until"), "done_version", "done_fence",
            )

        return self._commit(make)

    def _open(self, state: DataFrame) -> DataFrame:
        ran_out = (F.col("state") == "leased") & (F.col("lease_until") <= F.lit(self.clock()).cast("timestamp_ntz"))
        return state.where((F.col("state") == "pending") | ran_out)

    def pending(self) -> DataFrame:
        """Items (item_id, version) to be processed: pending, or leased until a time now past."""
        return self._open(self.state()).select("item_id", "version")

    def lease(self, seconds: int = 900, part: Column | None = None) -> int:
        """Lease the open items (those for which ``part`` holds) and return the fencing token."""
        until = F.lit(self.clock() + timedelta(seconds=seconds)).cast("timestamp_ntz")

        def make(state: DataFrame, number: int) -> DataFrame:
            chosen = self._open(state)
            chosen = chosen if part is None else chosen.where(part)
            return chosen.withColumns({"state": F.lit("leased"), "fence": F.lit(number).cast("long"), "lease_until": until})

        return self._commit(make)

    def _held(self, state: DataFrame, token: int) -> DataFrame:
        return state.where((F.col("state") == "leased") & (F.col("fence") == token))

    def leased(self, token: int) -> DataFrame:
        return self._held(self.state(), token).select("item_id", "version")

    def write_output(self, token: int, df: DataFrame) -> str:
        """Write a lease's result to the one place its token names, replacing an earlier attempt.

        ``df`` has item_id and version as ``leased`` gives them, and any other
        columns but ``fence``. Refused if the lease holds nothing any more.
        """
        missing = {"item_id", "version"} - set(df.columns)
        if missing or "fence" in df.columns:
            raise ValueError(f"a lease's result needs item_id and version and no column fence; missing: {sorted(missing)}")
        if self.leased(token).isEmpty():
            raise StaleLease(f"lease {token} holds no items")
        name = f"work/fence={token}"
        df.write.mode("overwrite").parquet(self.files.path(name))
        return self.files.path(name)

    def complete(self, token: int) -> int:
        """Mark the lease's items done; raises StaleLease if it holds none any more.

        The folder is put in its final place first: if the writer dies between
        the two steps, the items stay leased and nothing of it counts, and
        completing again goes on from there. Completing the same token twice
        is refused the second time without harm.
        """

        def make(state: DataFrame, _: int) -> DataFrame:
            mine = self._held(state, token)
            if mine.isEmpty():
                raise StaleLease(f"lease {token} holds no items")
            work, output = f"work/fence={token}", f"output/fence={token}"
            if self.files.exists(f"{work}/_SUCCESS"):
                self.files.delete(output)  # of an attempt to complete that got no further
                self.files.rename(work, output)
            return mine.withColumns({"state": F.lit("done"), "done_version": F.col("version"), "done_fence": F.col("fence")}).drop("commit")

        return self._commit(make)

    def release(self, token: int) -> int:
        """Give a lease's items back, as a worker does that fails in an orderly way."""

        def make(state: DataFrame, _: int) -> DataFrame:
            return self._held(state, token).withColumns({"state": F.lit("pending"), "fence": F.lit(0).cast("long"), "lease_until": F.lit(None).cast("timestamp_ntz")}).drop("commit")

        return self._commit(make)

    def _delivered(self, path: str, done: DataFrame) -> DataFrame:
        rows = self.spark.read.option("basePath", self.files.path("output")).parquet(path)
        done = done.select("item_id", F.col("done_version").alias("version"), F.col("done_fence").alias("fence"))
        return rows.withColumn("fence", F.col("fence").cast("long")).join(done, ["item_id", "version", "fence"], "left_semi").drop("fence")

    def outputs(self) -> DataFrame | None:
        """What finished leases wrote: of every item its last done version, from the lease that completed it; None if there is nothing."""
        if not self.files.list("output"):
            return None
        return self._delivered(self.files.path("output"), self.state().where("done_fence > 0"))

    def output_of(self, token: int) -> DataFrame | None:
        """What one completed lease delivered, without the items it had lost by then; reads that lease's folder only.

        Rows of items done again since are left out.
        """
        name = f"output/fence={token}"
        return self._delivered(self.files.path(name), self.state().where(F.col("done_fence") == token)) if self.files.exists(name) else None
