"""Problem 2: new batches against all history, by a prefix-tree hash forest.

Each text's shingle set gets ``trees`` signatures of ``DEPTH`` min-hashes,
each a permutation of its own. A signature is one 64-bit *node*: the tree in
the top byte, then the min-hashes of ``BITS`` bits, so a prefix of a node spans
a range of nodes. The forest persists, below one folder::

    <path>/commits/<n>          manifest: options, runs and their sizes, batches taken up
    <path>/data/<id>/           parquet, sorted by its first column, in files of bounded size
    <path>/data/<id>.json       least and greatest value and rows of each file

in three kinds of such runs: nodes (node, set_hash), classes (set_hash, text
and profile, a row per different shingle set) and members (set_hash, doc). A
batch becomes one run of each kind; then its nodes are widened to the prefix
at which a pair at the threshold is met with the target probability, and of
the forest only the files are opened whose span a widened range meets. The
same holds for the classes and members of what was found. So history is
neither hashed nor signed again, and what is read of it grows with the batch.
All entries need the same prefix: a shorter one for some would miss pairs at
the threshold, and a longer one is not enough because a close neighbour found
there says nothing about others.

Runs are merged in tiers: ``fanout`` runs of one tier make one of the next, so
every entry is written again once per tier. A run counts once the manifest
that names it is published; a writer that dies leaves the forest as it was.

Entries stand for classes of equal shingle sets, so copies cost nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswell.llm.neardup import BITMAP, _could_match, _verified, chunks, profile_columns
from presswell.llm.shingles import mix, shingle_batch
from presswell.operators.lookup import small
from presswell.session import materialize, scratch_path
from presswell.sources.commits import CommitLog

DEPTH, BITS = 4, 14
_U = np.uint64
_BITS = ", ".join(f"bits{k} long" for k in range(BITMAP))
SCHEMAS = {"nodes": "node long, set_hash long", "classes": f"set_hash long, text string, n int, {_BITS}", "members": "set_hash long, doc long"}


def recall(depth: int, trees: int, similarity: float) -> float:
    """The probability that two sets of this similarity agree on a prefix in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def signature_nodes(offsets: np.ndarray, tokens: np.ndarray, trees: int) -> np.ndarray:
    """An array (trees, sets) of nodes; all sets must be non-empty."""
    out = np.empty((trees, len(offsets) - 1), dtype=np.uint64)
    seeds = mix(np.arange(1, 2 * trees * DEPTH + 1, dtype=np.uint64))
    turned = tokens >> _U(29)
    for t in range(trees):
        node = np.full(len(offsets) - 1, t, dtype=np.uint64)
        for j in range(DEPTH):
            a, b = seeds[2 * (t * DEPTH + j)] | _U(1), seeds[2 * (t * DEPTH + j) + 1]
            least = np.minimum.reduceat((tokens * a + b) ^ turned, offsets[:-1])
            node = (node << _U(BITS)) | (mix(least) >> _U(64 - BITS))
        out[t] = node
    return out


class Taken(NamedTuple):
    """What adding a batch gives: candidate pairs of classes (a, b), and the batch's own (set_hash, doc)."""

    found: DataFrame | None
    members: DataFrame


class HashForest:
    """The forest at ``path``: opened if there is one, with the options it was made with, else made with these.

    ``file_rows``: about how many rows a file of a run holds.
    """

    def __init__(self, spark: SparkSession, path: str, trees: int = 40, threshold: float = 0.8, width: int = 5, target: float = 0.9999, fanout: int = 4, file_rows: int = 500_000):
        if not 0 < trees < 128:
            raise ValueError("a forest has 1 to 127 trees")
        self.spark, self.log = spark, CommitLog(spark, path)
        self.files = self.log.files
        options = {"trees": trees, "threshold": threshold, "width": width, "target": target, "fanout": fanout, "file_rows": file_rows}
        self.options = self.log.latest()[1].get("options", options)
        depth = DEPTH
        while depth > 1 and recall(depth, self.options["trees"], self.options["threshold"]) < self.options["target"]:
            depth -= 1
        self.shift = BITS * (DEPTH - depth)
        self.rows_opened = 0

    # -- sorted runs -----------------------------------------------------
    def _write(self, rows: DataFrame, kind: str, size: int) -> list:
        """[folder, rows] of a run of ``size`` rows: sorted over all files, hot values split over several by the second column."""
        name = f"data/{kind}-{uuid.uuid4().hex}"
        per_file = self.options["file_rows"] // (20 if kind == "classes" else 1)
        by = SCHEMAS[kind].split()[0], "set_hash" if kind == "nodes" else "doc" if kind == "members" else "n"
        parts = max(1, -(-size // per_file))
        spread = rows.repartition(1) if parts == 1 else rows.repartitionByRange(parts, *by)
        spread.sortWithinPartitions(*by).write.option("compression", "zstd").parquet(self.files.path(name))
        held = self.spark.read.schema(SCHEMAS[kind]).parquet(self.files.path(name)).groupBy(F.col("_metadata.file_name").alias("f"))
        spans = held.agg(F.min(by[0]).alias("lo"), F.max(by[0]).alias("hi"), F.count("*").alias("n")).collect()  # a row per file
        self.files.publish(f"{name}.json", json.dumps([[r.f, r.lo, r.hi, r.n] for r in spans]))
        return [name, sum(r.n for r in spans)]

    def _met(self, runs: list, kind: str, ranges: DataFrame) -> DataFrame:
        """Rows of the files whose span some range (lo, hi) meets; ranges don't overlap each other."""
        spans = [(f"{name}/{f}", lo, hi, n) for name, _ in runs for f, lo, hi, n in json.loads(self.files.read(f"{name}.json"))]
        first, last = (np.array([s[k] for s in spans], dtype=np.int64) for k in (1, 2))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            hit = np.zeros(len(first), dtype=bool)
            for frame in frames:
                frame = frame.sort_values("lo")
                lo, hi = frame["lo"].to_numpy(), frame["hi"].to_numpy()
                at = np.searchsorted(hi, first)
                inside = at < len(hi)
                hit[inside] |= lo[at[inside]] <= last[inside]
            yield pd.DataFrame({"file": np.flatnonzero(hit)})

        found = sorted(r.file for r in ranges.mapInPandas(run, "file int").distinct().collect()) if spans else []  # at most the files there are
        self.rows_opened += sum(spans[k][3] for k in found) if kind == "nodes" else 0
        paths = [self.files.path(spans[k][0]) for k in found]
        return self.spark.read.schema(SCHEMAS[kind]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[kind])

    def _of(self, kind: str, hashes: DataFrame) -> DataFrame:
        """Rows of classes or members whose set_hash is among the different ones of ``hashes``."""
        met = self._met(self.log.latest()[1].get(kind, []), kind, hashes.select(F.col("set_hash").alias("lo"), F.col("set_hash").alias("hi")))
        return met.join(_small(hashes), "set_hash", "left_semi")

    def classes(self, hashes: DataFrame) -> DataFrame:
        """(set_hash, text, n, bits0..) of these classes, once each."""
        return self._of("classes", hashes).dropDuplicates(["set_hash"])

    def members(self, hashes: DataFrame) -> DataFrame:
        """(set_hash, doc) of all texts of these classes."""
        return self._of("members", hashes).distinct()

    # -- batches ---------------------------------------------------------
    def _profiled(self, docs: DataFrame) -> DataFrame:
        """One pass over the texts: rows of all three kinds, classes and nodes once per 4 MB of text."""
        width, trees = self.options["width"], self.options["trees"]

        def rows(kind: str, size: int, **columns) -> pd.DataFrame:
            return pd.DataFrame({c: columns.get(c, np.full(size, None, dtype=object)) for c in names} | {"kind": np.full(size, kind, dtype=object)})

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in chunks(frames, "text"):
                offsets, tokens = shingle_batch(frame["text"], width)
                full = np.diff(offsets) > 0
                if not full.any():
                    continue
                profile = {c: v[full] for c, v in profile_columns(offsets, tokens).items()}
                hashes = profile["set_hash"]
                yield rows("members", len(hashes), set_hash=hashes, doc=frame["doc"].to_numpy()[full])
                _, first = np.unique(hashes, return_index=True)
                text = frame["text"].to_numpy(dtype=object)[full]
                yield rows("classes", len(first), text=text[first], **{c: v[first] for c, v in profile.items()})
                nodes = signature_nodes(np.append(offsets[:-1][full], offsets[-1]), tokens, trees)[:, first]
                yield rows("nodes", nodes.size, node=nodes.ravel().view(np.int64), set_hash=np.tile(hashes[first], trees))

        schema = f"node long, set_hash long, doc long, text string, n int, {_BITS}, kind string"
        names = [c.split()[0] for c in schema.split(", ")]
        return docs.where("doc is not null").select("doc", "text").mapInPandas(run, schema)

    def add(self, docs: DataFrame, batch: int | None = None, find: bool = True) -> Taken:
        """Take up ``docs`` (doc, text); with ``find``, look them up in all that was there before and in each other.

        Repeated rows count once; texts of fewer than ``width`` words, empty
        ones and NULL have no class; rows with a NULL doc are dropped. A
        numbered batch that was taken up before is looked up, but not written
        again. Batches are added by one writer at a time.
        """
        number, manifest = self.log.latest()
        repeated = batch is not None and batch in manifest.get("batches", [])
        raw = f"scratch/{uuid.uuid4().hex}"
        rows = self._profiled(docs)
        rows.write.option("compression", "zstd").partitionBy("kind").parquet(self.files.path(raw))
        kept = self.spark.read.schema(rows.schema).parquet(self.files.path(raw))
        of_kind = lambda kind: kept.where(F.col("kind") == kind).select(*(c.split()[0] for c in SCHEMAS[kind].split(", ")))
        sizes = {r.kind: r["count"] for r in kept.groupBy("kind").count().collect()}
        nodes, members = of_kind("nodes"), of_kind("members").distinct()
        if not repeated and sizes:
            with ThreadPoolExecutor(len(SCHEMAS)) as pool:
                own = dict(zip(SCHEMAS, pool.map(lambda kind: self._write(of_kind(kind), kind, sizes.get(kind, 0)), SCHEMAS), strict=True))
            changed = {kind: [*manifest.get(kind, []), own[kind]] for kind in SCHEMAS}
            batches = [*manifest.get("batches", []), *([batch] if batch is not None else [])]
            if not self.log.publish(number + 1, {"options": self.options, "batches": batches, **changed}):
                raise RuntimeError("another writer has changed the forest meanwhile")
            read = lambda kind: self.spark.read.schema(SCHEMAS[kind]).parquet(self.files.path(own[kind][0]))
            nodes, members = read("nodes"), read("members").distinct()
            self.files.delete(raw)
        found = self._lookup(nodes, sizes.get("nodes", 0)) if find else None
        if not repeated and sizes:
            self._merge()
        return Taken(found, members)

    def _lookup(self, asked: DataFrame, size: int) -> DataFrame:
        """(a, b), a < b: range search of ``size`` nodes in all runs."""
        prefix = F.shiftrightunsigned("node", self.shift)
        asked = asked.select(prefix.alias("prefix"), F.col("set_hash").alias("b"))
        lo = F.shiftleft("prefix", self.shift)
        held = self._met(self.log.latest()[1].get("nodes", []), "nodes", asked.select(lo.alias("lo"), (lo + F.lit((1 << self.shift) - 1)).alias("hi")))
        held = held.select(prefix.alias("prefix"), F.col("set_hash").alias("a"))
        met = held.join(F.broadcast(asked) if size <= MOST_BROADCAST else asked, "prefix").where("a <> b")
        return materialize(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "found")

    def _merge(self) -> None:
        """Merge the runs of a tier once there are ``fanout`` of them; repeated entries go.

        Replaced runs stay until the last manifest that names them is purged.
        """
        number, manifest = self.log.latest()
        fanout, changed = self.options["fanout"], {}
        for kind in SCHEMAS:
            tiers: dict[int, list] = {}
            for run in manifest[kind]:
                tiers.setdefault(int(np.log(max(1, run[1])) / np.log(fanout)), []).append(run)
            for _, runs in sorted(tiers.items()):
                if len(runs) >= fanout:
                    rows = self.spark.read.schema(SCHEMAS[kind]).parquet(*(self.files.path(name) for name, _ in runs))
                    rows = rows.dropDuplicates(["set_hash"]) if kind == "classes" else rows.distinct()
                    merged = self._write(rows, kind, sum(n for _, n in runs))
                    changed[kind] = [merged, *(r for r in manifest[kind] if r not in runs)]
                    break
        if changed and self.log.publish(number + 1, manifest | changed):
            self.log.purge(lambda m: [x for kind in SCHEMAS for name, _ in m[kind] for x in (name, f"{name}.json")])


#: A batch of at most so many nodes (about 16 bytes each) is broadcast to the runs it is looked up in; a larger one is joined by shuffle.
MOST_BROADCAST = 2_000_000


def _small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if a count proves that it has few narrow rows."""
    return F.broadcast(df) if small(df) else df


def similar_classes(forest: HashForest, candidates: DataFrame) -> DataFrame:
    """(a, b) of the candidate classes that are similar enough: size and bitmap tests without loss, then whole texts."""
    threshold, width = forest.options["threshold"], forest.options["width"]
    ids = materialize(candidates.select(F.explode(F.array("a", "b")).alias("set_hash")).distinct(), "ids")
    asked = materialize(forest.classes(ids).withColumnRenamed("set_hash", "doc"), "classes")
    marks = asked.drop("text")
    near = candidates.join(marks.alias("x"), F.col("a") == F.col("x.doc")).join(marks.alias("y"), F.col("b") == F.col("y.doc"))
    near = near.where((F.least("x.n", "y.n") >= threshold * F.greatest("x.n", "y.n") - 1e-9) & _could_match(threshold)).select("a", "b")
    return materialize(_verified(near, asked, width, threshold), "similar")


def _linked(history: DataFrame, batches: DataFrame, threshold: float, width: int, path: str | None, options: dict) -> tuple[HashForest, DataFrame, DataFrame] | None:
    """(forest, (b, id_b) of the incoming articles, (a, b) of similar classes); None without batches."""
    spark = batches.sparkSession
    forest = HashForest(spark, path or scratch_path(spark, "forest"), threshold=threshold, width=width, **options)
    forest.add(history.select("doc", "text"), find=False)
    incoming = batches.where("doc is not null").select(F.coalesce("batch_no", F.lit(-1)).alias("batch_no"), "doc", "text").distinct()
    incoming = materialize(incoming, "incoming")
    taken = [forest.add(incoming.where(F.col("batch_no") == r[0]).select("doc", "text")) for r in incoming.select("batch_no").distinct().orderBy("batch_no").collect()]
    if not taken:
        return None
    found = reduce(DataFrame.unionByName, (t.found for t in taken)).distinct()
    good = similar_classes(forest, materialize(found, "candidates"))
    new = reduce(DataFrame.unionByName, (t.members for t in taken)).distinct()
    return forest, materialize(new.select(F.col("set_hash").alias("b"), F.col("doc").alias("id_b")), "new"), good


def batch_duplicates(history: DataFrame, batches: DataFrame, threshold: float = 0.8, width: int = 5, path: str | None = None, **options) -> DataFrame:
    """(id_a, id_b) with id_a < id_b: incoming articles and near-duplicates that came earlier.

    ``history`` has doc and text; ``batches`` has batch_no, doc and text.
    Other columns are ignored. Batches are taken in order: each is added to
    the forest at ``path`` (by default a fresh one) and looked up in all that
    came before it and in itself. What a forest at ``path`` holds already is
    history too; ``history`` may then be empty. An article sent twice counts
    once per different text. Rows with a NULL doc are dropped, a NULL batch_no
    is a first batch of its own; texts of fewer than ``width`` words, empty
    ones and NULL have no pair. An empty history or no batches give no pairs
    for them.
    """
    linked = _linked(history, batches, threshold, width, path, options)
    if linked is None:
        return batches.sparkSession.createDataFrame([], "id_a long, id_b long")
    forest, new, good = linked
    links = good.unionByName(good.select(F.col("b").alias("a"), F.col("a").alias("b")))
    same = new.select(F.col("b").alias("a"), "b").distinct()
    links = materialize(links.join(_small(new.select("b").distinct()), "b", "left_semi").unionByName(same), "links")
    known = forest.members(links.select(F.col("a").alias("set_hash")).distinct()).select(F.col("set_hash").alias("a"), F.col("doc").alias("id_a"))
    return new.join(links, "b").join(known, "a").where("id_a < id_b").select("id_a", "id_b").distinct()


def batch_links(history: DataFrame, batches: DataFrame, threshold: float = 0.8, width: int = 5, path: str | None = None, **options) -> DataFrame:
    """(doc, class_id, links): a row per incoming article and different text instead of all its pairs.

    ``class_id`` is the same for texts of equal shingle sets, ``links`` the
    number of other classes, earlier or incoming, that are similar enough.
    Inputs as for ``batch_duplicates``.
    """
    linked = _linked(history, batches, threshold, width, path, options)
    if linked is None:
        return batches.sparkSession.createDataFrame([], "doc long, class_id long, links long")
    _, new, good = linked
    sides = good.select(F.explode(F.array("a", "b")).alias("b")).groupBy("b").agg(F.count("*").alias("links"))
    return new.join(sides, "b", "left").select(F.col("id_b").alias("doc"), F.col("b").alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))
