"""Problem 8: evaluation passages in the corpus, by a positional inverted index.

The index is kept in segments of about 4 MB of text, as a search engine keeps
them: building it shuffles nothing. A segment's words are numbered through all
its texts; for each term the index stores those numbers, ascending, as packed
differences. A phrase is found by taking the lists of its rarest terms, moving
each back by the term's place in the phrase, and intersecting.

Tables below the index's folder:
  postings (segment, term, n, wide, at)   one row per segment and term, sorted by term
  texts    (segment, number, doc, start, words)
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswell.llm.neardup import chunks
from presswell.llm.shingles import hash_words, words_of
from presswell.session import materialize, scratch_path

#: So many of each window's rarest terms are intersected.
ANCHORS = 6


def pack(at: np.ndarray, first: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """(packed lists, whether each takes 4 bytes a place instead of 2) of the ascending lists that begin at ``first`` of ``at``."""
    gaps = np.diff(at, prepend=0)
    gaps[first] = at[first]
    wide = np.maximum.reduceat(gaps, first) > 65535 if len(first) else np.empty(0, bool)
    small, large = gaps.astype(np.uint16).tobytes(), gaps.astype(np.uint32).tobytes()
    ends = [*first[1:], len(at)]
    return [large[4 * a : 4 * b] if w else small[2 * a : 2 * b] for a, b, w in zip(first, ends, wide, strict=True)], wide


def unpack(packed: bytes, wide: bool) -> np.ndarray:
    return np.cumsum(np.frombuffer(packed, np.uint32 if wide else np.uint16), dtype=np.int64)


class PositionalIndex:
    """A positional inverted index below one folder of the shared file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def add(self, docs: DataFrame) -> None:
        """Append the texts of ``docs`` (doc, text) as new segments.

        A text without words has no postings; rows with a NULL doc are dropped.
        """
        schema = "segment long, term long, n int, wide boolean, at binary, doc long, start long, words int"

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in chunks(frames, "text"):
                lists = [words_of(t) for t in frame["text"]]
                counts = np.array([len(x) for x in lists], dtype=np.int64)
                segment = uuid.uuid4().int & (2**63 - 1)
                starts = np.cumsum(counts) - counts
                yield pd.DataFrame({"segment": segment, "term": None, "n": None, "wide": None, "at": None, "doc": frame["doc"].to_numpy(), "start": starts, "words": counts.astype(np.int32)})
                flat = [w for x in lists for w in x]
                if not flat:
                    continue
                h = hash_words(flat).view(np.int64)
                order = np.argsort(h, kind="stable")
                terms, first, n = np.unique(h[order], return_index=True, return_counts=True)
                packed, wide = pack(order, first)
                yield pd.DataFrame({"segment": segment, "term": terms, "n": n.astype(np.int32), "wide": wide, "at": packed, "doc": None, "start": None, "words": None})

        # one pass writes both kinds of rows, in folders of their own
        rows = docs.where("doc is not null").select("doc", "text").mapInPandas(run, schema)
        rows = rows.withColumn("kind", F.when(F.col("term").isNull(), "texts").otherwise("postings"))
        rows.write.mode("append").option("compression", "zstd").partitionBy("kind").parquet(self.path)

    def _read(self, kind: str, columns: str) -> DataFrame:
        table = self.spark.read.schema(f"{columns}, kind string").parquet(self.path)
        return table.where(F.col("kind") == kind).drop("kind")

    def postings(self) -> DataFrame:
        return self._read("postings", "segment long, term long, n int, wide boolean, at binary")

    def texts(self) -> DataFrame:
        return self._read("texts", "segment long, doc long, start long, words int")

    def frequencies(self, terms: np.ndarray) -> dict[int, int]:
        """How often each of these terms occurs in the whole corpus; packed lists aren't read."""
        asked = self.spark.createDataFrame(pd.DataFrame({"term": terms}), "term long")
        counted = self.postings().select("term", "n").join(F.broadcast(asked), "term").groupBy("term").agg(F.sum("n").alias("n"))
        return {r.term: r.n for r in counted.collect()}

    def phrases(self, wanted: dict[tuple, list[tuple]], spread: int = 0) -> DataFrame:
        """(segment, phrase, at): places where all anchors of a phrase stand at their distances.

        ``wanted`` maps ((term, offset), ..), offsets counted from the first
        anchor, to any value; ``phrase`` is the place of the key in its order.
        With ``spread`` an anchor may stand so many words off its place.
        Only the lists of the anchors' terms are read and grouped, a segment
        at a time, so a task holds parts of 4 MB of text at once.
        """
        patterns = list(wanted)
        most = max(map(len, patterns))
        # arrays, 10 bytes an anchor; patterns of fewer anchors repeat their first one
        at = np.array([[t for t, _ in p] + [p[0][0]] * (most - len(p)) for p in patterns], dtype=np.int64)
        off = np.array([[o for _, o in p] + [p[0][1]] * (most - len(p)) for p in patterns], dtype=np.int16)
        terms, which_term = np.unique(at, return_inverse=True)
        asked = self.spark.createDataFrame(pd.DataFrame({"term": terms}), "term long")
        shared = self.spark.sparkContext.broadcast((terms, which_term.reshape(at.shape).astype(np.int32), off))

        def near(found: np.ndarray, places: np.ndarray) -> np.ndarray:
            i = np.searchsorted(places, found - spread)
            ok = i < len(places)
            ok[ok] = places[i[ok]] <= found[ok] + spread
            return found[ok]

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            terms, at, off = shared.value
            lists: dict[int, np.ndarray] = {}
            size = np.zeros(len(terms), dtype=np.int64)
            for k, p, w in zip(np.searchsorted(terms, frame["term"].to_numpy()).tolist(), frame["at"], frame["wide"], strict=True):
                lists[k] = unpack(p, w)
                size[k] = len(lists[k])
            which, places = [], []
            here = size[at]
            for k in np.flatnonzero(here.min(1) > 0).tolist():  # all anchors are in this segment: from the rarest list on
                order = np.argsort(here[k], kind="stable")
                found = lists[int(at[k, order[0]])] - int(off[k, order[0]])
                for a in order[1:].tolist():
                    o = int(off[k, a])
                    found = near(found + o, lists[int(at[k, a])]) - o
                    if not len(found):
                        break
                if len(found):
                    which.append(np.full(len(found), k))
                    places.append(found)
            total = sum(map(len, which))
            return pd.DataFrame({"segment": np.full(total, frame["segment"].iloc[0]), "phrase": np.concatenate(which) if which else [], "at": np.concatenate(places) if places else []})

        lists = self.postings().join(F.broadcast(asked), "term")
        return lists.groupBy("segment").applyInPandas(run, "segment long, phrase int, at long")


def item_blocks(items: DataFrame, words: int = 200_000) -> Iterator[list[tuple[int, list[str]]]]:
    """The query set in blocks of about so many words, each one pass over the index with some 12 MB of anchors: (item, its words)."""
    block: list[tuple[int, list[str]]] = []
    size = 0
    for row in items.where("item is not null").select("item", "passage").distinct().toLocalIterator():
        found = words_of(row.passage)
        if found:
            block.append((row.item, found))
            size += len(found)
        if size > words:
            yield block
            block, size = [], 0
    if block:
        yield block


def _run_length(text: list[str], passage: list[str]) -> int:
    """The longest run of successive words that both hold, by way of their diagonals."""
    places: dict[str, list[int]] = {}
    for i, w in enumerate(text):
        places.setdefault(w, []).append(i)
    best = 0
    before: dict[int, int] = {}
    for j, w in enumerate(passage):
        now = {i: before.get(i - 1, 0) + 1 for i in places.get(w, ())}
        best = max(best, max(now.values(), default=0))
        before = now
    return best


def leaks(docs: DataFrame, items: DataFrame, run: int = 12, spread: int = 0, index: PositionalIndex | None = None) -> DataFrame:
    """(doc, item, longest, needed): documents that may hold a passage, and their longest common run.

    ``docs`` has doc and text, ``items`` has item and passage; other columns
    are ignored. A document comes out if some window of ``run`` words of the
    passage (all its words, if they are fewer) has its ``ANCHORS`` rarest
    terms in place, give or take ``spread`` words; ``longest`` is the exact
    number of successive words in common, ``needed`` how many make a leak. So
    with spread 0 the rows with longest >= needed are all leaks there are.
    Repeated documents and items each count; NULL ids and texts without words
    give no rows.
    """
    spark = docs.sparkSession
    if index is None:
        index = PositionalIndex(spark, scratch_path(spark, "positions"))
        index.add(docs)
    results = []
    for block in item_blocks(items):
        hashed = [(item, words, hash_words(words).view(np.int64)) for item, words in block]
        count = index.frequencies(np.unique(np.concatenate([h for *_, h in hashed])))
        wanted: dict[tuple, list[tuple]] = {}
        for number, (_, words, h) in enumerate(hashed):
            size = min(run, len(words))
            n = np.array([count.get(int(t), 0) for t in h])
            for at in range(len(words) - size + 1):
                part = n[at : at + size]
                if not part.all():
                    continue  # a term that the corpus doesn't have
                rarest = np.sort(np.argsort(part, kind="stable")[:ANCHORS]) + at
                key = tuple((int(h[i]), int(i - rarest[0])) for i in rarest)
                wanted.setdefault(key, []).append(number)
        if not wanted:
            continue
        owners = [(k, number) for k, numbers in enumerate(wanted.values()) for number in dict.fromkeys(numbers)]
        whose = spark.createDataFrame(pd.DataFrame(owners, columns=["phrase", "number"]), "phrase int, number int")
        texts = index.texts().where("words > 0")
        places = index.phrases(wanted, spread)
        inside = (F.col("at") >= F.col("start")) & (F.col("at") < F.col("start") + F.col("words"))
        # a segment's places and texts meet on the segment; its size is bounded
        met = places.join(texts, "segment").where(inside).select("phrase", "doc").distinct()
        pairs = materialize(met.join(F.broadcast(whose), "phrase").select("doc", "number").distinct(), "alignments")
        passages = spark.sparkContext.broadcast([(item, words) for item, words, _ in hashed])

        def verify(frames: Iterator[pd.DataFrame], passages=passages) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = []
                for doc, text, numbers in zip(frame["doc"], frame["text"], frame["numbers"], strict=True):
                    found = words_of(text)
                    for number in numbers:
                        item, passage = passages.value[number]
                        rows.append((doc, item, _run_length(found, passage), min(run, len(passage))))
                yield pd.DataFrame(rows, columns=["doc", "item", "longest", "needed"])

        asked = pairs.groupBy("doc").agg(F.collect_set("number").alias("numbers"))  # at most the block's items
        read = docs.select("doc", "text").join(asked, "doc")
        results.append(read.mapInPandas(verify, "doc long, item int, longest int, needed int"))
    if not results:
        return spark.createDataFrame([], "doc long, item int, longest int, needed int")
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out.groupBy("doc", "item").agg(F.max("longest").alias("longest"), F.max("needed").alias("needed"))
