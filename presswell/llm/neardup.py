"""Problem 3: groups of texts with small edits, by token-combination prefixes.

Texts are sets of word shingles. Under one order of all shingles (rare first)
two sets with similarity t share at least l shingles within their l-prefixes,
``n - ceil(t * n) + l`` first shingles of each. So one of two things holds:

* a *rare* shingle is shared in the 1-prefixes: rare shingles are keys alone;
* l frequent ones are shared in the l-prefixes. They fall into m hash
  classes, and with l = m + 1 two of them fall into one class: the keys are
  the pairs of frequent shingles of one class.

m grows with the size of the texts, in tiers that overlap by the size ratio t,
so a pair always meets in the tier of its larger text. Every pair that shares
a key is a candidate; nothing is capped:

* small buckets (one key's texts) give their pairs;
* a bucket beyond ``small`` gives the links from its least text (a star).
  Once these are verified and joined to components, only the pairs of a large
  bucket that lie in different components can add anything, and those are
  compared by their parity bitmaps inside the join that makes them.

Candidates first pass a size test and the bitmap test (the bits in which two
parity bitmaps differ are at most the shingles in which the sets differ), both
without loss; whole texts are compared only for what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswell.llm.components import connected_components
from presswell.llm.shingles import mix, shingle_batch, similarity
from presswell.session import discard, materialize

#: (least size of the larger text, classes m), largest first; the classes grow with
#: the texts, so that a text of n shingles has about n keys however long it is.
TIERS = tuple((72 * 9**k, 40 * 9**k) for k in range(8, -1, -1)) + ((24, 12), (8, 3))
BITMAP = 8  # 64-bit words
_U = np.uint64
_CHARS = 4_000_000
_TASK_BYTES = 32 << 20
_PLAIN, _HOT = -1, -2  # instead of a leader: an ordinary posting, the leader's own one


def chunks(frames: Iterator[pd.DataFrame], text: str) -> Iterator[pd.DataFrame]:
    """Split Arrow batches so that one step holds about 4 MB of text, or one text."""
    for frame in frames:
        sizes = frame[text].str.len().fillna(0).to_numpy().astype(np.int64)
        part = np.cumsum(sizes) // _CHARS
        cuts = np.flatnonzero(np.diff(part)) + 1
        for rows in np.split(np.arange(len(frame)), cuts):
            if len(rows):
                yield frame.iloc[rows]


def _fold(values: np.ndarray, offsets: np.ndarray, ufunc) -> np.ndarray:
    out = np.zeros(len(offsets) - 1, dtype=np.uint64)
    full = offsets[1:] > offsets[:-1]
    if full.any():
        out[full] = ufunc.reduceat(values, offsets[:-1][full])
    return out


def parity_bitmaps(offsets: np.ndarray, tokens: np.ndarray) -> list[np.ndarray]:
    """BITMAP words per set: bit b is the parity of the number of shingles that hash to b."""
    bit = mix(tokens ^ _U(0x5851F42D4C957F2D)) % _U(64 * BITMAP)
    one = _U(1) << (bit % _U(64))
    return [_fold(np.where(bit // _U(64) == k, one, _U(0)), offsets, np.bitwise_xor) for k in range(BITMAP)]


def profile_columns(offsets: np.ndarray, tokens: np.ndarray) -> dict[str, np.ndarray]:
    """n, set_hash, bits0.. of a batch of shingle sets: size, a hash of the set and its parity bitmap."""
    n = np.diff(offsets)
    total = np.add(_fold(mix(tokens), offsets, np.add), _fold(mix(tokens ^ _U(77)), offsets, np.bitwise_xor) * _U(3))
    out = {"n": n.astype(np.int32), "set_hash": mix(total + n.astype(np.uint64)).view(np.int64)}
    return out | {f"bits{k}": words.view(np.int64) for k, words in enumerate(parity_bitmaps(offsets, tokens))}


def profiles(texts: DataFrame, width: int) -> DataFrame:
    """(doc, text, n, set_hash, bits0..) of every row, by ``profile_columns``."""
    schema = "doc long, text string, n int, set_hash long, " + ", ".join(f"bits{k} long" for k in range(BITMAP))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in chunks(frames, "text"):
            yield pd.DataFrame({"doc": frame["doc"].to_numpy(), "text": frame["text"].to_numpy(), **profile_columns(*shingle_batch(frame["text"], width))})

    return texts.select("doc", "text").mapInPandas(run, schema)


def _cells(tokens: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """(range, 32-bit cell within it) of each token."""
    wide = tokens >> _U(32)
    return ((wide * _U(ranges)) >> _U(32)).astype(np.int64), (tokens & _U(0xFFFFFFFF)).astype(np.uint32)


def frequent_tokens(docs: DataFrame, width: int, most: int, ranges: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """(token, number of texts) of the shingles found in two texts or more, in token order.

    Counts cover all texts: each task sends its different shingles as packed
    32-bit cells of hash ranges, and one task per range adds them up. Only the
    ``most`` most frequent go to the driver and the workers, so what is
    broadcast is bounded (9 bytes each); the last value tells whether that is
    all of them. The list decides order and classes, never which pairs are found.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        size = 0

        def pack() -> pd.DataFrame:
            tokens, inverse = np.unique(np.concatenate(held), return_inverse=True)
            total = np.bincount(inverse, weights=np.concatenate(counts)).astype(np.uint32)
            which, cell = _cells(tokens, ranges)
            order = np.lexsort((cell, which))
            which, cell, total = which[order], cell[order], total[order]
            cuts = np.flatnonzero(np.diff(which)) + 1
            return pd.DataFrame({
                "part": which[np.r_[0, cuts]] if len(which) else [],
                "cells": [x.tobytes() for x in np.split(cell, cuts)] if len(which) else [],
                "counts": [x.astype(np.uint16).tobytes() if x.max() < 65536 else x.tobytes() for x in np.split(total, cuts)] if len(which) else [],
            })

        for frame in chunks(frames, "text"):
            _, tokens = shingle_batch(frame["text"], width)
            values, n = np.unique(tokens, return_counts=True)
            held.append(values)
            counts.append(n)
            size += len(values)
            if size > 6_000_000:
                yield pack()
                held, counts, size = [], [], 0
        if size:
            yield pack()

    share = max(1, most // ranges)

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        cells = [np.frombuffer(x, np.uint32) for x in frame["cells"]]
        counts = [np.frombuffer(y, np.uint16 if len(y) == 2 * len(x) else np.uint32) for x, y in zip(cells, frame["counts"], strict=True)]
        values, inverse = np.unique(np.concatenate(cells), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)
        keep = np.flatnonzero(total > 1)
        whole = len(keep) <= share
        if not whole:
            keep = keep[np.argsort(-total[keep], kind="stable")[:share]]
            keep.sort()
        packed = np.minimum(255, np.ceil(4 * np.log2(total[keep].astype(float)))).astype(np.uint8)
        return pd.DataFrame({"part": [int(frame["part"].iloc[0])], "whole": [whole], "cells": [values[keep].tobytes()], "levels": [packed.tobytes()]})

    packed = docs.select("text").mapInPandas(count, "part long, cells binary, counts binary")
    rows = packed.groupBy("part").applyInPandas(add, "part long, whole boolean, cells binary, levels binary").collect()
    if not rows:
        return np.empty(0, np.uint64), np.empty(0, np.uint8), True
    # a key of range and cell; ranges are few enough for 64 bits
    keys = np.concatenate([(np.frombuffer(r.cells, np.uint32).astype(np.uint64)) | (_U(r.part) << _U(32)) for r in rows])
    levels = np.concatenate([np.frombuffer(r.levels, np.uint8) for r in rows])
    order = np.argsort(keys)
    return keys[order], levels[order], all(r.whole for r in rows)


def levels_of(tokens: np.ndarray, ranges: int, keys: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The frequency level (4 log2 of the number of texts) of each token, 0 if not listed."""
    if not len(keys):
        return np.zeros(len(tokens), np.uint8)
    which, cell = _cells(tokens, ranges)
    wanted = cell.astype(np.uint64) | (which.astype(np.uint64) << _U(32))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, levels[at], 0).astype(np.uint8)


def prefix_keys(offsets: np.ndarray, tokens: np.ndarray, level: np.ndarray, whole: bool, threshold: float, rare: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, key) of every key of every set.

    ``level`` 0 means unlisted: if the list is whole, such a shingle occurs in
    one text only and can't be shared; otherwise it counts as frequent. Levels
    up to ``rare`` are rare. All rare shingles come before all frequent ones:
    if the first shared one is frequent, so are all l of the l-prefixes.
    """
    n = np.diff(offsets)
    doc = np.repeat(np.arange(len(n)), n)
    late = level > rare if whole else (level > rare) | (level == 0)
    order = np.lexsort((tokens, level, late, doc))
    tokens, level = tokens[order], level[order]
    at = np.arange(len(tokens)) - offsets[:-1][doc]
    need = np.ceil(threshold * n - 1e-9).astype(np.int64)
    first = at < (n - need + 1)[doc]
    single = (level > 0) & (level <= rare)
    frequent = late[order]
    docs_out, keys_out = [doc[first & single]], [tokens[first & single]]
    combine = np.zeros(len(n), dtype=bool)
    np.logical_or.at(combine, doc[first & frequent], True)
    largest = np.iinfo(np.int64).max
    for least, classes in TIERS:
        classes = max(1, min(classes, int(threshold * least) - 1))  # so many pairs can't share m + 1 else
        mine = combine & (n > threshold * least - 1e-9) & (n <= largest)
        largest = least - 1
        if not mine.any():
            continue
        length = np.minimum(n, n - np.maximum(need, int(np.ceil(threshold * least - 1e-9))) + classes + 1)
        pick = mine[doc] & (at < length[doc]) & frequent
        d, z = doc[pick], tokens[pick]
        c = (mix(z) % _U(classes)).astype(np.int64)
        by = np.lexsort((z, c, d))
        d, z, c = d[by], z[by], c[by]
        for k in range(1, len(z)):
            same = (d[k:] == d[:-k]) & (c[k:] == c[:-k])
            if not same.any():
                break
            docs_out.append(d[k:][same])
            keys_out.append(mix(mix(z[:-k][same]) + z[k:][same] * _U(3) + _U(least)))
    tiny = first & (n <= largest)[doc]  # too small for combinations: every shingle of the 1-prefix
    docs_out.append(doc[tiny])
    keys_out.append(mix(tokens[tiny] + _U(5)))
    return np.concatenate(docs_out), np.concatenate(keys_out)


def _postings(docs: DataFrame, width: int, threshold: float, rare: int, small: int, ranges: int, listed) -> DataFrame:
    """(key, doc, n, leader) with the leader of texts of buckets already large within one batch.

    The leader's own posting is marked _HOT, so the key's task knows that the
    bucket is large even if it sees few of its texts; all others are _PLAIN.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, levels, whole = listed.value
        for frame in chunks(frames, "text"):
            frame = frame.sort_values("doc").drop_duplicates("set_hash")  # copies are linked by set_hash
            offsets, tokens = shingle_batch(frame["text"], width)
            owner, key = prefix_keys(offsets, tokens, levels_of(tokens, ranges, keys, levels), whole, threshold, rare)
            doc, n = frame["doc"].to_numpy(), np.diff(offsets)
            order = np.lexsort((owner, key))
            owner, key = owner[order], key[order]
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
            size = np.diff(np.r_[start, len(key)])
            leader = np.repeat(doc[owner[start]], size)
            hot = np.repeat(size > small, size)
            ids = doc[owner]
            yield pd.DataFrame({"key": key.view(np.int64), "doc": ids, "n": n[owner].astype(np.int32), "leader": np.where(hot, np.where(ids != leader, leader, _HOT), _PLAIN)})

    return docs.select("doc", "text", "set_hash").mapInPandas(run, "key long, doc long, n int, leader long")


def _buckets(postings: DataFrame, threshold: float, small: int, parts: int) -> DataFrame:
    """Candidate links and the members of large buckets, in one pass over sorted postings.

    Rows (kind, key, a, na, b, nb): kind 0 is a candidate link, kind 1 says
    that b belongs to the large bucket ``key``. A task sees each key's
    postings together and keeps at most ``small`` + 1 of them at a time. A
    bucket is large beyond ``small`` postings or with a _HOT one: then all its
    texts are members, those spread over other tasks and those seen here.
    """
    schema = "kind int, key long, a long, na int, b long, nb int"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry = pd.DataFrame({"key": np.empty(0, np.int64), "doc": np.empty(0, np.int64), "n": np.empty(0, np.int32), "leader": np.empty(0, np.int64)})
        head: dict[int, tuple[int, int]] = {}  # the open key, if it is known to be large: its leader

        def emit(frame: pd.DataFrame, open_end: bool) -> Iterator[pd.DataFrame]:
            nonlocal carry, head
            key, doc, n = frame["key"].to_numpy(), frame["doc"].to_numpy(), frame["n"].to_numpy()
            if not len(key):
                return
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[start, len(key)])
            hold = 0
            if open_end:
                last = int(key[-1])
                if last not in head and size[-1] <= small:
                    hold = int(size[-1])
            end = len(key) - hold
            carry = frame.iloc[end:]
            live = np.repeat(size, size)[:end]
            group = np.repeat(start, size)[:end]
            k, d, m = key[:end], doc[:end], n[:end]
            hot = np.logical_or.reduceat(frame["leader"].to_numpy() == _HOT, start)
            big = (live > small) | np.repeat(hot, size)[:end]
            lead_doc, lead_n = d[group], m[group]
            if len(k) and int(k[0]) in head:  # the rest of a bucket that is known to be large
                again = k == k[0]
                big = big | again
                lead_doc = np.where(again, head[int(k[0])][0], lead_doc)
                lead_n = np.where(again, head[int(k[0])][1], lead_n)
            parts = []
            ordinary = (live > 1) & ~big
            od, om, og = d[ordinary], m[ordinary], group[ordinary]
            for s in range(1, small):
                same = og[s:] == og[:-s] if s < len(og) else np.empty(0, bool)
                if not same.any():
                    break
                parts.append((np.zeros(same.sum(), np.int32), np.zeros(same.sum(), np.int64), od[:-s][same], om[:-s][same], od[s:][same], om[s:][same]))
            star = big & (d != lead_doc)
            parts.append((np.zeros(star.sum(), np.int32), np.zeros(star.sum(), np.int64), lead_doc[star], lead_n[star], d[star], m[star]))
            parts.append((np.ones(big.sum(), np.int32), k[big], d[big], m[big], d[big], m[big]))
            out = pd.DataFrame({c: np.concatenate([p[i] for p in parts]) for i, c in enumerate(("kind", "key", "a", "na", "b", "nb"))})
            fits = (out["kind"] == 1) | (np.minimum(out["na"], out["nb"]) >= threshold * np.maximum(out["na"], out["nb"]) - 1e-9)
            head = {}
            if open_end and end == len(key) and len(k) and big[-1]:
                head = {int(k[-1]): (int(lead_doc[-1]), int(lead_n[-1]))}
            yield out[fits]

        for frame in frames:
            plain = frame[frame["leader"] < 0]
            local = frame[frame["leader"] >= 0]
            if len(local):
                same = {"key": local["key"], "na": local["n"], "b": local["doc"], "nb": local["n"]}
                yield pd.DataFrame({"kind": np.int32(1), **same, "a": local["doc"]})[["kind", "key", "a", "na", "b", "nb"]]
                yield pd.DataFrame({"kind": np.int32(0), **same, "a": local["leader"]})[["kind", "key", "a", "na", "b", "nb"]]
            yield from emit(pd.concat([carry, plain], ignore_index=True), True)
        yield from emit(carry, False)

    # members of buckets that are hot within a batch are spread over all tasks
    route = F.when(F.col("leader") < 0, F.col("key")).otherwise(F.xxhash64("key", "doc"))
    sorted_ = postings.withColumn("route", route).repartition(parts, "route").sortWithinPartitions("key", "doc").drop("route")
    return sorted_.mapInPandas(run, schema)


def _differ() -> Column:
    out = F.lit(0)
    for k in range(BITMAP):
        out = out + F.bit_count(F.col(f"x.bits{k}").bitwiseXOR(F.col(f"y.bits{k}")))
    return out


def _could_match(threshold: float) -> Column:
    """False only if the bitmaps prove that x and y are less similar than the threshold."""
    total = F.col("x.n") + F.col("y.n")
    return _differ() * (1 + threshold) <= (1 - threshold) * total + 1e-6


def _verified(pairs: DataFrame, docs: DataFrame, width: int, threshold: float) -> DataFrame:
    """(a, b) of the pairs whose whole texts are similar enough."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 500):
                part = frame.iloc[at : at + 500]
                offsets, tokens = shingle_batch(list(part["text_a"]) + list(part["text_b"]), width)
                k = len(part)
                sets = [tokens[offsets[i] : offsets[i + 1]] for i in range(2 * k)]
                good = [similarity(sets[i], sets[k + i]) >= threshold - 1e-12 for i in range(k)]
                yield part.loc[good, ["a", "b"]]

    left = docs.select(F.col("doc").alias("a"), F.col("text").alias("text_a"))
    right = docs.select(F.col("doc").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInPandas(run, "a long, b long")


def near_duplicate_links(
    texts: DataFrame, threshold: float = 0.8, width: int = 5, rare: int = 2, small: int = 16, most: int = 1 << 20
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(links, copies, components if they are known already) of near-duplicate texts.

    ``texts`` has ``doc`` (bigint, one row each) and ``text``; other columns
    are ignored. ``links`` (a, b) connects texts with different shingle sets;
    every pair of similarity >= ``threshold`` is joined by a path of links of
    similar texts. ``copies`` (a, b) leads from each text to the least text
    with the same shingle set. Texts of fewer than ``width`` words, empty ones
    and NULL belong to no pair; rows with a NULL doc are dropped.

    ``rare``: shingles of up to so many texts are keys alone. ``small``: the
    largest bucket whose pairs are all made. ``most``: how many frequent
    shingles the order knows; beyond it shingles count as frequent.
    """
    spark = texts.sparkSession
    docs = materialize(profiles(texts.where("doc is not null"), width).where("n > 0"), "profiles")
    copies = docs.groupBy("set_hash").agg(F.min("doc").alias("a"), F.count("*").alias("c")).where("c > 1")
    copies = docs.select("set_hash", F.col("doc").alias("b")).join(copies, "set_hash").where("a <> b").select("a", "b")

    # one task adds up one range; their number follows the cluster's setting
    ranges = min(1 << 18, max(64, 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    listed = spark.sparkContext.broadcast(frequent_tokens(docs, width, most, ranges))
    level = int(np.ceil(4 * np.log2(rare)))
    postings = _postings(docs, width, threshold, level, small, ranges, listed)
    # tasks of a bounded size: a text has about 90 postings of 28 bytes
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + docs.count() * 90 * 28 // _TASK_BYTES)
    found = materialize(_buckets(postings, threshold, small, parts), "buckets")

    marks = docs.select("doc", "n", "set_hash", *(f"bits{k}" for k in range(BITMAP)))
    pairs = found.where("kind = 0").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    x, y = marks.alias("x"), marks.alias("y")
    near = pairs.join(x, F.col("a") == F.col("x.doc")).join(y, F.col("b") == F.col("y.doc"))
    near = near.where(_could_match(threshold)).where("x.set_hash <> y.set_hash").select("a", "b")
    links = materialize(_verified(near, docs, width, threshold), "verified")

    members = found.where("kind = 1").select("key", F.col("b").alias("doc")).distinct()
    if members.isEmpty():
        return links, copies, None
    labels = connected_components(links.unionByName(copies))
    labelled = members.join(labels.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    mixed = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    open_ = materialize(labelled.join(mixed, "key", "left_semi").join(marks.drop("set_hash"), "doc"), "open")
    # similar texts lie in the same or in neighbouring size classes: that prunes the pairs of a bucket and splits it
    size = F.floor(F.log("n") / F.lit(float(-np.log(threshold)) * (1 + 1e-6) + 1e-6)).cast("int")  # a little wider than the ratio
    x = open_.withColumn("size", size).alias("x")
    y = open_.withColumn("size", F.explode(F.array(size - 1, size, size + 1))).alias("y")
    meets = (F.col("x.key") == F.col("y.key")) & (F.col("x.size") == F.col("y.size")) & (F.col("x.doc") < F.col("y.doc")) & (F.col("x.component") != F.col("y.component"))
    sizes = F.least("x.n", "y.n") >= threshold * F.greatest("x.n", "y.n") - 1e-9
    rest = x.join(y, meets & sizes & _could_match(threshold)).select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).distinct()
    rest = materialize(_verified(rest.join(links, ["a", "b"], "left_anti"), docs, width, threshold), "rest")
    discard(found, open_)
    return links.unionByName(rest), copies, labels if rest.isEmpty() else None


def near_duplicate_groups(texts: DataFrame, threshold: float = 0.8, width: int = 5, **options) -> DataFrame:
    """(group_id, doc) of each text that has a near-duplicate; group_id is the group's least doc."""
    links, copies, labels = near_duplicate_links(texts, threshold, width, **options)
    if labels is None:
        labels = connected_components(links.unionByName(copies))
    return labels.select(F.col("component").alias("group_id"), F.col("node").alias("doc"))
