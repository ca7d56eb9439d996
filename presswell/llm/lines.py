"""Problem 5: lines repeated across one site's documents.

Lines are masked (numbers, dates and names become one mark each) and clustered
within their site by locality-sensitive hashing of word shingles: lines that
agree on a band of min-hashes meet in a bucket. The normal form itself is one
more bucket, so equal lines always meet, whatever their min-hashes. Buckets
are counted, partly before the shuffle, and those of few documents dropped;
what remains are clusters of near-duplicate lines with a high document
frequency. Only their lines are counted one by one, exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswell.llm.components import connected_components
from presswell.llm.neardup import chunks
from presswell.llm.shingles import mix
from presswell.operators.lookup import looked_up
from presswell.session import discard, materialize

WIDTH, BANDS, ROWS = 5, 3, 3
_U = np.uint64


def site_of(link: Column) -> Column:
    """The host of a link in lower case, without a port and a leading ``www.`` or ``m.``; NULL if there is none."""
    host = F.lower(F.regexp_extract(link, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]+)", 1))
    return F.nullif(F.regexp_replace(host, r"^(?:www|m)\.", ""), F.lit(""))


def normal_line(line: Column) -> Column:
    """Lower case, runs of ASCII white space one blank, none at the ends, runs of digits one 0."""
    spaced = F.trim(F.regexp_replace(F.lower(line), r"[ \t\n\x0B\f\r]+", " "))
    return F.regexp_replace(spaced, r"[0-9]+", "0")


_LINK = re.compile(r"://|^www\.|@|\.(?:example|com|org|net|lk)\b")
#: What a token is masked to.
_NUMBER_MARK, _NAME_MARK, _LINK_MARK, _END = (xxhash.xxh3_64_intdigest(x) for x in ("<0>", "<name>", "<link>", "<end>"))


def masked_tokens(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(line number, hash) of the masked tokens of each line.

    A token with a digit is a number (dates, times, scores), a link or address
    a link; a capitalised word that doesn't begin the line or a sentence is a
    name, and a run of names is one. Other tokens count in lower case, without
    the punctuation around them.
    """
    lists = [x.split() for x in lines]
    count = np.array([len(x) for x in lists], dtype=np.int64)
    codes, unique = pd.factorize(np.array([w for x in lists for w in x], dtype=object))
    word, mask, kind = np.empty((3, len(unique)), dtype=np.uint64)
    for i, w in enumerate(unique):
        core = w.strip(".,;:!?\"'“”‘’()[]|–—-") or w
        low = xxhash.xxh3_64_intdigest(core.lower())
        if _LINK.search(w.lower()):
            low = made = _LINK_MARK
        elif any(c.isdigit() for c in w):
            low = made = _NUMBER_MARK
        else:
            made = _NAME_MARK if core[:1].isupper() and not (len(core) > 1 and core.isupper()) else low
        word[i], mask[i], kind[i] = low, made, 1 if w[-1:] in ".!?" else 0
    line = np.repeat(np.arange(len(lists)), count)
    begins = np.ones(len(line), dtype=bool)
    begins[1:] = (line[1:] != line[:-1]) | (kind[codes[:-1]] == 1)
    h = np.where(begins, word[codes], mask[codes])
    name = h == _U(_NAME_MARK)
    again = np.zeros(len(line), dtype=bool)
    again[1:] = name[1:] & name[:-1] & (line[1:] == line[:-1])
    return line[~again], h[~again]


def _band_hashes(line: np.ndarray, h: np.ndarray, lines: int, bands: int, seed: int) -> np.ndarray:
    """Min-hashes of the token shingles of each line, joined to bands; short lines are filled up to one shingle."""
    lacking = np.maximum(0, WIDTH - np.bincount(line, minlength=lines))
    line = np.concatenate((line, np.repeat(np.arange(lines), lacking)))
    h = np.concatenate((h, np.full(lacking.sum(), _END, dtype=np.uint64)))
    order = np.argsort(line, kind="stable")
    line, h = line[order], h[order]
    n = len(h) - WIDTH + 1
    rolled = np.full(n, WIDTH, dtype=np.uint64)
    for k in range(WIDTH):
        rolled = mix(rolled ^ h[k : k + n]) + _U(0x9E3779B97F4A7C15)
    inner = line[:n] == line[WIDTH - 1 :]
    rolled, line = rolled[inner], line[:n][inner]
    starts = np.searchsorted(line, np.arange(lines))
    seeds = mix(np.arange(seed, seed + 2 * bands * ROWS, dtype=np.uint64))
    out = np.zeros((lines, bands), dtype=np.uint64)
    for b in range(bands):
        for r in range(ROWS):
            a, c = seeds[2 * (b * ROWS + r)] | _U(1), seeds[2 * (b * ROWS + r) + 1]
            least = np.minimum.reduceat((rolled * a + c) ^ (rolled >> _U(29)), starts)
            out[:, b] = mix(out[:, b] ^ least) + _U(b + 1)
    return out


def bands_of(lines: list[str]) -> np.ndarray:
    """(lines, BANDS) 32-bit hashes; equal ones of a band mean agreement on ROWS min-hashes."""
    line, masked = masked_tokens(lines)
    out = _band_hashes(line, masked, len(lines), BANDS, 1)
    return (out >> _U(32)).astype(np.uint32).view(np.int32)


def line_places(docs: DataFrame) -> DataFrame:
    """(doc, site, line_no, key, bands) of every non-empty line; key is a hash of the normal form.

    ``docs`` has doc, site and text. Lines count from 1 over all lines of the
    text split at ``\\n``, the empty ones too.
    """
    split = docs.where("text is not null").select("doc", "site", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    out = split.withColumn("normal", normal_line(F.col("line"))).where("normal <> ''")
    out = out.select("doc", "site", (F.col("at") + 1).alias("line_no"), "line", F.xxhash64("normal").alias("key"))
    schema = "doc long, site string, line_no int, key long, " + ", ".join(f"band{b} int" for b in range(BANDS))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in chunks(frames, "line"):
            found = bands_of(frame["line"].tolist())
            yield frame.drop(columns="line").assign(**{f"band{b}": found[:, b] for b in range(BANDS)})

    return out.mapInPandas(run, schema)


def repeated_lines(docs: DataFrame, least_docs: int = 5, least_share: float = 0.03) -> tuple[DataFrame, DataFrame]:
    """(places, clusters) of lines repeated within a site.

    ``docs`` has doc (one row each), site and text; other columns are ignored.
    ``places`` (doc, site, line_no, key, cluster, line_docs, cluster_docs,
    needed) has every line of a frequent cluster. The line itself is found in
    ``line_docs`` documents of the site, lines of its cluster in
    ``cluster_docs``, and ``needed`` is the number that makes a repeated line:
    ``least_docs`` and ``least_share`` of the site's documents. ``clusters``
    (site, cluster, lines, cluster_docs, line_docs, needed). Documents without a site (NULL) are left out; NULL and empty
    texts count as documents of their site but have no lines. A line counts
    once per document, however often it stands there.
    """
    sited = docs.where("site is not null").select("doc", "site", "text")
    places = materialize(line_places(sited), "lines")
    needed = F.greatest(F.lit(least_docs), F.ceil(F.round(F.count("*") * least_share, 9))).cast("long")
    totals = materialize(sited.groupBy("site").agg(needed.alias("needed")), "sites")

    # a document with two lines of one bucket counts twice here, so no frequent cluster is lost
    buckets_of = [(F.lit(b), F.col(f"band{b}").cast("long")) for b in range(BANDS)] + [(F.lit(-1), F.col("key"))]
    one = F.stack(F.lit(len(buckets_of)), *(x for pair in buckets_of for x in pair)).alias("at", "band")
    hashed = places.select("site", "key", one).select("site", "key", F.xxhash64("site", "at", "band").alias("bucket"))
    buckets = hashed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("key").alias("head")).where(F.col("n") >= least_docs)
    buckets = materialize(buckets, "buckets")
    members = looked_up(hashed, buckets, ["bucket"]).groupBy("site", "key", "head").agg(F.max("n").alias("n"))
    members = materialize(looked_up(members, totals, ["site"]).where("n >= needed").select("site", "key", "head"), "members")
    node = lambda c: F.xxhash64("site", c)
    labels = connected_components(members.select(node("key").alias("a"), node("head").alias("b")))
    keys = members.select("site", "key").distinct().withColumn("node", node("key")).join(labels, "node", "left")
    keys = materialize(keys.select("site", "key", F.coalesce("component", "node").alias("cluster")), "keys")

    # the exact counts of each line of the clusters, and of each cluster
    inside = looked_up(places.select("doc", "site", "key"), keys, ["site", "key"])
    per_doc = materialize(inside.select("site", "key", "cluster", "doc").distinct(), "inside")
    counted = per_doc.groupBy("site", "key", "cluster").agg(F.count("*").alias("line_docs"))
    sizes = per_doc.select("site", "cluster", "doc").distinct().groupBy("site", "cluster").agg(F.count("*").alias("cluster_docs"))
    counted = materialize(looked_up(counted.join(sizes, ["site", "cluster"]), totals, ["site"]), "counted")
    discard(buckets, members, keys, per_doc, totals)
    found = looked_up(places.select("doc", "site", "line_no", "key"), counted, ["site", "key"])
    summary = counted.groupBy("site", "cluster").agg(
        F.count("*").alias("lines"), F.max("cluster_docs").alias("cluster_docs"), F.max("line_docs").alias("line_docs"), F.max("needed").alias("needed")
    )
    return found, summary


def without_lines(docs: DataFrame, places: DataFrame, near: bool = False) -> DataFrame:
    """(doc, text) of ``docs`` without repeated lines; without all lines of clusters that stand in as many documents if ``near``.

    Documents in which no such line stands keep their text unchanged.
    """
    chosen = places.where("cluster_docs >= needed" if near else "line_docs >= needed")
    numbers = chosen.groupBy("doc").agg(F.collect_set("line_no").alias("gone"))  # lines of one document
    rows = docs.join(numbers, "doc", "left")
    kept = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("gone", (i + 1).cast("int")))
    return rows.select("doc", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))
