"""Exact and same-day near duplicates of articles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presswell.config import MAX_DAY_TERMS, NEAR_DUPLICATE_COSINE, STOPWORDS
from presswell.functions.text import content_hash, tokens
from presswell.operators.lookup import looked_up
from presswell.session import discard, materialize

#: A day of at most so many texts is compared in one task.
MOST_DAY_TEXTS = 4096


def mark_first_seen(rows: DataFrame, column: str) -> DataFrame:
    """Rows that are still UNIQUE and share ``column`` with one of a smaller id become EXACT_DUPLICATE of the least such id.

    NULL and '' never match. The least id comes from an aggregate with partial
    counts, of which only values that occur more than once are kept and looked
    up, so a value that very many rows share fills neither a window nor a task.
    """
    usable = (F.col("duplicate_status") == "UNIQUE") & F.col(column).isNotNull() & (F.col(column) != "")
    first = rows.where(usable).groupBy(column).agg(F.min("article_id").alias("__first"), F.count("*").alias("__n"))
    first = materialize(first.where("__n > 1").drop("__n"), "shared")
    hit = usable & (F.col("__first") < F.col("article_id"))
    return looked_up(rows, first, [column], "left").select(
        *(c for c in rows.columns if c not in ("duplicate_status", "duplicate_of")),
        F.when(hit, "EXACT_DUPLICATE").otherwise(F.col("duplicate_status")).alias("duplicate_status"),
        F.when(hit, F.col("__first")).otherwise(F.col("duplicate_of")).alias("duplicate_of"),
    )


def exact_duplicates(articles: DataFrame) -> DataFrame:
    """article_id, content_hash, duplicate_status, duplicate_of: by link first, then by hash among what is left.

    ``articles`` has article_id (one row each), content_clean, link and
    publication_date. Empty texts share one hash and so are duplicates.
    """
    start = articles.select("article_id", "link", "publication_date", content_hash(F.col("content_clean")).alias("content_hash"))
    start = start.withColumns({"duplicate_status": F.lit("UNIQUE"), "duplicate_of": F.lit(None).cast("long")})
    return mark_first_seen(mark_first_seen(start, "link"), "content_hash")


def day_term_weights(texts: DataFrame, stopwords: list[str] = STOPWORDS, most: int = MAX_DAY_TERMS) -> DataFrame:
    """(day, doc, term, w): TF-IDF weights, each day's texts a corpus of their own, rows of norm 1.

    Only a day's ``most`` most frequent terms count, ties by term; smooth idf
    ``ln((1 + n) / (1 + df)) + 1``. Rows with a NULL day are left out.
    """
    words = texts.where("day is not null").select("day", "doc", F.explode(tokens(F.col("text"))).alias("term"))
    words = words.where(~F.col("term").isin(list(stopwords)))
    tf = words.groupBy("day", "doc", "term").agg(F.count("*").alias("tf"))
    terms = tf.groupBy("day", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))
    rank = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("n"), "term"))  # one row per term of a day
    kept = terms.withColumn("r", rank).where(F.col("r") <= most)
    sizes = texts.where("day is not null").groupBy("day").agg(F.count("*").alias("docs"))
    idf = kept.join(sizes, "day").select("day", "term", (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = tf.join(idf, ["day", "term"]).withColumn("w", F.col("tf") * F.col("idf"))
    norm = raw.groupBy("day", "doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, ["day", "doc"]).select("day", "doc", "term", "idf", (F.col("w") / F.col("norm")).alias("w"))


def _pairs_of_day(docs: np.ndarray, words: list[list[str]], threshold: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, similarity) of one day's texts, given as lists of their terms."""
    turn = np.argsort(docs, kind="stable")
    docs, words = docs[turn], [words[i] for i in turn]
    number: dict[str, int] = {}
    term = np.fromiter((number.setdefault(x, len(number)) for ws in words for x in ws), np.int64)
    doc = np.repeat(np.arange(len(docs)), [len(ws) for ws in words])
    place = np.empty(len(number), np.int64)  # of each term in order of frequency, ties by term
    n = np.bincount(term, minlength=len(number)).tolist()
    place[[number[x] for x in sorted(number, key=lambda x: (-n[number[x]], x))]] = np.arange(len(number))
    cells, tf = np.unique(doc * max(1, len(number)) + place[term], return_counts=True)
    doc, term = np.divmod(cells, max(1, len(number)))
    doc, term, tf = (x[term < most] for x in (doc, term, tf))
    df = np.bincount(term)
    w = tf * (np.log((1 + len(docs)) / (1 + df[term])) + 1)
    w = w / np.sqrt(np.bincount(doc, w * w, len(docs)))[doc]
    table = np.zeros((len(docs), len(df)))
    table[doc, term] = w
    rough, found = table.astype(np.float32), []  # in single precision first, with room for its errors
    for at in range(0, len(docs), 512):
        x, y = np.nonzero(rough[at : at + 512] @ rough[at:].T >= threshold - 1e-4)
        found.append(np.stack([x, y])[:, x < y] + at)
    a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    cuts = range(0, len(a), 512)
    similarity = np.concatenate([np.einsum("ij,ij->i", table[a[k : k + 512]], table[b[k : k + 512]]) for k in cuts]) if len(a) else np.zeros(0)
    kept = similarity >= threshold - 1e-12
    return docs[a[kept]], docs[b[kept]], similarity[kept]


def near_pairs(texts: DataFrame, threshold: float = NEAR_DUPLICATE_COSINE, stopwords: list[str] = STOPWORDS, most: int = MAX_DAY_TERMS, most_texts: int = MOST_DAY_TEXTS) -> DataFrame:
    """(day, a, b, similarity) of same-day texts a < b with cosine >= threshold.

    Texts are shuffled once, by day. A day of up to ``most_texts`` texts is
    compared in one task, as one table of texts by terms; days of more are
    joined by terms, so they are never gathered.
    """
    dated = texts.where("day is not null")
    large = materialize(dated.groupBy("day").agg(F.count("*").alias("docs")).where(F.col("docs") > most_texts).select("day"), "large")
    crowded = not large.isEmpty()
    usual = dated.join(F.broadcast(large), "day", "left_anti") if crowded else dated
    words = F.filter(tokens(F.col("text")), lambda x: ~x.isin(list(stopwords)))
    # split after the shuffle, so only texts are moved
    usual = usual.select("day", "doc", "text").repartition("day").select("day", "doc", F.concat_ws(" ", words).alias("words"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        a, b, similarity = _pairs_of_day(frame["doc"].to_numpy(), [x.split(" ") if x else [] for x in frame["words"]], threshold, most)
        return pd.DataFrame({"day": frame["day"].iloc[0], "a": a, "b": b, "similarity": similarity})

    pairs = usual.groupBy("day").applyInPandas(run, "day date, a long, b long, similarity double")
    return pairs.unionByName(_joined_pairs(dated.join(F.broadcast(large), "day", "left_semi"), threshold, stopwords, most)) if crowded else pairs


def _joined_pairs(texts: DataFrame, threshold: float, stopwords: list[str], most: int) -> DataFrame:
    """``near_pairs`` by joins.

    Terms are ordered rare first. The last terms of a text whose joint norm is
    below the threshold can't make up a pair alone, so a pair shares one of
    the terms before them; only these meet in the join, and the full product
    is taken of the pairs found.
    """
    weights = materialize(day_term_weights(texts, stopwords, most), "weights")  # read four times below
    by_rarity = Window.partitionBy("day", "doc").orderBy(F.asc("idf"), F.desc("term"))  # one text's terms
    tail = F.sqrt(F.sum(F.col("w") * F.col("w")).over(by_rarity))
    head = weights.withColumn("tail", tail).where(F.col("tail") >= threshold - 1e-9).select("day", "term", "doc")
    pairs = head.withColumnRenamed("doc", "a").join(head.withColumnRenamed("doc", "b"), ["day", "term"]).where("a < b").select("day", "a", "b").distinct()
    # each text's weights as one row; terms in one order, so that sums are the same whatever the partitions
    packed = weights.groupBy("day", "doc").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("v"))
    side = lambda name: packed.select("day", F.col("doc").alias(name), F.map_from_entries("v").alias(f"v{name}"))
    both = pairs.join(side("a"), ["day", "a"]).join(side("b"), ["day", "b"])
    shared = F.array_intersect(F.map_keys("va"), F.map_keys("vb"))
    dot = F.aggregate(shared, F.lit(0.0), lambda s, t: s + F.element_at("va", t) * F.element_at("vb", t))
    return both.select("day", "a", "b", dot.alias("similarity")).where(F.col("similarity") >= threshold - 1e-12)


def greedy_marks(pairs: DataFrame) -> DataFrame:
    """(doc, duplicate_of) as a walk over the texts in order of id would mark them.

    The walk makes each text that isn't marked yet the original of all later
    ones similar to it. Without walking: a text all of whose earlier similar
    texts are marked is an original, and every later text similar to an
    original is marked; each round settles all texts of which that is known,
    so no day gathers in one task.
    """
    edges = materialize(pairs.where("a < b").select("a", "b").distinct(), "similar")
    open_, marked = edges, None
    while not open_.isEmpty():
        waiting = open_.select(F.col("b").alias("a")).distinct()
        originals = open_.select("a").distinct().join(waiting, "a", "left_anti")
        hit = edges.join(originals, "a", "left_semi").select("b").distinct()
        before = marked, open_
        marked = materialize(hit if marked is None else marked.unionByName(hit).distinct(), "marked")
        left = edges.join(marked, "b", "left_anti").join(marked.select(F.col("b").alias("a")), "a", "left_anti")
        open_ = materialize(left, "open")
        discard(*(t for t in before if t is not edges))
    if marked is None:
        return edges.select(F.col("b").alias("doc"), F.col("a").alias("duplicate_of"))
    originals = edges.join(marked.select(F.col("b").alias("a")), "a", "left_anti").join(marked, "b", "left_semi")
    return originals.groupBy(F.col("b").alias("doc")).agg(F.min("a").alias("duplicate_of"))


def assign_duplicates(articles: DataFrame, threshold: float = NEAR_DUPLICATE_COSINE) -> DataFrame:
    """article_id, content_hash, duplicate_status, duplicate_of by link, by hash, then near on the same day."""
    exact = exact_duplicates(articles)
    left = exact.where("duplicate_status = 'UNIQUE'").select("article_id").join(articles, "article_id")
    near = greedy_marks(near_pairs(left.select(F.col("article_id").alias("doc"), F.col("publication_date").alias("day"), F.col("content_clean").alias("text")), threshold))
    near = near.select(F.col("doc").alias("article_id"), F.col("duplicate_of").alias("__near"))
    out = exact.join(near, "article_id", "left")
    return out.select(
        "article_id", "content_hash",
        F.when(F.col("__near").isNotNull(), "NEAR_DUPLICATE").otherwise(F.col("duplicate_status")).alias("duplicate_status"),
        F.coalesce("__near", "duplicate_of").alias("duplicate_of"),
    )


def check_new(new: DataFrame, known: DataFrame, threshold: float = NEAR_DUPLICATE_COSINE, within: bool = True) -> DataFrame:
    """Duplicate status of new articles against known ones, without any known article being judged again.

    A hash (or link, if both tables have it) found in ``known`` makes an
    EXACT_DUPLICATE; otherwise the day's known articles that are no exact
    duplicates and the new ones are compared. Known articles come before new
    ones whatever their ids, new ones among each other in order of id, unless
    ``within`` is false. An article never matches its own id, nor one that is
    known as its duplicate.
    """
    hashed = materialize(new.withColumn("content_hash", content_hash(F.col("content_clean"))), "hashed")
    ids = hashed.select("article_id")
    owner = F.col("duplicate_of") if "duplicate_of" in known.columns else F.lit(None).cast("long")
    before = known.withColumn("duplicate_of", owner).join(ids, "article_id", "left_anti")
    apart = F.coalesce(F.col("__of") != F.col("article_id"), F.lit(True))
    match = None
    for column in ("link", "content_hash"):
        if column not in hashed.columns or column not in known.columns:
            continue
        mine = hashed.where(F.col(column).isNotNull() & (F.col(column) != "")).select("article_id", column)
        # of known articles only those with a new one's value, and of these one per value and original
        met = before.join(mine.select(column).distinct(), column, "left_semi").groupBy(column, F.col("duplicate_of").alias("__of")).agg(F.min("article_id").alias("__id"))
        hit = mine.join(met, column).where(apart).select("article_id", "__id")
        if within:
            least = mine.groupBy(column).agg(F.min("article_id").alias("__id"))
            hit = hit.unionByName(mine.join(least, column).where("__id < article_id").select("article_id", "__id"))
        hit = hit.groupBy("article_id").agg(F.min("__id").alias("__exact"))
        match = hit if match is None else match.unionByName(hit.join(match, "article_id", "left_anti"))
    match = materialize(match, "exact")
    days = hashed.select("publication_date").where("publication_date is not null").distinct()
    around = before.where("coalesce(duplicate_status, 'EXACT_DUPLICATE') <> 'EXACT_DUPLICATE'").join(days, "publication_date", "left_semi")
    columns = [F.col("article_id").alias("doc"), F.col("publication_date").alias("day"), F.col("content_clean").alias("text")]
    left = hashed.join(match, "article_id", "left_anti")
    pairs = near_pairs(around.select(*columns).unionByName(left.select(*columns)), threshold)
    sides = pairs.select(F.col("a").alias("article_id"), F.col("b").alias("o")).unionByName(pairs.select(F.col("b").alias("article_id"), F.col("a").alias("o")))
    sides = sides.join(ids, "article_id", "left_semi").join(around.select(F.col("article_id").alias("o"), F.col("duplicate_of").alias("__of"), F.lit(True).alias("__known")), "o", "left")
    earlier = F.when(F.col("__known"), apart).otherwise((F.col("o") < F.col("article_id")) & F.lit(within))
    near = sides.where(earlier).groupBy("article_id").agg(F.min("o").alias("__near"))
    out = hashed.select("article_id", "content_hash").join(match, "article_id", "left").join(near, "article_id", "left")
    status = F.when(F.col("__exact").isNotNull(), "EXACT_DUPLICATE").when(F.col("__near").isNotNull(), "NEAR_DUPLICATE").otherwise("UNIQUE")
    return out.select("article_id", "content_hash", status.alias("duplicate_status"), F.coalesce("__exact", "__near").alias("duplicate_of"))


def assign_after(articles: DataFrame, known: DataFrame) -> DataFrame:
    """``assign_duplicates`` of a run, its articles also matched with ``known`` ones, which come first."""
    own = assign_duplicates(articles)
    old = check_new(articles, known, within=False).select("article_id", F.col("duplicate_status").alias("__status"), F.col("duplicate_of").alias("__of"))
    use = (F.col("__status") == "EXACT_DUPLICATE") | ((F.col("__status") == "NEAR_DUPLICATE") & (F.col("duplicate_status") != "EXACT_DUPLICATE"))
    return own.join(old, "article_id").select(
        "article_id", "content_hash",
        F.when(use, F.col("__status")).otherwise(F.col("duplicate_status")).alias("duplicate_status"),
        F.when(use, F.col("__of")).otherwise(F.col("duplicate_of")).alias("duplicate_of"),
    )


def shared_values(rows: DataFrame, column: str) -> DataFrame:
    """All rows whose ``column`` occurs more than once; NULL is no value."""
    often = rows.groupBy(column).agg(F.count("*").alias("copies")).where("copies > 1")
    return rows.join(often, column)
