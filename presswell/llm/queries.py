"""Registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswell.llm import encoding, lines, mixing, news, truncation
from presswell.llm.hashforest import batch_duplicates, batch_links
from presswell.llm.leaks import leaks
from presswell.llm.neardup import near_duplicate_groups
from presswell.llm.oracle import ORACLE
from presswell.llm.quality import function_words, text_quality
from presswell.session import materialize
from presswell.sources.tables import read_table

#: Where the box keeps public tokenizers; a parameter of the queries that use one.
TOKENIZER = os.environ.get("PRESSWELL_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    batches = read_table(spark, folder, "news_batches").select("batch_no", F.col("article_id").alias("doc"), F.col("content_clean").alias("text"))
    return batch_duplicates(news.completed_texts(spark, folder).select("doc", "text"), batches, threshold=0.6, width=3)


def p2_links(spark: SparkSession, folder: str) -> DataFrame:
    """Each incoming article's class of equal texts and how many other classes it is similar to."""
    batches = read_table(spark, folder, "news_batches").select("batch_no", F.col("article_id").alias("doc"), F.col("content_clean").alias("text"))
    links = batch_links(news.completed_texts(spark, folder).select("doc", "text"), batches, threshold=0.6, width=3)
    return links.withColumnRenamed("doc", "article_id")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    groups = near_duplicate_groups(news.completed_texts(spark, folder).select("doc", "text"), threshold=0.6, width=3)
    return groups.where("group_id < doc").select("group_id", F.col("doc").alias("article_id"))


def _repeated(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = news.current_scraped(spark, folder, "content", "link")
    docs = rows.select(F.col("id").alias("doc"), lines.site_of(F.col("link")).alias("site"), F.col("content").alias("text"))
    return docs, *lines.repeated_lines(docs)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    _, places, _ = _repeated(spark, folder)
    return places.where("line_docs >= needed").select(F.col("doc").alias("id"), "line_no")


def p5_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters of near-duplicate lines of one site that stand in many of its articles."""
    return _repeated(spark, folder)[2]


def p5_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """Current articles without the repeated lines of their site."""
    docs, places, _ = _repeated(spark, folder)
    return lines.without_lines(docs, places).withColumnRenamed("doc", "id")


def p5_cleaned_near(spark: SparkSession, folder: str) -> DataFrame:
    """The same without all lines of near-duplicate clusters that stand in as many articles: bylines, counters and the like, too."""
    docs, places, _ = _repeated(spark, folder)
    return lines.without_lines(docs, places, near=True).withColumnRenamed("doc", "id")


def p5_remains(spark: SparkSession, folder: str) -> DataFrame:
    """The same in the COMPLETED articles' ``content_clean``, by the site of the article's current link."""
    links = news.current_scraped(spark, folder, "link").select(F.col("id").alias("doc"), lines.site_of(F.col("link")).alias("site"))
    docs = news.completed_texts(spark, folder).select("doc", "text").join(links, "doc", "left")
    places, _ = lines.repeated_lines(docs)
    return places.where("line_docs >= needed").select(F.col("doc").alias("article_id"), "line_no")


def _quality(spark: SparkSession, folder: str) -> DataFrame:
    return text_quality(materialize(news.completed_texts(spark, folder), "completed"), read_table(spark, folder, "common_words"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _quality(spark, folder).where("not_prose").select(F.col("doc").alias("article_id"))


def p6_stats(spark: SparkSession, folder: str) -> DataFrame:
    """All statistics of every COMPLETED article beside the stored word and sentence counts."""
    return _quality(spark, folder).withColumnRenamed("doc", "article_id").select("*", "extra.*").drop("extra")


def p6_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Words and the shares of lines and paragraphs that repeat earlier ones, of every COMPLETED article."""
    shares = [F.round(c, 6).alias(c) for c in ("duplicate_lines", "duplicate_paragraphs")]
    return _quality(spark, folder).select(F.col("doc").alias("article_id"), "words", *shares)


def p6_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The plain counts, by built-in expressions only, beside the stored ones."""
    words = function_words(read_table(spark, folder, "common_words"))
    text = F.coalesce("text", F.lit(""))
    rows = news.completed_texts(spark, folder).withColumn("t", F.array_remove(F.split(text, r"[ \n\r\t]+"), ""))
    return rows.select(
        F.col("doc").alias("article_id"), F.size("t").alias("words"), F.char_length(text).alias("chars"),
        F.size(F.filter("t", lambda x: F.lower(x).isin(words))).alias("common_words"),
        "article_length_words", "sentence_count",
        (F.col("article_length_words") != F.size("t")).alias("words_differ"),
    )


def _garbled(spark: SparkSession, folder: str) -> DataFrame:
    rows = materialize(news.current_scraped(spark, folder, "title", "content"), "current")
    fields = [rows.select("id", F.lit(c).alias("field_name"), F.col(c).alias("text")) for c in ("title", "content")]
    return encoding.garbled(fields[0].unionByName(fields[1]))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _garbled(spark, folder).select("id", "field_name")


def p7_restored(spark: SparkSession, folder: str) -> DataFrame:
    """The garbled fields with their text as far as it can be restored."""
    return _garbled(spark, folder).select("id", "field_name", "restored", "made", "lost")


def _leaks(spark: SparkSession, folder: str, spread: int = 0) -> DataFrame:
    docs = read_table(spark, folder, "documents").select(F.col("doc_id").alias("doc"), "text")
    items = read_table(spark, folder, "eval_items").select(F.col("item_id").alias("item"), "passage")
    return leaks(docs, items, spread=spread)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).where("longest >= needed").select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p8_items(spark: SparkSession, folder: str) -> DataFrame:
    """Each leaked item with the number of documents that hold it and the longest run found."""
    found = _leaks(spark, folder).where("longest >= needed")
    return found.groupBy(F.col("item").alias("item_id")).agg(F.count("*").alias("documents"), F.max("longest").alias("longest_run"))


def p8_near(spark: SparkSession, folder: str) -> DataFrame:
    """Proximity matches: rarest terms up to two words off their places; with the longest exact run."""
    found = _leaks(spark, folder, spread=2)
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), F.col("longest").alias("longest_run"))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents").select(F.col("doc_id").alias("doc"), "source", "text")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    per_source, _ = mixing.plan_mixture(mixing.whitespace_sizes(_documents(spark, folder)), read_table(spark, folder, "mix_targets"))
    return per_source.where("short").select("source")


def _mixture(spark: SparkSession, folder: str, tokenizer: str) -> tuple[DataFrame, DataFrame]:
    sizes = materialize(mixing.tokenizer_sizes(_documents(spark, folder), tokenizer), "sizes")
    per_source, per_length = mixing.plan_mixture(sizes, read_table(spark, folder, "mix_targets"))
    return per_source, mixing.select_mixture(sizes, per_source, per_length)


def p9_mixture(spark: SparkSession, folder: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """The documents of the mixture, in tokens of a public tokenizer, and how often each is taken."""
    return _mixture(spark, folder, tokenizer)[1].withColumnRenamed("doc", "doc_id")


def p9_shares(spark: SparkSession, folder: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """The shares reached by that mixture."""
    per_source, selected = _mixture(spark, folder, tokenizer)
    return mixing.mixture_report(selected, per_source)


def p9_check(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the documents selected, sized by white space, keep to shares, repeats and plan; all true, or it is wrong."""
    sizes = materialize(mixing.whitespace_sizes(_documents(spark, folder)), "sizes")
    per_source, per_length = mixing.plan_mixture(sizes, read_table(spark, folder, "mix_targets"))
    return mixing.mixture_check(mixing.select_mixture(sizes, per_source, per_length), per_source, sizes)


def p9_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Each source's documents and size in pieces between white space."""
    sizes = mixing.whitespace_sizes(_documents(spark, folder))
    return sizes.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("size"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncation(_documents(spark, folder)).where("cut").select(F.col("doc").alias("doc_id"))


def p10_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose whole text is a strict prefix of another one's."""
    texts = read_table(spark, folder, "documents").select(F.col("doc_id").alias("doc"), F.col("text").alias("body"))
    return truncation.strict_prefixes(texts).select(F.col("doc").alias("doc_id")).distinct()


def p10_rates(spark: SparkSession, folder: str) -> DataFrame:
    """How often each source's documents are cut, and at which length most often."""
    return truncation.truncation_rates(truncation.truncation(_documents(spark, folder)))


QUERIES = {
    "p2_found": p2_found,
    "p2_links": p2_links,
    "p3_found": p3_found,
    "p5_found": p5_found,
    "p5_clusters": p5_clusters,
    "p5_cleaned": p5_cleaned,
    "p5_cleaned_near": p5_cleaned_near,
    "p5_remains": p5_remains,
    "p6_found": p6_found,
    "p6_stats": p6_stats,
    "p6_duplicates": p6_duplicates,
    "p6_counts": p6_counts,
    "p7_found": p7_found,
    "p7_restored": p7_restored,
    "p8_found": p8_found,
    "p8_items": p8_items,
    "p8_near": p8_near,
    "p9_found": p9_found,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p9_check": p9_check,
    "p9_sizes": p9_sizes,
    "p10_found": p10_found,
    "p10_prefixes": p10_prefixes,
    "p10_rates": p10_rates,
}
