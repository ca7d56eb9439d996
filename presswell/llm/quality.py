"""Problem 6: text statistics per document, and which documents are not prose.

A text's blank-separated tokens fall into classes: each common function word
is one, then numbers, capitalised words, other words and anything else, each
with or without a comma or a sentence end. Two passes: the first counts class
bigrams over all texts, a table bounded by the number of classes; the second
measures each text whole, with that table.

Prose share: tokens are taken in blocks of ``BLOCK``; combined rules separate
prose from symbols and codes, from word lists and tables (few function words),
from menus and link lists (one pattern over and over), from repetition, and
from words in no order (class bigrams that prose hardly has). A text is a case
if less than ``LEAST_PROSE`` of its characters are words in blocks of prose,
or if it is mostly repetition as a whole, which blocks of otherwise good
sentences don't show: one n-gram covers more than ``DOMINANT`` of its
characters, or more than ``REPEATED`` of its lines, of its paragraphs or of
the characters of its 5-grams stood in it before.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswell.llm.neardup import chunks
from presswell.llm.shingles import mix

BLOCK = 20
NUMBER, CAPITAL, LOWER, FOREIGN, OTHER, KINDS = 0, 1, 2, 3, 4, 5
_U = np.uint64
_EDGE = "\"'“”‘’«»()[]{}<>.,;:!?…–—-/|"
_NUMBER = re.compile(r"[£€$]?\d[\d.,:/%½°-]*[a-z]{0,3}")
_PARAGRAPH = re.compile(r"\n\s*\n")

STATS = (
    "words int, chars int, sentences int, mean_word_length double, symbol_ratio double, punctuated_lines double, "
    "common_share double, duplicate_lines double, duplicate_paragraphs double, top_ngram_chars double, "
    "repeated_ngram_chars double, disorder double, prose_share double"
)


def _latin(word: str) -> bool:
    return all("a" <= c <= "z" or "À" <= c <= "ɏ" or c in "'’‑-" for c in word)


def token_kind(token: str, common: dict[str, int]) -> tuple[int, int, int]:
    """(class, letters, symbols) of one token; classes: 3 * kind + ending, common words after the other kinds."""
    letters = sum(unicodedata.category(c)[0] in "LM" for c in token)
    symbols = sum(unicodedata.category(c)[0] in "PSC" for c in token)
    core = token.strip(_EDGE)
    low = core.lower()
    tail = token.rstrip("\"'”’)]»")[-1:]
    ending = 2 if tail in (".", "!", "?") else 1 if tail in (",", ";", ":") else 0
    if low in common:
        kind = KINDS + common[low]
    elif not core:
        kind = OTHER
    elif _NUMBER.fullmatch(core):
        kind = NUMBER
    elif symbols - (len(token) - len(core)) > 2 or len(core) > 24:
        kind = OTHER
    elif _latin(low) and core[1:].replace("’", "").islower() | (len(core) == 1) | core.isupper():
        kind = CAPITAL if core[:1].isupper() and not core.isupper() else LOWER
    elif letters >= 0.8 * len(core) and any(c > "ɏ" for c in core):
        kind = FOREIGN
    elif _latin(low) and re.fullmatch(r"(?:[A-Z][’'a-zà-ɏ]*)+(?:[-‑][\w’']+)*|[a-z’']+(?:[-‑][\w’']+)+", core):
        kind = CAPITAL
    else:
        kind = OTHER
    return 3 * kind + ending, letters, symbols


class Tokens:
    """The blank-separated tokens of a chunk of texts as arrays."""

    def __init__(self, texts, common: dict[str, int]):
        lists = [t.split() if t else [] for t in texts]
        self.count = np.array([len(x) for x in lists], dtype=np.int64)
        flat = np.array([w for x in lists for w in x], dtype=object)
        self.doc = np.repeat(np.arange(len(lists)), self.count)
        self.start = np.cumsum(self.count) - self.count
        codes, unique = pd.factorize(flat) if len(flat) else (np.empty(0, np.int64), [])
        table = np.array([token_kind(w, common) for w in unique], dtype=np.int64).reshape(-1, 3)
        self.code, self.kind = codes, table[codes, 0]
        self.letters, self.symbols = table[codes, 1], table[codes, 2]
        self.length = np.array([len(w) for w in unique], dtype=np.int64)[codes] if len(flat) else np.empty(0, np.int64)
        self.classes = 3 * (KINDS + len(common))

    def bigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """(place of the second token, bigram number) within texts."""
        inner = np.flatnonzero(self.doc[1:] == self.doc[:-1]) + 1
        return inner, self.kind[inner - 1] * self.classes + self.kind[inner]

    def grams(self, values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(first token, hash with the text's number) of each n-gram within a text."""
        n = len(values) - width + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        h = mix(self.doc[:n].astype(np.uint64) + _U(1))  # mixed first: a number next to a word's must not make another's
        for k in range(width):
            h = mix(h ^ values[k : k + n].astype(np.uint64)) + _U(0x9E3779B97F4A7C15)
        at = np.flatnonzero(self.doc[:n] == self.doc[width - 1 :])
        return at, h[at]


def bigram_costs(texts: DataFrame, common: dict[str, int]) -> np.ndarray:
    """Minus the log-odds of each class bigram: log P(b) - log P(b | a), over all texts."""
    size = 3 * (KINDS + len(common))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size * size, dtype=np.int64)
        for frame in chunks(frames, "text"):
            _, pairs = Tokens(frame["text"], common).bigrams()
            total += np.bincount(pairs, minlength=size * size)
        found = np.flatnonzero(total)
        yield pd.DataFrame({"pair": found, "n": total[found]})

    rows = texts.select("text").mapInPandas(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    table = np.full(size * size, 0.0)
    for r in rows:
        table[r.pair] = r.n
    table = table.reshape(size, size)
    before, after, whole = table.sum(1, keepdims=True), table.sum(0, keepdims=True), max(1.0, table.sum())
    base = (after + 1) / (whole + size)
    return (np.log(base) - np.log((table + 5 * base) / (before + 5))).ravel()


def _repeats(at: np.ndarray, h: np.ndarray, size: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(how often each token's most frequent n-gram occurs, whether it is in an n-gram seen before)."""
    often, again = np.zeros(size, np.int64), np.zeros(size, bool)
    if len(at):
        _, first, inverse, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        later = np.ones(len(h), bool)
        later[first] = False
        for k in range(width):
            np.maximum.at(often, at + k, n[inverse])
            again[at[later] + k] = True
    return often, again


def measure(texts: list, common: dict[str, int], costs: np.ndarray) -> pd.DataFrame:
    """The statistics of a chunk of texts; all shares are 0 for NULL and for blank texts."""
    t = Tokens(texts, common)
    docs, n = len(texts), len(t.doc)
    per = lambda v: np.bincount(t.doc, weights=v, minlength=docs)
    chars = np.maximum(1, per(t.length))
    is_common = t.kind >= 3 * KINDS
    place, pairs = t.bigrams()
    odd = np.zeros(n)
    odd[place] = costs[pairs] if len(place) else 0
    pattern, _ = _repeats(*t.grams(t.kind // 3, 6), n, 6)
    _, again = _repeats(*t.grams(t.code, 5), n, 5)
    tops = np.zeros(docs)
    for width in (2, 3, 4):
        at, h = t.grams(t.code, width)
        if len(at):
            values, first, count = np.unique(h, return_index=True, return_counts=True)
            span = np.add.reduce([t.length[at[first] + k] for k in range(width)]) * count
            np.maximum.at(tops, t.doc[at[first]], np.where(count > 1, span, 0))

    # blocks
    index = np.arange(n) - t.start[t.doc]
    many = np.maximum(1, np.round(t.count / BLOCK)).astype(np.int64)
    block_of = np.minimum(index * many[t.doc] // np.maximum(1, t.count[t.doc]), many[t.doc] - 1)
    base = np.cumsum(many) - many
    block = base[t.doc] + block_of
    total = int(many.sum())
    sums = lambda v: np.bincount(block, weights=v, minlength=total)
    size = np.maximum(1, sums(np.ones(n)))
    length = np.maximum(1, sums(t.length))
    kind = t.kind // 3
    foreign = sums((kind == FOREIGN) * t.length) > 0.4 * length
    letters = sums(t.letters) / length
    words = sums((kind == LOWER) | (kind == CAPITAL) | is_common) / size
    usual = sums(is_common) / size
    strange = sums(odd) / size
    repeated = sums(again) / size
    ends = sums((t.kind % 3 == 2) & ((kind == LOWER) | (kind == CAPITAL) | is_common))
    listed = (sums(pattern >= LISTED) >= 0.6 * size) & (ends == 0)
    ordered = (words > 0.6) & (usual >= USUAL) & (strange < STRANGE) & ~listed
    prose = (letters > LETTERS) & (repeated < 0.6) & (foreign | ordered)
    held = np.bincount(np.repeat(np.arange(docs), many), weights=prose * sums(t.length * (kind != OTHER)), minlength=docs) / chars

    rows = []
    for text in texts:
        lines = [x.strip() for x in text.split("\n") if x.strip()] if text else []
        parts = [x.strip() for x in _PARAGRAPH.split(text) if x.strip()] if text else []
        rows.append((
            len(text or ""),
            sum(x.rstrip("\"'”’)")[-1:] in (".", "!", "?", "…") for x in lines) / max(1, len(lines)),
            1 - len(set(lines)) / max(1, len(lines)) if lines else 0.0,
            1 - len(set(parts)) / max(1, len(parts)) if parts else 0.0,
        ))
    line = np.array(rows, dtype=float).reshape(-1, 4)
    words_n = np.maximum(1, t.count)
    sentence_end = per((t.kind % 3 == 2).astype(float))
    open_end = np.zeros(docs)
    last = t.start + t.count - 1
    full = t.count > 0
    open_end[full] = t.kind[last[full]] % 3 != 2
    return pd.DataFrame({
        "words": t.count.astype(np.int32), "chars": line[:, 0].astype(np.int32), "sentences": (sentence_end + open_end).astype(np.int32),
        "mean_word_length": np.where(full, per(t.letters) / words_n, 0.0), "symbol_ratio": per(t.symbols) / chars, "punctuated_lines": line[:, 1],
        "common_share": per(is_common) / words_n, "duplicate_lines": line[:, 2], "duplicate_paragraphs": line[:, 3],
        "top_ngram_chars": np.minimum(1.0, tops / chars), "repeated_ngram_chars": per(again * t.length) / chars,
        "disorder": per(odd) / words_n, "prose_share": held,
    })


#: Limits of the block rules: a pattern's occurrences that make a list, the mean
#: log-odds beyond which class bigrams are out of order, the least share of
#: function words, the least share of letters among characters.
LISTED, STRANGE, USUAL, LETTERS = 6, 0.1, 0.1, 0.72
#: A text with less prose than this share of its characters is not prose.
LEAST_PROSE = 0.4
#: Shares beyond which a text is repetition: of its most frequent n-gram (prose of the test tables
#: has up to 0.14), and of lines, paragraphs and 5-grams seen before.
DOMINANT, REPEATED = 0.3, 0.5


def not_prose(repetition: bool = True) -> Column:
    """The combined rule over the statistics; without ``repetition`` the prose share alone, for comparison."""
    rule = F.col("prose_share") < LEAST_PROSE
    if repetition:
        rule = rule | (F.col("top_ngram_chars") > DOMINANT)
        for share in ("duplicate_lines", "duplicate_paragraphs", "repeated_ngram_chars"):
            rule = rule | (F.col(share) > REPEATED)
    return (F.col("words") > 0) & rule


#: So many function words at most: the table of class bigrams is (3 x (5 + so many)) squared, 78 MB.
MOST_COMMON = 1_000


def function_words(common: DataFrame) -> list[str]:
    """The different words (word) in lower case, in order; their number is checked."""
    found = [r[0] for r in common.select(F.lower("word")).where("word is not null").distinct().limit(MOST_COMMON + 1).collect()]
    if len(found) > MOST_COMMON:
        raise ValueError(f"common words are to be function words of a language, at most {MOST_COMMON:,}")
    return sorted(found)


def text_quality(texts: DataFrame, common: DataFrame) -> DataFrame:
    """(doc, statistics of STATS, extra, not_prose) of every row of ``texts`` (doc, text, ..).

    Other columns, whatever their names, come back in the struct ``extra``. Text that is NULL or blank has zeros
    everywhere and ``not_prose`` false: there is nothing in it. ``common`` has
    the column ``word``; its size is that of a language's function words and
    is checked (at most ``MOST_COMMON``).
    """
    table = {w: i for i, w in enumerate(function_words(common))}
    costs = texts.sparkSession.sparkContext.broadcast(bigram_costs(texts, table))

    extra = [c for c in texts.columns if c not in ("doc", "text")]
    packed = F.to_json(F.struct(*extra), {"ignoreNullFields": "false"}) if extra else F.lit(None).cast("string")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in chunks(frames, "text"):
            out = measure(list(frame["text"].where(frame["text"].notna(), None)), table, costs.value)
            out.insert(0, "doc", frame["doc"].to_numpy())
            out["extra"] = frame["extra"].to_numpy()
            yield out

    rows = texts.select("doc", "text", packed.alias("extra")).mapInPandas(run, f"doc long, {STATS}, extra string")
    if extra:
        kind = texts.select(F.struct(*extra).alias("extra")).schema["extra"].dataType
        rows = rows.withColumn("extra", F.from_json("extra", kind))
    else:
        rows = rows.drop("extra")
    return rows.withColumn("not_prose", not_prose())
