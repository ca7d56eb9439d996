"""Problem 10: texts cut off by field limits.

Two kinds of evidence. *Prefixes*: texts, without closing lines and cut marks,
are sorted as whole values over all tasks; a text that is a strict prefix of
any longer one is a prefix of the next different one in that order, so
comparing neighbours finds them all without making pairs, however many texts
begin alike. *Endings*: a cut text may have no longer copy anywhere, so the
end of every running text is looked at itself: one that stops without an end
of sentence was cut. Prefixes alone can't give that, and a prefix that ends
with its sentence is no case; they confirm cuts and show the lengths at which
a source cuts.

What closes a text (bylines, credits, calls to read on) is learned from the
corpus, not listed: numbers, names and links of a line are masked. An opening
of one to three tokens with which lines hardly ever end a sentence is a
closing one, and so is a whole line that recurs at the end of texts and that
most lines of its opening are. A cut line is unlike that: other lines that
open like it go on and end their sentences. Besides, a few forms are
closing by their build alone: labels, links, rules, small tables, signatures.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presswell.llm.neardup import chunks
from presswell.session import materialize

#: Marks put after a cut.
MARK = re.compile(r"\s*(?:\[?\s*(?:…|\.\.\.)\s*\]?(?:\s*\[\+?\d+ chars?\])?|\[\+\d+ chars?\]|�+|\(\s*cont(?:inue)?d?\b[^()]{0,30}\)?\.?)\s*$", re.IGNORECASE)
#: A text that ends with its sentence; closing quotes and brackets may follow.
END = re.compile(r"[.!?।॥。！？]['\"”’»)\]*]*$")
#: A token that is a link or an address.
LINK = re.compile(r"://|^www\.|\S@\S|\w\.[a-z]{2,}(?:/|\W*$)", re.IGNORECASE)
#: Forms that close a text by their build: begun with a sign, or a label of up to three words.
SIGN = re.compile(r"^[—–©•*#_=~|-]")
LABEL = re.compile(r"^\W*[^\W\d]+(?: [\w-]+){0,2} ?:(?: |$)")
#: Letter signatures and address lines: a name or place of one to three words.
NAME = re.compile(r"^[A-ZÀ-ÞŁ][\w’'-]*(?: [A-ZÀ-ÞŁ][\w’'-]*){0,2},?$")
#: An end of sentence with text after it.
WITHIN = re.compile(r"[.!?।]['\"”’)]*\s")
CELLS = re.compile(r"\s{2,}|\t|\s*\|\s*")
#: A single line without an end of sentence is a headline alone up to so many characters.
HEADLINE = 100
#: Marks and ends are looked for in so many characters at the end; they are shorter.
TAIL = 300
#: An opening is closing if it is found in so many texts, and such a share of them ...
LEAST_TEXTS, LEAST_SHARE = 3, 1e-4
#: ... and at least this share of the texts with such a line have none that ends a sentence.
UNFINISHED = 0.9
#: A whole line is closing if it makes up this share of its opening's texts.
ALIKE = 0.5


def _row(line: str) -> bool:
    """A row of a small table: three cells or more, divided by wide gaps or bars."""
    cells = CELLS.split(line.strip())
    return len(cells) > 2 and all(cells)


def masked(tokens: list[str]) -> list[str]:
    """Links, numbers and names as one mark each, other tokens in lower case.

    The first token is a name only if the second one begins with a capital
    letter as well, for every line begins with one.
    """
    out = []
    for i, w in enumerate(tokens):
        if LINK.search(w):
            out.append("L")
        elif any(c.isdigit() for c in w):
            out.append("0")
        elif w[:1].isupper() and (i or (len(tokens) > 1 and tokens[1][:1].isupper() and len(w) > 2)):
            out.append("N" + (w[-1] if not w[-1].isalnum() else ""))
        else:
            out.append(w.lower())
    return out


def line_keys(line: str, whole: bool) -> list[int]:
    """Hashes of a line's openings of one to three tokens; of the whole line too if ``whole``."""
    first = masked(line.split(None, 3)[:3])
    keys = [xxhash.xxh3_64_intdigest("\n".join(first[: k + 1])) for k in range(len(first))]
    return [*keys, xxhash.xxh3_64_intdigest("\n".join(["whole", *masked(line.split())]))] if whole else keys


def closing_lines(docs: DataFrame, least_texts: int = LEAST_TEXTS, least_share: float = LEAST_SHARE, unfinished: float = UNFINISHED) -> np.ndarray:
    """The hashes of openings and of whole lines that close texts, learned from all of ``docs`` (text), ascending.

    Each counts once per text; a whole line only as the last or last but one
    of texts of several lines. As each must be found in ``least_share``
    of the texts, at most so many reach the driver as a text has keys on
    average, divided by that share, however large the corpus.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in chunks(frames, "text"):
            keys: list[int] = []
            opened: list[bool] = []
            parts: dict[int, int] = {}
            for text in frame["text"]:
                lines = [x.strip() for x in text.split("\n") if x.strip()] if isinstance(text, str) else []
                seen: dict[int, bool] = {}
                for n, line in enumerate(lines):
                    last = n >= max(1, len(lines) - 2)
                    found = line_keys(line, last)
                    if last:
                        whole = found.pop()
                        seen[whole], parts[whole] = False, found[-1]
                    free = not END.search(line[-TAIL:])
                    for k in found:
                        seen[k] = seen.get(k, True) and free
                keys.extend(seen)
                opened.extend(seen.values())
            if keys:
                at, which = np.unique(np.array(keys, dtype=np.uint64), return_inverse=True)
                part = np.array([parts.get(k, 0) for k in at.tolist()], dtype=np.uint64)
                yield pd.DataFrame({"key": at.view(np.int64), "part": part.view(np.int64), "n": np.bincount(which), "open": np.bincount(which, weights=opened).astype(np.int64)})

    texts = docs.count()
    counted = docs.select("text").mapInPandas(count, "key long, part long, n long, open long")
    counted = counted.groupBy("key").agg(F.max_by("part", F.abs("part")).alias("part"), F.sum("n").alias("n"), F.sum("open").alias("open"))
    often = counted.where(F.col("n") >= max(least_texts, int(np.ceil(least_share * texts)))).collect()
    size = {r.key: r.n for r in often}
    good = [r.key for r in often if (r.n >= ALIKE * size[r.part] if r.part else r.open >= unfinished * r.n)]
    return np.sort(np.array(good, dtype=np.int64).view(np.uint64))


def _closes(line: str, learned: frozenset) -> bool:
    """Whether a last line (stripped) closes the text and is not part of it."""
    if any(k in learned for k in line_keys(line, True)):
        return True
    if line.startswith("©"):
        return True
    if WITHIN.search(line):
        return False
    return bool(SIGN.match(line) or LABEL.match(line) or (LINK.search(line) and len(line.split()) < 4))


def running_text(text: str | None, learned: frozenset = frozenset()) -> tuple[str, str, bool]:
    """(text without what closes it, kind of its end, whether a cut mark followed); ``learned`` are keys of closing lines.

    Kinds: ``none`` (no text, or a headline alone), ``sentence``, ``open``
    (it stops within a sentence), ``bare`` (it stops without an end of
    sentence, but its last paragraph has none at all, so that says nothing).
    """
    lines = (text or "").split("\n")
    total = sum(bool(x.strip()) for x in lines)
    while lines:
        last = lines[-1].strip()
        before = lines[-2].strip() if len(lines) > 1 else ""
        if last and NAME.match(last) and NAME.match(before) and len(lines) > 2:
            while lines and NAME.match(lines[-1].strip()):
                lines.pop()
        elif not last or (len(lines) > 1 and not MARK.search(last[-TAIL:]) and _closes(last, learned)):
            lines.pop()
        elif _row(lines[-1]) and len(lines) > 1:
            while lines and (_row(lines[-1]) or not lines[-1].strip()):
                lines.pop()
            if len(lines) > 1 and len(lines[-1].split()) <= 4 and not END.search(lines[-1].strip()[-TAIL:]):
                lines.pop()  # the table's heading
        else:
            break
    body = "\n".join(lines).rstrip()
    if not body:
        return "", "none", False
    ahead = max(0, len(body) - TAIL)  # marks and ends are short: a long text is not searched whole
    found = MARK.search(body[ahead:])
    if found:
        stop = body[: ahead + found.start()].rstrip()
        if stop:
            # an ellipsis may close a complete sentence: "... today. …" was cut between sentences
            whole = END.search(stop[-TAIL:]) and not found.group().startswith("...") and "�" not in found.group()
            return stop, "sentence" if whole else "open", True
        return "", "none", False
    last = body.rsplit("\n", 1)[-1].strip()
    if END.search(body[-TAIL:]):
        return body, "sentence", False
    within = WITHIN.search(last)
    if total == 1 and len(body) < HEADLINE and not within:
        return body, "none", False
    if not within and len(last.split()) > 40:
        return body, "bare", False
    return body, "open", False


def endings(docs: DataFrame) -> DataFrame:
    """(doc, source, body, size, kind, marked) of every row; see ``running_text``."""
    shared = docs.sparkSession.sparkContext.broadcast(closing_lines(docs))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        learned = frozenset(shared.value.tolist())
        for frame in chunks(frames, "text"):
            found = [running_text(t, learned) for t in frame["text"].where(frame["text"].notna(), None)]
            yield pd.DataFrame({
                "doc": frame["doc"].to_numpy(), "source": frame["source"].to_numpy(), "body": [b for b, _, _ in found],
                "size": frame["text"].str.len().fillna(0).astype("int32").to_numpy(), "kind": [k for _, k, _ in found], "marked": [m for _, _, m in found],
            })

    return docs.select("doc", "source", "text").mapInPandas(run, "doc long, source string, body string, size int, kind string, marked boolean")


def strict_prefixes(ended: DataFrame) -> DataFrame:
    """(doc) of every row whose body is a strict prefix of another body; an empty one is none.

    Only values are sorted, not rows: copies are dropped within each batch
    before the sort, what is left of them streams by, and rows find their
    value again by its hash.
    """
    rows = ended.where("body <> ''")
    schema = "value long, edge int, task int, body string"

    def different(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.drop_duplicates("value")

    def neighbours(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        before: tuple[int, str] | None = None
        first = None
        for frame in frames:
            out = []
            for value, body in zip(frame["value"], frame["body"], strict=True):
                if before is None:
                    first = body
                elif body != before[1] and body.startswith(before[1]):
                    out.append(before[0])
                before = (value, body)
            yield pd.DataFrame({"value": out, "edge": 0, "task": task, "body": None})
        if before is not None:  # the next task's first value decides on the last one here
            yield pd.DataFrame({"value": [before[0], 0], "edge": [1, 2], "task": task, "body": [before[1], first]})

    values = rows.select(F.xxhash64("body").alias("value"), "body").mapInPandas(different, "value long, body string")
    found = materialize(values.repartitionByRange("body").sortWithinPartitions("body").mapInPandas(neighbours, schema), "prefixes")
    firsts = found.where("edge = 2").select("task", F.col("body").alias("first"))
    following = firsts.select("task", F.lead("first").over(Window.orderBy("task")).alias("following"))  # one row a task
    last = found.where("edge = 1").select("task", "value", "body").join(following, "task")
    last = last.where(F.startswith("following", "body") & (F.col("following") != F.col("body"))).select("value")
    prefixes = found.where("edge = 0").select("value").unionByName(last).distinct()
    return rows.select("doc", F.xxhash64("body").alias("value")).join(prefixes, "value", "left_semi").select("doc")


def truncation(docs: DataFrame) -> DataFrame:
    """(doc, source, size, kind, marked, longer, cut) of every row of ``docs`` (doc, source, text).

    ``cut``: the running text stops within a sentence, or it stops without an
    end of sentence and a longer copy goes on. NULL, empty and blank texts and
    headlines alone are not cut. Repeated rows each count; other columns are
    ignored; a NULL source is a source of its own.
    """
    ended = materialize(endings(docs), "endings")
    longer = strict_prefixes(ended).distinct().withColumn("longer", F.lit(True))
    rows = ended.drop("body").join(longer, "doc", "left").withColumn("longer", F.coalesce("longer", F.lit(False)))
    cut = (F.col("kind") == "open") | ((F.col("kind") == "bare") & F.col("longer"))
    return rows.withColumn("cut", cut)


def truncation_rates(found: DataFrame) -> DataFrame:
    """Per source: texts, cut ones, those with a longer copy, and the commonest length of cut texts."""
    lengths = found.where("cut").groupBy("source", "size").agg(F.count("*").alias("n"))
    usual = lengths.groupBy("source").agg(F.max(F.struct("n", "size")).alias("m")).select(F.col("source").alias("s"), F.col("m.size").alias("usual_length"), F.col("m.n").alias("of_that_length"))
    rates = found.groupBy("source").agg(
        F.count("*").alias("documents"), F.count_if("cut").alias("cut_documents"),
        F.count_if(F.col("cut") & F.col("longer")).alias("confirmed"), F.round(F.avg(F.col("cut").cast("double")), 6).alias("rate"),
    )
    return rates.join(usual, rates["source"].eqNullSafe(usual["s"]), "left").drop("s")
