"""Problem 9: combine sources to target shares by subset-sum budget fitting.

Documents are counted by source and exact token length. A source's budget is
its share of the total; it is met by whole passes over the source, never more
than its ``max_repeats``, and a rest smaller than the source. The rest is cut
into the same fraction of every length, and what this leaves by a bounded
knapsack over the lengths still unused; where only documents longer than the
gap are left, one of them is taken and the surplus given back by the same
knapsack. Then so many documents of each length as the plan says are selected
by seeded hash order. A task holds one source's counts by length at a time;
documents never leave the executors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presswell.llm.neardup import chunks
from presswell.operators.lookup import looked_up
from presswell.session import materialize

#: The knapsack adds the last so many documents of usual length: the more alike their lengths, the more of them.
LEAST_FEW, MOST_FEW = 4, 64
#: It ends when so many items in a row reach no sum that was not reached before.
STALE = 256


def whitespace_sizes(docs: DataFrame) -> DataFrame:
    """(doc, source, tokens): pieces of the text between white space; NULL has none."""
    pieces = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"(?U)\s+"), "")
    return docs.select("doc", "source", F.size(pieces).cast("long").alias("tokens"))


def tokenizer_sizes(docs: DataFrame, path: str) -> DataFrame:
    """(doc, source, tokens) by the tokenizer file at ``path``, loaded once a worker; special strings are ordinary text."""
    loaded: dict = {}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if "t" not in loaded:
            from tokenizers import Tokenizer

            loaded["t"] = Tokenizer.from_file(path)
            loaded["t"].encode_special_tokens = True
        for frame in chunks(frames, "text"):
            texts = frame["text"].fillna("").tolist()
            n = [len(e.ids) for e in loaded["t"].encode_batch(texts, add_special_tokens=False)]
            yield pd.DataFrame({"doc": frame["doc"].to_numpy(), "source": frame["source"].to_numpy(), "tokens": n})

    return docs.select("doc", "source", "text").mapInPandas(run, "doc long, source string, tokens long")


def _knapsack(counts: dict[int, int], width: int) -> dict[int, int]:
    """How many of each length make a sum as near below ``width`` as is found; about 6 bytes of memory per unit of width.

    For every sum it is kept which item reached it first; that item came after
    those of the sum before it, so following them back uses no item twice.
    Lengths far apart come by turns, so sums of all sizes are reached soon; the
    search ends at the exact sum, or when ``STALE`` items in a row add no sum.
    """
    unit = math.gcd(*counts) if counts else 1
    width //= unit
    if width <= 0:
        return {}
    mask = (1 << (width + 1)) - 1
    lengths = np.array(sorted(counts), dtype=np.int64)
    items: list[tuple[int, int]] = []  # (length, copies), binary splitting
    for x in lengths[np.argsort(np.arange(len(lengths)) * 0.6180339887498949 % 1)].tolist():
        left, k = min(counts[x], width // (x // unit)), 1
        while left > 0:
            take = min(k, left)
            items.append((x // unit, take))
            left -= take
            k *= 2
    reached, by, idle = 1, np.full(width + 1, -1, dtype=np.int32), 0
    for at, (x, k) in enumerate(items):
        fresh = (reached << (x * k)) & mask & ~reached
        idle = 0 if fresh else idle + 1
        if fresh:
            bits = np.unpackbits(np.frombuffer(fresh.to_bytes(width // 8 + 1, "little"), np.uint8), bitorder="little")
            by[np.flatnonzero(bits)] = at
            reached |= fresh
        if fresh >> width & 1 or idle == STALE:
            break
    at, out = reached.bit_length() - 1, {}
    while at > 0:
        x, k = items[by[at]]
        out[x * unit] = out.get(x * unit, 0) + k
        at -= x * k
    return out


def _fill(counts: dict[int, int], target: int, reach: int) -> tuple[dict[int, int], int]:
    """(how many of each length, what is left of ``target``): large lengths first, the last ``reach`` by the knapsack."""
    plan: dict[int, int] = {}
    lengths = sorted(x for x, n in counts.items() if x > 0 and n > 0)
    for keep in (reach, 0):  # first without going below the reach, then as far as it goes
        for x in reversed(lengths):
            if target <= reach:
                break
            more = min(counts[x] - plan.get(x, 0), max(0, target - keep) // x)
            if more:
                plan[x] = plan.get(x, 0) + more
                target -= more * x
    last = _knapsack({x: counts[x] - plan.get(x, 0) for x in lengths if counts[x] > plan.get(x, 0)}, min(target, reach))
    for x, n in last.items():
        plan[x] = plan.get(x, 0) + n
        target -= x * n
    return plan, target


def fit(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents of each length: a sum as near below ``budget`` as can be found.

    ``counts`` holds the documents there are by length. A budget beyond their
    sum takes all. All but a few documents are taken in proportion from every
    length; the knapsack has these few to add, enough of them for sums of any
    size, and where that isn't exact, a longer document is taken and the
    surplus given back.
    """
    lengths = sorted(x for x, n in counts.items() if x > 0 and n > 0)
    total, most = sum(x * counts[x] for x in lengths), sum(counts[x] for x in lengths)
    if not total or budget <= 0:
        return {}
    if budget >= total:
        return {x: counts[x] for x in lengths}
    tenths, seen = [], 0
    for x in lengths:  # lengths that one tenth and nine tenths of the documents don't exceed: rare huge ones don't widen the knapsack
        seen += counts[x]
        if 10 * seen >= (9 if tenths else 1) * most:
            tenths.append(x)
        if len(tenths) == 2:
            break
    low, usual = tenths[0], tenths[-1]
    few = min(MOST_FEW, max(LEAST_FEW, -(-usual // max(1, usual - low)) + 1))
    aim = max(0, budget - few * usual)
    plan, carry = {}, 0
    for x in lengths:
        wanted = counts[x] * aim + carry
        plan[x] = min(counts[x], wanted // total)
        carry = min(wanted - plan[x] * total, total - 1)
    gap = budget - sum(x * n for x, n in plan.items())
    for x in reversed(lengths):
        if gap >= 0:
            break
        less = min(plan[x], -(gap // x))
        plan[x] -= less
        gap += less * x
    reach = (few + 2) * usual
    more, gap = _fill({x: counts[x] - plan[x] for x in lengths}, gap, reach)
    for x, n in more.items():
        plan[x] += n
    best: tuple[int, int, dict[int, int]] | None = None
    for x in lengths if gap else ():
        if x > gap and counts[x] > plan[x]:
            back, open_ = _fill({y: n for y, n in plan.items() if n and y != x}, x - gap, reach)
            if open_:  # the surplus can't be given back exactly: one document more of the least length that covers it
                cover = min((y for y, n in plan.items() if y >= open_ and n > back.get(y, 0) and y != x), default=None)
                if cover is None:
                    continue
                back[cover] = back.get(cover, 0) + 1
                open_ -= cover
            if best is None or -open_ < best[0]:
                best = (-open_, x, back)
            if not best[0]:
                break
    if best is not None and best[0] < gap:
        plan[best[1]] += 1
        for y, n in best[2].items():
            plan[y] -= n
    return {x: n for x, n in plan.items() if n}


_PLAN = "source string, target_share double, max_repeats int, available long, budget long, passes int, planned long, short boolean"


def plan_mixture(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(per source, per source and length) plan of a mixture.

    ``sizes`` has source and tokens, ``targets`` source, target_share and
    max_repeats, repeated rows counting once; rows with a NULL source are in
    no target. ``total`` is the size of the mixture, by default that of all
    documents. Per source: available, budget, passes, planned, and ``short``:
    even ``max_repeats`` passes are less than the share. The second frame
    (source, tokens, picks) says how many documents of each length have one
    copy more than there are passes. Sources are planned side by side, a
    source's counts by length in one task.
    """
    histogram = materialize(sizes.groupBy("source", "tokens").agg(F.count("*").alias("n")), "lengths")
    whole = histogram.agg(F.sum(F.col("tokens") * F.col("n"))).first()[0] or 0
    total = whole if total is None else total
    wanted = targets.where("source is not null").select("source", F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(0)).alias("repeats")).distinct()

    def plan(frame: pd.DataFrame) -> pd.DataFrame:
        source, share, repeats = frame["source"].iloc[0], float(frame["share"].iloc[0]), max(0, int(frame["repeats"].iloc[0]))
        known = frame[frame["n"].notna() & frame["tokens"].notna()]
        counts = {int(x): int(n) for x, n in zip(known["tokens"], known["n"], strict=True)}
        size = sum(x * n for x, n in counts.items())
        budget, short = round(share * total), size * repeats < share * total
        passes, rest = (repeats, 0) if short else divmod(budget, size) if size else (0, 0)
        if passes >= repeats:
            passes, rest = repeats, 0
        chosen = fit(counts, rest) if rest else {}
        planned = passes * size + sum(x * n for x, n in chosen.items())
        head = {"source": source, "target_share": share, "max_repeats": repeats, "available": size, "budget": budget, "passes": passes, "planned": planned, "short": short, "tokens": -1, "picks": 0}
        return pd.DataFrame([head, *({**head, "tokens": x, "picks": n} for x, n in chosen.items())])

    rows = wanted.join(histogram, "source", "left").groupBy("source", "share", "repeats").applyInPandas(plan, f"{_PLAN}, tokens long, picks long")
    rows = materialize(rows, "mixture-plan")
    return rows.where("tokens = -1").drop("tokens", "picks"), rows.where("tokens <> -1").select("source", "tokens", "picks")


def select_mixture(sizes: DataFrame, per_source: DataFrame, per_length: DataFrame, seed: int = 7) -> DataFrame:
    """(doc, source, tokens, copies) of all documents taken at least once.

    Among the documents of one source and length, those come first whose
    seeded hash is least. Ranks are made within small hash ranges and offset
    by the counts of the ranges before, so that no window holds a whole
    length of a hot source.
    """
    mine = looked_up(sizes, per_source.select("source", "passes"), ["source"])
    mark = F.xxhash64(F.lit(seed), "doc")
    hashed = mine.withColumns({"mark": mark, "part": F.shiftright(mark, 54)})
    picked = looked_up(hashed, per_length, ["source", "tokens"], "left").withColumn("picks", F.coalesce("picks", F.lit(0)))
    parts = hashed.groupBy("source", "tokens", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source", "tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most 1,024 rows
    offsets = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("source", "tokens", "part").orderBy("mark", "doc"))
    ranked = picked.withColumn("rank", rank).join(offsets, ["source", "tokens", "part"])
    extra = (F.col("before") + F.col("rank") <= F.col("picks")).cast("int")
    return ranked.select("doc", "source", "tokens", (F.col("passes") + extra).alias("copies")).where("copies > 0")


def mixture_report(selected: DataFrame, per_source: DataFrame) -> DataFrame:
    """Tokens taken and the share reached beside the plan, for every target source."""
    taken = selected.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("taken"), F.max("copies").alias("most_copies"))
    whole = taken.agg(F.sum("taken").alias("whole"))  # one row
    rows = per_source.join(taken, "source", "left").join(F.broadcast(whole))
    return rows.select(
        "source", "target_share", "max_repeats", "available", "budget", "passes", F.coalesce("taken", F.lit(0)).alias("taken"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "short",
        F.round(F.coalesce(F.col("taken"), F.lit(0)) / F.col("whole"), 6).alias("share_reached"),
    )


def mixture_check(selected: DataFrame, per_source: DataFrame, sizes: DataFrame) -> DataFrame:
    """(source, share_met, repeats_kept, as_planned) of every target source, from the documents selected.

    ``share_met``: the size taken falls short of the budget by less than the
    source's longest document, or is all there is if the source is short.
    """
    taken = selected.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("taken"), F.max("copies").alias("most"), F.count("*").alias("rows"), F.count_distinct("doc").alias("docs"))
    longest = sizes.groupBy("source").agg(F.max("tokens").alias("longest"))
    rows = per_source.join(taken, "source", "left").join(longest, "source", "left")
    size, gap = F.coalesce("taken", F.lit(0)), F.col("budget") - F.coalesce("taken", F.lit(0))
    met = F.when(F.col("short"), size == F.col("available") * F.col("max_repeats")).otherwise((gap == 0) | ((gap > 0) & (gap < F.coalesce("longest", F.lit(0)))))
    kept = (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")) & (F.coalesce("rows", F.lit(0)) == F.coalesce("docs", F.lit(0)))
    return rows.select("source", met.alias("share_met"), kept.alias("repeats_kept"), (size == F.col("planned")).alias("as_planned"))
