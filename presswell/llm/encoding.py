"""Problem 7: text that was decoded with the wrong character encoding.

A smoothed character trigram model is trained on the clean fields of all
records. Then each stretch of non-ASCII characters of a field is run through
every chain of encode and decode steps (one code page after another, up to
``STEPS`` of them, the last step UTF-8); the candidates are scored in their
surroundings, and the likeliest is accepted if it beats the stretch as it
stands by more than a margin. The margin is validated on every stretch of every
clean field, by cross-fitting: the fields fall into ``FOLDS`` parts, and those
of a part are scored by the counts of the others. The stretches are garbled by
every page and every pair of pages, and rightly written stretches that some
chain could undo all the same are made where a mark follows a letter, for any
other letter of the corpus and of the same case could stand there. The margin is
set where the share of the former that would be missed and that of the latter
that would be changed are least together.

Characters fall into a bounded number of classes, trigrams into a bounded table
and gains into bounded steps, so model and margin have one size whatever the
corpus; counts cover all of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswell.llm.neardup import chunks
from presswell.session import discard, materialize

#: Code pages text is wrongly read by.
PAGES = ("cp1252", "latin-1", "mac_roman", "cp1250", "cp1251", "iso8859_2", "cp1254", "cp1253", "cp1257", "iso8859_15", "cp437", "cp850", "cp866", "koi8_r", "mac_cyrillic")
STEPS = 3
CLASSES, BITS = 2048, 20
TABLE = 1 << BITS
SIDE = 3
SLOTS = 2 * TABLE + CLASSES
#: Parts of the clean fields, by the hash of the text; each is scored by a model of the others.
FOLDS = 4
#: Margins tried lie so far apart; gains beyond the last one are counted as beyond it.
STEP, TOP = 1 / 256, 256
BINS = int(TOP / STEP)
#: Places a task scores, about; each stands for some 200 garbled ones.
PLACES = 20_000
#: What stretches are garbled by: every page, every pair of pages, and one page three times.
CHAINS = (*((p,) for p in PAGES), *((p, q) for p in PAGES for q in PAGES), *((p, p, p) for p in PAGES))
#: Seams remembered, of 2 KB each, and characters, seams or places handled at once.
SEAMS, _AT_ONCE = 20_000, 2_000
RUN = re.compile(r"[^\x00-\x7f]+")
#: What no rightly decoded news text has: the replacement character and C1 controls.
BROKEN = re.compile("[�\x80-\x84\x86-\x9f]")
_U = np.uint64


@lru_cache(maxsize=None)
def encoder(page: str) -> dict[str, int]:
    """Character to byte of a code page; bytes it leaves undefined stand for the C1 control of that number, as readers do."""
    table = {}
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(page)
        except UnicodeDecodeError:
            c = chr(b)
        table.setdefault(c, b)
    return table


@lru_cache(maxsize=None)
def decoder(page: str) -> dict[int, str]:
    return {b: c for c, b in encoder(page).items()}


def garble(text: str, page: str) -> str:
    """UTF-8 bytes of ``text`` read by a code page."""
    table = decoder(page)
    return "".join(chr(b) if b < 128 else table.get(b, chr(b)) for b in text.encode("utf-8", "surrogatepass"))


def undo(run: str, page: str) -> str | None:
    """One step back: every valid UTF-8 sequence in the run's bytes becomes its character; None if there is none."""
    table = encoder(page)
    data = [table.get(c) for c in run]
    out, i, found = [], 0, False
    while i < len(run):
        b = data[i]
        size = 0 if b is None else 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 0
        part = data[i : i + size]
        if size and len(part) == size and all(x is not None and 0x80 <= x <= 0xBF for x in part[1:]):
            try:
                out.append(bytes(part).decode("utf-8"))
                i, found = i + size, True
                continue
            except UnicodeDecodeError:
                pass
        out.append(run[i])
        i += 1
    return "".join(out) if found else None


def candidates(run: str) -> tuple[str, ...]:
    """All results of chains of up to STEPS steps, each once."""
    return _remembered(run) if len(run) <= 64 else _chains(run)


def _chains(run: str) -> tuple[str, ...]:
    seen: dict[str, None] = {}
    edge = [run]
    for _ in range(STEPS):
        step = []
        for text in edge:
            for page in PAGES:
                back = undo(text, page)
                if back is not None and back != run and back not in seen:
                    seen[back] = None
                    step.append(back)
        edge = step
    return tuple(seen)


_remembered = lru_cache(maxsize=100_000)(_chains)


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of each code point: characters of the Latin and punctuation blocks are classes of their own, other scripts fall into blocks."""
    points = np.arange(0x110000)
    table = 1200 + (points >> 7) % 800
    table[points < 0x250] = points[points < 0x250]
    marks = (points >= 0x2000) & (points < 0x2150)
    table[marks] = 0x250 + (points[marks] - 0x2000)
    table[ord("0") : ord("9") + 1] = ord("0")
    return table.astype(np.int64)


def classes_of(text: str) -> np.ndarray:
    return class_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]


def _slots(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table slots of the trigrams and of the bigrams of a class sequence."""
    wide = c.astype(np.uint64)
    two = (wide[:-1] * _U(CLASSES) + wide[1:]) * _U(0x9E3779B97F4A7C15)
    three = ((wide[:-2] * _U(CLASSES) + wide[1:-1]) * _U(CLASSES) + wide[2:] + _U(1)) * _U(0xD6E8FEB86659FD93)
    return (three >> _U(64 - BITS)).astype(np.int64), (two >> _U(64 - BITS)).astype(np.int64)


class Model:
    """Interpolated trigram, bigram and unigram probabilities of character classes."""

    def __init__(self, three: np.ndarray, two: np.ndarray, one: np.ndarray):
        self.three, self.two, self.one = three, two, one
        self.whole = max(1.0, float(one.sum()))

    def unseen(self, text: str) -> int:
        """How many characters are of classes that clean text doesn't have."""
        return int((self.one[classes_of(text)] == 0).sum())

    def _costs(self, c: np.ndarray) -> np.ndarray:
        """Minus the log probability of every class of a sequence but the first two."""
        t, b = _slots(c)
        # slots are shared; no n-gram is more frequent than its parts, and an unseen class has none
        one = self.one[c]
        two = np.minimum(self.two[b], np.minimum(one[:-1], one[1:]))
        three = np.minimum(self.three[t], np.minimum(two[:-1], two[1:]))
        p1 = (one[2:] + 0.2) / (self.whole + 0.2 * CLASSES)
        p2 = (two[1:] + 20 * p1) / (one[1:-1] + 20)
        p3 = (three + 5 * p2) / (two[:-1] + 5)
        return -np.log(p3)

    def cost(self, text: str) -> float:
        """Minus the log probability of all characters but the first two, which are context."""
        return float(self._costs(classes_of(text)).sum()) if len(text) > 2 else 0.0

    def costs(self, texts: list[str]) -> np.ndarray:
        """``cost`` of each text."""
        size = np.array([len(t) for t in texts], dtype=np.int64)
        if size.sum() < 3:
            return np.zeros(len(texts))
        whose = np.repeat(np.arange(len(texts)), size)
        single = self._costs(classes_of("".join(texts)))
        inner = whose[2:] == whose[:-2]
        return np.bincount(whose[2:][inner], weights=single[inner], minlength=len(texts))


def suspicious(text: str) -> bool:
    """Whether a field can't serve as clean: broken characters, or a stretch some chain can undo."""
    return bool(BROKEN.search(text)) or any(candidates(r) for r in set(RUN.findall(text)))


def tally(fields: DataFrame) -> DataFrame:
    """Over every clean field (text), by fold: how often each slot is met, and with slot -1 each different place of a stretch, -2 each letter, small and capital."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((FOLDS, SLOTS), dtype=np.int64)
        for frame in chunks(frames, "text"):
            places: dict[tuple[int, str, str, str], None] = {}
            for fold, texts in frame.groupby("fold")["text"]:
                clean = [t for t in texts if t and not suspicious(t)]
                if not clean:
                    continue
                c = classes_of("\n\n" + "\n\n".join(clean))
                t, b = _slots(c)
                total[fold, :TABLE] += np.bincount(t, minlength=TABLE)
                total[fold, TABLE : 2 * TABLE] += np.bincount(b, minlength=TABLE)
                total[fold, 2 * TABLE :] += np.bincount(c, minlength=CLASSES)
                for text in clean:
                    for m in RUN.finditer(text):
                        places[fold, text[max(0, m.start() - SIDE) : m.start()], m.group(), text[m.end() : m.end() + SIDE]] = None
            letters = letters_of(run for _, _, run, _ in places)
            rows = [(fold, -1, 1, before, run, after) for fold, before, run, after in places] + [(0, -2, 1, "", letter, "") for letter in letters]
            yield pd.DataFrame(rows, columns=["fold", "slot", "n", "before", "run", "after"])
        fold, slot = np.nonzero(total)
        yield pd.DataFrame({"fold": fold, "slot": slot, "n": total[fold, slot], "before": "", "run": "", "after": ""})

    folded = fields.select("text", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"))
    rows = folded.mapInPandas(count, "fold int, slot int, n long, before string, run string, after string")
    return rows.groupBy("fold", "slot", "before", "run", "after").agg(F.sum("n").alias("n"))


class Counts(NamedTuple):
    """How often the slots were met, by fold: slots and numbers."""

    parts: list[tuple[np.ndarray, np.ndarray]]

    def model(self, without: int | None = None) -> Model:
        """The model of all clean fields, or of all but those of a fold."""
        total = np.zeros(SLOTS, dtype=np.float64)
        for fold, (slot, n) in enumerate(self.parts):
            if fold != without:
                total[slot] += n
        return Model(total[:TABLE], total[TABLE : 2 * TABLE], total[2 * TABLE :])


def counts_of(tallied: DataFrame) -> Counts:
    rows = tallied.where("slot >= 0").select("fold", "slot", "n").toPandas()
    return Counts([(part["slot"].to_numpy(np.int32), part["n"].to_numpy()) for part in (rows[rows["fold"] == k] for k in range(FOLDS))])


def gain(model: Model, before: str, run: str, candidate: str, after: str) -> float:
    """How much likelier the candidate is than the run in the same place."""
    left = ("\n\n" + before)[-SIDE:]
    return model.cost(left + run + after) - model.cost(left + candidate + after)


def fitting(model: Model, run: str) -> list[str]:
    """The candidates that may stand for a run: one with characters that clean text never has must have fewer of them than the run."""
    strange = model.unseen(run)
    return [c for c in candidates(run) if not (u := model.unseen(c)) or u < strange]


def best(model: Model, text: str, start: int, end: int) -> tuple[float, str]:
    """The likeliest candidate for text[start:end] and its gain."""
    run, before, after = text[start:end], text[max(0, start - SIDE) : start], text[end : end + SIDE]
    return max(((gain(model, before, run, c, after), c) for c in fitting(model, run)), default=(0.0, run))


@lru_cache(maxsize=None)
def _reading(page: str) -> tuple[dict[int, str], bytes]:
    """Characters a page's bytes are read as, and the bytes that come back from them."""
    read = {b: decoder(page).get(b, chr(b)) for b in range(128, 256)}
    return read, bytes(b for b, c in read.items() if encoder(page).get(c) == b)


def _misread(text: str, page: str) -> str | None:
    """``garble`` of non-ASCII text; None if ``undo`` doesn't give the text back."""
    read, kept = _reading(page)
    try:
        data = text.encode("utf-8")
    except UnicodeEncodeError:
        return None
    return None if data.translate(None, kept) else data.decode("latin-1").translate(read)


_PREFIXES = sorted({chain[:k] for chain in CHAINS for k in range(1, len(chain) + 1)}, key=len)


def texts_of(c: str) -> list[str]:
    """What a character becomes by every chain; empty if that can't be undone."""
    read: dict[tuple[str, ...], str | None] = {(): c}
    for chain in _PREFIXES:
        before = read[chain[:-1]]
        read[chain] = None if before is None else _misread(before, chain[-1])
    return [read[chain] or "" for chain in CHAINS]


class Readings(NamedTuple):
    """Of a character's texts by chain: the classes of the first and last two characters, a name that equal texts share, and whether they can be undone."""

    head: np.ndarray
    tail: np.ndarray
    name: np.ndarray
    kept: np.ndarray


@lru_cache(maxsize=20_000)
def readings(c: str) -> Readings:
    texts = texts_of(c)
    ends = classes_of("".join(t[:2] + t[-2:] if t else "    " for t in texts)).astype(np.int16).reshape(-1, 4)
    name = pd.util.hash_array(np.array([c + t for t in texts], dtype=object), categorize=False)
    return Readings(ends[:, :2], ends[:, 2:], name, np.array([t != "" for t in texts]))


class Garbler:
    """Costs of stretches garbled by every chain.

    A chain reads each character by itself, as two characters or more, so the
    cost of a garbled stretch is the sum of costs within its characters' texts
    and of those at the seams: the first two characters after a seam, given
    the two before it. Seams with the surroundings are alike.
    """

    def __init__(self, model: Model):
        self.model = model
        self.within: dict[str, np.ndarray] = {}
        self.seams: dict[tuple[str, str], np.ndarray] = {}

    @staticmethod
    def _ends(unit: str, tail: bool) -> np.ndarray:
        """Classes of the two characters of a unit next to a seam: a non-ASCII character as read by every chain, other texts as they are."""
        if len(unit) == 1 and ord(unit) > 127:
            return readings(unit).tail if tail else readings(unit).head
        return np.broadcast_to(classes_of(unit.ljust(2)), (len(CHAINS), 2))

    def know(self, seams: Iterable[tuple[str, str]]) -> None:
        """Have the costs of these seams at hand."""
        new = list(dict.fromkeys(s for s in seams if s not in self.seams))
        if len(self.seams) + len(new) > SEAMS:
            self.seams.clear()
            new = list(dict.fromkeys(seams))
        for k in range(0, len(new), 256):
            some = new[k : k + 256]
            c = np.concatenate([np.stack([self._ends(x, True) for x, _ in some]), np.stack([self._ends(y, False) for _, y in some])], axis=2)
            cost = np.append([0.0, 0.0], self.model._costs(c.ravel())).reshape(c.shape)[:, :, 2:]
            whole = np.array([len(y) > 1 or ord(y) > 127 for _, y in some])
            self.seams.update(zip(some, cost[:, :, 0] + cost[:, :, 1] * whole[:, None], strict=True))

    def cost(self, run: str) -> np.ndarray:
        """Costs of a garbled stretch but for its outer seams, by chain."""
        total = np.zeros(len(CHAINS))
        for c in run:
            if c not in self.within:
                if len(self.within) >= SEAMS:
                    self.within.clear()
                self.within[c] = self.model.costs(texts_of(c))
            total += self.within[c]
        for k in range(0, len(run) - 1, _AT_ONCE):
            seams = list(zip(run[k : k + _AT_ONCE], run[k + 1 : k + 1 + _AT_ONCE], strict=False))
            self.know(seams)
            for seam in seams:
                total += self.seams[seam]
        return total

    def gains(self, places: list[tuple[str, str, str]]) -> Iterator[np.ndarray]:
        """How much likelier each place's stretch is than what it becomes by each chain that can be undone; of chains alike for a stretch one counts."""
        for k in range(0, len(places), _AT_ONCE):
            some = [(("\n\n" + before)[-2:], run, after[:2]) for before, run, after in places[k : k + _AT_ONCE]]
            right = self.model.costs([before + run + after for before, run, after in some])
            at: dict[str, list[int]] = {}
            for i, (_, run, _) in enumerate(some):
                at.setdefault(run, []).append(i)
            inner = {run: (chains, self.cost(run)[chains]) for run in at if len(chains := self.different(run))}
            self.know([seam for before, run, after in some for seam in self._outer(before, run, after)])
            for run, (chains, within) in inner.items():
                for i in at[run]:
                    yield sum((self.seams[seam][chains] for seam in self._outer(*some[i])), within) - right[i]

    @staticmethod
    def _outer(before: str, run: str, after: str) -> list[tuple[str, str]]:
        return [(before, run[0]), (run[-1], after)] if after else [(before, run[0])]

    @staticmethod
    def different(run: str) -> np.ndarray:
        """The chains that can be undone, one for each different text the stretch becomes."""
        kept, name = np.ones(len(CHAINS), dtype=bool), np.zeros(len(CHAINS), dtype=np.uint64)
        for c in set(run):
            kept &= readings(c).kept
            name += readings(c).name
        chains = np.flatnonzero(kept)
        return chains[np.unique(name[chains], return_index=True)[1]]


def letters_of(stretches: Iterable[str]) -> frozenset[str]:
    """The non-ASCII letters of stretches, small and capital."""
    return frozenset(v for c in set().union(*stretches) if c.isalpha() for v in (c, c.upper(), c.lower()) if len(v) == 1 and ord(v) > 127)


def rightly_written(before: str, run: str, letters: frozenset[str]) -> list[tuple[str, str]]:
    """(before, stretch) that some chain could undo: where a mark follows a letter, any other of the letters of the same case."""
    out = []
    for i, (last, c) in enumerate(zip(before[-1:].rjust(1) + run, run, strict=False)):
        if last.isalpha() and not c.isalpha():
            for letter in _undoable(c, letters):
                if letter != last and letter.isupper() == last.isupper():
                    out.append((before, run[: i - 1] + letter + run[i:]) if i else (before[:-1], letter + run))
    return out


@lru_cache(maxsize=10_000)
def _undoable(mark: str, letters: frozenset[str]) -> list[str]:
    return [letter for letter in sorted(letters) if candidates(letter + mark)]


def binned(gains: np.ndarray) -> np.ndarray:
    """How many gains lie above the margin one ``STEP`` below and not above the margin of each bin."""
    return np.bincount(np.clip(np.ceil(gains / STEP), 0, BINS).astype(np.int64), minlength=BINS + 1)


def gains_at(garbler: Garbler, places: list[tuple[str, str, str]], letters: frozenset[str]) -> tuple[np.ndarray, np.ndarray]:
    """``binned`` gains of undoing all garbled stretches at places (before, stretch, after), and of the likeliest change of all rightly written ones."""
    true = np.zeros(BINS + 1, dtype=np.int64)
    gains = garbler.gains(places)
    while some := list(islice(gains, _AT_ONCE)):
        true += binned(np.concatenate(some))
    model, fits, wrongs = garbler.model, {}, []
    for before, run, after in places:
        for left, stretch in rightly_written(before, run, letters):
            if stretch not in fits:
                fits[stretch] = fitting(model, stretch)
            if fits[stretch]:
                wrongs.append(max(gain(model, left, stretch, c, after) for c in fits[stretch]))
    return true, binned(np.array(wrongs))


class Calibration(NamedTuple):
    """The margin, and what it was found by: stretches tried and the share of garbled ones missed and of clean ones changed."""

    margin: float
    garbled: int
    missed: float
    clean: int
    changed: float


def margin_of(true: np.ndarray, false: np.ndarray) -> Calibration:
    """The margin by ``binned`` gains of garbled and of rightly written stretches; 3 if there is nothing to go by."""
    garbled, clean = int(true.sum()), int(false.sum())
    if not garbled:
        return Calibration(3.0, 0, 0.0, clean, 0.0)
    # margins without a gain between them split all alike: of the widest of the best such intervals take the point a quarter
    # of the way up, for the clean stretches made here are harder than those of real text
    least = int(1 / STEP)
    missed = np.cumsum(true)[least:BINS] / garbled
    changed = 1 - np.cumsum(false)[least:BINS] / clean if clean else np.zeros(BINS - least)
    total = np.round(missed + changed, 12)
    starts = np.flatnonzero(np.append(True, (true + false)[least + 1 : BINS] > 0))
    width = np.diff(np.append(starts, len(total)))
    k = max(np.flatnonzero(total[starts] == total.min()), key=lambda i: width[i])
    at = starts[k] + (width[k] - 1) // 4
    return Calibration(float((least + at) * STEP), garbled, float(missed[at]), clean, float(changed[at]))


def calibrate(model: Model, places: list[tuple[str, str, str]]) -> Calibration:
    """Set the margin by places (before, stretch, after) of clean text the model has not seen."""
    return margin_of(*gains_at(Garbler(model), places, letters_of(run for _, run, _ in places)))


def cross_fitted(tallied: DataFrame, counts: Counts) -> Calibration:
    """The margin by all places of all folds, each scored by the counts of the other folds."""
    spark = tallied.sparkSession
    letters = frozenset(r.run for r in tallied.where("slot = -2").select("run").distinct().collect())
    shared = spark.sparkContext.broadcast((counts, letters))

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, letters = shared.value
        at, garbler = None, None
        total = np.zeros((2, BINS + 1), dtype=np.int64)
        for frame in frames:
            for fold, part in frame.groupby("fold"):
                if fold != at:
                    at, garbler = fold, Garbler(counts.model(without=fold))
                total += gains_at(garbler, list(zip(part["before"], part["run"], part["after"], strict=True)), letters)
        kind, bin_ = np.nonzero(total)
        yield pd.DataFrame({"kind": kind, "bin": bin_, "n": total[kind, bin_]})

    # places of one fold and stretch lie together, for they share seams
    places = tallied.where("slot = -1").select("fold", "run", "after", "before")
    tasks = max(spark.sparkContext.defaultParallelism, -(-places.count() // PLACES))
    spread = places.repartitionByRange(tasks, "fold", "run", "after", "before").sortWithinPartitions("fold", "run", "after", "before")
    rows = spread.mapInPandas(score, "kind int, bin int, n long").groupBy("kind", "bin").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros((2, BINS + 1), dtype=np.int64)
    total[rows["kind"].to_numpy(), rows["bin"].to_numpy()] = rows["n"].to_numpy()
    return margin_of(*total)


def fitted(fields: DataFrame) -> tuple[Model, Calibration]:
    """The model, trained on all clean fields, and the margin, validated on all places of them by models that have not seen them."""
    tallied = materialize(tally(fields), "p7_tally")
    counts = counts_of(tallied)
    found = cross_fitted(tallied, counts)
    discard(tallied)
    return counts.model(), found


def repair(model: Model, margin: float, text: str) -> tuple[str, int, int]:
    """(text with all accepted restorations, how many were made, how many garbled stretches can't be restored)."""
    out, at, made, lost = [], 0, 0, 0
    for m in RUN.finditer(text):
        score, candidate = best(model, text, m.start(), m.end()) if candidates(m.group()) else (0.0, m.group())
        accepted = candidate if score > margin else m.group()
        made += accepted != m.group()
        lost += bool(BROKEN.search(accepted))
        out.append(text[at : m.start()] + accepted)
        at = m.end()
    return "".join(out) + text[at:], made, lost


def garbled(fields: DataFrame) -> DataFrame:
    """(id, field_name, text, restored, made, lost) of the fields with garbled text.

    ``fields`` has id, field_name and text; other columns are ignored.
    ``restored`` is the text as far as it can be restored; where characters
    are lost (replacement characters), ``lost`` counts the stretches. NULL and
    empty texts are not garbled. Repeated rows each come out. Without clean
    text to learn from, only what is broken beyond doubt comes out.
    """
    spark = fields.sparkSession
    present = fields.where("text is not null and text <> ''")
    model, found = fitted(present)
    shared = spark.sparkContext.broadcast((model, found.margin))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in chunks(frames, "text"):
            model, margin = shared.value
            rows = []
            for key, name, text in zip(frame["id"], frame["field_name"], frame["text"], strict=True):
                restored, made, lost = repair(model, margin, text)
                if made or lost:
                    rows.append((key, name, text, restored, made, lost))
            yield pd.DataFrame(rows, columns=["id", "field_name", "text", "restored", "made", "lost"])

    # ASCII fields have nothing to undo; the test runs before any row goes to Python
    odd = present.where(F.col("text").rlike(r"[^\x00-\x7F]")).select("id", "field_name", "text")
    return odd.mapInPandas(run, "id long, field_name string, text string, restored string, made int, lost int")
