from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from presswell.operators.ledger import StaleLease, WorkLedger
from presswell.operators.rolling import densify, trailing
from presswell.plans.incremental import finished_versions, source_versions
from presswell.plans.rolling import entity_calendar, entity_days, weekly_averages

ITEMS = "item_id long, version long"


class Clock:
    now = datetime(2026, 1, 1)

    def __call__(self):
        return self.now

    def later(self, seconds):
        self.now += timedelta(seconds=seconds)


@pytest.fixture
def clock():
    return Clock()


@pytest.fixture
def ledger(spark, tmp_path, clock):
    return WorkLedger(spark, f"file://{tmp_path}/ledger", clock=clock, compact_every=4)


def ids(df):
    return sorted(r[0] for r in df.collect())


def items(spark, *rows):
    return spark.createDataFrame(list(rows), ITEMS)


def test_new_changed_and_unfinished_once(spark, ledger):
    ledger.sync(items(spark, (1, 10), (2, 20), (3, 30), (3, 30), (None, 1)), items(spark, (1, 10), (2, 99)))
    assert ids(ledger.pending()) == [2, 3]
    ledger.sync(items(spark, (1, 10), (2, 20), (3, 30)), items(spark, (1, 10), (2, 99)))  # repeated
    assert ids(ledger.pending()) == [2, 3]
    token = ledger.lease(60)
    assert ids(ledger.pending()) == [] and ids(ledger.leased(token)) == [2, 3]
    ledger.complete(token)
    ledger.sync(items(spark, (1, 10), (2, 20), (3, 30)), items(spark, (1, 10)))  # downstream lags behind
    assert ids(ledger.pending()) == []
    ledger.sync(items(spark, (1, 11), (2, 20), (3, 30)), items(spark, (1, 10)))  # item 1 changed
    assert ids(ledger.pending()) == [1]


def written(ledger):
    found = ledger.outputs()
    return [] if found is None else sorted((r.item_id, r.version) for r in found.collect())


def test_expired_lease_and_stale_writer(spark, ledger, clock):
    ledger.sync(items(spark, (1, 1), (2, 2)), items(spark))
    slow = ledger.lease(60)
    ledger.write_output(slow, ledger.leased(slow))
    clock.later(61)
    assert ids(ledger.pending()) == [1, 2]
    quick = ledger.lease(60)
    ledger.write_output(quick, ledger.leased(quick))
    ledger.write_output(quick, ledger.leased(quick))  # a retry
    for late in (lambda: ledger.complete(slow), lambda: ledger.write_output(slow, items(spark, (1, 1)))):
        with pytest.raises(StaleLease):
            late()
    ledger.complete(quick)
    for late in (lambda: ledger.complete(quick), lambda: ledger.write_output(quick, items(spark, (1, 1)))):
        with pytest.raises(StaleLease):
            late()
    assert written(ledger) == [(1, 1), (2, 2)]
    with pytest.raises(ValueError):
        ledger.write_output(quick, spark.createDataFrame([(1,)], "id long"))


def test_changed_item_is_delivered_in_its_last_version_only(spark, ledger):
    source = [(1, 10), (2, 20)]
    for version in (10, 11):
        ledger.sync(items(spark, (1, version), (2, 20)), items(spark))
        if version == 11:
            assert written(ledger) == source  # pending again: the old version is still the last one done
        token = ledger.lease(60)
        ledger.write_output(token, ledger.leased(token))
        ledger.complete(token)
        assert written(ledger) == [(1, version), (2, 20)]
    assert [(r.item_id, r.version) for r in ledger.output_of(token).collect()] == [(1, 11)]
    assert ledger.output_of(9999) is None


def test_item_changed_while_leased_comes_from_the_later_lease(spark, ledger):
    ledger.sync(items(spark, (1, 10), (2, 20)), items(spark))
    first = ledger.lease(60)
    ledger.write_output(first, ledger.leased(first))
    ledger.sync(items(spark, (1, 11), (2, 20)), items(spark))
    ledger.complete(first)
    assert written(ledger) == [(2, 20)] and ids(ledger.pending()) == [1]
    second = ledger.lease(60)
    ledger.write_output(second, ledger.leased(second))
    ledger.complete(second)
    assert written(ledger) == [(1, 11), (2, 20)]


def test_lease_taken_over_in_part(spark, ledger, clock):
    ledger.sync(items(spark, (1, 10), (2, 20), (3, 30)), items(spark))
    slow = ledger.lease(60)
    ledger.write_output(slow, ledger.leased(slow))
    clock.later(61)
    part = ledger.lease(60, part=F.col("item_id") == 1)
    ledger.write_output(part, ledger.leased(part))
    ledger.complete(part)
    assert written(ledger) == [(1, 10)]
    ledger.complete(slow)
    assert written(ledger) == [(1, 10), (2, 20), (3, 30)]


def test_adopted_items_are_done(spark, ledger):
    ledger.adopt(items(spark, (1, 10), (2, 20), (None, 3)))
    ledger.sync(items(spark, (1, 10), (2, 21), (3, 30)))
    ledger.adopt(items(spark, (1, 10)))
    assert ids(ledger.pending()) == [2, 3] and ledger.outputs() is None


#: Every file operation of sync, lease, write_output and complete, by its number; dying after a write is dying before what follows it.
DEATHS = [("changed", n, False) for n in (1, 2, 3, 4)] + [("publish", n, after) for n in (1, 2, 3) for after in (False, True)] + [("rename", 1, False), ("rename", 1, True)]


@pytest.mark.parametrize("step,nth,after", DEATHS)
def test_death_between_any_two_file_operations(spark, tmp_path, clock, step, nth, after, monkeypatch):
    """A worker dies at one of its file operations; a later one must deliver every item once."""
    from pyspark.sql.readwriter import DataFrameWriter

    from presswell.sources.commits import Files

    class Died(Exception):
        pass

    owner, name = (DataFrameWriter, "parquet") if step == "changed" else (Files, step)
    whole = getattr(owner, name)
    left = [0]

    def dying(self, *args, **options):
        left[0] -= 1
        if left[0] == 0 and not after:
            raise Died
        out = whole(self, *args, **options)
        if left[0] == 0:
            raise Died
        return out

    monkeypatch.setattr(owner, name, dying)
    source = items(spark, (1, 10), (2, 20))
    left[0] = nth
    with pytest.raises(Died):
        run = WorkLedger(spark, str(tmp_path / "w"), clock=clock)  # a path without a scheme
        run.sync(source)
        token = run.lease(60)
        run.write_output(token, run.leased(token))
        run.complete(token)
    left[0] = 0
    clock.later(61)
    again = WorkLedger(spark, str(tmp_path / "w"), clock=clock)
    again.sync(source)
    token = again.lease(60)
    if not again.leased(token).isEmpty():
        again.write_output(token, again.leased(token))
        again.complete(token)
    assert written(again) == [(1, 10), (2, 20)] and ids(again.pending()) == []


def test_release_part_and_compaction(spark, ledger):
    ledger.sync(items(spark, *((i, i) for i in range(10))), items(spark))
    assert ledger.outputs() is None
    for _ in range(6):
        ledger.release(ledger.lease(60, part=F.col("item_id") < 5))
    assert ids(ledger.pending()) == list(range(10))
    token = ledger.lease(60, part=F.col("item_id") < 5)
    assert ids(ledger.leased(token)) == [0, 1, 2, 3, 4] and ids(ledger.pending()) == [5, 6, 7, 8, 9]


def test_old_commits_are_purged(spark, tmp_path, clock):
    ledger = WorkLedger(spark, f"{tmp_path}/p", clock=clock, compact_every=2, keep=3)
    ledger.sync(items(spark, (1, 1)), items(spark))
    for _ in range(4):
        ledger.release(ledger.lease(60))
    assert ids(ledger.pending()) == [1] and len(ledger.log.numbers()) <= 5
    assert len(ledger.files.list("changes")) <= 7
    assert not ledger.log.publish(2, {"folders": []}) and 2 not in ledger.log.numbers()  # a writer that was asleep since


def test_one_of_many_racing_writers_wins(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    log = WorkLedger(spark, f"file://{tmp_path}/r").log
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: log.publish(1, {"folders": [f"writer-{i}"]}), range(16)))
    assert sum(won) == 1 and log.latest() == (1, {"folders": [f"writer-{won.index(True)}"]})


def test_two_ledgers_race(spark, tmp_path, clock):
    a, b = (WorkLedger(spark, f"{tmp_path}/two", clock=clock) for _ in range(2))
    a.sync(items(spark, (1, 1), (2, 2)), items(spark))
    real = a.log.publish

    def late(number, manifest):
        a.log.publish = real
        b.lease(60, part=F.col("item_id") == 1)  # takes the number between a's reading and a's writing
        return real(number, manifest)

    a.log.publish = late
    token = a.lease(60)
    assert ids(a.leased(token)) == [2]


def test_versions_and_nulls(spark):
    t = datetime(2026, 1, 1)
    raw = spark.createDataFrame([(1, None, "a", None, t), (2, "a", None, None, t), (2, "b", None, None, None), (3, "x", "y", "z", t), (None, "q", "q", "q", t)], "id long, title string, content string, date string, scraped_at timestamp_ntz")
    done = spark.createDataFrame([(1, "a", None, None, t, "COMPLETED"), (2, "a", None, None, t, "COMPLETED"), (3, "x", "y", "z", t, None)], "article_id long, title_original string, content_original string, date_raw string, processing_timestamp timestamp_ntz, processing_status string")
    source, finished = source_versions(raw), finished_versions(done)
    left = source.join(finished, ["item_id", "version"], "left_anti")
    assert ids(left.select("item_id")) == [1, 3]  # (NULL, a) is not (a, NULL)


def test_weekly_averages_against_brute_force(spark):
    base, weeks = date(2024, 12, 2), {}
    rows = []
    for s in ("a", "b"):
        for i in (0, 1, 2, 5, 6, 7, 8, 9, 20):
            monday = base + timedelta(7 * i)
            y, w, _ = monday.isocalendar()
            weeks[s, monday] = 3 * i + len(s)
            rows.append((s, f"{y}-W{w:02d}", 3 * i + len(s), None, None, datetime(2026, 1, 2)))
            rows.append((s, f"{y}-W{w:02d}", 999, 1.0, 1.0, datetime(2026, 1, 1)))  # restated since
    rows += [rows[0], ("c", "bad", 1, None, None, None), (None, "2025-W01", 1, None, None, None), ("d", "2025-W01", None, None, None, None)]
    df = spark.createDataFrame(rows, "series string, week string, article_count int, ma_4week double, ma_8week double, computed_at timestamp_ntz")
    got = weekly_averages(df.withColumn("monday", F.lit("clash")).withColumn("present", F.lit(1))).collect()
    assert {r.series for r in got} == {"a", "b", "d"}
    for r in got:
        if r.series == "d":
            assert r.right_4 is None
            continue
        y, w = int(r.week[:4]), int(r.week[6:])
        monday = date.fromisocalendar(y, w, 1)
        for n, v in ((4, r.right_4), (8, r.right_8)):
            span = [monday - timedelta(7 * k) for k in range(n)]
            want = None if span[-1] < base else sum(weeks.get((r.series, m), 0) for m in span) / n
            assert v == want
        assert r.present == ((r.series, monday) in weeks)
    assert sum(r.series == "a" for r in got) == 21
    assert weekly_averages(df.limit(0)).count() == 0


def test_dense_days(spark):
    d = date(2026, 1, 1)
    rows = [("x", d, 1), ("x", d + timedelta(3), 4), ("y", d, 2), (None, d, 1), ("z", None, 1)]
    dense = densify(spark.createDataFrame(rows, "e string, day date, n int"), ["e"], "day")
    got = {(r.e, r.day): (r.total_2, r.full_2) for r in trailing(dense, ["e"], "day", "n", [2]).collect()}
    assert got[("x", d + timedelta(3))] == (4, True) and got[("x", d + timedelta(1))] == (1, True) and got[("x", d)] == (1, False)
    assert len(got) == 5


def test_entity_days_counts_rows_once(spark):
    m = spark.createDataFrame([(1, "A  b", "ORG", 1.0), (1, "A  b", "ORG", 1.0), (1, "a B", "PERSON", None), (2, "a b", None, None), (9, "a b", "ORG", 1.0), (1, " ", "ORG", 1.0), (1, None, "ORG", 1.0)], "article_id long, entity string, entity_type string, confidence double")
    t = datetime(2026, 1, 1)
    p = spark.createDataFrame([(1, t, date(2026, 1, 1)), (1, datetime(2025, 1, 1), date(2025, 1, 1)), (2, t, None)], "article_id long, processing_timestamp timestamp_ntz, publication_date date")
    assert [tuple(r) for r in entity_days(m, p).collect()] == [("a b", date(2026, 1, 1), 2)]


def test_entity_calendar_goes_on_after_the_last_mention(spark):
    m = spark.createDataFrame([(1, "a", "ORG", 1.0), (1, "b", "ORG", 1.0), (2, "b", "ORG", 1.0), (9, "never dated", "ORG", 1.0)], "article_id long, entity string, entity_type string, confidence double")
    t = datetime(2026, 1, 1)
    p = spark.createDataFrame([(k, t, date(2026, 1, 1) + timedelta(days=d)) for k, d in ((0, 0), (1, 2), (2, 4), (3, 39))], "article_id long, processing_timestamp timestamp_ntz, publication_date date")
    mentioned = {"a": [2], "b": [2, 4], "never dated": []}
    want = {(e, date(2026, 1, 1) + timedelta(days=k), k in at, sum(k - 7 < d <= k for d in at), sum(k - 30 < d <= k for d in at)) for e, at in mentioned.items() for k in range(40)}
    got = [(r.entity, r.publication_date, r.mentions == 1, r.total_7, r.total_30) for r in entity_calendar(m, p).collect()]
    assert set(got) == want and len(got) == 120
    assert entity_calendar(m, p.limit(0)).count() == 0
