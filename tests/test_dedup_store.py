from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from presswell.operators.current import newest_rows, newest_values
from presswell.operators.dedup import assign_duplicates, check_new, greedy_marks, near_pairs, shared_values
from presswell.operators.store import VersionedTable, append_new_links, needing, stage_log, unprocessed, upsert

ARTICLES = "article_id long, content_clean string, link string, publication_date date"
DAY, OTHER = date(2026, 4, 1), date(2026, 4, 2)
LONG = "fuel prices rise as tankers queue outside the northern port while drivers wait for hours "


def status(spark, rows):
    found = assign_duplicates(spark.createDataFrame(rows, ARTICLES)).collect()
    return {r.article_id: (r.duplicate_status, r.duplicate_of) for r in found}


def test_link_then_hash_then_near(spark):
    got = status(spark, [
        (1, LONG, "a", DAY), (2, "something else entirely", "a", DAY), (3, LONG.upper(), "c", OTHER), (4, LONG + "today", None, DAY),
        (5, "", "e", None), (6, None, "f", None), (7, "unrelated words only", "", DAY),
    ])
    assert got[1] == ("UNIQUE", None)
    assert got[2] == ("EXACT_DUPLICATE", 1)
    assert got[3] == ("EXACT_DUPLICATE", 1)
    assert got[4] == ("NEAR_DUPLICATE", 1)
    assert got[5] == ("UNIQUE", None) and got[6] == ("EXACT_DUPLICATE", 5)
    assert got[7] == ("UNIQUE", None)


def test_near_needs_a_day_and_empty_table(spark):
    assert status(spark, [(1, LONG, "a", None), (2, LONG + "now", "b", None)])[2] == ("UNIQUE", None)
    assert status(spark, []) == {}


def test_near_pairs_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(60):
        base = list(rng.choice(words, 25)) if i % 3 == 0 else [w if rng.random() > 0.08 else str(rng.choice(words)) for w in rows[-1][2].split()]
        rows.append((i, DAY if i % 2 else OTHER, " ".join(base)))
    got = {(r.a, r.b): r.similarity for r in near_pairs(spark.createDataFrame(rows, "doc long, day date, text string")).collect()}
    want = {}
    for day in (DAY, OTHER):
        docs = [(d, t.split()) for d, x, t in rows if x == day]
        df = {w: sum(w in t for _, t in docs) for _, t in docs for w in t}
        vec = {}
        for d, t in docs:
            v = {w: t.count(w) * (np.log((1 + len(docs)) / (1 + df[w])) + 1) for w in set(t)}
            n = sum(x * x for x in v.values()) ** 0.5
            vec[d] = {w: x / n for w, x in v.items()}
        for a in vec:
            for b in vec:
                if a < b and (s := sum(x * vec[b].get(w, 0) for w, x in vec[a].items())) >= 0.85:
                    want[a, b] = s
    assert want and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_greedy_equals_walk(spark):
    rng = np.random.default_rng(3)
    for _ in range(3):
        pairs = sorted({tuple(sorted(map(int, rng.choice(20, 2, replace=False)))) for _ in range(25)})
        marked, want = set(), {}
        for a, b in pairs:
            if a not in marked and b not in marked:
                marked.add(b)
                want[b] = a
        got = greedy_marks(spark.createDataFrame(pairs, "a long, b long"))
        assert {r.doc: r.duplicate_of for r in got.collect()} == want
    assert greedy_marks(spark.createDataFrame([], "a long, b long")).count() == 0


def test_check_new(spark):
    known = assign_duplicates(spark.createDataFrame([(1, LONG, "a", DAY), (2, "other words", "b", DAY)], ARTICLES)).join(spark.createDataFrame([(1, LONG, DAY), (2, "other words", DAY)], "article_id long, content_clean string, publication_date date"), "article_id")
    new = spark.createDataFrame([(1, LONG, DAY), (8, LONG, None), (9, LONG + "again", DAY), (10, "new text", DAY)], "article_id long, content_clean string, publication_date date")
    got = {r.article_id: (r.duplicate_status, r.duplicate_of) for r in check_new(new, known).collect()}
    assert got[1] == ("UNIQUE", None)  # itself
    assert got[8] == ("EXACT_DUPLICATE", 1) and got[9][0] == "NEAR_DUPLICATE" and got[10] == ("UNIQUE", None)


def test_newest_ties_nulls_and_clashing_names(spark):
    t = datetime(2026, 1, 1)
    rows = [(1, t, "a"), (1, t, "b"), (1, None, "z"), (2, None, None), (None, t, "x"), (1, t, "b")]
    df = spark.createDataFrame(rows, "id long, at timestamp_ntz, v string")
    assert {(r.id, r.v) for r in newest_values(df, ["id"], "at", [F.col("v")]).collect()} == {(1, "b"), (2, None)}
    whole = newest_rows(df.withColumn("rank", F.lit(9)), ["id"], "at")
    assert sorted(r.id for r in whole.collect()) == [1, 2] and whole.columns == ["id", "at", "v", "rank"]
    assert newest_rows(df.limit(0), ["id"], "at").count() == 0


def test_upsert_scans_links_and_log(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id long, v string, w int")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "d")], "id long, v string")
    got = sorted(tuple(r) for r in upsert(old, new, ["id"]).collect())
    assert got == [(1, "a", 5), (2, "c", None), (3, "d", None)]
    raw = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    done = spark.createDataFrame([(1, "COMPLETED"), (2, "FAILED")], "article_id long, processing_status string")
    assert sorted(r.id for r in unprocessed(raw, done).collect()) == [2, 3]
    assert [r.article_id for r in needing(done, spark.createDataFrame([], "article_id long")).collect()] == [1]
    seen = spark.createDataFrame([(1, "x"), (2, None)], "id long, link string")
    found = spark.createDataFrame([(7, "x"), (8, "y"), (9, "y"), (10, "N/A"), (11, None)], "id long, link string")
    assert [(r.id, r.link) for r in append_new_links(seen, found).select("id", "link").collect()] == [(8, "y")]
    rows = spark.createDataFrame([(1, "", "bad", "FAILED", "UNIQUE"), (2, "EMPTY_TITLE", None, None, None)], "article_id long, reason string, date_raw string, date_parse_status string, duplicate_status string")
    log = [(r.article_id, r.stage, r.status, r.message) for r in stage_log(rows).orderBy("article_id", "step").collect()]
    assert log == [(1, "VALIDATION", "SUCCESS", ""), (1, "DATE_NORMALIZATION", "FAILED", "raw='bad'"), (1, "CLEANING", "SUCCESS", ""), (1, "DEDUPLICATION", "SUCCESS", "UNIQUE"), (2, "VALIDATION", "FAILED", "EMPTY_TITLE")]
    assert shared_values(found, "link").count() == 2


def test_versioned_table(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "id long, v string", ["id"], compact_every=2)
    rows = lambda *r: spark.createDataFrame(list(r), "id long, v string")
    read = lambda: sorted(tuple(r) for r in table.read().collect())
    assert read() == []
    table.upsert(rows((1, "a"), (2, "b")), 0)
    table.upsert(rows((2, "c"), (3, "d")), 1)
    table.upsert(rows((9, "again")), 1)  # a batch that was committed before
    assert read() == [(1, "a"), (2, "c"), (3, "d")]
    table.upsert(rows((1, "e")), 2)  # compacts
    assert len(table.log.latest()[1]["base"]) == 1 and table.log.latest()[1]["changes"] == []
    table.replace(table.read().where("id > 1"))
    table.upsert(rows((4, None)))
    assert read() == [(2, "c"), (3, "d"), (4, None)]
    assert sorted(tuple(r) for r in VersionedTable(spark, str(tmp_path / "t"), "id long, v string", ["id"]).read().collect()) == read()


@pytest.mark.parametrize("after", [False, True])
def test_table_survives_a_death_at_any_step(spark, tmp_path, monkeypatch, after):
    from pyspark.sql.readwriter import DataFrameWriter

    from presswell.sources.commits import Files

    table = VersionedTable(spark, str(tmp_path / "t"), "id long, v string", ["id"], compact_every=1, keep=2)
    table.replace(spark.range(1000).selectExpr("id", "'old' AS v"))
    for owner, name in ((DataFrameWriter, "parquet"), (Files, "publish")):
        whole = getattr(owner, name)

        def dying(self, *args, **options):
            if after:
                whole(self, *args, **options)
            raise KeyboardInterrupt

        for change in (lambda: table.replace(spark.createDataFrame([(1, "new")], "id long, v string")), lambda: table.upsert(spark.createDataFrame([(1, "new")], "id long, v string"))):
            monkeypatch.setattr(owner, name, dying)
            with pytest.raises(KeyboardInterrupt):
                change()
            monkeypatch.setattr(owner, name, whole)
            found = VersionedTable(spark, str(tmp_path / "t"), "id long, v string", ["id"]).read().count()
            assert found == 1000 or (after and name == "publish" and found == 1)
            table.replace(spark.range(1000).selectExpr("id", "'old' AS v"))


def test_lookup_spreads_a_hot_key(spark):
    from presswell.operators.lookup import looked_up

    rows = spark.createDataFrame([(i, "hot" if i % 3 else "k%d" % i) for i in range(60)] + [(99, None)], "id long, k string")
    table = spark.createDataFrame([("hot", 1), ("k3", 2)], "k string, v int")
    for most in (0, 10):
        got = {r.id: r.v for r in looked_up(rows, table, ["k"], "left", most=most).collect()}
        assert len(got) == 61 and got[1] == 1 and got[3] == 2 and got[6] is None and got[99] is None
        assert looked_up(rows, table, ["k"], "left_semi", most=most).count() == 41
        assert looked_up(rows, table, ["k"], "left_anti", most=most).count() == 20


def test_hot_values_are_marked(spark):
    rows = [(i, f"text {i}", "same link" if i else None, None) for i in range(40)]
    got = status(spark, rows)
    assert got[0] == ("UNIQUE", None) and got[1] == ("UNIQUE", None) and all(got[i] == ("EXACT_DUPLICATE", 1) for i in range(2, 40))


def test_near_pairs_of_usual_and_crowded_days(spark):
    rng = np.random.default_rng(8)
    words, rows = [f"word{i}" for i in range(90)], []
    for i in range(150):
        base = [str(w) for w in rng.choice(words, 20)] if i % 4 == 0 else [w if rng.random() > 0.06 else str(rng.choice(words)) for w in rows[-1][2].split()]
        rows.append((149 - i, DAY if i % 3 else OTHER, " ".join(base)))
    texts = spark.createDataFrame([*rows, (200, DAY, ""), (201, DAY, None), (202, None, rows[0][2])], "doc long, day date, text string")
    found = lambda **o: {(r.day, r.a, r.b): round(r.similarity, 6) for r in near_pairs(texts, **o).collect()}
    for most in (2000, 40):
        joined = found(most=most, most_texts=0)
        assert joined and joined == found(most=most) == found(most=most, most_texts=80)
    plan = near_pairs(texts)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1  # the texts are moved once
