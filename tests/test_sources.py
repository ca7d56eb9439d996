from presswell import schemas
from presswell.functions.html import parse_listings, strip_html, visible_text
from presswell.sources.sinks import append, write_csv, write_name_map
from presswell.sources.tables import read_csv, read_name_map


def test_tables_are_created_twice(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS press_test")
    spark.sql("USE press_test")
    try:
        for _ in range(2):
            schemas.create_tables(spark, f"file://{tmp_path}")
        for name, (_, keys) in schemas.TABLES.items():
            table = spark.table(name)
            assert table.count() == 0 and set(keys) <= set(table.columns)
            assert set(table.columns) == set(schemas.empty_table(spark, name).columns)
    finally:
        spark.sql("USE default")
        spark.sql("DROP DATABASE press_test CASCADE")


def test_conform(spark):
    got = schemas.conform(spark.createDataFrame([(1, "x", 2)], "rank long, keyword string, other int"), "article_keywords")
    assert got.columns == ["article_id", "keyword", "score", "rank"] and tuple(got.first()) == (None, "x", None, 1)


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", then'), (2, None)], "id int, name string")
    write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "c"), "id int, name string").collect())) == [(1, 'say "hi", then'), (2, None)]
    names = spark.createDataFrame([(0, "x"), (3, "ü")], "topic_id int, topic_name string")
    write_name_map(names, str(tmp_path / "n"))
    assert sorted(map(tuple, read_name_map(spark, str(tmp_path / "n")).collect())) == [(0, "x"), (3, "ü")]
    append(df, str(tmp_path / "a"))
    append(df, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 4


def test_html(spark):
    assert visible_text("<p>Fish &amp; <b>chips</b><script>x('</p>')</script></p>").split() == ["Fish", "&", "chips"]
    assert visible_text("a &amp; b") == "a &amp; b" and visible_text(None) is None and visible_text("") == ""
    df = spark.createDataFrame([(1, "<i>x</i>"), (2, None), (3, "y")], "id long, content string")
    assert sorted((r.id, r.content) for r in strip_html(df, "content").collect() if r.content) == [(1, "x"), (3, "y")]
    page = '<div><a href="/1"><h3 class="cat_title big">One &amp; only</h3><p class="text-dark">Body</p><h4 class="text-secondary">01 Apr 2026</h4></a><a href="/2"><h3 class="cat_title">Two</h3></a><h3 class="cat_title">None</h3></div>'
    rows = parse_listings(spark.createDataFrame([(page,), (None,), ("",)], "html string")).collect()
    assert [tuple(r) for r in rows] == [("One & only", "Body", "01 Apr 2026", "/1"), ("Two", "N/A", "N/A", "/2")]


def test_html_with_unknown_sections(spark):
    assert visible_text("a <![|;@[j b").split() == ["a", "<", "![|;@[j", "b"]  # never closed: text
    assert visible_text("<p>a<![|;@[j>b<![foo[x]]>c</p>").split() == ["a", "b", "c"]
    assert visible_text("a<![CDATA[x]]>b<![if word]>c<![endif]>").split() == ["a", "b", "c"]
    df = spark.createDataFrame([(1, "<b>x</b> <![|;@[j"), (2, "plain")], "id long, content string")
    assert {r.id: r.content.split() for r in strip_html(df, "content").collect()} == {1: ["x", "<", "![|;@[j"], 2: ["plain"]}
    assert [r.title for r in parse_listings(spark.createDataFrame([('<![?[><a href="u"><h3 class="cat_title">T</h3></a>',)], "html string")).collect()] == ["T"]
