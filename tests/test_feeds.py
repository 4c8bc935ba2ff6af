from tapedeck.operators import feeds as f

FEED = """<rss><title>The feed</title><item><title><![CDATA[ Artist Shares New Song “First &amp; Last” ]]></title></item>
<item id="2"><link>x</link></item><item><title>Caf&#233; &#x2013; It&apos;s &lt;3 &#128512; &#0; &#55296;
two lines</title><title>second</title></item></rss>"""


def items(spark, rows, **how):
    return f.feed_items(spark.createDataFrame(rows, "page_id int, source string, markup string").selectExpr("*", "1 as block", "2 as x"), markup="markup", **how)


def test_items_and_entities(spark):
    got = [(r.page_id, r["item"], r.title) for r in items(spark, [(1, "a", FEED), (2, "a", None), (3, "a", ""), (4, "a", "<item>no title")]).drop("block").collect()]
    assert sorted(got) == [(1, 0, "Artist Shares New Song “First & Last”"), (1, 2, "Café – It's <3 \U0001f600 &#0; &#55296;\ntwo lines")]


def test_entities_are_decoded_in_order(spark):
    rows = ["&amp;lt;", "&amp;#65;", "&#x41;&#X41;&#65;&#65", "&#1114112;", "&nbsp;", "", None, "&&amp;"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, t string")
    got = [r.d for r in df.select("i", f.decode_entities(df.t).alias("d")).orderBy("i").collect()]
    assert got == ["<", "A", "A&#X41;A&#65", "&#1114112;", "&nbsp;", "", None, "&&"]


def test_patterns_in_order_by_source(spark):
    patterns = [("blog", "(?i)^(.+?)\\s+(?:shares?|drops?)\\b.+[\"“](.+?)[\"”]"), ("blog", "^(.+?)\\s+.*[\"“](.+?)[\"”]"), ("dash", r"^(.+?)\s+[–—-]\s+(.+)$")]
    rows = [("blog", "New Band shares a tune “Hello”"), ("blog", "Other talk about \"That\" and \"This\""), ("blog", "No quotes"), ("dash", "A - B"), ("dash", "A — B - C"), ("none", "A - B"), (None, "A - B"), ("dash", None), ("blog", "x drops a \"  \"")]
    df = spark.createDataFrame(rows, "source string, title string").selectExpr("*", "1 as x")
    got = {(r.source, r.title): (r.artist, r.track) for r in f.extract_feed_titles(df.drop("x"), patterns).collect()}
    assert got == {
        rows[0]: ("New Band", "Hello"), rows[1]: ("Other", "This"), rows[3]: ("A", "B"), rows[4]: ("A", "B - C"), rows[8]: ("x", ""),
    }
    assert f.extract_feed_titles(df.drop("x"), []).count() == 0


def test_seeds_look_behind_series(spark):
    rows = ["Band :: New Album", "All One Song :: Singer on “Tune”", "The Lagniappe Sessions :: Duo - covers", "All One Song :: nothing more", "BAND :: Again", "X :: too short", "No parts", None]
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate(rows)], "source string, item int, title string")
    assert {(r["item"], r.artist, r.more) for r in f.artist_seeds(df).collect()} == {(0, "Band", "New Album"), (1, "Singer", "Singer on “Tune”"), (2, "Duo", "Duo - covers")}
