"""Artists and tracks named in the titles of feeds and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TITLE = r"(?s)<title>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</title>"
#: Entities by name, decoded in this order before those by number.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"))
#: Beginnings of titles that name a series, after which the artist stands in the second part.
SERIES = ("all one song", "the lagniappe sessions", "the aquarium drunkard")


def _numbered(prefix: str, base: int):
    """Replaces one numbered entity, given its digits, by its character."""

    def replaced(text: Column, digits: Column) -> Column:
        code = F.conv(digits, base, 10).cast("int")
        known = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(known, F.replace(text, F.concat(F.lit(prefix), digits, F.lit(";")), char)).otherwise(text)

    return replaced


def decode_entities(text: Column) -> Column:
    """text with its named entities and then its numbered ones (decimal, then hexadecimal) as characters; numbers that no character has stay."""
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    for prefix, digits, base in (("&#", "[0-9]{1,7}", 10), ("&#x", "[0-9a-fA-F]{1,6}", 16)):
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"{prefix}({digits});"), F.lit(1)))
        text = F.aggregate(found, text, _numbered(prefix, base))
    return text


def feed_items(pages: DataFrame, *, markup: str, block: str = "<item") -> DataFrame:
    """All columns but the markup, with item (from 0) and title: the first title in each block of the markup, decoded.

    A block begins at `block` and ends at the next; what stands before the first is none. Blocks without a title, null
    and empty markup give no rows.
    """
    kept = [c for c in pages.columns if c != markup]
    blocks = F.filter(F.transform(F.split(F.col(markup), F.lit(r"\Q" + block + r"\E")), lambda b, i: F.struct((i - 1).alias("item"), b.alias("block"))), lambda x: x["item"] >= 0)
    # the page's own columns in one, whatever their names
    rows = pages.select(F.struct(*kept).alias("page"), F.inline(blocks)).where(F.col("block").rlike(TITLE))
    title = decode_entities(F.trim(F.regexp_extract("block", TITLE, 1), F.lit(" \t\r\n")))
    return rows.select("page.*", "item", title.alias("title"))


def extract_feed_titles(items: DataFrame, patterns: list[tuple[str, str]], *, source: str = "source") -> DataFrame:
    """items (source, title) with artist and track, where a pattern of its source finds both.

    patterns: (source, regular expression with two groups), in the order in which they are tried; the first under which
    both groups find something counts. A source without patterns and titles that none fits have no rows.
    """
    found = []
    for of, pattern in patterns:
        artist, track = (F.trim(F.regexp_extract("title", pattern, g)) for g in (1, 2))
        hit = (F.col(source) == of) & F.col("title").rlike(pattern) & (F.regexp_extract("title", pattern, 1) != "") & (F.regexp_extract("title", pattern, 2) != "")
        found.append(F.when(hit, F.struct(artist.alias("artist"), track.alias("track"))))
    if not found:
        return items.limit(0).withColumns({"artist": F.lit(None).cast("string"), "track": F.lit(None).cast("string")})
    return items.withColumn("x", F.coalesce(*found)).where("x is not null").select(*items.columns, "x.artist", "x.track")


def artist_seeds(items: DataFrame, *, by: tuple[str, ...] = ("source",), order: tuple[str, ...] = ("item",), separator: str = "::", series: tuple[str, ...] = SERIES) -> DataFrame:
    """The artist that each title of the form "artist :: more" names, once for each of `by`: *by, artist, more.

    Where the first part names a series, the artist is what the second has before " on " or a dash, if there is one. Names
    of one letter don't count; of names that differ in case only the first by `order` stays.
    """
    parts = rf"^(.+?)\s+{separator}\s+(.+)$"
    named = r"(?i)^(" + "|".join(series) + ")" if series else "^$a"
    first, more = (F.regexp_extract("title", parts, g) for g in (1, 2))
    inner = F.trim(F.regexp_extract("more", r"^(.+?)(?:\s+on\s+|\s*[-–—]\s*)", 1))
    rows = items.where(F.col("title").rlike(parts)).withColumns({"first": F.trim(first), "more": more})
    rows = rows.withColumn("artist", F.when(F.col("first").rlike(named), inner).otherwise(F.col("first"))).where(F.length("artist") >= 2)
    rank = F.row_number().over(Window.partitionBy(*by, F.lower("artist")).orderBy(*order))
    return rows.withColumn("k", rank).where("k = 1").select(*by, *[c for c in order if c not in by], "artist", "more")
