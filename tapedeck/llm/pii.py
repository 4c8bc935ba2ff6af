"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust the score.

The patterns are written with possessive quantifiers and guards before them, so that each run of characters is
scanned once: they match what the plain forms in the comments match, in linear time and without deep recursion.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapedeck.llm.common import renamed


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: A cheap test that any text with a match passes.
    needs: str
    #: Score of a confirmed span, before its context.
    score: float
    #: Words before a span that raise (lower) its score by CONTEXT.
    raises: str
    lowers: str
    base: bool


CONTEXT, NEARBY, LEAST = 0.3, 40, 0.6

KINDS = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|write to", "example", True),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", 0.7, r"\bip\b|address|host|server", "version|release|section", True),
    # [0-9]([\x20-]?[0-9])+ of 13 to 19 digits: such a run starts at a digit that no run reaches, and can't go on
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])", r"[0-9](?:[\x20-]?[0-9]){12}", 0.8, "card|visa|credit|payment", "order|serial|isbn", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.7, "phone|call|mobile|tel", "equation|score", True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}", 0.9, "iban|account|bank", "", False),
    # without a checksum, this one needs its context
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]{2}-[0-9]", 0.4, "ssn|social security|taxpayer", "", False),
)


#: Matches of a text that are placed in one go: adding to an array copies it, so long lists are placed in pieces.
PIECE = 128
#: Code points of the blocks in which words nearby are looked up: finding a place in a text takes a walk from its start.
BLOCK = 1024


def _let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), 0)


def located(text: Column, pattern: str) -> Column:
    """All matches, left to right: start and end in code points, and value."""
    gaps = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, v: F.struct(F.length(g).alias("gap"), v.alias("value")))
    none = F.expr("cast(array() as array<struct<start: int, end: int, value: string>>)")

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.length(x["value"])
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("found"))

    def placed(pieces):
        lengths = F.transform(pieces, lambda p: F.aggregate(p, F.lit(0), lambda n, x: n + x["gap"] + F.length(x["value"])))
        starts = F.slice(F.aggregate(lengths, F.array(F.lit(0)), lambda at, n: F.concat(at, F.array(F.element_at(at, -1) + n))), 1, F.size(pieces))
        return F.flatten(F.zip_with(pieces, starts, lambda p, at: F.aggregate(p, F.struct(at.alias("at"), none.alias("found")), step, lambda acc: acc["found"])))

    def cut(found):
        last = F.floor((F.size(found) - 1) / PIECE).cast("int")
        return F.when(F.size(found) > 0, _let(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(found, i * PIECE + 1, PIECE)), placed)).otherwise(none)

    return _let(F.filter(gaps, lambda x: x["value"].isNotNull()), cut)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + (d.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number without blanks leaves 1 by 97, its first four characters moved to the end."""
    moved = F.concat(F.substring(iban, 5, 60), F.substring(iban, 1, 4))

    def step(rest, c):
        value = F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
        return (rest * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def confirmed(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        return luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return mod97(F.replace(value, F.lit(" "), F.lit("")))
    return F.lit(True)


def spans_of(text: Column, kind: Kind) -> Column:
    """Confirmed spans of a kind with their scores; those that the method adds must reach LEAST."""

    def scored(x, blocks):
        own = F.floor(x["start"] / BLOCK).cast("int")
        near = F.concat(F.coalesce(F.get(blocks, own - 1), F.lit("")), F.get(blocks, own))
        ends = x["start"] - F.greatest(own - 1, F.lit(0)) * BLOCK
        before = F.lower(F.substring(near, F.greatest(ends - NEARBY + 1, F.lit(1)), F.least(ends, F.lit(NEARBY))))
        score = F.lit(kind.score) + F.when(before.rlike(kind.raises), CONTEXT).otherwise(0.0)
        if kind.lowers:
            score = score - F.when(before.rlike(kind.lowers), CONTEXT).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"))

    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / BLOCK).cast("int")), lambda i: F.substring(text, i * BLOCK + 1, F.lit(BLOCK)))
    matches = F.filter(located(text, kind.pattern), lambda x: confirmed(kind.name, x["value"]))
    found = _let(blocks, lambda b: F.transform(matches, lambda x: scored(x, b)))
    if not kind.base:
        found = F.filter(found, lambda x: x["score"] >= LEAST)
    test = F.contains(text, F.lit(kind.needs)) if kind.needs == "@" else text.rlike(kind.needs)
    return F.when(test, found).otherwise(F.expr("cast(array() as array<struct<kind: string, start: int, end: int, score: double>>)"))


def find(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id and text (null: empty), other named columns, and an array of spans for each kind."""
    d = renamed(docs, ["doc_id", "text", *columns]).withColumn("text", F.coalesce("text", F.lit("")))
    return d.select("*", *[spans_of(F.col("text"), k).alias(f"_{k.name}") for k in KINDS])


def _joined(kinds) -> Column:
    return F.array_join(F.transform(F.concat(*[F.col(f"_{k.name}") for k in kinds]), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """Spans of personal data of each text, as counts, a digest of the base kinds and a list.

    Returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, and scores (one for each span, in the order of
    spans). A null text counts as empty, with no spans; each row is looked at by itself, so repeated rows repeat;
    other columns are not looked at; an empty table gives no rows.
    """
    base = [k for k in KINDS if k.base]
    counts = [F.size(f"_{k.name}").cast("long").alias(f"n_{k.name}") for k in base]
    scores = F.transform(F.concat(*[F.col(f"_{k.name}") for k in KINDS]), lambda x: x["score"])
    return find(docs).select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(KINDS).alias("spans"), scores.alias("scores"))


def replaced(text: Column, spans: Column) -> Column:
    """text with each of some sorted spans replaced by its kind in brackets (one that begins within another goes with
    it). PIECE spans at a time are replaced in their own part of the text, so that no long text is copied for each span."""

    def put(groups):
        ends = F.transform(groups, lambda g: F.array_max(F.transform(g, lambda x: x["end"])))
        return _let(F.aggregate(ends, F.array(F.lit(0)), lambda at, end: F.concat(at, F.array(F.greatest(F.element_at(at, -1), end)))), lambda bounds: parts(groups, bounds))

    def parts(groups, bounds):
        def part(group, i):
            first = F.get(bounds, i)
            return _let(F.substring(text, first + 1, F.get(bounds, i + 1) - first), lambda own: within(group, first, own))

        return F.concat(F.array_join(F.transform(groups, part), ""), F.substring(text, F.element_at(bounds, -1) + 1, F.length(text)))

    def within(group, first, own):
        def step(acc, x):
            gap = F.substring(own, acc["at"] - first + 1, x["start"] - acc["at"])
            out = F.when(x["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit("["), x["kind"], F.lit("]"))).otherwise(acc["out"])
            return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out"))

        return F.aggregate(group, F.struct(first.alias("at"), F.lit("").alias("out")), step, lambda acc: acc["out"])

    last = F.floor((F.size(spans) - 1) / PIECE).cast("int")
    return _let(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(spans, i * PIECE + 1, PIECE)), put)


def mask(docs: DataFrame) -> DataFrame:
    """docs with each span replaced by its kind in brackets, and n_chars, if there, counted anew.

    Null texts stay null, empty ones empty; all other columns stay as they are, whatever their names; rows are masked
    one by one, repeated or not; an empty table stays empty.
    """
    # the whole row is one struct, so that no column of it can clash with those added here
    d = docs.select(F.struct("*").alias("row"))
    text = F.coalesce(F.col("row").getField("text"), F.lit(""))
    found = d.select("row", text.alias("plain"), *[spans_of(text, k).alias(f"_{k.name}") for k in KINDS])
    spans = F.array_sort(F.concat(*[F.transform(f"_{k.name}", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.upper(x["kind"]).alias("kind"))) for k in KINDS]))
    plain = F.col("plain")
    done = found.select("row", "plain", spans.alias("spans")).select("row", "spans", F.when(F.size("spans") > 0, replaced(plain, F.col("spans"))).otherwise(plain).alias("masked"))
    row, types = F.col("row"), dict(docs.dtypes)
    put = {"text": F.when(row.getField("text").isNotNull(), F.col("masked"))}
    if "n_chars" in docs.columns:
        put["n_chars"] = F.when(row.getField("text").isNotNull() & (F.size("spans") > 0), F.length("masked").cast(types["n_chars"])).otherwise(row.getField("n_chars"))
    return done.select(*[put.get(c, row.getField(c)).alias(c) for c in docs.columns])
