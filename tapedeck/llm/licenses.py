"""License scans by diagonal voting: word pairs and triples of texts meet those of templates, and the hits vote for the
place where a template would have to begin."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapedeck.llm.common import renamed

#: Phrases that count wherever they stand unchanged.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Notices, which count where most of their words stand in order.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution sharealike license", "cc-by-sa"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
#: Words of a template at most (its grams are bits of one number).
LONGEST = 60
#: A template is found where this share of its words stands in order; its grams may be so many words apart from where they should be.
LEAST_SHARE, SLACK = 0.8, 3
#: Grams of templates that may be broadcast (about 100 bytes each); beyond that Spark chooses the join.
MOST_GRAMS = 100_000

_ASCII = "".join(chr(c) for c in range(128) if chr(c) not in string.ascii_letters + string.digits)
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased: letters, digits and all characters beyond ASCII."""
    lowered = F.btrim(F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase), F.lit(_ASCII))
    return F.when(lowered == "", F.array().cast("array<string>")).otherwise(F.split(lowered, SEPARATORS))


def grams(phrases, templates) -> list[tuple]:
    """template (its number, phrases first), tpos, w1, w2, w3 of each pair of a template of up to three words and each triple of the longer ones."""
    out = []
    for i, (text, _) in enumerate([*phrases, *templates]):
        w = text.split()
        if not 2 <= len(w) <= LONGEST or any(c in _ASCII for c in "".join(w)):
            raise ValueError(f"a template has 2 to {LONGEST} words of letters and digits: {text!r}")
        n = 2 if len(w) <= 3 else 3
        out += [(i, j, *w[j : j + n], *[None] * (3 - n)) for j in range(len(w) - n + 1)]
    return out


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """Places of license phrases and notices in each text: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Takes doc_id and text of docs, (text, label) of phrases and templates. Each pair or triple of a text's words that
    equals one of a template votes for the word where the template would begin; votes for beginnings at most SLACK apart
    are taken together. A phrase stands where all its pairs vote for one beginning; n_base counts such places, first_word
    and last_word are the first and last of them (words from 0). A notice stands where its grams cover LEAST_SHARE of its
    words, over at most twice its length or with one beginning. spans: label, first_word, n_words (to the last hit),
    share, by first_word. score: 1 with a phrase, else the largest share of a notice that any place covers.
    Null and empty texts have no words; each row has its own result, repeated rows too; other columns are not looked at.
    """
    spark = docs.sparkSession
    every = [*phrases, *templates]
    rows = spark.createDataFrame(grams(phrases, templates), "template int, tpos int, w1 string, w2 string, w3 string").withColumn("gram", F.xxhash64("w1", "w2"))
    small = F.broadcast if rows.count() <= MOST_GRAMS else (lambda x: x)
    key = ["doc_id", "text_hash", "n_words"]
    d = renamed(docs, ["doc_id", "text"]).select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("words")).withColumn("n_words", F.size("words"))
    # one row before the first word stands for the text itself
    d = d.select(*key, "words", F.explode(F.sequence(F.lit(-1), F.col("n_words") - 1)).alias("pos"))
    at = [F.get("words", F.col("pos") + j) for j in range(3)]
    same = (F.xxhash64(at[0], at[1]) == F.col("gram")) & (at[0] == F.col("w1")) & (at[1] == F.col("w2")) & (F.col("w3").isNull() | (at[2] == F.col("w3")))
    hits = d.join(small(rows), same, "left").where("template is not null or pos = -1")
    votes = hits.groupBy(*key, "template", (F.col("pos") - F.col("tpos")).alias("start")).agg(F.bit_or(F.expr("shiftleft(1L, tpos)")).alias("hit"), F.count("*").alias("copies"))

    lengths = spark.createDataFrame([(i, len(t.split()), label, i < len(phrases)) for i, (t, label) in enumerate(every)], "template int, length int, label string, exact boolean")
    votes = votes.join(F.broadcast(lengths), "template", "left")  # a row for each template
    n = F.when(F.col("length") <= 3, 2).otherwise(3)
    covered = F.col("hit").bitwiseOR(F.shiftleft("hit", 1)).bitwiseOR(F.when(n == 3, F.shiftleft("hit", 2)).otherwise(F.lit(0)))
    share = F.bit_count(covered) / F.col("length")
    low = F.length(F.regexp_extract(F.bin("hit"), "0*$", 0))
    votes = votes.withColumns({"alone": share, "first": F.col("start") + low, "end": F.col("start") + F.length(F.bin("hit")) - 1 + n})
    order = Window.partitionBy(*key, "template").orderBy("start")
    apart = F.when(F.col("exact") | (F.col("start") - F.lag("start").over(order) > SLACK), 1).otherwise(0)
    places = votes.where("template is not null").withColumn("apart", apart).withColumn("place", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    places = places.groupBy(*key, "template", "place", "length", "label", "exact").agg(F.bit_or("hit").alias("hit"), F.max("alone").alias("alone"), F.min("first").alias("first_word"), F.max("end").alias("end")).withColumn("share", share)
    n_words = F.col("end") - F.col("first_word")
    found = F.when(F.col("exact"), F.col("share") == 1).otherwise((F.col("alone") >= LEAST_SHARE) | ((F.col("share") >= LEAST_SHARE) & (n_words <= 2 * F.col("length"))))
    span = F.when(found, F.struct("first_word", n_words.alias("n_words"), "label", "share", "exact"))
    partly = F.when(~F.col("exact"), F.col("share"))

    texts = votes.where("template is null").select(*key, "copies")
    of_text = places.select(*key, span.alias("span"), partly.alias("partly")).unionByName(texts, allowMissingColumns=True)
    out = of_text.groupBy(*key).agg(F.array_sort(F.collect_list("span")).alias("spans"), F.max("partly").alias("partly"), F.max("copies").alias("copies"))
    base = F.filter("spans", lambda s: s["exact"])

    def joined(spans):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    plain = F.transform("spans", lambda s: F.struct(s["label"].alias("label"), s["first_word"].alias("first_word"), s["n_words"].alias("n_words"), s["share"].alias("share")))
    out = out.withColumn("base", base).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size("base").cast("long").alias("n_base"),
        F.get("base", F.lit(0))["first_word"].cast("long").alias("first_word"),
        F.get("base", F.size("base") - 1)["first_word"].cast("long").alias("last_word"),
        joined(F.col("base")).alias("base_labels"),
        joined(F.col("spans")).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("partly", F.lit(0.0))).alias("score"),
        plain.alias("spans"),
    )
