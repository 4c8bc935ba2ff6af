"""Small tables with the awkward rows that every operator must take: nulls, empty, long, repeated, clashing columns."""

import random

SF = "/root/testdata/sf0.001"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    syllables = ["ka", "lo", "mi", "ter", "ren", "sha", "bo", "ing", "est", "ur"]
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n))


def edited(text: str, at: list[int]) -> str:
    w = text.split()
    for i in at:
        w[i] = "edited"
    return " ".join(w)


def awkward() -> list[tuple]:
    a, b = prose(1, 120), prose(2, 300)
    return [
        (0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "two words"), (5, "Two  WORDS"), (6, a), (7, a), (8, edited(a, [5])),
        (9, b), (10, edited(b, [100, 200])), (10, edited(b, [100, 200])), (11, prose(3, 6000)), (None, a), (12, "x" * 30000), (13, "É" * 50 + " été " + a.upper()),
    ]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:  # names that operators use inside
        df = df.selectExpr("*", "1 as a", "2 as b", "'z' as rank", "'q' as slot", "3L as component", "'s' as source", "'en' as lang", "array(1) as tokens", "cast(length(text) as long) as n_chars")
    return df
