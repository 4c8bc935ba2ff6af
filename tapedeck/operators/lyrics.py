"""Lyrics, covers, vectors and how well rankings agree with ratings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapedeck.functions.columns import fold


def shingles(df: DataFrame, id: str, text: str, n: int = 5) -> DataFrame:
    """id, shingles: 64-bit hashes of the different runs of n words (letters, digits and _) of the lower-cased text."""
    words = F.filter(F.split(F.regexp_replace(fold(F.col(text)), r"[^a-z0-9_]+", " "), " "), lambda w: w != "")
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.xxhash64(F.slice("w", i, n)))
    return df.select(id, words.alias("w")).select(id, F.when(F.size("w") >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>")).alias("shingles"))


def jaccard_pairs(pairs: DataFrame, sets: DataFrame, *, id: str, least: float = 0.05) -> DataFrame:
    """pairs (a, b) with the similarity of their sets, 1 if both are empty, and whether it is enough."""
    out = pairs.join(sets.select(F.col(id).alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col(id).alias("b"), F.col("shingles").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    total = F.size("x") + F.size("y") - both
    return out.withColumn("jaccard", F.when(total == 0, 1.0).otherwise(F.round(both / total, 6))).withColumn("passes", F.col("jaccard") >= least).drop("x", "y")


MARKERS = r"\s*[\(\[-]\s*(live|remaster(ed)?|acoustic|demo|cover|remix)\b.*$"


def title_key(c: Column) -> Column:
    """A title without what marks a version of it."""
    return F.trim(F.regexp_replace(fold(c), MARKERS, ""))


#: Seeds that are broadcast; more are joined by a shuffle.
MOST_SEEDS = 500_000


def cover_candidates(seeds: DataFrame, catalog: DataFrame) -> DataFrame:
    """Recordings of the catalog (uri, track, artist) that may be covers of a seed: the same base title by another artist,
    or by the same artist under another title with a version marker."""
    s = seeds.select(F.col("uri").alias("seed"), title_key(F.col("track")).alias("title"), fold(F.col("artist")).alias("seed_artist"), fold(F.col("track")).alias("seed_track")).distinct()
    full = fold(F.col("track"))
    c = catalog.select(F.col("uri").alias("candidate"), title_key(F.col("track")).alias("title"), fold(F.col("artist")).alias("artist"), full.alias("full"), full.rlike(MARKERS).alias("has_marker"))
    # pairs are far more than rows: they are made where a part of the catalog lies, and only rows of repeated uris have to meet again
    parts = 8 * catalog.sparkSession.sparkContext.defaultParallelism
    c = c.repartition(parts, "candidate").distinct().withColumn("more", F.count("*").over(Window.partitionBy("candidate")) > 1)
    s = s.withColumn("of_more", F.count("*").over(Window.partitionBy("seed")) > 1)
    few = F.broadcast(s) if s.count() <= MOST_SEEDS else s
    other = F.col("artist") != F.col("seed_artist")
    marked = (F.col("artist") == F.col("seed_artist")) & (F.col("full") != F.col("seed_track")) & F.col("has_marker")
    j = c.join(few, "title").where("seed <> candidate").where(other | marked)
    again = F.col("more") | F.col("of_more")
    once = j.where(~again).select("seed", "candidate", other.alias("by_title"), marked.alias("by_version"))
    return once.unionByName(j.where(again).groupBy("seed", "candidate").agg(F.max(other).alias("by_title"), F.max(marked).alias("by_version")))


def audio_distance(pairs: DataFrame, features: DataFrame, names: list[str], *, id: str, far: float = 0.7) -> DataFrame:
    """pairs (a, b) with the distance of their features (0 to 1 each) over the root of their number, null without features, and its bucket."""
    f = features.select(id, F.array(*names).alias("f"))
    out = pairs.join(f.select(F.col(id).alias("a"), F.col("f").alias("x")), "a", "left").join(f.select(F.col(id).alias("b"), F.col("f").alias("y")), "b", "left")
    square = F.aggregate(F.zip_with("x", "y", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda t, v: t + v)
    d = F.round(F.sqrt(square / len(names)), 6)
    return out.withColumn("distance", d).withColumn("bucket", F.when(F.col("distance").isNull(), "no data").when(F.col("distance") >= far, "far").otherwise("near")).drop("x", "y")


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, v: t + v)


def _unit(rows: pd.DataFrame) -> np.ndarray:
    a = np.array(rows["v"].tolist(), np.float64)
    norm = np.linalg.norm(a, axis=1, keepdims=True)
    return np.where(np.isfinite(norm), a / np.maximum(norm, 1e-300), 0.0)


def _asked(q: pd.DataFrame, a: np.ndarray, m: pd.DataFrame, b: np.ndarray, k: int):
    """For each row of q its k best of m, whose ids ascend; some hundred rows at a time."""
    ids, mine = m["id"].to_numpy(), q["id"].to_numpy()
    for i in range(0, len(mine), 512):
        cosine = np.round(a[i : i + 512] @ b.T, 6)
        cosine[mine[i : i + 512, None] == ids] = -2
        if k < len(ids):
            # all that reach the k-th value, then ties by id
            low = np.partition(cosine, len(ids) - k, axis=1)[:, len(ids) - k, None]
            row, at = np.nonzero(cosine >= low)
        else:
            row, at = np.nonzero(cosine > -2)
        best = np.lexsort((at, -cosine[row, at], row))
        row, at = row[best], at[best]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        good = (place < k) & (cosine[row, at] > -2)
        row, at = row[good], at[good]
        yield pd.DataFrame({"query": mine[i + row], "match": ids[at], "cosine": cosine[row, at]})


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "match"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, *, id: str, vector: str, k: int = 10, block_rows: int = 8192) -> DataFrame:
    """The k vectors most alike (cosine) to each query vector, exactly: query, match, cosine, rank.

    Vectors and queries are dealt into blocks of about `block_rows`; each block of the one meets each of the other in a task
    of its own, which keeps k matches a query. A zero vector, or one with a component that is null or not finite, is like
    nothing (0); null vectors have no rows and match nothing.
    """
    kind = dict(vectors.dtypes)[id]
    sides = []
    for df, name in ((queries, "x"), (vectors, "y")):
        df = df.where(F.col(vector).isNotNull())
        sides.append((df.select(F.col(id).alias("id"), F.col(vector).alias("v"), F.pmod(F.xxhash64(id), F.lit(n := 1 + df.count() // block_rows)).alias(name)), n))
    (q, q_blocks), (v, v_blocks) = sides
    asked = q.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(v_blocks - 1).cast("long"))))
    known = v.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))))

    def best(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if q.empty or v.empty:
            return pd.DataFrame({"query": [], "match": [], "cosine": []})
        v = v.sort_values("id")
        return pd.concat(_asked(q, _unit(q), v, _unit(v), k))

    # as many parts as meetings, so that none waits for another
    met = [df.repartition(min(q_blocks * v_blocks, 100_000), "x", "y").groupBy("x", "y") for df in (asked, known)]
    return _ranked(met[0].cogroup(met[1]).applyInPandas(best, f"query {kind}, match {kind}, cosine double"), k)


def knn_table(vectors: DataFrame, *, id: str, vector: str, k: int = 10, block_rows: int = 4096) -> DataFrame:
    """The k vectors most alike (cosine) to each vector of a table, exactly: query, match, cosine, rank.

    Vectors are dealt into blocks of about `block_rows`, and each two blocks meet once, in a task that answers for both: a
    vector is shipped once for each block, and no task holds more than two. Of each meeting a vector keeps k matches,
    and Spark ranks what it kept. A zero vector is like nothing (0); null vectors have no rows and match nothing.
    """
    vectors = vectors.where(F.col(vector).isNotNull())
    blocks = 1 + vectors.count() // block_rows
    placed = vectors.select(F.col(id).alias("id"), F.col(vector).alias("v"), F.pmod(F.xxhash64(id), F.lit(blocks)).alias("block"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    met = met.select(F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), F.col("block").alias("own"), "id", "v")

    def best(pdf):
        x, y = pdf["x"].iloc[0], pdf["y"].iloc[0]
        sides = [pdf[pdf["own"] == n].sort_values("id") for n in ((x,) if x == y else (x, y))]
        if any(s.empty for s in sides):
            return pd.DataFrame({"query": [], "match": [], "cosine": []})
        units = [_unit(s) for s in sides]
        found = [*_asked(sides[0], units[0], sides[-1], units[-1], k)]
        if x != y:
            found += _asked(sides[1], units[1], sides[0], units[0], k)
        return pd.concat(found)

    kind = dict(vectors.dtypes)[id]
    return _ranked(met.groupBy("x", "y").applyInPandas(best, f"query {kind}, match {kind}, cosine double"), k)


def hybrid_rank(scores: DataFrame, *, id: str, a: str, b: str) -> DataFrame:
    """Mean of the z-scores of two columns; means and spreads come from one row."""
    stats = scores.agg(*[f(c).alias(f"{n}_{c}") for c in (a, b) for n, f in (("m", F.avg), ("s", F.stddev_pop))])

    def z(c: str) -> Column:
        return F.when(F.col(f"s_{c}") > 0, (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).otherwise(0.0)

    return scores.join(F.broadcast(stats), how="cross").select(id, a, b, F.round((z(a) + z(b)) / 2, 6).alias("hybrid"))


def average_ranks(df: DataFrame, c: str) -> DataFrame:
    """c, rank: of each different value, ties at their mean rank."""
    counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy(c).rowsBetween(Window.unboundedPreceding, 0))
    return counts.select(c, (upto - (F.col("n") - 1) / 2).alias("rank"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation of two columns; ranks are of different values, which are far fewer than rows."""
    df = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranks = df.join(average_ranks(df, x).withColumnRenamed("rank", "rx"), x).join(average_ranks(df, y).withColumnRenamed("rank", "ry"), y)
    return ranks.agg(F.count("*").alias("n"), F.round(F.corr("rx", "ry"), 6).alias("rho"))


def feature_correlations(df: DataFrame, features: list[str], rating: str) -> DataFrame:
    """Correlation of each feature with the rating."""
    one = df.agg(*[F.round(F.corr(f, rating), 6).alias(f) for f in features])
    return one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("r")) for f in features])).alias("x")).select("x.*")


def mean_by(df: DataFrame, category: str, rating: str) -> DataFrame:
    return df.groupBy(category).agg(F.count("*").alias("n"), F.round(F.avg(rating), 6).alias("mean"))


def topk_eval(df: DataFrame, *, id: str, rank: str, rating: str, k: int) -> DataFrame:
    """Mean rating of the first and the last k by a ranking column."""
    first = df.orderBy(rank, id).limit(k).agg(F.round(F.avg(rating), 6).alias("top_mean"))
    return first.join(df.orderBy(F.desc(rank), F.desc(id)).limit(k).agg(F.round(F.avg(rating), 6).alias("bottom_mean")), how="cross")


def stratified_sample(df: DataFrame, *, id: str, stratum: str, sizes: dict[int, int], seed: int) -> DataFrame:
    """So many rows of each stratum, by a hash of id and seed."""
    picks = F.create_map(*[F.lit(v) for kv in sizes.items() for v in kv])
    order = Window.partitionBy(stratum).orderBy(F.md5(F.concat(F.col(id).cast("string"), F.lit(f"/{seed}"))), id)
    return df.where(F.col(stratum).isin(*sizes)).withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= picks[F.col(stratum)])


def embedding_inputs(df: DataFrame, *, id: str, text: str, most: int = 8000) -> DataFrame:
    """The text that an embedding sees and its hash."""
    return df.select(id, F.substring(F.coalesce(text, F.lit("")), 1, most).alias("input")).withColumn("sha256", F.sha2("input", 256))


def shared_writers(pairs: DataFrame, credits: DataFrame) -> DataFrame:
    """How many people are credited for both recordings of each pair (a, b)."""
    c = credits.select("uri", "person").distinct()
    both = pairs.join(c.withColumnRenamed("uri", "a"), "a").join(c.withColumnRenamed("uri", "b"), ["b", "person"])
    return pairs.join(both.groupBy("a", "b").agg(F.count("*").alias("n")), ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("shared"))


def centroid_similarity(vectors: DataFrame, seeds: DataFrame, *, id: str, vector: str) -> DataFrame:
    """Cosine of every vector with the mean of the seeds' vectors, which is one row."""
    parts = vectors.join(seeds.select(id), id, "left_semi").select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("centroid"))
    norm = F.sqrt(_dot(vector, vector)) * F.sqrt(_dot("centroid", "centroid"))
    scored = vectors.join(F.broadcast(mean), how="cross").withColumn("norm", norm)
    return scored.select(id, F.when(F.col("norm") > 0, F.round(_dot(vector, "centroid") / F.col("norm"), 6)).otherwise(0.0).alias("similarity"))


def topk_overlap(df: DataFrame, *, id: str, a: str, b: str, k: int) -> DataFrame:
    """How many ids are among the first k of two rankings."""
    first = df.orderBy(a, id).limit(k).select(id)
    return first.intersect(df.orderBy(b, id).limit(k).select(id)).agg(F.count("*").alias("both"))
