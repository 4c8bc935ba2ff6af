import numpy as np
import pytest

from tapedeck.operators import covers as v
from tapedeck.operators import lyrics as ly

SONGS = "uri string, track string, artist string, work_id int"


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_versions_are_found_three_ways(spark):
    songs = [("s", "Blue Moon", "Ann", 1), ("w", "Luna", "Bob", 1), ("t", "BLUE MOON (Live)", "Cy", None), ("a", "Blue Moon - Remix", "ann", 1), ("p", "Blue Moon", "Ann", None), ("n", None, None, None)]
    c = spark.createDataFrame(songs, SONGS)
    got = v.find_versions(c.where("uri in ('s', 'n')"), c)
    assert rows(got) == [("s", "a", "mb_work", True, False, True), ("s", "t", "spotify_search", False, True, False), ("s", "w", "mb_work", True, False, False)]
    assert v.find_versions(c.limit(0), c).count() == v.find_versions(c, c.limit(0)).count() == 0


def test_audio_is_scaled_and_may_be_missing(spark):
    names = ", ".join(f"{n} double" for n in v.FEATURES)
    one, two = [0.5] * 5 + [-70.0, 0.1, 500.0, 0.2], [0.5] * 5 + [-30.0, 0.1, 125.0, 0.2]
    f = spark.createDataFrame([("a", *one), ("b", *two), ("c", *two[:-1], None)], f"uri string, {names}")
    pairs = spark.createDataFrame([("a", "b"), ("b", "b"), ("a", "c"), ("a", "z")], "seed string, candidate string")
    got = {(r.seed, r.candidate): r for r in v.version_audio(pairs, f).collect()}
    ab = got["a", "b"]
    assert ab.audio_distance == round(0.5**0.5, 4) and ab.audio_bucket == "different_sonic_world" and (ab.audio_feature_deltas["loudness"], ab.audio_feature_deltas["tempo"]) == (0.5, -0.5)
    assert got["b", "b"].audio_distance == 0 and got["b", "b"].audio_bucket == "alternate_version" and not got["b", "b"].no_audio_data
    for p in (("a", "c"), ("a", "z")):
        assert got[p].audio_distance is None and got[p].no_audio_data and got[p].audio_feature_deltas is None and got[p].audio_bucket == "alternate_version"


def test_writers_statuses_and_seeds(spark):
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "seed string, candidate string")
    credits = spark.createDataFrame([("a", "Zoe", "writer"), ("b", "Zoe", "composer"), ("a", "Al", "lyricist"), ("b", "Al", "writer"), ("b", "Al", "lyricist"), ("a", "Pat", "producer"), ("b", "Pat", "writer"), ("c", None, "writer")], "uri string, person string, role string")
    p = v.writers_in_common(pairs, credits)
    assert rows(p) == [("a", "b", ["Al", "Zoe"]), ("a", "c", None)]
    plays = spark.createDataFrame([("b",), ("b",), ("z",)], "uri string")
    status = spark.createDataFrame([("b", "ok"), ("b", "error")], "uri string, status string")
    assert rows(v.covers_enriched(p, plays, status, status.limit(0)).drop("shared_writers")) == [("a", "b", 2, True, "ok", None), ("a", "c", 0, False, None, None)]
    seeds = spark.createDataFrame([("a", 1), ("q", None)], "uri string, work_id int")
    kept = spark.createDataFrame([("a", True)], "seed string, no_audio_data boolean")
    assert rows(v.cover_seed_summary(seeds, pairs, kept)) == [("a", "both", 2, 1, 1), ("q", "spotify_only", 0, 0, 0)]


@pytest.mark.parametrize("block_rows", [7, 50, 1000])
def test_neighbours_are_those_of_all_pairs_whatever_the_blocks(spark, block_rows):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4))
    x[10:14] = x[3]
    x[20] = 0
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(99, None)], "id int, v array<double>")
    norm = np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    cosine = np.round((x / norm) @ (x / norm).T, 6)
    want = {(i, j) for i in range(60) for j in sorted((j for j in range(60) if j != i), key=lambda j: (-cosine[i, j], j))[:6]}
    got = ly.knn_table(df, id="id", vector="v", k=6, block_rows=block_rows).collect()
    assert {(r.query, r.match) for r in got} == want and len(got) == 360
    assert ly.knn_table(df.limit(0), id="id", vector="v").count() == 0
    assert len(ly.knn_table(df.where("id < 3"), id="id", vector="v", k=6, block_rows=block_rows).collect()) == 6


def test_twins_against_chance(spark):
    near = spark.createDataFrame([(1, 2), (2, 1), (1, 3), (3, 9)], "query int, match int")
    ratings = spark.createDataFrame([(1, 5), (2, 3), (3, None), (4, 1)], "id int, rating int")
    got = v.twin_concordance(near, ratings, digits=0).first()
    assert (got.pairs, got.mean_difference, got.random_pairs) == (2, 2.0, 2) and got.random_difference is not None
    empty = v.twin_concordance(near.limit(0), ratings.limit(0)).first()
    assert empty.pairs == empty.random_pairs == 0 and empty.mean_difference is None
