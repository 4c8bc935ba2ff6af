import math
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from tapedeck.operators.history import lost_favorites, track_affinity
from tapedeck.operators.queues import smart_queue

AS_OF = "2024-01-01"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    end, out = datetime(2024, 1, 1), []
    for user in (1, 2):
        for u in range(60):
            gone = u % 5 == 0
            for _ in range(r.randrange(2, 14)):
                ts = end - timedelta(days=r.randrange(800, 1500) if gone else r.randrange(1, 900), hours=r.randrange(24))
                skip = u % 7 == 3 and r.random() < 0.8
                out.append((user, ts if not skip else end - timedelta(days=2), f"spotify:track:{u}", f"Song {u}", f"{'ABCDEFGHIJKLMNOPQ'[u % 17]}", r.randrange(8, 40) / 8, 1000 if skip else 90_000, "fwdbtn" if skip else "trackdone"))
    return [(*x, x[1].year, x[1].month, (x[1].hour + 19) % 24) for x in out]


def frame(spark, rows):
    return spark.createDataFrame(rows, "user_id long, ts timestamp, uri string, track_name string, artist_name string, minutes double, ms_played long, reason_end string, year int, month int, local_hour int")


def step_by_step(spark, rows, *, minutes, mode="default", familiarity=0.5, seed=None, years=(), core=()):
    """The queue made by a sequential walk."""
    x, target = frame(spark, rows), math.ceil(minutes / 3.5)
    artist = {r[2]: r[4].lower() for r in rows}
    skipped = Counter(r[2] for r in rows if r[7] == "fwdbtn" and r[6] < 30_000 and r[1] >= datetime(2023, 12, 2))
    n, morning = Counter(r[2] for r in rows), Counter(r[2] for r in rows if 6 <= r[10] <= 10)
    era = {r[2] for r in rows if r[8] in years}
    pool = sorted(((r.affinity, r.uri) for r in track_affinity(x, as_of=AS_OF).collect()), key=lambda a: (-a[0], a[1]))[: 8 * target]
    cands = []
    for affinity, uri in pool:
        if skipped[uri] >= 3 and uri != seed:
            continue
        known = math.log2(n[uri])
        weight = 1 + (familiarity - 0.5) * 2 * known * 0.05 if familiarity > 0.5 else 1 + (0.5 - familiarity) * 2 * (1 / (1 + known * 0.3))
        score = math.floor(affinity * (1.15 if artist[uri] in core else 1.0) * weight * 100 + 0.5) / 100
        if mode == "era" and uri not in era:
            continue
        if mode == "morning":
            score *= 1 + morning[uri] * 0.1
        if seed and artist[uri] == (artist[seed] if seed in artist else seed.lower()):
            score *= 1.3
        cands.append((-score, uri))
    lost, slots = [], 0
    if mode == "rediscover" or familiarity < 0.3:
        slots = int(target * 0.3 + 0.5)
        lost = [(-r.plays, r.uri) for r in lost_favorites(x, as_of=AS_OF, min_plays=4, years_gone=2, limit=target).collect() if skipped[r.uri] < 3]
    counts, queue, names = Counter(), [], {u for _, u in lost}
    for _, uri in sorted(cands):
        if len(queue) < target - slots and uri not in names and counts[artist[uri]] < 3:
            counts[artist[uri]] += 1
            queue.append(uri)
    i = 0
    for _, uri in sorted(lost):
        if i < slots and counts[artist[uri]] < 3:
            counts[artist[uri]] += 1
            queue.insert(min(len(queue), (i + 1) * 3), uri)
            i += 1
    return queue


@pytest.mark.parametrize("how", [{}, {"mode": "morning", "core": ["a", "c"]}, {"mode": "era", "years": [2022], "familiarity": 0.9}, {"mode": "rediscover"}, {"familiarity": 0.1, "seed": "b"}, {"seed": "spotify:track:3"}, {"seed": "spotify:track:none"}], ids=str)
def test_queues_are_those_of_a_walk_step_by_step(spark, rows, how):
    x = frame(spark, rows)
    got = smart_queue(x, as_of=AS_OF, minutes=60, min_plays=4, by=("user_id",), **how).collect()
    for user in (1, 2):
        mine = [r for r in rows if r[0] == user]
        queue = sorted((r for r in got if r.user_id == user), key=lambda r: r.position)
        want = step_by_step(spark, mine, minutes=60, **how) if how.get("seed") != "spotify:track:none" else step_by_step(spark, mine, minutes=60)
        assert [r.uri for r in queue] == want and [r.position for r in queue] == list(range(len(want))) and len(want) >= 10
    one = smart_queue(frame(spark, [r for r in rows if r[0] == 1]), as_of=AS_OF, minutes=60, min_plays=4, **how)
    if how.get("seed") != "spotify:track:none":
        assert [r.uri for r in sorted(one.collect(), key=lambda r: r.position)] == [r.uri for r in sorted((r for r in got if r.user_id == 1), key=lambda r: r.position)]


def test_modes_and_empty_histories(spark, rows):
    x = frame(spark, rows)
    with pytest.raises(ValueError, match="mode"):
        smart_queue(x, as_of=AS_OF, minutes=60, mode="party")
    for mode in ("default", "rediscover"):
        assert smart_queue(x.limit(0), as_of=AS_OF, minutes=60, mode=mode, seed="spotify:track:3").collect() == []
    reasons = {r.reason for r in smart_queue(x, as_of=AS_OF, minutes=60, seed="b", core=["a"], by=("user_id",)).collect()}
    assert reasons <= {"never-stale core", "high recent affinity", "seed companion"} and "seed companion" in reasons
