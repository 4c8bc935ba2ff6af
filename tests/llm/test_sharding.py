import zlib
from collections import defaultdict

import pytest

from tapedeck.llm import sharding
from tests.llm.fixtures import SF, awkward, frame


def test_awkward_rows(spark):
    rows = awkward()
    got = sharding.assign(frame(spark, rows)).collect()
    want = sorted((d if d is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 8
        places[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in places.values())


def test_shards_hold_nearly_equal_bytes(spark):
    got = sharding.assign(spark.read.parquet(f"{SF}/../sf0.01/documents.parquet")).collect()
    load = defaultdict(int)
    for r in got:
        load[r.shard] += r.size
    assert max(load.values()) - min(load.values()) < 0.01 * sum(load.values()) / 8


def test_rebalance_moves_little_and_versions_are_kept(spark, tmp_path):
    weights = {s: 10 + s % 7 for s in range(sharding.SLOTS)}
    first = sharding.rebalance(sharding.even_map(8), weights, 8)
    grown = sharding.rebalance(first, weights, 9)
    load = [sum(weights[s] for s in weights if grown[s] == k) for k in range(9)]
    assert max(load) - min(load) <= 16
    moved = [s for s in range(sharding.SLOTS) if first[s] != grown[s]]
    to_new = [s for s in moved if grown[s] == 8]  # a few others even out the old shards
    assert len(to_new) > 0.98 * len(moved) and len(moved) < sharding.SLOTS / 8
    sharding.write_map(spark, first, str(tmp_path / "map"), 1)
    sharding.write_map(spark, grown, str(tmp_path / "map"), 2)
    assert sharding.read_map(spark, str(tmp_path / "map")) == grown
    assert sharding.read_map(spark, str(tmp_path / "map"), 1) == first


def test_empty_table(spark):
    assert sharding.assign(frame(spark, [])).count() == 0


def test_stored_versions_are_edited_in_turn(spark, tmp_path):
    path = str(tmp_path / "maps")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sharding.latest(spark, path) is None
    first = {r.doc_id: (r.shard, r.slot) for r in sharding.assign(docs, store=path).collect()}
    assert sharding.latest(spark, path) == 2 and sharding.read_map(spark, path, 1) == sharding.even_map(8)
    assert first == {r.doc_id: (r.shard, r.slot) for r in sharding.assign(docs).collect()}
    # the same records again: nothing moves, no new version
    assert first == {r.doc_id: (r.shard, r.slot) for r in sharding.assign(docs, store=path).collect()} and sharding.latest(spark, path) == 2
    # one more shard: few slots move, and those that stay keep their shard
    grown = {r.doc_id: r.shard for r in sharding.assign(docs, shards=9, store=path).collect()}
    assert sharding.latest(spark, path) == 3 and set(grown.values()) == set(range(9))
    assert sum(grown[d] != s for d, (s, _) in first.items()) < len(first) / 4
    with pytest.raises(ValueError):
        sharding.assign(docs, slots=64, store=path)
    assert sharding.assign(docs.limit(0), store=path).count() == 0 and sharding.latest(spark, path) == 3
