"""Sharding over fixed virtual slots: records hash into SLOTS slots, and a versioned map says which shard holds each slot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapedeck.llm.common import renamed

SLOTS = 4096


def slot_of(doc_id, text, slots: int = SLOTS):
    """The virtual slot of a record; a record without an id goes by its text."""
    return F.pmod(F.xxhash64(F.coalesce(doc_id, F.crc32(text), F.lit(0))), F.lit(slots)).cast("int")


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return renamed(docs, ["doc_id", "text"]).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), slot_of(F.col("doc_id"), F.col("text"), slots).alias("virtual_slot")
    )


def slot_bytes(records: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and records of each slot that has any: at most SLOTS rows come to the driver."""
    rows = records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    return {r["virtual_slot"]: (r["bytes"], r["n"]) for r in rows}


def even_map(shards: int, slots: int = SLOTS) -> list[int]:
    """The first version of a map: slots dealt out in turn."""
    return [s % shards for s in range(slots)]


def rebalance(mapping: list[int], weights: dict[int, int], shards: int) -> list[int]:
    """The next version of a map: single slots move from the fullest shard to the emptiest while that evens them out.

    Shards above those the map names start empty. Slots that need not move keep their shard.
    """
    mapping, load = list(mapping), [0] * shards
    for slot, shard in enumerate(mapping):
        load[shard] += weights.get(slot, 0)
    held = [sorted((weights[s], s) for s in range(len(mapping)) if mapping[s] == k and weights.get(s)) for k in range(shards)]
    while True:
        full, empty = max(range(shards), key=lambda k: (load[k], -k)), min(range(shards), key=lambda k: (load[k], k))
        gap = load[full] - load[empty]
        best = min((x for x in held[full] if x[0] < gap), key=lambda x: (abs(gap - 2 * x[0]), x[1]), default=None)
        if best is None:
            return mapping
        held[full].remove(best)
        held[empty].append(best)
        mapping[best[1]] = empty
        load[full] -= best[0]
        load[empty] += best[0]


def by_slot(spark: SparkSession, **columns: list[int]) -> DataFrame:
    """A row for each slot, with a value from each of the lists."""
    values = F.array(*[F.split(F.lit(",".join(map(str, v))), ",") for v in columns.values()])
    rows = spark.range(len(next(iter(columns.values())))).select(F.col("id").cast("int").alias("virtual_slot"), values.alias("v"))
    return rows.select("virtual_slot", *[F.get(F.get("v", F.lit(i)), "virtual_slot").cast("long").alias(c) for i, c in enumerate(columns)])


def map_frame(spark: SparkSession, mapping: list[int]) -> DataFrame:
    return by_slot(spark, shard=mapping).withColumn("shard", F.col("shard").cast("int"))


def write_map(spark: SparkSession, mapping: list[int], path: str, version: int) -> None:
    """Store a version of the map beside the older ones."""
    map_frame(spark, mapping).coalesce(1).write.parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int | None = None) -> list[int]:
    """A stored version, by default the latest."""
    maps = spark.read.parquet(path)
    version = maps.agg(F.max("version")).first()[0] if version is None else version
    return [r["shard"] for r in maps.where(F.col("version") == version).orderBy("virtual_slot").collect()]  # SLOTS rows


def latest(spark: SparkSession, path: str) -> int | None:
    """The number of the latest stored version, None before the first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    # a version counts once its table is written whole
    done = [f.getPath() for f in fs.listStatus(folder) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return max((int(p.getName().removeprefix("version=")) for p in done), default=None)


def revise(spark: SparkSession, path: str, weights: dict[int, int], shards: int, slots: int = SLOTS) -> list[int]:
    """The map to place records by, as stored in `path`: the latest version there (the even map, stored first, where there is none),
    rebalanced for the weights, and stored as the next version if a slot moves."""
    version = latest(spark, path)
    if version is None:
        version = 1
        write_map(spark, even_map(shards, slots), path, version)
    held = read_map(spark, path, version)
    if len(held) != slots:
        raise ValueError(f"the stored map has {len(held)} slots, not {slots}")
    moved = rebalance(held, weights, max(shards, max(held) + 1))
    if moved != held:
        version += 1
        write_map(spark, moved, path, version)
    return read_map(spark, path, version)


def assign(docs: DataFrame, *, shards: int = 8, slots: int = SLOTS, mapping: list[int] | None = None, store: str | None = None) -> DataFrame:
    """Each record's shard, under the law that shards hold nearly equal bytes.

    Takes doc_id and text; other columns are not looked at. Returns doc_id, size (UTF-8 bytes and 1; null text: 1),
    text_crc32, law, shard, slot (the record's place in its shard, gapless from 0), grown_shard (null: the map follows
    bytes, not ids alone) and virtual_slot. With `store`, a folder, the map is its latest version, edited for these records
    and stored as the next one; else `mapping` is the version to start from, by default the even map. Records without an id hash by
    their text; repeated rows are records of their own; an empty table gives no rows.
    """
    spark = docs.sparkSession
    records = sized(docs, slots)
    weights = slot_bytes(records)
    loads = {s: b for s, (b, _) in weights.items()}
    mapping = revise(spark, store, loads, shards, slots) if store else rebalance(mapping or even_map(shards, slots), loads, shards)
    base, filled = [], [0] * (max(mapping) + 1)
    for s, shard in enumerate(mapping):
        base.append(filled[shard])
        filled[shard] += weights.get(s, (0, 0))[1]
    places = by_slot(spark, shard=mapping, base=base).withColumn("shard", F.col("shard").cast("int"))
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32")
    out = records.withColumn("r", F.row_number().over(order)).join(F.broadcast(places), "virtual_slot")  # SLOTS rows
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("r") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
