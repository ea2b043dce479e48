"""Sharding over fixed virtual slots.

Each record hashes, by id, size and checksum, to one of ``SLOTS`` virtual slots, for good. Bytes are summed by slot, and a
versioned map says which shard holds which slot. The map is a table of its own: every version is stored, and rebalancing reads the
last one, edits it and stores the next. An edit moves whole slots, so that only the rows of moved slots travel. The law is
``bytes``: the shards' sizes are near equal.

A slot that holds more than ``HOT`` times its fair part (rows alike, of which there are many) is split into slots beyond ``SLOTS``,
over which its rows are spread by their number. Only the sums by slot and the map reach the driver; both have at most
``SLOTS`` * (1 + 1 / ``HOT``) + as many rows, whatever the input.

Defined results: a null text has no bytes and the checksum of an empty one; a record's size is its text's UTF-8 bytes
plus 8; null ids and rows that repeat an id are records like any other, told apart by size and checksum, and rows alike in all of these
are exchangeable; other columns take no part; an empty table gives an empty result. A single record larger than a shard's
fair part makes its shard larger by as much.
"""

from __future__ import annotations

import heapq
import json
import math
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, exists, ready, settle, shared_dir, whole_text

SLOTS = 8192
HOT = 16
SHARDS = 24


@dataclass
class SlotMap:
    """Which shard holds each slot; every edit makes a new version and remembers the slots that moved."""

    shards: int
    holder: dict[int, int]
    version: int = 1
    moved: list[int] = field(default_factory=list)

    @classmethod
    def balanced(cls, sizes: dict[int, int], shards: int) -> SlotMap:
        """The heaviest slot first, each to the shard that is lightest so far."""
        load = [(0, s) for s in range(shards)]
        holder = {}
        for slot, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
            held, shard = heapq.heappop(load)
            holder[slot] = shard
            heapq.heappush(load, (held + size, shard))
        return cls(shards, holder)

    def rebalanced(self, sizes: dict[int, int], shards: int | None = None) -> SlotMap:
        """A new version for new sizes or another number of shards, moving slots only out of shards that hold too much or go."""
        shards = shards or self.shards
        fair = sum(sizes.values()) / shards
        load = [0] * shards
        by_shard: dict[int, list[int]] = {s: [] for s in range(shards)}
        loose = []
        for slot in sorted(sizes):
            at = self.holder.get(slot, shards)
            if at < shards:
                by_shard[at].append(slot)
                load[at] += sizes[slot]
            else:
                loose.append(slot)
        for shard, slots in by_shard.items():
            for slot in sorted(slots, key=lambda s: (sizes[s], s), reverse=True):
                if load[shard] - sizes[slot] >= fair:
                    load[shard] -= sizes[slot]
                    loose.append(slot)
        holder = {s: h for s, h in self.holder.items() if h < shards and s in sizes}
        heap = [(x, s) for s, x in enumerate(load)]
        heapq.heapify(heap)
        for slot in sorted(loose, key=lambda s: (-sizes[s], s)):
            held, shard = heapq.heappop(heap)
            holder[slot] = shard
            heapq.heappush(heap, (held + sizes[slot], shard))
        moved = sorted(s for s in holder if self.holder.get(s) != holder[s])
        return SlotMap(shards, holder, self.version + 1, moved)

    def rows(self) -> list[tuple[int, int, int]]:
        return [(self.version, slot, shard) for slot, shard in sorted(self.holder.items())]

    def save(self, spark: SparkSession, path: str) -> None:
        """Appends this version to the map's table; older versions stay readable."""
        line = json.dumps({"shards": self.shards, "moved": self.moved})
        spark.createDataFrame([(*r, line) for r in self.rows()], "version int, slot int, shard int, about string").coalesce(1).write.mode("append").partitionBy("version").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        table = spark.read.parquet(path)
        version = version or table.agg(F.max("version")).first()[0] or 0
        found = table.where(F.col("version") == version).collect()  # a row for each slot
        if not found:
            return cls(0, {}, version)
        about = json.loads(found[0]["about"])
        return cls(about["shards"], {r["slot"]: r["shard"] for r in found}, version, about["moved"])


def slotted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(id, size, text_crc32, vslot) of each row."""
    text = whole_text(text_col)
    rows = df.select(F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"))
    return rows.withColumn("vslot", F.pmod(F.xxhash64("id", "size", "text_crc32"), F.lit(slots)).cast("int"))


def slot_sums(rows: DataFrame) -> list:
    """(vslot, bytes, n, most) of the slots in use, at most one row for each slot there is; most: the largest row."""
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.max("size").alias("most")).orderBy("vslot").collect()


def _split(rows: DataFrame, sums: list, slots: int) -> DataFrame | None:
    """rows with the slots that hold too much split; None where there is none."""
    fair = max(1, math.ceil(sum(r["bytes"] for r in sums) / slots))
    begin, hot = slots, []
    for r in sums:
        ways = min(r["n"], math.ceil(r["bytes"] / fair))
        if r["bytes"] - r["most"] > HOT * fair:  # one large record can't be split
            hot.append((r["vslot"], begin, ways))
            begin += ways
    if not hot:
        return None
    table = F.broadcast(rows.sparkSession.createDataFrame(hot, "vslot int, first int, ways int"))  # at most slots / HOT rows
    turn = F.pmod(F.xxhash64("turn"), F.col("ways")).cast("int")
    rows = rows.withColumn("turn", F.monotonically_increasing_id()).join(table, "vslot", "left")
    return rows.withColumn("vslot", F.coalesce(F.col("first") + turn, F.col("vslot"))).drop("turn", "first", "ways")


def sharded(df: DataFrame, shards: int = SHARDS, map_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> tuple[DataFrame, SlotMap]:
    """Rows (id, size, text_crc32, vslot, shard, slot) and the map; slot is a row's place in its shard, without gaps from 0.

    The map is stored at ``map_path``. Where one lies there already, its next version is made by moving as few slots as the new
    sizes ask for; without a path a new map is stored in the shared folder.
    """
    spark = ready(df.sparkSession)
    rows = slotted(df, id_col, text_col, slots)
    sums = slot_sums(rows)
    split = _split(rows, sums, slots)
    if split is not None:
        # which of the rows alike goes where must not change when a task runs again
        rows = settle(split, "slotted")
        sums = slot_sums(rows)
    sizes = {r["vslot"]: r["bytes"] for r in sums}
    new = map_path is None
    map_path = map_path or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    held = None if new or not exists(spark, map_path) else SlotMap.load(spark, map_path)
    (held.rebalanced(sizes, shards) if held else SlotMap.balanced(sizes, shards)).save(spark, map_path)
    slot_map = SlotMap.load(spark, map_path) if sizes else SlotMap(shards, {})
    begin, table = [0] * shards, []
    for r in sums:
        shard = slot_map.holder[r["vslot"]]
        table.append((r["vslot"], shard, begin[shard]))
        begin[shard] += r["n"]
    table = spark.createDataFrame(table, "vslot int, shard int, begin long")
    place = F.row_number().over(Window.partitionBy("vslot").orderBy("id", "size", "text_crc32"))
    placed = rows.withColumn("place", place).join(F.broadcast(table), "vslot")  # a row for each slot
    return placed.select("id", "size", "text_crc32", "vslot", "shard", (F.col("begin") + F.col("place") - 1).cast("long").alias("slot")), slot_map


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    path = f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    # the stored map of SHARDS - 1 shards is edited to hold one more
    sharded(docs, SHARDS - 1, path)
    rows, slot_map = sharded(docs, SHARDS, path)
    return rows.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", F.lit(slot_map.version).alias("map_version")
    )
