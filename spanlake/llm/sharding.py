"""Sharding by fixed virtual slots.

A record's hash puts it into one of SLOTS virtual slots for good. Bytes are
summed per slot (a fixed number of rows), and a versioned table maps slots to
shards: version 1 deals slots out in turn, every later version records an edit
of the one before (rebalancing, one more shard). Only slots that an edit names
move. All row work is DataFrame functions; the driver edits the map, whose size
is fixed.
"""

from __future__ import annotations

from bisect import bisect_right, insort

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, new_path

#: Virtual slots; never changed once data is placed.
SLOTS = 4096
#: Parts of a virtual slot whose rows are numbered apart.
PARTS = 16
#: What a record costs besides its text.
ROW_BYTES = 8


def virtual_slot(docs: DataFrame) -> Column:
    """The slot of a record, from its doc_id and text: rows with one null id, or copies under many ids, spread out."""
    return F.pmod(F.xxhash64(F.lit("slot"), docs["doc_id"].cast("long"), docs["text"]), F.lit(SLOTS)).cast("int")


def record_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def slot_bytes(rows: DataFrame) -> list[int]:
    """Bytes of every slot, from rows (virtual_slot, size): SLOTS numbers."""
    out = [0] * SLOTS
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("n")).collect():
        out[r["virtual_slot"]] = r["n"]
    return out


def rebalanced(owner: list[int], sizes: list[int], shards: int) -> list[int]:
    """The map after moving slots from the fullest shard to the emptiest, as long as that lessens their gap.

    Each move takes the slot nearest to half of the gap; where no slot fits
    between the two, the fullest tries the next emptier shards.
    """
    owner = list(owner)
    load = [0] * shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, (s, n) in enumerate(zip(owner, sizes, strict=True)):
        load[s] += n
        if n:
            insort(held[s], (n, slot))
    for _ in range(8 * len(owner)):
        order = sorted(range(shards), key=lambda s: (load[s], s))
        best = None
        for a, b in ((order[-1], order[0]), *((order[-1], s) for s in order[1:-1]), *((s, order[0]) for s in order[1:-1])):
            gap = load[a] - load[b]
            at = bisect_right(held[a], (gap // 2, len(owner)))
            for n, slot in held[a][max(0, at - 1) : at + 1]:
                if n < gap and (best is None or abs(gap - 2 * n) - gap < best[0]):
                    best = (abs(gap - 2 * n) - gap, a, b, n, slot)
            if best:
                break
        if not best:
            break
        _, a, b, n, slot = best
        held[a].remove((n, slot))
        insort(held[b], (n, slot))
        load[a], load[b], owner[slot] = load[a] - n, load[b] + n, b
    return owner


def grown(owner: list[int], sizes: list[int], shards: int) -> list[int]:
    """The map with one more shard, which takes slots from the fullest shards only into itself, up to its fair share."""
    owner, load, held = list(owner), [0] * shards, [[] for _ in range(shards)]
    for slot, (s, n) in enumerate(zip(owner, sizes, strict=True)):
        load[s] += n
        insort(held[s], (n, slot))
    fair, own = sum(load) / (shards + 1), 0
    while True:
        s = max(range(shards), key=lambda x: (load[x], -x))
        at = bisect_right(held[s], (min(fair - own, load[s] - own), len(owner)))
        if not at or load[s] <= fair or not (pick := held[s][at - 1])[0]:
            return owner
        held[s].pop(at - 1)
        load[s], own, owner[pick[1]] = load[s] - pick[0], own + pick[0], shards


class SlotMap:
    """The versioned slot-to-shard table: rows (version, slot, shard, bytes, why), one version after the other."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, version: int, owner: list[int], sizes: list[int], why: str) -> None:
        rows = [(version, slot, shard, n, why) for slot, (shard, n) in enumerate(zip(owner, sizes, strict=True))]
        self.spark.createDataFrame(rows, "version int, slot int, shard int, bytes long, why string").coalesce(1).write.mode("append").parquet(self.path)

    def table(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def read(self, version: int | None = None) -> DataFrame:
        """(slot, shard) of a version, the last one if none is named."""
        t = self.table()
        if version is None:
            version = t.agg(F.max("version")).first()[0]
        return t.filter(F.col("version") == version).select("slot", "shard")


def place(docs: DataFrame, shards: int, path: str | None = None) -> DataFrame:
    """Shard and place of every row of docs (doc_id, text; other columns are ignored), sizes near equal.

    (doc_id, size, text_crc32, virtual_slot, shard, slot): slot numbers a
    shard's rows from 0 without gaps; the order inside a virtual slot is not
    stated. Null texts count as empty, null ids hash as null, texts of any
    length are read whole; rows that repeat are placed one by one (equal ones
    in one virtual slot, numbered in PARTS tasks), ties of load go to the lower
    shard; an empty table gives an empty result. The map with its versions is kept at `path`, a
    new folder of the shared one if none is given.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), record_size(F.col("text")).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), virtual_slot(docs).alias("virtual_slot"), F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int").alias("part"))
    rows = materialize(rows, "records")  # part is kept with the rows, so that a task that runs again finds it as it was
    sizes = slot_bytes(rows)
    store = SlotMap(spark, path or new_path(spark, "slot_map"))
    owner = [slot % shards for slot in range(SLOTS)]
    store.write(1, owner, sizes, "dealt in turn")
    store.write(2, rebalanced(owner, sizes, shards), sizes, "rebalanced by bytes")
    # places: rows are numbered inside each part of a virtual slot, whose start is a sum over a fixed number of parts
    counts = rows.groupBy("virtual_slot", "part").agg(F.count("*").alias("n"))
    now = store.read().withColumnRenamed("slot", "virtual_slot").join(F.broadcast(counts), "virtual_slot")
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1))
    starts = now.select("virtual_slot", "part", "shard", F.coalesce(before, F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32"))
    return rows.withColumn("inside", inside).join(F.broadcast(starts), ["virtual_slot", "part"]).select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("start") + F.col("inside") - 1).alias("slot"))
