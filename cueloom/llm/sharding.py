"""Sharding through fixed virtual slots and a versioned slot-to-shard map."""

from __future__ import annotations

import bisect
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import shared_folder

#: Virtual slots; the map and the totals by slot have one entry each, so this bounds what the driver holds.
SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """Which shard holds each virtual slot. An edit gives a new version; slots never change, only their shards."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    @staticmethod
    def initial(shards: int, slots: int = SLOTS) -> SlotMap:
        return SlotMap(1, shards, tuple(i % shards for i in range(slots)))

    def loads(self, sizes: list[int]) -> list[int]:
        out = [0] * self.shards
        for slot, shard in enumerate(self.shard_of):
            out[shard] += sizes[slot]
        return out

    def rebalance(self, sizes: list[int], max_moves: int = 1 << 16) -> SlotMap:
        """The next version: moves or swaps slots between the heaviest and the lightest shard while that narrows their gap, ``max_moves`` times at most."""
        held = [sorted((sizes[s], s) for s, x in enumerate(self.shard_of) if x == shard and sizes[s]) for shard in range(self.shards)]
        load = self.loads(sizes)
        moved = False
        for _ in range(max_moves):
            order = sorted(range(self.shards), key=lambda s: (load[s], s))
            step = None
            for light in order[: self.shards // 2 + 1]:
                step = self._step(held[order[-1]], held[light], load[order[-1]] - load[light])
                if step:
                    break
            if not step:
                break
            heavy, (give, take) = order[-1], step
            held[heavy].remove(give)
            bisect.insort(held[light], give)
            if take:
                held[light].remove(take)
                bisect.insort(held[heavy], take)
            change = give[0] - (take[0] if take else 0)
            load[heavy] -= change
            load[light] += change
            moved = True
        return self._edited(held) if moved else self

    @staticmethod
    def _step(heavy: list, light: list, gap: int):
        """The move (slot, None) or swap (slot, slot) whose change of load comes nearest to half the gap."""
        if gap <= 1 or not heavy:
            return None
        best, found = gap, None
        for back in [None, *light]:
            have = back[0] if back else 0
            at = bisect.bisect_left(heavy, (have + gap / 2,))
            for give in heavy[max(0, at - 1) : at + 1]:
                change = give[0] - have
                if 0 < change < gap and abs(gap - 2 * change) < best:
                    best, found = abs(gap - 2 * change), (give, back)
            if best <= 1 or (found and best * 50 < gap):
                break
        return found

    def grow(self, sizes: list[int]) -> SlotMap:
        """The next version with one more shard, which takes slots from the heaviest shards; no slot moves between old shards."""
        held = [sorted((sizes[s], s) for s, x in enumerate(self.shard_of) if x == shard) for shard in range(self.shards)] + [[]]
        load = self.loads(sizes) + [0]
        share = sum(load) / len(load)
        while True:
            heavy = max(range(self.shards), key=lambda s: (load[s], -s))
            fits = [x for x in held[heavy] if load[-1] + x[0] <= share and load[heavy] - x[0] >= 0 and x[0]]
            if not fits or load[heavy] <= share:
                break
            give = fits[-1]
            held[heavy].remove(give)
            held[-1].append(give)
            load[heavy] -= give[0]
            load[-1] += give[0]
        return self._edited(held)

    def _edited(self, held: list) -> SlotMap:
        new = list(self.shard_of)
        for shard, slots in enumerate(held):
            for _, slot in slots:
                new[slot] = shard
        return SlotMap(self.version + 1, len(held), tuple(new))

    def save(self, spark: SparkSession, path: str) -> None:
        """Appends this version to the stored history."""
        rows = [(self.version, self.shards, slot, shard) for slot, shard in enumerate(self.shard_of)]
        spark.createDataFrame(rows, "version int, shards int, slot int, shard int").coalesce(1).write.mode("append").partitionBy("version").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A stored version, by default the newest."""
        kept = spark.read.parquet(path)
        if version is None:
            version = kept.agg(F.max("version")).first()[0]
        rows = sorted((r.slot, r.shard, r.shards) for r in kept.where(F.col("version") == version).collect())
        return SlotMap(version, rows[0][2], tuple(r[1] for r in rows))


def _lookup(values: list[int], kind: str):
    """A constant array, folded once by the optimiser."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def slot_sizes(sized: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each virtual slot; one row for each slot reaches the driver."""
    total, rows = [0] * slots, [0] * slots
    for r in sized.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        total[r.virtual_slot], rows[r.virtual_slot] = r.b, r.n
    return total, rows


def with_slots(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Adds size, text_crc32 and virtual_slot; the record's hash is over doc_id, size and checksum."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = docs.withColumn("size", F.octet_length(text).cast("long") + F.lit(1)).withColumn("text_crc32", F.crc32(text.cast("binary")))
    return sized.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(slots)).cast("int"))


def shard_documents(docs: DataFrame, shards: int = 8, slots: int = SLOTS, slot_map: SlotMap | None = None, store: str | None = None) -> DataFrame:
    """Adds size, text_crc32, virtual_slot, shard, slot (place in the shard, from 0 without gaps) and map_version.

    Records are hashed into fixed virtual slots. The map (by default the
    initial one, slot modulo shards) is edited until the bytes of the shards
    are nearly equal. Every version is written to ``store`` (by default a
    new folder in the shared one), and the shards come from the newest that is
    read back. Equal texts are spread by their doc_id, not kept together.
    Sizes are UTF-8 bytes of the text plus 1. A row's place is the rows of its
    shard's earlier slots plus its rank in its own slot, so no shard is sorted
    as a whole.

    Null texts count as empty; null ids are hashed like any value. Repeated
    rows get places of their own. No rows give no rows. Columns of the input
    named like an added one are replaced.
    """
    spark = docs.sparkSession
    sized = with_slots(docs.drop("size", "text_crc32", "virtual_slot", "shard", "slot", "map_version"), slots)
    sizes, rows = slot_sizes(sized.select("size", "virtual_slot"), slots)
    first = slot_map or SlotMap.initial(shards, slots)
    final = first.rebalance(sizes)
    store = store or f"{shared_folder(spark)}/cueloom-slot-maps-{uuid.uuid4().hex}"
    for m in dict.fromkeys([first, final]):
        m.save(spark, store)
    final = SlotMap.load(spark, store)
    before, seen = [0] * slots, [0] * final.shards
    for s, shard in enumerate(final.shard_of):
        before[s] = seen[shard]
        seen[shard] += rows[s]
    at = F.col("virtual_slot") + 1
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return sized.select(
        "*",
        F.element_at(_lookup(final.shard_of, "int"), at).alias("shard"),
        (F.element_at(_lookup(before, "bigint"), at) + rank - 1).alias("slot"),
        F.lit(final.version).alias("map_version"),
    )
