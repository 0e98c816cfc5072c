"""Mixing sources to target weights along a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Words of one block, slots of one ranking chunk, and cells that the unit interval is cut into for the slot-to-source join.
BLOCK, CHUNK, CELLS = 2048, 4096, 1024
GOLDEN = 0.6180339887498949


def source_targets(totals: DataFrame, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, most: int = 2) -> DataFrame:
    """sid, source, source_size, target, goal (whole words) for ``totals(source, source_size)``.

    Sources in code-point order, null last, weigh ``weights`` in turn and share
    ``percent`` of all sizes. A target stops at ``most`` times its source's
    size and the excess is reshared by weight until none is above. In the order
    of size by weight the stopped sources come first; a source is stopped when
    its share of what the earlier ones leave is at least its stop. One row for
    each source is sorted here.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*map(F.lit, weights))
    rows = totals.withColumn("sid", F.row_number().over(order) - 1)
    rows = rows.withColumn("w", F.element_at(table, (F.col("sid") % len(weights) + 1).cast("int")).cast("decimal(38,0)"))
    size = F.col("source_size").cast("decimal(38,0)")
    fill = Window.orderBy(F.col("source_size") / F.col("w"), "sid")
    every = Window.partitionBy()
    cap = size * (100 * most)
    rows = rows.withColumn("cap", cap.cast("decimal(38,0)"))
    left = (F.sum(size).over(every) * percent - F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("decimal(38,0)")
    rows = rows.withColumn("left", left).withColumn("open", F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)).cast("decimal(38,0)"))
    rows = rows.withColumn("free", F.col("cap") * F.col("open") > F.col("left") * F.col("w"))
    first = F.min_by(F.struct("left", "open"), F.when(F.col("free"), F.struct(F.col("source_size") / F.col("w"), "sid"))).over(every)
    rows = rows.withColumn("level", first)
    target = F.when(F.col("free"), (F.col("w") * F.col("level.left")).cast("double") / (100.0 * F.col("level.open").cast("double"))).otherwise(
        (F.col("source_size") * most).cast("double")
    )
    return rows.select("sid", "source", "source_size", target.alias("target")).withColumn("goal", F.floor(F.col("target") + 0.5).cast("long"))


def schedule(sources: DataFrame, slots: int, block: int = BLOCK) -> DataFrame:
    """(sid, block, slot): which source's next block each slot of the mix holds.

    Slot i takes the golden-ratio point frac((i + 1/2) * 0.618...), mapped
    through the cumulative shares of the sources' blocks; a source's slots are
    ranked and its n-th slot holds its n-th block. Ranks come from counts by
    chunk of slots, so no source's slots are sorted as a whole.
    """
    spark = sources.sparkSession
    order = Window.orderBy("sid")
    every = Window.partitionBy()
    share = sources.select("sid", F.ceil(F.col("goal") / block).alias("n")).where("n > 0")
    total = F.sum("n").over(every)
    upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    share = share.select("sid", ((upto - F.col("n")) / total).alias("lo"), (upto / total).alias("hi"))
    cells = share.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))))
    points = spark.range(slots).select(F.col("id").alias("slot"), (((F.col("id") + 0.5) * GOLDEN) % 1.0).alias("u"))
    points = points.withColumn("cell", F.floor(F.col("u") * CELLS))
    taken = points.join(cells, "cell").where("lo <= u and u < hi").select("sid", "slot", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    counts = taken.groupBy("sid", "chunk").count()
    counts = counts.withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot"))
    ranked = taken.withColumn("rank", rank).join(counts.drop("count"), ["sid", "chunk"])
    return ranked.select("sid", (F.col("before") + F.col("rank") - 1).alias("block"), "slot")


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, most: int = 2, block: int = BLOCK, seed: str = "", carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Two tables: the documents with their place, and the pieces of the mix.

    documents: row (unique), doc_id, source, size, sid, source_size, target,
    goal, cum, and the columns named in ``carry``. pieces: slot, sid, block, row, epoch, first_word, n_words, at
    most one for each block that an epoch of a document touches.

    Each source's documents are shuffled by the MD5 of ``seed`` and doc_id and
    laid end to end; ``goal`` words are read round and round and cut into blocks
    of ``block`` words (the last may be shorter), which the schedule deals to
    slots. Places come from totals of 4,096 hash ranges of each source, so no
    source is sorted as a whole. A block that the schedule has no slot for
    comes after its last slot, in a slot of its own.

    Null text has size 0 and takes nothing; null doc_id is hashed as an empty
    string; null is a source; rows with equal ids are ordered by size, then by
    the carried columns. No rows give no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    sized = docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        digest.alias("digest"),
        *carry,
    ).withColumn("range", F.substring("digest", 1, 3))
    sized = scratch.cut(sized, "sizes")
    ranges = sized.groupBy("source", "range").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    ranges = scratch.cut(ranges, "ranges")
    sources = source_targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, percent, most)
    sources = scratch.cut(sources.coalesce(1), "sources")
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select(
        F.col("source").alias("s"),
        F.col("range").alias("r"),
        F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("words_before"),
    ).join(sources, F.col("s").eqNullSafe(F.col("source"))).drop("source")
    inside = Window.partitionBy("source", "range").orderBy("digest", "doc_id", "size", *carry)
    placed = (
        sized.withColumn("rank", F.row_number().over(inside))
        .withColumn("within", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
        .select(
            F.concat_ws("/", F.col("sid").cast("string"), "range", F.col("rank").cast("string")).alias("row"),
            "doc_id", "source", "size", "sid", "source_size", "target", "goal",
            (F.col("words_before") + F.col("within")).alias("cum"), *carry,
        )
    )
    placed = scratch.cut(placed, "placed")
    slots = sources.agg(F.sum(F.ceil(F.col("goal") / block))).first()[0] or 0
    plan = schedule(sources, slots, block)
    earlier = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    later = sources.select("sid", (F.coalesce(F.sum(F.ceil(F.col("goal") / block)).over(earlier), F.lit(0)) + slots).alias("spare"))
    pieces = (
        placed.where("size > 0")
        .withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(most)])))
        .withColumn("start", F.col("epoch") * F.col("source_size") + F.col("cum"))
        .withColumn("stop", F.least(F.col("start") + F.col("size"), F.col("goal")))
        .where("start < stop")
        .withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block))))
        .withColumn("from", F.greatest("start", F.col("block") * block))
        .withColumn("to", F.least("stop", (F.col("block") + 1) * block))
        .join(plan, ["sid", "block"], "left")
        .join(later, "sid")
        .select(
            F.coalesce("slot", F.col("spare") + F.col("block")).alias("slot"),
            "sid", "block", "row", "epoch",
            (F.col("from") - F.col("start")).alias("first_word"),
            (F.col("to") - F.col("from")).alias("n_words"),
        )
    )
    return placed, pieces


def words_taken(placed: DataFrame, pieces: DataFrame) -> DataFrame:
    """The documents with ``taken``, the words that the mix takes of them, repeats counted, and the first and number of their slots."""
    taken = pieces.groupBy("row").agg(F.sum("n_words").alias("taken"), F.min("slot").alias("first_slot"), F.count("*").alias("n_pieces"))
    out = placed.join(taken, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    return out.withColumn("n_pieces", F.coalesce("n_pieces", F.lit(0)))
