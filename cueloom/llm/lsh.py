"""Components of similar items from the buckets that their signatures share."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .graph import connected_components
from .scratch import Scratch

#: About how many members of a bucket are compared as one block with another block.
MEMBERS = 256
#: Pairs whose signatures are compared at once in a task.
PAIRS = 1 << 20


def accept_table(n: int, batch: int, threshold: float, miss: float) -> list[int]:
    """Fewest agreeing hashes, after each batch of a signature, at which a pair stays.

    With a uniform prior the posterior of the similarity after m agreements in
    n is Beta(m + 1, n - m + 1). A pair is pruned when the posterior chance of
    a similarity of ``threshold`` or more is below its share of ``miss``, the
    chosen chance to lose a true pair over all batches. That tail is the
    binomial P(Bin(n + 1, threshold) <= m).
    """
    steps = range(batch, n + 1, batch)
    share = miss / len(steps)
    out = []
    for size in steps:
        total, m = 0.0, 0
        while m <= size:
            total += math.comb(size + 1, m) * threshold**m * (1 - threshold) ** (size + 1 - m)
            if total >= share:
                break
            m += 1
        out.append(m)
    return out


def passing(left, right, a, b, least: list[int], batch: int):
    """Which of the pairs left[a], right[b] of 16-bit signatures pass every batch: indices into a."""
    import numpy as np

    alive, agreed = np.arange(len(a)), np.zeros(len(a), np.int64)
    for step, need in enumerate(least):
        part = slice(step * batch, (step + 1) * batch)
        agreed[alive] += (left[a[alive], part] == right[b[alive], part]).sum(axis=1)
        alive = alive[agreed[alive] >= need]
    return alive


def bayes_prune(pairs: DataFrame, n_hashes: int, threshold: float, batch: int, miss: float) -> DataFrame:
    """Of pairs(a, b, sa, sb) keeps (a, b) whose signatures pass every batch."""
    least = accept_table(n_hashes, batch, threshold, miss)

    def work(batches):
        import numpy as np
        import pyarrow as pa

        for rb in batches:
            if not rb.num_rows:
                continue
            sa, sb = (np.frombuffer(b"".join(rb.column(c).to_pylist()), np.uint16).reshape(rb.num_rows, n_hashes) for c in (2, 3))
            every = np.arange(rb.num_rows)
            alive = pa.array(passing(sa, sb, every, every, least, batch))
            yield pa.RecordBatch.from_arrays([rb.column(0).take(alive), rb.column(1).take(alive)], names=["a", "b"])

    return pairs.select("a", "b", "sa", "sb").mapInArrow(work, "a long, b long")


def bucket_chains(members: DataFrame, scratch: Scratch, apart: int = 64) -> DataFrame:
    """(bucket, node, sketch, prev) of the nodes of ``members(bucket, node, sketch)`` that share their bucket.

    prev is the next smaller node there, unless its sketch differs in more than ``apart`` bits.
    The rows are cut into ranges of (bucket, node) and sorted, so a bucket of
    any size is spread over tasks, and each task streams its rows. Where a
    bucket runs on from one task into the next, the ends of the tasks' ranges
    (two rows of each) are chained on the driver. Repeated rows count once. An
    end that is alone in its bucket may be among the rows, with prev null.
    """

    def chain(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def rows(bucket, node, sketch, prev, has, edge):
            return pa.RecordBatch.from_arrays(
                [pa.array(bucket), pa.array(node), pa.array(sketch), pa.array(prev, mask=~has), pa.array(np.full(len(node), part, np.int32)), pa.array(edge.astype(np.int32))],
                names=["bucket", "node", "sketch", "prev", "part", "edge"],
            )

        held = None  # the newest row, which waits for its successor: bucket, node, sketch, prev, has prev, first of the task
        for rb in batches:
            b, n, k = (rb.column(c).to_numpy() for c in (0, 1, 2))
            if held is not None:
                b, n, k = (np.concatenate([[held[c]], x]) for c, x in enumerate((b, n, k)))
            if not len(b):
                continue
            new = np.concatenate([[True], (b[1:] != b[:-1]) | (n[1:] != n[:-1])])
            b, n, k = b[new], n[new], k[new]
            shared = np.concatenate([[False], b[1:] == b[:-1]])
            linked = shared.copy()
            linked[1:] &= np.bitwise_count((k[1:] ^ k[:-1]).view(np.uint64)) <= apart
            prev = np.concatenate([n[:1], n[:-1]])
            edge = np.zeros(len(b), bool)
            keep = shared.copy()
            keep[:-1] |= shared[1:]
            if held is None:
                edge[0] = keep[0] = True
            else:
                prev[0], linked[0], edge[0] = held[3], held[4], held[5]
                keep[0] |= held[6]
            if len(b) > 1:
                out = np.flatnonzero(keep[:-1])
                if len(out):
                    yield rows(b[out], n[out], k[out], prev[out], linked[out], edge[out])
            held = (b[-1], n[-1], k[-1], prev[-1], linked[-1], edge[-1], keep[-1])
        if held is not None:
            one = [np.array([x]) for x in held]
            yield rows(*one[:5], one[5] + 2)

    placed = members.select("bucket", "node", "sketch").repartitionByRange("bucket", "node").sortWithinPartitions("bucket", "node")
    found = scratch.cut(placed.mapInArrow(chain, "bucket long, node long, sketch long, prev long, part int, edge int"), "chains")
    ends = sorted((r.part, r.bucket, r.node, r.sketch) for r in found.where("edge > 0").select("part", "bucket", "node", "sketch").collect())
    joints = [(y[1], y[2], y[3], x[2]) for x, y in zip(ends, ends[1:]) if x[0] < y[0] and x[1] == y[1]]
    out = found.select("bucket", "node", "sketch", "prev")
    return out.unionByName(scratch.spark.createDataFrame(joints, "bucket long, node long, sketch long, prev long")) if joints else out


def _groups(batches, n_keys: int):
    """Columns of whole groups (equal values of the first ``n_keys`` columns) of sorted batches, with the number of the group in place of its key."""
    import numpy as np
    import pyarrow as pa

    held = None
    for rb in batches:
        held = rb if held is None else pa.concat_batches([held, rb])
        if not held.num_rows:
            continue
        key = np.stack([held.column(c).to_numpy().astype(np.int64) for c in range(n_keys)], axis=1)
        change = np.concatenate([[False], (key[1:] != key[:-1]).any(axis=1)])
        last = np.flatnonzero(change)
        if len(last):
            yield np.cumsum(change[: last[-1]]), held.slice(0, last[-1])
            held = held.slice(last[-1])
    if held is not None and held.num_rows:
        yield np.zeros(held.num_rows, np.int64), held


MET = "met long, split boolean, side boolean, node long, component long"


def likely_members(rest: DataFrame, percent: int, apart: int, n_hashes: int = 0, batch: int = 1, miss: float = 0.0) -> DataFrame:
    """The members of blocks that may be linked with a member of another component in the block that they meet.

    ``rest(bucket, node, component, main, blocks, main_blocks, sketch, n, signature)``: the members
    outside a bucket's largest component (main) are cut into ``blocks`` blocks by a hash of the node,
    those inside into ``main_blocks``. Every two of the first blocks meet in a task, and each of them meets each of the second.
    Members of the largest component never meet each other, so a bucket with few members outside it makes few rows. Of the pairs there, those count whose sketches differ in
    at most ``apart`` bits and, where there are signatures, that pass the
    Bayesian batches. No pair leaves the task, only the members of such pairs,
    under a name (met) made of themselves: members that meet in several buckets
    are listed once.
    """
    least = accept_table(n_hashes, batch, percent / 100, miss) if n_hashes else []

    def work(batches):
        import numpy as np
        import pyarrow as pa

        for group, rb in _groups(batches, 3):
            lo, hi, side, node, component, sketch, n = (rb.column(c).to_numpy(zero_copy_only=False) for c in range(1, 8))
            split = lo != hi
            sig = np.frombuffer(b"".join(rb.column(8).to_pylist()), np.uint16).reshape(rb.num_rows, n_hashes) if least else None
            many = np.searchsorted(group, group, side="right") - np.arange(len(group)) - 1
            upto = np.concatenate([[0], np.cumsum(many)])
            hit, at = np.zeros(len(group), bool), 0
            while at < len(group):
                to = max(at + 1, int(np.searchsorted(upto, upto[at] + PAIRS, side="right")) - 1)
                a = np.repeat(np.arange(at, to), many[at:to])
                b = a + 1 + np.arange(len(a)) - np.repeat(upto[at:to] - upto[at], many[at:to])
                ok = (component[a] != component[b]) & (~split[a] | (side[a] != side[b])) & (np.bitwise_count((sketch[a] ^ sketch[b]).view(np.uint64)) <= apart)
                ok &= 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
                a, b = a[ok], b[ok]
                alive = passing(sig, sig, a, b, least, batch) if least else slice(None)
                hit[a[alive]] = hit[b[alive]] = True
                at = to
            own = textvec.mix(node.view(np.uint64) * np.uint64(2) + (side & split).astype(np.uint64)) * hit.astype(np.uint64)
            upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own, dtype=np.uint64)])
            first, stop = np.searchsorted(group, group), np.searchsorted(group, group, side="right")
            met = (upto[stop] - upto[first]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x[hit]) for x in (met, split, side, node, component)], names=["met", "split", "side", "node", "component"])

    place, inside = F.xxhash64("node"), F.col("component") == F.col("main")
    own = F.when(inside, F.col("blocks") + F.pmod(place, F.col("main_blocks"))).otherwise(F.pmod(place, F.col("blocks"))).cast("int")
    last = F.col("blocks") + F.when(inside, 0).otherwise(F.col("main_blocks")) - 1
    met = rest.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    met = met.select(
        "bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).alias("side"), "node", "component", "sketch", "n", *(["signature"] if n_hashes else [])
    )
    return met.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi").mapInArrow(work, MET).distinct()


def listed(column):
    """Values and bounds of the lists of an Arrow column."""
    return column.values.to_numpy(), column.offsets.to_numpy()


def spanning_links(met: DataFrame, sets: DataFrame, percent: int, shingled: Callable = listed) -> DataFrame:
    """(a, b): links that join the components of each block of ``met`` which the exact similarity of their sets joins.

    ``shingled`` makes the distinct shingle hashes and their bounds from a column
    of the contents of ``sets(node, content)``; a text is a fraction of
    its hashes, so what can be hashed in the task is shuffled as text. Of a block's
    links only as many are returned as join its components, one fewer than they are at most.
    """

    def work(batches):
        import numpy as np
        import pyarrow as pa

        for group, rb in _groups(batches, 1):
            split, side, node, component = (rb.column(c).to_numpy(zero_copy_only=False) for c in (1, 2, 3, 4))
            values, offsets = shingled(rb.column(5))
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
            links = []
            for i, j in zip(bounds[:-1], bounds[1:]):
                sizes = np.diff(offsets[i : j + 1])
                _, word = np.unique(values[offsets[i] : offsets[j]], return_inverse=True)
                row = np.repeat(np.arange(j - i), sizes)
                both = np.zeros((j - i, j - i), np.float32)
                words = int(word.max()) + 1 if len(word) else 0
                for first in range(0, words, 8192):
                    part = (word >= first) & (word < first + 8192)
                    cells = np.zeros((j - i, min(8192, words - first)), np.float32)
                    cells[row[part], word[part] - first] = 1
                    both += cells @ cells.T
                union = sizes[:, None] + sizes[None, :] - both
                c = component[i:j]
                ok = (100 * both >= percent * union) & (c[:, None] != c[None, :])
                if split[i]:
                    ok &= side[i:j, None] != side[None, i:j]
                root: dict = {}

                def top(x, root=root):
                    while root.get(x, x) != x:
                        root[x] = root.get(root[x], root[x])
                        x = root[x]
                    return x

                for a, b in zip(*np.nonzero(np.triu(ok))):
                    x, y = top(int(c[a])), top(int(c[b]))
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        links.append((int(node[i + a]), int(node[i + b])))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    met = met.join(sets, "node").select("met", "split", "side", "node", "component", "content")
    found = met.repartition("met").sortWithinPartitions("met").mapInArrow(work, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def linked_components(
    members: DataFrame,
    scratch: Scratch,
    percent: int,
    likely: Callable[[DataFrame], DataFrame],
    confirm: Callable[[DataFrame, str], DataFrame],
    contents: Callable[[DataFrame], DataFrame],
    shingled: Callable = listed,
    signed: Callable[[DataFrame], DataFrame] | None = None,
    n_hashes: int = 0,
    batch: int = 1,
    miss: float = 0.0,
    apart: int = 64,
) -> DataFrame:
    """(node, component) of the nodes that have a link, from ``members(bucket, node, sketch, n)``.

    First each member of a bucket is compared with the next smaller one, unless
    their sketches differ in more than ``apart`` bits: ``likely`` thins these
    pairs(a, b) and ``confirm`` compares them in full. Members of a bucket that
    are still in different components then meet each other, in blocks: by
    their sketches and, if given, the signatures that ``signed`` adds to
    rows(node), then exactly, by the sets that ``shingled`` makes of what ``contents`` gives for ids(node)
    (node, content). The links found are confirmed in full. So no link between
    components is left out, and no bucket expands into its pairs.
    """
    chains = bucket_chains(members, scratch, apart)
    first = chains.where("prev is not null").select(F.col("prev").alias("a"), F.col("node").alias("b")).distinct()
    links = confirm(likely(first), "chains").select(F.col("a").alias("u"), F.col("b").alias("v"))
    label = scratch.cut(connected_components(links, scratch, "cc-chains"), "labels")
    scratch.release()

    tagged = chains.select("bucket", "node", "sketch").distinct().join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    tagged = scratch.cut(tagged, "tagged")
    scratch.delete(scratch.last["chains"])
    sizes = tagged.groupBy("bucket", "component").agg(F.count("*").alias("size"))
    mixed = sizes.groupBy("bucket").agg(F.max_by("component", "size").alias("main"), F.max("size").alias("most"), F.sum("size").alias("members"), F.count("*").alias("components")).where("components > 1")
    blocks = lambda n: F.ceil(n / MEMBERS).cast("int")
    rest = tagged.join(mixed.select("bucket", "main", blocks(F.col("members") - F.col("most")).alias("blocks"), blocks(F.col("most")).alias("main_blocks")), "bucket")
    rest = signed(rest) if signed else rest.withColumn("n", F.lit(1))
    met = scratch.cut(likely_members(rest, percent, apart, n_hashes, batch, miss), "met")
    scratch.delete(scratch.last["tagged"])
    scratch.release()
    sets = scratch.cut(contents(scratch.cut(met.select("node").distinct(), "ids-met")), "sets")
    more = confirm(spanning_links(met, sets, percent, shingled), "blocks").select(F.col("a").alias("u"), F.col("b").alias("v"))
    return connected_components(label.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more), scratch, "cc-all")
