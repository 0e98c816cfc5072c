"""Fuzzy line deduplication by MinHash of character shingles.

The signatures and the exact comparison are vectorised in Arrow batches: built
from SQL functions alone they take several times the allowed CPU time (figures
in the README). Buckets, joins and union-find are DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .bits import POWER, bitmap, is_set
from .lsh import linked_components
from .near_dup import bounded_batches
from .scratch import Scratch, shuffles_freed

#: Characters of a shingle; bands and rows: a pair of similarity 0.8 shares no band with probability 0.004.
WIDTH, BANDS, ROWS = 5, 14, 5
#: Most differing bits of the 64-bit sketches of a link: a pair of similarity 0.8 exceeds it with probability 0.0001.
APART = 16
SEED = 77
#: Ranges of buckets that are searched for recurring ones at once.
RANGE_BITS = 9
RANGES = 1 << RANGE_BITS


def _lines(texts):
    """Row, number, 64-bit name and text of each non-blank line of some texts."""
    import hashlib

    import numpy as np

    rows, numbers, names, lines = [], [], [], []
    for r, t in enumerate(texts):
        for n, line in enumerate((t or "").split("\n")):
            if line.strip(" \t\r\f\v"):
                rows.append(r)
                numbers.append(n)
                names.append(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest())
                lines.append(line)
    return np.array(rows, np.int64), np.array(numbers, np.int32), np.frombuffer(b"".join(names), np.int64), lines


def _shingles(lines, width: int, size: int = 1 << 16):
    """Shingle hashes of some lines, repeats included, and their bounds; about ``size`` characters at a time, so that they stay in the processor's cache."""
    import numpy as np

    sizes = np.array([len(x) for x in lines], np.int64)
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    whole = np.ones(len(points), bool)
    for j in range(1, width):
        whole[ends[sizes >= width] - j] = False
    short = np.flatnonzero(sizes < width)
    for i in short:
        whole[starts[i] + 1 : ends[i]] = False
    factor = np.uint64(0x9E3779B97F4A7C15)
    out = []
    for at in range(0, len(points), size):
        part = points[at : at + size + width - 1].astype(np.uint64)
        part += np.uint64(1)
        part = np.concatenate([part, np.ones(max(0, min(size, len(points) - at) + width - 1 - len(part)), np.uint64)])
        n = len(part) - width + 1
        acc = part[:n].copy()
        for j in range(1, width):
            acc *= factor
            acc += part[j : j + n]
        for i in short[np.searchsorted(starts[short], at) : np.searchsorted(starts[short], at + size)]:
            h = 0
            for c in points[starts[i] : ends[i]]:
                h = (h * 0x9E3779B97F4A7C15 + int(c) + 1) & 0xFFFFFFFFFFFFFFFF
            if sizes[i]:
                acc[starts[i] - at] = np.uint64(h ^ int(sizes[i]))
        out.append(textvec.mix(acc[whole[at : at + size]]))
    count = np.where(sizes < width, np.minimum(sizes, 1), sizes - width + 1)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(count)])


def _two_sided_hashes(values, bounds, n_hashes: int, seed: int):
    """MinHash signatures, a row of ``n_hashes`` uint32 for each row of values (none is empty).

    Each random order of the hashes gives two of them, by its first and by its last value.
    """
    import numpy as np

    half = (n_hashes + 1) // 2
    rng = np.random.Generator(np.random.PCG64(seed))
    factor = rng.integers(0, 1 << 31, half, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    flip = rng.integers(0, 1 << 32, half, dtype=np.uint32)
    n = len(bounds) - 1
    out = np.zeros((2 * half, n), np.uint32)
    step = max(1, int(n * 65536 / max(1, len(values))))
    for a in range(0, n, step):
        b = min(n, a + step)
        v = (values[bounds[a] : bounds[b]] >> np.uint64(32)).astype(np.uint32)
        starts = bounds[a:b] - bounds[a]
        t = np.empty_like(v)
        for k in range(half):
            np.bitwise_xor(v, flip[k], out=t)
            np.multiply(t, factor[k], out=t)
            out[k, a:b] = np.minimum.reduceat(t, starts)
            out[half + k, a:b] = np.maximum.reduceat(t, starts)
    return out[:n_hashes].T


def _pieces(rb, column: int, size: int = 1 << 20):
    """Row ranges and texts of a batch, about ``size`` bytes at a time."""
    _, offsets = textvec.string_buffers(rb.column(column))
    for i, j in textvec.blocks(offsets, size):
        yield i, rb.column(column).slice(i, j - i).to_pylist()


def line_keys(docs: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """row, doc_id, line_no, node, sketch, keys of every non-blank line of ``docs(row, doc_id, text)``.

    node names the line's text. keys are the hashes of the line's bands (32 bits each) and
    sketch has the lowest bits of 64 hash functions; keys are empty where a line is
    repeated within about a megabyte of text. A text without such lines has one
    row, with line_no null.
    """

    def work(batches):
        import numpy as np
        import pyarrow as pa

        for rb in batches:
            for i, texts in _pieces(rb, 2):
                row, number, node, lines = _lines(texts)
                _, first, of = np.unique(node, return_index=True, return_inverse=True)
                sig = _two_sided_hashes(*_shingles([lines[k] for k in first], width), bands * rows, SEED)
                sketch = ((sig[:, -64:] >> np.uint32(16)).astype(np.uint64) & np.uint64(1)) @ (np.uint64(1) << np.arange(min(64, bands * rows), dtype=np.uint64))
                keys = np.zeros((len(first), bands), np.uint64)
                for r in range(rows):
                    keys = textvec.mix(keys * np.uint64(0xD6E8FEB86659FD93) + sig[:, r::rows][:, :bands].astype(np.uint64) + np.uint64(1))
                keys = (keys >> np.uint64(32)).astype(np.uint32)
                there = np.zeros(len(lines), bool)
                there[first] = True
                ends = np.concatenate([[0], np.cumsum(there * (4 * bands)), np.full(len(texts), 4 * there.sum() * bands)]).astype(np.int32)
                keys = keys[of[there]]
                blank = np.setdiff1d(np.arange(len(texts)), row)
                at = pa.array(np.concatenate([row, blank]) + i)
                pad = [None] * len(blank)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(rb.column(c).take(at) for c in range(2)),
                        pa.concat_arrays([pa.array(number), pa.array(pad, pa.int32())]),
                        pa.concat_arrays([pa.array(node), pa.array(pad, pa.int64())]),
                        pa.concat_arrays([pa.array(sketch[of].view(np.int64)), pa.array(pad, pa.int64())]),
                        pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends[: len(at) + 1].tobytes()), pa.py_buffer(keys.tobytes())]),
                    ],
                    names=["row", "doc_id", "line_no", "node", "sketch", "keys"],
                )

    return docs.select("row", "doc_id", "text").mapInArrow(work, "row long, doc_id long, line_no int, node long, sketch long, keys binary")


def _buckets(keys):
    """Buckets (36 bits: band and key) of an Arrow column of ``line_keys``' keys, and the row of each."""
    import numpy as np

    data, offsets = textvec.string_buffers(keys)
    n = np.diff(offsets) // 4
    values = data[offsets[0] : offsets[-1]].view(np.uint32).astype(np.int64)
    band = np.arange(len(values)) - np.repeat((offsets[:-1] - offsets[0]) // 4, n)
    return (band << np.int64(32)) | values, np.repeat(np.arange(len(n)), n)


def recurring(table: DataFrame):
    """Broadcast bitmap (2^27 bits, for the lowest bits of a bucket) of the buckets of ``line_keys`` that have two different nodes.

    A task sorts its buckets, each with 28 bits of its node's name, and passes at most two nodes of a
    bucket on, so no bucket makes a range large. A bucket whose nodes all have equal bits would be
    missed: with two nodes, one in 2^28. Each range of buckets is one piece of the bitmap.
    """

    def pairs_of(packed):
        """Sorted distinct values, at most two of a bucket."""
        import numpy as np

        packed = np.sort(packed)
        packed = packed[np.concatenate([np.ones(min(1, len(packed)), bool), packed[1:] != packed[:-1]])]
        bucket = packed >> np.uint64(28)
        return packed[np.concatenate([np.ones(min(2, len(packed)), bool), bucket[2:] != bucket[:-2]])]

    def sort(batches):
        import numpy as np
        import pyarrow as pa

        def ranges():
            packed = pairs_of(np.concatenate(held))
            at = np.searchsorted(packed, np.arange(RANGES, dtype=np.uint64) << np.uint64(64 - RANGE_BITS))
            blobs = [packed[i:j].tobytes() for i, j in zip(at, [*at[1:], len(packed)])]
            return pa.RecordBatch.from_arrays([pa.array(np.arange(RANGES, dtype=np.int32)), pa.array(blobs, pa.binary())], names=["range", "packed"])

        held, size = [], 0
        for rb in batches:
            bucket, row = _buckets(rb.column(1))
            bucket, node = bucket.view(np.uint64), rb.column(0).to_numpy().view(np.uint64)[row]
            held.append((bucket << np.uint64(37)) | (bucket >> np.uint64(POWER) << np.uint64(28)) | (node >> np.uint64(36)))
            size += len(bucket)
            if size > 1 << 22:
                yield ranges()
                held, size = [], 0
        if size:
            yield ranges()

    def mark(key, group):
        import numpy as np
        import pyarrow as pa

        packed = pairs_of(np.frombuffer(b"".join(group.column("packed").to_pylist()), np.uint64))
        bucket = packed >> np.uint64(28)
        at = (bucket[1:][bucket[1:] == bucket[:-1]] >> np.uint64(36 - POWER)).astype(np.int64) - (key[0].as_py() << (POWER - RANGE_BITS))
        bits = np.zeros(1 << (POWER - RANGE_BITS), np.uint8)
        bits[at] = 1
        return pa.table({"range": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    import numpy as np

    found = table.select("node", "keys").mapInArrow(sort, "range int, packed binary").groupBy("range").applyInArrow(mark, "range int, bits binary")
    with shuffles_freed(table.sparkSession):
        got = found.toArrow()
    out = np.zeros((RANGES, 1 << (POWER - RANGE_BITS - 3)), np.uint8)
    for at, bits in zip(got.column(0).to_pylist(), got.column(1).to_pylist()):
        out[at] = np.frombuffer(bits, np.uint8)
    return table.sparkSession.sparkContext.broadcast(out.ravel().view(np.int64))


def recurring_members(table: DataFrame) -> DataFrame:
    """(bucket, node, sketch) of the rows of ``line_keys`` whose bucket has two different nodes or more, and of a few others.

    The bitmap leaves out the members of other buckets, so only the rest are
    sorted later. Its size is fixed; the fuller it is, the more others stay.
    """
    keyed = table.where("length(keys) > 0")
    seen = recurring(keyed)

    def work(batches):
        import numpy as np
        import pyarrow as pa

        for rb in batches:
            bucket, row = _buckets(rb.column(2))
            hit = np.flatnonzero(is_set(seen.value, bucket))
            at = pa.array(row[hit])
            yield pa.RecordBatch.from_arrays([pa.array(bucket[hit]), rb.column(0).take(at), rb.column(1).take(at)], names=["bucket", "node", "sketch"])

    return keyed.select("node", "sketch", "keys").mapInArrow(work, "bucket long, node long, sketch long")


def named_lines(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, line) of the lines of ``docs(text)`` that ids(node) names.

    A bitmap of fixed size leaves out other lines before they are shuffled.
    """
    wanted = bitmap(ids.select(F.col("node").alias("key")))

    def work(batches):
        import numpy as np
        import pyarrow as pa

        for rb in batches:
            for _, texts in _pieces(rb, 0):
                _, _, node, lines = _lines(texts)
                _, first = np.unique(node, return_index=True)
                first = first[is_set(wanted.value, node[first])]
                yield pa.RecordBatch.from_arrays([pa.array(node[first]), pa.array([lines[k] for k in first], pa.string())], names=["node", "line"])

    found = docs.select("text").mapInArrow(work, "node long, line string").join(ids, "node", "left_semi")
    return found.groupBy("node").agg(F.min("line").alias("line"))


def _confirm(pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of pairs(a, b, ta, tb) keeps (a, b) whose sets of shingles have 100 * intersection >= percent * union.

    Hashes of the shingles of each line of a batch rule pairs out; the others are compared by the shingles themselves.
    """

    def work(batches):
        import numpy as np
        import pyarrow as pa

        def full_set(t: str) -> set:
            return {t[i : i + width] for i in range(max(1, len(t) - width + 1))}

        for rb in batches:
            n, keep, last, left = rb.num_rows, [], None, set()
            a, b = (rb.column(c).to_numpy() for c in (0, 1))
            ta, tb = (rb.column(c).to_pylist() for c in (2, 3))
            _, first, of = np.unique(np.concatenate([a, b]), return_index=True, return_inverse=True)
            hashes, bounds = textvec.distinct(*_shingles([ta[k] if k < n else tb[k - n] for k in first], width))
            for row, (x, y) in enumerate(zip(of[:n], of[n:])):
                nx, ny = bounds[x + 1] - bounds[x], bounds[y + 1] - bounds[y]
                if 100 * min(nx, ny) < percent * max(nx, ny):
                    continue
                met = np.concatenate([hashes[bounds[x] : bounds[x + 1]], hashes[bounds[y] : bounds[y + 1]]])
                met.sort()
                both = np.count_nonzero(met[1:] == met[:-1])
                if 100 * both < percent * (nx + ny - both):
                    continue
                if a[row] != last:
                    last, left = a[row], full_set(ta[row])
                right = full_set(tb[row])
                both = len(left & right)
                if 100 * both >= percent * (len(left) + len(right) - both):
                    keep.append(row)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([rb.column(0).take(take), rb.column(1).take(take)], names=["a", "b"])

    return pairs.select("a", "b", "ta", "tb").mapInArrow(work, "a long, b long")


def _shingled(width: int):
    """A function from an Arrow column of lines to the distinct hashes of their shingles, and bounds."""

    def of(lines):
        return textvec.distinct(*_shingles(lines.to_pylist(), width))

    return of


def fuzzy_lines(docs: DataFrame, width: int = WIDTH, percent: int = 80, bands: int = BANDS, rows: int = ROWS, apart: int = APART) -> DataFrame:
    """row, doc_id, line_no (from 0), component and kept for every non-blank line of ``docs(doc_id, text)``.

    Lines (split at line feeds) are linked when the sets of their
    ``width``-character shingles have 100 * intersection >= percent * union; a
    shorter line is one shingle. Of each component of equal or linked lines the
    first is kept: that of the smallest doc_id, then (among rows that share it)
    of the row read first, then of the smallest line_no. row numbers
    the rows of ``docs``, so repeated rows are told apart, and only one of
    their copies is kept. Lines are known by a 64-bit hash: among n different
    lines two share one with probability n * n / 2^65.

    Null, empty and blank texts have one row, with line_no, component and kept
    null; blank lines are never dropped. Null ids sort first. Other columns are
    ignored. No rows give no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "fuzzy-lines")
    text = F.col("text").cast("string")
    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    table = scratch.cut(line_keys(docs, width, bands, rows), "lines")
    members = scratch.cut(recurring_members(table), "members")
    known: dict[str, DataFrame] = {}

    def texts(ids: DataFrame, tag: str) -> DataFrame:
        known[tag] = scratch.cut(named_lines(docs, ids), f"texts-{tag}")
        return known[tag]

    def confirmed(pairs: DataFrame, tag: str) -> DataFrame:
        """Links among distinct pairs(a, b). Those of blocks are between lines whose texts have been sought as contents."""
        pairs = scratch.cut(pairs, f"pairs-{tag}")
        lines = known[tag] if tag in known else texts(scratch.cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), f"ids-{tag}"), tag)
        full = pairs.join(lines.select(F.col("node").alias("b"), F.col("line").alias("tb")), "b").join(lines.select(F.col("node").alias("a"), F.col("line").alias("ta")), "a")
        links = scratch.cut(_confirm(full, width, percent), f"links-{tag}")
        for done in ("pairs", "ids", "texts"):
            scratch.delete(scratch.last.get(f"{done}-{tag}"))
        return links

    def contents(ids: DataFrame) -> DataFrame:
        return texts(ids, "blocks").withColumnRenamed("line", "content")

    label = linked_components(members, scratch, percent, lambda pairs: pairs, confirmed, contents, _shingled(width), apart=apart)
    placed = table.select("row", "doc_id", "line_no", "node").join(label, "node", "left").withColumn("component", F.coalesce("component", "node")).drop("node")
    first = placed.where("line_no is not null").groupBy("component").agg(F.min(F.struct("doc_id", "row", "line_no")).alias("first"), F.count("*").alias("n"))
    first = first.where("n > 1").select(F.col("component").alias("shared"), F.col("first.row").alias("first_row"), F.col("first.line_no").alias("first_line"))
    kept = F.col("shared").isNull() | ((F.col("row") == F.col("first_row")) & (F.col("line_no") == F.col("first_line")))
    return placed.join(first, F.col("component") == F.col("shared"), "left").select("row", "doc_id", "line_no", "component", F.when(F.col("line_no").isNotNull(), kept).alias("kept"))


def lines_by_document(lines: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_kept and dropped (line numbers, comma-joined) for every row of the documents of ``fuzzy_lines``."""
    gone = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("kept"), F.col("line_no")))), ",")
    each = lines.groupBy("row", "doc_id").agg(F.count("line_no").alias("n_lines"), F.count_if("kept").alias("n_kept"), gone.alias("dropped"))
    return each.select("doc_id", "n_lines", "n_kept", "dropped")
