"""Ranked lexical search over K2-treaps of the term-document grid.

A range of documents is a grid: a row for each query term, a column for each
document, and in its points the impact of the term in the document. The grid is
halved both ways again and again; a cell of this quadtree keeps which of its four
quarters hold points (four bits), where they begin, and the greatest impact inside.

An item's terms are paths of rows. They descend together: a state is a range
of columns with one cell for each term, and the sum of the cells' maxima bounds the score
of every document there. States of the highest bounds are opened first, many at a
time, until no bound reaches the item's k-th best score; a state of
one column is a document with its exact score. The best k of every range meet in the
end, so nothing is lost and no more than k rows of an item leave a range.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_dup import bounded_batches
from .scratch import Scratch

#: Documents of one grid.
RANGE = 1 << 14
#: Distinct query terms of a block of items; each block takes one scan of the documents.
TERMS = 1 << 20
#: States opened at once.
OPEN = 128
#: A term is a maximal match; only A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms): the distinct terms of each item; rows of one item_id are one item."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = F.regexp_extract_all(text, F.lit(f"({TERM})"))
    return items.select(F.col("item_id").cast("long").alias("item_id"), terms.alias("terms")).groupBy("item_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("terms")))).alias("terms"))


def postings(docs: DataFrame, number: dict) -> DataFrame:
    """(doc_id, n, terms, tfs): the terms of each document, those of them that ``number`` numbers, and how often they occur."""
    sent = docs.sparkSession.sparkContext.broadcast(number)

    def work(batches):
        import numpy as np
        import pyarrow as pa

        known = sent.value
        table = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
        for batch in batches:
            n, terms, tfs, ends = [], [], [], [0]
            for text in batch.column(1).cast("binary").to_pylist():
                words = (text or b"").translate(table).split()
                n.append(len(words))
                t, tf = np.unique(np.array([known[w] for w in words if w in known], np.int32), return_counts=True)
                terms.append(t)
                tfs.append(tf.astype(np.int64))
                ends.append(ends[-1] + len(t))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, kind), *x]))) for x, kind in ((terms, np.int32), (tfs, np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(work, "doc_id long, n long, terms array<int>, tfs array<long>")


def build_treap(row, col, impact, height: int) -> dict:
    """The K2-treap of points in a square of 2^height: levels one after the other, children of a cell side by side."""
    import numpy as np

    code = np.zeros(len(row), np.uint64)
    for bit in range(height):
        code |= (row.astype(np.uint64) >> np.uint64(bit) & np.uint64(1)) << np.uint64(2 * bit + 1)
        code |= (col.astype(np.uint64) >> np.uint64(bit) & np.uint64(1)) << np.uint64(2 * bit)
    order = np.argsort(code)
    code, most = code[order], impact[order]
    levels = [(np.zeros(len(code), np.uint8), np.zeros(len(code), np.int64), most)]
    for _ in range(height):
        parent = code >> np.uint64(2)
        start = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
        quarters = np.bitwise_or.reduceat(np.left_shift(np.uint8(1), (code & np.uint64(3)).astype(np.uint8)), start)
        most = np.maximum.reduceat(most, start)
        levels.append((quarters, start, most))
        code = parent[start]
    levels.reverse()
    ends = np.cumsum([0, *(len(x[2]) for x in levels)])
    first = np.concatenate([x[1] + ends[i + 1] for i, x in enumerate(levels)])
    return {"height": height, "quarters": np.concatenate([x[0] for x in levels]), "first": first.astype(np.int32), "most": np.concatenate([x[2] for x in levels])}


def search_treap(treap: dict, rows, k: int, opened: int = OPEN):
    """Columns and scores of the k best columns for the sum over ``rows``: scores above 0, equal scores by ascending column."""
    import numpy as np

    height, quarters, first, most = treap["height"], treap["quarters"], treap["first"], treap["most"]
    ones = np.array([bin(i).count("1") for i in range(16)], np.int32)
    found = np.zeros((2, 0), np.int64)
    bound, level, col, cells = np.array([len(rows) * most[0]]), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros((1, len(rows)), np.int32)
    least = 1
    while len(bound):
        if len(bound) > opened:
            best = np.argpartition(-bound, opened - 1)
            now, rest = best[:opened], best[opened:]
        else:
            now, rest = np.arange(len(bound)), np.zeros(0, np.int64)
        at = cells[now]
        half = 2 * (rows[None, :] >> (height - 1 - level[now])[:, None] & 1)
        here = np.where(at >= 0, quarters[at], 0)
        parts = []
        for side in (0, 1):
            q = half + side
            child = np.where(here >> q & 1, first[at] + ones[here & ((1 << q) - 1)], -1)
            parts.append((np.where(child >= 0, most[child], 0).sum(axis=1), level[now] + 1, 2 * col[now] + side, child.astype(np.int32)))
        new = [np.concatenate(x) for x in zip(*parts)]
        leaf = new[1] == height
        found = np.concatenate([found, np.stack([new[2], new[0]])[:, leaf & (new[0] >= least)]], axis=1)
        if found.shape[1] >= k:
            found = found[:, np.lexsort((found[0], -found[1]))[:k]]
            least = max(least, found[1, -1])
        keep = [np.concatenate([x[rest], y[~leaf]]) for x, y in zip((bound, level, col, cells), new)]
        reach = keep[0] >= least
        bound, level, col, cells = (x[reach] for x in keep)
    return found[:, np.lexsort((found[0], -found[1]))[:k]]


def search_ranges(table: DataFrame, weights, wanted: list, totals: tuple[int, int], k: int, size: int, search: Callable = search_treap) -> DataFrame:
    """(item, doc_id, score): the best k of every range of ``size`` documents for each of ``wanted`` (arrays of term numbers)."""
    n_docs, n_terms = totals
    sent = table.sparkSession.sparkContext.broadcast((weights, wanted))

    def work(batches):
        import numpy as np
        import pyarrow as pa

        weights, wanted = sent.value

        def ranges():
            held = []
            for batch in batches:
                while batch.num_rows:
                    room = size - sum(b.num_rows for b in held)
                    held.append(batch.slice(0, room))
                    batch = batch.slice(room)
                    if sum(b.num_rows for b in held) == size:
                        yield pa.Table.from_batches(held).combine_chunks()
                        held = []
            if held:
                yield pa.Table.from_batches(held).combine_chunks()

        for part in ranges():
            part = part.sort_by([("doc_id", "ascending")])
            lists = [part.column(c).combine_chunks() for c in ("terms", "tfs")]
            term, tf = (x.flatten().to_numpy() for x in lists)
            col = np.repeat(np.arange(len(part)), np.diff(lists[0].offsets.to_numpy()))
            if not len(term):
                continue
            m = 50 + 50 * part.column("n").to_numpy() * n_docs // n_terms
            impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[col]))
            # rows by weight, so that a cell holds terms of about the same impact
            held = np.unique(term)
            held = held[np.argsort(weights[held], kind="stable")]
            place = np.full(len(weights), -1, np.int64)
            place[held] = np.arange(len(held))
            height = max(1, (max(len(held), len(part)) - 1).bit_length())
            spread = height - max(1, (len(held) - 1).bit_length())
            good = impact > 0
            if not good.any():
                continue
            treap = build_treap(place[term[good]] << spread, col[good], impact[good], height)
            out = []
            for i, terms in enumerate(wanted):
                rows = place[terms]
                rows = rows[rows >= 0] << spread
                if len(rows):
                    cols, scores = search(treap, rows, k)
                    out.append((np.full(len(cols), i, np.int32), part.column("doc_id").take(pa.array(cols)).combine_chunks(), scores))
            if out:
                ids = pa.concat_arrays([x[1] for x in out])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[0] for x in out])), ids, pa.array(np.concatenate([x[2] for x in out]))], names=["item", "doc_id", "score"])

    return table.select("doc_id", "n", "terms", "tfs").mapInArrow(work, "item int, doc_id long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, range_docs: int = RANGE, block_terms: int = TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best of ``docs(doc_id, text)`` for each of ``items(item_id, text)``.

    Terms are runs of characters other than ASCII ones that are neither letters nor digits; A-Z
    are lower-cased. With N documents that hold a term, L terms in them, n
    of them in a document, a term in df documents and tf times in this one, its weight
    is w = floor(1000 ln((2N + 2) / (2df + 1))) and the document's score sums
    w * (10^9 tf div (1000 tf + 20 m)) over the item's terms, where
    m = 50 + (50 n N div L). Scores above 0 are ranked, equal ones by doc_id.

    Null or empty texts hold no term. Every row of docs is ranked on its own, repeated
    rows too; null ids come after all others of their score. Rows of one
    item_id (null is one too) are one item. Other columns are ignored. Empty tables give no rows.

    The items are taken in blocks of at most about ``block_terms`` terms (one item at least); the terms of a
    block are broadcast, and each block takes one scan of the documents.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "treap")
    asked = scratch.cut(item_terms(items), "items")
    blocks = 1 + (asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // block_terms
    parts = []
    for block in range(blocks):
        mine = sorted(asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect(), key=lambda r: (r.item_id is None, r.item_id or 0))
        parts.append(_rank_block(scratch, docs, mine, k, range_docs))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _rank_block(scratch: Scratch, docs: DataFrame, items: list, k: int, range_docs: int) -> DataFrame:
    import numpy as np

    spark = scratch.spark
    number = {t: i for i, t in enumerate(sorted({t for r in items for t in r.terms}))}
    table = scratch.cut(postings(docs, {t.encode(): i for t, i in number.items()}), "postings")
    n_docs, n_terms = table.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(max(1, len(number)), np.int64)
    for term, df in table.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    wanted = [np.array([number[t] for t in r.terms], np.int64) for r in items]
    best = search_ranges(table, weights, wanted, (n_docs, n_terms or 1), k, range_docs)
    ranked = best.withColumn("rank", F.expr("row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id ASC NULLS LAST)")).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(items)], "item int, item_id long")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
