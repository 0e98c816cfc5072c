"""Benchmark decontamination by latent semantic retrieval and subsequence checks."""

from __future__ import annotations

import bisect
import math
import re
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .near_dup import bounded_batches

#: Hashed terms, most passages (and latent dimensions) of one space and extra random directions, words of a passage's half.
TERMS, RANK, EXTRA, HALF = 1 << 17, 128, 10, 16
#: Least cosine of a candidate, least share of an item's words found in order, share of its answer.
COSINE, LCS, ANSWER = 0.30, 0.70, 0.5
#: Benchmark items, and about how many of their passages, handled in one scan of the documents; more go in further scans.
ITEMS, PASSAGES = 4_000, 4_096

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def fold_words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(FOLD))


def answer_words(text: str | None, answer: str | None = None) -> list[str]:
    """The words of the given answer, else of the last of several sentences."""
    if answer:
        return fold_words(answer)
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", (text or "").strip()) if p.strip()]
    return fold_words(parts[-1]) if len(parts) > 1 else []


def word_hashes(words: list[str]) -> list[int]:
    """The 64-bit hashes by which words are compared."""
    import pyarrow as pa

    data, offsets = textvec.string_buffers(pa.array([" ".join(words)], pa.large_string()))
    return textvec.words(data, offsets)[0].tolist()


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bit rows."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & places.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def compare(item: list, answer: list, region: list, least: int = 1) -> tuple[float, float]:
    """Best shares of the item's and its answer's words in order, over stretches of 5/4 of the item's length.

    ``region`` has (place, word) of the words that the item holds too; other
    words can't be in a common subsequence, so a best stretch begins at one of these.
    Stretches of fewer than ``least`` such words aren't looked into, as they can't have as many in order.
    """
    size = max(1, len(item) * 5 // 4)
    best, at = 0, 0
    places = [p for p, _ in region]
    for i in places:
        lo, hi = bisect.bisect_left(places, i), bisect.bisect_left(places, i + size)
        if hi - lo <= best or hi - lo < least:
            continue
        got = lcs_length(item, [w for _, w in region[lo:hi]])
        if got > best:
            best, at = got, i
    stop = at + size + max(1, len(item) // 8)
    found = lcs_length(answer, [w for p, w in region if at <= p < stop]) / len(answer) if answer else 1.0
    return best / len(item), found


def passage_starts(n: int) -> list[int]:
    """Where the passages of an item of ``n`` words begin: as few as cover it, spread evenly."""
    k = max(1, -(-n // (2 * HALF)))
    return [i * (n - 2 * HALF) // (k - 1) for i in range(k)] if k > 1 else [0]


@dataclass
class Space:
    """The latent space of at most RANK passages, which loses nothing of them."""

    local: object
    scaled: object
    vectors: object
    owner: object


@dataclass
class Index:
    """A block of benchmark items, bounded by ITEMS and PASSAGES, and the latent spaces of their passages."""

    ids: list
    words: list
    answers: list
    column: object
    idf: object
    other_idf: float
    spaces: list
    rare: list
    hashes: tuple
    counts: tuple
    sizes: list

    def cosine(self, columns, length: float, item: int) -> float:
        """The best cosine of a document passage with the passages of an item."""
        best = 0.0
        for space in self.spaces:
            own = space.owner == item
            if own.any():
                at = space.local[columns]
                best = max(best, float((space.scaled[at[at >= 0]].sum(axis=0) @ space.vectors[:, own]).max()) / length)
        return best

    def hits(self, data, offsets, cosine: float, share: float, answer_share: float):
        """(row, item id, cosine, lcs, answer) of the texts between the offsets."""
        import numpy as np

        h, bounds, _, _ = textvec.words(data, offsets)
        term = (h >> np.uint64(64 - 17)).astype(np.int64)
        col = self.column[term]
        known = col >= 0
        weight = np.where(known, self.idf[col], self.other_idf).astype(np.float32)
        counts = np.diff(bounds)
        halves = -(-counts // HALF)
        first = np.concatenate([[0], np.cumsum(halves)])
        if not first[-1]:
            return
        row = np.repeat(np.arange(len(counts)), halves)
        begin = bounds[:-1][row] + (np.arange(first[-1]) - first[:-1][row]) * HALF
        norm = np.add.reduceat(weight * weight, begin)
        joined = np.flatnonzero(row[1:] == row[:-1])
        total = norm.copy()
        total[joined] += norm[joined + 1]
        length = np.sqrt(np.maximum(total, 1e-9))[:, None]
        kept = np.flatnonzero(known)
        col, half = col[kept], np.searchsorted(begin, kept, side="right") - 1
        found = []
        for space in self.spaces:
            at = space.local[col]
            inside = np.flatnonzero(at >= 0)
            if not len(inside):
                continue
            at, where = at[inside], half[inside]
            sums = np.zeros((len(begin), space.scaled.shape[1]), np.float32)
            cut = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
            many = np.diff(np.append(cut, len(at)))
            for a in range(0, len(cut), 2048):
                # The longest halves first, so that the n-th words of all halves that have so many are added at once.
                part = a + np.argsort(-many[a : a + 2048], kind="stable")
                from_, left = cut[part], many[part]
                acc = space.scaled[at[from_]]
                for n in range(1, int(left[0])):
                    m = int(np.searchsorted(-left, -n))
                    acc[:m] += space.scaled[at[from_[:m] + n]]
                sums[where[from_]] = acc
            vec = sums.copy()
            vec[joined] += sums[joined + 1]
            vec /= length
            step = max(256, (1 << 21) // len(space.owner))
            for a in range(0, len(vec), step):
                near = vec[a : a + step] @ space.vectors
                p, q = np.nonzero(near >= cosine)
                found.append((p + a, space.owner[q], near[p, q]))
        last = first[1:][row]
        for start, stop, need, owner, reach, origin in self.rare:
            there = stop[col] > start[col]
            many = (stop[col] - start[col])[there]
            at = np.repeat(start[col][there] - np.cumsum(many) + many, many) + np.arange(many.sum())
            cells = np.bincount(np.repeat(half[there], many) * len(need) + owner[at], minlength=len(begin) * len(need))
            upto = np.zeros((len(begin) + 1, len(need)), np.int32)
            np.cumsum(cells.reshape(len(begin), len(need)), axis=0, out=upto[1:])
            for w in np.unique(reach):
                items = np.flatnonzero(reach == w)
                end = np.minimum(np.arange(len(begin)) + w, last)
                own = upto[:, items]
                p, q = np.nonzero(own[end] - own[:-1] >= need[items])
                found.append((np.minimum(p + w // 2, last[p] - 1), items[q] + origin, np.full(len(p), -1.0, np.float32)))
        if not found:
            return
        p, q, near = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((-near, q, p))
        p, q, near = p[order], q[order], near[order]
        first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (q[1:] != q[:-1])])) if len(p) else order
        best: dict = {}
        for p, q, c in zip(p[first].tolist(), q[first].tolist(), near[first].tolist()):
            r = int(row[p])
            known = best.get((r, q))
            if known and known[0] >= 1.0:
                best[r, q] = (*known[:2], max(known[2], c))
                continue
            size = self.sizes[q]
            lo, hi = max(int(bounds[r]), int(begin[p]) - size), min(int(bounds[r + 1]), int(begin[p]) + 2 * HALF + size)
            at = np.searchsorted(self.hashes[q], h[lo:hi])
            shared = self.hashes[q].take(at, mode="clip") == h[lo:hi]
            if np.minimum(np.bincount(at[shared], minlength=len(self.counts[q])), self.counts[q]).sum() < share * size:
                continue
            places = np.flatnonzero(shared)
            words = h[lo:hi][places].tolist()
            if lcs_length(self.words[q], words) < share * size:
                continue
            got, answer = compare(self.words[q], self.answers[q], list(zip(places.tolist(), words)), math.ceil(share * size - 1e-9))
            if got >= share and (answer >= answer_share or got >= 0.85):
                if c < 0:
                    words = slice(int(begin[p]), min(int(begin[p]) + 2 * HALF, int(bounds[r + 1])))
                    c = self.cosine(self.column[term[words]][self.column[term[words]] >= 0], float(length[p, 0]), q)
                known = known or (0.0, 0.0, 0.0)
                best[r, q] = (*max(known[:2], (got, answer)), max(known[2], c))
        for (r, q), (got, answer, c) in best.items():
            yield r, self.ids[q], c, got, answer


def randomised_svd(matrix, rank: int, extra: int = EXTRA, passes: int = 2, seed: int = 11):
    """Right singular vectors (columns x rank) of the rows of ``matrix``: a random block times A^T A, orthonormalised after each pass."""
    import numpy as np

    width = min(matrix.shape[1], rank + extra)
    block = np.random.Generator(np.random.PCG64(seed)).standard_normal((matrix.shape[1], width))
    for _ in range(passes + 1):
        block, r = np.linalg.qr(matrix.T @ (matrix @ np.linalg.qr(block)[0]))
    return (block @ np.linalg.svd(r)[0])[:, :rank]


def latent_spaces(spark, passages: list, owners: list, idf, rank: int) -> list[Space]:
    """A space for each ``rank`` of the sparse ``passages`` (terms, weights), fitted in tasks."""
    import numpy as np

    rows = [
        (b // rank, [i.tolist() for i, _ in passages[b : b + rank]], [v.tolist() for _, v in passages[b : b + rank]])
        for b in range(0, len(passages), rank)
    ]

    def fit(batches):
        import numpy as np
        import pyarrow as pa

        for rb in batches:
            out = []
            for idx, val in zip(rb.column(1).to_pylist(), rb.column(2).to_pylist()):
                terms = np.unique(np.concatenate(idx))
                matrix = np.zeros((len(idx), len(terms)))
                for i, (t, v) in enumerate(zip(idx, val)):
                    matrix[i, np.searchsorted(terms, t)] = v
                basis = randomised_svd(matrix, min(matrix.shape))
                vectors = matrix @ basis
                vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
                out.append([x.tobytes() for x in (terms.astype(np.int64), basis, vectors)])
            yield pa.RecordBatch.from_arrays([rb.column(0), *(pa.array([x[k] for x in out], pa.binary()) for k in range(3))], names=["space", "terms", "basis", "vectors"])

    spaces = []
    table = spark.createDataFrame(rows, "space int, idx array<array<int>>, val array<array<double>>").repartition(len(rows), "space")
    for r in sorted(table.mapInArrow(fit, "space int, terms binary, basis binary, vectors binary").collect()):
        terms, owner = np.frombuffer(r.terms, np.int64), np.asarray(owners[r.space * rank : (r.space + 1) * rank])
        basis = np.frombuffer(r.basis).reshape(len(terms), -1)
        local = np.full(len(idf), -1, np.int32)
        local[terms] = np.arange(len(terms))
        vectors = np.frombuffer(r.vectors).reshape(len(owner), -1)
        spaces.append(Space(local, (basis * idf[terms, None]).astype(np.float32), np.ascontiguousarray(vectors.T, np.float32), owner))
    return spaces


def rare_words(terms: list, idf, share: float, step: int = 256) -> list[tuple]:
    """For each ``step`` items, the postings of their rarest words and how many of them must be met.

    A stretch with ``share`` of an item's words holds at least ``need`` of the
    rarest (1 - share) * size + need, so that no item is missed whose words
    are there, whatever its cosine. A stretch lies in ``reach`` halves.
    """
    import numpy as np

    out = []
    for origin in range(0, len(terms), step):
        need, reach, pairs = [], [], []
        for i, t in enumerate(terms[origin : origin + step]):
            least = max(1, math.ceil(share * len(t)))
            most = min(len(t), len(t) - least + max(1, len(t) // 5))
            need.append(least - len(t) + most)
            reach.append(-(-max(1, len(t) * 5 // 4) // HALF) + 1)
            pairs += [(c, i) for c in set(t[np.argsort(-idf[t], kind="stable")[:most]].tolist())]
        column, owner = np.array(sorted(pairs)).T
        every = np.arange(len(idf))
        out.append((np.searchsorted(column, every), np.searchsorted(column, every, side="right"), np.array(need), owner, np.array(reach), origin))
    return out


def document_frequencies(docs: DataFrame, column) -> tuple[int, object]:
    """Number of documents, and how many hold each benchmark term, over all of ``docs(text)``."""
    import numpy as np

    columns = int(column.max()) + 1

    def count(batches):
        import numpy as np
        import pyarrow as pa

        total, n = np.zeros(columns, np.int64), 0
        for rb in batches:
            data, offsets = textvec.string_buffers(rb.column(0))
            n += rb.num_rows
            for i, j in textvec.blocks(offsets):
                h, bounds, _, _ = textvec.words(data, offsets[i : j + 1])
                col = column[(h >> np.uint64(64 - 17)).astype(np.int64)]
                row = np.repeat(np.arange(j - i), np.diff(bounds))
                pair = np.unique(row[col >= 0] * columns + col[col >= 0])
                total += np.bincount(pair % columns, minlength=columns)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], n))], names=["term", "n"])

    got = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(columns)
    n = 0
    for r in got:
        if r.term < 0:
            n = r.n
        else:
            df[r.term] = r.n
    return n, df


def build_index(docs: DataFrame, items: DataFrame, rank: int = RANK, share: float = LCS) -> Index | None:
    """The index of ``items(item_id, text[, answer])``; None where no item has words.

    Term weights are 1 + log of the count times log(1 + N / df), df over all
    documents. Items without words are skipped.
    """
    import numpy as np

    spark = docs.sparkSession
    bounded_batches(spark)
    has_answer = "answer" in items.columns
    rows = items.select("item_id", F.col("text").cast("string"), (F.col("answer").cast("string") if has_answer else F.lit(None).cast("string")).alias("answer")).collect()
    rows = sorted((r for r in rows if fold_words(r.text)), key=lambda r: (r.item_id is not None, r.item_id, r.text))
    if not rows:
        return None
    import pyarrow as pa

    data, offsets = textvec.string_buffers(pa.array([r.text for r in rows], pa.large_string()))
    h, bounds, _, _ = textvec.words(data, offsets)
    term = (h >> np.uint64(64 - 17)).astype(np.int64)
    column = np.full(TERMS, -1, np.int32)
    present = np.unique(term)
    column[present] = np.arange(len(present))
    n, df = document_frequencies(docs, column)
    idf = np.log1p(max(n, 1) / np.maximum(df, 1.0))
    passages, owners = [], []
    for i in range(len(rows)):
        for start in passage_starts(int(bounds[i + 1] - bounds[i])):
            at = bounds[i] + start
            idx, tf = np.unique(column[term[at : min(at + 2 * HALF, bounds[i + 1])]], return_counts=True)
            val = tf * idf[idx]
            passages.append((idx, val / np.sqrt((val * val).sum())))
            owners.append(i)
    spaces = latent_spaces(spark, passages, owners, idf, rank)
    rare = rare_words([column[term[bounds[i] : bounds[i + 1]]] for i in range(len(rows))], idf, share)
    hashed = [h[bounds[i] : bounds[i + 1]] for i in range(len(rows))]
    answers = [word_hashes(answer_words(r.text, r.answer)) for r in rows]
    hashes, counts = zip(*(np.unique(x, return_counts=True) for x in hashed))
    return Index(
        [r.item_id for r in rows], [x.tolist() for x in hashed], answers, column, idf, float(idf.max()), spaces, rare, hashes, counts, [len(x) for x in hashed],
    )


def item_blocks(benchmark: DataFrame, items: int = ITEMS, passages: int = PASSAGES):
    """The benchmark in blocks of about ``items`` rows or ``passages`` passages, whichever are reached first."""
    words = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD.pattern)), F.lit(0))
    n, p = benchmark.agg(F.count("*"), F.coalesce(F.sum(F.ceil(words / (2 * HALF))), F.lit(0))).first()
    parts = max(-(-n // items), -(-p // passages))
    for b in range(parts):
        yield benchmark if parts == 1 else benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == b)


def find_leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, share: float = LCS, answer_share: float = ANSWER) -> DataFrame:
    """doc_id, item_id, cosine, lcs, answer: the documents that hold a benchmark item or a paraphrase of it.

    Items are cut into passages of 32 words, and at most RANK passages share a
    latent space, so that no passage is shortened by its projection. Every
    passage of 32 words (stepping by 16) of every document is folded into all
    spaces; a cosine of ``cosine`` or more with a passage of an item makes it a
    candidate for the item; so is any stretch that holds as many of an item's
    rarest words as it must to have ``share`` of all its words, whatever its
    cosine. In the words around a candidate, at least
    ``share`` of the item's words must appear in order within 5/4 of its
    length, with ``answer_share`` of its answer (or 85 % of the whole item).

    Null or empty texts and items match nothing; null ids are carried; repeated
    rows are searched alike; other columns are ignored; an empty benchmark or no
    documents give no rows.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, cosine double, lcs double, answer double"
    out = spark.createDataFrame([], schema)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for part in item_blocks(benchmark):
        index = build_index(docs, part, share=share)
        if not index:
            continue
        shared = spark.sparkContext.broadcast(cloudpickle.dumps(index))

        def work(batches, shared=shared):
            import pyarrow as pa

            index = cloudpickle.loads(shared.value)
            for rb in batches:
                data, offsets = textvec.string_buffers(rb.column(1))
                for i, j in textvec.blocks(offsets):
                    got = sorted(index.hits(data, offsets[i : j + 1], cosine, share, answer_share))
                    ids = rb.column(0).slice(i, j - i).take(pa.array([g[0] for g in got], pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array([g[1] for g in got], pa.int64()), *(pa.array([g[k] for g in got], pa.float64()) for k in (2, 3, 4))],
                        names=["doc_id", "item_id", "cosine", "lcs", "answer"],
                    )

        out = out.unionByName(texts.mapInArrow(work, schema))
    return out.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("lcs").alias("lcs"), F.max("answer").alias("answer"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, share: float = LCS, answer_share: float = ANSWER) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which ``find_leaks`` finds nothing."""
    out = docs
    at = docs.columns.index("text")
    for part in item_blocks(benchmark):
        index = build_index(docs, part, share=share)
        if not index:
            continue
        shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(index))

        def work(batches, shared=shared):
            import pyarrow as pa

            index = cloudpickle.loads(shared.value)
            for rb in batches:
                data, offsets = textvec.string_buffers(rb.column(at))
                dirty = {i + g[0] for i, j in textvec.blocks(offsets) for g in index.hits(data, offsets[i : j + 1], cosine, share, answer_share)}
                yield rb.take(pa.array([n for n in range(rb.num_rows) if n not in dirty], pa.int64()))

        out = out.mapInArrow(work, docs.schema)
    return out
