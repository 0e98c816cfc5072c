"""Near-duplicate documents by MinHash with sequential Bayesian verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec
from .lsh import bayes_prune, linked_components
from .scratch import Scratch

#: Bands and rows of each band. A pair of similarity 0.8 shares none of 40 bands
#: of 6 rows with probability 5e-6.
BANDS, ROWS = 40, 6


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of 16 MB or 2,000 rows, so that very long texts don't swell a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def signatures(docs: DataFrame, k: int, bands: int, rows: int, seed: int) -> DataFrame:
    """doc_id, n_shingles, two 64-bit digests of the shingle set, SHA-256 of the text, 16-bit signature (binary) and band keys."""

    def work(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        mask = np.uint64(0xFFFFFFFFFFFFFFFF)
        for batch in batches:
            data, offsets = textvec.string_buffers(batch.column(1))
            for i, j in textvec.blocks(offsets):
                h, bounds, _, _ = textvec.words(data, offsets[i : j + 1])
                s, sb = textvec.distinct(*textvec.shingles(h, bounds, k))
                sig = textvec.min_hashes(s, sb, bands * rows, seed)
                n = np.diff(sb)
                sums = np.concatenate([[np.uint64(0)], np.cumsum(s, dtype=np.uint64)])
                mixed = np.concatenate([[np.uint64(0)], np.cumsum(textvec.mix(s ^ mask), dtype=np.uint64)])
                d1, d2 = (x[sb[1:]] - x[sb[:-1]] for x in (sums, mixed))
                keys = np.zeros((j - i, bands), np.uint64)
                for r in range(rows):
                    keys = textvec.mix(keys * np.uint64(0xD6E8FEB86659FD93) + sig[:, r::rows][:, :bands].astype(np.uint64) + np.uint64(1))
                keys = textvec.mix(keys + np.arange(bands, dtype=np.uint64))
                width = 2 * bands * rows
                low = np.ascontiguousarray((sig >> np.uint32(8)).astype(np.uint16))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(n.astype(np.int64)),
                        pa.array(d1.view(np.int64)),
                        pa.array(d2.view(np.int64)),
                        pa.array([hashlib.sha256(data[a:b]).digest() for a, b in zip(offsets[i:j], offsets[i + 1 : j + 1])], pa.binary()),
                        pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), j - i, [None, pa.py_buffer(low.tobytes())]).cast(pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * bands), pa.array(keys.ravel().view(np.int64))),
                    ],
                    names=["doc_id", "n_shingles", "d1", "d2", "sha", "signature", "band_keys"],
                )

    schema = "doc_id long, n_shingles long, d1 long, d2 long, sha binary, signature binary, band_keys array<long>"
    return docs.mapInArrow(work, schema)


def confirm(pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of pairs(a, b, ta, tb) keeps (a, b) whose full shingle sets have 100 * intersection >= percent * union."""

    def work(batches):
        import re

        import pyarrow as pa

        word = re.compile(r"[^\x20\x09-\x0D]+")
        fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

        def full_set(text):
            w = word.findall((text or "").translate(fold))
            return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

        for rb in batches:
            last, left, keep = None, None, []
            texts = rb.column(2), rb.column(3)
            for row, a in enumerate(rb.column(0).to_pylist()):
                if a != last or left is None:
                    last, left = a, full_set(texts[0][row].as_py())
                right = full_set(texts[1][row].as_py())
                both = len(left & right)
                if left and right and 100 * both >= percent * (len(left) + len(right) - both):
                    keep.append(row)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([rb.column(0).take(take), rb.column(1).take(take)], names=["a", "b"])

    return pairs.select("a", "b", "ta", "tb").mapInArrow(work, "a long, b long")


def hashed_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id and the distinct 64-bit hashes of the k-word shingles of ``docs(doc_id, text)``."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            data, offsets = textvec.string_buffers(batch.column(1))
            for i, j in textvec.blocks(offsets):
                h, bounds, _, _ = textvec.words(data, offsets[i : j + 1])
                v, vb = textvec.distinct(*textvec.shingles(h, bounds, k))
                values = pa.ListArray.from_arrays(pa.array(vb.astype(np.int32)), pa.array(v.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), values], names=["doc_id", "hashes"])

    return docs.mapInArrow(work, "doc_id long, hashes array<long>")


def near_duplicates(
    docs: DataFrame,
    k: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
    batch: int = 24,
    miss: float = 1e-6,
    seed: int = 20,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs(doc_id, text)``.

    Documents are linked when 100 * intersection >= percent * union of their
    sets of k-word shingles (A-Z folded); components are the classes of linked
    documents and each keeps its smallest doc_id. Equal texts, and texts whose
    sets have equal digests and are equal in full, share a class from the
    start. Candidates share a band of their signatures and pass the Bayesian
    batches of ``batch`` hashes, which lose a true pair with a chance of ``miss``;
    every link is confirmed on the full sets.

    Null or empty text: an empty set, linked with nothing. Rows that share a
    doc_id are one node; a row without doc_id is its own class (component_id
    null, kept). Other columns are ignored. No rows give no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "near-dup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = scratch.cut(signatures(docs, k, bands, rows, seed), "signatures")
    text_key, set_key = ["n_shingles", "d1", "d2", "sha"], ["n_shingles", "d1", "d2"]

    def confirmed(pairs: DataFrame, tag: str, least: int = percent) -> DataFrame:
        """Links among distinct pairs(a, b)."""
        pairs = scratch.cut(pairs, f"pairs-{tag}")
        ids = scratch.cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), f"ids-{tag}")
        texts = scratch.cut(docs.join(ids, "doc_id", "left_semi"), f"texts-{tag}")
        full = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").join(
            texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a"
        )
        return scratch.cut(confirm(full, k, least), f"links-{tag}")

    texts = scratch.cut(sig.where("n_shingles > 0 and doc_id is not null").groupBy(*text_key).agg(F.min("doc_id").alias("own")), "texts")
    first = scratch.cut(texts.groupBy(*set_key).agg(F.min("own").alias("rep")), "sets")
    texts = texts.join(first, set_key)
    equal = confirmed(texts.where("own <> rep").select(F.col("rep").alias("a"), F.col("own").alias("b")).distinct(), "equal", 100)
    classes = texts.join(equal.select(F.col("b").alias("own"), F.col("a").alias("rep"), F.lit(True).alias("equal")).distinct(), ["own", "rep"], "left")
    classes = scratch.cut(classes.select(*text_key, F.when(F.col("equal"), F.col("rep")).otherwise(F.col("own")).alias("rep")), "classes")
    reps = sig.where("n_shingles > 0").join(classes.select(F.col("rep").alias("doc_id"), *set_key), ["doc_id", *set_key], "left_semi")
    reps = scratch.cut(reps.dropDuplicates(["doc_id", "d1", "d2"]), "reps")
    scratch.release()
    members = reps.select(F.explode("band_keys").alias("bucket"), F.col("doc_id").alias("node"), F.lit(0).cast("long").alias("sketch"))

    def likely(pairs: DataFrame) -> DataFrame:
        """Of distinct pairs(a, b) those that the signatures leave."""
        light = reps.select("doc_id", "signature", "n_shingles")
        sized = (
            pairs.join(light.select(F.col("doc_id").alias("a"), F.col("signature").alias("sa"), F.col("n_shingles").alias("na")), "a")
            .join(light.select(F.col("doc_id").alias("b"), F.col("signature").alias("sb"), F.col("n_shingles").alias("nb")), "b")
            .where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
        )
        return bayes_prune(sized, bands * rows, percent / 100, batch, miss)

    def signed(rows: DataFrame) -> DataFrame:
        return rows.join(reps.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "signature"), "node")

    def contents(ids: DataFrame) -> DataFrame:
        return hashed_sets(docs.join(ids.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi"), k).select(F.col("doc_id").alias("node"), F.col("hashes").alias("content"))

    label = linked_components(members, scratch, percent, likely, confirmed, contents, signed=signed, n_hashes=bands * rows, batch=batch, miss=miss)

    return (
        sig.select("doc_id", *text_key)
        .join(classes, text_key, "left")
        .withColumn("rep", F.coalesce("rep", "doc_id"))
        .join(label.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).alias("component_id"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
