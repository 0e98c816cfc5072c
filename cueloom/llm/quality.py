"""Quality classifier: n-gram indicators scaled by class log-count ratios under a linear hinge-loss model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec
from .near_dup import bounded_batches

#: Feature buckets, and the most labelled documents that the model is fitted on.
BUCKETS, MAX_LABELLED = 1 << 18, 20_000


def indicators(data, offsets):
    """Distinct feature buckets of each row: words, word pairs, byte 4-grams; and their bounds."""
    import numpy as np

    h, bounds, _, _ = textvec.words(data, offsets)
    pairs = textvec.mix(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:]) if len(h) > 1 else h[:0]
    mask = np.uint64(BUCKETS - 1)
    one = (h & mask).astype(np.int32)
    two = (pairs & mask).astype(np.int32)
    lo = int(offsets[0])
    b = data[lo : int(offsets[-1])].astype(np.uint32)
    if len(b) > 3:
        gram = b[:-3] | (b[1:-2] << np.uint32(8)) | (b[2:-1] << np.uint32(16)) | (b[3:] << np.uint32(24))
        four = ((gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - 18)).astype(np.int32)
    else:
        four = np.zeros(0, np.int32)
    stamp = np.zeros(BUCKETS, np.int32)
    out, sizes = [], np.zeros(len(offsets) - 1, np.int64)
    for i in range(len(sizes)):
        a, z = bounds[i], bounds[i + 1]
        s, e = int(offsets[i]) - lo, int(offsets[i + 1]) - lo
        idx = np.concatenate([one[a:z], two[a : max(a, z - 1)], four[s : max(s, e - 3)]])
        order = np.arange(len(idx), dtype=np.int32)
        stamp[idx] = order
        idx = idx[stamp[idx] == order]
        out.append(idx)
        sizes[i] = len(idx)
    return (np.concatenate(out) if out else np.zeros(0, np.int32)), np.concatenate([[0], np.cumsum(sizes)])


def fit(rows: list, labels, epochs: int = 12, c: float = 1.0, smooth: float = 1.0, seed: int = 5):
    """(ratios, weights, bias, slope, shift) from feature lists and 0/1 labels.

    Dual coordinate descent on the hinge loss of unit vectors r * x, each class
    weighing the same. Every fifth row of each class is kept back to fit the slope and shift
    that turn a margin into a probability.
    """
    import numpy as np

    y = np.asarray(labels) > 0
    counts = np.full((2, BUCKETS), smooth)
    for x, positive in zip(rows, y):
        counts[int(positive), x] += 1
    ratio = (np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())).astype(np.float32)
    back = np.zeros(len(rows), bool)
    for kind in (True, False):
        back[np.flatnonzero(y == kind)[4::5]] = True
    if min(y[~back].sum(), (~y[~back]).sum()) == 0 or min(y[back].sum(), (~y[back]).sum()) == 0:
        share = (y.sum() + 1.0) / (len(y) + 2.0)
        return ratio, np.zeros(BUCKETS, np.float32), 0.0, 0.0, float(np.log(share / (1 - share)))
    train = np.flatnonzero(~back)
    values = {}
    for i in train:
        v = ratio[rows[i]]
        values[i] = v / max(1e-12, float(np.sqrt((v * v).sum())))
    sign = np.where(y, 1.0, -1.0)
    upper = np.where(y, 0.5 * len(train) / y[train].sum(), 0.5 * len(train) / (~y[train]).sum()) * c
    w, bias, alpha = np.zeros(BUCKETS, np.float32), 0.0, np.zeros(len(rows))
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        for i in rng.permutation(train):
            x, v = rows[i], values[i]
            gradient = sign[i] * (float(w[x] @ v) + bias) - 1.0
            new = min(max(alpha[i] - gradient / 2.0, 0.0), upper[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                w[x] += np.float32(step) * v
                bias += step
                alpha[i] = new
    margins = np.array([float(w[rows[i]] @ ratio[rows[i]]) / max(1e-12, float(np.sqrt((ratio[rows[i]] ** 2).sum()))) + bias for i in np.flatnonzero(back)])
    slope, shift = logistic(margins, y[back])
    return ratio, w, bias, slope, shift


def logistic(margins, positive) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by damped Newton steps with a small ridge."""
    import numpy as np

    target = np.where(positive, (positive.sum() + 1) / (positive.sum() + 2), 1 / ((~positive).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        d, s = p - target, p * (1 - p)
        g = np.array([(d * margins).sum() + 1e-3 * a, d.sum()])
        m = np.array([[(s * margins * margins).sum() + 1e-3, (s * margins).sum()], [(s * margins).sum(), s.sum() + 1e-9]])
        step = np.linalg.solve(m, g)
        size = max(1.0, float(np.abs(step).max()) / 2)
        a, b = a - step[0] / size, b - step[1] / size
    return max(0.0, float(a)), float(b)


def train(docs: DataFrame, labelled: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple:
    """The model of ``labelled(doc_id, label)`` over the texts of ``docs(doc_id, text)``.

    At most ``max_labelled`` labelled rows are used, those of the smallest
    hashes of doc_id; that bounds the broadcast ids and the fitting task.
    Without labelled rows every score is 1/2.
    """
    import numpy as np

    bounded_batches(docs.sparkSession)
    picks = (
        labelled.where("doc_id is not null and label is not null")
        .groupBy("doc_id")
        .agg(F.max("label").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picks), "doc_id")

    def extract(batches):
        import pyarrow as pa

        for rb in batches:
            data, offsets = textvec.string_buffers(rb.column(1))
            for i, j in textvec.blocks(offsets):
                x, bounds = indicators(data, offsets[i : j + 1])
                yield pa.RecordBatch.from_arrays(
                    [rb.column(0).slice(i, j - i), rb.column(2).slice(i, j - i), pa.array([x[bounds[n] : bounds[n + 1]].tobytes() for n in range(j - i)], pa.binary())],
                    names=["doc_id", "label", "x"],
                )

    def learn(batches):
        import pyarrow as pa

        got = sorted((r for rb in batches for r in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), rb.column(2).to_pylist())), key=lambda r: (hash(r[0]) * 2654435761 % 4294967296, r[0], r[1]))
        rows = [np.frombuffer(r[2], np.int32) for r in got]
        ratio, w, *rest = fit(rows, [r[1] for r in got])
        yield pa.RecordBatch.from_arrays([pa.array([ratio.tobytes()]), pa.array([w.tobytes()]), pa.array([[float(x) for x in rest]])], names=["ratio", "w", "rest"])

    features = texts.select("doc_id", "text", "label").mapInArrow(extract, "doc_id long, label int, x binary")
    row = features.repartition(1).mapInArrow(learn, "ratio binary, w binary, rest array<double>").first()
    return np.frombuffer(row.ratio, np.float32), np.frombuffer(row.w, np.float32), *row.rest


def score(docs: DataFrame, model: tuple, threshold: float = 0.3, carry: list[str] | None = None) -> DataFrame:
    """doc_id (or the columns ``carry``), score, predicted for every row of ``docs(doc_id, text)``.

    Null and empty texts get the score of a text without features. Repeated rows
    are scored alike, other columns are ignored, no rows give no rows.
    """
    bounded_batches(docs.sparkSession)
    ratio, w, bias, slope, shift = model

    def work(batches):
        import numpy as np
        import pyarrow as pa

        for rb in batches:
            data, offsets = textvec.string_buffers(rb.column(1))
            for i, j in textvec.blocks(offsets):
                x, bounds = indicators(data, offsets[i : j + 1])
                r = ratio[x].astype(np.float64)
                total = np.concatenate([[0.0], np.cumsum(r * w[x])])
                norm = np.concatenate([[0.0], np.cumsum(r * r)])
                part = total[bounds[1:]] - total[bounds[:-1]]
                size = np.sqrt(np.maximum(norm[bounds[1:]] - norm[bounds[:-1]], 1e-12))
                p = 1 / (1 + np.exp(-np.clip(slope * (part / size + bias) + shift, -30, 30)))
                kept = [rb.column(c).slice(i, j - i) for c in range(rb.num_columns) if c != 1 or "text" in carry]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*carry, "score", "predicted"])

    carry = carry or ["doc_id"]
    text = docs.withColumn("text", F.col("text").cast("string"))
    chosen = text.select(carry[0], "text", *(c for c in carry[1:] if c != "text"))
    carry = [c for c in chosen.columns if c in carry]
    schema = T.StructType([*chosen.select(*carry).schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return chosen.mapInArrow(work, schema)


def held_out(doc_id):
    """Whether a row's labels must not be learned from: crc32(doc_id as text) mod 5 is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
