"""Quality classifier: supervised subword embeddings averaged per document.

A text becomes hashed word 1- and 2-grams, hashed byte 1- to 4-grams, and markers (the share of five-word windows seen
before in the text, and its length class). Each of these groups is averaged, the document vector is the mean of the
group means, and a softmax layer gives the score. Vectors and output weights are learned together by stochastic gradient
descent in numpy, on at most ``SAMPLE`` labelled rows (the smallest by a hash of the id), in one task of bounded size.
Since the score is linear in the average, scoring needs one number per bucket: a broadcast of ``BUCKETS`` floats.

Labels are learned only from rows whose crc32(id as text) mod 3 is not 1. Language, source, id and labels are no
inputs. Defined cases: a null text is an empty one and is scored by its length class and bias; with nothing to learn
from every score is 0.5; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.decontaminate import window_hashes, word_hashes

#: Rows to learn from at most, table size, vector size, passes and first learning rate.
SAMPLE, BUCKETS, DIM, EPOCHS, RATE = 2500, 1 << 16, 8, 6, 0.5
FOLDS, HELD_OUT = 3, 1
#: Buckets of markers, below the hashed ones.
NEW, AGAIN, LENGTH = 0, 1, 2
FIRST = 64


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _bucket(h: np.ndarray) -> np.ndarray:
    return FIRST + (h % np.uint64(BUCKETS - FIRST)).astype(np.int64)


def features(text: str | None) -> list[tuple[np.ndarray, np.ndarray | None]]:
    """(buckets, weights) of each group; without weights every bucket counts the same."""
    data = b" ".join((text or "").encode("utf-8", "replace").split())
    hashes, _ = word_hashes(np.frombuffer(data, np.uint8))
    n = len(hashes)
    windows = window_hashes(hashes, 5)
    new = len(np.unique(windows)) / len(windows) if len(windows) else 1.0
    groups = [(np.array([NEW, AGAIN]), np.array([new, 1 - new])), (np.array([LENGTH + n.bit_length()]), np.ones(1))]
    if n:
        groups.append((_bucket(np.concatenate([hashes, window_hashes(hashes, 2)])), None))
        raw = np.frombuffer(b" " + data + b" ", np.uint8).astype(np.uint32)
        h, found = raw, []
        for width in range(1, 5):
            if width > 1:
                h = h[:-1] * np.uint32(0x01000193) + raw[width - 1 :] if len(h) > 1 else h[:0]
            found.append((h + np.uint32(width)) * np.uint32(0x9E3779B1) >> np.uint32(8))
        chars = np.concatenate(found)
        groups.append((FIRST + (chars % np.uint32(BUCKETS - FIRST)).astype(np.int64), None))
    return groups


def _sparse(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    groups = features(text)
    at = np.concatenate([g for g, _ in groups])
    weight = np.concatenate([np.full(len(g), 1 / len(g)) if w is None else w for g, w in groups]) / len(groups)
    ids, back = np.unique(at, return_inverse=True)
    return ids, np.bincount(back, weight).astype(np.float32)


def train(rows: list[tuple[str | None, int]], seed: int = 7) -> np.ndarray:
    """Log-odds of label 1 per bucket, and the bias last."""
    out = np.zeros(BUCKETS + 1, np.float32)
    if not rows:
        return out
    r = np.random.default_rng(seed)
    vectors = r.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    top, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    made = [(*_sparse(t), y) for t, y in rows]
    steps, total = 0, EPOCHS * len(made)
    for _ in range(EPOCHS):
        for k in r.permutation(len(made)):
            ids, weight, y = made[k]
            rate = RATE * (1 - steps / total)
            steps += 1
            own = vectors[ids]
            h = weight @ own
            z = top @ h + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = p @ top
            top -= rate * np.outer(p, h)
            bias -= np.float32(0.1 * rate) * p
            # the gradient over the squared weights: the average moves by rate * back, however long the text is
            vectors[ids] = own - rate * np.outer(weight / (weight @ weight), back)
    out[:-1] = vectors @ (top[1] - top[0])
    out[-1] = bias[1] - bias[0]
    return out


def score(model: np.ndarray, text: str | None) -> float:
    groups = features(text)
    z = sum(float(model[g].mean(dtype=np.float64)) if w is None else float(model[g] @ w) for g, w in groups) / len(groups) + float(model[-1])
    return float(1 / (1 + np.exp(-np.clip(z, -700, 700))))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> np.ndarray:
    """Model learned from at most ``sample`` labelled rows outside the held-out fold."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key)))
    known = known.groupBy(F.col(key).alias("key")).agg(F.min(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("key"), "key").limit(sample)  # so many rows at most: small enough to broadcast
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "key")
    rows = rows.dropDuplicates(["key"]).select("key", "text", "label")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda x: x[0])
        yield pa.RecordBatch.from_arrays([pa.array([train([x[1:] for x in got])], pa.list_(pa.float32()))], names=["model"])

    model = rows.repartition(1).mapInArrow(run, "model array<float>").first()
    return np.zeros(BUCKETS + 1, np.float32) if model is None else np.array(model[0], np.float32)


def classify(docs: DataFrame, model: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, held_out, score, predicted)`` for every row; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([score(shared.value, texts[i].as_py()) for i in range(batch.num_rows)], pa.float64())], names=["key", "score"])

    out = docs.select(F.col(key).alias("key"), F.col(text).cast("string")).mapInArrow(run, f"key {kind}, score double")
    return out.select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
