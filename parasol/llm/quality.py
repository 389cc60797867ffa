"""Text quality by a factorisation machine.

Features are hashed words (weighted by frequency, unit length a document), bins of structure statistics, and the
binned length as metadata. A document's score is a logistic of a bias, a weight for each feature, and an
interaction of low rank for each pair of them, which the identity
    sum over pairs of <v_i, v_j> x_i x_j = 1/2 sum over factors of ((sum v x)^2 - sum v^2 x^2)
gives in time linear in the features. Fitting is bounded: about SAMPLE labelled documents, dealt by hash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16  # of words
BINS = 12  # of each statistic
RANK, ROUNDS, RATE, DECAY = 8, 80, 0.05, 2e-4
SAMPLE = 5000  # labelled documents to fit on, in expectation; at most twice as many
THRESHOLD = 0.3
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
KIND = bytes(
    0x75 if 0x41 <= c <= 0x5A else 0x6C if 0x61 <= c <= 0x7A or c >= 0x80 else 0x64 if 0x30 <= c <= 0x39 else 0x20 if c in (9, 10, 11, 12, 13, 32) else 0x73
    for c in range(256)
)  # upper, lower, digit, space, symbol
REPEAT = re.compile(rb"(.)\1\1")


def statistics(b: bytes, words: Counter, n: int) -> list[float]:
    """Shares between 0 and 1, and two logarithmic sizes scaled to about that."""
    kinds = b.translate(KIND)
    size = max(1, len(b))
    lines = [x for x in b.split(b"\n") if x.strip()]
    upper, lower, digit, symbol = (kinds.count(k) for k in (b"u", b"l", b"d", b"s"))
    top = max(words.values(), default=0)
    return [
        upper / max(1, upper + lower),
        symbol / size,
        digit / size,
        (b.count(b"!") + b.count(b"?")) / size * 4,
        b.count(b"|") / size * 8,
        b.count(b".") / max(1, n),
        b.count(b",") / max(1, n),
        1 - len(words) / max(1, n),
        1 - len(set(lines)) / max(1, len(lines)),
        top / max(1, n),
        len(lines) / max(1, n) * 4,
        len(REPEAT.findall(b)) / max(1, n),
        (b.count(b"http") + b.count(b"@")) / max(1, n) * 4,
        sum(map(len, words)) / max(1, len(words)) / 16,
        np.log2(1 + n) / 16,
        np.log2(size) / 20,
    ]


STATISTICS = 16
SIZE = BUCKETS + STATISTICS * BINS


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values; an empty text has statistics only."""
    b = (text or "").encode("utf-8", "surrogatepass")
    words = Counter(b.translate(FOLD).split())
    n = words.total()
    at = np.fromiter((zlib.crc32(w) for w in words), np.int64, len(words)) & (BUCKETS - 1)
    x = 1 + np.log(np.fromiter(words.values(), np.float64, len(words)))
    if len(x):
        x /= np.sqrt((x * x).sum())
    s = np.clip(np.sqrt(np.clip(statistics(b, words, n), 0, 1)) * BINS, 0, BINS - 1).astype(np.int64)
    own = BUCKETS + np.arange(STATISTICS) * BINS + s
    return np.concatenate([at, own]), np.concatenate([x, np.full(STATISTICS, 0.5)])


class Machine:
    """Bias, weights and factors."""

    def __init__(self, bias: float, weight: np.ndarray, factor: np.ndarray):
        self.bias, self.weight, self.factor = bias, weight, factor

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        vx = self.factor[at] * x[:, None].astype(np.float32)
        pairs = 0.5 * float((vx.sum(axis=0) ** 2 - (vx * vx).sum(axis=0)).sum())
        z = self.bias + float(self.weight[at] @ x) + pairs
        return 1 / (1 + np.exp(-min(50.0, max(-50.0, z))))


def fit(rows: list[tuple[list[int], list[float], int]]) -> Machine:
    """Logistic loss, Adam over the whole sample. Without both labels, the share of label 1 (one half without any)."""
    y = np.array([r[2] for r in rows], np.float64)
    base = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    w, v = np.zeros(SIZE, np.float32), np.random.default_rng(0).normal(0, 0.05, (SIZE, RANK)).astype(np.float32)
    bias = float(np.log(base / (1 - base)))
    if len(set(y)) < 2:
        return Machine(bias, w, np.zeros_like(v))
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    at = np.concatenate([np.asarray(r[0], np.int64) for r in rows])
    x = np.concatenate([np.asarray(r[1], np.float32) for r in rows])
    used, at = np.unique(at, return_inverse=True)
    start = np.searchsorted(row, np.arange(len(rows)))
    order = np.argsort(at, kind="stable")
    bounds = np.searchsorted(at[order], np.arange(len(used)))
    params = [np.zeros(len(used), np.float32), v[used].copy(), np.array([bias], np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for k in range(1, ROUNDS + 1):
        vx = params[1][at] * x[:, None]
        s = np.add.reduceat(vx, start, axis=0)
        z = params[2][0] + np.add.reduceat(params[0][at] * x, start) + 0.5 * (s**2 - np.add.reduceat(vx * vx, start, axis=0)).sum(axis=1)
        g = ((1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / len(y)).astype(np.float32)
        gx = g[row] * x
        gv = (s[row] - vx) * gx[:, None]
        grads = [
            np.add.reduceat(gx[order], bounds) + DECAY * params[0] / 10,
            np.add.reduceat(gv[order], bounds, axis=0) + DECAY * params[1],
            np.array([g.sum()], np.float32),
        ]
        for p, d, m, n in zip(params, grads, first, second, strict=True):
            m += 0.1 * (d - m)
            n += 0.01 * (d * d - n)
            p -= RATE * (m / (1 - 0.9**k)) / (np.sqrt(n / (1 - 0.99**k)) + 1e-8)
    v[:] = 0  # features never seen interact with nothing
    w[used], v[used] = params[0], params[1]
    return Machine(float(params[2][0]), w, v)


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(1))


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    """Fits on labelled rows whose crc32(doc_id) mod 5 is not 0, dealt by hash if there are more than SAMPLE."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != 0))
    usable = usable.select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    n = usable.count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = usable.where(draw < SAMPLE / max(1, n)).orderBy(draw).limit(2 * SAMPLE)  # bounded, so it may be broadcast
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    # Where documents share an id, the least by hash stands for them: as many rows as labels, whatever the table.
    rows = rows.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64(F.coalesce("text", F.lit("")))).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            f = [features(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "at": [a for a, _ in f], "x": [x.astype(np.float32) for _, x in f], "y": pdf["quality"]})

    found = rows.mapInPandas(run, "doc_id long, at array<int>, x array<float>, y int")
    taken = sorted(found.collect(), key=lambda r: (r["doc_id"], r["y"], len(r["at"]), r["at"])) if n else []
    return fit([(r["at"], r["x"], r["y"]) for r in taken])


def scored(docs: DataFrame, machine: Machine, name: str = "score") -> DataFrame:
    """docs with the machine's score of the whole text; a column of that name is replaced."""
    docs = docs.drop(name)
    schema = docs.withColumn(name, F.lit(0.0)).schema
    sent = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.weight, machine.factor))  # fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Machine(*sent.value)
        for pdf in batches:
            yield pdf.assign(**{name: [m.score(*features(t)) for t in pdf["text"]]})

    return docs.mapInPandas(run, schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Null and empty texts are scored by their statistics alone; repeated rows alike. A null doc_id is not held
    out. Without labels every score is one half; with one kind of label, its clipped share. Further columns
    are not read.
    """
    machine = train(docs, labels)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), (fold(F.col("doc_id")) == 0).alias("held_out"))
    out = scored(rows, machine).drop("text")
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int"))
