"""Approximate nearest neighbours by an inverted multi-index.

The two halves of a vector are quantised by codebooks of their own; a pair of centroids is a cell of the index.
A query walks the grid of cells by summed distance (here: falling summed inner product) from a heap, until the
cells it has seen hold the wanted share of all vectors; the entries of those cells are reranked by the exact
inner product. Equal vectors are one entry with their smallest ids, so a vector that fills a third of the table
is compared once. Entries lie in blocks of neighbouring cells, a crowded cell in several; a query goes to the blocks
that hold a cell it probes, and to no other. Every row is indexed.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parasol.llm.common import keep, parts

CENTROIDS = 64  # of each half
SAMPLE = 8192  # rows, at most, on which codebooks are fitted
SHARE = 0.5  # of all distinct vectors, that a query's cells hold at least
BLOCK = 8192  # entries
STRIP = 256  # queries compared at once
ENTRY = "vec array<double>, ids array<long>, cell int"
MEET = "eb int, home boolean, query_id long, vec array<double>, probed binary, ids array<long>, cell int"


def codebook(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means centroids, k at most as many as distinct rows; the first rows start it."""
    rows = np.asarray(rows, np.float64)
    start = np.unique(rows, axis=0)
    start = start[np.random.default_rng(0).permutation(len(start))[:k]].copy()
    for _ in range(rounds):
        at = quantise(rows, start)
        n = np.bincount(at, minlength=len(start))
        for j in np.flatnonzero(n):
            start[j] = rows[at == j].mean(axis=0)
    return start


def quantise(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmax(rows @ centroids.T - 0.5 * (centroids**2).sum(axis=1), axis=1)


def probes(first: np.ndarray, second: np.ndarray, held: np.ndarray, want: int) -> np.ndarray:
    """Cells in falling order of first[i] + second[j] until they hold `want` vectors; held: by cell, row-major."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    m, heap, out, seen = len(b), [(-(x[0] + y[0]), 0, 0)], [], 0
    while heap and seen < want:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * m + int(b[j])
        out.append(cell)
        seen += int(held[cell])
        if j + 1 < m:
            heapq.heappush(heap, (-(x[i] + y[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (-(x[i + 1] + y[0]), i + 1, 0))
    return np.array(out, np.int64)


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.concatenate([*column.to_numpy(), np.zeros(0)]).reshape(-1, width)


class Block:
    """Entries of some cells, sorted by cell."""

    def __init__(self, parts_: list[pd.DataFrame], width: int):
        rows = pd.concat(parts_).sort_values("cell", kind="stable")
        self.vectors, self.ids, self.cell = _matrix(rows["vec"], width), rows["ids"].to_numpy(), rows["cell"].to_numpy(np.int64)
        self.cuts = np.flatnonzero(np.r_[True, self.cell[1:] != self.cell[:-1], True])

    def nearest(self, queries: pd.DataFrame, cells: int, k: int) -> Iterator[tuple[int, int, float]]:
        """The k nearest entries' rows of each query among the entries whose cell it probes."""
        e, cuts = self.vectors, self.cuts
        q, names = _matrix(queries["vec"], e.shape[1]), queries["query_id"].to_numpy(np.int64)
        bits = np.unpackbits(np.stack([np.frombuffer(b, np.uint8) for b in queries["probed"]]), axis=1, bitorder="little")[:, :cells]
        for s in range(0, len(q), STRIP):
            score = np.full((min(STRIP, len(q) - s), len(e)), -np.inf)
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                who = np.flatnonzero(bits[s : s + STRIP, self.cell[i]])
                if len(who):
                    score[who, i:j] = q[s + who] @ e[i:j].T
            most = min(k + 1, len(e))  # one more: the query's own entry may hold no other row
            least = -np.partition(-score, most - 1, axis=1)[:, most - 1]
            for r in range(len(score)):
                floor = least[r] - 1e-9 * (1 + abs(least[r])) if np.isfinite(least[r]) else -np.inf
                near = np.flatnonzero((score[r] >= floor) & (score[r] > -np.inf))
                own = int(names[s + r])
                found = [(-math.fsum(q[s + r] * e[c]), int(v)) for c in near for v in self.ids[c] if v != own]
                yield from ((own, v, -d) for d, v in heapq.nsmallest(k, found))


def _meetings(batches: Iterator[pd.DataFrame], width: int, cells: int, k: int) -> Iterator[pd.DataFrame]:
    """Rows of a block come together, its entries first, then the queries, of which few are held at once."""
    at, entries, block = None, [], None
    for pdf in batches:
        for eb, rows in pdf.groupby("eb", sort=True):
            if eb != at:
                at, entries, block = eb, [], None
            home = rows["home"].to_numpy(bool)
            if home.any():
                entries.append(rows[home])
            asked = rows[~home]
            if len(asked) and entries:
                block = block or Block(entries, width)
                yield pd.DataFrame(block.nearest(asked, cells, k), columns=["query_id", "vec_id", "score"])


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, share: float = SHARE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query its k nearest by inner product, ties to smaller vec_id.

    Both have vec_id and embedding. Vectors that are null, empty, all zero or hold null or non-finite components
    take no part, nor do those of another length than most, nor rows of null vec_id. All rows that bear the
    query's vec_id are its own; repeated rows count once. Without vectors or queries there are no rows.
    Further columns are not read.
    """
    spark = vectors.sparkSession
    v = F.col("embedding").cast("array<double>")
    usable = (
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    clean = vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vec"))
    asked = queries.where(usable).select(F.col("vec_id").cast("long").alias("query_id"), v.alias("vec")).distinct()
    common = clean.groupBy(F.size("vec").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if common is None:
        return empty
    width, n = common["w"], common["count"]
    clean, asked = clean.where(F.size("vec") == width), asked.where(F.size("vec") == width)
    draw = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = clean.where(draw < SAMPLE / n).select("vec").limit(2 * SAMPLE).collect() or clean.select("vec").limit(SAMPLE).collect()
    rows, half = np.array([r["vec"] for r in sample], np.float64), (width + 1) // 2
    books = (codebook(rows[:, :half], CENTROIDS), codebook(rows[:, half:], CENTROIDS) if half < width else np.zeros((1, 0)))
    grid = len(books[0]) * len(books[1])

    def cell_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = _matrix(pdf["vec"], width)
            at = quantise(x[:, :half], books[0]) * len(books[1]) + quantise(x[:, half:], books[1])
            yield pdf.assign(cell=at.astype("int32"))

    # One entry for each distinct vector, with the ids that can be among the nearest: pre-aggregated by salt.
    few = lambda c: F.slice(F.array_sort(F.array_distinct(F.flatten(c))), 1, k + 1)
    salted = clean.groupBy("vec", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt")).agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    entries = salted.select("vec", F.slice("ids", 1, k + 1).alias("ids")).groupBy("vec").agg(few(F.collect_list("ids")).alias("ids"))
    entries = keep(entries.mapInPandas(cell_of, ENTRY))
    held = np.zeros(grid, np.int64)
    for r in entries.groupBy("cell").count().collect():  # at most CENTROIDS squared rows
        held[r["cell"]] = r["count"]
    want = max(k + 1, math.ceil(share * int(held.sum())))  # k others, at the least
    # Cells that lie together share a block; a crowded cell is dealt over several.
    base, spread = (np.cumsum(held) - held) // BLOCK, np.maximum(1, held // BLOCK)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = _matrix(pdf["vec"], width)
            first, second = x[:, :half] @ books[0].T, x[:, half:] @ books[1].T
            marks = np.zeros((len(x), grid), bool)
            for i in range(len(x)):
                marks[i, probes(first[i], second[i], held, want)] = True
            full = [np.flatnonzero(m & (held > 0)) for m in marks]
            goes = [sorted({b for c in cells for b in range(int(base[c]), int(base[c] + spread[c]))}) for cells in full]
            yield pdf.assign(probed=[m.tobytes() for m in np.packbits(marks, axis=1, bitorder="little")], blocks=goes)

    asked = keep(asked.repartition(parts(spark), "query_id").mapInPandas(probe, "query_id long, vec array<double>, probed binary, blocks array<int>"))
    place = F.element_at(F.lit(base.tolist()), F.col("cell") + 1)
    wide = F.element_at(F.lit(spread.tolist()), F.col("cell") + 1)
    e = entries.withColumn("eb", (place + F.pmod(F.xxhash64("vec"), wide)).cast("int")).withColumns({"home": F.lit(True), "query_id": F.lit(0).cast("long")})
    q = asked.withColumn("eb", F.explode("blocks")).drop("blocks").withColumns({"home": F.lit(False), "cell": F.lit(0)})
    names = [c.split()[0] for c in MEET.split(", ")]
    meet = e.unionByName(q, allowMissingColumns=True).select(*names).repartition(max(parts(spark), int((base + spread).max())), "eb")
    meet = meet.sortWithinPartitions("eb", F.desc("home"))
    near = meet.mapInPandas(lambda it: _meetings(it, width, grid, k), "query_id long, vec_id long, score double")
    best = near.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("d"), "vec_id"))), 1, k).alias("best"))
    ranked = best.select("query_id", F.posexplode("best").alias("at", "b"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "b.vec_id", (-F.col("b.d")).alias("score"))
