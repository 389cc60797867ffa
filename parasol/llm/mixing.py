"""Mixing sources to target weights by pivotal dependent rounding.

Every document has a fractional number of copies, its source's target over its source's size. The whole part
is taken; the fraction is rounded dependently: a document is paired with another, or with all smaller ones of
its bucket taken as one, and mass moves at random between them, in words, until one is integral. Expectations
and the words of the pair are kept, so a source misses its target by less than one document. Each source is dealt
into salted buckets, each bucket leaves at most one unfinished document, and these meet again in a reduction
tree, level by level, until one is left per source, which a last draw settles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parasol.llm.common import SPACE_WORD, fresh, keep, parts

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BUCKET = 256
FAN_IN = 256
TWINS = 4096  # equal rows written out by one task
ROUNDED = "doc_id long, source string, size long, row_key long, n long, source_size long, target double, copies long, p double, bucket long"


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def _draw(a: int, b: int, salt: int) -> float:
    """A uniform number that depends on the two rows alone (splitmix64 finaliser)."""
    m = (1 << 64) - 1
    x = (a * 0x9E3779B97F4A7C15 ^ b * 0xC2B2AE3D27D4EB4F ^ salt * 0x165667B19E3779F9) & m
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & m
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & m
    return ((x ^ x >> 31) >> 11) / (1 << 53)


def pivot(rows: list[tuple[int, int, float]], seed: int) -> tuple[dict[int, int], tuple[int, float] | None]:
    """Rounds rows of (key, size, p), 0 < p < 1: index -> 0 or 1, and the index and p of the one left over.

    Largest first, each document is paired with all smaller ones taken as one: it becomes integral and the
    others give or take its words in proportion to their room, which keeps every expectation and the words of
    all, and leaves over a small document rather than a large one. Where the others have too little room, and
    at the end, documents meet in plain pairs.
    """
    order = sorted(range(len(rows)), key=lambda k: (-rows[k][1], rows[k][0]))
    w = np.array([rows[k][1] for k in order], dtype=np.float64)
    p = np.array([rows[k][2] for k in order], dtype=np.float64)
    done: dict[int, int] = {}
    rest: list[int] = []
    for i, k in enumerate(order):
        q, v = float(p[i]), float(w[i])
        if not 1e-12 < q < 1 - 1e-12:
            done[k] = int(q > 0.5)
            continue
        room = np.minimum(p[i + 1 :], 1 - p[i + 1 :])
        words = float(room @ w[i + 1 :])
        if max(q, 1 - q) * v > words:
            rest.append(i)
            continue
        up = _draw(rows[k][0], len(rows) - i, seed) < q
        p[i + 1 :] += room * ((q if not up else q - 1) * v / words)
        done[k] = int(up)
    left: tuple[int, float] | None = None
    for i in rest:
        k, q = order[i], float(p[i])
        if not 1e-12 < q < 1 - 1e-12:
            done[k] = int(q > 0.5)
        elif left is None:
            left = (k, q)
        else:
            left = _pair(rows, left, (k, q), done, seed)
    return done, left


def _pair(rows: list[tuple[int, int, float]], a: tuple[int, float], b: tuple[int, float], done: dict[int, int], seed: int) -> tuple[int, float] | None:
    """Moves words between two documents until one is integral; returns the other."""
    (i, q), (j, p) = a, b
    v, w = rows[i][1], rows[j][1]
    up = min((1 - q) * v, p * w)  # words that can move from j to i
    down = min(q * v, (1 - p) * w)  # and from i to j
    moved = up if _draw(rows[i][0], rows[j][0], seed) * (up + down) < down else -down
    if moved == (1 - q) * v if moved > 0 else -moved == q * v:
        done[i] = int(moved > 0)
        left = (j, p - moved / w)
    else:
        done[j] = int(moved < 0)
        left = (i, q + moved / v)
    if 1e-12 < left[1] < 1 - 1e-12:
        return left
    done[left[0]] = int(left[1] > 0.5)  # both at once
    return None


def _settle(batches: Iterator[pd.DataFrame], last: bool, seed: int) -> Iterator[pd.DataFrame]:
    """Rows come sorted by source and bucket. A bucket (about BUCKET or FAN_IN rows) is settled when all of it is there,
    so that where batches end does not matter."""
    held = None  # the bucket at hand
    for pdf in batches:
        if pdf.empty:
            continue
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        source = pdf["source"].where(pdf["source"].notna(), None)
        key = pd.factorize(pd.MultiIndex.from_arrays([source.isna(), source.fillna(""), pdf["bucket"]]))[0]
        whole = key != key[-1]
        held = pdf[~whole]
        if whole.any():
            yield _settled(pdf[whole], key[whole], last, seed)
    if held is not None:
        yield _settled(held, np.zeros(len(held), np.int64), last, seed)


def _settled(pdf: pd.DataFrame, key: np.ndarray, last: bool, seed: int) -> pd.DataFrame:
    pdf = pdf.reset_index(drop=True)
    copies, p = pdf["copies"].to_numpy().copy(), pdf["p"].to_numpy().copy()
    sizes, ids = pdf["size"].to_numpy(), pdf["row_key"].to_numpy()
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        rows = [(int(ids[i]) & (1 << 64) - 1, int(sizes[i]), float(p[i])) for i in range(begin, end)]
        done, left = pivot(rows, seed)
        for i, up in done.items():
            copies[begin + i] += up
            p[begin + i] = 0.0
        if left:
            p[begin + left[0]] = left[1]
    pdf["copies"], pdf["p"] = copies, p
    return _closed(pdf, last, seed)


def _closed(pdf: pd.DataFrame, last: bool, seed: int) -> pd.DataFrame:
    if last and (pdf["p"] > 0).any():
        pdf = pdf.copy()
        up = [int(p > 0 and _draw(int(k) & (1 << 64) - 1, 1, seed) < p) for k, p in zip(pdf["row_key"], pdf["p"], strict=True)]
        pdf["copies"] = pdf["copies"] + up
        pdf["p"] = 0.0
    return pdf


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size -> with target. Sources by code point, null last, weigh 5, 2, 1, repeating.

    They share 1.5 times all words; a target stops at twice its source's size, and what is over goes to the
    rest by weight until none is above. Every round is one aggregate over the table of sources, and a round
    that caps none is the last. Without words all targets are 0.
    """
    # A global order without a single task: sorted ranges, their counts, and the rank within each.
    order = sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id())
    order = keep(order)
    shift = 1 << 33
    ahead = {}
    n = 0
    for r in order.groupBy(F.shiftright("at", 33).alias("k")).count().orderBy("k").collect():  # a row for each task
        ahead[r["k"]] = n
        n += r["count"]
    if not ahead:
        return order.select("source", "source_size", F.lit(0.0).alias("target"))
    base = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in ahead.items() for x in kv]), F.shiftright("at", 33))
    rank = base + F.col("at") % shift
    weight = F.element_at(F.lit(list(WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int"))
    rows = order.withColumn("weight", weight.cast("double")).withColumn("cap", MOST * F.col("source_size"))
    total = SHARE * float(rows.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while total:
        free = F.col("cap") > level * F.col("weight")
        r = rows.agg(
            F.coalesce(F.sum(F.when(~free, F.col("cap"))), F.lit(0.0)).alias("fixed"),
            F.sum(F.when(free, F.col("weight"))).alias("weight"),
        ).first()
        if not r["weight"]:
            break
        new = (total - r["fixed"]) / r["weight"]
        if new <= level * (1 + 1e-15):
            break
        level = new
    return rows.select("source", "source_size", F.least(F.col("cap"), level * F.col("weight")).alias("target"))


def rounded_copies(docs: DataFrame, row_key: Column, seed: int = 17) -> DataFrame:
    """doc_id, source, size, row_key, n, source_size, target, copies for every distinct row of docs.

    row_key must be the same in every run and names the row in random draws. The n rows that agree in key, doc_id,
    source and size are one, with the copies of all of them (0 to 2n): paired among themselves, all but one of equal
    rows become integral, whatever the draws, so their whole part is taken and the rest is the fraction of one row.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"),
        row_key.alias("row_key"),
    )
    rows = keep(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")))
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    sizes = keep(sizes)
    targets = source_targets(sizes.select("source", "source_size")).join(
        sizes.select(F.col("source").alias("s"), "n_rows"), F.col("source").eqNullSafe(F.col("s"))
    ).drop("s")
    few = sizes.count() <= 100_000  # a checked size: beyond it the join is shuffled and skewed keys are split by AQE
    t = targets.select(F.col("source").alias("s"), "source_size", "target", "n_rows")
    t = F.broadcast(t) if few else t
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.join(t, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumn("share", share * F.col("n"))
    whole = F.floor(F.col("share") + 1e-12)
    part = F.when(F.col("size") > 0, F.greatest(F.lit(0.0), F.col("share") - whole)).otherwise(0.0)
    n_buckets = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / BUCKET))
    rows = rows.select(
        "doc_id", "source", "size", "row_key", "n", "source_size", "target",
        whole.cast("long").alias("copies"),
        F.when(part > 1e-12, part).otherwise(0.0).alias("p"),
        F.pmod(F.xxhash64("row_key", "doc_id", "size"), n_buckets).alias("bucket"),
    )
    top = int(sizes.agg(F.max("n_rows")).first()[0] or 0)
    depth = -(-top // BUCKET)  # buckets of the largest source
    done: list[DataFrame] = [rows.where("p = 0")]
    rest = rows.where("p > 0")
    while True:
        last = depth <= 1
        level = rest.repartition(parts(spark), "source", "bucket").sortWithinPartitions("source", "bucket", "row_key", "doc_id", "size")
        step = keep(level.mapInPandas(lambda it, last=last: _settle(it, last, seed), ROUNDED))
        if last:
            done.append(step)
            break
        done.append(step.where("p = 0"))
        rest = step.where("p > 0").withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
        depth = -(-depth // FAN_IN)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("p", "bucket")


def _shared_out(total: Column, n: Column, at: Column) -> Column:
    """Copies of the row `at` (from 0) of n equal rows that have so many in all."""
    return F.floor(total / n) + F.when(at < total % n, 1).otherwise(0)


def mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (size times copies), copies, source.

    Null texts and texts without words have size 0 and take 0; null sources form one source, last in order.
    Copies of repeated rows are shared out evenly over them. Ties, partitions and batches do not matter: draws depend
    on row contents. An empty table gives an empty table. Other columns are not read.
    """
    out = rounded_copies(docs, _key(), seed)
    # Equal rows are written out in runs, so that no task has to write all rows of one kind.
    runs = out.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / TWINS))))
    runs = runs.repartition(parts(docs.sparkSession), "row_key", "run")
    first = F.col("run") * TWINS
    rows = runs.withColumn("at", F.explode(F.sequence(first, F.least(first + TWINS, F.col("n")) - 1)))
    rows = rows.withColumn("copies", _shared_out(F.col("copies"), F.col("n"), F.col("at")).cast("int"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")


def _key() -> Column:
    return F.xxhash64(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("source"), F.lit("")))


def mixed_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """docs with every row repeated as often as the mix takes it (0 to 2 times); all columns kept.

    Rows without words carry no weight and stay once. Decisions are joined back by row key and doc_id; the copies of
    rows that agree in both, whole copies of one another, are spread over them evenly.
    """
    k, n, t, at = fresh(docs, "_key", "_rows", "_times", "_at")
    named = lambda key: F.concat_ws("/", key, F.col("doc_id").cast("long"))
    out = rounded_copies(docs, _key(), seed)
    copies = F.when(F.col("size") > 0, F.col("copies")).otherwise(F.col("n"))
    decided = out.groupBy(named(F.col("row_key")).alias(k)).agg(F.sum("n").alias(n), F.sum(copies).alias(t))
    twins = Window.partitionBy(k).orderBy(F.xxhash64(*docs.columns))
    keyed = docs.withColumn(k, named(_key())).withColumn(at, F.row_number().over(twins) - 1).join(decided, k)
    times = keyed.withColumn(t, _shared_out(F.col(t), F.col(n), F.col(at)).cast("int")).where(F.col(t) > 0)
    return times.withColumn(t, F.explode(F.sequence(F.lit(1), F.col(t)))).select(*docs.columns)
