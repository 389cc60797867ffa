"""Shards by Hilbert-curve order, with DataFrame functions only.

Three metadata dimensions (source, language, size) are quantised to 16 levels each. The 4,096 cells of that
grid lie on a Hilbert curve, rows are sorted by curve index, and the order is cut into runs of equal length,
so that the files of a shard span few sources, languages and sizes, and a reader can skip the rest.

No row order passes through one task: rows are counted by cell and part of a cell, the counts (bounded by the
grid and the number of partitions) give each part its first rank, and rows are ranked within parts. A part is a
range of the text hash; a text that crowds its part is cut out of it and divided by the hash of doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parasol.llm.common import fresh, parts

BITS = 4
LEVELS = 1 << BITS


def hilbert_index(point: tuple[int, ...], bits: int) -> int:
    """Position on the Hilbert curve through a grid of 2^bits levels a dimension: Gray code of the transposed axes."""
    axes = list(point)
    for level in reversed(range(1, bits)):
        bit, low = 1 << level, (1 << level) - 1
        for k in range(len(axes)):
            if axes[k] & bit:
                axes[0] ^= low
            else:
                swap = (axes[0] ^ axes[k]) & low
                axes[0] ^= swap
                axes[k] ^= swap
    for k in range(1, len(axes)):
        axes[k] ^= axes[k - 1]
    flip = 0
    for level in reversed(range(1, bits)):
        if axes[-1] >> level & 1:
            flip ^= (1 << level) - 1
    axes = [a ^ flip for a in axes]
    out = 0
    for level in reversed(range(bits)):
        for a in axes:
            out = out << 1 | a >> level & 1
    return out


def curve() -> list[int]:
    """The curve index of every cell, cells in row-major order."""
    n = LEVELS
    return [hilbert_index((i // n // n, i // n % n, i % n), BITS) for i in range(n**3)]


def shard(docs: DataFrame, shards: int = 16, keep_text: bool = True) -> DataFrame:
    """Puts every row of docs (doc_id, text, source, lang; more columns may be there) into shards by law `rows`.

    Adds size, text_crc32, law, shard, slot, grown_shard and curve_index; shard sizes are at most one row apart
    and slots count from 0 in curve order. Null or missing text, source and lang are quantised as empty. Rows
    that agree in all metadata are ordered by text hash, so copies of a text with the same metadata
    are neighbours; repeated rows get slots of their own. Empty tables give empty tables. Columns of these
    names that docs already has are replaced. The order is by curve index, hash of the text, hash of doc_id and
    doc_id, so it depends on no number of partitions.
    """
    spark = docs.sparkSession
    new = ("size", "text_crc32", "law", "shard", "slot", "grown_shard", "curve_index")
    docs = docs.drop(*new)
    part, order, own, hot, lead, tail, first, total, rank = fresh(docs, "_part", "_order", "_own", "_hot", "_lead", "_tail", "_first", "_total", "_rank")
    name = {c.lower() for c in docs.columns}
    column = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in name else F.lit("")
    text = column("text")
    rows = docs.withColumns(
        {
            "size": F.octet_length(text).cast("long") + 1,
            "text_crc32": F.crc32(text.cast("binary")),
            order: F.xxhash64(text),
            own: F.xxhash64(F.col("doc_id").cast("string")),
        }
    )
    level = lambda c: F.pmod(F.crc32(column(c).cast("binary")), F.lit(LEVELS))
    magnitude = F.least(F.floor(F.log2(F.col("size").cast("double"))), F.lit(LEVELS - 1)).cast("long")
    cell = (level("source") * LEVELS + level("lang")) * LEVELS + magnitude
    (at,) = fresh(rows, "_cell")
    grid = spark.range(1).select(F.posexplode(F.lit(curve())).alias(at, "curve_index"))  # LEVELS cubed rows
    rows = rows.withColumn(at, cell.cast("int")).join(F.broadcast(grid), at).drop(at)
    # Parts of a cell are ranges of the text hash, so that their order is the order of rows.
    n = rows.select(F.count(F.lit(1)).alias("n")).first()["n"]
    each = max(64, n // (16 * parts(spark)))
    slices = 1 << max(0, (-(-n // each) - 1).bit_length())  # a power of two, of which a cell uses as many as it needs
    bits = max(1, slices.bit_length() - 1)
    fine = lambda h: F.shiftrightunsigned(F.col(h).bitwiseXOR(F.lit(-(1 << 63))), 64 - bits)
    width = lambda rows_there: F.greatest(F.lit(1), F.ceil(F.lit(2.0 * slices * each) / rows_there)).cast("long")
    cells = rows.groupBy("curve_index").agg(F.count(F.lit(1)).alias(total))
    rows = rows.join(F.broadcast(cells), "curve_index").withColumn(part, F.floor(fine(order) / width(F.col(total)))).drop(total)
    # Texts with more rows than a part should have: at most n / each of them.
    crowded = rows.groupBy("curve_index", part).agg(F.count(F.lit(1)).alias(total)).where(F.col(total) > 4 * each)
    texts = rows.join(F.broadcast(crowded.drop(total)), ["curve_index", part], "left_semi").groupBy("curve_index", part, order)
    texts = texts.agg(F.count(F.lit(1)).alias(total)).where(F.col(total) > each)
    hots = texts.groupBy("curve_index", part).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("h"), F.col(total).alias("n")))).alias(hot))
    rows = rows.join(F.broadcast(hots), ["curve_index", part], "left")
    before = F.element_at(F.filter(hot, lambda x: x.h <= F.col(order)), -1)  # the crowded text at or before this one
    rows = rows.withColumn(hot, F.when(F.size(F.filter(hot, lambda x: x.h <= F.col(order))) > 0, before))
    rows = rows.withColumn(lead, F.coalesce(F.col(hot).h, F.lit(-(1 << 63))))
    rows = rows.withColumn(tail, F.when(F.col(hot).h == F.col(order), F.floor(fine(own) / width(F.col(hot).n))).otherwise(F.lit(slices)))
    label = ["curve_index", part, lead, tail]
    counts = rows.groupBy(*label).agg(F.count(F.lit(1)).alias(total))
    ahead = Window.orderBy(*label).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*label, F.coalesce(F.sum(total).over(ahead), F.lit(0)).alias(first))
    within = Window.partitionBy(*label).orderBy(order, own, F.col("doc_id").asc_nulls_last())
    if not keep_text:
        rows = rows.drop("text")
    ranked = rows.withColumn(rank, F.row_number().over(within))
    ranked = ranked.join(F.broadcast(starts), label)
    ranked = ranked.withColumn(rank, F.col(rank) + F.col(first) - 1)
    short, longer = n // shards, n % shards
    edge = F.lit(longer * (short + 1))
    at = F.col(rank)
    div = lambda a, b: F.floor(a / F.lit(max(1, b)))  # noqa: E731  exact below 2^53 rows
    placed = F.when(at < edge, div(at, short + 1)).otherwise(div(at - edge, short) + longer)
    begin = F.when(at < edge, F.col("shard") * (short + 1)).otherwise(edge + (F.col("shard") - longer) * short)
    return (
        ranked.withColumn("shard", placed.cast("int"))
        .withColumn("slot", (at - begin).cast("long"))
        .withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})
        .select(*[c for c in docs.columns if c in rows.columns], *new)
    )
