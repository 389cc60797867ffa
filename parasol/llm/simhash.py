"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are 64-bit majorities of shingle hashes. Distinct fingerprints lie in tiles by the population
counts of their four 16-bit quarters: two fingerprints differ in at least as many bits as these counts do, so
tile pairs that differ by more than the radius are skipped and all others are compared whole, by numpy
exclusive-or and bit counts. No pair within the radius is missed and no bucket is capped: a crowded tile is
split into blocks, each of which meets every block of the neighbouring tiles.
A tile returns a spanning forest of its links, never all pairs; components follow by hooking and shortcutting.

Where a similarity is asked for, a pair is compared only if it shares one of KEYS least shingles, each under an order
of its own: tiles are by least shingle and by population count of the whole set of shingles, since sets whose counts
differ too much can't be that similar. Components of what is near by fingerprint say which texts may be near copies:
within each, blocks of its texts meet, and pairs that are near are linked if the Jaccard index of their shingle sets
confirms it.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parasol.llm.common import batch_rows, fresh, keep, parts
from parasol.llm.text import FOLD_CASE

BLOCK = 1024  # fingerprints in a tile block
STRIP = 1024  # compared at once
SIDE = 17  # a quarter has 0 to 16 bits set


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of n words, space-joined; of all words if there are fewer; none for none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(FOLD_CASE).split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    ends = list(itertools.accumulate([len(w) + 1 for w in words]))
    h = xxhash.xxh64_intdigest
    out = [h(line[a : b - 1], 42) for a, b in zip([0, *ends], ends[n - 1 :], strict=False)]
    return np.array(out, np.uint64)


def fingerprint(hashes: np.ndarray, words: int = 1) -> list[int]:
    """A bit is 1 if it is set in over half the hashes; all 0 without hashes. Signed, as Spark holds it.

    Words after the first are fingerprints of the same shingles under further mixings of their hashes.
    """
    if not len(hashes):
        return [0] * words
    out = []
    for k in range(words):
        total = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 1 << 16):
            h = hashes[at : at + (1 << 16)]
            if k:
                h = h * np.uint64(2 * k + 1)
                h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(32)
            bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total += bits.sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<i8")[0]))
    return out


def fingerprints(docs: DataFrame, names: list[str], n: int) -> DataFrame:
    """docs (with text) and a long column for each word of the fingerprint."""
    schema = docs.withColumns({c: F.lit(0).cast("long") for c in names}).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = np.array([fingerprint(shingle_hashes(t, n), len(names)) for t in pdf["text"]], np.int64)
            yield pdf.assign(**dict(zip(names, found.reshape(-1, len(names)).T, strict=True)))

    return docs.mapInPandas(run, schema)


def least_shingles(hashes: np.ndarray) -> list[int]:
    """The least of the hashes under each of KEYS mixings; none of none."""
    out = []
    for k in range(KEYS if len(hashes) else 0):
        h = (hashes ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        out.append(int((h * np.uint64(0xD6E8FEB86659FD93)).min()) - (1 << 63))
    return out


def set_fingerprints(docs: DataFrame, names: list[str], n: int) -> DataFrame:
    """docs (with text), the long column name, a hash of the text's set of shingles, the fingerprint of that set, its
    count and its least shingles as keys."""
    columns = ["name", *names, "count"]
    schema = docs.withColumns({c: F.lit(0).cast("long") for c in columns}).withColumn("keys", F.array(F.lit(0).cast("long"))).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [np.unique(shingle_hashes(t, n)) for t in pdf["text"]]
            found = [[xxhash.xxh64_intdigest(h.tobytes(), 42) - (1 << 63), *fingerprint(h, len(names)), len(h)] for h in sets]
            found = dict(zip(columns, np.array(found, np.int64).reshape(-1, len(columns)).T, strict=True))
            yield pdf.assign(**found, keys=[least_shingles(h) for h in sets])

    return docs.mapInPandas(run, schema)


def neighbours(radius: int, quarters: int) -> list[int]:
    """Steps between tiles that can hold a pair within radius, one of each opposite two, without the zero step."""
    span = range(-radius, radius + 1)
    steps = (d for d in itertools.product(span, repeat=quarters) if sum(map(abs, d)) <= radius and d > (0,) * quarters)
    return [sum(x * SIDE**k for k, x in enumerate(reversed(d))) for d in steps]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) -> (node, root) of their components, one for each node that is not its root."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _compare(batches: Iterator[pa.RecordBatch], width: int, radius: int, wide: int) -> Iterator[pa.RecordBatch]:
    """Rows of a tile block come together, its own fingerprints first, then those that visit it.

    A fingerprint is `width` words: its name, then its own words (one word is its own name).
    """
    first = min(1, width - 1)
    tile, own, guests, held = None, np.zeros((0, width), np.uint64), [], 0
    found: list[tuple[np.ndarray, np.ndarray]] = []  # links of the block at hand, kept as a forest

    def settled() -> Iterator[pa.RecordBatch]:
        if found:
            a, b = forest(*map(np.concatenate, zip(*found, strict=True)))
            found.clear()
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def links(block: np.ndarray, others: np.ndarray, same: bool) -> None:
        for i in range(0, len(block), STRIP):
            left = block[i : i + STRIP]
            for j in range(i if same else 0, len(others), STRIP):
                right = others[j : j + STRIP]
                near = np.bitwise_count(left[:, None, first] ^ right[None, :, first]) <= radius
                if same and i == j:
                    near &= ~np.tri(len(left), dtype=bool)
                x, y = np.nonzero(near)
                if width > 1 and len(x):
                    whole = np.bitwise_count(left[x, 1:] ^ right[y, 1:]).sum(axis=1, dtype=np.int64) <= wide
                    x, y = x[whole], y[whole]
                if len(x):
                    found.append(forest(left[x, 0].view(np.int64), right[y, 0].view(np.int64)))
                if sum(len(a) for a, _ in found) > 1 << 18:
                    found[:] = [forest(*map(np.concatenate, zip(*found, strict=True)))]

    for batch in batches:
        place, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        home = batch.column(2).to_numpy(zero_copy_only=False)
        ends = batch.column(3).offsets.to_numpy()
        flat = batch.column(3).values.to_numpy().view(np.uint64)
        new = (place[1:] != place[:-1]) | (part[1:] != part[:-1]) | (home[1:] != home[:-1])
        cut = np.flatnonzero(np.r_[True, new])
        for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(place)], strict=True):
            block = flat[ends[i] : ends[j]].reshape(-1, width)
            if (place[i], part[i]) != tile:
                if guests:
                    links(own, np.concatenate(guests), False)
                yield from settled()
                tile, own, guests, held = (place[i], part[i]), np.zeros((0, width), np.uint64), [], 0
            if home[i]:
                links(block, block, True)
                links(own, block, False)
                own = np.concatenate([own, block])
            else:
                guests.append(block.copy())
                held += len(block)
                if held >= 1 << 16:
                    links(own, np.concatenate(guests), False)
                    guests, held = [], 0
    if guests:
        links(own, np.concatenate(guests), False)
    yield from settled()


def near_links(fps: DataFrame, radius: int) -> DataFrame:
    """Distinct fingerprints (long w0) -> links (a, b) between them, enough to join all that differ in at most radius bits."""
    count = lambda k: F.bit_count(F.shiftrightunsigned("w0", 16 * k).bitwiseAND(0xFFFF))
    key = F.lit(0)
    for k in range(4):
        key = key * SIDE + count(k)
    rows = fps.select(key.cast("long").alias("tile"), F.array("w0").alias("body"))
    # At most 17^4 tiles, whatever the input: their block counts may be broadcast.
    counts = F.broadcast(keep(rows.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks"))))
    tiles = _tiles(rows.join(counts, "tile"), ["tile"])
    # A step that leaves the grid may land on a tile that is farther off: it costs a comparison, no more.
    step = F.explode(F.array(*map(F.lit, neighbours(radius, 4)))).alias("step")
    guests = tiles.select("tile", "fps", step).select((F.col("tile") + F.col("step")).alias("tile"), "fps").join(counts, "tile")
    return _meet(tiles, guests, 1, radius, 0)


def _tiles(rows: DataFrame, tile: list[str]) -> DataFrame:
    """Rows of a tile (body, and how many blocks the tile has) -> its blocks."""
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("body"), F.col("blocks")))
    return keep(blocks.groupBy(*tile, "block", "blocks").agg(F.flatten(F.collect_list("body")).alias("fps")))


def _meet(tiles: DataFrame, guests: DataFrame, width: int, radius: int, wide: int) -> DataFrame:
    """Blocks of tiles meet those before them in the tile, and the guests (tile, blocks, fps), which come to every block of it."""
    below = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias("block")
    guests = guests.select("tile", below("blocks"), "fps")
    guests = guests.unionByName(tiles.where(F.col("block") > 0).select("tile", below("block"), "fps"))
    meet = tiles.withColumn("home", F.lit(True)).unionByName(guests.withColumn("home", F.lit(False)), allowMissingColumns=True)
    meet = meet.select("tile", "block", "home", "fps").repartition(parts(tiles.sparkSession), "tile", "block")
    meet = meet.sortWithinPartitions("tile", "block", F.desc("home"))
    return meet.mapInArrow(lambda it: _compare(it, width, radius, wide), "a long, b long")


def shared_links(fps: DataFrame, radius: int, wide: int, similarity: float) -> DataFrame:
    """Sets of shingles -> links (a, b) of their names, enough of them to join all that share a key, are of counts that
    the similarity allows, and differ in at most radius bits of w0 and `wide` bits of all words.

    fps has the long columns name, count, w0, w1, ... and keys. Classes of counts are so wide that only neighbours can
    hold a pair.
    """
    words = [c for c in fps.columns if c.startswith("w")]
    level = F.floor(F.log("count") / (math.log(1 / similarity) * (1 + 1e-9))).alias("level")
    rows = fps.where("count > 0").select("name", level, F.array("name", *words).alias("body"), F.posexplode("keys").alias("at", "key"))
    rows = rows.select(F.xxhash64("at", "key").alias("key"), "level", "body")
    # Most keys are of one text and meet nothing.
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    rows = keep(rows.join(shared, "key", "left_semi"))
    counts = rows.groupBy("key", "level").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks"))
    tiles = _tiles(rows.join(counts, ["key", "level"]).withColumn("tile", F.xxhash64("key", "level")), ["key", "level", "tile"])
    guests = tiles.select("key", (F.col("level") + 1).alias("level"), "fps").join(counts, ["key", "level"])
    guests = guests.withColumn("tile", F.xxhash64("key", "level"))
    return _meet(tiles, guests, 1 + len(words), radius, wide)


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) -> (node, root): the smallest node of each component, for every node that has a link.

    Each round hooks the parents of both ends to the smaller grandparent and shortcuts; rounds grow with the
    logarithm of the longest chain. Every round is written to the shared folder.
    """
    both = keep(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    f = keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")))
    total = lambda d: d.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
    before = total(f)
    while before is not None:
        parent = f.select(F.col("node").alias("root"), F.col("root").alias("grand"))
        g = f.join(parent, "root").select("node", "root", "grand")
        low = both.join(g.select(F.col("node").alias("b"), "grand"), "b").groupBy(F.col("a").alias("node")).agg(F.min("grand").alias("low"))
        g = g.join(low, "node")
        least = F.least("grand", "low")
        moves = F.array(F.struct(F.col("node"), least.alias("root")), F.struct(F.col("root").alias("node"), least.alias("root")))
        f = keep(g.select(F.explode(moves).alias("m")).select("m.*").groupBy("node").agg(F.min("root").alias("root")))
        after = total(f)
        if after == before:
            break
        before = after
    return f


def with_components(docs: DataFrame, n: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, row (64-bit hash of doc_id and text), w0 and component_id, the smallest doc_id reachable through
    links, itself included, for every row of docs.

    Null, empty and blank texts have fingerprint 0, which links like any other. Repeated rows and rows that share
    a doc_id keep rows of their own. A null doc_id is the smallest only where all are null. An empty table gives
    an empty one. Further columns are not read.
    """
    rows = keep(fingerprints(_rows(docs), ["w0"], n).drop("text"))
    fps = keep(rows.groupBy("w0").agg(F.min("doc_id").alias("least")).withColumn("name", F.col("w0")))
    return _named(rows, fps, components(near_links(fps, radius)), ["w0"])


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("row"))


def _named(rows: DataFrame, fps: DataFrame, roots: DataFrame, key: list[str]) -> DataFrame:
    """rows with the component_id of their fingerprint (fps: key, name, least) under roots (node, root)."""
    rooted = fps.join(roots.select(F.col("node").alias("name"), "root"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(rooted.join(smallest, "root").select(*key, "component_id"), key)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id."""
    fingerprint = F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint")
    return with_components(docs).select("doc_id", fingerprint, "component_id")


def _confirm(batches: Iterator[pa.RecordBatch], radius: int, wide: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows of a meeting of two blocks come together, those of its own block first: links of similar sets, as a forest."""
    meeting, own, found = None, [], []
    bits_of = np.zeros((0, 0), np.uint64)  # of own
    lead: dict[int, int] = {}  # of the sets at hand, by links confirmed

    def root(x: int) -> int:
        while lead.setdefault(x, x) != x:
            lead[x] = lead[lead[x]]
            x = lead[x]
        return x

    def links(name: int, words: np.ndarray, shingles: frozenset) -> None:
        nonlocal bits_of
        if not own:
            return
        if len(bits_of) < len(own):  # doubled when full
            bits_of = np.array([own[k % len(own)][1] for k in range(2 * len(own))])
        bits = np.bitwise_count(bits_of[: len(own)] ^ words)
        for k in np.flatnonzero((bits[:, 0] <= radius) & (bits.sum(axis=1, dtype=np.int64) <= wide)):
            other, _, theirs = own[k]
            x, y = root(name), root(other)
            if x == y or min(len(shingles), len(theirs)) < similarity * max(len(shingles), len(theirs)):
                continue
            both = len(shingles & theirs)
            if both >= similarity * (len(shingles) + len(theirs) - both):
                lead[max(x, y)] = min(x, y)
                found.append((name, other))

    for batch in batches:
        for at, home, name, words, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != meeting:
                meeting, own, lead, bits_of = at, [], {}, bits_of[:0]
            words, shingles = np.array(words, np.int64).view(np.uint64), frozenset(np.frombuffer(shingles, np.uint64).tolist())
            links(name, words, shingles)
            if home:
                if len(own) < len(bits_of):
                    bits_of[len(own)] = words
                own.append((name, words, shingles))
        if found:
            a, b = zip(*found, strict=True)
            found.clear()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def confirmed_links(texts: DataFrame, n: int, radius: int, wide: int, similarity: float) -> DataFrame:
    """texts (name, words, text, root: what may be linked has one root) -> links (a, b) of names, enough of them to
    join all whose shingle sets have at least this Jaccard index and that are near by fingerprint.

    Every block of a root meets every other; a block has about MEMBERS texts or MEMBER_BYTES of them.
    """
    spark = texts.sparkSession

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(shingle_hashes(t, n)).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("root", "name", "words")), pa.array(found, pa.binary())], ["root", "name", "words", "shingles"])

    rows = keep(texts.mapInArrow(sets, "root long, name long, words array<long>, shingles binary"))
    size = F.greatest(F.count(F.lit(1)) / MEMBERS, F.sum(F.length("shingles")) / MEMBER_BYTES)
    rows = rows.join(rows.groupBy("root").agg(F.ceil(size).cast("long").alias("blocks")), "root")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("name"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    met = rows.select("root", "own", other, "name", "words", "shingles")
    at = F.struct("root", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    met = met.select(at.alias("at"), (F.col("own") <= F.col("other")).alias("home"), "name", "words", "shingles")
    met = met.repartition(parts(spark), "at").sortWithinPartitions("at", F.desc("home"))
    return met.mapInArrow(lambda it: _confirm(it, radius, wide, similarity), "a long, b long")


MEMBERS, MEMBER_BYTES = 512, 8 << 20  # texts in a block that is confirmed, bytes of their shingles
SIMILARITY = 0.8
KEYS = 8  # a pair at 0.8 shares none of so many least shingles with probability 0.2^8 = 2.6e-6
#: Bits of 64, and of 256, in which candidates differ at most. Sets of equal size at 0.8 differ in a bit with probability
#: 0.1515, so such a pair is beyond the first with probability 3.5e-5, beyond the second with 8e-7; less for sets of unlike size. The
#: smallest that can be at 0.8 (four shingles within five: 0.1875) are missed with 1.7e-3.
NEAR_BITS, NEAR_WIDE_BITS = 22, 68


def near_copies(docs: DataFrame, n: int = 5, radius: int = NEAR_BITS, wide: int = NEAR_WIDE_BITS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, row, count (distinct shingles) and component_id as with_components, by links between texts whose n-word
    shingle sets have at least this Jaccard index. Blank texts are linked with each other alone."""
    names = [f"w{k}" for k in range(4)]
    rows = keep(set_fingerprints(_rows(docs), names, n).drop("text"))
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))  # the row that stands for the set
    fps = rows.groupBy("name", *names, "count").agg(least.alias("first"), F.first("keys").alias("keys"))
    fps = keep(fps.select("name", *names, "count", "keys", F.col("first.doc_id").alias("least"), F.col("first.row").alias("row")))
    maybe = components(shared_links(fps.select("name", "count", "keys", *names), radius, wide, similarity))
    named = fps.select(F.col("name").alias("node"), F.array(*names).alias("words"), F.col("least").alias("doc_id"), "row").join(maybe, "node")
    # A row's key is its id and a hash, so only rows that share an id could be taken for one another.
    given = _rows(docs).select(F.col("doc_id").alias("id"), F.col("row").alias("own"), "text")
    one = given.join(named, (F.col("own") == F.col("row")) & F.col("id").eqNullSafe(F.col("doc_id"))).dropDuplicates(["node"])
    with batch_rows(docs.sparkSession, 64):  # a text of 20,000 words has shingles of 160 kB
        links = keep(confirmed_links(one.select(F.col("node").alias("name"), "words", "text", "root"), n, radius, wide, similarity))
    return _named(rows.drop("keys", *names), fps.select("name", "least"), components(links), ["name"]).drop("name")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one row left of each group of near copies, the one of smallest doc_id; all columns kept.

    Shingles of five words; near are texts whose sets of them have a Jaccard index of 0.8 or more. Rows without
    words are no copies of anything and stay. Of repeated rows one stays.
    """
    found = near_copies(docs)
    row, id_ = fresh(docs, "_row", "_id")
    lead = F.when(F.col("doc_id").eqNullSafe(F.col("component_id")), F.col("row"))
    leads = found.where("count > 0").groupBy("component_id").agg(F.min(lead).alias(row)).withColumnRenamed("component_id", id_)
    blank = found.where("count = 0").select(F.col("doc_id").alias(id_), F.col("row").alias(row)).distinct()
    stay = leads.select(id_, row).unionByName(blank)
    keyed = docs.withColumn(row, F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    kept = keyed.join(stay.withColumnRenamed(row, row + "_"), (F.col(row) == F.col(row + "_")) & F.col("doc_id").eqNullSafe(F.col(id_)), "left_semi")
    return kept.dropDuplicates(["doc_id", row]).select(*docs.columns)
