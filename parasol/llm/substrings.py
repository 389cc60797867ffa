"""Removal of repeated 100-byte strings by column-wise multi-document suffix sorting.

A collection of short documents is sorted as one: every round inserts one symbol of each, from the right, into
the sorted list of all suffixes so far. A new suffix is its symbol and the place of the suffix it prolongs, so
one merge by (symbol, place) finds where it goes, and its common prefix with its new neighbour is one more than
that of the two they prolong. The list (the symbols in it are the transform of the collection) and the common
prefixes are written to and read from a sequential file each round. Suffixes with a common prefix of 100 bytes
or more lie together in the end; all but the first occurrence in each such run are repeats.

Two things make it fit whole corpora. Texts are cut into pieces at anchors, the least 16-byte hash of each
100-byte window, so equal windows are in pieces of one anchor, the pieces of an anchor meet in one bucket, and
no piece, hence no number of rounds, grows with the length of a text. And a symbol is a block of twenty bytes, a
piece entering once for each of the twenty ways to cut it, so that 184 bytes take 9 rounds, not 184.
Pieces whose anchor occurs once hold no repeat and are not sent on. Byte-equal pieces are taken as one, and an anchor with one distinct piece is left out of the sorting: nothing
but the copies of that piece, all but the first of which go whole, can repeat in it.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parasol.llm.common import parts

LENGTH = 100
GRAM = 16
STEP = 20  # bytes of a symbol
DEEP = LENGTH // STEP
SPAN = LENGTH - GRAM + 1  # grams in a window
SEGMENT = 4 << 20  # bytes whose pieces are cut at once
BUCKET = 6 << 20  # bytes of text for each bucket of pieces
SLOTS, RANGES = 1 << 28, 64  # of the table of anchors that occur more than once, one bit each
SORTED = 1 << 20  # bytes of pieces sorted at once
GROUP = 16 << 20  # bytes of text for each group of documents that meets its spans
MIX = 1540483477
ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))


# ---- anchors and pieces


def anchors(b: np.ndarray) -> np.ndarray:
    """For each window start, 40 hash bits of its least gram and 24 of that gram's place (leftmost of equals)."""
    x = b.astype(np.uint64)
    x = x[:-1] | x[1:] << np.uint64(8)
    x = x[:-2] | x[2:] << np.uint64(16)
    x = x[:-4] | x[4:] << np.uint64(32)
    h = x[:-8] * ODD[0]
    h ^= h >> np.uint64(29)
    h += x[8:]
    h *= ODD[1]
    h ^= h >> np.uint64(32)
    h *= ODD[2]
    h &= np.uint64(0xFFFFFFFFFF000000)
    h |= np.arange(len(h), dtype=np.uint64)
    width = 1
    while width * 2 <= SPAN:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.minimum(h[: len(h) - (SPAN - width)], h[SPAN - width :]) if width < SPAN else h


def pieces(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts laid end to end -> key, text number, start and number of windows of every piece."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none.astype(np.uint64), none, none, none
    a = anchors(np.frombuffer(data, np.uint8))
    starts = np.r_[0, ends[:-1]]
    of = np.repeat(np.arange(len(ends)), ends - starts)[: len(a)]
    fits = np.arange(len(a)) + LENGTH <= ends[of]
    at = np.flatnonzero(fits)
    if not len(at):
        return none.astype(np.uint64), none, none, none
    a, of = a[at], of[at]
    cut = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1)])
    return a[cut] >> np.uint64(24), of[cut], at[cut], np.diff(np.r_[cut, len(at)])


def _pack(*arrays: np.ndarray, tail: bytes = b"") -> bytes:
    """Arrays and bytes as one compressed string."""
    head = np.array([len(arrays), *(x.itemsize for x in arrays), *(len(x) for x in arrays)], np.int64)
    return zstandard.ZstdCompressor(level=3).compress(b"".join([head.tobytes(), *(np.ascontiguousarray(x).tobytes() for x in arrays), tail]))


def _unpack(blob: bytes, *kinds: str) -> list:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = len(kinds), 8 * (1 + 2 * len(kinds)), []
    head = np.frombuffer(raw, np.int64, 1 + 2 * n)
    for k, kind in enumerate(kinds):
        out.append(np.frombuffer(raw, kind, head[1 + n + k], at))
        at += int(head[1 + k] * head[1 + n + k])
    return [*out, raw[at:]]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, bytes, np.ndarray]]:
    """doc, h, text -> parts of documents (doc, h, offset of the first byte), their bytes end to end, and their ends.

    A long text goes over several segments; each window is whole in one.
    """
    docs: list[tuple[int, int, int]] = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for d, h, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            t = t or b""
            for a in range(0, max(1, len(t) - LENGTH + 1), SEGMENT):
                part = t[a : a + SEGMENT + LENGTH - 1]
                if texts and size + len(part) > SEGMENT + LENGTH:
                    yield np.array(docs, np.int64), b"".join(texts), np.cumsum([len(x) for x in texts])
                    docs, texts, size = [], [], 0
                docs.append((d, h, a))
                texts.append(part)
                size += len(part)
    if texts:
        yield np.array(docs, np.int64), b"".join(texts), np.cumsum([len(x) for x in texts])


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, h, text -> slots of anchors by range of slots, twice if they occur more than once."""
    for _, data, ends in _segments(batches):
        slot, n = np.unique(pieces(data, ends)[0] % np.uint64(SLOTS), return_counts=True)
        slot = np.repeat(slot.astype(np.int64), np.minimum(n, 2))
        width = SLOTS // RANGES
        cuts = np.searchsorted(slot, np.arange(RANGES + 1) * width)
        rows = [(r, _pack((slot[i:j] - r * width).astype(np.uint32))) for r, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
        if rows:
            yield _batch(rows, 0)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slots by range -> one bit for each slot that comes more than once."""

    def bits(at: int, count: np.ndarray) -> pa.RecordBatch:
        return _batch([(at, zstandard.ZstdCompressor().compress(np.packbits(count > 1, bitorder="little").tobytes()))], 0)

    at, count = None, np.zeros(0, np.uint8)
    for batch in batches:
        for r, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if r != at:
                if at is not None:
                    yield bits(at, count)
                at, count = r, np.zeros(SLOTS // RANGES, np.uint8)
            slot = _unpack(blob, "u4")[0]
            first = np.r_[True, slot[1:] != slot[:-1]]
            count[slot[first]] = np.minimum(count[slot[first]] + 1, 2)
            count[slot[~first]] = 2
    if at is not None:
        yield bits(at, count)


def _cut(batches: Iterator[pa.RecordBatch], buckets: int, groups: int, marks: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
    """doc, h, text -> blobs of pieces by bucket, blobs of spans by group.

    Of byte-equal pieces in a segment only the first goes on: all windows of the others are repeats.
    """
    table = np.zeros(SLOTS // 8, np.uint8)
    for r, blob in marks.items():
        width = SLOTS // RANGES // 8
        table[r * width : (r + 1) * width] = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    for who, data, ends in _segments(batches):
        key, of, start, n = pieces(data, ends)
        slot = key % np.uint64(SLOTS)
        often = table[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1 > 0
        key, of, start, n = key[often], of[often], start[often], n[often]
        pos = start - np.r_[0, ends[:-1]][of] + who[of, 2]
        order = np.lexsort((pos, who[of, 1], who[of, 0]))
        key, of, start, n, pos = (x[order] for x in (key, of, start, n, pos))
        seen: dict[bytes, int] = {}
        body = [data[s : s + m] for s, m in zip(start.tolist(), (n + LENGTH - 1).tolist(), strict=True)]
        first = np.fromiter((seen.setdefault(p, k) for k, p in enumerate(body)), np.int64, len(body))
        fresh = first == np.arange(len(body))
        at = (key % np.uint64(buckets)).astype(np.int64)
        keep = np.flatnonzero(fresh)
        keep = keep[np.argsort(at[keep], kind="stable")]
        cuts = np.flatnonzero(np.r_[True, at[keep][1:] != at[keep][:-1], True]) if len(keep) else []
        rows: list[tuple[int, bytes]] = []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            k = keep[i:j]
            blob = _pack(key[k], who[of[k], 0], who[of[k], 1], pos[k], n[k].astype(np.uint8), tail=b"".join([body[x] for x in k.tolist()]))
            rows.append((int(at[k[0]]), blob))
        if rows:
            yield _batch(rows, 0)
        twin = (who[of, 0] == who[of[first], 0]) & (who[of, 1] == who[of[first], 1]) & (pos == pos[first])
        old = np.flatnonzero(~fresh & ~twin)  # a document given twice is one
        if len(old):
            yield from _spans(who[of[old], 0], who[of[old], 1], pos[old], pos[old] + n[old] + LENGTH - 1, groups)


def _batch(rows: list[tuple[int, bytes]], kind: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([kind] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["at", "kind", "blob"])


def _spans(doc: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray, groups: int) -> Iterator[pa.RecordBatch]:
    at = group_of(doc, groups)
    order = np.argsort(at, kind="stable")
    cuts = np.flatnonzero(np.r_[True, at[order][1:] != at[order][:-1], True])
    rows = []
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        k = order[i:j]
        rows.append((int(at[k[0]]), _pack(doc[k], h[k], start[k], end[k])))
    if rows:
        yield _batch(rows, 1)


def group_of(doc: np.ndarray, groups: int) -> np.ndarray:
    x = ((doc & 0xFFFFFFFF) ^ (doc >> 32 & 0xFFFFFFFF)) * MIX
    return (x >> 15) % groups


# ---- column-wise suffix sorting


class Columns:
    """The sorted list of suffixes: symbol, place of the prolonged suffix, common prefix, name."""

    KINDS = (("symbol", np.int32), ("tail", np.int32), ("common", np.uint8), ("name", np.int64))

    def __init__(self) -> None:
        self.file, self.n = tempfile.TemporaryFile(), 0

    def read(self) -> list[np.ndarray]:
        self.file.seek(0)
        out = [np.frombuffer(self.file.read(self.n * np.dtype(k).itemsize), k) for _, k in self.KINDS]
        return [x if x.dtype == np.uint8 else x.astype(np.int64) for x in out]

    def write(self, arrays: list[np.ndarray]) -> None:
        self.file.seek(0)
        self.n = len(arrays[0])
        for x, (_, kind) in zip(arrays, self.KINDS, strict=True):
            self.file.write(np.ascontiguousarray(x.astype(kind)))

    def close(self) -> None:
        self.file.close()


def _common(old: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least of old[a+1..b] for pairs a < b; 0 where a is -1. By minima over runs of 1, 2, 4, ... entries."""
    out = np.zeros(len(a), np.int64)
    run = np.cumsum(old == 0)
    k = np.flatnonzero((a >= 0) & (b >= 0))
    k = k[run[a[k]] == run[b[k]]]  # in different runs a zero lies between
    level, least = 0, old
    power = np.log2(b[k] - a[k]).astype(np.int64)
    for p in range(int(power.max(initial=-1)) + 1):
        while level < p:
            least = np.minimum(least[: -(1 << level)], least[1 << level :])
            level += 1
        j = k[power == p]
        out[j] = np.minimum(least[a[j] + 1], least[b[j] + 1 - (1 << p)])
    return out


def sort_suffixes(symbols: np.ndarray, first: np.ndarray, count: np.ndarray, deep: int = DEEP) -> tuple[np.ndarray, np.ndarray]:
    """Strings symbols[first[j] : first[j] + count[j]] -> (name, common) in suffix order.

    The name of a suffix is string * 256 + number of its symbols; common counts the symbols it shares with the
    suffix before it, up to `deep`.
    """
    listed = Columns()
    last = np.full(len(first), -1, np.int64)  # place of each string's newest suffix
    for r in range(1, int(count.max(initial=0)) + 1):
        symbol, tail, common, name = listed.read()
        own = np.flatnonzero(count >= r)
        c, p = symbols[first[own] + count[own] - r], last[own]
        key = c << 32 | (p + 1)
        order = np.argsort(key, kind="stable")
        own, c, p, key = own[order], c[order], p[order], key[order]
        at = np.searchsorted(symbol << 32 | (tail + 1), key, side="right")
        moved = np.arange(len(symbol)) + np.cumsum(np.bincount(at, minlength=len(symbol) + 1))[: len(symbol)]
        place = at + np.arange(len(at))
        total = len(symbol) + len(at)
        before_tail = np.empty(total, np.int64)  # places in the list as it was
        new_symbol, new_name, new_common = np.empty(total, np.int64), np.empty(total, np.int64), np.empty(total, np.uint8)
        for new, kept, fresh in ((new_symbol, symbol, c), (before_tail, tail, p), (new_name, name, own * 256 + r), (new_common, common, 0)):
            new[moved] = kept
            new[place] = fresh
        near = np.zeros(total + 1, bool)
        near[place] = near[place + 1] = True
        touched = 1 + np.flatnonzero(near[1:total])
        same = touched[new_symbol[touched] == new_symbol[touched - 1]]
        new_common[touched] = 0
        new_common[same] = np.minimum(deep, 1 + _common(common, before_tail[same - 1], before_tail[same]))
        new_tail = before_tail
        has = new_tail >= 0
        new_tail[has] = moved[new_tail[has]]
        last[own] = place
        listed.write([new_symbol, new_tail, new_common, new_name])
    _, _, common, name = listed.read()
    listed.close()
    return name, common


def block_codes(data: np.ndarray) -> np.ndarray:
    """A number for the twenty bytes from each place: equal for equal blocks, and for no others.

    Blocks are numbered by a 64-bit hash; each is then compared with the first of its number, and if any differs, all
    are numbered by their bytes.
    """
    x = np.r_[data, np.zeros(STEP, np.uint8)].astype(np.uint64)
    two = x[:-1] | x[1:] << np.uint64(8)
    four = two[:-2] | two[2:] << np.uint64(16)
    eight = four[:-4] | four[4:] << np.uint64(32)
    n = len(data)
    block = eight[:n], eight[8 : 8 + n], four[16 : 16 + n]
    _, first, code = np.unique(block_hash(*block), return_index=True, return_inverse=True)
    lead = first[code]
    if all(np.array_equal(c, c[lead]) for c in block):
        return code.astype(np.int64)
    order = np.lexsort(block)
    new = np.zeros(n, bool)
    for c in block:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    code[order] = np.cumsum(new)
    return code.astype(np.int64)


def block_hash(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    h = a * ODD[0]
    h ^= h >> np.uint64(32)
    h += b * ODD[1]
    h ^= h >> np.uint64(29)
    h *= ODD[2]
    h += c * ODD[1]
    h ^= h >> np.uint64(32)
    return h


def repeats(body: list[bytes], order: np.ndarray) -> list[np.ndarray]:
    """Distinct pieces and the order of their first windows in the corpus -> numbers of each one's repeated windows."""
    data = np.frombuffer(b"".join(body), np.uint8)
    size = np.array([len(b) for b in body])
    begin = np.cumsum(size) - size
    code = block_codes(data)
    # A string of blocks for each phase of each piece; symbols are laid out by string.
    piece, phase = np.repeat(np.arange(len(body)), STEP), np.tile(np.arange(STEP), len(body))
    count = (size[piece] - phase) // STEP
    first = np.cumsum(count) - count
    at = np.arange(int(count.sum())) - np.repeat(first, count)
    symbols = code[np.repeat(begin[piece] + phase, count) + STEP * at]
    name, common = sort_suffixes(symbols, first, count)
    string, length = name >> 8, name & 255
    whole = length >= DEEP
    group = np.cumsum(common < DEEP)[whole]
    string, length = string[whole], length[whole]
    window = phase[string] + STEP * (count[string] - length)
    rank = order[piece[string]] + window
    cut = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    least = np.repeat(np.minimum.reduceat(rank, cut), np.diff(np.r_[cut, len(group)]))
    later = rank != least
    p, w = piece[string][later], window[later]
    sort = np.lexsort((w, p))
    return np.split(w[sort], np.searchsorted(p[sort], np.arange(1, len(body))))


def _bucket(blobs: list[bytes], groups: int) -> Iterator[pa.RecordBatch]:
    """All pieces of a bucket -> spans of repeated windows."""
    loaded = [_unpack(b, "u8", "i8", "i8", "i8", "u1") for b in blobs]
    key, doc, h, pos, n = (np.concatenate([x[k] for x in loaded]) for k in range(5))
    n = n.astype(np.int64)
    size = n + LENGTH - 1
    raw = b"".join([x[5] for x in loaded])
    begin = np.cumsum(size) - size
    uniq, at, count = np.unique(key, return_inverse=True, return_counts=True)
    several = np.flatnonzero(count[at] > 1)
    if not len(several):
        return
    several = several[np.lexsort((pos[several], h[several], doc[several]))]
    # The order of occurrences: documents by (doc, h), then place; a document given twice is one.
    d, g, q = doc[several], h[several], pos[several]
    rank = np.cumsum(np.r_[0, (d[1:] != d[:-1]) | (g[1:] != g[:-1])]) << 36 | q
    seen: dict[bytes, int] = {}
    lead: list[int] = []
    out: list[tuple[int, int, int]] = []  # piece, first and end byte of a span in it
    for k, x in enumerate(several.tolist()):
        j = seen.setdefault(raw[begin[x] : begin[x] + size[x]], len(lead))
        if j == len(lead):
            lead.append(k)
        elif rank[k] != rank[lead[j]]:
            out.append((x, 0, int(size[x])))
    body, head = list(seen), np.array(lead)
    # An anchor with one distinct piece has no repeat but that piece's copies.
    _, at, count = np.unique(key[several[head]], return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count[at] > 1)
    part = at[shared] % (1 + int(size[several[head[shared]]].sum()) // SORTED)
    for p in range(int(part.max(initial=-1)) + 1):
        chosen = shared[part == p]
        if not len(chosen):
            continue
        for j, w in zip(chosen.tolist(), repeats([body[j] for j in chosen.tolist()], rank[head[chosen]]), strict=True):
            if len(w):
                cut = np.flatnonzero(np.r_[True, w[1:] > w[:-1] + LENGTH, True])
                x = int(several[lead[j]])
                out += [(x, int(w[a]), int(w[b - 1]) + LENGTH) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    if out:
        x, a, b = np.array(out, np.int64).T
        yield from _spans(doc[x], h[x], pos[x] + a, pos[x] + b, groups)


def _sorted_buckets(batches: Iterator[pa.RecordBatch], groups: int) -> Iterator[pa.RecordBatch]:
    """Spans pass; the pieces of a bucket come together."""
    at, blobs = None, []
    for batch in batches:
        for k, kind, blob in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            if kind == 1:
                yield _batch([(k, blob)], 1)
                continue
            if k != at:
                if blobs:
                    yield from _bucket(blobs, groups)
                at, blobs = k, []
            blobs.append(blob)
    if blobs:
        yield from _bucket(blobs, groups)


def _apply(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    """at, kind, blob, doc, h, doc_id, text: the spans of a group come before its documents."""
    at, loaded, index = None, [], None
    for batch in batches:
        out = []
        for k, kind, blob, doc, h, doc_id, text in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
            if k != at:
                at, loaded, index = k, [], None
            if kind == 1:
                loaded.append(_unpack(blob, "i8", "i8", "i8", "i8"))
                continue
            if index is None:
                index = _index(loaded)
                loaded = []
            text = text or b""
            kept, removed, spans, from_ = [], 0, 0, 0
            for a, b in index(doc, h):
                kept.append(text[from_:a])
                removed += b - a
                spans += 1
                from_ = b
            kept.append(text[from_:])
            rest = b"".join(kept)
            out.append((doc_id, len(text), removed, spans, hashlib.sha256(rest).hexdigest(), rest if with_text else None))
        if out:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], RESULT)


BLOBS = "at int, kind int, blob binary"
RESULT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]


def _index(loaded: list):
    """Looks up a document's spans, merged where they touch or overlap."""
    if not loaded:
        return lambda doc, h: []
    doc, h, a, b = (np.concatenate([x[k] for x in loaded]) for k in range(4))
    order = np.lexsort((a, h, doc))
    doc, h, a, b = doc[order], h[order], a[order], b[order]
    cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])
    place = {(int(doc[i]), int(h[i])): (int(i), int(j)) for i, j in zip(cut, np.r_[cut[1:], len(doc)], strict=True)}

    def find(d: int, g: int) -> list[tuple[int, int]]:
        i, j = place.get((d, g), (0, 0))
        if i == j:
            return []
        far = np.maximum.accumulate(b[i:j])
        new = np.flatnonzero(np.r_[True, a[i + 1 : j] > far[:-1]])
        return list(zip(a[i:j][new].tolist(), far[np.r_[new[1:], j - i] - 1].tolist(), strict=True))

    return find


def remove_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the remaining bytes) for every row of docs.

    Null and empty texts have 0 bytes and remove nothing, as does any text of fewer than 100 bytes. Order is by
    doc_id (null last), then by a hash of the text where different texts share an id; rows that share both are
    one document given more than once and have the same result. An empty table gives an empty table. Further
    columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64(text).alias("h"), F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text")
    )
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, groups = 1 + total // BUCKET, max(1 + total // GROUP, 4 * parts(spark))
    body = rows.select("doc", "h", "text")
    # A table of fixed size says which anchors may occur more than once; no piece of any other can hold a repeat.
    seen = body.mapInArrow(_mark, BLOBS).repartition(parts(spark), "at").sortWithinPartitions("at").mapInArrow(_repeated, BLOBS)
    marks = {r["at"]: r["blob"] for r in seen.collect()}
    sent = spark.sparkContext.broadcast(marks)  # SLOTS bits at most, whatever the input
    cut = body.mapInArrow(lambda it: _cut(it, buckets, groups, sent.value), BLOBS)
    by = max(parts(spark), min(buckets, 1 << 16))
    met = cut.repartition(by, "at", "kind").sortWithinPartitions("kind", "at")
    spans = met.mapInArrow(lambda it: _sorted_buckets(it, groups), BLOBS)
    low = F.lit(0xFFFFFFFF)
    x = F.col("doc").bitwiseAND(low).bitwiseXOR(F.shiftright("doc", 32).bitwiseAND(low)) * MIX  # as group_of()
    given = rows.select((F.shiftright(x, 15) % groups).cast("int").alias("at"), F.lit(2).alias("kind"), F.lit(None).cast("binary").alias("blob"), "doc", "h", "doc_id", "text")
    spans = spans.select("at", "kind", "blob", F.lit(None).cast("long").alias("doc"), F.lit(None).cast("long").alias("h"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("text"))
    both = spans.unionByName(given).repartition(max(parts(spark), min(groups, 1 << 16)), "at").sortWithinPartitions("at", "kind")
    out = both.mapInArrow(lambda it: _apply(it, with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if with_text else out.drop("kept")
