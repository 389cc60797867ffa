"""Language-model scores from an Elias-Fano trie of word pairs.

The model is p(w | c) = m * n(c, w) / n(c) + (1 - m) * (n(w) + 1) / (N + V + 1), with counts over all training
documents; the weight m is the one of WEIGHTS under which the training tokens, each left out of its own counts, are
likeliest. Its trie has contexts on one level and their successors on the next, both sorted: successors form one
monotone sequence (number + context * universe) in Elias-Fano form, monotone pointers say where a context's
successors begin, each has its probability as an 8-bit logarithm, and the levels lie in memory-mapped files. A
query finds its context, then searches the successors between two pointers.

Counts and trie are partitioned, nothing is broadcast and no count passes through the driver: blocks of
documents send their distinct words, with counts, to shards by word hash, which answer with totals and numbers;
then they send their distinct pairs, with counts, to shards by context, which sum them, build their part of the
trie, look every pair up and answer with one byte for it; the block adds these up by document. A context of more
than HOT tokens is dealt by (context, successor), of which a block sends one entry each, so no word, however
frequent, fills a shard.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parasol.llm.common import keep, parts
from parasol.llm.text import FOLD_CASE

WEIGHTS = (0.01, 0.02, 0.05, *(k / 10 for k in range(1, 10)), 0.95, 0.98)
BLOCK = 8 << 20  # bytes of text in a block of documents
WORD_SHARD, PAIR_SHARD = 16 << 20, 8 << 20  # bytes of text for each shard
HOT = 1 << 17  # tokens of a context: about a tenth of those in a shard
MIX = np.uint64(0xC2B2AE3D27D4EB4F)
END = np.uint64(0)  # stands for the end of a text, and for what is before its first word
STEPS = 8  # codes for a factor of two
UNSEEN = 255


# ---- packing


def pack(*arrays: np.ndarray, rising: int = 0) -> bytes:
    """Arrays as one string, the first `rising` as differences; bytes of equal weight lie together."""
    head = np.array([len(arrays), *(len(x) for x in arrays)], np.int64)
    kinds = bytes(ord(x.dtype.char) for x in arrays)
    body = []
    for k, x in enumerate(arrays):
        x = np.diff(x, prepend=x.dtype.type(0)) if k < rising else np.ascontiguousarray(x)
        body.append(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() if len(x) else b"")
    return zstandard.ZstdCompressor(level=3).compress(b"".join([head.tobytes(), kinds, *body]))


def unpack(blob: bytes, rising: int = 0) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, n, 8).tolist()
    at, out = 8 + 8 * n, []
    kinds = raw[at : at + n].decode()
    at += n
    for k, (kind, size) in enumerate(zip(kinds, sizes, strict=True)):
        d = np.dtype(kind)
        b = np.frombuffer(raw, np.uint8, size * d.itemsize, at).reshape(d.itemsize, size)
        x = np.ascontiguousarray(b.T).view(d).reshape(size) if size else np.zeros(0, d)
        out.append(np.cumsum(x, dtype=d) if k < rising else x)
        at += size * d.itemsize
    return out


def least_kind(x: np.ndarray) -> np.ndarray:
    top = int(x.max(initial=0))
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def batch(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


ROW = (["at", "block", "kind", "shard", "blob"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()])
ROW_DDL = "at long, block long, kind int, shard int, blob binary"
TOKENS, WORDS, COUNTED, PAIRS, CODES, BASE, FITS = range(7)


# ---- quantised logarithms


def count_code(n: np.ndarray, up: bool) -> np.ndarray:
    """Counts from 1 on as 8-bit logarithms, rounded up or down, so that probabilities never sum to more than 1."""
    x = STEPS * np.log2(np.maximum(n, 1))
    return np.clip(np.ceil(x - 1e-9) if up else np.floor(x + 1e-9), 0, 255).astype(np.uint8)


def code_count(code: np.ndarray) -> np.ndarray:
    return np.exp2(code.astype(np.float64) / STEPS)


def chance_code(p: np.ndarray) -> np.ndarray:
    """Probabilities as 8-bit logarithms, rounded down; 0 stands for 1, UNSEEN for 0 and all below 2^-31."""
    return np.clip(np.ceil(-STEPS * np.log2(p) - 1e-9), 0, UNSEEN).astype(np.uint8)


def code_chance(code: np.ndarray) -> np.ndarray:
    return np.where(code == UNSEEN, 0.0, np.exp2(-code.astype(np.float64) / STEPS))


# ---- Elias-Fano


IN_BYTE = np.array([[[j for j in range(8) if b >> j & 1][k] if k < b.bit_count() else 0 for k in range(8)] for b in range(256)], np.uint8)


class EliasFano:
    """A monotone sequence: low bytes as they are, high parts as gaps in unary, both memory-mapped."""

    def __init__(self, values: np.ndarray):
        n, top = len(values), int(values[-1]) if len(values) else 0
        ideal = max(0, (top // max(1, n)).bit_length() - 1)
        self.width = next(w for w in (8, 16, 32, 64) if ideal <= w or w == 64)
        low = values.astype({8: np.uint8, 16: np.uint16, 32: np.uint32, 64: np.uint64}[self.width])
        high = (values >> np.uint64(self.width)).astype(np.int64) if self.width < 64 else np.zeros(n, np.int64)
        bits = np.zeros(((int(high[-1]) + n if n else 0) // 64 + 1) * 64, bool)
        bits[high + np.arange(n)] = True
        self.low = mapped(low)
        self.high = mapped(np.packbits(bits, bitorder="little"))
        ones = np.bitwise_count(self.high.view(np.uint64)).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def get(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.before, i, side="right") - 1
        left = i - self.before[word]
        byte = word * 8
        for _ in range(7):
            ones = np.bitwise_count(self.high[byte])
            on = left >= ones
            if not on.any():
                break
            left = left - on * ones
            byte = byte + on
        high = byte * 8 + IN_BYTE[self.high[byte], left] - i
        low = self.low[i].astype(np.uint64)
        return low if self.width == 64 else high.astype(np.uint64) << np.uint64(self.width) | low


def mapped(x: np.ndarray) -> np.ndarray:
    """The array in a file of its own, mapped; the file has no name and goes with the array."""
    if not len(x):
        return x
    with tempfile.TemporaryFile() as f:
        f.write(np.ascontiguousarray(x))
        f.flush()
        return np.memmap(f, x.dtype, "r", shape=x.shape)


class Trie:
    """Pairs (context, successor) sorted, with probability codes."""

    def __init__(self, context: np.ndarray, successor: np.ndarray, code: np.ndarray):
        names, first = np.unique(context, return_index=True)
        self.universe = np.uint64(int(successor.max(initial=0)) + 1)
        self.names = EliasFano(names)
        self.n = len(names)
        self.pointers = EliasFano(np.r_[first, len(context)].astype(np.uint64))
        row = np.repeat(np.arange(len(names)), np.diff(np.r_[first, len(context)]))
        self.row_base = self.universe
        self.successors = EliasFano(successor + row.astype(np.uint64) * self.universe)
        self.code = mapped(code)

    def _search(self, level: EliasFano, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Least place in [low, high) whose value is not below; high if there is none."""
        low, high = low.copy(), high.copy()
        todo = np.flatnonzero(low < high)
        while len(todo):
            mid = (low[todo] + high[todo]) >> 1
            below = level.get(mid) < value[todo]
            low[todo[below]] = mid[below] + 1
            high[todo[~below]] = mid[~below]
            todo = todo[low[todo] < high[todo]]
        return low

    def find(self, context: np.ndarray, n: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Contexts and how many successors are asked of each -> probability codes, UNSEEN for pairs never seen."""
        out = np.full(len(successor), UNSEEN, np.uint8)
        if not self.n or not len(context):
            return out
        at = self._search(self.names, np.zeros(len(context), np.int64), np.full(len(context), self.n), context)
        known = (at < self.n) & (self.names.get(np.minimum(at, self.n - 1)) == context)
        at = np.minimum(at, self.n - 1)
        begin, end = self.pointers.get(at).astype(np.int64), self.pointers.get(at + 1).astype(np.int64)
        row, low, high = (np.repeat(x, n) for x in (at, begin, end))
        ask = np.flatnonzero(np.repeat(known, n) & (successor < self.universe))
        value = successor[ask] + row[ask].astype(np.uint64) * self.universe
        place = self._search(self.successors, low[ask], high[ask], value)
        hit = place < high[ask]
        hit[hit] = self.successors.get(place[hit]) == value[hit]
        out[ask[hit]] = self.code[place[hit]]
        return out


# ---- stages


def shard_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(np.r_[True, x[1:] != x[:-1], True]) if len(x) else np.zeros(1, np.int64)
    return list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))


def _blocks(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """doc_id, held_out, text -> a row with the block's tokens, and rows of its words for their shards."""
    docs: list[tuple] = []
    lengths: list[int] = []
    number: dict[bytes, int] = {}
    tokens: list[int] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        block = int(np.frombuffer(np.random.default_rng().bytes(8), np.int64)[0] >> 1)
        h = np.array([xxhash.xxh64_intdigest(w) or 1 for w in number], np.uint64)
        local = np.array(tokens, np.int64)
        held = np.array([d[1] for d in docs], np.uint8)
        none = np.array([d[0] is None for d in docs], np.uint8)
        ids = np.array([d[0] or 0 for d in docs], np.int64)
        length = np.array(lengths, np.int64)
        seen = np.bincount(local[np.repeat(held == 0, length)], minlength=len(h))
        # Words in order of shard and hash; tokens are numbers in that order.
        at = shard_of(h, shards)
        order = np.lexsort((h, at))
        rank = np.empty(len(h), np.int64)
        rank[order] = np.arange(len(h))
        rows = [(block, block, TOKENS, 0, pack(ids, none, held, length, least_kind(rank[local])))]
        h, at, seen = h[order], at[order], seen[order]
        for i, j in _runs(at):
            rows.append((int(at[i]), block, WORDS, int(at[i]), pack(h[i:j], least_kind(seen[i:j]), rising=1)))
        yield batch(*ROW, rows)

    for b in batches:
        for doc_id, held, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            words = (text or "").encode("utf-8", "surrogatepass").translate(FOLD_CASE).split()
            docs.append((doc_id, held))
            lengths.append(len(words))
            tokens += [number.setdefault(w, len(number)) for w in words]
            size += len(text or "") + 16
            if size >= BLOCK:
                yield from flush()
                docs, lengths, number, tokens, size = [], [], {}, [], 0
    if docs:
        yield from flush()


def _count(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """All blocks' words of a shard -> totals and numbers for each block, and the shard's N and V."""
    for shard, rows in _grouped(batches):
        got = [unpack(r[4], rising=1) for r in rows]
        h = np.concatenate([g[0] for g in got])
        n = np.concatenate([g[1].astype(np.int64) for g in got])
        _, at = np.unique(h, return_inverse=True)
        total = np.bincount(at, weights=n).astype(np.int64)
        cut = np.cumsum([0, *(len(g[0]) for g in got)])
        for r, i, j in zip(rows, cut[:-1], cut[1:], strict=True):
            yield batch(*ROW, [(r[1], r[1], COUNTED, shard, pack(least_kind(at[i:j]), least_kind(total[at[i:j]])))])
        yield batch(*ROW, [(-1, -1, BASE, shard, np.array([total.sum(), (total > 0).sum()], np.int64).tobytes())])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows come sorted by `at`."""
    at, rows = None, []
    for b in batches:
        for row in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
            if row[0] != at:
                if rows:
                    yield at, rows
                at, rows = row[0], []
            rows.append(row)
    if rows:
        yield at, rows


def _ask(batches: Iterator[pa.RecordBatch], shards: int, pair_shards: int, n_tokens: int, n_words: int, n_ends: int) -> Iterator[pa.RecordBatch]:
    """A block's tokens and their counts -> what needs no pairs, by document, with the documents of each distinct pair, and
    rows of these pairs for their shards."""
    room = n_tokens + n_words + 1
    for block, rows in _grouped(batches):
        (main,) = (r for r in rows if r[2] == TOKENS)
        answers = sorted((r for r in rows if r[2] == COUNTED), key=lambda r: r[3])
        ids, none, held, length, token = unpack(main[4])
        got = [unpack(r[4]) for r in answers]
        # Numbers: 0 is the end, a word's is one more than its rank times shards plus its shard.
        word = np.concatenate([np.zeros(1, np.uint64), *(g[0].astype(np.uint64) * np.uint64(shards) + np.uint64(r[3] + 1) for g, r in zip(got, answers, strict=True))])
        count = np.concatenate([np.array([n_ends]), *(g[1].astype(np.int64) for g in got)])
        del got, answers, rows
        # Every document is its words and an end; what precedes the first word is an end.
        stop = np.cumsum(length + 1) - 1
        w = np.zeros(int((length + 1).sum()), np.int32)
        is_word = np.ones(len(w), bool)
        is_word[stop] = False
        w[is_word] = token.astype(np.int32) + 1
        c = np.r_[w[:0], 0, w[:-1]][: len(w)].astype(np.int32)
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), length + 1)
        del token, is_word, main
        total = lambda x: np.bincount(doc, weights=x, minlength=len(ids))
        base = np.log10((count + 1) / room)[w]
        n, known, sums = length + 1, total(count[w] > 0).astype(np.int64), [total(base)]
        ask = (count[c] > 0) & (count[w] > 0)
        back = total((count[c] > 0) & ~ask).astype(np.int64)
        base[ask] = 0.0
        sums.append(total(base))
        del base
        # Tokens by shard, context, successor and document: what is alike lies together.
        c, w, doc = c[ask], w[ask], doc[ask]
        hot = count[c] > HOT
        at = word[c]
        at[hot] = at[hot] * MIX ^ word[w[hot]]
        at = shard_of(at, pair_shards).astype(np.int32)
        place = np.empty(len(word), np.int32)
        place[np.argsort(word)] = np.arange(len(word), dtype=np.int32)
        order = np.lexsort((doc, place[w], place[c], at))
        c, w, doc, at = c[order], w[order], doc[order], at[order]
        del order, hot
        new = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (w[1:] != w[:-1])][: len(c)])
        learned = np.add.reduceat((held[doc] == 0).astype(np.int32), new) if len(new) else np.zeros(0, np.int32)
        times = np.diff(np.r_[new, len(c)])
        pc, pw, at = c[new], w[new], at[new]
        blob = pack(ids, none, held, n, known, back, *sums, least_kind(times), least_kind(doc), count_code(count[pw], up=False))
        yield batch(*ROW, [(block, block, BASE, 0, blob)])
        del c, w, doc, new, times, blob
        for i, j in _runs(at):
            x, y = pc[i:j], pw[i:j]
            new = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
            blob = pack(
                word[x[new]], least_kind(np.diff(np.r_[new, len(x)])), count_code(count[x[new]], up=True),
                least_kind(word[y]), count_code(count[y], up=False), least_kind(learned[i:j]), rising=1,
            )
            yield batch(*ROW, [(int(at[i]), block, PAIRS, int(at[i]), blob)])


def _answer(batches: Iterator[pa.RecordBatch], room: int) -> Iterator[pa.RecordBatch]:
    """All blocks' pairs of a shard -> trie -> for each block its pairs' probability codes in their order, and for the
    shard the training tokens' likelihood, each token left out of its own counts, under every weight in WEIGHTS."""
    for shard, rows in _grouped(batches):
        seen = []
        for r in rows:
            context, n, nc, successor, cw, learned = unpack(r[4], rising=1)
            some = np.flatnonzero(learned)
            seen.append([np.repeat(context, n)[some], successor[some].astype(np.uint64), learned[some].astype(np.int64), np.repeat(nc, n)[some], cw[some]])
        c, w, n, nc, cw = map(np.concatenate, zip(*seen, strict=True))
        del seen
        order = np.lexsort((w, c))
        c, w, n, nc, cw = (x[order] for x in (c, w, n, nc, cw))
        new = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (w[1:] != w[:-1])]) if len(c) else np.zeros(0, np.int64)
        total = np.add.reduceat(n, new) if len(new) else np.zeros(0, np.int64)
        c, w, nc, cw = c[new], w[new], code_count(nc[new]), code_count(cw[new])
        trie = Trie(c, w, chance_code(np.minimum(1.0, total / nc)))
        others, alone = np.minimum(1.0, (total - 1) / np.maximum(1.0, nc - 1)), np.maximum(1.0, cw) / room
        fits = np.array([float(total @ np.log10(m * others + (1 - m) * alone)) for m in WEIGHTS])
        del c, w, n, nc, cw, order, new, total, others, alone
        yield batch(*ROW, [(-1, -1, FITS, shard, fits.tobytes())])
        for r in rows:
            context, n, _, successor, _, _ = unpack(r[4], rising=1)
            code = trie.find(context, n.astype(np.int64), successor.astype(np.uint64))
            yield batch(*ROW, [(r[1], r[1], CODES, shard, pack(code))])


RESULT = (
    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()],
)
RESULT_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _finish(batches: Iterator[pa.RecordBatch], n_tokens: int, room: int, weight: float) -> Iterator[pa.RecordBatch]:
    for _, rows in _grouped(batches):
        (main,) = (r for r in rows if r[2] == BASE)
        ids, none, held, n, known, back, base, score, times, doc, cw = unpack(main[4])
        codes = [unpack(r[4])[0] for r in sorted((r for r in rows if r[2] == CODES), key=lambda r: r[3])]
        score = score + back * np.log10(1 - weight)
        if codes:
            p = np.log10(weight * code_chance(np.concatenate(codes)) + (1 - weight) * (code_count(cw) + 1) / room)
            score += np.bincount(doc, weights=np.repeat(p, times), minlength=len(ids))
        out = [(None if x else int(i), bool(k), int(a), int(b), n_tokens, float(c), float(d)) for i, x, k, a, b, c, d in zip(ids, none, held, n, known, base, score, strict=True)]
        yield batch(*RESULT, out)


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7, F.lit(0))


def score(docs: DataFrame, weight: float | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    The weight of pairs (0 to 1, neither included) is fitted if none is given.

    Null and empty texts are one end. Repeated rows count, and are scored, one by one; a null doc_id is not held
    out. Without training rows nothing is known and both scores are those of the base. Further columns are not
    read. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    held = F.when(F.col("doc_id").isNull(), F.lit(False)).otherwise(fold(F.col("doc_id")) == 2)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), text.alias("text"))
    size, ends = rows.agg(F.sum(F.octet_length("text")), F.sum(F.when(~F.col("held_out"), 1).otherwise(0))).first()
    size, ends = size or 0, ends or 0
    shards, pair_shards = 1 + size // WORD_SHARD, 1 + size // PAIR_SHARD

    def met(df: DataFrame, n: int) -> DataFrame:
        return df.repartition(max(parts(spark), n), "at").sortWithinPartitions("at", "kind", "shard")

    def of(df: DataFrame, kind: int) -> DataFrame:
        return df.where(F.col("kind") == kind)

    blocks = keep(rows.mapInArrow(lambda it: _blocks(it, shards), ROW_DDL))
    counted = keep(met(of(blocks, WORDS), shards).mapInArrow(lambda it: _count(it, shards), ROW_DDL))
    n_words = v_words = 0
    for r in of(counted, BASE).select("blob").toLocalIterator():  # two numbers a shard
        n, v = np.frombuffer(r["blob"], np.int64)
        n_words, v_words = n_words + int(n), v_words + int(v)
    n_tokens, v = n_words + ends, v_words + (ends > 0)
    room = n_tokens + v + 1
    both = of(blocks, TOKENS).unionByName(of(counted, COUNTED))
    asked = keep(met(both, 1 + size // BLOCK).mapInArrow(lambda it: _ask(it, shards, pair_shards, n_tokens, v, ends), ROW_DDL))
    answered = keep(met(of(asked, PAIRS), pair_shards).mapInArrow(lambda it: _answer(it, room), ROW_DDL))
    fits = np.zeros(len(WEIGHTS))
    for r in of(answered, FITS).select("blob").toLocalIterator():  # a number for each weight a shard
        fits += np.frombuffer(r["blob"])
    weight = weight or WEIGHTS[int(fits.argmax())]
    both = of(asked, BASE).unionByName(of(answered, CODES))
    return met(both, 1 + size // BLOCK).mapInArrow(lambda it: _finish(it, n_tokens, room, weight), RESULT_DDL)
