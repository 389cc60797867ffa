"""Benchmark decontamination by Wu-Manber multi-pattern search.

Patterns are windows of ten consecutive item words, joined and bounded by single spaces; texts are brought to
the same form, so a window occurs where its bytes do. The search looks at the last block of each alignment:
a shift table says how far the next possible occurrence is, most blocks occur in no pattern and skip almost a
whole pattern length, a block that may end a pattern selects a bucket, the pattern's first bytes select the
strings to test in it, and a direct comparison confirms.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parasol.llm.common import fresh

WINDOW = 10
#: Bytes of item text whose tables are built and sent at once; a larger benchmark takes one pass for each such block.
BLOCK_BYTES = 4 << 20
#: Separators and A-Z mapped, so that words are what bytes.split() gives.
FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cases A-Z and takes runs of digits, ASCII letters and anything from U+0080 on; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class WuManber:
    """One table set: patterns of similar length share shifts that their shortest allows."""

    def __init__(self, patterns: Iterable[bytes]):
        self.patterns = list(patterns)
        self.m = min(map(len, self.patterns))
        self.block = 8 if self.m >= 24 else max(2, self.m // 3)
        self.far = self.m - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, dict[bytes, list[int]]] = defaultdict(lambda: defaultdict(list))
        b, m = self.block, self.m
        for k, p in enumerate(self.patterns):
            for end in range(b, m + 1):
                s = p[end - b : end]
                if m - end < self.shift.get(s, self.far):
                    self.shift[s] = m - end
            self.bucket[p[m - b : m]][p[: m - b]].append(k)
        self.bucket = {s: dict(v) for s, v in self.bucket.items()}

    def find(self, text: bytes) -> Iterator[tuple[int, int]]:
        """(start, pattern) of every occurrence, overlaps included."""
        b, m, far, get, n = self.block, self.m, self.far, self.shift.get, len(text)
        end = m
        while end <= n:
            s = text[end - b : end]
            step = get(s, far)
            if step:
                end += step
                continue
            start = end - m
            for k in self.bucket[s].get(text[start : end - b], ()):
                if text.startswith(self.patterns[k], start):
                    yield start, k
            end += 1


def tables(items: list[tuple[str, str | None]]) -> tuple[list[WuManber], dict[bytes, list[str]]]:
    """Table sets by length class, and the items of each window."""
    of: dict[bytes, set[str]] = defaultdict(set)
    for item, text in items:
        w = words_of(text)
        for k in range(max(1, len(w) - WINDOW + 1)) if w else ():
            of[b" " + b" ".join(w[k : k + WINDOW]) + b" "].add(item)
    by: dict[int, list[bytes]] = defaultdict(list)
    for p in of:
        by[0 if len(p) < 8 else 1 if len(p) < 16 else 2 if len(p) < 32 else 3].append(p)
    return [WuManber(sorted(v)) for _, v in sorted(by.items())], {p: sorted(v) for p, v in of.items()}


def hits(text: str | None, sets: list[WuManber], of: dict[bytes, list[str]]) -> tuple[int, list[int], set[str]]:
    """Number of words, spans of hit words as a flat list of first and end, items."""
    w = words_of(text)
    line = b" " + b" ".join(w) + b" "
    spans: list[tuple[int, int]] = []
    found: set[str] = set()
    for t in sets:
        for start, k in t.find(line):
            p = t.patterns[k]
            spans.append((start, p.count(b" ") - 1))
            found.update(of[p])
    if not spans:
        return len(w), [], found
    first, out, at, word = sorted(set(spans)), [], 0, 0
    for start, n in first:  # word numbers by counting blanks from one start to the next
        word += line.count(b" ", at, start)
        at = start
        if out and word <= out[-1]:
            out[-1] = max(out[-1], word + n)
        else:
            out += [word, word + n]
    return len(w), out, found


def _blocks(benchmark: DataFrame) -> list[list[tuple[str, str | None]]]:
    """Items in blocks of at most about BLOCK_BYTES each, dealt by hash; one block for an ordinary benchmark.

    The driver holds one block at a time before it is broadcast.
    """
    rows = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES) or 1
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k)
        yield [(r["i"], r["t"]) for r in part.collect()]


def scan(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with n_words, hit_spans (first and end word, flat, disjoint, sorted) and hit_items (distinct, sorted).

    Null or empty texts have no words; a benchmark without words hits nothing; items of null item_id are not
    searched for; items that share an id count once. Repeated rows are judged one by one. Columns of docs with
    these names are replaced; all others stay.
    """
    docs = docs.drop("n_words", "hit_spans", "hit_items")
    spark = docs.sparkSession
    (w, s, i) = fresh(docs, "n_words", "hit_spans", "hit_items")
    out = docs.withColumns({w: F.lit(0).cast("long"), s: F.lit(None).cast("array<int>"), i: F.lit(None).cast("array<string>")})
    schema = out.schema
    for items in _blocks(benchmark):
        sent = spark.sparkContext.broadcast(items)

        def search(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            sets, of = tables(sent.value)
            for pdf in batches:
                for name in (s, i):
                    pdf[name] = [[] if x is None else list(x) for x in pdf[name]]
                counts = []
                for k, text in enumerate(pdf["text"]):
                    n, spans, found = hits(text, sets, of)
                    counts.append(n)
                    if spans:
                        pdf.at[pdf.index[k], s] = _union(pdf[s].iloc[k], spans)
                        pdf.at[pdf.index[k], i] = sorted(found.union(pdf[i].iloc[k]))
                pdf[w] = counts
                yield pdf

        out = out.mapInPandas(search, schema)
    return out


def _union(a: list[int], b: list[int]) -> list[int]:
    out: list[int] = []
    for first, end in sorted([*zip(a[::2], a[1::2], strict=True), *zip(b[::2], b[1::2], strict=True)]):
        if out and first <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [int(first), int(end)]
    return out


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs."""
    found = scan(docs.select("doc_id", F.col("text").cast("string").alias("text")), benchmark).drop("text")
    ends = F.aggregate(
        F.sequence(F.lit(0), F.size("hit_spans") - 1),
        F.lit(0).cast("long"),
        lambda a, k: a + F.when(k % 2 == 0, -F.get("hit_spans", k)).otherwise(F.get("hit_spans", k)),
    )
    n = F.when(F.size("hit_spans") > 0, ends).otherwise(0).cast("long")
    return found.select(
        "doc_id",
        "n_words",
        n.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        (n > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no window occurs, all columns kept."""
    return scan(docs, benchmark).where(F.size("hit_spans") == 0).select(*docs.columns)


def items_digest(ids: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
