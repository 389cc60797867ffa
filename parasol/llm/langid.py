"""Language by compression: a text is encoded with a zstandard raw-content dictionary for each language, and the
language whose dictionary makes it smallest wins; where the next one does as well, the text is rejected.

Fitting is bounded: passages of at most PASSAGE characters from about SAMPLE documents of a language, SIZE bytes of
dictionary each, and never more than ALL bytes of dictionaries, which many languages share evenly. Every learned
language has a dictionary. Classification reads whole texts.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parasol.llm.common import fresh

SIZE, PASSAGE, SAMPLE, ALL = 32 << 10, 1500, 200, 32 << 20
SHARED = 4  # words: runs of so many that occur before, in any language, are left out of dictionaries
PIECE = 4096  # bytes encoded at once: in longer pieces a text would lean on itself, not on the dictionary
NARROW = 0.001  # of the smallest encoding: a text whose two best are nearer is rejected
LETTER = re.compile(r"[^\W\d_]")
#: ASCII letters lower-cased, other ASCII blank, bytes of other characters as they are.
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def folded(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(FOLD).split())


def encoder(dictionary: bytes) -> zstandard.ZstdCompressor:
    """Optimal parsing with matches from three bytes on, whatever the text's length."""
    params = zstandard.ZstdCompressionParameters.from_level(
        3, strategy=zstandard.STRATEGY_BTOPT, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    d = zstandard.ZstdCompressionDict(dictionary or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=params)


class Compressors:
    """An encoder for each language, in order of name."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = sorted(dictionaries)
        self.encoders = [encoder(dictionaries[n]) for n in self.names]

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score (0: as good as the next, towards 1: far better), rejected."""
        if not self.names or not text or not LETTER.search(text):
            return "und", 0.0, True
        line = folded(text) or b" "
        pieces = [line[k : k + PIECE] for k in range(0, len(line), PIECE)]
        sizes = [sum(len(c.compress(p)) for p in pieces) for c in self.encoders]
        best = min(range(len(sizes)), key=lambda k: (sizes[k], k))
        if len(sizes) == 1:
            return self.names[0], 1.0, False
        margin = min(x for k, x in enumerate(sizes) if k != best) / sizes[best] - 1
        return self.names[best], margin / (margin + 0.05), margin < NARROW


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from: crc32 of the id mod 4 is not 2, text and language there."""
    return docs.where((fold(F.col("doc_id")) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(0))


def fit(docs: DataFrame) -> dict[str, bytes]:
    """Dictionaries by language from training rows."""
    rows = training_rows(docs).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    counts = rows.groupBy("lang").count().collect()  # names of languages
    if not counts:
        return {}
    size = min(SIZE, ALL // len(counts))
    sample = max(8.0, SAMPLE * size / SIZE)
    rate = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, sample / r["count"]))])
    draw = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)
    length = F.length("text")
    start = F.lit(1) + F.pmod(F.shiftrightunsigned("h", 31), F.greatest(F.lit(1), length - PASSAGE))
    picked = rows.where(draw < F.element_at(rate, F.col("lang"))).select("lang", "h", F.substring(F.col("text"), start.cast("int"), F.lit(PASSAGE)).alias("t"))
    return dictionaries([(r["lang"], r["h"], r["t"]) for r in picked.collect()], [r["lang"] for r in counts], size)


def dictionaries(passages: list[tuple[str, int, str]], names: list[str], size: int = SIZE) -> dict[str, bytes]:
    """Passages in order of hash, without word runs that another language has or that came before (copies, licences)."""
    rows = [(lang, folded(t).split()) for lang, _, t in sorted(passages)]
    of: dict[tuple, set[str]] = defaultdict(set)
    for lang, words in rows:
        for k in range(len(words) - SHARED + 1):
            of[tuple(words[k : k + SHARED])].add(lang)
    seen: set[tuple] = set()
    out = dict.fromkeys(names, b"")
    for lang, words in rows:
        if len(out[lang]) >= size:
            continue
        drop: set[int] = set()
        for k in range(len(words) - SHARED + 1):
            run = tuple(words[k : k + SHARED])
            if len(of[run]) > 1 or run in seen:
                drop.update(range(k, k + SHARED))
            seen.add(run)
        out[lang] += b"".join(w + b" " for k, w in enumerate(words) if k not in drop)
    return {k: v[:size] for k, v in out.items()}


def predicted(docs: DataFrame, learned: dict[str, bytes], names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """docs with the three columns; docs' own columns of these names are replaced.

    A null text, or one without a letter, is `und` with score 0 and rejected, as is any text if nothing was
    learned; ties go to the smaller name, with score 0, rejected. Repeated rows are judged alike.
    """
    docs = docs.drop(*names)
    schema = docs.withColumns({names[0]: F.lit(""), names[1]: F.lit(0.0), names[2]: F.lit(True)}).schema
    sent = docs.sparkSession.sparkContext.broadcast(learned)  # ALL bytes at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Compressors(sent.value)
        for pdf in batches:
            found = [judge.classify(t) for t in pdf["text"]]
            yield pdf.assign(**{n: pd.Series([f[k] for f in found], index=pdf.index, dtype=t) for k, (n, t) in enumerate(zip(names, ("object", "float64", "bool"), strict=True))})

    return docs.mapInPandas(run, schema)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of docs."""
    rows = docs.select("doc_id", "text", (fold(F.col("doc_id")) == 2).alias("held_out"))
    out = predicted(rows.withColumn("text", F.col("text").cast("string")), fit(docs))
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def identified(docs: DataFrame) -> DataFrame:
    """The rows of docs that are not rejected, all columns as they are."""
    names = tuple(fresh(docs, "_lang", "_score", "_rejected"))
    return predicted(docs, fit(docs), names).where(~F.col(names[2])).select(*docs.columns)
