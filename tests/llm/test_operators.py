"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from parasol.llm import ann, common, decontamination, extraction, langid, lm, mixing, quality, sharding, simhash, substrings

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and river stone walks under bright morning light over quiet fields where old trees stand".split()


def prose(seed: int, n: int) -> str:
    r = np.random.default_rng(seed)
    return " ".join(WORDS[k] + str(r.integers(40)) for k in r.integers(len(WORDS), size=n))


def odd_rows() -> list[tuple]:
    long = prose(1, 4000)
    return [
        (1, None, None, None, None), (2, "", "en", "", 0), (3, " \n\t ", "en", "a", 4), (4, "Word", None, "a", 4), (5, long, "en", "b", len(long)), (6, long, "en", None, len(long)),
        (7, "ÀÉ ünï 12 !?", "fr", "c", 12), (7, "ÀÉ ünï 12 !?", "fr", "c", 12), (None, prose(3, 60), "en", "b", 1), (9, prose(4, 60), "en", "b", 1), (10, prose(4, 60), "de", "b", 1), (11, prose(4, 59) + " end", "en", "b", 1),
        *[(20 + k, prose(50 + k, 30 + k), "en" if k % 2 else "de", "abc"[k % 3], 1) for k in range(30)],
    ]


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns bear the names that operators use inside."""
    d = spark.createDataFrame(odd_rows(), DOCS).repartition(5)
    return d.withColumn("score", F.lit("x")).withColumn("_Row", F.lit(1)).withColumn("Size", F.lit(2)).withColumn("w0", F.lit(3))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# ---- mixing


def test_pivot_keeps_words():
    rows = [(k * 77 + 1, k % 9 + 1, 0.3) for k in range(500)]
    done, left = mixing.pivot(rows, 1)
    taken = sum(rows[k][1] * v for k, v in done.items()) + (rows[left[0]][1] * left[1] if left else 0)
    assert taken == pytest.approx(0.3 * sum(r[1] for r in rows)) and set(done.values()) <= {0, 1} and len(done) + bool(left) == 500


def test_pivot_is_fair():
    rows = [(1, 3, 0.25), (2, 5, 0.5), (3, 2, 0.25), (4, 7, 0.4)]
    n = Counter()
    for seed in range(4000):
        done, left = mixing.pivot(rows, seed)
        for k, v in done.items():
            n[k] += v
        if left:
            n[left[0]] += left[1]
    assert [n[k] / 4000 for k in range(4)] == pytest.approx([0.25, 0.5, 0.25, 0.4], abs=0.04)


def test_mix(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(odd_rows())
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(2)).collect()))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by: dict = {}
    for _, t, _, s, _ in odd_rows():
        by[s] = by.get(s, 0) + size(t)
    order = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, target, free = 1.5 * sum(by.values()), {}, set(order)
    while True:  # shares by weight; what is over goes to the rest
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * by[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * by[s] for s in over}
        free -= over
    most = max(size(r[1]) for r in odd_rows())
    for s in order:
        own = [r for r in rows if r["source"] == s]
        assert all(r["target"] == pytest.approx(target[s]) and r["source_size"] == by[s] and r["taken"] <= 2 * r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - target[s]) <= most
    assert mixing.mix(none).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and Counter(r["doc_id"] for r in mixed.collect())[1] == 1


def test_mix_whatever_the_batches(spark):
    """Copies depend neither on batches nor on partitions, whole repeated rows included, and stage and query agree."""
    rows = [(k, " ".join(["w"] * (1 + k * 37 % 400)), "en", f"s{k % 3}", k) for k in range(2500)] + [(7, "w w w", "en", "s1", 7)] * 700
    docs = spark.createDataFrame(rows, DOCS)
    usual = spark.conf.get(common.BATCH), spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for batch, partitions in ((7, 3), (512, 8), (10_000, 4)):
            spark.conf.set(common.BATCH, str(batch))
            spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
            found.append(Counter(map(tuple, mixing.mix(docs.repartition(partitions)).collect())))
    finally:
        spark.conf.set(common.BATCH, usual[0])
        spark.conf.set("spark.sql.shuffle.partitions", usual[1])
    assert found[0] == found[1] == found[2] and found[0].total() == len(rows)
    taken = Counter()
    for r, n in found[0].items():
        taken[r[0]] += n * r[5]
    assert Counter(r["doc_id"] for r in mixing.mixed_documents(docs).collect()) == +taken
    for s in ("s0", "s1", "s2"):
        own = [(r, n) for r, n in found[0].items() if r[6] == s]
        assert abs(sum(r[4] * n for r, n in own) - own[0][0][3]) <= 400 and all(r[4] <= 2 * r[1] for r, _ in own)


# ---- decontamination


def brute_hits(text, items):
    take = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = take(text), set(), set()
    for name, t in items:
        p = take(t)
        n = min(10, len(p))
        for k in range(len(p) - n + 1) if p else ():
            for j in range(len(w) - n + 1):
                if w[j : j + n] == p[k : k + n]:
                    hit.update(range(j, j + n))
                    found.add(str(name))
    return len(w), len(hit), len(found), decontamination.items_digest(found)


def test_decontamination(spark, docs, none):
    items = [(1, prose(4, 14)), (2, "word"), (3, None), (4, ""), (5, prose(1, 4000)[300:420]), (5, "stone1 under2"), (None, "the"), (6, "12"), (7, prose(4, 14).upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.report(docs, bench).collect()
    want = Counter((r[0], *brute_hits(r[1], [i for i in items if i[0] is not None])) for r in odd_rows())
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in got) == want
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in got)
    kept = decontamination.decontaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(n for k, n in want.items() if k[2] == 0)
    assert decontamination.report(none, bench).count() == 0
    assert decontamination.report(docs, bench.limit(0)).where("contaminated").count() == 0


def test_decontamination_in_blocks(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(k, prose(4, 60)[k * 3 : k * 3 + 90]) for k in range(12)], "item_id long, text string")
    one = sorted(map(str, decontamination.report(docs, bench).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 400)
    assert one == sorted(map(str, decontamination.report(docs, bench).collect()))


# ---- substrings


def brute_repeats(rows):
    seen, out = {}, {}
    order = sorted({(math.inf if d is None else d, (t or "").encode()) for d, t in rows})
    for d, b in order:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            if seen.setdefault(b[k : k + 100], (d, b, k)) != (d, b, k):
                gone[k : k + 100] = True
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[d, b] = (len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


def test_substrings(spark, docs, none):
    shared = prose(7, 40)
    rows = [(r[0], r[1]) for r in odd_rows()] + [(100 + k, prose(200 + k, 9) + shared[k * 5 :] + "ab" * 130 + shared[: 99 + k]) for k in range(8)] + [(200, "x" * 700), (201, "é" * 200)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_repeats(rows)
    got = substrings.remove_repeats(d).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == Counter((d, *want[math.inf if d is None else d, (t or "").encode()]) for d, t in rows)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)
    assert substrings.remove_repeats(none).count() == 0
    assert substrings.remove_repeats(docs, False).count() == len(odd_rows())


def test_long_text_over_segments(spark, monkeypatch):
    t = prose(9, 3000)
    rows = [(1, t), (2, prose(10, 30) + t[5000:9000])]
    want = brute_repeats(rows)
    data = [(d, xxhash.xxh64_intdigest(x.encode()) >> 1, x.encode()) for d, x in rows]
    monkeypatch.setattr(substrings, "SEGMENT", 2000)
    import pyarrow as pa

    b = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*data, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc", "h", "text"])
    windows = sum(int(substrings.pieces(x, e)[3].sum()) for _, x, e in substrings._segments(iter([b])))
    assert windows == sum(len(x) - 99 for *_, x in data)
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), False).collect()
    assert {(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == {(d, *want[d, t.encode()]) for d, t in rows}


def test_blocks_are_equal_by_bytes(monkeypatch):
    data = np.frombuffer((prose(5, 300) * 2).encode(), np.uint8)
    whole = [data[k : k + 20].tobytes().ljust(20, b"\0") for k in range(len(data))]
    hashed = substrings.block_codes(data)
    monkeypatch.setattr(substrings, "block_hash", lambda a, b, c: a % np.uint64(7))
    for code in (hashed, substrings.block_codes(data)):
        assert len(set(zip(code.tolist(), whole, strict=True))) == len(set(whole)) == len(set(code.tolist()))


# ---- sharding


def test_curve_is_continuous():
    at = {c: k for k, c in enumerate(sharding.curve())}
    n = sharding.LEVELS
    points = [(at[k] // n // n, at[k] // n % n, at[k] % n) for k in range(n**3)]
    assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for p, q in zip(points, points[1:], strict=False))


def test_sharding(docs, none):
    rows = sharding.shard(docs).collect()
    assert len(rows) == len(odd_rows())
    count = Counter(r["shard"] for r in rows)
    assert max(count.values()) - min(count.values()) <= 1 and len(count) == 16
    for k in count:
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(count[k]))
    line = [r["curve_index"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert line == sorted(line)
    for r in rows:
        b = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(b) + 1, zlib.crc32(b), "rows", None)
    assert sharding.shard(none).count() == 0 and sharding.shard(docs.limit(3)).count() == 3


def plain_index(curve: list[int], source: str, lang: str, size: int) -> int:
    """Place on the curve of a row's cell, from its metadata alone."""
    level = lambda x: zlib.crc32(x.encode()) % 16
    return curve[(level(source) * 16 + level(lang)) * 16 + min(15, int(math.log2(size)))]


def test_shards_of_a_hot_text(spark):
    """A third of all rows is one text: it is divided, in an order that no number of partitions changes."""
    r = np.random.default_rng(2)
    rows = [(k, "the same" if k % 3 == 0 else prose(k, 1 + k % 9), "en", f"s{int(r.integers(3))}") for k in range(3000)]
    rows += [(5000 + k, "", None, None) for k in range(700)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = []
    for parts in (3, 16):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got.append({x["doc_id"]: x for x in sharding.shard(d.repartition(parts)).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got[0] == got[1] and len(got[0]) == len(rows)
    line = sorted(got[0].values(), key=lambda x: (x["shard"], x["slot"]))
    count = Counter(x["shard"] for x in line)
    assert max(count.values()) - min(count.values()) <= 1
    assert all([x["slot"] for x in line if x["shard"] == k] == list(range(count[k])) for k in count)
    curve = sharding.curve()
    assert all(x["curve_index"] == plain_index(curve, x["source"] or "", x["lang"] or "", x["size"]) for x in line)
    xx = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) ^ 1 << 63  # noqa: E731  in order of signed numbers
    place = [(x["curve_index"], xx(x["text"]), xx(str(x["doc_id"]))) for x in line]
    assert place == sorted(place)


# ---- nearest neighbours


def test_ann(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(1500, 16)).astype(np.float32)
    x[40:400] = x[40]
    rows = [(k, x[k].tolist()) for k in range(1500)] + [(5, x[5].tolist()), (2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0] * 8), (2004, []), (None, x[3].tolist()), (2005, [None] * 16), (2020, [float("inf")] * 16)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("vec", F.lit(1)).withColumn("cell", F.lit(1))
    for share, least in ((1.0, 1.0), (ann.SHARE, 0.9)):
        got: dict = {}
        for q in ann.search(v, v.where("vec_id % 20 = 0"), share=share).collect():
            got.setdefault(q["query_id"], []).append((q["rank"], q["vec_id"], q["score"]))
        assert set(got) == set(range(0, 1500, 20))
        hits = 0
        for q, found in got.items():
            s = x.astype(np.float64) @ x[q].astype(np.float64)
            order = [k for k in sorted(range(1500), key=lambda k: (-round(float(s[k]), 9), k)) if k != q][:20]
            found.sort()
            assert [f[0] for f in found] == list(range(1, 21)) and all(f[2] == pytest.approx(s[f[1]], abs=1e-9) for f in found)
            hits += len(set(order) & {f[1] for f in found})
        assert hits / (20 * len(got)) >= least
    few = v.where("vec_id < 3")
    assert ann.search(few, few.where("vec_id = 0")).count() == 2
    assert ann.search(v.limit(0), v).count() == 0 and ann.search(v, v.limit(0)).count() == 0


def test_ann_goes_to_probed_blocks_alone(spark, monkeypatch):
    """Clustered vectors in many small blocks, doubles that floats can't hold: exact scores, high recall, few meetings."""
    monkeypatch.setattr(ann, "BLOCK", 64)
    r = np.random.default_rng(3)
    x = np.repeat(r.normal(size=(60, 12)) * 4, 40, axis=0) + r.normal(size=(2400, 12)) + 1e-12
    x[100:400] = x[100]
    v = spark.createDataFrame([((1 << 53) + k, x[k].tolist()) for k in range(2400)], "vec_id long, embedding array<double>")
    hits, got = 0, {}
    for q in ann.search(v, v.where("vec_id % 20 = 0"), share=0.2).collect():
        got.setdefault(q["query_id"] - (1 << 53), []).append((q["rank"], q["vec_id"] - (1 << 53), q["score"]))
    assert len(got) == 120
    for q, found in got.items():
        exact = [math.fsum(x[k] * x[q]) for k in range(2400)]
        order = sorted((k for k in range(2400) if k != q), key=lambda k: (-exact[k], k))[:20]
        assert all(f[2] == exact[f[1]] for f in found) and len(found) == 20
        hits += len(set(order) & {f[1] for f in found})
    assert hits / 2400 > 0.9


def test_probes_in_order():
    a, b = np.random.default_rng(1).normal(size=(2, 12))
    p = ann.probes(a, b, np.ones(144, np.int64), 144)
    s = np.add.outer(a, b).ravel()[p]
    assert sorted(p) == list(range(144)) and (np.diff(s) <= 1e-12).all()


# ---- simhash


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(docs, none):
    rows = odd_rows()
    fp = [brute_fingerprint(r[1]) for r in rows]
    lead = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fp[i] ^ fp[j]).bit_count() <= 3:
                    lead[i] = lead[j] = min(lead[i], lead[j])
    least = {k: min((rows[j][0] for j in range(len(rows)) if lead[j] == k and rows[j][0] is not None), default=None) for k in set(lead)}
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.report(docs).collect())
    assert got == Counter((r[0], f"{f:016x}", least[k]) for r, f, k in zip(rows, fp, lead, strict=True))
    assert simhash.report(none).count() == 0


def test_tiles_miss_no_link(spark):
    r = np.random.default_rng(2)
    base = r.integers(0, 1 << 62, 400)
    near = [int(b) ^ sum(1 << int(k) for k in r.choice(60, 3, replace=False)) for b in base]
    fps = spark.createDataFrame([(int(x), int(x)) for x in {*map(int, base), *near}], "w0 long, name long")
    links = simhash.near_links(fps, 3)
    root = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    assert all(root[int(a)] == root[b] for a, b in zip(base, near, strict=True))


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (501, 500)], "a long, b long")
    root = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    assert set(root.values()) == {0, 500} and len(root) == 203


def test_deduplicated(spark, docs, none):
    t = prose(77, 400).split()
    close = [" ".join(t[:k] + ["changed"] + t[k + 1 :]) for k in (30, 200, 350)]
    rows = [(900, " ".join(t), "en", "a", 1), *[(901 + k, c, "en", "a", 1) for k, c in enumerate(close)], (950, prose(78, 400), "en", "a", 1), (951, prose(79, 400), "en", "a", 1)]
    d = spark.createDataFrame(rows, DOCS)
    assert {r["doc_id"] for r in simhash.deduplicated(d).collect()} == {900, 950, 951}
    kept = simhash.deduplicated(docs)
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert kept.columns == docs.columns and ids[5] == 1 and ids[6] == 0 and ids[7] == 1 and ids[9] == 1 and ids[10] == 0 and ids[1] == ids[2] == ids[3] == 1
    assert simhash.deduplicated(none).count() == 0


def test_near_copies_are_confirmed(spark):
    """Pairs at true similarities of 0.6 to 0.85, short and long, against brute force."""
    rows = []
    for k in range(120):
        t = prose(5000 + k, (40, 120, 400)[k % 3]).split()
        shingles = len(t) - 4
        gone = round((1 - (0.6 + k % 26 / 100)) * shingles / (2 - (1 - (0.6 + k % 26 / 100))))
        rows += [(2 * k, " ".join(t)), (2 * k + 1, " ".join(t[: len(t) - gone] + prose(9000 + k, gone).split()))]
    rows += [(1000, "one two three four five six seven eight"), (1001, "one two three four five six seven eight nine"), (1002, "a b c d e f"), (1003, "a b c d e f a b c d e f")]
    sets = {d: set(zip(*[t.split()[j:] for j in range(5)], strict=False)) for d, t in rows}
    jaccard = lambda x, y: len(sets[x] & sets[y]) / len(sets[x] | sets[y])
    lead = {d: d for d, _ in rows}
    ids = sorted(lead)
    for i in ids:
        for j in ids:
            if i < j and jaccard(i, j) >= 0.8:
                lead[j] = min(lead[j], lead[i])
    below = [k for k in range(120) if 0.7 <= jaccard(2 * k, 2 * k + 1) < 0.8]
    assert len(below) > 20 and lead[1001] == 1000 and lead[1003] == 1003
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.deduplicated(d).collect()} == {x for x in lead if lead[x] == x}


def test_near_copies_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MEMBERS", 7)
    t = prose(77, 300).split()
    rows = [(k, " ".join(t[:k] + [f"changed{k}"] + t[k + 1 :])) for k in range(0, 300, 6)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["doc_id"] for r in simhash.deduplicated(d).collect()] == [0]


# ---- quality, language, language model


def test_factorisation_identity():
    r = np.random.default_rng(3)
    at, x = np.array([3, 9, 20]), np.array([0.5, 1.0, 2.0])
    m = quality.Machine(0.1, r.normal(size=quality.SIZE).astype(np.float32), r.normal(size=(quality.SIZE, 4)).astype(np.float32) * 0.1)
    pairs = sum(float(m.factor[at[i]] @ m.factor[at[j]]) * x[i] * x[j] for i in range(3) for j in range(i))
    assert m.score(at, x) == pytest.approx(1 / (1 + math.exp(-(0.1 + float(m.weight[at] @ x) + pairs))), abs=1e-6)


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(r[0], 1 if k % 2 else 0, 0) for k, r in enumerate(odd_rows()) if r[0]] + [(None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.report(docs, labels).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert {r["score"] for r in quality.report(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.report(none, labels).count() == 0


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.report(spark.read.parquet(f"{sf}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.9


def test_langid(spark, docs, none):
    rows = langid.report(docs).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert {r["lang_pred"] for r in rows if r["doc_id"] in range(20, 50)} <= {"en", "de", "fr"}
    assert langid.identified(docs).columns == docs.columns and langid.report(none).count() == 0
    assert {r["lang_pred"] for r in langid.report(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_langid_drops_no_language(spark):
    """Three hundred languages of their own words are all learned, and told apart."""
    rows = []
    for lang in range(300):
        r = np.random.default_rng(lang)
        words = ["".join(chr(97 + c) for c in r.integers(0, 26, 6)) for _ in range(60)]
        rows += [(lang * 10 + n, " ".join(r.choice(words, 120)), f"l{lang:03d}") for n in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    learned = langid.fit(docs)
    assert len(learned) == 300 and all(learned.values())
    judge = langid.Compressors({k: v for k, v in learned.items() if k < "l030"})
    assert sum(judge.classify(t)[0] == lang for _, t, lang in rows if lang < "l030") > 0.8 * 180


def test_langid_equals_plain_encoding(spark, docs):
    """Every prediction by encoding its pieces one by one, without the operator."""
    learned = langid.fit(docs)
    for r in langid.report(docs).collect():
        text = next(t for d, t, *_ in odd_rows() if d == r["doc_id"] and (d is not None or t))
        if not text or not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        line = langid.folded(text) or b" "
        size = {}
        for lang, d in learned.items():
            p = zstandard.ZstdCompressionParameters.from_level(3, strategy=zstandard.STRATEGY_BTOPT, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
            c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=p)
            size[lang] = sum(len(c.compress(line[k : k + langid.PIECE])) for k in range(0, len(line), langid.PIECE))
        least, following = sorted(size.values())[:2] if len(size) > 1 else (1, math.inf)
        assert r["lang_pred"] == min(size, key=lambda k: (size[k], k))
        assert r["rejected"] == (following / least - 1 < langid.NARROW)


def test_langid_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.report(d).where("held_out").join(d.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.95


def test_elias_fano():
    r = np.random.default_rng(4)
    for n, top in ((0, 1), (1, 5), (1000, 10), (1000, 1 << 40), (5000, 1 << 62)):
        v = np.sort(r.integers(0, top, n)).astype(np.uint64)
        assert (lm.EliasFano(v).get(np.arange(n)) == v).all()


def test_trie():
    r = np.random.default_rng(5)
    pairs = sorted({(int(a), int(b)) for a, b in r.integers(0, 60, (800, 2))})
    c, w = (np.array(x, np.uint64) for x in zip(*pairs, strict=True))
    code = r.integers(1, 200, len(pairs)).astype(np.uint8)
    t = lm.Trie(c, w, code)
    have = dict(zip(pairs, code.tolist(), strict=True))
    for a in range(70):
        got = t.find(np.array([a], np.uint64), np.array([75]), np.arange(75, dtype=np.uint64))
        assert got.tolist() == [have.get((a, b), lm.UNSEEN) for b in range(75)]


def test_lm(docs, none):
    rows = sorted(lm.score(docs, weight=0.2).collect(), key=str)
    texts = [(r[0], re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")) + [None]) for r in odd_rows()]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    count, pairs = Counter(), Counter()
    for d, t in texts:
        if not held(d):
            count.update(t)
            pairs.update(zip([None, *t], t, strict=False))
    n, v = count.total(), len(count)
    want = []
    for d, t in texts:
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t)
        full = sum(math.log10((0.2 * pairs[p, w] / count[p] if count[p] else 0) + (1 - 0.2 if count[p] else 1) * (count[w] + 1) / (n + v + 1)) for p, w in zip([None, *t], t, strict=False))
        want.append((d, held(d), len(t), sum(count[w] > 0 for w in t), n, base, full))
    assert Counter(tuple(r)[:5] for r in rows) == Counter(w[:5] for w in want)
    key = lambda r: (str(r[0]), r[2], r[5])
    for r, w in zip(sorted(rows, key=key), sorted(want, key=key), strict=True):
        assert r["base_score"] == pytest.approx(w[5], rel=1e-9) and abs(r["score"] - w[6]) <= 0.06 * w[2]  # probabilities are 8-bit logarithms
    assert lm.score(none).count() == 0
    # The fitted weight is the likeliest of the grid, with every training token left out of its own counts.
    seen = [(p, w) for d, t in texts if not held(d) for p, w in zip([None, *t], t, strict=False)]
    likely = {m: sum(math.log10(m * (pairs[p, w] - 1) / max(1, count[p] - 1) + (1 - m) * count[w] / (n + v + 1)) for p, w in seen) for m in lm.WEIGHTS}
    best = sorted(likely, key=likely.get)[-3:]
    fitted = Counter((str(r["doc_id"]), r["n_tokens"], round(r["score"], 9)) for r in lm.score(docs).collect())
    assert any(fitted == Counter((str(r["doc_id"]), r["n_tokens"], round(r["score"], 9)) for r in lm.score(docs, weight=m).collect()) for m in best)


def test_lm_hot_context(spark, monkeypatch):
    """A context dealt over shards by pair scores as it does in one."""
    docs = spark.createDataFrame([(k, " ".join(f"the w{(k * 7 + j) % 90}" for j in range(60))) for k in range(40)], "doc_id long, text string")
    whole = sorted(map(tuple, lm.score(docs, 0.3).collect()))
    for name, value in (("HOT", 20), ("PAIR_SHARD", 2048), ("WORD_SHARD", 4096), ("BLOCK", 4096)):
        monkeypatch.setattr(lm, name, value)
    parted = sorted(map(tuple, lm.score(docs, 0.3).collect()))
    assert [r[:5] for r in whole] == [r[:5] for r in parted]
    assert all(a[5] == pytest.approx(b[5]) and a[6] == pytest.approx(b[6], rel=1e-6) for a, b in zip(whole, parted, strict=True))


# ---- extraction


@pytest.mark.parametrize(
    "page",
    [
        "<a " * 350_000, "<a<a" * 250_000, "<div>" * 100_000 + "</p>" * 100_000, '<a "' * 250_000, "<!" * 500_000, "<ul><li><ul>" + "<b>" * 100_000 + "<li></li>" * 60_000,
        "<body>" + "<div><p>x</p></div>" * 50_000, "<form>" + "<div>" * 100_000 + "</span>" * 50_000 + "<p>" * 50_000, "<!-- " * 200_000,
    ],
    ids=range(9),
)
def test_hostile_pages_take_linear_time(page):
    start = time.time()
    extraction.main_text(page + "<p>end")
    assert time.time() - start < 5 * max(1.0, 4 * _slowness())


def _slowness() -> float:
    """Seconds of a fixed piece of work, about a quarter of one on an ordinary machine."""
    start = time.time()
    sum(len(str(k)) for k in range(1_500_000))
    return time.time() - start


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""), ("", ""), ("<p>One<p>Two &amp;  <b>three</b><br>four", "One\n\nTwo & three four"),
        ("<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><a href=x>Menu</a></nav><div class='ad'>Buy now</div><article><h1>Head</h1><p><b>First <i>bold</b> text.<p>Second\n\n text</p></article><footer>Foot</footer></body></html>", "Head\n\nFirst bold text.\n\nSecond text"),
        ("<body><header>Site</header><div id=sidebar><p>Links here</p></div><main><article><p>" + "Long text here. " * 20 + "</p></article><section class='comments'><p>Nice!</p></section></main><form><p>Mail</p></form>", ("Long text here. " * 20).strip()),
        ("<article><p>a &lt; b &#233;&nbsp;c</p><!-- x --><ul><li>one<li>two</ul></article", "a < b é c\n\none\n\ntwo"),
    ],
)
def test_extraction(page, text):
    assert extraction.main_text(page) == text


@pytest.mark.parametrize(
    "page,text",
    [
        ("<article><p class='notice'>Cookies<p>First text.<p>Second text.</article>", "First text.\n\nSecond text."),
        ("<article><div><p class='notice'>Cookies</div><p>After it.</p></article>", "After it."),
        ("<article><ul><li class='share'>Share<li>One<li>Two</ul><p>End.</p></article>", "One\n\nTwo\n\nEnd."),
        ("<article><p class='notice'>Cookies <b>here<div>Text.</div></article>", "Text."),
        ("<article><div class='entry-header'><h1>Head</h1></div><p>Text.</p></article>", "Head\n\nText."),
        ("<body><h1>Head</h1><div>By someone</div><div>" + "<p>Long text here.</p>" * 9 + "</div></body>", "\n\n".join(["Head", "By someone", *["Long text here."] * 9])),
        ("<article><div class='share'><ul><li>A<li>B</ul><p>C<p>D</div><p>Text.</p></article>", "Text."),
    ],
)
def test_extraction_after_noise(page, text):
    assert extraction.main_text(page) == text


def test_extraction_of_articles(spark):
    p = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").unionByName(spark.createDataFrame([(None, None, None)], "page_id long, url string, html string"))
    rows = extraction.extract(p.withColumn("text", F.lit(1))).collect()
    assert len(rows) == p.count() and all(r["n_chars"] == len(r["text"]) for r in rows)
    by = {r["page_id"]: r["html"] for r in p.collect()}
    for r in rows:
        if r["page_id"] is not None:
            inner = re.search(r"<article>(.*)</article>", by[r["page_id"]], re.S)[1]
            words = re.sub(r"<[^>]*>", " ", inner)
            import html

            assert "".join(r["text"].split()) == "".join(html.unescape(words).split())
