import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricebasket.llm import codes, decontamination, resampling

DOCS = "doc_id long, text string, lang string, gain string, chunk string, runs string"


def brute_codes(rows, entries=16, rounds=6):
    kept = [(i, l, [math.floor(4096 * x) for x in v]) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    if not kept:
        return {}
    width = len(kept[0][2]) // 8
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(r[2], p) for r in kept[:entries]] for p in range(8)]
    best = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(8):
            own = [(best(cut(r[2], p), books[p])[1], cut(r[2], p)) for r in kept]
            for e in range(len(books[p])):
                if members := [x for k, x in own if k == e]:
                    books[p][e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    out = [(i, l, [best(cut(v, p), books[p]) for p in range(8)]) for i, l, v in kept]
    of_label = Counter()
    for _, l, b in out:
        of_label[l] += sum(d for d, _ in b)
    sha = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for _, e in b), sum(d for d, _ in b), of_label[l], sha) for i, l, b in out), key=str)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("code", F.lit("clash")).withColumn("vector", F.lit(1)).repartition(3)


def coded(spark, rows, **how):
    books, stored = codes.fit_codebooks(codes.whole_vectors(vectors(spark, rows)), **how)
    out = codes.encoded(stored, books)
    of_label = {r["label"]: r["e"] for r in out.groupBy("label").agg(F.sum("error").alias("e")).collect()}
    return books, sorted(((r["vec_id"], r["code"].hex(), r["error"], of_label[r["label"]], codes.books_sha256(books)) for r in out.collect()), key=str)


def test_codes_are_those_of_the_plain_iteration(spark):
    r = random.Random(3)
    centres = [[r.uniform(-1, 1) for _ in range(32)] for _ in range(20)]
    rows = [(i, [float(np.float32(x + r.gauss(0, 0.2))) for x in r.choice(centres)], r.choice([1, 2, None])) for i in range(400)]
    rows += [(1000, None, 1), (1001, [None] * 32, 1), (1002, [float("nan")] * 32, 1), (1003, [float("inf")] + [0.0] * 31, 1), (-5, [0.0] * 32, 2), (7, rows[7][1], 1), (7, rows[9][1], 1), (None, rows[3][1], None)]
    assert coded(spark, rows)[1] == brute_codes(rows)


def test_few_equal_and_no_vectors(spark):
    rows = [(i, [0.5] * 8, None) for i in range(5)]
    assert coded(spark, rows)[1] == brute_codes(rows)
    books, none = codes.fit_codebooks(codes.whole_vectors(vectors(spark, [(1, None, 1)])))
    assert books is None and none.count() == 0
    with pytest.raises(Exception, match="can't be cut into"):
        codes.fit_codebooks(codes.whole_vectors(vectors(spark, [(1, [0.1] * 9, 1)])))
    with pytest.raises(Exception, match="components"):
        coded(spark, [(1, [0.1] * 8, 1), *((k, [0.1] * 16, 1) for k in range(2, 40))])
    with pytest.raises(Exception, match="not below"):
        coded(spark, [(1, [1e9] * 8, 1)])


def test_only_changed_parts_contribute(spark):
    rows = spark.createDataFrame([(1, "a", [1, 2, 3, 4], bytearray([0, 1]), bytearray([0, 0])), (2, "a", [5, 6, 7, 8], bytearray([1, 1]), bytearray([1, 1])), (3, "a", [9, 9, 9, 9], bytearray([1, 0]), None)], codes.CODED)
    got = {(r["part"], r["entry"], r["at"]): r["delta"] for r in codes.contributions(rows, 2, 2, 4).collect()}
    want = {(1, 1, 0): 3, (1, 1, 1): 4, (1, 1, 2): 1, (1, 0, 0): -3 + 9, (1, 0, 1): -4 + 9, (0, 1, 0): 9, (0, 1, 1): 9, (0, 1, 2): 1}
    assert got == want | ({(1, 0, 2): 0} if (1, 0, 2) in got else {})


def test_codes_decode_to_entries(spark):
    books, _ = coded(spark, [(i, [float(i % 3)] * 16, 1) for i in range(9)], entries=3)
    frame = spark.createDataFrame([(bytearray([0, 1, 2, 0, 1, 2, 0, 1]),)], "code binary")
    got = codes.decoded(frame, books).first()["vector"]
    assert got == [x / 4096 for p, e in enumerate([0, 1, 2, 0, 1, 2, 0, 1]) for x in books[p][e].tolist()]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_resample(docs, target, grams=1, buckets=10_000, percent=10, least=20):
    def runs(text):
        w = plain_words(text)
        return [" ".join(w[i : i + n]) for n in range(1, grams + 1) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in docs for f in runs(x)), Counter(bucket(f) for x in target for f in runs(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (big_s + buckets) / ((s[b] + 1.0) * (big_t + buckets))))
    out = []
    for i, x in docs:
        own = runs(x)
        weight = sum(gain(bucket(f)) for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_words(x)) >= least])
    fit = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    drawn = fit[: len(fit) * percent // 100]
    ranks = {}
    for k, x in enumerate(drawn, 1):
        ranks.setdefault((x[0], x[3]), []).append(k)
    return out, ranks


NAMES = "alpha beta gamma delta epsilon zeta eta theta iota kappa Äpfel 日本 x1 2y".split()


def text_of(r, n):
    return " ".join(r.choice(NAMES[: r.randint(3, len(NAMES))]) + r.choice(["", ".", ",", "\n"]) for _ in range(n))


@pytest.mark.parametrize("grams", [1, 2])
def test_resampling_is_what_the_formula_says(spark, grams, monkeypatch):
    r = random.Random(grams)
    docs = [(i, text_of(r, r.randint(0, 60))) for i in range(300)] + [(900, None), (901, ""), (902, "!!"), (903, text_of(r, 30_000)), (5, text_of(r, 40)), (None, text_of(r, 40))]
    docs += [(950, docs[3][1])] * 3 + [(None, "Alpha BETA " * 30)] * 4
    target = [text_of(r, 50), "alpha beta", None, ""]
    monkeypatch.setattr(resampling, "CHUNK", 700)
    frame = spark.createDataFrame([(i, t, "en", "clash", "clash", "clash") for i, t in docs], DOCS).repartition(5)
    got = resampling.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), grams=grams).collect()
    want, ranks = brute_resample(docs, target, grams)
    assert sorted((str(x["doc_id"]), x["n_features"], x["weight"], x["score"]) for x in got) == sorted((str(i), n, w, s) for i, n, w, s, _ in want)
    own = {}
    for x in got:
        if x["rank"] is not None:
            own.setdefault((x["doc_id"], x["score"]), []).append(x["rank"])
    assert {k: sorted(v) for k, v in own.items()} == ranks


def test_resampling_of_nothing(spark):
    empty, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b " * 20, "", "", "", "")], DOCS)
    assert resampling.resample(empty, some).count() == 0
    assert resampling.resample(some, empty).first()["rank"] is None
    many = spark.createDataFrame([(i, "a b " * 20, "", "", "", "") for i in range(30)], DOCS)
    assert resampling.drawn_documents(many, some).count() == 3


def brute_hits(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = plain_words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for i, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[p : p + n]))) is not None:
                    hit.update(range(p, p + n))
                    found |= own
        ids = sorted(str(x) for x in found if x is not None)
        out.append((str(i), len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("bits", [decontamination.BITS, 64])
def test_hits_are_those_of_all_windows(spark, bits, monkeypatch):
    """Also with bitmaps that are full: what they let pass is found out by the join."""
    monkeypatch.setattr(decontamination.bitmap, "__defaults__", (bits,))
    r = random.Random(bits)
    long = [[r.choice("abcdefgh") + str(r.randint(0, 9)) for _ in range(40)] for _ in range(30)]
    items = [(k, " ".join(w)) for k, w in enumerate(long)] + [(100, None), (101, ""), (102, "?!"), (103, "ONE"), (104, "two three, four"), (105, "a b c d e f g h i"), (3, "other words of item three are these and those ones here"), (None, " ".join(long[2])), (106, " ".join(long[4][5:25]))]
    docs = []
    for i in range(120):
        parts = [" ".join(r.choice("abcdefgh") + str(r.randint(0, 9)) for _ in range(r.randint(0, 30)))]
        w = r.choice(long)
        a = r.randint(0, 39)
        parts += [r.choice(["", " ".join(w[a : a + r.randint(1, 30)]).upper(), "one", "Two-three\nfour", "a b c d e f g h i", " ".join(w)])]
        docs.append((i, " ".join(parts + [r.choice(["", "tail x1"])])))
    docs += [(200, None), (201, ""), (202, "..."), (None, " ".join(long[1])), (None, "one one"), (7, docs[7][1]), (203, " ".join(long[9]) * 200)]
    frame = spark.createDataFrame([(i, t, "en", "clash", "clash", "clash") for i, t in docs], DOCS).repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit("clash"))
    got = sorted((str(x["doc_id"]), *x[1:]) for x in decontamination.decontaminate(frame, bench).collect())
    assert got == brute_hits(docs, items)


def test_hits_of_nothing(spark):
    docs, none = spark.createDataFrame([(1, "a b", "", "", "", "")], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert decontamination.decontaminate(docs, none).collect()[0]["contaminated"] is False
    assert decontamination.decontaminate(docs.limit(0), none).count() == 0
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontamination.clean_documents(docs, none).count() == 1 and decontamination.clean_documents(docs, some).count() == 0
