"""Benchmark decontamination by winnowing: documents' words that stand in a window of a benchmark item.

A window is WINDOW consecutive words of an item; an item of fewer words is one window of its own length.

1. Fingerprints. Of the k-word grams of a window of k + w - 1 words the one with the least hash is kept, so texts that share a
   window share its fingerprint: nothing that is long enough is missed. k is half the window, so short windows have theirs
   alike. Items give a table of windows with their fingerprints.
2. Documents are read once. Their fingerprints are looked up in a bitmap of the items' fingerprints, and hits are extended to the
   windows around them, which are looked up in a bitmap of whole windows. Bitmaps have BITS bits, whatever the benchmark's
   size, so they are broadcast; one that fills up lets more pass, never less. What passes is kept as runs: stretches of a
   document's words that overlapping windows cover. A document's row is stored with its runs; most have none.
3. Join. Different runs, each once however many documents hold it, are cut into windows with their fingerprints, and joined
   with the items' by fingerprint and by the words themselves, so that no hash decides. Words in windows that are found are hit.
4. Documents alike in their runs share their counts and items, which are made once for each set of runs and joined back.

Null texts, and texts without words, have no words and no hits; items without words occur nowhere. Items without an id count as
hits, but not among the items; rows of one item id are one item. Rows of one document id (or none) each have their own
result. Empty tables give empty results, an empty benchmark no hits. Very long texts are read whole. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricebasket.llm.common import Batches, documents, map_batches, stored
from pricebasket.llm.hashing import mix, signed
from pricebasket.llm.words import words_of, words_sql

WINDOW = 10
#: Bits of a bitmap; words of texts that are looked at together, about.
BITS, TOGETHER = 1 << 26, 400_000
FOUND = "doc_id long, n_words long, runs_id string, runs array<struct<key:binary,run:binary,n:int>>"
_U = np.uint64


def winnow(length: int) -> tuple[int, int]:
    """k and w: grams of k words, the least of w grams in a row; together they span a window of so many words."""
    k = (length + 1) // 2
    return k, length - k + 1


def marks(texts: list[list[bytes]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text, place, fingerprint and hash of all windows of so many words."""
    sizes = np.array([len(t) for t in texts], np.int64)
    words = mix(np.fromiter((crc32(w) for t in texts for w in t), np.uint32, int(sizes.sum())).astype(_U) + _U(1))
    n = len(words) - length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none.view(_U), none.view(_U)
    salts = mix(np.arange(1, length + 1, dtype=_U)) | _U(1)
    k, w = winnow(length)
    grams, whole = np.zeros(n + w - 1, _U), np.zeros(n, _U)
    for j in range(k):
        grams += words[j : j + n + w - 1] * salts[j]
    grams, least = mix(grams), None
    for j in range(w):
        least = grams[j : j + n] if least is None else np.minimum(least, grams[j : j + n])
    for j in range(length):
        whole += words[j : j + n] * salts[j]
    text = np.repeat(np.arange(len(texts)), sizes)
    inside = np.flatnonzero(text[:n] == text[length - 1 :])
    first = np.cumsum(sizes) - sizes
    return text[inside], inside - first[text[inside]], least[inside], mix(whole[inside] + _U(length))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, length, words, fingerprint and whole (their hash) of each window of each item's text."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("item_id"), [words_of(t) for t in batch.column("text").to_pylist()]
            for length in sorted({min(window, len(t)) for t in texts} - {0}):
                rows = [k for k, t in enumerate(texts) if min(window, len(t)) == length]
                text, at, fingerprint, whole = marks([texts[k] for k in rows], length)
                words = [b" ".join(texts[rows[t]][p : p + length]) for t, p in zip(text.tolist(), at.tolist(), strict=True)]
                own = ids.take(pa.array(np.array(rows)[text]))
                yield pa.RecordBatch.from_arrays([own, pa.array(np.full(len(text), length, np.int32)), pa.array(words, pa.binary()), pa.array(signed(fingerprint)), pa.array(signed(whole))], names=["item_id", "length", "words", "fingerprint", "whole"])

    return map_batches(items.select(F.col("item_id").cast("string").alias("item_id"), "text"), run, "item_id string, length int, words binary, fingerprint long, whole long")


def bitmap(hashes: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """Which hashes, modulo bits, occur: so many bits, in words of 64. At most bits / 64 rows reach the driver."""
    slot = F.pmod(F.col(column), F.lit(bits))
    rows = hashes.select(slot.alias("slot")).groupBy((F.col("slot") / 64).cast("long").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, _U)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(_U)
    return out


def _in(found: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = np.mod(signed(hashes), np.int64(len(found) * 64)).astype(_U)
    return (found[slot >> _U(6)] >> (slot & _U(63))) & _U(1) == _U(1)


def _stretches(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def document_runs(docs: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """Each document with its runs, and an id of these (null if it has none)."""
    looked_up = docs.sparkSession.sparkContext.broadcast((bitmap(windows, "fingerprint"), bitmap(windows, "whole")))

    def found(texts: list[list[bytes]]) -> list[Counter]:
        fingerprints, wholes = looked_up.value
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        for length in lengths:
            text, at, fingerprint, whole = marks(texts, length)
            hit = np.flatnonzero(_in(fingerprints, fingerprint))
            hit = hit[_in(wholes, whole[hit])]
            for t, p in zip(text[hit].tolist(), at[hit].tolist(), strict=True):
                spans[t].append((p, p + length))
        return [Counter(b" ".join(texts[t][s:e]) for s, e in _stretches(own)) for t, own in enumerate(spans)]

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs_id", pa.string()), ("runs", pa.list_(pa.struct([("key", pa.binary()), ("run", pa.binary()), ("n", pa.int32())])))])
        for batch in batches:
            ids, all_texts = batch.column("doc_id"), batch.column("text")
            first = 0
            while first < len(all_texts):
                texts, size = [], 0
                while first + len(texts) < len(all_texts) and size < TOGETHER:
                    texts.append(words_of(all_texts[first + len(texts)].as_py()))
                    size += len(texts[-1])
                runs = [sorted(c.items()) for c in found(texts)]
                runs_id = [hashlib.sha256(b"\n".join(b"%s\t%d" % x for x in r)).hexdigest() if r else None for r in runs]
                rows = [[{"key": hashlib.sha256(x).digest(), "run": x, "n": n} for x, n in r] for r in runs]
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(texts)), pa.array([len(t) for t in texts], pa.int64()), pa.array(runs_id, pa.string()), pa.array(rows, schema.field("runs").type)], schema=schema)
                first += len(texts)

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, FOUND)


def run_windows(runs: DataFrame, lengths: list[int]) -> DataFrame:
    """key, at, length, words and fingerprint of all windows of runs (key, run)."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [r.split(b" ") for r in batch.column("run").to_pylist()]
            for length in lengths:
                text, at, fingerprint, _ = marks(texts, length)
                words = [b" ".join(texts[t][p : p + length]) for t, p in zip(text.tolist(), at.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(text)), pa.array(at), pa.array(np.full(len(text), length, np.int32)), pa.array(words, pa.binary()), pa.array(signed(fingerprint))], names=["key", "at", "length", "words", "fingerprint"])

    return map_batches(runs, run, "key binary, at long, length int, words binary, fingerprint long")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document (doc_id, text); items: item_id, text."""
    spark = docs.sparkSession
    windows = stored(spark, item_windows(items, window), "windows")
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())  # at most as many as a window has words
    read = stored(spark, document_runs(docs, windows, lengths), "runs")
    held = read.filter("runs_id is not null")
    runs = held.select(F.explode("runs").alias("r")).select("r.key", "r.run").distinct()
    cut = stored(spark, run_windows(runs, lengths), "run-windows")
    on = ["fingerprint", "length", "words"]
    hits = cut.join(windows.select(on).distinct(), on).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "length"))).alias("spans"))
    step = lambda s, x: F.struct(F.greatest(s["end"], x["at"] + x["length"]).alias("end"), (s["n"] + F.greatest(x["at"] + x["length"] - F.greatest(s["end"], x["at"]), F.lit(0))).alias("n"))
    hits = hits.select("key", F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")), step)["n"].alias("hit"))
    of_item = cut.join(windows.filter("item_id is not null").select(*on, "item_id").distinct(), on).select("key", "item_id").distinct()

    sets = held.select("runs_id", F.transform("runs", lambda r: F.struct(r["key"].alias("key"), r["n"].alias("n"))).alias("runs")).dropDuplicates(["runs_id"])
    each = sets.select("runs_id", F.explode("runs").alias("r")).select("runs_id", "r.key", "r.n")
    counted = each.join(hits, "key").groupBy("runs_id").agg(F.sum(F.col("n") * F.col("hit")).alias("n_hit"))
    named = each.select("runs_id", "key").join(of_item, "key").select("runs_id", "item_id").distinct().groupBy("runs_id")
    named = named.agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item_id")), ","), 256).alias("items_sha256"))
    known = counted.join(named, "runs_id", "left")
    none = hashlib.sha256(b"").hexdigest()

    def row(n_hit: object, n_items: object, digest: object) -> list:
        return ["doc_id", "n_words", F.coalesce(n_hit, F.lit(0)).cast("long").alias("n_hit"), F.coalesce(n_items, F.lit(0)).cast("long").alias("n_items"), F.coalesce(digest, F.lit(none)).alias("items_sha256"), (F.coalesce(n_hit, F.lit(0)) > 0).alias("contaminated")]

    empty = F.lit(None)
    clean = read.filter("runs_id is null").select(*row(empty.cast("long"), empty.cast("long"), empty.cast("string")))
    return clean.unionByName(held.select("doc_id", "n_words", "runs_id").join(known, "runs_id", "left").select(*row(F.col("n_hit"), F.col("n_items"), F.col("items_sha256"))))


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW, most: float = 0.0) -> DataFrame:
    """Documents of whose words no more than this share is hit, with all their columns. Ids must be there and stand once."""
    bad = decontaminate(docs, items, window).filter(F.col("n_hit") > most * F.col("n_words")).select("doc_id")
    return docs.join(bad, "doc_id", "left_anti")


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP13_SQL = f"""
with docs as (select row_number() over () as r, doc_id, {words_sql('text')} as w from documents),
items as (select item_id, w, least({WINDOW}, len(w)) as l from (select item_id, {words_sql('text')} as w from benchmark) where len(w) > 0),
windows as (
  select distinct item_id, l, array_to_string(w[p : p + l - 1], ' ') as t from (select *, unnest(range(1, len(w) - l + 2)) as p from items)),
places as (
  select r, p, l, array_to_string(w[p : p + l - 1], ' ') as t
  from (select r, w, l, unnest(range(1, len(w) - l + 2)) as p from docs, (select distinct l from windows))),
found as (select r, p, l, item_id from places join windows using (l, t)),
hit as (select r, count(distinct q) as n_hit from (select r, unnest(range(p, p + l)) as q from found) group by r),
named as (
  select r, count(*) as n_items, sha256(string_agg(item_id, ',' order by item_id)) as items_sha256
  from (select distinct r, cast(item_id as varchar) as item_id from found where item_id is not null) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hit using (r) left join named using (r)
"""
