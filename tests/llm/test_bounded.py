"""What is gathered stays small, and is the same as without that bound."""

import random
import zlib

from pyspark.sql import functions as F

from pricebasket.llm import jaccard, language, records, sharding
from pricebasket.llm.common import new_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_the_language_sample_is_the_one_of_all_rows(spark, monkeypatch):
    r = random.Random(1)
    rows = [(i, f"text {r.random()} " * 9, "en" if i % 3 else "de", "s", 1) for i in range(3000)] + [(7000, "few " * 9, "rare", "s", 1), (7001, None, "rare", "s", 1), (None, "no id", "rare", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    sample = lambda: sorted((x["lang"], tuple(x["spans"])) for x in language.training_spans(docs, 50).collect())
    own = sample()
    monkeypatch.setattr(language, "SOUGHT", 1e9)
    assert own == sample() and {n: sum(x[0] == n for x in own) for n in ("en", "de")} == {"en": 50, "de": 50}


def test_files_and_index_batches_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(records, "ENTRIES", 3)
    monkeypatch.setattr(records, "FILES", 2)
    docs = spark.createDataFrame([(i % 40, f"some words {i}", "en", "s", 1) for i in range(60)], SCHEMA)
    folder = new_path(spark, "records")
    index = records.with_starts(records.write_records(docs, folder, file_bytes=10))
    assert index.select("file").distinct().count() <= 3
    read = records.read_records(index, folder, lambda _, ids: {"n": len(ids), "c": zlib.crc32(ids.tobytes())}, "n long, c long").orderBy("part", "place").collect()
    assert len(read) == 60 and [x["doc_id"] for x in read] == sorted(i % 40 for i in range(60))
    assert [x["start"] for x in read] == [sum(y["n"] for y in read[:k]) for k in range(60)]


def test_rows_of_one_id_are_dealt_out(spark):
    docs = spark.createDataFrame([(5, f"text {i}", "en", "s", 1) for i in range(4000)], SCHEMA)
    out = sharding.interleave(docs.select("doc_id", "text", "source")).collect()
    assert sorted((x["shard"], x["slot"]) for x in out) == [(s, k) for s in range(8) for k in range(500)]
    first = {x["text_crc32"]: (x["shard"], x["slot"]) for x in out}
    again = sharding.interleave(docs.repartition(7).select("doc_id", "text", "source")).collect()
    assert {x["text_crc32"]: (x["shard"], x["slot"]) for x in again} == first
    assert docs.agg(F.count("*")).first()[0] == len(first)


def test_frequent_shingles_by_counts_of_counts(spark):
    rows = [(k, 1 + k % 50) for k in range(5000)]
    frame = spark.createDataFrame(rows, "doc_id long, c long")
    assert sorted(jaccard._frequent(frame, 10_000).column("doc_id").to_pylist()) == list(range(5000))
    some = jaccard._frequent(frame, 1000).to_pylist()
    assert 800 <= len(some) <= 1200 and min(x["c"] for x in some) >= 38
    assert sum(x["c"] >= 45 for x in some) == sum(c >= 45 for _, c in rows)
    assert jaccard._frequent(frame.limit(0)).num_rows == 0
