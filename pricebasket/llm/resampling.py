"""Target-distribution importance resampling with a dictionary of the distinct features.

1. Features of a text are all runs of 1 to GRAMS consecutive words, joined by a space, repeats counted. Texts are taken in
   chunks of about CHUNK features (a longer text goes alone); a chunk has one row a distinct feature, with the chunk's documents
   that hold it and how often. Chunks are stored once.
2. Dictionary. Features are counted over all chunks, of the documents and of the target; sums are made in each task first, so a
   frequent word gives a task one row. Each distinct feature is hashed once and gets its bucket; counts are summed by bucket.
3. A bucket's gain is the logarithm of its smoothed share in the target over that in the documents. There are BUCKETS gains,
   whatever the input, so they are broadcast to the dictionary.
4. Gains are joined back to the chunks' rows by feature, then a chunk's rows come together and give the mean gain of each of its
   documents. A feature that most chunks hold is a hot key of that join only on the side that can be split.
5. Scores are the mean gains plus Gumbel noise from a hash of the id. The documents with at least LEAST words of which PERCENT
   are drawn are ranked by counts: scores are integers within some 70,000 values, so how many documents stand before a score is a
   sum over few rows; within a score, rows are counted by id and salt, and only rows alike in score, id and salt are numbered together.

Null texts, and those without words, have no features and weigh 0. Null ids hash like an empty one and come last among ties.
Repeated rows count each and are drawn each; rows of one id are told apart by rank only. Empty tables give empty results; without a
target every gain tells only how frequent a bucket is. Very long texts are one chunk. Other columns play no part.
"""

from __future__ import annotations

from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricebasket.llm.common import Batches, documents, map_batches, stored
from pricebasket.llm.words import words_of, words_sql

GRAMS, BUCKETS, SEED = 1, 10_000, "2024"
#: Words that a document that may be drawn has at least; how many of a hundred such are drawn.
LEAST, PERCENT = 20, 10
#: Features (with repeats) of a chunk, about; its documents, at most, so that their places fit into 16 bits.
CHUNK, CHUNK_DOCS = 4_000_000, 1 << 16
#: Over so many salts rows alike in score and id are spread.
SALTS = 64
CHUNKS = "chunk long, feature binary, total long, docs binary, counts binary, doc_id long, at int, n_features long, n_words long"


def features(words: list[bytes], grams: int = GRAMS) -> list[bytes]:
    """All runs of 1 to so many consecutive words."""
    out = list(words)
    for n in range(2, grams + 1):
        out += map(b" ".join, zip(*(words[k:] for k in range(n))))
    return out


def chunks(docs: DataFrame, grams: int = GRAMS) -> DataFrame:
    """Rows of (chunk, feature, total, docs, counts), and one of (chunk, doc_id, at, n_features, n_words) for each document."""
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]

    def batch_of(n: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(c) if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds, strict=True)], names=names)

    def packed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """Runs of values as binaries."""
        ends = np.concatenate([[0], np.cumsum(sizes)]) * values.itemsize
        return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values)])

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        heads: list[tuple[int | None, int, int]] = []
        places, counts, sizes = array("i"), array("i"), []
        index: defaultdict[bytes, int] = defaultdict()
        index.default_factory = index.__len__  # a new feature gets the next number
        size = 0

        def closed() -> Iterator[pa.RecordBatch]:
            ids, n_features, n_words = zip(*heads, strict=True)
            chunk = lambda n: pa.array(np.full(n, number, np.int64))
            yield batch_of(len(heads), chunk=chunk(len(heads)), doc_id=pa.array(ids, pa.int64()), at=pa.array(range(len(heads)), pa.int32()), n_features=pa.array(n_features, pa.int64()), n_words=pa.array(n_words, pa.int64()))
            if index:
                feature, often = np.frombuffer(places, np.int32), np.frombuffer(counts, np.int32)
                order = np.argsort(feature, kind="stable")
                found = np.bincount(feature, minlength=len(index))
                first = np.cumsum(found) - found
                docs_of, often = np.repeat(np.arange(len(heads), dtype=np.uint16), sizes)[order], often[order]
                total, once = np.add.reduceat(often.astype(np.int64), first), np.maximum.reduceat(often, first) == 1
                # once in each document, as most are: no counts
                counts_of = packed(often[~np.repeat(once, found)], np.where(once, 0, found))
                yield batch_of(len(index), chunk=chunk(len(index)), feature=pa.array(list(index), pa.binary()), total=pa.array(total), docs=packed(docs_of, found), counts=counts_of)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                own = features(words, grams)
                if heads and (size + len(own) > CHUNK or len(heads) == CHUNK_DOCS):
                    yield from closed()
                    number, heads, size = number + 1, [], 0
                    places, counts, sizes = array("i"), array("i"), []
                    index.clear()
                found = Counter(own)
                places.extend(map(index.__getitem__, found))
                counts.extend(found.values())
                sizes.append(len(found))
                heads.append((doc_id, len(own), len(words)))
                size += len(own)
        if heads:
            yield from closed()

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, CHUNKS)


def dictionary(own: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """feature, bucket, s and t (how often it is in the documents and in the target) of each distinct feature."""
    both = own.filter("feature is not null").select("feature", F.col("total").alias("s"), F.lit(0).cast("long").alias("t"))
    both = both.unionByName(target.filter("feature is not null").select("feature", F.lit(0).cast("long").alias("s"), F.col("total").alias("t")))
    counted = both.groupBy("feature").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    return counted.select("feature", F.pmod(F.crc32("feature"), F.lit(buckets)).cast("int").alias("bucket"), "s", "t")


def gains(words: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and gain of each bucket that a feature falls into; never more rows than buckets."""
    of_bucket = words.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    whole = of_bucket.agg(F.sum("s").cast("double").alias("all_s"), F.sum("t").cast("double").alias("all_t"))
    more, less = (F.col("t") + 1.0) * (F.col("all_s") + buckets), (F.col("s") + 1.0) * (F.col("all_t") + buckets)
    return of_bucket.join(F.broadcast(whole)).select("bucket", F.floor(1000 * F.log(more / less)).alias("gain"))


def _sums(places: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The exact sum of the values of each place."""
    out = np.zeros(CHUNK_DOCS, np.int64)
    np.add.at(out, places, values)
    return out


def weighed(own: DataFrame, words: DataFrame, gain: DataFrame) -> DataFrame:
    """doc_id, n_features, n_words and weight of each document of the stored chunks."""
    known = words.join(F.broadcast(gain), "bucket").select("feature", "gain")
    rows = own.filter("feature is not null").select("feature", "chunk", "docs", "counts").join(known, "feature").select("chunk", "docs", "counts", "gain")
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    rows = rows.select("*", none("doc_id", "long"), none("at", "int"), none("n_features", "long"), none("n_words", "long"))
    heads = own.filter("at is not null").select("chunk", none("docs", "binary"), none("counts", "binary"), none("gain", "long"), "doc_id", "at", "n_features", "n_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, heads = np.zeros(CHUNK_DOCS, np.int64), []
        for batch in batches:
            is_head = batch.column("at").is_valid()
            heads.append(batch.filter(is_head).select(["doc_id", "at", "n_features", "n_words"]))
            part = batch.filter(pa.compute.invert(is_head))
            if not part.num_rows:
                continue
            docs_of = np.frombuffer(b"".join(part.column("docs").to_pylist()), np.uint16)
            sizes = pa.compute.binary_length(part.column("docs")).to_numpy() // 2
            counts_of, counted = np.ones(len(docs_of), np.int64), pa.compute.binary_length(part.column("counts")).to_numpy() > 0
            counts_of[np.repeat(counted, sizes)] = np.frombuffer(b"".join(part.column("counts").to_pylist()), np.int32)
            sums += _sums(docs_of, counts_of * np.repeat(part.column("gain").to_numpy(), sizes))
        for head in heads:
            at, n = head.column("at").to_numpy(), head.column("n_features").to_numpy()
            yield pa.RecordBatch.from_arrays([head.column("doc_id"), head.column("n_features"), head.column("n_words"), pa.array(sums[at] // np.maximum(n, 1))], names=["doc_id", "n_features", "n_words", "weight"])

    return rows.unionByName(heads).groupBy("chunk").applyInArrow(run, "doc_id long, n_features long, n_words long, weight long")


def noise(seed: str = SEED) -> Column:
    """Gumbel noise in thousandths, from a hash of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(scored: DataFrame, eligible: Column, percent: int = PERCENT) -> DataFrame:
    """scored (stored rows with score, doc_id and salt) with rank: 1, 2, 3... of the drawn rows, highest scores first, then smaller ids."""
    chosen = scored.filter(eligible)
    of_score = chosen.groupBy("score").agg(F.count("*").alias("_n"))
    # few rows: one a score
    higher = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    places = of_score.withColumn("_higher", F.coalesce(F.sum("_n").over(higher), F.lit(0))).join(F.broadcast(of_score.agg(F.floor(F.coalesce(F.sum("_n"), F.lit(0)) * percent / 100).alias("_drawn"))))
    places = places.filter("_higher < _drawn").select("score", "_higher", "_drawn")
    cell = [F.col("doc_id").asc_nulls_last(), F.col("salt")]
    before = Window.partitionBy("score").orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    cells = chosen.join(F.broadcast(places), "score").groupBy("score", "doc_id", "salt", "_higher", "_drawn").agg(F.count("*").alias("_n"))
    cells = cells.withColumn("_before", F.col("_higher") + F.coalesce(F.sum("_n").over(before), F.lit(0))).filter("_before < _drawn").select(F.col("score").alias("_score"), F.col("doc_id").alias("_doc_id"), F.col("salt").alias("_salt"), "_before", "_drawn")
    same = (F.col("score") == F.col("_score")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("salt") == F.col("_salt")) & eligible
    joined = scored.join(cells, same, "left")
    number = F.row_number().over(Window.partitionBy("score", "doc_id", "salt", eligible).orderBy("n_features"))
    place = F.col("_before") + number
    return joined.withColumn("rank", F.when(place <= F.col("_drawn"), place)).drop("_score", "_doc_id", "_salt", "_before", "_drawn")


def resample(docs: DataFrame, target: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS, percent: int = PERCENT, least: int = LEAST, seed: str = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document (doc_id, text); target: rows with a text. rank is null where a document isn't drawn."""
    spark = docs.sparkSession
    own = stored(spark, chunks(docs, grams), "chunks")
    wanted = chunks(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), grams)
    words = stored(spark, dictionary(own, wanted, buckets), "dictionary")
    scored = weighed(own, words, gains(words, buckets)).withColumn("score", F.col("weight") + noise(seed)).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return ranked(stored(spark, scored, "scored"), F.col("n_words") >= least, percent).select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


def drawn_documents(docs: DataFrame, target: DataFrame, **how: int) -> DataFrame:
    """The documents that are drawn, whole, with their other columns. Ids must be there and stand once."""
    drawn = resample(docs, target, **how).filter("rank is not null").select("doc_id")
    return docs.join(drawn, "doc_id", "left_semi")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = f"""
with bits as (
  select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, cast(i as bigint))) as crc),
docs as (select row_number() over () as r, doc_id, {words_sql('text')} as w from documents),
used as (select r, unnest(w) as f from docs),
wanted as (select unnest({words_sql('text')}) as f from benchmark),
counted as (select f, cast(sum(s) as bigint) as s, cast(sum(t) as bigint) as t from (
  select f, count(*) as s, 0 as t from used group by f union all select f, 0, count(*) from wanted group by f) group by f),
hashed as (
  select f, s, t, xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda x: cast('0x' || x as bigint)),
    lambda c, x: xor(bits.crc[(xor(c, x) & 255) + 1], c >> 8), cast(4294967295 as bigint))) % {BUCKETS} as bucket from counted, bits),
gain as (
  select bucket, cast(floor(1000 * ln((sum(t) + 1.0::double) * ((select sum(s) from counted) + {BUCKETS}.0::double) / ((sum(s) + 1.0::double) * ((select sum(t) from counted) + {BUCKETS}.0::double)))) as bigint) as g
  from hashed group by bucket),
weights as (
  select r, sum(g) as total, count(*) as n from used join hashed using (f) join gain using (bucket) group by r),
scored as (
  select r, doc_id, len(w) as n_features, coalesce(cast((total - (total % n + n) % n) // n as bigint), 0) as weight,
         cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('{SEED}:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) + 0.5::double) / 4294967296.0::double))) as bigint) as noise
  from docs left join weights using (r)),
placed as (
  select r, row_number() over (order by weight + noise desc, doc_id nulls last) as place, count(*) over () as n from scored where n_features >= {LEAST})
select doc_id, cast(n_features as bigint) as n_features, weight, weight + noise as score, cast(case when place <= n * {PERCENT} // 100 then place end as bigint) as rank
from scored left join placed using (r)
"""
