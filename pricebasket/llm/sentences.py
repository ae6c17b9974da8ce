"""Substring deduplication by sliding sentence spans.

A text is cut into sentences (each with its closing marks and the white space after them; together they are the text);
a sentence of more than LONG words is cut at its clause marks, and the parts count as sentences. From every sentence a
run of consecutive sentences is hashed: two at least, and as many as hold WORDS words (WORDS sentences at most, should they hold fewer words). A
text of fewer words than that is one run; the last sentences of others, which begin no run, are in earlier ones. Runs
are joined globally by their hash, and every sentence is removed that a repeated run covers, unless the run is its first
occurrence (the smallest id, then the first place in the text).

Runs that occur once are told by a partial count of each hash, so a passage in a third of all rows costs a few rows a
task; an equi-join with one row a hash, whose skewed partitions Spark splits, finds the others, and a partial minimum
their first occurrence.

Runs compare by a hash of 128 bits of their sentences without outer white space. Null and empty texts have no sentences
and stay as they are. Rows of one id (or none) are told apart by a hash of their text; rows equal in both are one
document. Empty tables give empty results; other columns pass through untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricebasket.llm.common import Batches, documents, map_batches, stored, whole_text

#: Words that a run holds at least, sentences likewise; words of a sentence beyond which it is cut at clause marks.
WORDS, RUN, LONG = 20, 2, 15
#: A sentence: what comes before closing marks or line ends, these, and white space; or the rest. A clause likewise.
SENTENCE = re.compile(rb"[^.!?\n]*+[.!?\n]++[ \t\r\n\f\v]*+|[^.!?\n]++")
CLAUSE = re.compile(rb"[^,;:]*+[,;:]++[ \t\r\n\f\v]*+|[^,;:]++")


def sentences(text: bytes, long: int = LONG) -> tuple[list[bytes], list[int]]:
    """The text's sentences, those of more than `long` words as their clauses; and their words."""
    found, counts = [], []
    for s in SENTENCE.findall(text):
        n = len(s.split())
        parts = CLAUSE.findall(s) if n > long else [s]
        found += parts
        counts += [n] if len(parts) == 1 else [len(p.split()) for p in parts]
    return found, counts


def runs(counts: list[int], words: int = WORDS) -> Iterator[tuple[int, int]]:
    """Begin and end of the run from each sentence that has one."""
    sums, most, n, end = [0, *accumulate(counts)], max(words, RUN), len(counts), 0
    for begin in range(n):
        while end < n and (end < begin + RUN or sums[end] - sums[begin] < words and end < begin + most):
            end += 1
        if end - begin >= RUN and (sums[end] - sums[begin] >= words or end - begin == most):
            yield begin, end
        else:
            if begin == 0:
                yield 0, n
            return


def sentence_spans(df: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, _row (a hash of the text), at (place of the first sentence), k (sentences), and the hash h1, h2 of every run of sentences."""
    names = ["doc_id", "_row", "at", "k", "h1", "h2"]

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, at, k, hashes = [], [], [], []

            def made() -> pa.RecordBatch:
                h = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
                held = pa.array(own, pa.int64())
                columns = [batch.column(c).take(held) for c in names[:2]] + [pa.array(at, pa.int32()), pa.array(k, pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1])]
                for x in (own, at, k, hashes):
                    x.clear()
                return pa.RecordBatch.from_arrays(columns, names)

            for i, text in enumerate(batch.column("text")):
                found, counts = sentences(text.as_py().encode())
                bare = [s.strip() for s in found]
                for begin, end in runs(counts, words):
                    own.append(i)
                    at.append(begin)
                    k.append(end - begin)
                    hashes.append(xxhash.xxh3_128_digest(b"\n".join(bare[begin:end])))
                if len(own) > 50_000:
                    yield made()
            yield made()

    rows = df.select("doc_id", F.xxhash64(whole_text()).alias("_row"), "text").filter("length(text) > 0")
    return map_batches(rows, run, f"{df.select('doc_id').schema.simpleString()[7:-1].replace(':', ' ')}, _row long, at int, k int, h1 long, h2 long")


def drop_repeated_sentences(df: DataFrame, words: int = WORDS) -> DataFrame:
    """df with text reduced to what stays, and n_sentences and n_removed."""
    spans, own = sentence_spans(df, words), F.struct("doc_id", "_row", "at")
    several = spans.groupBy("h1", "h2").agg(F.count("*").alias("_n")).filter("_n > 1").select("h1", "h2")
    repeated = stored(df.sparkSession, spans.join(several, ["h1", "h2"]), "repeated-runs")
    firsts = repeated.groupBy("h1", "h2").agg(F.min(own).alias("_first"))
    later = repeated.join(firsts, ["h1", "h2"]).filter(~own.eqNullSafe(F.col("_first")))
    covered = later.groupBy(F.col("doc_id").alias("_id"), F.col("_row").alias("_row_of")).agg(F.collect_set(F.struct("at", "k")).alias("_runs"))
    others = [c for c in df.columns if c not in ("text", "n_sentences", "n_removed", "_row", "_id", "_row_of", "_runs")]
    rows = df.select(*others, "text").withColumn("_row", F.xxhash64(whole_text()))
    kept = rows.join(covered, rows["doc_id"].eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_row_of")), "left").select(*others, "text", "_runs")
    schema = df.select(*others, "text").schema.add("n_sentences", "long").add("n_removed", "long")

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_rest(t.as_py(), r.as_py()) for t, r in zip(batch.column("text"), batch.column("_runs"), strict=True)]
            columns = [batch.column(c) for c in others]
            columns += [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    return map_batches(kept, run, schema)


def _rest(text: str | None, runs: list[dict] | None) -> tuple[str | None, int, int]:
    """What stays of a text; how many sentences it has, and how many go."""
    found, _ = sentences((text or "").encode())
    gone = {i for r in runs or () for i in range(r["at"], r["at"] + r["k"])}
    return b"".join(s for i, s in enumerate(found) if i not in gone).decode() if gone else text, len(found), len(gone)


def op3_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_sentences(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(F.col("doc_id").cast("long"), "n_sentences", "n_removed", F.sha2(whole_text(), 256).alias("kept_sha256"))


OP3_SQL = rf"""
with whole as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^.!?\n]*[.!?\n]+[ \t\r\n\f\v]*|[^.!?\n]+') as s from documents),
cut as (
  select doc_id, flatten(list_transform(s, lambda x: case when len(regexp_extract_all(x, '[^ \t\r\n\f\v]+')) > {LONG}
                                              then regexp_extract_all(x, '[^,;:]*[,;:]+[ \t\r\n\f\v]*|[^,;:]+') else [x] end)) as s from whole),
counted as (
  select doc_id, s, list_transform(s, lambda x: len(regexp_extract_all(x, '[^ \t\r\n\f\v]+'))) as w from cut where len(s) > 0),
starts as (
  select doc_id, s, w, unnest(range(len(s))) as pos from counted),
sized as (
  select doc_id, s, pos, coalesce(
    list_filter(range({RUN}, least({WORDS}, len(s) - pos) + 1), lambda k: k = {WORDS} or list_sum(w[pos + 1 : pos + k]) >= {WORDS})[1],
    case when pos = 0 then len(s) end) as k from starts),
runs as (
  select doc_id, pos, k, array_to_string(list_transform(s[pos + 1 : pos + k], lambda x: trim(x, e' \t\r\n\f' || chr(11))), e'\n') as run from sized where k is not null),
nths as (
  select doc_id, pos, k, row_number() over (partition by run order by doc_id, pos) as nth from runs),
later as (select distinct doc_id, unnest(range(pos, pos + k)) as pos from nths where nth > 1),
kept as (
  select e.doc_id, count(l.pos) as n_removed, coalesce(string_agg(e.s[e.pos + 1], '' order by e.pos) filter (where l.pos is null), '') as kept
  from starts e left join later l on l.doc_id = e.doc_id and l.pos = e.pos group by e.doc_id)
select c.doc_id, cast(len(c.s) as bigint) as n_sentences, cast(coalesce(k.n_removed, 0) as bigint) as n_removed,
       sha256(coalesce(k.kept, '')) as kept_sha256
from cut c left join kept k using (doc_id)
"""
