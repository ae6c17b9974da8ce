"""Exact top-k search by BM25: a stored inverted index in shards, block-max WAND in each, an exact merge by global statistics.

Index: SHARD documents make a shard, one row of a stored table: postings by term, documents numbered by likeness (those
with the same most frequent term stand together, by length, so that blocks differ in what they hold). It is built once for all queries;
the texts are read once, as document frequencies, lengths and counts of all documents come from it.

Search, in each shard, TOGETHER queries at once: documents stand in groups of GROUP and blocks of BLOCK. A term in more than a share of
COMMON of a group's documents is common there (long documents stand together and have many such terms, short ones few). Common terms
come before the pivot: at first only their greatest impacts in each block count. The terms from the pivot on are the rare ones, whose postings are
added up by document. Blocks are skipped in which the greatest such sum and the bounds of the common terms, for all queries from a product of
two small matrices, don't reach a query's k-th best score. For queries with blocks left in a group, what common terms add to its
documents takes the place of the bounds, by a product of matrices too; what still reaches the k-th best score, hardly more than what is
found, is scored in full from its own terms. Scores are added in one order of terms, so equal documents tie.

Shards are searched in rounds, first as many as can be side by side, then GROWTH - 1 times as many as before at most: the k-th best scores so far are where a
round starts, so rows that leave a later round are some k (GROWTH - 1) a query, whatever the number of shards. Shards return k rows a query at most, which
are merged by score (then the smaller id). Document frequencies, lengths and counts are those of all documents.

Queries run in groups of TERMS terms, about; a group's terms are broadcast, its results stored, and the broadcast dropped
before the next, so what the driver holds is bounded whatever the number of queries. Each group reads the index once, over all rounds.

Terms are runs of ASCII letters, digits and other than ASCII characters, in lower case as far as ASCII goes, by 64-bit hash. Null
and empty texts have none: they are never found, and as queries find nothing. Rows without an id can't be named in a
result: they are left out, as documents and as queries. Repeated rows are found each; ties go to the smaller id. Empty tables
give empty results. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricebasket.llm.common import Batches, documents, map_batches, stored, whole_text
from pricebasket.llm.hashing import mix, signed, span_hashes, together

K1, B, K = 1.2, 0.75, 10
#: Documents of a block, of a group and of a shard; terms of queries that run together, about; how many times as many shards have been searched after a round.
BLOCK, GROUP, SHARD, TERMS, GROWTH = 128, 1024, 16_000, 2_000_000, 4
#: Shards of the first round at most; there are as many as can be searched side by side.
FIRST = 16
#: Terms by which documents are alike.
HEADS = 64
#: The share of a group's documents above which a term is common there, the most such terms of a group (others are as rare ones), and queries searched together.
COMMON, COMMON_TERMS, TOGETHER = 0.05, 1280, 256
#: What sums of 4-byte floats may be off by, as a share (COMMON_TERMS roundings of 2 ** -24 each at most, and some more).
ROUGH = 1e-4
#: What a score to reach may be off by once it is a 4-byte float, and the least that counts as one.
SLACK, TINY = 1e-6, 1e-30
#: A posting of a term that is not common where it is.
POSTING = np.dtype([("doc", "<u4"), ("impact", "<f4")])
_U = np.uint64


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, occurrences) of the different terms of each text, and each text's length in terms."""
    lower = data + ((data >= 65) & (data <= 90)) * np.uint8(32)
    word = ((lower >= 97) & (lower <= 122)) | ((lower >= 48) & (lower <= 57)) | (lower >= 128)
    ends = np.zeros(len(data) + 1, bool)
    ends[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    starts = np.flatnonzero(word & (~before | ends[:-1]))
    stops = np.flatnonzero(word & (~after | ends[1:])) + 1
    text = np.searchsorted(offsets, starts, "right") - 1
    hashes = span_hashes(lower, starts, stops)
    order = np.argsort(hashes)
    order = order[np.argsort(text[order].astype(np.uint32), kind="stable")]
    text_of, hashes = text[order], hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = (text_of[1:] != text_of[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return text_of[at], signed(hashes[at]), np.diff(np.append(at, len(order))), np.bincount(text, minlength=len(offsets) - 1)


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term and occurrences of each query."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = [t.as_py().encode() for t in batch.column("text")], batch.column("doc_id")
            for first, _, data, offsets in together(texts):
                text, term, count, _ = terms(data, offsets)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(text + first)), pa.array(term), pa.array(count)], ["query_id", "term", "count"])

    return map_batches(queries, run, "query_id long, term long, count long")


INDEX = {"ids": "<i8", "lengths": "<i8", "terms": "<i8", "first": "<i8", "doc": "<u2", "count": "<u4"}


def shard_row(ids: np.ndarray, lengths: np.ndarray, doc: np.ndarray, term: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    """One shard's postings: documents numbered by likeness, postings by term and then by document."""
    # the most frequent in a document of the HEADS terms that most documents have; then its length
    order = np.argsort(term, kind="stable")
    by_term = term[order]
    new = np.append(True, by_term[1:] != by_term[:-1]) if len(term) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    terms = by_term[first]
    del by_term
    heads = np.argsort(-np.diff(np.append(first, len(term))), kind="stable")[:HEADS]
    likeness, most = np.full(len(ids), len(heads)), np.zeros(len(ids), np.int64)
    for k, t in enumerate(heads):
        own = order[first[t] : np.append(first, len(term))[t + 1]]
        own = own[count[own] > most[doc[own]]]
        likeness[doc[own]], most[doc[own]] = k, count[own]
    by = np.lexsort((ids, lengths, likeness))
    place = np.empty(len(ids), np.int32)
    place[by] = np.arange(len(ids))
    key = (np.cumsum(new) - 1) * len(ids) + place[doc[order]]  # by term, then by document
    within = np.argsort(key)
    count = count[order[within]]
    del order
    held = {"ids": ids[by], "lengths": lengths[by], "terms": terms, "first": np.append(first, len(term)), "doc": key[within] % max(1, len(ids)), "count": count}
    del key, within
    columns = []
    for k, kind in INDEX.items():
        data = pa.py_buffer(held.pop(k).astype(kind))
        columns.append(pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, data.size], np.int32)), data]))
    return pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_64_intdigest(columns[0][0].as_py()) >> 1], pa.int64()), *columns], ["shard", *INDEX])


def build_index(docs: DataFrame) -> DataFrame:
    """A row for each shard of (doc_id, text)."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        held = 0

        def made() -> pa.RecordBatch:
            base = np.cumsum([0, *(len(p[0]) for p in parts)])
            columns = [np.concatenate([p[k] + np.int32(b) if k == 2 else p[k] for p, b in zip(parts, base, strict=False)]) for k in range(5)]
            parts.clear()
            return shard_row(*columns)

        for batch in batches:
            texts, ids = [t.as_py().encode() for t in batch.column("text")], batch.column("doc_id").to_numpy()
            for first, last, data, offsets in together(texts):
                doc, term, count, length = terms(data, offsets)
                parts.append((ids[first:last], length, doc.astype(np.int32), term, count.astype(np.int32)))
                held += last - first
            if held >= SHARD:
                yield made()
                held = 0
        if parts:
            yield made()

    return map_batches(docs, run, "shard long, " + ", ".join(f"{k} binary" for k in INDEX))


def statistics(index: DataFrame) -> DataFrame:
    """term, n: in how many documents of the index it is; as term null the number of documents, and in `total` their length."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                lengths, terms, first = (np.frombuffer(batch.column(c)[row].as_buffer(), INDEX[c]) for c in ("lengths", "terms", "first"))
                whole = np.arange(len(terms) + 1) == 0
                yield pa.RecordBatch.from_arrays([pa.array(np.append(0, terms), mask=whole), pa.array(np.append(len(lengths), np.diff(first))), pa.array(whole * lengths.sum())], ["term", "n", "total"])

    return map_batches(index.select("lengths", "terms", "first"), run, "term long, n long, total long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers first[i], first[i] + 1, ... of each range, one after another."""
    return np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


class ShardIndex:
    """A shard as it is searched: for each group of documents its common terms' impacts by document with the greatest of each block; the other postings by term; each document's terms."""

    def __init__(self, row: dict[str, bytes | pa.Buffer], mean: float) -> None:
        held = {k: np.frombuffer(row[k], kind) for k, kind in INDEX.items()}
        self.ids, self.terms = held["ids"], held["terms"]
        doc, self.number = held["doc"].astype(np.int32), np.diff(held["first"])
        share = held["lengths"] / mean if mean else np.ones(len(self.ids))
        impact = (1 - B + B * share)[doc]
        impact *= K1
        impact += held["count"]
        np.divide(held["count"] * (K1 + 1), impact, out=impact)
        self.blocks = -(-len(self.ids) // BLOCK)
        term = np.repeat(np.arange(len(self.terms), dtype=np.int32), self.number)
        # postings of a term in a group of documents are a run; those of many documents are common there
        group = doc // GROUP
        start = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (group[1:] != group[:-1]))) if len(term) else np.zeros(0, np.int64)
        size, of = np.diff(np.append(start, len(term))), group[start]
        del group
        common = size > COMMON * np.minimum(GROUP, len(self.ids) - GROUP * of)
        self.groups: list[tuple[slice, np.ndarray, np.ndarray]] = []  # documents, common terms' columns, impacts by document
        runs_of = np.split(runs := np.flatnonzero(common)[np.argsort(of[common], kind="stable")], np.searchsorted(of[runs], np.arange(1, -(-len(self.ids) // GROUP))))
        for g, runs in enumerate(runs_of):
            common[runs[np.argsort(-size[runs], kind="stable")[COMMON_TERMS:]]] = False
            runs_of[g] = runs[common[runs]]
        self.column = np.full(len(self.terms), -1)
        used = np.unique(term[start[common]])
        self.column[used] = np.arange(len(used))
        self.greatest = np.zeros((len(used), self.blocks), np.float32)  # of each block, by column
        for g, runs in enumerate(runs_of):
            first, last = g * GROUP, min((g + 1) * GROUP, self.blocks * BLOCK)
            by_doc = np.zeros((len(runs), last - first), np.float32)
            post = _ranges(start[runs], size[runs])
            by_doc[np.repeat(np.arange(len(runs)), size[runs]), doc[post] - first] = impact[post] * (1 + ROUGH)
            columns = self.column[term[start[runs]]]
            self.groups.append((slice(first, last), columns, by_doc))
            self.greatest[columns, first // BLOCK : last // BLOCK] = by_doc.reshape(len(runs), (last - first) // BLOCK, BLOCK).max(axis=2)
        rare = np.repeat(~common, size)
        del start, size, of, common
        self.rare = np.empty(int(rare.sum()), POSTING)
        self.rare["doc"], self.rare["impact"] = doc[rare], impact[rare] * (1 + ROUGH)
        self.rare_number = np.bincount(term[rare], minlength=len(self.terms))
        self.rare_first = np.cumsum(self.rare_number) - self.rare_number
        by = np.argsort(held["doc"], kind="stable")  # by document, its terms in order
        self.doc_term, self.doc_impact = term[by], impact[by]
        self.doc_first = np.append(0, np.cumsum(np.bincount(doc, minlength=len(self.ids))))
        self.weight = np.zeros(len(self.terms))  # of one query's terms, while its documents are scored
        # postings looked at (what the products of common terms take is not counted), those that the queries' terms have, and documents in products, over all queries
        self.looked = self.held = self.multiplied = 0

    def find(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of those of the terms that the shard has, and which they are."""
        at = np.minimum(np.searchsorted(self.terms, term), max(0, len(self.terms) - 1))
        known = self.terms[at] == term if len(self.terms) else np.zeros(len(term), bool)
        return at[known], known

    def search(self, term: np.ndarray, weight: np.ndarray, k: int, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best of at least `least`; term: places of the query's terms, in their order."""
        return self.search_all([(term, weight)], k, np.array([least]))[0]

    def search_all(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, least: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """What search finds for each of the queries (places, weights)."""
        sums, least = np.empty((len(queries), self.blocks * BLOCK), np.float32), least.copy()
        for q, query in enumerate(queries):
            sums[q] = self._added(*query)
        of, term, weight = np.repeat(np.arange(len(queries)), [len(t) for t, _ in queries]), *(np.concatenate(x) for x in zip(*queries, strict=True))
        self.held += int(self.number[term].sum())
        column = self.column[term]
        weights = np.zeros((len(self.greatest), len(queries)), np.float32)
        weights[column[column >= 0], of[column >= 0]] = weight[column >= 0]
        new = np.flatnonzero(least <= 0)
        if len(new):
            whole = sums[new]
            for docs, columns, by_doc in self.groups:
                whole[:, docs] += weights[np.ix_(columns, new)].T @ by_doc
            least[new] = [self._reached(x * (1 - 2 * ROUGH), k) for x in whole]
        bar = np.maximum(least * (1 - SLACK), TINY).astype(np.float32)[:, None]
        # blocks that can't reach it are skipped: sums of the rare terms' postings, and bounds of the common ones
        reach = weights.T @ self.greatest
        reach += np.maximum.reduceat(sums, np.arange(0, self.blocks * BLOCK, BLOCK), axis=1)
        left = reach >= bar
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
        for docs, columns, by_doc in self.groups:
            own = np.flatnonzero(left[:, docs.start // BLOCK : docs.stop // BLOCK].any(axis=1))
            if len(own):
                heavy = weights[columns]
                most = (heavy if len(own) == len(queries) else heavy.take(own, axis=1)).T @ by_doc
                most += sums[own, docs]
                self.multiplied += most.size
                q, at = np.divmod(np.flatnonzero(most >= bar[own]), docs.stop - docs.start)
                found.append((own[q], at + docs.start, most[q, at]))
        of, alive, most = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(of, kind="stable")
        ends = np.searchsorted(of[order], np.arange(len(queries) + 1))
        return [self._best(*query, k, float(x), alive[order[a:b]], most[order[a:b]]) for query, x, a, b in zip(queries, least, ends, ends[1:], strict=False)]

    def _best(self, term: np.ndarray, weight: np.ndarray, k: int, least: float, alive: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best of these documents, whose scores are `most` but for a share of 2 ROUGH."""
        if not len(alive):
            return self.ids[:0], np.zeros(0)
        if len(alive) > 2 * k:
            least = max(least, self._reached(most * (1 - 2 * ROUGH), k))
            alive = alive[most >= least * (1 - SLACK)]
        scores = self._score(term, weight, alive)
        good = np.flatnonzero((scores >= least) & (scores > 0))
        ids, scores = self.ids[alive[good]], scores[good]
        best = np.lexsort((ids, -scores))[:k]
        return ids[best], scores[best]

    def _added(self, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """What the postings of these terms that are not common where they are add to each document's score."""
        size = self.rare_number[term]
        post = self.rare.view(np.int64).take(_ranges(self.rare_first[term], size)).view(POSTING)
        self.looked += len(post)
        return np.bincount(post["doc"], post["impact"] * np.repeat(weight.astype(np.float32), size), self.blocks * BLOCK)

    def _reached(self, low: np.ndarray, k: int) -> float:
        """What k documents reach, given what each reaches at least."""
        return max(0.0, float(np.partition(low, len(low) - k)[-k]) * (1 - SLACK)) if len(low) >= k else 0.0

    def _score(self, term: np.ndarray, weight: np.ndarray, alive: np.ndarray) -> np.ndarray:
        """Scores of these documents in full, added in the order of the terms."""
        self.weight[term] = weight
        n = self.doc_first[alive + 1] - self.doc_first[alive]
        post = _ranges(self.doc_first[alive], n)
        added = self.doc_impact[post] * self.weight[self.doc_term[post]]
        self.weight[term] = 0
        self.looked += int(np.count_nonzero(added))
        return np.bincount(np.repeat(np.arange(len(alive)), n), added, len(alive))


def top_k(docs: DataFrame, queries: DataFrame, k: int = K, at_once: int = TERMS) -> DataFrame:
    """query_id, rank, doc_id, score: the k documents of docs with the best BM25 score for each id of queries (both: doc_id, text).
    Where one query id has several texts, the smallest is asked for; documents of one id are documents each."""
    spark = docs.sparkSession
    docs, queries = (x.select(F.col("doc_id").cast("long"), whole_text().alias("text")).filter("doc_id is not null") for x in (docs, queries))
    index = stored(spark, build_index(docs), "index")
    known = stored(spark, statistics(index), "statistics")
    whole = known.filter("term is null").first()
    n, mean = (whole["n"], whole["total"] / whole["n"]) if whole else (0, 0.0)
    idf = F.log(1 + (F.lit(n) - F.col("n") + 0.5) / (F.col("n") + 0.5))
    asked = query_terms(queries.groupBy("doc_id").agg(F.min("text").alias("text")))
    weighed = stored(spark, asked.join(known.filter("term is not null").select("term", "n"), "term").select("query_id", "term", (F.col("count") * idf).alias("weight")), "query-terms")
    shards = sorted(r[0] for r in index.select("shard").distinct().collect())  # a number for SHARD documents, about
    ends, at_first = [0], min(FIRST, spark.sparkContext.defaultParallelism)
    while ends[-1] < len(shards):
        ends.append(min(len(shards), max(at_first, GROWTH * ends[-1])))
    rounds = [index.filter(F.col("shard").between(shards[a], shards[b - 1])) for a, b in zip(ends, ends[1:], strict=False)]
    groups = max(1, -(-weighed.count() // at_once))
    found = [_group(rounds, weighed.filter(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g), mean, k) for g in range(groups if rounds else 0)]
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    none = spark.createDataFrame([], "query_id long, doc_id long, score double")
    return reduce(DataFrame.unionByName, found, none).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def _group(rounds: list[DataFrame], weighed: DataFrame, mean: float, k: int) -> DataFrame:
    """query_id, doc_id, score: each shard's best for a group of queries, stored."""
    spark, table = weighed.sparkSession, weighed.toArrow()
    query, term, weight = (table.column(c).to_numpy() for c in ("query_id", "term", "weight"))
    order = np.lexsort((term, query))
    query, term, weight = query[order], term[order], weight[order]
    ids, begins = np.unique(query, return_index=True)
    known, term = np.unique(term, return_inverse=True)
    shared = spark.sparkContext.broadcast((ids, np.append(begins, len(query)), known, term.astype(np.int32), weight))
    found: list[DataFrame] = []
    least = np.zeros(len(ids))
    for shards in rounds:
        if found:
            so_far = reduce(DataFrame.unionByName, found)
            reached = so_far.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), False).alias("s")).filter(F.size("s") >= k).select("query_id", F.get("s", F.lit(k - 1)).alias("s")).toArrow()
            least[np.searchsorted(ids, reached.column("query_id").to_numpy())] = reached.column("s").to_numpy()
        found.append(stored(spark, _searched(shards, shared, least.copy(), mean, k), "found"))
    shared.unpersist()
    return reduce(DataFrame.unionByName, found)


def _searched(index: DataFrame, shared: Broadcast, least: np.ndarray, mean: float, k: int) -> DataFrame:
    reached = index.sparkSession.sparkContext.broadcast(least)

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        (ids, begins, known, term, weight), least = shared.value, reached.value
        for batch in batches:
            for row in range(batch.num_rows):
                shard = ShardIndex({c: batch.column(c)[row].as_buffer() for c in INDEX}, mean)
                place = np.full(len(known), -1)
                at, held = shard.find(known)
                place[held] = at
                out: list[list] = [[], [], []]
                for a in range(0, len(ids), TOGETHER):
                    asked = []
                    for q in range(a, min(len(ids), a + TOGETHER)):
                        at = place[term[begins[q] : begins[q + 1]]]
                        asked.append((at[at >= 0], weight[begins[q] : begins[q + 1]][at >= 0]))
                    for q, (found, scores) in enumerate(shard.search_all(asked, k, least[a : a + TOGETHER]), a):
                        for column, values in zip(out, (np.full(len(found), ids[q]), found, scores), strict=True):
                            column.append(values)
                del shard  # before the next one is built
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["query_id", "doc_id", "score"])

    return map_batches(index.drop("shard"), run, "query_id long, doc_id long, score double")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return top_k(docs, docs.filter("doc_id % 50 = 0")).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))
