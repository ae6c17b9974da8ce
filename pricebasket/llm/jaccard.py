"""N-gram Jaccard join with adaptive multi-match prefixes; near-duplicate components.

A document's set is its distinct WIDTH-word shingles. Documents link at a Jaccard similarity of 0.8 or more.

1. Sets. One pass hashes words and shingles (numpy, many texts at a time), counts each set and takes its digest; equal
   sets are one node from here on. The pass also counts shingles that several sets of a task have; the FREQUENT most frequent
   ones are broadcast, as an order: what is found doesn't hang on it, only how fast.
2. Prefixes. Every set is ordered alike: rare shingles by their hash, then frequent ones by rising frequency. Two sets
   that overlap in at least c of n shingles share l of the first n - c + l, for every l. A document's l is
   lengthened from 1 while its prefix's estimated candidates, over l, fall; a pair then must share l or more (see candidates).
3. Candidates. Prefix shingles are dealt out, sorted and streamed. A shingle of few sets gives its pairs within the
   size bounds; pairs are counted by a partial aggregate. A shingle of more than PAIRED sets gives no pairs: it becomes
   a block, whose sets are compared in tasks (in parts beyond BLOCK sets: each two parts meet in one task).
4. Verification. Candidates that hang together by pairs and blocks are a group; each group's whole sets are dealt to one
   task, once, and overlaps counted exactly. Sets that a task has in one component already aren't compared, so a large
   group of like sets costs one pass over it. A group of more than BLOCK shingles is dealt out by its pairs and blocks
   instead, a block of more in parts of which each two meet in one task. A task returns a spanning forest of its links, not
   all links: the components are the same.
5. Components by stars (components.py), then back from sets to documents.

Null and empty texts, and those without words, have no shingles, link with nothing and are their own component; fewer
than WIDTH words are one shingle. Repeated rows have equal sets. Rows of one id (or none) are told apart by a hash of
their text; a component without any id has a null component_id. `one_of_each` keeps rows without an id, keeps or drops
rows of one id together if their sets hang together, and passes other columns through. Empty tables give empty results.
Very long texts are one set like others. Words and
shingles are compared by 64-bit hashes whose blocks are mixed one after the other; texts of equal hashes are taken as equal.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricebasket.llm.common import Batches, documents, map_batches, stored, whole_text
from pricebasket.llm.components import components
from pricebasket.llm.hashing import mix, signed, span_hashes, together

WIDTH = 5
#: Similarity of linked documents, in hundredths.
PERCENT = 80
#: Sets of one task that a shingle is in if it may be frequent.
FLOOR = 2
#: Frequent shingles that are kept, the most frequent ones: only their order hangs on it.
FREQUENT = 200_000
#: Sets that share a shingle and are paired at once; shingles of the sets that are compared in one task, about.
PAIRED, BLOCK = 40, 2_000_000
#: Values that a document's l can take; other sets that a rare shingle of a prefix leads to, about; what a row of a longer prefix costs.
LEVELS = (1, 2, 3, 5, 8, 12, 16, 24, 32)
RARE, ROW = 0.05, 0.05
_U = np.uint64


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of each text, in order of the text and then of the hash."""
    lower = data + ((data >= 65) & (data <= 90)) * np.uint8(32)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    ends = np.zeros(len(data) + 1, bool)
    ends[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    starts = np.flatnonzero(word & (~before | ends[:-1]))
    stops = np.flatnonzero(word & (~after | ends[1:])) + 1
    text = np.searchsorted(offsets, starts, "right") - 1
    words = span_hashes(lower, starts, stops)
    salts = mix(np.arange(1, width + 1, dtype=_U))
    n = max(0, len(words) - width + 1)
    sums = np.zeros(n, _U)
    for k in range(width):
        sums += words[k : k + n] * (salts[k] | _U(1))
    whole = text[:n] == text[width - 1 :] if n else np.zeros(0, bool)
    counts = np.bincount(text, minlength=len(offsets) - 1)
    few = np.flatnonzero((counts > 0) & (counts < width))
    first = np.cumsum(counts) - counts
    short = np.array([np.append(words[first[t] : first[t] + counts[t]] * (salts[: counts[t]] | _U(1)), salts[counts[t]]).sum(dtype=_U) for t in few], _U)
    own, hashes = np.concatenate([text[:n][whole], few]), np.concatenate([mix(sums[whole]), mix(short)]) >> _U(1)
    order = np.argsort(hashes)
    order = order[np.argsort(own[order].astype(np.uint32), kind="stable")]
    own, hashes = own[order], hashes[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (hashes[1:] != hashes[:-1])
    return own[new], hashes[new]


def least_overlap(n: int, m: int, percent: int = PERCENT) -> int:
    """The smallest overlap of sets of n and m that makes 100 * overlap >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def _batches(batches: Batches) -> Iterator[tuple[list[pa.Array], int, np.ndarray, np.ndarray]]:
    """doc_ids and hashes of the rows' texts, how many texts, and the shingles' texts and hashes, of runs of rows."""
    for batch in batches:
        texts = [t.as_py().encode() for t in batch.column("text")]
        for first, last, data, offsets in together(texts):
            ids = [batch.column(c).slice(first, last - first) for c in ("doc_id", "_row")]
            yield ids, last - first, *shingles(data, offsets)


def _digests(n: int, own: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and digests of the sets of n texts."""
    sizes, digests = np.bincount(own, minlength=n), np.zeros(n, _U)
    if len(own):
        filled = np.flatnonzero(sizes)
        digests[filled] = mix(np.add.reduceat(mix(hashes), (np.cumsum(sizes) - sizes)[filled]) + sizes[filled].astype(_U))
    return sizes, signed(digests)


def sets(docs: DataFrame) -> DataFrame:
    """doc_id, _row, n (shingles) and node (the set's digest) of each document; and rows without n: as doc_id a shingle and as node its count, for what is frequent in a task."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        seen, often = set(), Counter()
        names = ["doc_id", "_row", "n", "node"]
        for ids, n, own, hashes in _batches(batches):
            sizes, digests = _digests(n, own, hashes)
            yield pa.RecordBatch.from_arrays([*ids, pa.array(sizes), pa.array(digests)], names)
            new = np.array([d not in seen and not seen.add(d) for d in digests.tolist()], bool)
            values, counts = np.unique(hashes[new[own]], return_counts=True)
            twice = counts > 1
            often.update(dict(zip(values[twice].tolist(), counts[twice].tolist(), strict=True)))
            if len(often) > 4 * FREQUENT:
                often = Counter(dict(often.most_common(2 * FREQUENT)))
        found = [(h, c) for h, c in often.items() if c >= FLOOR]
        none = pa.nulls(len(found), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.int64()), none, none, pa.array([c for _, c in found], pa.int64())], names)

    return map_batches(docs, run, "doc_id long, _row long, n long, node long")


class Order:
    """Places shingles: rare ones by hash, then frequent ones by rising frequency."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        self.hashes, rank = np.sort(hashes), np.argsort(np.lexsort((hashes, counts)))
        order = np.argsort(hashes)
        self.rank, self.counts = rank[order].astype(_U), counts[order]

    def keys(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sort keys, and estimated numbers of other sets (0 for rare shingles)."""
        if not len(self.hashes):
            return hashes, np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known = self.hashes[at] == hashes
        return np.where(known, self.rank[at] | _U(1 << 63), hashes), np.where(known, self.counts[at], 0)


def prefixes(docs: DataFrame, order: Order, percent: int = PERCENT) -> DataFrame:
    """shingle, node, n and rest (shingles after the prefix) of each shingle in the prefix of each set."""
    shared = docs.sparkSession.sparkContext.broadcast(order)
    names = ["shingle", "node", "n", "rest"]

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        place, seen = shared.value, set()
        for _, n, own, hashes in _batches(batches):
            sizes, digests = _digests(n, own, hashes)
            new = np.array([d not in seen and not seen.add(d) for d in digests.tolist()], bool) & (sizes > 0)
            kept = new[own]
            own, hashes = own[kept], hashes[kept]
            keys, cost = place.keys(hashes)
            by = np.argsort(keys)
            by = by[np.argsort(own[by].astype(np.uint32), kind="stable")]
            own, hashes, cost, keys = own[by], hashes[by], cost[by], keys[by]
            sizes = np.where(new, sizes, 0)
            first = np.cumsum(sizes) - sizes
            base = sizes - -(-percent * sizes // 100)  # the prefix for l has base + l shingles
            sums = np.concatenate([[0.0], np.cumsum(cost)])
            best, least = np.ones(n, np.int64), np.full(n, np.inf)
            for l in LEVELS:
                end = np.minimum(first + base + l, first + sizes)
                price = (sums[end] - sums[first] + RARE * (base + l)) / l + ROW * l
                better = (price < least) & (base + l <= sizes)
                best[better], least[better] = l, price[better]
            position = np.arange(len(own)) - first[own]
            inside = position < (base + best)[own]
            own = own[inside]
            columns = [signed(hashes[inside]), digests[own], sizes[own].astype(np.int32), (sizes - np.minimum(sizes, base + best))[own].astype(np.int32)]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names)

    return map_batches(docs, run, "shingle long, node long, n int, rest int")


def candidates(prefix: DataFrame, percent: int = PERCENT, paired: int = PAIRED) -> DataFrame:
    """From rows sorted by shingle: pairs (a, b, shingles they need in common) of few sets; of more, blocks: (node, null, null, shingle).

    With x's prefix ending first in the order, what x and y share is in both prefixes or after x's. So two sets of sizes n and
    m that overlap enough share least_overlap(n, m) less the longer rest in their prefixes: l at least, more for like sizes.
    """
    names, names_in = ["a", "b", "need", "block"], ["shingle", "node", "n", "rest"]

    def pairs(group: list[tuple]) -> Iterator[tuple]:
        group.sort()
        for i, (n, a, rest) in enumerate(group):
            for m, b, other in group[i + 1 :]:
                if percent * m > 100 * n:
                    break
                yield min(a, b), max(a, b), max(1, least_overlap(n, m, percent) - max(rest, other)), None

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        now, group, large, out = None, {}, False, []

        def done() -> None:
            if large:
                out.extend((node, None, None, now) for node in group)
            elif len(group) > 1:
                out.extend(pairs([(n, node, rest) for node, (n, rest) in group.items()]))

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names)

        for batch in batches:
            # a shingle of one row has no pair; a batch's ends may go on in the next one
            own = batch.column("shingle").to_numpy()
            kept = np.zeros(len(own) + 1, bool)
            kept[1:-1] = own[1:] == own[:-1]
            kept = kept[1:] | kept[:-1]
            kept[[0, -1]] = True
            batch = batch.filter(pa.array(kept))
            for shingle, node, n, rest in zip(*(batch.column(c).to_pylist() for c in names_in), strict=True):
                if shingle != now:
                    done()
                    now, group, large = shingle, {}, False
                group[node] = (n, rest)
                if len(group) > paired:
                    large = True
                    out.extend((x, None, None, now) for x in group)
                    group = {}
                if len(out) > 20_000:
                    yield made()
                    out.clear()
        done()
        if out:
            yield made()

    return map_batches(prefix.repartition("shingle").sortWithinPartitions("shingle"), run, "a long, b long, need long, block long")


class _Group:
    """Sets that are compared in one task; components so far are labels. Each set's shingles stand rare ones first (rare in this
    group), so that two sets that link share one of their first ones: posting lists are made of these alone."""

    def __init__(self, members: list[np.ndarray], sides: list[int], percent: int) -> None:
        self.percent, self.side, self.sizes = percent, np.array(sides), np.array(list(map(len, members)))
        n, self.starts = len(members), np.cumsum(self.sizes) - self.sizes
        values, at = np.unique(np.concatenate(members), return_inverse=True)
        own, counts = np.repeat(np.arange(n), self.sizes), np.bincount(at)
        self.at = at[np.lexsort((at, counts[at], own))]
        self.first = self.sizes - -(-percent * self.sizes // 100) + 1
        inside = (np.arange(len(own)) - self.starts[own] < self.first[own]) & (counts[self.at] > 1)
        shingle, holder = self.at[inside], own[inside]
        order = np.argsort(shingle, kind="stable")
        self.posting, self.bounds = holder[order], np.searchsorted(shingle[order], np.arange(len(values) + 1))
        self.label, self.marked, self.within = np.arange(n), np.zeros(n, bool), np.zeros(len(values), bool)
        self.alike = np.zeros(len(values), bool)

    def settle(self) -> None:
        """Notes which posting lists are of one component: they lead to nothing new."""
        filled = np.flatnonzero(np.diff(self.bounds))
        if len(filled):
            labels, at = self.label[self.posting], self.bounds[filled]
            self.alike[filled] = np.minimum.reduceat(labels, at) == np.maximum.reduceat(labels, at)

    def links(self, i: int, among: np.ndarray) -> np.ndarray:
        """Sets of other components that set i links to, among those marked so."""
        mine = self.at[self.starts[i] : self.starts[i] + self.sizes[i]]
        head = mine[: self.first[i]]
        lists = [self.posting[self.bounds[v] : self.bounds[v + 1]] for v in head[~self.alike[head]].tolist()]
        if not lists:
            return np.zeros(0, np.int64)
        found = np.concatenate(lists)
        self.marked[found] = True
        near = np.flatnonzero(self.marked & among & (self.label != self.label[i]))
        self.marked[found] = False
        least, most = np.minimum(self.sizes[near], self.sizes[i]), np.maximum(self.sizes[near], self.sizes[i])
        near = near[(100 * least >= self.percent * most) & ((self.side[near] != self.side[i]) | (self.side[i] == 0))]
        if not len(near):
            return near
        sizes = self.sizes[near]
        base = np.cumsum(sizes) - sizes
        self.within[mine] = True
        overlap = np.add.reduceat(self.within[self.at[np.repeat(self.starts[near] - base, sizes) + np.arange(sizes.sum())]].astype(np.int64), base)
        self.within[mine] = False
        return near[100 * overlap >= self.percent * (sizes + self.sizes[i] - overlap)]

    def join(self, i: int, linked: np.ndarray) -> list[int]:
        """Puts i and what it links to in one component; one set of each component that was apart."""
        labels, one = np.unique(self.label[linked], return_index=True)
        self.label[np.isin(self.label, np.append(labels, self.label[i]))] = min(int(labels.min()), int(self.label[i]))
        return linked[one].tolist()

    def forest(self) -> Iterator[tuple[int, int]]:
        """Links that join all components: first of sets that none is known of, which settles large groups of like sets; then of
        those outside the largest component, with other components only."""
        n = len(self.sizes)
        free = np.ones(n, bool)
        for i in range(n):
            if free[i]:
                free[i] = False
                if len(linked := self.links(i, free)):
                    free[linked] = False
                    yield from ((i, j) for j in self.join(i, linked))
        every = np.ones(n, bool)
        labels, counts = np.unique(self.label, return_counts=True)
        left = np.flatnonzero(self.label != labels[counts.argmax()])
        anchor = int(np.flatnonzero(self.label == labels[counts.argmax()])[0])
        for k, i in enumerate(left.tolist()):
            if k % 500 == 0:
                self.settle()
            if self.label[i] != self.label[anchor] and len(linked := self.links(i, every)):
                yield from ((i, j) for j in self.join(i, linked))


def _forest(nodes: list[int], members: list[np.ndarray], sides: list[int], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets; of two parts (sides 1 and 2) only links across."""
    return [(nodes[i], nodes[j]) for i, j in _Group(members, sides, percent).forest()]


def verified(dealt: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Edges a, b from rows (to, side, node, members): sets dealt out to be compared with those of the same `to`."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        now, group = None, {}

        def done() -> pa.RecordBatch:
            nodes = list(group)
            found = _forest(nodes, [group[x][1] for x in nodes], [group[x][0] for x in nodes], percent) if len(nodes) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for to, side, node, members in zip(*(batch.column(c).to_pylist() for c in ("to", "side", "node", "members")), strict=True):
                if to != now:
                    yield done()
                    now, group = to, {}
                group[node] = (side, np.frombuffer(members, np.uint64))
        yield done()

    return map_batches(dealt.repartition("to").sortWithinPartitions("to"), run, "a long, b long")


def _dealt(texts: DataFrame) -> DataFrame:
    """A row for each place (to, side) where a document's set is wanted."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py().encode() for t in batch.column("text")]
            nodes, wanted = batch.column("node").to_pylist(), batch.column("_to").to_pylist()
            for first, last, data, offsets in together(texts):
                own, hashes = shingles(data, offsets)
                bounds = np.searchsorted(own, np.arange(last - first + 1))
                for i in range(first, last):
                    members = hashes[bounds[i - first] : bounds[i - first + 1]].tobytes()
                    for at in range(0, len(wanted[i]), 64):
                        some = wanted[i][at : at + 64]
                        columns = [pa.array([w["to"] for w in some], pa.int64()), pa.array([w["side"] for w in some], pa.int32()), pa.array([nodes[i]] * len(some), pa.int64()), pa.array([members] * len(some), pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, ["to", "side", "node", "members"])

    return map_batches(texts.select("node", "text", "_to"), run, "to long, side int, node long, members binary")


def _frequent(counted: DataFrame, most: int = FREQUENT) -> pa.Table:
    """About `most` rows of (doc_id: a shingle, c: its count), those with the highest counts: from counts of counts, so that no task sorts them all."""
    counted = stored(counted.sparkSession, counted.withColumn("level", F.floor(8 * F.log2("c")).cast("int")), "frequent")
    left, chosen = most, F.lit(False)
    for row in sorted(counted.groupBy("level").agg(F.count("*").alias("k")).collect(), reverse=True):  # eight levels each time that counts double
        share = min(1.0, left / row["k"])
        chosen = chosen | ((F.col("level") == row["level"]) & (F.xxhash64("doc_id") / F.lit(float(1 << 64)) + 0.5 <= share))
        left -= row["k"]
        if left <= 0:
            break
    return counted.filter(chosen).select("doc_id", "c").toArrow()


def near_duplicates(df: DataFrame, percent: int = PERCENT, paired: int = PAIRED, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of each row of (doc_id, text)."""
    spark = df.sparkSession
    docs = df.select(F.col("doc_id").cast("long"), F.xxhash64(whole_text()).alias("_row"), whole_text().alias("text"))
    found = stored(spark, sets(docs), "sets")
    known = found.filter("n is not null")
    often = _frequent(found.filter("n is null").groupBy("doc_id").agg(F.sum("node").alias("c")))
    order = Order(often.column("doc_id").to_numpy().view(np.uint64), often.column("c").to_numpy())
    some = stored(spark, candidates(prefixes(docs, order, percent), percent, paired), "candidates")
    pairs = some.filter("block is null").groupBy("a", "b", "need").agg(F.count("*").alias("k")).filter("k >= need")
    pairs = stored(spark, pairs.select("a", "b"), "pairs")
    members = stored(spark, some.filter("block is not null").select(F.col("a").alias("node"), "block").distinct(), "blocks")
    first = stored(spark, known.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.min(F.struct("doc_id", "_row")).alias("_one")), "nodes")
    # candidates that hang together, by pairs or blocks, meet in one task, each once; where they are too many, pair by pair and block by block
    stars = members.join(members.groupBy("block").agg(F.min("node").alias("b")), "block").select(F.col("node").alias("a"), "b")
    groups = components(pairs.unionByName(stars)).join(first.select("node", "n"), "node")
    small = groups.groupBy("component").agg(F.sum("n").alias("_n")).filter(F.col("_n") <= block).select("component")
    in_small = groups.join(small, "component").select("node", F.xxhash64(F.lit("group"), "component").alias("to"))
    apart = pairs.join(in_small.select(F.col("node").alias("a")), "a", "left_anti")
    of_pairs = in_small.unionByName(apart.select(F.explode(F.array("a", "b")).alias("node"), F.xxhash64("a", "b").alias("to"))).withColumn("side", F.lit(0))
    large = members.join(in_small.select("node"), "node", "left_anti").join(first.select("node", "n"), "node")
    parts = large.groupBy("block").agg(F.ceil(2 * F.sum("n") / block).cast("int").alias("_parts"))
    own = F.pmod(F.xxhash64("node"), F.col("_parts")).cast("int")
    # a block of several parts is dealt to every two of them; a part itself meets in (own, own)
    meets = F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), lambda j: F.struct(F.xxhash64("block", F.least(j, F.col("_own")), F.greatest(j, F.col("_own"))).alias("to"), F.when(j == F.col("_own"), 0).when(j > F.col("_own"), 1).otherwise(2).alias("side")))
    of_blocks = large.join(parts, "block").withColumn("_own", own).select("node", F.explode(meets).alias("_m")).select("node", "_m.to", "_m.side")
    wanted = of_pairs.unionByName(of_blocks).groupBy("node").agg(F.collect_list(F.struct("to", "side")).alias("_to"))
    wanted = wanted.join(first.select("node", F.col("_one.doc_id").alias("_id"), F.col("_one._row").alias("_row_of")), "node")
    edges = verified(_dealt(docs.join(wanted, docs["doc_id"].eqNullSafe(F.col("_id")) & (docs["_row"] == F.col("_row_of")))), percent)
    class_of = components(edges)
    labelled = first.select("node", F.col("doc_id").alias("_first")).join(class_of, "node", "left").withColumn("_label", F.coalesce("component", "node"))
    least = labelled.groupBy("_label").agg(F.min("_first").alias("component_id"))
    ids = stored(spark, labelled.join(least, "_label").select("node", "component_id"), "classes")
    return known.join(ids, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(df: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of df that stay: of each component the one with the smallest doc_id."""
    kept = near_duplicates(df, percent).filter("doc_id is null or component_id is null or doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    return df.join(kept, df["doc_id"].cast("long").eqNullSafe(kept["_kept"]), "left_semi")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
