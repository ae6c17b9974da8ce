"""Linking parsed items to lasting item series (L1, L2).

Only the keys of one bucket (outlet and portion size) are compared. Rows whose key is already known change nothing and
resolve by a null-safe join. What is left is what a fold in the order of month and page gives, as a new key joins its
bucket at once; a whole history links in one pass.

No bucket is gathered. Distinct keys that can reach the threshold are found by equi-joins of the new keys' rarest q-grams with an
inverted index of the stored keys' q-grams, and among themselves; each such pair is scored once. Which keys found series is then
decided in a few rounds of joins over those pairs (a key without an undecided earlier partner founds, and its later partners
don't) and then component by component. Each row takes the best of the keys that stood at its time, by a join with the few keys
that ever were a key's best.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricebasket.functions.similarity import ratio_from
from pricebasket.operators.graphs import components
from pricebasket.operators.store import item_id
from pricebasket.session import ship_package, stored
from pricebasket.settings import DEFAULTS, Settings

BUCKET = ["outlet_id", "size_value", "size_unit"]
LONGEST_GRAM = 3
#: Rounds before what is left is looked at by components; pairs of a component that one task folds, at most.
ROUNDS, TOGETHER = 2, 100_000
#: Rows that a task has together, about, so that its memory stays as it is when the rows grow.
ROWS_A_TASK = 250_000
#: Added where a bound is rounded, so that floating point loses no pair.
SLACK = 1e-6


def _gain(q: int, threshold: float) -> float:
    return (q - 0.5) * threshold - (q - 1)


def longest_gram(threshold: float) -> int:
    """The largest q for which two keys at the threshold are sure to share q-grams."""
    return max(n for n in range(1, LONGEST_GRAM + 1) if n == 1 or _gain(n, threshold) >= 0)


def grams_of(keys: DataFrame, q: int) -> DataFrame:
    """keys (with a key) with its length and its q-grams, a row each; one that recurs in a key counts each time, numbered."""
    mark = F.lit("\1" * (q - 1))
    padded, length = F.concat(mark, "key", mark), F.length("key")
    plain = F.transform(F.sequence(F.lit(1), length + (q - 1)), lambda i: F.substr(padded, i, F.lit(q)))
    numbered = lambda g, i: F.concat(g, F.lit("\2"), F.size(F.filter(F.slice(F.col("_grams"), F.lit(1), i + 1), lambda x: x == g)).cast("string"))
    return keys.withColumn("_grams", plain).select(*keys.columns, length.alias("length"), F.explode(F.transform("_grams", numbered)).alias("gram"))


def rarest_grams(grams: DataFrame, counts: DataFrame, q: int, threshold: float) -> DataFrame:
    """Of the grams of each (bucket, key) the rarest ones, by counts (gram, n): so many that a key within the threshold has one of them.

    Any order would do; a gram that is not counted comes first. A pair with M letters in common in order has a ratio of 2 M / (length of
    a + length of b). A letter of a outside these breaks at most q of its q-grams and a gap in b at most q - 1, so with q - 1 marks at
    either end at least (2 q - 1) M - (q - 1) (both lengths - 1) q-grams are common; all but one fewer than that may be left out.
    """
    shortest = threshold / (2 - threshold)
    ordered = grams.join(counts.select(F.col("gram").alias("_gram"), "n"), F.col("gram") == F.col("_gram"), "left").groupBy("bucket", "key", "length").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("_grams")
    )
    least = F.greatest(F.ceil(_gain(q, threshold) * (F.col("length") + F.ceil(F.col("length") * shortest - SLACK)) + (q - 1) - SLACK), F.lit(1))
    kept = F.slice("_grams", F.lit(1), F.greatest(F.size("_grams") - least + 1, F.lit(1)).cast("int"))
    return ordered.withColumn("gram", F.explode(kept)).select("bucket", "key", "length", "gram.gram")


def letters_in_common(a: Column, b: Column) -> Column:
    """How many letters two keys share, each as often as both have it: never less than those in common in order."""
    each = lambda text: F.split(text, "")
    count = lambda text, letter: F.length(text) - F.length(F.replace(text, letter))
    return F.aggregate(F.array_intersect(each(a), each(b)), F.lit(0), lambda n, x: n + F.when(x == "", 0).otherwise(F.least(count(a, x), count(b, x))))


def scored_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """a, b and score of all pairs of different keys of one bucket that share a gram and reach the threshold; left and right: bucket, key, length, gram."""
    other = right.select(F.col("bucket").alias("_bucket"), F.col("key").alias("b"), F.col("length").alias("_lb"), F.col("gram").alias("_gram"))
    fits = 2 * F.least("length", "_lb") >= threshold * (F.col("length") + F.col("_lb")) - SLACK
    met = left.join(other, (F.col("bucket") == F.col("_bucket")) & (F.col("gram") == F.col("_gram")) & (F.col("key") != F.col("b")) & fits)
    found = met.select("bucket", F.col("key").alias("a"), "b").distinct()
    found = found.filter(2 * letters_in_common(F.col("a"), F.col("b")) >= threshold * (F.length("a") + F.length("b")) - SLACK)

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([ratio_from(x, y, threshold) for x, y in zip(a, b, strict=True)], dtype="float64")

    return found.withColumn("score", score("a", "b")).filter("score > 0").select(
        F.struct("bucket", F.col("a").alias("key")).alias("a"), F.struct("bucket", F.col("b").alias("key")).alias("b"), "score"
    )


@dataclass(frozen=True)
class KeyIndex:
    """Where the q-grams of stored keys are: counts(grams) gives gram and n of at least these grams (a frame of distinct grams), postings(grams) the
    rows (bucket, key, length, gram) of at least these grams, of all stored keys."""

    counts: Callable[[DataFrame], DataFrame]
    postings: Callable[[DataFrame], DataFrame]


def computed_index(keys: DataFrame, q: int) -> KeyIndex:
    """The index of keys (bucket, key) that are not stored as one."""
    grams = grams_of(keys, q)
    return KeyIndex(lambda _: grams.groupBy("gram").agg(F.count("*").alias("n")), lambda _: grams)


def near_pairs(new: DataFrame, index: KeyIndex, threshold: float) -> DataFrame:
    """a, b and score of all pairs of a new key (bucket, key; distinct) and a new or stored one of its bucket whose ratio reaches the threshold."""
    spark, q = new.sparkSession, longest_gram(threshold)
    grams = grams_of(new, q)
    own = stored(spark, grams.groupBy("gram").agg(F.count("*").alias("n")), "linking")
    counts = own.unionByName(index.counts(own.select("gram"))).groupBy("gram").agg(F.sum("n").alias("n"))
    rare = stored(spark, rarest_grams(grams, counts, q, threshold), "linking")
    return scored_pairs(rare, rare, threshold).unionByName(scored_pairs(rare, index.postings(rare.select("gram").distinct()), threshold))


def _at(period: Column | str, position: Column | str, key: Column | str, stored_first: bool = False) -> Column:
    """A key's or row's place in the fold: stored keys before all rows, rows by month, page and key, nulls last."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.struct(
        F.lit(not stored_first).alias("row"), col(period).isNull().alias("no_period"), col(period).alias("period"), col(position).isNull().alias("no_position"),
        col(position).alias("position"), col(key).alias("key")
    )


def _name(bucket: str, key: str) -> Column:
    """What a node is known by where rows are dealt: text alone, since keys with floating numbers are rewritten by joins and groups and so dealt again."""
    return F.struct(
        F.col(f"{bucket}outlet_id").cast("string").alias("outlet_id"), (F.col(f"{bucket}size_value").cast("double") + 0.0).cast("string").alias("size"),
        F.col(f"{bucket}size_unit").cast("string").alias("size_unit"), F.col(key).alias("key")
    )


def _named(df: DataFrame, node: str) -> DataFrame:
    """df with a node's name and the name's hash, which stands before it in joins and groups: these sort by a number then."""
    return df.withColumn("_name", _name(f"{node}.bucket.", f"{node}.key")).withColumn("_hash", F.xxhash64("_name"))


def _folded(groups: DataFrame) -> DataFrame:
    """_gone: what _later_partners gives, each component in one task, by the fold itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        earlier: dict[bytes, list[bytes]] = {}
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                earlier.setdefault(a, []).append(b)
                earlier.setdefault(b, [])
        gone: set[bytes] = set()
        for node in sorted(earlier):  # places sort as the fold goes
            if any(b not in gone for b in earlier[node]):
                gone.add(node)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(gone), pa.int64())], names=["_gone"])

    return groups.groupBy("component").applyInArrow(run, "_gone long")


def _later_partners(pairs: DataFrame, together: int = TOGETHER, rounds: int = ROUNDS) -> DataFrame:
    """Of pairs (a, b) of new keys with their places, b the earlier one: every a (as _gone) with a founder b.

    An undecided key without undecided earlier partners founds: that decides all but long chains in a few rounds. What is left falls into
    components; those of up to `together` pairs are folded in a task each, the larger ones go on in rounds.
    """
    spark, lost, n = pairs.sparkSession, None, 0
    left = stored(spark, pairs.select("a", "a_at", "b", "b_at"), "linking")
    while not left.isEmpty():
        if n == rounds:
            folded, left = _small_components(left, together)
            lost = folded if lost is None else lost.unionByName(folded)
        n += 1
        heads = left.select(F.col("a").alias("_head")).distinct()
        gone = stored(spark, left.join(heads, F.col("b") == F.col("_head"), "left_anti").select(F.col("a").alias("_gone")).distinct(), "linking")
        lost = gone if lost is None else lost.unionByName(gone)
        left = stored(spark, left.join(gone, F.col("a") == F.col("_gone"), "left_anti").join(gone, F.col("b") == F.col("_gone"), "left_anti"), "linking")
    return pairs.select(F.col("a").alias("_gone")).limit(0) if lost is None else lost


def _small_components(left: DataFrame, together: int) -> tuple[DataFrame, DataFrame]:
    """What the components of up to so many pairs lose, and the pairs of the larger ones."""
    spark = left.sparkSession
    nodes = left.select(F.col("a").alias("node"), F.col("a_at").alias("at")).unionByName(left.select(F.col("b").alias("node"), F.col("b_at").alias("at"))).distinct()
    # numbers in the order of the fold, within what is dealt out by it
    nodes = stored(spark, nodes.orderBy("at").withColumn("number", F.monotonically_increasing_id()), "linking")
    end = lambda c: nodes.select(F.col("node").alias(f"_{c}"), F.col("number").alias(f"{c}_number"))
    numbered = stored(spark, left.join(end("a"), F.col("a") == F.col("_a")).join(end("b"), F.col("b") == F.col("_b")).select(*left.columns, "a_number", "b_number"), "linking")
    of = components(numbered.select(F.col("a_number").alias("a"), F.col("b_number").alias("b")))
    placed = stored(spark, numbered.join(of, F.col("a_number") == F.col("node")).drop("node"), "linking")
    sizes = placed.groupBy("component").agg(F.count("*").alias("_pairs")).filter(F.col("_pairs") <= together).select("component")
    small = placed.join(sizes, "component", "left_semi").select("component", F.col("a_number").alias("a"), F.col("b_number").alias("b"))
    gone = stored(spark, _folded(small).join(nodes, F.col("_gone") == F.col("number")).select(F.col("node").alias("_gone")), "linking")
    return gone, stored(spark, placed.join(sizes, "component", "left_anti").select(*left.columns), "linking")


def link_items(parsed: DataFrame, known: DataFrame, settings: Settings = DEFAULTS, index: KeyIndex | None = None) -> DataFrame:
    """Rows of parsed (bucket columns, period, position, match_key) with the key that they belong to, the score, is_new, renamed and item_id.

    known: items with bucket columns, match_key and first_seen, of the outlets of parsed at least. index: the stored q-grams of these; made here if not
    given. Rows with an empty key are dropped.
    """
    spark, threshold = parsed.sparkSession, settings.match_threshold
    ship_package(spark)
    rows = parsed.filter("match_key != ''").select(_name("", "match_key").alias("name"), "period", F.col("position").cast("long").alias("position"))
    rows = stored(spark, rows.withColumn("hash", F.xxhash64("name")), "linking")
    # all that follows needs a node's rows together: they are dealt once a pass, in parts whose number follows the rows
    dealt = rows.repartition(max(spark.sparkContext.defaultParallelism, -(-rows.count() // ROWS_A_TASK)), "hash", "name").withColumn("at", _at("period", "position", "name.key"))
    items = known.filter("match_key != ''").groupBy(_name("", "match_key").alias("name")).agg(F.min(F.coalesce("first_seen", F.lit(""))).alias("first_seen"))
    items = items.withColumn("hash", F.xxhash64("name"))
    same = (F.col("hash") == F.col("_hash")) & (F.col("name") == F.col("_name"))
    bucket = F.struct("name.outlet_id", F.col("name.size").cast("double").alias("size_value"), "name.size_unit")
    node = F.struct(bucket.alias("bucket"), "name.key").alias("node")

    rest = dealt.join(items.select(F.col("hash").alias("_hash"), F.col("name").alias("_name")), same, "left_anti")
    new = rest.groupBy("hash", "name").agg(F.min("at").alias("at")).select(node, "at", F.lit(True).alias("unlinked"))
    old = items.select(node, _at("first_seen", F.lit(None).cast("long"), "name.key", stored_first=True).alias("at"), F.lit(False).alias("unlinked"))
    nodes = stored(spark, new.unionByName(old), "linking")
    keys = nodes.filter("unlinked").select("node.bucket", "node.key")
    pairs = near_pairs(keys, index or computed_index(nodes.filter("not unlinked").select("node.bucket", "node.key"), longest_gram(threshold)), threshold)
    ends = lambda end: nodes.select(F.col("node").alias(f"_{end}"), F.col("at").alias(f"{end}_at"))
    pairs = stored(spark, pairs.join(ends("a"), F.col("a") == F.col("_a")).join(ends("b"), F.col("b") == F.col("_b")).select("a", "a_at", "b", "b_at", "score"), "linking")

    covered = pairs.filter("not b_at.row").select(F.col("a").alias("_gone")).distinct()
    earlier = pairs.filter("b_at.row and b_at < a_at").select("a", "a_at", "b", "b_at")
    open_pairs = earlier.join(covered, F.col("a") == F.col("_gone"), "left_anti").join(covered, F.col("b") == F.col("_gone"), "left_anti")
    renamed = stored(spark, covered.unionByName(_later_partners(open_pairs)).distinct(), "linking")

    # of the keys that a renamed key can belong to, those better than all that stood before them, with the time until the next
    before = Window.partitionBy("a").orderBy("b_at")
    standing = pairs.join(renamed, F.col("a") == F.col("_gone"), "left_semi").join(renamed, F.col("b") == F.col("_gone"), "left_anti")
    better = standing.withColumn("_best", F.max("score").over(before.rowsBetween(Window.unboundedPreceding, -1))).filter("_best is null or score > _best")
    best = _named(better, "a").select("_name", "_hash", F.col("b.key").alias("match_key"), "score", "b_at", F.lead("b_at").over(before).alias("_until"))
    state = _named(nodes.join(renamed, F.col("node") == F.col("_gone"), "left"), "node").select("_name", "_hash", "unlinked", F.col("_gone").isNotNull().alias("_later"))
    ended = dealt.join(state, same).drop("_name", "_hash")
    linked = ended.filter("_later").join(
        best, same & (F.col("b_at") < F.col("at")) & (F.col("_until").isNull() | (F.col("at") < F.col("_until")))
    ).withColumn("is_new", F.lit(False))
    # rows alike in month, place and key: one is the first
    turn = F.row_number().over(Window.partitionBy("hash", "name").orderBy("at"))
    own = ended.filter("not _later").withColumn("match_key", F.col("name.key")).withColumn("score", F.lit(1.0)).withColumn("is_new", F.col("unlinked") & (turn == 1))

    columns = [*(bucket[c].alias(c) for c in BUCKET), "period", "position", F.col("name.key").alias("new_key"), "match_key", "score", "is_new"]
    both = linked.select(columns).unionByName(own.select(columns))
    return both.withColumn("renamed", F.col("match_key") != F.col("new_key")).withColumn("item_id", item_id())
