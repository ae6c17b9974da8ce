"""The monthly job over a store of committed snapshots: one batch of pages, one version (W1; L2 to L4, L6, L8, S5, S6).

Tables and their parts: `items` by a hash of the outlet (a batch rewrites the parts of its outlets only), `observations` by
dataset and month (only the batch's months are read and rewritten), `log` by month (appended), and the inverted index of
the items' keys: `grams<q>` and `gram_counts<q>` by a hash of the gram (appended, and merged when a part has many folders). Linking
reads the parts of the index that its keys' grams are in, counts first and then postings of the rare grams only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricebasket.jobs.collect import collect
from pricebasket.operators.linking import BUCKET, KeyIndex, grams_of, longest_gram
from pricebasket.operators.reports import run_report
from pricebasket.operators.store import joined_observations
from pricebasket.session import run_folder, stored
from pricebasket.settings import DEFAULTS, Settings
from pricebasket.sources.constraints import ITEM_RULES, LOG_RULES, OBSERVATION_RULES
from pricebasket.sources.schemas import COLLECTION_LOG, ITEMS, OBSERVATIONS
from pricebasket.sources.snapshots import Change, Snapshot, Store

#: Parts of the items and of the index; folders of a part of the index before they are merged.
ITEM_PARTS, GRAM_PARTS, FOLDERS = 64, 64, 16
POSTINGS = "outlet_id string, size_value double, size_unit string, key string, length int, gram string"
COUNTS = "gram string, n long"


def item_part(outlet: str | Column = "outlet_id") -> Column:
    return F.pmod(F.xxhash64(outlet), F.lit(ITEM_PARTS)).cast("string")


def gram_part(gram: str | Column = "gram") -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(GRAM_PARTS)).cast("string")


def month_part() -> Column:
    return F.concat_ws("@", "dataset", "period")


def _parts(rows: DataFrame, part: Column) -> tuple[str, ...]:
    """The parts that rows are in: as many as the table has at most, or months of a batch."""
    return tuple(sorted(r[0] for r in rows.select(part.alias("p")).filter("p is not null").distinct().collect()))


def stored_index(store: Store, at: Snapshot, q: int) -> KeyIndex:
    """The index of a snapshot; only the parts that the asked-for grams are in are read."""

    def counts(grams: DataFrame) -> DataFrame:
        return store.read(f"gram_counts{q}", COUNTS, _parts(grams, gram_part()), at).groupBy("gram").agg(F.sum("n").alias("n"))

    def postings(grams: DataFrame) -> DataFrame:
        return store.read(f"grams{q}", POSTINGS, _parts(grams, gram_part()), at).select(F.struct(*BUCKET).alias("bucket"), "key", "length", "gram")

    return KeyIndex(counts, postings)


def _indexed(store: Store, base: Snapshot, keys: DataFrame, q: int, whole: bool) -> tuple[list[Change], list[Change]]:
    """Changes, replacing and appending, that add the keys (bucket columns, key; distinct) to the index, or make it of them alone."""
    grams = stored(store.spark, grams_of(keys, q).select(*BUCKET, "key", F.col("length").cast("int").alias("length"), "gram"), "grams")
    tables = ((f"grams{q}", POSTINGS, grams), (f"gram_counts{q}", COUNTS, grams.groupBy("gram").agg(F.count("*").alias("n"))))
    replaced, appended = [], []
    for table, schema, rows in tables:
        full = tuple(p for p, folders in base.parts(table).items() if len(folders) >= FOLDERS)
        if whole:
            replaced.append(Change(table, rows, gram_part()))
            continue
        if full:
            merged = store.read(table, schema, full, base).unionByName(rows.filter(gram_part().isin(*full)))
            merged = merged if schema == POSTINGS else merged.groupBy("gram").agg(F.sum("n").alias("n"))
            replaced.append(Change(table, merged, gram_part(), full))
        appended.append(Change(table, rows.filter(~gram_part().isin(*full)) if full else rows, gram_part()))
    return replaced, appended


def collect_into(store: Store, pages: DataFrame, outlets: DataFrame, dataset: str, batch: str, settings: Settings = DEFAULTS, ids: list[str] | None = None) -> Snapshot:
    """Collects a batch of pages and commits it as one version. A batch that was committed before changes nothing.

    Items, observations, log and index change together or not at all. The report of the batch is report_of() of the version.
    """
    if not dataset:
        raise ValueError("a dataset must be named")
    base, q = store.snapshot(), longest_gram(settings.match_threshold)
    if batch in base.batches:
        return base
    with run_folder(store.spark):
        outlet_parts = _parts(pages, item_part())
        months = _parts(pages, F.concat_ws("@", F.lit(dataset), F.col("period")))
        items, old = store.read("items", ITEMS, outlet_parts, base), store.read("observations", OBSERVATIONS, months, base)
        known = bool(base.parts(f"grams{q}"))
        done = collect(pages, outlets, items, old, dataset, settings, ids, stored_index(store, base, q) if known else None)
        new_keys = done.linked.filter("is_new").select(*BUCKET, F.col("match_key").alias("key")).distinct()
        if not known:  # a store without an index of these q-grams
            new_keys = new_keys.unionByName(store.read("items", ITEMS, at=base).filter("match_key != ''").select(*BUCKET, F.col("match_key").alias("key"))).distinct()
        replaced, appended = _indexed(store, base, new_keys, q, whole=not known)
        log = done.log.select("outlet_id", "ran_at", "status", "reason", "items_found", "period")
        counts = run_report(done.log, done.linked)[1].withColumn("batch", F.lit(batch))
        return store.commit(
            base, batch,
            [Change("items", done.items, item_part(), outlet_parts, ITEM_RULES), Change("observations", done.observations, month_part(), months, OBSERVATION_RULES), *replaced],
            [Change("log", log, F.col("period"), rules=LOG_RULES), Change("runs", counts, F.lit("all")), *appended],
        )


RUNS = "outlet_id string, fetched long, skipped long, errored long, items_written long, new_items long, renames long, batch string"


def report_of(store: Store, batch: str, at: Snapshot | None = None) -> DataFrame:
    """One row for each outlet of a batch (L10), from what was counted as it was written."""
    return store.read("runs", RUNS, at=at).filter(F.col("batch") == batch)


def read_log(store: Store, months: list[str] | None = None, at: Snapshot | None = None) -> DataFrame:
    return store.read("log", f"{COLLECTION_LOG}, period string", months, at)


def load_observations(store: Store, outlets: DataFrame, dataset: str, at: Snapshot | None = None) -> DataFrame:
    """One dataset's observations with items and outlets (R1); other datasets' folders aren't opened."""
    at = store.snapshot() if at is None else at
    own = [p for p in at.parts("observations") if p.startswith(f"{dataset}@")]
    return joined_observations(store.read("observations", OBSERVATIONS, own, at), store.read("items", ITEMS, at=at), outlets, dataset)


def clear_into(store: Store, dataset: str, batch: str, settings: Settings = DEFAULTS) -> tuple[Snapshot, int]:
    """Drops a dataset's months, and with the same version the items that no other dataset has observed (L8). Returns how many observations went."""
    base, q = store.snapshot(), longest_gram(settings.match_threshold)
    if batch in base.batches:
        return base, 0
    own = {p for p in base.parts("observations") if p.startswith(f"{dataset}@")}
    removed = store.read("observations", OBSERVATIONS, own, base).count()
    with run_folder(store.spark):
        kept = store.read("observations", OBSERVATIONS, [p for p in base.parts("observations") if p not in own], base)
        items = stored(store.spark, store.read("items", ITEMS, at=base).join(kept.select("item_id"), "item_id", "left_semi"), "items")
        keys = items.filter("match_key != ''").select(*BUCKET, F.col("match_key").alias("key")).distinct()
        index, _ = _indexed(store, base, keys, q, whole=True)
        after = store.commit(base, batch, [Change("items", items, item_part()), *index], dropped=lambda table, part: table == "observations" and part in own)
    return after, removed
