"""Suffix-array deduplication: bytes covered by a string of LENGTH bytes that starts anywhere else too are removed.

Only strings of LENGTH bytes matter, so suffixes are sorted to that depth, and only those that can have an equal:

1. First buckets. Each window of LENGTH bytes picks the GRAM-byte string in it with the smallest hash, its anchor. Equal
   windows pick equal strings at equal places, so windows are equal only if their anchors are: anchors are the first
   q-gram buckets, sampled so that they can be dealt out. A run of windows with one anchor is one row: its anchor's hash,
   and a hash of all bytes that the run covers (its extent).
2. Counts by anchor, with a partial aggregate: a bucket of one run is done with. So is a bucket whose runs all have one
   extent: they are copies of each other, and there is nothing to tell apart.
3. In the other buckets each extent stands once, with the number of its copies; its bytes are dealt out by anchor.
4. Bucket-pointer refinement, in tasks, over many anchors at a time: every position of these bytes gets the identifier of
   its STEP-gram's bucket. Buckets are then sorted by the identifiers at the next offset; the buckets that they split
   into get new identifiers, which are written back to their positions and are what the next round sorts by, there and at
   the next offset, so that the depth doubles each round until it is LENGTH. Positions alone in their bucket (and without
   copies) drop out, with all that reach over them. Windows left in a bucket that counts two or more are repeated.
5. An anchor with more than WIDE extents isn't gathered in a task: its windows are counted one by one by their hash.
6. Copies of an extent take its repeated pieces over by a join; these are gathered for each document, and its bytes cut.

A text in a third of all rows costs its anchors' partial counts. Nothing is gathered but a document's own runs and, up
to WIDE, an anchor's extents. STEP-grams, anchors and extents compare by 64-bit hashes of their bytes.

Null texts are empty; texts under LENGTH bytes keep everything. Rows with one id (or none) are told apart by a hash of
their text; rows equal in both are copies of each other like any. Empty tables give empty results. Other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricebasket.llm.common import Batches, documents, map_batches, stored, whole_text
from pricebasket.llm.hashing import gram_hashes, mix, signed, span_hashes, together

LENGTH, GRAM, STEP = 200, 64, 40
#: Extents of one anchor that one task refines at most.
WIDE = 20_000
#: Bytes of extents that are refined together, about.
REFINED = 1_000_000
_U = np.uint64


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: text, start within it, windows, anchor's hash, extent's hash."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none
    grams = gram_hashes(data, gram)
    width, places = length - gram + 1, np.arange(len(grams), dtype=_U)
    low = _U((1 << max(22, int(len(grams)).bit_length())) - 1)
    keys = np.full(-(-len(grams) // width) * width + width, np.iinfo(np.uint64).max, _U)
    keys[: len(grams)] = (grams & ~low) | places  # the smallest hash, the leftmost of equal ones
    blocks = keys.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    n = len(data) - length + 1
    anchor = (np.minimum(back[:n], ahead[width - 1 : width - 1 + n]) & low).astype(np.int64)
    inside = np.ones(n, bool)
    for end in offsets[1:].tolist():
        inside[max(0, end - length + 1) : end] = False
    short = offsets[:-1][np.diff(offsets) < length]
    for begin in short.tolist():
        inside[begin : begin + 1] = False
    first = inside.copy()
    first[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    last = inside.copy()
    last[:-1] &= (anchor[:-1] != anchor[1:]) | ~inside[1:]
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    text = np.searchsorted(offsets, first, "right") - 1
    at, windows = anchor[first] - first, last - first + 1
    extent = mix(span_hashes(data, first, last + length) + at.astype(_U) * _U(0x9E3779B97F4A7C15) + windows.astype(_U) * _U(0xD6E8FEB86659FD93))
    return text, first - offsets[text], windows, signed(grams[anchor[first]]), signed(extent)


def repeated_windows(data: np.ndarray, sizes: np.ndarray, copies: np.ndarray, length: int = LENGTH, step: int = STEP) -> np.ndarray:
    """For pieces of `sizes` bytes that make up data, each there in `copies`: whether the `length` bytes from a position occur again."""
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))  # bytes of its piece from each position on
    counts = np.repeat(copies, sizes)
    pointers, alive, used = np.zeros(len(data), np.int64), np.zeros(len(data), bool), 0
    live = np.flatnonzero(left >= step)
    keys = [gram_hashes(data, step)[live]]
    depth, ahead = 0, step
    while True:
        order = np.lexsort(keys[::-1])
        new = np.ones(len(live), bool)
        if len(live):
            new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
        bucket = np.cumsum(new) - 1
        live = live[order]
        pointers[live] = bucket + used  # no identifier is ever used again
        used += len(live)
        several = np.bincount(bucket, counts[live], minlength=1)[bucket] > 1 if len(live) else np.zeros(0, bool)
        live = np.sort(live[several])
        alive[:] = False
        alive[live] = True
        depth += ahead
        if depth >= length:
            return alive
        ahead = min(depth, length - depth)
        live = live[left[live] >= depth + ahead]
        live = live[alive[live + ahead]]
        keys = [pointers[live], pointers[live + ahead]]


def _identified(df: DataFrame) -> DataFrame:
    """doc_id, _row (a hash of the text, for rows of one id) and text."""
    return df.select("doc_id", F.xxhash64(whole_text()).alias("_row"), whole_text().alias("text"))


def anchor_runs(df: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """anchor, extent, doc_id, _row, start, windows of each run of windows."""
    names = ["anchor", "extent", "doc_id", "_row", "start", "windows"]

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("doc_id"), batch.column("_row").to_numpy(zero_copy_only=False)
            texts = [t.as_py().encode() for t in batch.column("text")]
            for first, _, data, offsets in together(texts):
                text, start, windows, anchor, extent = anchors(data, offsets, length, gram)
                own = pa.array(text + first)
                columns = [pa.array(anchor), pa.array(extent), ids.take(own), pa.array(rows[text + first]), *(pa.array(x.astype(np.int32)) for x in (start, windows))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return map_batches(df.select("doc_id", "_row", "text").filter(F.octet_length("text") >= length), run, "anchor long, extent long, doc_id long, _row long, start int, windows int")


def repeated_spans(df: DataFrame, length: int = LENGTH, gram: int = GRAM, step: int = STEP, wide: int = WIDE) -> DataFrame:
    """doc_id, _row, begin, end: pieces whose bytes are all covered by repeated strings; df as _identified() gives it."""
    spark = df.sparkSession
    runs = stored(spark, anchor_runs(df, length, gram), "anchor-runs")
    of_anchor = runs.groupBy("anchor").agg(F.count("*").alias("_n"), F.min("extent").alias("_least"), F.max("extent").alias("_most")).filter("_n > 1")
    shared = stored(spark, runs.join(of_anchor.select("anchor", (F.col("_least") == F.col("_most")).alias("_same")), "anchor"), "shared-runs")
    same = shared.filter("_same").select("doc_id", "_row", F.col("start").alias("begin"), (F.col("start") + F.col("windows") + (length - 1)).alias("end"))
    mixed = shared.filter("not _same").drop("_same")
    extents = stored(spark, mixed.groupBy("anchor", "extent").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "_row", "start", "windows")).alias("_one")), "extents")
    many = extents.groupBy("anchor").agg(F.count("*").alias("_k")).filter(F.col("_k") > wide).select("anchor", F.lit(True).alias("_wide"))
    one = extents.join(many, "anchor", "left").select("anchor", "extent", "copies", "_one.*", F.coalesce("_wide", F.lit(False)).alias("_wide"))
    wanted = one.groupBy("doc_id", "_row").agg(F.collect_list(F.struct("anchor", "extent", "copies", "start", "windows", "_wide")).alias("_runs"))
    wanted = wanted.withColumnsRenamed({"doc_id": "_id", "_row": "_row_of"})
    texts = df.join(wanted, df["doc_id"].eqNullSafe(wanted["_id"]) & (df["_row"] == wanted["_row_of"]))
    cut = stored(spark, _bytes_of_runs(texts, length), "run-bytes")
    single = cut.filter("hashes is not null").select("anchor", "extent", "copies", "doc_id", "_row", "start", F.posexplode("hashes").alias("_k", "_hash"))
    twice = single.groupBy("_hash").agg(F.sum("copies").alias("_n")).filter("_n > 1").select("_hash")
    counted = single.join(twice, "_hash").select("anchor", "extent", "copies", "doc_id", "_row", "start", F.col("_k").alias("begin"), (F.col("_k") + length).alias("end"))
    found = stored(spark, _refined(cut.filter("hashes is null"), length, step).unionByName(counted), "repeated-pieces")
    pieces = [(F.col("start") + F.col(c)).alias(c) for c in ("begin", "end")]
    alone = found.filter("copies = 1").select("doc_id", "_row", *pieces)
    copied = mixed.join(found.filter("copies > 1").select("anchor", "extent", "begin", "end"), ["anchor", "extent"]).select("doc_id", "_row", *pieces)
    return same.unionByName(alone).unionByName(copied)


def _bytes_of_runs(texts: DataFrame, length: int) -> DataFrame:
    """A row for each run: its bytes, or for anchors with too many extents the hashes of its windows."""
    names = ["anchor", "extent", "copies", "doc_id", "_row", "start", "data", "hashes"]
    schema = "anchor long, extent long, copies long, doc_id long, _row long, start int, data binary, hashes array<long>"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())]

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, row, text, runs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "_row", "text", "_runs")), strict=True):
                data = text.encode()
                for r in runs:
                    piece, hashes = data[r["start"] : r["start"] + r["windows"] + length - 1], None
                    if r["_wide"]:
                        hashes, piece = signed(gram_hashes(np.frombuffer(piece, np.uint8), length)).tolist(), None
                    for column, value in zip(out, (r["anchor"], r["extent"], r["copies"], doc_id, row, r["start"], piece, hashes), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)

    return map_batches(texts.select("doc_id", "_row", "text", "_runs"), run, schema)


def _refined(cut: DataFrame, length: int, step: int) -> DataFrame:
    """Repeated pieces (begin and end within the run) of the runs of each anchor."""
    names = ["anchor", "extent", "copies", "doc_id", "_row", "start"]

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        pieces = [x.as_py() for x in rows.column("data")]
        data, sizes = np.frombuffer(b"".join(pieces), np.uint8), np.array(list(map(len, pieces)), np.int64)
        twice = repeated_windows(data, sizes, rows.column("copies").to_numpy(), length, step)
        own = np.repeat(np.arange(len(sizes)), sizes)
        # consecutive windows of a run make one piece
        first, last = twice.copy(), twice.copy()
        same = own[1:] == own[:-1]
        first[1:] &= ~(twice[:-1] & same)
        last[:-1] &= ~(twice[1:] & same)
        first, last = np.flatnonzero(first), np.flatnonzero(last)
        origin = (np.cumsum(sizes) - sizes)[own[first]]
        taken = rows.select(names).take(pa.array(own[first])).combine_chunks().to_batches()
        columns = taken[0].columns if taken else [pa.array([], k) for k in rows.select(names).schema.types]
        return pa.RecordBatch.from_arrays([*columns, pa.array((first - origin).astype(np.int32)), pa.array((last - origin + length).astype(np.int32))], [*names, "begin", "end"])

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, now = 0, None
        for batch in batches:
            anchor = batch.column("anchor").to_numpy()
            edges = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])).tolist() if len(anchor) else []
            for low, high in zip(edges, [*edges[1:], len(anchor)], strict=True):
                if anchor[low] != now and size >= REFINED:
                    yield solve(held)
                    held, size = [], 0
                part = batch.slice(low, high - low)
                held.append(part)
                now, size = anchor[low], size + sum(len(x.as_py()) for x in part.column("data"))
        if held:
            yield solve(held)

    return map_batches(cut.drop("hashes").repartition("anchor").sortWithinPartitions("anchor"), run, "anchor long, extent long, copies long, doc_id long, _row long, start int, begin int, end int")


def cut_repeats(df: DataFrame, length: int = LENGTH, gram: int = GRAM, step: int = STEP, wide: int = WIDE) -> DataFrame:
    """df with text as what stays of it (bytes cut out of a character go with it), kept (its exact bytes), n_bytes, n_removed and n_spans."""
    others = [c for c in df.columns if c not in ("text", "kept", "n_bytes", "n_removed", "n_spans", "_row", "_id", "_cuts", "_row_of")]
    rows = _identified(df)
    spans = repeated_spans(rows, length, gram, step, wide)
    pieces = spans.groupBy(F.col("doc_id").alias("_id"), "_row").agg(F.collect_list(F.struct("begin", "end")).alias("_cuts"))
    kept = df.select(*others, "text").withColumn("_row", F.xxhash64(whole_text()))
    kept = kept.join(pieces.withColumnRenamed("_row", "_row_of"), kept["doc_id"].eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_row_of")), "left").drop("_id", "_row", "_row_of")
    schema = df.select(*others, "text").schema
    for name, kind in (("kept", "binary"), ("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long")):
        schema = schema.add(name, kind)

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_cut(t, c) for t, c in zip(batch.column("text").to_pylist(), batch.column("_cuts").to_pylist(), strict=True)]
            columns = [batch.column(c) for c in others]
            columns += [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    return map_batches(kept.select(*others, "text", "_cuts"), run, schema)


def _cut(text: str | None, cuts: list[dict] | None) -> tuple[str | None, bytes, int, int, int]:
    data = (text or "").encode()
    if not cuts:
        return text, data, len(data), 0, 0
    left, at, spans = [], 0, 0
    end = -1
    for begin, stop in sorted((c["begin"], c["end"]) for c in cuts):
        if begin > end:
            left.append(data[max(at, 0) : begin])
            spans += 1
        end = max(end, stop)
        at = end
    left.append(data[at:])
    kept = b"".join(left)
    return kept.decode("utf-8", "ignore"), kept, len(data), len(data) - len(kept), spans


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cut_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(F.col("doc_id").cast("long"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, str]]:
    """n_removed, n_spans and digest of what stays, by counting every string of `length` bytes; for tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int)])) == 1
        out.append((int(gone.sum()), int(edges.sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out
