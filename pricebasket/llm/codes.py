"""Vector code compression: product codes by a delta-maintained Lloyd iteration, in integers.

1. Kept rows. Components become floor(SCALE * x); rows whose vector is null or holds a null or non-finite component are
   dropped. The vectors are cut into PARTS equal consecutive parts.
2. Each part position's codebook starts as that part of the ENTRIES smallest kept ids.
3. Rounds. A table holds every row with its codes and those of the round before. A round reads the last table, assigns,
   and writes the next one; then only rows with a changed code are read, and only their plus and minus contributions (the
   part added to the entry it came to, taken from the one it left) are summed: in each task first, then over the tasks, so
   what is shuffled is at most one row an entry and task. The running integer sums and counts, one row an entry,
   are all that the driver has. An entry becomes floor(sum / count); one that nothing is assigned to stays as it is.
4. Parts are assigned once more, to the final codebooks; errors are squared distances summed over a row's parts.

All arithmetic is in integers, so the result hangs on no order of adding. A round's table is deleted when the next one
is complete; a lost executor costs the tasks it had, as every table is in the shared folder. Ties go to the lower entry.

Null ids: such rows are coded like others and come last among the smallest ids. Rows of one id are ordered by their
vectors. Fewer kept rows than ENTRIES: so many entries. Equal entries: the later one stays unused and unchanged. No kept
rows: an empty result. Components of more than 2**14 in size, vectors of different lengths and lengths that are no multiple of PARTS are errors that say so. Other columns play no part. Null labels are one label.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricebasket.llm.common import Batches, map_batches, new_path
from pricebasket.session import discard

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components are smaller than this after scaling; sums of their squares then fit into 64 bits.
LIMIT = 1 << 26
CODED = "vec_id long, label string, vector array<int>, code binary, was binary"


def whole_vectors(vectors: DataFrame, column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, label and the scaled vector of the rows that are kept."""
    x = F.col(column)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    over = F.exists(x, lambda c: F.abs(c.cast("double") * scale) >= LIMIT)
    checked = F.when(over, F.raise_error(F.lit(f"a component is not below {LIMIT // scale}"))).otherwise(scaled.cast("array<int>"))
    return vectors.filter(x.isNotNull() & ~bad).select(F.col("vec_id").cast("long"), F.col("label").cast("string"), checked.alias("vector"))


def _matrix(batch: pa.RecordBatch, length: int) -> np.ndarray:
    column = batch.column("vector")
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes != length).any():
        raise ValueError(f"vectors of {length} and of {int(sizes[sizes != length][0])} components")
    return column.flatten().to_numpy().reshape(len(sizes), length)


def nearest(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For (rows, parts * width) and books (parts, entries, width): the nearest entry of each part and its squared distance."""
    parts, _, width = books.shape
    cut = vectors.reshape(len(vectors), parts, width).astype(np.int64)
    code, error = np.zeros((len(vectors), parts), np.uint8), np.zeros(len(vectors), np.int64)
    for p in range(parts):
        distance = ((cut[:, p, None, :] - books[p][None]) ** 2).sum(axis=2)
        code[:, p] = distance.argmin(axis=1)  # the first of equal ones
        error += distance.min(axis=1)
    return code, error


def _fixed(code: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in code], pa.binary())


def _assigned(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """Rows with a new code each; the one before is kept beside it."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, _ = nearest(_matrix(batch, books.shape[0] * books.shape[2]), books)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("vector"), _fixed(code), batch.column("code")], names=["vec_id", "label", "vector", "code", "was"])

    return map_batches(rows, run, CODED)


def contributions(coded: DataFrame, parts: int, entries: int, length: int) -> DataFrame:
    """part, entry, at (0 to width - 1, or width for the count) and the sum of what came less what went, of changed parts only."""
    width = length // parts
    changed = coded.filter("was is null or code != was").select("vector", "code", "was")

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            cut = _matrix(batch, length).reshape(-1, parts, width).astype(np.int64)
            cut = np.concatenate([cut, np.ones((len(cut), parts, 1), np.int64)], axis=2)
            now = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts)
            before = [c.as_py() for c in batch.column("was")]
            old = np.array([c is not None for c in before], bool)
            was = np.frombuffer(b"".join(c or bytes(parts) for c in before), np.uint8).reshape(-1, parts)
            for p in range(parts):
                moved = ~old | (now[:, p] != was[:, p])
                np.add.at(sums[p], now[moved, p], cut[moved, p])
                np.subtract.at(sums[p], was[moved & old, p], cut[moved & old, p])
        p, e, at = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(sums[p, e, at])], names=["part", "entry", "at", "delta"])

    return map_batches(changed, run, "part int, entry int, at int, delta long").groupBy("part", "entry", "at").agg(F.sum("delta").alias("delta"))


def fit_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[np.ndarray | None, DataFrame]:
    """Codebooks (parts, entries, width) after the rounds, and the stored rows of (vec_id, label, vector) with their codes by the
    codebooks before the last update. None and an empty frame for no vectors."""
    spark = vectors.sparkSession
    path = new_path(spark, "vectors")
    vectors.select("vec_id", "label", "vector", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("binary").alias("was")).write.parquet(path)
    rows = spark.read.schema(CODED).parquet(path)
    start = [r["vector"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()]
    if not start:
        return None, rows
    length = len(start[0])
    if not length or length % parts or any(len(v) != length for v in start):
        raise ValueError(f"vectors of {sorted({len(v) for v in start})} components can't be cut into {parts} equal parts")
    width = length // parts
    books = np.array(start, np.int64).reshape(len(start), parts, width).transpose(1, 0, 2).copy()
    sums = np.zeros((parts, len(start), width + 1), np.int64)
    for _ in range(rounds):
        then, path = path, new_path(spark, "vectors")
        _assigned(rows, books).write.parquet(path)
        discard(spark, then)
        rows = spark.read.schema(CODED).parquet(path)
        for r in contributions(rows, parts, len(start), length).collect():  # one row an entry and position, however many vectors there are
            sums[r["part"], r["entry"], r["at"]] += r["delta"]
        used = sums[:, :, width] > 0
        books[used] = sums[used][:, :width] // sums[used][:, width:]
    return books, rows


def encoded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (bytes, an entry each) and error of rows of (vec_id, label, vector)."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = nearest(_matrix(batch, books.shape[0] * books.shape[2]), books)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), _fixed(code), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return map_batches(rows.select("vec_id", "label", "vector"), run, "vec_id long, label string, code binary, error long")


def decoded(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """codes with the vector that each code (bytes) stands for, in the original scale."""
    table = F.array(*(F.array(*(F.array(*(F.lit(float(x) / scale) for x in entry)) for entry in part)) for part in books))
    entry = lambda p: F.conv(F.hex(F.substring("code", p + 1, 1)), 16, 10).cast("int")
    return codes.withColumn("vector", F.flatten(F.array(*(F.get(F.get(table, F.lit(p)), entry(p)) for p in range(len(books))))))


def books_sha256(books: np.ndarray | None) -> str:
    return hashlib.sha256(",".join(map(str, [] if books is None else books.ravel().tolist())).encode()).hexdigest()


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kept vector's code. Labels' errors are summed in each task before they are dealt out."""
    books, rows = fit_codebooks(whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    if books is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    codes = encoded(rows, books)
    of_label = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    joined = codes.join(of_label, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The same in SQL: one group of tables a round, by entry and position in the part."""
    steps = [f"""
with kept as (
  select row_number() over (order by vec_id nulls last, v) as r, vec_id, label, v from (
    select vec_id, label, [cast(floor({SCALE} * cast(x as double)) as bigint) for x in embedding] as v from embeddings
    where embedding is not null and len([1 for x in embedding if x is null or not isfinite(x)]) = 0)),
parts as (
  select r, p, [v[p * (len(v) // {PARTS}) + i] for i in range(1, len(v) // {PARTS} + 1)] as x from kept, (select unnest(range({PARTS})) as p)),
b0 as (select p, r - 1 as e, x as c from parts where r <= {ENTRIES})"""]
    for n in range(ROUNDS + 1):
        steps.append(f"""a{n} as (
  select r, p, x, min(struct_pack(d := d, e := e)) as best from (
    select r, p, x, e, cast(list_sum([(x[i] - c[i]) * (x[i] - c[i]) for i in range(1, len(x) + 1)]) as bigint) as d from parts join b{n} using (p)) group by r, p, x)""")
        if n < ROUNDS:
            steps.append(f"""m{n} as (
  select p, e, list(m order by i) as c from (
    select p, best.e as e, i, cast(floor(cast(sum(x[i]) as double) / count(*)) as bigint) as m from a{n}, (select unnest(range(1, 1025)) as i) where i <= len(x) group by 1, 2, 3) group by 1, 2),
b{n + 1} as (select p, e, coalesce(m.c, b.c) as c from b{n} b left join m{n} m using (p, e))""")
    steps.append(f"""sha as (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) as codebooks_sha256 from b{ROUNDS}),
coded as (select r, string_agg(printf('%02x', best.e), '' order by p) as code, cast(sum(best.d) as bigint) as error from a{ROUNDS} group by r)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
from coded join kept using (r), sha""")
    return ",\n".join(steps)


OP11_SQL = _sql()
