"""Token ids in length-delimited binary records with masked checksums, and an offset index for shuffled reads.

A file is a sequence of frames: the record's length (8 bytes, little-endian), a masked checksum of these 8 bytes
(4 bytes), the record, a masked checksum of the record (4 bytes). A mask turns the checksum right by 15 bits and adds a
constant, so that checksums of data that holds checksums stay sound. A record is the id's presence and value, the width of a token id
in bytes, and the ids, little-endian.

Writing: texts are encoded where they are read, and each row gets its file's number by binary search among bounds of
(doc_id, hash of the text). The bounds are the first rows of Spark's range partitioning of these two columns; there is
one for FILE_BYTES of text, so they stay few. Rows go to their file's partition by number, are sorted there and written
to one file under a name of its own, then renamed. The index (part, file, doc_id, place in file, offset, length, ids, ids
before in the file) is a table; ids before in all earlier files come from sums over spans of files. A task that is
repeated after a lost executor writes a file of another name; only what the index names counts.

Reading: the index's entries are dealt out by file, read by offset, and both checksums are verified.

Texts are encoded as the library does by default: the strings of special tokens, wherever they stand, are these tokens.

Null texts are encoded as empty ones and hold the end id alone. Null ids come first. Repeated rows and equal ids give a record each,
in an order of their texts' hashes, so that rows of one id (or none) may fill several files; rows equal in both share one. Empty tables write no file and give an empty result. Other columns play no part.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pricebasket.llm.common import Batches, documents, map_batches, new_path, stored, whole_text
from pricebasket.llm.sharding import offsets

TOKENIZER, END = "word_bpe_49k.json", 2
#: Bytes of text that one file holds the ids of, about; files, about, however large the input; entries of an index batch.
FILE_BYTES, FILES, ENTRIES = 24_000_000, 50_000, 10_000
#: Words and stems that a task's memo holds, about; it starts anew beyond.
MEMO, STEMS = 250_000, 250_000
#: Latin letters, which no normal form changes and whose lower case is one letter, and closing marks.
LATIN = re.compile(r"([A-Za-zÀ-ÖØ-Þß-öø-ÿ]+)([.,;:!?#$%&*]*)")
#: The model's characters for the bytes of those letters: bytes that print stand for themselves, the others for characters from 256 on, in order.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
OF_BYTE = {b: chr(b) for b in PRINTED} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in PRINTED)}
BYTES = {c: "".join(OF_BYTE[b] for b in chr(c).encode()) for c in range(128, 256)}
MASK = 0xA282EAD8
#: Formats of what stands before and after a record, and of a record's beginning; their sizes.
HEAD, FOOT, RECORD = "<QI", "<I", "<?qB"
HEAD_SIZE, FOOT_SIZE, RECORD_SIZE = map(struct.calcsize, (HEAD, FOOT, RECORD))
INDEX = "part int, file string, doc_id long, place long, offset long, length long, n_tokens long, earlier long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(record: bytes) -> bytes:
    length = struct.pack("<Q", len(record))
    return b"".join((length, struct.pack(FOOT, masked(length)), record, struct.pack(FOOT, masked(record))))


def unframe(data: bytes) -> bytes:
    """The record of one frame; ValueError if a length or checksum is wrong."""
    if len(data) < HEAD_SIZE + FOOT_SIZE:
        raise ValueError("a frame is cut off")
    length, check = struct.unpack_from(HEAD, data)
    if masked(data[:8]) != check or len(data) != HEAD_SIZE + length + FOOT_SIZE:
        raise ValueError("a frame's length is wrong")
    record = data[HEAD_SIZE : HEAD_SIZE + length]
    if masked(record) != struct.unpack_from(FOOT, data, HEAD_SIZE + length)[0]:
        raise ValueError("a record's checksum is wrong")
    return record


def frames(data: bytes) -> Iterator[bytes]:
    """The records of a whole file, in order."""
    at = 0
    while at < len(data):
        end = at + HEAD_SIZE + struct.unpack_from(HEAD, data, at)[0] + FOOT_SIZE
        yield unframe(data[at:end])
        at = end


def pack(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return struct.pack(RECORD, doc_id is not None, doc_id or 0, width) + ids


def unpack(record: bytes) -> tuple[int | None, np.ndarray]:
    present, doc_id, width = struct.unpack_from(RECORD, record)
    return doc_id if present else None, np.frombuffer(record, f"<u{width}", offset=RECORD_SIZE).astype("<u4")


class WordMemo(dict):
    """Ids of words: the tokenizer splits at white space and drops it, so a text's ids are those of its words, one after another.

    It also splits between a letter and closing marks, and has lower case only; so the ids of a word of Latin letters and marks are those
    of its stem in lower case, which goes to the tokenizer's model at once, and of its marks. Other words go through the whole tokenizer,
    among them all that hold a special token's string, as these have no white space and marks that LATIN doesn't know.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.narrow = self.tokenizer.get_vocab_size() <= 1 << 16  # 16 bits hold every id
        self.kind = "H" if self.narrow else "I"
        self.stems: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if len(self) > MEMO:
            self.clear()
        if word.isascii() and word.isalpha():
            ids = self._stem(word.lower())
        elif found := LATIN.fullmatch(word):
            ids = self._stem(found[1].lower())
            if found[2]:
                if (marks := self.stems.get(found[2])) is None:
                    marks = self.stems[found[2]] = self._whole(found[2])
                ids += marks
        else:
            ids = self._whole(word)
        self[word] = ids
        return ids

    def _stem(self, stem: str) -> bytes:
        if (ids := self.stems.get(stem)) is None:
            if len(self.stems) > STEMS:
                self.stems.clear()
            found = self.tokenizer.model.tokenize(stem if stem.isascii() else stem.translate(BYTES))
            ids = self.stems[stem] = array(self.kind, [t.id for t in found]).tobytes()
        return ids

    def _whole(self, word: str) -> bytes:
        return array(self.kind, self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str], end: int) -> Iterator[bytes]:
        """Each text's ids and the end id, as little-endian integers of 16 or 32 bits."""
        last = array(self.kind, [end]).tobytes()
        for text in texts:  # str.split() would also cut at characters that the tokenizer keeps
            yield b"".join(map(self.__getitem__, text.replace("\n", " ").replace("\t", " ").split(" "))) + last


class Bounds:
    """Where files begin: ascending pairs of (doc_id, hash of the text), a null id before all others."""

    def __init__(self, pairs: list[tuple[int | None, int]]) -> None:
        self.ids = np.array([np.iinfo(np.int64).min if i is None else i for i, _ in pairs], np.int64)
        self.present = np.array([i is not None for i, _ in pairs], bool)
        self.hashes = np.array([h for _, h in pairs], np.int64)

    def place(self, ids: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """How many bounds aren't above each row."""
        known = np.asarray(ids.is_valid())
        own = np.where(known, ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), np.iinfo(np.int64).min)
        low, high = np.zeros(len(own), np.int64), np.full(len(own), len(self.ids), np.int64)
        while (open_ := low < high).any():
            mid = np.minimum((low + high) // 2, max(0, len(self.ids) - 1))
            i, h, p = self.ids[mid], self.hashes[mid], self.present[mid]
            reached = (known > p) | (known == p) & ((own > i) | (own == i) & (hashes >= h))
            low, high = np.where(open_ & reached, mid + 1, low), np.where(open_ & ~reached, mid, high)
        return low


def file_bounds(df: DataFrame, files: int) -> Bounds:
    """Bounds of about so many files, from (doc_id, _hash): the first row of each range but the first. Two numbers a file reach the driver."""
    if files < 2:
        return Bounds([])
    ranges = df.select("doc_id", "_hash").repartitionByRange(files, F.col("doc_id").asc_nulls_first(), "_hash")
    firsts = ranges.groupBy(F.spark_partition_id().alias("_part")).agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("present"), "doc_id", "_hash")).alias("first")).select("first.*")
    pairs = sorted({(r["present"], r["doc_id"] or 0, r["_hash"]) for r in firsts.collect()})
    return Bounds([(i if present else None, h) for present, i, h in pairs[1:]])


def encode_documents(df: DataFrame, bounds: Bounds | None = None, path: str | None = None, end: int = END) -> DataFrame:
    """doc_id, _hash (of the text), part (the number of its file) and record (binary) of each document; ids of 16 bits where they suffice, else of 32."""
    path, spark = path or public_tokenizers.path(TOKENIZER), df.sparkSession
    shared = spark.sparkContext.broadcast(bounds or Bounds([]))

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        memo = WordMemo(path)
        for batch in batches:
            ids, hashes = batch.column("doc_id"), batch.column("_hash")
            records = [pack(i, own, 2 if memo.narrow else 4) for i, own in zip(ids.to_pylist(), memo.encode(batch.column("text").to_pylist(), end), strict=True)]
            part = shared.value.place(ids, hashes.to_numpy(zero_copy_only=False)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids, hashes, pa.array(part), pa.array(records, pa.binary())], ["doc_id", "_hash", "part", "record"])

    return map_batches(_hashed(df), run, "doc_id long, _hash long, part int, record binary")


def _hashed(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").cast("long"), F.xxhash64(whole_text()).alias("_hash"), whole_text().alias("text"))


def _store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def write_records(df: DataFrame, folder: str, file_bytes: int = FILE_BYTES, path: str | None = None, end: int = END) -> DataFrame:
    """Encodes df (doc_id, text) and writes its records to files in the folder, in ascending order of doc_id over all files; the index, stored beside them."""
    spark, docs = df.sparkSession, _hashed(df)
    size = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    bounds = file_bounds(docs, -(-size // max(file_bytes, size // FILES)))
    encoded = encode_documents(df, bounds, path, end)
    dealt = encoded.repartitionById(len(bounds.ids) + 1, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "_hash", "record")
    kinds = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[k]) for n, k in map(str.split, INDEX.split(", "))])

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        fs, root = _store(folder)
        fs.create_dir(root, recursive=True)
        out, name, entries = None, "", []

        def done() -> Iterator[pa.RecordBatch]:
            if out:
                out.close()
                fs.move(f"{root}/_{name}", f"{root}/{name}")
            if entries:
                yield pa.RecordBatch.from_pylist(entries, kinds)

        now, place = None, 0
        for batch in batches:
            for p, doc_id, record in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "record")), strict=True):
                if p != now:
                    yield from done()
                    now, name, entries, offset, earlier, place = p, f"{p:08d}-{uuid.uuid4().hex}.records", [], 0, 0, 0
                    out = fs.open_output_stream(f"{root}/_{name}")
                data, n = frame(record), (len(record) - RECORD_SIZE) // record[RECORD_SIZE - 1]
                out.write(data)
                entries.append({"part": p, "file": name, "doc_id": doc_id, "place": place, "offset": offset, "length": len(data), "n_tokens": n, "earlier": earlier})
                offset, earlier, place = offset + len(data), earlier + n, place + 1
                if len(entries) == ENTRIES:
                    yield pa.RecordBatch.from_pylist(entries, kinds)
                    entries = []
        yield from done()

    return stored(spark, map_batches(dealt.select("part", "doc_id", "record"), run, INDEX), "record-index")


def read_records(index: DataFrame, folder: str, of: Callable[[int | None, np.ndarray], dict], schema: str) -> DataFrame:
    """The index with what `of` makes of each record (doc_id, ids), read from the files by offset; schema: of these columns."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "array<long>": pa.list_(pa.int64())}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        fs, root = _store(folder)
        name, file = None, None
        for batch in batches:
            found = []
            for own, doc_id, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "doc_id", "offset", "length")), strict=True):
                if own != name:
                    name, file = own, fs.open_input_file(f"{root}/{own}")
                file.seek(offset)
                got, ids = unpack(unframe(file.read(length)))
                if got != doc_id:
                    raise ValueError("the index names another document")
                found.append(of(got, ids))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([x[k] for x in found], t) for k, t in zip(names, types, strict=True))], [*batch.schema.names, *names])

    dealt = index.repartition("file").sortWithinPartitions("file", "offset")
    return map_batches(dealt, run, f"{INDEX}, start long, {schema}" if "start" in index.columns else f"{INDEX}, {schema}")


def with_starts(index: DataFrame) -> DataFrame:
    """The index with start: ids in all files and records before. One row a file is summed up, span by span."""
    files = index.groupBy("part").agg(F.sum("n_tokens").alias("_n")).withColumn("_all", F.lit(0))
    before = offsets(files, ["_all"], "part", "_n", "_before").select("part", "_before")
    return index.join(before, "part").select(*(index[c] for c in index.columns), (F.col("_before") + F.col("earlier")).alias("start"))


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "records")
    index = write_records(documents(spark, sf_dir), folder)
    read = read_records(with_starts(index), folder, lambda _, ids: {"n_read": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())}, "n_read long, ids_crc32 long")
    return read.select("doc_id", "start", F.col("n_read").alias("n_tokens"), "ids_crc32")
