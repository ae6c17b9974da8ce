"""Byte-level BPE: pre-tokens, a minimal perfect hash for those that are tokens, merges over linked bytes for the rest.

Every pre-token is first looked up whole. The vocabulary's keys sit in a minimal perfect hash (one displacement for
each small bucket of keys, as many slots as keys), so a lookup is one hash, two array reads and one comparison. A
pre-token that is no token is merged: its bytes form a linked list, a heap holds the joinable neighbours by rank,
and the lowest rank (leftmost on ties) is joined until no neighbours can be.

The vocabulary is broadcast: its size is that of a vocabulary file, whatever the data. Texts are never shuffled. A task
remembers pre-tokens' ids, packed, in two generations of MEMO entries at most, and frees them when it ends.

Null texts are encoded as empty ones (no ids); empty texts give no ids, and the digests are those of no bytes.
Repeated rows give repeated rows. An empty table gives an empty result. Other columns of the input play no part.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricebasket.llm.common import Batches, documents, map_batches, whole_text

VOCABULARY = "byte_bpe_50k.tiktoken"
MASK = (1 << 64) - 1
#: Texts of more characters than this are split into pre-tokens piece by piece, so that no list of all of them is held.
LONG_TEXT = 1 << 20
#: Pre-tokens at a time there.
PIECES = 1 << 16
#: Bytes of packed ids that are handed on together, at least one text's.
PACKED = 1 << 20
#: Entries in one of the two generations of a task's memo of pre-tokens: when the young one is full, it becomes the old one, and what is used of that moves over.
MEMO = 250_000
#: Pairs of neighbours whose rank a task remembers.
PAIRS = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file's lines: base64 of a token's bytes, its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class MinimalPerfectHash:
    """n keys in n slots without collisions. A key's bucket holds a displacement that sends each of the bucket's keys to a slot of its own."""

    def __init__(self, keys: list[bytes], per_bucket: int = 4) -> None:
        self.n, self.buckets = len(keys), max(1, len(keys) // per_bucket)
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        if len(np.unique(hashes)) != len(keys):
            raise ValueError("two keys have one hash")
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        free, at = np.ones(self.n, bool), np.zeros(self.n, np.int64)
        shift = np.zeros(self.buckets, np.int64)
        sizes = np.diff(starts)
        for b in np.argsort(-sizes, kind="stable"):
            own = order[starts[b] : starts[b + 1]]
            if len(own) < 2:
                break
            base = 0
            while True:
                tried = np.arange(base, base + 256, dtype=np.uint64)
                slots = self._slots(hashes[own][None, :], tried[:, None])
                ranked = np.sort(slots, axis=1)
                good = free[slots].all(axis=1) & (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
                if good.any():
                    k = int(good.argmax())
                    shift[b], at[own], free[slots[k]] = base + k, slots[k], False
                    break
                base += 256
        left = np.flatnonzero(free)  # single keys take what is left, by a direct reference
        alone = order[starts[:-1][sizes == 1]]
        at[alone] = left[: len(alone)]
        shift[bucket[alone]] = -1 - left[: len(alone)]
        self.shift, self.slot_of_key = shift.tolist(), at

    def _slots(self, hashes: np.ndarray, shift: np.ndarray) -> np.ndarray:
        mixed = (hashes ^ (hashes >> np.uint64(29))) * (shift * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15))
        return ((mixed >> np.uint64(32)) % np.uint64(self.n)).astype(np.int64)

    def slot(self, key: bytes) -> int:
        """The only slot where the key can be."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        if d < 0:
            return -1 - d
        return ((((h ^ (h >> 29)) * (2 * d + 0x9E3779B97F4A7C15)) & MASK) >> 32) % self.n


class _Merged(dict):
    """Pre-token -> ids, packed in the codec's width; made on demand and bounded."""

    def __init__(self, codec: BytePairCodec) -> None:
        self.codec, self.old = codec, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = array(self.codec.kind, self.codec.encode_piece(piece.encode())).tobytes()
        if len(piece) <= 64:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class BytePairCodec:
    """Encodes and decodes texts by the ranks of a vocabulary, as byte-level BPE without special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN) -> None:
        keys = list(ranks)
        self.pattern = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"(?!\S)", r"(?!\P{White_Space})")
        self.hash = MinimalPerfectHash(keys)
        self.keys, self.ids = [b""] * len(keys), [0] * len(keys)
        for key, slot in zip(keys, self.hash.slot_of_key.tolist(), strict=True):
            self.keys[slot], self.ids[slot] = key, ranks[key]
        self.hash.slot_of_key = None
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        for key, rank in ranks.items():
            self.token[rank] = key
        self.kind = "H" if len(self.token) <= 1 << 16 else "I"
        self.of_byte = [self.find(bytes([b])) for b in range(256)]
        if min(self.of_byte) < 0:
            raise ValueError("a byte has no token")
        self._prepare()

    def _prepare(self) -> None:
        self.split = regex.compile(self.pattern)
        self.forget()

    def forget(self) -> None:
        """Frees what has been remembered."""
        self.merged, self.pairs = _Merged(self), {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("split", "merged", "pairs")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._prepare()

    def find(self, key: bytes) -> int:
        """A token's id; -1 if the bytes are no token."""
        slot = self.hash.slot(key)
        return self.ids[slot] if self.keys[slot] == key else -1

    def _pair(self, both: int) -> int:
        """The rank of two neighbours' join, -1 if they can't be joined; both: the left id above the right id's 32 bits."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        got = self.pairs[both] = self.find(self.token[both >> 32] + self.token[both & 0xFFFFFFFF])
        return got

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one pre-token."""
        whole = self.find(piece)
        return (whole,) if whole >= 0 else self.merge(piece)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Joins neighbours, lowest rank first. The heap holds rank * n + position; joinable[i] is the rank that still counts at i."""
        n, known, pair = len(piece), self.pairs.get, self._pair
        ids = [self.of_byte[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        joinable = [r if (r := known(x := a << 32 | b)) is not None else pair(x) for a, b in pairwise(ids)]
        joinable.append(-1)
        heap = [r * n + i for i, r in enumerate(joinable) if r >= 0]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            i, rank = top % n, top // n
            if joinable[i] != rank:
                continue  # one of the two has been joined since
            j = after[i]
            k = after[i] = after[j]
            ids[i], ids[j], joinable[j] = rank, -1, -1
            if k < n:
                before[k] = i
                if (r := known(x := rank << 32 | ids[k])) is None:
                    r = pair(x)
                joinable[i] = r
                if r >= 0:
                    heapq.heappush(heap, r * n + i)
            else:
                joinable[i] = -1
            if (p := before[i]) >= 0:
                if (r := known(x := ids[p] << 32 | rank)) is None:
                    r = pair(x)
                joinable[p] = r
                if r >= 0:
                    heapq.heappush(heap, r * n + p)
        return tuple(x for x in ids if x >= 0)

    def encode_chunks(self, text: str) -> Iterator[bytes]:
        """The text's ids, packed, in pieces of bounded length where the text is long."""
        look = self.merged.__getitem__
        if len(text) <= LONG_TEXT:
            yield b"".join(map(look, self.split.findall(text)))
            return
        pieces = (m[0] for m in self.split.finditer(text))
        while part := list(islice(pieces, PIECES)):
            yield b"".join(map(look, part))

    def unpack(self, packed: bytes) -> array:
        return array(self.kind, packed)

    def encode(self, text: str) -> list[int]:
        return self.unpack(b"".join(self.encode_chunks(text))).tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def codec(path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> BytePairCodec:
    return BytePairCodec(read_ranks(path or public_tokenizers.path(VOCABULARY)), pattern)


def bpe_encode(df: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and token_ids (array<int>) of each document."""
    shared = df.sparkSession.sparkContext.broadcast(codec(path))

    def lists(own: BytePairCodec, ids: pa.Array, packed: list[bytes]) -> pa.RecordBatch:
        ends = np.zeros(len(packed) + 1, np.int32)
        np.cumsum([len(p) // array(own.kind).itemsize for p in packed], out=ends[1:])
        flat = np.frombuffer(b"".join(packed), own.kind).astype(np.int32)
        return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "n_tokens", "token_ids"])

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        own = shared.value
        try:
            for batch in batches:
                ids, packed, size, first = batch.column("doc_id"), [], 0, 0
                for k, text in enumerate(batch.column("text")):
                    packed.append(b"".join(own.encode_chunks(text.as_py())))
                    size += len(packed[-1])
                    if size > PACKED or k + 1 == len(ids):
                        yield lists(own, ids.slice(first, k + 1 - first), packed)
                        packed, size, first = [], 0, k + 1
        finally:
            own.forget()

    return map_batches(df.select("doc_id", whole_text().alias("text")), run, "doc_id long, n_tokens long, token_ids array<int>")


def bpe_decode(df: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and decoded (binary) from doc_id and token_ids; null ids decode to no bytes."""
    shared = df.sparkSession.sparkContext.broadcast(codec(path))

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            decoded = [own.decode(x.as_py() or ()) for x in batch.column("token_ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(decoded, pa.binary())], ["doc_id", "decoded"])

    return map_batches(df.select("doc_id", "token_ids"), run, "doc_id long, decoded binary")


def bpe_round_trip(df: DataFrame, path: str | None = None) -> DataFrame:
    """Encode each text and decode its ids again: doc_id, n_tokens, and the digests of the ids and of the decoded bytes.

    One pass; neither ids nor texts leave the task. Long texts go through in bounded pieces.
    """
    shared = df.sparkSession.sparkContext.broadcast(codec(path))

    def digests(own: BytePairCodec, digits: list[str], text: str) -> tuple[int, str, str]:
        n, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
        for packed in own.encode_chunks(text):
            if packed:
                ids = own.unpack(packed)
                of_ids.update(((" " if n else "") + " ".join(map(digits.__getitem__, ids))).encode())
                of_bytes.update(own.decode(ids))
                n += len(ids)
        return n, of_ids.hexdigest(), of_bytes.hexdigest()

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        own = shared.value
        digits = list(map(str, range(len(own.token))))
        try:
            for batch in batches:
                rows = [digests(own, digits, t.as_py()) for t in batch.column("text")]
                n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            own.forget()

    return map_batches(df.select("doc_id", whole_text().alias("text")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(documents(spark, sf_dir)).select(F.col("doc_id").cast("long"), "n_tokens", "ids_sha256", "decoded_sha256")
