"""Registered queries on awkward rows, against plain forms."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from pricebasket.llm import bpe, media, search

SCHEMA = "doc_id long, text string, lang string, source string, n_chars string, payload string, media string, token_ids string, rank string"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdeé日 ") for _ in range(r.randint(1, 8)))
    out = [(i, " ".join(word() for _ in range(r.randint(0, 60)))) for i in range(40)]
    out += [(100, None), (101, ""), (102, "x" * 64), (103, "y" * 65), (104, "\x00\xff" * 100), (None, "no id"), (None, None), (5, out[5][1]), (5, "another text of one id")]
    return [*out, (200, "lang und breit " * 30_000), (201, "w" * 3000 + " " + "é" * 2000)]


@pytest.fixture(scope="module")
def where(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "en", "s", *["clash"] * 5) for i, t in rows], SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def same(got, want):
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_op1_is_the_library_on_every_row(spark, rows, where, monkeypatch):
    """Also where long texts are cut up on their way."""
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY)), special_tokens={})
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    same([tuple(x) for x in bpe.op1_byte_bpe(spark, where).collect()], want)
    monkeypatch.setattr(bpe, "LONG_TEXT", 50)
    assert len(rows[-2][1]) > 50
    frame = spark.read.parquet(f"{where}/documents.parquet")
    same([(x["doc_id"], x["token_ids"]) for x in bpe.bpe_encode(frame).collect()], [(i, library.encode_ordinary(t or "")) for i, t in rows])


def plain_jpeg(data):
    """Width, height and each block's 64 coefficients, in the order they stand, of a baseline file of one component with a restart after every block."""
    at, codes, out = 2, {}, []
    while data[at + 1] != 0xDA:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4])
        body = data[at + 4 : at + 2 + size]
        if marker == 0xC0:
            height, width = int.from_bytes(body[1:3]), int.from_bytes(body[3:5])
        if marker == 0xC4:
            code, k, table = 0, 17, {}
            for length in range(1, 17):
                for _ in range(body[length]):
                    table[f"{code:0{length}b}"] = body[k]
                    code, k = code + 1, k + 1
                code <<= 1
            codes[body[0]] = table
        at += 2 + size
    at += 2 + int.from_bytes(data[at + 2 : at + 4])
    scan = data[at:-2]
    parts, start = [], 0
    for k in range(len(scan) - 1):
        if scan[k] == 0xFF and 0xD0 <= scan[k + 1] <= 0xD7:
            parts.append(scan[start:k])
            start = k + 2
    for part in [*parts, scan[start:]]:
        bits, place, block = "".join(f"{b:08b}" for b in part.replace(b"\xff\x00", b"\xff")), 0, []
        while len(block) < 64:
            table, code = codes[0x10 if block else 0x00], ""
            while code not in table:
                code, place = code + bits[place], place + 1
            size = table[code]
            assert size >> 4 == 0
            value = int(bits[place : place + size], 2)
            place += size
            block.append(value if value >= 1 << (size - 1) else value - (1 << size) + 1)
        out.append(block)
    return width, height, out


def test_op4_is_what_a_plain_decoder_reads(spark, rows, where):
    files = {x["media"]: x for x in media.store_media(spark.read.parquet(f"{where}/documents.parquet").filter("length(text) < 6000 or text is null")).collect()}
    for data in sorted(files, key=len)[:45]:
        data = bytes(data)
        width, height, blocks = plain_jpeg(data)
        assert width % 8 == height % 8 == 0 and len(blocks) == width * height // 64
        stored = bytes(v + 255 if v < 0 else v for b in blocks for v in b)
        means = np.clip(np.rint(np.array([b[0] for b in blocks]).reshape(height // 8, width // 8) / 8 + 128), 0, 255).astype(np.uint8)
        (found,) = media.features([data])
        assert stored.startswith(found["payload"]) and not any(stored[len(found["payload"]) :]) and found["thumbnail"] == means.tobytes()
    want = []
    for i, t in rows:
        text = (t or "").encode()
        payload = text.ljust(max(1, -(-len(text) // 64)) * 64, b"\0")
        written = media.write_jpeg(payload)
        (found,) = media.features([written])
        want.append((i, len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(written), hashlib.sha256(written).hexdigest(), f"{found['width']}x{found['height']} {found['thumbnail_hash']}"))
    same([tuple(x) for x in media.op4_media(spark, where).collect()], want)


def test_repeated_query_ids_ask_for_the_smallest_text(spark):
    docs = spark.createDataFrame([(1, "apple pie"), (2, "banana bread"), (3, "cherry tart pie")], "doc_id long, text string")
    asked = spark.createDataFrame([(50, "banana"), (50, "apple"), (50, None), (100, "cherry"), (100, "banana")], "doc_id long, text string")
    got = {x["query_id"]: x["doc_id"] for x in search.top_k(docs, asked, k=1).collect()}
    assert got == {100: 2}
