"""Hashes of spans: no arithmetic relation of texts makes them equal, such as that of complementary Thue-Morse strings."""

import hashlib
import random

import numpy as np
import pytest

from pricebasket.llm import jaccard, search, suffixes
from pricebasket.llm.hashing import gram_hashes, span_hashes

SWAP = bytes.maketrans(b"ab", b"ba")


def morse(n):
    out = b"a"
    while len(out) < n:
        out += out.translate(SWAP)
    return out


@pytest.mark.parametrize("q", [1, 3, 8, 13, 40, 64, 200])
def test_grams_are_equal_where_bytes_are(q):
    r = random.Random(q)
    data = np.frombuffer(bytes(r.choice(b"ab") for _ in range(70_000)) + morse(1024) * 2, np.uint8)
    of = {}
    for k, h in enumerate(gram_hashes(data, q).tolist()):
        of.setdefault(data[k : k + q].tobytes(), set()).add(h)
    assert all(len(h) == 1 for h in of.values()) and len(set().union(*of.values())) == len(of)
    assert len(gram_hashes(data[: q - 1], q)) == 0


def test_spans_are_equal_where_bytes_are():
    r = random.Random(1)
    data = np.frombuffer(bytes(r.choice(b"ab") for _ in range(4000)), np.uint8)
    start = np.array([r.randrange(4000) for _ in range(5000)])
    end = np.minimum(4000, start + np.array([r.choice([0, 1, 2, 7, 8, 9, 30, 512, 513, 900]) for _ in range(5000)]))
    of = {}
    for s, e, h in zip(start, end, span_hashes(data, start, end).tolist(), strict=True):
        of.setdefault(data[s:e].tobytes(), set()).add(h)
    assert all(len(h) == 1 for h in of.values()) and len(set().union(*of.values())) == len(of)


@pytest.mark.parametrize("n", [64, 256, 1024, 2048, 4096, 8192])
def test_complementary_strings_differ(n):
    own, other = morse(n), morse(n).translate(SWAP)
    both = np.frombuffer(own + b" " + other, np.uint8)
    assert len(set(span_hashes(both, np.array([0, n + 1]), np.array([n, 2 * n + 1])).tolist())) == 2
    found = gram_hashes(both, n)
    assert found[0] != found[n + 1]
    offsets = np.array([0, n, 2 * n + 1])
    assert len(set(search.terms(both, offsets)[1].tolist())) == 2
    assert len(set(jaccard.shingles(both, offsets)[1].tolist())) == 2


def test_operators_on_complementary_strings(spark):
    texts = [f(morse(n)).decode() for n in (64, 256, 1024, 2048, 4096, 8192) for f in (bytes, lambda x: x.translate(SWAP))] + [(morse(1024) + b" x").decode(), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(r["component_id"] == r["doc_id"] for r in jaccard.near_duplicates(docs).collect())
    got = [(r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in sorted(suffixes.cut_repeats(docs).collect(), key=lambda r: r["doc_id"])]
    assert got == suffixes.brute_force([(t or "").encode() for t in texts])
