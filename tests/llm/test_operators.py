import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pricebasket.llm import bpe, jaccard, language, media, mixing, records, search, sentences, sharding, suffixes
from pricebasket.llm.common import new_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau upsilon".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (". " if r.random() < 0.15 else "") for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base = prose(0, 300)
    cut = base.split(" ")
    near = " ".join(w if i % 97 else "changed" for i, w in enumerate(cut))
    return [None, "", "Word", "a b c", base, base, near, prose(1, 80) + " " + base[300:900] + " " + prose(2, 80), prose(3, 50), "!!! 123", prose(4, 4000), "x" * 450, "é日本 <|endoftext|> \x1c it's\n\n  ok", base]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s0" if i % 3 else None, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("anchor", F.lit("clash")).withColumn("n", F.lit("clash")).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, key="doc_id"):
    return sorted(df.collect(), key=lambda r: r[key])


def test_bpe_is_what_the_library_gives(docs, empty, texts):
    ranks = bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows(bpe.bpe_encode(docs))
    assert [r["token_ids"] for r in got] == [library.encode_ordinary(t or "") for t in texts]
    assert [bytes(r["decoded"]) for r in rows(bpe.bpe_decode(bpe.bpe_encode(docs)))] == [(t or "").encode() for t in texts]
    assert [r["decoded_sha256"] for r in rows(bpe.bpe_round_trip(docs))] == [hashlib.sha256((t or "").encode()).hexdigest() for t in texts]
    assert bpe.bpe_round_trip(empty).count() == 0


def test_perfect_hash_has_no_collisions():
    keys = [f"k{i}".encode() for i in range(5000)]
    found = bpe.MinimalPerfectHash(keys)
    assert sorted(map(found.slot, keys)) == list(range(5000))


def test_gradients_are_right():
    net = language.ByteNetwork(["a", "b"], hidden=3)
    x, y, w = np.array([[97, 98, 99], [100, 97, 98]], np.uint8), np.array([0, 1]), np.ones(2, np.float32)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    _, g = net.gradients(x, y, w)
    for name, at in (("uf", (1, 4)), ("ub", (0, 7)), ("wf", (97, 2)), ("o", (4, 1)), ("bb", (5,))):
        old, losses = net.p[name][at], []
        for step in (1e-3, -1e-3):
            net.p[name][at] = old + step
            losses.append(net.gradients(x, y, w)[0])
        net.p[name][at] = old
        assert g[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-3, rel=0.05, abs=1e-4)


def test_language_id_learns(spark, empty):
    r = random.Random(5)
    make = lambda letters: " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(60))
    labelled = spark.createDataFrame([(i, make("abcde" if i % 2 else "defgh"), "x" if i % 2 else "y", None, 1) for i in range(120)] + [(200, None, "x", None, 1), (201, "12 !", "x", None, 1)], SCHEMA)
    got = rows(language.predict_languages(labelled, language.fit_languages(labelled)))
    assert sum(r["lang_pred"] == r["lang"] for r in got[:120]) >= 118
    assert [(r["lang_pred"], r["score"]) for r in got[120:]] == [("und", 0.0)] * 2
    assert language.predict_languages(empty, language.fit_languages(empty)).count() == 0


def test_language_windows_are_the_network(monkeypatch):
    """Windows side by side give what the network gives running over whole texts, as far as it looks; any length of text."""
    net = language.ByteNetwork(["a", "b", "c"])
    for key, v in net.p.items():
        net.p[key] = np.random.default_rng(len(key)).standard_normal(v.shape).astype(np.float32)
    texts = [prose(k, n).encode() for k, n in enumerate((1, 3, 20, 28, 29, 30, 60, 400))] + [b"", b"x", b"ab" * language.WINDOW, "日本é".encode() * 90]
    got = net.pooled(texts)
    for text, found in zip(texts, got, strict=True):
        if len(text) <= language.WINDOW:
            exact = np.exp(net.positions(np.frombuffer(text, np.uint8)[None])).mean(axis=(0, 1)) if text else np.zeros(3)
            assert found == pytest.approx(exact, abs=1e-4)
        else:
            logs = []
            for at in range(0, len(text), language.WINDOW):
                begin = min(at, len(text) - language.WINDOW)
                low, high = max(0, begin - language.CONTEXT), min(len(text), begin + language.WINDOW + language.CONTEXT)
                x = np.frombuffer(text, np.uint8)[None]
                states = [net._run(x[:, low : begin + language.WINDOW], "f", False)[0][begin - low :], net._run(x[:, begin:high], "b", False)[0][: language.WINDOW]]
                logs.append(np.exp(net._log_probabilities(np.concatenate(states, axis=2)))[at - begin :, 0])
            assert found == pytest.approx(np.concatenate(logs).mean(axis=0), abs=1e-4)
    long = prose(5, 2000).encode() * 300
    assert net.pooled([b"ab", long])[1].sum() == pytest.approx(1, abs=1e-3)


def test_language_learns_from_labels_of_the_rest_only(spark):
    """Scrambled labels of held-out rows, and null ones, change nothing; equal and null ids, clashing columns, held-out accuracy."""
    r = random.Random(6)
    make = lambda letters: " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(40))
    given = [(i if i % 10 else (None if i % 20 else 10), make("abcde" if i % 2 else "defgh"), "x" if i % 2 else "y") for i in range(150)]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    schema = "doc_id long, text string, lang string"
    fair = spark.createDataFrame(given, schema)
    scrambled = spark.createDataFrame([(i, t, r.choice(["x", "y", "z", None]) if out(i) else k) for i, t, k in given] + [(7, None, "w"), (8, "text", None)], schema)
    nets = [language.fit_languages(f) for f in (fair, scrambled)]
    assert nets[0].languages == nets[1].languages == ["x", "y"] and all((nets[0].p[k] == nets[1].p[k]).all() for k in nets[0].p)
    got = language.predict_languages(fair.withColumn("score", F.lit("clash")).withColumn("_row", F.lit("clash")), nets[0])
    assert got.columns == ["doc_id", "text", "lang", "_row", "lang_pred", "score"]
    told = [(x["lang"] == x["lang_pred"], 0.5 <= x["score"] <= 1) for x in got.collect() if out(x["doc_id"])]
    assert len(told) > 30 and sum(a for a, _ in told) >= 0.95 * len(told) and all(b for _, b in told)


def test_sentence_spans(spark, empty):
    shared = "First of the shared sentences. Second of the shared ones! Third shared sentence?"
    frame = spark.createDataFrame([(1, "Own one. " + shared, None, None, 1), (2, shared + " Own two.", None, None, 1), (3, None, None, None, 1), (4, "Quite different.", None, None, 1)], SCHEMA)
    assert [(r["n_removed"], r["text"]) for r in rows(sentences.drop_repeated_sentences(frame, words=1))] == [(0, "Own one. " + shared), (3, "Own two."), (0, None), (0, "Quite different.")]
    assert sentences.drop_repeated_sentences(empty).count() == 0


def test_two_shared_sentences(spark):
    shared = "Only these two are shared. They stand between others! "
    frame = spark.createDataFrame([(1, "One. " + shared + "Two.", None, None, 1), (2, "Three. " + shared + "Four.", None, None, 1)], SCHEMA)
    assert [(r["n_removed"], r["text"]) for r in rows(sentences.drop_repeated_sentences(frame, words=1))] == [(0, "One. " + shared + "Two."), (2, "Three. Four.")]
    short = spark.createDataFrame([(1, "Íllue. " * 9, None, None, 1), (2, "So it is.", None, None, 1), (3, "So it is.", None, None, 1), (4, "So was it.", None, None, 1)], SCHEMA)
    assert [(r["n_removed"], r["text"]) for r in rows(sentences.drop_repeated_sentences(short, words=1))] == [(8, "Íllue. "), (0, "So it is."), (1, ""), (0, "So was it.")]


def test_short_sentence_runs(spark):
    """Runs hold 20 words or 20 sentences; a text with fewer is one run; one long sentence is cut at its clause marks."""
    list_ = "one two three four five six seven, eight nine ten eleven twelve thirteen fourteen; fifteen sixteen seventeen eighteen nineteen twenty: more"
    frame = spark.createDataFrame([(1, "Íllue. " * 41, None, None, 1), (2, "So it is.", None, None, 1), (3, "So it is.", None, None, 1), (4, "So was it.", None, None, 1), (5, "Alone. So was it.", None, None, 1),
                                   (6, list_ + " here", None, None, 1), (7, "Before. " + list_ + " there", None, None, 1), (8, "\n. \n. " * 30, None, None, 1)], SCHEMA)
    got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in sentences.drop_repeated_sentences(frame).collect()}
    assert got[1] == (40, "Íllue. ") and got[8][0] == 59 and got[8][1].strip()
    assert [got[i] for i in (2, 3, 4, 5)] == [(0, "So it is."), (1, ""), (0, "So was it."), (0, "Alone. So was it.")]
    assert got[6][0] == 0 and got[7] == (3, "Before. more there")


def test_sentence_spans_of_equal_and_null_ids(spark):
    """Rows of one id or none are told apart; rows equal in both are one document; a column's name may clash; long texts."""
    a, b = prose(1, 80), prose(2, 80)
    long = ". ".join(prose(3, 40).replace(".", "") + str(k) for k in range(3000))
    given = [(1, a), (2, a), (2, b), (2, b), (None, "none " + b), (None, None), (7, long), (8, long)]
    frame = spark.createDataFrame(given, "doc_id long, text string").withColumn("at", F.lit("clash")).withColumn("k", F.lit("clash")).withColumn("n_removed", F.lit("clash"))
    got = sorted(((r["doc_id"], r["n_removed"] > 0, r["text"]) for r in sentences.drop_repeated_sentences(frame).collect()), key=str)
    assert [x for x in got if x[0] == 1] == [(1, False, a)] and [x for x in got if x[0] == 7] == [(7, False, long)] and (8, True, "") in got
    assert sorted(x[1] for x in got if x[0] == 2) == [True, True, True] and all(len(x[2]) < len(b) for x in got if x[0] == 2)
    assert (None, False, None) in got and (None, False, "none " + b) in got


def test_media_round_trip(docs, empty, texts):
    got = rows(media.read_media(media.store_media(docs)))
    for r, t in zip(got, texts, strict=True):
        data = (t or "").encode()
        assert bytes(r["payload"]) == data.ljust(max(1, -(-len(data) // 64)) * 64, b"\0")
    assert got[4]["thumbnail_hash"] == got[5]["thumbnail_hash"]
    assert media.features([None, b"", b"\xff\xd8\xff", media.write_jpeg(bytes(64))[:-20] + b"\xff\xd9"])[:3] == [None] * 3
    assert media.read_media(media.store_media(empty)).count() == 0


def test_jpeg_with_other_tables():
    """Two components with subsampling, DC differences, runs of zeros and an end of block, written bit by bit."""
    dc, ac = bytes([0, 3, *[0] * 14, 0, 3, 5]), bytes([0, 2, 1, *[0] * 13, 0x00, 0x12, 0xF0])
    bits = ""
    for dc_diff, code in ((5, "01"), (-4, "01"), (0, "00"), (20, "10"), (6, "01")):
        size = {"00": 0, "01": 3, "10": 5}[code]
        value = dc_diff if dc_diff >= 0 else dc_diff + (1 << size) - 1
        bits += code + (f"{value:0{size}b}" if size else "")
        bits += "01" + "11" + "00"  # one zero, then 3, then the end of the block
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    s = media._segment
    data = b"\xff\xd8" + s(0xDB, bytes([0, 8, *[1] * 63])) + s(0xC0, bytes([8, 0, 16, 0, 16, 2, 1, 0x22, 0, 2, 0x11, 0])) + s(0xC4, b"\x00" + dc) + s(0xC4, b"\x10" + ac) + s(0xDA, bytes([2, 1, 0, 2, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    image = media.parse_jpeg(data)
    (y, cb), = media.decode_together([image])
    assert y[:, :, 0].tolist() == [[5, 1], [1, 21]] and cb[0, 0, 0] == 6 and y[0, 0, 2] == 3
    assert media.thumbnail(image, y).tolist() == [[133, 129], [129, 149]]


def test_sharding(docs, empty, texts):
    got = rows(sharding.interleave(docs, shards=4))
    assert [(r["size"], r["text_crc32"]) for r in got] == [(len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts]
    of_shard = {k: sorted(r["slot"] for r in got if r["shard"] == k) for k in range(4)}
    assert all(v == list(range(len(v))) for v in of_shard.values()) and max(map(len, of_shard.values())) - min(map(len, of_shard.values())) <= 1
    assert sharding.interleave(empty).count() == 0


def test_sharding_matches_the_mixture(spark):
    """Every shard holds each source's share, to a row or two; a hot source, null ids and sources, rows repeated; another seed gives another order."""
    r = random.Random(2)
    given = [(i if i % 9 else None, f"text {i % 50}", r.choice(["hot", "hot", "a", "b", None])) for i in range(2500)]
    given += given[:40]
    frame = spark.createDataFrame(given, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("_n", F.lit("clash")).repartition(5)
    got, other = sharding.interleave(frame, shards=7).collect(), sharding.interleave(frame, shards=7, seed="two").collect()
    assert sorted(((x["doc_id"], x["source"], x["text_crc32"]) for x in got), key=str) == sorted(((i, s, zlib.crc32(t.encode())) for i, t, s in given), key=str)
    for shard in range(7):
        own = [x for x in got if x["shard"] == shard]
        assert sorted(x["slot"] for x in own) == list(range(len(own))) and abs(len(own) - len(given) / 7) < 1
        for source in ("hot", "a", "b", None):
            assert abs(sum(x["source"] == source for x in own) - sum(g[2] == source for g in given) / 7) <= 2
    place = lambda found: {(x["doc_id"], x["source"]): (x["shard"], x["slot"]) for x in found if x["doc_id"]}
    assert place(got) != place(other)


@pytest.mark.parametrize("wide", [suffixes.WIDE, 1])
def test_suffixes_against_brute_force(docs, empty, texts, wide):
    got = rows(suffixes.cut_repeats(docs, wide=wide))
    assert [(r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in got] == suffixes.brute_force([(t or "").encode() for t in texts])
    assert suffixes.cut_repeats(empty).count() == 0


@pytest.mark.parametrize(("length", "gram", "step"), [(200, 64, 40), (50, 16, 10), (33, 9, 8), (12, 5, 5), (8, 8, 8)])
def test_refinement_against_brute_force(length, gram, step):
    """Pieces with copies, strings that end within a piece, all depths."""
    r = random.Random(length)
    base = bytes(r.choice(b"ab") for _ in range(3 * length))
    pieces = [bytes(r.choice(b"ab") for _ in range(r.randint(0, length))) + base[k : k + r.randint(length, 2 * length)] for k in (r.randint(0, length) for _ in range(20))] + [b"ab" * length, b"x" * (2 * length)]
    copies = [1 + (k % 7 == 0) for k in range(len(pieces))]
    seen = {}
    for p, n in zip(pieces, copies, strict=True):
        for i in range(len(p) - length + 1):
            seen[p[i : i + length]] = seen.get(p[i : i + length], 0) + n
    expected = [i + length <= len(p) and seen[p[i : i + length]] > 1 for p in pieces for i in range(len(p))]
    got = suffixes.repeated_windows(np.frombuffer(b"".join(pieces), np.uint8), np.array(list(map(len, pieces))), np.array(copies), length, step)
    assert got.tolist() == expected


def test_suffixes_of_long_texts_and_equal_ids(spark):
    """Texts longer than what is hashed together; null and equal ids; other depths; repeated rows."""
    r = random.Random(1)
    big = "".join(r.choices("abcdefgh", k=1_300_000))
    frame = spark.createDataFrame([(1, "." * 150 + big), (2, big + "!" * 100)], "doc_id long, text string").repartition(2)
    assert [(x["n_removed"], x["n_spans"]) for x in rows(suffixes.cut_repeats(frame))] == [(len(big), 1)] * 2
    texts = [prose(k, 30) + " " + prose(90 + k % 3, 12) for k in range(8)] + [prose(0, 30), None, prose(5, 40), prose(5, 40)]
    ids = [4, 4, 4, None, None, 5, 6, 7, 4, None, 8, 8]
    frame = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").withColumn("copies", F.lit("clash")).withColumn("extent", F.lit("clash"))
    for length, gram, step in ((60, 20, 15), (30, 10, 8)):
        got = [(x["doc_id"], x["n_removed"], x["n_spans"], hashlib.sha256(bytes(x["kept"])).hexdigest()) for x in suffixes.cut_repeats(frame, length, gram, step).collect()]
        expected = [(i, *x) for i, x in zip(ids, suffixes.brute_force([(t or "").encode() for t in texts], length), strict=True)]
        assert sorted(got, key=str) == sorted(expected, key=str)


def shingled(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


@pytest.mark.parametrize(("paired", "block"), [(jaccard.PAIRED, jaccard.BLOCK), (2, 600), (1, 1)])
def test_jaccard_against_brute_force(spark, empty, texts, paired, block):
    base = prose(9, 120).split(" ")
    more = [" ".join(w if random.Random(k).random() > 0.01 or i % 40 else "new" for i, w in enumerate(base)) for k in range(12)]
    whole = texts + [" ".join(base[:-k] if k else base) for k in range(8)] + more
    sets = [shingled(t) for t in whole]
    label = list(range(len(whole)))
    for _ in whole:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    frame = spark.createDataFrame(list(enumerate(whole)), "doc_id long, text string").repartition(3)
    got = rows(jaccard.near_duplicates(frame, paired=paired, block=block))
    assert [(r["n_shingles"], r["component_id"]) for r in got] == [(len(s), x) for s, x in zip(sets, label, strict=True)]
    if paired > 2:
        assert jaccard.near_duplicates(empty).count() == 0


def links_of(members, percent=80, sides=None):
    sets = [set(m.tolist()) for m in members]
    return {(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and (not sides or sides[i] != sides[j] or not sides[i])}


def labels_of(n, links):
    label = list(range(n))
    for _ in range(n):
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    return label


@pytest.mark.parametrize("sided", [False, True])
def test_forest_against_brute_force(sided):
    """Chains, stars, like sets that don't link, several components."""
    for seed in range(40):
        r = np.random.default_rng(seed)
        bases = [r.choice(400, r.integers(3, 40), replace=False) for _ in range(3)]
        members = []
        for _ in range(30):
            own = bases[r.integers(3)].copy()
            change = r.random(len(own)) < r.choice([0.0, 0.05, 0.15])
            own[change] = r.integers(400, 900, change.sum())
            members.append(np.unique(own).astype(np.uint64))
        sides = [int(x) for x in r.integers(1, 3, len(members))] if sided else [0] * len(members)
        got = jaccard._forest(list(range(len(members))), members, sides, 80)
        links = links_of(members, sides=sides if sided else None)
        assert {(max(e), min(e)) for e in got} <= links
        assert labels_of(len(members), got) == labels_of(len(members), links) and len(got) == len(members) - len(set(labels_of(len(members), links)))


def test_forest_of_many_like_sets():
    r, base = np.random.default_rng(1), np.arange(200, dtype=np.uint64)
    members = []
    for k in range(20_000):
        own = base.copy()
        own[r.choice(200, 6, replace=False)] = 1000 + 6 * k + np.arange(6)
        members.append(np.sort(own))
    began = time.process_time()
    got = jaccard._forest(list(range(len(members))), members, [0] * len(members), 80)
    assert len(got) == len(members) - 1 and time.process_time() - began < 20


def test_jaccard_of_null_and_equal_ids(spark):
    """Links of sets that only rows without an id, or several rows of one id, have; a long text; clashing columns."""
    a, b, c, long = prose(1, 60), prose(2, 60), prose(3, 60), prose(4, 30_000)
    given = [(None, a + " end"), (1, a), (None, a + " end more"), (2, b), (2, c), (3, c + " end"), (4, b + " end"), (None, None), (None, "alone and without any id at all"), (8, long), (9, long + " end"), (5, ""), (5, "")]
    frame = spark.createDataFrame(given, "doc_id long, text string").withColumn("node", F.lit("clash")).withColumn("_kept", F.lit(7)).repartition(3)
    got = sorted(((r["doc_id"], r["n_shingles"] > 0, r["component_id"]) for r in jaccard.near_duplicates(frame).collect()), key=str)
    assert got == sorted([(None, True, 1), (1, True, 1), (None, True, 1), (2, True, 2), (2, True, 2), (3, True, 2), (4, True, 2), (None, False, None), (None, True, None), (8, True, 8), (9, True, 8), (5, False, 5), (5, False, 5)], key=str)
    kept = jaccard.one_of_each(frame)
    assert kept.columns == frame.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 0, 0, 1, 2, 2, 5, 5, 8]


def test_search_against_brute_force(spark, docs, texts):
    got = search.top_k(docs, docs.filter("doc_id in (4, 8, 12)"), k=5).collect()
    words = [re.findall(rb"[a-z0-9\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())) for t in texts]
    n, mean = len(words), sum(map(len, words)) / len(words)
    df = {w: sum(w in x for x in words) for x in words for w in x}
    for q in (4, 8, 12):
        scores = [(-sum(np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(x) / mean)) for w in words[q] if (f := x.count(w))), i) for i, x in enumerate(words)]
        best = [(i, -s) for s, i in sorted((round(s, 9), i) for s, i in scores) if s < 0][:5]
        own = sorted((r["rank"], r["doc_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [x[1] for x in own] == [i for i, _ in best]
        assert [x[2] for x in own] == pytest.approx([s for _, s in best])


def test_search_with_many_blocks_and_shards(spark, monkeypatch):
    """Several shards and query groups, more than ten blocks, exact copies that tie at the k-th place, null and empty texts, null ids; a good part of the postings is skipped."""
    r = random.Random(8)
    letters = ["abcdefgh", "ijklmnop", "qrstuvwx"]
    word = lambda own: "".join(r.choice(own) for _ in range(r.choice([1, 2, 2, 3])))
    texts = [" ".join(word(letters[i % 3]) for _ in range(r.randint(5, 60))) for i in range(1500)]
    texts += [texts[30]] * 15 + [None, "", "never seen before"]
    given = list(enumerate(texts)) + [(None, texts[30])]
    frame = spark.createDataFrame(given, "doc_id long, text string").withColumn("term", F.lit("clash")).repartition(3)
    queries = frame.filter("doc_id % 50 = 0 or doc_id in (30, 1515, 1516, 1517) or doc_id is null")
    got = search.top_k(frame, queries, k=5, at_once=400).collect()
    words = [(t or "").split() for t in texts]
    n, mean = len(words), sum(map(len, words)) / len(words)
    df = Counter(w for x in words for w in set(x))
    for q in [*range(0, 1500, 50), 30, 1515, 1516, 1517]:
        scores = []
        for i, x in enumerate(words):
            s = sum(np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(x) / mean)) for w in words[q] if (f := x.count(w)))
            scores.append((-round(s, 9), i))
        best = [(i, -s) for s, i in sorted(scores) if s < 0][:5]
        own = sorted((x["rank"], x["doc_id"], x["score"]) for x in got if x["query_id"] == q)
        assert [x[1] for x in own] == [i for i, _ in best] and [x[2] for x in own] == pytest.approx([s for _, s in best])
    assert {x["query_id"] for x in got} <= {i for i, t in given if t} and search.top_k(frame.limit(0), queries).count() == 0 == search.top_k(frame, queries.limit(0)).count()
    # one shard alone: what is skipped
    data = [t.encode() for t in texts[:1500]]
    doc, term, count, lengths = search.terms(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    shard = search.ShardIndex({c: v[0].as_py() for c, v in zip(search.shard_row(np.arange(1500), lengths, doc, term, count).schema.names, search.shard_row(np.arange(1500), lengths, doc, term, count).columns, strict=True)}, mean)
    shard.search(shard.find(np.sort(term[doc == 30]))[0], np.ones((doc == 30).sum()), 1)
    assert shard.blocks > 10 and 0 < shard.looked < 0.75 * shard.held


def test_few_documents_are_scored_in_full(monkeypatch):
    """A search that starts from a score scores little more than what it finds: rare terms before the pivot are added up for the candidates first."""
    r, scored, score = np.random.default_rng(3), [], search.ShardIndex._score
    data = [" ".join([f"w{x}" for x in r.integers(0, 300, n)] + [f"t{k % 20}x{x} " for x in r.integers(0, 150, n)]).encode() for k in range(2000) for n in [int(r.integers(100, 200))]]
    doc, term, count, lengths = search.terms(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    row = search.shard_row(np.arange(2000), lengths, doc, term, count)
    shard = search.ShardIndex({c: row.column(c)[0].as_py() for c in search.INDEX}, lengths.mean())
    monkeypatch.setattr(search.ShardIndex, "_score", lambda self, t, w, alive: scored.append(len(alive)) or score(self, t, w, alive))
    found = 0
    for q in range(0, 2000, 50):
        place = shard.find(np.sort(term[doc == q]))[0]
        weight = np.log(1 + (2000 - shard.number[place] + 0.5) / (shard.number[place] + 0.5))
        every = score(shard, place, weight, np.arange(2000))
        best = np.lexsort((shard.ids, -every))[:10]
        scored.clear()
        ids, scores = shard.search(place, weight, 10, every[best[-1]])
        assert ids.tolist() == shard.ids[best].tolist() and scores.tolist() == every[best].tolist()
        found += scored[0]
    assert found <= 40 * 10 * 1.2


def test_queries_are_searched_together_and_only_where_documents_may_reach(monkeypatch):
    """Four vocabularies: products are of the groups that hold a query's own, and the results are those of each query scored against all documents."""
    r = np.random.default_rng(4)
    monkeypatch.setattr(search, "GROUP", 256)
    monkeypatch.setattr(search, "BLOCK", 32)
    data = [" ".join([f"c{k % 4}x{x} " for x in r.zipf(1.3, n) % 4000]).encode() for k in range(2000) for n in [int(r.integers(20, 300))]]
    data[40], data[80] = data[0], b""
    doc, term, count, lengths = search.terms(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    row = search.shard_row(np.arange(2000), lengths, doc, term, count)
    shard = search.ShardIndex({c: row.column(c)[0].as_py() for c in search.INDEX}, lengths.mean())
    places = [shard.find(np.sort(term[doc == q]))[0] for q in [*range(0, 2000, 19), 40, 80]]
    queries = [(p, np.log(1 + (2000 - shard.number[p] + 0.5) / (shard.number[p] + 0.5))) for p in places]
    every = [shard._score(*query, np.arange(2000)) for query in queries]
    best = [np.lexsort((shard.ids, -e))[:10] for e in every]
    best = [b[e[b] > 0] for b, e in zip(best, every, strict=True)]
    for least in (np.zeros(len(queries)), np.array([e[b[-1]] if len(b) else 0.0 for e, b in zip(every, best, strict=True)])):
        shard.multiplied = 0
        for (ids, scores), e, b in zip(shard.search_all(queries, 10, least), every, best, strict=True):
            assert ids.tolist() == shard.ids[b].tolist() and scores.tolist() == e[b].tolist()
        assert 0 < shard.multiplied < 0.4 * len(queries) * 2000
    none = search.shard_row(np.arange(3), np.zeros(3, np.int64), *(np.zeros(0, np.int64) for _ in range(3)))
    empty = search.ShardIndex({c: none.column(c)[0].as_py() for c in search.INDEX}, 0.0)
    assert not len(best[-1]) and len(best[0]) == 10 and not len(empty.search(empty.find(term[:5])[0], np.zeros(0), 10)[0])


def test_rows_that_leave_shards_do_not_follow_their_number(spark, monkeypatch):
    """Rounds start from the scores so far, so 32 shards do not give k rows a query each."""
    r, found, kept = random.Random(5), [], search.stored
    frame = spark.createDataFrame([(i, " ".join(r.choice("abcdefghijklmnopqrst") * r.choice([1, 2, 3]) for _ in range(30))) for i in range(960)], "doc_id long, text string").repartition(32)

    def counted(session, df, what):
        out = kept(session, df, what)
        if what == "found":
            found.append(out.count())
        return out

    monkeypatch.setattr(search, "stored", counted)
    assert search.top_k(frame, frame.filter("doc_id % 80 = 0"), k=5).count() == 60
    assert sum(found) < 0.4 * 12 * 5 * 32


def test_statistics_come_from_the_index(spark, docs, texts):
    """Texts are not read again for document frequencies, lengths and counts."""
    words = [re.findall(rb"[a-z0-9\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())) for t in texts]
    index = search.build_index(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartition(3))
    got = {r["term"]: (r["n"], r["total"]) for r in search.statistics(index).collect()}
    assert got.pop(None) == (len(words), sum(map(len, words)))
    assert sorted(got.values()) == sorted((n, 0) for n in Counter(w for x in words for w in set(x)).values())


def test_first_round_searches_shards_side_by_side(spark, monkeypatch):
    """Four shards and four cores are one round, in which no core waits for the first shard's scores; eight shards are two."""
    found, kept = [], search.stored
    frame = spark.createDataFrame([(i, f"a{i % 7} b{i % 5} c{i % 3}") for i in range(80)], "doc_id long, text string")
    monkeypatch.setattr(search, "stored", lambda session, df, what: found.append(what) or kept(session, df, what))
    monkeypatch.setattr(search, "FIRST", 4)
    for shards, rounds in ((4, 1), (8, 2)):
        found.clear()
        assert search.top_k(frame.repartition(shards), frame.filter("doc_id % 20 = 0"), k=5).count() == 20
        assert found.count("found") == rounds


def test_mixing_meets_targets(spark, empty):
    docs = spark.createDataFrame([(i, "good words here" if i % 3 else "bad !!! words", None, None, 1) for i in range(300)] + [(999, None, None, None, 1)], SCHEMA)
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0, 0) for i in range(150)], "doc_id long, quality int, toxic int")
    out = mixing.mix(docs, labels, targets={"high": 0.5, "low": 0.5}, budget=1.0)
    share = out.agg(*(F.sum(F.col("rate") * F.col("n_tokens") * F.col(f"p_{d}")) / F.sum("n_tokens") for d in ("high", "low"))).first()
    assert list(share) == pytest.approx([0.5, 0.5], abs=0.02)
    assert out.filter("rate < 0 or copies < 0").count() == 0
    assert mixing.mix(empty, labels.limit(0)).count() == 0


def plain_rates(n, p, wanted, metric, budget):
    """The totals of rates that projected gradient finds over explicit arrays, in 20,000 small steps."""
    rate, inverse = np.full(len(n), budget), np.linalg.inv(metric)
    for _ in range(20_000):
        rate = np.maximum(0, rate - 0.1 * p @ (inverse @ ((rate * n) @ p - wanted)))
    return (rate * n) @ p


@pytest.mark.parametrize(("targets", "reached"), [({"high": 0.5, "low": 0.3, "toxic": 0.2}, True), ({"high": 0.7, "low": 0.3, "toxic": 0.0}, False)])
def test_rates_against_a_plain_solver(spark, targets, reached):
    """Totals meet targets that can be met; others are come near to, in the metric of the second moments, if not as near in STEPS steps as by 20,000."""
    r = np.random.default_rng(4)
    p, tokens = 0.7 * r.dirichlet([2, 2, 1], 400) + 0.1, r.integers(1, 900, 400)
    members = spark.createDataFrame([(int(n), *map(float, x)) for n, x in zip(tokens, p, strict=True)], "n_tokens long, p_high double, p_low double, p_toxic double")
    rates = np.array([x[0] for x in members.select(mixing.fitted_rates(members, targets, 1.0)).collect()])
    n, wanted = tokens / tokens.sum(), np.array([targets[d] for d in mixing.DOMAINS])
    metric = (p * n[:, None]).T @ p
    got, plain = (rates * n) @ p, plain_rates(n, p, wanted, metric, 1.0)
    far = lambda totals: float((totals - wanted) @ np.linalg.inv(metric) @ (totals - wanted))
    assert (rates >= 0).all() and far(got) <= (1.02 if reached else 1.5) * far(plain) + 1e-6
    assert (np.abs(got - wanted).max() < 1e-5) == reached


def test_mixing_of_equal_and_null_ids(spark):
    """Rows of one id or none each get their own posteriors; null texts have no tokens; columns of our names are replaced, others pass through."""
    given = [(i, "good words here" if i % 3 else "bad !!! words") for i in range(300)] + [(1, "bad !!! words"), (None, "good words here"), (None, None)]
    docs = spark.createDataFrame(given, "doc_id long, text string").withColumn("rate", F.lit("clash")).withColumn("domain", F.lit("kept"))
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0, 0) for i in range(200)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = mixing.mix(docs, labels).collect()
    assert len(got) == len(given) and {x["domain"] for x in got} == {"kept"} and all(isinstance(x["rate"], float) for x in got)
    by = {(x["doc_id"], x["text"]): x for x in got}
    assert by[1, "good words here"]["p_high"] > 0.5 > by[1, "bad !!! words"]["p_high"] and by[None, None]["n_tokens"] == 0
    told = {x["domain"]: (x["target"], x["share"]) for x in mixing.reached(mixing.mix(docs, labels, targets={"high": 0.7, "low": 0.3}), {"high": 0.7, "low": 0.3}).collect()}
    assert told["high"] == pytest.approx((0.7, 0.7), abs=0.01) and told["low"] == pytest.approx((0.3, 0.3), abs=0.01)
    mixed = mixing.mixed_documents(docs, labels)
    assert mixed.columns == docs.columns and mixed.count() == sum(x["copies"] for x in got)


def test_records(spark, docs, empty, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(records.TOKENIZER))
    folder = new_path(spark, "test-records")
    index = records.write_records(docs, folder, file_bytes=4000)
    assert index.select("file").distinct().count() > 2
    read = records.read_records(records.with_starts(index), folder, lambda i, ids: {"ids": ids.tolist()}, "ids array<long>")
    expected = [tokenizer.encode(t or "", add_special_tokens=False).ids + [records.END] for t in texts]
    got = rows(read)
    assert [r["ids"] for r in got] == expected
    assert [r["start"] for r in got] == [sum(map(len, expected[:i])) for i in range(len(texts))]
    good = records.frame(b"abc")
    assert list(records.frames(good + good)) == [b"abc"] * 2
    with pytest.raises(ValueError):
        records.unframe(good[:-1] + bytes([good[-1] ^ 1]))
    assert records.write_records(empty, new_path(spark, "none")).count() == 0


def test_records_of_special_strings():
    """Words alone, one after another, give what the library gives for the whole text."""
    tokenizer, memo, r = Tokenizer.from_file(public_tokenizers.path(records.TOKENIZER)), records.WordMemo(public_tokenizers.path(records.TOKENIZER)), random.Random(3)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "|>", " ", "  ", "\n", "\t", "\r", "\x1c", "\u00a0", "Word", "é", "e\u0301", "\u0301", "don't", "'S", "12", "日本", "İ", ",", "%$", "ß."]
    for text in ["a <|endoftext|> b", "a<|startoftext|>b", *("".join(r.choice(parts) for _ in range(r.randint(1, 12))) for _ in range(3000))]:
        assert np.frombuffer(next(memo.encode([text], records.END)), "<u2").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, records.END], repr(text)


def test_records_of_null_and_equal_ids(spark):
    """Null ids first; rows of one id in an order of their texts' hashes, over several files; the query's digests."""
    given = [(None, f"no id {k} " * 40) for k in range(30)] + [(5, f"same id {k} " * 40) for k in range(30)] + [(5, "twice"), (5, "twice"), (6, None), (-3, "less")]
    frame = spark.createDataFrame(given, "doc_id long, text string").withColumn("part", F.lit("clash")).withColumn("record", F.lit("clash"))
    folder = new_path(spark, "test-records")
    index = records.write_records(frame, folder, file_bytes=2500)
    assert index.select("file").distinct().count() > 5
    got = records.read_records(records.with_starts(index), folder, lambda i, ids: {"ids": ids.tolist()}, "ids array<long>").orderBy("start").collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path(records.TOKENIZER))
    expected = sorted((i is not None, i or 0, tokenizer.encode(t or "", add_special_tokens=False).ids + [records.END]) for i, t in given)
    assert [r["doc_id"] for r in got] == [i if known else None for known, i, _ in expected]
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["ids"]) for r in got) == expected
    assert [r["start"] for r in got] == [sum(len(x["ids"]) for x in got[:k]) for k in range(len(got))]


def test_records_query(spark, tmp_path, docs, texts):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    tokenizer, start = Tokenizer.from_file(public_tokenizers.path(records.TOKENIZER)), 0
    for r, t in zip(rows(records.op10_token_records(spark, str(tmp_path))), texts, strict=True):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [records.END], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
