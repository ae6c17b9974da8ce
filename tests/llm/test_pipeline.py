import hashlib
import random
from pathlib import Path

import public_tokenizers
import tiktoken

import corpus_pipeline
from pricebasket.llm import bpe, suffixes
from pricebasket.session import shared_folder
from tests.llm.test_operators import SCHEMA, prose, shingled


def test_stages_against_brute_force(spark, tmp_path):
    shared = prose(100, 70)
    texts = [prose(k, 60) + (" " + shared if k % 4 == 0 else "") + " " + prose(50 + k, 30) for k in range(12)]
    texts += [texts[1], texts[2] + " more", None, "", "12 !!"]
    whole = dict(enumerate(texts))
    spark.createDataFrame([(i, t, "en" if i % 2 else "de", "s", len(t or "")) for i, t in whole.items()], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    kept = stage["near_duplicates"](spark, docs, str(tmp_path))
    sets = {i: shingled(t) for i, t in whole.items()}
    near = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert kept.columns == docs.columns
    assert ids == [i for i in whole if not any(near(sets[i], sets[j]) for j in range(i))]

    cut = {r["doc_id"]: r for r in stage["repeated_substrings"](spark, kept, str(tmp_path)).collect()}
    for i, (removed, _, digest) in zip(ids, suffixes.brute_force([(whole[i] or "").encode() for i in ids]), strict=True):
        assert hashlib.sha256((cut[i]["text"] or "").encode()).hexdigest() == digest
        assert not removed or cut[i]["n_chars"] == len(cut[i]["text"])

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY)), special_tokens={})
    mixed = stage["mixing"](spark, kept, str(tmp_path))
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= set(ids)
    for r in stage["byte_bpe"](spark, kept, str(tmp_path)).collect():
        assert r["token_ids"] == library.encode_ordinary(whole[r["doc_id"]] or "") and r["n_tokens"] == len(r["token_ids"])


def corpus(r, n):
    """Texts of two languages that their letters tell apart."""
    words = {"aa": ["".join(r.choice("abcdeio") for _ in range(r.randint(2, 7))) for _ in range(60)], "zz": ["".join(r.choice("stuvwxyz") for _ in range(r.randint(2, 7))) for _ in range(60)]}
    return [(lang, " ".join(r.choice(words[lang]) for _ in range(r.randint(40, 90)))) for lang in (r.choice(["aa", "zz"]) for _ in range(n))]


CLASHING = SCHEMA + ", lang_pred string, score string, component_id string, anchor string, kept string, rate string, copies string, n_tokens string, node string"


def written(spark, where, rows, labels):
    spark.createDataFrame([(*r, *["clash"] * 9) for r in rows], CLASHING).repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")


def test_the_whole_pipeline_on_awkward_rows(spark, tmp_path):
    """Null and equal ids, null, empty and letterless texts, copies, clashing columns: all stages, and what comes out is encoded as the library does."""
    r = random.Random(4)
    texts = corpus(r, 60)
    shared = corpus(r, 1)[0][1] * 2
    rows = [(i, t, lang, "s", len(t)) for i, (lang, t) in enumerate(texts)]
    rows += [(100, texts[3][1], texts[3][0], "s", 1), (101, texts[3][1], None, "s", 1), (None, corpus(r, 1)[0][1], "aa", None, None), (None, None, None, None, None), (7, corpus(r, 1)[0][1], "zz", "s", 1)]
    rows += [(200, None, "aa", "s", 0), (201, "", "aa", "s", 0), (202, "123 !!", "zz", "s", 6), (203, texts[8][1] + " " + shared, texts[8][0], "s", 1), (204, texts[9][1] + " " + shared, texts[9][0], "s", 1)]
    written(spark, tmp_path, rows, [(i, i % 2, 0) for i in range(60)] + [(None, 1, None), (5, None, None)])
    left = Path(shared_folder(spark).removeprefix("file://"))
    before = set(left.glob("*"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.name.split("-")[0:2] == ["stage", "byte_bpe"] for p in set(left.glob("*")) - before} == {True}  # the result alone stays

    ids = {x["doc_id"] for x in got}
    assert not ids & {200, 201, 202} and len(ids & {3, 100, 101}) <= 1
    docs, stage = spark.read.parquet(f"{tmp_path}/documents.parquet"), dict(corpus_pipeline.STAGES)
    spoken = stage["language_id"](spark, docs, str(tmp_path))
    assert spoken.columns == docs.columns
    told = [x["doc_id"] for x in spoken.collect()]
    assert not {200, 201, 202} & set(told) and len(told) >= 0.9 * (len(rows) - 4)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY)), special_tokens={})
    for x in got:
        text = library.decode(x["token_ids"])
        assert x["n_tokens"] == len(x["token_ids"]) and x["token_ids"] == library.encode_ordinary(text)
        assert any(text in (t or "") or (t or "").startswith(text[:20]) or (t or "").endswith(text[-20:]) for i, t, *_ in rows if i == x["doc_id"])


def test_the_whole_pipeline_on_nothing(spark, tmp_path):
    written(spark, tmp_path, [], [])
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() == 0 and {"doc_id", "n_tokens", "token_ids"} <= set(got.columns)
