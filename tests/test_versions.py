"""The store of committed snapshots, and the monthly job over it."""

import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pricebasket.functions.similarity import best_match
from pricebasket.jobs import collect as collecting
from pricebasket.jobs import monthly
from pricebasket.operators import extract, graphs, linking, store
from pricebasket.session import shared_folder
from pricebasket.settings import Settings
from pricebasket.sources import schemas, snapshots, tables
from pricebasket.sources.snapshots import Change, Store

SELECTORS = (".m", ".n", ".p")
OUTLETS = [(o, o.upper(), "casual", f"https://{o}.example", "static", True, SELECTORS, None) for o in "abcdef"]
FOOD = "chowder bisque burger noodles dumpling pancake omelette sandwich tortilla lasagne risotto goulash".split()


def html(items):
    return "".join(f"<div class=m><b class=n>{n}</b><i class=p>${c / 100:.2f}</i></div>" for n, c in items)


def pages(spark, rows):
    return spark.createDataFrame([(o, p, "u", h, f"{p}-{day:02d}") for o, p, h, day in rows], schemas.PAGES)


def config(spark):
    return spark.createDataFrame(OUTLETS, schemas.OUTLET_CONFIG)


def menu(r, n=6):
    out = []
    for _ in range(n):
        name = f"{r.choice(FOOD)} with {r.choice(FOOD)}"
        for _ in range(r.randrange(2)):
            k = r.randrange(len(name))
            name = name[:k] + r.choice("xs") + name[k:]
        out.append((name, 100 * r.randint(2, 40)))
    return out


def state(store):
    """All that readers see, without what a repeat may number anew."""
    at = store.snapshot()
    of = lambda name, schema: sorted(map(str, store.read(name, schema, at=at).collect()))
    return of("items", schemas.ITEMS), of("observations", schemas.OBSERVATIONS), of("log", schemas.COLLECTION_LOG), of("grams3", monthly.POSTINGS), of("gram_counts3", monthly.COUNTS), of("runs", monthly.RUNS)


def plain_fold(batches, threshold=0.88):
    """Linking of all batches, one row after the other: for each outlet its keys in order, for each row its key."""
    keys, out = {}, {}
    for batch in batches:
        before = {o: list(k) for o, k in keys.items()}
        for o, p, items in sorted(batch, key=lambda x: (x[1])):
            seen = set()
            for name, cents in items:
                if (name, cents) in seen:
                    continue
                seen.add((name, cents))
                key = " ".join(w for w in name.split() if w not in ("with",))
                known = keys.setdefault(o, [])
                found, _ = (key, 1.0) if key in before.get(o, []) else best_match(key, known, threshold)
                if found is None:
                    known.append(key)
                out[o, p, found or key] = cents
    return keys, out


def test_a_history_in_batches_is_the_fold(spark, tmp_path):
    """Months in batches, some over again: items and observations are those of the plain fold, through the stored index."""
    r, own = random.Random(5), Store(spark, str(tmp_path / "store"))
    batches = [[(o, f"2026-{m:02d}", menu(r)) for o in "abc"] for m in (1, 2)] + [[("d", "2026-03", menu(r)), ("a", "2026-03", menu(r))]]
    for k, batch in enumerate(batches):
        monthly.collect_into(own, pages(spark, [(o, p, html(i), 1) for o, p, i in batch]), config(spark), "real", f"b{k}")
    keys, prices = plain_fold(batches)
    items = own.read("items", schemas.ITEMS).collect()
    assert {(x["outlet_id"], x["match_key"]) for x in items} == {(o, k) for o, ks in keys.items() for k in ks}
    named = {x["item_id"]: (x["outlet_id"], x["match_key"]) for x in items}
    got = {(*named[x["item_id"]][:1], x["period"], named[x["item_id"]][1]): x["price_cents"] for x in own.read("observations", schemas.OBSERVATIONS).collect()}
    assert got == prices
    assert own.read("grams3", monthly.POSTINGS).select("outlet_id", "key").distinct().count() == len(items)
    report = monthly.report_of(own, "b2").agg(F.sum("fetched"), F.sum("items_written")).first()
    assert tuple(report) == (2, sum(len({*i}) for _, _, i in batches[2]))


def killed_at(n, monkeypatch):
    """Store's writes and its switch, of which the n-th dies."""
    calls = []

    def dying(f):
        def run(*a):
            calls.append(1)
            if len(calls) == n:
                raise KeyboardInterrupt
            return f(*a)

        return run

    monkeypatch.setattr(Store, "_written", dying(Store._written))
    monkeypatch.setattr(Store, "_switch", dying(Store._switch))


def test_nothing_is_half_done(spark, tmp_path, monkeypatch):
    """A commit that is killed before any of its writes leaves the version that was; repeated it gives what an undisturbed one gives."""
    own, schema = Store(spark, str(tmp_path / "store")), "id long, p string"
    rows = lambda a, b: spark.range(a, b).withColumn("p", (F.col("id") % 3).cast("string"))
    names = ("items", "observations")
    changes = lambda a, b: ([Change(t, rows(a, b), F.col("p"), ("0", "1", "2")) for t in names], [Change("log", rows(a, b), F.col("p"))])
    own.commit(own.snapshot(), "b0", *changes(0, 10))
    seen = lambda: [sorted(x["id"] for x in own.read(t, schema).collect()) for t in (*names, "log")]
    before = seen()
    for n in range(1, 5):
        with monkeypatch.context() as patch, pytest.raises(KeyboardInterrupt):
            killed_at(n, patch)
            own.commit(own.snapshot(), "b1", *changes(5, 30))
        assert seen() == before and own.snapshot().version == 1
    after = own.commit(own.snapshot(), "b1", *changes(5, 30))
    assert seen() == [list(range(5, 30))] * 2 + [sorted([*range(10), *range(5, 30)])]
    assert own.commit(after, "b1", *changes(0, 1)) == after and own.commit(after, "b0") == after
    own.commit(after, "b2", *changes(0, 3))
    named = {f.split("/")[0] for v in own._versions() for parts in own.snapshot(v).tables.values() for f in sum(parts.values(), ())}
    assert set(own._names("data")) == named  # what the killed commits wrote is gone
    assert len(own._versions()) == snapshots.KEPT


def test_a_killed_month_can_be_repeated(spark, tmp_path, monkeypatch):
    """Killed at its last write, a month leaves the store as it was; repeated, it gives what an undisturbed one gives, and once more changes nothing."""
    r = random.Random(1)
    batches = [pages(spark, [("a", f"2026-0{m}", html(menu(r, 4)), 1)]) for m in (1, 2)]
    calm, wild = (Store(spark, str(tmp_path / x)) for x in ("calm", "wild"))
    monthly.collect_into(wild, batches[0], config(spark), "real", "b0")
    shutil.copytree(tmp_path / "wild", tmp_path / "calm")
    monthly.collect_into(calm, batches[1], config(spark), "real", "b1")
    before = state(wild)
    with monkeypatch.context() as patch, pytest.raises(KeyboardInterrupt):
        killed_at(6, patch)
        monthly.collect_into(wild, batches[1], config(spark), "real", "b1")
    assert state(wild) == before
    monthly.collect_into(wild, batches[1], config(spark), "real", "b1")
    assert state(wild) == state(calm)
    assert monthly.collect_into(wild, batches[0], config(spark), "real", "b1").version == 2
    left = Path(shared_folder(spark).removeprefix("file://"))
    assert not [x for x in left.glob("run-*") if len(x.name) == len("run-") + 32]  # what a run stores goes with it


def test_a_batch_touches_its_own_parts(spark, tmp_path):
    """One outlet's batch rewrites one part of the items and one month, and reads no other month and no index part without its grams."""
    r, own = random.Random(2), Store(spark, str(tmp_path / "store"))
    monthly.collect_into(own, pages(spark, [(o, m, html(menu(r)), 1) for o in "abcdef" for m in ("2026-01", "2026-02")]), config(spark), "real", "b0")
    base, read = own.snapshot(), []
    opened = own.read
    own.read = lambda table, schema, parts=None, at=None: read.append((table, None if parts is None else set(parts))) or opened(table, schema, parts, at)
    after = monthly.collect_into(own, pages(spark, [("a", "2026-02", html([("zzyzx", 500)]), 2)]), config(spark), "real", "b2")
    parts = spark.createDataFrame([("a",)], "outlet_id string").select(monthly.item_part()).first()[0]
    assert {t: {p for p, f in after.parts(t).items() if f != base.parts(t).get(p)} for t in ("items", "observations")} == {"items": {parts}, "observations": {"real@2026-02"}}
    grams = linking.grams_of(spark.createDataFrame([("zzyzx",)], "key string"), 3).select("gram", monthly.gram_part().alias("p")).collect()
    assert len({x["p"] for x in grams}) <= 7 < len(base.parts("grams3"))
    assert [(t, p) for t, p in read if t.startswith("gram_counts")] == [("gram_counts3", {x["p"] for x in grams})]
    assert all(p <= {x["p"] for x in grams} for t, p in read if t == "grams3")
    assert {tuple(p) for t, p in read if t == "observations"} == {("real@2026-02",)}
    plan = opened("grams3", monthly.POSTINGS, [x["p"] for x in grams], base)
    assert {f.split("part=")[1].split("/")[0] for f in plan.inputFiles()} <= {x["p"] for x in grams}
    monthly.clear_into(own, "none", "b3")
    assert sorted(map(str, own.read("grams3", monthly.POSTINGS).collect())) == sorted(map(str, linking.grams_of(own.read("items", schemas.ITEMS).select(*linking.BUCKET, F.col("match_key").alias("key")), 3).withColumn("length", F.col("length").cast("int")).select(*linking.BUCKET, "key", "length", "gram").collect()))


def test_index_parts_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(monthly, "FOLDERS", 1)
    r, own = random.Random(3), Store(spark, str(tmp_path / "store"))
    for k in range(2):
        monthly.collect_into(own, pages(spark, [("a", f"2026-0{k + 1}", html(menu(r, 8)), 1)]), config(spark), "real", f"b{k}")
    assert max(len(f) for f in own.snapshot().parts("grams3").values()) == 1
    keys = own.read("items", schemas.ITEMS).select(*linking.BUCKET, F.col("match_key").alias("key"))
    assert own.read("grams3", monthly.POSTINGS).count() == linking.grams_of(keys, 3).count() == own.read("gram_counts3", monthly.COUNTS).agg(F.sum("n")).first()[0]


def test_clearing_a_dataset(spark, tmp_path):
    r, own = random.Random(4), Store(spark, str(tmp_path / "store"))
    shared, only = menu(r), [("unheard of dish", 900)]
    monthly.collect_into(own, pages(spark, [("a", "2026-01", html(shared), 1)]), config(spark), "real", "b0")
    monthly.collect_into(own, pages(spark, [("a", "2026-01", html(shared + only), 1)]), config(spark), "simulated", "b1")
    simulated = own.read("observations", schemas.OBSERVATIONS).filter("dataset = 'simulated'").count()
    _, removed = monthly.clear_into(own, "simulated", "b2")
    assert removed == simulated
    assert {x["dataset"] for x in own.read("observations", schemas.OBSERVATIONS).collect()} == {"real"}
    assert own.read("items", schemas.ITEMS).filter("match_key like 'unheard%'").count() == 0 == own.read("grams3", monthly.POSTINGS).filter("key like 'unheard%'").count()
    assert monthly.load_observations(own, config(spark), "real").count() == own.read("observations", schemas.OBSERVATIONS).count()


def test_a_page_is_parsed_once(spark, tmp_path, monkeypatch):
    from pricebasket.functions import html as parser

    count, parse = spark.sparkContext.accumulator(0), parser.parse

    def texts(pages_in, outlets, settings):
        return extract.page_texts(pages_in, outlets, settings, lambda page: count.add(1) or parse(page))

    monkeypatch.setattr(collecting, "page_texts", texts)
    own, r = Store(spark, str(tmp_path / "store")), random.Random(6)
    monthly.collect_into(own, pages(spark, [(o, "2026-01", html(menu(r)), 1) for o in "abcde"]), config(spark), "real", "b0")
    assert count.value == 5


def test_another_writer_is_told(spark, tmp_path):
    own = Store(spark, str(tmp_path / "store"))
    base = own.snapshot()
    rows = spark.range(3).withColumn("p", F.lit(None).cast("string"))
    own.commit(base, "x", [Change("t", rows, F.col("p"))])
    with pytest.raises(RuntimeError, match="another writer"):
        own.commit(base, "y", [Change("t", rows, F.col("p"))])
    assert own.read("t", "id long, p string", [""]).count() == 3


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """Keys that are windows of one string, each like its neighbours only: 500 of them, in the order of the string."""
    r = random.Random(8)
    line = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(520))
    rows = [("a", None, None, "2026-01", k, line[k : k + 20]) for k in range(500)]
    parsed = spark.createDataFrame(rows, "outlet_id string, size_value double, size_unit string, period string, position long, match_key string")
    rounds, marks = [], graphs._mark
    monkeypatch.setattr(graphs, "_mark", lambda edges: rounds.append(1) or marks(edges))
    got = {x["position"]: x["match_key"] for x in linking.link_items(parsed, tables.empty(spark, schemas.ITEMS), Settings()).collect()}
    keys = []
    for *_, k, key in rows:
        found, _ = best_match(key, keys, 0.88)
        if found is None:
            keys.append(key)
        assert got[k] == (found or key)
    assert linking.ROUNDS + len(rounds) <= 12


@pytest.mark.parametrize("together", [0, 3, 100_000])
def test_components_of_any_size_fold_alike(spark, together, monkeypatch):
    monkeypatch.setattr(linking, "TOGETHER", together)
    monkeypatch.setattr(linking._later_partners, "__defaults__", (together, 1))
    r = random.Random(9)
    pairs = {tuple(sorted(r.sample(range(k * 30, k * 30 + 30), 2), reverse=True)) for k in range(3) for _ in range(40)}
    frame = spark.createDataFrame([(a, a, b, b) for a, b in pairs], "a long, a_at long, b long, b_at long")
    gone = set()
    for a in range(90):
        if any(x == a and b not in gone for x, b in pairs):
            gone.add(a)
    assert {x["_gone"] for x in linking._later_partners(frame).collect()} == gone


def test_renames_are_listed(spark):
    rows = [("a", None, None, "2026-01", 0, "cheeseburger"), ("a", None, None, "2026-02", 1, "cheeseburgers"), ("a", None, None, "2026-02", 2, "cheeseburger")]
    parsed = spark.createDataFrame(rows, "outlet_id string, size_value double, size_unit string, period string, position long, match_key string")
    from pricebasket.operators.reports import renames

    linked = linking.link_items(parsed, tables.empty(spark, schemas.ITEMS))
    assert [tuple(x) for x in renames(linked).collect()] == [("a", "2026-02", "cheeseburger", "cheeseburgers", 0.96)]
    assert store.id_collisions(linked.select("item_id", *store.NATURAL)).count() == 0


def test_letters_in_common(spark):
    from collections import Counter

    r = random.Random(10)
    pairs = [("".join(r.choice("abc $.") for _ in range(r.randint(0, 9))), "".join(r.choice("abcd $.") for _ in range(r.randint(0, 9)))) for _ in range(200)]
    got = spark.createDataFrame(pairs, "a string, b string").select(linking.letters_in_common(F.col("a"), F.col("b"))).collect()
    assert [x[0] for x in got] == [sum((Counter(a) & Counter(b)).values()) for a, b in pairs]
