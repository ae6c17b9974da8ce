"""Mixing to target weights by soft membership, in DataFrame functions alone.

1. A classifier of domains is fitted on labelled rows (the table of labels: high, low or toxic): a naive Bayes over hashed
   words and runs of marks, each counted once a text. SAMPLE labelled rows, those with the smallest hash, are used at most.
2. Every document gets a posterior for each domain; no row leaves its task for it.
3. Rates r >= 0, one a document, are fitted by projected-gradient least squares with momentum: the expected tokens of a
   domain are the sum of r * tokens * posterior, and shall be the domain's target. A step needs these few totals only,
   which are one distributed aggregate; each document recomputes its rate from the steps so far. Distances are measured in the metric of the
   posteriors' second moments, so that rare domains converge as fast as frequent ones, and no step overshoots. Steps end
   when the totals are CLOSE to the targets or STEPS have been made; targets that no rates meet are only come near to; `reached` tells the
   targets and the totals.
4. A rate's whole part, and one more with the chance of its fraction (by a hash of the id), are a document's copies.

Null texts have no tokens and the domains' shares as posteriors. Without labels the posteriors are equal. Repeated rows
are rows like others; rows without an id draw alike. Null ids and domains of labels are not learned from. Empty tables give empty results. Other columns pass through.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricebasket.llm.common import documents, stored, whole_text

DOMAINS = ("high", "low", "toxic")
#: Shares of all tokens wanted of each domain; tokens wanted in all, as a share of those there are.
TARGETS = {"high": 0.85, "low": 0.10, "toxic": 0.05}
BUDGET = 1.0
#: Labelled rows that the classifier learns from at most.
SAMPLE = 20_000
#: Hash buckets; pseudo-occurrences that a bucket has in each domain; how far over its share (as a logarithm) a bucket tells a domain.
BUCKETS, SMOOTH, FAINT = 1 << 16, 10.0, 0.8
STEPS, CLOSE = 32, 1e-6
#: Words, and runs of marks.
PIECE = r"[A-Za-zÀ-ɏ]++|[^A-Za-zÀ-ɏ\s]++"


def pieces(text: Column) -> Column:
    """The hash buckets of a text's different words and runs of marks."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit(PIECE), 0), lambda p: F.pmod(F.xxhash64(p), F.lit(BUCKETS)).cast("int")))


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """domain and text of a bounded number of labelled rows."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    chosen = labels.select("doc_id", domain.alias("domain")).filter("doc_id is not null and domain is not null").orderBy(F.xxhash64("doc_id"), "domain").limit(sample)
    return docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id").select("domain", "text")


def fit_domains(docs: DataFrame, labels: DataFrame) -> tuple[list[float], list[list[float]]]:
    """For each domain its score for a text without telling buckets, and what each of these adds; a few numbers a bucket reach the driver."""
    rows = labelled(docs, labels).select("domain", pieces(F.col("text")).alias("pieces"))
    seen = rows.select("domain", F.explode(F.concat(F.array(F.lit(-1)), "pieces")).alias("bucket")).groupBy("bucket").pivot("domain", list(DOMAINS)).count().na.fill(0).collect()
    counts = {r["bucket"]: [r[d] for d in DOMAINS] for r in seen}
    size = counts.pop(-1, [0] * len(DOMAINS))
    total = sum(size)
    start = [math.log((n + 1) / (total + len(DOMAINS))) for n in size]
    weights = [[0] * BUCKETS for _ in DOMAINS]
    for bucket, own in counts.items():
        share = sum(own) / max(1, total)
        telling = max(math.log((n + SMOOTH) / (size[d] * share + SMOOTH)) for d, n in enumerate(own))
        if telling < FAINT:
            continue
        for d, n in enumerate(own):
            p = min(0.999, (n + SMOOTH * share) / (size[d] + SMOOTH))
            start[d] += math.log(1 - p)
            weights[d][bucket] = round(math.log(p / (1 - p)), 4)
    return start, weights


def posteriors(df: DataFrame, model: tuple[list[float], list[list[float]]]) -> DataFrame:
    """df with n_tokens and p_<domain> for each domain."""
    prior, weights = model

    def score(start: float, own: list[float]) -> Column:
        table = F.split(F.lit(",".join(map(str, own))), ",").cast("array<double>")
        return F.aggregate("_pieces", F.lit(start), lambda s, b: s + F.get(table, b))

    scores = [score(*x) for x in zip(prior, weights, strict=True)]
    out = df.drop("n_tokens", *(f"p_{d}" for d in DOMAINS)).withColumn("_pieces", pieces(whole_text())).withColumn("_s", F.array(*scores)).withColumn("_top", F.array_max("_s"))
    out = out.withColumn("_e", F.transform("_s", lambda s: F.exp(s - F.col("_top")))).withColumn("_z", F.aggregate("_e", F.lit(0.0), lambda a, b: a + b))
    words = F.size(F.filter(F.split(whole_text(), r"[ \t\r\n\x0B\f]+"), lambda w: w != "")).cast("long")
    return out.withColumn("n_tokens", words).withColumns({f"p_{d}": F.get("_e", F.lit(k)) / F.col("_z") for k, d in enumerate(DOMAINS)}).drop("_pieces", "_s", "_top", "_e", "_z")


def fitted_rates(members: DataFrame, targets: dict[str, float], budget: float = BUDGET) -> Column:
    """The rate of each row of (n_tokens, p_<domain>) as an expression of these columns."""
    p = [F.col(f"p_{d}") for d in DOMAINS]
    moments = members.agg(F.sum("n_tokens").alias("n"), *(F.sum(F.col("n_tokens") * a * b).alias(f"m{i}_{j}") for i, a in enumerate(p) for j, b in enumerate(p))).first()
    total = float(moments["n"] or 0)
    if not total:
        return F.lit(1.0)
    metric = np.array([[moments[f"m{i}_{j}"] / total for j in range(len(p))] for i in range(len(p))]) + 1e-9 * np.eye(len(p))
    wanted = np.array([targets.get(d, 0.0) for d in DOMAINS])
    wanted = budget * wanted / wanted.sum()
    steps, momentum, best, least = [], 1.0, F.lit(budget), float("inf")
    for _ in range(STEPS):
        # totals where the next step starts: ahead of the rates by the momentum
        further, start = (momentum - 1) / (t := (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2), _rate(steps, budget)
        rate, ahead = start["rate"], start["rate"] + further * (start["rate"] - start["before"])
        each = members.select("n_tokens", *(f"p_{d}" for d in DOMAINS), rate.alias("_r"), ahead.alias("_y"))
        sums = each.agg(*(F.sum(F.col(r) * F.col("n_tokens") * x / total) for r in ("_r", "_y") for x in p)).first()
        error, error_ahead = (np.array([float(x) for x in sums[k : k + len(p)]]) - wanted for k in (0, len(p)))
        if (size := float(error @ np.linalg.solve(metric, error))) < least:
            best, least = rate, size
        if np.abs(error).sum() < CLOSE:
            break
        steps.append((further, *np.linalg.solve(metric, error_ahead).tolist()))
        momentum = t
    return best


def _rate(steps: list[tuple[float, ...]], budget: float) -> Column:
    """The rate after so many steps and the one before, from a row's posteriors."""
    none = F.struct(F.lit(float(budget)).alias("rate"), F.lit(float(budget)).alias("before"))
    if not steps:
        return none

    def step(now: Column, s: Column) -> Column:
        down = sum((F.col(f"p_{d}") * s[k + 1] for k, d in enumerate(DOMAINS[1:], 1)), F.col(f"p_{DOMAINS[0]}") * s[1])
        start = now["rate"] + s[0] * (now["rate"] - now["before"])
        return F.struct(F.greatest(F.lit(0.0), start - down).alias("rate"), now["rate"].alias("before"))

    return F.aggregate(F.array(*(F.array(*map(F.lit, s)) for s in steps)), none, lambda now, s: step(now, s))


def reached(mixed: DataFrame, targets: dict[str, float] = TARGETS, budget: float = BUDGET) -> DataFrame:
    """domain, target and share: of all tokens, what the rates of mix() give each domain; one row a domain."""
    of = lambda d: F.sum(F.col("rate") * F.col("n_tokens") * F.col(f"p_{d}")) / F.sum("n_tokens")
    whole = sum(targets.values())
    rows = F.array(*(F.struct(F.lit(d).alias("domain"), F.lit(budget * targets.get(d, 0.0) / whole).alias("target"), of(d).alias("share")) for d in DOMAINS))
    return mixed.agg(rows.alias("rows")).select(F.explode("rows").alias("row")).select("row.*")


def mix(docs: DataFrame, labels: DataFrame, learned: DataFrame | None = None, targets: dict[str, float] = TARGETS, budget: float = BUDGET) -> DataFrame:
    """docs with n_tokens, posteriors, rate and copies; learned: documents with the texts that the classifier learns from, docs unless given."""
    members = stored(docs.sparkSession, posteriors(docs, fit_domains(docs if learned is None else learned, labels)), "members")
    rate = fitted_rates(members.select("n_tokens", *(f"p_{d}" for d in DOMAINS)), targets, budget)
    chance = F.pmod(F.xxhash64(F.lit("copies"), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return members.withColumn("rate", rate).withColumn("copies", F.floor(F.col("rate") + chance).cast("int"))


def mixed_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float = BUDGET) -> DataFrame:
    """The documents that the mixture holds, each as often as it has copies, with the columns of docs."""
    return mix(docs, labels, None, targets, budget).filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    ids = mix(docs.select("doc_id", "text"), labels)
    return ids.select(F.col("doc_id").cast("long"), "n_tokens", *(f"p_{d}" for d in DOMAINS), "rate", "copies")
