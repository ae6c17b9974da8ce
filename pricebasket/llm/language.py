"""Language ID: a bidirectional gated recurrent network over bytes labels every position; a document pools its positions.

The network runs over the whole text's bytes in windows of WINDOW bytes, forwards and backwards; a window's first state is
what CONTEXT bytes before it (behind it, backwards) leave, at a text's ends zero. Every byte gets a probability for each
language; a document's probabilities are the means over its bytes. Many windows run side by side in numpy, in blocks of
bounded size, whatever a text's length.

Training: numpy, backpropagation through time, on spans of documents. The driver gets a bounded sample, gathered by
Spark: of each language the SAMPLE_DOCS labelled rows with the smallest hash, and SPANS spans of SPAN bytes of each, from
places anywhere in its text. The sample's size depends on the number of languages, not of rows.

A text that is null or has no letter is labelled `und` with score 0. With no learnable language everything is `und`.
Null langs and null texts are not learned from; rows without an id or with equal ids are rows like others. Empty tables
give empty results; repeated rows repeated results; ties go to the first language in alphabetic order. Other columns of
df pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricebasket.llm.common import Batches, documents, map_batches
from pricebasket.llm.hashing import together

UNKNOWN = "und"
#: Labelled rows of a language that the sample holds at most; spans of each; bytes of a span.
SAMPLE_DOCS, SPANS, SPAN = 400, 4, 64
#: How many times as many rows the sample is sought among.
SOUGHT = 4
#: Bytes of a window, and those around it that lead up to it; windows that run side by side.
WINDOW, CONTEXT, LANES = 192, 16, 2048
HIDDEN, BATCH, RATE, SEED = 8, 128, 0.02, 7
#: Steps of training at least, and passes over the sample at least.
STEPS, EPOCHS = 240, 2


def _sign(x: np.ndarray) -> np.ndarray:
    """The soft sign, x / (1 + |x|): what bounds states and, halved and raised by a half, gates. Several times cheaper than exponentials."""
    return x / (1 + np.abs(x))


class ByteNetwork:
    """Two gated recurrent layers over bytes, one in each direction, and a softmax over languages at every byte."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = SEED) -> None:
        self.languages, self.hidden = languages, hidden
        r = np.random.default_rng(seed)
        near = lambda *shape: (r.standard_normal(shape) * 0.3 / np.sqrt(shape[0])).astype(np.float32)
        self.p: dict[str, np.ndarray] = {"o": near(2 * hidden, len(languages)), "ob": np.zeros(len(languages), np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": (r.standard_normal((256, 3 * hidden)) * 0.3).astype(np.float32), f"b{d}": np.zeros(3 * hidden, np.float32), f"u{d}": near(hidden, 3 * hidden) * 3}

    def _run(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """States (length, spans, hidden) of one direction; x: (spans, length) bytes."""
        n, length, h = len(x), x.shape[1], self.hidden
        state, out, kept = np.zeros((n, h), np.float32), np.empty((length, n, h), np.float32), []
        given = self.p[f"w{d}"] + self.p[f"b{d}"]
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            a, b = given[x[:, t]], state @ self.p[f"u{d}"]
            zr = 0.5 + 0.5 * _sign(a[:, : 2 * h] + b[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            new = _sign(a[:, 2 * h :] + r * b[:, 2 * h :])
            if keep:
                kept.append((t, state, z, r, b[:, 2 * h :], new))
            state = new + z * (state - new)
            out[t] = state
        return out, kept

    def _log_probabilities(self, states: np.ndarray) -> np.ndarray:
        x = states @ self.p["o"] + self.p["ob"]
        x -= x.max(axis=-1, keepdims=True)
        return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Log probabilities (length, spans, languages) of spans of one length."""
        return self._log_probabilities(np.concatenate([self._run(x, d, False)[0] for d in "fb"], axis=2))

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over positions, and its gradients by backpropagation through time."""
        h, runs = self.hidden, {d: self._run(x, d, True) for d in "fb"}
        states = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        logs = self._log_probabilities(states)
        share = (weight / (weight.sum() * x.shape[1]))[None, :, None]
        error = (np.exp(logs) - np.eye(len(self.languages), dtype=np.float32)[y][None]) * share
        flat = error.reshape(-1, error.shape[2])
        g = {"o": states.reshape(-1, 2 * h).T @ flat, "ob": flat.sum(axis=0)}
        back = error @ self.p["o"].T
        for i, d in enumerate("fb"):
            u, gu, later, given = self.p[f"u{d}"], np.zeros_like(self.p[f"u{d}"]), 0.0, np.empty((x.shape[1], len(x), 3 * h))
            for t, before, z, r, inner, new in reversed(runs[d][1]):
                dh = back[t, :, i * h : (i + 1) * h] + later
                dz, dn = dh * (before - new) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2, dh * (1 - z) * (1 - np.abs(new)) ** 2
                dr = dn * inner * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
                through = np.concatenate([dz, dr, dn * r], axis=1)
                gu += before.T @ through
                given[t] = np.concatenate([dz, dr, dn], axis=1)
                later = dh * z + through @ u.T
            seen, given = x.T.ravel(), given.reshape(-1, 3 * h)
            gw = np.stack([np.bincount(seen, given[:, k], 256) for k in range(3 * h)], axis=1)
            g |= {f"w{d}": gw, f"u{d}": gu, f"b{d}": gw.sum(axis=0)}
        loss = -(logs[:, np.arange(len(y)), y] * share[:, :, 0]).sum()
        return float(loss), g

    def fit(self, spans: list[bytes], labels: np.ndarray, weights: np.ndarray, steps: int = STEPS) -> ByteNetwork:
        """Adam over batches of spans of one length."""
        r, first, second, step = np.random.default_rng(SEED), {}, {}, 0
        lengths = np.array(list(map(len, spans)))
        groups = [(np.frombuffer(b"".join(spans[i] for i in own), np.uint8).reshape(-1, n), own) for n in np.unique(lengths) if len(own := np.flatnonzero(lengths == n))]
        epochs = max(EPOCHS, -(-steps // max(1, sum(-(-len(own) // BATCH) for _, own in groups))))
        for epoch in range(epochs):
            batches = [(x[k], own[k]) for x, own in groups for k in np.array_split(r.permutation(len(own)), -(-len(own) // BATCH))]
            rate = RATE * (1 - epoch / epochs) + RATE / 20
            for b in r.permutation(len(batches)):
                x, own = batches[b]
                _, g = self.gradients(x, labels[own], weights[own])
                step += 1
                for k, v in g.items():
                    first[k] = 0.9 * first.get(k, 0) + 0.1 * v
                    second[k] = 0.99 * second.get(k, 0) + 0.01 * v * v
                    self.p[k] = (self.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities (texts, languages): the means over each text's positions; zeros for a text without bytes."""
        out = np.zeros((len(texts), len(self.languages)))
        for first, last, data, offsets in together(texts):
            for block in _lanes(offsets):
                text, sums = block[0], self._window_sums(data, *block[1:])
                for k in range(len(self.languages)):
                    out[first:last, k] += np.bincount(text, sums[k], last - first)
        return out / np.maximum(1, np.array([list(map(len, texts))]).T)

    def _steps(self, d: str, x: np.ndarray, inside: np.ndarray, times: range) -> Iterator[tuple[int, np.ndarray]]:
        """(time, states (hidden, lanes)) of one direction, features first; x: (times, lanes) bytes; states outside the texts are zero."""
        h, n, every = self.hidden, x.shape[1], inside.all(axis=1)
        given, u = np.ascontiguousarray((self.p[f"w{d}"] + self.p[f"b{d}"]).T), np.ascontiguousarray(self.p[f"u{d}"].T)
        state, a, b, size = np.zeros((h, n), np.float32), np.empty((3 * h, n), np.float32), np.empty((3 * h, n), np.float32), np.empty((2 * h, n), np.float32)
        gates, new, inner = a[: 2 * h], a[2 * h :], b[2 * h :]
        for t in times:
            np.take(given, x[t], axis=1, out=a, mode="clip")
            np.matmul(u, state, out=b)
            gates += b[: 2 * h]
            np.abs(gates, out=size)
            size += 1
            gates /= size
            gates *= 0.5
            gates += 0.5
            inner *= gates[h:]
            new += inner
            np.abs(new, out=size[:h])
            size[:h] += 1
            new /= size[:h]
            state -= new
            state *= gates[:h]
            state += new
            if not every[t]:
                state *= inside[t]
            yield t, state

    def _window_sums(self, data: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """(languages, lanes): probabilities summed over each window's positions from `fresh` on; low, high: the text's ends."""
        place = start[None, :] + np.arange(-CONTEXT, WINDOW + CONTEXT)[:, None]
        inside = (place >= low) & (place < high)
        x = data[np.clip(place, 0, len(data) - 1)].astype(np.intp)
        own, out = self.p["o"].T.copy(), np.zeros((len(self.languages), len(start)), np.float32)
        forwards = np.empty((WINDOW, self.hidden, len(start)), np.float32)
        for t, state in self._steps("f", x, inside, range(CONTEXT + WINDOW)):
            if t >= CONTEXT:
                forwards[t - CONTEXT] = state
        for t, state in self._steps("b", x, inside, range(2 * CONTEXT + WINDOW - 1, CONTEXT - 1, -1)):
            if (at := t - CONTEXT) < WINDOW:
                p = own[:, : self.hidden] @ forwards[at] + own[:, self.hidden :] @ state + self.p["ob"][:, None]
                p -= p.max(axis=0)
                np.exp(p, out=p)
                p /= p.sum(axis=0)
                p *= fresh <= at
                out += p
        return out


def _lanes(offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Windows of texts that stand one after another, in blocks: text, start, the text's ends, and the first position that counts.

    A text's last window ends with it and counts what the window before leaves; shorter texts have one window that begins before them.
    """
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), counts)
    turn = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = np.minimum(turn * WINDOW, sizes[text] - WINDOW)
    order = np.argsort(start < 0, kind="stable")
    text, turn, start = text[order], turn[order], start[order]
    for at in range(0, len(text), LANES):
        own, t, s = (v[at : at + LANES] for v in (text, turn, start))
        yield own, s + offsets[own], offsets[own], offsets[own + 1], t * WINDOW - s


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def training_spans(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, spans: int = SPANS) -> DataFrame:
    """lang and spans (array) of a bounded number of labelled rows of each language; only the spans are sorted and moved."""
    rows = docs.select("doc_id", "lang", "text").filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    places = [F.pmod(F.xxhash64("text", F.lit(k)), F.greatest(F.lit(1), F.length("text") - SPAN)).cast("int") + 1 for k in range(spans)]
    cut = rows.select("lang", F.xxhash64("doc_id", "text").alias("_hash"), F.array_distinct(F.array(*(F.substring("text", p, SPAN) for p in places))).alias("spans"))
    # those with the smallest hashes are sought among a few times as many, by each language's count, so that what meets in a task is bounded
    share = rows.groupBy(F.col("lang").alias("_lang")).agg((F.lit(float(SOUGHT * sample_docs)) / F.count("*")).alias("_share"))
    # one row a language, of which the network on the driver has a unit each: few
    few = cut.join(F.broadcast(share), F.col("lang") == F.col("_lang")).filter(F.col("_hash") / F.lit(float(1 << 64)) + 0.5 <= F.col("_share")).select("lang", "_hash", "spans")
    by_hash = Window.partitionBy("lang").orderBy("_hash", "spans")
    return few.withColumn("_rank", F.row_number().over(by_hash)).filter(F.col("_rank") <= sample_docs).select("lang", "spans")


def fit_languages(docs: DataFrame) -> ByteNetwork:
    """The network, trained on the driver on the bounded sample; each language has the same weight in all."""
    rows = sorted((r["lang"], data) for r in training_spans(docs).collect() for x in r["spans"] if (data := x.encode()[:SPAN]))
    languages = sorted({r[0] for r in rows})
    labels = np.array([languages.index(r[0]) for r in rows], np.int64)
    weights = np.ones(len(rows), np.float32)
    for k in range(len(languages)):
        weights[labels == k] /= (labels == k).sum()
    net = ByteNetwork(languages)
    return net.fit([r[1] for r in rows], labels, weights) if rows else net


def predict_languages(df: DataFrame, net: ByteNetwork) -> DataFrame:
    """df with lang_pred and score; df's other columns pass through, columns of these names are replaced."""
    shared = df.sparkSession.sparkContext.broadcast(net)
    kept = df.drop("lang_pred", "score")
    schema = kept.schema.add("lang_pred", "string").add("score", "double")
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts, known = batch.column("text"), batch.column("_lettered").to_pylist()
            found = own.pooled([t.as_py().encode() if k else b"" for t, k in zip(texts, known, strict=True)]) if own.languages and len(known) else np.zeros((len(known), 1))
            best, names = found.argmax(axis=1).tolist(), own.languages
            known = [k and bool(names) for k in known]
            predicted = [names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            scores = [float(p) if k else 0.0 for p, k in zip(found.max(axis=1), known, strict=True)] if len(known) else []
            columns = [c for name, c in zip(batch.schema.names, batch.columns, strict=True) if name != "_lettered"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(predicted, pa.string()), pa.array(scores, pa.float64())], schema.fieldNames())

    return map_batches(kept.withColumn("_lettered", lettered), run, schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = predict_languages(docs.select("doc_id", "text"), fit_languages(docs))
    return found.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "lang_pred", "score")
