"""Language identification by a bidirectional gated recurrent network over bytes (operator 1).

The network reads all bytes of a text, of any script, and labels every one with a probability for each language. It
reads in blocks of ``BLOCK`` bytes: the forward state starts from zero ``CONTEXT`` bytes before a block, the backward
state ``CONTEXT`` bytes behind it, and places outside of the text are a symbol of their own. So the labels of a byte
follow from the bytes around it alone, and a long text is as many blocks side by side as it needs. A document's
probabilities are the mean over its bytes; of languages with the same mean the first by name is taken.

Gates are piecewise linear (0 to 1) and candidates are x / (1 + abs(x)), which numpy computes several times faster than
logistic curves. Training is backpropagation through time in numpy, on spans of a bounded number of labelled documents of each
language (``per_language``, ``most_spans``, ``least_spans``). The same data give the same network.

Null texts and texts without a letter get ``und`` and score 0. Texts of any length are read whole. Rows without lang are
predicted but not learned from. Rows without doc_id are never held out and never learned from. With no labelled rows
all is ``und``. Repeated rows get the same result each; an empty table gives no rows. Extra columns stay; columns named
lang_pred or score are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._session import bounded_batches
from ._words import released, slices, utf8

#: Bytes that are labelled together, bytes read before and behind them, and the symbol outside of texts.
BLOCK, CONTEXT, OUTSIDE = 112, 16, 256
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


@dataclass
class Network:
    """Gate tables by symbol (257 x 3H) and recurrent weights (3H x H) of both directions, and the output layer."""

    languages: list[str]
    table: list[np.ndarray]
    recurrent: list[np.ndarray]
    out: list[np.ndarray]  # L x H of each direction
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.table, *self.recurrent, *self.out, self.bias]


def fresh(languages: list[str], hidden: int, seed: int) -> Network:
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    tables = [normal(OUTSIDE + 1, 3 * hidden, scale=0.2) for _ in range(2)]
    for table in tables:
        table[:, : 2 * hidden] += 0.5  # gates begin half open
    return Network(
        languages,
        tables,
        [normal(3 * hidden, hidden, scale=hidden**-0.5) for _ in range(2)],
        [normal(len(languages), hidden, scale=hidden**-0.5) for _ in range(2)],
        np.zeros(len(languages), np.float32),
    )


def _scan(table: np.ndarray, recurrent: np.ndarray, x: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States after each step (steps, H, rows) of the rows of symbols ``x``, from a zero state."""
    hidden = recurrent.shape[1]
    columns = np.ascontiguousarray(x.T)
    n = x.shape[0]
    states = np.empty((x.shape[1], hidden, n), np.float32)
    g, u, new, size = (np.empty((k * hidden, n), np.float32) for k in (3, 3, 1, 1))
    h = np.zeros((hidden, n), np.float32)
    for t in range(x.shape[1]):
        np.copyto(g, table.take(columns[t], 0).T)
        np.matmul(recurrent, h, out=u)
        gates = g[: 2 * hidden]
        gates += u[: 2 * hidden]
        np.clip(gates, 0, 1, out=gates)
        z, r = gates[:hidden], gates[hidden:]
        np.multiply(r, u[2 * hidden :], out=new)
        new += g[2 * hidden :]
        np.abs(new, out=size)
        size += 1
        new /= size
        if keep is not None:
            keep.append((h, u[2 * hidden :].copy(), z.copy(), r.copy(), new.copy()))
        h = np.subtract(h, new, out=states[t])
        h *= z
        h += new
    return states


def _both(net: Network, x: np.ndarray, keep: list[list] | None = None) -> list[np.ndarray]:
    """States of both directions at the labelled places of ``x`` (rows, CONTEXT + places + CONTEXT)."""
    forwards = _scan(net.table[0], net.recurrent[0], x[:, :-CONTEXT], keep and keep[0])
    backwards = _scan(net.table[1], net.recurrent[1], x[:, : CONTEXT - 1 : -1], keep and keep[1])
    return [forwards[CONTEXT:], backwards[CONTEXT:][::-1]]


def _probabilities(net: Network, states: list[np.ndarray]) -> np.ndarray:
    """(places, L, rows)."""
    p = np.matmul(net.out[0], states[0])
    p += np.matmul(net.out[1], states[1])
    p += net.bias[:, None]
    p -= p.max(1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(1, keepdims=True)
    return p


def label(net: Network, data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Sums over the bytes of each text of the languages' probabilities. ``places``: where texts begin and end."""
    out = np.zeros((len(places) - 1, len(net.languages)))
    size = np.diff(places)
    blocks = -(-size // BLOCK)
    row = np.repeat(np.arange(len(size)), blocks)
    first = places[row] + BLOCK * (np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    steps = np.arange(-CONTEXT, BLOCK + CONTEXT)
    for k in range(0, len(row), 2048):
        own, at = row[k : k + 2048], first[k : k + 2048, None] + steps
        inside = (at >= places[own][:, None]) & (at < places[own + 1][:, None])
        x = np.where(inside, data[np.clip(at, 0, len(data) - 1)], np.int16(OUTSIDE))
        p = _probabilities(net, _both(net, x))
        p *= inside[:, CONTEXT:-CONTEXT].T[:, None, :]
        np.add.at(out, own, p.sum(0).T)
    return out


def _gradients(net: Network, x: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross entropy over the labelled places, by backpropagation through time."""
    kept: list[list] = [[], []]
    states = _both(net, x, kept)
    error = _probabilities(net, states)
    error -= target.T
    error /= np.float32(error.shape[0] * len(x))
    tables, recurrents, outs = [], [], []
    hidden = net.recurrent[0].shape[1]
    for k, symbols in enumerate((x[:, :-CONTEXT], x[:, : CONTEXT - 1 : -1])):
        outs.append(np.matmul(error, states[k].transpose(0, 2, 1)).sum(0))
        own = error if k == 0 else error[::-1]  # in the order of the steps
        recurrent = np.zeros_like(net.recurrent[k])
        given = np.empty((symbols.shape[1], len(x), 3 * hidden), np.float32)
        later = np.zeros((hidden, len(x)), np.float32)
        for t in range(symbols.shape[1] - 1, -1, -1):
            h, un, z, r, new = kept[k][t]
            d = later + net.out[k].T @ own[t - CONTEXT] if t >= CONTEXT else later
            dn = d * (1 - z) * (1 - np.abs(new)) ** 2
            dz = d * (h - new) * ((z > 0) & (z < 1))
            dr = dn * un * ((r > 0) & (r < 1))
            du = np.concatenate([dz, dr, dn * r])
            recurrent += du @ h.T
            given[t] = np.concatenate([dz, dr, dn]).T
            later = d * z + net.recurrent[k].T @ du
        table = np.zeros_like(net.table[k])
        order = np.argsort(flat := symbols.T.ravel(), kind="stable")
        at = np.flatnonzero(np.diff(flat[order], prepend=-1))
        table[flat[order][at]] = np.add.reduceat(given.reshape(-1, 3 * hidden)[order], at)
        tables.append(table)
        recurrents.append(recurrent)
    return [*tables, *recurrents, *outs, error.sum((0, 2))]


def train(x: np.ndarray, language: np.ndarray, languages: list[str], hidden: int = 12, steps: int = 300, batch: int = 256, rate: float = 0.02, seed: int = 1) -> Network:
    """Adam over batches of spans ``x`` (rows of symbols, context included), drawn alike from each language."""
    net = fresh(languages, hidden, seed)
    rng = np.random.default_rng(seed)
    first, second = ([np.zeros_like(p) for p in net.parameters()] for _ in range(2))
    count = np.bincount(language, minlength=len(languages))
    chance = 1 / count[language]
    chance /= chance.sum()
    target = np.eye(len(languages), dtype=np.float32)[language]
    for step in range(1, steps + 1):
        at = rng.choice(len(x), batch, p=chance)
        gradients = _gradients(net, x[at], target[at])
        speed = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, m, v in zip(net.parameters(), gradients, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= speed * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def held_out(doc_id: Column, modulus: int = 4, remainder: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def _cut_spans(per_text: int, length: int):
    """(text, lang, seed) in; up to ``per_text`` spans of each text, at places that follow from the seed."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                data, places = utf8(batch.column(0))
                spans, rows = [], []
                for row, (a, b, seed) in enumerate(zip(places[:-1].tolist(), places[1:].tolist(), batch.column(2).to_pylist(), strict=True)):
                    n = min(per_text, -(-(b - a) // length))
                    text = np.full(b - a + 2 * CONTEXT + length, OUTSIDE, "<u2")
                    text[CONTEXT : CONTEXT + b - a] = data[a:b]
                    for at in np.random.default_rng(abs(seed)).integers(0, max(b - a - length, 0) + 1, n).tolist():
                        spans.append(text[at : at + length + 2 * CONTEXT].tobytes())
                        rows.append(row)
                yield pa.RecordBatch.from_arrays([pa.array(spans, pa.binary()), batch.column(1).take(pa.array(rows, pa.int64()))], ["span", "lang"])

    return run


def fit(docs: DataFrame, per_language: int = 300, most_spans: int = 40_000, least_spans: int = 500, length: int = 32, **options) -> Network | None:
    """A network from the labelled documents of ``docs`` (doc_id, text, lang).

    It learns from ``per_language`` documents of each language, first in the order of a hash of doc_id, and from spans
    of ``length`` bytes in them: ``most_spans`` shared evenly, but at least ``least_spans`` of each language.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.where("doc_id is not null and lang is not null and text != ''").select("doc_id", "lang")
    counts = rows.groupBy("lang").count()
    languages = sorted(r["lang"] for r in counts.collect())
    if not languages:
        return None
    # twice as many as needed by a threshold of the hash, so that little is ordered; all where that could be too few
    share = F.when(F.col("count") > 4 * per_language, 2 * per_language / F.col("count")).otherwise(1.0)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    low = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 52)) < F.col("share") * float(1 << 52)
    chosen = rows.join(F.broadcast(counts.select("lang", share.alias("share"))), "lang").where(low).withColumn("place", place).where(F.col("place") <= per_language)
    chosen = F.broadcast(chosen.select("doc_id", "lang").distinct())  # per_language rows of each language at most
    texts = docs.select("doc_id", "text", "lang").where("text != ''").join(chosen, ["doc_id", "lang"]).select("text", "lang", F.xxhash64("doc_id", "text").alias("seed"))
    of_each = max(most_spans // len(languages), least_spans)
    per_text = -(-of_each // per_language)
    found = texts.mapInArrow(_cut_spans(per_text, length), "span binary, lang string")
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("span"), "span"))).where(F.col("place") <= of_each).drop("place").toPandas()
    if found.empty:
        return None
    found = found.sort_values(["lang", "span"])
    x = np.frombuffer(b"".join(found["span"]), "<u2").reshape(len(found), -1).astype(np.int64)
    return train(x, np.searchsorted(languages, found["lang"]), languages, **options)


def _predict(net: Network | None, text_at: int, names: list[str]):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                column = batch.column(text_at)
                data, places = utf8(column)
                size = np.diff(places)
                sums = np.zeros((batch.num_rows, 1)) if net is None else label(net, data, places)
                letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
                ok = (letters[places[1:]] > letters[places[:-1]]) & (net is not None)
                # texts without an ASCII letter may hold others
                ok[[i for i in np.flatnonzero(~ok & (size > 0)).tolist() if net is not None and any(map(str.isalpha, column[i].as_py()))]] = True
                best = sums.argmax(1)
                score = np.where(ok, np.minimum(sums.max(1) / np.maximum(size, 1), 1.0), 0.0)
                predicted = [net.languages[b] if o else "und" for b, o in zip(best.tolist(), ok.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(predicted, pa.string()), pa.array(score)], names)

    return run


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """``docs`` with lang_pred and score, from the texts alone."""
    bounded_batches(docs.sparkSession)
    base = docs.drop("lang_pred", "score")
    schema = T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return base.mapInArrow(_predict(net, base.columns.index("text"), schema.names), schema)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every whole text of ``documents``, learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    net = fit(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), net).drop("text")
