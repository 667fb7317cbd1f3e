"""Quality of whole texts by a factorisation machine.

Features of a text: hashed words and hashed word shapes (shares of its words)
and statistics of its structure and length, cut into bins. The model adds to a
linear score the products of all feature pairs through low-rank factors,

    w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2),

in time linear in a text's features. It is fitted on a bounded sample of
labelled rows (``SAMPLE`` rows, chosen by a hash of the id, with at most
``WORDS + SHAPES + STATS`` features each) by one task, and only the model comes
to the driver; every row is scored.

Nulls: a null text is scored as an empty one; rows with a null label or id are
not learned from; labels of repeated ids are each a row. Without any labelled
row every score is 0.5. Columns other than the id and the text are not read by
``score`` and all kept by ``keep_good``.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .base import table

SAMPLE = 6000
WORDS, SHAPES, RANK = 4096, 1024, 8
CUT = 0.3
BINS = 12
EPOCHS, BATCH, RATE, DECAY = 14, 64, 0.03, 1e-5

# byte classes of word shapes: lower, upper, digit, beyond ASCII; other bytes are themselves
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 97, 65, 48, 97

STAT_NAMES = ("bytes", "words", "lines", "word_bytes", "upper", "digits", "symbols", "space", "bars", "marks", "distinct", "repeats", "longest", "line_words",
              "ends", "same_lines", "symbol_words", "upper_words")
STATS = len(STAT_NAMES) * BINS


def _per(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive cuts."""
    run = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
    return np.diff(run[cuts])


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) of hashed words and shapes, and (texts x stats)."""
    data, offs = words.raw(texts)
    n = len(texts)
    stats = np.zeros((n, len(STAT_NAMES)))
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), stats
    keep = ~words.SPACE[data]
    starts, ends = words.segments(keep, offs)
    doc = np.searchsorted(offs, starts, side="right") - 1
    word = words.hashes(words.LOWER[data], keep, starts)
    kind = _CLASS[data]
    # a shape is the run of classes of a word, each once
    turn = keep.copy()
    turn[1:] &= kind[1:] != kind[:-1]
    turn[starts] = True
    at = np.flatnonzero(turn)
    owner = np.searchsorted(starts, at, side="right") - 1
    first = np.searchsorted(owner, np.arange(len(starts)))
    shape = words.hashes(kind[at], np.ones(len(at), bool), first) if len(at) else word[:0]
    count = np.maximum(np.bincount(doc, minlength=n), 1)
    doc2, feat = np.concatenate([doc, doc]), np.concatenate([(word >> np.uint64(40)) % np.uint64(WORDS), np.uint64(WORDS) + (shape >> np.uint64(40)) % np.uint64(SHAPES)]).astype(np.int64)
    cell, times = np.unique(doc2 * (WORDS + SHAPES) + feat, return_counts=True)
    row = cell // (WORDS + SHAPES)
    value = np.sqrt(times / count[row])

    size = np.maximum(np.diff(offs), 1)
    cuts = np.searchsorted(starts, offs)
    line = data == 10
    lines = _per(line, offs) + 1
    letters = (kind == 97) | (kind == 65)
    symbol = keep & ~letters & (kind != 48)
    again = np.zeros(len(word))
    again[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((word, doc))
    new = np.ones(len(word))
    new[1:] = (word[order][1:] != word[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    length = (ends - starts).astype(float)
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    l_start, l_end = words.segments(~line, offs)
    l_doc = np.searchsorted(offs, l_start, side="right") - 1
    l_hash = words.hashes(data, ~line, l_start)
    l_order = np.lexsort((l_hash, l_doc))
    l_same = np.zeros(len(l_hash))
    l_same[1:] = (l_hash[l_order][1:] == l_hash[l_order][:-1]) & (l_doc[l_order][1:] == l_doc[l_order][:-1])
    l_cuts = np.searchsorted(l_start, offs)
    in_lines = np.maximum(np.diff(l_cuts), 1)
    last = data[ends - 1]
    sym_word = _per(symbol, np.append(starts, len(data))) >= 2
    up_word = _per(kind == 65, np.append(starts, len(data))) >= 2
    out = (np.log1p(size), np.log1p(count), np.log1p(lines), _per(length, cuts) / count, _per(kind == 65, offs) / size, _per(kind == 48, offs) / size,
           _per(symbol, offs) / size, _per(~keep, offs) / size, _per(data == 124, offs) / count, _per(data == 33, offs) / count, _per(new, cuts) / count,
           _per(again, cuts) / count, np.log1p(longest), np.log1p(count / lines), _per((last == 46) | (last == 63), cuts) / count, _per(l_same, l_cuts) / in_lines,
           _per(sym_word, cuts) / count, _per(up_word, cuts) / count)
    stats[:] = np.stack(out, 1)
    stats[np.diff(offs) == 0] = 0
    return row, cell % (WORDS + SHAPES), value, stats


def _cells(stats: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The bin of each statistic as a feature number."""
    k = np.stack([np.searchsorted(edges[j], stats[:, j], side="right") for j in range(stats.shape[1])], 1) if len(stats) else stats.astype(np.int64)
    return WORDS + SHAPES + np.arange(stats.shape[1])[None, :] * BINS + k


def _design(row, feat, value, stats, edges):
    """Features sorted by row: (feature, value, bounds of rows)."""
    n = len(stats)
    bins = _cells(stats, edges)
    every = np.full(bins.shape[1], 1 / np.sqrt(bins.shape[1]))
    rows = np.concatenate([row, np.repeat(np.arange(n), bins.shape[1])])
    feats, values = np.concatenate([feat, bins.reshape(-1)]), np.concatenate([value, np.tile(every, n)])
    order = np.argsort(rows, kind="stable")
    return feats[order], values[order], np.searchsorted(rows[order], np.arange(n + 1))


def _logit(model: dict, feats, values, bounds):
    """Scores, and the factor sums that the gradient needs. Every row has features."""
    vx = model["v"][feats] * values[:, None]
    s = np.add.reduceat(vx, bounds[:-1], axis=0)
    pairs = 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), bounds[:-1]))
    return model["w0"] + np.add.reduceat(model["w"][feats] * values, bounds[:-1]) + pairs, s


def fit(row, feat, value, stats, label: np.ndarray, seed: int = 5) -> dict:
    """Logistic loss, Adagrad over small batches."""
    edges = np.sort(np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T, axis=1)
    feats, values, bounds = _design(row, feat, value, stats, edges)
    rng = np.random.default_rng(seed)
    size = WORDS + SHAPES + STATS
    rate = label.mean().clip(0.01, 0.99)
    model = {"w0": float(np.log(rate / (1 - rate))), "w": np.zeros(size), "v": rng.normal(0, 0.05, (size, RANK)), "edges": edges}
    sum_w, sum_v, sum_0 = np.full(size, 1e-6), np.full((size, RANK), 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(len(label))
        for b in range(0, len(order), BATCH):
            pick = order[b:b + BATCH]
            at = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in pick])
            own = np.concatenate(([0], np.cumsum(bounds[pick + 1] - bounds[pick])))
            f, x = feats[at], values[at]
            z, s = _logit(model, f, x, own)
            g = (1 / (1 + np.exp(-z)) - label[pick]) / len(pick)
            r = np.repeat(np.arange(len(pick)), np.diff(own))
            part, where = np.unique(f, return_inverse=True)
            gw = np.bincount(where, weights=g[r] * x, minlength=len(part)) + DECAY * model["w"][part]
            each = (g[r] * x)[:, None] * (s[r] - model["v"][f] * x[:, None])
            gv = np.stack([np.bincount(where, weights=each[:, k], minlength=len(part)) for k in range(RANK)], 1) + DECAY * model["v"][part]
            sum_w[part] += gw * gw
            sum_v[part] += gv * gv
            sum_0 += g.sum() ** 2
            model["w"][part] -= RATE * 3 * gw / np.sqrt(sum_w[part])
            model["v"][part] -= RATE * gv / np.sqrt(sum_v[part])
            model["w0"] -= RATE * g.sum() / np.sqrt(sum_0)
    return model


def scores(model: dict | None, texts: pa.Array) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    z, _ = _logit(model, *_design(*features(texts), model["edges"]))
    return 1 / (1 + np.exp(-z))


def _fitted(batches):
    """One row, the model, from the rows (label, text) of a bounded sample."""
    rows, feats, values, stats, labels = [], [], [], [], []
    done = 0
    for batch in batches:
        texts = words.as_texts(batch.column(1))
        labels.append(batch.column(0).to_numpy())
        for _, part in words.slices(texts):
            row, feat, value, stat = features(part)
            rows.append(row + done)
            feats.append(feat)
            values.append(value)
            stats.append(stat)
            done += len(part)
    if done:
        model = fit(*(np.concatenate(x) for x in (rows, feats, values, stats, labels)))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])


def learn(labelled: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> dict | None:
    """A model from at most ``sample`` labelled rows, those with the least hash of their id."""
    rows = labelled.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.select(F.col(label_col).cast("int").alias("label"), F.col(text_col).alias("text"), F.md5(F.col(id_col).cast("string")).alias("h"))
    got = rows.orderBy("h").limit(sample).select("label", "text").mapInArrow(_fitted, "model binary").collect()  # one row at most
    return pickle.loads(got[0]["model"]) if got else None


def _scored(model):
    def run(batches):
        for batch in batches:
            texts = words.as_texts(batch.column(batch.num_columns - 1))
            parts = [scores(model, part) for _, part in words.slices(texts)]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], [*batch.schema.names[:-1], "score"])
    return run


def score(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, kept columns, score (0 to 1, higher: label 1 likelier), predicted."""
    rows = docs.select(F.col(id_col).alias("doc_id"), *[c.alias(k) for k, c in (keep or {}).items()], F.col(text_col).alias("text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_scored(model), f"{fields}, score double").withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_good(docs: DataFrame, model: dict | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is not rejected, with all columns."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = words.as_texts(batch.column(at))
            parts = [scores(model, part) for _, part in words.slices(texts)]
            yield batch.filter(pa.array((np.concatenate(parts) if parts else np.zeros(0)) >= CUT))

    return docs.mapInArrow(run, docs.schema)


def labelled(spark, sf_dir: str, docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Texts with their quality, of rows that may be learned from. The sample is
    taken of the labels, so that at most ``sample`` narrow rows are sent to the
    documents and no text is shuffled."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("of"), "quality").filter(F.crc32(F.col("of").cast("string")) % 5 != 0)
    few = labels.filter("quality IS NOT NULL").orderBy(F.md5(F.col("of").cast("string"))).limit(sample)
    return docs.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("of")).select("doc_id", "text", "quality")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return score(docs, learn(labelled(spark, sf_dir, docs)), keep={"held_out": held_out})
