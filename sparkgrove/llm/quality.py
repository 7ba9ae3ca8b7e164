"""Quality classifier: a factorisation machine.

Features of a text: hashed lower-case words (presence, scaled to unit length),
structure statistics in quantile-free bins (share of capitals, digits, symbols, bars,
word repetition, line repetition, length, ...) and metadata derived from the text
alone. Pairwise interactions have rank RANK and are scored in linear time by
1/2 * sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

The model is fitted on at most `train_rows` labelled rows (a documented bound: the
rows with the smallest hash of doc_id), in one task; scoring is one pass over the
texts. Labels, lang, source and doc_id are no inputs of a score.

Defined results: null text is the empty text, which has a score too; rows of
repeated doc_ids are scored each; null labels take no part in the fit, nor do rows
with a null doc_id; with no labelled rows all scores are 0.5; further columns are
ignored; texts are never cut.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RollingHash, bounded, crc_mod, joined_bytes, lower_bytes, runs, slices, text_or_empty, word_spans, _SPACE

BUCKETS, RANK, STATS, BINS = 1 << 15, 8, 16, 12
N_FEATURES = BUCKETS + STATS * BINS
TRAIN_ROWS = 8_000


def _class_table() -> np.ndarray:
    kind = np.zeros(256, np.int8)
    kind[65:91], kind[97:123], kind[48:58] = 1, 2, 3
    kind[33:48] = kind[58:65] = kind[91:97] = kind[123:127] = 4
    kind[[44, 46]] = 5
    kind[128:] = 6
    return kind


_CLASS = _class_table()


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: (row, feature, value), sorted by row."""
    data, at = joined_bytes(texts, " ")
    n = len(at) - 1
    size = np.diff(at) - 1
    per = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[at])
    kinds = _CLASS[data]
    upper, letters = per(kinds == 1), per((kinds == 1) | (kinds == 2) | (kinds == 6))
    low = lower_bytes(data)
    start, end = word_spans(low)
    row = np.searchsorted(at, start, "right") - 1
    h = RollingHash(low).of(start, end)
    words = np.bincount(row, minlength=n)
    # distinct words of each text
    bucket = (h % np.uint64(BUCKETS)).astype(np.int64)
    pair = np.unique(row * np.int64(BUCKETS) + bucket)
    r, b = pair // BUCKETS, pair % BUCKETS
    distinct = np.bincount(r, minlength=n)
    # repeated lines and repeated four-word runs
    ls, le = runs(data != 10)
    line_row = np.searchsorted(at, ls, "right") - 1
    le = np.minimum(le, at[line_row + 1] - 1)
    ok = le > ls
    lh = RollingHash(data).of(ls[ok], le[ok])
    lines = np.bincount(line_row[ok], minlength=n)
    uniq_lines = _distinct(line_row[ok], lh, n)
    if len(h) > 3:
        gram = h[:-3] * np.uint64(3) + h[1:-2] * np.uint64(5) + h[2:-1] * np.uint64(7) + h[3:] * np.uint64(11)
        same = row[:-3] == row[3:]
        grams, uniq_grams = np.bincount(row[:-3][same], minlength=n), _distinct(row[:-3][same], gram[same], n)
    else:
        grams = uniq_grams = np.zeros(n, np.int64)
    last = low[end - 1] if len(end) else np.zeros(0, np.uint8)
    odd_end = np.bincount(row, (_CLASS[last] == 4), n)
    one = np.bincount(row, (end - start) == 1, n)
    long_words = np.bincount(row, (end - start) > 12, n)
    safe, w = np.maximum(size, 1), np.maximum(words, 1)
    stats = np.stack([
        np.log1p(size) / 12, np.log1p(words) / 10, upper / np.maximum(letters, 1), per(kinds == 3) / safe * 5, per(kinds == 4) / safe * 5,
        per(kinds == 5) / w, per(data == 124) / w, per(data == 33) / w, distinct / w, np.where(lines, uniq_lines / np.maximum(lines, 1), 1),
        np.where(grams, uniq_grams / np.maximum(grams, 1), 1), odd_end / w, one / w, long_words / w, np.minimum(lines / w * 4, 1), size / w / 20], 1)
    stats = np.clip(stats, 0, 1)
    place = stats * (BINS - 1)
    lo = np.floor(place).astype(np.int64)
    hi, part = np.minimum(lo + 1, BINS - 1), place - lo
    base = BUCKETS + np.arange(STATS) * BINS
    rows = np.concatenate((r, np.repeat(np.arange(n), STATS), np.repeat(np.arange(n), STATS)))
    cols = np.concatenate((b, (base + lo).ravel(), (base + hi).ravel()))
    vals = np.concatenate((1 / np.sqrt(np.maximum(distinct[r], 1)), 0.5 * (1 - part).ravel(), 0.5 * part.ravel()))
    order = np.argsort(rows, kind="stable")
    return rows[order], cols[order], vals[order]


def _distinct(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    if not len(row):
        return np.zeros(n, np.int64)
    order = np.lexsort((h, row))
    r, x = row[order], h[order]
    new = np.concatenate(([True], (r[1:] != r[:-1]) | (x[1:] != x[:-1])))
    return np.bincount(r[new], minlength=n)


def _sums(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Row sums of values (entries, k); rows are sorted."""
    begin = np.searchsorted(rows, np.arange(n))
    total = np.zeros((n, values.shape[1]), values.dtype)
    full = np.diff(np.append(begin, len(rows))) > 0
    if len(rows):
        total[full] = np.add.reduceat(values, begin[full], axis=0)
    return total


def margin(model: dict, rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The margins, and sum_i v_i x_i of each row."""
    vx = model["v"][cols] * vals[:, None]
    parts = _sums(rows, np.concatenate((vx, (vx * vx).sum(1, keepdims=True), (model["w"][cols] * vals)[:, None]), 1), n)
    inner = parts[:, :RANK]
    return model["b"] + parts[:, -1] + 0.5 * ((inner * inner).sum(1) - parts[:, RANK]), inner


def fit(texts: pa.Array, labels: np.ndarray, epochs: int = 12, rate: float = 0.08, decay: float = 1e-5, seed: int = 7) -> dict:
    """AdaGrad on logistic loss over batches of rows."""
    rng = np.random.default_rng(seed)
    model = {"b": 0.0, "w": np.zeros(N_FEATURES), "v": rng.normal(0, 0.03, (N_FEATURES, RANK))}
    n = len(labels)
    if not n or labels.min() == labels.max():
        if n:
            model["b"] = float(np.log((labels.sum() + 1) / (n - labels.sum() + 1)))
        model["v"][:] = 0
        return model
    model["b"] = float(np.log(labels.mean() / (1 - labels.mean())))
    parts, done = [], 0
    for part in slices(iter([pa.record_batch({"text": texts})])):
        r, c, x = features(text_or_empty(part.column("text")))
        parts.append((r + done, c, x.astype(np.float32)))
        done += part.num_rows
    rows, cols, vals = (np.concatenate(x) for x in zip(*parts))
    begin = np.searchsorted(rows, np.arange(n + 1))
    gw, gv, gb = np.full(N_FEATURES, 1e-3), np.full((N_FEATURES, RANK), 1e-3), 1e-3
    for _ in range(epochs):
        order = rng.permutation(n)
        for k in range(0, n, 64):
            pick = order[k : k + 64]
            count = begin[pick + 1] - begin[pick]
            at = np.repeat(begin[pick] - np.cumsum(count) + count, count) + np.arange(count.sum())
            r, c, x = np.repeat(np.arange(len(pick)), count), cols[at], vals[at]
            m, inner = margin(model, r, c, x, len(pick))
            g = (1 / (1 + np.exp(-m)) - labels[pick]) / len(pick) * 8
            uc, inv = np.unique(c, return_inverse=True)
            gr = g[r] * x
            dw = np.bincount(inv, gr, len(uc)) + decay * model["w"][uc]
            dv = np.empty((len(uc), RANK))
            vx = model["v"][c] * x[:, None]
            for f in range(RANK):
                dv[:, f] = np.bincount(inv, gr * (inner[r, f] - vx[:, f]), len(uc))
            dv += decay * model["v"][uc]
            gw[uc] += dw * dw
            gv[uc] += dv * dv
            gb += g.sum() ** 2
            model["w"][uc] -= rate * dw / np.sqrt(gw[uc])
            model["v"][uc] -= rate * dv / np.sqrt(gv[uc])
            model["b"] -= rate * g.sum() / np.sqrt(gb)
    return model


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = list(batches)
    if not got:
        return
    found = pa.Table.from_batches(got).sort_by([("h", "ascending"), ("text", "ascending")])
    model = fit(text_or_empty(found["text"]), found["y"].to_numpy().astype(float))
    model = {"b": model["b"], "w": model["w"].astype(np.float32), "v": model["v"].astype(np.float32)}
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> dict:
    """Fits the model in one task on the train_rows labelled rows of smallest hash.
    The model has a fixed size (about 1.2 MB)."""
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    known = known.where(crc_mod(F.col("doc_id"), 5) != 0).select("doc_id", "y", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(train_rows)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id").select("h", "text", "y")
    # every task joins its own documents; only the sample itself meets in one
    rows = rows.orderBy("h", "text").limit(train_rows)
    got = rows.mapInArrow(_fit_rows, "model binary").collect()
    if not got:
        return fit(pa.array([], pa.string()), np.zeros(0))
    return pickle.loads(got[0]["model"])


def scored(docs: DataFrame, model: dict, threshold: float = 0.3) -> DataFrame:
    """docs with `score` and `predicted` appended; columns of these names are replaced."""
    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    docs = bounded(docs.drop("score", "predicted"))
    packed = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = packed.value
        for batch in slices(batches):
            m, _ = margin(model, *features(text_or_empty(batch.column("text"))), batch.num_rows)
            p = 1 / (1 + np.exp(-np.clip(m.astype(float), -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())]))


def accepted(docs: DataFrame, model: dict, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that the classifier accepts, with their columns as they are."""
    packed = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = packed.value
        for batch in slices(batches):
            m, _ = margin(model, *features(text_or_empty(batch.column("text"))), batch.num_rows)
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(m.astype(float), -500, 500))) >= threshold))

    return bounded(docs).mapInArrow(run, docs.schema)
