"""Benchmark decontamination: CGK embeddings and bit-sampling LSH.

Items and item-sized windows of documents are word sequences (lower case, runs of
letters and digits). A random walk (CGK) copies a word or stays, by a shared random
bit for each step and word, so a small edit distance becomes a small Hamming
distance. Tables of SAMPLED places of several walks are the LSH: TABLES keys a walk.
The keys are what windows and items are joined on: every key of a window is looked up
among the keys of all items of its size, and each item met is verified by its exact
edit distance to the best substring near the window. The number of walks follows from
RECALL: it is the smallest at which simulated copies with as many random edits as the
budget allows meet their item in that share of cases (see `walks`).

Windows need not be tried everywhere: at most d edits leave one of an item's d+1 runs
untouched, so a window within reach shares a run of words with an item at the same
alignment. Windows start at the alignments of shared runs, whatever their number.

A document holds an item if a substring lies within floor((1 - similarity) * words)
edits of it; items of fewer than five words allow none and are found exactly.

The benchmark is handled in blocks of at most BLOCK_ITEMS items and about BLOCK_WORDS
words, which bounds what is broadcast; each block is a pass over the documents.

Defined results: null and empty texts hold nothing; null item ids or texts, and items
without words, take no part; repeated items and rows are reported each; an empty table
gives no rows; columns of the documents pass through, whatever their names; texts are
never cut. `edits` is the least of the verified windows, `first_word` where the stretch
searched for it begins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RollingHash, bounded, joined_bytes, mix64, runs, slices, text_or_empty, written

SIMILARITY, RECALL, WALKS, TABLES, SAMPLED, BLOCK_ITEMS, BLOCK_WORDS = 0.8, 0.99, 16, 6, 2, 10_000, 1_000_000
_rng = np.random.default_rng(3)
_SALTS = [np.uint64(x) for x in _rng.integers(1, 2**63, WALKS)]
_DRAWS = _rng.random((WALKS, TABLES, SAMPLED))
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts and where each text's begin."""
    data, at = joined_bytes(pc.utf8_lower(texts), " ")
    start, end = runs(_WORD[data])
    return RollingHash(data, salt=1).of(start, end), np.searchsorted(start, at)


def _runs_of(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of runs of k words, by start."""
    n = max(0, len(h) - k + 1)
    return mix64(sum((mix64(h[j : j + n] + np.uint64(j * 77)) for j in range(k)), np.uint64(k)))


def edit_budget(n: int, similarity: float = SIMILARITY) -> int:
    return int(np.floor((1 - similarity) * n + 1e-9))


def keys(seq: np.ndarray, n_walks: int) -> np.ndarray:
    """(sequences, words) -> (sequences, n_walks * TABLES) keys; equal keys of a column meet."""
    m, n = seq.shape
    out = np.zeros((m, n_walks * TABLES), np.uint64)
    padded = np.concatenate((seq, np.zeros((m, 1), np.uint64)), 1)
    row = np.arange(m)
    for r in range(n_walks):
        # walks of 2n steps: a word is left with probability one half
        places = (_DRAWS[r] * 2 * n).astype(np.int64)
        wanted: dict[int, list[int]] = {}
        for t in range(TABLES):
            for p in set(places[t].tolist()):
                wanted.setdefault(p, []).append(t)
        at = np.zeros(m, np.int64)
        for step in range(max(wanted) + 1):
            here = padded[row, at]
            for t in wanted.get(step, ()):
                c = r * TABLES + t
                out[:, c] = mix64(out[:, c] * np.uint64(31) + here + np.uint64(step))
            bit = (mix64(here ^ _SALTS[r] ^ np.uint64(step * 2654435761)) >> np.uint64(63)).astype(np.int64)
            at = np.minimum(at + bit, n)
    return mix64(out + np.arange(out.shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def edited(rng: np.random.Generator, n: int, d: int) -> tuple[np.ndarray, np.ndarray]:
    """A random item of n words and the item-sized window of a copy with d random edits,
    aligned at a word that the edits spared, among other words."""
    item = rng.integers(1, 2**62, n).astype(np.uint64)
    copy, source = list(item), list(range(n))
    for _ in range(d):
        at, kind = int(rng.integers(len(copy) + 1)), int(rng.integers(3))
        if kind and at < len(copy):
            del copy[at], source[at]
        if kind < 2:
            copy.insert(at, np.uint64(rng.integers(1, 2**62)))
            source.insert(at, -1)
    kept = [i for i, x in enumerate(source) if x >= 0]
    if not kept:
        return item, item
    at = kept[int(rng.integers(len(kept)))]
    around = [*rng.integers(1, 2**62, n).astype(np.uint64), *copy, *rng.integers(1, 2**62, n).astype(np.uint64)]
    first = max(0, n + at - source[at])
    return item, np.array(around[first : first + n], np.uint64)


@lru_cache(1024)
def walks(n: int, d: int, target: float = RECALL, trials: int = 200) -> int:
    """The fewest walks (at most WALKS) that reach the target on simulated copies."""
    if not d:
        return 1
    rng = np.random.default_rng(n * 1000 + d)
    pairs = [edited(rng, n, d) for _ in range(trials)]
    same = keys(np.array([x for x, _ in pairs]), WALKS) == keys(np.array([y for _, y in pairs]), WALKS)
    met = np.logical_or.accumulate(same, axis=1)[:, TABLES - 1 :: TABLES].mean(0)
    return int(np.argmax(met >= target)) + 1 if (met >= target).any() else WALKS


class Items:
    """The items of one block, ready for search."""

    def __init__(self, ids: list[int], texts: list[str], similarity: float = SIMILARITY):
        h, at = words(pa.array(texts, pa.large_string()))
        kept = [i for i in range(len(ids)) if at[i + 1] > at[i]]
        self.similarity = similarity
        self.ids = [ids[i] for i in kept]
        self.words = [h[at[i] : at[i + 1]] for i in kept]
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.edits = np.array([edit_budget(len(w), similarity) for w in self.words], np.int64)
        seed = np.minimum(5, -(-(self.size - self.edits) // (self.edits + 1)))
        self.seeds = {}
        for k in sorted(set(seed.tolist())):
            mine = np.flatnonzero(seed == k)
            parts = [_runs_of(self.words[i], k) for i in mine]
            runs_ = np.concatenate(parts)
            item = np.repeat(mine, [len(p) for p in parts])
            place = np.concatenate([np.arange(len(p)) for p in parts])
            order = np.argsort(runs_, kind="stable")
            mask = np.zeros(1 << 20, bool)
            mask[(runs_ >> np.uint64(44)).astype(np.int64)] = True
            self.seeds[k] = (runs_[order], item[order], place[order], mask)
        # the tables of each item size: sorted keys of all its items
        self.tables = {}
        for n in sorted(set(self.size.tolist())):
            mine = np.flatnonzero(self.size == n)
            up = -(-n // 5) * 5  # sizes up to the next that allows one edit more share its plan
            r = walks(up, edit_budget(up, similarity)) if self.edits[mine[0]] else 1
            own = keys(np.stack([self.words[i] for i in mine]), r)
            item = np.repeat(mine, own.shape[1])
            order = np.argsort(own.ravel(), kind="stable")
            self.tables[n] = (r, own.ravel()[order], item[order])

    def candidates(self, h: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Distinct (document, item, start) of alignments that share a run."""
        found = []
        for k, (keys, item, place, mask) in self.seeds.items():
            g = _runs_of(h, k)
            maybe = np.flatnonzero(mask[(g >> np.uint64(44)).astype(np.int64)])
            lo, hi = np.searchsorted(keys, g[maybe]), np.searchsorted(keys, g[maybe], "right")
            count = hi - lo
            pos = np.repeat(maybe, count)
            at = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())
            doc = np.searchsorted(begin, pos, "right") - 1
            inside = pos + k <= begin[doc + 1]
            found.append(np.stack([doc[inside], item[at][inside], (pos - place[at])[inside]], 1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)

    def meet(self, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (window, item) that share a key of a table."""
        r, own, item = self.tables[window.shape[1]]
        found = keys(window, r).ravel()
        lo, hi = np.searchsorted(own, found), np.searchsorted(own, found, "right")
        count = hi - lo
        at = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())
        pair = np.unique(np.repeat(np.arange(len(found)) // (r * TABLES), count) * len(self.ids) + item[at])
        return pair // max(1, len(self.ids)), pair % max(1, len(self.ids))

    def search(self, h: np.ndarray, begin: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(document, item number, edits, first word) of the best place of each item held."""
        cand, best = self.candidates(h, begin), {}
        size = self.size[cand[:, 1]] if len(cand) else np.zeros(0, np.int64)
        for n in np.unique(size).tolist():
            d = edit_budget(n, self.similarity)
            places = np.unique(cand[size == n][:, [0, 2]], axis=0)
            for part in np.array_split(places, max(1, len(places) * n // 400_000)):
                doc, start = part[:, 0], part[:, 1]
                first = np.clip(start, begin[doc], begin[doc + 1])
                idx = first[:, None] + np.arange(n)
                window = np.where(idx < begin[doc + 1][:, None], h[np.minimum(idx, len(h) - 1)], 0)
                at, item = self.meet(window)
                for i in np.unique(item).tolist():
                    mine = at[item == i]
                    x, y = doc[mine], start[mine]
                    lo = np.maximum(y - d, begin[x])
                    idx = lo[:, None] + np.arange(n + 2 * d)
                    near = np.where((idx < np.minimum(begin[x + 1], y + n + d)[:, None]), h[np.minimum(idx, len(h) - 1)], 0)
                    edits = substring_edits(self.words[i], near)
                    for x_, e, p in zip(x.tolist(), edits.tolist(), (lo - begin[x]).tolist()):
                        if e <= d and (e, p) < best.get((x_, i), (d + 1, 0)):
                            best[(x_, i)] = (e, p)
        return [(x, i, e, p) for (x, i), (e, p) in sorted(best.items())]


def substring_edits(item: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Edit distance of item to its best substring of each row of near."""
    m, w = near.shape
    row = np.zeros((m, w + 1), np.int64)
    lift = np.arange(w + 1)
    for i, x in enumerate(item):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, :-1] + (near != x), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - lift, axis=1) + lift
    return row.min(1)


def blocks(bench: DataFrame, similarity: float = SIMILARITY) -> Iterator[Items]:
    """The benchmark in blocks of bounded size, read one at a time."""
    rows = bench.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    held, size = [], 0
    for r in rows.toLocalIterator():
        held.append(r)
        size += len(r["text"]) // 5
        if len(held) >= BLOCK_ITEMS or size >= BLOCK_WORDS:
            yield Items([x["item_id"] for x in held], [x["text"] for x in held], similarity)
            held, size = [], 0
    if held:
        yield Items([x["item_id"] for x in held], [x["text"] for x in held], similarity)


LEAK = "doc_id long, item_id long, edits int, first_word long"


def _leaks(packed):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = packed.value
        for batch in slices(batches):
            h, begin = words(text_or_empty(batch.column("text")))
            found = items.search(h, begin) if len(h) else []
            doc, item, edits, first = (list(x) for x in zip(*found)) if found else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(doc, pa.int64())), pa.array([items.ids[i] for i in item], pa.int64()), pa.array(edits, pa.int32()), pa.array(first, pa.int64())],
                names=["doc_id", "item_id", "edits", "first_word"])

    return run


def _clean(packed):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = packed.value
        for batch in slices(batches):
            h, begin = words(text_or_empty(batch.column("text")))
            free = np.ones(batch.num_rows, bool)
            free[[x[0] for x in (items.search(h, begin) if len(h) else [])]] = False
            yield batch.filter(pa.array(free))

    return run


def leaks(docs: DataFrame, bench: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, edits, first_word: where documents hold benchmark items. Each
    block of items is a pass over the documents."""
    spark = docs.sparkSession
    rows = bounded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    out = spark.createDataFrame([], LEAK)
    for n, items in enumerate(blocks(bench, similarity)):
        found = rows.mapInArrow(_leaks(spark.sparkContext.broadcast(items)), LEAK)
        out = out.unionByName(found) if n else found
    return out


def clean(docs: DataFrame, bench: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs without those that hold a benchmark item, columns as they are. What a block
    leaves is written before the next one, so a task never holds more than one block."""
    out = bounded(docs)
    for n, items in enumerate(blocks(bench, similarity)):
        out = (written(out, "dec_left") if n else out).mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(items)), docs.schema)
    return out


def plain_words(text: str | None) -> list[str]:
    """The words as the operator takes them, for tests."""
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())
