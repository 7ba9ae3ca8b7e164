"""Repeated byte strings, by difference covers and one bucket of windows at a time.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else.
Texts are packed into blocks. Of each block only the positions whose remainder lies in
a difference cover modulo V get a rank class (the hash of the LENGTH - V + 1 bytes
there). Any two positions share a step below V at which both are in the cover, so a
string that starts twice holds, at that step, a cover position whose class occurs
twice. Only windows that hold such a position stay (the segments). Their hashes are
then sorted one range (bucket) after another, so that what is in flight at a time is
bounded; the number of passes depends on the share of such windows, not on the input.

A block sends each distinct hash once, in sorted order and without positions; the
answer is a bit for each, and the block finds its places again by hashing anew. So a
passage in a third of all texts costs one entry a block.

Strings are told apart by two 64-bit hashes (of the cover class and of the whole).

Defined results: null and empty texts have no bytes; texts shorter than LENGTH keep
all; rows that repeat a doc_id, and rows with a null doc_id, are returned each; an
empty table gives no rows; further columns are ignored; texts are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RollingHash, erased, joined_bytes, n_tasks, released, runs, slices, text_or_empty, written

LENGTH, Q = 200, 11
V = Q * Q + Q + 1
PASS_SHARE = 1 / 7  # windows of a pass, in bytes of text


@lru_cache(1)
def difference_cover() -> np.ndarray:
    """Q + 1 residues modulo V = Q^2 + Q + 1 whose differences are all residues: the
    zeros of a linear recurrence of full period over the field of Q elements."""
    for a in range(Q):
        for b in range(Q):
            for c in range(1, Q):
                state, seen, zeros = (0, 0, 1), 0, set()
                while True:
                    if state[0] == 0:
                        zeros.add(seen % V)
                    state = (state[1], state[2], (a * state[2] + b * state[1] + c * state[0]) % Q)
                    seen += 1
                    if state == (0, 0, 1) or seen == Q**3:
                        break
                if seen == Q**3 - 1 and len(zeros) == Q + 1:
                    return np.array(sorted(zeros))
    raise AssertionError


BLOCK = "doc_ids array<long>, offsets binary, data binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        data, at = joined_bytes(text_or_empty(batch.column("text")))
        yield pa.RecordBatch.from_arrays([
            pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([at.astype("<i8").tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary())], names=["doc_ids", "offsets", "data"])


def _cover_places(at: np.ndarray, length: int) -> np.ndarray:
    """Positions of the cover whose class lies within their document."""
    mask = np.zeros(V, bool)
    mask[difference_cover()] = True
    n, w = int(at[-1]), length - V + 1
    ok = np.resize(mask, n)
    for end in (at[1:] - 1).tolist():  # no class may reach a separator
        ok[max(0, end - w + 1) : end + 1] = False
    return np.flatnonzero(ok)


def _new(ranked: np.ndarray) -> np.ndarray:
    """Marks the first of each run of equal values."""
    mark = np.ones(len(ranked), bool)
    mark[1:] = ranked[1:] != ranked[:-1]
    return mark


def _sent(h: np.ndarray, bid: int, first: int, last: int, total: int):
    """Distinct hashes of the buckets first..last-1 of total, a row for each bucket."""
    width = (1 << 64) // total
    edges = np.array([min(k * width, (1 << 64) - 1) for k in range(first, last + 1)], np.uint64)
    if first:
        h = h[h >= edges[0]]
    if last < total:
        h = h[h < edges[-1]]
    distinct = np.sort(h)
    distinct = distinct[_new(distinct)]
    cut = np.searchsorted(distinct, edges)
    if last == total:
        cut[-1] = len(distinct)
    there = np.flatnonzero(np.diff(cut))
    return pa.RecordBatch.from_arrays([
        pa.array((there + first).astype(np.int32)), pa.array(np.full(len(there), bid)), pa.array([distinct[cut[k] : cut[k + 1]].tobytes() for k in there], pa.binary())], names=["bucket", "bid", "hashes"])


def _twice(t: pa.Table) -> pa.Table:
    """Of a bucket: for each block a bit for each of its hashes, set if another block has it."""
    parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["hashes"].combine_chunks()]
    h = np.sort(np.concatenate(parts))
    more = h[1:][h[1:] == h[:-1]]
    more = more[_new(more)]
    bits = []
    for x in parts:
        at = np.minimum(np.searchsorted(more, x), max(0, len(more) - 1))
        bits.append(np.packbits(more[at] == x if len(more) else np.zeros(len(x), bool)).tobytes())
    return pa.table({"bid": t["bid"], "bucket": t["bucket"], "n": pa.array([len(x) for x in parts], pa.int32()), "bits": pa.array(bits, pa.binary())})


def _answered(h: np.ndarray, answers: list[dict]) -> np.ndarray:
    """Whether each hash of a block occurs twice, in the block or beyond it."""
    order = np.argsort(h)
    ranked = h[order]
    new = _new(ranked)
    bits = [np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=x["n"]) for x in sorted(answers, key=lambda x: x["bucket"])]
    flags = np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)
    assert len(flags) == new.sum()
    first = np.flatnonzero(new)
    flags |= np.diff(np.append(first, len(h))) > 1
    out = np.empty(len(h), bool)
    out[order] = np.repeat(flags, np.diff(np.append(first, len(h))))
    return out


_ANSWER = "bid long, bucket int, n int, bits binary"


def _classes(length: int, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                data, at = np.frombuffer(x["data"], np.uint8), np.frombuffer(x["offsets"], "<i8")
                s = _cover_places(at, length)
                yield _sent(RollingHash(data, 2).of(s, s + length - V + 1), x["bid"], 0, total, total)

    return run


def _segments(length: int):
    """The windows that hold a repeated cover class, as runs of starts with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                data, at = np.frombuffer(x["data"], np.uint8), np.frombuffer(x["offsets"], "<i8")
                s = _cover_places(at, length)
                s = s[_answered(RollingHash(data, 2).of(s, s + length - V + 1), x["answers"] or [])] if len(s) else s
                step = np.zeros(len(data) + 1, np.int32)
                np.add.at(step, np.maximum(s - V + 1, 0), 1)
                np.add.at(step, s + 1, -1)
                ok = np.cumsum(step[:-1]) > 0
                for end in (at[1:] - 1).tolist():
                    ok[max(0, end - length + 1) : end + 1] = False
                a, b = runs(ok)
                raw = [data[i : j + length - 1].tobytes() for i, j in zip(a.tolist(), b.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array([x["bid"]]), pa.array([int((b - a).sum())]), pa.array([a.astype("<i8").tobytes()], pa.binary()), pa.array([(b - a).astype("<i8").tobytes()], pa.binary()), pa.array([b"".join(raw)], pa.binary())],
                    names=["bid", "windows", "starts", "sizes", "data"])

    return run


def _window_hashes(x: dict, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Start in the block and hash of each window of a row of segments."""
    starts, sizes = np.frombuffer(x["starts"], "<i8"), np.frombuffer(x["sizes"], "<i8")
    data = np.frombuffer(x["data"], np.uint8)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    # runs lie one behind the other: windows that reach into the next run are passed over
    reach = sizes + length - 1
    end = np.cumsum(reach)
    own = np.zeros(len(data) + 1, np.int8)
    own[end - reach] += 1
    own[end - length + 1] -= 1
    inside = np.flatnonzero(np.cumsum(own[: len(data) - length + 1], dtype=np.int8))
    places = inside + np.repeat(starts - (end - reach), sizes)
    return places, RollingHash(data, 3).all(length)[inside]


def _windows(length: int, first: int, last: int, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                yield _sent(_window_hashes(x, length)[1], x["bid"], first, last, total)

    return run


def _spans(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                at, h = _window_hashes(x, length)
                at = at[_answered(h, x["answers"] or [])] if len(h) else at
                # starts in order; a span goes on while the next window begins inside or right behind it
                new = np.flatnonzero(np.concatenate(([True], np.diff(at) > length))) if len(at) else np.zeros(0, np.int64)
                end = np.append(at[new[1:] - 1], at[-1]) + length if len(at) else at
                yield pa.RecordBatch.from_arrays([pa.array([x["bid"]]), pa.array([at[new].astype("<i8").tobytes()], pa.binary()), pa.array([end.astype("<i8").tobytes()], pa.binary())], names=["bid", "a", "b"])

    return run


RESULT = "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary"


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.to_pylist():
            raw, at = x["data"], np.frombuffer(x["offsets"], "<i8")
            a, b = (np.frombuffer(x[c] or b"", "<i8") for c in "ab")
            first = np.searchsorted(a, at)
            sizes, spans, kept = np.diff(at) - 1, [], []
            for k in range(len(at) - 1):
                base, mine, place, parts = int(at[k]), [], int(at[k]), []
                for i in range(int(first[k]), int(first[k + 1])):
                    lo, hi = int(a[i]), int(b[i])
                    if mine and mine[-1]["stop"] == lo - base:
                        mine[-1]["stop"] = hi - base
                    else:
                        mine.append({"start": lo - base, "stop": hi - base})
                    parts.append(raw[place:lo])
                    place = hi
                parts.append(raw[place : int(at[k + 1]) - 1])
                spans.append(mine)
                kept.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays([
                pa.array(x["doc_ids"], pa.int64()), pa.array(sizes), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"])


def _collected(answers: DataFrame) -> DataFrame:
    return answers.groupBy("bid").agg(F.collect_list(F.struct("bucket", "n", "bits")).alias("answers"))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, the removed spans (byte positions) and the kept bytes."""
    assert length > V
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = written(rows.mapInArrow(_blocks, BLOCK).withColumn("bid", F.monotonically_increasing_id()), "rep_blocks")
    total = 4 * n_tasks(spark)
    sent = "bucket int, bid long, hashes binary"
    answers = blocks.mapInArrow(_classes(length, total), sent).groupBy("bucket").applyInArrow(_twice, _ANSWER)
    answers = written(answers, "rep_classes")
    released(spark)
    with_answers = blocks.select("bid", "offsets", "data").join(_collected(answers), "bid", "left")
    segments = written(with_answers.mapInArrow(_segments(length), "bid long, windows long, starts binary, sizes binary, data binary"), "rep_segments")
    erased(answers)
    released(spark)
    size = segments.agg(F.sum("windows").alias("w")).first()["w"] or 0
    bytes_ = blocks.agg(F.sum(F.length("data")).alias("b")).first()["b"] or 0
    passes = max(1, -(-int(size) // max(1, int(bytes_ * PASS_SHARE))))
    tables = []
    for p in range(passes):
        some = segments.mapInArrow(_windows(length, p * total, (p + 1) * total, passes * total), sent).groupBy("bucket").applyInArrow(_twice, _ANSWER)
        tables.append(written(some, "rep_windows"))
        del some
        released(spark)
    found = reduce(DataFrame.unionByName, tables)
    spans = segments.join(_collected(found), "bid", "left").mapInArrow(_spans(length), "bid long, a binary, b binary")
    spans = written(spans, "rep_spans")
    erased(segments, *tables)
    released(spark)
    return blocks.join(spans, "bid", "left").select("doc_ids", "offsets", "data", "a", "b").mapInArrow(_removed, RESULT)
