"""Token ids in Simple-8b words.

Every word of 64 bits has a selector in its top four bits and as many ids as fit
into the other 60 at the selector's width. Selectors 0 and 1 stand for 240 and 120
zero ids; selector 15 is the escape: the next word is one raw 64-bit value. A block
packs the ids of consecutive documents; its `offsets` say where each document's
ids start, so any block, and any document in it, can be decoded alone, with one
vectorised shift per selector. Blocks are rows of a Parquet table (first doc_id,
block start in the id stream, words as binary, offsets as binary).

Defined results: a null or empty text has the end id alone; repeated doc_ids keep
all rows, ordered by doc_id, then a hash of the text; a null doc_id sorts first; an empty table
gives an empty file; further columns are ignored; texts are never cut.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, bounded, joined_bytes, n_tasks, shared_dir, slices, text_or_empty, written

#: ids per word and bits per id of each selector (fixed values of the format)
COUNTS = (240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2)
WIDTHS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30)
ESCAPE = 15
BLOCK_IDS = 1 << 18


def _needs(ids: np.ndarray) -> np.ndarray:
    """The place, among the widths in ascending order, of the narrowest that holds each id."""
    return sum(((ids >= np.uint64(1 << width)).astype(np.int8) for width in sorted(set(WIDTHS))), np.zeros(len(ids), np.int8))


_NEED = _needs(np.arange(1 << 16, dtype=np.uint64))


def pack(ids: np.ndarray) -> np.ndarray:
    """uint64 ids -> uint64 words. At each place the selector that packs most ids is
    taken; all places are judged at once, then the chain of words is followed."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64)
    order = sorted(set(WIDTHS))
    need = np.zeros(n + max(COUNTS), np.int8)  # the narrowest width that holds the id; nothing after the end
    need[:n] = _NEED[np.minimum(ids, np.uint64(len(_NEED) - 1)).astype(np.uint32)]
    if (wide := np.flatnonzero(ids >= len(_NEED))).size:
        need[wide] = _needs(ids[wide])
    # the widest need among the next c ids, for all c, from shorter spans
    span = {1: need}
    for c in sorted(COUNTS):
        half = max(x for x in span if x >= c / 2) if c > 2 else 1
        wide = span[half]
        span[c] = np.maximum(wide[: len(wide) - (c - half)], wide[c - half :])
    best = np.full(n, ESCAPE, np.int8)
    for s in range(len(COUNTS) - 1, -1, -1):
        fits = span[COUNTS[s]][:n] <= order.index(WIDTHS[s])
        if s < 2:
            fits[max(0, n - COUNTS[s] + 1) :] = False  # runs of zeros are never padded
        np.minimum(best, np.where(fits, np.int8(s), np.int8(ESCAPE)), out=best)
    step = np.array([*COUNTS, 1], np.int64)[best].tolist()
    places, at = [], 0
    while at < n:
        places.append(at)
        at += step[at]
    places = np.array(places, np.int64)
    chosen = best[places]
    extra = np.cumsum(chosen == ESCAPE)
    where = np.arange(len(places)) + extra - (chosen == ESCAPE)
    words = np.zeros(len(places) + int(extra[-1]), np.uint64)
    words[where] = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate((ids, np.zeros(max(COUNTS), np.uint64)))
    for s in range(2, len(COUNTS)):
        mine = chosen == s
        if mine.any():
            at, word = places[mine], np.zeros(int(mine.sum()), np.uint64)
            for k in range(COUNTS[s]):
                word |= padded[at + k] << np.uint64(k * WIDTHS[s])
            words[where[mine]] |= word
    raw = chosen == ESCAPE
    words[where[raw] + 1] = ids[places[raw]]
    return words


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The first n ids."""
    words = np.ascontiguousarray(words, np.uint64)
    if not n:
        return np.zeros(0, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int8)
    raw = np.zeros(len(words), bool)
    if (sel == ESCAPE).any():  # a raw value may look like a selector: follow the escapes
        flags, at, marks = sel == ESCAPE, 0, np.flatnonzero(sel == ESCAPE)
        for m in marks.tolist():
            if m >= at:
                raw[m + 1] = True
                at = m + 2
        sel = np.where(flags & ~raw, ESCAPE, sel)
    heads = np.flatnonzero(~raw)
    counts = np.array([*COUNTS, 1], np.int64)[sel[heads]]
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in range(2, len(COUNTS)):
        mine = sel[heads] == s
        if mine.any():
            shift = np.arange(COUNTS[s], dtype=np.uint64) * np.uint64(WIDTHS[s])
            out[starts[mine][:, None] + np.arange(COUNTS[s])] = (words[heads[mine]][:, None] >> shift) & np.uint64((1 << WIDTHS[s]) - 1)
    lone = sel[heads] == ESCAPE
    out[starts[lone]] = words[heads[lone] + 1]
    return out[:n]


@lru_cache(1)
def worker_encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: UTF-8 of white space outside ASCII starts with one of these pairs; next to it pieces are not cut
_ODD = np.zeros(65536, bool)
_ODD[[0xC285, 0xC2A0, 0xE19A, 0xE280, 0xE281, 0xE380]] = True
_LEAD = _ODD.reshape(256, 256).any(1)
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True


class Encoder:
    """Encodes texts piece by piece: a piece is a run of white space with the run of
    other characters after it. The tokenizer's pattern never joins characters across
    such a border, so each distinct piece is encoded once; many are encoded as one
    string and cut by the byte lengths of tokens. Texts with white space outside ASCII
    are encoded whole. Up to KNOWN pieces, in no more than KNOWN_BYTES, stay for later
    slices of the worker: those that were met most often."""

    KNOWN, KNOWN_BYTES = 1 << 19, 24 << 20

    def __init__(self, path: str):
        self.tok = _tokenizer(path)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        self.bytes[list(vocab.values())] = [len(t) for t in vocab]  # a character of a byte-level token is a byte
        self.pieces = pa.array([], pa.large_binary())
        self.ids, self.ends, self.uses = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def _add(self, pieces: pa.Array) -> np.ndarray:
        """Encodes new pieces; the place of each among those known."""
        size = pc.binary_length(pieces).to_numpy()
        data = np.frombuffer(pieces.buffers()[2], np.uint8)
        end = np.cumsum(size)
        joins = _WHITE[data[end - size]] & ~_WHITE[data[end - 1]]
        order = np.concatenate((np.flatnonzero(joins), np.flatnonzero(~joins)))
        if not joins.all():
            pieces = pieces.take(pa.array(order))
            size, data = size[order], np.frombuffer(pieces.buffers()[2], np.uint8)
            end = np.cumsum(size)
        cut, n, ids, counts = np.append(0, end), int(joins.sum()), [], []
        for k in range(0, n, 1000):
            stop = min(k + 1000, n)
            got = np.array(self.tok.encode_batch_fast([data[cut[k] : cut[stop]].tobytes().decode()], add_special_tokens=False)[0].ids, np.int64)
            ids.append(got)
            counts.append(np.diff(np.searchsorted(np.cumsum(self.bytes[got]), cut[k + 1 : stop + 1] - cut[k]) + 1, prepend=0))
        for k in range(n, len(size)):
            got = np.array(self.tok.encode(data[cut[k] : cut[k + 1]].tobytes().decode(), add_special_tokens=False).ids, np.int64)
            ids.append(got)
            counts.append(np.array([len(got)]))
        place = np.empty(len(order), np.int64)
        place[order] = len(self.pieces) + np.arange(len(order))
        self.pieces = pa.concat_arrays([self.pieces, pieces])
        self.ids = np.concatenate((self.ids, *ids)).astype(np.uint32)
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(np.concatenate(counts))))
        self.uses = np.concatenate((self.uses, np.zeros(len(order), np.int64)))
        return place

    def _trim(self) -> None:
        if len(self.pieces) <= self.KNOWN and self.pieces.nbytes <= self.KNOWN_BYTES:
            return
        best = np.argsort(-self.uses, kind="stable")[: self.KNOWN // 2]
        size = pc.binary_length(self.pieces).to_numpy()[best]
        best = np.sort(best[np.cumsum(size) <= self.KNOWN_BYTES // 2])
        count = np.diff(self.ends)[best]
        self.ids = self.ids[np.repeat(self.ends[best] - np.cumsum(count) + count, count) + np.arange(count.sum())]
        self.ends = np.append(0, np.cumsum(count))
        self.pieces, self.uses = self.pieces.take(pa.array(best)), self.uses[best] // 2

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """uint32 ids of all texts, each closed by id 0, and the start of each text's."""
        self._trim()
        data, at = joined_bytes(texts, " ")
        n = len(at) - 1
        white = _WHITE[data]
        border = np.zeros(len(data), bool)
        border[1:] = white[1:] & ~white[:-1]
        border[at[1:] - 1] = True  # the separator itself, dropped below
        border[at[:-1]] = True
        lead = np.flatnonzero(_LEAD[data])  # the separator is ASCII, so a next byte is there
        lead = lead[_ODD[(data[lead].astype(np.int64) << 8) | data[lead + 1]]]
        odd = np.zeros(n, bool)
        odd[np.searchsorted(at, lead, "right") - 1] = True
        starts = np.flatnonzero(border)
        doc = np.repeat(np.arange(n), np.diff(np.searchsorted(starts, at)))
        keep = (starts != at[doc + 1] - 1) & ~odd[doc]
        ends = np.append(starts[1:], len(data))[keep]
        ends = np.minimum(ends, at[doc[keep] + 1] - 1)
        starts, doc = starts[keep], doc[keep]
        # pieces as an Arrow array of their own; those not known yet are encoded once each
        sizes = ends - starts
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        take = np.ones(len(data), bool)
        take[at[1:] - 1] = False
        if odd.any():
            take &= ~np.repeat(odd, np.diff(at))
        flat = np.ascontiguousarray(data[take])
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat)])
        mine = pc.fill_null(pc.index_in(pieces, self.pieces), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(mine < 0)
        if len(new):
            coded = pieces.take(pa.array(new)).dictionary_encode()
            mine[new] = self._add(coded.dictionary)[coded.indices.to_numpy()]
        self.uses += np.bincount(mine, minlength=len(self.uses))
        bounds = self.ends
        first, count = bounds[mine], bounds[mine + 1] - bounds[mine]
        whole = {int(d): np.array(self.tok.encode(texts[int(d)].as_py(), add_special_tokens=False).ids, np.uint32) for d in np.flatnonzero(odd)}
        per_doc = np.bincount(doc, count, n).astype(np.int64) + 1
        for d, got in whole.items():
            per_doc[d] = len(got) + 1
        begin = np.concatenate(([0], np.cumsum(per_doc)))
        out = np.zeros(int(begin[-1]), np.uint32)
        inside = np.cumsum(count) - count
        first_of_doc = np.searchsorted(doc, np.arange(n))
        base = np.append(inside, count.sum())[first_of_doc]
        where = begin[doc] + inside - base[doc]
        total = int(count.sum())
        if total:
            lift = np.repeat(first - inside, count) + np.arange(total)
            out[np.repeat(where - inside, count) + np.arange(total)] = self.ids[lift]
        for d, got in whole.items():
            out[begin[d] : begin[d] + len(got)] = got
        return out, begin


BLOCK = "part int, block int, n_ids long, doc_ids binary, offsets binary, words binary"
NULL_ID = -(2**63)


def _blocks(path: str):
    def made(part: int, block: int, docs: list, ids: list[np.ndarray]) -> pa.RecordBatch:
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype("<i8")
        return pa.RecordBatch.from_arrays([
            pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([int(offsets[-1])], pa.int64()),
            pa.array([np.array(docs, "<i8").tobytes()], pa.binary()), pa.array([offsets.tobytes()], pa.binary()),
            pa.array([pack(np.concatenate(ids)).astype("<u8").tobytes()], pa.binary())],
            names=["part", "block", "n_ids", "doc_ids", "offsets", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows of a partition -> blocks of consecutive documents."""
        encoder, docs, kept, size, part, block = worker_encoder(path), [], [], 0, 0, 0
        for batch in slices(batches, limit=3 * SLICE_BYTES // 2):  # fewer slices look fewer pieces up
            ids, begin = encoder.encode(text_or_empty(batch.column("text")))
            part = batch.column("part")[0].as_py()
            for d, a, b in zip(batch.column("doc_id").to_pylist(), begin[:-1].tolist(), begin[1:].tolist()):
                if docs and size + b - a > BLOCK_IDS:
                    yield made(part, block, docs, kept)
                    docs, kept, size, block = [], [], 0, block + 1
                docs.append(NULL_ID if d is None else d)
                kept.append(ids[a:b])
                size += b - a
        if docs:
            yield made(part, block, docs, kept)

    return run


def write_ids(docs: DataFrame, tokenizer_path: str, path: str) -> None:
    """Encodes all texts and writes the file of blocks in ascending doc_id order. The
    texts are dealt by ranges of doc_id before they are encoded, so each is encoded once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = bounded(rows).withColumn("h", F.xxhash64("text"))  # many rows of one doc_id (or none) are several ranges, too
    ordered = rows.repartitionByRange(n_tasks(docs.sparkSession), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").withColumn("part", F.spark_partition_id())
    ordered.select("doc_id", "text", "part").mapInArrow(_blocks(tokenizer_path), BLOCK).write.option("compression", "zstd").parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.to_pylist():
            docs, at = np.frombuffer(x["doc_ids"], "<i8"), np.frombuffer(x["offsets"], "<i8")
            ids = unpack(np.frombuffer(x["words"], "<u8"), int(at[-1])).astype("<u4")
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([
                pa.array(docs, mask=docs == NULL_ID), pa.array(at[:-1] + x["base"]), pa.array(np.diff(at)), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the file: doc_id, start, n_tokens, ids_crc32. A block's place
    in the stream is the sum of the blocks before it."""
    blocks = spark.read.schema(BLOCK).parquet(path)
    sizes = blocks.select("part", "block", "n_ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each task of the writer
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_base"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part").select("part", "block", (F.col("part_base") + F.col("inside")).alias("base"))
    placed = written(placed, "ids_placed")  # its size is known then, so the blocks are not dealt out where it is small
    return blocks.join(placed, ["part", "block"]).select("doc_ids", "offsets", "words", "base").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Writes the id file into the shared folder and reads it back."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/grove/ids-{uuid.uuid4().hex}"
    write_ids(docs, tokenizer_path, path)
    return read_ids(spark, path)
