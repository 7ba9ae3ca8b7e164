"""N-gram Jaccard join over count-vector R-trees.

A document is its set of word shingles. Shingles are hashed into GROUPS groups; the
group counts are the set's point. The overlap of two sets is at most the sum of their
coordinate minima, and that of any sets below two tree nodes at most the sum of minima
of the nodes' upper corners. Pairs of points that pass are verified on the shingles.

One tree over all points prunes little once counts are spread evenly over groups (every
corner reaches every query), so sets are routed to a forest first: sets whose symmetric
difference is at most r agree exactly on one of r+1 bands of groups (pigeonhole) and
meet in that band's cell. Sets of a cell whose points pass the bound lie in one tree;
a cell returns a spanning forest of such pairs. Bands that are empty for a document say
nothing; spare bands make up for them, and documents with too many meet on the empty
ones too. Long sets fill all groups alike, which loosens the bound; so trees beyond a
chunk are parted anew by points of FINE groups. So no link is lost, whatever the data.

Each tree is packed along a Hilbert curve of the points: leaves of NODE points, FANOUT
nodes below a node, each with its upper corner and range of sizes. A tree is joined with
itself from the root down, pairs of nodes at a time. A tree of more than CHUNK points, or
CHUNK_BYTES, is cut into chunks by hash, and every pair of chunks is a task of its own.
A task verifies its pairs itself and returns a row for each of its sets: the number of
links, and the smallest set that its links reach. Every link between different sets is
found and counted once; pairs are never sent. Equal sets are one point with its number
of rows.

Defined results: null, empty and blank texts have no shingles and link with nothing;
a text with fewer than k words has its word sequence as one shingle; rows with a null
doc_id link like others, but have a null component; rows that repeat a doc_id are
returned each; an empty table gives no rows; further columns are ignored; texts are
never cut. Sets are told apart by 64-bit hashes of shingles and of sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import RollingHash, bounded, erased, joined_bytes, lower_bytes, mix64, shielded, slices, text_or_empty, word_spans, written
from .neighbours import hilbert_keys

GROUPS, NODE, FANOUT, CHUNK, CELL_CHUNK = 128, 16, 8, 2048, 16_384
FINE, FINE_CHUNK = 2048, 500  # groups of the points that part large trees, and points of a chunk
CHUNK_BYTES, BUCKET_BYTES = 8 << 20, 8 << 20


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and where each text's begin."""
    data, at = joined_bytes(texts, " ")
    low = lower_bytes(data)
    start, end = word_spans(low)
    n = len(at) - 1
    first = np.searchsorted(start, at)
    words = np.diff(first)
    h = RollingHash(low).of(start, end)
    row = np.repeat(np.arange(n), words)
    roll = lambda j, m: h[j : len(h) - m + 1 + j] * np.uint64(2 * j * j + 6 * j + 3)
    if len(h) >= k:
        sh = mix64(sum((mix64(roll(j, k)) for j in range(k)), np.uint64(k)))
        own = row[: len(sh)]
        keep = own == row[k - 1 :]
        sh, own = sh[keep], own[keep]
    else:
        sh, own = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((words > 0) & (words < k))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            there = words[short] > j
            extra[there] = mix64(extra[there] * np.uint64(31) + h[first[short[there]] + j])
        extra = mix64(extra + words[short].astype(np.uint64))
        sh, own = np.concatenate((sh, extra)), np.concatenate((own, short))
        order = np.argsort(own, kind="stable")
        sh, own = sh[order], own[order]
    begin = np.searchsorted(own, np.arange(n + 1))
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
        sh[a:b].sort()
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (own[1:] != own[:-1])
    sh, own = sh[new], own[new]
    return sh, np.searchsorted(own, np.arange(n + 1))


def _per_set(sh: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set (0: empty)."""
    n = np.diff(begin)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(sh + np.uint64(17)))))
    sig = mix64((sums[begin[1:]] - sums[begin[:-1]]) * np.uint64(0x9E3779B97F4A7C15) + n.astype(np.uint64))
    return np.where(n == 0, np.uint64(0), np.where(sig == 0, np.uint64(1), sig))


def _counts(sh: np.ndarray, begin: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """The points of sets: how many shingles lie in each group (a power of two of them)."""
    n = len(begin) - 1
    row = np.repeat(np.arange(n), np.diff(begin))
    return np.bincount(row * groups + (sh >> np.uint64(65 - groups.bit_length())).astype(np.int64), minlength=n * groups).reshape(n, groups)


def _points(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sh, begin = shingle_sets(text_or_empty(batch.column("text")), k)
            points = _counts(sh, begin).astype("<i4")
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.diff(begin)), pa.array(_per_set(sh, begin).view(np.int64)), pa.array([x.tobytes() for x in points], pa.binary())], names=["doc_id", "n", "sig", "point"])

    return run


@lru_cache(8)
def size_classes(num: int, den: int, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower ends of size classes up to size top, and for pairs whose smaller set is in
    the class: the largest symmetric difference r and the number of bands. A set can
    only link with sets of its own class and the classes beside it."""
    ends = [1]
    while ends[-1] <= top:
        ends.append(max(ends[-1] + 1, (ends[-1] - 1) * den // num + 1))
    low = np.array(ends, np.int64)
    high = np.append(low[1:] - 1, low[-1])
    r = (high + high * den // num) * (den - num) // (den + num)
    bands = np.where(r == 0, 1, r + 1 + 2 + (r + 1) // 16)
    return low, r, bands


def band_keys(sh: np.ndarray, begin: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of all bands under which sets have to meet."""
    n = np.diff(begin)
    if not len(sh):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low, r, bands = size_classes(num, den, 1 << max(4, int(n.max()).bit_length()))
    own = np.searchsorted(low, n, "right") - 1
    place, value = mix64(sh ^ np.uint64(0x5851F42D4C957F2D)), mix64(sh + np.uint64(99))
    keys, rows = [], []
    for down in (0, 1):
        c = own - down
        ok = (n > 0) & (c >= 0)
        if down:  # only where the class below holds sets large enough
            ok &= (low[own] - 1) * den >= n * num
        sets = np.flatnonzero(ok)
        if not len(sets):
            continue
        m = np.where(ok, bands[np.maximum(c, 0)], 0)
        base = np.cumsum(m) - m
        size = n[sets]
        at = np.repeat(begin[sets] - np.cumsum(size) + size, size) + np.arange(size.sum())
        row = np.repeat(sets, size)
        idx = base[row] + (place[at] % m[row].astype(np.uint64)).astype(np.int64)
        total = int(m.sum())
        acc = np.zeros(total, np.uint64)
        np.add.at(acc, idx, value[at])
        count = np.bincount(idx, minlength=total)
        band_row = np.repeat(np.arange(len(n)), m)
        band = np.arange(total) - base[band_row]
        empty = np.bincount(band_row, count == 0, len(n))
        crowded = empty >= m - r[np.maximum(c, 0)]
        keep = (count > 0) | crowded[band_row]
        name = mix64(c[band_row].astype(np.uint64) * np.uint64(1 << 32) + band.astype(np.uint64))
        keys.append(mix64(acc + name)[keep])
        rows.append(band_row[keep])
    return np.concatenate(keys or [np.zeros(0, np.uint64)]), np.concatenate(rows or [np.zeros(0, np.int64)])


def _bands(k: int, num: int, den: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sh, begin = shingle_sets(text_or_empty(batch.column("text")), k)
            sig = _per_set(sh, begin)
            _, one = np.unique(sig, return_index=True)  # equal sets of a batch speak once
            once = np.zeros(len(sig), bool)
            once[one] = True
            keep = np.repeat(once, np.diff(begin))
            size = np.where(once, np.diff(begin), 0)
            keys, rows = band_keys(sh[keep], np.concatenate(([0], np.cumsum(size))), num, den)
            bucket = (keys % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            pairs = np.stack([keys[order], sig[rows[order]]], 1)
            there, cut = np.unique(bucket[order], return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array([x.tobytes() for x in np.split(pairs, cut[1:])] if len(there) else [], pa.binary())], names=["bucket", "pairs"])

    return run


def _twins(keys: np.ndarray) -> np.ndarray:
    """Marks sorted keys that occur more than once."""
    twin = keys[1:] == keys[:-1]
    found = np.zeros(len(keys), bool)
    found[1:] = twin
    found[:-1] |= twin
    return found


def _collisions(t: pa.Table) -> pa.Table:
    pairs = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64).reshape(-1, 2) for x in t["pairs"].combine_chunks()])
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    pairs = np.unique(pairs[_twins(pairs[:, 0])], axis=0)
    pairs = pairs[_twins(pairs[:, 0])]
    return pa.table({"key": pa.array(np.ascontiguousarray(pairs[:, 0]).view(np.int64)), "sig": pa.array(np.ascontiguousarray(pairs[:, 1]).view(np.int64))})


def _levels(points: np.ndarray, n: np.ndarray, side: np.ndarray) -> list[dict]:
    """Levels of a packed tree, leaves first: corners, least and most sizes, sides below.
    The points are in packing order."""
    levels = [{"corner": points, "least": n, "most": n, "lo": side, "hi": side}]
    width = NODE
    while len(levels) == 1 or len(levels[-1]["least"]) > FANOUT:
        below = levels[-1]
        cut = np.arange(0, len(below["least"]), width)
        up = lambda f, c: f.reduceat(below[c], cut, axis=0)  # noqa: E731, B023
        levels.append({"corner": up(np.maximum, "corner"), "least": up(np.minimum, "least"), "most": up(np.maximum, "most"), "lo": up(np.minimum, "lo"), "hi": up(np.maximum, "hi")})
        width = FANOUT
    return levels


def _reach(level: dict, a: np.ndarray, b: np.ndarray, num: int, den: int, across: bool) -> np.ndarray:
    """Whether sets below nodes a and b may link: by sizes, then by the overlap that the corners allow."""
    ok = (level["least"][a] * num <= level["most"][b] * den) & (level["least"][b] * num <= level["most"][a] * den)
    if across:
        ok &= (level["lo"][a] != level["hi"][b]) | (level["hi"][a] != level["lo"][b])
    at = np.flatnonzero(ok)
    block = max(1, (1 << 22) // level["corner"].shape[1])
    for k in range(0, len(at), block):
        x, y = a[at[k : k + block]], b[at[k : k + block]]
        most = np.minimum(level["corner"][x], level["corner"][y]).sum(1)
        ok[at[k : k + block]] = most * (den + num) >= num * (level["least"][x] + level["least"][y])
    return ok


def _order(points: np.ndarray) -> np.ndarray:
    """Packing order: a Hilbert curve of four coordinates, each the sum of a quarter of the groups."""
    four = points.reshape(len(points), 4, -1).sum(2)
    return np.argsort(hilbert_keys(four * 1023 // max(1, int(four.max())), 10), kind="stable")


def tree_pairs(points: np.ndarray, n: np.ndarray, side: np.ndarray, num: int, den: int):
    """Blocks of pairs (i, j) of different points that pass all bounds, each pair once. Of
    points of two sides only pairs of both."""
    order = _order(points)
    order = order[np.argsort(side[order], kind="stable")]
    across = side.min() != side.max()
    levels = _levels(points[order], n[order], side[order])
    top = np.arange(len(levels[-1]["least"]))
    a, b = np.triu_indices(len(top))
    work = [(len(levels) - 1, a, b)]
    while work:
        k, a, b = work.pop()
        ok = _reach(levels[k], a, b, num, den, across)
        a, b = a[ok], b[ok]
        if not k:
            if len(a):
                yield order[a], order[b]
            continue
        width, below = (NODE if k == 1 else FANOUT), len(levels[k - 1]["least"])
        step = np.arange(width)
        for c in range(0, len(a), 2000):
            x = (a[c : c + 2000, None, None] * width + step[:, None]).repeat(width, 2).ravel()
            y = (b[c : c + 2000, None, None] * width + step).repeat(width, 1).ravel()
            keep = (x < below) & (y < below) & ((x < y) if k == 1 else (x <= y))
            work.append((k - 1, x[keep], y[keep]))


def _all_pairs(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs inside runs of rows; runs are short."""
    own = np.repeat(first + size, size) - 1
    i = np.arange(len(own)) + np.repeat(first - np.cumsum(size) + size, size)
    count = own - i
    return np.repeat(i, count), np.repeat(i + 1 - np.cumsum(count) + count, count) + np.arange(count.sum())


def _overlaps(code: np.ndarray, begin: np.ndarray, i: np.ndarray, j: np.ndarray, width: int) -> np.ndarray:
    """Sizes of the intersections of the sets i and j, for pairs sorted by i."""
    mark, out = np.zeros(width, bool), np.zeros(len(i), np.int64)
    cut = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1], [True])))
    size = np.diff(begin)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        own = code[begin[i[a]] : begin[i[a] + 1]]
        mark[own] = True
        for k in range(a, b, 4096):
            other = j[k : min(k + 4096, b)]
            m = size[other]
            start = np.cumsum(m) - m
            at = np.repeat(begin[other] - start, m) + np.arange(int(m.sum()))
            out[k : k + len(other)] = np.add.reduceat(mark[code[at]].view(np.int8), start, dtype=np.int64)
        mark[own] = False
    return out


def _smallest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each member's component."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _unique(t: pa.Table, by: str) -> pa.Table:
    """Rows in the order of (by, sig), each once."""
    t = t.sort_by([(by, "ascending"), ("sig", "ascending")])
    sig, own = t["sig"].to_numpy(), t[by].to_numpy()
    once = np.ones(len(sig), bool)
    once[1:] = (sig[1:] != sig[:-1]) | (own[1:] != own[:-1])
    return t.filter(pa.array(once))


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), -1)


def _forest(flat: dict, first: int, size: int, num: int, den: int):
    """Edges (i, j) that span the components, under the bound, of one run of points: each
    point looks once at those not reached yet, so near copies take one look."""
    left, work = np.arange(first, first + size), []
    while len(left) or work:
        if not work:
            work, left = [left[0]], left[1:]
        i = work.pop()
        near = _reach(flat, np.full(len(left), i), left, num, den, False)
        found, left = left[near], left[~near]
        yield np.full(len(found), i), found
        work += found.tolist()
        if not len(left):
            return


def _cell_forest(num: int, den: int):
    """Of one task's cells: (a, b) rows that join the sets whose points pass the bound."""

    def run(t: pa.Table) -> pa.Table:
        t = _unique(t, "cell")
        sig, cell, n = (t[c].to_numpy() for c in ("sig", "cell", "n"))
        points = _vectors(t["point"])
        flat = {"corner": points, "least": n, "most": n}
        first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        size = np.diff(np.append(first, len(cell)))
        small = size <= NODE
        edges = []
        for k in range(0, int(small.sum()), 4000):
            i, j = _all_pairs(first[small][k : k + 4000], size[small][k : k + 4000])
            ok = _reach(flat, i, j, num, den, False)
            edges.append((i[ok], j[ok]))
        for a, m in zip(first[~small].tolist(), size[~small].tolist()):
            edges += _forest(flat, a, m, num, den)
        return _joined(sig, edges)

    return run


def _joined(sig: np.ndarray, edges: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """A row for each set that the edges (of places) join to a smaller one."""
    names, own = np.unique(sig, return_inverse=True)
    i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (list(zip(*edges)) or [(), ()]))
    label = _smallest(len(names), own[i], own[j])
    moved = np.flatnonzero(label != np.arange(len(names)))
    return pa.table({"a": pa.array(names[label[moved]], pa.int64()), "b": pa.array(names[moved], pa.int64())})


def _fine_forest(num: int, den: int):
    """Of two chunks of a large tree: rows that join the sets whose fine points pass the bound."""

    def run(t: pa.Table) -> pa.Table:
        t = _unique(t, "tree")
        n, points = t["n"].to_numpy(), _vectors(t["point"])
        return _joined(t["sig"].to_numpy(), list(_forest({"corner": points, "least": n, "most": n}, 0, len(n), num, den)))

    return run


def _across(num: int, den: int):
    """Of two chunks of a large cell: rows that join sets of different trees."""

    def run(t: pa.Table) -> pa.Table:
        t = _unique(t, "cell")
        sig, n, side, tree = (t[c].to_numpy() for c in ("sig", "n", "side", "tree"))
        edges = []
        for i, j in tree_pairs(_vectors(t["point"]), n, side, num, den):
            differ = tree[i] != tree[j]
            edges.append((i[differ], j[differ]))
        return _joined(sig, edges)

    return run


def _search(num: int, den: int):
    """Of one task's trees: links of each set (in rows, its own copies left out) and the
    smallest set that its links here reach."""

    def run(t: pa.Table) -> pa.Table:
        t = _unique(t, "tree")
        sig, tree, side, copies = (t[c].to_numpy() for c in ("sig", "tree", "side", "copies"))
        raw = t["shingles"].combine_chunks()
        n = pc.binary_length(raw).to_numpy().astype(np.int64) // 8
        sh = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in raw])
        begin = np.append(0, np.cumsum(n))
        points = _counts(sh, begin)
        names, code = np.unique(sh, return_inverse=True)
        links, edges = np.zeros(len(n), np.int64), []

        def joined(i, j):
            if not len(i):
                return
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            shared = _overlaps(code, begin, i, j, len(names))
            ok = den * shared >= num * (n[i] + n[j] - shared)
            i, j = i[ok], j[ok]
            links[:] += (np.bincount(i, copies[j], len(n)) + np.bincount(j, copies[i], len(n))).astype(np.int64)
            # what joins these sets is enough of the pairs
            new = _smallest(len(n), i, j)
            moved = np.flatnonzero(new != np.arange(len(n)))
            edges.append((new[moved], moved))

        first = np.flatnonzero(np.concatenate(([True], tree[1:] != tree[:-1])))
        size = np.diff(np.append(first, len(tree)))
        small = size <= NODE
        if small.any():
            flat = {"corner": points, "least": n, "most": n, "lo": side, "hi": side}
            for k in range(0, int(small.sum()), 4000):
                i, j = _all_pairs(first[small][k : k + 4000], size[small][k : k + 4000])
                ok = _reach(flat, i, j, num, den, False)
                ok &= (side[i] != side[j]) if side.min() != side.max() else True
                joined(i[ok], j[ok])
        for a, m in zip(first[~small].tolist(), size[~small].tolist()):
            for i, j in tree_pairs(points[a : a + m], n[a : a + m], side[a : a + m], num, den):
                joined(i + a, j + a)
        label = _smallest(len(n), *(np.concatenate(x) for x in zip(*edges))) if edges else np.arange(len(n))
        return pa.table({"sig": pa.array(sig), "root": pa.array(sig[label]), "links": pa.array(links), "whole": t["whole"]})

    return run


BITS = 1 << 26


def _places(ids: pa.Array) -> np.ndarray:
    """The bit of each doc_id; null counts as 0."""
    known = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return (mix64(known.view(np.uint64)) % np.uint64(BITS)).astype(np.int64)


def _has(bits: np.ndarray, ids: pa.Array) -> np.ndarray:
    at = _places(ids)
    return ((bits[at >> 3] >> (at & 7)) & 1).astype(bool)


def _sets(k: int, packed, groups: int | None = None):
    """The sets (or their points) of the documents whose bit is set (and of few others)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = packed.value
        for batch in slices(batches):
            there = np.flatnonzero(_has(bits, batch.column("doc_id")))
            if not len(there):
                continue
            sh, begin = shingle_sets(text_or_empty(batch.column("text").take(pa.array(there))), k)
            rows = [x.tobytes() for x in _counts(sh, begin, groups).astype("<i4")] if groups else [sh[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(_per_set(sh, begin).view(np.int64)), pa.array(rows, pa.binary())], names=["sig", "point" if groups else "shingles"])

    return run


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = _places(batch.column("doc_id"))
        yield pa.RecordBatch.from_arrays([pa.array((at >> 5).astype(np.int32)), pa.array(np.int64(1) << (at & 31))], names=["word", "bits"])


def marked(ids: DataFrame) -> np.ndarray:
    """A bitmap of BITS bits (8 MB, whatever the number of ids) of hashed doc_ids."""
    out = np.zeros(BITS >> 5, "<u4")
    words = ids.mapInArrow(_marks, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    for batch in words.toArrow().to_batches():  # as many rows as the map has words, at most
        out[batch.column("word").to_numpy()] = batch.column("bits").to_numpy().astype(np.uint32)
    return out.view(np.uint8)


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (id, comp): the smallest id of each connected component. Every
    round hooks ids on their smallest neighbour, shortens the chains and contracts."""
    e = written(edges.select("a", "b").where("a <> b").distinct(), "cc_edges")
    label = None
    while e.limit(1).count():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        p = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("p")).select("id", F.least("id", "p").alias("p")), "cc_parent")
        while True:
            q = p.select(F.col("id").alias("p"), F.col("p").alias("pp"))
            p2 = written(p.join(q, "p").select("id", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "cc_parent")
            p = p2.select("id", "p")
            if not p2.where("moved").limit(1).count():
                break
        if label is None:
            label = p.select("id", F.col("p").alias("comp"))
        else:
            label = label.join(p.select(F.col("id").alias("comp"), "p"), "comp", "left").select("id", F.coalesce("p", "comp").alias("comp"))
        label = written(label, "cc_label")
        pa_, pb = p.select(F.col("id").alias("a"), F.col("p").alias("x")), p.select(F.col("id").alias("b"), F.col("p").alias("y"))
        e = written(e.join(pa_, "a").join(pb, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc_edges")
    return label if label is not None else edges.select(F.col("a").alias("id"), F.col("b").alias("comp")).limit(0)


def _parts(volume: float) -> int:
    """Buckets of about BUCKET_BYTES."""
    return max(1, -(-int(volume) // BUCKET_BYTES))


def routed(cells: DataFrame, points: DataFrame, num: int, den: int) -> DataFrame:
    """(id, comp): the tree of each set that may link with another of its cell. A cell of
    more than CELL_CHUNK sets is cut by hash; each chunk holds the cell's first set too, so
    what is close to that meets at once, and pairs of chunks are searched only for cells
    that still hold several trees."""
    dealt = cells.join(points, "sig")
    many = _parts(cells.count() * (4 * GROUPS + 16))
    whole, every = F.col("parts") == 1, F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    chunk = F.pmod(F.xxhash64("sig"), F.col("parts"))
    copies = F.when(whole, F.array(F.lit(-1).cast("long"))).when(F.col("sig") == F.col("a"), every).otherwise(F.array(chunk))
    dealt = dealt.withColumn("chunk", F.explode(copies)).withColumn("key", F.when(whole, F.pmod(F.xxhash64("cell"), F.lit(many))).otherwise(F.col("cell")))
    edges = dealt.select("key", "chunk", "cell", "sig", "n", "point").groupBy("key", "chunk").applyInArrow(_cell_forest(num, den), "a long, b long")
    edges = written(edges, "jac_forest")
    trees = components(edges)
    large = cells.where("parts > 1")
    if not large.limit(1).count():
        return trees
    named = large.join(trees.withColumnRenamed("id", "sig"), "sig", "left").withColumn("tree", F.coalesce("comp", "sig"))
    open_ = named.groupBy("cell").agg(F.min("tree").alias("lo"), F.max("tree").alias("hi")).where("lo <> hi").select("cell")
    cut = named.join(open_, "cell").withColumn("side", chunk).withColumn("other", F.explode(every)).join(points, "sig")
    cut = cut.withColumn("x", F.least("side", "other")).withColumn("y", F.greatest("side", "other"))
    more = cut.select("cell", "x", "y", "side", "tree", "sig", "n", "point").groupBy("cell", "x", "y").applyInArrow(_across(num, den), "a long, b long")
    return components(edges.unionByName(more))


def parted(rows: DataFrame, met: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """met with the trees that points of FINE groups leave; sets that are alone then go."""
    bits = rows.sparkSession.sparkContext.broadcast(marked(met.select("doc_id")))
    fine = rows.mapInArrow(_sets(k, bits, FINE), "sig long, point binary")
    size = met.groupBy("tree").agg(F.ceil(F.count("*") / FINE_CHUNK).alias("parts"))
    cut = met.join(size, "tree").select("tree", "sig", "n", F.pmod(F.xxhash64("sig"), F.col("parts")).alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    cut = cut.withColumn("x", F.least("side", "other")).withColumn("y", F.greatest("side", "other")).join(fine, "sig")
    edges = cut.select("tree", "x", "y", "sig", "n", "point").groupBy("tree", "x", "y").applyInArrow(_fine_forest(num, den), "a long, b long")
    return met.drop("tree").join(components(edges).withColumnRenamed("id", "sig").withColumnRenamed("comp", "tree"), "sig").select(*met.columns)


def linked(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, sig) of each row, and of each set that others may link with: sig, root
    (the set that names its component) and links (rows of other sets)."""
    spark = docs.sparkSession
    rows = bounded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    points = written(rows.mapInArrow(_points(k), "doc_id long, n long, sig long, point binary"), "jac_points")
    of_rows = points.agg(F.sum("n").alias("n"), F.count("*").alias("rows")).first()
    # a set sends about r + 3 bands to its own size class, as many to the one below, 16 bytes each
    volume = 16 * ((of_rows["n"] or 0) * 4.5 * (den - num) / (den + num) + 6 * of_rows["rows"])
    cells = rows.mapInArrow(_bands(k, num, den, _parts(volume)), "bucket int, pairs binary").groupBy("bucket").applyInArrow(_collisions, "key long, sig long")
    all_cells = written(cells, "jac_cells")
    # close texts meet in many bands: of cells with the same sets one is enough
    same = all_cells.groupBy("key").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("sig")).alias("x"), F.bit_xor(F.xxhash64("sig", F.lit(1))).alias("y"), F.min("sig").alias("a"))
    lead = same.groupBy("c", "x", "y").agg(F.min(F.struct("key", "a")).alias("one")).select("one.key", "one.a", F.ceil(F.col("c") / CELL_CHUNK).alias("parts"))
    cells = written(all_cells.join(lead, "key").select(F.col("key").alias("cell"), "sig", "a", "parts"), "jac_distinct_cells")
    erased(all_cells)
    known = points.where("n > 0").groupBy("sig").agg(F.min(F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)).alias("doc_id"))).getField("doc_id").alias("doc_id"), F.first("n").alias("n"), F.count("*").alias("copies"), F.first("point").alias("point"))
    known = written(known.join(cells.select("sig").distinct(), "sig"), "jac_met")
    trees = routed(cells, known.select("sig", "n", "point"), num, den)
    met = trees.withColumnRenamed("id", "sig").withColumnRenamed("comp", "tree").join(known.drop("point"), "sig")
    met = written(met, "jac_in_trees")
    parts = lambda: F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("n") * 8 / CHUNK_BYTES)).alias("parts")
    large = met.groupBy("tree").agg(parts()).where("parts > 1").select("tree")
    if large.limit(1).count():
        anew = parted(rows, met.join(large, "tree"), k, num, den)
        met = written(met.join(large, "tree", "left_anti").unionByName(anew), "jac_in_trees")
    # one document for each set; a second one for a set, or a set too many, does no harm
    bits = spark.sparkContext.broadcast(marked(met.select("doc_id")))
    sets = rows.mapInArrow(_sets(k, bits), "sig long, shingles binary")
    size = met.groupBy("tree").agg(parts())
    many = _parts(8 * (met.agg(F.sum("n").alias("n")).first()["n"] or 0))
    met = met.join(size, "tree")
    # small trees share a task; a chunk of a large one meets each chunk of it once
    whole = F.col("parts") == 1
    chunk = F.pmod(F.xxhash64("sig"), F.col("parts"))
    dealt = met.join(sets, "sig").withColumn("whole", whole).withColumn("side", chunk).withColumn("other", F.explode(F.when(whole, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))))
    dealt = dealt.withColumn("x", F.when(whole, -1).otherwise(F.least("side", "other"))).withColumn("y", F.greatest("side", "other"))
    dealt = dealt.withColumn("key", F.when(whole, F.pmod(F.xxhash64("tree"), F.lit(many))).otherwise(F.col("tree")))
    found = dealt.select("key", "x", "y", "side", "tree", "sig", "copies", "whole", "shingles").groupBy("key", "x", "y").applyInArrow(_search(num, den), "sig long, root long, links long, whole boolean")
    found = written(found, "jac_found")
    large = found.where("NOT whole")
    roots = components(large.select(F.col("sig").alias("a"), F.col("root").alias("b"))).withColumnRenamed("comp", "over")
    links = large.groupBy("sig").agg(F.sum("links").alias("links")).join(roots.withColumnRenamed("id", "sig"), "sig", "left").select("sig", F.coalesce("over", "sig").alias("root"), "links")
    return points, written(found.where("whole").select("sig", "root", "links").unionByName(links), "jac_sets")


def join_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that
    links reach) and n_links (other rows that it links with, copies included); two
    documents link when den * intersection >= num * union."""
    points, sets = linked(docs, k, num, den)
    by_set = points.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")).join(sets, "sig", "left")
    named = by_set.where("copies > 1 OR root IS NOT NULL").withColumn("root", F.coalesce("root", "sig"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    named = written(named.join(least, "root").select("sig", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")), "jac_named")
    out = points.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("sig")).alias("sig")).join(named, "sig", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def _named_rows(k: int, packed):
    """Appends the name of the set of each row whose doc_id has its bit set, else null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            there = _has(packed.value, batch.column("__id"))
            names = np.zeros(batch.num_rows, np.int64)
            if there.any():
                sh, begin = shingle_sets(text_or_empty(batch.column("text").filter(pa.array(there))), k)
                names[there] = _per_set(sh, begin).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, mask=~there)], names=[*batch.schema.names, "__sig"])

    return run


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id (a null one comes
    last), then of the smallest set name, then of the smallest text. Rows without shingles
    all stay. Texts are not dealt out but for rows whose doc_id has its bit set in a bitmap
    of the ids concerned."""
    points, sets = linked(docs, k, num, den)
    keyed = points.where("n > 0").groupBy("doc_id", "sig").agg(F.count("*").alias("rows")).join(sets.select("sig", "root"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("best_id"), F.col("sig").alias("best_sig"))
    best = keyed.groupBy("root").agg(F.min(order).alias("best"), F.sum("rows").alias("rows_of_root")).where("rows_of_root > 1")
    told = keyed.join(best, "root").select("doc_id", "sig", (F.col("doc_id").eqNullSafe(F.col("best.best_id")) & (F.col("sig") == F.col("best.best_sig"))).alias("stays"), "rows").where("NOT stays OR rows > 1")
    told = written(told.select(F.col("doc_id").alias("__id"), F.col("sig").alias("__sig"), "stays"), "jac_told")
    inner, restored = shielded(docs)
    packed = docs.sparkSession.sparkContext.broadcast(marked(told.select(F.col("__id").alias("doc_id"))))
    d = inner.withColumn("__id", F.col("doc_id").cast("long"))
    d = bounded(d).mapInArrow(_named_rows(k, packed), StructType([*d.schema.fields, StructField("__sig", LongType())]))
    names = [F.col(f"`{c}`") for c in inner.columns]
    some = d.where("__sig IS NOT NULL")
    free = some.join(told, some["__id"].eqNullSafe(told["__id"]) & (some["__sig"] == told["__sig"]), "left_anti").select(*names)
    again = told.where("stays").select(F.col("__id").alias("__own"), F.col("__sig").alias("__set"))
    kept = some.join(again, F.col("__id").eqNullSafe(F.col("__own")) & (F.col("__sig") == F.col("__set")), "left_semi")
    kept = kept.groupBy("__id", "__sig").agg(F.min_by(F.struct(*names), F.coalesce("text", F.lit(""))).alias("__row")).select("__row.*")
    return restored(d.where("__sig IS NULL").select(*names).unionAll(free).unionAll(kept))
