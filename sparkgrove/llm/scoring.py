"""Language-model scores by online logistic context mixing.

The text is its token sequence: words in lower case (A-Z), then one end. It is coded word
by word, a word as the bits of a code tree, by a mixer of hashed contexts that run across
words (coder.py): slots count the running text of all training documents, the weights are
chosen by gates and trained online, an adaptive probability map refines each bit, and every
text goes on teaching its own copy of weights and map while it is read. The score is the
sum of what the mixer gives all bits, plus the spelling of the rare words.

The tree's symbols are the HEAD most frequent training words, the end and one symbol for
all rarer words. Which rare word it is, is a second step: a known one keeps (count - D) / N
of the rare training tokens; the mass so saved goes to the byte model, which spells any
word, less the share it would give the frequent ones. All next tokens sum to 1.

The byte model codes a word's bytes and its closing blank bit by bit. Predictors are
hashed contexts: none, the last 1, 2, 3 and 4 bytes, and the word so far. Each slot
counts zeros and ones over all distinct training words. Their stretched probabilities
are summed with weights chosen by gates (the longest context seen before, and each
predictor's own confidence), trained online; an adaptive probability map indexed by
the last byte refines the result.

Counts cover all training documents and are gathered by a shuffle; the head of the
vocabulary goes to every task, the rest meets its documents in a join. The hashed tables
grow with the training tokens up to 2^22 slots a context (2^20 in the byte model), then
slots are shared. One training document of HELD_BACK (by hash) teaches the first weights
and map, on tables without it, and then joins the tables; likewise for words and the byte
model. Both are fitted on all that is held back: online passes over parts, whose cells are
averaged by how often each was used.

Defined results: null text is the empty text, whose only token is the end; rows that
repeat a doc_id are scored each; a null doc_id is held out if crc32 of '' says so;
with no training documents counts are 0, and the byte model and the tree give every bit
1/2 at first; an empty table gives no rows; further columns are ignored; texts are never cut.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import coder
from .common import lower_words, mix64, n_tasks, picked, slices, text_or_empty, written

ORDERS, LOG_SLOTS, HEAD, MIX_WORDS, DISCOUNT = 6, 20, 1 << 18, 30_000, 0.75
TOP, MARKERS, BACKOFF = 1 << 15, 32, 300.0
SPELLED = 60_000  # words whose like beginnings are found at once
FIT_BYTES, TABLE_TOKENS = 4 << 20, 8_000_000  # text of a part of the fit; tokens of a task that counts
HELD_BACK = 16  # one of so many words or documents (by hash) teaches the mixer and the map, not the slots it learns from
GATES = (1, 2, 4, 8, 32)  # confidence classes: counts below
APM_STEPS = 33


def spelled(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all words with their closing blank, each word's start, and the context
    hashes (ORDERS, symbols)."""
    both = pc.binary_join_element_wise(words.cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    _, offsets, data = both.buffers()
    at = np.frombuffer(offsets, np.int64)[both.offset : both.offset + len(both) + 1]
    sym = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    size = np.diff(at)
    pos = np.arange(len(sym)) - np.repeat(at[:-1], size)
    ctx = np.zeros((ORDERS, len(sym)), np.uint64)
    tail = np.zeros(len(sym), np.uint64)
    for k in range(1, 5):
        there = pos >= k
        prev = np.zeros(len(sym), np.uint64)
        prev[k:] = sym[:-k]
        tail = tail * np.uint64(257) + np.where(there, prev + np.uint64(1), np.uint64(0))
        ctx[k] = mix64(tail + np.uint64(k << 60))
    # the word so far: a running hash, restarted at each word
    run = np.zeros(len(sym), np.uint64)
    starts, left = at[:-1], size
    for p in range(1, int(size.max()) if len(size) else 0):
        starts, left = starts[left > p], left[left > p]
        mine = starts + p if p < 40 else None
        if mine is None:
            rest = np.flatnonzero(pos >= p)  # few words are so long; one by one
            for i in rest.tolist():
                run[i] = (int(run[i - 1]) * 0x100000001B3 + int(sym[i - 1]) + 1) & 0xFFFFFFFFFFFFFFFF
            break
        run[mine] = run[mine - 1] * np.uint64(0x100000001B3) + sym[mine - 1] + np.uint64(1)
    ctx[5] = mix64(run ^ np.uint64(0xABCDEF))
    ctx[0] = mix64(np.zeros(1, np.uint64))[0]
    return sym, at, ctx


def slots(ctx: np.ndarray, node: np.ndarray) -> np.ndarray:
    return ((ctx + node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20) & np.uint64((1 << LOG_SLOTS) - 1)).astype(np.int64)


def distinct(sym: np.ndarray, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words that begin alike share symbols and their contexts: one place of each different
    symbol and word so far, how many there are of it, and which of them every symbol is."""
    key = ctx[5] + sym
    order = np.argsort(key)
    new = np.ones(len(key), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    begin = np.flatnonzero(new)
    which = np.empty(len(key), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[begin], np.diff(begin, append=len(key)), which


def count_words(words: pa.Array, counts: np.ndarray) -> None:
    """Adds the bits of words to counts (ORDERS, 2, slots)."""
    sym, _, ctx = spelled(words)
    some, times, _ = distinct(sym, ctx)
    sym, ctx, times = sym[some].astype(np.uint16), ctx[:, some], times.astype(np.float32)
    for b in range(8):
        node = (np.uint16(1) << np.uint16(b)) | (sym >> np.uint16(8 - b))
        bit = (sym >> np.uint16(7 - b) & np.uint16(1)).astype(np.int64) << LOG_SLOTS
        for k in range(ORDERS):
            np.add.at(counts[k].reshape(-1), slots(ctx[k], node) + bit, times)


def _sparse_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's words as packed chunks of slots."""
    counts, seen = np.zeros((ORDERS, 2, 1 << LOG_SLOTS), np.float32), 0
    held: list[pa.Array] = []

    def counted():
        nonlocal seen
        if held:
            count_words(pa.concat_arrays(held), counts)
            seen += 1
            held.clear()

    for batch in batches:
        held.append(batch.column("word"))
        if sum(map(len, held)) >= SPELLED:
            counted()
    counted()
    if seen:
        chunks = counts.reshape(-1, 1 << 14)
        there = np.flatnonzero(chunks.any(1))
        for part in np.array_split(there, max(1, len(there) // 64)):
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array([_thin(chunks[i]) for i in part], pa.binary())], names=["chunk", "counts"])


def _thin(x: np.ndarray) -> bytes:
    i = np.flatnonzero(x)
    return np.array([len(i)], "<i4").tobytes() + i.astype("<u2").tobytes() + x[i].astype("<f4").tobytes()


def _thick(raw: bytes) -> np.ndarray:
    n, out = int(np.frombuffer(raw, "<i4", 1)[0]), np.zeros(1 << 14, np.float32)
    out[np.frombuffer(raw, "<u2", n, 4)] = np.frombuffer(raw, "<f4", n, 4 + 2 * n)
    return out


def _summed(t: pa.Table) -> pa.Table:
    total = np.zeros(1 << 14, np.float64)
    for x in t["counts"].to_pylist():
        total += _thick(x)
    return pa.table({"chunk": t["chunk"].slice(0, 1), "counts": pa.array([_thin(total.astype(np.float32))], pa.binary())})


class Mixer:
    """The byte model: stretched slot probabilities, gated weights, probability map."""

    def __init__(self, counts: np.ndarray):
        n0, n1 = counts[:, 0], counts[:, 1]
        self.stretch = np.clip(np.log((n1 + 0.4) / (n0 + 0.4)) * 2048, -32767, 32767).astype(np.int16)
        self.sure = np.digitize(n0 + n1, GATES).astype(np.uint8)
        self.weights = np.full((ORDERS, ORDERS, len(GATES) + 1), 0.3, np.float32)
        self.weights[:, :, 0] = 0
        grid = np.linspace(-8, 8, APM_STEPS)
        self.map = np.tile(1 / (1 + np.exp(-grid)), (256, 1)).astype(np.float32)
        self.uses = np.zeros(self.weights.size), np.zeros(self.map.size)

    def _inputs(self, ctx: np.ndarray, node: np.ndarray):
        x, sure = [], []
        gate = np.zeros(len(node), np.int64)
        for k in range(ORDERS):
            at = slots(ctx[k], node)
            x.append(picked(self.stretch[k], at).astype(np.float32))
            x[-1] /= 2048
            sure.append(picked(self.sure[k], at))
            if k:
                gate[sure[k] > 0] = k
        return x, sure, gate

    def _bits(self, sym: np.ndarray, ctx: np.ndarray, last: np.ndarray, rate: float | None):
        """Log2 probability of each symbol; with a rate, the weights and the map learn."""
        total = np.zeros(len(sym))
        weights, flat, row = self.weights.reshape(-1), self.map.reshape(-1), last * APM_STEPS
        for b in range(8):
            node = (np.uint16(1) << np.uint16(b)) | (sym.astype(np.uint16) >> np.uint16(8 - b))
            bit = ((sym >> np.uint8(7 - b)) & np.uint8(1)).astype(np.float32)
            x, sure, gate = self._inputs(ctx, node)
            gate *= ORDERS * (len(GATES) + 1)
            cells = [gate + (sure[k] + np.uint8(k * (len(GATES) + 1))) for k in range(ORDERS)]
            dot = np.zeros(len(sym), np.float32)
            for k in range(ORDERS):
                dot += picked(weights, cells[k]) * x[k]
            np.clip(dot, -7.9, 7.9, out=dot)
            p = 1 / (1 + np.exp(-dot))
            place = (dot + 8) * np.float32((APM_STEPS - 1) / 16)
            lo = place.astype(np.int64)
            part = np.subtract(place, lo, dtype=np.float32)
            lo += row
            refined = picked(flat, lo) * (1 - part) + picked(flat[1:], lo) * part
            final = np.clip(np.float32(0.5) * p + np.float32(0.5) * refined, 1e-6, 1 - 1e-6)
            total += np.log2(np.where(bit > 0, final, 1 - final))
            if rate is not None:
                err = bit - p
                for k in range(ORDERS):
                    step = np.bincount(cells[k], err * x[k], weights.size)
                    n = np.bincount(cells[k], minlength=weights.size)
                    self.uses[0][:] += n
                    weights += (rate * step / np.sqrt(n + 1.0)).astype(np.float32)
                near = row + np.rint(place).astype(np.int64)
                n = np.bincount(near, minlength=self.map.size)
                mean = np.bincount(near, bit, self.map.size) / np.maximum(n, 1)
                self.uses[1][:] += n
                flat += ((n / (n + 30.0)) * (mean - flat) * (n > 0)).astype(np.float32)
        return total

    def fit(self, words: pa.Array) -> None:
        """One online pass, 256 words at a time."""
        for k in range(0, len(words), 256):
            sym, at, ctx = spelled(words.slice(k, 256))
            self._bits(sym, ctx, _last(sym, at), 0.02)

    def log10(self, words: pa.Array) -> np.ndarray:
        out = []
        for k in range(0, len(words), SPELLED):
            sym, at, ctx = spelled(words.slice(k, SPELLED))
            some, _, which = distinct(sym, ctx)
            last, bits = _last(sym, at), np.zeros(len(some))
            for j in range(0, len(some), 1 << 14):
                one = some[j : j + (1 << 14)]
                bits[j : j + (1 << 14)] = self._bits(sym[one], ctx[:, one], last[one], None)
            out.append(np.add.reduceat(bits[which], at[:-1]))
        return np.concatenate(out or [np.zeros(0)]) * np.log10(2)


def _lessons(packed):
    """The weights and the map of a part, and how often each cell was used."""

    def run(t: pa.Table) -> pa.Table:
        mixer = copy.copy(packed.value)
        mixer.weights, mixer.map = mixer.weights.copy(), mixer.map.copy()
        mixer.uses = tuple(np.zeros(len(u)) for u in mixer.uses)
        mixer.fit(t.sort_by([("order", "ascending"), ("word", "ascending")])["word"].combine_chunks())
        uses = np.concatenate(mixer.uses)
        cells = np.concatenate((mixer.weights.ravel(), mixer.map.ravel())).astype(float)
        return pa.table({"lane": pa.array([t["part"][0].as_py() % 16], pa.int32()), "sums": pa.array([np.stack((uses, cells * uses)).tobytes()], pa.binary())})

    return run


def _lane_sums(t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_buffer()) for x in t["sums"].combine_chunks())
    return pa.table({"lane": t["lane"].slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})


def fit_all(mixer: Mixer, words: DataFrame) -> None:
    """Fits the weights and the map on all of words(word); up to MIX_WORDS words in one pass."""
    parts = max(1, -(-words.count() // MIX_WORDS))
    packed = words.sparkSession.sparkContext.broadcast(mixer)
    order = F.xxhash64("word", F.lit(1))
    dealt = words.select("word", order.alias("order"), F.pmod(order, F.lit(parts)).cast("int").alias("part"))
    sums = dealt.groupBy("part").applyInArrow(_lessons(packed), "lane int, sums binary").groupBy("lane").applyInArrow(_lane_sums, "lane int, sums binary")
    got = sums.collect()  # 16 rows of fixed size, at most
    packed.unpersist()
    if got:
        uses, cells = sum(np.frombuffer(bytes(r["sums"])) for r in sorted(got)).reshape(2, -1)
        start = np.concatenate((mixer.weights.ravel(), mixer.map.ravel()))
        cells = np.where(uses > 0, cells / np.maximum(uses, 1), start).astype(np.float32)
        mixer.weights, mixer.map = cells[: mixer.weights.size].reshape(mixer.weights.shape), cells[mixer.weights.size :].reshape(mixer.map.shape)


def _last(sym: np.ndarray, at: np.ndarray) -> np.ndarray:
    last = np.zeros(len(sym), np.int64)
    last[1:] = sym[:-1]
    last[at[:-1]] = 0
    return last


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a task with their training counts, summed before they are sent."""
    held: list[pa.Table] = []

    def summed():
        t = pa.concat_tables(held).combine_chunks()
        coded = t["word"].combine_chunks().dictionary_encode() if t.num_rows else pa.array([], pa.large_string()).dictionary_encode()
        n = np.bincount(coded.indices.to_numpy(), t["n"].to_numpy(), len(coded.dictionary))
        return pa.table({"word": coded.dictionary, "n": n.astype(np.int64)})

    for batch in slices(batches):
        words, at = lower_words(text_or_empty(batch.column("text")))
        trained = np.repeat(batch.column("trained").to_numpy(zero_copy_only=False).astype(np.int64), np.diff(at))
        coded = words.dictionary_encode()
        n = np.bincount(coded.indices.to_numpy(), trained, len(coded.dictionary)).astype(np.int64)
        held.append(pa.table({"word": coded.dictionary.cast(pa.large_string()), "n": n}))
        if sum(t.num_rows for t in held) > 1_200_000:
            held = [summed()]
            if held[0].num_rows > 800_000:
                yield from _plain(held[0])
                held = []
    if held:
        yield from _plain(summed())


def _plain(t: pa.Table) -> Iterator[pa.RecordBatch]:
    return iter(t.set_column(0, "word", t["word"].cast(pa.string())).combine_chunks().to_batches(100_000))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together to SPELLED rows or somewhat more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= SPELLED:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _word_scores(packed, facts: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = packed.value
        for batch in _gathered(batches):
            n = batch.column("n").to_numpy().astype(np.float64)
            yield pa.RecordBatch.from_arrays([
                batch.column("word"), batch.column("n"), pa.array(_base(n, facts)), pa.array(model.log10(batch.column("word")))],
                names=["word", "n", "base", "spell"])

    return run


def _base(n, facts):
    return np.log10((n + 0.5) / (facts["N"] + 0.5 * (facts["V"] + 1)))


def rare_score(rare: dict):
    """Log10 of a rare word's share of all rare words, a column of (n, spell): the discounted
    count and the spelled share together. rare: N tokens and V words of training, and head,
    the sum of what the byte model gives the frequent words."""
    share = DISCOUNT * rare["V"] / rare["N"] if rare["N"] else 1.0
    spelled = F.col("spell") + F.lit(float(np.log10(share / max(1e-6, 1 - rare["head"]))))
    return F.when(F.col("n") > 0, F.log10((F.col("n") - DISCOUNT) / F.lit(float(max(rare["N"], 1))) + F.pow(F.lit(10.0), spelled))).otherwise(spelled)


def experts(counts: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Not a part of score: texts are told apart by the mixer's contexts. Of class counts (classes, TOP + 2) and the common probabilities of the top words:
    natural logs of each class's probability over the common one (words and rest, classes),
    and of the prior."""
    n = len(common)
    p = np.append(common, max(1e-12, 1 - common.sum()))
    c = np.concatenate((counts[:, :n], counts[:, TOP : TOP + 1]), 1)
    own = (c + BACKOFF * p) / (c.sum(1, keepdims=True) + BACKOFF)
    texts = counts[:, TOP + 1] + 0.5
    return np.log(own / p / own.sum(1, keepdims=True)).T, np.log(texts / texts.sum())


ROW = "uid long, doc_id long, held_out boolean, word string, tf long, n_tokens long, n_known long, base double, lp double, n_bytes long"


def _slot_counts(head, log: int):
    """A task's counts of the text tables, as packed chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, tree = coder.Symbols(head.value["word"]), head.value["tree"]
        counts = np.zeros((coder.HASHED, 2 << log), np.uint32)
        for batch in slices(batches):
            words, at = lower_words(text_or_empty(batch.column("text")))
            for _, _, tok in coder.pieces(at, *symbols.of(words), len(symbols.names) + 1):
                coder.count_paths(tree, tok, counts)
        coder.summed_paths(counts)
        chunks = counts.reshape(-1, coder.CHUNK)
        there = np.flatnonzero(chunks.any(1))
        for k in range(0, len(there), 64):
            part = there[k : k + 64]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array([coder.packed_counts(chunks[i]) for i in part], pa.binary())], names=["chunk", "counts"])

    return run


def _slot_sums(t: pa.Table) -> pa.Table:
    total = np.zeros(coder.CHUNK, np.int64)
    for x in t["counts"]:
        total += coder.unpacked_counts(x.as_py())
    return pa.table({"chunk": t["chunk"].slice(0, 1), "counts": pa.array([coder.packed_counts(total)], pa.binary())})


def _slot_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array([coder.states(coder.unpacked_counts(x.as_py())).tobytes() for x in batch.column("counts")], pa.binary())], names=["chunk", "states"])


def _text_table(sums: DataFrame, log: int) -> np.ndarray:
    """The states of all slots, (HASHED, slots): a byte each, 16 MB at most."""
    table = np.zeros((coder.HASHED << log) // (coder.CHUNK >> 1) * (coder.CHUNK >> 1), np.uint8).reshape(-1, coder.CHUNK >> 1)
    table[:] = coder.states(np.zeros(2, np.int64))
    for r in sums.mapInArrow(_slot_states, "chunk int, states binary").toLocalIterator():
        table[r["chunk"]] = np.frombuffer(bytes(r["states"]), np.uint8)
    return table.reshape(coder.HASHED, 1 << log)


def _text_lessons(head, table):
    """The weights and the map after a part of the held-back texts, and how often each cell was used."""

    def run(t: pa.Table) -> pa.Table:
        symbols = coder.Symbols(head.value["word"])
        mixer = coder.TextMixer(head.value["tree"], table.value)
        uses = np.zeros(len(mixer.cells()))
        for batch in slices(iter(t.sort_by([("order", "ascending"), ("text", "ascending")]).select(["text"]).to_batches())):
            words, at = lower_words(text_or_empty(batch.column("text")))
            for _, _, tok in coder.pieces(at, *symbols.of(words), len(symbols.names) + 1, coder.FIT_ROWS):
                mixer.code(tok, True, uses)
        return pa.table({"lane": pa.array([t["part"][0].as_py() % 16], pa.int32()), "sums": pa.array([np.stack((uses, mixer.cells() * uses)).tobytes()], pa.binary())})

    return run


def text_cells(rows: DataFrame, head, table) -> np.ndarray:
    """First weights and map of the text mixer, fitted on all of rows(doc_id, text)."""
    start = coder.TextMixer(head.value["tree"], table.value).cells()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = F.xxhash64("doc_id", "text", F.lit(1))
    dealt = rows.select("text", order.alias("order"), F.pmod(order, F.lit(-(-size // FIT_BYTES) or 1)).cast("int").alias("part"))
    sums = dealt.groupBy("part").applyInArrow(_text_lessons(head, table), "lane int, sums binary").groupBy("lane").applyInArrow(_lane_sums, "lane int, sums binary")
    got = sums.collect()  # 16 rows of fixed size, at most
    if not got:
        return start
    uses, cells = sum(np.frombuffer(bytes(r["sums"])) for r in sorted(got)).reshape(2, -1)
    return np.where(uses > 0, cells / np.maximum(uses, 1), start)


def _head_scores(head, table, cells: np.ndarray):
    """Each text's base over end and head words and the mixer's score of its symbols, and its
    other words one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = head.value
        symbols = coder.Symbols(held["word"])
        n, base = (np.append(held[c], 0.0) for c in ("n", "base"))
        mixer = coder.TextMixer(held["tree"], table.value)
        mixer.taught(cells)
        for batch in slices(batches):
            # texts of like length share their blocks
            batch = batch.take(pc.sort_indices(pc.binary_length(batch.column("text"))))
            words, at = lower_words(text_or_empty(batch.column("text")))
            rows, size = batch.num_rows, np.diff(at)
            doc = np.repeat(np.arange(rows), size)
            code, hashes = symbols.of(words)
            add = lambda x: np.bincount(doc, x[code], rows)
            empty = lambda k: pa.nulls(rows, k)
            lp = np.zeros(rows)
            for start, stop, tok in coder.pieces(at, code, hashes, len(symbols.names) + 1):
                lp[start:stop] = np.bincount(tok.doc, mixer.code(tok), stop - start)
            yield pa.RecordBatch.from_arrays([
                batch.column("uid"), batch.column("doc_id"), batch.column("held_out"), empty(pa.string()), empty(pa.int64()),
                pa.array(size + 1), pa.array((np.bincount(doc, n[code] > 0, rows) + held["end"][0]).astype(np.int64)), pa.array(add(base) + held["end"][1]), pa.array(lp),
                pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())], names=[c.split()[0] for c in ROW.split(", ")])
            rest = np.flatnonzero(code == len(symbols.names))
            if not len(rest):
                continue
            tail = words.take(pa.array(rest)).dictionary_encode()
            width = len(tail.dictionary)
            pair, tf = np.unique(doc[rest] * width + tail.indices.to_numpy(), return_counts=True)
            d = pa.array(pair // width)
            none = lambda k: pa.nulls(len(pair), k)
            yield from pa.Table.from_arrays([
                batch.column("uid").take(d), none(pa.int64()), none(pa.bool_()), tail.dictionary.take(pa.array(pair % width)).cast(pa.string()), pa.array(tf.astype(np.int64)),
                none(pa.int64()), none(pa.int64()), none(pa.float64()), none(pa.float64()), none(pa.int64())], names=[c.split()[0] for c in ROW.split(", ")]).to_batches(50_000)

    return run


def _large(column: pa.ChunkedArray) -> pa.Array:
    chunks = column.cast(pa.large_string()).chunks
    return pa.concat_arrays(chunks) if chunks else pa.array([], pa.large_string())


def score(docs: DataFrame, trained) -> DataFrame:
    """docs(doc_id, text), trained: a Boolean column of the documents to learn from."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), trained.alias("trained"))
    vocabulary = written(rows.select("text", "trained").mapInArrow(_vocabulary, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm_words")
    ends = rows.where("trained").count()
    got = vocabulary.where("n > 0").agg(F.count("*").alias("v"), F.sum("n").alias("n")).first()
    facts = {"N": int(got["n"] or 0) + ends, "V": got["v"] + (1 if ends else 0)}
    # slots: all words but the held-back teach the tables the mixer learns on; then all words
    known = vocabulary.where("n > 0").select("word")
    back = F.pmod(F.xxhash64("word"), F.lit(HELD_BACK)) == 0
    tasks = max(2, min(n_tasks(spark), -(-facts["V"] // 1_000_000)))

    def tables(words: DataFrame) -> np.ndarray:
        sums = words.coalesce(tasks).mapInArrow(_sparse_counts, "chunk int, counts binary").groupBy("chunk").applyInArrow(_summed, "chunk int, counts binary")
        counts = np.zeros((ORDERS * 2 << LOG_SLOTS) >> 14 << 14, np.float32).reshape(-1, 1 << 14)
        for r in sums.toLocalIterator():
            counts[r["chunk"]] = _thick(bytes(r["counts"]))
        return counts.reshape(ORDERS, 2, 1 << LOG_SLOTS)

    most = tables(known.where(~back))
    taught = Mixer(most)
    fit_all(taught, known.where(back))
    most += tables(known.where(back))
    model = Mixer(most)
    del most
    model.weights, model.map = taught.weights, taught.map
    packed = spark.sparkContext.broadcast(model)
    words = written(vocabulary.mapInArrow(_word_scores(packed, facts), "word string, n long, base double, spell double"), "lm_scores")
    top = words.where("n > 0").orderBy(F.desc("n"), "word").limit(HEAD).toArrow().combine_chunks()
    n = top["n"].to_numpy().astype(float)
    rare = {"N": facts["N"] - ends - int(n.sum()), "V": got["v"] - len(n), "head": float((10 ** top["spell"].to_numpy()).sum())}
    tree = coder.Tree(np.concatenate((n, (rare["N"] + 1.0, ends + 1.0))))
    end = (int(ends > 0), float(_base(np.array(float(ends)), facts)))
    head = spark.sparkContext.broadcast({"tree": tree, "word": _large(top["word"]), "n": n, "base": top["base"].to_numpy(), "end": end})
    # text tables: all training documents but the held-back teach the weights, then all
    log = coder.log_slots(facts["N"])
    read = rows.where("trained")
    back = F.pmod(F.xxhash64("doc_id", "text"), F.lit(HELD_BACK)) == 0
    counting = max(2, -(-facts["N"] // TABLE_TOKENS))

    def counted(docs: DataFrame) -> DataFrame:
        return docs.select("text").coalesce(counting).mapInArrow(_slot_counts(head, log), "chunk int, counts binary")

    sums = written(counted(read.where(~back)).groupBy("chunk").applyInArrow(_slot_sums, "chunk int, counts binary"), "lm_slots")
    table = spark.sparkContext.broadcast(_text_table(sums, log))
    cells = text_cells(read.where(back).select("doc_id", "text"), head, table)
    table.unpersist()
    table = spark.sparkContext.broadcast(_text_table(sums.unionByName(counted(read.where(back))).groupBy("chunk").applyInArrow(_slot_sums, "chunk int, counts binary"), log))
    numbered = rows.withColumn("uid", F.monotonically_increasing_id()).withColumn("held_out", ~F.col("trained")).select("uid", "doc_id", "held_out", "text")
    parts = written(numbered.mapInArrow(_head_scores(head, table, cells), ROW), "lm_parts")
    tail = parts.where("word IS NOT NULL").select("uid", "word", "tf").join(words, "word")
    tail = tail.groupBy("uid").agg(F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("k"), F.sum(F.col("tf") * F.col("base")).alias("b"), F.sum(F.col("tf") * rare_score(rare)).alias("l"))
    out = parts.where("word IS NULL").select("uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "lp", "n_bytes").join(tail, "uid", "left")
    whole = F.col("lp") + F.coalesce("l", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(facts["N"]).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"), whole.alias("score"),
        F.when(F.col("n_bytes") > 0, -whole / F.log10(F.lit(2.0)) / F.col("n_bytes")).alias("bits_per_byte"))


