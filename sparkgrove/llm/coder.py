"""Codes running text word by word, each word as the bits of a code tree, by online
logistic context mixing.

The symbols are the frequent words, one for any rarer word and the end of a text; the
tree is Huffman's over their training counts, so that frequent words take few bits.
Every bit is predicted by

* the tree itself (exact counts below each side of the node),
* hashed contexts that run across words: the last one, two and three words, and the last
  word of the MARKERS most frequent ones; a slot counts zeros and ones over the running
  text of all training documents,
* a match: the symbol that followed the last place of this text with the same previous
  word, as long as its code agrees.

Their stretched probabilities are summed with weights that a gate (the longest context
seen in training, and whether a match stands) and each predictor's own confidence choose;
an adaptive probability map under the same gate refines the sum. Every text starts from
the fitted weights and map and teaches its own copy of them as it is read: after 32, 32,
64 and 128 words, then after each 256. A prediction depends on earlier words only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import RollingHash, mix64, picked

MARKERS = 32
HASHED, INPUTS = 4, 6
GATES = (1, 2, 4, 8, 32)  # confidence classes: counts below
N_GATES, SURE = 8, 6
APM_STEPS = 33
RATE, FIT_RATE, APM_LIMIT = 0.2, 0.05, 30.0
LEAST_LOG, MOST_LOG, CHUNK = 14, 22, 1 << 14
STEP, REACH = 0.4, 15  # stretched slots are kept in steps, up to so many
GROUP = 3  # levels of the tree whose slots lie side by side
PIECE_ROWS, FIT_ROWS, PIECE_TOKENS = 512, 16, 30_000
_NODE, _SPREAD = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)


class Tree:
    """Huffman's code of symbols with counts (all positive, two at least; a code longer than 64
    bits would take 10^13 tokens). From start[s] on, path has depth[s] steps of symbol s: node
    (the root is 0), its place in its group of levels, and the bit; odds has the node's
    stretched probability, and low the place and the bit alone. From group_start[s] on, heads has
    the hashes of its groups[s] groups of levels, and tails the place the last bit of each leads to."""

    def __init__(self, counts: np.ndarray):
        n = len(counts)
        order = np.argsort(counts, kind="stable")
        leaf, made = [*counts[order].tolist(), float("inf")], []
        up, side = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.int64)
        one, whole = np.zeros(n - 1), np.zeros(n - 1)
        i = j = 0
        for m in range(n - 1):
            total = 0
            for bit in (0, 1):
                if j >= len(made) or leaf[i] <= made[j]:
                    child, weight, i = int(order[i]), leaf[i], i + 1
                else:
                    child, weight, j = n + j, made[j], j + 1
                up[child], side[child] = m, bit
                total += weight
            one[m], whole[m] = weight, total
            made.append(total)
        entries, at, alive = [], np.arange(n), np.arange(n)
        self.depth = np.zeros(n, np.int64)
        while len(alive):
            entries.append((alive, (n - 2 - up[at]) * 2 + side[at]))
            self.depth[alive] += 1
            more = up[at] < n - 2
            alive, at = alive[more], n + up[at][more]
        self.start = np.cumsum(self.depth) - self.depth
        self.path = np.zeros(int(self.depth.sum()), np.int32)
        for level, (who, entry) in enumerate(entries):
            self.path[self.start[who] + self.depth[who] - 1 - level] = entry
        self.groups = (self.depth + GROUP - 1) // GROUP
        self.group_start = np.cumsum(self.groups) - self.groups
        self.heads = np.zeros(int(self.groups.sum()), np.uint32)
        self.tails = np.zeros(len(self.heads), np.uint8)
        self.word = np.zeros(n, np.uint64)  # the code from the highest bit on
        inner = np.ones(n, np.int32)
        for level in range(int(self.depth.max())):
            who = np.flatnonzero(self.depth > level)
            at = self.start[who] + level
            entry = self.path[at]
            bit = entry & 1
            if level % GROUP == 0:
                self.heads[self.group_start[who] + level // GROUP] = (entry >> 1).astype(np.uint32) * _NODE
                inner[who] = 1
            self.path[at] = (entry >> 1 << GROUP | inner[who]) << 1 | bit
            inner[who] = 2 * inner[who] + bit
            self.tails[self.group_start[who] + level // GROUP] = inner[who]
            self.word[who] |= bit.astype(np.uint64) << np.uint64(63 - level)
        self.stretch = np.log(one / (whole - one))[::-1].astype(np.float32)
        self.odds = self.stretch[self.path >> GROUP + 1]
        self.low = (self.path & (2 << GROUP) - 1).astype(np.uint8)

    @property
    def group(self) -> np.ndarray:
        """The hash of its group, for every step of path."""
        return np.repeat(self.heads, self._levels(self.depth, self.groups))

    @staticmethod
    def _levels(size: np.ndarray, groups: np.ndarray) -> np.ndarray:
        """How many levels each group of symbols with codes of these sizes has."""
        ends = np.cumsum(groups)
        out = np.full(int(ends[-1]) if len(ends) else 0, GROUP)
        out[ends - 1] = size - GROUP * (groups - 1)
        return out

    def bits(self, sym: np.ndarray):
        """Of symbols: how many bits each has and where they begin, the bits, what the tree gives
        them, the groups of each symbol and their hashes, and where each bit lies if every group
        has 1 << GROUP places."""
        size, groups = self.depth[sym], self.groups[sym]
        first, begin = np.cumsum(size) - size, np.cumsum(groups) - groups
        at = _runs(self.start[sym] - first, size)
        low, odds = picked(self.low, at), picked(self.odds, at)
        head = picked(self.heads, _runs(self.group_start[sym] - begin, groups))
        place = np.repeat(np.arange(0, len(head) << GROUP, 1 << GROUP), self._levels(size, groups))
        place += low >> np.uint8(1)
        return size, first, low & np.uint8(1), odds, groups, head, place

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bits the codes of two symbols begin with alike."""
        other = self.word[a] ^ self.word[b]
        high = np.frexp((other >> np.uint64(32)).astype(float))[1]
        low = np.frexp((other & np.uint64(0xFFFFFFFF)).astype(float))[1]
        return np.where(a == b, self.depth[a], np.where(high > 0, 32 - high, 64 - low))


def _runs(shift: np.ndarray, size: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... with shift[i] added to the next size[i] of them."""
    out = np.repeat(shift, size)
    out += np.arange(len(out))
    return out


class Tokens:
    """Symbols of some texts in running order, with what their contexts are made of."""

    def __init__(self, sym: np.ndarray, names: np.ndarray, doc: np.ndarray):
        n = len(sym)
        here = np.arange(n)
        first = np.searchsorted(doc, doc, "left") if n else here
        self.sym, self.doc, self.pos = sym, doc, here - first
        last = []
        for k in (1, 2, 3):
            prev = np.zeros(n, np.uint64)
            prev[k:] = names[:-k] if n > k else 0
            prev[self.pos < k] = 0
            last.append(prev)
        seen = np.zeros(n, np.int64)
        seen[1:] = np.maximum.accumulate(np.where(sym < MARKERS, here, -1))[:-1] if n else 0
        marker = np.where((self.pos > 0) & (seen >= first), sym[np.maximum(seen, 0)] + 1, 0) if n else seen
        two = mix64(last[0] + np.uint64(2)) + last[1]
        self.ctx = [mix64(last[0] + np.uint64(1)), mix64(two), mix64(mix64(two + np.uint64(3)) + last[2]), mix64(marker.astype(np.uint64) + (np.uint64(4) << np.uint64(60)))]
        self.ctx = [(c >> np.uint64(32)).astype(np.uint32) for c in self.ctx]
        # the last place of this text with the same previous word, and how many words before agree
        key = mix64(last[0] + np.uint64(5)) + doc.astype(np.uint64)
        order = np.argsort(key, kind="stable")
        before, after = order[:-1], order[1:]
        same = (key[before] == key[after]) & (self.pos[after] > 0)
        self.guess, self.agreed = np.zeros(n, np.int64), np.zeros(n, np.int64)
        before, after = before[same], after[same]
        self.guess[after] = sym[before]
        second = last[1][before] == last[1][after]
        self.agreed[after] = 1 + second + (second & (last[2][before] == last[2][after]))


def block_of(pos: np.ndarray) -> np.ndarray:
    """The block of each word of a text: of 32, 32, 64 and 128 words, then of 256."""
    return np.where(pos < 256, np.searchsorted([32, 64, 128], pos, "right"), 3 + pos // 256)


def _blocks(tok: Tokens) -> Iterator[tuple[np.ndarray, int]]:
    """The tokens of each block in turn, first those whose texts go on after it, and how many these are."""
    if not len(tok.sym):
        return
    block = block_of(tok.pos)
    ends = np.flatnonzero(np.append(np.diff(tok.doc) > 0, True))
    final = block == np.repeat(block[ends], np.diff(ends, prepend=-1))
    key = block * 2 + final
    order = np.argsort(key.astype(np.uint16) if key.max() < 1 << 16 else key, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
        yield at, len(at) - int(final[at].sum())


def slots(ctx: np.ndarray, head: np.ndarray, log: int) -> np.ndarray:
    """Where the slots of a group lie, in units of 1 << GROUP slots."""
    out = ctx ^ head
    out *= _SPREAD
    out >>= np.uint32(32 + GROUP - log)
    return out.astype(np.intp)


def log_slots(tokens: int) -> int:
    """Slots of a context grow with the training text, up to what a worker's memory holds."""
    return min(MOST_LOG, max(LEAST_LOG, int(4 * max(tokens, 1)).bit_length()))


def count_paths(tree: Tree, tok: Tokens, counts: np.ndarray) -> None:
    """Adds what the codes of tok do in each group of levels to counts (HASHED, 2 * slots), one
    count for all bits of a group; summed_paths makes zeros and ones of a slot from it."""
    log = (counts.shape[1] >> 1).bit_length() - 1
    groups = tree.groups[tok.sym]
    at = _runs(tree.group_start[tok.sym] - np.cumsum(groups) + groups, groups)
    head, tail = picked(tree.heads, at), picked(tree.tails, at)
    for k in range(HASHED):
        where = slots(np.repeat(tok.ctx[k], groups), head, log)
        where <<= GROUP + 1
        where += tail
        np.add.at(counts[k], where, counts.dtype.type(1))


def summed_paths(counts: np.ndarray) -> None:
    """A path through a group ends at one place: every place before gets the paths beyond it."""
    cells = counts.reshape(-1, 2 << GROUP)
    for level in range(GROUP - 1, 0, -1):
        here, next_ = 1 << level, 2 << level
        cells[:, here:next_] += cells[:, next_ : 2 * next_ : 2] + cells[:, next_ + 1 : 2 * next_ : 2]


def count_bits(tree: Tree, tok: Tokens, counts: np.ndarray) -> None:
    """Adds the bits of tok to counts (HASHED, 2 * slots): zeros and ones of a slot side by side."""
    paths = np.zeros_like(counts)
    count_paths(tree, tok, paths)
    summed_paths(paths)
    counts += paths


def states(counts: np.ndarray) -> np.ndarray:
    """Counts (2 * slots) as one byte a slot: stretched probability in steps, and confidence."""
    n0, n1 = counts[0::2].astype(float), counts[1::2].astype(float)
    stretch = np.clip(np.rint(np.log((n1 + 0.4) / (n0 + 0.4)) / STEP), -REACH, REACH).astype(np.int64)
    return (stretch + REACH + 1 << 3 | np.digitize(n0 + n1, GATES)).astype(np.uint8)


def packed_counts(x: np.ndarray) -> bytes:
    """A chunk of counts, a byte each; those of 255 and more follow with their places."""
    big = np.flatnonzero(x >= 255)
    return np.minimum(x, 255).astype("u1").tobytes() + big.astype("<u2").tobytes() + x[big].astype("<u8").tobytes()


def unpacked_counts(raw: bytes) -> np.ndarray:
    out = np.frombuffer(raw, "u1", CHUNK).astype(np.int64)
    n = (len(raw) - CHUNK) // 10
    out[np.frombuffer(raw, "<u2", n, CHUNK)] = np.frombuffer(raw, "<u8", n, CHUNK + 2 * n)
    return out


class TextMixer:
    def __init__(self, tree: Tree, table: np.ndarray):
        """table: (HASHED, slots) of states."""
        self.tree, self.table, self.log = tree, table, table.shape[1].bit_length() - 1
        self.eights = table.view(np.uint64)  # the slots of a group at once
        self.weights = np.full((INPUTS, N_GATES, SURE), 0.25, np.float32)
        self.weights[1:, :, 0] = 0
        self.map = np.tile(1 / (1 + np.exp(-np.linspace(-8, 8, APM_STEPS))), (N_GATES, 1)).astype(np.float32)

    def _inputs(self, tok: Tokens, at: np.ndarray):
        """Of the tokens at: how many bits each has and where they begin, the bits, the inputs but
        the match, stretched, the hashed ones' confidence, the gate; and the match: the bits it
        stands at, its inputs and its confidence."""
        tree, sym = self.tree, tok.sym[at]
        size, first, bit, odds, groups, head, place = tree.bits(sym)
        x, sure = [odds], []
        gate = np.zeros(len(bit), np.uint8)
        for k in range(HASHED):
            state = picked(picked(self.eights[k], slots(np.repeat(tok.ctx[k][at], groups), head, self.log)).view(np.uint8), place)
            x.append((state >> 3).astype(np.float32))
            x[-1] -= np.float32(REACH + 1)
            x[-1] *= np.float32(STEP)
            state &= 7
            sure.append(state)
            if k < 3:
                np.maximum(gate, (state > 0) * np.uint8(k + 1), out=gate)
        # a guess stands up to the first bit it gets wrong
        known = np.flatnonzero(tok.agreed[at])
        alike = tree.common(sym[known], tok.guess[at[known]])
        stand = np.minimum(alike + 1, size[known])
        stands = _runs(first[known] - np.cumsum(stand) + stand, stand)
        right = stands < np.repeat(first[known] + alike, stand)
        guess = np.where(bit[stands] == right, np.float32(2), np.float32(-2))
        gate[stands] += np.uint8(4)
        return size, first, bit, x, sure, gate, (stands, guess, np.repeat(tok.agreed[at[known]], stand))

    def code(self, tok: Tokens, fit: bool = False, uses: np.ndarray | None = None) -> np.ndarray:
        """Log10 probability of every token. Each text teaches its own copy of weights and map;
        to fit, all texts teach this mixer's own, and uses counts the bits of each of its cells."""
        out = np.zeros(len(tok.sym))
        lanes = 1 if fit or not len(tok.doc) else int(tok.doc[-1]) + 1
        weights = np.repeat(self.weights[:, None], lanes, 1).reshape(INPUTS, -1)
        maps = np.tile(self.map.ravel(), lanes)
        for at, going in _blocks(tok):
            size, first, bit, x, sure, gate, (stands, guess, agreed) = self._inputs(tok, at)
            lane = np.zeros(len(at), np.int64) if fit else tok.doc[at]
            gated = np.repeat(lane * (N_GATES * SURE), size)
            gated += gate * np.uint8(SURE)
            cells = [gated, *(gated + s for s in sure)]
            dot = picked(weights[0], gated)
            dot *= x[0]
            for k in range(1, HASHED + 1):
                w = picked(weights[k], cells[k])
                w *= x[k]
                dot += w
            cells.append(gated[stands] + agreed)
            dot[stands] += picked(weights[-1], cells[-1]) * guess
            np.clip(dot, -7.9, 7.9, out=dot)
            p = np.exp(-dot)
            p += 1
            np.reciprocal(p, out=p)
            dot += 8
            dot *= np.float32((APM_STEPS - 1) / 16)
            lo = np.floor(dot)
            part = dot - lo
            cell = np.repeat(lane * (N_GATES * APM_STEPS), size)
            cell += gate * np.uint8(APM_STEPS)
            cell += lo.astype(np.intp)
            low, final = picked(maps, cell), picked(maps[1:], cell)
            final -= low
            final *= part
            final += low
            final += p
            final *= np.float32(0.5)
            np.clip(final, 1e-6, 1 - 1e-6, out=final)
            final -= 1 - bit
            np.log(np.abs(final, out=final), out=final)
            out[at] = np.add.reduceat(final, first, dtype=float)
            # texts that end in this block have nothing more to learn for
            m = len(bit) if fit else int(size[:going].sum())
            if not m:
                continue
            err = bit[:m] - p[:m]
            rate = ((FIT_RATE if fit else RATE) / np.sqrt(np.bincount(lane, size, lanes) + 1.0)).repeat(N_GATES * SURE)
            stood = int(np.searchsorted(stands, m))
            for k in range(HASHED + 1):
                weights[k] += (rate * np.bincount(cells[k][:m], err * x[k][:m], weights.shape[1])).astype(np.float32)
            weights[-1] += (rate * np.bincount(cells[-1][:stood], err[stands[:stood]] * guess[:stood], weights.shape[1])).astype(np.float32)
            near = cell[:m] + (part[:m] >= 0.5)
            near *= 2
            near += bit[:m]
            zeros, ones = np.bincount(near, minlength=2 * len(maps)).reshape(-1, 2).T
            n = zeros + ones
            maps += ((ones - n * maps) / (n + APM_LIMIT)).astype(np.float32)
            if uses is not None:
                uses += np.concatenate([np.bincount(c, minlength=weights.shape[1]) for c in cells] + [n])
        out /= np.log(10)
        if fit:
            self.weights, self.map = weights.reshape(self.weights.shape), maps.reshape(self.map.shape)
        return out

    def cells(self) -> np.ndarray:
        return np.concatenate((self.weights.ravel(), self.map.ravel())).astype(float)

    def taught(self, cells: np.ndarray) -> None:
        cells = cells.astype(np.float32)
        self.weights, self.map = cells[: self.weights.size].reshape(self.weights.shape), cells[self.weights.size :].reshape(self.map.shape)


def word_hashes(words: pa.Array) -> np.ndarray:
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = words.buffers()[2]
    return RollingHash(np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)).of(offsets[:-1], offsets[1:])


class Symbols:
    """Finds the symbols of words among names: by their hashes, then compared in full."""

    def __init__(self, names: pa.Array):
        found = word_hashes(names)
        self.names, self.order = names, np.argsort(found)
        self.hashes = found[self.order]
        self.alike = int(np.unique(found, return_counts=True)[1].max(initial=0))  # 1, but for names of one hash

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all words (len(names) for others) and their hashes."""
        coded = words.dictionary_encode()
        different, index = coded.dictionary, coded.indices.to_numpy()
        hashes = word_hashes(different)
        sym = np.full(len(different), len(self.names), np.int64)
        at = np.searchsorted(self.hashes, hashes)
        for _ in range(self.alike):
            maybe = np.flatnonzero(at < len(self.hashes))
            maybe = maybe[self.hashes[at[maybe]] == hashes[maybe]]
            name = self.order[at[maybe]]
            same = pc.equal(different.take(pa.array(maybe)), self.names.take(pa.array(name))).to_numpy(zero_copy_only=False)
            sym[maybe[same]] = name[same]
            at += 1
        return sym[index], hashes[index]


def pieces(at: np.ndarray, sym: np.ndarray, names: np.ndarray, end: int, most: int = PIECE_ROWS) -> Iterator[tuple[int, int, Tokens]]:
    """The texts whose words (symbols sym, hashes names) begin at `at`, some at a time: first and last row, and their tokens."""
    rows, start = len(at) - 1, 0
    while start < rows:
        stop = max(start + 1, min(start + most, int(np.searchsorted(at, at[start] + PIECE_TOKENS, "right")) - 1))
        size = np.diff(at[start : stop + 1])
        doc = np.repeat(np.arange(stop - start), size + 1)
        ends = np.cumsum(size + 1) - 1
        inner = np.ones(len(doc), bool)
        inner[ends] = False
        s, h = np.full(len(doc), end, np.int64), np.zeros(len(doc), np.uint64)
        s[inner], h[inner] = sym[at[start] : at[stop]], names[at[start] : at[stop]]
        yield start, stop, Tokens(s, h, doc)
        start = stop
