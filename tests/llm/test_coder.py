"""The text mixer against a plain coder, bit by bit."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkgrove.llm import coder, scoring
from sparkgrove.llm.common import crc_mod

LOG = 14


def made(seed=3, texts=(300, 1, 40, 90)):
    rng = np.random.default_rng(seed)
    tree = coder.Tree(1000.0 / np.arange(1, 61))
    names = coder.mix64(np.arange(60, dtype=np.uint64) + np.uint64(9))
    doc = np.repeat(np.arange(len(texts)), texts)
    sym = np.minimum(rng.geometric(0.08, len(doc)) - 1, 59)
    return tree, names, sym, doc, coder.Tokens(sym, names[sym], doc)


def taught(tree, tok):
    counts = np.zeros((coder.HASHED, 2 << LOG), np.uint32)
    coder.count_bits(tree, tok, counts)
    assert counts.sum() == coder.HASHED * tree.depth[tok.sym].sum()
    return coder.TextMixer(tree, np.stack([coder.states(c) for c in counts]))


def code_of(tree, s):
    at = tree.start[s]
    return [(int(e) >> coder.GROUP + 1, int(e) >> 1 & (1 << coder.GROUP) - 1, int(e) & 1, int(g)) for e, g in zip(tree.path[at : at + tree.depth[s]], tree.group[at : at + tree.depth[s]])]


def plain(model, names, text):
    """Log10 probability of a text's symbols, one bit after the other."""
    tree, mix, total = model.tree, lambda x: int(coder.mix64(np.array([x % 2**64], np.uint64))[0]), 0.0
    weights, maps, learnt = model.weights.astype(float), model.map.astype(float), []
    for t, s in enumerate(text):
        if t in (32, 64, 128) or (t >= 256 and t % 256 == 0):
            step = coder.RATE / math.sqrt(len(learnt) + 1)
            new, seen = weights.copy(), {}
            for g, x, sure, err, near, bit in learnt:
                for k in range(coder.INPUTS):
                    new[k, g, sure[k]] += step * err * x[k]
                seen.setdefault((g, near), []).append(bit)
            for c, bits in seen.items():
                maps[c] += (sum(bits) - len(bits) * maps[c]) / (len(bits) + coder.APM_LIMIT)
            weights, learnt = new, []
        h = [int(names[text[t - k]]) if t >= k else 0 for k in (1, 2, 3)]
        two = (mix(h[0] + 2) + h[1]) % 2**64
        marker = next((text[i] + 1 for i in range(t - 1, -1, -1) if text[i] < coder.MARKERS), 0)
        ctx = [c >> 32 for c in (mix(h[0] + 1), mix(two), mix(mix(two + 3) + h[2]), mix(marker + (4 << 60)))]
        before = [i for i in range(1, t) if text[i - 1] == text[t - 1]] if t else []
        agreed, guess = 0, None
        if before:
            i, agreed = before[-1], 1
            back = lambda k: text[i - k] if i >= k else None
            if back(2) == (text[t - 2] if t >= 2 else None):
                agreed = 3 if back(3) == (text[t - 3] if t >= 3 else None) else 2
            guess = code_of(tree, text[i])
        for j, (node, inner, bit, group) in enumerate(code_of(tree, s)):
            x, sure, gate = [float(tree.stretch[node])], [0], 0
            for k in range(coder.HASHED):
                slot = ((((ctx[k] ^ group) * int(coder._SPREAD)) % 2**32) >> (32 + coder.GROUP - LOG)) << coder.GROUP | inner
                state = int(model.table[k, slot])
                x.append(((state >> 3) - coder.REACH - 1) * coder.STEP)
                sure.append(state & 7)
                gate = k + 1 if k < 3 and sure[-1] else gate
            stands = guess is not None and j < len(guess) and guess[j][0] == node
            x.append((guess[j][2] * 4 - 2) if stands else 0)
            sure.append(agreed if stands else 0)
            g = gate + 4 * stands
            dot = min(7.9, max(-7.9, sum(weights[k, g, sure[k]] * x[k] for k in range(coder.INPUTS))))
            p, place = 1 / (1 + math.exp(-dot)), (dot + 8) * 2
            lo = int(place)
            final = min(1 - 1e-6, max(1e-6, 0.5 * p + 0.5 * (maps[g, lo] * (1 - place + lo) + maps[g, lo + 1] * (place - lo))))
            total += math.log10(final if bit else 1 - final)
            learnt.append((g, x, sure, bit - p, lo + (place - lo >= 0.5), bit))
    return total


def test_code_agrees_with_a_plain_coder():
    tree, names, sym, doc, tok = made()
    model = taught(tree, tok)
    model.code(made(5)[-1], True)
    got = np.bincount(doc, model.code(tok))
    for d in range(4):
        assert got[d] == pytest.approx(plain(model, names, sym[doc == d].tolist()), rel=1e-3)
        alone = coder.Tokens(sym[doc == d], names[sym[doc == d]], np.zeros((doc == d).sum(), int))
        assert model.code(alone).sum() == pytest.approx(got[d], rel=1e-9)  # texts do not teach each other


def test_next_symbols_sum_to_one():
    tree, names, sym, doc, tok = made()
    model = taught(tree, tok)
    for size in (0, 1, 31, 70, 280):
        text = np.concatenate([np.append(sym[:size], s) for s in range(60)])
        whose = np.repeat(np.arange(60), size + 1)
        last = model.code(coder.Tokens(text, names[text], whose))[size :: size + 1]
        assert (10.0**last).sum() == pytest.approx(1, abs=1e-4)


def test_rare_words_sum_to_one(spark):
    n, spell = [4, 1, 1, 0, 0], [0.1, 0.3, 0.05, 0.2, 0.15]
    rows = spark.createDataFrame([(a, math.log10(b)) for a, b in zip(n, spell)], "n long, spell double")
    got = rows.select(F.pow(F.lit(10.0), scoring.rare_score({"N": 6, "V": 3, "head": 0.2}))).collect()
    assert sum(r[0] for r in got) == pytest.approx(1)
    assert rows.limit(1).select(scoring.rare_score({"N": 0, "V": 0, "head": 0.0})).first()[0] is not None


def test_counts_of_chunks_come_back_whole():
    x = np.zeros(coder.CHUNK, np.int64)
    x[[0, 5, 77, coder.CHUNK - 1]] = [3, 255, 70_000, 5_000_000_000]
    assert (coder.unpacked_counts(coder.packed_counts(x)) == x).all()


def test_longer_codes_share_what_they_begin_with():
    tree = coder.Tree(2.0 ** np.arange(45, 0, -1))
    assert tree.depth.max() > 40
    for a in range(0, 45, 4):
        for b in range(45):
            alike = next((i for i, (x, y) in enumerate(zip(code_of(tree, a), code_of(tree, b))) if x != y), int(tree.depth[a]))
            assert tree.common(np.array([a]), np.array([b]))[0] == alike


def test_score_depends_on_the_order_of_words(spark):
    rng = np.random.default_rng(1)
    text = lambda: " ".join(f"k{a} v{a}" for a in rng.integers(0, 12, 60))
    docs = [(i, text()) for i in range(120)]
    parts = docs[0][1].split()
    docs += [(1000, " ".join(parts)), (1001, " ".join(parts[::-1]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r for r in scoring.score(df, F.col("doc_id") < 1000).collect()}
    assert got[1000]["n_tokens"] == got[1001]["n_tokens"] and got[1000]["base_score"] == pytest.approx(got[1001]["base_score"])
    assert got[1000]["score"] > got[1001]["score"] + 10
    assert got[1000]["score"] > got[1000]["base_score"] * 0.7  # a word's pair is nearly certain
    again = {r["doc_id"]: r["score"] for r in scoring.score(df.repartition(5, "text"), F.col("doc_id") < 1000).collect()}
    assert all(again[i] == pytest.approx(r["score"], rel=1e-6) for i, r in got.items())
