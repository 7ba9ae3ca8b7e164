"""What the language model's steps work on: groups, not bits; different beginnings, not all words."""

import numpy as np
import pyarrow as pa

from sparkgrove.llm import coder, scoring

from .test_coder import LOG, made, taught


def test_counting_looks_slots_up_once_a_group(monkeypatch):
    tree, _, sym, _, tok = made()
    sizes, real = [], coder.slots
    monkeypatch.setattr(coder, "slots", lambda ctx, *rest: sizes.append(len(ctx)) or real(ctx, *rest))
    counts = np.zeros((coder.HASHED, 2 << LOG), np.uint32)
    coder.count_bits(tree, tok, counts)
    assert sum(sizes) == coder.HASHED * (-(-tree.depth[sym] // coder.GROUP)).sum()
    # one bit after the other
    slow = np.zeros_like(counts)
    for t, s in enumerate(sym):
        for e, g in zip(tree.path[tree.start[s] :][: tree.depth[s]], tree.group[tree.start[s] :]):
            for k in range(coder.HASHED):
                slot = ((((int(tok.ctx[k][t]) ^ int(g)) * int(coder._SPREAD)) % 2**32) >> (32 + coder.GROUP - LOG)) << coder.GROUP | int(e) >> 1 & 7
                slow[k, slot * 2 + (int(e) & 1)] += 1
    assert (counts == slow).all()


def test_ends_of_texts_teach_nothing():
    tree, names, sym, doc, tok = made(texts=(300, 1, 40, 90, 32, 0, 600))
    going = {}
    for at, n in coder._blocks(tok):
        last = coder.block_of(tok.pos[at]) == coder.block_of(np.bincount(doc)[doc[at]] - 1)
        assert n == (~last).sum() and not last[:n].any()
        going.update(dict.fromkeys(at.tolist()))
    assert len(going) == len(sym)
    model, alone = taught(tree, tok), []
    got = np.bincount(doc, model.code(tok), 7)
    for d in range(7):
        mine = doc == d
        alone.append(model.code(coder.Tokens(sym[mine], names[sym[mine]], np.zeros(mine.sum(), int))).sum())
    assert np.allclose(got, alone, rtol=1e-9)


def test_words_that_begin_alike_are_spelled_once(monkeypatch):
    words = pa.array([f"beginning{i}" for i in range(500)] + ["", "b", "a" * 60, "a" * 59, "é"], pa.large_string())
    counts = np.zeros((scoring.ORDERS, 2, 1 << scoring.LOG_SLOTS), np.float32)
    scoring.count_words(words, counts)
    assert counts.sum() == scoring.ORDERS * 8 * sum(len(w.as_py().encode()) + 1 for w in words)
    mixer, sizes, real = scoring.Mixer(counts), [], scoring.Mixer._bits
    monkeypatch.setattr(scoring.Mixer, "_bits", lambda self, sym, *rest: sizes.append(len(sym)) or real(self, sym, *rest))
    got = mixer.log10(words)
    assert sum(sizes) < 1500
    assert np.allclose(got, [mixer.log10(words.slice(i, 1))[0] for i in range(len(words))], rtol=1e-6)


def test_symbols_compare_words_in_full(monkeypatch):
    names = pa.array(["a", "bc", "def", "gh"], pa.large_string())
    words = pa.array(["def", "x", "a", "gh", "yy", "bc", "def"], pa.large_string())
    assert coder.Symbols(names).of(words)[0].tolist() == [2, 4, 0, 3, 4, 1, 2]
    assert coder.Symbols(names.slice(0, 0)).of(words)[0].tolist() == [0] * 7
    assert coder.Symbols(names).of(words.slice(0, 0))[0].tolist() == []
    monkeypatch.setattr(coder, "word_hashes", lambda w: np.full(len(w), 7, np.uint64))
    assert coder.Symbols(names).of(words)[0].tolist() == [2, 4, 0, 3, 4, 1, 2]
