"""Decontamination against exact edit distances."""

import random

import numpy as np

from sparkgrove.llm import decontaminate as dc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, edits string, __leaks int"


def edits(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item):
        new = [i + 1]
        for j, y in enumerate(text):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def corpus():
    random.seed(8)
    vocab = ["the", "of", "and", "to"] * 10 + [f"v{i}" for i in range(200)]
    items = {i: random.choices(vocab, k=random.choice([4, 5, 8, 12, 20, 33, 47, 66])) for i in range(30)}
    docs = {}
    for i in range(300):
        w = random.choices(vocab, k=random.choice([0, 3, 40, 120]))
        if i % 2:
            x = list(random.choice(list(items.values())))
            for _ in range(random.randint(0, max(0, int(len(x) * 0.25)))):
                p = random.randrange(len(x))
                x[p : p + random.choice([0, 1, 1])] = random.choices(vocab, k=random.choice([0, 1, 1]))
            p = random.randrange(len(w) + 1)
            w[p:p] = x
        docs[i] = random.choice([" ", ", ", "\n"]).join(w).title()
    return items, docs


def test_recall_and_precision(spark):
    items, docs = corpus()
    bench = spark.createDataFrame([*((i, " ".join(w)) for i, w in items.items()), (None, "the of"), (99, None), (98, "")], "item_id long, text string")
    d = spark.createDataFrame([(i, t, None, "s", 1, "e", 2) for i, t in [*docs.items(), (900, None), (901, ""), (902, "the " * 20_000)]], DOCS).repartition(4)
    want = {(i, j) for i, t in docs.items() for j, w in items.items() if edits(w, dc.plain_words(t)) <= dc.edit_budget(len(w))}
    found = dc.leaks(d, bench).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    assert len(want) > 80 and got <= want and len(got) >= 0.97 * len(want)
    for r in found:
        assert r["edits"] >= edits(items[r["item_id"]], dc.plain_words(docs[r["doc_id"]]))
    kept = dc.clean(d, bench)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == (set(docs) | {900, 901, 902}) - {i for i, _ in got}
    assert dc.clean(d, bench.limit(0)).count() == 303 and dc.leaks(d.limit(0), bench).count() == 0


def test_blocks_agree(spark, monkeypatch):
    items, docs = corpus()
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    d = spark.createDataFrame([(i, t, None, "s", 1, "e", 2) for i, t in docs.items()], DOCS)
    whole = {tuple(r) for r in dc.leaks(d, bench).collect()}
    monkeypatch.setattr(dc, "BLOCK_ITEMS", 7)
    assert {tuple(r) for r in dc.leaks(d, bench).collect()} == whole


def test_substring_edits():
    random.seed(2)
    for _ in range(50):
        a, b = random.choices(range(1, 5), k=6), random.choices(range(1, 5), k=9)
        assert dc.substring_edits(np.array(a, np.uint64), np.array([b], np.uint64))[0] == edits(a, b)


def test_recall_follows_the_plan():
    """Copies with as many edits as allowed, not those of the plan, meet their item."""
    for n in (10, 23, 58):
        d = dc.edit_budget(n)
        rng = np.random.default_rng(99)
        pairs = [dc.edited(rng, n, d) for _ in range(300)]
        r = dc.walks(-(-n // 5) * 5, dc.edit_budget(-(-n // 5) * 5))
        met = (dc.keys(np.array([x for x, _ in pairs]), r) == dc.keys(np.array([y for _, y in pairs]), r)).any(1)
        assert r < dc.WALKS and met.mean() >= dc.RECALL - 0.02


def test_repeated_rows_and_items(spark):
    bench = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "x y")], "item_id long, text string")
    d = spark.createDataFrame([(5, "q a b c d e f", 1), (5, "q a b c d e f", 1), (6, "x, Y!", 2), (7, "x z y", 3)], "doc_id long, text string, item_id long")
    got = sorted((r["doc_id"], r["item_id"], r["edits"]) for r in dc.leaks(d, bench).collect())
    assert got == [(5, 1, 0)] * 4 + [(6, 2, 0)]
    assert [r["doc_id"] for r in dc.clean(d, bench).collect()] == [7]
