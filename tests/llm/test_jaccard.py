"""The Jaccard join against brute force."""

import random
import re

import numpy as np
import pytest

from sparkgrove.llm import jaccard

DOCS = "doc_id long, text string, lang string, source string, n_chars long, sig long, n long"


def brute(texts, k, num, den):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    comp, links = {i: i for i in texts}, dict.fromkeys(texts, 0)

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                comp[b] = a
                links[i] += 1
                links[j] += 1
    return {i: (len(sets[i]), top(i)) for i in texts}, links


def corpus(seed):
    random.seed(seed)
    vocab = ["the", "of", "and"] * 8 + [f"w{i}" for i in range(60)]
    texts = {}
    bases = [random.choices(vocab, k=random.choice([1, 2, 3, 4, 6, 9, 20, 45, 90, 200])) for _ in range(60)]
    for i in range(420):
        w = list(random.choice(bases))
        for _ in range(random.choice([0, 0, 1, 1, 2, 3, 6])):
            p = random.randrange(len(w) + 1)
            w[p : p + random.choice([0, 1])] = random.choices(vocab, k=random.choice([0, 1]))
        texts[i * 3] = (" ", "\n")[i % 2].join(w).upper() if i % 7 == 0 else "  ".join(w)
    hot = random.choices(vocab, k=150)
    for i in range(2000, 2120):  # a large group of near copies
        w = list(hot)
        w[random.randrange(150)] = f"x{i}"
        texts[i] = " ".join(w)
    return texts | {5000: None, 5001: "", 5002: " \n ", 5003: "a b", 5004: "A\tB", 5005: "z " * 5000, 5006: "z z z"}


@pytest.mark.parametrize(("k", "num", "seed"), [(3, 90, 1), (5, 80, 2), (2, 60, 3)])
def test_against_brute_force(spark, k, num, seed):
    texts = corpus(seed)
    rows = [(i, t, None, "s", 1, 7, 7) for i, t in texts.items()]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    want, links = brute(texts, k, num, 100)
    found = jaccard.join_components(df, k, num, 100).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want
    assert {r["doc_id"]: r["n_links"] for r in found} == links


def test_large_trees_are_cut(spark, monkeypatch):
    texts = corpus(4)
    df = spark.createDataFrame([(i, t, None, "s", 1, 7, 7) for i, t in texts.items()], DOCS).repartition(5)
    want, links = brute(texts, 3, 90, 100)
    for name, value in (("CHUNK", 30), ("CELL_CHUNK", 9), ("FINE_CHUNK", 7), ("CHUNK_BYTES", 20_000)):
        monkeypatch.setattr(jaccard, name, value)
        found = jaccard.join_components(df, 3, 90, 100).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in found} == {i: (*want[i], links[i]) for i in texts}


@pytest.mark.parametrize("sides", [1, 2])
def test_tree_finds_all_pairs(sides):
    rng = np.random.default_rng(5)
    points = rng.poisson(3, (12, jaccard.GROUPS)).repeat(60, 0)
    points = np.maximum(points + (rng.random(points.shape) < 0.05) - (rng.random(points.shape) < 0.05), 0)
    n, side = points.sum(1), rng.integers(0, sides, len(points))
    got = [tuple(sorted(x)) for i, j in jaccard.tree_pairs(points, n, side, 80, 100) for x in zip(i.tolist(), j.tolist())]
    least = np.minimum(points[:, None], points[None]).sum(2)
    ok = least * 180 >= 80 * (n[:, None] + n[None])
    want = {(i, j) for i in range(len(n)) for j in range(i + 1, len(n)) if ok[i, j] and n[i] * 80 <= n[j] * 100 and n[j] * 80 <= n[i] * 100 and (sides == 1 or side[i] != side[j])}
    assert len(got) == len(set(got)) and set(got) == want


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f", None, None, None, 1, 1), (1, "a b c d e f", None, None, None, 1, 1), (None, "a b c d e f", None, None, None, 1, 1), (0, "q", None, None, None, 1, 1)], DOCS)
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.join_components(df).collect())
    assert got == [("0", 1, "0"), ("1", 2, "1"), ("1", 2, "1"), ("None", 2, "None")]
    assert sorted(str(r["doc_id"]) for r in jaccard.keep_one(df).collect()) == ["0", "1"]
    assert jaccard.keep_one(df).columns == df.columns
    assert jaccard.join_components(df.limit(0)).count() == 0


def test_kept_rows(spark):
    """Rows are told apart by id and text; columns with any name pass through."""
    text, other = "a b c d e f g h", "q r s t u v w"
    rows = [(1, text, 1, "x"), (1, other, 2, "x"), (None, text, 3, "x"), (None, "n o n e i s", 4, "x"), (2, other + " ", 5, "x"), (3, "", 6, "x"), (None, None, 7, "x"), (4, "n o n e i s", 8, "x"), (1, text.upper(), 9, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id long, __sig string")
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["__id"] for r in kept.collect()) == [2, 6, 7, 8, 9]


def test_components(spark):
    random.seed(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(random.randrange(100, 200), random.randrange(100, 200)) for _ in range(60)]
    comp = {x: x for e in edges for x in e}
    for _ in comp:
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r["id"]: r["comp"] for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(comp[x] == c for x, c in got.items()) and set(got) == {x for a, b in edges if a != b for x in (a, b)}
