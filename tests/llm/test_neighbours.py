"""Nearest neighbours against brute force."""

import numpy as np

from sparkgrove.llm import neighbours


def brute(rows, every, k):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 16 and None not in v and np.isfinite(np.array(v)).all() and np.any(v):
            ok[(i, tuple(v))] = np.array(v, np.float64)
    ids, m = np.array([k[0] for k in ok]), np.array(list(ok.values()))
    out = {}
    for q in [i for i in ids if i % every == 0]:
        d = np.sqrt(((m[ids == q][0] - m) ** 2).sum(1))
        out[int(q)] = sorted((float(x), int(i)) for x, i in zip(d, ids) if i != q)[:k]
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(1500, 16))
    base[:600] = base[rng.integers(0, 30, 600)] + rng.normal(size=(600, 16)) * 0.05
    base[700:1000] = base[700]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(base)]
    rows += [(2000, None), (2100, [0.0] * 16), (2200, [1.0, None] * 8), (2300, [float("nan")] * 16), (2400, [1.0] * 3), (None, [1.0] * 16), rows[100]]
    df = spark.createDataFrame([(i, v, "q", 3) for i, v in rows], "vec_id long, embedding array<float>, rep string, key int")
    want, got = brute(rows, 20, 10), {}
    for r in neighbours.search(df, query_every=20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    assert set(got) == set(want) and all(len(x) == 10 for x in got.values())
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    same = [q for q in want if 700 <= q < 1000]
    assert same and all([i for _, i in got[q]] == [i for _, i in want[q]] for q in same)
    few = neighbours.search(df.where("vec_id IN (0, 1, 2)"), query_every=20).collect()
    assert [r["query_id"] for r in few] == [0, 0]
    assert neighbours.search(df.limit(0)).count() == 0


def test_keys_follow_a_curve():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    order = np.argsort(neighbours.hilbert_keys(grid, 3))
    assert sorted(neighbours.hilbert_keys(grid, 3)) == list(range(512))
    assert (np.abs(np.diff(grid[order], axis=0)).sum(1) == 1).all()
