"""Repeated byte strings against brute force."""

import random
from collections import Counter

import numpy as np

from sparkgrove.llm import common, repeats

DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, data string"


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - length + 1):
            if count[x[i : i + length]] > 1:
                gone[i : i + length] = True
        a, b = common.runs(gone)
        out.append((len(x), list(zip(a.tolist(), b.tolist())), bytes(np.frombuffer(x, np.uint8)[~gone])))
    return out


def corpus():
    random.seed(12)
    word = lambda n: " ".join("".join(random.choices("abcdeé", k=random.randint(1, 6))) for _ in range(n))
    shared = [word(k) for k in (40, 60, 120, 300)]
    made = []
    for i in range(260):
        parts = [word(random.choice([0, 3, 30, 90]))]
        for _ in range(random.choice([0, 0, 1, 2])):
            s = random.choice(shared)
            a = random.randrange(len(s) // 2)
            parts += [s[a : a + random.choice([150, 199, 200, 201, 330, 900])], word(random.choice([0, 1, 20]))]
        made.append(" ".join(parts))
    made += [made[0], made[1], word(200)] + ["ab" * 500, "z" * 200, "z" * 199, None, "", "x" * 201]
    made += [shared[3][:k] for k in (199, 200, 201, 333)]
    return made


def test_cover():
    d = repeats.difference_cover()
    assert len(d) == 12 and {(a - b) % repeats.V for a in d for b in d} == set(range(repeats.V))


def check(spark, made, length):
    d = spark.createDataFrame([(i, t, None, "s", 1, "x", "y") for i, t in enumerate(made)], DOCS).repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], [(s["start"], s["stop"]) for s in r["spans"]], bytes(r["kept"])) for r in repeats.remove_repeats(d, length).collect()}
    assert got == dict(enumerate(brute(made, length)))


def test_against_brute_force(spark):
    check(spark, corpus(), 200)


def test_many_small_blocks_and_passes(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PASS_SHARE", 1 / 64)
    old = repeats.slices
    monkeypatch.setattr(repeats, "_blocks", lambda batches: _small(old, batches))
    check(spark, corpus(), 150)


def _small(slices, batches):
    import pyarrow as pa

    for batch in slices(batches, limit=3000):
        data, at = common.joined_bytes(common.text_or_empty(batch.column("text")))
        yield pa.RecordBatch.from_arrays([pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([at.astype("<i8").tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary())], names=["doc_ids", "offsets", "data"])


def test_odd_tables(spark):
    d = spark.createDataFrame([(None, "q" * 300, None, None, None, None, None), (1, "r", None, None, None, None, None), (1, "r", None, None, None, None, None)], DOCS)
    got = sorted((str(r["doc_id"]), r["n_bytes"], bytes(r["kept"])) for r in repeats.remove_repeats(d).collect())
    assert got == [("1", 1, b"r"), ("1", 1, b"r"), ("None", 300, b"")]
    assert repeats.remove_repeats(d.limit(0)).count() == 0
