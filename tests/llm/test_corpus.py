"""Scores and mixing against plain versions."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkgrove.llm import mixing, scoring
from sparkgrove.llm.common import crc_mod

DOCS = "doc_id long, text string, lang string, source string, n_chars long, uid string, word string"


def texts():
    random.seed(6)
    vocab = ["the", "of", "And"] * 9 + [f"w{i}" for i in range(300)] + ["été", "日本"]
    made = [random.choice([" ", "\n", "\t "]).join(random.choices(vocab, k=random.choice([0, 1, 5, 60]))) for _ in range(200)]
    return [*made, None, "", "  ", "x\x1cy\x85z q", "Z" * 3000, "the " * 30_000, "nul\x00l"]


def frame(spark, made):
    return spark.createDataFrame([(i, t, None if i % 7 == 0 else "en", f"s{i % 3}" if i % 5 else None, 1, "u", "w") for i, t in enumerate(made)], DOCS).repartition(3)


def test_scores(spark):
    made = texts()
    got = {r["doc_id"]: r for r in scoring.score(frame(spark, made), crc_mod(F.col("doc_id"), 5) != 1).collect()}
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for i, t in enumerate(made)}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        assert math.isfinite(r["score"]) and r["score"] < 0
    assert sum(got[i]["score"] for i in got if held[i]) > sum(got[i]["base_score"] for i in got if held[i]) * 1.6
    assert scoring.score(frame(spark, made).limit(0), F.lit(True)).count() == 0
    odd = frame(spark, ["a b", "a"]).withColumn("doc_id", F.lit(None).cast("long"))
    got = scoring.score(odd.unionByName(frame(spark, ["a b", "a b"]).withColumn("doc_id", F.lit(7).cast("long"))), crc_mod(F.col("doc_id"), 5) != 1).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["7", "7", "None", "None"] and all(r["held_out"] is not None for r in got)
    assert all(r["train_tokens"] == 0 for r in scoring.score(frame(spark, made[:5]), F.lit(False)).collect())


def test_byte_model_is_a_distribution():
    counts = np.zeros((scoring.ORDERS, 2, 1 << scoring.LOG_SLOTS), np.float32)
    words = pa.array(["the", "then", "there", "é", "of"] * 3)
    scoring.count_words(words, counts)
    model = scoring.Mixer(counts)
    model.fit(words)
    sym = np.arange(256, dtype=np.uint8)
    _, _, ctx = scoring.spelled(pa.array(["thex"]))
    bits = model._bits(sym, np.repeat(ctx[:, 3:4], 256, axis=1), np.full(256, ord("e")), None)
    assert (2.0**bits).sum() == pytest.approx(1, abs=1e-4)
    assert model.log10(pa.array(["the"]))[0] > model.log10(pa.array(["xqz"]))[0]


def test_raking_meets_targets(spark):
    cells = spark.createDataFrame([(f"s{i}", f"l{j}", f"t{k}", (i + 1) * (j + 2) * (k * k + 1)) for i in range(4) for j in range(3) for k in range(3) if (i + j + k) % 4], "source string, lang string, topic string, tokens long")
    want = {"source": [0.1, 0.2, 0.3, 0.4], "lang": [0.5, 0.3, 0.2], "topic": [0.2, 0.2, 0.6]}
    targets = {d: spark.createDataFrame([(f"{d[0]}{i}", x) for i, x in enumerate(v)], f"{d} string, share double") for d, v in want.items()}
    got = mixing.rake(cells, targets, rounds=60).toPandas()
    for d, v in want.items():
        assert got.groupby(d)["weight"].sum().tolist() == pytest.approx(v, abs=1e-6)
    whole = got.sort_values(["source", "lang", "topic"])["weight"].tolist()
    mixing.SMALL_CELLS, before = 0, mixing.SMALL_CELLS
    try:
        again = mixing.rake(cells, targets, rounds=3).toPandas()
    finally:
        mixing.SMALL_CELLS = before
    few = mixing.rake(cells, targets, rounds=3).toPandas()
    order = ["source", "lang", "topic"]
    assert again.sort_values(order)["weight"].tolist() == pytest.approx(few.sort_values(order)["weight"].tolist())
    assert len(whole) == cells.count()


def test_sampling(spark):
    made = texts()
    d = frame(spark, [*made, *made[:3]]).unionByName(spark.createDataFrame([(None, "a b", None, None, None, None, None)], DOCS))
    m = mixing.mixed(d, rate=0.6).toPandas()
    assert len(m) == d.count() and m["__probability"].between(0, 1).all()
    weight = m["__words"].clip(lower=1)
    assert (weight * m["__probability"]).sum() == pytest.approx(0.6 * weight.sum(), rel=1e-6)
    once = mixing.decided(d, rate=0.6).toPandas()
    assert sorted(once["__probability"]) == pytest.approx(sorted(m["__probability"])) and once["__kept"].sum() == m["__kept"].sum()
    kept = mixing.sample(d, rate=0.6)
    assert kept.columns == d.columns and kept.count() == m["__kept"].sum()
    assert mixing.sample(d.limit(0)).count() == 0


def test_experts_are_distributions():
    rng = np.random.default_rng(2)
    common = np.array([0.2, 0.1, 0.05])
    counts = np.zeros((scoring.MARKERS + 1, scoring.TOP + 2))
    counts[:, :3], counts[:, scoring.TOP], counts[:, scoring.TOP + 1] = rng.integers(0, 50, (scoring.MARKERS + 1, 3)), 30, 4
    ratio, prior = scoring.experts(counts, common)
    assert (np.exp(ratio) * np.append(common, 0.65)[:, None]).sum(0) == pytest.approx(np.ones(scoring.MARKERS + 1))
    assert np.exp(prior).sum() == pytest.approx(1)


def test_mixer_learns_from_every_held_back_word(spark, monkeypatch):
    words = [f"w{i:x}{'ab'[i % 2] * (i % 5)}" for i in range(400)]
    df = spark.createDataFrame([(w,) for w in words], "word string").repartition(3)
    counts = np.zeros((scoring.ORDERS, 2, 1 << scoring.LOG_SLOTS), np.float32)
    scoring.count_words(pa.array(words), counts)
    monkeypatch.setattr(scoring, "MIX_WORDS", 50)
    mixer = scoring.Mixer(counts)
    before = mixer.weights.copy()
    scoring.fit_all(mixer, df)
    assert (mixer.weights != before).any() and np.isfinite(mixer.weights).all()
    # the map's cells count each bit of each word once
    parts = max(1, -(-len(words) // 50))
    packed = spark.sparkContext.broadcast(scoring.Mixer(counts))
    order = F.xxhash64("word", F.lit(1))
    rows = df.select("word", order.alias("order"), F.pmod(order, F.lit(parts)).cast("int").alias("part")).groupBy("part").applyInArrow(scoring._lessons(packed), "lane int, sums binary").collect()
    size = scoring.Mixer(counts).weights.size
    assert sum(np.frombuffer(bytes(r["sums"])).reshape(2, -1)[0, size:].sum() for r in rows) == 8 * sum(len(w) + 1 for w in words)
    # one part is the plain online pass
    monkeypatch.setattr(scoring, "MIX_WORDS", 1000)
    one, plain = scoring.Mixer(counts), scoring.Mixer(counts)
    scoring.fit_all(one, df)
    plain.fit(pa.array([r["word"] for r in df.orderBy(order, "word").collect()]))
    assert np.allclose(one.weights, plain.weights, atol=1e-6) and np.allclose(one.map, plain.map, atol=1e-6)
