"""Chat formatting, token ids, quality scores and license scans against plain versions."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkgrove.llm import chat, ids, licenses, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, words string"
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD_TEXTS = [
    None, "", " ", "  \n\n a  b\t\nc ", "x" * 30_000, "word " * 20_000, "été \n\n b c \x1c d\x85e", "don't <|endoftext|> a<|endoftext|>\n b",
    "CC BY all rights reserved", "cc by", "GNU General Public License, version 3 or later", "All All Rights RESERVED cc by-nc 4.0 cc  by", "éCC BY", "日本語 テキスト　です",
]


def docs(spark, texts=ODD_TEXTS):
    return spark.createDataFrame([(i, t, None, "s", None, "z", "w") for i, t in enumerate(texts)], DOCS)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a<|b\n<|n", ""]), st.text("<|>\nim_endstar \\n") | st.text())))
def test_template_round_trip(turns):
    formatted, spans = chat.format_turns(turns)
    assert chat.parse(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_paths_of_trees(spark):
    random.seed(1)
    parent = {f"n{i:03}": (None if i < 4 else f"n{random.randrange(i):03}") for i in range(120)}
    score = {k: random.choice([None, 0.5, 1.0, 2.0]) for k in parent}
    nodes = spark.createDataFrame([(k, p, score[k]) for k, p in parent.items()], "node string, parent string, score double")
    up = lambda n: [] if n is None else [*up(parent[n]), n]
    leaves = set(parent) - set(parent.values())
    total = {n: sum(score[x] or 0 for x in up(n)) for n in leaves}
    want = {}
    for root in [k for k, p in parent.items() if p is None]:
        mine = sorted((n for n in leaves if up(n)[0] == root), key=lambda n: (-total[n], n))[:2]
        want |= {n: up(n) for n in mine}
    got = {}
    for r in chat.paths(nodes, 2).collect():
        got.setdefault(r["leaf"], {})[r["depth"]] = r["node"]
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == want


def test_chat_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "a<|im_end|>b"), (1, 1, "assistant", "a"), (None, 3, None, "x"), (2, 5, "assistant", "é😀")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS node", "'q' AS leaf")
    got = {r["conv_id"]: r for r in chat.digest(chat.format_chats(chat.as_nodes(turns))).collect()}
    assert {k: (r["n_turns"], r["loss_chars"]) for k, r in got.items()} == {1: (3, 13), None: (1, 0), 2: (1, 2)}
    assert chat.digest(chat.format_chats(chat.as_nodes(turns.limit(0)))).count() == 0


@settings(deadline=None)
@given(st.lists(st.integers(0, 3) | st.integers(0, 70_000) | st.just(0) | st.integers(0, 2**64 - 1), max_size=400))
def test_simple8b(values):
    x = np.array(values, np.uint64)
    assert (ids.unpack(ids.pack(x), len(x)) == x).all()
    long = np.concatenate((np.zeros(700, np.uint64), x, np.zeros(130, np.uint64)))
    assert (ids.unpack(ids.pack(long), len(long)) == long).all()
    assert len(ids.pack(np.zeros(240, np.uint64))) == 1


def test_ids(spark):
    tok, at, want = Tokenizer.from_file(PATH), 0, {}
    for i, t in enumerate(ODD_TEXTS):
        x = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want[i] = (at, len(x), zlib.crc32(x.tobytes()))
        at += len(x)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in ids.encode_documents(docs(spark).repartition(3), PATH).collect()}
    assert got == want
    assert ids.encode_documents(docs(spark).limit(0), PATH).count() == 0


@settings(deadline=None, max_examples=200)
@given(st.lists(st.text(alphabet="ab'st 1.\n\t\r\x0b\x1c\x1d   　\x85é日") | st.text(), max_size=5))
def test_pieces(texts):
    got, at = ids.Encoder(PATH).encode(pa.array(texts, pa.large_string()))
    tok = Tokenizer.from_file(PATH)
    assert [got[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [[*tok.encode(t, add_special_tokens=False).ids, 0] for t in texts]


def test_quality(spark):
    random.seed(3)
    words = ["the", "of", "lorem", "ipsum", "dolor", "sit"]
    good = [" ".join(random.choices(words, k=30)) for _ in range(150)]
    bad = [" ".join(w.upper() + "!!" for w in random.choices(words, k=30)) for _ in range(150)]
    d = docs(spark, [*good, *bad, *ODD_TEXTS])
    labels = spark.createDataFrame([(i, int(i < 150) if i % 50 else None) for i in range(300)], "doc_id long, quality int")
    got = quality.scored(d, quality.train(d, labels)).collect()
    assert len(got) == 300 + len(ODD_TEXTS) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["doc_id"] < 300 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert held and all(r["predicted"] == (r["doc_id"] < 150) for r in held)
    assert {r["score"] for r in quality.scored(d, quality.train(d, labels.limit(0))).collect()} == {0.5}
    assert quality.scored(d.limit(0), quality.train(d, labels)).count() == 0


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    model = {"b": 0.3, "w": rng.normal(size=quality.N_FEATURES), "v": rng.normal(size=(quality.N_FEATURES, quality.RANK))}
    r, c, x = quality.features(pa.array(["a b c", "", "a A!! b|c 9"]))
    m, _ = quality.margin(model, r, c, x, 3)
    for k in range(3):
        cs, xs = c[r == k], x[r == k]
        vx = model["v"][cs] * xs[:, None]
        want = 0.3 + (model["w"][cs] * xs).sum() + sum(vx[i] @ vx[j] for i in range(len(cs)) for j in range(i))
        assert m[k] == pytest.approx(want)


def test_licenses(spark):
    texts = [*ODD_TEXTS, "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "plain words"]
    got = {r["doc_id"]: r for r in licenses.scan(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        words = [w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low.encode())]
        places = [(p, label) for phrase, label in licenses.BASE.items() for p in range(len(words)) if words[p : p + len(phrase.split())] == phrase.split()]
        r, at = got[i], [p for p, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(at), min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and {x for _, x in places} <= {*r["labels"].split(","), ""} and 0 <= r["score"] <= 1
    n = len(ODD_TEXTS)
    assert "apache-2.0" in got[n]["labels"] and "gpl-3" in got[n + 1]["labels"] and "cc-by-nc-4.0" in got[n + 2]["labels"] and got[n + 3]["labels"] == ""
    assert len(licenses.rules()) >= 200 and licenses.scan(docs(spark, []) if False else docs(spark).limit(0)).count() == 0
    spans = licenses.detections("gnu general public license, version 3 or later. all rights reserved cc by-sa 4.0")
    assert not any(a <= c and d <= b and (a, b) != (c, d) for a, b, _, _ in spans for c, d, _, _ in spans)


@pytest.mark.parametrize(("text", "label"), [
    ("MIT\nLicense", "mit"), ("Permission is hereby\ngranted, free of charge", "mit"), ("released under the\nMIT", "mit"), ("public\ndomain", "public-domain"),
    ("redistribution and\nuse in source and binary forms", "bsd"), ("GNU General\nPublic License v2", "gpl-2"), ("Apache licence", "apache"), ("see LICENCE.md", "license-header"),
    ("without prior written permission", "proprietary"), ("open database license 1.0", "odbl-1.0"), ("copyright 2020", "copyright-notice"), ("Copyright (c) 2020", "copyright-notice"), ("\u00a92020", "copyright-notice"),
    ("creative commons attribution 4.0", "cc-by-4.0")])
def test_license_separators(text, label):
    assert label in {x for _, _, x, _ in licenses.detections(re.sub("[A-Z]", lambda m: m[0].lower(), text))}


def test_license_keywords_are_in_every_match():
    """A minimal match of each rule, made of its pattern, passes the rule's own gate."""
    for _, _, keywords, pattern in licenses.rules():
        text = pattern.pattern.replace(r"\w+", "x").replace(r"\d{4}", "2020").replace("[sc]", "c")
        for old, new in ((r"(?:\W{1,4})", "\n"), (r"\W{0,3}", ""), (r"\W{0,2}", ""), (r"\s*", ""), (r"(?![\d.]*\d)", ""), (r"\.", "."), (r"\b", ""), ("[a-z0-9.+\\-]+", "x"), (r"[a-z0-9\-]+", "x"), (r"\(c\)", "c"), (r"\+", "+")):
            text = text.replace(old, new)
        while True:  # optional groups go, of alternatives the last stays
            shorter = re.sub(r"\(\?:([^()]*)\)(\?)?", lambda m: "" if m[2] else m[1].split("|")[-1], text)
            if shorter == text:
                break
            text = shorter
        text = re.sub(r".\?", "", text, flags=re.S)
        assert pattern.search(text), (pattern.pattern, text)
        assert all(w in text for w in keywords.split()), (keywords, text)


_PARTS = sorted({w for _, _, keywords, _ in licenses.rules() for w in keywords.split()} | {"the", "gnu", "version", "v2", "3.0", "2.0", "or", "later", "cc", "by", "sa", "4.0", "creative", "commons", "attribution", "under", "copyright", "2020", "(c)", "spdx-license-identifier:", "x"})


@settings(deadline=None, max_examples=60)
@given(st.lists(st.tuples(st.sampled_from(_PARTS), st.sampled_from([" ", "\n", "-", "  ", ", ", "\n * ", ""])), max_size=30))
def test_the_gate_loses_nothing(parts):
    text = "".join(a + b for a, b in parts)
    assert licenses.detections(text) == licenses.every_detection(text)


def test_gate_on_signatures():
    for _, _, keywords, pattern in licenses.rules():
        text = "; ".join(["gnu general public license v2 or later, " + keywords.replace(" ", "\n"), "mit license", keywords])
        assert licenses.detections(text) == licenses.every_detection(text)


@settings(deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 30), st.integers(1, 12)), max_size=40))
def test_suppression(spans):
    hits = [(-p, -n, i, a, a + n, str(i)) for i, (p, a, n) in enumerate(spans)]
    kept = []
    for minus, _, _, a, b, label in sorted(hits):
        if not any(x <= a and b <= y for x, y, _, _ in kept):
            kept.append((a, b, label, -minus))
    assert licenses.suppressed(hits) == sorted(kept)


def test_repeated_rows_are_scored_each(spark):
    rows = [(7, "Released under the MIT\nLicense", None), (7, "Released under the MIT\nLicense", None), (None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    got = licenses.scan(d).collect()
    assert sorted((str(r["doc_id"]), r["labels"]) for r in got) == [("7", "mit"), ("7", "mit"), ("None", "")]
    model = quality.fit(pa.array([], pa.string()), np.zeros(0))
    assert [r["score"] for r in quality.scored(d, model).collect()] == [0.5] * 3
    assert quality.accepted(d.withColumn("score", F.lit(9)), model).columns == [*d.columns, "score"]
