"""The pipeline, stage by stage, on a small table."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from sparkgrove.llm import decontaminate, mixing
from sparkgrove.llm.common import table

from .test_jaccard import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name == "token_ids":
            got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in out.collect()}
            break
        assert out.columns == docs.columns
        rows, kept = docs.collect(), {r["doc_id"] for r in out.collect()}
        assert 0 < len(kept) <= before
        if name == "near_duplicates":
            comp, _ = brute({r["doc_id"]: r["text"] for r in rows}, 5, 80, 100)
            assert kept == {i for i, (_, c) in comp.items() if c == i}
        if name == "decontamination":
            items = [decontaminate.plain_words(r["text"]) for r in table(spark, SF, "benchmark").collect()]
            for r in rows:
                held = any(" ".join(w) in " ".join(decontaminate.plain_words(r["text"])) for w in items)
                assert not held or r["doc_id"] not in kept
        if name == "mixing":
            assert kept == {r["doc_id"] for r in mixing.mixed(docs, rate=corpus_pipeline.MIX_RATE).where("__kept").collect()}
        docs = spark.createDataFrame(out.collect(), out.schema)
    tok, at, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, {}
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        x = np.array([*tok.encode(r["text"], add_special_tokens=False).ids, 0], "<u4")
        want[r["doc_id"]] = (at, len(x), zlib.crc32(x.tobytes()))
        at += len(x)
    assert got == want
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == set(want)


def test_odd_tables(spark):
    """Nulls, empty, long and repeated texts, clashing names and an empty table pass every stage."""
    some = table(spark, SF, "documents").limit(60).collect()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], 1.5, i, "x", "y") for i, r in enumerate(some)]
    odd = [(None, None), (None, "a b"), (10**6, None), (10**6, ""), (10**6 + 1, "word " * 50_000), (some[0]["doc_id"], some[0]["text"]), (some[0]["doc_id"], "other words here " * 9), (-5, "\n\t ")]
    rows += [(i, t, None, None, None, None, 100 + k, None, None) for k, (i, t) in enumerate(odd)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, __words int, __id string, __leaks string")
    given = {tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, docs, SF), stage(spark, docs.limit(0), SF)
        assert none.count() == 0
        if name == "token_ids":
            assert out.count() == len(given)
        else:
            kept = [tuple(r) for r in out.collect()]
            assert out.columns == docs.columns == none.columns and len(kept) == len(set(kept)) and set(kept) <= given
            if name == "near_duplicates":  # of the two rows of one id and text one stays, rows without words all stay
                assert len([r for r in kept if r[:2] == (some[0]["doc_id"], some[0]["text"])]) == 1 and len([r for r in kept if not (r[1] or "").strip()]) == 4
