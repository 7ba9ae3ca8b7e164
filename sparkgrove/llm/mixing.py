"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed into cells (source, language, topic). Cell weights are raked
in turn to the target shares of each dimension for a fixed number of rounds; a
document is then kept with probability min(1, c * weight / tokens of its cell), with
c set so that about `rate` of all tokens are kept, by a hash of its doc_id. DataFrame
operations throughout.

Targets default to the tempered shares of the data, share^temper, scaled to sum 1.
The topic is the form of the text (empty, table, shout, marked, short, medium, long).

Up to SMALL_CELLS cells (counted first) the rounds run in one small task; beyond
that each step is a grouped sum joined back, and rounds are written to the shared
folder. Documents reach their cell's factor by a join on the cell key.

Defined results: a null source or lang counts as ''; null, empty and blank texts have
no words, topic 'empty' and weigh one token; a null doc_id is hashed as ''; repeated
rows are decided alike; an empty table gives no rows; a target that names no cell is
left out and the others are scaled; further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shielded, written

DIMS = ("source", "lang", "topic")
SMALL_CELLS, ROUNDS, TEMPER, RATE, FILL_STEPS = 100_000, 12, 0.7, 0.8, 12
MARKS = "#$%&*"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def with_cell(docs: DataFrame) -> DataFrame:
    """docs with __source, __lang, __topic and __words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # marks are ASCII: bytes tell their number, and replace() only searches where translate() looks each character up
    chars = lambda marks: sum((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(m), F.lit(""))) for m in marks), F.lit(0))
    d = docs.withColumn("__words", word_count(text)).withColumn("__source", F.coalesce(F.col("source").cast("string"), F.lit(""))).withColumn("__lang", F.coalesce(F.col("lang").cast("string"), F.lit("")))
    w = F.col("__words")
    topic = (F.when(w == 0, "empty").when(chars("|") * 5 >= w, "table").when(chars("!") >= w, "shout").when(chars(MARKS) * 2 >= w, "marked")
             .when(w < 150, "short").when(w < 1000, "medium").otherwise("long"))
    return d.withColumn("__topic", topic)


def default_targets(cells: DataFrame, dim: str, temper: float = TEMPER) -> DataFrame:
    return cells.groupBy(dim).agg(F.pow(F.sum("tokens").cast("double"), F.lit(temper)).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """cells(source, lang, topic, tokens) -> the same with weight; the weights' total is 1
    and their sums over the last raked dimension are the targets."""
    cells = written(cells, "mix_cells")
    small = cells.limit(SMALL_CELLS + 1).count() <= SMALL_CELLS
    state = cells
    for d in DIMS:
        state = state.join(targets[d].select(d, F.col("share").cast("double").alias(f"t_{d}")), d, "left").withColumn(f"t_{d}", F.coalesce(f"t_{d}", F.lit(0.0)))
    state = written(state.withColumn("weight", F.col("tokens").cast("double")), "mix_state")
    for k in range(rounds):
        if small and k % 4 == 0:
            state = state.coalesce(1)
        for d in DIMS:
            if small:
                now = F.sum("weight").over(Window.partitionBy(d))
                state = state.withColumn("weight", F.when(now > 0, F.col("weight") * F.col(f"t_{d}") / now).otherwise(0.0))
            else:
                sums = state.groupBy(d).agg(F.sum("weight").alias("now"))
                state = state.join(sums, d).withColumn("weight", F.when(F.col("now") > 0, F.col("weight") * F.col(f"t_{d}") / F.col("now")).otherwise(0.0)).drop("now")
        if not small or k % 4 == 3 or k == rounds - 1:
            state = written(state, "mix_state")
    total = state.agg(F.sum("weight").alias("total"))
    return state.crossJoin(F.broadcast(total)).withColumn("weight", F.when(F.col("total") > 0, F.col("weight") / F.col("total")).otherwise(0.0)).select(*DIMS, "tokens", "weight")


def calibrate(cells: DataFrame, rate: float = RATE) -> DataFrame:
    """cells with weight -> (source, lang, topic, probability). c rises until the kept
    tokens reach the rate; each step is one sum over the cells."""
    f = F.col("weight") / F.col("tokens")
    all_tokens = cells.agg(F.sum("tokens").alias("t"), F.sum("weight").alias("w")).first()
    c = rate * float(all_tokens["t"] or 0) / float(all_tokens["w"] or 1.0)
    for _ in range(FILL_STEPS):
        full = F.lit(c) * f >= 1
        got = cells.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("rest")).first()
        if not got["rest"] or got["rest"] <= 0:
            break
        c = max(c, (rate * float(all_tokens["t"]) - float(got["full"])) / float(got["rest"]))
    return cells.select(*DIMS, F.round(F.least(F.lit(1.0), F.lit(c) * f), 9).alias("probability"))


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) from the id alone."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def decided(docs: DataFrame, targets: dict[str, DataFrame] | None = None, rate: float = RATE) -> DataFrame:
    """Per row of docs: doc_id, __source, __lang, __topic, __words, __probability, __kept. The
    texts are read once: what is measured on them is written as a table."""
    d = written(with_cell(docs).select("doc_id", "__source", "__lang", "__topic", "__words"), "mix_measured")
    return _with_probability(d, targets, rate)


def mixed(docs: DataFrame, targets: dict[str, DataFrame] | None = None, rate: float = RATE) -> DataFrame:
    """docs with __source, __lang, __topic, __words, __probability and __kept."""
    return _with_probability(with_cell(docs), targets, rate)


def _with_probability(d: DataFrame, targets: dict[str, DataFrame] | None, rate: float) -> DataFrame:
    cells = d.groupBy(F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic")).agg(F.sum(F.greatest(F.col("__words"), F.lit(1))).alias("tokens"))
    cells = written(cells, "mix_counts")
    found = calibrate(rake(cells, {k: (targets or {}).get(k, default_targets(cells, k)) for k in DIMS}), rate)
    found = written(found.select(*(F.col(k).alias(f"__{k}") for k in DIMS), F.col("probability").alias("__probability")), "mix_found")
    return d.join(found, [f"__{k}" for k in DIMS]).withColumn("__kept", draw(F.col("doc_id")) < F.col("__probability"))


def sample(docs: DataFrame, targets: dict[str, DataFrame] | None = None, rate: float = RATE) -> DataFrame:
    """The documents that are kept, with the columns of docs, whatever their names."""
    inner, restored = shielded(docs)
    return restored(mixed(inner, targets, rate).where("__kept"))


def oracle_ctes(docs: str, rate: float = RATE, rounds: int = ROUNDS) -> str:
    """DuckDB CTEs that end in mix_kept: the rows of docs with their probability."""
    count = lambda m: f"(length(t) - length(translate(t, '{m}', '')))"
    parts = [
        f"mix_text AS (SELECT *, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS w_ FROM {docs})",
        f"""mix_docs AS (SELECT *, coalesce(CAST(source AS VARCHAR), '') AS s_, coalesce(CAST(lang AS VARCHAR), '') AS l_, CASE WHEN w_ = 0 THEN 'empty' WHEN {count('|')} * 5 >= w_ THEN 'table'
      WHEN {count('!')} >= w_ THEN 'shout' WHEN {count(MARKS)} * 2 >= w_ THEN 'marked' WHEN w_ < 150 THEN 'short' WHEN w_ < 1000 THEN 'medium' ELSE 'long' END AS o_ FROM mix_text)""",
        "mix_0 AS (SELECT s_, l_, o_, sum(greatest(w_, 1)) AS tokens, CAST(sum(greatest(w_, 1)) AS DOUBLE) AS weight FROM mix_docs GROUP BY ALL)",
    ]
    for k in "slo":
        parts.append(f"mix_t{k} AS (SELECT {k}_, pow(CAST(sum(tokens) AS DOUBLE), {TEMPER}) AS share FROM mix_0 GROUP BY 1)")
    last = "mix_0"
    for r in range(rounds):
        for k in "slo":
            name = f"mix_{r}{k}"
            parts.append(f"{name} AS MATERIALIZED (SELECT c.s_, c.l_, c.o_, tokens, weight * share / sum(weight) OVER (PARTITION BY c.{k}_) AS weight FROM {last} c JOIN mix_t{k} t ON c.{k}_ = t.{k}_)")
            last = name
    parts.append(f"mix_w AS MATERIALIZED (SELECT s_, l_, o_, tokens, weight / sum(weight) OVER () AS weight, sum(tokens) OVER () AS total FROM {last})")
    parts.append(f"mix_c0 AS MATERIALIZED (SELECT {rate} * max(total) / sum(weight) AS c FROM mix_w)")
    for i in range(FILL_STEPS):
        parts.append(f"""mix_c{i + 1} AS MATERIALIZED (SELECT CASE WHEN sum(CASE WHEN c * weight / tokens >= 1 THEN 0 ELSE weight END) > 0 THEN greatest(max(c),
      ({rate} * max(total) - sum(CASE WHEN c * weight / tokens >= 1 THEN tokens ELSE 0 END)) / sum(CASE WHEN c * weight / tokens >= 1 THEN 0 ELSE weight END)) ELSE max(c) END AS c FROM mix_w, mix_c{i})""")
    parts.append(f"mix_p AS MATERIALIZED (SELECT s_, l_, o_, round(least(1.0, c * (weight / tokens)), 9) AS p_ FROM mix_w, mix_c{FILL_STEPS})")
    parts.append("mix_kept AS (SELECT d.*, p.p_, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) / 4294967296.0 < p.p_ AS kept_ FROM mix_docs d JOIN mix_p p ON d.s_ = p.s_ AND d.l_ = p.l_ AND d.o_ = p.o_)")
    return ",\n".join(parts)
