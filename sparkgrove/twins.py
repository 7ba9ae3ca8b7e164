"""SQL twins of training: whole boosting runs as one statement of common table expressions.

Rows that agree in features and label have equal margins, so they are counted once and
weighted by their number. Nodes are numbered as in a heap (the children of n are 2n and
2n + 1); each step finds the best split of every open node by running sums over the values
of each feature, and rows move on by a join with the splits. Features must have at most
max_bin distinct values, so that every value is a cut.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Loss:
    """g, h: terms of each output over m0.., y and, if scaled, the round's s0..; start: first
    margins as aggregates over rows of weight n; newton: one Newton step follows them."""

    g: tuple[str, ...]
    h: tuple[str, ...]
    start: tuple[str, ...]
    metric: str
    value: str
    scaled: bool = False
    newton: bool = False


_P = "(1 / (1 + exp(-m0)))"
LOGISTIC = Loss((f"{_P} - y",), (f"{_P} * (1 - {_P})",), ("-ln(1 / (sum(n * y) / sum(n)) - 1)",), "logloss", f"sum(n * -(y * ln({_P}) + (1 - y) * ln(1 - {_P}))) / sum(n)")
SQUARED = Loss(("m0 - y",), ("1.0::DOUBLE",), ("sum(n * y) / sum(n)",), "rmse", "sqrt(sum(n * (m0 - y) * (m0 - y)) / sum(n))")
ABSOLUTE = Loss(("(m0 - y) * s0 / sqrt(s0 * s0 + (m0 - y) * (m0 - y))",), ("s0 / sqrt(s0 * s0 + (m0 - y) * (m0 - y))",), SQUARED.start, "mae", "sum(n * abs(m0 - y)) / sum(n)", True, True)


def softmax(k: int) -> Loss:
    z = " + ".join(f"exp(m{j})" for j in range(k))
    prior = [f"ln(greatest(sum(CASE WHEN y = {j} THEN n ELSE 0 END) / sum(n), 1e-6))" for j in range(k)]
    mean = f"(({' + '.join(prior)}) / {k})"
    own = "CASE y " + " ".join(f"WHEN {j} THEN m{j}" for j in range(k)) + " END"
    return Loss(tuple(f"exp(m{j}) / ({z}) - CASE WHEN y = {j} THEN 1 ELSE 0 END" for j in range(k)), tuple(f"2 * exp(m{j}) / ({z}) * (1 - exp(m{j}) / ({z}))" for j in range(k)),
                tuple(f"{p} - {mean}" for p in prior), "mlogloss", f"sum(n * (ln({z}) - {own})) / sum(n)")


def quantiles(low: float, high: float) -> Loss:
    x = [f"((m{j} - y) / (0.04 * s{j}))" for j in (0, 1)]
    miss = [f"CASE WHEN y >= {p} THEN {a} * (y - {p}) ELSE (1 - {a}) * ({p} - y) END" for p, a in (("least(m0, m1)", low), ("greatest(m0, m1)", high))]
    return Loss(tuple(f"0.5 * s{j} * (tanh({x[j]}) + 1 - 2 * {a})" for j, a in enumerate((low, high))), tuple(f"greatest(CASE WHEN {v} = 0 THEN 1 ELSE tanh({v}) / {v} END, 3e-4) / 0.08" for v in x),
                ("max(0.0::DOUBLE)", "max(0.0::DOUBLE)"), "quantile", f"sum(n * ({miss[0]} + {miss[1]}) / 2) / sum(n)", True, True)


def boosted(source: str, features: int, loss: Loss, rounds: int, steps: int, eta: float = 0.3, vector: bool = False, best_first: bool = False,
            monotone: dict[int, int] | None = None, sets: dict[int, int] | None = None) -> str:
    """source gives f0.., y. The metric of each round on the training rows, in the rows of a
    training history. steps: levels, or with best_first single splits. monotone: feature ->
    sign; sets: feature -> its (disjoint) interaction set."""
    k, ctes = len(loss.g), []
    each = lambda form, ts=range(k), by=", ": by.join(form.format(t=t) for t in ts)

    def cte(name: str, body: str) -> str:
        ctes.append(f"{name} AS MATERIALIZED ({body})")
        return name

    def graded(rows: str, name: str) -> str:
        if loss.scaled:
            cte(f"{name}_s", f"SELECT {each('pow(sum(n * sqrt(abs(m{t} - y))) / sum(n), 2) AS s{t}')} FROM {rows}")
        terms = ", ".join(f"n * ({g}) AS g{t}, n * ({h}) AS h{t}" for t, (g, h) in enumerate(zip(loss.g, loss.h)))
        return cte(name, f"SELECT {rows}.*, {terms} FROM {rows}" + (f", {name}_s" if loss.scaled else ""))

    keys = ", ".join([*(f"f{i}" for i in range(features)), "y", "n"])
    cte("src", f"SELECT {keys[:-3]}, CAST(count(*) AS DOUBLE) AS n FROM ({source}) GROUP BY ALL")
    cte("base", "SELECT " + ", ".join(f"{s} AS m{t}" for t, s in enumerate(loss.start)) + " FROM src")
    rows = cte("r0", f"SELECT {keys}, {each('m{t}')} FROM src, base")
    if loss.newton:
        first = graded(rows, "c_first")
        cte("step", f"SELECT {each('sum(g{t}) / sum(h{t}) AS d{t}')} FROM {first}")
        rows = cte("r0n", f"SELECT {keys}, {each('m{t} - d{t} AS m{t}')} FROM r0, step")
    found = []
    for r in range(rounds):
        c, margins = graded(rows, f"c{r}"), [f"m{t}" for t in range(k)]
        for j, ts in enumerate([range(k)] if vector else [[t] for t in range(k)]):
            at = cte(f"a{r}_{j}_0", f"SELECT *, 1 AS node, CAST('-inf' AS DOUBLE) AS lo, CAST('inf' AS DOUBLE) AS hi, NULL::INTEGER AS grp FROM {c}")
            for s in range(steps):
                at = _level(cte, each, at, f"a{r}_{j}_{s + 1}", features, ts, 0 if best_first else 2**s, best_first, monotone or {}, sets or {})
            leaf = ", ".join(f"m{t} + {eta} * {_weight(f'(sum(g{t}) OVER (PARTITION BY node))', f'(sum(h{t}) OVER (PARTITION BY node))')} AS m{t}" for t in ts)
            kept = ", ".join([*(f"m{t}" for t in range(k) if t not in ts), *(f"{x}{t}" for t in range(k) for x in "gh")])
            c = cte(f"d{r}_{j}", f"SELECT {keys}, {leaf}, {kept} FROM {at}")
        rows = cte(f"r{r + 1}", f"SELECT {keys}, {', '.join(margins)} FROM {c}")
        found.append(f"SELECT 'train' AS data, '{loss.metric}' AS metric, {r} AS round, round({loss.value}, 6) AS value FROM {rows}")
    return "WITH " + ",\n ".join(ctes) + "\n" + " UNION ALL ".join(found)


def _weight(g: str, h: str) -> str:
    return f"least(greatest(-{g} / ({h} + 1), lo), hi)"


def _gain(g: str, h: str) -> str:
    w = _weight(g, h)
    return f"-(2 * {g} * {w} + ({h} + 1) * {w} * {w})"


def _level(cte, each, at: str, name: str, features: int, ts, least_node: int, best_first: bool, monotone: dict, sets: dict) -> str:
    by = lambda form, sep=", ": each(form, ts, sep)
    cells = " UNION ALL ".join(f"SELECT node, {i} AS fidx, f{i} AS v, {by('g{t}, h{t}')} FROM {at}" for i in range(features))
    cte(f"{name}_x", f"SELECT node, fidx, v, {by('sum(g{t}) AS g{t}, sum(h{t}) AS h{t}')} FROM ({cells}) WHERE v IS NOT NULL GROUP BY node, fidx, v")
    cte(f"{name}_t", f"SELECT node, any_value(lo) AS lo, any_value(hi) AS hi, any_value(grp) AS grp, {by('sum(g{t}) AS tg{t}, sum(h{t}) AS th{t}')} FROM {at} WHERE node >= {least_node} GROUP BY node")
    w = "(PARTITION BY node, fidx ORDER BY v)"
    cte(f"{name}_c", f"SELECT *, max(v) OVER (PARTITION BY node, fidx) AS top, {by(f'sum(g{{t}}) OVER {w} AS cg{{t}}, sum(h{{t}}) OVER {w} AS ch{{t}}, sum(g{{t}}) OVER (PARTITION BY node, fidx) AS sg{{t}}, sum(h{{t}}) OVER (PARTITION BY node, fidx) AS sh{{t}}')} FROM {name}_x JOIN {name}_t USING (node)")
    side = "SELECT node, fidx, v, {d} AS dir, lo, hi, grp, {terms}, {tot} FROM {name}_c {where}"
    tot, lost = by("tg{t}, th{t}"), by("abs(sh{t} - th{t}) > 1e-9", " OR ")
    right = side.format(d=0, terms=by("cg{t} AS gl{t}, ch{t} AS hl{t}, tg{t} - cg{t} AS gr{t}, th{t} - ch{t} AS hr{t}"), tot=tot, name=name, where="")
    left = side.format(d=1, terms=by("tg{t} - sg{t} + cg{t} AS gl{t}, th{t} - sh{t} + ch{t} AS hl{t}, sg{t} - cg{t} AS gr{t}, sh{t} - ch{t} AS hr{t}"), tot=tot, name=name, where=f"WHERE v < top AND ({lost})")
    gain = " + ".join(f"{_gain(f'gl{t}', f'hl{t}')} + {_gain(f'gr{t}', f'hr{t}')} - ({_gain(f'tg{t}', f'th{t}')})" for t in ts)
    valid = [f"{by(c, ' + ')} >= {len(ts)}" for c in ("hl{t}", "hr{t}")]
    wl, wr = _weight(f"gl{ts[0]}", f"hl{ts[0]}"), _weight(f"gr{ts[0]}", f"hr{ts[0]}")
    valid += [f"(fidx <> {f} OR {wl} {'<=' if m > 0 else '>='} {wr})" for f, m in monotone.items()]
    group = "CASE fidx " + " ".join(f"WHEN {f} THEN {g}" for f, g in sets.items()) + " END" if sets else "NULL::INTEGER"
    if sets:
        valid.append(f"(grp IS NULL OR grp = {group})")
    order = "round(gain, 9) DESC, fidx, dir, CASE WHEN dir = 0 THEN v ELSE -v END"
    first = f"ORDER BY {'round(gain, 9) DESC, node' if best_first else 'node'}" + (" LIMIT 1" if best_first else "")
    cte(f"{name}_b", f"SELECT node, fidx, v, dir, ({wl} + {wr}) / 2 AS mid, {group} AS own FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY {order}) AS nth FROM (SELECT *, {gain} AS gain FROM ({right} UNION ALL {left}) WHERE {' AND '.join(valid)})) WHERE nth = 1 AND gain > 1e-6 {first}")
    value = "CASE b.fidx " + " ".join(f"WHEN {i} THEN f{i}" for i in range(features)) + " END"
    goes = f"(CASE WHEN {value} IS NULL THEN 1 - b.dir WHEN {value} <= b.v THEN 0 ELSE 1 END)"
    ups, downs = [f for f, m in monotone.items() if m > 0], [f for f, m in monotone.items() if m < 0]
    bounded = lambda up, down: " OR ".join([*(f"(b.fidx = {f} AND {goes} = {up})" for f in ups), *(f"(b.fidx = {f} AND {goes} = {down})" for f in downs)]) or "FALSE"
    return cte(name, f"SELECT a.* EXCLUDE (node, lo, hi, grp), CASE WHEN b.node IS NULL THEN a.node ELSE 2 * a.node + {goes} END AS node, CASE WHEN {bounded(1, 0)} THEN b.mid ELSE a.lo END AS lo, CASE WHEN {bounded(0, 1)} THEN b.mid ELSE a.hi END AS hi, coalesce(a.grp, b.own) AS grp FROM {at} a LEFT JOIN {name}_b b ON a.node = b.node")


def linear(source: str, features: int, rounds: int, eta: float = 0.5) -> str:
    """Coordinate descent of a squared loss, feature after feature; missing cells are 0."""
    x = [f"coalesce(f{i}, 0)" for i in range(features)]
    ctes = [f"src AS MATERIALIZED (SELECT *, CAST(count(*) AS DOUBLE) AS n FROM ({source}) GROUP BY ALL)", "r0 AS MATERIALIZED (SELECT *, (SELECT sum(n * y) / sum(n) FROM src) AS m0 FROM src)"]
    found = []
    for r in range(rounds):
        sums = ["sum(n * (m0 - y)) AS g", "sum(n) AS h", *(f"sum(n * (m0 - y) * {a}) AS g{i}, sum(n * {a}) AS h{i}" for i, a in enumerate(x)), *(f"sum(n * {x[i]} * {x[j]}) AS h{i}_{j}" for i in range(features) for j in range(i + 1))]
        ctes.append(f"s{r} AS MATERIALIZED (SELECT *, -{eta} * g / h AS b FROM (SELECT {', '.join(sums)} FROM r{r}))")
        last = f"s{r}"
        for i in range(features):
            past = "".join(f" + d{j} * h{i}_{j}" for j in range(i))
            ctes.append(f"{last}_{i} AS MATERIALIZED (SELECT *, -{eta} * (g{i} + b * h{i}{past}) / h{i}_{i} AS d{i} FROM {last})")
            last = f"{last}_{i}"
        move = " + ".join(f"d{i} * {a}" for i, a in enumerate(x))
        ctes.append(f"r{r + 1} AS MATERIALIZED (SELECT r{r}.* EXCLUDE (m0), m0 + b + {move} AS m0 FROM r{r}, {last})")
        found.append(f"SELECT 'train' AS data, '{SQUARED.metric}' AS metric, {r} AS round, round({SQUARED.value}, 6) AS value FROM r{r + 1}")
    return "WITH " + ",\n ".join(ctes) + "\n" + " UNION ALL ".join(found)


def stopped(history: str, patience: int) -> str:
    """The rounds of a history, of a metric that falls, up to the stop of early stopping."""
    seen = f"h AS ({history}), s AS (SELECT *, value < coalesce(min(value) OVER (ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), CAST('inf' AS DOUBLE)) AS better FROM h), " \
           f"w AS (SELECT *, round - max(CASE WHEN better THEN round ELSE -1 END) OVER (ORDER BY round) AS waited FROM s)"
    return f"WITH {seen} SELECT data, metric, round, value FROM w WHERE round <= coalesce((SELECT min(round) FROM w WHERE waited >= {patience}), (SELECT max(round) FROM w))"
