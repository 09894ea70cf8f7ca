"""Mixing sources to target weights by iterative proportional fitting (operator 1, native).

Token counts by (source, language, topic) are raked until their sums over each of the three match target shares: each
step scales the cells of one value to its target, for the three in turn, until no sum of any of them is off by more than
``TOLERANCE`` of its target. Targets that can't be met together stop the raking when it no longer comes nearer, or after ``ROUNDS``, with a warning that names what is left.
A cell's rate is its raked weight by its tokens. A cell gives at most its
tokens, so a second raking is bounded: each step gives the cells of one value the factor at which their tokens, full cells held at what
they have, meet the value's share of ``budget`` tokens; documents are then drawn with the probability of their cell. A value with
fewer tokens than its share gives all of them, and the other values share the rest by their targets.
Small tables of cells, up to ``LOCAL``, are raked within one row by array functions, larger ones by windows over the values; both compare sums
with targets after the same rounds and end by the same rule, so the results are the same, also where targets can't be met. ``residual`` tells by how much they are missed.
The draw compares the probability with a digest of doc_id and seed, so it is the same on any cluster.

The default target of a value is its share of tokens to the power ``temperature``, normalised, which lifts small sources.
Explicit targets are given by value; values without one get nothing. Only the table of cells is raked, by windows over the values of a dimension; it grows with the metadata,
not with the documents, and is broadcast only if it has at most ``BROADCAST_CELLS`` rows; beyond that it is joined by a shuffle.

Cases: null source, lang and topic are values of their own, told from all texts but the single character U+0000, which counts as null; rows of one
doc_id share a draw, so those with a null one are drawn or left together; doc_id may be of any type; null, empty and white texts have no tokens, and a cell
without tokens has rate 0; repeated rows are drawn alike; an empty table gives no rows; further columns aren't touched.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.common import WORD, columns_of, fresh, settle, text_of

DIMENSIONS = ("source", "lang", "topic")
TEMPERATURE, BUDGET, SEED = 0.7, 0.6, "mix-1"
ROUNDS, TOLERANCE = 1000, 1e-12
#: After so many rounds sums are compared with their targets; raking ends where they meet, or are hardly nearer than at the last comparison.
STRIDE, GAIN = 5, 0.999
BROADCAST_CELLS = 100_000
NONE = "\x00"


def topic_of(text: Column) -> Column:
    """A topic by the form of the text: the first that applies."""
    return (
        F.when(text.contains(" | "), "tables")
        .when(F.lower(text).contains("licens"), "legal")
        .when(text.contains("@") | text.contains("://"), "contacts")
        .when(text.contains("\n"), "articles")
        .otherwise("notes")
    )


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the three dimensions and n_tokens."""
    text = text_of()
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(c)
    return docs.select("doc_id", plain("source"), plain("lang"), topic_of(text).alias("topic"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_tokens"))


def _off(cells: DataFrame, value: Column, aim: str) -> float:
    """By how much the sums of value over any of the dimensions miss their aims, as a part of these; aims of values without tokens don't count."""
    parts = [
        cells.groupBy(d).agg(F.max("tokens").alias("t"), (F.abs(F.sum(value) - F.first(f"{aim}_{d}")) / F.greatest(F.first(f"{aim}_{d}"), F.lit(1e-9))).alias("off")).filter("t > 0").select("off")
        for d in DIMENSIONS
    ]
    return float(parts[0].unionByName(parts[1]).unionByName(parts[2]).agg(F.max("off")).first()[0] or 0)


def _until_settled(cells: DataFrame, step: Callable[[DataFrame, str], DataFrame], value: Column, aim: str, rounds: int, tolerance: float) -> DataFrame:
    """cells after as many rounds of steps, one for each dimension, as it takes."""
    off = math.inf
    for k in range(rounds):
        for d in DIMENSIONS:
            cells = step(cells, d)
        if k % STRIDE == STRIDE - 1 or k == rounds - 1:
            cells = settle(cells)
            before, off = off, _off(cells, value, aim)
            if off <= tolerance or off >= before * GAIN:
                break
    if off > tolerance:
        warnings.warn(f"raking ended while a sum is off by {off:.3g} of its target", stacklevel=3)
    return _with_residual(cells, off)


def _with_residual(cells: DataFrame, off: float) -> DataFrame:
    """cells with residual: by how much a sum misses its target at most, after this raking or one before."""
    known = F.col("residual") if "residual" in cells.columns else F.lit(0.0)
    return cells.withColumn("residual", F.greatest(known, F.lit(float(off))))


# Tables of at most LOCAL cells are raked within one row: c holds the cells in order, and of each dimension d the arrays k_d (a cell's value, by number), g_d (a value's cells) and t_d
# (its aim). All rounds are one expression, so their number costs no jobs. w stands for the cells' weights, tk for their tokens.
LOCAL = 5000


def _one_row(cells: DataFrame) -> DataFrame:
    """One row with c, tk, w and, for each dimension, k_d and g_d; settled, so that what is made of them isn't made again for every use."""
    others = [c for c in cells.columns if c not in DIMENSIONS]
    row = settle(cells.agg(F.array_sort(F.collect_list(F.struct(*DIMENSIONS, *others))).alias("c")))
    row = row.withColumns({f"v_{d}": F.expr(f"array_sort(array_distinct(transform(c, x -> x.{d})))") for d in DIMENSIONS})
    row = row.withColumns(
        {f"k_{d}": F.expr(f"transform(c, x -> cast(array_position(v_{d}, x.{d}) as int) - 1)") for d in DIMENSIONS}
        | {f"g_{d}": F.expr(f"transform(v_{d}, v -> filter(sequence(0, size(c) - 1), i -> c[i].{d} = v))") for d in DIMENSIONS}
        | {"tk": F.expr("transform(c, x -> cast(x.tokens as double))"), "w": F.expr("transform(c, x -> cast(x.weight as double))")}
    )
    return settle(row.drop(*(f"v_{d}" for d in DIMENSIONS)))


def _sums(d: str, value: str) -> str:
    """Of each value of d, the sum of value over its cells i."""
    return f"transform(g_{d}, g -> aggregate(g, 0D, (s, i) -> s + {value}))"


def _rounds(factor: Callable[[str, str], str], new: str, value: str, rounds: int, tolerance: float) -> str:
    """The expression of all rounds: struct(w, off). factor(d, w): of each value of d; new: a cell's weight by x, its factor f, and i; value: what sums to aims, by w and i."""
    steps, w = "", "a.w"
    for n, d in enumerate(DIMENSIONS):
        steps += f"transform(array(transform(array({factor(d, w)}), z -> transform({w}, (x, i) -> {new.format(f=f'z[k_{d}[i]]')}))[0]), w{n} -> "
        w = f"w{n}"
    off = ", ".join(f"array_max(transform(zip_with(g_{d}, {_sums(d, value.format(w=w))}, (g, s) -> struct(g, s)), (y, k) -> if(exists(y.g, i -> tk[i] > 0), abs(y.s - t_{d}[k]) / greatest(t_{d}[k], 1e-9D), 0D)))" for d in DIMENSIONS)
    # The rule of _until_settled: sums are compared every few rounds, and the last comparison may end it.
    ended = f"o <= {tolerance!r}D OR o >= a.off * {GAIN!r}D"
    compared = f"transform(array(greatest({off})), o -> named_struct('w', {w}, 'off', o, 'ended', {ended}))[0]"
    steps += f"if(r % {STRIDE} = 0 OR r = {rounds}, {compared}, named_struct('w', {w}, 'off', a.off, 'ended', false))" + ")[0]" * len(DIMENSIONS)
    start = "named_struct('w', w, 'off', cast('Infinity' as double), 'ended', false)"
    return f"aggregate(sequence(1, {rounds}), {start}, (a, r) -> if(a.ended, a, {steps}))"


def _back(row: DataFrame, more: dict[str, str], tolerance: float) -> DataFrame:
    """The cells with the weights of out, and more columns by cell i; row has c and out."""
    row = settle(row)
    off = row.first()["out"]["off"]
    if off > tolerance:
        warnings.warn(f"raking ended while a sum is off by {off:.3g} of its target", stacklevel=4)
    cells = row.select("*", F.expr("posexplode(c)").alias("i", "x")).select("x.*", *(F.expr(v).alias(f"_{k}") for k, v in ({"weight": "out.w[i]"} | more).items()))
    for k in ("weight", *more):
        cells = cells.drop(k).withColumnRenamed(f"_{k}", k)
    return settle(_with_residual(cells, off))


def _rake_row(cells: DataFrame, rounds: int, tolerance: float) -> DataFrame:
    row = _one_row(cells)
    row = row.withColumns({f"t_{d}": F.expr(f"transform(g_{d}, g -> c[g[0]].want_{d})") for d in DIMENSIONS})
    program = _rounds(lambda d, w: f"zip_with({_sums(d, f'{w}[i]')}, t_{d}, (s, t) -> if(s > 0, t / s, 0D))", "x * {f}", "{w}[i]", rounds, tolerance)
    return _back(row.withColumn("out", F.expr(program)), {}, tolerance)


def _bound_row(cells: DataFrame, budget: float, rounds: int, tolerance: float) -> DataFrame:
    row = _one_row(cells).withColumn("amount", F.expr(f"least({budget!r}D * aggregate(tk, 0D, (s, x) -> s + x), aggregate(zip_with(tk, w, (t, x) -> if(x > 0, t, 0D)), 0D, (s, x) -> s + x))"))
    for d in DIMENSIONS:
        row = row.withColumn(f"v_{d}", F.expr(f"zip_with(g_{d}, {_sums(d, 'if(w[i] > 0, tk[i], 0D)')}, (g, h) -> named_struct('held', h, 'want', if(h > 0, c[g[0]].want_{d}, 0D)))"))
        # With values by falling need, the first of them full, the amount gives a scale; the first for which a value isn't full is the one. They are walked from the end.
        needs = f"array_sort(transform(filter(v_{d}, v -> v.held > 0 AND v.want > 0), v -> named_struct('need', v.want / v.held, 'held', v.held, 'want', v.want)))"
        all_ = f"aggregate(filter(v_{d}, v -> v.held > 0 AND v.want > 0), 0D, (s, v) -> s + v.held)"
        at = "(amount - (all_ - a.seen - v.held)) / (a.free + v.want)"
        row = row.withColumn("all_", F.expr(all_)).withColumn(
            f"s_{d}", F.expr(f"aggregate({needs}, named_struct('free', 0D, 'seen', 0D, 'scale', 1e300D), (a, v) -> named_struct('free', a.free + v.want, 'seen', a.seen + v.held, 'scale', if({at} * v.need < 1, {at}, a.scale)), a -> a.scale)")
        )
        row = row.withColumn(f"t_{d}", F.expr(f"transform(v_{d}, v -> least(v.held, v.want * s_{d}))"))
    row = settle(row.drop("all_", *(f"{x}_{d}" for x in "vs" for d in DIMENSIONS)))

    def factor(d: str, w: str) -> str:
        # With cells by falling rate, the first of them full, each number of full cells gives a factor; the largest is the one that fits. They are walked from the end.
        held = f"array_sort(transform(g, i -> named_struct('rate', if(tk[i] > 0, {w}[i] / tk[i], 0D), 'i', -i, 't', tk[i], 'w', {w}[i])))"
        step = "named_struct('free', b.free + e.w, 'seen', b.seen + e.t, 'best', if(b.free + e.w > 0, greatest(b.best, (aim - all_ + b.seen + e.t) / (b.free + e.w)), b.best))"
        step = step.replace("aim", f"t_{d}[k]").replace("all_", "y")
        walk = f"aggregate({held}, named_struct('free', 0D, 'seen', 0D, 'best', 0D), (b, e) -> {step}, b -> b.best)"
        return f"transform(g_{d}, (g, k) -> transform(array(aggregate(g, 0D, (s, i) -> s + tk[i])), y -> {walk})[0])"

    program = _rounds(factor, "least(x * {f}, tk[i] * 1e9D)", "least(tk[i], {w}[i])", rounds, tolerance)
    out = _back(row.withColumn("out", F.expr(program)), {"rate": "if(tk[i] > 0, w[i] / tk[i], 0D)", "prob": "if(tk[i] > 0, least(tk[i], out.w[i]) / tk[i], 0D)"}, tolerance)
    return out


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, temperature: float = TEMPERATURE, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """cells (dimensions, tokens) with weight: the raked tokens; their total is that of tokens."""
    total = F.lit(float(cells.agg(F.sum("tokens")).first()[0] or 0))
    out = cells.withColumn("weight", F.col("tokens").cast("double"))
    for d in DIMENSIONS:
        if given := (targets or {}).get(d):
            whole = sum(given.values())
            share = F.coalesce(F.create_map(*(F.lit(x) for k, v in given.items() for x in (k, v / whole)))[F.col(d)], F.lit(0.0))
            out = out.withColumn(f"want_{d}", total * share)
        else:
            sums = cells.groupBy(d).agg(F.sum("tokens").alias("t")).withColumn("p", F.when(F.col("t") > 0, F.pow(F.col("t").cast("double"), F.lit(temperature))).otherwise(0.0))
            whole = float(sums.agg(F.sum("p")).first()[0] or 0) or 1.0
            out = out.join(sums.select(d, (F.col("p") / F.lit(whole) * total).alias(f"want_{d}")), d)
    if 0 < cells.count() <= LOCAL:
        return _rake_row(out, rounds, tolerance)

    def step(now: DataFrame, d: str) -> DataFrame:
        held = F.sum("weight").over(Window.partitionBy(d))
        return now.withColumn("weight", F.when(held > 0, F.col("weight") * F.col(f"want_{d}") / held).otherwise(0.0))

    return _until_settled(out, step, F.col("weight"), "want", rounds, tolerance)


def _scale(rows: DataFrame, amount: float) -> float:
    """The factor of weight at which the rows' weights, each at most its tokens, add up to amount.

    Raising the scale fills rows up, and each step sets those aside that are full; every step is one small aggregate.
    """
    scale = 0.0
    for _ in range(1000):
        full = (F.col("weight") > 0) & (F.col("weight") * F.lit(scale) >= F.col("tokens"))
        held, free = rows.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not free:
            break
        new = (amount - float(held or 0)) / float(free)
        if new <= scale * (1 + 1e-12):
            break
        scale = new
    return scale


def _rate() -> Column:
    return F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)


def bounded(cells: DataFrame, budget: float, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Raked cells with rate, and prob: at most 1, for which budget of all tokens, or all that targets allow, is expected in target shares."""
    if 0 < cells.count() <= LOCAL:
        return _bound_row(cells, budget, rounds, tolerance)
    usable = F.when(F.col("weight") > 0, F.col("tokens")).otherwise(0)
    total, most = (float(x or 0) for x in cells.agg(F.sum("tokens"), F.sum(usable)).first())
    amount = min(budget * total, most)
    out = cells.withColumn("rate", _rate())
    for d in DIMENSIONS:
        values = settle(cells.groupBy(d).agg(F.sum(usable).alias("tokens"), F.first(f"want_{d}").alias("weight")).withColumn("weight", F.when(F.col("tokens") > 0, F.col("weight")).otherwise(0.0)))
        held = F.sum(usable).over(Window.partitionBy(d))
        out = out.withColumn(f"aim_{d}", F.least(held.cast("double"), F.col(f"want_{d}") * F.lit(_scale(values, amount))))
    taken = F.least(F.col("tokens").cast("double"), F.col("weight"))

    def step(now: DataFrame, d: str) -> DataFrame:
        # With cells by falling rate, the first of them full, each number of full cells gives a factor; the largest is the one that fits.
        order = Window.partitionBy(d).orderBy(_rate().desc(), *DIMENSIONS)
        full = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        free = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        now = now.withColumn("_factor", F.when(free > 0, (F.col(f"aim_{d}") - full) / free))
        factor = F.coalesce(F.max("_factor").over(Window.partitionBy(d)), F.lit(0.0))
        # Cells that can't meet their values' shares don't grow forever.
        return now.withColumn("weight", F.least(F.col("weight") * factor, F.col("tokens") * F.lit(1e9))).drop("_factor")

    out = _until_settled(out, step, taken, "aim", rounds, tolerance)
    return out.withColumn("prob", F.when(F.col("tokens") > 0, taken / F.col("tokens")).otherwise(0.0))


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) by doc_id and seed."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def probabilities(rows: DataFrame, targets: Mapping[str, Mapping[str, float]] | None, budget: float, temperature: float) -> DataFrame:
    """The table of cells of measured rows: dimensions, rate, prob and residual."""
    cells = settle(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")))
    return settle(bounded(rake(cells, targets, temperature), budget).select(*DIMENSIONS, "rate", "prob", "residual"))


def weigh(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, budget: float = BUDGET, temperature: float = TEMPERATURE, seed: str = SEED) -> DataFrame:
    """docs' doc_id, dimensions and n_tokens with rate, prob, residual and sampled.

    residual is the same in all rows: the largest part by which a marginal's sum misses its target; above 1e-9 targets can't be met together. Only the narrow table of these is kept, and the texts are read once."""
    rows = settle(measured(docs))
    cells = probabilities(rows, targets, budget, temperature)
    side = F.broadcast(cells) if cells.count() <= BROADCAST_CELLS else cells
    return rows.join(side, list(DIMENSIONS)).withColumn("sampled", draw(F.col("doc_id"), seed) < F.col("prob"))


def sample(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, budget: float = BUDGET, temperature: float = TEMPERATURE, seed: str = SEED) -> DataFrame:
    """The rows of docs that are drawn, with their columns."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
    *names, prob = fresh(docs, "_source", "_lang", "_topic", "_prob")
    keys = dict(zip(DIMENSIONS, names, strict=True))
    rows = docs.withColumns(dict(zip(names, (plain("source"), plain("lang"), topic_of(text_of())), strict=True)))
    cells = probabilities(measured(docs), targets, budget, temperature)
    cells = cells.select(*(F.col(k).alias(v) for k, v in keys.items()), F.col("prob").alias(prob))
    side = F.broadcast(cells) if cells.count() <= BROADCAST_CELLS else cells
    return rows.join(side, names).filter(draw(F.col("doc_id"), seed) < F.col(prob)).select(*columns_of(docs))


def sql() -> str:
    """DuckDB SQL: both rakings by recursion, until they have settled."""
    m = r"""m AS MATERIALIZED (SELECT doc_id, coalesce(source, chr(0)) AS source, coalesce(lang, chr(0)) AS lang,
  CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'tables' WHEN contains(lower(coalesce(text, '')), 'licens') THEN 'legal'
       WHEN contains(coalesce(text, ''), '@') OR contains(coalesce(text, ''), '://') THEN 'contacts' WHEN contains(coalesce(text, ''), chr(10)) THEN 'articles' ELSE 'notes' END AS topic,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents)"""
    parts = [m, "c AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM m GROUP BY ALL)"]
    for d in DIMENSIONS:
        parts.append(f"w_{d} AS MATERIALIZED (SELECT {d}, p / sum(p) OVER () * (SELECT sum(tokens) FROM c) AS want_{d} FROM (SELECT {d}, CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens), {TEMPERATURE}) ELSE 0 END AS p FROM c GROUP BY ALL))")
    off = lambda value, aim: "greatest(" + ", ".join(f"max(CASE WHEN tokens > 0 THEN abs(o_{d} - {aim}_{d}) / greatest({aim}_{d}, 1e-9) ELSE 0 END) OVER ()" for d in DIMENSIONS) + ")"
    sums = lambda value: ", ".join(f"sum({value}) OVER (PARTITION BY {d}) AS o_{d}" for d in DIMENSIONS)

    def until(name: str, start: str, step: str, value: str, aim: str) -> str:
        """A recursive table: step, by the dimension, goes from the rows of {rows} to those with a new weight."""
        rows = name
        for d in DIMENSIONS:
            rows = step.format(d=d, rows=rows)
            rows = f"({rows})"
        names = ", ".join(["source", "lang", "topic", "tokens", "rate", *(f"{aim}_{d}" for d in DIMENSIONS)])
        return f"{name} AS (SELECT 0 AS k, {names}, weight, 1::DOUBLE AS off FROM {start} UNION ALL SELECT k + 1, {names}, weight, {off(value, aim)} FROM (SELECT *, {sums(value)} FROM {rows}) WHERE k < {ROUNDS} AND off > {TOLERANCE})"

    parts.append("r0 AS (SELECT *, tokens AS weight, 0::DOUBLE AS rate FROM c JOIN w_source USING (source) JOIN w_lang USING (lang) JOIN w_topic USING (topic))")
    parts.append(until("r", "r0", "SELECT * REPLACE (CASE WHEN sum(weight) OVER (PARTITION BY {d}) > 0 THEN weight * want_{d} / sum(weight) OVER (PARTITION BY {d}) ELSE 0 END AS weight) FROM {rows}", "weight", "want"))
    parts.append("raked AS MATERIALIZED (SELECT * EXCLUDE (rate), CASE WHEN tokens > 0 THEN weight / tokens ELSE 0 END AS rate, CASE WHEN weight > 0 THEN tokens ELSE 0 END AS usable FROM r WHERE k = (SELECT max(k) FROM r))")
    parts.append(f"amount AS (SELECT least({BUDGET} * sum(tokens), sum(usable)) AS amount FROM raked)")
    for d in DIMENSIONS:
        # With values by falling need, the first of them full, the amount gives a scale; the first for which a value isn't full is the one.
        parts.append(f"v_{d} AS (SELECT {d}, sum(usable) AS held, CASE WHEN sum(usable) > 0 THEN max(want_{d}) ELSE 0 END AS want FROM raked GROUP BY ALL)")
        parts.append(f"n_{d} AS (SELECT *, want / held AS need, coalesce(sum(held) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_, sum(want) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM v_{d} WHERE held > 0 AND want > 0 WINDOW w AS (ORDER BY want / held DESC, {d}))")
        parts.append(f"x_{d} AS (SELECT (amount - full_) / free AS scale FROM n_{d}, amount WHERE (amount - full_) / free * need < 1 ORDER BY need DESC, {d} LIMIT 1)")
        parts.append(f"a_{d} AS (SELECT {d}, least(held, want * coalesce((SELECT scale FROM x_{d}), 1e300)) AS aim_{d} FROM v_{d})")
    parts.append("b0 AS (SELECT source, lang, topic, tokens, rate, weight, aim_source, aim_lang, aim_topic FROM raked JOIN a_source USING (source) JOIN a_lang USING (lang) JOIN a_topic USING (topic))")
    now = "CASE WHEN tokens > 0 THEN weight / tokens ELSE 0 END"
    full = f"coalesce(sum(tokens) OVER (PARTITION BY {{d}} ORDER BY {now} DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    free = f"sum(weight) OVER (PARTITION BY {{d}} ORDER BY {now} DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    step = f"SELECT * EXCLUDE (full_, free) REPLACE (least(weight * coalesce(max(CASE WHEN free > 0 THEN (aim_{{d}} - full_) / free END) OVER (PARTITION BY {{d}}), 0), tokens * 1e9) AS weight) FROM (SELECT *, {full} AS full_, {free} AS free FROM {{rows}})"
    parts.append(until("b", "b0", step, "least(tokens, weight)", "aim"))
    parts.append("s AS MATERIALIZED (SELECT source, lang, topic, rate, CASE WHEN tokens > 0 THEN least(tokens, weight) / tokens ELSE 0 END AS prob FROM b WHERE k = (SELECT max(k) FROM b))")
    return f"""WITH RECURSIVE {", ".join(parts)}
SELECT doc_id, source, lang, topic, n_tokens, round(rate, 6) AS rate, round(prob, 6) AS prob,
       ('0x' || substr(md5('{SEED}:' || doc_id), 1, 13))::BIGINT / pow(16, 13) < prob AS sampled
FROM m JOIN s USING (source, lang, topic)"""
