"""Penalised change points of daily series (operator 11), by Spark's higher-order functions alone.

A key's series is the sum of a value per day, from its first to its last day with rows; days between without any count 0. It is cut
into segments of at least ``LEAST`` days (a shorter series is one segment) so that the segments' costs plus ``PENALTY`` for each cut
are least. With n days, sum S and sum of squares Q of a segment, V = 1 + floor((n*Q - S*S) / (n*n)), in whole numbers, and its cost
is n * floor(1000 * ln(V)). Ties go to fewest segments, then to earliest starts, compared from the last segment backwards.

Method. Rows are summed by (key, day), with Spark's partial sums before the shuffle, so a key that holds a third of all rows sends at
most a row for each day and task. Days are then dealt by key: a key has one row for each day, however many rows it had before. Running
sums by a window give each day's S and Q. ``aggregate`` folds the days with state arrays of the best cost, count and predecessor of
each prefix (:func:`_fold`), a second ``aggregate`` walks the predecessors back, and the segments are exploded. All of it is in the JVM.
A fold costs at most the square of a series' days, which the calendar bounds, not the input; its state is a few numbers for each day.

Cases: rows whose value or day is null are left out, and a key with no other rows has no segments; a null key is a series of its own;
repeated rows count each time; negative values count as such; values are whole numbers (fractions are cut off), and days those of the
session's time zone where the timestamps have a zone; an empty table gives no rows; columns may have any names, others are not
read. Series whose n * Q passes 62 bits are folded in decimals, to the same rule; sums beyond 64 bits or n * Q beyond 38 digits fail the
job under ANSI arithmetic, Spark's default. So does a series of more than ``MOST_DAYS`` days (87 years), with a message: one broken
date would otherwise cost the square of the days up to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.common import n_partitions

LEAST, PENALTY = 14, 40_000
#: Days of a series at most; ranks of longer ones don't fit 64 bits.
MOST_DAYS = 32_000
#: Rank of a prefix that no segments can make up; above any rank, and far from 64 bits.
_NEVER = 1 << 61


def daily(rows: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """(key, day, total): the sum of value per day since 1970 of at; days without rows are not there yet."""
    taken = rows.select(
        F.col(key).alias("key"),
        F.unix_date(F.to_date(F.col(at))).cast("long").alias("day"),
        F.col(value).cast("long").alias("value"),
    )
    return taken.where("day IS NOT NULL AND value IS NOT NULL").groupBy("key", "day").agg(F.sum("value").alias("total"))


def series(days: DataFrame) -> DataFrame:
    """(key, first_day, s, q) from (key, day, total): s and q are arrays of the sums of the first k days and of their squares, k = 0 to n."""
    by_key = Window.partitionBy("key").orderBy("day")
    so_far = by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wide = F.col("total").cast("decimal(19,0)")
    sums = days.select(
        "key",
        "day",
        F.sum("total").over(so_far).alias("s"),
        F.sum((wide * wide).cast("decimal(38,0)")).over(so_far).cast("decimal(38,0)").alias("q"),
        (F.lead("day", 1).over(by_key) - F.col("day")).alias("lasts"),
    )
    held = sums.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("day", "s", "q", "lasts"))).alias("days"))
    # A day's sums hold until the next day that has rows.
    lasting = lambda c: F.flatten(
        F.transform("days", lambda d: F.array_repeat(d[c], F.coalesce(d["lasts"], F.lit(1)).cast("int")))
    )
    return held.select(
        "key",
        F.col("days")[0]["day"].alias("first_day"),
        F.concat(F.array(F.lit(0).cast("long")), lasting("s")).alias("s"),
        F.concat(F.array(F.lit(0).cast("decimal(38,0)")), lasting("q")).alias("q"),
    )


def _wide_spread(n: Column, s: Column, q: Column) -> Column:
    """V of n days with sum s and sum of squares q, in decimals."""
    whole = lambda x: x.cast("decimal(38,0)")
    n, s = n.cast("decimal(19,0)"), s.cast("decimal(19,0)")
    return F.call_function("div", whole(whole(n * q) - whole(s * s)), whole(n * n)) + F.lit(1).cast("long")


def _spread(n: Column, s: Column, q: Column) -> Column:
    return F.call_function("div", n * q - s * s, n * n) + F.lit(1).cast("long")


def _cost(n: Column, v: Column) -> Column:
    return n * F.floor(F.lit(1000.0) * F.log(v.cast("double")))


def _slack(least: int, days: Column, s: Column, q: Column) -> Column:
    """How far below its cost at an earlier last day a segment's cost can come at a later one, at most.

    Without the two floors, n * ln(1 + v) never falls as days are added. They take at most 1 + 1000 / v a day, and a window's v is at
    least the least squared deviation of ``least`` days over 2 * least - 1, or 1 where that is less.
    """
    ends = F.sequence(F.lit(least), days)
    whole = lambda x: x.cast("decimal(38,0)")

    def apart(k: Column) -> Column:
        total = (s[k] - s[k - least]).cast("decimal(19,0)")
        return whole(F.lit(least) * (q[k] - q[k - least])) - whole(total * total)

    v = F.call_function("div", whole(F.array_min(F.transform(ends, apart))), whole(F.lit(least * (2 * least - 1))))
    most = days.cast("long") * (F.call_function("div", F.lit(1000), F.greatest(v, F.lit(1).cast("long"))) + 3)
    return F.when(days >= least, most).otherwise(F.lit(0).cast("long"))


def _fold(kind: str, penalty: int) -> Column:
    """For k = 0 to n the rank of the best segments of the first k days; columns s and q are sums up to each day, squares of the given kind.

    A rank is (cost * unit + segments) * unit + start of the last segment, with a unit above the number of days, so the least rank is the
    choice by cost, then segments, then start. The state holds for each day the best rank, what a segment that starts there adds to, and
    the rank of the last segment from there when it was last looked at. That one is looked at again only when the best known rank
    of today comes within the slack of it; before, it can't be today's best.
    """
    s, q, unit, square = F.col("s"), F.col("q_long" if kind == "long" else "q"), F.col("unit"), F.col("square")
    rank_type = "array<bigint>"

    def grow(state: Column, p: Column) -> Column:
        def through(i: Column) -> Column:  # the last segment starts after i days
            n = p["k"] - i
            spread = _spread(n, p["s"] - s[i], p["q"] - q[i]) if kind == "long" else _wide_spread(n, p["s"] - s[i], p["q"] - q[i])
            return state["next"][i] + _cost(n, spread) * square

        def look(bound: Column) -> Column:
            open_ = F.concat(state["seen"], F.array(F.lit(-_NEVER).cast("long")))
            return F.transform(open_, lambda x, i: F.when(x < bound, through(i)).otherwise(x))

        # A transform over one element gives its value a name, so that it is made once.
        looked = F.transform(F.array(through(state["last"]) + F.col("slack")), look)[0]
        seen = F.when(p["k"] >= F.col("shortest"), looked).otherwise(state["seen"])

        def entry(v: Column) -> Column:
            x = F.coalesce(F.array_min(v), F.lit(_NEVER).cast("long"))
            return F.struct(
                v.alias("seen"),
                F.concat(state["next"], F.array(x - F.pmod(x, unit) + F.col("step") + p["k"])).alias("next"),
                F.concat(state["best"], F.array(x)).alias("best"),
                F.when(p["k"] >= F.col("shortest"), F.pmod(x, unit).cast("int")).otherwise(F.lit(0)).alias("last"),
            )

        return F.transform(F.array(seen), entry)[0]

    # The first segment is not a cut, so the empty prefix stands a penalty below.
    start = F.struct(
        F.array().cast(rank_type).alias("seen"), F.array(unit).alias("next"), F.array(-penalty * square).alias("best"), F.lit(0).alias("last")
    )
    points = F.transform(
        F.sequence(F.lit(1), F.col("days")), lambda k: F.struct(k.cast("long").alias("k"), s[k].alias("s"), q[k].alias("q"))
    )
    return F.aggregate(points, start, grow, lambda state: state["best"])


def cut(made: DataFrame, least: int = LEAST, penalty: int = PENALTY) -> DataFrame:
    """A row for each segment of each series of :func:`series`.

    key, segment_no, first_day, n_days, total, spread, cost, n_segments, best_cost.
    """
    made = made.repartition(n_partitions(made), "key")  # few bytes, but much work: not to be coalesced
    days = F.size("s") - 1
    unit = (days + 1).cast("long")
    made = made.select(
        "key",
        "first_day",
        "s",
        "q",
        F.when(days > MOST_DAYS, F.raise_error(F.concat(F.lit(f"a series of more than {MOST_DAYS} days: "), days))).otherwise(days).alias("days"),
        unit.alias("unit"),
        (unit * unit).alias("square"),
        (penalty * unit * unit + unit).alias("step"),
        F.least(F.lit(least), days).alias("shortest"),
        (_slack(least, days, F.col("s"), F.col("q")) * unit * unit).alias("slack"),
        (days.cast("double") * F.col("q")[days].cast("double") < F.lit(float(1 << 62))).alias("narrow"),
    )
    made = made.withColumn("q_long", F.when(F.col("narrow"), F.transform("q", lambda x: x.cast("long"))))
    best = made.withColumn("best", F.when(F.col("narrow"), _fold("long", penalty)).otherwise(_fold("decimal(38,0)", penalty)))
    rank = F.col("best")[F.col("days")]
    square = F.col("unit") * F.col("unit")
    best = best.withColumns(
        {
            "n_segments": F.call_function("div", F.pmod(rank, square), F.col("unit")),
            "best_cost": F.call_function("div", rank, square),
        }
    )
    back = F.aggregate(
        F.sequence(F.lit(1), F.col("n_segments").cast("int")),
        F.array("days"),
        lambda ends, _: F.concat(F.array(F.pmod(F.col("best")[ends[0]], F.col("unit")).cast("int")), ends),
    )
    ends = best.select("key", "first_day", "s", "q", back.alias("ends"), "n_segments", "best_cost")

    def segment(i: Column) -> Column:
        a, b = F.col("ends")[i - 1], F.col("ends")[i]
        n, total = (b - a).cast("long"), F.col("s")[b] - F.col("s")[a]
        return F.struct(
            i.alias("segment_no"),
            (F.col("first_day") + a).alias("first_day"),
            n.alias("n_days"),
            total.alias("total"),
            _wide_spread(n, total, F.col("q")[b] - F.col("q")[a]).alias("spread"),
        )

    parts = F.transform(F.sequence(F.lit(1), F.size("ends") - 1), segment)
    rows = ends.select("key", "n_segments", "best_cost", F.explode(parts).alias("part")).select("key", "part.*", "n_segments", "best_cost")
    cost = _cost(F.col("n_days"), F.col("spread")).alias("cost")
    return rows.select("key", "segment_no", "first_day", "n_days", "total", "spread", cost, "n_segments", "best_cost")


def change_points(rows: DataFrame, key: str, at: str, value: str, least: int = LEAST, penalty: int = PENALTY) -> DataFrame:
    """The segments of each key's daily series of value, as :func:`cut` gives them; the key keeps its name."""
    found = cut(series(daily(rows, key, at, value)), least, penalty)
    return found.withColumnRenamed("key", key)


#: The same rows in DuckDB: a recursive query goes through the days of all series in step, with a list of best prefixes for each.
SQL = f"""
WITH RECURSIVE daily AS (
  SELECT vendor_id, CAST(CAST(shipped_at AS DATE) - DATE '1970-01-01' AS BIGINT) AS day, CAST(sum(quantity) AS HUGEINT) AS x
  FROM sale_lines WHERE quantity IS NOT NULL AND shipped_at IS NOT NULL GROUP BY ALL
), ends AS (
  SELECT row_number() OVER (ORDER BY vendor_id) AS id, vendor_id, min(day) AS lo, max(day) AS hi FROM daily GROUP BY vendor_id
), grid AS (
  SELECT id, vendor_id, lo, hi - lo + 1 AS n, unnest(range(lo, hi + 1)) AS day FROM ends
), points AS (
  SELECT g.id, g.n, g.day - g.lo + 1 AS k,
    sum(coalesce(d.x, 0)) OVER w AS s, sum(coalesce(d.x * d.x, 0)) OVER w AS q
  FROM grid g LEFT JOIN daily d ON d.vendor_id IS NOT DISTINCT FROM g.vendor_id AND d.day = g.day
  WINDOW w AS (PARTITION BY g.id ORDER BY g.day)
), folded AS (
  SELECT id, CAST(0 AS BIGINT) AS k,
    [{{'cost': CAST({-PENALTY} AS BIGINT), 'segments': 0, 'pred': CAST(-1 AS BIGINT), 's': CAST(0 AS HUGEINT), 'q': CAST(0 AS HUGEINT)}}] AS best
  FROM ends
  UNION ALL
  SELECT f.id, f.k + 1,
    list_append(f.best, coalesce(
      list_transform([list_min(list_transform(list_filter(
          list_transform(f.best, lambda e, i: {{'e': e, 'i': i - 1, 'n': p.k - i + 1}}), lambda c: c.n >= least({LEAST}, p.n) AND c.e.pred >= -1 AND c.e.cost < {_NEVER}),
        lambda c: {{'cost': CAST(c.e.cost + {PENALTY}
            + c.n * floor(1000 * ln(CAST(1 + (c.n * (p.q - c.e.q) - (p.s - c.e.s) * (p.s - c.e.s)) // (c.n * c.n) AS DOUBLE))) AS BIGINT),
          'segments': c.e.segments + 1, 'pred': c.i}}))], lambda m: {{'cost': coalesce(m.cost, {_NEVER}), 'segments': coalesce(m.segments, 0), 'pred': coalesce(m.pred, -1),
          's': CAST(p.s AS HUGEINT), 'q': CAST(p.q AS HUGEINT)}})[1], NULL))
  FROM folded f JOIN points p ON p.id = f.id AND p.k = f.k + 1
), done AS (
  SELECT f.id, f.best, f.k AS n FROM folded f JOIN ends e ON e.id = f.id AND f.k = e.hi - e.lo + 1
), walked AS (
  SELECT id, n AS b, best[n + 1].pred AS a, best[n + 1].segments AS no FROM done
  UNION ALL
  SELECT w.id, w.a, d.best[w.a + 1].pred, w.no - 1 FROM walked w JOIN done d USING (id) WHERE w.a > 0
), cuts AS (
  SELECT e.vendor_id, CAST(w.no AS INTEGER) AS segment_no, e.lo + w.a AS first_day, w.b - w.a AS n_days,
    d.best[w.b + 1].s - d.best[w.a + 1].s AS s, d.best[w.b + 1].q - d.best[w.a + 1].q AS q,
    CAST(d.best[d.n + 1].segments AS BIGINT) AS n_segments, d.best[d.n + 1].cost AS best_cost
  FROM walked w JOIN done d USING (id) JOIN ends e USING (id)
), spreads AS (
  SELECT *, CAST(1 + (n_days * q - s * s) // (n_days * n_days) AS BIGINT) AS spread FROM cuts
)
SELECT vendor_id, segment_no, first_day, n_days, CAST(s AS BIGINT) AS total, spread,
  CAST(n_days * floor(1000 * ln(CAST(spread AS DOUBLE))) AS BIGINT) AS cost, n_segments, best_cost
FROM spreads
"""
