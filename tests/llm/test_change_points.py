"""Operator 11 against a plain dynamic programme, the least cost over all cuts, and its SQL on hard rows."""

import datetime
import itertools
import math
import random

import duckdb
import pytest

from storyloom.llm import change_points

SCHEMA = "vendor_id long, quantity int, shipped_at timestamp_ntz, s string, q string, day string, key string"
START = datetime.datetime(2024, 1, 1)


def cost(xs):
    n, s, q = len(xs), sum(xs), sum(x * x for x in xs)
    v = 1 + (n * q - s * s) // (n * n)
    return n * math.floor(1000 * math.log(v)), v


def brute(xs, least=14, penalty=40_000):
    """By all cuts of the prefix, with the ties' order written out: cost, number of segments, starts from the last one backwards."""
    n, known = len(xs), {0: (-penalty, 0, ())}
    for k in range(1, n + 1):
        ways = [
            (known[i][0] + penalty + cost(xs[i:k])[0], known[i][1] + 1, (i, *known[i][2]))
            for i in known
            if k - i >= min(least, n)
        ]
        if ways:
            known[k] = min(ways)
    return known[n]


def expected(rows, least=14, penalty=40_000):
    series = {}
    for vendor, quantity, at, *_ in rows:
        if quantity is not None and at is not None:
            days = series.setdefault(vendor, {})
            day = (at.date() - datetime.date(1970, 1, 1)).days
            days[day] = days.get(day, 0) + quantity
    out = []
    for vendor, days in series.items():
        lo = min(days)
        xs = [days.get(d, 0) for d in range(lo, max(days) + 1)]
        best, count, starts = brute(xs, least, penalty)
        ends = [*reversed(starts), len(xs)]
        for k, (a, b) in enumerate(itertools.pairwise(ends)):
            c, v = cost(xs[a:b])
            out.append((vendor, k + 1, lo + a, b - a, sum(xs[a:b]), v, c, count, best))
    return sorted(out, key=str)


def rows_of(vendor, xs, start=0):
    return [(vendor, x, START + datetime.timedelta(days=start + k, hours=k % 24)) for k, x in enumerate(xs) if x is not None]


def spark_rows(spark, rows, **bounds):
    rows = [(*r, "a", "b", "c", "d") for r in rows]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted((tuple(r) for r in change_points.change_points(df, "vendor_id", "shipped_at", "quantity", **bounds).collect()), key=str)


@pytest.fixture(scope="module")
def hard():
    rnd = random.Random(11)
    rows = []
    for vendor in range(12):
        xs = []
        while len(xs) < rnd.choice([15, 27, 28, 60, 110]):
            high = rnd.choice([0, 1, 3, 40, 900])
            xs += [rnd.choice([None, rnd.randint(0, high)]) for _ in range(rnd.randint(5, 40))]
        rows += rows_of(vendor, xs, rnd.randint(0, 30))
    rows += rows_of(None, [5] * 10 + [700, 0, 9] * 8)
    rows += rows_of(100, [3] * 13) + rows_of(101, [7]) + rows_of(102, [1, None, None, 2])
    rows += rows_of(103, [-5, 5, 80, -80] * 10) + rows_of(104, [0] * 60) + rows_of(105, [None] * 9 + [1] * 14 + [1000, 2] * 7)
    rows += [(106, None, START), (107, 5, None), (108, 2, START)] + [(109, 4, START)] * 5 + rows_of(109, [4] * 30)
    return rows


def test_change_points_by_brute_force(spark, hard):
    assert spark_rows(spark, hard) == expected(hard)


@pytest.mark.parametrize(("least", "penalty"), [(2, 0), (2, 3000), (5, 1), (1, 500)])
def test_change_points_of_other_bounds(spark, hard, least, penalty):
    """Small penalties bring many cuts and ties."""
    rows = [r for r in hard if r[0] is None or r[0] < 6 or r[0] > 99]
    assert spark_rows(spark, rows, least=least, penalty=penalty) == expected(rows, least, penalty)


def test_change_points_sql(spark, hard):
    con = duckdb.connect()
    con.execute("CREATE TABLE sale_lines (vendor_id BIGINT, quantity INTEGER, shipped_at TIMESTAMP)")
    con.executemany("INSERT INTO sale_lines VALUES (?, ?, ?)", [list(r) for r in hard])
    assert sorted(con.sql(change_points.SQL).fetchall(), key=str) == spark_rows(spark, hard)


def test_change_points_of_large_sums(spark):
    """Where n * Q passes 64 bits, decimals give the same rule."""
    rnd = random.Random(12)
    xs = [rnd.randint(0, 2_000_000_000) for _ in range(40)] + [rnd.randint(0, 90) for _ in range(40)]
    rows = [r for _ in range(3) for r in rows_of(1, xs)] + rows_of(2, [4] * 20)
    assert spark_rows(spark, rows) == expected(rows)


def test_change_points_of_nothing(spark):
    assert spark_rows(spark, []) == []
    assert spark_rows(spark, [(1, None, START), (2, 3, None)]) == []


def test_change_points_of_too_many_days(spark):
    with pytest.raises(Exception, match="a series of more than"):
        spark_rows(spark, [(1, 1, START), (1, 1, datetime.datetime(9999, 1, 1))])
