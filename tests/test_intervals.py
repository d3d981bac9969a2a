import random
from datetime import date, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from memlake.operators.intervals import interval_gaps, merge_intervals, usable_date

DAY = date(2020, 1, 1)


def brute(rows):
    facts = {}
    for k, s, e in rows:
        if s is not None and (e is None or s < e):
            facts.setdefault(k, []).append((s, e))
    periods, gaps = [], []
    for k, iv in facts.items():
        cur = None
        for s, e in sorted(iv, key=lambda x: x[0]):
            if cur is None:
                cur = [s, e]
            elif cur[1] is None or s <= cur[1]:
                cur[1] = None if cur[1] is None or e is None else max(cur[1], e)
            else:
                gaps.append((k, cur[1], s))
                periods.append((k, *cur))
                cur = [s, e]
        periods.append((k, *cur))
    return sorted(periods, key=str), sorted(gaps, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(k, s, e, "x") for k, s, e in rows], "k string, s date, e date, before string")
    p = sorted(((r.k, r.period_from, r.period_to) for r in merge_intervals(df, ["k"], "s", "e").collect()), key=str)
    g = sorted(((r.k, r.gap_from, r.gap_to) for r in interval_gaps(df, ["k"], "s", "e").collect()), key=str)
    return p, g


day = st.integers(0, 40).map(lambda n: DAY + timedelta(n))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.none() | day, st.none() | day), max_size=40))
def test_as_brute_force(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_hot_entity_over_many_partitions(spark):
    rnd = random.Random(3)
    rows = [("hot", DAY + timedelta(s := rnd.randrange(30000)), DAY + timedelta(s + rnd.randrange(1, 6))) for _ in range(6000)]
    rows += [("hot", DAY + timedelta(100), DAY + timedelta(9000)), ("cold", DAY, None)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == ([], [])


def test_usable_dates(spark):
    raw = ["2020-02-29", "2021-02-29", "20200301", "2020-03-01T23:59:59Z", "2020-03-01T23:59:59+02:00", "", None, "n/a", " 2020-01-02 "]
    got = [r.d for r in spark.createDataFrame([(x,) for x in raw], "x string").select(usable_date("x").cast("string").alias("d")).collect()]
    assert got == ["2020-02-29", None, "2020-03-01", "2020-03-01", None, None, None, None, "2020-01-02"]


def test_dates_before_1970(spark):
    rows = [("a", date(1950, 1, 1), date(1960, 1, 1)), ("a", date(1961, 1, 1), None)]
    assert run(spark, rows)[1] == [("a", date(1960, 1, 1), date(1961, 1, 1))]
    assert spark.range(1).select(F.lit(1)).count() == 1
