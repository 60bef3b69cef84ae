"""Panels with two time axes, tolerant records, loaders, sinks and extracts."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.sources import files, vintages

DAY = dt.date(2000, 1, 1)


def day(k):
    return None if k is None else DAY + dt.timedelta(days=int(k))


def test_panels_of_all_dates_at_once(spark):
    rng = np.random.default_rng(1)
    rows = [(f"s{a}", day(b), day(b + c), None if v < -1.4 else float(np.round(v, 3))) for a, b, c, v in zip(rng.integers(0, 3, 300), rng.integers(0, 90, 300), rng.integers(0, 200, 300), rng.normal(size=300))]
    rows += [("s0", day(5), None, 1.0), *rows[:20]]
    dates = [day(k) for k in (0, 3, 30, 31, 59, 60, 61, 100, 100, 250, 400)]
    df = spark.createDataFrame(rows, "series string, ts date, vintage date, value double")
    out = vintages.panel_as_of(df, spark.createDataFrame([(d,) for d in dates] + [(None,)], "as_of date"), ["series"])
    got = {(r.as_of, r.series, r.ts): (r.vintage, r.value) for r in out.collect()}
    want = {}
    for d in set(dates):
        for s, t in {(r[0], r[1]) for r in rows}:
            known = [r for r in rows if r[:2] == (s, t) and r[2] is not None and r[2] <= d and t <= d]
            if known:
                last = max(r[2] for r in known)
                value = max((r[3] for r in known if r[2] == last and r[3] is not None), default=None)
                if value is not None:
                    want[d, s, t] = (last, value)
    assert got == want
    assert "NestedLoop" not in out._jdf.queryExecution().toString() and "Cartesian" not in out._jdf.queryExecution().toString()
    none = vintages.panel_as_of(df, spark.createDataFrame([], "as_of date"), ["series"])
    assert none.count() == 0
    month = vintages.monthly_as_of(out, ["series"]).where(F.col("as_of") == day(400)).collect()
    assert {(r.series, r.ts): r.value for r in month} == {(s, m): max((t, v) for (d, q, t), (_, v) in want.items() if (d, q) == (day(400), s) and (t.year, t.month) == (m.year, m.month))[1] for s, m in {(r.series, r.ts) for r in month}}


def test_each_record_is_loaded_or_told_apart(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Some title\nDate,Calls,Ratio\n01/02/2001,5,0.5\n13/45/2001,5,0.5\n01/03/2001,"1,005",0.7\n01/04/2001,x,0.8\n01/05/2001,7\n01/06/2001,7,0.9,more\n\n01/07/2001,,0.4\n01/08/2001,3,NaN\nNote: the end\n')
    good, bad = files.read_records(spark, str(tmp_path), ["Date", "Calls", "Ratio"], {"Date": "MM/dd/yyyy"}, ["Calls", "Ratio"], ["Date", "Ratio"], skip="^(Some title|Note:)")
    assert sorted(map(tuple, good.collect()), key=str) == [(dt.date(2001, 1, 2), 5.0, 0.5), (dt.date(2001, 1, 3), 1005.0, 0.7), (dt.date(2001, 1, 7), None, 0.4)]
    assert {r.Date: tuple(r.why) for r in bad.collect()} == {"13/45/2001": ("Date",), "01/04/2001": ("Calls",), "01/05/2001": ("record", "no Ratio"), "01/06/2001": ("record",), "01/08/2001": ("Ratio",)}


def test_loaders(spark):
    one = spark.createDataFrame([("r", day(0), 1.0), ("r", day(1), 3.0), ("r", None, 9.0), ("r", day(40), None)], "series string, day date, value double")
    two = spark.createDataFrame([("r", day(1), 100.0), ("r", day(2), 5.0), ("r", day(2), 7.0), ("r", day(40), 8.0)], "series string, day date, value double")
    assert [tuple(r) for r in files.ratio_months(one, two).orderBy("ts").collect()] == [("r", dt.date(2000, 1, 31), 3.0), ("r", dt.date(2000, 2, 29), 8.0)]
    cape = spark.createDataFrame([("c", 1999.01, 1.0, 1), ("c", 1999.1, 2.0, 2), ("c", 1999.1, 3.0, 3), ("c", 1999.0, 4.0, 4), ("c", 1999.13, 5.0, 5), ("c", None, 6.0, 6), ("c", 1999.02, None, 7)], "series string, stamp double, value double, line int")
    assert [(r.ts.month, r.value) for r in files.decimal_year_months(cape).orderBy("ts").collect()] == [(1, 4.0), (10, 3.0), (12, 5.0)]
    assert files.decimal_year_months(cape, "1999-11-01").count() == 2
    quarters = spark.createDataFrame([("q", dt.date(2000, 1, 1), 1.0), ("q", dt.date(2000, 4, 1), 2.0)], "series string, ts date, value double")
    assert [(r.ts.month, r.value) for r in files.quarters_as_months(quarters).orderBy("ts").collect()] == [(1, 1.0), (2, 1.0), (3, 1.0), (4, 2.0)]
    panel = spark.createDataFrame([("p", day(k), float(k)) for k in range(4)], "series string, ts date, value double")
    late = spark.createDataFrame([("z", day(1), 5.0), ("z", day(3), 7.0)], "series string, ts date, value double")
    assert [r.value for r in files.joined_features(panel, late).where("series = 'z'").orderBy("ts").collect()] == [5.0, 5.0, 5.0, 7.0]
    assert files.joined_features(panel).count() == 4


def test_writing_twice_leaves_one_copy(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0)], "series string, year int, value double")
    path = f"file://{tmp_path}/t"
    files.write_partitions(df, path, ["year"])
    files.write_partitions(df.withColumn("year", F.lit(2)), path, ["year"])
    files.write_partitions(df, path, ["year"])
    assert spark.read.parquet(path).count() == 4
    scored = spark.createDataFrame([("a", day(k), 1.0, 0.5, 0.2) for k in range(3)], "series string, ts date, actual double, pred double, bench double")
    for _ in range(2):
        files.write_report(scored, f"file://{tmp_path}/r", "first")
    files.write_report(scored, f"file://{tmp_path}/r", "second")
    assert spark.read.parquet(f"file://{tmp_path}/r/predictions").count() == 6 and spark.read.parquet(f"file://{tmp_path}/r/metrics").count() == 2


def test_extracts(spark, tmp_path):
    store, made = files.Extracts(spark, f"file://{tmp_path}/x"), []

    def make(n):
        made.append(n)
        return spark.range(n)

    for prefix, arg, n in (("spx", "1990", 3), ("spx", "1990", 3), ("spx", "1991", 4), ("macro", "1990", 5)):
        assert store.get(prefix, (arg, "m"), lambda n=n: make(n)).count() == n
    assert made == [3, 4, 5]
    assert store.clear("spx") and not store.clear("spx")
    assert store.get("macro", ("1990", "m"), lambda: make(9)).count() == 5 and store.get("spx", ("1990", "m"), lambda: make(6)).count() == 6
    assert store.clear() and made == [3, 4, 5, 6]
    with pytest.raises(ZeroDivisionError):
        store.get("bad", ("x",), lambda: 1 / 0)
