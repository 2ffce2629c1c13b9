"""The panel reader, the partitioned layer and the period table on small frames."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import regimes as R
from ledgerlens.operators import risk as RK
from ledgerlens.sources.panel import MEASURES, read_panel
from ledgerlens.sources.sinks import read_layer, rewrite_partitions, write_layer


@pytest.fixture()
def folder(spark, tmp_path):
    return str(tmp_path)


def test_panel_from_csv(spark, folder):
    path = os.path.join(folder, "p.csv")
    with open(path, "w") as f:
        f.write("year,company,cash,note,net_sales\n2000,a,NaN,x,1.5\n2000,b,inf,y,2\n200x,c,1,z,3\n2001,a,7,,\n2001,a,,,9\n2001,a,7,,9\n,d,-inf,,4\n")
    p = read_panel(spark, path)
    assert p.rows.columns == ["company", "year", "net_sales", "cash"]
    assert sorted(map(tuple, p.rows.collect()), key=repr) == sorted(
        [("a", 2000, 1.5, None), ("b", 2000, 2.0, None), ("a", 2001, 9.0, 7.0), ("d", None, 4.0, None)], key=repr)
    assert [r["line"] for r in p.rejected.collect()] == ["200x,c,1,z,3"]
    assert [tuple(r) for r in p.repeated.collect()] == [("a", 2001, 3)]
    assert len(p.missing) == 1 + len(MEASURES) - 2 and "sector" in p.missing
    assert p.rows.select("cash").count() == 4                     # fewer columns, same lines


def test_panel_from_parquet(spark, folder):
    path = os.path.join(folder, "p.parquet")
    spark.createDataFrame([("a", "2000", "1.5"), ("b", "2000", "many"), ("c", None, "NaN")],
                          "company string, year string, cash string").write.parquet(path)
    p = read_panel(spark, path, "parquet")
    assert sorted(map(tuple, p.rows.collect()), key=repr) == sorted([("a", 2000, 1.5), ("c", None, None)], key=repr)
    assert p.rejected.count() == 1 and p.repeated.count() == 0
    with pytest.raises(ValueError):
        read_panel(spark, path, "xlsx")


def test_one_year_is_written_anew(spark, folder):
    path = os.path.join(folder, "layer")
    df = spark.range(30).selectExpr("id", "CAST(2000 + id % 3 AS int) AS year", "CAST(id AS double) AS v")
    write_layer(df, path, "year")
    before = {f for f in glob.glob(f"{path}/year=*/*.parquet") if "year=2001" not in f}
    rewrite_partitions(df.where("year = 2001").withColumn("v", F.col("v") * 10), path, "year")
    assert before == {f for f in glob.glob(f"{path}/year=*/*.parquet") if "year=2001" not in f}
    part = read_layer(spark, path, "year = 2001")
    assert sorted(r["v"] for r in part.collect()) == [10.0 * i for i in range(1, 30, 3)]
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "(year" in plan.split("PartitionFilters")[1].split("]")[0]
    assert read_layer(spark, path).count() == 30


def test_macros_that_disagree_keep_the_panel_whole(spark):
    rows = [(f"c{i}", 2000 + i % 3, 1.0 if i else 9.0, 2.0, 3.0, 4.0) for i in range(9)] + [("x", 2004, None, 1.0, 1.0, 1.0)]
    p = spark.createDataFrame(rows, "company string, year int, inflation double, fed_rate double, gdp_growth double, stress_intensity double")
    t = R.rule_regimes(p)
    assert sorted((r["year"], r["inflation"]) for r in t.collect()) == [(2000, 1.0), (2001, 1.0), (2002, 1.0)]
    assert R.label_panel(p, t.select("year", "regime_name")).count() == len(rows)
    assert [tuple(r) for r in R.disagreements(p, R.MACRO_VARS).collect()] == [(2000, 2, 1)]
    assert [(r["series"], r["found"]) for r in R.macro_report(p.drop("fed_rate")).collect()][1] == ("interest_rate", False)
    assert R.rule_regimes(p.drop("fed_rate", "stress_intensity")).where("regime_name IS NULL").count() == 0


def test_too_many_periods_are_refused(spark, monkeypatch):
    monkeypatch.setattr(R, "MAX_PERIODS", 2)
    p = spark.range(9).selectExpr("id AS year", "1.0 AS inflation")
    with pytest.raises(ValueError):
        R.period_table(p, ["inflation"])


def test_clusters_and_silhouette_on_known_points(spark):
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (0, 1), (1, 0), (10, 10), (10, 11), (11, 10), (50, 0)])]
    t = spark.createDataFrame(rows, "year int, zx double, zy double")
    out = R.fit_kmeans(t, ["zx", "zy"], 3).orderBy("year")
    assert [r["regime_kmeans"] for r in out.collect()] == [0, 0, 0, 1, 1, 1, 2]
    import math
    def s(own, other):
        a, b = sum(own) / len(own), sum(other) / len(other)
        return (b - a) / max(a, b)
    pts = [(x, y) for _, x, y in rows]

    def d(i, js):
        return [math.dist(pts[i], pts[j]) for j in js]
    one, two = [0, 1, 2], [3, 4, 5]
    expected = [s(d(i, [j for j in g if j != i]), min(d(i, o), d(i, [6]), key=lambda v: sum(v) / len(v)))
                for g, o in ((one, two), (two, one)) for i in g] + [0.0]
    got = R.silhouette(out, "regime_kmeans", ["zx", "zy"]).first()["silhouette"]
    assert abs(got - sum(expected) / 7) < 1e-12
    sweep = [r["inertia"] for r in R.kmeans_sweep(t, ["zx", "zy"]).orderBy("k").collect()]
    assert len(sweep) == 6 and all(a >= b - 1e-9 for a, b in zip(sweep, sweep[1:]))
    assert R.silhouette(t.withColumn("l", F.lit(0)), "l", ["zx"]).first()["silhouette"] is None


def test_scores_round_half_to_even(spark):
    risk = spark.createDataFrame([("a", "s", "ROA", 0.02), ("b", "s", "ROA", 0.03), ("c", "t", "ROA", 0.01), ("d", "t", "ROA", 0.02)],
                                 "company string, sector string, target string, risk_score double")
    assert {r["sector"]: r["avg_risk"] for r in RK.sector_summary(risk).collect()} == {"s": 0.02, "t": 0.02}
