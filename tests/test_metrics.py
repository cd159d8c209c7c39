import pytest

from annulus.operators import metrics
from annulus.sources import run_records

SCHEMA = "run_id long, g string, latency_us double, gather_us double, search_max_us double"


def test_outlier_rules(spark):
    five = [(i, "five", 100.0, 10.0, 50.0) for i in range(4)] + [(4, "five", 130.0, 10.0, 50.0)]
    four = [(10, "four", 100.0, 10.0, 50.0), (11, "four", 100.0, 10.0, 50.0), (12, "four", 300.0, 10.0, 50.0), (13, "four", 300.0, 10.0, 50.0)]
    three = [(20, "three", 100.0, 1.0, 1.0), (21, "three", 100.0, 1.0, 1.0), (22, "three", 900.0, 1.0, 1.0)]
    gather = [(30 + i, "gather", 100.0, 10.0, 50.0) for i in range(4)] + [(34, "gather", 112.0, 50.0, 50.0), (35, "gather", 105.0, 90.0, 50.0)]
    slow = [(40 + i, "search", 100.0, 0.0, 50.0) for i in range(4)] + [(44, "search", 112.0, 0.0, 70.0)]
    df = spark.createDataFrame(five + four + three + gather + slow, SCHEMA)
    got = {r.run_id: r for r in metrics.outliers(df, ["g"]).collect()}
    for most in (0, 4):  # all groups, or those over four runs, by joins
        assert {r.run_id: r for r in metrics.outliers(df, ["g"], most=most).collect()} == got
    assert {i for i, r in got.items() if r.removed} == {4, 34, 44}
    assert got[4].reasons.startswith("latency_us") and got[34].reasons == "gather_us > 4.00 x median" and got[44].reasons == "search_max_us > 1.30 x median"
    assert not got[12].reasons  # kept, since fewer than three would be left


def test_derived_columns(spark):
    runs = spark.createDataFrame([(1, 100.0, 20.0, 90.0, 5.0, 5.0), (4, 40.0, 4.0, 20.0, 3.0, 3.0)], "np long, latency_us double, bcast_us double, search_max_us double, gather_us double, merge_us double")
    assert [r.other_us for r in metrics.breakdown(runs).orderBy("np").collect()] == [0.0, 10.0]
    assert [r.comm_pct for r in metrics.comm_ratio(runs).orderBy("np").collect()] == [30.0, 25.0]
    from pyspark.sql import functions as F

    fast = metrics.speedup(runs.withColumn("g", F.lit("x")), ["g"], "np", "latency_us").orderBy("np").collect()
    assert [(r.speedup, r.efficiency) for r in fast] == [(1.0, 1.0), (2.5, 0.625)]
    with pytest.raises(ValueError):
        metrics.pick(runs, np=7)
    assert metrics.best(runs, "latency_us", ["np"]).first().np == 4


def test_records_with_a_title_and_blank_lines(spark, tmp_path):
    path = tmp_path / "runs.csv"
    path.write_text("results\n\nrun_id,np,recall,partition\n\na1,4,0.5,block\n\na2,x,0.75,cyclic\n")
    got = run_records.read(spark, str(path)).orderBy("seq").collect()
    assert [(r.run_id, r.np, r.recall, r.partition) for r in got] == [("a1", 4, 0.5, "block"), ("a2", None, 0.75, "cyclic")]
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "a.csv").write_text("run_id,np,recall\na1,4,0.5\n")
    (tmp_path / "two" / "b.csv").write_text('run_id,recall,np,partition\n"b,1",0.25,8,cyclic\n')
    both = run_records.read(spark, str(tmp_path / "two")).orderBy("run_id").collect()  # each by its own header
    assert [(r.run_id, r.np, r.recall, r.partition) for r in both] == [("a1", 4, 0.5, None), ("b,1", 8, 0.25, "cyclic")]
    run_records.append(run_records.read(spark, str(path)), str(tmp_path / "log"))
    run_records.append(run_records.read(spark, str(path)), str(tmp_path / "log"))
    assert spark.read.option("header", True).csv(str(tmp_path / "log")).count() == 4


@pytest.mark.parametrize("most", [0, 40, 10**6])
def test_medians_are_exact(spark, most):
    import math
    import random
    from statistics import median

    from annulus.operators.medians import group_sizes, medians

    r = random.Random(4)
    rows = [("odd", float(r.randrange(10**6)), 1.0) for _ in range(301)] + [("even", r.lognormvariate(0, 8), -5.0) for _ in range(400)]
    rows += [("ties", float(i % 3), 2.0) for i in range(90)] + [("one", 7.5, None)] + [("none", None, None)] * 3 + [(None, float(i), float(-i)) for i in range(51)] + [("infinite", x, 0.0) for x in (math.inf, -math.inf, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, a double, b double")
    for accuracy in (20, 10_000):
        sizes, few = group_sizes(df, ["g"])
        got = {row[0]: tuple(row[1:]) for row in medians(df, ["g"], ["a", "b"], sizes, few and accuracy == 20, most, accuracy).select("g", "__n", "__median0", "__median1").collect()}
        for g in {x[0] for x in rows}:
            own = [x for x in rows if x[0] == g]
            want = [median(v) if (v := [x[i] for x in own if x[i] is not None]) else None for i in (1, 2)]
            assert got[g] == (len(own), *want), (g, accuracy)


HUGE = """
import sys, tempfile
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from annulus.operators import metrics
spark = SparkSession.builder.master("local[4]").config("spark.driver.memory", "1500m").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate()
x = F.xxhash64("id")
runs = spark.range(6_000_000).select(F.col("id").alias("run_id"), F.lit("g").alias("g"), (F.abs(x % 1_000_003) + 1.0).alias("latency_us"), (F.abs(x % 999_983) + F.rand(1)).alias("gather_us"), F.rand(2).alias("search_max_us"))
found = metrics.outliers(runs, ["g"]).agg(F.count(F.lit(1)), F.count(F.when(F.col("removed"), 1))).first()
assert found[0] == 6_000_000 and found[1] > 1_000_000, found
print("passed")
"""


def test_one_group_of_six_million_runs_in_a_small_jvm():
    import subprocess
    import sys

    from .conftest import ROOT

    done = subprocess.run([sys.executable, "-c", HUGE.format(root=ROOT)], capture_output=True, text=True, timeout=400)
    assert "passed" in done.stdout, done.stderr[-2000:]
