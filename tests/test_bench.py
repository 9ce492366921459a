"""Measurements: digests of results, sweeps and modes, without sessions and in them."""

import json

import bench
import pytest
from pyspark.sql import functions as F
from strandspark.operators.measurement import digest


def test_digests_tell_rows_not_order(spark):
    df = spark.range(1000).select("id", (F.col("id") / 7).alias("x"), F.when(F.col("id") % 3 == 0, "t").alias("a.b"))
    one = digest(df).first()
    assert one == digest(df.orderBy(F.desc("id")).repartition(3).withColumn("x", F.col("x") + 1e-12)).first() and one["rows"] == 1000
    others = [df.where("id > 0"), df.unionByName(df.where("id = 1")), df.withColumn("x", F.col("x") + 0.001), df.withColumn("a.b", F.lit(None).cast("string")), df.unionByName(df)]
    assert len({one["digest"], *(digest(o).first()["digest"] for o in others)}) == 6
    assert digest(df.where("false")).first()["rows"] == 0


@pytest.fixture
def other(monkeypatch):
    """Runs that take eight seconds of one core; what they find where splits are small can be changed."""
    found = {"digest": 7}

    def apart(name, settings):
        return {"value": 8.0 / int(settings.get("BENCH_CPUS", 8)), "digests": {name: [3, found["digest"] if settings.get("BENCH_SPLIT") == "1m" else 7]}}

    monkeypatch.setattr(bench, "apart", apart)
    return found


def test_modes_give_one_verdict(other, capsys):
    assert bench.modes("q")
    *rows, last = map(json.loads, capsys.readouterr().out.splitlines())
    assert [r["speedup"] for r in rows] == [1.0, 8.0, 8.0, 8.0] and last == {"query": "q", "modes": 4, "all_equal": True}
    other["digest"] = 8
    assert not bench.modes("q")
    *rows, last = map(json.loads, capsys.readouterr().out.splitlines())
    assert [r["result_ok"] for r in rows] == [True, True, False, True] and not last["all_equal"]


def test_sweep_over_cores(other, capsys):
    bench.sweep("cpus", "q")
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [(r["cpus"], r["speedup"], r["efficiency_pct"]) for r in rows] == [("1", 1.0, 100.0), ("2", 2.0, 100.0), ("4", 4.0, 100.0), ("8", 8.0, 100.0)]
