"""Readers, writers, reports and streams."""

import json

import pytest
from pyspark.sql import functions as F

from reprolith.operators import metrics as M
from reprolith.operators import reports as R
from reprolith.operators import rules as RU
from reprolith.sources import io
from reprolith.streaming import windows as S


def test_summary_round_trip(spark, tmp_path):
    path = str(tmp_path / "summary")
    rows = spark.createDataFrame([("e1", "gcd", 0.12345), ("e2", "gcd", 0.5)], "experiment_id string, contract_id string, R_raw double")
    io.append_summary(rows, path)
    io.append_summary(rows.limit(1), path)
    got = io.read_summary(spark, path)
    assert len(got.columns) == 36 and got.count() == 3 and {r.R_raw for r in got.collect()} == {0.123, 0.5}
    assert R.keep_last(got.select("experiment_id", "R_raw", "ordinal"), ["experiment_id"], "ordinal").count() == 2
    assert all(t == "string" for _, t in io.read_rows(spark, path).dtypes)


def test_experiments(spark, tmp_path):
    good = {"experiment_id": "a", "contract_id": "gcd", "model": "m", "temperature": 0.0, "llm_results": [dict(run_id=1, raw_output=None, success=False, error="x"), dict(run_id=2, raw_output="c", success=True)]}
    (tmp_path / "gcd_temp0.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "bad_temp0.json").write_text("{ broken")
    got = io.read_experiments(spark, f"{tmp_path}/*_temp*.json")
    assert [r.file for r in got.collect()] == ["gcd_temp0.json"]
    assert [(r.run_id, r.success) for r in io.generations_of(got).orderBy("run_id").collect()] == [(1, False), (2, True)]


def test_contracts(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"contract_id": "gcd", "prompt": "p", "constraints": {"k": "v"}, "oracle_requirements": dict(test_cases=[dict(input=[1, 2], expected=1)])}]))
    c = io.read_contracts(spark, str(tmp_path))
    r = io.contract(c, "gcd").first()
    assert r.language == "python" and json.loads(r.oracle_requirements.test_cases[0].input) == [1, 2]
    with pytest.raises(ValueError):
        io.contract(c, "nothing")
    assert io.invalid_contracts(c).first().missing == ["task_intent"]


def test_partitioned_overwrite(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(10).withColumn("k", F.col("id") % 2)
    io.write_partitioned(df, path, ["k"])
    io.write_partitioned(df.filter("k = 1").limit(1), path, ["k"])
    assert {r.k: r["count"] for r in spark.read.parquet(path).groupBy("k").count().collect()} == {0: 5, 1: 1}
    assert spark.range(1).select(io.provider(F.lit("claude-x")).alias("p")).first().p == "anthropic"


def test_empty_metrics(spark):
    none = spark.createDataFrame([], "g string, out string, i int, distance_pre double, distance_post double, passed boolean")
    assert M.repeatability(none, ["g"], F.col("out"), "i").count() == 0
    r = M.anchor_metrics(none, []).first()
    assert r.r_anchor_pre == 0 and r.rescue_rate == 0 and r.mean_distance_pre is None
    one = spark.createDataFrame([("a", 0.3)] * 4, "g string, x double")
    h = M.histogram(one, ["g"], "x").first()
    assert (h.bin, h.n) == (5, 4)


def test_rules(spark):
    found = spark.createDataFrame([(1, "loop_to_comprehension", 0.3), (1, "boolean_redundancy", 0.1), (2, "ternary_opportunity", 0.2)], "key int, mismatch string, severity double")
    got = RU.select_rules(found, "key", RU.rules(spark)).orderBy("key", "place").collect()
    assert [(r.key, r.place, r.rule) for r in got] == [(1, 0, "append_loop"), (1, 1, "boolean_redundancy"), (2, 0, "ternary")]
    assert RU.select_rules(found, "key", RU.rules(spark), least=0.8).count() == 1


def test_stream_windows_and_sessions(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = S.event_stream(spark, str(tmp_path / "in"), schema=events.schema.simpleString()[7:-1].replace(":", " "))
    for name, make in (("w", lambda d: S.windowed(d, late="100 days")), ("s", lambda d: S.sessions(d, late="100 days")), ("r", lambda d: S.running_repeatability(d, late="100 days"))):
        q = make(stream).writeStream.outputMode("complete").format("memory").queryName(f"t_{name}").start()
        q.processAllAvailable()
        q.stop()
        batch = make(events.withColumn("ts", F.col("ts").cast("timestamp")))
        plain = lambda df: sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in df.collect())
        assert plain(spark.table(f"t_{name}")) == plain(batch)
    assert S.finish(spark.table("t_r")).agg(F.sum("n")).first()[0] == events.count()
