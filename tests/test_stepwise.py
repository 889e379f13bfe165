"""Answers that are asked for once, and plans that go on where they broke off."""

from __future__ import annotations

import os
import uuid
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strandline.api import Service
from strandline.operators import sequences
from strandline.plans import agents, execution, ledger, stepwise
from strandline.plans.registry import Registry


class Calls:
    """Counts calls by files, since they are made in other processes."""

    def __init__(self, folder: Path) -> None:
        self.folder = str(folder)
        os.makedirs(self.folder, exist_ok=True)

    def note(self, name: str) -> None:
        Path(self.folder, f"{name}.{uuid.uuid4().hex}").touch()

    def counted(self) -> Counter:
        return Counter(f.rsplit(".", 1)[0] for f in os.listdir(self.folder))


def test_each_key_is_asked_once_and_retried(spark, tmp_path):
    calls, folder = Calls(tmp_path / "calls"), str(tmp_path / "ledger")

    def call(payload: str) -> str:
        calls.note(payload)
        if payload == "bad" or (payload == "flaky" and calls.counted()["flaky"] < 2):
            raise ValueError("no " + payload)
        return payload.upper()

    rows = spark.createDataFrame([(p, p) for p in ("a", "a", "flaky", "bad")], "key string, payload string")
    for _ in range(2):  # the second time all is there
        got = ledger.call_once(rows, call, folder, width=2, wait=0.01, slices=3)
        assert sorted(tuple(r) for r in got.collect()) == [("a", "A", None, 1), ("bad", None, "no bad", 3), ("flaky", "FLAKY", None, 2)]
        assert got.count() == 3
    more = spark.createDataFrame([("b", "b"), ("a", "a")], "key string, payload string")
    assert sorted(r.key for r in ledger.call_once(more, call, folder).collect()) == ["a", "b"]
    assert calls.counted() == {"a": 1, "b": 1, "flaky": 2, "bad": 3}


def test_keys_tell_nulls_and_parts_apart(spark):
    df = spark.createDataFrame([(None, "x"), ("", "x"), ("x", ""), ("x", None)], "a string, b string")
    assert df.select(ledger.request_key(F.col("a"), F.col("b"))).distinct().count() == 4


PLAN = '{"steps": [{"tool_name": "up"}, {"tool_name": "%s"}], "reasoning": "r", "confidence": 0.9, "input_types": [], "output_types": [], "estimated_time": 5}'


@pytest.mark.parametrize("kept", [False, True])
def test_process_plans_and_runs_once(spark, tmp_path, kept):
    """Ten requests of six different texts, both results read twice."""
    models, tools = Calls(tmp_path / "models"), Calls(tmp_path / "tools")

    def model(said: list[dict]) -> str:
        models.note(said[-1]["content"])
        return PLAN % ("up" if said[-1]["content"] < "q3" else "fail")

    def up(value: str, parameters: dict) -> str:
        tools.note("up")
        return value.upper() + "+"

    registry = Registry().add("up", up).add("fail", lambda v, p: '{"error": "stop"}')
    planner = agents.model_planner(model, folder=str(tmp_path / "ledger") if kept else None)
    service = Service(spark, spark.createDataFrame([], "app_name string"), "", lambda m: m, registry, planner)
    requests = spark.createDataFrame([(i, f"q{i % 6}", "v" if i != 9 else None) for i in range(10)], "request_id long, query string, input string")
    plans, results = service.process(requests, auto_execute=True, work=str(tmp_path / "work"))
    for _ in range(2):
        assert sorted((r.request_id, r.status) for r in plans.collect()) == [(i, "planned" if i == 9 else "completed" if i % 6 < 3 else "execution_failed") for i in range(10)]
        assert results.count() == 18
        assert {r.output for r in results.collect()} == {"V+", "V++", None}
    assert sum(models.counted().values()) == (6 if kept else 10)
    assert tools.counted()["up"] == 9 + 6  # first steps, and second ones of requests 0 to 2 and 6 to 8
    again, _ = service.process(requests, auto_execute=True, work=str(tmp_path / "work"))
    assert again.count() == 10 and sum(models.counted().values()) == (6 if kept else 10)


def plans_and_steps(spark, n=12):
    plans = spark.createDataFrame([(str(i), str(i)) for i in range(n)], "plan_id string, input string")
    rows = [(str(i), k + 1, "none" if (i, k) == (4, 1) else "add" if k % 2 == 0 else "stop", {"by": str(k)}) for i in range(n) for k in range(i % 5)]
    return plans, spark.createDataFrame(rows, "plan_id string, step long, tool_name string, parameters map<string,string>")


def registry_of(calls: Calls, crash: str | None = None):
    def add(value: str, parameters: dict) -> str:
        calls.note(f"add {value}")
        if crash and value == "7" and not os.path.exists(crash):
            os._exit(3)  # the worker is lost
        return str(int(value) + 100)

    def stop(value: str, parameters: dict) -> str:
        return '{"error": "stop"}' if int(value) % 3 == 0 else value

    return Registry().add("add", add).add("stop", stop)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("plan_id", "step", "tool_name", "success", "output", "error").collect())


@pytest.mark.parametrize("slices", [1, 3])
def test_rounds_equal_whole_runs(spark, tmp_path, slices):
    plans, steps = plans_and_steps(spark)
    calls, folder = Calls(tmp_path / "calls"), str(tmp_path / "run")
    seen = []
    for _ in range(6):
        stepwise.run_stepwise(plans, steps, registry_of(calls), folder, most_rounds=1, slices=slices)
        seen.append(stepwise.progress_so_far(spark, folder).count())
    assert seen == sorted(seen) and seen[0] < seen[2] and seen[4] == seen[5]
    got = stepwise.results_so_far(spark, folder)
    whole = execution.run_plans(plans, steps, registry_of(Calls(tmp_path / "other")))
    assert rows_of(got) == rows_of(whole) and got.filter("error = 'Tool none not found'").count() == 1
    assert set(calls.counted().values()) == {1}
    made = steps.join(whole.select("plan_id", "step", "success"), ["plan_id", "step"], "left").withColumn("success", F.coalesce("success", F.lit(False)))
    assert sorted(map(tuple, stepwise.progress_so_far(spark, folder).collect())) == sorted(map(tuple, execution.progress(plans, made).collect()))


def test_goes_on_after_a_lost_worker(spark, tmp_path):
    plans, steps = plans_and_steps(spark)
    calls, folder, flag = Calls(tmp_path / "calls"), str(tmp_path / "run"), str(tmp_path / "flag")
    late = steps.withColumn("tool_name", F.when((F.col("plan_id") == "7") & (F.col("step") == 1), "stop").otherwise(F.col("tool_name")))  # plan 7 adds to 7 in its second step
    late = late.withColumn("tool_name", F.when((F.col("plan_id") == "7") & (F.col("step") == 2), "add").otherwise(F.col("tool_name")))
    with pytest.raises(Exception):  # noqa: B017
        stepwise.run_stepwise(plans, late, registry_of(calls, flag), folder)
    before = calls.counted()
    assert stepwise.results_so_far(spark, folder).agg(F.max("step")).first()[0] == 1
    Path(flag).touch()
    got = stepwise.run_stepwise(plans, late, registry_of(calls, flag), folder)
    assert rows_of(got) == rows_of(execution.run_plans(plans, late, registry_of(Calls(tmp_path / "other"))))
    first = {k for k in before if k != "add 7"}
    assert all(calls.counted()[k] == 1 for k in first)  # what the first round called, it called once


def test_no_plans(spark, tmp_path):
    plans, steps = plans_and_steps(spark)
    assert stepwise.run_stepwise(plans.limit(0), steps, Registry(), str(tmp_path / "a")).count() == 0
    assert stepwise.run_stepwise(plans, steps.limit(0), Registry(), str(tmp_path / "b")).count() == 0
    assert {r.status for r in stepwise.progress_so_far(spark, str(tmp_path / "b")).collect()} == {"completed"}


@pytest.mark.parametrize("then", [1, 2, 5])
def test_a_run_goes_on_in_the_slices_it_was_begun_with(spark, tmp_path, monkeypatch, then):
    """A run of three slices breaks off after the first, and is called again with another number of them."""
    plans, steps = plans_and_steps(spark)
    want = rows_of(execution.run_plans(plans, steps, registry_of(Calls(tmp_path / "plain"))))
    calls, folder, write = Calls(tmp_path / "calls"), str(tmp_path / "run"), stepwise.written

    def broken(df, path):
        if path.endswith("round-000001/slice-000001"):
            raise RuntimeError("lost")
        return write(df, path)

    monkeypatch.setattr(stepwise, "written", broken)
    with pytest.raises(RuntimeError):
        stepwise.run_stepwise(plans, steps, registry_of(calls), folder, slices=3)
    monkeypatch.setattr(stepwise, "written", write)
    assert rows_of(stepwise.run_stepwise(plans, steps, registry_of(calls), folder, slices=then)) == want
    assert max(calls.counted().values()) == 1


def test_no_round_follows_one_without_success(spark, tmp_path):
    plans = spark.createDataFrame([("a", "3"), ("b", "6")], "plan_id string, input string")
    steps = spark.createDataFrame([(p, k, "stop", {}) for p in "ab" for k in range(1, 6)], "plan_id string, step long, tool_name string, parameters map<string,string>")
    got = stepwise.run_stepwise(plans, steps, registry_of(Calls(tmp_path / "calls")), str(tmp_path / "run"))
    assert [r[:4] for r in rows_of(got)] == [("a", 1, "stop", False), ("b", 1, "stop", False)]
    assert os.listdir(tmp_path / "run" / "rounds") == ["round-000001"]


def test_a_run_is_dealt_by_its_rows_and_its_progress_reads_the_rounds_alone(spark, tmp_path, monkeypatch):
    """Plans of more rows than the session's partitions shall sort; among them plans and steps that meet nothing."""
    monkeypatch.setattr(sequences, "ROWS_OF_A_TASK", 5)
    plans = spark.createDataFrame([(f"p{i}", str(i)) for i in range(60)] + [("none", "1"), (None, "1")], "plan_id string, input string")
    rows = [(f"p{i}", k, "add" if k != 2 else "stop", {"by": "1"}) for i in range(60) for k in (1, 2, 3)] + [("unknown", 1, "add", {}), (None, 1, "add", {})]
    steps = spark.createDataFrame(rows, "plan_id string, step long, tool_name string, parameters map<string,string>")
    calls, folder = Calls(tmp_path / "calls"), str(tmp_path / "run")
    got = rows_of(stepwise.run_stepwise(plans, steps, registry_of(calls), folder, partitions=11))
    files = lambda name: len(list((tmp_path / "run" / name).glob("part-*")))
    assert files("steps/step=1") == 11 and files("rounds/round-000002/slice-000000") > 4
    stops = {i for i in range(60) if (i + 100) % 3 == 0}
    assert len(got) == 60 * 3 - len(stops) and {r[0] for r in got if not r[3]} == {f"p{i}" for i in stops}
    assert {r[4] for r in got if r[1] == 3} == {str(i + 200) for i in range(60) if i not in stops}
    progress = stepwise.progress_so_far(spark, folder)
    plan = progress._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    ends = {r.plan_id: (r.seq, r.total_steps, r.status) for r in progress.filter("step_name = 'pipeline'").collect()}
    assert ends == {f"p{i}": (7, 3, "failed") if i in stops else (10, 3, "completed") for i in range(60)} | {"none": (1, 0, "completed"), None: (1, 0, "completed")}
    assert progress.count() == 3 * len(got) + 62


def test_calls_have_parameters_of_their_own(spark, tmp_path):
    def take(value: str, parameters: dict) -> str:
        return f"{value}{parameters.pop('x')}{parameters.pop('y', {}).pop('z', '')}"

    plans = spark.createDataFrame([(str(i), "v") for i in range(6)], "plan_id string, input string")
    steps = spark.range(6).select(F.col("id").cast("string").alias("plan_id"), F.lit(1).alias("step"), F.lit("take").alias("tool_name"), F.struct(F.lit("a").alias("x"), F.when(F.col("id") > 2, F.struct(F.lit("b").alias("z"))).alias("y")).alias("parameters"))
    got = stepwise.run_stepwise(plans.coalesce(1), steps.coalesce(1), Registry().add("take", take), str(tmp_path / "run"))
    assert {(r.plan_id, r.output) for r in got.collect()} == {(str(i), "va" if i < 3 else "vab") for i in range(6)}


@pytest.mark.parametrize("out,error", [("5", None), ("[1]", None), ("", None), ("{bad", None), ('{"error": 1}', "1"), (' \n{"error": "x"}', "x"), ('"error"', None), ("[" * 100_000, None)])
def test_only_objects_with_an_error_fail(out, error):
    assert Registry().add("t", lambda v, p: out).call("t", "", {}) == (error is None, out, error)
