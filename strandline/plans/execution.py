"""Validating and running plans: issues, stop at the first failure, progress rows, status, results of real tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions.jsonx import is_error
from strandline.operators.lookups import lookup
from strandline.operators.sequences import ordered, until_first_failure
from strandline.session import workers_import

PROGRESS = "plan_id string, seq long, current_step long, total_steps long, step_name string, status string, percentage double"


def validate_plans(plans: DataFrame, steps: DataFrame, catalog: DataFrame) -> DataFrame:
    """(plan_id, step, message) for each issue: steps whose tool the catalog lacks, and plans without steps (step 0).

    plans: plan_id; steps: plan_id, step (from 1), tool_name; catalog: tool_name.
    """
    missing = steps.join(catalog.select("tool_name").distinct(), "tool_name", "left_anti")
    message = F.concat(F.lit("Step "), F.col("step").cast("string"), F.lit(": Tool '"), F.col("tool_name"), F.lit("' not available"))
    empty = plans.select("plan_id").join(steps.select("plan_id"), "plan_id", "left_anti")
    return missing.select("plan_id", "step", message.alias("message")).unionByName(empty.select("plan_id", F.lit(0).cast("long").alias("step"), F.lit("Pipeline has no steps").alias("message")))


def step_results(steps: DataFrame, catalog: DataFrame) -> DataFrame:
    """steps with ``success`` and ``error``: a tool that the catalog lacks fails, whatever the step's own success.

    steps: plan_id, step, tool_name, success; catalog: tool_name, one row each.
    """
    known = lookup(steps, catalog.select("tool_name").distinct(), ["tool_name"], "known")
    error = F.when(~F.col("known"), F.concat(F.lit("Tool "), F.col("tool_name"), F.lit(" not found"))).when(~F.col("success"), F.lit("step failed"))
    return known.withColumn("error", error).withColumn("success", F.col("known") & F.col("success")).drop("known")


def executed(results: DataFrame) -> DataFrame:
    """The results of the steps that run: up to and with a plan's first failure."""
    return until_first_failure(results, ["plan_id"], ["step"], F.col("success"))


def progress(plans: DataFrame, results: DataFrame) -> DataFrame:
    """All progress rows of all plans: three for each executed step, one at the end of each plan, numbered by ``seq``.

    plans: plan_id; results: plan_id, step (from 1), tool_name, success for all steps of the plans. One shuffle by plan
    serves the window, the number of steps and the final row's aggregate.
    """
    # as a window over the plan: how many steps it has in all
    counted = results.withColumn("total_steps", F.count(F.lit(1)).over(ordered(["plan_id"], ["step"]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ran = executed(counted)
    last = ran.groupBy("plan_id").agg(F.every("success").alias("ok"), F.max("total_steps").alias("total_steps"), F.count(F.lit(1)).alias("n_run"))
    return step_progress(ran).unionByName(end_progress(plans.select("plan_id").join(last, "plan_id", "left")))


def step_progress(ran: DataFrame) -> DataFrame:
    """The three progress rows of each executed step, for rows of plan_id, step, tool_name, success, total_steps."""
    i, n = (F.col("step") - 1).cast("double"), F.col("total_steps").cast("double")
    hundred = F.lit(100.0)

    def row(status: str | Column, share: Column, place: int) -> Column:
        status = F.lit(status) if isinstance(status, str) else status
        return F.struct(((F.col("step") - 1) * 3 + place).alias("seq"), F.col("step").alias("current_step"), F.col("tool_name").cast("string").alias("step_name"), status.alias("status"), (share * hundred).alias("percentage"))

    ended = F.when(F.col("success"), "completed").otherwise("failed")
    rows = ran.select("plan_id", "total_steps", F.explode(F.array(row("starting", i / n, 1), row("running", (i + F.lit(0.5)) / n, 2), row(ended, (i + F.lit(1.0)) / n, 3))).alias("r"))
    return rows.select("plan_id", "r.seq", "r.current_step", "total_steps", "r.step_name", "r.status", "r.percentage")


def end_progress(ends: DataFrame) -> DataFrame:
    """The last progress row of plans that have ended, for rows of plan_id, ok, total_steps, n_run; a plan without steps has nulls."""
    total, n_run = F.coalesce("total_steps", F.lit(0).cast("long")), F.coalesce("n_run", F.lit(0).cast("long"))
    return ends.select(
        "plan_id", (n_run * 3 + 1).alias("seq"), total.alias("current_step"), total.alias("total_steps"),
        F.lit("pipeline").alias("step_name"), F.when(F.coalesce("ok", F.lit(True)), "completed").otherwise("failed").alias("status"), F.lit(100.0).alias("percentage"),
    )


def progress_message(seconds: Column, failed: Column, error: Column) -> Column:
    """The text of a progress row with columns step_name, status, current_step."""
    name, status = F.col("step_name"), F.col("status")
    final = F.when(status == "completed", F.concat(F.lit("Pipeline completed successfully in "), F.format_string("%.1f", seconds), F.lit("s"))).otherwise(F.concat(F.lit("Pipeline failed at steps: "), failed))
    return (
        F.when(name == "pipeline", final)
        .when(status == "starting", F.concat(F.lit("Initializing "), name))
        .when(status == "running", F.concat(F.lit("Executing "), name, F.lit("...")))
        .when(status == "completed", F.concat(name, F.lit(" completed successfully")))
        .otherwise(F.concat(name, F.lit(" failed: "), F.coalesce(error, F.lit(""))))
    )


def planning_error(plans: DataFrame, total_steps: Column) -> DataFrame:
    """The single row of a plan whose run itself broke: step 0, 0 per cent."""
    return plans.select("plan_id", F.lit(1).cast("long").alias("seq"), F.lit(0).cast("long").alias("current_step"), total_steps.cast("long").alias("total_steps"), F.lit("pipeline").alias("step_name"), F.lit("failed").alias("status"), F.lit(0.0).alias("percentage"))


def plan_outcomes(plans: DataFrame, results: DataFrame) -> DataFrame:
    """(plan_id, success, failed_steps, n_run): true, '' and 0 for a plan without steps."""
    ran = executed(results).groupBy("plan_id").agg(
        F.every("success").alias("success"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("success"), F.struct("step", "tool_name")))), lambda s: s["tool_name"]), ", ").alias("failed_steps"),
        F.count(F.lit(1)).alias("n_run"),
    )
    return plans.select("plan_id").join(ran, "plan_id", "left").select("plan_id", F.coalesce("success", F.lit(True)).alias("success"), F.coalesce("failed_steps", F.lit("")).alias("failed_steps"), F.coalesce("n_run", F.lit(0).cast("long")).alias("n_run"))


def request_status(auto_execute: Column, has_input: Column, issues: Column, last_status: Column, error: Column) -> Column:
    """planned, validation_failed, completed, execution_failed or error."""
    return (
        F.when(error.isNotNull(), "error")
        .when(~(auto_execute & has_input), "planned")
        .when(issues > 0, "validation_failed")
        .when(last_status == "completed", "completed")
        .otherwise("execution_failed")
    )


def output_success(output: Column) -> Column:
    return ~is_error(output)


def run_plans(plans: DataFrame, steps: DataFrame, registry, partitions: int | None = None) -> DataFrame:
    """Run each plan's steps in order, a step's input being the output of the one before; plans run in parallel.

    plans: plan_id, input (a string), one row each; steps: plan_id, step, tool_name, parameters (map). Returns plan_id, step,
    tool_name, success, output, error for the executed steps. Tools come from a registry (see registry.py). A plan's row arrives
    before those of its steps, and rows are run as they come, so neither a plan nor a partition is held in memory, and a plan
    costs no call of its own. Plans are dealt over so many partitions (else the session's number), each sorted in one task.
    """
    workers_import(plans.sparkSession)
    columns = ["plan_id", "head", "step", "tool_name", "parameters", "input"]
    heads = plans.withColumns({"head": F.lit(0), "step": F.lit(0).cast("long"), "tool_name": F.lit(None).cast("string"), "parameters": F.lit(None).cast(steps.schema["parameters"].dataType)}).select(columns)
    both = heads.unionByName(steps.withColumns({"head": F.lit(1), "input": F.lit(None).cast("string")}).select(columns)).filter("plan_id IS NOT NULL")
    schema = "plan_id string, step long, tool_name string, success boolean, output string, error string"

    def run(frames):
        import pandas as pd

        plan, value, alive = None, None, False
        for f in frames:
            rows = []
            for plan_id, head, step, tool_name, parameters, given in f.itertuples(index=False, name=None):
                if not head:
                    plan, value, alive = plan_id, given, True
                    continue
                if plan_id != plan or not alive:  # a step of no plan, or after a failure
                    continue
                alive, out, error = registry.call(tool_name, value, dict(parameters or {}))
                rows.append((plan_id, step, tool_name, alive, out if alive else None, error))
                value = out
            yield pd.DataFrame(rows, columns=["plan_id", "step", "tool_name", "success", "output", "error"])

    dealt = both.repartition(partitions, "plan_id") if partitions else both.repartition("plan_id")
    return dealt.sortWithinPartitions("plan_id", "head", "step").mapInPandas(run, schema)


def final_outputs(plans: DataFrame, results: DataFrame) -> DataFrame:
    """(plan_id, output): that of the last executed step, the plan's input for a plan without steps, null after a failure."""
    last = results.groupBy("plan_id").agg(F.max_by("output", "step").alias("_out"), F.every("success").alias("_ok"))
    joined = plans.join(last, "plan_id", "left")
    return joined.select("plan_id", F.when(F.col("_ok").isNull(), F.col("input")).when(F.col("_ok"), F.col("_out")).alias("output"))
