"""The engine's operators on the driver tables, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import jsonx, names, text, types
from strandline.operators import catalog, compat, events, lookups, sequences
from strandline.plans import execution, graph, planner
from strandline.plans.planner import IntentRule
from strandline.session import shared_folder, workers_import, written

#: The type rules of the driver tables: which part type may follow which.
PART_RULES = {"economy": ("medium", "promo"), "medium": ("small", "large"), "large": ("small",), "promo": ("standard", "small")}
PART_RULES_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, bs in sorted(PART_RULES.items()) for b in bs) + ") r(o, i)"
#: Keyword rules of the driver tables, on part names.
NAME_RULES = (IntentRule(("ring", "bolt"), "fasten", "hold things"), IntentRule(("gear", "rod", "in"), "move", "move things"), IntentRule(("cold", "hot"), "heat", "temper things"))
NAME_DEFAULT = IntentRule((), "store", "keep it")
EVENT_MAP = {"click": "text_message_content", "view": "state_snapshot", "purchase": "tool_call_result", "error": "run_error"}
EVENT_ROUTES = {"click": "message", "signup": "start", "view": "validation", "purchase": "feedback"}
UI_ACTIONS = {"signup": "start", "click": "text", "purchase": "end", "error": "error"}
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LINE_ORDER_SQL = ", ".join(LINE_ORDER)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def case_sql(column: str, table: dict[str, str], default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE '{default}' END"


# ---- names, types, catalogs


def type_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", names.app_name(url).alias("app_name"), types.short_type(url, "legacy").alias("legacy"), types.short_type(url).alias("fixed"))


TYPE_CLEAN = """
SELECT page_id, split_part(url, '/', -1) AS app_name, split_part(split_part(url, '/', -1), 'v', 1) AS legacy,
  split_part(regexp_replace(url, '/v[0-9]+(\\.[0-9]+)*$', ''), '/', -1) AS fixed FROM pages"""


def type_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").groupBy(types.namespace(F.col("url")).alias("namespace")).agg(F.count(F.lit(1)).alias("n"))


TYPE_NAMESPACE = "SELECT CASE WHEN contains(url, '/') THEN substr(url, 1, length(url) - length(split_part(url, '/', -1)) - 1) ELSE '' END AS namespace, count(*) AS n FROM pages GROUP BY 1"


def catalog_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_brand").alias("app_name"), F.col("p_name").alias("version"), F.col("p_type").alias("description"))
    first = parts.groupBy("app_name").agg(F.min_by("version", "ord").alias("latest_version"), F.count(F.lit(1)).alias("versions"))
    last = sequences.last_wins(parts.drop("version"), "app_name", "ord")
    return last.join(first, "app_name").select("app_name", "ord", "latest_version", "versions", "description")


CATALOG_LATEST = """
SELECT p_brand AS app_name, min(p_partkey) AS ord, arg_min(p_name, p_partkey) AS latest_version, count(*) AS versions, arg_max(p_type, p_partkey) AS description
FROM part GROUP BY p_brand"""


def part_catalog(parts: DataFrame) -> DataFrame:
    """Parts as catalog entries: a slot of one type, of two alternatives or none by size; a labelled output; one parameter."""
    kind = lambda name: F.struct(name.alias("type"), (F.col("p_size") > 25).alias("required"), F.create_map(F.lit("timeUnit"), F.lit("seconds")).alias("properties"))
    slots = F.when(F.col("p_size") % 3 == 0, F.array(F.array(kind(F.col("p_type"))))).when(F.col("p_size") % 3 == 1, F.array(F.array(kind(F.col("p_type")), kind(F.col("p_brand"))))).otherwise(F.array().cast("array<array<struct<type:string,required:boolean,properties:map<string,string>>>>"))
    parameter = F.struct(F.lit("size").alias("name"), F.lit("how large").alias("description"), F.lit("integer").alias("type"), F.col("p_size").cast("string").alias("default"))
    return parts.select(F.col("p_partkey").alias("ord"), F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("app_name"), F.col("p_brand").alias("latest_version"), F.col("p_name").alias("description"), slots.alias("input"), F.array(kind(F.col("p_type"))).alias("output"), F.array(parameter).alias("parameters"))


def catalog_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = part_catalog(read(spark, sf_dir, "part"))
    lines = catalog.tool_lines(parts)
    return catalog.describe_tools(parts).join(lines, ["ord", "app_name"])


CATALOG_DESCRIBE = """
WITH p AS (SELECT *, 'part-' || p_partkey AS app_name, CASE WHEN p_size % 3 = 0 THEN p_type || CASE WHEN p_size > 25 THEN ' (required)' ELSE '' END WHEN p_size % 3 = 1 THEN 'one of [' || p_type || ', ' || p_brand || ']' END AS slot FROM part)
SELECT p_partkey AS ord, app_name,
  'Tool for ' || p_name || '.' || chr(10) || chr(10) || 'Inputs:' || chr(10) || coalesce('- ' || slot, '') || chr(10) || chr(10) || 'Outputs:' || chr(10) || '- ' || p_type || ' (timeUnit=seconds)' || chr(10) || chr(10)
  || 'Parameters:' || chr(10) || '- size (integer) = ' || p_size || ': how large' || chr(10) || chr(10) || 'Version: ' || p_brand AS description,
  '- ' || app_name || ': ' || p_name || chr(10) || '  Input: ' || CASE WHEN p_size % 3 = 0 THEN p_type ELSE 'Any' END || ' | Output: ' || p_type AS line
FROM p"""


def palette_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.palette(read(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "UTF8_BINARY", "p_partkey")


PALETTE_RANK = "SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_name, p_partkey) AS rank FROM part"


def palette_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in small and in capital letters under the UNICODE collation: by letters first, small ones first where these are equal."""
    part = read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"))
    return catalog.palette(part, "name", "UNICODE", "p_partkey")


PALETTE_UNICODE = """
WITH p AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE p_name END AS name FROM part)
SELECT p_partkey, name, row_number() OVER (ORDER BY lower(name), name = upper(name), p_partkey) AS rank FROM p"""


def slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.initcap("p_name"), F.lit(" "), F.lower("p_brand"))
    return read(spark, sf_dir, "part").select("p_partkey", names.slug(name).alias("slug"), names.pipeline_title(F.concat(names.slug(F.col("p_name")), F.lit(".yaml"))).alias("title"))


SLUG = """
SELECT p_partkey, replace(lower(p_name || ' ' || p_brand), ' ', '_') AS slug,
  upper(p_name[1]) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(split_part(p_name, ' ', 2)[1]) || substr(split_part(p_name, ' ', 2), 2) AS title FROM part"""


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.health(tools=read(spark, sf_dir, "part"), sessions=read(spark, sf_dir, "conversations").select("conv_id").distinct(), events=read(spark, sf_dir, "events"), store=None)


HEALTH = """
SELECT (SELECT count(*) FROM part) AS tools_count, (SELECT count(DISTINCT conv_id) FROM conversations) AS sessions_count, (SELECT count(*) FROM events) AS events_count,
  true AS tools_available, true AS sessions_available, true AS events_available, false AS store_available, CAST(NULL AS BIGINT) AS store_count, 'healthy' AS status"""


def available_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part").select(F.col("p_brand").alias("app_name"))
    wanted = ["Brand#12", "no brand", "Brand#9", "Brand#23", "Brand#1", "Brand#55"]
    have = lookups.wanted_and_available(spark.createDataFrame(list(enumerate(wanted)), "place long, app_name string"), parts)
    return sequences.with_rank(have, ["place"]).select(F.col("rank").cast("long").alias("rank"), "app_name")


AVAILABLE_TOOLS = """
WITH w AS (SELECT unnest(['Brand#12', 'no brand', 'Brand#9', 'Brand#23', 'Brand#1', 'Brand#55']) AS app_name, unnest(range(6)) AS i)
SELECT row_number() OVER (ORDER BY i) AS rank, app_name FROM w WHERE app_name IN (SELECT p_brand FROM part)"""


def tool_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    tools = s.select(F.concat(F.lit("t"), F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 2 == 0, "-wrapper").otherwise("")).alias("tool_name"))
    name = F.concat(F.lit("t"), F.col("s_suppkey").cast("string"))
    directory = F.when(F.col("s_nationkey") % 3 == 0, name).when(F.col("s_nationkey") % 3 == 1, F.concat(F.lit("app-"), name)).otherwise(F.concat(F.lit("app-"), name, F.lit("-wrapper")))
    return lookups.find_directories(tools, s.select(directory.alias("directory"), F.concat(F.lit("/apps/"), directory).alias("path"), (F.col("s_acctbal") > 0).alias("has_app")))


TOOL_DIRECTORIES = """
WITH s AS (SELECT 't' || s_suppkey AS n, s_suppkey % 2 = 0 AS w, s_nationkey % 3 AS k, s_acctbal > 0 AS ok FROM supplier),
d AS (SELECT CASE k WHEN 0 THEN n WHEN 1 THEN 'app-' || n ELSE 'app-' || n || '-wrapper' END AS dir FROM s WHERE ok),
t AS (SELECT n || CASE WHEN w THEN '-wrapper' ELSE '' END AS tool_name FROM s),
c AS (SELECT tool_name, 0 AS prio, 'app-' || tool_name AS dir FROM t UNION ALL SELECT tool_name, 1, 'app-' || tool_name || '-wrapper' FROM t UNION ALL SELECT tool_name, 2, 'app-' || replace(tool_name, '-wrapper', '') FROM t UNION ALL SELECT tool_name, 3, tool_name FROM t),
b AS (SELECT tool_name, '/apps/' || arg_min(dir, prio) AS path FROM c JOIN d USING (dir) GROUP BY tool_name)
SELECT t.tool_name, b.path FROM t LEFT JOIN b USING (tool_name)"""


# ---- compatibility


def _part_types(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    outs = parts.select(F.col("p_partkey").alias("tool"), F.lit(0).alias("out_ord"), F.col("p_type").alias("out_type"))
    return outs, parts.select(F.col("p_partkey").alias("tool"), F.col("p_partkey").alias("ord"), F.col("p_type").alias("in_type"))


def compat_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part").select(F.concat("p_brand", F.lit(" "), F.col("p_size").cast("string")).alias("tool"), "p_type")
    return compat.compatible_pairs(parts.withColumnRenamed("p_type", "out_type"), parts.withColumnRenamed("p_type", "in_type"), compat.rule_table(spark, PART_RULES))


COMPAT_PAIRS = f"""
WITH p AS (SELECT DISTINCT p_brand || ' ' || p_size AS tool, lower(p_type) AS t FROM part)
SELECT DISTINCT a.tool AS source, b.tool AS target FROM p a JOIN p b ON a.tool <> b.tool LEFT JOIN {PART_RULES_SQL} ON r.o = a.t AND r.i = b.t WHERE a.t = b.t OR r.o IS NOT NULL"""


def suggest_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part")
    firsts = parts.groupBy("p_brand").agg(F.min("p_partkey").alias("last")).select("last")
    outs, ins = _part_types(parts)
    unknown = spark.createDataFrame([(-1,)], "last long")
    found = compat.suggest_next(firsts.unionByName(unknown), outs, ins, compat.rule_table(spark, PART_RULES))
    return found.select("last", "rank", F.col("tool").cast("string").alias("tool"))


SUGGEST_TOP5 = f"""
WITH f AS (SELECT min(p_partkey) AS last FROM part GROUP BY p_brand),
o AS (SELECT f.last, lower(p.p_type) AS o FROM f JOIN part p ON p.p_partkey = f.last),
a AS (SELECT last, o AS i FROM o UNION SELECT last, r.i FROM o JOIN {PART_RULES_SQL} ON r.o = o.o),
h AS (SELECT a.last, p.p_partkey AS tool, row_number() OVER (PARTITION BY a.last ORDER BY p.p_partkey) AS rank FROM a JOIN part p ON lower(p.p_type) = a.i AND p.p_partkey <> a.last)
SELECT last, rank, CAST(tool AS VARCHAR) AS tool FROM h WHERE rank <= 5
UNION ALL SELECT -1, unnest([1, 2, 3]), unnest(['transnet-wrapper', 'whisper-wrapper', 'easyocr-wrapper'])"""


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    return sequences.with_ordinal(sequences.dealt(lines, ["l_orderkey"], lines.count()), ["l_orderkey"], LINE_ORDER, "step")


def edge_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = _steps(spark, sf_dir).select("l_orderkey", "step", "l_partkey")
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_type")
    typed = steps.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    w = sequences.ordered(["l_orderkey"], ["step"])
    edges = typed.select("l_orderkey", "step", F.lag("l_partkey").over(w).alias("source"), F.col("l_partkey").alias("target"), F.lag("p_type").over(w).alias("source_type"), F.col("p_type").alias("target_type")).filter("source IS NOT NULL")
    return compat.typed_edges(edges, compat.rule_table(spark, PART_RULES)).select("l_orderkey", "step", "source", "target", "edge_type")


EDGE_VALIDITY = f"""
WITH s AS (SELECT l_orderkey, l_partkey, p_type, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER_SQL}) AS step FROM lineitem JOIN part ON p_partkey = l_partkey),
e AS (SELECT l_orderkey, step, lag(l_partkey) OVER w AS source, l_partkey AS target, lag(p_type) OVER w AS st, p_type AS tt FROM s WINDOW w AS (PARTITION BY l_orderkey ORDER BY step))
SELECT l_orderkey, step, source, target, CASE WHEN lower(st) = lower(tt) OR r.o IS NOT NULL THEN 'default' ELSE 'invalid' END AS edge_type
FROM e LEFT JOIN {PART_RULES_SQL} ON r.o = lower(st) AND r.i = lower(tt) WHERE source IS NOT NULL"""


# ---- plans


def _plans(spark: SparkSession, sf_dir: str, most_size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(plans, results, tools): the tool lookup comes before the numbering, so lines are dealt by order only once more."""
    plans = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("plan_id"))
    tools = read(spark, sf_dir, "part").filter(F.col("p_size") <= most_size).select(F.col("p_partkey").alias("tool_name"))
    lines = read(spark, sf_dir, "lineitem").withColumn("tool_name", F.col("l_partkey")).withColumn("success", F.col("l_returnflag") != "R")
    looked_up = sequences.dealt(execution.step_results(lines, tools), ["l_orderkey"], lines.count())
    steps = sequences.with_ordinal(looked_up, ["l_orderkey"], LINE_ORDER, "step")
    return plans, steps.select(F.col("l_orderkey").alias("plan_id"), "step", "tool_name", "success", "error"), tools


def validate_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans, steps, tools = _plans(spark, sf_dir, 40)
    return execution.validate_plans(plans, steps, tools)


STEPS_SQL = f"s AS (SELECT l_orderkey AS plan_id, l_partkey AS tool_name, l_returnflag <> 'R' AS fine, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER_SQL}) AS step FROM lineitem)"
VALIDATE_PLAN = f"""
WITH {STEPS_SQL}
SELECT plan_id, step, 'Step ' || step || ': Tool ''' || tool_name || ''' not available' AS message FROM s WHERE tool_name NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40)
UNION ALL SELECT o_orderkey, 0, 'Pipeline has no steps' FROM orders WHERE o_orderkey NOT IN (SELECT plan_id FROM s)"""


def plan_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans, steps, _ = _plans(spark, sf_dir, 45)
    return execution.progress(plans, steps)


RESULTS_SQL = f"""{STEPS_SQL},
k AS (SELECT s.*, fine AND p_partkey IS NOT NULL AS ok, count(*) OVER (PARTITION BY plan_id) AS n FROM s LEFT JOIN part ON p_partkey = tool_name AND p_size <= 45),
g AS (SELECT *, coalesce(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY plan_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bad FROM k),
ran AS (SELECT * FROM g WHERE bad = 0)"""
PLAN_PROGRESS = f"""
WITH {RESULTS_SQL},
d AS (SELECT *, CAST(step - 1 AS DOUBLE) AS i, CAST(n AS DOUBLE) AS m FROM ran),
last AS (SELECT plan_id, bool_and(ok) AS ok, max(n) AS n, count(*) * 3 + 1 AS seq FROM ran GROUP BY plan_id)
SELECT plan_id, (step - 1) * 3 + 1 AS seq, step AS current_step, n AS total_steps, CAST(tool_name AS VARCHAR) AS step_name, 'starting' AS status, i / m * 100.0::DOUBLE AS percentage FROM d
UNION ALL SELECT plan_id, (step - 1) * 3 + 2, step, n, CAST(tool_name AS VARCHAR), 'running', (i + 0.5::DOUBLE) / m * 100.0::DOUBLE FROM d
UNION ALL SELECT plan_id, (step - 1) * 3 + 3, step, n, CAST(tool_name AS VARCHAR), CASE WHEN ok THEN 'completed' ELSE 'failed' END, (i + 1.0::DOUBLE) / m * 100.0::DOUBLE FROM d
UNION ALL SELECT o_orderkey, coalesce(seq, 1), coalesce(n, 0), coalesce(n, 0), 'pipeline', CASE WHEN coalesce(ok, true) THEN 'completed' ELSE 'failed' END, 100.0::DOUBLE FROM orders LEFT JOIN last ON plan_id = o_orderkey"""


def plan_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans, steps, _ = _plans(spark, sf_dir, 45)
    outcomes = execution.plan_outcomes(plans, steps.withColumn("tool_name", F.col("tool_name").cast("string")))
    heads = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("plan_id"), "o_orderstatus", "o_totalprice")
    status = execution.request_status(F.col("o_orderstatus") != "P", F.col("o_totalprice") > 1000.0, F.when(F.col("o_orderstatus") == "O", 0).otherwise(F.when(F.col("n_run") == 0, 1).otherwise(0)), F.when(F.col("success"), "completed").otherwise("failed"), F.lit(None).cast("string"))
    return outcomes.join(heads, "plan_id").select("plan_id", "success", "failed_steps", "n_run", status.alias("status"))


PLAN_STATUS = f"""
WITH {RESULTS_SQL},
a AS (SELECT plan_id, bool_and(ok) AS ok, coalesce(string_agg(CASE WHEN NOT ok THEN CAST(tool_name AS VARCHAR) END, ', ' ORDER BY step), '') AS f, count(*) AS n FROM ran GROUP BY plan_id)
SELECT o_orderkey AS plan_id, coalesce(ok, true) AS success, coalesce(f, '') AS failed_steps, coalesce(n, 0) AS n_run,
  CASE WHEN NOT (o_orderstatus <> 'P' AND o_totalprice > 1000.0) THEN 'planned' WHEN o_orderstatus <> 'O' AND coalesce(n, 0) = 0 THEN 'validation_failed' WHEN coalesce(ok, true) THEN 'completed' ELSE 'execution_failed' END AS status
FROM orders LEFT JOIN a ON plan_id = o_orderkey"""


def step_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = _steps(spark, sf_dir).select("l_orderkey", "step", "l_partkey")
    seeds = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (-F.col("o_custkey")).alias("seed"))
    return steps.join(seeds, "l_orderkey").select("l_orderkey", "step", sequences.previous(F.col("l_partkey"), ["l_orderkey"], ["step"], F.col("seed")).alias("input"), F.col("l_partkey").alias("output"))


STEP_CHAIN = f"""
WITH {STEPS_SQL} SELECT plan_id AS l_orderkey, step, coalesce(lag(tool_name) OVER (PARTITION BY plan_id ORDER BY step), -o_custkey) AS input, tool_name AS output FROM s JOIN orders ON o_orderkey = plan_id"""


def intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("request_id"), F.upper("p_name").alias("query"))
    plans = planner.plan_requests(requests, rules=NAME_RULES)
    tools = planner.matched_tools(F.col("query"), NAME_RULES, NAME_DEFAULT)
    seconds = F.when(F.element_at(tools, 1) == NAME_DEFAULT.tool, planner.STEP_SECONDS).otherwise(F.col("plan.estimated_total_time"))
    return plans.select("request_id", F.array_join(tools, ",").alias("tools"), seconds.cast("long").alias("seconds"), F.col("plan.confidence").alias("confidence"), F.col("plan.reasoning").alias("reasoning"))


def _intent_sql() -> str:
    def hit(r: IntentRule) -> str:
        return " OR ".join(f"contains(lower(p_name), '{w}')" for w in r.words)

    cases = ", ".join(f"CASE WHEN {hit(r)} THEN '{r.tool}' END" for r in NAME_RULES)
    return f"""
WITH t AS (SELECT p_partkey, upper(p_name) AS q, list_filter([{cases}], lambda x: x IS NOT NULL) AS l FROM part)
SELECT p_partkey AS request_id, CASE WHEN len(l) = 0 THEN '{NAME_DEFAULT.tool}' ELSE array_to_string(l, ',') END AS tools, CAST(greatest(len(l), 1) * 60 AS BIGINT) AS seconds, 0.5::DOUBLE AS confidence, 'Fallback plan for: ' || q AS reasoning FROM t"""


def plan_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planner outputs as JSON strings, some broken, some with failed planning, converted and exploded to steps."""
    props = read(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.col("event_type").alias("query"), "value", "user_id")
    good = F.concat(F.lit('{"steps":[{"tool_name":"a","estimated_time":7},{"reasoning":"r"}],"reasoning":"x","confidence":0.75,"input_types":["i"],"output_types":["o"],"estimated_time":'), F.col("user_id").cast("string"), F.lit("}"))

    def given(requests: DataFrame) -> DataFrame:
        output = F.when(F.col("request_id") % 3 == 0, good).when(F.col("request_id") % 3 == 1, F.lit("no json"))
        return props.select("request_id", output.alias("output"), F.when(F.col("request_id") % 3 == 2, "down").alias("error"))

    plans = planner.plan_requests(props.select("request_id", "query"), given)
    steps = planner.plan_steps(plans, keep=("confidence", "estimated_total_time"))
    return steps.select("request_id", "step", "tool_name", "reasoning", F.col("estimated_time").cast("long").alias("estimated_time"), F.size("parameters").cast("long").alias("n_parameters"), "confidence", F.col("estimated_total_time").cast("long").alias("total"))


PLAN_CONVERT = """
SELECT request_id, CAST(step AS BIGINT) AS step, tool_name, reasoning, CAST(estimated_time AS BIGINT) AS estimated_time, CAST(0 AS BIGINT) AS n_parameters, confidence, CAST(total AS BIGINT) AS total FROM (
SELECT event_id AS request_id, unnest([1, 2]) AS step, unnest(['a', '']) AS tool_name, unnest(['', 'r']) AS reasoning, unnest([7, 30]) AS estimated_time, 0.75::DOUBLE AS confidence, user_id AS total FROM events WHERE event_id % 3 = 0
UNION ALL SELECT event_id, 1, 'whisper-wrapper', 'General audio analysis', 30, 0.5::DOUBLE, 60 FROM events WHERE event_id % 3 = 1
UNION ALL SELECT event_id, 1, 'whisper-wrapper', 'Fallback plan due to planning error: down', 60, 0.1::DOUBLE, 60 FROM events WHERE event_id % 3 = 2)"""


# ---- JSON and arguments


def error_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = F.when(F.col("event_type") == "error", F.concat(F.lit('{"error": '), "props", F.lit("}"))).when(F.col("event_type") == "view", F.lit("error")).when(F.col("event_type") == "click", F.lit('{"error": null}')).otherwise(F.col("props"))
    return read(spark, sf_dir, "events").select("event_id", jsonx.is_error(output).alias("failed"), jsonx.has_key(F.col("props"), "k").alias("has_k"))


ERROR_DETECT = "SELECT event_id, event_type IN ('error', 'click') AS failed, json_exists(props, '$.k') AS has_k FROM events"


def cli_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    parameters = jsonx.parse_parameters(F.when(F.col("event_type") == "error", F.lit("not json")).otherwise(F.col("props")))
    config = F.when(F.col("event_type") == "view", F.lit("base.yaml"))
    rows = read(spark, sf_dir, "events").select("event_id", parameters.alias("p"), config.alias("config"))
    return rows.select("event_id", F.array_join(jsonx.cli_arguments(F.col("p"), F.col("config"), F.lit("in.json")), " ").alias("args"), jsonx.parameters_json(F.col("p")).alias("json"), jsonx.choose_script(F.col("event_id") % 3 == 0, F.col("event_id") % 3 == 1).alias("script"))


CLI_ARGS = """
SELECT event_id, CASE WHEN event_type = 'view' THEN '--config config/base.yaml ' ELSE '' END || CASE WHEN event_type = 'error' THEN '' ELSE '--k ' || json_extract_string(props, '$.k') || ' ' END || 'in.json' AS args,
  CASE WHEN event_type <> 'error' THEN '{"k":"' || json_extract_string(props, '$.k') || '"}' END AS json, CASE event_id % 3 WHEN 0 THEN 'cli.py' WHEN 1 THEN 'app.py' END AS script FROM events"""


# ---- events and sessions


def event_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", events.mapped(F.col("event_type"), EVENT_MAP, "raw_event").alias("type"), events.update_event(F.col("event_type")).alias("update_type"))


EVENT_MAP_SQL = f"SELECT event_id, {case_sql('event_type', EVENT_MAP, 'raw_event')} AS type, CASE event_type WHEN 'error' THEN 'run_error' ELSE 'raw_event' END AS update_type FROM events"


def event_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy(events.route(F.col("event_type"), EVENT_ROUTES).alias("branch")).agg(F.count(F.lit(1)).alias("n"))


EVENT_ROUTE = f"SELECT {case_sql('event_type', EVENT_ROUTES, 'unhandled')} AS branch, count(*) AS n FROM events GROUP BY 1"


def _user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("session_id"), F.struct("ts", "event_id").alias("at"), "ts", "event_id", "event_type", "value", "user_id")


def _at(e: DataFrame) -> DataFrame:
    return sequences.with_ordinal(e, ["session_id"], ["ts", "event_id"], "ord")


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All branches of the router at once: acknowledgements, feedback answers, session starts, unhandled events."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("ord"), F.col("event_type").alias("type"), "value")
    kind = events.route(F.col("type"), EVENT_ROUTES)
    parts = [
        events.acknowledgements(e.filter(kind == "validation").select("session_id", "ord", F.when(F.col("ord") % 2 == 0, "plan").alias("item"))),
        events.feedback_events(e.filter(kind == "feedback").select("session_id", "ord", (F.col("value") > 50).alias("approved"), F.when(F.col("ord") % 2 == 0, "soon").otherwise("").alias("comments"))),
        events.start_events(e.filter(kind == "start")),
        events.unhandled_events(e.filter(kind == "unhandled")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


FEEDBACK = """
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS ord, event_type AS t, value FROM events)
SELECT session_id, ord, CAST(1 AS BIGINT) AS seq, 'custom_event' AS type, 'Processing validation request' AS content FROM e WHERE t = 'view'
UNION ALL SELECT session_id, ord, 2, 'text_message_content', 'I understand you want to validate: ' || CASE WHEN ord % 2 = 0 THEN 'plan' ELSE 'unknown' END || '. Please confirm if this looks correct.' FROM e WHERE t = 'view'
UNION ALL SELECT session_id, ord, 1, 'text_message_content', 'Great! I''ll proceed with your approved pipeline. ' || CASE WHEN ord % 2 = 0 THEN 'Note: soon' ELSE '' END FROM e WHERE t = 'purchase' AND value > 50
UNION ALL SELECT session_id, ord, 2, 'state_delta', 'approved' FROM e WHERE t = 'purchase' AND value > 50
UNION ALL SELECT session_id, ord, 1, 'text_message_content', 'I understand. Let me revise the approach. ' || CASE WHEN ord % 2 = 0 THEN 'soon' ELSE 'What would you like me to change?' END FROM e WHERE t = 'purchase' AND NOT (value > 50)
UNION ALL SELECT session_id, ord, 1, 'custom_event', 'Session started successfully' FROM e WHERE t = 'signup'
UNION ALL SELECT session_id, ord, 1, 'raw_event', 'Unhandled event type: ' || t FROM e WHERE t = 'error'"""


def response_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as sessions: each user turn is answered by the assistant turn after it, each fifth run breaks."""
    c = read(spark, sf_dir, "conversations")
    messages = c.filter("role = 'user'").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("ord"), F.when(F.col("conv_id") % 5 == 0, "broken").alias("failed"))
    said = c.filter("role = 'assistant'").select(F.col("conv_id").alias("session_id"), (F.col("turn") - 1).alias("message_ord"), F.lit(1).alias("ord"), F.lit("assistant_message").alias("type"), F.col("text").alias("content"))
    done = messages.filter("failed IS NULL").select("session_id", F.col("ord").alias("message_ord"), F.lit(2).alias("ord"), F.lit("conversation_complete").alias("type"), F.lit("completed").alias("content"))
    return events.responses(messages, said.join(messages.select("session_id", F.col("ord").alias("message_ord")), ["session_id", "message_ord"]).unionByName(done))


RESPONSE_EVENTS = """
WITH m AS (SELECT conv_id, turn, conv_id % 5 = 0 AS bad, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'user'),
r AS (SELECT conv_id, turn, 0 AS stage, 'text_message_content' AS type, 'Hello! What would you like to analyze?' AS content FROM m WHERE k = 1
UNION ALL SELECT conv_id, turn, 1, 'run_started', 'Processing your request...' FROM m
UNION ALL SELECT m.conv_id, m.turn, 2, 'text_message_content', c.text FROM m JOIN conversations c ON c.conv_id = m.conv_id AND c.turn = m.turn + 1 AND c.role = 'assistant'
UNION ALL SELECT conv_id, turn, 3, 'run_finished', 'completed' FROM m WHERE NOT bad
UNION ALL SELECT conv_id, turn, 3, 'run_error', 'broken' FROM m WHERE bad
UNION ALL SELECT conv_id, turn, 4, 'run_finished', 'Response complete' FROM m)
SELECT conv_id AS session_id, turn AS message_ord, row_number() OVER (PARTITION BY conv_id, turn ORDER BY stage) AS seq, type, content FROM r"""


def session_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.streaming.sessions import session_states

    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("ord"), "role", "text")
    history = c.groupBy("session_id").agg(F.md5(sequences.joined_in_order("ord", "text", "|")).alias("history"), sequences.joined_in_order("ord", "role", ",").alias("roles"))
    return session_states(c).join(history, "session_id")


SESSION_STATE = """
SELECT conv_id AS session_id, count(*) AS messages, count(*) FILTER (role = 'user') AS user_messages, min(turn) AS first_ord, max(turn) AS last_ord, arg_max(text, turn) FILTER (role = 'assistant') AS last_text,
  count(*) FILTER (role = 'user') > 0 AS welcomed, md5(string_agg(text, '|' ORDER BY turn)) AS history, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id"""


def session_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn")
    return sequences.clear(c, c.filter("conv_id % 7 = 0").select("conv_id").distinct(), ["conv_id"]).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))


SESSION_CLEAR = "SELECT conv_id, count(*) AS n FROM conversations WHERE conv_id % 7 <> 0 GROUP BY conv_id"


def session_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id")).distinct()
    pipelines = c.filter("session_id % 2 = 0").select("session_id", F.concat(F.lit("Pipeline-"), F.col("session_id").cast("string")).alias("pipeline"))
    return lookups.session_pipeline(c, pipelines, read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id")))


SESSION_PIPELINE = """
WITH c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT c_custkey AS session_id, CASE WHEN conv_id % 2 = 0 THEN 'Pipeline-' || conv_id END AS pipeline, CASE WHEN conv_id IS NULL THEN 'no session' WHEN conv_id % 2 = 0 THEN 'found' ELSE 'no pipeline' END AS status
FROM customer LEFT JOIN c ON conv_id = c_custkey"""


def welcome_inject(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = read(spark, sf_dir, "conversations").filter("role = 'user'")
    return users.select("conv_id", "turn", sequences.is_first(["conv_id"], ["turn"]).alias("welcome"))


WELCOME_INJECT = "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 AS welcome FROM conversations WHERE role = 'user'"


def response_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "assistant", "assistant_message").when(F.col("role") == "user", "tool_selected").otherwise("other")
    updates = c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("ord"), kind.alias("type"), F.col("text").alias("content"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("tool_name"))
    out = events.folded_response(updates)
    history = events.history_entries(updates).groupBy("session_id").agg(F.count_if(F.col("target") == "node").alias("nodes"))
    return out.join(history, "session_id", "left").select("session_id", "content", F.array_join("tool_calls", ",").alias("tool_calls"), "updates", F.coalesce("nodes", F.lit(0)).alias("nodes"))


RESPONSE_FOLD = """
SELECT conv_id AS session_id, coalesce(arg_max(text, turn) FILTER (role = 'assistant'), '') AS content, coalesce(string_agg('t' || turn, ',' ORDER BY turn) FILTER (role = 'user'), '') AS tool_calls,
  count(*) AS updates, count(*) FILTER (role = 'user') AS nodes FROM conversations GROUP BY conv_id"""


def update_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as an agent run: one chunk a turn, an assistant's turn calls two tools, a user's turn is a tool's result."""
    c = read(spark, sf_dir, "conversations")
    message = F.struct(F.when(F.col("role") == "assistant", "assistant").otherwise("tool").alias("kind"), F.col("text").alias("content"), F.lit("n").alias("name"), F.when(F.col("role") == "assistant", F.array(F.lit("a"), F.lit("b"))).alias("tool_calls"))
    node = F.struct(F.lit("node").alias("name"), F.array(message).alias("messages"), F.when(F.col("turn") % 2 == 0, F.lit(3)).alias("pipeline_nodes"), F.lit(0).alias("pipeline_edges"))
    chunks = c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("chunk_ord"), F.when((F.col("conv_id") % 4 == 0) & (F.col("turn") == 1), "oops").alias("error"), F.array(node).alias("nodes"))
    return events.flattened_updates(chunks)


UPDATE_FLATTEN = """
WITH c AS (SELECT * FROM conversations),
u AS (SELECT conv_id, turn, 0 AS b, CASE role WHEN 'assistant' THEN 'assistant_message' ELSE 'tool_result' END AS type, text AS content, CASE WHEN role <> 'assistant' THEN 'n' END AS tool_name FROM c
UNION ALL SELECT conv_id, turn, unnest([1, 2]), 'tool_selected', NULL, unnest(['a', 'b']) FROM c WHERE role = 'assistant'
UNION ALL SELECT conv_id, turn, 9, 'pipeline_updated', '3,0', NULL FROM c WHERE turn % 2 = 0
UNION ALL SELECT conv_id, 1000000, 0, CASE WHEN conv_id % 4 = 0 AND max(turn) FILTER (turn = 1) IS NOT NULL THEN 'error' ELSE 'conversation_complete' END, CASE WHEN conv_id % 4 = 0 AND max(turn) FILTER (turn = 1) IS NOT NULL THEN 'oops' ELSE 'completed' END, NULL FROM c GROUP BY conv_id)
SELECT conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, b) AS ord, type, content, tool_name FROM u"""


def tools_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    out = sequences.distinct_first_seen(e, ["user_id"], "event_type", F.struct("ts", "event_id"), "seen")
    return out.select("user_id", F.array_join("seen", ",").alias("seen"))


TOOLS_FIRST_SEEN = """
WITH f AS (SELECT user_id, event_type, min({'ts': ts, 'event_id': event_id}) AS k FROM events GROUP BY ALL)
SELECT user_id, string_agg(event_type, ',' ORDER BY k) AS seen FROM f GROUP BY user_id"""


def node_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("tool_id"), "ts", "event_id")
    return graph.add_nodes(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "ord", "id", "x", "y")


NODE_IDS = """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ord FROM events)
SELECT user_id, event_id, ord, event_type || '-' || ord AS id, 100.0::DOUBLE AS x, CAST(ord * 100 AS DOUBLE) AS y FROM n"""


def edge_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _at(_user_events(spark, sf_dir))
    source = F.lag("event_type").over(sequences.ordered(["session_id"], ["ord"]))
    edges = e.select("user_id", source.alias("source"), F.col("event_type").alias("target"), "ord").filter("source IS NOT NULL")
    return graph.add_edges(edges, ["user_id"], "ord")


EDGE_DEDUPE = """
WITH e AS (SELECT user_id, row_number() OVER w AS ord, lag(event_type) OVER w AS source, event_type AS target FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, source, target, min(ord) AS ord, source || '-' || target AS id FROM e WHERE source IS NOT NULL GROUP BY user_id, source, target"""


def ui_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    out = events.ui_flags(e, ["user_id"], ["ts", "event_id"], events.mapped(F.col("event_type"), UI_ACTIONS, "other"))
    out = events.ui_node_counter(out, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "view", F.col("event_id") % 4))
    name = events.ui_tool_name(F.when(F.col("event_id") % 3 == 0, F.col("event_type")), F.when(F.col("event_id") % 3 == 1, F.lit("")))
    return out.select("event_id", "streaming", "loading", "nodes_now", "announce", name.alias("tool_name"), events.ui_action(F.col("event_type")).alias("action"))


UI_FLAGS = """
SELECT event_id,
  coalesce(last_value(CASE event_type WHEN 'signup' THEN true WHEN 'click' THEN false WHEN 'purchase' THEN false WHEN 'error' THEN false END IGNORE NULLS) OVER w, false) AS streaming,
  coalesce(last_value(CASE event_type WHEN 'signup' THEN true WHEN 'purchase' THEN false WHEN 'error' THEN false END IGNORE NULLS) OVER w, false) AS loading,
  last_value(CASE WHEN event_type = 'view' THEN event_id % 4 END IGNORE NULLS) OVER w AS nodes_now, event_type = 'view' AND event_id % 4 > 0 AS announce,
  CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'Unknown Tool' END AS tool_name, CASE event_type WHEN 'error' THEN 'error' ELSE 'other' END AS action
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.heartbeats(read(spark, sf_dir, "events"), ["user_id"], "ts", "event_id").select("event_id", "beats")


HEARTBEATS = "SELECT event_id, coalesce((epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) // 30000000, 0) AS beats FROM events"


def session_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.capped(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 50).select("event_id", "user_id")


SESSION_CAP = "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 50"


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' sign-ups are connections, the last one counts; their other events are delivered to it."""
    e = _user_events(spark, sf_dir)
    opened = e.filter("event_type = 'signup'").select("session_id", F.col("at").alias("connected_at"), F.col("event_id").alias("queue"))
    return lookups.latest_connection(e.filter("event_type <> 'signup'").select("session_id", "event_id", "at"), opened).select("session_id", "event_id", "queue")


CONNECTIONS = """
WITH c AS (SELECT user_id, max({'ts': ts, 'event_id': event_id}) AS at FROM events WHERE event_type = 'signup' GROUP BY user_id)
SELECT CAST(e.user_id AS VARCHAR) AS session_id, e.event_id, c.at.event_id AS queue FROM events e JOIN c USING (user_id) WHERE event_type <> 'signup' AND {'ts': e.ts, 'event_id': e.event_id} >= c.at"""


def broadcast_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = read(spark, sf_dir, "nation").select(F.col("n_name").alias("session_id"))
    errors = read(spark, sf_dir, "events").filter("event_type = 'error'").select(F.col("user_id").alias("session_id"), "event_id")
    return lookups.broadcast_events(errors, nations).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


BROADCAST_ALL = "SELECT n_name AS session_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM nation, events WHERE event_type = 'error' GROUP BY 1"


def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"))


PREVIEW = "SELECT doc_id, text[1:200] || '...' AS preview FROM documents"


def wire_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("type"), F.col("user_id").cast("string").alias("session_id"))
    return e.select("event_id", text.sse_frame(F.to_json(F.struct("type", "session_id"))).alias("frame"))


WIRE_FRAMES = """SELECT event_id, 'data: {"type":"' || event_type || '","session_id":"' || user_id || '"}' || chr(10) || chr(10) AS frame FROM events"""


def message_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "view", "").when(F.col("event_type") != "error", F.col("event_type")).alias("message"))
    fine, rejected = events.with_message(rows)
    passed, total = sequences.tally("ok")
    both = fine.select(F.lit(True).alias("ok"), "event_id").unionByName(rejected.select(F.lit(False).alias("ok"), "event_id"))
    return both.agg(passed.alias("passed"), total.alias("total"), sequences.all_true("ok").alias("all_ok"))


MESSAGE_GUARD = "SELECT count(*) FILTER (event_type NOT IN ('view', 'error')) AS passed, count(*) AS total, bool_and(event_type NOT IN ('view', 'error')) AS all_ok FROM events"


def session_elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("user_id").agg(sequences.elapsed_seconds("ts").alias("elapsed"), sequences.last_value_by("event_type", "event_id").alias("last_type"))


SESSION_ELAPSED = "SELECT user_id, CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / 1e6 AS elapsed, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id"


def plan_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("request_id"), F.col("p_name").alias("query"))
    plans = planner.plan_requests(requests, rules=NAME_RULES[:1])
    return plans.select("request_id", text.explanation(F.col("query"), F.col("plan")).alias("explanation"))


PLAN_EXPLAIN = """
SELECT p_partkey AS request_id, 'Request: "' || p_name || '"' || chr(10) || chr(10) || '**Overview:**' || chr(10) || 'Fallback plan for: ' || p_name || chr(10) || chr(10) || '**Steps:**' || chr(10)
  || CASE WHEN contains(p_name, 'ring') OR contains(p_name, 'bolt') THEN '1. **fasten**: hold things' ELSE '1. **whisper-wrapper**: General audio analysis' END || chr(10) || chr(10)
  || chr(10) || '**Estimated time:** 1 minutes 0 seconds' || chr(10) || '**Confidence:** 50.0%' AS explanation FROM part"""


# ---- without SQL


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of conversations as a stream over what is there, in update mode: the last row of each session."""
    from strandline.streaming.sessions import run_available, session_stream

    schema = spark.read.parquet(f"{sf_dir}/conversations.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_stream_path(spark, sf_dir, "conversations"))
    sessions = session_stream(rows.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("ord"), "role", "text"), ttl_ms=None)
    out = run_available(sessions, f"sessions_{uuid.uuid4().hex}", "update", shared_folder(spark, "stream"))
    return out.groupBy("session_id").agg(*[F.max_by(c, "messages").alias(c) for c in out.columns if c not in ("session_id", "messages")], F.max("messages").alias("messages"))


def _stream_path(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A folder for a streaming source: tables are single files or folders, and a stream reads folders."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return f"{sf_dir}/{name}.parquet" if fs.getFileStatus(path).isDirectory() else f"{sf_dir}/{name}*.parquet"


def pipeline_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges of users' event pipelines to structs and back: (pipeline, kind, ord, id), equal to what went in."""
    e = _at(_user_events(spark, sf_dir)).withColumn("pipeline", F.concat(F.lit("p"), "session_id"))
    nodes = graph.add_nodes(e.select("pipeline", F.col("event_type").alias("tool_id"), F.lit("{}").alias("data"), F.col("ord").alias("event_ord")), ["pipeline"], ["event_ord"])
    w = sequences.ordered(["pipeline"], ["ord"])
    pairs = nodes.select("pipeline", F.lag("id").over(w).alias("source"), F.col("id").alias("target"), "ord").filter("source IS NOT NULL")
    edges = graph.add_edges(pairs, ["pipeline"], "ord")
    _, n, d = graph.from_struct(graph.to_struct(nodes.select("pipeline").distinct(), nodes, edges))
    return n.select("pipeline", F.lit("node").alias("kind"), "ord", "id").unionByName(d.select("pipeline", F.lit("edge").alias("kind"), "ord", "id"))


PIPELINE_GRAPH = """
WITH n AS (SELECT 'p' || user_id AS pipeline, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ord FROM events),
i AS (SELECT *, event_type || '-' || ord AS id FROM n), e AS (SELECT pipeline, ord - 1 AS ord, lag(id) OVER (PARTITION BY pipeline ORDER BY ord) || '-' || id AS id FROM i)
SELECT pipeline, 'node' AS kind, ord, id FROM i UNION ALL SELECT pipeline, 'edge', ord, id FROM e WHERE id IS NOT NULL"""


def _yaml_folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder of pipeline files, one for each region."""
    from strandline.sources import pipelines

    e = read(spark, sf_dir, "nation").select(F.concat(F.lit("Region "), F.col("n_regionkey").cast("string")).alias("pipeline"), F.col("n_name").alias("tool_id"), F.lit("{}").alias("data"), "n_nationkey")
    nodes = graph.add_nodes(e, ["pipeline"], ["n_nationkey"])
    edges = spark.createDataFrame([], "pipeline string, ord long, id string, source string, target string")
    folder = shared_folder(spark, "yaml")
    pipelines.save(graph.to_struct(nodes.select("pipeline").distinct(), nodes, edges), folder)
    return folder


def pipeline_yaml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipelines through files and back."""
    from strandline.sources import pipelines

    _, back, _ = graph.from_struct(pipelines.read_folder(spark, _yaml_folder(spark, sf_dir)))
    return back.select("pipeline", "ord", "id", "y")


PIPELINE_YAML = """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS ord FROM nation)
SELECT 'Region ' || n_regionkey AS pipeline, ord, n_name || '-' || ord AS id, CAST(ord * 100 AS DOUBLE) AS y FROM n"""


def _tool_plans(spark: SparkSession, sf_dir: str):
    """(plans, steps, registry): orders as plans of real functions, one step for each line."""
    from strandline.plans.registry import Registry

    def add(value: str, parameters: dict) -> str:
        return str(int(value) + int(parameters["by"]))

    def stop(value: str, parameters: dict) -> str:
        return '{"error": "stop"}' if int(value) % 5 == 0 else value

    registry = Registry().add("add", add).add("stop", stop)
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("plan_id"), F.col("o_custkey").cast("string").alias("input"))
    lines = read(spark, sf_dir, "lineitem").withColumn("plan_id", F.col("l_orderkey").cast("string"))  # numbered by plan_id, so that they lie as the plans do
    steps = sequences.with_ordinal(sequences.dealt(lines, ["plan_id"], lines.count()), ["plan_id"], LINE_ORDER, "step")
    steps = steps.select("plan_id", "step", F.when(F.col("step") % 2 == 1, "add").otherwise("stop").alias("tool_name"), F.create_map(F.lit("by"), F.col("l_linenumber").cast("string")).alias("parameters"))
    return orders, steps, registry


def tool_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans run by real functions, each step on the output of the one before."""
    parts = sequences.parts_for(spark, read(spark, sf_dir, "lineitem").count() + read(spark, sf_dir, "orders").count())
    return execution.run_plans(*_tool_plans(spark, sf_dir), parts).select("plan_id", "step", "tool_name", "success", "output", "error")


TOOL_RUNS = f"""
WITH RECURSIVE s AS (SELECT l_orderkey AS k, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER_SQL}) AS step FROM lineitem),
r AS (SELECT o_orderkey AS k, CAST(0 AS BIGINT) AS step, CAST(o_custkey AS BIGINT) AS v, true AS ok FROM orders
UNION ALL SELECT s.k, s.step, CASE WHEN s.step % 2 = 1 THEN r.v + s.n ELSE r.v END, s.step % 2 = 1 OR r.v % 5 <> 0 FROM r JOIN s ON s.k = r.k AND s.step = r.step + 1 WHERE r.ok)
SELECT CAST(k AS VARCHAR) AS plan_id, step, CASE WHEN step % 2 = 1 THEN 'add' ELSE 'stop' END AS tool_name, ok AS success, CASE WHEN ok THEN CAST(v AS VARCHAR) END AS output, CASE WHEN NOT ok THEN 'stop' END AS error FROM r WHERE step > 0"""

def pipeline_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.sources import pipelines

    return pipelines.list_names(spark, _yaml_folder(spark, sf_dir))


PIPELINE_NAMES = "SELECT DISTINCT 'region_' || n_regionkey || '.yaml' AS file, 'Region ' || n_regionkey AS name FROM nation"


# ---- catalogs, documents, logs


def _shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog of brands: each part is a version of its brand's app, and the details are those of one part."""
    parts = read(spark, sf_dir, "part")
    versions = F.when(F.col("p_size") % 5 == 0, F.array().cast("array<array<string>>")).otherwise(F.array(F.array("p_name", F.lit("x"))))
    index = parts.select(F.col("p_partkey").alias("ord"), F.concat(F.lit("http://apps/"), "p_brand").alias("app_url"), F.when(F.col("p_size") % 7 > 0, F.col("p_type")).alias("description"), F.lit(None).cast("string").alias("latest_update"), versions.alias("versions"))
    one = part_catalog(parts.groupBy("p_brand").agg(F.min("p_partkey").alias("p_partkey")).filter("p_brand <> 'Brand#13'").join(parts.drop("p_brand"), "p_partkey"))
    return catalog.shape_catalog(index, one.select(F.col("latest_version").alias("app_name"), "input", "output", "parameters"))


def catalog_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shaped catalog, written as a snapshot and read again."""
    from strandline.sources import catalogs

    path = shared_folder(spark, "catalog")
    catalogs.write_snapshot(_shaped(spark, sf_dir), path)
    shaped = catalogs.read_snapshot(spark, path)
    return shaped.select("ord", "app_name", "latest_version", "description", F.get("output", F.lit(0))["type"].alias("gives"), F.size("input").cast("long").alias("inputs"), F.size("parameters").cast("long").alias("parameters"))


CATALOG_SHAPE = """
WITH one AS (SELECT p_brand, arg_min(p_type, p_partkey) AS gives, arg_min(p_size % 3, p_partkey) AS k FROM part WHERE p_brand <> 'Brand#13' GROUP BY p_brand)
SELECT min(p_partkey) AS ord, p_brand AS app_name, arg_max(CASE WHEN p_size % 5 = 0 THEN 'unknown' ELSE p_name END, p_partkey) AS latest_version, arg_max(CASE WHEN p_size % 7 > 0 THEN p_type ELSE '' END, p_partkey) AS description,
  any_value(gives) AS gives, CAST(CASE WHEN any_value(k) < 2 THEN 1 ELSE 0 END AS BIGINT) AS inputs, CAST(CASE WHEN any_value(gives) IS NULL THEN 0 ELSE 1 END AS BIGINT) AS parameters
FROM part LEFT JOIN one USING (p_brand) GROUP BY p_brand"""


def catalog_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.pick_app(_shaped(spark, sf_dir), "Brand#12").select("ord", "app_name", "latest_version", "description")


CATALOG_PICK = f"SELECT ord, app_name, latest_version, description FROM ({CATALOG_SHAPE}) WHERE app_name = 'Brand#12'"


def catalog_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata bodies, some of which do not parse, and an index of them through a file and back."""
    from strandline.sources import catalogs

    parts = read(spark, sf_dir, "part")
    kind = F.concat(F.lit('{"@type": "'), "p_type", F.lit('"}'))
    body = F.when(F.col("p_size") % 4 == 0, F.lit("no json")).otherwise(F.concat(F.lit('{"input": ['), kind, F.lit(", ["), kind, F.lit(", "), kind, F.lit(']], "output": [{"@type": "'), "p_brand", F.lit('", "properties": {"n": 1}}], "parameters": [{"name": "p", "default": 0}]}')))
    details = catalogs.parse_details(parts.select(F.col("p_partkey").cast("string").alias("app_name"), body.alias("body")))
    nations = read(spark, sf_dir, "nation").orderBy("n_nationkey").agg(F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list(F.concat(F.lit('"http://a/'), F.format_string("%03d", "n_nationkey"), F.lit('": {"description": "'), "n_name", F.lit('", "versions": [["v'), F.col("n_regionkey").cast("string"), F.lit('", "x"]]}')))), ", "), F.lit("}")).alias("value"))
    path = shared_folder(spark, "index")
    nations.write.mode("overwrite").text(path)
    index = catalogs.read_index(spark, path)
    first = details.select("app_name", F.array_join(F.transform("input", lambda s: F.array_join(F.transform(s, lambda t: t["type"]), "|")), ",").alias("takes"), F.get("output", F.lit(0))["properties"]["n"].alias("n"), F.get("parameters", F.lit(0))["default"].alias("latest"))
    return first.unionByName(index.select(F.col("app_url").alias("app_name"), F.col("description").alias("takes"), F.col("ord").cast("string").alias("n"), names.latest_version(F.col("versions")).alias("latest")))


CATALOG_DETAILS = """
SELECT CAST(p_partkey AS VARCHAR) AS app_name, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_type || ',' || p_type || '|' || p_type END AS takes, CASE WHEN p_size % 4 <> 0 THEN '1' END AS n, CASE WHEN p_size % 4 <> 0 THEN '0' END AS latest FROM part
UNION ALL SELECT 'http://a/' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0'), n_name, CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS VARCHAR), 'v' || n_regionkey FROM nation"""


def documents_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interchange documents written as files, read whole and taken apart; some do not parse."""
    from strandline.sources import documents

    p = read(spark, sf_dir, "part")
    body = F.when(F.col("p_size") % 6 == 0, F.lit("{")).otherwise(F.concat(F.lit('{"documents": [{"@type": "'), "p_type", F.lit('", "properties": {"mime": "'), "p_brand", F.lit('", "id": "'), F.col("p_partkey").cast("string"), F.lit('", "location": "'), "p_name", F.lit('"}}]}')))
    path = shared_folder(spark, "documents")
    p.select(body.alias("value")).write.mode("overwrite").text(path)
    lines = documents.read_documents(spark, path, "*.txt").select("path", F.explode(F.split("body", "\n")).alias("body"))
    return documents.document_parts(lines).select("type", "mime", "id", "location")


DOCUMENTS_PARTS = "SELECT p_type AS type, p_brand AS mime, CAST(p_partkey AS VARCHAR) AS id, p_name AS location FROM part WHERE p_size % 6 <> 0"


def log_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended to a log, and its records read again with the JSON in them."""
    from strandline.sources import logs

    e = read(spark, sf_dir, "events")
    body = F.concat(F.lit('{"type": "'), "event_type", F.lit('", "session_id": "s", "data": {"message": "'), F.col("event_id").cast("string"), F.lit('"}}'))
    path = shared_folder(spark, "log")
    logs.append_log(e.select(F.col("ts").cast("timestamp").alias("at"), F.col("user_id").cast("string").alias("session_id"), F.upper("event_type").alias("log_type"), body.alias("body")), path)
    return logs.log_events(logs.read_log(spark, path)).select(F.unix_millis("log_ts").alias("at_ms"), "session_id", "log_type", "type", "message")


LOG_ROUND_TRIP = "SELECT epoch_us(ts) // 1000 AS at_ms, CAST(user_id AS VARCHAR) AS session_id, upper(event_type) AS log_type, event_type AS type, CAST(event_id AS VARCHAR) AS message FROM events"


# ---- edges, names and nodes by their own operators


def connection_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive tools of an order, valid if a namespace of the one's outputs is one of the other's inputs."""
    parts = read(spark, sf_dir, "part")

    def kind(number: Column) -> Column:
        return F.struct(F.concat(F.lit("http://n"), number.cast("string"), F.lit("/"), "p_type").alias("type"), F.lit(True).alias("required"), F.create_map().cast("map<string,string>").alias("properties"))

    tools = parts.filter("p_size <= 45").select(F.col("p_partkey").alias("app_name"), F.array(kind(F.col("p_size") % 3)).alias("output"), F.array(F.array(kind(F.col("p_partkey") % 3))).alias("input"))
    steps = _steps(spark, sf_dir).select("l_orderkey", "step", "l_partkey")
    edges = steps.select("l_orderkey", "step", F.lag("l_partkey").over(sequences.ordered(["l_orderkey"], ["step"])).alias("source_tool"), F.col("l_partkey").alias("target_tool")).filter("source_tool IS NOT NULL")
    return compat.valid_connections(edges, tools).select("l_orderkey", "step", "source_tool", "target_tool", "edge_type")


CONNECTION_VALIDITY = f"""
WITH {STEPS_SQL}, e AS (SELECT plan_id AS l_orderkey, step, lag(tool_name) OVER (PARTITION BY plan_id ORDER BY step) AS source_tool, tool_name AS target_tool FROM s)
SELECT l_orderkey, step, source_tool, target_tool, CASE WHEN a.p_size % 3 = b.p_partkey % 3 THEN 'default' ELSE 'invalid' END AS edge_type
FROM e JOIN part a ON a.p_partkey = source_tool AND a.p_size <= 45 JOIN part b ON b.p_partkey = target_tool AND b.p_size <= 45"""


def shown_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of users' event pipelines; those that lead to no node are not shown."""
    e = _at(_user_events(spark, sf_dir)).withColumn("pipeline", F.concat(F.lit("p"), "session_id"))
    nodes = graph.add_nodes(e.select("pipeline", F.col("event_type").alias("tool_id"), F.col("ord").alias("event_ord"), "event_id"), ["pipeline"], ["event_ord"])
    source = F.lag("id").over(sequences.ordered(["pipeline"], ["ord"]))
    edges = nodes.select("pipeline", source.alias("source"), F.when(F.col("event_id") % 3 == 0, "gone").otherwise(F.col("id")).alias("target"), "ord").filter("source IS NOT NULL")
    return graph.displayed_edges(graph.add_edges(edges, ["pipeline"], "ord"), nodes).select("pipeline", "id", "source_tool", "target_tool")


SHOWN_EDGES = """
WITH n AS (SELECT 'p' || user_id AS pipeline, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ord FROM events),
i AS (SELECT *, event_type || '-' || ord AS id FROM n), e AS (SELECT *, lag(id) OVER w AS source, lag(event_type) OVER w AS source_tool FROM i WINDOW w AS (PARTITION BY pipeline ORDER BY ord))
SELECT pipeline, source || '-' || id AS id, source_tool, event_type AS target_tool FROM e WHERE source IS NOT NULL AND event_id % 3 <> 0"""


def node_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 4
    name, url = F.when(k == 0, F.col("p_name")).when(k == 1, ""), F.when(k < 3, F.when(k == 2, F.concat(F.lit("http://a/"), "p_brand")).otherwise(F.lit("http://a/")))
    return read(spark, sf_dir, "part").select("p_partkey", names.display_name(name, url, F.concat(F.lit("n-"), F.col("p_partkey").cast("string"))).alias("name"))


NODE_NAMES = "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_name WHEN 2 THEN p_brand ELSE 'n-' || p_partkey END AS name FROM part"


def conversation_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.struct("ts", "event_id").alias("ord"), F.when(F.col("event_type") == "view", "other").otherwise("tool_selected").alias("type"), F.when(F.col("event_type") != "error", F.col("event_type")).otherwise("").alias("tool_name"))
    return graph.from_tool_events(e).select("pipeline", "ord", "id", "x", "y")


CONVERSATION_NODES = """
WITH n AS (SELECT 'Pipeline-' || user_id AS pipeline, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ord FROM events WHERE event_type NOT IN ('view', 'error'))
SELECT pipeline, ord, event_type || '-' || ord AS id, 100.0::DOUBLE AS x, CAST(ord * 100 AS DOUBLE) AS y FROM n"""


def preview_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, more = sequences.head_and_more(read(spark, sf_dir, "part").select("p_partkey", "p_name"), ["p_name", "p_partkey"])
    return first.select("p_partkey", F.lit(None).cast("long").alias("more")).unionByName(more.select(F.lit(None).cast("long").alias("p_partkey"), "more"))


PREVIEW_MORE = "SELECT * FROM (SELECT p_partkey, CAST(NULL AS BIGINT) AS more FROM part ORDER BY p_name, p_partkey LIMIT 5) UNION ALL SELECT NULL, greatest(count(*) - 5, 0) FROM part"


def catalog_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry with a tool for each app of the catalog, and plans of one step each that call it."""
    from strandline.plans import registry

    tools = registry.from_catalog(_shaped(spark, sf_dir), lambda name: registry.echo)
    parts = read(spark, sf_dir, "part")
    plans = parts.select(F.col("p_partkey").cast("string").alias("plan_id"), F.col("p_name").alias("input"))
    tool = F.when(F.col("p_size") % 9 == 0, "none").otherwise(F.col("p_brand"))
    steps = parts.select(F.col("p_partkey").cast("string").alias("plan_id"), F.lit(1).cast("long").alias("step"), tool.alias("tool_name"), F.create_map(F.lit("size"), F.col("p_size").cast("string")).alias("parameters"))
    return execution.run_plans(plans, steps, tools).select("plan_id", "tool_name", "success", "output", "error")


CATALOG_TOOLS = """
SELECT CAST(p_partkey AS VARCHAR) AS plan_id, CASE WHEN p_size % 9 = 0 THEN 'none' ELSE p_brand END AS tool_name, p_size % 9 <> 0 AS success,
  CASE WHEN p_size % 9 <> 0 THEN '{"text": "' || p_name || '", "size": "' || p_size || '"}' END AS output, CASE WHEN p_size % 9 = 0 THEN 'Tool none not found' END AS error FROM part"""


# ---- the service


SERVICE_EVENTS = {"click": "user_message", "signup": "session_start", "view": "validation_request", "purchase": "human_feedback"}


def _service(spark: SparkSession, sf_dir: str):
    """(service, incoming events): its agent repeats each message, names a tool and ends."""
    from strandline.api import Service

    def agent(messages: DataFrame) -> DataFrame:
        def row(i: int, kind: str, content: Column, tool: Column) -> Column:
            return F.struct(F.lit(i).cast("long").alias("ord"), F.lit(kind).alias("type"), content.alias("content"), tool.alias("tool_name"))

        none = F.lit(None).cast("string")
        rows = F.array(row(1, "assistant_message", F.concat(F.lit("re: "), "message"), none), row(2, "tool_selected", none, F.col("message")), row(3, "conversation_complete", F.lit("completed"), none))
        return messages.select("session_id", "message_ord", F.explode(rows).alias("u")).select("session_id", "message_ord", "u.*")

    e = read(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("ord"), events.mapped(F.col("event_type"), SERVICE_EVENTS, "odd").alias("type"), F.when(F.col("event_id") % 7 > 0, F.concat(F.lit("m"), F.col("event_id").cast("string"))).otherwise("").alias("message"),
        F.when(F.col("event_id") % 2 == 0, "plan").alias("item"), (F.col("value") > 50).alias("approved"), F.when(F.col("event_id") % 2 == 0, "soon").otherwise("").alias("comments"),
    )
    return Service(spark, _shaped(spark, sf_dir), "", agent), e


SERVICE_SQL = """
e AS (SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS ord, event_type AS t, value FROM events),
m AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ord) AS k FROM e WHERE t = 'click' AND ord % 7 > 0),
r AS (SELECT session_id, ord, 0 AS stage, 'text_message_content' AS type, 'Hello! What would you like to analyze?' AS content FROM m WHERE k = 1
UNION ALL SELECT session_id, ord, 1, 'run_started', 'Processing your request...' FROM m
UNION ALL SELECT session_id, ord, unnest([2, 3, 4]), unnest(['text_message_content', 'tool_call_start', 'run_finished']), unnest(['re: m' || ord, NULL, 'completed']) FROM m
UNION ALL SELECT session_id, ord, 5, 'run_finished', 'Response complete' FROM m),
answers AS (SELECT session_id, ord, row_number() OVER (PARTITION BY session_id, ord ORDER BY stage) AS seq, type, content FROM r
UNION ALL SELECT session_id, ord, 1, 'run_error', 'Message is required' FROM e WHERE t = 'click' AND ord % 7 = 0
UNION ALL SELECT * FROM (""" + FEEDBACK.strip().replace("WITH e AS (SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS ord, event_type AS t, value FROM events)\n", "").replace("'Unhandled event type: ' || t", "'Unhandled event type: odd'") + "))"


def service_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    service, incoming = _service(spark, sf_dir)
    return service.answer(incoming)


SERVICE_ANSWERS = f"WITH {SERVICE_SQL} SELECT session_id, ord, seq, type, content FROM answers"


def service_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    service, incoming = _service(spark, sf_dir)
    return service.stream(incoming)


SERVICE_STREAM = f"WITH {SERVICE_SQL} SELECT session_id, ord, seq, type, content FROM answers QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ord, seq) <= 50"


def service_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folded answers of all sessions, and the pipelines that their messages built."""
    service, incoming = _service(spark, sf_dir)
    clicks = incoming.filter("type = 'user_message'")
    chats = service.chat(clicks).select("session_id", "content", F.array_join("tool_calls", ",").alias("tool_calls"), "updates", "tool_added")
    return chats.join(service.session_pipelines(clicks, clicks.select("session_id").distinct()), "session_id", "right")


SERVICE_CHAT = """
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS ord FROM events WHERE event_type = 'click'),
m AS (SELECT session_id, 're: m' || max(ord) AS content, string_agg('m' || ord, ',' ORDER BY ord) AS tool_calls, count(*) * 3 AS updates FROM e WHERE ord % 7 > 0 GROUP BY session_id)
SELECT DISTINCT e.session_id, content, tool_calls, updates, CASE WHEN m.session_id IS NOT NULL THEN true END AS tool_added, CASE WHEN m.session_id IS NOT NULL THEN 'Pipeline-' || m.session_id END AS pipeline, CASE WHEN m.session_id IS NULL THEN 'no pipeline' ELSE 'found' END AS status
FROM e LEFT JOIN m ON m.session_id = e.session_id"""


def service_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests planned by the rules, and run where they have an input and all tools are there."""
    service, _ = _service(spark, sf_dir)
    service.registry.add("whisper-wrapper", lambda value, parameters: value.upper()).add("easyocr-wrapper", lambda value, parameters: '{"error": "dark"}')
    word = F.element_at(F.array(F.lit("speech"), F.lit("read"), F.lit("scene"), F.lit("plain")), (F.col("p_size") % 4 + 1).cast("int"))
    requests = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("request_id"), word.alias("query"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_name")).alias("input"))
    plans, results = service.process(requests, auto_execute=True)
    ran = results.select(F.col("plan_id").cast("long").alias("request_id"), "tool_name", "output")
    return plans.select("request_id", "issues", "status").join(ran, "request_id", "left")


SERVICE_REQUESTS = """
SELECT p_partkey AS request_id, CAST(CASE WHEN p_size % 4 = 2 THEN 1 ELSE 0 END AS BIGINT) AS issues,
  CASE WHEN p_partkey % 3 = 0 THEN 'planned' WHEN p_size % 4 = 2 THEN 'validation_failed' WHEN p_size % 4 = 1 THEN 'execution_failed' ELSE 'completed' END AS status,
  CASE WHEN p_partkey % 3 > 0 THEN CASE p_size % 4 WHEN 1 THEN 'easyocr-wrapper' WHEN 2 THEN NULL ELSE 'whisper-wrapper' END END AS tool_name,
  CASE WHEN p_partkey % 3 > 0 AND p_size % 4 IN (0, 3) THEN upper(p_name) END AS output FROM part"""

# ---- state across batches and restarts


def _two_runs(spark: SparkSession, rows: DataFrame, first: Column, make: Callable[[DataFrame], DataFrame], last: DataFrame | None = None) -> DataFrame:
    """What make() gives for rows as a stream whose first part is run over before the rest arrives; the second run starts from the checkpoint."""
    from strandline.streaming.sessions import run_available

    folder = shared_folder(spark, "stream")
    for i, part in enumerate((rows.filter(first), rows.filter(~first))):
        part.write.mode("append").parquet(f"{folder}/in/part={i}")
        if i and last is not None:
            last.write.mode("append").parquet(f"{folder}/in/part={i}")
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        out = run_available(make(stream), f"run_{uuid.uuid4().hex}", "append", f"{folder}/state")
    return out


def session_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user message with its session's history before it; the history lives in the stream's state over a restart."""
    from strandline.streaming.keyed import remembered

    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("long").alias("ord"), "role", "text")
    out = _two_runs(spark, c, F.col("ord") < 2, remembered)
    said = F.array_join(F.transform("history", lambda h: F.concat(h["role"], F.lit(":"), F.coalesce(h["text"], F.lit("")))), "|")
    return out.select("session_id", "ord", "text", "first", F.size("history").cast("long").alias("n_before"), F.md5(said).alias("history"))


SESSION_MEMORY = """
WITH h AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(turn AS BIGINT) AS ord, role, text, coalesce(count(*) FILTER (role = 'user') OVER w, 0) = 0 AS first, count(*) OVER w AS n_before,
  md5(coalesce(string_agg(role || ':' || coalesce(text, ''), '|') OVER w, '')) AS history FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT session_id, ord, text, first, n_before, history FROM h WHERE role = 'user'"""


def _recalling(said: list[dict]) -> str:
    """A stand-in for a model, which tells what it has been given."""
    return f"{len(said) - 2} before, last {len(said[-2]['content'])}: {said[-1]['content']}" if len(said) > 2 else f"new: {said[-1]['content']}"


def agent_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User messages answered by an agent that is given its session's earlier messages and its own answers, over a restart."""
    from strandline.plans.agents import updates_of
    from strandline.plans.registry import Registry
    from strandline.streaming.keyed import conversation

    c = read(spark, sf_dir, "conversations").filter("role = 'user'").select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("long").alias("ord"), F.coalesce("text", F.lit("")).alias("text"))
    out = _two_runs(spark, c, F.col("ord") < 2, lambda m: conversation(m, updates_of(_recalling, Registry())))
    return out.select("session_id", "message_ord", "ord", "type", "content")


AGENT_MEMORY = """
WITH RECURSIVE m AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(turn AS BIGINT) AS message_ord, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'user'),
r AS (SELECT session_id, message_ord, k, 'new: ' || text AS content FROM m WHERE k = 1
UNION ALL SELECT m.session_id, m.message_ord, m.k, 2 * r.k || ' before, last ' || length(r.content) || ': ' || m.text FROM r JOIN m ON m.session_id = r.session_id AND m.k = r.k + 1)
SELECT session_id, message_ord, CAST(1 AS BIGINT) AS ord, 'assistant_message' AS type, content FROM r UNION ALL SELECT session_id, message_ord, 2, 'conversation_complete', 'completed' FROM r"""


def delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups and other events as two streams: each event with the connection that is open at its time, over a restart."""
    from strandline.streaming.keyed import deliver

    e = _user_events(spark, sf_dir).select("session_id", F.col("ts").cast("timestamp").alias("at"), F.col("event_id").cast("long").alias("seq"), F.when(F.col("event_type") == "signup", F.col("event_id").cast("string")).alias("queue"))
    middle = e.agg(F.expr("timestamp_micros((unix_micros(min(at)) + unix_micros(max(at))) div 2)").alias("middle"))
    split = e.join(F.broadcast(middle))  # one row
    close = e.agg(F.lit("").alias("session_id"), (F.max("at") + F.expr("INTERVAL 2 DAYS")).alias("at"), F.lit(-1).cast("long").alias("seq"), F.lit("close").alias("queue"), F.max("at").alias("middle"))  # moves the watermark past all rows
    # some of the first half arrive with the second, late by less than the watermark allows
    first = (F.col("at") < F.col("middle")) & ~((F.col("seq") % 5 == 0) & (F.col("at") > F.col("middle") - F.expr("INTERVAL 12 HOURS")))
    make = lambda both: deliver(both.filter("queue IS NULL"), both.filter("queue IS NOT NULL"), "1 day")
    return _two_runs(spark, split, first, make, close).select("session_id", F.col("seq").alias("event_id"), F.col("queue").cast("long").alias("queue"))


DELIVERY = """
WITH o AS (SELECT user_id, event_id, event_type, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS queue FROM events)
SELECT CAST(user_id AS VARCHAR) AS session_id, event_id, queue FROM o WHERE event_type <> 'signup' AND queue IS NOT NULL"""


def frame_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 frames of each user's stream, counted over two runs."""
    from strandline.streaming.keyed import capped_stream

    e = _at(_user_events(spark, sf_dir)).select("session_id", F.col("ord").cast("long").alias("ord"), F.col("event_type").alias("frame"))
    return _two_runs(spark, e, F.col("ord") <= 30, lambda s: capped_stream(s, 50))


FRAME_CAP = "SELECT CAST(user_id AS VARCHAR) AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord, event_type AS frame FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 50"


# ---- answers kept, and plans run in rounds


def planned_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests made of parts, planned by a model that fails at first on some: equal requests share one answer of the ledger."""
    from strandline.plans.agents import model_planner

    def model(said: list[dict], seen={}) -> str:  # noqa: B006
        query = said[-1]["content"]
        seen[query] = seen.get(query, 0) + 1
        if query.startswith("size 7") and seen[query] % 3:  # twice in three calls
            raise ValueError("busy")
        if query.startswith("size 9"):
            raise ValueError("no plan for " + query)
        return '{"steps": [{"tool_name": "%s"}, {"tool_name": "keep"}], "reasoning": "r", "confidence": 0.5, "input_types": [], "output_types": [], "estimated_time": 3}' % query.replace(" ", "-")

    requests = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("request_id"), F.concat(F.lit("size "), F.col("p_size").cast("string"), F.lit(" "), F.col("p_brand")).alias("query"))
    folder = shared_folder(spark, "planned")
    planner_of = model_planner(model, folder=f"{folder}/ledger", attempts=4)
    plans = planner.plan_requests(requests, planner_of, path=f"{folder}/planned")
    kept = planner_of(requests).select("request_id", "attempts")  # all from the ledger by now
    return plans.join(kept, "request_id").select("request_id", F.array_join("plan.steps.tool_name", ",").alias("tools"), "attempts", F.col("plan.confidence").alias("confidence"))


PLANNED_ONCE = """
SELECT p_partkey AS request_id, CASE WHEN p_size = 9 OR p_size // 10 = 9 THEN 'whisper-wrapper' ELSE 'size-' || p_size || '-' || p_brand || ',keep' END AS tools,
  CAST(CASE WHEN starts_with('size ' || p_size, 'size 9') THEN 4 WHEN starts_with('size ' || p_size, 'size 7') THEN 3 ELSE 1 END AS BIGINT) AS attempts, CASE WHEN starts_with('size ' || p_size, 'size 9') THEN 0.1::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM part"""


def _stepwise(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """(folder, results) of the plans of tool_runs, run for two rounds, then on to the end from what these wrote."""
    from strandline.plans.stepwise import run_stepwise

    orders, lines, registry = _tool_plans(spark, sf_dir)
    folder, parts = shared_folder(spark, "rounds"), sequences.parts_for(spark, read(spark, sf_dir, "lineitem").count())
    run_stepwise(orders, lines, registry, folder, most_rounds=2, partitions=parts)
    return folder, run_stepwise(orders, lines, registry, folder)


def stepwise_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stepwise(spark, sf_dir)[1]


def stepwise_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The progress rows that the rounds of all plans leave."""
    from strandline.plans.stepwise import progress_so_far

    return progress_so_far(spark, _stepwise(spark, sf_dir)[0])


STEPWISE_PROGRESS = f"""
WITH x AS ({{TOOL_RUNS}}),
n AS (SELECT CAST(o_orderkey AS VARCHAR) AS plan_id, count(l_orderkey) AS total_steps FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
r AS (SELECT x.*, total_steps FROM x JOIN n USING (plan_id)),
p AS (SELECT plan_id, unnest([3 * step - 2, 3 * step - 1, 3 * step]) AS seq, step AS current_step, total_steps, tool_name AS step_name, unnest(['starting', 'running', CASE WHEN success THEN 'completed' ELSE 'failed' END]) AS status,
  unnest([CAST(step - 1 AS DOUBLE) / total_steps * 100, (CAST(step - 1 AS DOUBLE) + 0.5::DOUBLE) / total_steps * 100, CAST(step AS DOUBLE) / total_steps * 100]) AS percentage FROM r),
e AS (SELECT n.plan_id, 3 * count(step) + 1 AS seq, any_value(n.total_steps) AS current_step, any_value(n.total_steps) AS total_steps, 'pipeline' AS step_name, CASE WHEN coalesce(bool_and(success), true) THEN 'completed' ELSE 'failed' END AS status, 100.0::DOUBLE AS percentage FROM n LEFT JOIN x USING (plan_id) GROUP BY n.plan_id)
SELECT * FROM p UNION ALL SELECT * FROM e""".replace("{TOOL_RUNS}", TOOL_RUNS)


# ---- sources and sinks of its own


def frame_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as wire frames and taken in from there as a stream, some of them after a restart."""
    from strandline.sources import documents, tail
    from strandline.streaming.sessions import run_available

    workers_import(spark)
    spark.dataSource.register(tail.RecordTail)
    folder = shared_folder(spark, "frames")
    e = read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("type"), F.create_map(F.lit("message"), F.coalesce("props", F.lit(""))).alias("data"), F.col("event_id").cast("string").alias("timestamp"), F.col("user_id").cast("string").alias("session_id"))
    for part in (F.col("event_id") % 3 == 0, F.col("event_id") % 3 != 0):
        documents.write_frames(e.filter(part), f"{folder}/in")
        frames = spark.readStream.format("record_tail").option("kind", "frames").option("chunk", str(1 << 20)).load(f"{folder}/in")
        out = run_available(frames, f"ingest_{uuid.uuid4().hex}", "append", f"{folder}/state")
    event = F.from_json(F.expr("substr(record, 7)"), "type string, data map<string,string>, timestamp string, session_id string")
    return out.select(event.alias("e")).select("e.session_id", F.col("e.timestamp").cast("long").alias("event_id"), "e.type", F.col("e.data")["message"].alias("message"))


FRAME_INGEST = "SELECT CAST(user_id AS VARCHAR) AS session_id, event_id, event_type AS type, coalesce(props, '') AS message FROM events"


def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of a thousand events each, followed while they grow: first three fifths of each file, which ends within a record, then all of it."""
    from strandline.sources import logs, tail
    from strandline.sources.named_files import write_files
    from strandline.streaming.sessions import run_available

    workers_import(spark)
    spark.dataSource.register(tail.RecordTail)
    folder = shared_folder(spark, "tail")
    body = F.concat(F.lit('{\n  "type": "'), "event_type", F.lit('",\n  "session_id": "s",\n  "data": {"message": "'), F.col("event_id").cast("string"), F.lit('"}\n}'))
    e = read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"), F.col("user_id").cast("string").alias("session_id"), F.upper("event_type").alias("log_type"), body.alias("body"))
    lines = e.select("event_id", F.concat(logs.log_lines(e), F.lit("\n")).alias("line"))
    whole = lines.groupBy(F.floor(F.col("event_id") / 1000).alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"]), "").alias("body"))
    files = written(whole.select(F.concat(F.lit("events-"), F.col("file").cast("string"), F.lit(".log")).alias("name"), "body"), f"{folder}/whole")  # made once for both shares
    for share in (0.6, 1.0):
        write_files(files.withColumn("body", F.expr(f"substr(body, 1, int(ceil(length(body) * {share})))")), f"{folder}/in")
        records = spark.readStream.format("record_tail").option("chunk", str(1 << 16)).load(f"{folder}/in")
        out = run_available(records, f"tail_{uuid.uuid4().hex}", "append", f"{folder}/state")
    return logs.log_events(logs.parse_log(out, "record")).select(F.unix_millis("log_ts").alias("at_ms"), "session_id", "log_type", "type", "message")


def frame_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 events of each user through the sink of frames, in two runs; and read from its committed batches."""
    from strandline.sources import frame_sink as sink
    from strandline.streaming.keyed import capped_stream

    workers_import(spark)
    spark.dataSource.register(sink.FrameSink)
    folder = shared_folder(spark, "sink")
    e = _at(_user_events(spark, sf_dir)).select("session_id", F.col("ord").cast("long").alias("ord"), "event_type")
    frame = text.sse_frame(F.to_json(F.struct("session_id", "ord", F.col("event_type").alias("type"))))
    rows = e.select("session_id", "ord", frame.alias("frame"))
    for i, part in enumerate((rows.filter("ord <= 30"), rows.filter("ord > 30"))):
        part.write.mode("append").parquet(f"{folder}/in/part={i}")
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        query = capped_stream(stream, 50).repartition("session_id").writeStream.format("frame_sink").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    event = F.from_json(F.expr("substr(record, 7)"), "session_id string, ord long, type string")
    return sink.read_frames(spark, f"{folder}/out").select(event.alias("e")).select("e.*")


FRAME_SINK = FRAME_CAP.replace("event_type AS frame", "event_type AS type")


def _served_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog whose apps are the brands of part, loaded from an index and details in files; some details can't be read."""
    from strandline.sources.catalog_source import catalog_table
    from strandline.sources.named_files import write_files

    parts = read(spark, sf_dir, "part")
    brands = parts.groupBy("p_brand").agg(F.min("p_partkey").alias("first"), F.max_by("p_name", "p_partkey").alias("version"), F.max_by("p_type", "p_partkey").alias("kind"), F.count(F.lit(1)).alias("n"))
    entry = F.to_json(F.create_map(F.concat(F.lit("http://apps/"), "p_brand"), F.struct(F.col("kind").alias("description"), F.when(F.col("n") % 3 > 0, F.array(F.array("version", F.lit("x")))).alias("versions"))))
    index = brands.agg(F.array_sort(F.collect_list(F.struct("first", F.regexp_replace(entry, r"^\{|\}$", "").alias("e")))).alias("es"))  # an index is one object, with an entry for each app
    index = index.select(F.lit("index.json").alias("name"), F.concat(F.lit("{"), F.array_join(F.transform("es", lambda x: x["e"]), ", "), F.lit("}")).alias("body"))
    detail = F.when(F.col("n") % 5 == 0, "broken").otherwise(F.to_json(F.struct(F.array(F.struct(F.col("kind").alias("@type")), F.struct(F.col("p_brand").alias("@type"))).alias("output"), F.array(F.struct(F.lit("n").alias("name"), F.col("n").cast("string").alias("default"))).alias("parameters"))))
    details = brands.select(F.concat_ws("/", "p_brand", F.when(F.col("n") % 3 > 0, F.col("version")).otherwise("unknown"), F.lit("metadata.json")).alias("name"), detail.alias("body"))
    folder = shared_folder(spark, "apps")
    write_files(details.unionByName(index), folder)
    return catalog_table(spark, folder, group=4)


def catalog_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = _served_catalog(spark, sf_dir)
    return shown.select("ord", "app_name", "latest_version", "description", F.array_join(F.transform("output", lambda o: o["type"]), ",").alias("gives"), F.get("parameters", F.lit(0))["default"].alias("n"), F.size("input").cast("long").alias("inputs"))


CATALOG_LOAD = """
WITH b AS (SELECT p_brand, min(p_partkey) AS first, arg_max(p_name, p_partkey) AS version, arg_max(p_type, p_partkey) AS kind, count(*) AS n FROM part GROUP BY p_brand)
SELECT row_number() OVER (ORDER BY first) - 1 AS ord, p_brand AS app_name, CASE WHEN n % 3 > 0 THEN version ELSE 'unknown' END AS latest_version, kind AS description, CASE WHEN n % 5 = 0 THEN '' ELSE kind || ',' || p_brand END AS gives,
  CASE WHEN n % 5 > 0 THEN CAST(n AS VARCHAR) END AS n, CAST(0 AS BIGINT) AS inputs FROM b"""


def catalog_load_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One app: the name reaches the source, which asks for one detail."""
    return catalog.pick_app(_served_catalog(spark, sf_dir), "Brand#12").select("app_name", "latest_version", "description", F.array_join(F.transform("output", lambda o: o["type"]), ",").alias("gives"))


CATALOG_LOAD_ONE = f"SELECT app_name, latest_version, description, gives FROM ({CATALOG_LOAD}) WHERE app_name = 'Brand#12'"


def pipelines_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipelines of all users' events, each written to its file by the tasks that hold it, and read again."""
    from strandline.sources import pipelines

    e = _at(_user_events(spark, sf_dir)).select(F.concat(F.lit("User "), "session_id").alias("pipeline"), F.col("event_type").alias("tool_id"), F.lit("{}").alias("data"), F.col("ord").alias("event_ord"))
    nodes = graph.add_nodes(e, ["pipeline"], ["event_ord"])
    w = sequences.ordered(["pipeline"], ["ord"])
    edges = graph.add_edges(nodes.select("pipeline", F.lag("id").over(w).alias("source"), F.col("id").alias("target"), "ord").filter("source IS NOT NULL"), ["pipeline"], "ord")
    folder = shared_folder(spark, "pipelines")
    pipelines.save(graph.to_struct(nodes.select("pipeline").distinct(), nodes, edges), folder)
    back = pipelines.read_folder(spark, folder)
    return back.select("name", F.size("nodes").cast("long").alias("nodes"), F.size("edges").cast("long").alias("edges"), F.md5(F.array_join(F.transform("nodes", lambda n: n["id"]), ",")).alias("ids"), F.md5(F.array_join(F.transform("edges", lambda x: F.concat(x["source"], F.lit(">"), x["target"])), ",")).alias("links"))


PIPELINES_WRITTEN = """
WITH n AS (SELECT user_id, event_type || '-' || (row_number() OVER w - 1) AS id, row_number() OVER w AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
x AS (SELECT *, lag(id) OVER (PARTITION BY user_id ORDER BY i) || '>' || id AS link FROM n)
SELECT 'User ' || user_id AS name, count(*) AS nodes, count(link) AS edges, md5(string_agg(id, ',' ORDER BY i)) AS ids, md5(coalesce(string_agg(link, ',' ORDER BY i), '')) AS links FROM x GROUP BY user_id"""



ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "type_clean": (type_clean, TYPE_CLEAN), "type_namespace": (type_namespace, TYPE_NAMESPACE), "catalog_latest": (catalog_latest, CATALOG_LATEST), "catalog_describe": (catalog_describe, CATALOG_DESCRIBE),
    "compat_pairs": (compat_pairs, COMPAT_PAIRS), "suggest_top5": (suggest_top5, SUGGEST_TOP5), "edge_validity": (edge_validity, EDGE_VALIDITY), "validate_plan": (validate_plan, VALIDATE_PLAN),
    "plan_progress": (plan_progress, PLAN_PROGRESS), "plan_status": (plan_status, PLAN_STATUS), "step_chain": (step_chain, STEP_CHAIN), "error_detect": (error_detect, ERROR_DETECT), "cli_args": (cli_args, CLI_ARGS),
    "event_map": (event_map, EVENT_MAP_SQL), "event_route": (event_route, EVENT_ROUTE), "session_state": (session_state, SESSION_STATE), "welcome_inject": (welcome_inject, WELCOME_INJECT), "response_fold": (response_fold, RESPONSE_FOLD),
    "tools_first_seen": (tools_first_seen, TOOLS_FIRST_SEEN), "node_ids": (node_ids, NODE_IDS), "edge_dedupe": (edge_dedupe, EDGE_DEDUPE), "ui_flags": (ui_flags, UI_FLAGS), "heartbeats": (heartbeats, HEARTBEATS), "session_cap": (session_cap, SESSION_CAP),
    "preview": (preview, PREVIEW), "intent": (intent, _intent_sql()), "slug": (slug, SLUG), "palette_rank": (palette_rank, PALETTE_RANK), "palette_unicode": (palette_unicode, PALETTE_UNICODE), "health": (health, HEALTH), "available_tools": (available_tools, AVAILABLE_TOOLS), "tool_directories": (tool_directories, TOOL_DIRECTORIES),
    "plan_convert": (plan_convert, PLAN_CONVERT), "plan_explain": (plan_explain, PLAN_EXPLAIN), "feedback": (feedback, FEEDBACK), "response_events": (response_events, RESPONSE_EVENTS), "update_flatten": (update_flatten, UPDATE_FLATTEN), "session_clear": (session_clear, SESSION_CLEAR),
    "session_pipeline": (session_pipeline, SESSION_PIPELINE), "connections": (connections, CONNECTIONS), "broadcast_all": (broadcast_all, BROADCAST_ALL), "wire_frames": (wire_frames, WIRE_FRAMES), "message_guard": (message_guard, MESSAGE_GUARD), "session_elapsed": (session_elapsed, SESSION_ELAPSED),
    "catalog_shape": (catalog_shape, CATALOG_SHAPE), "catalog_pick": (catalog_pick, CATALOG_PICK), "catalog_details": (catalog_details, CATALOG_DETAILS), "documents_parts": (documents_parts, DOCUMENTS_PARTS), "log_round_trip": (log_round_trip, LOG_ROUND_TRIP),
    "connection_validity": (connection_validity, CONNECTION_VALIDITY), "shown_edges": (shown_edges, SHOWN_EDGES), "node_names": (node_names, NODE_NAMES), "conversation_nodes": (conversation_nodes, CONVERSATION_NODES), "preview_more": (preview_more, PREVIEW_MORE), "catalog_tools": (catalog_tools, CATALOG_TOOLS),
    "service_answers": (service_answers, SERVICE_ANSWERS), "service_stream": (service_stream, SERVICE_STREAM), "service_chat": (service_chat, SERVICE_CHAT), "service_requests": (service_requests, SERVICE_REQUESTS), "pipeline_names": (pipeline_names, PIPELINE_NAMES),
    "pipeline_graph": (pipeline_graph, PIPELINE_GRAPH), "pipeline_yaml": (pipeline_yaml, PIPELINE_YAML), "tool_runs": (tool_runs, TOOL_RUNS), "stream_sessions": (stream_sessions, SESSION_STATE.replace("conv_id AS session_id", "CAST(conv_id AS VARCHAR) AS session_id").replace(", md5(string_agg(text, '|' ORDER BY turn)) AS history, string_agg(role, ',' ORDER BY turn) AS roles", "")),
    "session_memory": (session_memory, SESSION_MEMORY), "agent_memory": (agent_memory, AGENT_MEMORY), "delivery": (delivery, DELIVERY), "frame_cap": (frame_cap, FRAME_CAP),
    "planned_once": (planned_once, PLANNED_ONCE), "stepwise_runs": (stepwise_runs, TOOL_RUNS), "stepwise_progress": (stepwise_progress, STEPWISE_PROGRESS),
    "frame_ingest": (frame_ingest, FRAME_INGEST), "log_tail": (log_tail, LOG_ROUND_TRIP), "frame_sink": (frame_sink, FRAME_SINK), "catalog_load": (catalog_load, CATALOG_LOAD), "catalog_load_one": (catalog_load_one, CATALOG_LOAD_ONE), "pipelines_written": (pipelines_written, PIPELINES_WRITTEN),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
