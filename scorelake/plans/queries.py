"""Registered queries of the evaluation operators, each with its SQL.

Suppliers stand for models, part brands for tasks, line items and events for answers.  All read
their whole tables.  Results that pass through floating sums are rounded to six digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity, metering
from ..functions import marks as M
from ..functions import text as T
from ..operators import analysis, exports, joins, marking, readings, scores, usage
from ..sources import writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def registered(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ---- scores -------------------------------------------------------------------------------

SCORES = """ts AS (SELECT l_suppkey AS model_id, p_brand AS task, 2 * avg(l_quantity) AS score, count(*) AS n
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""


def task_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("l_suppkey").alias("model_id"), F.col("p_brand").alias("task")).agg((2 * F.avg("l_quantity")).alias("score"), F.count("*").alias("n"))


def models(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("model_id"), F.col("s_name").alias("label"), (F.col("s_acctbal") >= 0).alias("featured"), "s_nationkey", "s_acctbal")


@registered(f"""WITH {SCORES}, t AS (SELECT model_id, round(sum(score * n) / sum(n), 6) AS total, CAST(sum(n) AS BIGINT) AS questions FROM ts GROUP BY model_id)
SELECT model_id, s_name AS label, total, questions, row_number() OVER (ORDER BY total DESC, model_id) AS rank FROM t JOIN supplier ON s_suppkey = model_id WHERE s_acctbal >= 0""")
def leaderboard_total(spark, d):
    """JN-17, AGG-6, AGG-33, WIN-2, SRT-1, FLT-4."""
    ts, shown = task_scores(spark, d), models(spark, d).where("featured")
    out = scores.totals(ts.join(shown, "model_id", "left_semi")).withColumn("total", r6("total")).join(shown.select("model_id", "label"), "model_id")
    return scores.ranked(out, [F.desc("total"), F.asc("model_id")]).select("model_id", "label", "total", "questions", F.col("rank").cast("bigint").alias("rank"))


@registered(f"""WITH {SCORES}, o AS (SELECT model_id, task, CASE WHEN task = 'Brand#12' THEN 90.0 ELSE score END AS score, n FROM ts WHERE task <> 'Brand#11')
SELECT model_id, round(sum(score * n) / sum(n), 6) AS total, CAST(sum(n) AS BIGINT) AS questions FROM o GROUP BY model_id""")
def total_skip_override(spark, d):
    """AGG-6 with skip and override, AGG-23."""
    ts = task_scores(spark, d)
    other = ts.where("task = 'Brand#12'").select("model_id", "task", F.lit(90.0).alias("score"))
    return scores.totals(ts, skip=["Brand#11"], override=other).withColumn("total", r6("total"))


@registered("""WITH c AS (SELECT l_suppkey AS model_id, p_brand AS task, avg(l_discount * 10) AS accuracy, avg(CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END) AS instruction,
avg(CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END) AS other FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT model_id, task, round(100 * other * CASE task WHEN 'Brand#12' THEN 0.3 WHEN 'Brand#13' THEN 0.7 ELSE 0.0 END + 100 * accuracy * CASE task WHEN 'Brand#12' THEN 0.5 WHEN 'Brand#13' THEN 0.1 ELSE 0.8 END
+ 100 * instruction * 0.2, 6) AS score FROM c""")
def composite_weights(spark, d):
    """AGG-4, JN-8, SRC-10."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    parts = rows.groupBy(F.col("l_suppkey").alias("model_id"), F.col("p_brand").alias("task")).agg(
        F.avg(F.col("l_discount") * 10).alias("accuracy"), F.avg((F.col("l_returnflag") == "A").cast("double")).alias("instruction"), F.avg((F.col("l_linestatus") == "O").cast("double")).alias("other")
    )
    weights = spark.createDataFrame([("Brand#12", 0.3, 0.5, 0.2), ("Brand#13", 0.7, 0.1, 0.2)], "task string, w_other double, w_accuracy double, w_instruction double")
    made = scores.composite(*[F.col(c) for c in ("other", "accuracy", "instruction", "w_other", "w_accuracy", "w_instruction")])
    return scores.with_weights(parts, weights).select("model_id", "task", r6(made).alias("score"))


@registered(f"""WITH {SCORES}, g AS (SELECT model_id, substring(task, 1, 7) AS grp, task, score, n FROM ts)
SELECT model_id, grp, task, CAST(grouping(model_id) * 4 + grouping(grp) * 2 + grouping(task) AS INTEGER) AS level, round(sum(score * n) / sum(n), 6) AS score
FROM g GROUP BY GROUPING SETS ((model_id, grp, task), (model_id, grp), (model_id))""")
def table_rollup(spark, d):
    """AGG-7, AGG-8."""
    rows = task_scores(spark, d).withColumn("group", F.substring("task", 1, 7))
    return scores.table_rollup(rows).withColumnRenamed("group", "grp").withColumn("score", r6("score"))


@registered(f"""WITH {SCORES}, r AS (SELECT model_id, task, round(score, 1) AS score FROM ts), b AS (SELECT task, max(score) AS best FROM r GROUP BY task),
l AS (SELECT model_id, r.task, count(*) OVER (PARTITION BY r.task) AS leaders FROM r JOIN b USING (task) WHERE score >= best - 1e-9)
SELECT model_id, CAST(count(*) FILTER (l.leaders = 1) AS BIGINT) AS wins, CAST(count(*) FILTER (l.leaders > 1) AS BIGINT) AS ties FROM (SELECT DISTINCT model_id FROM r) LEFT JOIN l USING (model_id) GROUP BY model_id""")
def task_wins(spark, d):
    """AGG-10, WIN-1."""
    return scores.task_wins(task_scores(spark, d).withColumn("score", F.round("score", 1)))


POINTS = "p AS (SELECT l_suppkey AS model_id, round(sum(l_tax), 1) AS cost, round(avg(l_quantity), 1) AS score FROM lineitem GROUP BY l_suppkey)"


def points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("model_id")).agg(F.round(F.sum("l_tax"), 1).alias("cost"), F.round(F.avg("l_quantity"), 1).alias("score"))


FRONT = f"WITH {POINTS} SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.score > p.score AND q.cost <= p.cost)"


@registered(FRONT)
def frontier_theta(spark, d):
    """JN-11 as an anti-join (one row a model)."""
    return scores.frontier_pairs(points(spark, d))


@registered(FRONT)
def frontier_window(spark, d):
    """JN-11, WIN-7, SRT-3, AGG-20."""
    return scores.frontier(points(spark, d))


@registered(f"WITH {POINTS}, f AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.score > p.score AND q.cost <= p.cost)) SELECT *, lead(cost) OVER (ORDER BY cost, model_id) AS next_cost FROM f")
def frontier_budgets(spark, d):
    """WIN-6."""
    return scores.budget_ranges(points(spark, d), "model_id")


@registered(f"""WITH {SCORES}, o AS (SELECT model_id, task, round(score, 1) AS score, row_number() OVER (PARTITION BY model_id ORDER BY task) AS ordinal FROM ts)
SELECT model_id, round(avg(score), 6) AS mean, round(median(score), 6) AS median, arg_min(task, (score, ordinal)) AS minimum, arg_max(task, (score, -ordinal)) AS maximum FROM o GROUP BY model_id""")
def minmax_task_median(spark, d):
    """AGG-9, T-2."""
    from pyspark.sql import Window

    rows = task_scores(spark, d).withColumn("score", F.round("score", 1)).withColumn("ordinal", F.row_number().over(Window.partitionBy("model_id").orderBy("task")))
    return scores.task_summary(rows).withColumn("mean", r6("mean")).withColumn("median", r6("median"))


@registered(f"""WITH {SCORES}, m AS (SELECT model_id, round(avg(score), 6) AS mean FROM ts GROUP BY model_id), l AS (SELECT model_id, 'lab' || s_nationkey AS lab, CASE WHEN model_id % 3 = 0 THEN NULL ELSE model_id % 7 END AS size_rank, mean,
max(mean) OVER (PARTITION BY s_nationkey) AS lab_best FROM m JOIN supplier ON s_suppkey = model_id)
SELECT model_id, lab, mean, lab_best, row_number() OVER (ORDER BY lab_best DESC, lab, coalesce(size_rank, 99), model_id) AS position FROM l""")
def lab_order(spark, d):
    """AGG-31, SRT-2, SRT-9."""
    mean = task_scores(spark, d).groupBy("model_id").agg(r6(F.avg("score")).alias("mean"))
    rows = mean.join(models(spark, d), "model_id").withColumn("lab", F.concat(F.lit("lab"), "s_nationkey")).withColumn("size_rank", F.when(F.col("model_id") % 3 != 0, F.col("model_id") % 7))
    return scores.best_of_lab(rows).select("model_id", "lab", "mean", "lab_best", F.col("position").cast("bigint").alias("position"))


# ---- usage --------------------------------------------------------------------------------


@registered("""SELECT user_id, event_type, count(*) AS n, list_sort(list(value))[least(count(*) - 1, floor(count(*) * 0.25)::BIGINT) + 1] AS p25, list_sort(list(value))[least(count(*) - 1, floor(count(*) * 0.5)::BIGINT) + 1] AS p50,
list_sort(list(value))[least(count(*) - 1, floor(count(*) * 0.75)::BIGINT) + 1] AS p75, list_sort(list(value))[least(count(*) - 1, floor(count(*) * 0.95)::BIGINT) + 1] AS p95, max(value) AS max FROM events WHERE value IS NOT NULL GROUP BY ALL""")
def nearest_rank_latency(spark, d):
    """AGG-12, T-1."""
    return usage.nearest_rank(table(spark, d, "events"), ["user_id", "event_type"], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95})


@registered("SELECT event_type, list_sort(list(value))[count(*) // 2 + 1] AS upper_median FROM events WHERE value IS NOT NULL GROUP BY event_type")
def upper_median(spark, d):
    """AGG-13."""
    return usage.upper_median(table(spark, d, "events"), ["event_type"], "value")


@registered("""SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_pop(value), 6) AS sd, min(value) AS min, max(value) AS max, round(max(value) - min(value), 6) AS spread FROM events GROUP BY event_type""")
def population_stats(spark, d):
    """AGG-16, T-3."""
    out = usage.spread(table(spark, d, "events"), ["event_type"], "value")
    return out.select("event_type", "n", r6("mean").alias("mean"), r6("median").alias("median"), r6("sd").alias("sd"), "min", "max", r6("spread").alias("spread"))


@registered("SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.75), 6) AS q3 FROM events GROUP BY event_type")
def quartiles_interpolated(spark, d):
    """AGG-17."""
    out = usage.quartiles(table(spark, d, "events"), ["event_type"], "value")
    return out.select("event_type", *[r6(c).alias(c) for c in ("q1", "q2", "q3")])


COST = "CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END"


def event_costs(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, d, "events").withColumn("cost", F.when(k % 5 != 0, k))


@registered(f"SELECT user_id, CAST(sum({COST}) AS BIGINT) AS cost, count({COST}) AS receipts, count(*) AS answers FROM events GROUP BY user_id")
def billed_cost_nulls(spark, d):
    """AGG-11, PRJ-4, T-14."""
    return usage.billed(event_costs(spark, d), ["user_id"])


@registered(f"SELECT user_id, event_type, CAST(CASE WHEN bool_and({COST} IS NOT NULL) THEN sum({COST}) END AS BIGINT) AS cost FROM events GROUP BY ALL")
def complete_cost_gate(spark, d):
    """AGG-15."""
    return usage.complete_costs(event_costs(spark, d), ["user_id", "event_type"], "cost")


@registered("""SELECT l_suppkey, round(sum(l_extendedprice) / sum(l_quantity), 6) AS prompt, round(sum(l_tax * l_extendedprice) / greatest(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END), 1), 6) AS completion FROM lineitem GROUP BY l_suppkey""")
def effective_price(spark, d):
    """AGG-14."""
    rows = table(spark, d, "lineitem").select("l_suppkey", F.col("l_extendedprice").alias("prompt_cost"), F.col("l_quantity").alias("prompt_tokens"), (F.col("l_tax") * F.col("l_extendedprice")).alias("completion_cost"), F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0).alias("completion_tokens"))
    return usage.effective_prices(rows, ["l_suppkey"]).select("l_suppkey", r6("prompt").alias("prompt"), r6("completion").alias("completion"))


@registered("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def latest_record(spark, d):
    """AGG-34, T-14."""
    return usage.latest(table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@registered("""SELECT user_id, count(DISTINCT event_id) AS answered, count(DISTINCT event_id) >= 40 AS complete, max(ts) <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) AS fresh FROM events GROUP BY user_id""")
def freshness_guard(spark, d):
    """AGG-30."""
    rows = table(spark, d, "events")
    at = rows.agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("limit")).first()[0]
    return usage.completeness(rows, ["user_id"], 40, F.lit(at), "event_id", "ts").select("user_id", "answered", "complete", "fresh")


RULES = "(VALUES ('patch', 16, 1.2, NULL, NULL), ('area', NULL, NULL, 0.00075, NULL), ('pair', NULL, NULL, 0.0013, NULL), ('flat', NULL, NULL, NULL, 63.0)) r(kind, patch, multiplier, per_pixel, per_frame)"


@registered(f"""WITH t AS (SELECT p_partkey, kind, CASE kind WHEN 'patch' THEN 8 * ceil((640 + p_size * 10) / patch::DOUBLE) * ceil(480 / patch::DOUBLE) * multiplier WHEN 'area' THEN 8 * per_pixel * ((640 + p_size * 10) * 480) WHEN 'pair' THEN ceil(8 / 2.0) * per_pixel * ((640 + p_size * 10) * 480)
ELSE 8 * per_frame END::DOUBLE AS tokens, p_retailprice * 1e-9 AS prompt FROM part, {RULES})
SELECT p_partkey, kind, round(tokens, 6) AS tokens, 3600.0::DOUBLE AS frames_per_hour, 450.0::DOUBLE AS queries_per_hour, round(450.0 * (tokens * prompt + 110 * prompt), 6) AS input_usd, round(450.0 * (200.0 * prompt * 5), 6) AS output_usd FROM t""")
def hourly_cost_rules(spark, d):
    """Metering scalars, four kinds of rules (a table of four rows)."""
    rules = spark.createDataFrame([("patch", 16, 1.2, None, None), ("area", None, None, 0.00075, None), ("pair", None, None, 0.0013, None), ("flat", None, None, None, 63.0)], "kind string, patch int, multiplier double, per_pixel double, per_frame double")
    rows = table(spark, d, "part").crossJoin(F.broadcast(rules))
    tokens = metering.clip_tokens(F.col("kind"), 640 + F.col("p_size") * 10, F.lit(480), F.lit(8), F.col("patch"), F.col("multiplier"), F.col("per_pixel"), F.col("per_frame"))
    prompt = F.col("p_retailprice") * 1e-9
    rate = metering.input_price(F.lit("prompt"), prompt, F.lit(None).cast("double"))
    out = rows.withColumn("tokens", tokens).withColumn("c", metering.hourly_cost(F.col("tokens"), rate, prompt, prompt * 5, F.lit(200.0), F.lit(8), F.lit(1)))
    return out.select("p_partkey", "kind", r6("tokens").alias("tokens"), "c.frames_per_hour", "c.queries_per_hour", r6("c.input_usd").alias("input_usd"), r6("c.output_usd").alias("output_usd"))


@registered("""SELECT l_suppkey, l_linenumber, round(median(l_quantity), 6) AS billed, round(max(l_quantity * 0.9), 6) AS rule, count(*) AS n, round(100 * (median(l_quantity) - max(l_quantity * 0.9)) / max(l_quantity * 0.9), 6) AS residual_pct FROM lineitem GROUP BY ALL HAVING count(*) >= 20""")
def fit_residual_having(spark, d):
    """AGG-28, FLT-13."""
    out = usage.fit_residuals(table(spark, d, "lineitem").withColumn("rule_tokens", F.col("l_quantity") * 0.9), ["l_suppkey", "l_linenumber"], "l_quantity", "rule_tokens")
    return out.select("l_suppkey", "l_linenumber", r6("billed").alias("billed"), r6("rule").alias("rule"), "n", r6("residual_pct").alias("residual_pct"))


@registered("""WITH c AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, user_id, n, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS place FROM c QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) <= 5""")
def top_items(spark, d):
    """WIN-9 (a report of the top five)."""
    return usage.top_per(table(spark, d, "events"), "event_type", "user_id").withColumn("place", F.col("place").cast("bigint"))


@registered("""SELECT l_suppkey, count(*) FILTER (l_returnflag <> 'N') AS completed, count(*) AS total, count(*) FILTER (l_linestatus = 'F') AS truncated, count(*) FILTER (l_discount > 0.05) AS fallbacks, count(*) FILTER (l_tax = 0) AS carried, bool_and(l_returnflag <> 'N') AS all_complete FROM lineitem GROUP BY l_suppkey""")
def run_totals(spark, d):
    """AGG-29."""
    rows = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_returnflag") != "N").alias("answered"), (F.col("l_linestatus") == "F").alias("truncated"), (F.col("l_discount") > 0.05).alias("fallback"), (F.col("l_tax") == 0).alias("carried"))
    return usage.run_totals(rows, ["l_suppkey"])

# ---- texts and marks ------------------------------------------------------------------------


def turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.concat("role", F.lit("; "), "text").alias("raw"), "text")


@registered("""SELECT conv_id, turn, array_to_string(list_slice(string_split(lower(role || '; ' || text), ';'), 2, 10000), '') AS question, string_split(role || '; ' || text, ';')[1] AS selector FROM conversations""")
def text_question(spark, d):
    """TXT-1, PRJ-2."""
    return turns(spark, d).select("conv_id", "turn", T.question_text(F.col("raw")).alias("question"), T.selector(F.col("raw")).alias("selector"))


@registered(r"""SELECT conv_id, turn, regexp_replace(string_split(text, 'correct answer is:')[-1], '[*\n"]', '', 'g') AS plain, trim(lower(text), ':[]()'' .') AS cleaned, NOT contains(trim(lower(text), ':[]()'' .'), ''', ''') AS single FROM conversations""")
def text_cleaned(spark, d):
    """TXT-2, TXT-3, TXT-6."""
    cleaned = T.clean(F.lower("text"))
    return turns(spark, d).select("conv_id", "turn", T.remove_symbols(F.col("text")).alias("plain"), cleaned.alias("cleaned"), T.single(cleaned).alias("single"))


@registered("""SELECT conv_id, turn, 'The ' || CASE WHEN role = 'user' THEN 'sequence' ELSE 'image' END || ' is from France. ' || text AS prompt FROM conversations""")
def prompt_text(spark, d):
    """PRJ-2 (the text after the selector is kept as it is)."""
    raw = F.concat(F.when(F.col("role") == "user", F.lit(" [frames];")).otherwise(F.lit("frame;")), "text")
    return table(spark, d, "conversations").select("conv_id", "turn", T.prompt(raw, F.lit("France")).alias("prompt"))


@registered(r"""SELECT doc_id, CASE WHEN len(t) > 400 THEN substring(t, 1, 400) || '…' ELSE t END AS cell FROM (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents)""")
def answer_cells(spark, d):
    """PRJ-6."""
    return table(spark, d, "documents").select("doc_id", T.answer_cell(F.col("text")).alias("cell"))


@registered("""SELECT doc_id, regexp_matches(coalesce(text, ''), '^\\s*$') AS missing, len(text) >= 64 AND text = repeat(substring(text, 1, 1), len(text)) AS degenerate, lower(lang) IN ('length', 'max_tokens') AS cut_off FROM documents""".replace("\\\\", "\\"))
def answer_flags(spark, d):
    """FLT-1, FLT-2, FLT-3."""
    return table(spark, d, "documents").select("doc_id", T.blank(F.col("text")).alias("missing"), T.degenerate(F.col("text")).alias("degenerate"), T.cut_off(F.col("lang")).alias("cut_off"))


CASES = """a AS (SELECT l_orderkey, l_linenumber, 'image;Which flag? Options: [''' || 'A' || ''', ''N'', ''R'']' AS raw, l_returnflag AS ref,
CASE (l_orderkey + l_linenumber) % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'correct answer is: *N*.' WHEN 2 THEN 'R or N' WHEN 3 THEN 'b: R!' ELSE '['''||'A'||''', ''N'']' END AS answer FROM lineitem),
x AS (SELECT *, trim(lower(regexp_replace(string_split(answer, 'correct answer is:')[-1], '[*\\n"]', '', 'g')), ':[]()'' .') AS c, lower(ref) AS r FROM a)""".replace("\\\\", "\\")


def flag_answers(spark: SparkSession, d: str) -> DataFrame:
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % 5
    answer = F.when(k == 0, "A").when(k == 1, "correct answer is: *N*.").when(k == 2, "R or N").when(k == 3, "b: R!").otherwise("['A', 'N']")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.lit("image;Which flag? Options: ['A', 'N', 'R']").alias("raw"), F.col("l_returnflag").alias("ref"), answer.alias("answer"))


@registered(f"""WITH {CASES} SELECT l_orderkey, l_linenumber, CASE WHEN NOT contains(c, ''', ''') AND (c = r OR (contains(c, r) AND len(list_filter(['a', 'n', 'r'], lambda t: t <> r AND contains(c, t))) = 0)) THEN 1.0 ELSE 0.0 END::DOUBLE AS accuracy,
CASE WHEN NOT contains(c, ''', ''') AND contains('which flag? options: [''a'', ''n'', ''r'']', c) THEN 1 ELSE 0 END::INTEGER AS instruction FROM x""")
def choice_marks(spark, d):
    """MRK-1, TXT-5."""
    rows = M.with_choice_mark(flag_answers(spark, d), F.col("raw"), F.col("ref"), F.col("answer"), "m")
    return rows.select("l_orderkey", "l_linenumber", "m.accuracy", "m.instruction")


@registered("""WITH a AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN 'yes' WHEN l_returnflag = 'A' THEN 'no' ELSE 'car' END AS r, CASE l_linenumber % 3 WHEN 0 THEN 'Yes.' WHEN 1 THEN 'no' ELSE 'car' END AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN trim(lower(c), '.') = r THEN 1.0 ELSE 0.0 END::DOUBLE AS accuracy, 1 AS instruction, CASE WHEN r <> 'car' THEN CASE WHEN trim(lower(c), '.') = r THEN 1.0 ELSE 0.0 END END::DOUBLE AS other, CASE WHEN r = 'car' THEN 'description' ELSE 'judgment' END AS kind FROM a""")
def judge_marks(spark, d):
    """MRK-2."""
    ref = F.when(F.col("l_returnflag") == "N", "yes").when(F.col("l_returnflag") == "A", "no").otherwise("car")
    answer = F.when(F.col("l_linenumber") % 3 == 0, "Yes.").when(F.col("l_linenumber") % 3 == 1, "no").otherwise("car")
    rows = M.with_judge_mark(table(spark, d, "lineitem"), F.lit("image;Is it a car? Options: ['yes', 'no', 'car']"), ref, answer, "m")
    return rows.select("l_orderkey", "l_linenumber", "m.accuracy", "m.instruction", "m.other", "m.kind")


@registered("""WITH a AS (SELECT l_orderkey, l_linenumber, [CAST(l_linenumber AS VARCHAR), CAST(l_linenumber % 3 + 1 AS VARCHAR)] AS r, [CAST(l_orderkey % 4 + 1 AS VARCHAR), CAST(l_linenumber % 3 + 1 AS VARCHAR)] AS g FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN NOT list_contains(r, g[1]) OR NOT list_contains(r, g[2]) THEN 0.0 ELSE 1.0 END::DOUBLE AS accuracy, 1 AS instruction FROM a""")
def relation_marks(spark, d):
    """MRK-6."""
    ref = F.concat_ws("/", F.col("l_linenumber"), F.col("l_linenumber") % 3 + 1)
    answer = F.concat(F.lit("Sign 0 belongs to lanes "), F.concat_ws("/", F.col("l_orderkey") % 4 + 1, F.col("l_linenumber") % 3 + 1), F.lit("."))
    rows = M.with_relation_mark(table(spark, d, "lineitem").withColumn("given", answer), ref, F.col("given"), "m")
    return rows.select("l_orderkey", "l_linenumber", "m.accuracy", "m.instruction")


@registered("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN 0.0 ELSE CASE WHEN l_linenumber % 2 = 0 THEN 0.5 ELSE 0 END + CASE WHEN l_orderkey % 3 = 0 THEN 0.5 ELSE 0 END END::DOUBLE AS accuracy, CASE WHEN l_linenumber = 7 THEN 0 ELSE 1 END AS instruction FROM lineitem""")
def speed_marks(spark, d):
    """MRK-7: bounds compare as text, so 080 is not 80."""
    low = F.when(F.col("l_linenumber") % 2 == 0, "40").otherwise("040")
    high = F.when(F.col("l_orderkey") % 3 == 0, "80").otherwise("90")
    answer = F.when(F.col("l_linenumber") == 7, F.lit("[1, 2] or [3, 4]")).otherwise(F.concat(F.lit("limits: [ "), low, F.lit(" ,"), high, F.lit("]")))
    rows = table(spark, d, "lineitem").withColumn("m", M.speed_mark(F.lit("[40, 80]"), answer))
    return rows.select("l_orderkey", "l_linenumber", "m.accuracy", "m.instruction")


BOXES = """b AS (SELECT l_orderkey, l_linenumber, [100, 100, 100 + l_linenumber * 20, 200] AS a, [100.0 + l_quantity, 90.0, 160.0 + l_quantity, 190.5]::DOUBLE[] AS g FROM lineitem),
i AS (SELECT *, list_transform(g, lambda v: CAST(trunc(v) AS BIGINT)) AS t FROM b),
s AS (SELECT *, greatest(least(a[3], t[3]) - greatest(a[1], t[1]) + 1, 0) * greatest(least(a[4], t[4]) - greatest(a[2], t[2]) + 1, 0) AS shared FROM i),
u AS (SELECT l_orderkey, l_linenumber, shared::DOUBLE / ((a[3] - a[1] + 1) * (a[4] - a[2] + 1) + (t[3] - t[1] + 1) * (t[4] - t[2] + 1) - shared) AS iou FROM s)"""


@registered(f"WITH {BOXES} SELECT l_orderkey, l_linenumber, round(iou, 6) AS iou, (iou > 0.5)::INTEGER::DOUBLE AS accuracy, 1 AS instruction FROM u")
def box_marks(spark, d):
    """MRK-3, MRK-4, T-6, T-11."""
    ref = F.array(F.lit(100.0), F.lit(100.0), (100 + F.col("l_linenumber") * 20).cast("double"), F.lit(200.0))
    side = lambda c: F.format_string("%.1f", c)
    answer = F.concat(F.lit("It is at ["), F.concat_ws(", ", side(100 + F.col("l_quantity")), F.lit("90"), side(160 + F.col("l_quantity")), F.lit("190.5")), F.lit("]"))
    rows = M.with_box_mark(table(spark, d, "lineitem"), ref, answer, "m")
    return rows.select("l_orderkey", "l_linenumber", r6("m.other").alias("iou"), "m.accuracy", "m.instruction")


@registered("""SELECT p_partkey, list_transform([p_size * 4.0 * 1280 / 1000, 100.0 * 720 / 1000, (p_size * 4.0 + 50) * 1280 / 1000, 300.0 * 720 / 1000]::DOUBLE[], lambda v: round(v, 6))[1] AS x1, round(100.0 * 720 / 1000, 6)::DOUBLE AS y1, round((p_size * 4.0 + 50) * 1280 / 1000, 6)::DOUBLE AS x2, round(300.0 * 720 / 1000, 6)::DOUBLE AS y2 FROM part""")
def grid_boxes(spark, d):
    """MRK-10."""
    x = F.col("p_size") * 4.0
    box = F.array(F.lit(100.0), x, F.lit(300.0), x + 50)
    out = table(spark, d, "part").withColumn("b", M.to_pixels(box, F.lit("grid_yx"), F.lit(1280), F.lit(720)))
    return out.select("p_partkey", *[r6(F.get("b", F.lit(k))).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])


ACC = "CASE WHEN l_returnflag = 'N' THEN 1.0 WHEN l_returnflag = 'R' THEN 0.5 ELSE 0.0 END::DOUBLE"
#: Line numbers repeat within an order; these together give its questions an order.
PLACE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus"]


def accuracies(spark: SparkSession, d: str) -> DataFrame:
    acc = F.when(F.col("l_returnflag") == "N", 1.0).when(F.col("l_returnflag") == "R", 0.5).otherwise(0.0)
    return table(spark, d, "lineitem").select("l_orderkey", *PLACE, acc.alias("accuracy"), F.struct(*PLACE).alias("place"))


PAIRS = f"""a AS (SELECT *, {ACC} AS acc, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(PLACE)}) - 1 AS pos, count(*) OVER (PARTITION BY l_orderkey) // 2 AS half FROM lineitem),
p AS (SELECT s.*, CASE WHEN f.pos IS NOT NULL THEN ((s.acc = 1 AND f.acc = 1) OR s.acc > f.acc)::INTEGER END AS pair FROM a s LEFT JOIN a f ON f.l_orderkey = s.l_orderkey AND f.pos = s.pos - s.half AND s.pos >= s.half AND s.pos < 2 * s.half)"""


@registered(f"WITH {PAIRS} SELECT l_orderkey, l_linenumber, l_partkey, pair FROM p")
def pair_halves(spark, d):
    """MRK-8, JN-12, WIN-3."""
    return marking.pair_halves(accuracies(spark, d), ["l_orderkey"], "place", "accuracy").select("l_orderkey", "l_linenumber", "l_partkey", "pair")


@registered(f"WITH {PAIRS} SELECT l_orderkey, CAST(coalesce(sum(pair), 0) AS INTEGER) AS pairs FROM p GROUP BY l_orderkey")
def released_pairs(spark, d):
    """MRK-8 in the released form; without null marks both agree."""
    return marking.released_pairs(accuracies(spark, d), ["l_orderkey"], "place", "accuracy")


@registered(f"""WITH {PAIRS}, m AS (SELECT l_suppkey, CASE l_suppkey % 4 WHEN 0 THEN 'judge' WHEN 1 THEN 'speed' WHEN 2 THEN 'grounding' ELSE 'choice' END AS family, acc, (l_linestatus = 'O')::INTEGER AS ins, l_discount * 10 AS oth,
CASE WHEN l_suppkey % 4 = 0 THEN CASE WHEN l_linenumber % 2 = 0 THEN 'judgment' ELSE 'description' END WHEN l_suppkey % 4 = 2 THEN CASE WHEN l_linenumber % 2 = 0 THEN 'box' ELSE 'choice' END ELSE 'choice' END AS kind, pair FROM p)
SELECT l_suppkey, family, round(CASE WHEN family = 'judge' THEN coalesce(avg(acc) FILTER (kind = 'description'), 0) ELSE avg(acc) END, 6) AS accuracy, round(avg(ins), 6) AS instruction,
round(CASE family WHEN 'judge' THEN avg(acc) FILTER (kind = 'judgment') WHEN 'speed' THEN 2.0 * sum(coalesce(pair, 0)) / count(*) WHEN 'grounding' THEN avg(oth) FILTER (kind = 'box') ELSE 0 END, 6)::DOUBLE AS other, count(*) AS questions FROM m GROUP BY l_suppkey, family""")
def task_components(spark, d):
    """AGG-1, AGG-2, AGG-3."""
    rows = marking.pair_halves(accuracies(spark, d), ["l_orderkey"], "place", "accuracy")
    k, even = F.col("l_suppkey") % 4, F.col("l_linenumber") % 2 == 0
    family = F.when(k == 0, "judge").when(k == 1, "speed").when(k == 2, "grounding").otherwise("choice")
    kind = F.when(k == 0, F.when(even, "judgment").otherwise("description")).when((k == 2) & even, "box").otherwise("choice")
    marked = rows.select("l_suppkey", family.alias("family"), "accuracy", (F.col("l_linestatus") == "O").cast("int").alias("instruction"), (F.col("l_discount") * 10).alias("other"), kind.alias("kind"), "pair")
    return marking.components(marked, ["l_suppkey"]).select("l_suppkey", "family", r6("accuracy").alias("accuracy"), r6("instruction").alias("instruction"), r6("other").alias("other"), "questions")


@registered("""WITH s AS (SELECT l_orderkey, count(*) AS questions, bool_and(l_returnflag <> 'A') AS ok, count(*) FILTER (l_tax > 0.075) AS bad FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, questions, ok AND bad = 0 AS eligible, CASE WHEN bad > 0 THEN 'invalid_sample' WHEN NOT ok THEN 'incomplete_sample' END AS reason FROM s""")
def sample_eligibility(spark, d):
    """MRK-11."""
    rows = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") != "A", "text").otherwise(" ").alias("answer"), F.when(F.col("l_tax") > 0.075, "bad").alias("error"))
    return marking.eligible_samples(rows, ["l_orderkey"]).drop("errors")


@registered("""WITH r AS (SELECT l_suppkey, l_orderkey, l_returnflag <> 'A' AS answered, bool_and(l_returnflag <> 'A') OVER (PARTITION BY l_suppkey, l_orderkey) AS eligible, CASE WHEN l_linestatus = 'O' THEN 'judgment' ELSE 'box' END AS kind FROM lineitem)
SELECT l_suppkey, count(DISTINCT l_orderkey) AS samples_expected, count(*) AS questions_expected, count(*) FILTER (answered) AS questions_received, count(DISTINCT l_orderkey) FILTER (eligible) AS samples_scored, count(*) FILTER (eligible) AS questions_scored,
count(*) FILTER (eligible AND kind = 'box') AS box, count(*) FILTER (eligible AND kind = 'judgment') AS judgment, CAST(0 AS BIGINT) AS description, CAST(0 AS BIGINT) AS comparison_pairs FROM r GROUP BY l_suppkey""")
def denominators(spark, d):
    """AGG-5."""
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", (F.col("l_returnflag") != "A").alias("answered"), F.when(F.col("l_linestatus") == "O", "judgment").otherwise("box").alias("kind"))
    ok = rows.groupBy("l_suppkey", "l_orderkey").agg(F.bool_and("answered").alias("eligible"))
    return marking.denominators(rows.join(ok, ["l_suppkey", "l_orderkey"]).withColumn("sample_index", F.col("l_orderkey")).withColumn("family", F.lit("judge")), ["l_suppkey"])


@registered("""WITH k AS (SELECT event_type AS task, user_id AS sample_index, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS kind FROM events),
m AS (SELECT task, kind, min(sample_index) AS s FROM k GROUP BY ALL), z AS (SELECT task, min(sample_index) AS s FROM k GROUP BY task), w AS (SELECT task, s FROM m UNION SELECT task, s FROM z)
SELECT k.task, sample_index, event_id, kind FROM k JOIN w ON w.task = k.task AND w.s = k.sample_index""")
def first_of_kind(spark, d):
    """WIN-8."""
    rows = table(spark, d, "events").select(F.col("event_type").alias("task"), F.col("user_id").alias("sample_index"), "event_id", (F.get_json_object("props", "$.k").cast("bigint") % 10).alias("kind"))
    return marking.first_of_kind(rows).select("task", "sample_index", "event_id", "kind")


@registered("""WITH s AS (SELECT o_custkey AS sample_index, list(o_orderpriority ORDER BY o_orderkey) AS qs FROM orders GROUP BY o_custkey)
SELECT sample_index, CAST(i AS INTEGER) AS question_index, qs[i + 1] AS raw_question, 'The image is from X. ' AS prompt FROM (SELECT *, unnest(range(len(qs))) AS i FROM s)""")
def flattened_questions(spark, d):
    """PRJ-1, SRC-1."""
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("sample_index")).agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda s: s["o_orderpriority"]).alias("questions"))
    samples = per.select(F.lit("t").alias("task"), "sample_index", F.lit("X").alias("country"), "questions", F.col("questions").alias("reference"))
    return marking.flatten(samples).select("sample_index", F.col("question_index").cast("int").alias("question_index"), "raw_question", "prompt")


# ---- analysis -------------------------------------------------------------------------------


@registered(f"""WITH {SCORES} SELECT task, count(score) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS sd, avg(score) >= 75 OR stddev_pop(score) < 2.5 AS saturated,
CASE WHEN (avg(score) >= 75 OR stddev_pop(score) < 2.5) AND task IN ('Brand#11', 'Brand#12') THEN 'saturated, distrusted' WHEN avg(score) >= 75 OR stddev_pop(score) < 2.5 THEN 'saturated' WHEN task IN ('Brand#11', 'Brand#12') THEN 'distrusted' ELSE 'useful' END AS quadrant FROM ts GROUP BY task""")
def saturation_quadrant(spark, d):
    """AGG-25."""
    out = analysis.saturation(usage.spread(task_scores(spark, d), ["task"], "score"), ["Brand#11", "Brand#12"])
    return out.select("task", "n", r6("mean").alias("mean"), r6("sd").alias("sd"), "saturated", "quadrant")


@registered(f"""SELECT l_linestatus AS kind, l_returnflag AS gold, count(*) AS n, round(avg({ACC}) FILTER (l_orderkey % 3 = 0), 6) AS "0", round(avg({ACC}) FILTER (l_orderkey % 3 = 1), 6) AS "1", round(avg({ACC}) FILTER (l_orderkey % 3 = 2), 6) AS "2",
round(greatest(avg({ACC}) FILTER (l_orderkey % 3 = 0), avg({ACC}) FILTER (l_orderkey % 3 = 1), avg({ACC}) FILTER (l_orderkey % 3 = 2)), 6) AS best, max({ACC}) < 1 AS nobody FROM lineitem GROUP BY ALL""")
def accuracy_by_label(spark, d):
    """AGG-18: every order is of one of three models."""
    rows = accuracies(spark, d).select(F.col("l_linestatus").alias("kind"), F.col("l_returnflag").alias("gold"), (F.col("l_orderkey") % 3).alias("model"), "accuracy")
    out = analysis.accuracy_by_label(rows, [0, 1, 2])
    return out.select("kind", "gold", "n", *[r6(f"`{k}`").alias(str(k)) for k in range(3)], r6("best").alias("best"), "nobody")


LINES = range(1, 8)


@registered(f"""SELECT l_linestatus AS kind, l_returnflag AS gold, count(*) AS n, {", ".join(f'round(avg({ACC}) FILTER (l_linenumber = {k}), 6) AS "{k}"' for k in LINES)},
round(greatest({", ".join(f"avg({ACC}) FILTER (l_linenumber = {k})" for k in LINES)}), 6) AS best, max({ACC}) < 1 AS nobody FROM lineitem GROUP BY ALL""")
def accuracy_by_label_lines(spark, d):
    """AGG-18 over all rows: each of the seven line numbers is a model."""
    rows = accuracies(spark, d).select(F.col("l_linestatus").alias("kind"), F.col("l_returnflag").alias("gold"), F.col("l_linenumber").alias("model"), "accuracy")
    out = analysis.accuracy_by_label(rows, list(LINES))
    return out.select("kind", "gold", "n", *[r6(f"`{k}`").alias(str(k)) for k in LINES], r6("best").alias("best"), "nobody")


@registered(f"SELECT l_orderkey, count(*) FILTER ({ACC} >= 1) AS \"right\", count(*) FILTER ({ACC} >= 1) BETWEEN 1 AND 6 AS disagree, count(*) FILTER ({ACC} >= 1) = 0 AS allwrong FROM lineitem GROUP BY l_orderkey")
def question_difficulty(spark, d):
    """AGG-19, FLT-7, SRT-5."""
    return analysis.difficulty(accuracies(spark, d), ["l_orderkey"], 7)


@registered("""WITH c AS (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 AS label, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL)
SELECT event_type, arg_max(label, (n, -first)) AS majority, round(max(n) / sum(n), 6)::DOUBLE AS baseline FROM c GROUP BY event_type""")
def majority_baseline(spark, d):
    """AGG-27."""
    rows = table(spark, d, "events").withColumn("label", F.get_json_object("props", "$.k").cast("bigint") % 7)
    return analysis.majority(rows, ["event_type"], "label", "event_id").withColumn("baseline", r6("baseline"))


@registered("""WITH c AS (SELECT source, coalesce(lower(trim(lang)), '') AS label, count(*) AS n FROM documents GROUP BY ALL), x AS (SELECT source, count(*) AS labels, CAST(sum(n) AS BIGINT) AS questions, string_agg(label || '=' || n, ',' ORDER BY label) AS distribution FROM c GROUP BY source)
SELECT source, labels, questions, distribution, samples, bad FROM x JOIN (SELECT source, count(DISTINCT doc_id) AS samples, count(*) FILTER (lang IS NULL) AS bad FROM documents GROUP BY source) USING (source)""")
def label_audit(spark, d):
    """AGG-26."""
    out = analysis.label_audit(table(spark, d, "documents"), ["source"], "lang", F.lower(F.trim("lang")), "doc_id")
    shown = F.array_join(F.transform(F.map_entries("distribution"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.select("source", "labels", "questions", shown.alias("distribution"), "samples", "bad")


@registered("""WITH a AS (SELECT p_brand AS task, avg(p_retailprice) AS mean FROM part WHERE p_size > 10 AND p_brand <> 'Brand#11' GROUP BY ALL), b AS (SELECT p_brand AS task, avg(p_retailprice) AS mean FROM part WHERE p_size <= 10 AND p_brand <> 'Brand#12' GROUP BY ALL)
SELECT task, round(a.mean, 6) AS new_mean, round(b.mean, 6) AS old_mean, round(coalesce(a.mean - b.mean, 0), 6) AS shift FROM a FULL JOIN b USING (task)""")
def cohort_shift(spark, d):
    """JN-10, WIN-10."""
    part = table(spark, d, "part")
    of = lambda rows: rows.groupBy(F.col("p_brand").alias("task")).agg(F.avg("p_retailprice").alias("mean"))
    out = analysis.shift(of(part.where("p_size > 10 and p_brand <> 'Brand#11'")), of(part.where("p_size <= 10 and p_brand <> 'Brand#12'")))
    return out.select("task", r6("new_mean").alias("new_mean"), r6("old_mean").alias("old_mean"), r6("shift").alias("shift"))


@registered("""WITH r AS (SELECT user_id, event_id, event_type, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM r JOIN (SELECT event_id, ts FROM events) USING (event_id))
SELECT user_id, CAST(run AS BIGINT) AS run, max(event_type) AS event_type, count(*) AS n FROM g GROUP BY user_id, run""")
def event_islands(spark, d):
    """WIN-5."""
    return analysis.islands(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "run", "event_type", "n")


@registered("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderkey % 7 = 0 AS aggregate, CASE WHEN o_orderkey % 7 = 0 THEN 2.0 ELSE 1.5 + (o_orderkey % 10) / 10.0 END AS score FROM orders),
g AS (SELECT *, coalesce(sum(aggregate::INTEGER) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM o),
c AS (SELECT o_custkey, CAST(grp AS BIGINT) AS grp, max(score) FILTER (aggregate) AS published, sum(score * (o_orderkey % 5 + 1)) FILTER (NOT aggregate) / sum(o_orderkey % 5 + 1) FILTER (NOT aggregate) AS recomputed FROM g GROUP BY ALL)
SELECT o_custkey, grp, published::DOUBLE AS published, round(recomputed, 6)::DOUBLE AS recomputed, round(abs(published - recomputed), 6) <= 0.1 AS agrees FROM c WHERE published IS NOT NULL AND recomputed IS NOT NULL""")
def published_groups(spark, d):
    """WIN-4, AGG-24: agreement within 0.1."""
    total, k = F.col("o_orderkey") % 7 == 0, F.col("o_orderkey") % 10
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(total, 2.0).otherwise((15 + k) / 10).alias("score"), total.alias("aggregate"), (F.col("o_orderkey") % 5 + 1).alias("n"))
    out = analysis.published_check(analysis.running_groups(rows, ["o_custkey"], "o_orderkey", F.col("aggregate")), ["o_custkey"])
    return out.select("o_custkey", F.col("group").alias("grp"), "published", F.round("recomputed", 6).alias("recomputed"), "agrees")


@registered("SELECT source, min(doc_id) AS first FROM documents GROUP BY source")
def first_seen(spark, d):
    """AGG-32."""
    return analysis.first_seen(table(spark, d, "documents"), "source", "doc_id")


# ---- joins, identity, tables ------------------------------------------------------------------


@registered("SELECT c_custkey AS id, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def pending_questions(spark, d):
    """JN-3, JN-1 (the missing side)."""
    questions = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment")
    return joins.pending(questions, table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id")))


@registered("SELECT doc_id AS id, lang, quality FROM documents LEFT JOIN labels USING (doc_id)")
def answered_questions(spark, d):
    """JN-1, JN-14."""
    questions = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    return joins.answered(questions, table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality"))


@registered("SELECT event_id, user_id AS id, event_type FROM events WHERE user_id IN (SELECT c_custkey FROM customer)")
def valid_answers(spark, d):
    """JN-4."""
    answers = table(spark, d, "events").select("event_id", F.col("user_id").alias("id"), "event_type")
    return joins.valid(answers, table(spark, d, "customer").select(F.col("c_custkey").alias("id")))


@registered("""SELECT event_type AS model_id, count(*) AS answers, count(DISTINCT user_id) AS distinct_questions, count(*) FILTER (user_id NOT IN (SELECT c_custkey FROM customer)) AS unknown,
count(*) = (SELECT count(*) FROM customer) AND count(DISTINCT user_id) = (SELECT count(*) FROM customer) AND count(*) FILTER (user_id NOT IN (SELECT c_custkey FROM customer)) = 0 AS covered FROM events GROUP BY event_type""")
def coverage_check(spark, d):
    """JN-5."""
    answers = table(spark, d, "events").select(F.col("event_type").alias("model_id"), F.col("user_id").alias("id"))
    return joins.coverage(answers, table(spark, d, "customer").select(F.col("c_custkey").alias("id")))


@registered("SELECT DISTINCT user_id AS id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def missing_models(spark, d):
    """JN-6, SET-1."""
    return joins.missing_from(table(spark, d, "events").select(F.col("user_id").alias("id")), table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id")), "id")


@registered("""SELECT conv_id, turn, substring(sha256(len(role) || ':' || role || '|' || len(conv_id::VARCHAR) || ':' || conv_id || '|' || len(text) || ':' || text), 1, 24) AS question_id FROM conversations""")
def question_ids(spark, d):
    """Identity hashes."""
    return table(spark, d, "conversations").select("conv_id", "turn", identity.short_id(F.col("role"), F.col("conv_id"), F.col("text")).alias("question_id"))


@registered("SELECT event_id, sha256(props) AS plain, sha256(replace(replace(props, ': ', ':'), ', ', ',')) AS digest FROM events")
def canonical_digests(spark, d):
    """Hash of canonical JSON, T-8."""
    return table(spark, d, "events").select("event_id", F.sha2(F.col("props").cast("binary"), 256).alias("plain"), identity.canonical_digest(F.col("props")).alias("digest"))


#: Exact ties of two decimals are odd multiples of 1/8; printf rounds those to even, the rule is away from zero.
CELL = "coalesce(printf('%.2f', {0} + CASE WHEN {0} * 8 = floor({0} * 8) AND CAST({0} * 8 AS BIGINT) % 2 = 1 THEN 0.001 ELSE 0 END), '')"


@registered(f"""WITH s AS (SELECT p_brand AS task, l_orderkey % 3 AS model_id, 2 * avg(l_quantity) AS score FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), w AS (SELECT task, max(score) FILTER (model_id = 0) AS a, max(score) FILTER (model_id = 1) AS b, max(score) FILTER (model_id = 2) AS c FROM s GROUP BY task)
SELECT task, task || ',' || {CELL.format("a")} || ',' || {CELL.format("b")} || ',' || {CELL.format("c")} AS line FROM w""")
def text_table(spark, d):
    """SNK-7, the body: every order is of one of three models."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.groupBy(F.col("p_brand").alias("task"), (F.col("l_orderkey") % 3).alias("model_id")).agg((2 * F.avg("l_quantity")).alias("score"))
    return writers.text_table(rows, [0, 1, 2])


@registered(f"""WITH s AS (SELECT p_brand AS task, l_linenumber AS model_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT)::DOUBLE AS score FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT task, task || {" || ".join(f"',' || coalesce(printf('%.2f', max(score) FILTER (model_id = {k})), '')" for k in LINES)} AS line FROM s GROUP BY task""")
def text_table_lines(spark, d):
    """SNK-7 over all rows: each of the seven line numbers is a model; sums of whole numbers, so that two decimals never stand on a tie."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.groupBy(F.col("p_brand").alias("task"), F.col("l_linenumber").alias("model_id")).agg(F.sum(F.col("l_quantity").cast("bigint")).cast("double").alias("score"))
    return writers.text_table(rows, list(LINES))


@registered("""SELECT l_orderkey, l_linenumber, count(DISTINCT l_suppkey) AS models, min(l_suppkey) AS first_model FROM lineitem GROUP BY ALL""")
def answer_documents(spark, d):
    """SNK-5."""
    rows = table(spark, d, "lineitem").select(F.lit("t").alias("task"), F.col("l_orderkey").alias("sample_index"), F.col("l_linenumber").alias("question_index"), F.col("l_suppkey").alias("model_id"), "l_returnflag")
    rows = rows.groupBy("task", "sample_index", "question_index", "model_id").agg(F.max("l_returnflag").alias("answer")).select("*", F.lit(1.0).alias("accuracy"), F.lit(1).alias("instruction"), F.lit(None).cast("double").alias("other"), F.lit(None).cast("int").alias("pair"))
    out = writers.answer_documents(rows)
    return out.select(F.col("sample_index").alias("l_orderkey"), F.col("question_index").alias("l_linenumber"), F.size("answers").cast("bigint").alias("models"), F.array_min(F.map_keys("answers")).alias("first_model"))


# ---- readings and reports -----------------------------------------------------------------------

GRID = """g AS (SELECT l_suppkey AS model_id, p_brand AS task, (l_linenumber % 2 = 0) AS box, CASE WHEN l_returnflag = 'N' THEN 1.0 WHEN l_returnflag = 'R' THEN 0.5 ELSE 0.0 END::DOUBLE AS acc, l_discount * 10 AS iou,
(l_linestatus = 'O')::INTEGER AS ins FROM lineitem JOIN part ON l_partkey = p_partkey),
c AS (SELECT model_id, task, (sum(CASE WHEN box THEN 0 ELSE acc END) + count(*) FILTER (box AND iou > 0.5)) / count(*) AS accuracy, avg(iou) FILTER (box) AS mean_iou, count(*) FILTER (box) AS boxes, count(*) FILTER (box AND iou > 0.5) AS hits,
100 * (coalesce(avg(iou) FILTER (box), 0) * 0.3 + (sum(CASE WHEN box THEN 0 ELSE acc END) + count(*) FILTER (box AND iou > 0.5)) / count(*) * 0.5 + avg(ins) * 0.2) AS score FROM g GROUP BY model_id, task)"""


def grid_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    acc = F.when(F.col("l_returnflag") == "N", 1.0).when(F.col("l_returnflag") == "R", 0.5).otherwise(0.0)
    marked = rows.select(F.col("l_suppkey").alias("model_id"), F.col("p_brand").alias("task"), F.when(F.col("l_linenumber") % 2 == 0, "box").otherwise("choice").alias("kind"), acc.alias("accuracy"), (F.col("l_linestatus") == "O").cast("int").alias("instruction"), (F.col("l_discount") * 10).alias("grid_iou"), F.lit(0.3).alias("w_other"), F.lit(0.5).alias("w_accuracy"), F.lit(0.2).alias("w_instruction"))
    return readings.grid_composite(marked, ["model_id", "task"])


@registered(f"WITH {GRID} SELECT model_id, task, round(accuracy, 6) AS accuracy, round(mean_iou, 6) AS mean_iou, boxes, hits, round(score, 6) AS score FROM c")
def grid_composite(spark, d):
    """AGG-22."""
    return grid_scores(spark, d).select("model_id", "task", r6("accuracy").alias("accuracy"), r6("mean_iou").alias("mean_iou"), "boxes", "hits", r6("score").alias("score"))


@registered(f"""WITH {SCORES}, {GRID}, j AS (SELECT ts.*, c.score AS grid FROM ts LEFT JOIN (SELECT * FROM c WHERE boxes > 2) c USING (model_id, task))
SELECT model_id, round(sum(score * n) / sum(n), 6) AS pixels, round(sum(coalesce(grid, score) * n) / sum(n), 6) AS grid, round(sum(score * n) FILTER (grid IS NULL) / nullif(sum(n) FILTER (grid IS NULL), 0), 6) AS "none" FROM j GROUP BY model_id""")
def reading_variants(spark, d):
    """AGG-23."""
    out = readings.variants(task_scores(spark, d), grid_scores(spark, d).where("boxes > 2"))  # a task with few boxes has no grid score
    return out.select("model_id", *[r6(c).alias(c) for c in ("pixels", "grid", "none")])


@registered("""WITH a AS (SELECT l_orderkey, l_linenumber, l_linenumber * 3 AS x, l_quantity AS q FROM lineitem), i AS (SELECT *, greatest(least(x + 100, trunc((x + 20) * 2.0)) - greatest(x, trunc(x * 2.0)) + 1, 0) * greatest(least(50, trunc(q * 1.0)) - greatest(1, 1) + 1, 0) AS shared,
101 * 50 AS a1, (trunc((x + 20) * 2.0) - trunc(x * 2.0) + 1) * (trunc(q * 1.0) - 1 + 1) AS a2 FROM a)
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 5 THEN 0.0 ELSE round(shared::DOUBLE / (a1 + a2 - shared), 6) END::DOUBLE AS grid_iou FROM i""")
def grid_overlaps(spark, d):
    """MRK-10, JN-13."""
    x = F.col("l_linenumber") * 3
    dims = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit(2000).alias("width"), F.lit(1000).alias("height"))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_quantity").join(dims, "id")
    answer = F.when(F.col("l_linenumber") == 5, F.lit("nowhere")).otherwise(F.concat(F.lit("["), F.concat_ws(", ", x, F.lit("1"), x + 20, F.format_string("%.1f", F.col("l_quantity"))), F.lit("]")))
    boxes = rows.select("id", F.col("id").alias("l_orderkey"), "l_linenumber", "width", "height", F.lit("grid").alias("convention"), F.array(x.cast("double"), F.lit(1.0), (x + 100).cast("double"), F.lit(50.0)).alias("reference"), answer.alias("answer"))
    out = readings.grid_marks(boxes)
    return out.select("l_orderkey", "l_linenumber", r6("grid_iou").alias("grid_iou"))


@registered(f"""WITH {SCORES}, c AS (SELECT model_id, task, 'accuracy' AS component, score / 100 AS value, 0.8 AS weight FROM ts UNION ALL SELECT model_id, task, 'instruction', n / 1000.0, 0.2 FROM ts UNION ALL SELECT model_id, task, 'other', 0.5, 0.3 FROM ts WHERE task = 'Brand#12')
SELECT model_id, task, component, round(value::DOUBLE, 6) AS value, weight::DOUBLE AS weight, round(100 * value * weight, 6)::DOUBLE AS points FROM c""")
def component_breakdown(spark, d):
    """PRJ-11."""
    rows = task_scores(spark, d).select("model_id", "task", (F.col("score") / 100).alias("accuracy"), (F.col("n") / 1000.0).cast("double").alias("instruction"), F.lit(0.5).alias("other"), F.when(F.col("task") == "Brand#12", 0.3).otherwise(0.0).alias("w_other"), F.lit(0.8).alias("w_accuracy"), F.lit(0.2).alias("w_instruction"))
    out = exports.component_rows(rows)
    return out.select("model_id", "task", "component", r6("value").alias("value"), "weight", r6("points").alias("points"))


@registered(f"SELECT l_orderkey, count(*) FILTER ({ACC} >= 1) AS \"right\" FROM lineitem GROUP BY l_orderkey ORDER BY 2, 1 LIMIT 60 OFFSET 60")
def hardest_page(spark, d):
    """SRT-7, FLT-8 (the second page of a report)."""
    return exports.page(analysis.difficulty(accuracies(spark, d), ["l_orderkey"], 7), [F.asc("right"), F.asc("l_orderkey")], 1).select("l_orderkey", "right")


@registered("""SELECT event_id, 'm' AS model_id, event_type AS answer, CAST(len(event_type) AS INTEGER) AS answer_chars, CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 5 AS INTEGER) ELSE 1 END AS attempt, CAST(json_extract_string(props, '$.k') AS BIGINT) AS prompt_tokens, 'full-original' AS condition, false AS lossy_fallback, 'off · high' AS chips FROM events""")
def exported_answers(spark, d):
    """PRJ-4, PRJ-5, PRJ-7, PRJ-8."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    none = lambda t: F.lit(None).cast(t)
    usage_ = F.struct(k.alias("prompt_tokens"), none("bigint").alias("completion_tokens"), none("double").alias("cost"), F.struct(none("bigint").alias("reasoning_tokens")).alias("completion_tokens_details"))
    rows = table(spark, d, "events").select(
        "event_id", F.lit("m").alias("model_id"), F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("answer"), none("string").alias("finish_reason"), F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 5).cast("int")).alias("attempt"),
        F.col("props").alias("response"), "value", F.col("value").alias("elapsed_seconds"), usage_.alias("usage"), none("string").alias("condition"), none("boolean").alias("lossy_fallback"), none("string").alias("protocol_sha256"), F.col("ts").alias("timestamp"),
    )
    out = exports.answers_table(rows)
    chips = exports.condition_chips(exports.reasoning_label(F.lit("none")), none("string"), exports.reasoning_label(F.lit("high")))
    return out.select(F.col("question_id").cast("bigint").alias("event_id"), "model_id", "answer", "answer_chars", "attempt", "prompt_tokens", "condition", "lossy_fallback", chips.alias("chips"))


@registered("""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN CASE WHEN l_quantity > 25 THEN 'bad box' END WHEN 1 THEN CASE WHEN l_quantity > 25 THEN 'bad relation' END WHEN 2 THEN CASE WHEN l_quantity <= 25 THEN 'bad speed pair' END ELSE CASE WHEN l_quantity > 25 THEN 'empty reference' END END AS error FROM lineitem""")
def reference_checks(spark, d):
    """FLT-9, FLT-10."""
    k, many = F.col("l_linenumber") % 4, F.col("l_quantity") > 25
    family = F.when(k == 0, "grounding").when(k == 1, "relation").when(k == 2, "speed").otherwise("choice")
    text = F.when(k == 1, F.when(many, "1/").otherwise("1/2")).when(k == 2, F.when(many, "x [1, 2]").otherwise("[1]")).otherwise(F.when(many, "").otherwise("A"))
    box = F.array(F.when(many, 9.0).otherwise(1.0), F.lit(1.0), F.lit(5.0), F.lit(5.0))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", exports.reference_errors(family, k == 0, text, box).alias("error"))


from . import documents, from_files, whole  # noqa: E402, F401  (register the queries of the whole evaluation, of files and of documents, which use the helpers above)
