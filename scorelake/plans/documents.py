"""Registered queries that go through a run's documents: catalogue, registry, specifications, prices, receipts, payloads, records and guarded score files.

The documents are derived from the tables, written under the shared folder and read back by the library's readers.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import marks as M
from ..operators import exports, joins
from ..session import fresh_folder
from ..sources import lines, readers, specs, writers
from .from_files import REVISION, _kept
from .queries import r6, registered, table


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _collected(rows: DataFrame, order: str, text: str, between: str, *keys: str) -> DataFrame:
    """keys, all: the texts of a document in their order.  A document is read whole, so its rows fit one task."""
    found = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(found, lambda x: x["t"]), between).alias("all"))


@registered("""WITH c AS (SELECT r_name AS category, n_name AS grp, s_suppkey AS k, CASE WHEN s_suppkey = 1 THEN 'Trajectory' ELSE s_name END AS task, row_number() OVER (ORDER BY r_name, n_name, s_suppkey) - 1 AS ordinal FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT category, grp, task, ordinal, task <> 'Trajectory' AS available, count(*) AS answers FROM c JOIN lineitem ON l_suppkey = k GROUP BY ALL""")
def catalogue_groups(spark: SparkSession, d: str) -> DataFrame:
    """SRC-3, JN-7: a nested catalogue document flattened in its order, and the tasks of all answers with their category and group."""
    at = fresh_folder(spark, "catalogue")
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    task = F.when(F.col("s_suppkey") == 1, "Trajectory").otherwise(F.col("s_name"))
    tasks = table(spark, d, "supplier").withColumn("task", task)
    listed = lambda *c: F.sort_array(F.collect_list(F.struct(*c)))
    groups = tasks.join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("r_name", "n_name").agg(F.transform(listed("s_suppkey", "task"), lambda x: x["task"]).alias("tasks"))
    cats = groups.groupBy("r_name").agg(listed("n_name", "tasks").alias("groups"))
    whole = cats.agg(F.to_json(F.map_from_entries(F.transform(listed("r_name", "groups"), lambda c: F.struct(c["r_name"], F.map_from_entries(c["groups"]))))).alias("value"))
    lines.written_lines(whole.select(F.lit("all").alias("name"), "value"), at, ["name"], [])
    known = readers.catalogue(spark, f"{at}/*/*").withColumnRenamed("group", "grp")
    answers = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("answers")).join(tasks.select(F.col("s_suppkey").alias("l_suppkey"), "task"), "l_suppkey")
    out = answers.join(F.broadcast(known), "task")  # a row a task
    return _kept(spark, out.select("category", "grp", "task", F.col("ordinal").cast("bigint").alias("ordinal"), "available", "answers"), at)


@registered("""SELECT 'm' || s_suppkey AS model_id, CASE WHEN k <> 3 THEN 'L ' || s_suppkey END AS label, CASE WHEN k <> 7 THEN s_suppkey % 5 END AS size_rank, k NOT IN (1, 2) AS featured, CASE WHEN k = 1 THEN 'too old' END AS not_featured_reason,
  CASE k WHEN 2 THEN 'no not_featured_reason' WHEN 3 THEN 'missing label' WHEN 4 THEN 'unknown more' WHEN 5 THEN 'bad box_convention' WHEN 6 THEN 'bad color' WHEN 7 THEN 'bad size_rank or featured' END AS error FROM (SELECT *, s_suppkey % 8 AS k FROM supplier)""")
def registry_entries(spark: SparkSession, d: str) -> DataFrame:
    """SRC-8, SET-4: registry documents (one for every thousand models) whose entries have exactly the keys and values allowed, or say what is wrong."""
    at = fresh_folder(spark, "registry")
    n = F.col("s_suppkey")
    k = n % 8
    fields = [
        F.when(k != 3, _text('"label": "L ', n, '"')), F.lit('"lab": "X", "parameters": "1B"'), _text('"box_convention": "', F.when(k == 5, "yards").otherwise("grid_yx"), '"'), _text('"color": "', F.when(k == 6, "red").otherwise("#00ff0a"), '"'),
        _text('"featured": ', F.when(k.isin(1, 2), "false").otherwise("true")), _text('"size_rank": ', F.when(k == 7, '"x"').otherwise((n % 5).cast("string"))), F.when(k == 1, '"not_featured_reason": "too old"'), F.when(k == 4, '"more": 1'),
    ]
    rows = table(spark, d, "supplier").select("s_suppkey", F.floor(n / 1000).alias("part"), _text('"m', n, '": {', F.concat_ws(", ", *fields), "}").alias("entry"))
    whole = _collected(rows, "s_suppkey", "entry", ", ", "part")
    lines.written_lines(whole.select("part", _text("{", F.col("all"), "}").alias("value")), at, ["part"], [])
    found = readers.registry(spark, f"{at}/*/*")
    return _kept(spark, found.select("model_id", "label", F.col("size_rank").cast("bigint").alias("size_rank"), "featured", "not_featured_reason", "error"), at)


_FILES = """f AS (SELECT o_orderkey // 500 AS f, sha256(string_agg(o_orderkey || ',' || o_custkey, chr(10) ORDER BY o_orderkey) || chr(10)) AS sha256 FROM orders GROUP BY ALL)"""


@registered(f"""WITH {_FILES} SELECT 'f=' || f AS name, 'x' || substring(sha256, 2) AS expected, sha256 FROM f WHERE f % 3 = 0 UNION ALL SELECT 'gone=' || f, sha256, NULL FROM f WHERE f % 3 = 2""")
def changed_files(spark: SparkSession, d: str) -> DataFrame:
    """SRC-2: checksums of a file for every 500 orders against those expected; files that differ or are not there."""
    at = fresh_folder(spark, "files")
    f = F.floor(F.col("o_orderkey") / 500)
    rows = table(spark, d, "orders").select(f.alias("f"), "o_orderkey", F.concat_ws(",", "o_orderkey", "o_custkey").alias("value"))
    lines.written_lines(rows, at, ["f"], ["o_orderkey"])
    sha = F.sha2(_text(F.col("all"), "\n").cast("binary"), 256)
    right = _collected(rows, "o_orderkey", "value", "\n", "f").select("f", sha.alias("sha"))
    name = _text(F.when(F.col("f") % 3 == 2, "gone=").otherwise("f="), F.col("f"))
    expected = right.select(name.alias("name"), F.when(F.col("f") % 3 == 0, _text("x", F.substring("sha", 2, 63))).otherwise(F.col("sha")).alias("sha256"))
    found = readers.checksums(spark, f"{at}/*/*").withColumn("path", F.element_at(F.split("path", "/"), -2))  # a folder holds one file
    return _kept(spark, readers.mismatches(found, expected), at)


@registered("""SELECT coalesce(url, '') || '#' || page_id AS url, CASE WHEN page_id % 3 = 0 THEN 1280 ELSE 640 END + page_id % 7 + (page_id % 5 = 0)::INTEGER AS width, CASE WHEN page_id % 3 = 0 THEN 720 ELSE 480 END AS height FROM pages""")
def frame_sizes(spark: SparkSession, d: str) -> DataFrame:
    """SRC-12: receipts that list frames, two for a third of the pages; of a frame seen twice the later file's size, and within a file the later entry's."""
    at = fresh_folder(spark, "receipts")
    k = F.col("page_id")
    frame = lambda wide, high, more: F.struct(_text(F.coalesce("url", F.lit("")), "#", k).alias("url"), (F.lit(wide) + k % 7 + more).alias("width"), F.lit(high).alias("height"))
    pages = table(spark, d, "pages")

    def receipt(name: str, rows: DataFrame, wide: int, high: int) -> DataFrame:
        once = F.struct(F.lit(0).alias("again"), k.alias("k"), frame(wide, high, 0).alias("f"))
        twice = F.struct(F.lit(1).alias("again"), k.alias("k"), frame(wide, high, 1).alias("f"))
        each = rows.select(F.floor(k / 100).alias("part"), F.explode(F.when(k % 5 == 0, F.array(once, twice)).otherwise(F.array(once))).alias("x"))
        return each.groupBy("part").agg(F.sort_array(F.collect_list("x")).alias("all")).select(_text(name, F.col("part")).alias("receipt"), F.to_json(F.struct(F.transform("all", lambda x: x["f"]).alias("frames"))).alias("value"))

    lines.written_lines(receipt("a", pages, 640, 480).union(receipt("b", pages.where(k % 3 == 0), 1280, 720)), at, ["receipt"], [])
    return _kept(spark, readers.frame_dimensions(spark, f"{at}/*/*").select("url", F.col("width").cast("bigint").alias("width"), "height"), at)


@registered("""WITH m AS (SELECT s_suppkey AS model_id, 'x/' || s_suppkey AS slug, s_suppkey % 7 <> 3 AS listed FROM supplier), p AS (SELECT *, CASE WHEN listed THEN CASE WHEN model_id % 4 = 0 THEN 0.5 ELSE CAST('0.' || lpad(model_id::VARCHAR, 6, '0') AS DOUBLE) END END::DOUBLE AS prompt, CASE WHEN listed AND model_id % 2 = 0 THEN 0 END::DOUBLE AS cached FROM m)
SELECT model_id, slug, prompt, cached, round(sum(l_quantity) * prompt, 6)::DOUBLE AS cost FROM p JOIN lineitem ON l_suppkey = model_id GROUP BY model_id, slug, prompt, cached""")
def list_costs(spark: SparkSession, d: str) -> DataFrame:
    """SRC-14, JN-16: saved price lists (one for every thousand models), of a slug listed twice the later entry; what all answers cost by it, null for models that are not listed."""
    at = fresh_folder(spark, "prices")
    k = F.col("s_suppkey")
    entry = lambda price: _text('{"id": "x/', k, '", "pricing": {"prompt": "', price, '", "completion": "0.1"', F.when(k % 2 == 0, ', "input_cache_read": "0"').otherwise(""), "}}")
    first, later = entry(_text("0.", F.lpad(k.cast("string"), 6, "0"))), entry(F.lit("0.5"))
    rows = table(spark, d, "supplier").where(k % 7 != 3).select("s_suppkey", F.floor(k / 1000).alias("part"), F.when(k % 4 == 0, F.concat_ws(", ", first, later)).otherwise(first).alias("entry"))
    lines.written_lines(_collected(rows, "s_suppkey", "entry", ", ", "part").select("part", _text('{"data": [', F.col("all"), "]}").alias("value")), at, ["part"], [])
    models = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("model_id")).agg(F.sum("l_quantity").alias("q")).withColumn("slug", _text("x/", F.col("model_id")))
    out = joins.priced(models, readers.prices(spark, f"{at}/*/*"))
    return _kept(spark, out.select("model_id", "slug", "prompt", F.col("input_cache_read").alias("cached"), r6(F.col("q") * F.col("prompt")).alias("cost")), at)


@registered("SELECT c_custkey // 1000 AS part, c_custkey AS k, c_name || ';' AS name, c_custkey % 3 AS frames FROM customer")
def payload_rows(spark: SparkSession, d: str) -> DataFrame:
    """SRC-9: script files that assign one value each, a file for every thousand customers."""
    at = fresh_folder(spark, "payloads")
    item = F.struct(F.col("c_custkey").alias("k"), F.concat("c_name", F.lit(";")).alias("name"), (F.col("c_custkey") % 3).alias("frames"))
    parts = table(spark, d, "customer").groupBy(F.floor(F.col("c_custkey") / 1000).alias("part")).agg(F.sort_array(F.collect_list(item)).alias("rows"))
    lines.written_lines(parts.select("part", _text("window.DATA = ", F.to_json(F.struct("part", "rows")), "; ").alias("value")), at, ["part"], [])
    found = readers.payload(spark, f"{at}/*/*", "part bigint, rows array<struct<k: bigint, name: string, frames: bigint>>")
    return _kept(spark, found.select("part", F.explode("rows").alias("r")).select("part", "r.*"), at)


@registered("SELECT l_suppkey AS model_id, count(*) AS answers, round(avg(l_quantity), 6)::DOUBLE AS score, true AS refused FROM lineitem GROUP BY ALL")
def guarded_scores(spark: SparkSession, d: str) -> DataFrame:
    """SNK-6: scores of more answers take the place of those of fewer, and those of fewer are refused."""
    at = fresh_folder(spark, "guarded")
    scored = lambda rows: rows.groupBy(F.col("l_suppkey").alias("model_id")).agg(F.count("*").alias("answers"), r6(F.avg("l_quantity")).alias("score"))
    rows, refused = table(spark, d, "lineitem"), False
    fewer = scored(rows.where("l_linenumber > 1"))
    writers.guarded(fewer, at)
    writers.guarded(scored(rows), at)
    try:
        writers.guarded(fewer, at)
    except ValueError:
        refused = True
    return _kept(spark, spark.read.parquet(at).withColumn("refused", F.lit(refused)), at)


@registered("""SELECT n_name AS nation, count(DISTINCT s_suppkey) AS models, count(*) AS answers, sum(l_quantity)::DOUBLE AS quantity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL""")
def run_record(spark: SparkSession, d: str) -> DataFrame:
    """SRC-6, SNK-3: a record of a run as one JSON document (an entry a nation), written without NaN and read back."""
    at = f"{fresh_folder(spark, 'record')}/record.json"
    rows = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("answers"), F.sum("l_quantity").alias("quantity")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    by = rows.groupBy("s_nationkey").agg(F.count("*").alias("models"), F.sum("answers").alias("answers"), F.sum("quantity").alias("quantity")).join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    entries = {r["n_name"]: {"models": r["models"], "answers": r["answers"], "quantity": float(r["quantity"])} for r in by.collect()}  # an entry a nation
    writers.record(spark, {"nations": entries}, at)
    found = readers.record(spark, at, "nations map<string, struct<models: bigint, answers: bigint, quantity: double>>")
    return _kept(spark, found.select(F.explode("nations").alias("nation", "r")).select("nation", "r.*"), at.rsplit("/", 1)[0])


def _spec(protocol: dict, model: dict, times: int = 1, **top) -> str:
    """A specification of one model (named @), with changes."""
    own = {
        "id": "@", "provider": "p", "model": "m", "endpoint": "e", "credential": {"type": "environment"}, "reasoning_effort": "low", "reasoning_parameter": "reasoning_effort", "input_transport": "video_mp4",
        "video_options": None, "single_frame_policy": "as_is", "oversize_fallback": "none", "backend_reproducibility": "none",
    }
    asked = {"temperature": None, "prompt": "original", "coordinate_convention": "native_pixels", "max_tokens": 512}
    asked = {k: v for k, v in (asked | protocol).items() if v != "gone"}
    return json.dumps({"schema_version": 2, "dataset_revision": REVISION, "tasks": "all", "protocol": asked, "models": [own | model] * times} | top)


SPECS = (
    _spec({}, {}), _spec({}, {}, schema_version=1), _spec({"max_tokens": 0}, {}), _spec({}, {"more": 1}), _spec({"temperature": "gone"}, {}), _spec({}, {"single_frame_policy": "not_applicable"}), _spec({}, {}, times=2),
    _spec({"prompt": "other"}, {"reasoning_effort": "most", "oversize_fallback": "not_applicable"}),
)


@registered("""SELECT c_custkey, CASE c_custkey % 8 WHEN 1 THEN 'bad schema_version' WHEN 2 THEN 'bad max_tokens' WHEN 3 THEN 'm' || c_custkey || ': missing [], unknown [''more'']' WHEN 4 THEN 'bad temperature' WHEN 5 THEN 'm' || c_custkey || ': bad single_frame_policy'
  WHEN 6 THEN 'bad models' WHEN 7 THEN 'bad prompt; m' || c_custkey || ': bad reasoning_effort; m' || c_custkey || ': bad oversize_fallback' END AS error FROM customer""")
def spec_problems(spark: SparkSession, d: str) -> DataFrame:
    """SRC-7, SET-4: a specification for each customer, with its fields, values and key sets checked."""
    text = F.replace(F.element_at(F.array(*map(F.lit, SPECS)), (F.col("c_custkey") % 8 + 1).cast("int")), F.lit("@"), _text("m", F.col("c_custkey")))
    return table(spark, d, "customer").select("c_custkey", specs.spec_errors(text, REVISION).alias("error"))


@registered("""WITH i AS (SELECT l_returnflag AS task, l_orderkey AS sample_index, l_linenumber AS question_index FROM lineitem WHERE (l_orderkey + l_linenumber) % 5 <> 0), r AS (SELECT l_returnflag AS task, l_orderkey AS sample_index, l_linenumber AS question_index, 1 AS request FROM lineitem WHERE (l_orderkey + l_linenumber) % 7 <> 0)
SELECT task, sample_index, question_index, request IS NOT NULL AND item IS NOT NULL AS matched FROM (SELECT *, 1 AS item FROM i) FULL JOIN r USING (task, sample_index, question_index)""")
def matched_positions(spark: SparkSession, d: str) -> DataFrame:
    """JN-9: items and requests of all line items by their position; those without a partner show."""
    at = (F.col("l_orderkey") + F.col("l_linenumber")).alias("at")
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("task"), F.col("l_orderkey").alias("sample_index"), F.col("l_linenumber").alias("question_index"), at)
    items, requests = rows.where("at % 5 <> 0").withColumnRenamed("at", "item"), rows.where("at % 7 <> 0").withColumnRenamed("at", "request")
    return joins.by_position(items, requests).select("task", "sample_index", "question_index", "matched")


@registered("""WITH m AS (SELECT s_suppkey AS model_id, s_suppkey AS ordinal, CASE WHEN s_acctbal > 0 THEN floor(s_acctbal / 1000) END AS stat, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS first FROM supplier)
SELECT model_id, row_number() OVER (ORDER BY first, stat DESC NULLS LAST, ordinal DESC) AS down, row_number() OVER (ORDER BY first, stat NULLS FIRST, ordinal) AS up FROM m""")
def models_by_statistic(spark: SparkSession, d: str) -> DataFrame:
    """SRT-4: models by a statistic within groups in the order first seen; missing ones are the least, and turning the order turns ties."""
    stat = F.when(F.col("s_acctbal") > 0, F.floor(F.col("s_acctbal") / 1000))
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("model_id"), F.col("s_suppkey").alias("ordinal"), stat.alias("stat"), F.min("s_suppkey").over(Window.partitionBy("s_nationkey")).alias("first"))
    place = lambda down: F.row_number().over(Window.orderBy(*exports.by_statistic("stat", "first", "ordinal", down))).cast("bigint")  # noqa: E731  (models)
    return rows.select("model_id", place(True).alias("down"), place(False).alias("up"))


@registered("""WITH b AS (SELECT l_orderkey, l_linenumber, (l_orderkey % 90) AS x, (l_partkey % 70) AS y, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
r AS (SELECT *, [floor(x / 512.0 * 1000), floor(y / 256.0 * 1000), floor((x + 200) / 512.0 * 1000), floor((y + 100) / 256.0 * 1000)] AS a, [q, q, q + 400, q + 400] AS g FROM b),
s AS (SELECT *, greatest(least(a[3], g[3]) - greatest(a[1], g[1]) + 1, 0) * greatest(least(a[4], g[4]) - greatest(a[2], g[2]) + 1, 0) AS shared FROM r), v AS (SELECT l_orderkey, l_linenumber, round(shared / ((a[3] - a[1] + 1) * (a[4] - a[2] + 1) + 401 * 401 - shared), 6)::DOUBLE AS grid,
  greatest(least(x + 200, g[3]) - greatest(x, g[1]) + 1, 0) * greatest(least(y + 100, g[4]) - greatest(y, g[2]) + 1, 0) AS own FROM s) SELECT l_orderkey, l_linenumber, grid, round(own::DOUBLE / (201 * 101 + 401 * 401 - own), 6)::DOUBLE AS pixels FROM v""")
def rescaled_boxes(spark: SparkSession, d: str) -> DataFrame:
    """MRK-5: references on a 0..1000 grid for a model that answers so, and in pixels for one that does not."""
    x, y, q = F.col("l_orderkey") % 90, F.col("l_partkey") % 70, F.col("l_quantity").cast("bigint")
    reference, side = F.array(*[c.cast("double") for c in (x, y, x + 200, y + 100)]), F.array(F.lit(512.0), F.lit(256.0))
    answer = _text("it is [", q, ", ", q, ", ", q + 400, ", ", q + 400, "]")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[M.rescaled(reference, side, name).alias(c) for c, name in (("grid", "lab/Qwen-9"), ("pixels", "lab/other"))], answer.alias("answer"))
    overlap = lambda c: r6(M.box_mark(F.col(c), F.col("answer"))["other"]).alias(c)
    return rows.select("l_orderkey", "l_linenumber", overlap("grid"), overlap("pixels"))


@registered("SELECT l_orderkey AS sample, count(*) AS questions, sum(l_quantity)::DOUBLE AS frames, 'zstd' AS codec FROM lineitem GROUP BY ALL")
def slim_samples(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-9, SNK-2: samples with their questions as a Parquet table with zstd, read without the questions, of which the number stays."""
    at = fresh_folder(spark, "samples")
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sample")).agg(F.collect_list(F.struct("l_linenumber", "l_partkey")).alias("items"), F.sum("l_quantity").alias("frames"))
    writers.parquet(rows.withColumn("questions", F.size("items").cast("bigint")), at)
    codec = F.regexp_extract("_metadata.file_name", r"\.(\w+)\.parquet$", 1)
    return _kept(spark, spark.read.parquet(at).select("sample", "questions", "frames", codec.alias("codec")), at)
