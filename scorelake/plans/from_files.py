"""Registered queries that go through files: annotation files and journals derived from the tables, read back by line and scored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity
from ..functions import text as T
from ..operators import audit, exports, scores
from ..session import drop_folder, fresh_folder
from ..sources import lines, readers, writers
from . import sql_functions
from .queries import r6, registered, table
from .scoring_run import Model, Spec, candidates, scoring_run

REVISION = "0" * 40
LIVE = Spec("full", [Model("m0", "lab/m0", 1024, "low"), Model("m1", "lab/m1", 1024, "none")])
OLD = [Spec("half", [Model("m1", "lab/m1", 512, "none")]), Spec("tiny", [Model("m0", "lab/m0", 256), Model("m1", "lab/m1", 256)])]
TASKS = ("Weather", "VRU_Recognition", "Sign_Sign_Relation")


def _samples(spark: SparkSession, d: str) -> DataFrame:
    """A sample for each supplier: k (its place among all), task and JSON; references of every kind, frames under two names, one in ten without a country."""
    k, q = F.col("s_suppkey"), F.lit('"')
    kind = k % 3
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    frames = F.when(k % 2 == 0, text('"sequence": "s', k, '", "front": ["a b.jpg", "b.jpg"]')).otherwise(text('"sequence": "s', k, '", "back view": ["c.jpg"]'))
    head = F.when(k % 2 == 0, "[front]").otherwise("[back view]")
    country = F.when(k % 10 == 7, "5").otherwise('"X"')
    first = F.when(kind == 0, text(q, head, ";Which? ['a', '1.5', 'true']", q)).when(kind == 1, text(q, head, ";Where is it Located in the image?", q)).otherwise(text(q, head, ";Which signs?", q))
    second = F.when(kind == 0, text(q, head, ";Which one? ['b', 'c']", q)).when(kind == 1, text(q, head, ";Is it? ['yes', 'no']", q)).otherwise(text(q, head, ";Which other?", q))
    one = F.floor(k / 3) % 3
    ref = F.when(kind == 0, F.when(one == 0, '"A"').when(one == 1, "1.50").otherwise("true")).when(kind == 1, text("[10, 10.0, ", 50 + k % 5 * 10, ", 6e1]")).otherwise('"1/2"')
    other = F.when(kind == 0, '"b"').when(kind == 1, '"yes"').otherwise('"2"')
    made = text('{"country": ', country, ", ", frames, ', "questions": [', first, ", ", second, '], "reference": [', ref, ", ", other, "]}")
    return table(spark, d, "supplier").select(k.alias("k"), F.element_at(F.array(*map(F.lit, TASKS)), (kind + 1).cast("int")).alias("task"), made.alias("json"))


def _files(spark: SparkSession, d: str, at: str) -> None:
    """Annotation files (their samples in the order of k) and journals under a folder.

    Journals hold two lines for each answer, of which the earlier is wrong, with broken lines between; questions of one sample in ten lack the second answer.
    """
    rows = _samples(spark, d)
    # a task's file: its samples in order, one on a line
    ends = rows.groupBy("task").agg(F.min("k").alias("first"))
    signs = F.explode(F.array(F.struct(F.lit(0).alias("o"), F.lit("[").alias("value")), F.struct(F.lit(2).alias("o"), F.lit("]").alias("value")))).alias("x")
    signs = ends.select("task", F.col("first").alias("k"), signs).select("task", "k", "x.*")
    listed = rows.join(F.broadcast(ends), "task")  # a row a task
    listed = listed.select("task", "k", F.lit(1).alias("o"), F.concat(F.when(F.col("k") == F.col("first"), "").otherwise(", "), "json").alias("value"))
    lines.written_lines(listed.unionByName(signs).withColumn("name", F.concat("task", F.lit("_E.json"))), f"{at}/annotations", ["name"], ["o", "k"])
    from ..sources import annotations
    from . import dims

    asked = annotations.questions(spark, f"{at}/annotations", dims.task_families(spark), REVISION).where("id is not null")
    k, i = F.regexp_extract("sample_id", r"(\d+)$", 1).cast("bigint"), F.col("question_index")
    folder = F.concat_ws("/", "task", "sequence")
    asked = asked.withColumn("k", k).withColumn("urls", F.transform("frames", lambda f: T.frame_url("http://h", folder, f)))
    good = F.floor(F.col("k") / 9) % 2 == 0
    right = (
        F.when(F.col("task") == "Weather", F.when(i == 0, F.when(~good, "nope").otherwise(F.lower("reference"))).otherwise("b"))
        .when(F.col("task") == "VRU_Recognition", F.when(i == 0, "it is [10, 10, 50, 60]").otherwise(F.when(good, "Yes.").otherwise("no"))).otherwise(F.when(i == 0, F.when(good, "1/2").otherwise("3")).otherwise("2"))
    )
    hashes = candidates(asked, LIVE, OLD)
    # m0 answers as the live specification asks; m1 in part as superseded ones did
    old = F.col("k") % 4
    condition = F.when(F.col("model_id") == "m0", None).when(old == 1, "half").when(old == 2, "tiny")
    rows = asked.select("k", "task", "id", i.alias("i"), right.alias("right")).join(hashes, "id").withColumn("wanted", condition)
    rows = rows.where((F.col("precedence") == 0) & F.col("wanted").isNull() | F.col("wanted").eqNullSafe(F.col("condition")) & (F.col("precedence") > 0))
    rows = rows.where("not (k % 10 = 8 and i = 1)")
    line = lambda answer: F.to_json(F.struct("id", F.col("request_hash").alias("protocol_sha256"), answer.alias("answer"), F.col("wanted").alias("condition"), F.lit("stop").alias("finish_reason")))
    each = F.array(F.struct(F.lit(0).alias("o"), line(F.lit("wrong")).alias("value")), F.struct(F.lit(1).alias("o"), F.lit('{"id": "cut').alias("value")), F.struct(F.lit(2).alias("o"), line(F.col("right")).alias("value")))
    out = rows.select("model_id", "task", "k", "i", F.explode(each).alias("x")).select("model_id", "task", "k", "i", "x.o", "x.value")
    lines.written_lines(out, f"{at}/journal", ["model_id", "task"], ["o", "k", "i"])


def _kept(spark: SparkSession, df: DataFrame, *gone: str) -> DataFrame:
    """A small result as a table, after which the files that it came from go; the table goes with the application."""
    path = fresh_folder(spark, "result")
    df.write.parquet(path)
    drop_folder(spark, path, at_end=True)
    for uri in gone:
        drop_folder(spark, uri)
    return spark.read.schema(df.schema).parquet(path)


_IN = """s AS (SELECT s_suppkey AS k, ['Weather', 'VRU_Recognition', 'Sign_Sign_Relation'][s_suppkey % 3 + 1] AS task, s_suppkey % 3 AS kind, (s_suppkey // 9) % 2 = 0 AS good FROM supplier),
e AS (SELECT *, k % 10 NOT IN (7, 8) AS eligible FROM s)"""


@registered(f"""WITH {_IN}, b AS (SELECT *, 41 * 51 / ((41 + k % 5 * 10) * 51)::DOUBLE AS iou FROM e WHERE eligible),
c AS (SELECT task, CASE kind WHEN 0 THEN avg((good::INTEGER + 1) / 2.0) WHEN 1 THEN avg(((iou > 0.5)::INTEGER + good::INTEGER) / 2.0) ELSE avg((good::INTEGER + 1) / 2.0) END AS accuracy,
  CASE kind WHEN 0 THEN avg((good::INTEGER + 1) / 2.0) ELSE 1 END AS instruction, CASE kind WHEN 0 THEN 0 WHEN 1 THEN avg(iou) ELSE 1 END AS other, 2 * count(*) AS n FROM b GROUP BY task, kind)
SELECT model_id, task, round(accuracy, 6)::DOUBLE AS accuracy, round(instruction, 6)::DOUBLE AS instruction, round(other, 6)::DOUBLE AS other,
  round(CASE task WHEN 'Weather' THEN 80 * accuracy + 20 * instruction ELSE 30 * other + 50 * accuracy + 20 * instruction END, 6)::DOUBLE AS score, n FROM c, (SELECT unnest(['m0', 'm1']) AS model_id)""")
def scores_from_files(spark: SparkSession, d: str) -> DataFrame:
    """SRC-1, 4, 5, JN-1, 2, 18, MRK-11, TXT-4: files in, scores out; the last line of an answer counts, carried answers do, references are strings, numbers, booleans and boxes."""
    at = fresh_folder(spark, "run")
    _files(spark, d, at)
    run = scoring_run(spark, f"{at}/annotations/*/*", f"{at}/journal/*/*/*", LIVE, OLD, revision=REVISION, base="http://h")
    out = run.evaluation.task_scores().select("model_id", "task", *[r6(c).alias(c) for c in ("accuracy", "instruction", "other", "score")], "n")
    return _kept(spark, out, at)


@registered("""SELECT user_id, event_type, arg_max(event_id, (event_id % 2, event_id)) AS event_id, CAST(max(event_id % 2) AS VARCHAR) AS file FROM events GROUP BY ALL""")
def last_lines_by_file(spark: SparkSession, d: str) -> DataFrame:
    """SRC-4, SRC-5, AGG-34: events written to two files of JSON lines, in the order of their number; of each key the last line of the last file."""
    at = fresh_folder(spark, "lines")
    rows = table(spark, d, "events").select((F.col("event_id") % 2).alias("half"), "event_id", F.to_json(F.struct("user_id", "event_type", "event_id")).alias("value"))
    broken = rows.where("event_id % 97 = 0").select("half", "event_id", F.lit('{"user_id": ').alias("value"))
    lines.written_lines(rows.union(broken), at, ["half"], ["event_id"])
    found = lines.records(spark, f"{at}/*/*", "user_id bigint, event_type string, event_id bigint").where("event_id is not null")
    out = lines.last_lines(found, ["user_id", "event_type"]).select("user_id", "event_type", "event_id", F.regexp_extract("file", r"half=(\d)", 1).alias("file"))
    return _kept(spark, out, at)


@registered(r"""SELECT doc_id, CASE doc_id % 7 WHEN 3 THEN 'bad relation' WHEN 4 THEN 'bad relation' WHEN 6 THEN 'empty reference' END AS relation_error, doc_id % 3 = 1 AS revision, printf('%.6f', doc_id / 7.0 + 0.1234565)::DOUBLE AS accuracy, printf('%.4f', (doc_id % 1000) / 32.0 + 0.00005)::DOUBLE AS other FROM documents""")
def exact_checks(spark: SparkSession, d: str) -> DataFrame:
    """FLT-10, FLT-11, PRJ-6, T-7: whole matches (no line end after them), signed ids, blanks as references, and decimals of the exact double."""
    k = F.col("doc_id") % 7
    text = F.when(k == 0, "3/-4").when(k == 1, "-1").when(k == 2, "12/3/4").when(k == 3, "3/4\n").when(k == 4, "3//4").when(k == 5, " ").otherwise("")
    family = F.when(k < 5, "relation").otherwise("choice")
    sha = F.substring(F.sha2(F.col("doc_id").cast("string").cast("binary"), 256), 1, 40)
    revision = F.when(F.col("doc_id") % 3 == 0, F.concat(sha, F.lit("\n"))).when(F.col("doc_id") % 3 == 1, sha).otherwise(F.substring(sha, 1, 39))
    cell = exports.mark_cell(F.col("doc_id") / 7.0 + F.lit(0.1234565).cast("double"), (F.col("doc_id") % 1000) / 32.0 + F.lit(0.00005).cast("double"))
    return table(spark, d, "documents").select("doc_id", exports.reference_errors(family, F.lit(False), text, F.lit(None).cast("array<double>")).alias("relation_error"), identity.is_revision(revision).alias("revision"), cell.alias("c")).select("doc_id", "relation_error", "revision", "c.*")


# ---- audit, order of names, tasks written anew, SQL functions --------------------------------------


_Q = """q AS (SELECT o_orderkey AS k, o_custkey AS sample_index, o_orderkey % 5 AS t FROM orders),
a AS (SELECT k, sample_index, CASE t WHEN 0 THEN 'Sign_Sign_Relation' WHEN 1 THEN 'VRU_Cross' ELSE 'Weather' END AS task,
  CASE t WHEN 0 THEN 'scene_local_relation_ids' WHEN 1 THEN CASE WHEN k % 2 = 1 THEN 'yes_no [front]' ELSE 'yes_no' END WHEN 2 THEN 'categorical ["a", "b c", "d''e"]' WHEN 3 THEN 'categorical ["x", "y"]' ELSE 'categorical question Plain ' || k % 4 END AS key,
  CASE t WHEN 0 THEN 'scene_local_relation_ids' WHEN 1 THEN 'yes_no' ELSE 'categorical' END AS type,
  CASE t WHEN 0 THEN CASE WHEN k % 3 = 0 THEN 'x' ELSE '1/-2' END WHEN 1 THEN CASE WHEN k % 3 = 0 THEN 'yes' ELSE 'no' END WHEN 2 THEN CASE WHEN k % 11 = 0 THEN 'zzz' ELSE 'd''e' END WHEN 3 THEN CASE WHEN k % 4 < 2 THEN 'x' ELSE 'y' END ELSE 'one' END AS norm,
  CASE t WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN (k % 11 <> 0)::INTEGER WHEN 3 THEN 0 ELSE 1 END AS changed, CASE t WHEN 0 THEN (k % 3 = 0)::INTEGER WHEN 2 THEN (k % 11 = 0)::INTEGER ELSE 0 END AS bad FROM q)"""


def _audited(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    t = k % 5
    raw = (
        F.when(t == 0, "a.png;Which signs?").when(t == 1, F.concat(F.when(k % 2 == 1, "[front]").otherwise("a.png"), F.lit(";Is it? [2, 3] or ['yes', 'no']"))).when(t == 2, "a.png;Which of ['A', \"B c\", 'd\\'e', 'a'] [not a list]?")
        .when(t == 3, "a.png;Which? [1] ['y', 'x']").otherwise(F.concat(F.lit("a.png;Plain "), k % 4))
    )
    ref = (
        F.when(t == 0, F.when(k % 3 == 0, "x").otherwise("1/-2")).when(t == 1, F.when(k % 3 == 0, "(Yes.").otherwise("No:")).when(t == 2, F.when(k % 11 == 0, "zzz").otherwise("D'E"))
        .when(t == 3, F.when(k % 4 < 2, "x").otherwise("y")).otherwise("One")
    )
    rows = table(spark, d, "orders").select(
        F.when(t == 0, "Sign_Sign_Relation").when(t == 1, "VRU_Cross").otherwise("Weather").alias("task"), F.when(t == 0, "relation").when(t == 1, "judge").otherwise("choice").alias("family"), F.col("o_custkey").alias("sample_index"),
        k.alias("question_index"), raw.alias("raw_question"), ref.alias("reference"), F.lit("text").alias("reference_kind"), F.concat(F.lit('"'), ref, F.lit('"')).alias("raw_reference"), F.lit(None).cast("array<double>").alias("reference_box"),
    )
    return audit.labelled(rows)


@registered(f"""WITH {_Q}, n AS (SELECT task, key, norm, count(*) AS n, min(struct_pack(s := sample_index, k)) AS first FROM a GROUP BY ALL),
m AS (SELECT task, key, arg_max(norm, (n, -first.s, -first.k)) AS answer, max(n) AS correct FROM n GROUP BY ALL),
b AS (SELECT task, key, any_value(type) AS type, count(*) AS questions, count(DISTINCT sample_index) AS samples, CAST(sum(changed) AS BIGINT) AS changed, CAST(sum(bad) AS BIGINT) AS bad FROM a GROUP BY ALL)
SELECT task, key, type, questions, samples, changed, bad, CASE WHEN g THEN answer END AS answer, CASE WHEN g THEN correct END AS correct, CASE WHEN g THEN round(correct / questions, 6) END::DOUBLE AS accuracy
FROM (SELECT *, type = 'yes_no' OR (key LIKE 'categorical [%' AND bad = 0) AS g FROM b JOIN m USING (task, key))""")
def audit_buckets(spark: SparkSession, d: str) -> DataFrame:
    """AGG-26, AGG-27: buckets by kind and options (quotes and escapes of Python), selector or question; bad references; baselines only where answers are clean."""
    return audit.buckets(_audited(spark, d)).withColumn("accuracy", r6("accuracy"))


@registered(f"""WITH {_Q} SELECT task, key, 'normalized' AS form, norm AS label, count(*) AS n FROM a GROUP BY ALL
UNION ALL SELECT task, key, 'raw', '"' || CASE key[1:6] WHEN 'scene_' THEN norm WHEN 'yes_no' THEN CASE norm WHEN 'yes' THEN '(Yes.' ELSE 'No:' END ELSE CASE norm WHEN 'd''e' THEN 'D''E' WHEN 'one' THEN 'One' ELSE norm END END || '"', count(*) FROM a GROUP BY ALL""")
def audit_distributions(spark: SparkSession, d: str) -> DataFrame:
    """AGG-26: raw labels beside normalised ones."""
    return audit.distributions(_audited(spark, d)).drop("first")


_LABS = ("Zeta", "alpha", "Éclair", "eclipse", "Beta", "ångström", "apple")


@registered("""WITH m AS (SELECT s_suppkey AS model_id, s_nationkey % 7 AS k, s_suppkey % 5 AS size_rank, (s_suppkey % 3)::DOUBLE AS mean FROM supplier),
l AS (SELECT *, max(mean) OVER (PARTITION BY k) AS lab_best, [7, 1, 5, 6, 4, 2, 3][k + 1] AS place FROM m)
SELECT model_id, ['Zeta', 'alpha', 'Éclair', 'eclipse', 'Beta', 'ångström', 'apple'][k + 1] AS lab, lab_best, row_number() OVER (ORDER BY lab_best DESC, place, size_rank, model_id) AS position FROM l""")
def lab_names(spark: SparkSession, d: str) -> DataFrame:
    """SRT-2: names of labs in the order of a locale, whatever their case and accents."""
    rows = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("model_id"), F.element_at(F.array(*map(F.lit, _LABS)), (F.col("s_nationkey") % 7 + 1).cast("int")).alias("lab"), (F.col("s_suppkey") % 5).alias("size_rank"), (F.col("s_suppkey") % 3).cast("double").alias("mean")
    )
    return scores.best_of_lab(rows).select("model_id", "lab", "lab_best", F.col("position").cast("bigint").alias("position"))


@registered("SELECT task, l_suppkey, CASE task WHEN 'R' THEN 100 * n ELSE n END AS n FROM (SELECT l_returnflag AS task, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL)")
def rewritten_task(spark: SparkSession, d: str) -> DataFrame:
    """SNK-1, SNK-5, SRC-13: a folder a task; one task is written anew, others stay, and each is read by its folder only."""
    at = fresh_folder(spark, "tasks")
    rows = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("task"), "l_suppkey").agg(F.count("*").alias("n"))
    writers.by_task(rows, at)
    writers.by_task(rows.where("task = 'R'").withColumn("n", F.col("n") * 100), at)
    flags = ("A", "N", "R")
    parts = [readers.task_answers(spark, at, f) for f in flags]
    return _kept(spark, parts[0].unionByName(parts[1]).unionByName(parts[2]).select("task", "l_suppkey", "n"), at)


@registered("""WITH b AS (SELECT p_partkey, [10, 10, 50 + p_size, 60] AS a, [p_size, 20, p_size + 40, 70] AS g, p_size FROM part), s AS (SELECT *, greatest(least(a[3], g[3]) - greatest(a[1], g[1]) + 1, 0) * greatest(least(a[4], g[4]) - greatest(a[2], g[2]) + 1, 0) AS shared FROM b)
SELECT p_partkey, round(30.0 * (shared::DOUBLE / ((a[3] - a[1] + 1) * 51 + 41 * 51 - shared)) + 50.0 * (p_size % 2) + 20.0, 6)::DOUBLE AS score, (8 * ceil((640 + p_size * 10) / 16.0) * 30 * 1.2)::DOUBLE AS tokens FROM s""")
def sql_function_scores(spark: SparkSession, d: str) -> DataFrame:
    """SQL functions composite, box_iou and clip_tokens, in a query written in SQL."""
    sql_functions.register(spark)
    return spark.sql(
        """select p_partkey, round(composite(box_iou(array(10D, 10D, double(50 + p_size), 60D), array(double(p_size), 20D, double(p_size + 40), 70D)), double(p_size % 2), 1D, 0.3D, 0.5D, 0.2D), 6) as score,
        clip_tokens('patch', 640 + p_size * 10, 480, 8, 16, 1.2D, null, null) as tokens from {part}""",
        part=table(spark, d, "part"),
    )


_US = "epoch_us(ts) + event_id % 3 * 250000"


@registered(f"""SELECT event_id, t AS iso, substring(t, 1, 10) AS day, substring(t, 1, 19) || 'Z' AS second, CASE event_id % 3 WHEN 0 THEN 'Ordered image URLs for sequences and image URLs' WHEN 1 THEN 'Lossless 1 FPS MP4 sequences and image URLs' ELSE 'Lossless 1 FPS MP4 sequences and image URLs; receipted H.264 fallback above the provider body limit' END AS transport
FROM (SELECT event_id, strftime(make_timestamp({_US}), '%Y-%m-%dT%H:%M:%S') || CASE WHEN ({_US}) % 1000000 = 0 THEN '' ELSE '.' || lpad((({_US}) % 1000000)::VARCHAR, 6, '0') END || '+00:00' AS t FROM events)""")
def record_labels(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-7 and date scalars: times as ISO text, their day and second, and what a transport is called."""
    k = F.col("event_id") % 3
    iso = T.utc_text((F.unix_micros(F.col("ts").cast("timestamp")) + k * 250_000) / 1_000_000)
    rows = table(spark, d, "events").withColumn("iso", iso)
    label = T.transport_label(F.when(k == 0, "ordered_image_urls").otherwise("video_mp4"), F.when(k == 1, "none").otherwise("h264_crf18"))
    return rows.select("event_id", "iso", T.day_of(F.col("iso")).alias("day"), T.second_of(F.col("iso")).alias("second"), label.alias("transport"))
