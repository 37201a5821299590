"""Annotation files as questions: samples are VARIANT values, as their references are strings, numbers, booleans or boxes.

A file holds the list of a task's samples, on one line or many; a line is read whole.  Whole numbers beyond 64 bits, and fractions without an exponent beyond 38
digits, are read as doubles; a negative zero loses its sign.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity
from ..functions import marks as M
from ..functions import text as T
from ..operators import exports
from ..operators.marking import PAIRED
from . import lines

#: Models whose boxes are marked on a grid need the frame's size (fixed values).
GRID_MODELS = ("qwen", "internvl", "gemini", "drivemm", "ivl")


_BLANKS = re.compile(r"[ \t\n\r]*")
_AHEAD, _MOST = 1 << 16, 128 << 20  # characters read at once; of one sample (VARIANT holds no more)
_BATCH, _ROW = 1 << 20, 512  # characters given out at once; what a row counts for besides its text


class _NoList(Exception):
    """A text is no list of JSON values."""


def _distinct(pairs: list) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):  # VARIANT refuses names that repeat
        raise _NoList
    return found


def _refused(constant: str) -> None:
    raise _NoList


def _elements(parts: Iterator[str]) -> Iterator[tuple[str, object]]:
    """Text and value of each element of a JSON list that comes in parts; holds little more than one element at a time."""
    decoder = json.JSONDecoder(object_pairs_hook=_distinct, parse_constant=_refused)
    text, at, ended = "", 0, False

    def more() -> None:
        nonlocal text, at, ended
        held, size = [text[at:]], 0
        if len(held[0]) > _MOST:
            raise _NoList
        while size < max(_AHEAD, len(held[0])) and not ended:
            part = next(parts, None)
            ended = part is None
            held.append(part or "")
            size += len(held[-1])
        text, at = "".join(held), 0

    def sign() -> str:
        nonlocal at
        while True:
            at = _BLANKS.match(text, at).end()
            if at < len(text) or ended:
                return text[at : at + 1]
            more()

    if sign() != "[":
        raise _NoList
    at += 1
    empty = sign() == "]"
    while not empty:
        sign()
        try:
            value, end = decoder.raw_decode(text, at)
        except (ValueError, RecursionError):  # wrong, or cut
            end = len(text)
            if ended:
                raise _NoList from None
        if end == len(text) and not ended:  # it may go on
            more()
            continue
        yield text[at:end], value
        at = end
        after = sign()
        if after not in (",", "]"):
            raise _NoList
        if after == "]":
            break
        at += 1
    at += 1
    if sign():
        raise _NoList


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines of files in order to a row for each element, with its text and canonical digest (VARIANT does not keep the forms of
    numbers, which the digest is over), and at each file's end a row without sample_index that says whether all of it was a list.

    Rows go out in batches of about a million characters, whatever the size of samples and files."""
    rows, size = [], 0

    def made() -> pd.DataFrame:
        nonlocal size
        size = 0
        out = pd.DataFrame(rows, columns=["file", "sample_index", "text", "digest", "listed"]).astype({"sample_index": "Int32", "listed": "boolean"})
        rows.clear()
        return out

    lines_of = ((f, v) for batch in batches for f, v in zip(batch["file"], batch["value"]))
    for file, own in itertools.groupby(lines_of, key=lambda x: x[0]):
        n, listed = 0, True
        try:
            for text, value in _elements(v + "\n" for _, v in own):
                rows.append((file, n, text, identity.digest_or_none(value), None))
                n, size = n + 1, size + len(text) + _ROW
                if size > _BATCH:
                    yield made()
        except _NoList:
            listed = False
        rows.append((file, None, None, None, listed and n > 0))
        size += _ROW
        if size > _BATCH:
            yield made()
    yield made()


def _kind(v: Column) -> Column:
    """text, number, boolean, list, object or null."""
    t = F.schema_of_variant(v)
    return (
        F.when(t == "STRING", "text").when(t == "BOOLEAN", "boolean").when(F.startswith(t, F.lit("ARRAY")), "list").when(F.startswith(t, F.lit("OBJECT")), "object")
        .when(F.rlike(t, F.lit("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")), "number").otherwise("null")
    )


def token_text(v: Column) -> Column:
    """A reference as the text that marks compare: strings as they are, whole numbers by their digits, others in the shortest form, booleans capitalised; null for lists and objects."""
    kind, t = _kind(v), F.schema_of_variant(v)
    number = F.try_variant_get(v, "$", "double")
    whole = (t == "BIGINT") | (F.rlike(t, F.lit(r"^DECIMAL\(\d+,0\)$")) & (F.abs(number) >= 2.0**63))
    return (
        F.when(kind == "text", F.try_variant_get(v, "$", "string")).when(kind == "boolean", F.initcap(F.try_variant_get(v, "$", "string")))
        .when((kind == "number") & whole, F.try_variant_get(v, "$", "string")).when(kind == "number", T.number_text(number))
    )


def box_numbers(v: Column) -> Column:
    """The numbers of a list of numbers; null for anything else."""
    parts = F.try_variant_get(v, "$", "array<variant>")
    return F.when((_kind(v) == "list") & F.forall(parts, lambda x: _kind(x) == "number"), F.try_variant_get(v, "$", "array<double>"))


def _text_field(name: str) -> Column:
    v = F.try_variant_get("sample", f"$.{name}", "variant")
    return F.when(_kind(v) == "text", F.try_variant_get(v, "$", "string"))


def samples(spark: SparkSession, path: str) -> DataFrame:
    """task, sample_index, sample (VARIANT), digest, and error: one row for a file that holds no list.

    A task reads a file's lines in order and parts them into samples, of which it holds a few at a time; all else is done by sample.
    """
    read = lines.numbered(spark, path).repartition("file").sortWithinPartitions("file", "line").select("file", "value")
    cut = read.mapInPandas(_cut, "file string, sample_index int, text string, digest string, listed boolean")
    # a row a file; those without a line too
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"))
    files = files.join(cut.where("listed").select("file", "listed"), "file", "left")
    found = cut.where("sample_index is not null").select("file", "sample_index", "text", "digest").repartition("file", "sample_index")
    none = files.where("listed is null").select("file", *[F.lit(None).cast(t).alias(c) for c, t in found.dtypes[1:]])
    rows = found.join(F.broadcast(files.where("listed")), "file", "left_semi").unionByName(none)
    name = F.regexp_extract("file", r"([^/=]+?)(?:_E)?\.json(?:/[^/]*)?$", 1)  # of the file, or of the folder that Spark wrote it to
    rows = rows.select(name.alias("task"), "sample_index", F.try_parse_json("text").alias("sample"), "digest")
    return rows.withColumn("error", sample_error(F.col("sample")))


def sample_error(sample: Column) -> Column:
    """The first thing that is wrong with a sample's structure; null if nothing."""
    questions, reference = (F.try_variant_get(sample, f"$.{k}", "array<variant>") for k in ("questions", "reference"))
    texts = F.forall(questions, lambda q: (_kind(q) == "text") & F.contains(F.coalesce(F.try_variant_get(q, "$", "string"), F.lit("")), F.lit(";")))
    country = F.try_variant_get(sample, "$.country", "variant")
    return (
        F.when(sample.isNull(), "no list of samples").when(_kind(sample) != "object", "no object")
        .when(questions.isNull() | (F.size(questions) == 0) | ~F.coalesce(texts, F.lit(False)), "no questions with selectors")
        .when(reference.isNull() | (F.size(reference) != F.size(questions)), "questions and references differ in number")
        .when(country.isNull() | (_kind(country) != "text"), "no country")
    )


def frames(sample: Column, raw_question: Column) -> Column:
    """The frames that a bracketed selector names in the sample itself; null without such a selector, or where the sample has no such list.

    The path is built for each row, so samples may keep their frames under any name.
    """
    head = T.squish(T.selector(raw_question))
    name = F.substring(head, F.lit(2), F.char_length(head) - 2)
    many = F.startswith(head, F.lit("[")) & F.endswith(head, F.lit("]")) & ~F.rlike(name, F.lit("['\\\\]"))
    return F.try_variant_get(F.when(many, sample), F.concat(F.lit("$['"), F.when(many, name).otherwise("x"), F.lit("']")), "array<string>")


def selector_error(sample: Column, raw_question: Column) -> Column:
    """What is wrong with a question's selector; null if nothing."""
    parts = F.split(raw_question, ";", 2)
    head = T.squish(F.element_at(parts, 1))
    listed = F.startswith(head, F.lit("["))
    return (
        F.when((head == "") | (T.squish(F.try_element_at(parts, F.lit(2))) == ""), "empty selector or question")
        .when(listed & (F.coalesce(F.size(frames(sample, raw_question)), F.lit(0)) <= 0), "invalid sequence selector")
        .when(listed & (F.coalesce(F.try_variant_get(sample, "$.sequence", "string"), F.lit("")) == ""), "missing sequence folder")
    )


def questions(spark: SparkSession, path: str, families: DataFrame, revision: str, scorer_model: str = "") -> DataFrame:
    """A row for each question: id, task, family, sample_id, sample_index, question_index, raw_question, prompt, sequence, frames, reference (text), reference_kind, raw_reference (JSON), reference_box, dimension, error.

    Rows of a sample that has an error in its structure stand for it with question_index null; other errors are those of a question.
    """
    found = samples(spark, path).join(F.broadcast(families), "task", "left")  # a row a task
    items = F.arrays_zip(F.try_variant_get("sample", "$.questions", "array<variant>").alias("q"), F.try_variant_get("sample", "$.reference", "array<variant>").alias("r"))
    rows = found.select("*", F.posexplode_outer(F.when(F.col("error").isNull(), items)).alias("question_index", "item"))
    raw, ref = F.try_variant_get("item.q", "$", "string"), F.col("item.r")
    text_of = F.coalesce(F.try_variant_get("sample", "$.id", "string"), F.try_variant_get("sample", "$.sequence", "string"), F.col("sample_index").cast("string"))
    side = box_numbers(F.try_variant_get("sample", "$.dimension", "variant"))
    rows = rows.select(
        "task", "family", "sample", "sample_index", "question_index", "digest", text_of.alias("sample_id"), raw.alias("raw_question"), _text_field("country").alias("country"), _text_field("sequence").alias("sequence"),
        token_text(ref).alias("reference"), _kind(ref).alias("kind"), F.to_json(ref).alias("raw_reference"), box_numbers(ref).alias("reference_box"), side.alias("dimension"), "error", F.size(F.try_variant_get("sample", "$.questions", "array<variant>")).alias("n"),
    )
    box = M.is_box_question(F.col("raw_question"))
    strings = F.when((F.col("kind") == "text") | ~F.col("family").isin("relation", "speed"), F.col("reference"))
    finite = F.when((F.col("kind") == "number") & F.col("reference").isin("inf", "-inf", "nan"), "number not finite")
    odd = F.when(F.col("family").isin(*PAIRED) & (F.col("n") % 2 == 1), "halves differ in number")
    pair = F.coalesce((F.size("dimension") == 2) & F.forall("dimension", lambda d: d > 0), F.lit(False))
    grid = F.when((F.col("family") == "grounding") & box & ~pair, "no dimension") if any(k in scorer_model.lower() for k in GRID_MODELS) else F.lit(None).cast("string")
    # found below in the reference and selector of one question; a row without a question keeps what is wrong with its sample
    own = F.when(F.col("question_index").isNotNull(), F.coalesce(selector_error(F.col("sample"), F.col("raw_question")), exports.reference_errors(F.col("family"), box, strings, F.col("reference_box")), finite, odd, grid))
    name = identity.question_id_of(F.lit(revision), F.col("task"), F.col("sample_index"), F.col("question_index"), F.col("digest"))
    return rows.select(
        F.when(F.col("question_index").isNotNull(), name).alias("id"), "task", "family", "sample_id", "sample_index", "question_index", "raw_question", T.prompt(F.col("raw_question"), F.col("country")).alias("prompt"), "sequence",
        frames(F.col("sample"), F.col("raw_question")).alias("frames"), "reference", F.col("kind").alias("reference_kind"), "raw_reference", "reference_box", "dimension", F.coalesce("error", own).alias("error"),
    )
