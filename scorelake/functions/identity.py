"""Hashes that identify records."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(value: object) -> str:
    """JSON with sorted keys, no spaces, raw Unicode and no NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def digest(value: object) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def digest_or_none(value: object) -> str | None:
    """None for a value that has no canonical form: a number that is not finite."""
    try:
        return digest(value)
    except ValueError:
        return None


def canonical_digest(raw: Column) -> Column:
    """SHA-256 of the canonical form of JSON texts; null for null and for texts without such a form (see digest_error).

    Spark's to_json neither sorts keys nor writes floats like this, so it is an Arrow function.
    """

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def of(text: str | None) -> str | None:
            try:
                return None if text is None else digest(json.loads(text))
            except ValueError:  # no JSON, or a number that is not finite
                return None

        return texts.map(of)

    return run(raw)


def digest_error(raw: Column, digest: Column) -> Column:
    """Why a text has no digest; null where it has one, or is null itself."""
    return F.when(raw.isNotNull() & digest.isNull(), "no canonical JSON")


def joined_digest(*parts: Column) -> Column:
    """SHA-256 of the parts, each with its length in front: distinct lists never join to one text."""
    each = [F.concat(F.char_length(F.coalesce(p.cast("string"), F.lit(""))).cast("string"), F.lit(":"), F.coalesce(p.cast("string"), F.lit(""))) for p in parts]
    return F.sha2(F.concat_ws("|", *each).cast("binary"), 256)


def short_id(*parts: Column) -> Column:
    return F.substring(joined_digest(*parts), 1, 24)


def question_id(revision: Column, task: Column, sample_index: Column, question_index: Column, sample: Column) -> Column:
    """24 hex digits that name a question: of the canonical list of revision, task, both positions and the digest of the sample's JSON."""
    return question_id_of(revision, task, sample_index, question_index, canonical_digest(sample))


def question_id_of(revision: Column, task: Column, sample_index: Column, question_index: Column, sample_digest: Column) -> Column:
    """The same, from the sample's digest."""
    names = F.to_json(F.array(revision, task))
    listed = F.concat(F.substring(names, F.lit(1), F.char_length(names) - 1), F.lit(","), F.concat_ws(",", sample_index, question_index), F.lit(',"'), sample_digest, F.lit('"]'))
    return F.substring(F.sha2(listed.cast("binary"), 256), 1, 24)


def request_digest(model: Column, prompt: Column, urls: Column, max_tokens: Column, effort: Column, effort_parameter: Column, detail: str = "high", video: Column | None = None) -> Column:
    """SHA-256 of a request's canonical JSON: its frames as images, or as one video where ``video`` holds, then the prompt.

    Fields stand in the order of their names, and null fields are left out.
    """
    image = lambda u: F.struct(F.struct(F.lit(detail).alias("detail"), u.alias("url")).alias("image_url"), F.lit(None).cast("string").alias("text"), F.lit("image_url").alias("type"), F.lit(None).cast(CLIP).alias("video_url"))
    plain = lambda kind, text, clip: F.struct(F.lit(None).cast("struct<detail:string,url:string>").alias("image_url"), text.cast("string").alias("text"), F.lit(kind).alias("type"), clip.cast(CLIP).alias("video_url"))
    clip = F.array(plain("video_url", F.lit(None), F.struct(F.size(urls).alias("encoded_frames"), urls.alias("frames"))))
    shown = F.transform(urls, image) if video is None else F.when(video, clip).otherwise(F.transform(urls, image))
    content = F.concat(shown, F.array(plain("text", prompt, F.lit(None))))
    direct, off = effort_parameter == "reasoning_effort", effort == "none"
    reasoning = F.when(~direct, F.struct(F.when(~off, effort).alias("effort"), F.when(off, F.lit(False)).alias("enabled")))
    message = F.struct(content.alias("content"), F.lit("user").alias("role"))
    payload = F.struct(max_tokens.alias("max_tokens"), F.array(message).alias("messages"), model.alias("model"), reasoning.alias("reasoning"), F.when(direct, effort).alias("reasoning_effort"))
    return F.sha2(F.to_json(payload).cast("binary"), 256)


CLIP = "struct<encoded_frames:int,frames:array<string>>"

# Forms of identifiers.
REVISION = r"\A[0-9a-f]{40}\z"
SHA256 = r"\A[0-9a-f]{64}\z"
COLOUR = "^#[0-9a-f]{6}$"


def is_revision(c: Column) -> Column:
    return F.coalesce(F.rlike(c, F.lit(REVISION)), F.lit(False))


def is_colour(c: Column) -> Column:
    return F.coalesce(F.rlike(c, F.lit(COLOUR)), F.lit(False))


def is_relative_path(c: Column) -> Column:
    """A path below its root: not empty, not absolute, without backslashes and without steps to itself or its parent."""
    steps = F.filter(F.split(c, "/"), lambda p: p != "")
    good = (F.size(steps) > 0) & ~F.startswith(c, F.lit("/")) & ~F.contains(c, F.lit("\\")) & ~F.exists(steps, lambda p: p == "..") & ~F.rlike(c, F.lit(r"^\./*$"))
    return F.coalesce(good, F.lit(False))
