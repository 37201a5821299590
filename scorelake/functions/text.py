"""Text steps of marking, as column expressions.

Patterns carry (?U) where digits or blanks of any script count, and (?d) where only a line
feed ends a line.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"(?U)^\s+|\s+$"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def squish(c: Column) -> Column:
    """Without white space of any kind at either end (trim takes spaces only)."""
    return F.regexp_replace(c, BLANKS, "")


def blank(c: Column) -> Column:
    """Null, or nothing but white space of any kind."""
    return c.isNull() | ~F.rlike(c, F.lit(r"(?U)\S"))


def question_text(raw: Column) -> Column:
    """Lower case, without what stands before the first semicolon, and without any other semicolon."""
    return F.array_join(F.slice(F.split(F.lower(raw), ";"), 2, 10_000), "")


def remove_symbols(answer: Column) -> Column:
    """What follows the last answer marker, without stars, line feeds and double quotes."""
    return F.regexp_replace(F.element_at(F.split(answer, "correct answer is:"), -1), '[*\\n"]', "")


def clean(c: Column) -> Column:
    """Without brackets, colons, quotes, full stops and spaces at either end."""
    return F.btrim(c, F.lit(":[]()' ."))


def options(text: Column) -> Column:
    """The entries of the last bracketed list; without quotes in it they part at comma and space, else between quotes."""
    last = let(F.regexp_extract_all(text, F.lit(r"\[([^\]]+)\]"), F.lit(1)), lambda g: F.when(F.size(g) > 0, F.element_at(g, -1)))
    return let(last, parted)


def parted(one: Column) -> Column:
    """The entries of what stood between brackets; none for null."""
    quoted = F.transform(F.split(one, "', '"), lambda x: F.btrim(squish(x), F.lit("'")))
    return F.coalesce(F.when(F.contains(one, F.lit("'")), quoted).otherwise(F.split(one, ", ")), F.array().cast("array<string>"))


def single(cleaned: Column) -> Column:
    """Whether an answer names one option."""
    return ~F.contains(cleaned, F.lit("', '"))


def selector(raw: Column) -> Column:
    """What stands before the first semicolon."""
    return F.element_at(F.split(raw, ";", 2), 1)


def is_sequence(raw: Column) -> Column:
    return F.startswith(squish(selector(raw)), F.lit("["))


def prompt(raw: Column, country: Column) -> Column:
    kind = F.when(is_sequence(raw), "sequence").otherwise("image")
    return F.concat(F.lit("The "), kind, F.lit(" is from "), country, F.lit(". "), F.coalesce(F.try_element_at(F.split(raw, ";", 2), F.lit(2)), F.lit("")))


def answer_cell(answer: Column, most: int = 400) -> Column:
    """Trimmed, and cut with an ellipsis beyond ``most`` characters."""
    t = squish(answer)
    return F.when(F.char_length(t) > most, F.concat(F.substring(t, 1, most), F.lit("…"))).otherwise(t)


def cut_off(finish_reason: Column) -> Column:
    return F.lower(F.coalesce(finish_reason, F.lit(""))).isin("length", "max_tokens")


def degenerate(answer: Column) -> Column:
    """At least 64 times one character."""
    return F.coalesce((F.char_length(answer) >= 64) & (F.replace(answer, F.substring(answer, 1, 1), F.lit("")) == ""), F.lit(False))


# Misspelt parts of task names, and what reports show for them.
SPELLING = {"Bahavior": "Behavior", "Obsturction": "Obstruction"}


def humanize(name: Column) -> Column:
    out = F.replace(name, F.lit("_"), F.lit(" "))
    for wrong, right in SPELLING.items():
        out = F.replace(out, F.lit(wrong), F.lit(right))
    return out


def number_text(c: Column) -> Column:
    """A double as the shortest decimal that reads back as it: with a point, and an exponent from 1e16 up and below 1e-4."""
    java = c.cast("string")
    plain = F.regexp_replace(F.regexp_replace(java.cast("decimal(38,20)").cast("string"), r"0+$", ""), r"\.$", ".0")
    digits = F.regexp_replace(F.regexp_extract(java, r"^(.*)E", 1), r"\.0$", "")
    power = F.regexp_extract(java, r"E(-?\d+)$", 1).cast("int")
    exponent = F.concat(digits, F.when(power < 0, "e-").otherwise("e+"), F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
    far = (F.abs(c) >= 1e16) | ((F.abs(c) < 1e-4) & (c != 0))
    return F.when(F.isnan(c), "nan").when(F.abs(c) == float("inf"), F.when(c > 0, "inf").otherwise("-inf")).when(far, exponent).when(F.contains(java, F.lit("E")), plain).otherwise(java)


def answer_text(token: Column) -> Column:
    """A JSON token as the text that marks compare: strings as they are, whole numbers by their digits, others as number_text, booleans capitalised."""
    fraction = F.rlike(token, F.lit(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$")) & F.rlike(token, F.lit(r"[.eE]"))
    text = F.startswith(token, F.lit('"'))
    return (
        F.when(text, F.get_json_object(F.concat(F.lit('{"v":'), token, F.lit("}")), "$.v"))
        .when(token.isin("true", "false"), F.initcap(token))
        .when(fraction, number_text(token.try_cast("double")))
        .otherwise(token)
    )


def message_text(content: Column) -> Column:
    """The text of a chat message's content, as JSON: a string, or the text parts of a list joined; null if it has neither."""
    parts = F.from_json(content, "array<struct<type: string, text: string>>")
    joined = F.array_join(F.transform(F.filter(parts, lambda x: x["type"] == "text"), lambda x: F.coalesce(x["text"], F.lit(""))), "")
    return F.when(F.startswith(F.ltrim(content), F.lit('"')), F.get_json_object(F.concat(F.lit('{"v":'), content, F.lit("}")), "$.v")).when(F.startswith(F.ltrim(content), F.lit("[")), joined)


def two_decimals(c: Column) -> Column:
    """The nearest two decimals of the double's exact value, ties away from zero: 0.125 gives 0.13, and 1.005, which is less, 1.00.

    The fraction is split in two parts whose multiples by 200 are exact, so that the side of a tie is never rounded.
    """
    x = F.abs(c)
    f = x - F.floor(x)
    low = F.floor(f * 100)
    part = F.floor(f * float(1 << 26))
    over = f * float(1 << 26) - part
    up = (over * 200 >= ((2 * low + 1) * (1 << 26) - part * 200).cast("double")).cast("bigint")
    cents = F.floor(x).cast("bigint") * 100 + low + up
    return F.when(F.isnan(c), "NaN").otherwise(F.concat(F.when(c < 0, "-").otherwise(""), F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0")))


def rounded(c: Column, digits: int) -> Column:
    """The nearest number of that many decimals to the double's exact value (0.1234565, which is less than it looks, gives 0.123456), ties to even.

    Spark rounds the shortest text of a double instead, so it is an Arrow function.
    """

    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: round(x, digits), na_action="ignore")

    return run(c.cast("double"))


def utc_text(epoch: Column) -> Column:
    """Seconds since 1970 as ISO text in UTC, with six decimals unless they are nought: 2026-01-02T03:04:05.250000+00:00."""
    us = F.bround(epoch * 1_000_000).cast("bigint")
    shown = F.date_format(F.to_utc_timestamp(F.timestamp_micros(us), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")
    part = F.pmod(us, F.lit(1_000_000))
    return F.concat(shown, F.when(part == 0, "").otherwise(F.concat(F.lit("."), F.lpad(part.cast("string"), 6, "0"))), F.lit("+00:00"))


def day_of(iso: Column) -> Column:
    return F.substring(iso, 1, 10)


def second_of(iso: Column) -> Column:
    """Date and time to the second, as reports show it."""
    return F.concat(F.substring(iso, 1, 19), F.lit("Z"))


# How reports name what a model was sent.
VIDEO_LABEL = "Lossless 1 FPS MP4 sequences and image URLs"
FALLBACK_LABEL = "; receipted H.264 fallback above the provider body limit"
IMAGE_LABEL = "Ordered image URLs for sequences and image URLs"


def transport_label(input_transport: Column, oversize_fallback: Column) -> Column:
    video = F.concat(F.lit(VIDEO_LABEL), F.when(oversize_fallback == "none", "").otherwise(FALLBACK_LABEL))
    return F.when(input_transport == "video_mp4", video).otherwise(IMAGE_LABEL)


def frame_url(base: str, folder: Column, name: Column) -> Column:
    """base/folder/name with everything percent-encoded but letters, digits, ``_.-~`` and slashes."""
    part = lambda c: F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
    return F.concat_ws("/", F.lit(base), part(folder), part(name))


def money(c: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(c, 2))


def percent(c: Column) -> Column:
    return F.concat(F.format_number(c, 2), F.lit("%"))


def seconds(c: Column) -> Column:
    return F.concat(F.format_number(c, 1), F.lit(" s"))
