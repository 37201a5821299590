"""Protocol specifications: small JSON documents whose every value is checked before anything is asked or scored."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What a specification may say.
TRANSPORTS = ("ordered_image_urls", "video_mp4")
PARAMETERS = ("openrouter_reasoning", "reasoning_effort")
EFFORTS = ("none", "minimal", "low", "medium", "high", "xhigh")
FALLBACKS = ("none", "h264_crf18")
FIELDS = (
    "backend_reproducibility", "credential", "endpoint", "id", "input_transport", "model", "oversize_fallback", "provider", "reasoning_effort", "reasoning_parameter", "single_frame_policy", "video_options",
)


def model_problems(model: dict) -> list[str]:
    """What is wrong with one model's entry."""
    if set(model) != set(FIELDS):
        return [f"missing {sorted(set(FIELDS) - set(model))}, unknown {sorted(set(model) - set(FIELDS))}"]
    video = model["input_transport"] == "video_mp4"
    said = {
        "reasoning_effort": model["reasoning_effort"] in EFFORTS,
        "reasoning_parameter": model["reasoning_parameter"] in PARAMETERS,
        "input_transport": model["input_transport"] in TRANSPORTS,
        "credential": isinstance(model["credential"], dict) and model["credential"].get("type") == "environment",
        "video_options": set(model["video_options"] or ()) <= {"content_part", "payload"} and (video or not model["video_options"]),
        "single_frame_policy": model["single_frame_policy"] == ("as_is" if video else "not_applicable"),
        "oversize_fallback": model["oversize_fallback"] in (FALLBACKS if video else ("not_applicable",)),
    }
    return [f"bad {name}" for name, good in said.items() if not good]


def protocol_spec(text: str, revision: str) -> dict:
    """The specification with the hash of its text; raises with all that is wrong with it."""
    spec = json.loads(text)
    protocol, models = spec.get("protocol") or {}, spec.get("models") or []
    most = protocol.get("max_tokens")
    said = {
        "schema_version": spec.get("schema_version") == 2,
        "dataset_revision": spec.get("dataset_revision") == revision,
        "tasks": spec.get("tasks") == "all",
        "temperature": "temperature" in protocol and protocol["temperature"] is None,
        "prompt": protocol.get("prompt") == "original",
        "coordinate_convention": protocol.get("coordinate_convention") == "native_pixels",
        "max_tokens": type(most) is int and most > 0,
        "models": bool(models) and len({m.get("id") for m in models}) == len(models),
    }
    wrong = [f"bad {name}" for name, good in said.items() if not good] + [f"{m.get('id', '?')}: {p}" for m in models for p in model_problems(m)]
    if wrong:
        raise ValueError("; ".join(wrong))
    return spec | {"sha256": hashlib.sha256(text.encode()).hexdigest()}


def spec_errors(texts: Column, revision: str) -> Column:
    """What is wrong with each specification; null if nothing.  Null texts and texts that are no JSON object are errors too."""

    def of(text: str | None) -> str | None:
        try:
            protocol_spec(text or "", revision)
        except ValueError as e:
            return str(e)
        except (AttributeError, TypeError, KeyError):
            return "not a specification"
        return None

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(of, na_action=None)

    return run(texts)
