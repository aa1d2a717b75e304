"""Redaction of recorded evidence and checks of recorded observations, as column expressions."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions.scalar import let
from quarrylight.session import workers_find_us

#: fixed values: names of sensitive fields; prefixes of tokens
SENSITIVE_KEYS = [
    "authorization", "proxy-authorization", "cookie", "set-cookie", "x-api-key", "api-key", "apikey", "password", "passwd", "secret", "token", "access_token",
    "refresh_token", "session", "sessionid", "email", "phone", "telephone", "ssn", "social_security", "date_of_birth", "dob",
]
TOKEN_PREFIXES = ["ghp_", "github_pat_", "sk-"]
WITHHELD = "<redacted>"


def is_sensitive_name(name: Column) -> Column:
    """Holds a sensitive key, whatever the case and - or _ between its words."""
    return F.translate(F.lower(name), "-_", "").rlike("|".join(sorted({k.replace("-", "").replace("_", "") for k in SENSITIVE_KEYS})))


def holds_sensitive_text(text: Column) -> Column:
    """Sensitive key with a value, a bearer or provider token, or a JSON web token."""
    keys = "|".join(SENSITIVE_KEYS)
    tokens = "|".join(TOKEN_PREFIXES)
    return text.rlike(rf"(?i)(?:{keys})\"?\s*[=:]\s*\S|bearer \S|(?:{tokens})\S") | text.rlike(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")


def cut(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def redact_headers(headers: Column) -> Column:
    return F.transform_values(headers, lambda k, v: F.when(is_sensitive_name(k), WITHHELD).otherwise(cut(v, 512)))


def redact_text(text: Column) -> Column:
    """Values of sensitive keys up to the next separator, bearer and provider tokens and JSON web tokens of a text that is no JSON."""
    out = cut(text, 1024)
    for key in SENSITIVE_KEYS:
        out = F.regexp_replace(out, rf"(?i)({key}\s*[=:]\s*)[^&,;\n\r]*", "$1" + WITHHELD)
    out = F.regexp_replace(out, r"(?i)(bearer )[^\s\"'<>,;&)\]]*", "$1" + WITHHELD)
    for prefix in TOKEN_PREFIXES:
        out = F.regexp_replace(out, rf"(?i){prefix}[^\s\"'<>,;&)\]]*", WITHHELD)
    return F.regexp_replace(out, r"(?<![A-Za-z0-9_.-])(?=[A-Za-z0-9_.-]{32})eyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*(?![A-Za-z0-9_.-])", WITHHELD)


_SENSITIVE = re.compile("|".join(sorted({k.replace("-", "").replace("_", "") for k in SENSITIVE_KEYS})))
#: nested values beyond this depth make a text no JSON
JSON_DEPTH = 128


def withhold(value, depth: int = 0):
    """A JSON value with what stands under a sensitive key, of whatever kind and at whatever depth, withheld."""
    if depth > JSON_DEPTH:
        raise ValueError("nested too deeply")
    if isinstance(value, dict):
        return {k: WITHHELD if _SENSITIVE.search(k.lower().replace("-", "").replace("_", "")) else withhold(v, depth + 1) for k, v in value.items()}
    return [withhold(v, depth + 1) for v in value] if isinstance(value, list) else value


def _no_constant(name: str):
    raise ValueError(name)


def _redacted(text: str | None) -> str | None:
    try:
        return None if text is None else json.dumps(withhold(json.loads(text, parse_constant=_no_constant)), separators=(",", ":"), ensure_ascii=False)
    except (ValueError, RecursionError):
        return None


def redact_json(text: Column) -> Column:
    """JSON text with sensitive values withheld, without spaces between tokens; null where the text is no JSON. Runs in Arrow batches."""
    workers_find_us(SparkSession.getActiveSession())
    return F.pandas_udf(lambda texts: texts.map(_redacted), "string")(text)


def redact_body(body: Column, secrets: list[str] = ()) -> Column:
    """A body fit to be kept: JSON by key, other text by pattern, then the secrets given; cut to 1,024 characters."""
    shown = let(F.struct(redact_json(body).alias("j"), body.alias("b")), lambda t: F.when(t["j"].isNotNull(), cut(t["j"], 1024)).otherwise(redact_text(t["b"])))
    return reduce(lambda t, s: F.replace(t, F.lit(s), F.lit(WITHHELD)), [s.strip() for s in secrets if s.strip()], shown)


def comparable(left: Column, right: Column) -> Column:
    """Recorded responses struct<status, content_type, body, truncated> that can be compared: whole, of one 2xx status and MIME type."""
    mime = lambda r: F.lower(F.trim(F.split_part(F.coalesce(r["content_type"], F.lit("")), F.lit(";"), F.lit(1))))
    return ~left["truncated"] & ~right["truncated"] & left["status"].between(200, 299) & (left["status"] == right["status"]) & (mime(left) == mime(right))


def similarity(left: Column, right: Column) -> Column:
    same = F.sha2(left["body"], 256) == F.sha2(right["body"], 256)
    return F.when(~comparable(left, right), "not_comparable").when(same, "similar").otherwise("different")


def observation_problem(action: Column, digest: Column, label: Column, confidence: Column, scores: Column) -> Column:
    """First reason why a recorded prediction can't be kept, or null; scores: array<struct<label, score>>."""
    probability = lambda x: x.isNotNull() & ~F.isnan(x) & x.between(0.0, 1.0)
    total = F.aggregate(scores, F.lit(0.0), lambda a, s: a + s["score"])
    chosen = F.filter(scores, lambda s: s["label"] == label)
    labels = F.transform(scores, lambda s: s["label"])
    return (
        F.when((action == "") | (F.octet_length(action) > 256), "action")
        .when(~digest.rlike("^[0-9a-f]{64}$"), "digest")
        .when(~probability(confidence), "confidence")
        .when((F.size(scores) == 0) | (F.size(scores) > 256), "score_count")
        .when(F.exists(labels, lambda x: x == "") | (F.size(F.array_distinct(labels)) < F.size(labels)), "labels")
        .when(F.exists(scores, lambda s: ~probability(s["score"])), "score_range")
        .when(F.abs(total - 1.0) > 0.001, "score_sum")
        .when(F.size(chosen) == 0, "label_absent")
        .when(F.abs(F.element_at(chosen, 1)["score"] - confidence) > 1e-6, "confidence_mismatch")
    )
