"""Incidents from error messages: what kind they are, a fingerprint for equal ones, and their context without secrets."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import fnv1a

# Parts of keys whose values are secret, and what secret values look like.
SECRET_KEYS = ["token", "password", "secret", "api_key", "apikey", "authorization", "rut", "dni", "email", "phone", "cookie", "set-cookie"]
SECRET_VALUES = [r"bearer\s+[a-z0-9._\-]+", r"sk-[a-z0-9]{8,}", r"pcsk_[a-z0-9_\-]{8,}", r"(?:api[_-]?key|token|password|secret)\s*[:=]\s*[^\s,;]+"]
BLANK = "[REDACTED]"

# What messages mean, in the order in which they are tried: pattern, kind, system, code, and what the pattern's group names.
RULES = [
    (r"no such table:\s*([a-zA-Z0-9_]+)", "db", "d1", "D1_NO_SUCH_TABLE", "table"),
    (r"no such column:\s*([a-zA-Z0-9_]+)", "db", "d1", "D1_NO_SUCH_COLUMN", "column"),
    (r"skill_test_error_forced", "workflow", "workflows", "WORKFLOW_TEST_ERROR", None),
    (r"rpc exception", "workflow", "workflows", "WORKFLOW_RPC_EXCEPTION", None),
    (r"internal error", "workflow", "workflows", "WORKER_INTERNAL_ERROR_REFERENCE", "reference"),
    (r"sin json en kv", "kv", "kv", "KV_MISSING_VALUE", None),
    (r"gateway_timeout", "ai", "mistral", "AI_GATEWAY_TIMEOUT", None),
    (r"mistral fail", "ai", "mistral", "AI_ENRICHMENT_FAILED", "document"),
    (r"(?:fetch failed:\s*|status\s*=\s*|status\s+)429", "network", "http", "HTTP_429_RATE_LIMIT", None),
    (r"(?:fetch failed:\s*|status\s*=\s*|status\s+)[5-9]\d\d", "network", "http", "HTTP_5XX", None),
    (r"(?:fetch failed:\s*|status\s*=\s*|status\s+)4\d\d", "network", "http", "HTTP_4XX_CLIENT_ERROR", None),
    (r"dns lookup failed|enotfound|eai_again|getaddrinfo|failed to resolve|name not resolved", "network", "http", "NETWORK_DNS_LOOKUP_FAILED", None),
    (r"fetch failed|network error|socket hang up|connect timeout", "network", "http", "NETWORK_FETCH_FAILED", None),
]
_REFERENCE, _DOCUMENT, _STATUS = r"(?i)reference(?:\s*id)?\s*[:=]\s*([a-zA-Z0-9-]+)", r"(?i)mistral fail:\s*([a-zA-Z0-9]+)", r"(?i)(?:fetch failed:\s*|status\s*=\s*|status\s+)(\d{3})"

_VALUES = [re.compile(p, re.IGNORECASE) for p in SECRET_VALUES]


def _clean(value, key: str | None = None):
    """A value of JSON without secrets, at any depth; what stands under a secret key is blanked whole."""
    if key is not None and any(s in key.lower() for s in SECRET_KEYS):
        return BLANK
    if isinstance(value, str):
        for pattern in _VALUES:
            value = pattern.sub(BLANK, value)
    elif isinstance(value, list):
        value = [_clean(v, key) for v in value]
    elif isinstance(value, dict):
        value = {k: _clean(v, k) for k, v in value.items()}
    return value


def _cleaned(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        return json.dumps(_clean(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
    except (ValueError, RecursionError):
        return _clean(text)


def sanitized(json_text: Column) -> Column:
    """JSON texts without secret values, in compact form and with their keys in order; other texts are cleaned as one value, null stays."""

    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(_cleaned)

    return F.pandas_udf(clean, "string")(json_text)


def normalised(df: DataFrame, message: str, service: Column, workflow: Column, context: str | None = None, base_url: Column | None = None) -> DataFrame:
    """``df`` with ``kind``, ``system``, ``code``, ``named`` (the table, column, reference or document meant), ``context`` and ``fingerprint``.

    The first rule counts. An internal error needs a reference; where the source's address is known it is one of the network.
    A status that is written first in a message counts, whatever numbers follow. Null messages are unknown incidents.
    """
    m = F.coalesce(F.col(message), F.lit(""))
    known = F.lit(False) if base_url is None else base_url.isNotNull()
    part = lambda pattern: F.nullif(F.regexp_extract(m, pattern, 1), F.lit(""))
    status = part(_STATUS)
    found = []
    for pattern, kind, system, code, names in RULES:
        named = F.lit(None).cast("string") if names is None else part(_REFERENCE) if names == "reference" else part(_DOCUMENT) if names == "document" else part(f"(?i){pattern}")
        holds = m.rlike(f"(?i){pattern}")
        if code.startswith("HTTP_"):
            holds = status.rlike(pattern.rpartition(")")[2])
        told = [F.lit(kind), F.lit(system), F.lit(code)]
        if names == "reference":
            holds = holds & named.isNotNull()
            told = [F.when(known, x).otherwise(y) for x, y in zip(("network", "http", "NETWORK_DNS_LOOKUP_FAILED"), (kind, system, code))]
        found.append(F.when(holds, F.struct(*[x.alias(n) for x, n in zip(told, ("kind", "system", "code"))], named.alias("named"), F.lit(names or "").alias("of"))))
    unknown = F.struct(F.lit("unknown").alias("kind"), F.lit("worker").alias("system"), F.lit("UNKNOWN").alias("code"), F.lit(None).cast("string").alias("named"), F.lit("").alias("of"))
    out = df.withColumn("_i", F.coalesce(*found, unknown))
    at = lambda name: F.when(F.col("_i.of") == name, F.coalesce(F.col("_i.named"), F.lit(""))).otherwise("")
    fingerprint = fnv1a(F.concat_ws("|", F.col("_i.code"), F.col("_i.system"), service, F.coalesce(workflow, F.lit("none")), at("table"), at("column")))
    clean = [] if context is None else [sanitized(F.col(context)).alias("context")]
    return out.select(*[c for c in df.columns if c != context], "_i.kind", "_i.system", "_i.code", "_i.named", fingerprint.alias("fingerprint"), *clean)
