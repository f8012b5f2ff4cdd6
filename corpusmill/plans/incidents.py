"""Queries on incidents: events whose messages and contexts are made of their values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import incidents
from corpusmill.plans.registry import Tables, query
from corpusmill.streaming import stateful

_SAID = [
    ("No such table: users_{}", "db", "d1", "D1_NO_SUCH_TABLE", "users_{}"), ("D1_ERROR: no such column: c{} at offset 5", "db", "d1", "D1_NO_SUCH_COLUMN", "c{}"), ("RPC exception {}", "workflow", "workflows", "WORKFLOW_RPC_EXCEPTION", None),
    ("internal error; reference id: r-{}", "workflow", "workflows", "WORKER_INTERNAL_ERROR_REFERENCE", "r-{}"), ("Internal error without one {}", "unknown", "worker", "UNKNOWN", None), ("GATEWAY_TIMEOUT {}", "ai", "mistral", "AI_GATEWAY_TIMEOUT", None),
    ("Mistral fail: doc{} status 500", "ai", "mistral", "AI_ENRICHMENT_FAILED", "doc{}"), ("status=429 for {}", "network", "http", "HTTP_429_RATE_LIMIT", None), ("fetch failed: 503 then status 404 {}", "network", "http", "HTTP_5XX", None), ("CGR status 404 {}", "network", "http", "HTTP_4XX_CLIENT_ERROR", None),
    ("status 302 getaddrinfo {}", "network", "http", "NETWORK_DNS_LOOKUP_FAILED", None), ("socket hang up {}", "network", "http", "NETWORK_FETCH_FAILED", None), ("Sin JSON en KV {}", "kv", "kv", "KV_MISSING_VALUE", None),
]


def _message(t: Tables) -> DataFrame:
    id_ = F.col("user_id").cast("string")
    text = F.element_at(F.array(*[F.replace(F.lit(s[0]), F.lit("{}"), id_) for s in _SAID]), (F.col("event_id") % len(_SAID) + 1).cast("int"))
    return t.events.select("event_id", text.alias("message"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("workflow"), F.when(F.col("value") > 80, "https://x").alias("base_url"))


_CASE = lambda i, text=lambda s: f"'{s}'": "CASE event_id % 13 " + " ".join(f"WHEN {n} THEN {'NULL' if s[i] is None else text(s[i])}" for n, s in enumerate(_SAID)) + " END"
_NAMED = lambda s: "replace('" + s + "', '{}', CAST(user_id AS VARCHAR))"


@query("q_incident_kinds", "Q17 F22", f"""
    WITH x AS (SELECT event_id, user_id, CASE WHEN event_type <> 'view' THEN event_type END AS workflow, event_id % 13 = 3 AND value > 80 AS dns, {_CASE(1)} AS kind, {_CASE(2)} AS system, {_CASE(3)} AS code, {_CASE(4, _NAMED)} AS named FROM events),
    y AS (SELECT event_id, CASE WHEN dns THEN 'network' ELSE kind END AS kind, CASE WHEN dns THEN 'http' ELSE system END AS system, CASE WHEN dns THEN 'NETWORK_DNS_LOOKUP_FAILED' ELSE code END AS code, named, workflow, event_id % 13 AS m FROM x),
    b AS (SELECT *, concat_ws('|', code, system, 'api', coalesce(workflow, 'none'), CASE WHEN m = 0 THEN named ELSE '' END, CASE WHEN m = 1 THEN named ELSE '' END) AS base FROM y)
    SELECT event_id, kind, system, code, named, format('{{:08x}}', list_reduce(list_concat([CAST(2166136261 AS BIGINT)], list_transform(string_split(base, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, x: (xor(h, x) * 16777619) & 4294967295)) AS fingerprint FROM b""")
def kinds(t: Tables) -> DataFrame:
    out = incidents.normalised(_message(t), "message", F.lit("api"), F.col("workflow"), base_url=F.col("base_url"))
    return out.select("event_id", "kind", "system", "code", "named", "fingerprint")


@query("q_sanitized", "F21", """
    SELECT event_id, '{"user":' || user_id || ',"auth":{"X_API_KEY":"[REDACTED]","list":[[{"passwordOld":"[REDACTED]"},"' || CASE WHEN event_type = 'click' THEN '[REDACTED] ok' ELSE event_type || ' ok' END || '",{"note":"a [REDACTED]; b"}],"sk-short"]},"e mail":"none","EMail":"[REDACTED]","n":[1,2.5,null,true],"é":"[REDACTED], [REDACTED]"}' AS context FROM events
    WHERE event_type <> 'error' UNION ALL SELECT event_id, 'no JSON, [REDACTED]' FROM events WHERE event_type = 'error'""")
def sanitized(t: Tables) -> DataFrame:
    """Objects in arrays in objects, with secrets under keys and inside values; and texts that are no JSON."""
    n, kind = F.col("event_id").cast("string"), F.col("event_type")
    said = F.when(kind == "click", F.concat(F.lit("Bearer abc."), n)).otherwise(kind)
    text = F.format_string(
        '{"user":%d,"auth":{"X_API_KEY":"k%s","list":[[{"passwordOld":{"deep":["%s"]}},"%s ok",{"note":"a token=%s; b"}], "sk-short"]},"e mail":"none","EMail":["%s"], "n":[1,2.5,null,true],"é":"secret: %s, pcsk_%s12345678"}',
        F.col("user_id"), n, n, said, n, n, n, n,
    )
    return t.events.select("event_id", incidents.sanitized(F.when(kind == "error", F.concat(F.lit("no JSON, password:"), n)).otherwise(text)).alias("context"))


@query("q_key_transitions", "X9", """
    WITH r AS (SELECT user_id, ts, CASE WHEN event_type = 'error' THEN 'exhausted' WHEN event_type = 'purchase' AND value > 90 THEN 'blocked' ELSE 'used' END AS kind FROM events),
    b AS (SELECT user_id, min(ts) AS blocked FROM r WHERE kind = 'blocked' GROUP BY 1),
    e AS (SELECT user_id, ts, ts + INTERVAL 1 DAY AS until, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS next, blocked FROM r LEFT JOIN b USING (user_id) WHERE kind = 'exhausted' AND (blocked IS NULL OR ts < blocked))
    SELECT user_id, ts, 'resting' AS state, until FROM e UNION ALL SELECT user_id, until, 'active', NULL FROM e WHERE until < TIMESTAMP '2024-01-31' AND (next IS NULL OR until < next) AND (blocked IS NULL OR until < blocked) UNION ALL SELECT user_id, blocked, 'blocked', NULL FROM b""")
def key_transitions(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "exhausted").when((F.col("event_type") == "purchase") & (F.col("value") > 90), "blocked").otherwise("used")
    return stateful.key_transitions(t.events, "user_id", "ts", kind, 86_400, F.lit("2024-01-31").cast("timestamp"))
