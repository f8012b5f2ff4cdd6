"""Queries on document metadata. Orders are documents; expressions that both engines read make their flags and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import metadata, scoring
from corpusmill.plans.registry import Tables, query

_K = "o_orderkey"
_INPUT = {
    "recency": f"({_K} % 11) / 10.0e0", "in_total": f"{_K} % 7", "out_total": f"{_K} % 5", "in_adjusts": f"CASE WHEN {_K} % 17 = 0 THEN 2 ELSE 0 END", "in_limits": f"CASE WHEN {_K} % 13 = 0 THEN 1 ELSE 0 END",
    "in_displaces": f"CASE WHEN {_K} % 19 = 0 THEN 1 ELSE 0 END", "out_develops": f"{_K} % 4", "out_adjusts": f"CASE WHEN {_K} % 3 = 0 THEN 1 ELSE 0 END", "out_limits": f"CASE WHEN {_K} % 9 = 0 THEN 1 ELSE 0 END",
    "out_displaces": f"CASE WHEN {_K} % 8 = 0 THEN 2 ELSE 0 END", "relevant": "o_orderpriority = '1-URGENT'", "bulletin": "o_orderpriority IN ('1-URGENT', '2-HIGH')", "appeal": f"{_K} % 23 = 0", "clarified": f"{_K} % 10 = 4",
    "altered": f"{_K} % 10 = 5", "applied": "o_orderstatus = 'F'", "complemented": f"{_K} % 10 = 6", "confirmed": f"{_K} % 10 = 1", "reactivated": f"{_K} % 21 = 2", "reconsidered": f"{_K} % 6 = 3", "partly_reconsidered": f"{_K} % 10 = 7",
    "has_topic": f"{_K} % 2 = 0", "shows_topic": f"{_K} % 4 <> 1", "has_source": f"{_K} % 5 <> 0",
    "body": f"CASE {_K} % 12 WHEN 0 THEN 'Se ABSTIENE de intervenir, pues ha devenido en litigiosa' WHEN 1 THEN 'Materia litigiosa: tribunales  de justicia.' WHEN 2 THEN 'Agotada la competencia' WHEN 3 THEN 'En lo sucesivo rige un nuevo criterio; regla aplicable' WHEN 4 THEN NULL ELSE 'Criterio vigente. Se aclara' END",
}
# the folded text, and the phrases in it
_FOLDED = "trim(regexp_replace(regexp_replace(lower(coalesce(body, '')), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
_FOUND = ", ".join(f"list_filter([{', '.join(repr(p) for p in phrases)}], lambda p: contains({_FOLDED}, p)) AS s_{name}" for name, phrases in metadata.SIGNALS.items())
_ROWS = f"i AS (SELECT {_K}, {', '.join(f'{e} AS {n}' for n, e in _INPUT.items())} FROM orders), f AS (SELECT *, {_FOUND} FROM i)"


def _documents(t: Tables) -> DataFrame:
    docs = t.orders.select(_K, *[F.expr(e).alias(n) for n, e in _INPUT.items()])
    return docs.withColumn("signals", metadata.matched_signals(F.col("body")))


def _unit(x: str) -> str:
    return f"floor(greatest(0.0e0, least(1.0e0, {x})) * 1000.0e0 + 0.5e0) / 1000.0e0"


def _if(condition: str, weight: float) -> str:
    return f"CASE WHEN {condition} THEN {weight}e0 ELSE 0.0e0 END"


_SCORED = f"""{_ROWS},
    a AS (SELECT *, least(1.0e0, (in_total + out_total) / 8) AS rd, in_displaces + in_limits + in_adjusts AS ag, out_displaces + out_limits + out_adjusts AS mv, len(s_abstention) > 0 AS ab, len(s_litigious) > 0 AS li FROM f),
    b AS (SELECT *, len(s_competence) > 0 OR (ab AND NOT applied) AS cl, len(s_operational) > 0 OR confirmed OR applied AS ru FROM a),
    c AS (SELECT *, {_unit(f"recency * 0.36e0 + {_if('ru', 0.16)} + {_if('confirmed', 0.08)} + {_if('applied', 0.07)} + {_if('reactivated', 0.12)} + {_if('complemented', 0.04)} - least(0.26e0, ag * 0.09e0) - {_if('ab', 0.04)}")} AS currentness,
        {_unit(f"rd * 0.22e0 + {_if('relevant', 0.16)} + {_if('bulletin', 0.1)} + least(0.28e0, in_total * 0.07e0) + least(0.14e0, in_displaces * 0.14e0) + least(0.1e0, in_limits * 0.08e0) + (1 - recency) * 0.12e0")} AS historical,
        {_unit(f"rd * 0.25e0 + {_if('relevant', 0.18)} + {_if('bulletin', 0.09)} + {_if('has_source', 0.08)} + least(0.18e0, in_total * 0.05e0) + least(0.14e0, out_total * 0.04e0) + {_if('appeal', 0.04)}")} AS centrality,
        {_unit(f"least(0.34e0, mv * 0.12e0) + {_if('reconsidered', 0.18)} + {_if('partly_reconsidered', 0.1)} + {_if('reactivated', 0.12)} + least(0.14e0, out_develops * 0.05e0) + least(0.08e0, in_displaces * 0.08e0)")} AS shift,
        {_unit(f"{_if('NOT shows_topic', 0.2)} + {_if('NOT has_source', 0.12)} + {_if('NOT (relevant OR bulletin)', 0.08)} + {_if('ab OR li', 0.1)} + greatest(0.0e0, 0.18e0 - rd * 0.18e0)")} AS drift FROM b),
    d AS (SELECT *, {_unit("centrality * 0.48e0 + currentness * 0.22e0 + historical * 0.18e0 + (1 - drift) * 0.12e0")} AS family, currentness >= 0.58e0 AND NOT ab AND NOT li AND ag <= 1 AS supports FROM c),
    e AS (SELECT *, CASE WHEN ab THEN 'abstains' WHEN li THEN 'litigious' WHEN cl THEN 'residual' WHEN supports AND centrality >= 0.32e0 THEN 'normal' WHEN centrality >= 0.3e0 OR ag > 0 OR shift >= 0.45e0 THEN 'conditional' ELSE 'unclear' END AS intervention,
        CASE WHEN in_displaces > 0 THEN 'displaced' WHEN in_limits > 0 OR in_adjusts > 1 THEN 'partly_displaced' WHEN supports AND currentness >= 0.72e0 THEN 'in_force' WHEN supports THEN 'in_force_strained' WHEN shift >= 0.55e0 THEN 'under_review' WHEN historical >= 0.62e0 THEN 'historical' ELSE 'undetermined' END AS validity,
        CASE WHEN ab THEN 'abstention' WHEN li THEN 'litigious' WHEN cl THEN 'competence_closure' WHEN reactivated THEN 'reactivation' WHEN shift >= 0.68e0 THEN 'displacement' WHEN supports AND currentness >= 0.68e0 THEN 'current_rule' WHEN applied THEN 'application' WHEN clarified THEN 'clarification'
            WHEN complemented THEN 'complement' WHEN partly_reconsidered THEN 'clarification' WHEN altered THEN 'adjustment' WHEN centrality >= 0.64e0 THEN 'core' WHEN historical >= 0.66e0 AND currentness < 0.52e0 THEN 'milestone' ELSE 'context' END AS role,
        CASE WHEN supports AND currentness >= 0.7e0 THEN 'current_state' WHEN shift >= 0.68e0 THEN 'turning_point' WHEN historical >= 0.72e0 AND currentness < 0.48e0 THEN 'historical_anchor' WHEN centrality >= 0.6e0 THEN 'doctrinal_entry' WHEN centrality >= 0.34e0 OR applied OR clarified THEN 'semantic_entry' ELSE 'context' END AS reading_role FROM d),
    g AS (SELECT *, list_filter([CASE WHEN supports AND role <> 'current_rule' THEN 'current_rule' END, CASE WHEN centrality >= 0.58e0 AND role <> 'core' THEN 'core' END, CASE WHEN historical >= 0.62e0 AND role <> 'milestone' THEN 'milestone' END, CASE WHEN applied AND role <> 'application' THEN 'application' END,
        CASE WHEN clarified AND role <> 'clarification' THEN 'clarification' END, CASE WHEN complemented AND role <> 'complement' THEN 'complement' END, CASE WHEN role <> 'adjustment' THEN CASE WHEN partly_reconsidered THEN 'limitation' WHEN altered THEN 'adjustment' END END,
        CASE WHEN role NOT IN ('reactivation', 'displacement') THEN CASE WHEN reactivated THEN 'reactivation' WHEN shift >= 0.66e0 THEN 'displacement' END END], lambda r: r IS NOT NULL) AS secondary FROM e)"""


_ENTRY = "reading_role IN ('current_state', 'doctrinal_entry')"


@query("q_document_metadata", "C20", f"""
    WITH {_SCORED}, h AS (SELECT *, {_unit(f"rd * 0.24e0 + 0.28e0 + {_if('has_source', 0.08)} + {_if('has_topic', 0.08)} + least(0.16e0, len(secondary) * 0.04e0) + least(0.16e0, (len(s_abstention) + len(s_litigious) + len(s_operational)) * 0.04e0)")} AS confidence FROM g)
    SELECT {_K}, currentness, historical, centrality, shift, drift, family, supports, intervention, validity, role, reading_role, array_to_string(secondary, ',') AS secondary, confidence, CASE WHEN confidence < 0.58e0 THEN 'needs_review' ELSE 'ready' END AS review,
        {_unit(f"centrality * 0.34e0 + currentness * 0.26e0 + historical * 0.18e0 + shift * 0.12e0 + {_if(_ENTRY, 0.1)}")} AS reading_weight FROM h""")
def document_metadata(t: Tables) -> DataFrame:
    out = metadata.document_metadata(_documents(t)).withColumn("secondary", F.array_join("secondary_roles.role", ","))
    return out.select(_K, "currentness", "historical", "centrality", "shift", "drift", "family", "supports", "intervention", "validity", "role", "reading_role", "secondary", "confidence", "review", "reading_weight")


@query("q_metadata_seeds", "C24", f"""
    WITH {_SCORED} SELECT {_K}, role, centrality, currentness FROM g WHERE role IN ('current_rule', 'core', 'application') AND centrality >= 0.6e0 ORDER BY centrality DESC, currentness DESC, {_K} LIMIT 25""")
def metadata_seeds(t: Tables) -> DataFrame:
    found = metadata.document_metadata(_documents(t))
    return scoring.seeds(found, ["current_rule", "core", "application"], 0.6, 25, _K).select(_K, "role", "centrality", "currentness")


@query("q_signals", "C21 C23", f"""
    WITH {_ROWS}, x AS (SELECT {_K}, unnest([{", ".join(f"struct_pack(signal := '{n}', phrases := s_{n})" for n in metadata.SIGNALS)}]) AS u FROM f)
    SELECT {_K}, u.signal AS signal, len(u.phrases) AS n FROM x WHERE len(u.phrases) > 0""")
def signals(t: Tables) -> DataFrame:
    found = F.array(*[F.struct(F.lit(n).alias("signal"), F.size(F.col("signals")[n]).cast("long").alias("n")) for n in metadata.SIGNALS])
    return _documents(t).select(_K, F.explode(found).alias("u")).select(_K, "u.*").where("n > 0")


@query("q_signal_evidence", "C23", f"""
    WITH {_ROWS} SELECT {_K}, 'abstention' AS signal, unnest(s_abstention) AS phrase, 0.72e0 AS score, 0.76e0 AS confidence FROM f
    UNION ALL SELECT {_K}, 'litigious', unnest(s_litigious), 0.74e0, 0.78e0 FROM f UNION ALL SELECT {_K}, 'operational', unnest(s_operational[1:2]), 0.6e0, 0.72e0 FROM f""")
def signal_evidence(t: Tables) -> DataFrame:
    return metadata.signal_evidence(_documents(t), _K)


_STATE = f"CASE {_K} % 7 WHEN 0 THEN 'enriched' WHEN 1 THEN 'vectorizing' WHEN 2 THEN 'ingested' WHEN 3 THEN 'ingested_importante' WHEN 4 THEN 'ingested_trivial' WHEN 5 THEN 'error_quota' END"


@query("q_route_profile", "C25", f"""
    WITH d AS (SELECT {_K}, {_STATE} AS s, CAST(year(o_orderdate) + {_K} % 50 AS INT) AS y, o_orderpriority = '1-URGENT' OR o_orderstatus = 'P' AS imp FROM orders),
    r AS (SELECT {_K}, CASE WHEN s IN ('enriched', 'vectorizing') THEN 'enriched_pending_vectorization' WHEN s LIKE 'ingested%' THEN s WHEN y >= 2020 THEN 'ingested' WHEN imp THEN 'ingested_importante' ELSE 'ingested_trivial' END AS target FROM d)
    SELECT *, CASE target WHEN 'ingested' THEN 'general' WHEN 'ingested_importante' THEN 'important' WHEN 'ingested_trivial' THEN 'trivial' ELSE 'vectors_only' END AS route FROM r""")
def route_profile(t: Tables) -> DataFrame:
    year = F.year("o_orderdate") + F.col(_K) % 50
    route = metadata.processing_route(F.expr(_STATE), year, F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus") == "P")
    return t.orders.select(_K, route.alias("r")).select(_K, "r.*")
