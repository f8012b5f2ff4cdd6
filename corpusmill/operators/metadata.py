"""What a document is to its doctrine: signals in its text, six scores, states, roles, and how it is processed next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import once, search_text
from corpusmill.operators.aggregates import half_up

# Phrases that tell of each signal.
SIGNALS = {
    "abstention": ["se abstiene de intervenir", "corresponde abstenerse", "no corresponde emitir pronunciamiento", "no intervendra", "se abstendra de resolver", "abstenerse de resolver"],
    "litigious": ["materia litigiosa", "ha devenido en litigiosa", "caracter litigioso", "competencia de los tribunales", "tribunales de justicia"],
    "competence": ["cierre competencial", "agotada la competencia", "sin competencia para intervenir", "fuera del ambito de competencia"],
    "operational": ["en lo sucesivo", "nuevo criterio", "criterio vigente", "se confirma el criterio", "regla aplicable", "de ahora en adelante"],
    "clarification": ["aclara", "se aclara", "precisa", "se precisa", "determina el alcance", "interpreta", "lineamientos", "criterios del proceso", "instrucciones sobre"],
    "complement": ["se complementa", "sin perjuicio de que se complementa", "complementa en los terminos", "complementa el dictamen", "agrega que", "complementario"],
    "instruction": ["imparte instrucciones", "lineamientos", "criterios", "debe", "corresponde", "instrucciones sobre"],
}
# States that go on to vectors only, and the route of each state of intake.
VECTOR_STATES = ["enriched", "enriched_pending_vectorization", "error_quota_pinecone", "vectorizing"]
ROUTES = {"ingested": "general", "ingested_importante": "important", "ingested_trivial": "trivial"}


def ladder(rules: list[tuple[Column, str]], default: str) -> Column:
    """The label of the first condition that holds; nulls hold for none."""
    return F.coalesce(*[F.when(condition, label) for condition, label in rules], F.lit(default))


def matched_signals(text: Column) -> Column:
    """A struct with an array for each signal: those of its phrases that the folded text holds (empty for a null text)."""
    found = lambda phrases, folded: F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(folded, p))
    # one text is folded once, and not for each phrase
    return once(F.coalesce(search_text(text), F.lit("")), lambda folded: F.struct(*[found(phrases, folded).alias(name) for name, phrases in SIGNALS.items()]))


def _unit(x: Column) -> Column:
    return half_up(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 3)


def _worth(condition: Column, weight: float) -> Column:
    return F.when(condition, weight).otherwise(0.0)


def document_metadata(df: DataFrame) -> DataFrame:
    """``df`` with scores (0 to 1, 3 digits), states, roles, reading order and confidence of each document.

    Columns read: ``recency`` (0 to 1); counts ``in_total``, ``out_total``, ``in_adjusts``, ``in_limits``, ``in_displaces``,
    ``out_develops``, ``out_adjusts``, ``out_limits``, ``out_displaces``; booleans ``relevant``, ``bulletin``, ``appeal``,
    ``clarified``, ``altered``, ``applied``, ``complemented``, ``confirmed``, ``reactivated``, ``reconsidered``,
    ``partly_reconsidered``, ``has_topic``, ``shows_topic``, ``has_source``; ``signals`` as ``matched_signals`` gives them.
    Nulls of counts are 0, of booleans false. One projection after another: nothing is shuffled.
    """
    c = F.col
    counts = ["in_total", "out_total", "in_adjusts", "in_limits", "in_displaces", "out_develops", "out_adjusts", "out_limits", "out_displaces"]
    flags = ["relevant", "bulletin", "appeal", "clarified", "altered", "applied", "complemented", "confirmed", "reactivated", "reconsidered", "partly_reconsidered", "has_topic", "shows_topic", "has_source"]
    out = df.withColumns({n: F.coalesce(n, F.lit(0)) for n in counts} | {n: F.coalesce(n, F.lit(False)) for n in flags} | {"recency": F.coalesce("recency", F.lit(0.0))})
    said = {name: F.size(c("signals")[name]) for name in ("abstention", "litigious", "competence", "operational")}
    out = out.withColumns({
        "_density": F.least(F.lit(1.0), (c("in_total") + c("out_total")) / 8),
        "_against": c("in_displaces") + c("in_limits") + c("in_adjusts"),
        "_moves": c("out_displaces") + c("out_limits") + c("out_adjusts"),
        "abstains": said["abstention"] > 0,
        "litigious": said["litigious"] > 0,
        "closes_competence": (said["competence"] > 0) | ((said["abstention"] > 0) & ~c("applied")),
        "sets_rule": (said["operational"] > 0) | c("confirmed") | c("applied"),
    })
    currentness = c("recency") * 0.36 + _worth(c("sets_rule"), 0.16) + _worth(c("confirmed"), 0.08) + _worth(c("applied"), 0.07) + _worth(c("reactivated"), 0.12) + _worth(c("complemented"), 0.04) - F.least(F.lit(0.26), c("_against") * 0.09) - _worth(c("abstains"), 0.04)
    historical = c("_density") * 0.22 + _worth(c("relevant"), 0.16) + _worth(c("bulletin"), 0.1) + F.least(F.lit(0.28), c("in_total") * 0.07) + F.least(F.lit(0.14), c("in_displaces") * 0.14) + F.least(F.lit(0.1), c("in_limits") * 0.08) + (1 - c("recency")) * 0.12
    centrality = c("_density") * 0.25 + _worth(c("relevant"), 0.18) + _worth(c("bulletin"), 0.09) + _worth(c("has_source"), 0.08) + F.least(F.lit(0.18), c("in_total") * 0.05) + F.least(F.lit(0.14), c("out_total") * 0.04) + _worth(c("appeal"), 0.04)
    shift = F.least(F.lit(0.34), c("_moves") * 0.12) + _worth(c("reconsidered"), 0.18) + _worth(c("partly_reconsidered"), 0.1) + _worth(c("reactivated"), 0.12) + F.least(F.lit(0.14), c("out_develops") * 0.05) + F.least(F.lit(0.08), c("in_displaces") * 0.08)
    drift = _worth(~c("shows_topic"), 0.2) + _worth(~c("has_source"), 0.12) + _worth(~c("relevant") & ~c("bulletin"), 0.08) + _worth(c("abstains") | c("litigious"), 0.1) + F.greatest(F.lit(0.0), 0.18 - c("_density") * 0.18)
    out = out.withColumns({"currentness": _unit(currentness), "historical": _unit(historical), "centrality": _unit(centrality), "shift": _unit(shift), "drift": _unit(drift)})
    out = out.withColumns({
        "family": _unit(c("centrality") * 0.48 + c("currentness") * 0.22 + c("historical") * 0.18 + (1 - c("drift")) * 0.12),
        "supports": (c("currentness") >= 0.58) & ~c("abstains") & ~c("litigious") & (c("_against") <= 1),
    })
    role = ladder([
        (c("abstains"), "abstention"), (c("litigious"), "litigious"), (c("closes_competence"), "competence_closure"), (c("reactivated"), "reactivation"), (c("shift") >= 0.68, "displacement"),
        (c("supports") & (c("currentness") >= 0.68), "current_rule"), (c("applied"), "application"), (c("clarified"), "clarification"), (c("complemented"), "complement"), (c("partly_reconsidered"), "clarification"),
        (c("altered"), "adjustment"), (c("centrality") >= 0.64, "core"), ((c("historical") >= 0.66) & (c("currentness") < 0.52), "milestone"),
    ], "context")
    out = out.withColumns({
        "intervention": ladder([(c("abstains"), "abstains"), (c("litigious"), "litigious"), (c("closes_competence"), "residual"), (c("supports") & (c("centrality") >= 0.32), "normal"), ((c("centrality") >= 0.3) | (c("_against") > 0) | (c("shift") >= 0.45), "conditional")], "unclear"),
        "validity": ladder([(c("in_displaces") > 0, "displaced"), ((c("in_limits") > 0) | (c("in_adjusts") > 1), "partly_displaced"), (c("supports") & (c("currentness") >= 0.72), "in_force"), (c("supports"), "in_force_strained"), (c("shift") >= 0.55, "under_review"), (c("historical") >= 0.62, "historical")], "undetermined"),
        "role": role,
        "reading_role": ladder([(c("supports") & (c("currentness") >= 0.7), "current_state"), (c("shift") >= 0.68, "turning_point"), ((c("historical") >= 0.72) & (c("currentness") < 0.48), "historical_anchor"), (c("centrality") >= 0.6, "doctrinal_entry"), ((c("centrality") >= 0.34) | c("applied") | c("clarified"), "semantic_entry")], "context"),
    })
    is_not = lambda *names: ~c("role").isin(*names)
    secondary = [
        (c("supports") & is_not("current_rule"), F.lit("current_rule"), c("currentness")),
        ((c("centrality") >= 0.58) & is_not("core"), F.lit("core"), c("centrality")),
        ((c("historical") >= 0.62) & is_not("milestone"), F.lit("milestone"), c("historical")),
        (c("applied") & is_not("application"), F.lit("application"), F.lit(0.68)),
        (c("clarified") & is_not("clarification"), F.lit("clarification"), F.lit(0.64)),
        (c("complemented") & is_not("complement"), F.lit("complement"), F.lit(0.62)),
        ((c("altered") | c("partly_reconsidered")) & is_not("adjustment", "limitation"), F.when(c("partly_reconsidered"), "limitation").otherwise("adjustment"), F.lit(0.66)),
        ((c("reactivated") | (c("shift") >= 0.66)) & is_not("reactivation", "displacement"), F.when(c("reactivated"), "reactivation").otherwise("displacement"), c("shift")),
    ]
    roles = F.array(*[F.when(condition, F.struct(name.alias("role"), confidence.alias("confidence"))) for condition, name, confidence in secondary])
    weight = c("centrality") * 0.34 + c("currentness") * 0.26 + c("historical") * 0.18 + c("shift") * 0.12 + _worth(c("reading_role").isin("current_state", "doctrinal_entry"), 0.1)
    out = out.withColumns({"secondary_roles": F.filter(roles, lambda r: r.isNotNull()), "reading_weight": _unit(weight)})
    told = F.least(F.lit(0.16), (said["abstention"] + said["litigious"] + said["operational"]) * 0.04)
    confidence = c("_density") * 0.24 + 0.28 + _worth(c("has_source"), 0.08) + _worth(c("has_topic"), 0.08) + F.least(F.lit(0.16), F.size("secondary_roles") * 0.04) + told
    out = out.withColumn("confidence", _unit(confidence)).withColumn("review", F.when(c("confidence") < 0.58, "needs_review").otherwise("ready"))
    return out.drop("_density", "_against", "_moves")


def signal_evidence(df: DataFrame, key: str) -> DataFrame:
    """(key, signal, phrase, score, confidence): a row for each phrase of abstention and litigation, and for the first two of a rule."""
    kinds = [("abstention", 0.72, 0.76, None), ("litigious", 0.74, 0.78, None), ("operational", 0.6, 0.72, 2)]
    rows = []
    for name, score, confidence, most in kinds:
        phrases = F.col("signals")[name] if most is None else F.slice(F.col("signals")[name], 1, most)
        rows.append(F.transform(phrases, lambda p: F.struct(F.lit(name).alias("signal"), p.alias("phrase"), F.lit(score).alias("score"), F.lit(confidence).alias("confidence"))))  # noqa: B023
    return df.select(key, F.explode(F.concat(*rows)).alias("e")).select(key, "e.*")


def processing_route(state: Column, year: Column, relevant: Column, bulletin: Column) -> Column:
    """A struct (target, route): where a document goes next by its state, else by its year (2020 on), else by its flags."""
    to = lambda target, route: F.struct(F.lit(target).alias("target"), F.lit(route).alias("route"))
    rules = [F.when(state.isin(VECTOR_STATES), to("enriched_pending_vectorization", "vectors_only"))]
    rules += [F.when(state == name, to(name, route)) for name, route in ROUTES.items()]
    rules += [F.when(year >= 2020, to("ingested", ROUTES["ingested"])), F.when(relevant | bulletin, to("ingested_importante", ROUTES["ingested_importante"]))]
    return F.coalesce(*rules, to("ingested_trivial", ROUTES["ingested_trivial"]))
