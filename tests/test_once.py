"""What is costly is evaluated once a row, wherever expressions name it."""

from pyspark.sql import functions as F

from corpusmill.operators import alignment, lines, metadata, scoring


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_alignment_folds_a_text_once(spark):
    about = F.struct(F.lit("Secret key").alias("label"), F.array(F.lit("token")).alias("terms"), F.lit(0.9).alias("confidence"))
    rows = spark.createDataFrame([("The secret key, a token",)], "body string")
    found = rows.select(alignment.alignment(F.col("body"), F.lit("the token here"), F.lit(1.0), about, about).alias("a")).select("a.score", "a.matched")
    assert plan(found).count("lower(body") == 1 and [tuple(r) for r in found.collect()] == [(1.13, 2)]


def test_signals_fold_a_text_once(spark):
    rows = spark.createDataFrame([("Se ACLARA: nuevo criterio",), (None,)], "body string")
    found = rows.select(metadata.matched_signals(F.col("body")).alias("signals"))
    assert plan(found).count("lower(body") == 1
    assert [(r.signals.operational, r.signals.clarification) for r in found.collect()] == [(["nuevo criterio"], ["aclara", "se aclara"]), ([], [])]


def test_constrained_lines_read_texts_once(spark):
    rows = spark.createDataFrame([(1, "the thing", ["en"], ["the thing and there"]), (2, "x", ["of"], ["the"]), (3, None, None, None)], "k int, title string, tags array<string>, parts array<string>")
    out = lines.constrained_lines(rows, "k", "title", "tags", "parts", ["the", "there", "thing"], ["and", "of"], True)
    # what is joined to the one row on all lines is a written table
    assert "lower(" not in plan(out) and [(r.k, r.anchors, r.strict) for r in out.collect()] == [(1, 4, True)]


def test_seeds_do_not_evaluate_scores_twice(spark):
    rows = spark.createDataFrame([(1, "core", 0.9, 0.1), (2, "other", 1.0, 1.0), (3, None, 1.0, 1.0), (4, "core", None, 1.0), (5, "core", 0.6, 0.3), (6, "core", 0.9, 0.2)], "k int, role string, centrality double, currentness double")
    out = scoring.seeds(rows.withColumn("role", F.trim("role")), ["core"], 0.6, 9, "k")
    assert [r.k for r in out.collect()] == [6, 1, 5] and plan(out).count("trim(") == 1
