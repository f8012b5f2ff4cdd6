"""Queries on the coherence of lines. Customers are lines, their orders documents, types and brands of parts labels and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import coherence
from corpusmill.plans.registry import Tables, query
from corpusmill.sources.tables import checkpointed

_R2 = "floor(({x}) * 100.0e0 + 0.5e0) / 100.0e0".format
_SIGNALS = f"""
    WITH RECURSIVE m AS (SELECT o_custkey AS line, o_orderkey AS k, o_totalprice / 500000.0e0 AS score, o_orderstatus = 'F' AS related FROM orders),
    i AS (SELECT m.*, p_type, p_brand FROM m JOIN lineitem ON l_orderkey = k JOIN part ON p_partkey = l_partkey),
    l AS (SELECT c_custkey AS line, c_nationkey / 24.0e0 AS density, CASE WHEN c_nationkey % 5 = 0 THEN 'adjusts' ELSE 'develops' END AS bucket, c_mktsegment || ' ' || c_nationkey AS title FROM customer WHERE c_custkey IN (SELECT line FROM m)),
    d AS (SELECT line, max(n) FILTER (WHERE r = 1) AS a, max(n) FILTER (WHERE r = 2) AS b FROM (SELECT line, p_type, count(*) AS n, row_number() OVER (PARTITION BY line ORDER BY count(*) DESC, p_type) AS r FROM i GROUP BY 1, 2) GROUP BY 1),
    s AS (SELECT line, max(n) AS n FROM (SELECT line, p_brand, count(*) AS n FROM i GROUP BY 1, 2) GROUP BY 1),
    c AS (SELECT m.line, count(*) AS members, count(*) FILTER (WHERE related) AS related, count(*) FILTER (WHERE score < greatest(density * 0.7e0, 0.35e0)) AS outs FROM m JOIN l USING (line) GROUP BY 1),
    x AS (SELECT line, members, density, bucket, coalesce(a, 0) / members AS dominance, coalesce(b, 0) / greatest(coalesce(a, 0), 1) AS competition, coalesce(n, 0) / members AS source, related / members AS related, {_R2(x="outs / members")} AS outliers FROM c JOIN l USING (line) LEFT JOIN d USING (line) LEFT JOIN s USING (line)),
    y AS (SELECT *, {_R2(x="greatest(0.0e0, least(1.0e0, density * 0.55e0 + dominance * 0.2e0 + source * 0.15e0 + related * 0.1e0))")} AS cohesion FROM x), z AS (SELECT *, {_R2(x="1 - cohesion")} AS dispersion, {_R2(x="least(1.0e0, (1 - dominance) * 0.7e0 + competition * 0.3e0)")} AS noise FROM y),
    f AS (SELECT *, {_R2(x="least(1.0e0, dispersion * 0.45e0 + outliers * 0.3e0 + competition * 0.15e0 + CASE WHEN bucket = 'adjusts' THEN 0.1e0 ELSE 0.0e0 END)")} AS fragmentation FROM z),
    g AS (SELECT line, members, cohesion, dispersion, outliers, noise, fragmentation, CASE WHEN fragmentation >= 0.62 OR (dispersion >= 0.5 AND outliers >= 0.3) THEN 'fragmented' WHEN dispersion >= 0.34 OR noise >= 0.45 OR outliers >= 0.22 THEN 'mixed' ELSE 'cohesive' END AS status FROM f)"""


def _frames(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    members = t.orders.select(F.col("o_custkey").alias("line"), F.col("o_orderkey").alias("k"), (F.col("o_totalprice") / 500000.0).alias("score"), (F.col("o_orderstatus") == "F").cast("int").alias("relations"))
    parts = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p_partkey")).join(t.part.select("p_partkey", "p_type", "p_brand"), "p_partkey")
    # a line's signals and items count these mentions up to five times
    mentions = checkpointed(members.select("line", "k").join(parts, "k").select("line", "k", "p_type", "p_brand"))
    bucket = F.when(F.col("c_nationkey") % 5 == 0, "adjusts").otherwise("develops")
    lines = t.customer.select(F.col("c_custkey").alias("line"), (F.col("c_nationkey") / 24.0).alias("density"), bucket.alias("bucket"), F.concat_ws(" ", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("title"))
    return lines, members, mentions


def _signals(t: Tables) -> DataFrame:
    return _signalled(*_frames(t))


def _signalled(lines: DataFrame, members: DataFrame, mentions: DataFrame) -> DataFrame:
    return coherence.signals(lines, "line", members, mentions, "p_type", mentions, "p_brand")


@query("q_coherence", "C10", f"{_SIGNALS} SELECT * FROM g")
def signals(t: Tables) -> DataFrame:
    return _signals(t)


@query("q_coherence_findings", "Q12", f"""{_SIGNALS} SELECT line, CASE WHEN status = 'fragmented' THEN 'fragmentation' ELSE 'outliers' END AS finding, CASE WHEN status = 'fragmented' THEN 'high' ELSE 'medium' END AS severity, cohesion, dispersion, outliers, noise, fragmentation FROM g
    WHERE status = 'fragmented' OR (status = 'mixed' AND outliers >= 0.22)""")
def findings(t: Tables) -> DataFrame:
    return coherence.findings(_signals(t), "line")


_ITEMS = """
    item AS (SELECT DISTINCT k, p_brand AS item FROM i), tag AS (SELECT line, p_brand AS item FROM i GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY line ORDER BY count(*) DESC, p_brand) <= 5), src AS (SELECT line, p_type AS item FROM i GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY line ORDER BY count(*) DESC, p_type) <= 5),
    outs AS (SELECT m.line, m.k FROM m JOIN l USING (line) JOIN g USING (line) WHERE g.outliers >= 0.22 AND score < greatest(density * 0.7e0, 0.35e0))"""


@query("q_coherence_moves", "Q12", f"""{_SIGNALS}, {_ITEMS}
    SELECT line, k, target, shared FROM (SELECT outs.line, k, tag.line AS target, count(*) AS shared FROM outs JOIN item USING (k) JOIN tag USING (item) WHERE tag.line <> outs.line GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY line, k ORDER BY shared DESC, target) = 1""")
def moves(t: Tables) -> DataFrame:
    lines, members, mentions = _frames(t)
    found = _signalled(lines, members, mentions).where("outliers >= 0.22").select("line")
    outliers = members.join(found, "line").join(lines.select("line", "density"), "line").where(coherence.is_outlier(F.col("score"), F.col("density")))
    return coherence.reassignments(outliers, "line", "k", mentions.select("k", F.col("p_brand").alias("item")), _top(mentions, "p_brand").select("line", F.explode("tops").alias("item")))


def _top(mentions: DataFrame, column: str, n: int = 5) -> DataFrame:
    counts = mentions.groupBy("line", F.col(column).alias("item")).agg((-F.count("*")).alias("n"))
    return counts.groupBy("line").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "item"))), 1, n)["item"].alias("tops"))


@query("q_coherence_actions", "Q12 J20", f"""{_SIGNALS}, {_ITEMS},
    lt AS (SELECT line, lower(title) AS t FROM l WHERE line IN (SELECT line FROM tag)), tn AS (SELECT line, count(*) AS n FROM tag GROUP BY 1), sn AS (SELECT line, count(*) AS n FROM src GROUP BY 1),
    tp AS (SELECT x.line AS a, y.line AS b, {_R2(x="count(*) / least(max(p.n), max(q.n))")} AS o FROM lt x JOIN lt y ON x.t = y.t AND x.line < y.line JOIN tag u ON u.line = x.line JOIN tag v ON v.line = y.line AND u.item = v.item JOIN tn p ON p.line = x.line JOIN tn q ON q.line = y.line GROUP BY 1, 2),
    sp AS (SELECT x.line AS a, y.line AS b, {_R2(x="count(*) / least(max(p.n), max(q.n))")} AS o FROM lt x JOIN lt y ON x.t = y.t AND x.line < y.line JOIN src u ON u.line = x.line JOIN src v ON v.line = y.line AND u.item = v.item JOIN sn p ON p.line = x.line JOIN sn q ON q.line = y.line GROUP BY 1, 2),
    pr AS (SELECT coalesce(tp.a, sp.a) AS a, coalesce(tp.b, sp.b) AS b, coalesce(tp.o, 0.0e0) AS o, coalesce(sp.o, 0.0e0) AS s FROM tp FULL JOIN sp ON tp.a = sp.a AND tp.b = sp.b),
    near AS (SELECT DISTINCT m.line, m.k AS a, n.k AS b FROM m JOIN g USING (line) JOIN item x ON x.k = m.k JOIN item y ON y.item = x.item JOIN m n ON n.k = y.k AND n.line = m.line WHERE g.status = 'fragmented'),
    reach AS (SELECT line, k AS a, k AS b FROM m JOIN g USING (line) WHERE g.status = 'fragmented' UNION SELECT reach.line, reach.a, near.b FROM reach JOIN near ON near.line = reach.line AND near.a = reach.b), parts AS (SELECT line, count(DISTINCT c) AS parts FROM (SELECT line, a, min(b) AS c FROM reach GROUP BY 1, 2) GROUP BY 1),
    mv AS (SELECT line, count(DISTINCT k) AS n FROM (SELECT outs.line, k FROM outs JOIN item USING (k) JOIN tag USING (item) WHERE tag.line <> outs.line) GROUP BY 1),
    a AS (SELECT 'merge' AS action, a AS line, b AS other, NULL AS detail, {_R2(x="0.7e0 + o * 0.18e0 + s * 0.12e0")} AS confidence, 'high' AS impact, CASE WHEN greatest(o, s) >= 0.55 THEN 'low' ELSE 'medium' END AS risk FROM pr WHERE greatest(o, s) >= 0.4
        UNION ALL SELECT 'merge', min(line), NULL, count(*), {_R2(x="0.64e0 + least((count(*) - 2) * 0.06e0, 0.12e0)")}, 'high', 'medium' FROM lt GROUP BY t HAVING count(*) > 1
        UNION ALL SELECT 'split', line, NULL, parts, {_R2(x="0.62e0 + fragmentation * 0.25e0")}, 'high', 'high' FROM g JOIN parts USING (line)
        UNION ALL SELECT 'reassign', line, NULL, mv.n, {_R2(x="least(1.0e0, 0.5e0 + outliers * 0.6e0)")}, 'medium', 'medium' FROM g LEFT JOIN mv USING (line) WHERE outliers >= 0.22
        UNION ALL SELECT 'normalise', line, NULL, NULL, {_R2(x="least(1.0e0, 0.52e0 + noise * 0.5e0)")}, 'medium', 'low' FROM g WHERE noise >= 0.4)
    SELECT * FROM a""")
def actions(t: Tables) -> DataFrame:
    lines, members, mentions = _frames(t)
    tops = _top(mentions, "p_brand").withColumnRenamed("tops", "tags").join(_top(mentions, "p_type").withColumnRenamed("tops", "sources"), "line")
    return coherence.actions(_signalled(lines, members, mentions), lines.join(tops, "line"), "line", "k", members, mentions.select("k", F.col("p_brand").alias("item")), most=None)
