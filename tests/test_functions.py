"""Column functions and operators on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import keys, numbers, text
from corpusmill.operators import changes, graph, joins, quality, scoring
from corpusmill.sources import tables
from corpusmill.streaming import events


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_tags(spark):
    a, b = F.lit(" Contratación Pública. "), F.lit("contratación   pública")
    r = one(spark, text.tag_norm(a), text.tag_norm(b), text.tag_display(b), text.slug(b))
    assert r[0] == r[1] and r[2] == "Contratación pública." and r[3] == "contratacion-publica"


def test_source_keys(spark):
    k = lambda kind, number=None, article=None, year=None: keys.source_key(*[F.lit(x).cast("string") for x in (kind, number, article, year, None)])
    r = one(spark, k("Ley", "18.834", "1"), k("Ley", "18.834", "2"), k("Código Civil", None, "1545"), k("Código Civil", "", "1546"), k("Decreto", "250", "10", "2004"), k("Decreto", "250", "11", "2004"), k("Ley", "valor de relleno"), k("Desconocido", "123"), k("Ley", "n/a"), k("ctb", None, "68"), k("Código del Trabajo", None, "68"))
    assert r[0] != r[1] and r[2] != r[3] and r[4] != r[5] and None not in r[:6] and r[6] is r[7] is r[8] is None and r[9] == r[10]
    assert one(spark, keys.source_label(F.lit("Ley"), F.lit("18834"), F.lit("4")))[0] == "Ley 18.834, Estatuto Administrativo, art. 4"


def test_regime_keys(spark):
    k = lambda *p: keys.regime_key(*[F.lit(x).cast("string") for x in p])
    r = one(spark, k("CPR", None, "19", None, None), k("Código Civil", None, None, None, None), k("ctb", None, "68", None, None), k("LBPA", None, None, None, None), k("LBPA", None, "3", None, None), k("Ley", "19880", None, None, None), k("Ley", "21000", None, None, None), k("Decreto", "250", None, None, None), k("Decreto", "250", None, "2004", "Ministerio."), k("DFL", "29", None, "2004", None), k("Otro", "5", "2", None, None), k("Decreto Ley", "799", "", None, None))
    assert r[:] == (None, None, "Código|Código del Trabajo|68", None, "Ley|19880|3", None, "Ley|21000|", None, "Decreto|250|2004|minis|", None, "Otro|5|2", "DL|799|")
    s = one(spark, keys.stored_source(*[F.lit(x) for x in ("ley", "18.834", "Art. 4", "inc/2", "1989.0")]))[0]
    assert tuple(s) == ("Ley", "18834", "4", "inciso 2", "1989", "Estatuto Administrativo")


def test_references(spark):
    r = one(spark, text.reference_numbers(F.lit("Aplica 007.640/97 y 12/24, E5/1999")))[0]
    assert [(x.number, x.year) for x in r] == [("7640", 1997), ("12", 2024), ("E5", 1999)]
    assert one(spark, text.segments(F.lit("Aplica dictamen 12/24, confirma 45/1999"), "aplica|confirma"))[0] == ["Aplica dictamen 12/24,", "confirma 45/1999"]
    assert [one(spark, text.full_year(F.lit(y)))[0] for y in ("97", "24", "50", "51")] == [1997, 2024, 2050, 1951]


def test_hash_and_round(spark):
    from corpusmill.operators.aggregates import half_up

    assert one(spark, text.fnv1a(F.lit("ab")))[0] == "4d2505ca"
    assert one(spark, half_up(F.lit(1.005)), half_up(F.lit(0.285)))[:] == (1.0, 0.28)


def test_small_functions(spark):
    x = lambda v: F.lit(v).cast("string")
    assert one(spark, text.flag(x("SI")), text.flag(x("0")), text.flag(x("?")), text.preview(x("abcdef"), 3), text.strip_prefixes(x("Title:  x"), ["title"]))[:] == (True, False, None, "abc…", "x")
    assert one(spark, text.initials(x("ABC, xy, DEF, ABC"), ["DEF"]), text.initials(x("one two three"), []))[:] == (["ABC"], [])
    assert one(spark, text.redact(x('password: hunter2 and {"token": "abc"}')))[0] == "password: [redacted] and {\"token\": [redacted]}"
    assert one(spark, numbers.json_payload(x("ok ```{\"a\": 1}``` bye")), numbers.json_payload(x("{broken")), numbers.json_list(x("oops")))[:] == ('{"a": 1}', None, [])
    assert one(spark, numbers.score(x("1.7")), numbers.score(x("oops")), numbers.level(F.lit(0.5)))[:] == (1.0, None, "medium")
    assert str(one(spark, numbers.next_reset(F.lit("2024-01-01 12:00:00").cast("timestamp"), "America/Santiago"))[0]) == "2024-01-02 03:00:00"
    assert one(spark, text.autocorrect(x("contratc"), ["contrato"]), text.autocorrect(x("ab1"), ["contrato"]))[:] == ("contrato", "ab1")
    assert one(spark, numbers.patched(x(None), "k", F.lit(True)), numbers.patched(x('{"k":"1"}'), "k", F.lit(2)))[:] == ('{"k":"true"}', '{"k":"2"}')


def test_effects(spark):
    for word, effect in {"aplicado": "strengthens", "confirmed": "strengthens", "complemented": "develops", "reactivated": "adjusts", "partly_reconsidered": "limits", "reconsidered": "displaces", "other": "adjusts"}.items():
        assert one(spark, graph.effect(F.lit(word)))[0] == effect


def test_fuzzy(spark):
    terms = spark.createDataFrame([("patentes de alcohol",), ("ley 20212",)], "t string")
    words = spark.createDataFrame([("patentes de alcoholes",), ("ley 20282",)], "w string")
    assert {r.term: r.match for r in joins.fuzzy_lookup(terms, "t", words, "w").collect()} == {"patentes de alcohol": "patentes de alcoholes", "ley 20212": None}


def test_incidents(spark):
    rules = [(r"no such table: (\w+)", "db", "D1"), (r"status (429)", "http", "RATE"), (r"5\d\d", "http", "5XX")]
    df = spark.createDataFrame([("no such table: foo",), ("status 429",), ("fetch failed: 503",), (None,)], "m string")
    assert [(r.code, r.named) for r in quality.incidents(df, "m", rules).collect()] == [("D1", "foo"), ("RATE", "429"), ("5XX", None), ("UNKNOWN", None)]


def test_upsert(spark):
    old = spark.createDataFrame([(1, "ok", "a"), (2, "error", "b")], "id int, state string, v string")
    new = spark.createDataFrame([(1, "new", "x"), (2, "new", None), (3, "new", "z")], "id int, state string, v string")
    out = changes.upsert(old, new, "id", skip=~F.col("state").startswith("error"))
    assert sorted(map(tuple, out.collect())) == [(1, "ok", "a"), (2, "new", "b"), (3, "new", "z")]


def test_repeats(spark):
    rows = [("k", i, f"2024-01-01 00:0{s // 60}:{s % 60:02d}") for i, s in enumerate((0, 60, 200, 260, 330))]
    df = spark.createDataFrame(rows, "k string, id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r.id for r in quality.without_repeats(df, ["k"], "ts", "id", 120).collect()) == [0, 2, 4]


def test_representatives(spark):
    pairs = spark.createDataFrame([("aaa", "aab"), ("aab", "aa"), ("x", "xy")], "a string, b string")
    got = {r.term: r.canonical for r in graph.representatives(pairs, "a", "b").collect()}
    assert got == {"aaa": "aa", "aab": "aa", "aa": "aa", "x": "x", "xy": "x"}


def test_greedy_clusters(spark):
    rows = [(x, i, [1, 2] if i < 4 else [9, i], ["f"], int(i == 7), 0.1 * i, i) for x in "lm" for i in range(8)]
    df = spark.createDataFrame(rows, "label string, id int, tags array<int>, flags array<string>, near int, align double, o int")
    got = sorted((r.label, r.seed, r.member, r.score) for r in scoring.greedy_clusters(df, "label", "id", "tags", "flags", "near", "align", "o", top=3).collect())
    # 7 takes those that share its tag, best aligned first; the rest share two tags and a flag
    got = [(x, a, b, round(s, 6)) for x, a, b, s in got]
    assert [g[1:] for g in got if g[0] == "l"] == [g[1:] for g in got if g[0] == "m"]
    assert [g[1:] for g in got if g[0] == "l" and g[1] == 7] == [(7, 5, 7.0), (7, 6, 7.4), (7, 7, 0.0)]
    assert [g[1:] for g in got if g[0] == "l" and g[1] == 3] == [(3, 1, 7.4), (3, 2, 7.8), (3, 3, 0.0)]


def test_overlap(spark):
    a = spark.createDataFrame([(1, 0, 10), (2, 100, 100)], "a_id int, start long, end long")
    b = spark.createDataFrame([(1, 10, 50), (2, 11, 99), (3, -5, 200)], "b_id int, start long, end long")
    for width in (1, 7, 1000):
        assert sorted(map(tuple, joins.overlapping_ranges(a, b, width).collect())) == [(1, 1), (1, 3), (2, 3)]


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2)], "day string, v int")
    tables.replace_partitions(df, f"{tmp_path}/t", "day")
    tables.replace_partitions(df.where("v = 2").withColumn("v", F.lit(9)), f"{tmp_path}/t", "day")
    assert sorted((r.v, str(r.day)) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [(1, "2024-01-01"), (9, "2024-01-02")]
    assert spark.read.parquet(tables.replace_table(df, f"{tmp_path}/v")).count() == 2
    tables.replace_table(df.limit(1), f"{tmp_path}/v")
    # one that broke off isn't listed
    (tmp_path / "v" / "v-99999999999999999999-x").mkdir()
    assert tables.newest_version(spark, f"{tmp_path}/v").count() == 1
    assert one(spark, tables.unwrapped(F.lit('{"source": {"a": 1}}')), tables.unwrapped(F.lit('{"b": 2}')))[:] == ('{"a":1}', '{"b": 2}')
    store = spark.createDataFrame([("1", "x"), ("doc:2", "y")], "key string, value string")
    assert sorted((r.id, r.value) for r in tables.with_fallback(spark.createDataFrame([("1",), ("2",), ("3",)], "id string"), store, "id", "value", "doc:").collect() if r.value) == [("1", "x"), ("2", "y")]


@pytest.mark.parametrize("late", [None, "1 day"])
def test_streams(spark, tmp_path, late):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", "k") for i in range(30)]
    df = spark.createDataFrame(rows, "id long, ts string, key string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = events.rates(stream, "ts", "key", "10 minutes", 5, late).writeStream.format("memory").queryName("rates").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("rates").collect())) == sorted(map(tuple, events.rates(df, "ts", "key", "10 minutes", 5).collect()))
    q = events.first_of_repeats(stream, ["key"], "ts", "2 hours").writeStream.format("memory").queryName("firsts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("firsts").count() == 1
    known = spark.createDataFrame([(1,)], "id long")
    q = events.new_rows(spark, f"{tmp_path}/in", df.schema, "id", lambda: known, lambda d: d.write.mode("append").parquet(f"{tmp_path}/out"), f"{tmp_path}/check")
    q.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 29


def test_similar_by_length(spark):
    """Pairs that differ in their first letters or stand far apart in order are found, as by comparing all."""
    base = ["norm", "decreto", "resolucion", "administracion", "constitucionalidades"]
    terms = {w for b in base for i in range(len(b)) for w in (b, b[:i] + b[i + 1 :], b[:i] + "x" + b[i:], b[:i] + "yz" + b[i + 2 :], "q" + b[:i] + b[i + 2 :])}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    want = set()
    for a in terms:
        for b in terms:
            if 4 <= len(a) <= len(b) <= len(a) + 3 and (len(a) < len(b) or a < b):
                d = distance(a, b)
                if d <= (3 if len(a) > 15 else 2 if len(a) > 8 else 1):
                    want.add((a, b, d))
    got = [tuple(r) for r in joins.similar_by_length(spark.createDataFrame([(t,) for t in sorted(terms)], "t string"), "t").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {a[:3] == b[:3] for a, b, _ in want} == {True, False}


def test_numeric_references(spark):
    rows = [("<p>a&#65;&#x42;&#8364;&#x1F600;</p>",), ("&#0; &#xD800; &amp;#65; &#9999999;",), (None,), ("",)]
    got = [r[0] for r in spark.createDataFrame(rows, "h string").select(text.strip_html(F.col("h"))).collect()]
    assert got == ["aAB€😀", "&#0; &#xD800; &#65; &#9999999;", None, ""]
