"""Keys and labels of legal sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import fold, squeeze

# Fillers that stand for nothing, types that are one text, and types whose number names the text.
FILLERS = ["valor de relleno", "desconocido", "n/a", ""]
WHOLE = ["constitucion", "codigo"]
NUMBERED = ["ley", "dl", "decreto ley"]

# Short names of types of legal sources, without marks, and what they stand for.
ALIASES = {
    "ley": "Ley", "dfl": "DFL", "dl": "DL", "dto": "Decreto", "decreto": "Decreto", "ds": "Decreto Supremo", "decreto supremo": "Decreto Supremo", "res": "Resolución", "resolucion": "Resolución",
    "resolucion exenta": "Resolución Exenta", "oficio circular": "Oficio Circular", "oficio": "Oficio", "ctb": "Código del Trabajo", "ctr": "Código del Trabajo", "cci": "Código Civil", "cag": "Código de Aguas", "csa": "Código Sanitario",
    "pol": "Constitución Política de la República", "constitucion": "Constitución Política de la República", "constitucion politica": "Constitución Política de la República", "cpr": "Constitución Política de la República",
}

# Laws with names of their own, laws that say nothing without an article, the titles of laws, types whose number repeats every year.
LAW_NAMES = {"locbgae": "18575", "lbpa": "19880", "loc cgr": "10336", "ley karin": "21643"}
GENERAL_LAWS, GENERAL_DFL = ["18575", "19880", "10336"], ["29"]
LAW_TITLES = {
    "18834": "Estatuto Administrativo", "18883": "Estatuto Administrativo para Funcionarios Municipales", "18575": "Ley Orgánica Constitucional de Bases Generales de la Administración del Estado",
    "19880": "Ley de Bases de los Procedimientos Administrativos", "19886": "Ley de Compras Públicas", "10336": "Ley Orgánica de la Contraloría General de la República",
}
YEARLY = ["DFL", "Decreto", "Decreto Supremo", "Resolución", "Resolución Exenta", "Oficio Circular"]
DOTLESS = ["Ley", "DL", "DFL", "Decreto", "Decreto Supremo", "Resolución", "Resolución Exenta", "Oficio Circular"]


def _lookup(table: dict[str, str], x: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), x)


def filler(x: Column) -> Column:
    """Whether a value only fills a field."""
    return F.lower(F.trim(x)).isin([f for f in FILLERS])


def canonical_type(x: Column, aliases: dict[str, str] = ALIASES) -> Column:
    """The full name of a type."""
    return F.coalesce(_lookup(aliases, fold(squeeze(x))), squeeze(x))


def stored_source(kind: Column, number: Column, article: Column, extra: Column, year: Column) -> Column:
    """A source in the form that is stored: full type, number without dots, article and note without their prefixes, year of four digits, title."""
    full = canonical_type(kind)
    n = F.nullif(squeeze(number), F.lit(""))
    bare = F.regexp_replace(n, r"\s", "")
    n = F.when(full.isin(DOTLESS) & bare.rlike(r"^[0-9.]+$"), F.regexp_replace(bare, r"\.", "")).otherwise(n)
    art = F.nullif(F.trim(F.regexp_replace(squeeze(article), r"(?i)^art(?:[íi]culo)?\.?\s*", "")), F.lit(""))
    note = squeeze(extra)
    for pattern, word in ((r"(?i)^inc(?:iso)?/?", "inciso "), (r"(?i)^lt/?", "letra "), (r"(?i)^num/?", "número ")):
        note = F.regexp_replace(note, pattern, word)
    when = F.regexp_replace(squeeze(year), r"^(\d{4})\.0$", "$1")
    title = F.when(full == "Ley", _lookup(LAW_TITLES, n))
    return F.struct(full.alias("kind"), n.alias("number"), art.alias("article"), F.nullif(squeeze(note), F.lit("")).alias("extra"), F.nullif(when, F.lit("")).alias("year"), title.alias("title"))


def regime_key(kind: Column, number: Column, article: Column, year: Column, organ: Column) -> Column:
    """What names a source without doubt, or null.

    Constitutions never do; codes need an article, general laws too; what is numbered anew each year needs its year and
    counts the first five letters of the organ; other types need number and article.
    """
    part = lambda c: F.coalesce(F.trim(c), F.lit(""))
    n, art, y = part(number), part(article), part(year)
    low, full = fold(squeeze(kind)), canonical_type(kind)
    law = F.coalesce(_lookup(LAW_NAMES, low), F.when(full == "Ley", F.nullif(n, F.lit(""))))
    dl = full.isin("DL") | low.isin("decreto ley", "decreto-ley")
    office = F.coalesce(F.nullif(F.substring(F.regexp_replace(F.lower(squeeze(organ)), r"\.$", ""), 1, 5), F.lit("")), F.lit("unk"))
    vague = (art == "") & (law.isin(GENERAL_LAWS))
    key = (
        F.when(full.startswith("Constitución"), None)
        .when(low.startswith("codigo") | full.startswith("Código"), F.when(art != "", F.concat_ws("|", F.lit("Código"), full, art)))
        .when(law.isNotNull(), F.when(~vague, F.concat_ws("|", F.lit("Ley"), law, art)))
        .when(dl, F.when(n != "", F.concat_ws("|", F.lit("DL"), n, art)))
        .when(full.isin(YEARLY), F.when((n != "") & (y != "") & ~((full == "DFL") & n.isin(GENERAL_DFL) & (art == "")), F.concat_ws("|", full, n, y, office, art)))
        .when(full == "Ley", None)
        .otherwise(F.when((n != "") & (art != ""), F.concat_ws("|", full, n, art)))
    )
    return key


def source_cards(mentions: DataFrame, key: str, label: str, article: str, n: str, quality: str) -> DataFrame:
    """One row for each key: mentions added up, different articles in order, and the label of the best quality."""
    return mentions.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(n).alias("mentions"), F.array_sort(F.collect_set(article)).alias("articles"), F.max_by(label, F.struct(F.col(quality), F.col(label))).alias("label"))


def source_key(kind: Column, number: Column, article: Column, year: Column, sector: Column) -> Column:
    """What identifies a source: laws by type, number and article; constitutions and codes by type and article; others by all five parts.

    Empty parts are "-". A filler as type or number gives null.
    """
    part = lambda c: F.coalesce(F.nullif(F.lower(squeeze(c.cast("string"))), F.lit("")), F.lit("-"))
    name = fold(canonical_type(kind))
    plain = F.regexp_replace(part(number), r"\.", "")
    whole = name.startswith(WHOLE[0]) | name.startswith(WHOLE[1])
    numbered = name.isin(NUMBERED)
    key = F.when(whole, F.concat_ws("|", name, part(article))).when(numbered, F.concat_ws("|", name, plain, part(article))).otherwise(F.concat_ws("|", name, plain, part(article), part(year), part(sector)))
    return F.when(kind.isNull() | filler(kind) | F.coalesce(filler(number) & (F.trim(number) != ""), F.lit(False)), None).otherwise(key)


def source_label(kind: Column, number: Column, article: Column) -> Column:
    """A source as it is shown: laws with dots in their number and their title, then the article."""
    plain = F.regexp_replace(F.trim(number), r"\.", "")
    dotted = F.when(plain.rlike("^[0-9]{4,6}$"), F.regexp_replace(plain, r"(\d)(\d{3})$", "$1.$2")).otherwise(number)
    base = F.concat_ws(" ", canonical_type(kind), F.nullif(dotted, F.lit("")))
    base = F.concat_ws(", ", base, F.when(canonical_type(kind) == "Ley", _lookup(LAW_TITLES, plain)))
    return F.when(article.isNotNull() & (F.trim(article) != ""), F.concat(base, F.lit(", art. "), F.trim(article))).otherwise(base)


def document_id(number: Column, year: Column, *others: Column) -> Column:
    """A document's id: the number, N, and the last two digits of the year; without these the first of the others, else unknown."""
    own = F.concat(number.cast("string"), F.lit("N"), F.lpad((year % 100).cast("string"), 2, "0"))
    return F.coalesce(own, *others, F.lit("unknown"))
