"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks and what stands for them.
MARKED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyy"


def once(x: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of ``x``, which is evaluated once a row, however often and inside whichever lambda ``use`` names it."""
    return F.transform(F.array(x), use)[0]


def fold(x: Column) -> Column:
    """Lower case without the marks of Latin letters."""
    return F.translate(F.lower(x), MARKED, PLAIN)


def squeeze(x: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def search_text(x: Column) -> Column:
    """What searches compare: folded letters and digits, single blanks."""
    return squeeze(F.regexp_replace(fold(x), r"[^a-z0-9\s]", " "))


def tokens(x: Column, least: int = 3) -> Column:
    """Different folded words of at least so many letters, in order of appearance."""
    return F.filter(F.array_distinct(F.split(fold(x), "[^a-z0-9]+")), lambda w: F.length(w) >= max(least, 1))


def tag_norm(x: Column) -> Column:
    """A tag's comparison form: lower case, no dots at the end, single blanks."""
    return squeeze(F.regexp_replace(F.lower(squeeze(x)), r"[.\s]+$", ""))


def tag_display(x: Column) -> Column:
    """A tag as it is shown: first letter upper, a dot at the end."""
    base = squeeze(F.regexp_replace(squeeze(x), r"[.\s]+$", ""))
    return F.when(base == "", "").otherwise(F.concat(F.upper(F.substring(base, 1, 1)), F.substring(base, 2, 1 << 30), F.lit(".")))


def slug(x: Column) -> Column:
    """Folded letters and digits, joined by hyphens."""
    return F.regexp_replace(F.regexp_replace(fold(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def light_normalise(x: Column, typos: dict[str, str]) -> Column:
    """Underscores and slashes as blanks, single blanks, and known misspellings put right word by word."""
    words = F.split(squeeze(F.regexp_replace(x, "[_/]+", " ")), " ")
    known = F.create_map(*[F.lit(v) for kv in typos.items() for v in kv]) if typos else None
    return F.array_join(words if known is None else F.transform(words, lambda w: F.coalesce(F.try_element_at(known, F.lower(w)), w)), " ")


def autocorrect(word: Column, vocabulary: list[str]) -> Column:
    """The first word of a fixed vocabulary within distance 1 (2 from 7 letters, 3 from 9); words with digits or under 5 letters stay."""
    low = F.lower(word)
    near = lambda v: F.levenshtein(low, F.lit(v)) <= (1 if len(v) < 7 else 2 if len(v) < 9 else 3)
    found = F.coalesce(*[F.when(near(v), F.lit(v)) for v in vocabulary])
    return F.when(word.rlike(r"\d") | (F.length(word) < 5), word).otherwise(F.coalesce(found, word))


def word_count(x: Column) -> Column:
    return F.when(squeeze(x) == "", 0).otherwise(F.size(F.split(squeeze(x), " ")))


def noisy_label(x: Column, verbs: list[str]) -> Column:
    """Labels that are empty, too long, sentences with punctuation, or begin with a verb of decision."""
    t = squeeze(x)
    return x.isNull() | (t == "") | (F.length(t) > 90) | (t.rlike("[;:,]") & (word_count(x) > 8)) | reduce(Column.__or__, [F.lower(t).startswith(v) for v in verbs], F.lit(False))


def weak(x: Column, least_chars: int, least_words: int) -> Column:
    """Whether a text is shorter than its limits in characters or words; null is weak."""
    return F.coalesce((F.length(F.trim(x)) < least_chars) | (word_count(x) < least_words), F.lit(True))


def initials(x: Column, noise: list[str]) -> Column:
    """Comma lists of initials: upper-case parts of 2 to 5 letters that aren't noise; a phrase of three words without commas is none."""
    parts = F.transform(F.split(F.coalesce(x, F.lit("")), ","), lambda p: F.trim(p))
    good = F.filter(parts, lambda p: p.rlike("^[A-ZÑ]{2,5}$") & ~p.isin(noise))
    return F.when(~F.contains(x, F.lit(",")) & (word_count(x) >= 3), F.array().cast("array<string>")).otherwise(F.array_distinct(good))


def flag(x: Column) -> Column:
    """Yes and no in their spellings as booleans, else null."""
    t = F.lower(F.trim(x.cast("string")))
    return F.when(t.isin("si", "sí", "true", "1", "yes"), True).when(t.isin("no", "false", "0"), False)


# Named references of HTML that plain text needs.
NAMED = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&copy;": "©", "&middot;": "·"}


def _referred(reference: Column) -> Column:
    """The character of a numeric reference; the reference itself where there is no such character."""
    digits = F.regexp_extract(reference, "([0-9a-fA-F]+);", 1)
    code = F.when(reference.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("long")
    there = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    return F.when(there, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(reference)


def strip_html(x: Column) -> Column:
    """Text of a piece of HTML: no scripts, styles, comments and tags; numeric and common references decoded, ampersands last."""
    out = F.regexp_replace(x, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, "(?s)<[^>]*>", " ")
    for name, char in NAMED.items():
        out = F.replace(out, F.lit(name), F.lit(char))
    numeric = F.array_distinct(F.regexp_extract_all(out, F.lit("(&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});)"), F.lit(1)))
    out = F.aggregate(numeric, out, lambda text, r: F.replace(text, r, _referred(r)))
    return squeeze(F.replace(out, F.lit("&amp;"), F.lit("&")))


def rows_of_cells(html: Column) -> Column:
    """The table rows of a piece of HTML as arrays of cell texts."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), strip_html))


def segments(x: Column, verbs: str) -> Column:
    """A text cut before each verb of a pattern; pieces without one go."""
    return F.filter(F.transform(F.split(x, rf"(?i)(?=\b(?:{verbs})\b)"), lambda p: F.trim(p)), lambda p: p.rlike(rf"(?i)^(?:{verbs})\b"))


def reference_numbers(x: Column) -> Column:
    """References like 12.345/97 as (number, year): dots and leading zeros go, years of two digits above 50 are of the last century."""
    found = F.regexp_extract_all(x, F.lit(r"(E?\d[\d.]{0,8})/(\d{4}|\d{2})(?!\d)"), F.lit(0))
    return F.transform(found, lambda r: F.struct(plain_number(F.split_part(r, F.lit("/"), F.lit(1))).alias("number"), full_year(F.split_part(r, F.lit("/"), F.lit(2))).alias("year")))


def plain_number(x: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.trim(x), r"\.", ""), "^(E?)0+(?=.)", "$1")
    return bare


def full_year(x: Column) -> Column:
    y = F.try_to_number(x, F.lit("9999")).cast("int")
    return F.when(F.length(x) == 4, y).when(y > 50, y + 1900).otherwise(y + 2000)


def preview(x: Column, n: int) -> Column:
    """The first ``n`` characters, with an ellipsis if there are more."""
    return F.when(F.length(x) > n, F.concat(F.rtrim(F.substring(x, 1, n)), F.lit("…"))).otherwise(x)


def strip_prefixes(x: Column, labels: list[str]) -> Column:
    """A text without a label like "Title:" before it."""
    return F.trim(F.regexp_replace(x, rf"(?i)^\s*(?:{'|'.join(labels)})\s*:\s*", ""))


def token_estimate(x: Column) -> Column:
    """Tokens of a text by the rule of four characters each."""
    return F.ceil(F.length(x) / 4).cast("long")


def replace_in_order(x: Column, rules: list[tuple[str, str]]) -> Column:
    """Phrase replacements one after the other, each on what the last one left."""
    return squeeze(reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rules, x))


# What gives secrets away in keys and values.
SECRET_KEYS = ["password", "passwd", "secret", "token", "api_key", "apikey", "authorization", "cookie", "session", "private_key", "access_key", "credential"]
SECRET_VALUES = [r"(?i)bearer\s+[a-z0-9._~+/-]+=*", r"\b[0-9a-f]{32,}\b", r"\bsk-[A-Za-z0-9]{16,}\b", r"\b\d{13,19}\b"]


def redact(x: Column) -> Column:
    """A text with secret values and values of secret keys blanked out."""
    out = F.regexp_replace(x, rf"(?i)\b({'|'.join(SECRET_KEYS)})(\"?\s*[:=]\s*)(\"[^\"]*\"|\S+)", "$1$2[redacted]")
    return reduce(lambda c, p: F.regexp_replace(c, p, "[redacted]"), SECRET_VALUES, out)


def redact_map(m: Column) -> Column:
    """A map of strings with the values of secret keys blanked out and others redacted."""
    return F.transform_values(m, lambda k, v: F.when(F.lower(k).isin(SECRET_KEYS), "[redacted]").otherwise(redact(v)))


def fnv1a(x: Column) -> Column:
    """The 32-bit FNV-1a hash of a text's UTF-8 bytes as 8 hex digits."""
    pairs = F.regexp_extract_all(F.hex(F.encode(x, "UTF-8")), F.lit("(..)"), F.lit(1))
    step = lambda h, p: (h.bitwiseXOR(F.conv(p, 16, 10).cast("long")) * 16777619).bitwiseAND(0xFFFFFFFF)
    return F.lower(F.lpad(F.hex(F.aggregate(pairs, F.lit(2166136261).cast("long"), step)), 8, "0"))
