"""Text scalars: normal forms, keys, slugs, checks and redaction, as columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks that vanish beside accents: circumflex, grave, diaeresis, macron, acute, middle dot, cedilla.
MARKS = "^`\u00a8\u00af\u00b4\u00b7\u00b8"
#: White space of any script.
SPACE = "\t\n\x0b\x0c\r\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
ROUTE_MARKS, PERIOD_MARKS = "_-./", "_-./:;()[]"


def _letters() -> tuple[str, str, str]:
    """Small letters that are a plain letter with accents, those plain letters, and the accents that stand alone."""
    accented, plain = [], []
    for code in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)):
        c = chr(code)
        bare = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if bare != c and len(bare) == 1 and c == c.lower():
            accented.append(c)
            plain.append(bare.lower())
    return "".join(accented), "".join(plain), "".join(chr(code) for code in (*range(0x300, 0x370), *range(0x1DC4, 0x1DD0)))


ACCENTED, PLAIN, COMBINING = _letters()


def quoted(value: str) -> str:
    """A SQL literal of the text as it stands, backslashes included."""
    return "r'" + value + "'" if "'" not in value else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def one_spaced(sql: str) -> str:
    return f"trim(regexp_replace({sql}, ' {{2,}}', ' '))"


def normal_sql(col: str, marks: str) -> str:
    """Lower case without accents; runs of `marks` and of white space become one space. Null gives null.

    One pass maps letters, marks and white space; what has no counterpart there vanishes.
    """
    return one_spaced(f"translate(lower({col}), {quoted(ACCENTED + marks + SPACE + MARKS + COMBINING)}, {quoted(PLAIN + ' ' * len(marks + SPACE))})")


def period_of_route(col: str) -> str:
    """The period's normal form of a text that has the route's already: fewer marks are left."""
    left = "".join(c for c in PERIOD_MARKS if c not in ROUTE_MARKS)
    return one_spaced(f"translate({col}, {quoted(left)}, {quoted(' ' * len(left))})")


def normal_route(col: str) -> str:
    return normal_sql(col, ROUTE_MARKS)


def normal_period(col: str) -> str:
    return normal_sql(col, PERIOD_MARKS)


def normal_folder(col: str) -> str:
    return normal_sql(col, ROUTE_MARKS)


def settled(sql: str, body: str, name: str = "t") -> str:
    """`body` over the value of `sql`, computed once and called `name` there."""
    return f"element_at(transform(array({sql}), {name} -> {body}), 1)"


def section_tokens(text: Column) -> Column:
    """Tokens of a section: longer than two letters, not all digits."""
    return F.filter(F.split(text, " "), lambda t: (F.length(t) > 2) & ~t.rlike("^[0-9]+$"))


def learning_tokens(text: Column, stop: list[str]) -> Column:
    """Tokens for learning: longer than two letters, not one to three digits, no stop word."""
    return F.filter(F.split(text, " "), lambda t: (F.length(t) > 2) & ~t.rlike("^[0-9]{1,3}$") & ~t.isin(stop))


def file_tokens(name: Column) -> Column:
    """The first eight tokens of a file name without its extension; accents are kept apart."""
    base = F.regexp_replace(F.lower(name), r"\.[^.]+$", "")
    return F.slice(F.filter(F.split(base, "[^a-z0-9]+"), lambda t: F.length(t) > 2), 1, 8)


def slug(text: Column) -> Column:
    """Lower case, runs of other characters as dashes; empty gives null."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(""))


def safe_segment(text: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(text, "[^a-zA-Z0-9._-]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("item"))


def employee_key(file_name: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(file_name, r"(?i)\.pdf$", ""), "[^A-Za-z0-9_-]", "_"), 1, 40)


def is_tax_number(text: Column) -> Column:
    return text.rlike("^[0-9]{9}$")


def is_hash(text: Column) -> Column:
    return text.rlike("^[a-f0-9]{64}$")


def folder_prefix(name: Column, least: int = 2) -> Column:
    """The folder number that a file name starts with, from `least` to 13."""
    number = F.nullif(F.regexp_extract(name, r"^([0-9]{1,2})[_\-\s]", 1), F.lit("")).cast("int")
    return F.when(number.between(least, 13), number)


def employee_name(file_name: Column) -> Column:
    """A person's name from a payslip's file name; the file name itself where nothing is left."""
    name = F.regexp_replace(file_name, r"(?i)\.pdf$", "")
    for pattern in (r"^[0-9]{1,2}[_\-\s]+(?:[A-Z]{2}[_\-\s]+)?", r"[_\-\s]+[0-9]{4}[_\-][0-9]{2}$", r"(?i)_TESTE$"):
        name = F.regexp_replace(name, pattern, "")
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(name, "_+", " ")), F.lit("")), file_name)


def month_key(year: Column, month: Column, dash: bool = False) -> Column:
    return F.format_string("%04d-%02d" if dash else "%04d%02d", year, month)


# Short month names of display codes.
MONTHS = ("JAN", "FEV", "MAR", "ABR", "MAI", "JUN", "JUL", "AGO", "SET", "OUT", "NOV", "DEZ")


def display_code(company: Column, folder: Column, month: Column, index: Column) -> Column:
    """COMPANY-Fnn-MON-nn; a null month is UNK, others are held to 1 to 12."""
    key = F.substring(F.upper(F.regexp_replace(company, "[^A-Za-z0-9]", "")), 1, 8)
    name = F.when(month.isNull(), F.lit("UNK")).otherwise(F.element_at(F.array(*map(F.lit, MONTHS)), F.greatest(F.lit(1), F.least(F.lit(12), month))))
    return F.format_string("%s-F%02d-%s-%02d", key, folder, name, index)


# Words that are no tokens of a header.
HEADER_STOP = ("para", "com", "por", "dos", "das", "uma", "sem", "mes", "ano", "pagina", "total", "valor")


def top_tokens(text: Column, top: int = 45) -> Column:
    """The most frequent tokens of a text in normal form: three letters or more, no stop word, no number; ties first seen."""
    words = F.filter(F.split(text, " "), lambda t: (F.length(t) > 2) & ~t.isin(*HEADER_STOP) & ~t.rlike("^[0-9]+$"))
    counted = F.transform(F.array_distinct(words), lambda t, i: F.struct((-F.size(F.filter(words, lambda w: w == t))).alias("n"), i.alias("i"), t.alias("t")))
    return F.slice(F.transform(F.array_sort(counted), lambda x: x["t"]), 1, top)


def bundle_name(keys: Column) -> Column:
    """The name of a bundle over sorted month keys: one month, or the first to the last."""
    return F.when(F.size(keys) == 1, F.concat(F.lit("base_"), keys[0])).when(F.size(keys) > 1, F.concat(F.lit("base_"), keys[0], F.lit("_to_"), F.element_at(keys, -1)))


def file_status(upload: Column, has_item: Column, confidence: Column, month: Column) -> Column:
    """What a file's card says, from its upload's status and the item it became."""
    return F.when(month.isNotNull(), "Month detected").when(has_item & (confidence < 0.7), "Needs review").when(has_item, "Grouped").when(upload == "processing", "Processing pending").when(upload == "ready", "Ready").otherwise("Submitted")


def redacted(text: Column) -> Column:
    """Bank and tax numbers hidden, white space collapsed, 4000 characters."""
    hidden = F.regexp_replace(F.regexp_replace(text, r"(?i)PT50[ 0-9]{21,}", "[IBAN]"), "[0-9]{9}", "[NIF]")
    return F.substring(F.trim(F.regexp_replace(hidden, r"\s+", " ")), 1, 4000)


def loose_boolean(text: Column) -> Column:
    word = F.lower(F.trim(text))
    return F.when(word.isin("true", "yes", "sim"), True).when(word.isin("false", "no", "não", "nao"), False)


def redacted_parts(parts: Column) -> Column:
    """Redacted texts of an array, joined by semicolons."""
    return redacted(F.array_join(parts, "; "))


def redacted_fields(fields: Column) -> Column:
    """Keys and values of a map as one redacted text, in the order of keys."""
    pairs = F.array_sort(F.map_entries(fields))
    return redacted(F.array_join(F.transform(pairs, lambda p: F.concat_ws(": ", p["key"], p["value"])), "; "))


def clean_hints(hints: Column, most: int = 12) -> Column:
    """Hints redacted one by one, without empty ones, at most `most`."""
    return F.slice(F.filter(F.transform(hints, redacted), lambda h: h != ""), 1, most)


def loose_boolean_of(parts: Column) -> Column:
    """The first element that says yes or no."""
    return F.get(F.filter(F.transform(parts, loose_boolean), lambda b: b.isNotNull()), F.lit(0))


def media_type(kind: Column, name: Column) -> Column:
    low = F.lower(name)
    by_name = F.when(low.endswith(".pdf"), "application/pdf").when(low.endswith(".png"), "image/png").when(low.endswith(".jpg") | low.endswith(".jpeg"), "image/jpeg").otherwise("")
    return F.coalesce(F.nullif(kind, F.lit("")), by_name)
