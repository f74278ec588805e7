"""Accounting periods from text: the first rule that matches decides.

A period is year * 100 + month. Kept as they are: a label with year and month cuts months 10 to 12 to
1 (`exact_months=True` corrects it), and the rules for month names and for six-digit periods do not
check the range of years. All rules want a year, so a text without one is settled by one look.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.functions.text import normal_period, normal_route, period_of_route, quoted, settled
from docketry.operators.dims import MONTH_NAMES

# Years and months as they are written.
YEAR, MONTH = "(20[2-3][0-9])", "(0?[1-9]|1[0-2])"
NAMES = "|".join(v for names in MONTH_NAMES.values() for v in names)
# Words before a month and year of pay, and labels of a period.
PAY_WORDS = r"(?:sub\s+refeicao|subsidio\s+alimentacao|subs?\s+alimentacao|refeicao|vencimento|vencimentos|salario|salarios|remuneracao|remuneracoes|ordenado|ordenados)"
LABELS = "(?:ano mes de referencia|ano mes ref|ano mes|periodo|referencia|competencia|mes)"
NEAR_WORDS = "subsidio|refeicao|cartao|vencimento|salario|ordenado|ajuda"
# Labels of the routing rules, and of the dates of an operation.
ROUTE_LABELS = "(?:ano mes de referencia|ano mes ref|ano mes|periodo|referencia)"
OPERATION_LABELS = "(?:data valor|data do movimento|data de movimento|data emissao|data de emissao)"
# Patterns of the period rules.
PAY = rf"{PAY_WORDS}\s+{MONTH}\s+{YEAR}\b"
LABEL_YEAR, LABEL_MONTH = rf"{LABELS}\s+{YEAR}\s+{MONTH}", rf"{LABELS}\s+{MONTH}\s+{YEAR}"
NAMED, NAMED_CLOSE = rf"\b({NAMES})(?:\s+de)?\s+{YEAR}\b", rf"\b({NAMES})\s+{YEAR}\b"
ALONE, SOME_YEAR = rf"\b({NAMES})\b", rf"\b{YEAR}\b"
DAY_FIRST, YEAR_FIRST = rf"\b([0-9]{{1,2}})\s+{MONTH}\s+{YEAR}\b", rf"\b{YEAR}\s+{MONTH}\s+[0-9]{{1,2}}\b"
YEAR_MONTH, MONTH_YEAR, COMPACT = rf"\b{YEAR}\s+{MONTH}\b", rf"\b{MONTH}\s+{YEAR}\b", rf"\b{YEAR}(0[1-9]|1[0-2])\b"
ROUTE_LABEL, LABEL_BEHIND = rf"{ROUTE_LABELS}\s+{YEAR}\s+{MONTH}", rf"{YEAR}\s+{MONTH}\s+(?:periodo|referencia)"
OPERATION, OPERATION_ISO = rf"{OPERATION_LABELS}\s+([0-9]{{1,2}})\s+{MONTH}\s+{YEAR}", rf"{OPERATION_LABELS}\s+{YEAR}\s+{MONTH}\s+[0-9]{{1,2}}"


def _like(t: str, pattern: str) -> str:
    return f"({t} RLIKE {quoted(pattern)})"


def _part(t: str, pattern: str, group: int) -> str:
    return f"CAST(regexp_extract({t}, {quoted(pattern)}, {group}) AS INT)"


def _value(t: str, pattern: str, year: int, month: int) -> str:
    return f"({_part(t, pattern, year)} * 100 + {_part(t, pattern, month)})"


def _in_range(t: str, pattern: str, year: int) -> str:
    return f"{_part(t, pattern, year)} BETWEEN 2020 AND 2035"


def _held(t: str, pattern: str, year: int, month: int) -> str:
    """The value if its year is in range, else null: the rule ends the search either way."""
    return f"CASE WHEN {_in_range(t, pattern, year)} THEN {_value(t, pattern, year, month)} END"


def _named(t: str, pattern: str, year_pattern: str, year: int) -> str:
    name = f"regexp_extract({t}, {quoted(pattern)}, 1)"
    number = f"CASE {name} " + " ".join(f"WHEN '{v}' THEN {n}" for n, names in MONTH_NAMES.items() for v in names) + " END"
    return f"{_part(t, year_pattern, year)} * 100 + {number}"


def _far_month(t: str) -> tuple[str, str]:
    """A month's name and a year anywhere, unless a whole date competes and no word of pay stands near the name."""
    spot = f"length(regexp_extract({t}, {quoted(rf'(?s)^(.*?){ALONE}')}, 1))"
    near = f"substring({t}, greatest({spot} - 35, 0) + 1, {spot} + 35 - greatest({spot} - 35, 0))"
    return f"{_like(t, ALONE)} AND {_like(t, SOME_YEAR)} AND (NOT {_like(t, DAY_FIRST)} OR {_like(near, NEAR_WORDS)})", _named(t, ALONE, SOME_YEAR, 1)


def _first_of(t: str, rules: list[tuple[str, str]]) -> str:
    return f"CASE WHEN {t} IS NULL OR NOT {_like(t, '20[23][0-9]')} THEN NULL " + " ".join(f"WHEN {when} THEN {then}" for when, then in rules) + " END"


def period_case(t: str, standalone_dates: bool = True, exact_months: bool = False) -> str:
    """The period in `t`, a column of text in the period's normal form."""
    year_first = LABEL_YEAR + (r"\b" if exact_months else "")
    rules = [
        (_like(t, PAY), _held(t, PAY, 2, 1)),
        (f"{_like(t, year_first)} AND {_in_range(t, year_first, 1)}", _value(t, year_first, 1, 2)),
        (f"{_like(t, LABEL_MONTH)} AND {_in_range(t, LABEL_MONTH, 2)}", _value(t, LABEL_MONTH, 2, 1)),
        (_like(t, NAMED), _named(t, NAMED, NAMED, 2)),
        _far_month(t),
    ]
    if standalone_dates:
        rules += [(_like(t, DAY_FIRST), _held(t, DAY_FIRST, 3, 2)), (_like(t, YEAR_FIRST), _held(t, YEAR_FIRST, 1, 2))]
    rules += [(_like(t, YEAR_MONTH), _held(t, YEAR_MONTH, 1, 2)), (_like(t, MONTH_YEAR), _held(t, MONTH_YEAR, 2, 1)), (_like(t, COMPACT), _value(t, COMPACT, 1, 2))]
    return _first_of(t, rules)


def late_route_case(a: str) -> str:
    """P2 after P1 has found nothing: the routing rules, over text in the route's normal form."""
    rules = [(f"{_like(a, p)} AND {_in_range(a, p, 1)}", _value(a, p, 1, 2)) for p in (ROUTE_LABEL, LABEL_BEHIND)]
    rules += [
        (_like(a, NAMED_CLOSE), _named(a, NAMED_CLOSE, NAMED_CLOSE, 2)),
        _far_month(a),
        (_like(a, COMPACT), _value(a, COMPACT, 1, 2)),
        (_like(a, OPERATION), _held(a, OPERATION, 3, 2)),
        (_like(a, OPERATION_ISO), _held(a, OPERATION_ISO, 1, 2)),
    ]
    return _first_of(a, rules)


def routing_case(a: str, b: str) -> str:
    """The period of a text whose normal forms for routes and periods are `a` and `b`."""
    return f"coalesce({period_case(b)}, {late_route_case(a)})"


def period_sql(text: str, standalone_dates: bool = True, exact_months: bool = False) -> str:
    """P1 of a raw text given as SQL."""
    return settled(normal_period(text), period_case("t", standalone_dates, exact_months))


def period(text: str, standalone_dates: bool = True, exact_months: bool = False) -> Column:
    """The period of a column of raw text."""
    return F.expr(period_sql(text, standalone_dates, exact_months))


def routing_period(text: str) -> Column:
    """The routing period of a column of raw text."""
    return F.expr(settled(normal_route(text), settled(period_of_route("a"), routing_case("a", "b"), "b"), "a"))


def first_period(texts: str) -> str:
    """P5, as SQL over an array of raw texts: the first that tells a period without whole dates, else the first with them.

    A struct of period and evidence (180 characters of the text's normal form), or null.
    """
    normal = f"transform({texts}, x -> {normal_period('x')})"
    found = lambda whole: f"filter(transform({normal}, t -> named_struct('period', {period_case('t', whole)}, 'evidence', substring(t, 1, 180))), f -> f.period IS NOT NULL)"
    return f"coalesce(get({found(False)}, 0), get({found(True)}, 0))"


# Month words of folder names, Portuguese and English.
FOLDER_MONTHS = {1: "jan", 2: "fev|feb", 3: "mar", 4: "abr|apr", 5: "mai|may", 6: "jun", 7: "jul", 8: "ago|aug", 9: "set|sep", 10: "out|oct", 11: "nov", 12: "dez|dec"}


def folder_period(name: Column, this_year: int) -> Column:
    """The period that a sub-folder's name tells: a month word or a lone number 1 to 12, and the year or `this_year`."""
    year = F.coalesce(F.nullif(F.regexp_extract(name, "(20[23][0-9])", 1), F.lit("")).cast("int"), F.lit(this_year))
    rest = F.regexp_replace(name, "20[23][0-9]", " ")
    month = F.lit(None).cast("int")
    lone = F.nullif(F.regexp_extract(rest, r"(?<![0-9])(0?[1-9]|1[0-2])(?![0-9])", 1), F.lit("")).cast("int")
    for n, words in reversed(FOLDER_MONTHS.items()):
        month = F.when(rest.rlike(rf"\b({words})[a-z]*\b"), n).otherwise(month)
    month = F.coalesce(month, lone)
    return F.when(month.isNotNull(), year * 100 + month)
