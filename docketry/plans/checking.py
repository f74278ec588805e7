"""The checking engine's own way to periods and routes: tables of rules joined with documents, and ranks over scores.

It shares fixed values with the operators, but none of their expressions.
"""

from __future__ import annotations

from docketry.functions import period as P
from docketry.operators.dims import FOLDER_HINTS, FOLDER_OF, PATTERNS

SPACE = r"\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def normal(text: str, marks: str) -> str:
    return f"trim(regexp_replace(lower(translate(strip_accents({text}), '^`¨¯´·¸', '')), '[{marks}{SPACE}]+', ' ', 'g'))"


def normal_route(text: str) -> str:
    return normal(text, r"_\-./")


def normal_period(text: str) -> str:
    return normal(text, r"_\-./:;()\[\]")


MONTHS = "['jan', 'fev', 'mar', 'abr', 'mai', 'jun', 'jul', 'ago', 'set', 'out', 'nov', 'dez']"


def found(name: str, text: str, pattern: str, *parts: str) -> str:
    return f"regexp_extract({text}, '{pattern}', [{', '.join(repr(p) for p in parts)}]) AS {name}"


def value(x: str) -> str:
    return f"CAST(nullif({x}.y, '') AS INTEGER) * 100 + CAST(nullif({x}.m, '') AS INTEGER)"


def named(x: str, year: str) -> str:
    return f"CAST(nullif({year}.y, '') AS INTEGER) * 100 + list_position({MONTHS}, {x}.n[1:3])"


def fits(x: str) -> str:
    return f"CAST(nullif({x}.y, '') AS INTEGER) BETWEEN 2020 AND 2035"


def held(x: str) -> str:
    return f"WHEN {x}.y <> '' THEN CASE WHEN {fits(x)} THEN {value(x)} END"


def far(text: str, a: str, y: str, d: str) -> str:
    low = f"greatest(length({a}.before) - 35, 0)"
    near = f"substring({text}, CAST({low} + 1 AS INTEGER), CAST(length({a}.before) + 35 - {low} AS INTEGER))"
    return f"WHEN {a}.n <> '' AND {y}.y <> '' AND ({d}.y = '' OR regexp_matches({near}, '{P.NEAR_WORDS}')) THEN {named(a, y)}"


def period_tables(source: str, columns: str, text: str, into: str, whole_dates: bool = True) -> str:
    """Common tables that end with `into`: `columns` and p1, the period of `text` (in the period's normal form)."""
    seen = ", ".join(
        [
            found("pay", text, P.PAY, "m", "y"), found("ly", text, P.LABEL_YEAR, "y", "m"), found("lm", text, P.LABEL_MONTH, "m", "y"), found("nm", text, P.NAMED, "n", "y"), found("al", text, r"(?s)^(.*?)" + P.ALONE, "before", "n"), found("sy", text, P.SOME_YEAR, "y"),
            found("df", text, P.DAY_FIRST, "d", "m", "y"), found("yf", text, P.YEAR_FIRST, "y", "m"), found("ym", text, P.YEAR_MONTH, "y", "m"), found("my", text, P.MONTH_YEAR, "m", "y"), found("co", text, P.COMPACT, "y", "m"),
        ]
    )
    rules = [held("pay"), f"WHEN {fits('ly')} THEN {value('ly')}", f"WHEN {fits('lm')} THEN {value('lm')}", f"WHEN nm.y <> '' THEN {named('nm', 'nm')}", far(text, "al", "sy", "df"), *([held("df"), held("yf")] if whole_dates else []), held("ym"), held("my"), f"WHEN co.y <> '' THEN {value('co')}"]
    return f"{into}_seen AS (SELECT *, {seen} FROM {source}), {into} AS (SELECT {columns}, CASE {' '.join(rules)} END AS p1 FROM {into}_seen)"


def late_tables(source: str, columns: str, text: str, into: str) -> str:
    """Common tables that end with `into`: `columns` and period, p1 or else what the routing rules find in `text` (in the route's normal form)."""
    seen = ", ".join(
        [
            found("rl", text, P.ROUTE_LABEL, "y", "m"), found("lb", text, P.LABEL_BEHIND, "y", "m"), found("nc", text, P.NAMED_CLOSE, "n", "y"), found("al", text, r"(?s)^(.*?)" + P.ALONE, "before", "n"), found("sy", text, P.SOME_YEAR, "y"), found("df", text, P.DAY_FIRST, "d", "m", "y"),
            found("co", text, P.COMPACT, "y", "m"), found("op", text, P.OPERATION, "d", "m", "y"), found("oi", text, P.OPERATION_ISO, "y", "m"),
        ]
    )
    rules = ["WHEN p1 IS NOT NULL THEN p1", f"WHEN {fits('rl')} THEN {value('rl')}", f"WHEN {fits('lb')} THEN {value('lb')}", f"WHEN nc.y <> '' THEN {named('nc', 'nc')}", far(text, "al", "sy", "df"), f"WHEN co.y <> '' THEN {value('co')}", held("op"), held("oi")]
    return f"{into}_seen AS (SELECT *, {seen} FROM {source}), {into} AS (SELECT {columns}, CASE {' '.join(rules)} END AS period FROM {into}_seen)"


def _list(values: tuple[str, ...]) -> str:
    return "CAST([" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "] AS VARCHAR[])"


def _hits(text: str, patterns: tuple[str, ...]) -> str:
    return "CAST([" + ", ".join(f"regexp_matches({text}, '{p}')" for p in patterns) + "] AS BOOLEAN[])"


def _hint(place: int, code: str) -> str:
    n, low = FOLDER_OF[code], code.lower()
    marked = rf"regexp_matches(nt, '(pasta|folder|grupo|f)\s*0?{n}(\b|\s|_|-|\.)') OR contains(nt, '{n:02d} {low}') OR contains(nt, '{n:02d}{low}')"
    return rf"{{place: {place}, code: '{code}', number: {marked}, marker: regexp_matches(nt, '(^|\b|_|-|\.){low}(\b|\s|_|-|\.)'), terms: {_list(FOLDER_HINTS[code])}}}"


def _rule(place: int, code: str) -> str:
    strong, weak, negative = PATTERNS[code]
    parts = {"name_strong": ("nt", strong), "body_strong": ("bt", strong), "name_weak": ("nt", weak), "body_weak": ("bt", weak), "negative": ("st", negative)}
    return f"{{place: {place}, code: '{code}', " + ", ".join(f"{k}: {_hits(*v)}" for k, v in parts.items()) + "}"


HINTS = "[" + ", ".join(_hint(k, c) for k, c in enumerate(FOLDER_HINTS)) + "]"
RULES = "[" + ", ".join(_rule(k, c) for k, c in enumerate(PATTERNS)) + "]"


def route_tables(year: int, month: int, ignore_period: bool = False) -> str:
    """Common tables over doc_inputs that end with `routes` and `bucketed`."""
    d = lambda x: f"CAST({x} AS DOUBLE)"
    cost = d(0 if ignore_period else 0.18)
    asked = year * 100 + month
    return rf"""texts AS (SELECT doc_id, file_name, {normal_route("coalesce(file_name, '')")} AS nt, {normal_route("coalesce(body, '')")} AS bt FROM doc_inputs),
    both_texts AS (SELECT *, nt || ' ' || bt AS st, {normal_period("nt || ' ' || bt")} AS pt FROM texts),
    {period_tables('both_texts', 'doc_id, file_name, nt, bt, st', 'pt', 'first_periods')},
    {late_tables('first_periods', 'doc_id, file_name, nt, bt, st', 'st', 'dated')},
    signs AS (SELECT *, regexp_matches(st, 'dados da operacao|consultar saldos e movimentos a ordem') AS bank, regexp_matches(st, '(extrato|extracto).{{0,80}}(periodo|data mov|saldo contabil)|data mov.{{0,80}}data valor|saldo contabilistico') AS statement, regexp_matches(st, 'pagamento tsu|taxa social unica|seguranca social') AS tsu,
      regexp_matches(st, 'multi imposto|pagamentos ao estado|autoridade tributaria|\birs\b|referencia para pagamento') AS tax, regexp_matches(st, 'entrega de ficheiro de remuneracoes.{{0,120}}extrato de resumo|extrato de resumo.{{0,180}}total de remuneracoes') AS summary, regexp_matches(st, 'mapa de liquidacao de irs|liquidacao de irs.{{0,160}}(funcionario|valor coletavel|liquidado)') AS liquidation,
      regexp_matches(st, 'recibo[s]?.{{0,30}}(vencimento|salario|remunerac)|folha de vencimento|payslip') AS payslip FROM dated),
    hints AS (SELECT doc_id, nt, st, unnest({HINTS}, max_depth := 2) FROM signs), rules AS (SELECT doc_id, unnest({RULES}, max_depth := 2) FROM signs),
    hint_scores AS (SELECT doc_id, place, code, list_reduce(list_prepend(CASE WHEN number THEN {d(0.54)} ELSE {d(0)} END + CASE WHEN marker THEN {d(0.5)} ELSE {d(0)} END,
      list_transform(terms, lambda t: CASE WHEN contains(nt, t) THEN {d(0.22)} WHEN contains(st, t) THEN {d(0.1)} ELSE {d(0)} END)), lambda a, b: a + b) AS score FROM hints),
    hint_ranks AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score > {d(0.88)} DESC, CASE WHEN score > {d(0.88)} THEN -place ELSE -score END, place) AS nth FROM hint_scores),
    rule_scores AS (SELECT doc_id, place, code, greatest({d(0)}, least({d(0.98)}, CASE WHEN list_contains(name_strong, true) THEN {d(0.42)} ELSE {d(0)} END + CASE WHEN list_contains(body_strong, true) THEN {d(0.36)} ELSE {d(0)} END
      + least({d(0.24)}, len(list_filter(name_weak, lambda h: h)) * {d(0.08)}) + least({d(0.18)}, len(list_filter(body_weak, lambda h: h)) * {d(0.05)}) - CASE WHEN list_contains(negative, true) THEN {d(0.22)} ELSE {d(0)} END)) AS score FROM rules),
    rule_ranks AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) AS nth FROM rule_scores),
    joined AS (SELECT s.*, CASE WHEN bank AND tsu THEN 'PSS' WHEN bank AND tax THEN 'PIR' WHEN statement AND (tsu OR tax) THEN 'EBI' WHEN summary THEN 'SSR' WHEN liquidation THEN 'LIR' END AS proof, h.code AS hint, least({d(0.88)}, h.score) AS hint_score, a.code AS top, a.score AS top_score, a.score - b.score AS gap
      FROM signs s JOIN hint_ranks h ON h.doc_id = s.doc_id AND h.nth = 1 JOIN rule_ranks a ON a.doc_id = s.doc_id AND a.nth = 1 JOIN rule_ranks b ON b.doc_id = s.doc_id AND b.nth = 2),
    staged AS (SELECT *, CASE WHEN proof IS NOT NULL THEN 'proof' WHEN hint_score >= {d(0.34)} THEN 'hint' WHEN payslip THEN 'payslip' WHEN top_score >= {d(0.3)} THEN 'pattern' ELSE 'unknown' END AS stage FROM joined),
    routes AS (SELECT doc_id, file_name, stage, CASE stage WHEN 'proof' THEN proof WHEN 'hint' THEN hint WHEN 'payslip' THEN 'RV' WHEN 'pattern' THEN top ELSE 'UNKNOWN' END AS document_code,
      CASE stage WHEN 'proof' THEN CASE proof WHEN 'PSS' THEN {d(0.68)} WHEN 'PIR' THEN {d(0.64)} WHEN 'EBI' THEN {d(0.58)} ELSE {d(0.66)} END WHEN 'hint' THEN greatest({d(0.42)}, hint_score) WHEN 'payslip' THEN {d(0.64)}
        WHEN 'pattern' THEN greatest({d(0)}, least({d(0.98)}, top_score + CASE WHEN period // 100 = {year} THEN {d(0.04)} ELSE {d(0)} END + CASE WHEN period % 100 = {month} THEN {d(0.05)} ELSE {d(0)} END - CASE WHEN period <> {asked} THEN {cost} ELSE {d(0)} END - CASE WHEN gap < {d(0.12)} THEN {d(0.1)} ELSE {d(0)} END)) ELSE {d(0.35)} END AS confidence,
      CAST(period // 100 AS INTEGER) AS target_year, CAST(period % 100 AS INTEGER) AS target_month FROM staged),
    bucketed AS (SELECT *, CASE WHEN document_code <> 'UNKNOWN' AND confidence >= 0.34 THEN document_code ELSE 'OUTLIERS' END AS bucket FROM routes)"""
