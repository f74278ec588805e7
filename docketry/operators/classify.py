"""The classification cascade: proofs, learned sections, folder hints, payslips, pattern scores.

Every stage is a row-local expression over a document's normal name and body; the rule tables are
literals, so nothing is joined and nothing shuffles. One pass looks for the rules' words in a text,
and a pattern is only tried where the words that each of its matches must hold are there; most texts
hold none and cost one look. Scores are doubles added in the order of the rules.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions.period import routing_case
from docketry.functions.text import normal_route, period_of_route, quoted, settled
from docketry.operators.dims import FOLDER_HINTS, FOLDER_OF, PATTERNS

# Patterns of the explicit proofs and of payslips.
BANK_PROOF = "dados da operacao|consultar saldos e movimentos a ordem"
STATEMENT = "(extrato|extracto).{0,80}(periodo|data mov|saldo contabil)|data mov.{0,80}data valor|saldo contabilistico"
TSU = "pagamento tsu|taxa social unica|seguranca social"
TAX = r"multi imposto|pagamentos ao estado|autoridade tributaria|\birs\b|referencia para pagamento"
SUMMARY = "entrega de ficheiro de remuneracoes.{0,120}extrato de resumo|extrato de resumo.{0,180}total de remuneracoes"
LIQUIDATION = "mapa de liquidacao de irs|liquidacao de irs.{0,160}(funcionario|valor coletavel|liquidado)"
PAYSLIP = "recibo[s]?.{0,30}(vencimento|salario|remunerac)|folha de vencimento|payslip"
# Confidences of the proofs and of a payslip.
PROOF_CONFIDENCE = {"PSS": 0.68, "PIR": 0.64, "EBI": 0.58, "SSR": 0.66, "LIR": 0.66}
PAYSLIP_CONFIDENCE = 0.64
# Markers of a folder's number and code in a file name.
NUMBER_MARKER, CODE_MARKER = r"(pasta|folder|grupo|f)\s*0?{0}(\b|\s|_|-|\.)", r"(^|\b|_|-|\.){0}(\b|\s|_|-|\.)"
# Weights and caps of folder hints and of patterns.
HINT = {"number": 0.54, "code": 0.5, "name": 0.22, "text": 0.1, "cap": 0.88, "least": 0.34, "floor": 0.42}
# floors of learned and unknown routes; what a period that fits adds, year and month alone; what one that does not costs, of marks, learned signals and other routes; a close second's cost
ROUTE = {"learned": 0.38, "unknown": 0.35, "scanned": 0.18, "fits": 0.1, "year": 0.04, "month": 0.05, "off_mark": 0.15, "off_signal": 0.25, "off": 0.18, "close": 0.12, "close_cost": 0.1, "cap": 0.98}
SCORE = {"name": 0.42, "body": 0.36, "name_weak": 0.08, "name_most": 0.24, "body_weak": 0.05, "body_most": 0.18, "example": 0.12, "negative": 0.22, "cap": 0.98, "least": 0.3}


def double(value: float) -> str:
    """A double literal; a bare decimal would be a DECIMAL."""
    return f"{value!r}D"


def alternatives(pattern: str) -> list[str]:
    """The branches of a pattern at its outermost level."""
    out, depth, at = [], 0, 0
    for k, c in enumerate(pattern):
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append(pattern[at:k])
            at = k + 1
    return [*out, pattern[at:]]


def needed_words(branch: str) -> list[str]:
    """Texts that every match of a branch holds: the leading plain run of each part between gaps."""
    out = []
    for part in re.split(r"\.\{0,\d+\}|\.\*", branch):
        found = re.match(r"(?:\\b)?([a-z0-9 ]+)", part)
        if found and "|" not in re.sub(r"\(.*\)", "", part):
            word = found[1][:-1] if part[found.end() : found.end() + 1] in ("?", "*", "{") else found[1]
            if len(word.strip()) > 2:
                out.append(word)
    return out


def is_plain(branch: str) -> bool:
    return re.fullmatch(r"[a-z0-9 ]+", branch) is not None


def has(words: str, word: str) -> str:
    return f"array_contains({words}, '{word}')"


def matches(text: str, words: str, pattern: str) -> str:
    """Whether `text` matches; `words`: the array of looked-for words that it holds."""
    tests = []
    for branch in alternatives(pattern):
        need = [has(words, w) for w in needed_words(branch)]
        tests.append(" AND ".join(need) if is_plain(branch) else " AND ".join([*need, f"({text} RLIKE {quoted(branch)})"]))
    return "(" + " OR ".join(f"({t})" for t in tests) + ")"


def _every_pattern() -> list[str]:
    return [BANK_PROOF, STATEMENT, TSU, TAX, SUMMARY, LIQUIDATION, PAYSLIP, *(p for kinds in PATTERNS.values() for kind in kinds for p in kind)]


#: All words that one pass looks for.
WORDS = sorted({w for p in _every_pattern() for b in alternatives(p) for w in needed_words(b)} | {t for terms in FOLDER_HINTS.values() for t in terms})


#: Their beginnings, of which most texts hold few.
ROOTS = sorted({w[:4] for w in WORDS})


def words_in(text: str, among: str | None = None) -> str:
    """The looked-for words that a text holds, or those of an array of them; roots are looked for first."""
    if among:
        return f"filter({among}, w -> contains({text}, w))"
    every = ", ".join(f"named_struct('root', {quoted(w[:4])}, 'word', {quoted(w)})" for w in WORDS)
    held = f"transform(filter(array({every}), x -> array_contains(roots, x.root) AND contains({text}, x.word)), x -> x.word)"
    return settled(f"filter(array({', '.join(map(quoted, ROOTS))}), r -> contains({text}, r))", held, "roots")


def first_of(rules: list[tuple[str, str]], otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {when} THEN {then}" for when, then in rules) + f" ELSE {otherwise} END"


def proof_code() -> str:
    """The code of the first explicit proof."""
    hit = lambda p: matches("both_text", "words", p)
    return first_of([(f"{hit(BANK_PROOF)} AND {hit(TSU)}", "'PSS'"), (f"{hit(BANK_PROOF)} AND {hit(TAX)}", "'PIR'"), (f"{hit(STATEMENT)} AND ({hit(TSU)} OR {hit(TAX)})", "'EBI'"), (hit(SUMMARY), "'SSR'"), (hit(LIQUIDATION), "'LIR'")])


def hint_score(code: str) -> str:
    """C4: number and code markers in the name, and terms in the name or else in the text, added in order."""
    number, low = FOLDER_OF[code], code.lower()
    marked = f"(name_text RLIKE {quoted(NUMBER_MARKER.format(number))} OR contains(name_text, '{number:02d} {low}') OR contains(name_text, '{number:02d}{low}'))"
    start = f"(CASE WHEN {marked} THEN {double(HINT['number'])} ELSE 0D END + CASE WHEN name_text RLIKE {quoted(CODE_MARKER.format(low))} THEN {double(HINT['code'])} ELSE 0D END)"
    terms = ", ".join(quoted(t) for t in FOLDER_HINTS[code])
    return f"aggregate(array({terms}), {start}, (s, t) -> s + CASE WHEN array_contains(name_words, t) THEN {double(HINT['name'])} WHEN array_contains(words, t) THEN {double(HINT['text'])} ELSE 0D END)"


def pattern_score(code: str) -> str:
    """The first strong hit in the name and in the body, weak hits, the examples' share, a negative hit."""
    strong, weak, negative = PATTERNS[code]
    any_of = lambda text, words, ps: "(" + " OR ".join(matches(text, words, p) for p in ps) + ")"
    count = lambda text, words: "(" + " + ".join(f"CAST({matches(text, words, p)} AS INT)" for p in weak) + ")"
    s = {k: double(v) for k, v in SCORE.items()}
    score = f"CASE WHEN {any_of('name_text', 'name_words', strong)} THEN {s['name']} ELSE 0D END + CASE WHEN {any_of('body_text', 'body_words', strong)} THEN {s['body']} ELSE 0D END"
    score += f" + least({s['name_most']}, {count('name_text', 'name_words')} * {s['name_weak']}) + least({s['body_most']}, {count('body_text', 'body_words')} * {s['body_weak']})"
    score += f" + least({s['example']}, coalesce(try_element_at(example_scores, '{code}'), 0D) * {s['example']})"
    if negative:
        score += f" - CASE WHEN {any_of('both_text', 'words', negative)} THEN {s['negative']} ELSE 0D END"
    return f"greatest(0D, least({s['cap']}, {score}))"


def scored(codes: list[str], score) -> str:
    """An array of (code, score); its parts are evaluated as they stand, outside of generated code."""
    return settled("0", "array(" + ", ".join(f"named_struct('code', '{c}', 'score', {score(c)})" for c in codes) + ")", "z")


def capped_best(scores: str, cap: float) -> str:
    """The best (code, score), where each raw score is held against the capped best so far.

    So if any score exceeds the cap the last such one wins, else the highest, first on ties.
    """
    none = "named_struct('code', CAST(NULL AS STRING), 'score', 0D)"
    return f"aggregate({scores}, {none}, (best, x) -> CASE WHEN x.score > best.score THEN named_struct('code', x.code, 'score', least({double(cap)}, x.score)) ELSE best END)"


#: What a document may bring along: the learned branch, periods by code (with `rated`: found often enough), examples' shares, scanned.
BROUGHT = {
    "learned_code": "string",
    "learned_score": "double",
    "learned_periods": "map<string,struct<period:int,rated:boolean>>",
    "example_scores": "map<string,double>",
    "ocr": "boolean",
}


def _texts(docs: DataFrame) -> DataFrame:
    """The document's texts, periods and words, each computed once."""
    brought = [F.col(k).cast(t).alias(k) if k in docs.columns else F.lit(None).cast(t).alias(k) for k, t in BROUGHT.items()]
    own = docs.select("doc_id", "file_name", F.expr(normal_route("coalesce(file_name, '')")).alias("name_text"), F.expr(normal_route("coalesce(body, '')")).alias("body_text"), *brought)
    both = own.withColumn("both_text", F.expr("concat(name_text, ' ', body_text)"))
    seen = both.withColumns({"words": F.expr(words_in("both_text")), "period_text": F.expr(period_of_route("both_text"))})
    return seen.withColumns({"name_words": F.expr(words_in("name_text", "words")), "body_words": F.expr(words_in("body_text", "words")), "period": F.expr(routing_case("both_text", "period_text"))})


def settled_rows(df: DataFrame) -> DataFrame:
    """The same rows behind a generator, whose expressions the optimizer does not copy into later ones."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def local_route(docs: DataFrame, year: int, month: int, ignore_period: bool = False) -> DataFrame:
    """doc_id, file_name, document_code, confidence, stage, target_year, target_month of (doc_id, file_name, body).

    Null names and bodies count as empty. Columns of BROUGHT are used where docs has them. With
    `ignore_period` another period than asked for costs no confidence, as when a folder is clustered.
    """
    texts = _texts(docs)
    stages = texts.withColumns({
        "proof": F.expr(settled("0", proof_code(), "z")),
        "payslip": F.expr(settled("0", matches("both_text", "words", PAYSLIP), "z")),
        "hints": F.expr(scored(list(FOLDER_HINTS), hint_score)),
        "scores": F.expr(scored(list(PATTERNS), pattern_score)),
    })
    best = stages.select("doc_id", "file_name", "period", "proof", "payslip", *BROUGHT, F.expr(capped_best("hints", HINT["cap"])).alias("hint"), F.expr(capped_best("scores", 1.0)).alias("top"), F.expr("element_at(array_sort(transform(scores, x -> -x.score)), 2)").alias("second"))
    asked, n = year * 100 + month, double
    known = first_of(
        [
            ("proof IS NOT NULL", "named_struct('stage', 'proof', 'code', proof, 'base', " + first_of([(f"proof = '{c}'", n(x)) for c, x in PROOF_CONFIDENCE.items()]) + ")"),
            ("learned_code IS NOT NULL", f"named_struct('stage', 'learned', 'code', learned_code, 'base', greatest({ROUTE['learned']}D, learned_score))"),
            (f"hint.score >= {n(HINT['least'])}", f"named_struct('stage', 'hint', 'code', hint.code, 'base', greatest({n(HINT['floor'])}, hint.score))"),
            ("payslip", f"named_struct('stage', 'payslip', 'code', 'RV', 'base', {n(PAYSLIP_CONFIDENCE)})"),
            (f"top.score >= {n(SCORE['least'])}", "named_struct('stage', 'pattern', 'code', top.code, 'base', top.score)"),
        ],
        f"named_struct('stage', 'unknown', 'code', 'UNKNOWN', 'base', CASE WHEN ocr THEN {ROUTE['scanned']}D ELSE {ROUTE['unknown']}D END)",
    )
    decided = best.withColumn("known", F.expr(known)).withColumn("signal", F.expr("CASE WHEN known.stage NOT IN ('payslip', 'unknown') THEN try_element_at(learned_periods, known.code) END"))
    used = decided.withColumn("found", F.expr("CASE WHEN known.stage <> 'pattern' OR signal.rated THEN signal.period END"))
    cost = lambda x: "0D" if ignore_period else n(x)
    by_mark = f"known.base + CASE WHEN found IS NULL THEN 0D WHEN found = {asked} THEN {ROUTE['fits']}D ELSE -{cost(ROUTE['off_mark'])} END"
    step = lambda c: f"CASE WHEN found IS NULL THEN {c} WHEN found = {asked} THEN least({ROUTE['cap']}D, {c} + {ROUTE['fits']}D) ELSE greatest(0D, {c} - {cost(ROUTE['off_signal'])}) END"
    near = f"least({ROUTE['cap']}D, least({ROUTE['cap']}D, known.base + CASE WHEN floor(period / 100) = {year} THEN {ROUTE['year']}D ELSE 0D END) + CASE WHEN period % 100 = {month} THEN {ROUTE['month']}D ELSE 0D END)"
    learned = f"CASE WHEN signal IS NOT NULL THEN {step('known.base')} WHEN period <> {asked} THEN greatest(0D, {near} - {cost(ROUTE['off'])}) ELSE {near} END"
    drift = f"CASE WHEN signal.rated THEN CASE WHEN found IS NULL THEN 0D WHEN found = {asked} THEN {ROUTE['fits']}D ELSE -{cost(ROUTE['off_signal'])} END ELSE CASE WHEN floor(period / 100) = {year} THEN {ROUTE['year']}D ELSE 0D END + CASE WHEN period % 100 = {month} THEN {ROUTE['month']}D ELSE 0D END - CASE WHEN period <> {asked} THEN {cost(ROUTE['off'])} ELSE 0D END END"
    pattern = f"known.base + {drift} - CASE WHEN known.base + second < {ROUTE['close']}D THEN {ROUTE['close_cost']}D ELSE 0D END"
    confidence = first_of([("known.stage IN ('proof', 'hint')", f"greatest(0D, least({ROUTE['cap']}D, {by_mark}))"), ("known.stage = 'learned'", learned), ("known.stage = 'pattern'", f"greatest(0D, least({ROUTE['cap']}D, {pattern}))")], "known.base")
    target = "coalesce(found, period)"
    routes = used.select(
        "doc_id", "file_name", F.expr("known.code").alias("document_code"), F.expr(confidence).alias("confidence"), F.expr("known.stage").alias("stage"),
        F.expr(f"CAST(floor({target} / 100) AS INT)").alias("target_year"), F.expr(f"CAST({target} % 100 AS INT)").alias("target_month"), F.coalesce("ocr", F.lit(False)).alias("ocr"),
    )
    # a generator: filters and constraints of later steps would copy all these expressions, again and again
    return settled_rows(routes)
