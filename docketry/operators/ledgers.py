"""Checks that must add up: pages from intake to export, documents in a file of pages, a bundle's structure, rules under correction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The share of pages that must be preserved, corrections that make a proposal, and the share that flags a rule.
PRESERVED, PROPOSE, FLAGGED = 0.95, 3, 0.10
# Weights of coverage, order and the fingerprints' quality in a structure's confidence.
COVERAGE, ORDER, QUALITY = 0.5, 0.3, 0.2
PAGE = ["batch_id", "document", "page"]


def page_ledger(taken: DataFrame, classified: DataFrame, reviewed: DataFrame, exported: DataFrame) -> DataFrame:
    """batch_id, document, page, state, copies: every page once: exported, reviewed, classified (and nowhere since), lost, or unexpected.

    Each table: batch_id, document, page, one row per page in that place. The four are put under one
    another and meet in one aggregate, so a page that only the export has is seen too. copies: how
    often the page was exported.
    """
    tables = {"taken": taken, "classified": classified, "reviewed": reviewed, "exported": exported}
    rows = None
    for name, df in tables.items():
        one = df.select(*PAGE, *[F.lit(int(name == k)).alias(k) for k in tables])
        rows = one if rows is None else rows.unionByName(one)
    seen = rows.groupBy(*PAGE).agg(*[F.sum(k).alias(k) for k in tables])
    state = F.when(F.col("taken") == 0, "unexpected").when(F.col("exported") > 0, "exported").when(F.col("reviewed") > 0, "reviewed").when(F.col("classified") > 0, "classified").otherwise("lost")
    return seen.select(*PAGE, state.alias("state"), F.col("exported").alias("copies"))


def reconciliation(ledger: DataFrame) -> DataFrame:
    """Per batch its pages by state, pages exported twice or more, and whether enough are preserved and none is lost, doubled or unexpected."""
    n = lambda s: F.count_if(F.col("state") == s)
    out = ledger.groupBy("batch_id").agg(
        F.count_if(F.col("state") != "unexpected").alias("input_pages"), n("exported").alias("exported_pages"), n("reviewed").alias("reviewed_pages"), n("classified").alias("waiting_pages"), n("lost").alias("lost_pages"), n("unexpected").alias("unexpected_pages"), F.count_if(F.col("copies") > 1).alias("doubled_pages")
    )
    share = (F.col("exported_pages") + F.col("reviewed_pages")) / F.greatest("input_pages", F.lit(1))
    whole = (F.col("lost_pages") + F.col("doubled_pages") + F.col("unexpected_pages")) == 0
    return out.withColumns({"preserved": F.round(share, 6), "enough": share >= PRESERVED, "reconciled": whole & (F.col("waiting_pages") == 0)})


def logical_documents(pages: DataFrame) -> DataFrame:
    """File, document, first_page, pages, kind, reasons, conflicts: logical documents over a file's pages.

    pages: file, page, kind, continuation, company_nif, employee_nif, entity, period, employee_kind
    (the type is one person's). A document begins with the first page, where a page says it is no
    continuation, and where the type, the company's or (for such types) the employee's number, the
    entity or the period is another than the last stated one. What a page does not state changes
    nothing. A page that says it continues and yet begins is a conflict, for review.
    """
    order = Window.partitionBy("file").orderBy("page")
    before = order.rowsBetween(Window.unboundedPreceding, -1)

    def changed(k: str) -> F.Column:
        return F.coalesce(F.col(k) != F.last(k, ignorenulls=True).over(before), F.lit(False))

    first = F.row_number().over(order) == 1
    signs = {"first_page": first, "not_continued": ~F.coalesce("continuation", F.lit(True)) & ~first, "type": changed("kind"), "company_nif": changed("company_nif"), "employee_nif": changed("employee_nif") & F.coalesce("employee_kind", F.lit(False)), "entity": changed("entity"), "period": changed("period")}
    reasons = F.array_compact(F.array(*[F.when(c, k) for k, c in signs.items()]))
    seen = pages.withColumn("reasons", reasons)
    begins = F.size("reasons") > 0
    conflict = F.coalesce("continuation", F.lit(False)) & (F.size(F.array_except("reasons", F.array(F.lit("first_page")))) > 0)
    numbered = seen.withColumns({"conflict": conflict, "document": F.sum(begins.cast("long")).over(order)})
    return numbered.groupBy("file", "document").agg(F.min("page").alias("first_page"), F.count("*").alias("pages"), F.min_by("kind", F.when(F.col("kind").isNotNull(), F.col("page"))).alias("kind"), F.min_by("reasons", "page").alias("reasons"), F.count_if("conflict").alias("conflicts"))


def structure_sections(expected: DataFrame, folders: DataFrame) -> DataFrame:
    """workspace_key, code, folder_number, expected_position, actual_position, found, order_match of each expected section.

    expected: workspace_key, code, folder_number, section_order. folders: workspace_key,
    folder_number, status, a row a folder. Folders 2 and up that are approved or passed stand in order of
    number; a section matches if it stands behind every section found before it.
    """
    kept = folders.where(F.col("status").isin("approved", "passed") & (F.col("folder_number") >= 2))
    place = kept.select("workspace_key", "folder_number", (F.row_number().over(Window.partitionBy("workspace_key").orderBy("folder_number")) - 1).alias("actual_position"))
    order = Window.partitionBy("workspace_key").orderBy("section_order", "code")
    both = expected.withColumn("expected_position", F.row_number().over(order) - 1).join(place, ["workspace_key", "folder_number"], "left")
    before = F.max("actual_position").over(Window.partitionBy("workspace_key").orderBy("expected_position").rowsBetween(Window.unboundedPreceding, -1))
    found = F.col("actual_position").isNotNull()
    return both.select("workspace_key", "code", "folder_number", "expected_position", "actual_position", found.alias("found"), F.coalesce(F.col("actual_position") > F.coalesce(before, F.lit(-1)), F.lit(False)).alias("order_match"))


def structure_summary(sections: DataFrame, folders: DataFrame, quality: DataFrame) -> DataFrame:
    """workspace_key, coverage, order_alignment, confidence, missing and unexpected codes.

    quality: workspace_key, quality of its fingerprints (none counts as 0). folders as before, with their code.
    """
    of = sections.groupBy("workspace_key").agg(F.count("*").alias("n"), F.count_if("found").alias("found"), F.count_if("order_match").alias("ordered"), F.transform(F.array_sort(F.collect_list(F.when(~F.col("found"), F.struct("expected_position", "code")))), lambda s: s["code"]).alias("missing"))
    kept = folders.where(F.col("status").isin("approved", "passed") & (F.col("folder_number") >= 2))
    extra = kept.join(sections.select("workspace_key", "folder_number").distinct(), ["workspace_key", "folder_number"], "left_anti").groupBy("workspace_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("folder_number", "code"))), lambda s: s["code"]).alias("unexpected"))
    out = of.join(extra, "workspace_key", "left").join(quality, "workspace_key", "left")
    coverage, aligned = F.col("found") / F.col("n"), F.when(F.col("found") > 0, F.col("ordered") / F.col("found")).otherwise(0.0)
    sure = COVERAGE * coverage + ORDER * aligned + QUALITY * F.coalesce("quality", F.lit(0.0))
    return out.select("workspace_key", F.round(coverage, 6).alias("coverage"), F.round(aligned, 6).alias("order_alignment"), F.round(sure, 6).alias("confidence"), "missing", F.coalesce("unexpected", F.array().cast("array<string>")).alias("unexpected"))


def rule_corrections(uses: DataFrame, corrections: DataFrame) -> DataFrame:
    """Rule, uses, corrections, rate, flagged, proposals of active rules: flagged over a tenth corrected, proposals where three corrections agree.

    uses: rule, seq, code. corrections: seq, to_code, high_value (an administrator's mark, which proposes at once).
    """
    both = uses.join(corrections.withColumn("corrected", F.lit(True)), "seq", "left").withColumn("wrong", F.coalesce(F.col("corrected") & (F.col("to_code") != F.col("code")), F.lit(False)))
    agreed = both.where("wrong").groupBy("rule", "code", "to_code").agg(F.count("*").alias("k"), F.bool_or(F.coalesce("high_value", F.lit(False))).alias("marked"))
    proposals = agreed.groupBy("rule").agg(F.count_if((F.col("k") >= PROPOSE) | F.col("marked")).alias("proposals"))
    of = both.groupBy("rule").agg(F.count("*").alias("uses"), F.count_if("wrong").alias("corrections"))
    rate = F.col("corrections") / F.col("uses")
    return of.join(proposals, "rule", "left").select("rule", "uses", "corrections", F.round(rate, 6).alias("rate"), (rate > FLAGGED).alias("flagged"), F.coalesce("proposals", F.lit(0)).alias("proposals"))


# Evidence that needs its detail beside it, by code.
DETAIL_OF = {"EBV": "TV", "EBSA": "TSA", "PIR": "LIR"}


def evidence_checklist(docs: DataFrame, roster: DataFrame) -> DataFrame:
    """Group, missing categories, evidence without its detail, and employees of the roster that the monthly listing does not cover.

    docs: group, folder_code, employee_code. roster: group, employee_code, the approved payslips'.
    Counts only; categories are a fixed few, and employees meet by group and code.
    """
    codes = docs.groupBy("group", "folder_code").agg(F.count("*").alias("n"))
    have = codes.groupBy("group").agg(F.collect_set("folder_code").alias("codes"))  # fourteen at most
    wanted = F.array(*[F.lit(c) for c in ("RV", "LC", "TV", "EBV", "TSA", "EBSA", "SSR", "SSD", "GIR", "LIR", "PSS", "PIR", "EBI")])
    undetailed = F.array_compact(F.array(*[F.when(F.array_contains("codes", k) & ~F.array_contains("codes", v), k) for k, v in DETAIL_OF.items()]))
    people = roster.select("group", "employee_code").dropna().distinct()
    listed = docs.where("folder_code = 'GIR'").select("group", "employee_code").dropna().distinct()
    uncovered = people.join(listed, ["group", "employee_code"], "left_anti").groupBy("group").agg(F.count("*").alias("uncovered"))
    out = have.join(uncovered, "group", "left")
    return out.select("group", F.array_except(wanted, "codes").alias("missing"), undetailed.alias("without_detail"), F.coalesce("uncovered", F.lit(0)).alias("uncovered_employees"))
