"""Workspaces: answers and caches of routes, months and companies, bundles, payslips, uploads, activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.text import employee_key, employee_name, slug
from docketry.operators.cluster import SURE, folder_number, folders

#: Status of a folder that needs no more evidence, and of a bundle that new files invalidate.
SETTLED, STALE = ("approved", "passed", "confirmed_missing"), ("current", "ready", "needs_confirmation")


def cached_routes(files: DataFrame, cache: DataFrame, versions: DataFrame) -> DataFrame:
    """Files with their cached route: its rules version is the company's, or an operator gave it; relabelled `cache`.

    files: company_id, seq, source_hash. cache: company_id, source_hash, document_code, confidence,
    rules_version, route_source; one row a key. versions: company_id, rules_version.
    """
    valid = cache.join(versions.withColumnRenamed("rules_version", "now"), "company_id").where((F.col("rules_version") == F.col("now")) | (F.col("route_source") == "operator"))
    hit = valid.select("company_id", "source_hash", "document_code", "confidence", F.lit("cache").alias("route_source"))
    return files.join(hit, ["company_id", "source_hash"], "left")


def to_ask(routes: DataFrame, year: int, month: int) -> F.Column:
    """C11: whether a provider is asked: not from the cache, and no folder of 2 to 13, not sure, or another period."""
    other = F.coalesce(F.col("target_year") != year, F.lit(False)) | F.coalesce(F.col("target_month") != month, F.lit(False))
    return (F.col("route_source") != "cache") & ((folder_number(F.col("document_code")) < 2) | (F.col("confidence") < SURE) | other)


def answered(routes: DataFrame, answers: DataFrame, year: int, month: int) -> DataFrame:
    """Routes after providers have answered: an answer replaces the route; without one the local code stays, at 0.69 at most.

    answers: seq, code, answer_confidence; one row a question that was answered.
    """
    asked = routes.withColumn("asked", to_ask(routes, year, month)).join(answers, "seq", "left")
    told, failed = F.col("asked") & F.col("code").isNotNull(), F.col("asked") & F.col("code").isNull()
    return asked.select(
        "seq", F.when(told, F.col("code")).otherwise(F.col("document_code")).alias("document_code"), F.when(told, F.col("answer_confidence")).when(failed, F.least("confidence", F.lit(0.69))).otherwise(F.col("confidence")).alias("confidence"),
        F.when(told, "llm").when(failed, "fallback").otherwise(F.col("route_source")).alias("route_source"),
    )


def repaired_answers(raw: DataFrame) -> DataFrame:
    """Seq and the fields of a provider's JSON answer: unknown codes are UNKNOWN, blank numbers null, a blank reason has a default; `rejected` tells fields out of range."""
    parsed = raw.withColumn("j", F.from_json("answer", "document_code string, confidence string, reason string, target_year string, target_month string, employee_name string"))
    known = folder_number(F.coalesce("j.document_code", F.lit(""))) > 0
    confidence = F.when(F.col("j.confidence").isNull(), 0.0).otherwise(F.expr("try_cast(j.confidence AS DOUBLE)"))
    whole = lambda c: F.expr(f"try_cast(nullif(trim(j.{c}), '') AS INT)")
    blank = lambda c: F.coalesce(F.trim(f"j.{c}"), F.lit("")) == ""
    bad = lambda c, lo, hi: ~blank(c) & (whole(c).isNull() | ~whole(c).between(lo, hi))
    rejected = F.coalesce(confidence.isNull() | ~confidence.between(0.0, 1.0) | bad("target_year", 2000, 2100) | bad("target_month", 1, 12) | F.col("j").isNull(), F.lit(True))
    return parsed.select(
        "seq", F.when(known, F.col("j.document_code")).otherwise("UNKNOWN").alias("document_code"), confidence.alias("confidence"), F.when(blank("reason"), "Sem evidência suficiente para classificação automática.").otherwise(F.col("j.reason")).alias("reason"),
        whole("target_year").alias("target_year"), whole("target_month").alias("target_month"), F.when(~blank("employee_name"), F.col("j.employee_name")).alias("employee_name"), rejected.alias("rejected"),
    )


def cache_rows(routes: DataFrame, year: int, month: int, clustering: bool = False) -> DataFrame:
    """Routes that are stored: of folders 2 to 13 at 0.7 or more, also when they came from the cache; while clustering, of folders 1 to 13 at 0.34 or more that did not."""
    other = F.coalesce(F.col("target_year") != year, F.lit(False)) | F.coalesce(F.col("target_month") != month, F.lit(False))
    number = folder_number(F.col("document_code"))
    fit = (number >= 1) & (F.col("confidence") >= 0.34) & (F.col("route_source") != "cache") if clustering else (number >= 2) & (F.col("confidence") >= SURE)
    return routes.where(fit & ~other)


def route_counts(routes: DataFrame) -> DataFrame:
    """C17: routes by source."""
    return routes.groupBy("route_source").agg(F.count("*").alias("n"))


def periods_to_apply(routes: DataFrame) -> DataFrame:
    """Items of each workspace and period asked for, with those that are approved at once."""
    return routes.groupBy("workspace_key", "year", "month").agg(F.count("*").alias("items"), F.count_if(F.col("confidence") >= SURE).alias("sure"))


def applied_periods(routes: DataFrame) -> DataFrame:
    """Results put where they belong: folder counters of each workspace and period asked for, the last document naming the status.

    routes: workspace_key, year, month, seq, document_code, confidence. Those without a period go to review of no month.
    """
    number = folder_number(F.col("document_code"))
    review = F.col("confidence") < SURE
    order = F.struct("seq", "document_code", "confidence")
    known = routes.where(number > 0).withColumns({"folder_number": number, "review": review})
    return known.groupBy("workspace_key", "year", "month", "folder_number").agg(F.count("*").alias("document_count"), F.count_if(~F.col("review")).alias("approved_count"), F.count_if("review").alias("review_count"), F.max_by(F.when(F.col("review"), "review").otherwise("approved"), order).alias("status"))


def new_employees(payslips: DataFrame, employees: DataFrame, year: int, month: int) -> DataFrame:
    """An employee for every payslip, numbered after those that a workspace has, with the name of the final bundle.

    payslips: workspace_key, seq, employee_name. employees: workspace_key.
    """
    have = employees.groupBy("workspace_key").agg(F.count("*").alias("have"))
    nth = F.row_number().over(Window.partitionBy("workspace_key").orderBy("seq")) + F.coalesce("have", F.lit(0))
    code = F.format_string("E%04d", F.col("nth"))
    return payslips.join(have, "workspace_key", "left").withColumn("nth", nth).select("workspace_key", "seq", code.alias("employee_code"), F.coalesce("employee_name", F.concat(F.lit("Employee "), F.col("nth").cast("string"))).alias("employee_name"), F.concat(F.lit(f"CF_{year:04d}{month:02d}_"), code, F.lit(".pdf")).alias("file_name"))


def classified_folders(routes: DataFrame) -> DataFrame:
    """C20: documents, approved and reviewed of each workspace's folders; the last document names the status.

    routes: workspace_key, seq, document_code, review.
    """
    number = folder_number(F.col("document_code"))
    return routes.where(number > 0).groupBy("workspace_key", number.alias("folder_number")).agg(F.count("*").alias("document_count"), F.count_if(~F.col("review")).alias("approved_count"), F.count_if("review").alias("review_count"), F.max_by(F.when(F.col("review"), "review").otherwise("approved"), "seq").alias("status"))


def audit_manifest(docs: DataFrame, calls: DataFrame) -> DataFrame:
    """Per batch the manifest's counters. Its page fields hold documents, its rule-hit rate is the cache-hit rate, and grouping accuracy and latency are constants; the true mean latency stands beside them."""
    d = docs.groupBy("batch_id").agg(F.count("*").alias("documents"), F.sum("page_count").alias("input_pages"), F.count_if(F.col("confidence") > 0.8).alias("approved_pages"), F.count_if(F.col("confidence") <= 0.8).alias("reviewed_pages"), F.count_if("cache_hit").alias("hits"))
    c = calls.groupBy("batch_id").agg(F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.sum("cost").alias("cost"), F.avg("latency_ms").alias("latency"))
    rate = F.round(F.col("hits") / F.greatest(F.lit(1), "documents"), 6)
    return d.join(c, "batch_id", "left").select(
        "batch_id", "input_pages", (F.col("approved_pages") + F.col("reviewed_pages")).alias("classified_pages"), "reviewed_pages", "approved_pages", F.round(F.col("approved_pages") / F.greatest(F.lit(1), "documents"), 6).alias("accuracy"), F.lit(1.0).alias("grouping_accuracy"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"), rate.alias("cache_hit_rate"), rate.alias("rule_hit_rate"), F.lit(150).alias("average_latency_ms"), F.round(F.coalesce("latency", F.lit(0.0)), 4).alias("true_latency_ms"), F.round(F.coalesce("cost", F.lit(0.0)), 4).alias("cost"),
    )


def batch_activity(docs: DataFrame) -> DataFrame:
    """Per batch what it adds to its workspace's intake, and its line of activity."""
    n = docs.groupBy("batch_id").agg(F.count("*").alias("intake"), F.sum("page_count").alias("pages"))
    return n.select("batch_id", "intake", F.format_string("Batch %d: %d documents, %d pages", "batch_id", "intake", "pages").alias("text"))


def export_bundles(batches: DataFrame) -> DataFrame:
    """batch_id, file_name, format and page count of each batch's bundle. batches: batch_id, company_id, year, month."""
    return batches.select("batch_id", F.format_string("BJ_%d%02d_%d.pdf", "year", "month", "company_id").alias("file_name"), F.lit("pdf").alias("format"), F.lit(1).alias("page_count"))


def database_roll_up(workspaces: DataFrame, employees: DataFrame, folder_status: DataFrame, reviews: DataFrame) -> DataFrame:
    """company_id, years: newest year first, its months in order, with employees by final status, settled folders and pending reviews.

    Each child table is counted per workspace before it meets the workspaces.
    """
    e = employees.groupBy("workspace_key").agg(F.count("*").alias("employees"), F.count_if(F.col("final_status") == "current").alias("current"), F.count_if(F.col("final_status").isin("ready", "ready_with_warnings")).alias("ready"))
    f = folder_status.groupBy("workspace_key").agg(F.count_if(F.col("status").isin(*SETTLED)).alias("folders"))
    r = reviews.groupBy("workspace_key").agg(F.count_if(F.col("status") == "pending").alias("pending"))
    counted = workspaces.join(e, "workspace_key", "left").join(f, "workspace_key", "left").join(r, "workspace_key", "left").fillna(0, ["employees", "current", "ready", "folders", "pending"])
    month = F.struct("month", "workspace_key", "employees", "current", "ready", F.greatest(F.lit(0), F.col("employees") - F.col("current") - F.col("ready")).alias("blocked"), "folders", "pending")
    years = counted.groupBy("company_id", "year").agg(F.array_sort(F.collect_list(month)).alias("months"))
    return years.groupBy("company_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("year", "months")))).alias("years"))


def opened_months(requests: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Workspace rows of months to open: of the template (same company and project, else same company, the newest), with 13 missing folders each.

    requests: company_id, project_id, year, month. workspaces: company_id, project_id, year, month,
    workspace_key. The newest of each company, and of each of its projects, are found before they
    meet the requests: one row a key.
    """
    have = workspaces.select("company_id", "project_id", "year", "month")
    new = requests.join(have, ["company_id", "project_id", "year", "month"], "left_anti")
    newest = F.max(F.struct("year", "month", "workspace_key"))
    of_project = workspaces.groupBy("company_id", "project_id").agg(newest.alias("p"))
    of_company = of_project.groupBy("company_id").agg(F.max("p").alias("c"))
    same = new["company_id"].eqNullSafe(of_project["company_id"]) & new["project_id"].eqNullSafe(of_project["project_id"])
    picked = new.join(of_project, same, "left").select(*[new[k] for k in new.columns], "p").join(of_company, "company_id", "left")
    opened = picked.select("company_id", "project_id", "year", "month", F.coalesce("p.workspace_key", "c.workspace_key").alias("template"))
    return opened.join(F.broadcast(folders(requests.sparkSession).select(F.col("number").alias("folder_number")))).withColumn("status", F.lit("missing"))  # 13 rows


def new_companies(requests: DataFrame, companies: DataFrame) -> DataFrame:
    """Seq, id and what becomes of each request for a company: created, or why not. A code's slug is its id; the first of equal ones wins.

    requests: seq, code, nif. companies: id.
    """
    named = requests.withColumn("id", slug(F.col("code"))).join(companies.select("id", F.lit(1).alias("known")), "id", "left")
    first = F.row_number().over(Window.partitionBy("id").orderBy("seq"))
    ok = F.col("id").isNotNull() & F.coalesce(F.col("nif").rlike("^[0-9]{9}$"), F.lit(False))
    return named.select("seq", "id", F.when(~ok, "invalid code or NIF").when(F.col("known").isNotNull() | (first > 1), "already there").otherwise("created").alias("result"))


def updated_reviews(reviews: DataFrame, updates: DataFrame) -> DataFrame:
    """Reviews after approvals, rejections (passed) and requests for correction (pending again); the last update of a review counts. updates: seq, nth, action, code."""
    last = updates.groupBy("seq").agg(F.max_by(F.struct("action", "code"), "nth").alias("u"))
    state = F.when(F.col("u.action") == "approve", "approved").when(F.col("u.action") == "reject", "passed").when(F.col("u.action") == "correct", "pending").otherwise(F.col("status"))
    return reviews.join(last, "seq", "left").select("workspace_key", "seq", state.alias("status"), F.coalesce("u.code", "proposed_code").alias("proposed_code"))


def finals_to_make(employees: DataFrame) -> DataFrame:
    """Employees whose final bundle can be made: ready, also with warnings, and with a payslip; they become current."""
    return employees.where(F.col("final_status").isin("ready", "ready_with_warnings") & F.col("payslip_hash").isNotNull()).withColumn("final_status", F.lit("current"))


def resolved_payslips(employees: DataFrame, stored: DataFrame, files: DataFrame) -> DataFrame:
    """Per employee the payslip's file: by its hash; else the first file of folder 1 whose name holds the employee's; else the only file there is.

    employees: workspace_key, employee_code, employee_name, payslip_hash. stored: source_hash, file_name.
    files: workspace_key, seq, file_name (folder 1 of the workspace's month); of files with one seq the
    least name is first. Names are compared without spaces, in lower case, within a workspace only.
    A file's name is cut into its parts of the lengths that its workspace's employees' names have, so
    names meet by equality and not one by one.
    """
    bare = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", "")
    key = ["workspace_key", "employee_code"]
    by_hash = employees.join(stored.select(F.col("source_hash").alias("payslip_hash"), F.col("file_name").alias("by_hash")), "payslip_hash", "left")
    left = by_hash.where("by_hash IS NULL").select(*key, bare("employee_name").alias("wanted")).where("wanted <> ''").distinct()
    lengths = left.groupBy("workspace_key").agg(F.collect_set(F.length("wanted")).alias("lengths"))  # no more than a file's name has letters
    have = files.select("workspace_key", "seq", "file_name", bare("file_name").alias("have")).join(lengths, "workspace_key")
    parts = F.expr("array_distinct(flatten(transform(filter(lengths, n -> n <= length(have)), n -> transform(sequence(1, length(have) - n + 1), k -> substring(have, k, n)))))")
    first = have.select("workspace_key", F.explode(parts).alias("wanted"), F.struct("seq", "file_name").alias("f")).groupBy("workspace_key", "wanted").agg(F.min("f").alias("f"))
    named = left.join(first, ["workspace_key", "wanted"]).groupBy(*key).agg(F.min("f")["file_name"].alias("by_name"))
    only = files.groupBy("workspace_key").agg(F.count("*").alias("n"), F.min("file_name").alias("only_file")).where("n = 1").drop("n")
    out = by_hash.join(named, key, "left").join(only, "workspace_key", "left")
    how = F.when(F.col("by_hash").isNotNull(), "hash").when(F.col("by_name").isNotNull(), "name").when(F.col("only_file").isNotNull(), "only file").otherwise("none")
    return out.select(*key, F.coalesce("by_hash", "by_name", "only_file").alias("file_name"), how.alias("how"))


def detected_payslips(uploads: DataFrame, month: int | None = None) -> DataFrame:
    """Payslips of a company: files of folder 1, then files of the inbox that begin with 01_ or 01-; a name counts once. Uploads without a month pass every month.

    uploads: company_id, seq, folder_number, month, status, file_name.
    """
    able = uploads if month is None else uploads.where(F.col("month").isNull() | (F.col("month") == month))
    own = F.col("folder_number") == 1
    inbox = (F.col("folder_number") == 0) & (F.col("status") != "archived") & F.col("file_name").rlike("^01[_-]")
    first = F.row_number().over(Window.partitionBy("company_id", "file_name").orderBy(F.when(own, 0).otherwise(1), "seq"))
    found = able.where(own | inbox).withColumn("nth", first).where("nth = 1")
    return found.select("company_id", "file_name", employee_name(F.col("file_name")).alias("employee_name"), "seq", "folder_number")


def reassigned(cache: DataFrame, corrections: DataFrame) -> DataFrame:
    """The cache after operators' corrections, which are certain and outlive rule changes; the last one of a file counts. corrections: company_id, source_hash, nth, document_code."""
    key = ["company_id", "source_hash"]
    last = corrections.where(folder_number(F.col("document_code")) > 0).groupBy(*key).agg(F.max_by("document_code", "nth").alias("document_code"))
    new = last.withColumns({"confidence": F.lit(1.0), "rules_version": F.lit(None).cast("int"), "route_source": F.lit("operator")})
    columns = [*key, "document_code", "confidence", "rules_version", "route_source"]
    return cache.join(last.select(*key), key, "left_anti").select(*columns).unionByName(new.select(*columns))


def after_deleted_exports(employees: DataFrame, bundles: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(employees, bundles) after generated files are deleted: a base bundle is ready again and its current employees too; a final bundle only its employee.

    employees, bundles: workspace_key, file_name, final_status / status. deleted: file_name.
    """
    gone = deleted.select("file_name").distinct().withColumn("gone", F.lit(True))
    hit = bundles.join(gone, "file_name", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    base = hit.where("gone").select("workspace_key").distinct().withColumn("base_gone", F.lit(True))
    seen = employees.join(gone, "file_name", "left").join(base, "workspace_key", "left")
    status = F.when(F.col("gone") | (F.col("base_gone") & (F.col("final_status") == "current")), "ready").otherwise(F.col("final_status"))
    return seen.select("workspace_key", "seq", "file_name", status.alias("final_status")), hit.select("workspace_key", "file_name", F.when(F.col("gone"), "ready").otherwise(F.col("status")).alias("status"))


def reset_companies(workspaces: DataFrame, rules: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(workspaces, rules) left after companies, or one project of theirs, are reset; rules stay while a workspace of the company does or nothing of it was there. requests: company_id, project_id (null: all)."""
    asked = requests.select("company_id", F.col("project_id").alias("asked")).distinct()
    same = (workspaces["company_id"] == asked["company_id"]) & (asked["asked"].isNull() | (workspaces["project_id"] == asked["asked"]))
    left = workspaces.join(asked, same, "left_anti")
    hit = workspaces.join(asked, same, "left_semi").select("company_id").distinct()
    emptied = hit.join(left.select("company_id").distinct(), "company_id", "left_anti")
    return left, rules.join(emptied, "company_id", "left_anti")


def without_hashes(uploads: DataFrame, hashes: DataFrame) -> DataFrame:
    """Uploads without the files of listed hashes; uploads left empty go. uploads: company_id, seq, files array<struct<name, hash>>. hashes: company_id, hash; few of a company."""
    gone = hashes.groupBy("company_id").agg(F.collect_set("hash").alias("gone"))
    left = F.expr("filter(files, f -> gone IS NULL OR f.hash IS NULL OR NOT array_contains(gone, f.hash))")
    return uploads.join(gone, "company_id", "left").withColumn("kept", left).withColumn("deleted", F.size("files") - F.size("kept")).where("size(kept) > 0 OR deleted = 0").select("company_id", "seq", F.col("kept").alias("files"), "deleted")


def without_company(uploads: DataFrame, companies: DataFrame) -> DataFrame:
    """Uploads of all companies but those listed."""
    return uploads.join(companies.select("company_id").distinct(), "company_id", "left_anti")


def invalidated(workspaces: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Workspaces after new files: a bundle that was current, ready or to be confirmed is blocked again; in replace mode the intake begins anew.

    workspaces: workspace_key, status, intake. arrivals: workspace_key, mode, files.
    """
    seen = workspaces.join(arrivals, "workspace_key", "left")
    hit = F.col("mode").isNotNull()
    return seen.select("workspace_key", F.when(hit & F.col("status").isin(*STALE), "blocked").otherwise(F.col("status")).alias("status"), (F.when(F.col("mode") == "replace", 0).otherwise(F.col("intake")) + F.coalesce("files", F.lit(0))).alias("intake"), F.coalesce(F.col("mode") == "replace", F.lit(False)).alias("cleared"))


def activity_log(activity: DataFrame, last: int = 20) -> DataFrame:
    """The newest lines of each workspace, newest first. activity: workspace_key, at, seq, text."""
    order = Window.partitionBy("workspace_key").orderBy(F.desc("at"), F.desc("seq"))
    return activity.withColumn("place", F.row_number().over(order)).where(F.col("place") <= last)


def training_activity(trained: DataFrame) -> DataFrame:
    """company_id, text and tone of a training: success at a quality of 0.7 or more. trained: company_id, n, quality."""
    return trained.select("company_id", F.format_string("%d fingerprints trained, quality %d%%", "n", F.floor(F.col("quality") * 100 + 0.5).cast("int")).alias("text"), F.when(F.col("quality") >= 0.7, "success").otherwise("warning").alias("tone"))


def finals_by_month(finals: DataFrame) -> DataFrame:
    """V8: final bundles of each company by month, newest first, employees in order. finals: company_id, year, month, employee_code."""
    grouped = finals.groupBy("company_id", "year", "month").agg(F.array_sort(F.collect_list("employee_code")).alias("employees"))
    return grouped.withColumn("place", F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("year"), F.desc("month"))))


def selected_periods(workspaces: DataFrame, detected: DataFrame, keys: DataFrame, months: DataFrame) -> DataFrame:
    """Per workspace the detected periods that are chosen; where none was detected, the chosen months of its year.

    detected: workspace_key, year, month. keys: workspace_key, period_key. months: workspace_key, month.
    """
    named = detected.withColumn("period_key", F.format_string("%04d-%02d", "year", "month"))
    first = named.join(keys, ["workspace_key", "period_key"], "left_semi").select("workspace_key", "year", "month")
    rest = workspaces.join(detected.select("workspace_key").distinct(), "workspace_key", "left_anti").select("workspace_key", "year").join(months, "workspace_key").select("workspace_key", "year", "month")
    return first.unionByName(rest)


def items_to_confirm(items: DataFrame, year: int, month: int) -> DataFrame:
    """Items of folders 2 to 13 with a hash; those without a period take the workspace's, and a missing confidence is 0.9."""
    dated = F.col("target_year").isNotNull() & F.col("target_month").isNotNull()
    return items.where("folder_number BETWEEN 2 AND 13 AND source_hash IS NOT NULL").select("source_hash", "folder_number", F.when(dated, F.col("target_year")).otherwise(year).alias("target_year"), F.when(dated, F.col("target_month")).otherwise(month).alias("target_month"), F.coalesce("confidence", F.lit(0.9)).alias("confidence"))


def workspace_counters(workspaces: DataFrame, folder_status: DataFrame, reviews: DataFrame, employees: DataFrame, references: DataFrame) -> DataFrame:
    """Per workspace its approved folders, pending reviews, current finals, and references by kind."""
    out = workspaces.select("workspace_key")
    for rows, names in (
        (folder_status, {"approved_folders": F.count_if(F.col("status").isin("approved", "passed"))}),
        (reviews, {"pending_reviews": F.count_if(F.col("status") == "pending")}),
        (employees, {"current_finals": F.count_if(F.col("final_status") == "current")}),
        (references, {"base_references": F.count_if(F.col("kind") == "base_join"), "final_references": F.count_if(F.col("kind") == "final_join")}),
    ):
        out = out.join(rows.groupBy("workspace_key").agg(*[c.alias(k) for k, c in names.items()]), "workspace_key", "left").fillna(0, list(names))
    return out


def cell_files(uploads: DataFrame, folder: int, month: int | None) -> DataFrame:
    """Per company and year the submitted uploads and files of one cell, no month being a cell of its own, and whether it is being processed."""
    cell = uploads.where((F.col("folder_number") == folder) & F.col("month").eqNullSafe(F.lit(month)))
    return cell.groupBy("company_id", "year").agg(F.coalesce(F.sum(F.when(F.col("status") == "submitted", F.col("files"))), F.lit(0)).alias("files"), F.bool_or(F.col("status").isin("grouped", "month_detected", "approved", "archived")).alias("processing"))


def inbox_files(uploads: DataFrame, company: int, year: int) -> DataFrame:
    """Files of the inbox to stage: of the company and year, not archived, with a place to read them. uploads: files array<struct<name, hash, url>>."""
    mine = uploads.where((F.col("company_id") == company) & (F.col("year") == year) & (F.col("folder_number") == 0) & (F.col("status") != "archived"))
    return mine.select("seq", F.inline("files")).where("coalesce(url, '') <> ''")


def bundles_of_payslips(payslips: DataFrame, finals: DataFrame) -> DataFrame:
    """Payslips with the final bundles that exist for them, by company and code. payslips: company_id, file_name. finals: company_id, employee_code."""
    coded = payslips.withColumn("employee_code", employee_key(F.col("file_name")))
    have = finals.groupBy("company_id", "employee_code").agg(F.count("*").alias("n"))
    return coded.join(have, ["company_id", "employee_code"], "left").select("company_id", "file_name", "employee_code", F.coalesce("n", F.lit(0)).alias("bundles"))


def without_items(items: DataFrame, removed: DataFrame) -> DataFrame:
    """Clusters after items are removed: counts per bucket; buckets left empty stay only if they are folders. items: bucket, source_hash. removed: bucket, source_hash."""
    gone = removed.select("bucket", "source_hash").distinct().withColumn("gone", F.lit(1))
    left = items.join(gone, ["bucket", "source_hash"], "left").groupBy("bucket").agg(F.count_if(F.col("gone").isNull()).alias("items"), F.count("gone").alias("removed"))
    return left.where((F.col("items") > 0) | (folder_number(F.col("bucket")) > 0))


def file_locations(documents: DataFrame, cached: DataFrame, uploaded: DataFrame) -> DataFrame:
    """Where each document's bytes are: in the content cache by hash, else in its upload; `skipped` if in neither."""
    seen = documents.join(cached.select("source_hash", F.lit(1).alias("c")), "source_hash", "left").join(uploaded.select("source_hash", "path"), "source_hash", "left")
    return seen.select("seq", "source_hash", F.when(F.col("c").isNotNull(), "cache").when(F.col("path").isNotNull(), "upload").otherwise("skipped").alias("place"))
