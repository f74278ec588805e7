"""Inputs of the document operators, derived from the given tables by expressions both engines share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Phrases put before documents, one for each branch of the rules; rows without one stay as they are.
PHRASES = (
    "Recibo de Vencimento Junho 2025",
    "Dados da Operação: Pagamento TSU 06/2025",
    "Extrato Conta Período 03/2025 Autoridade Tributária",
    "Entrega de ficheiro de remunerações - Extrato de resumo",
    "Mapa de Liquidação de IRS 202504",
    "Dados da Operação Multi Imposto Março 2024",
    "Transferência de vencimento Abril de 2025",
    "Subsídio Alimentação 03 2025 transferência",
    "Guia de IRS ano mês 2025 06",
    "Listagem de IRS 15.03.2025",
    "Lançamentos contabilísticos Dez 2025",
    "Extrato bancário vencimento 2025-06-30",
    "Período 2025 12",
    "Declaração mensal de remunerações detalhe trabalhador Outubro 2025",
    "Comprovativo segurança social 05/2025",
    "Cartão Refeição Junh 2025",
)

SLUGS = ("01_RV_recibo", "02_LC_mapa", "05_TSA_cartao", "scan", "pasta 9 guia", "tsu_comprovativo", "ebi", "documento")

# Phrases put before pages, one for each branch of the page rules.
PAGE_PHRASES = (
    "Recibo de vencimento", "Extracto de contas pasta 2", "Comprovativo de operação transferência vencimento", "Extrato D.O. salário período data mov data valor", "Carregamento de cartões pré-pagos", "Extrato D O cartão refeição 06/2025",
    "Entrega de declaração de remunerações - extrato de resumo Junho 2025", "Extracto da declaração de remunerações", "Identificação do sujeito passivo, importância a pagar 202503", "Mapa de liquidação de IRS data valor", "Comprovativo segurança social", "Pagamento de IRS período 2025 06",
    "Extrato D.O. autoridade tributária", "continua", "data mov saldo contabilístico", "", "",
)

# Texts put on pages, dates among them.
DATED_ITEMS = ("Período 06/2025", "emitido 15.03.2025", "2024-11", "Março de 2025", "vencimento 2025/02", "31-12-2023", "pagamento 07/2024", "mês")


def _page_items(words: str) -> str:
    """Words of a turn placed on a page by a law: eight to a line, some lines numbered and indented, some items dates or blank."""
    number = "CAST(((line // 9) * 5 + line % 9 - 1) % 17 + 1 AS INT)"
    numbered = "col = 0 AND line % 9 BETWEEN 1 AND 5"
    digits = f"CAST({number} AS VARCHAR(4))"
    dates = " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(DATED_ITEMS))
    text = f"""CASE WHEN {numbered} THEN concat({digits}, CASE CAST({number} % 3 AS INT) WHEN 0 THEN ' -' WHEN 1 THEN '.' ELSE ')' END) WHEN col = 5 AND line % 6 = 2 THEN CASE CAST((doc_id + page + line) % {len(DATED_ITEMS)} AS INT) {dates} END WHEN col = 3 AND line % 4 = 0 THEN '  ' ELSE word END"""
    placed = f"SELECT CAST(conv_id // 4 AS BIGINT) AS doc_id, CAST(turn * 4 + conv_id % 4 + 1 AS INT) AS page, CAST(seq AS BIGINT) AS seq, CAST(seq // 8 AS BIGINT) AS line, CAST(seq % 8 AS BIGINT) AS col, word FROM ({words}) AS w"
    return f"""SELECT doc_id, page, seq, text, CAST(40 + ((col * 5) % 8) * 60 + CASE WHEN line % 9 BETWEEN 1 AND 5 THEN 30 ELSE 0 END AS DOUBLE) AS x,
        CAST(800 - 12 * line + CASE WHEN line % 5 = 0 AND col = 7 THEN 2 ELSE seq % 3 - 1 END AS DOUBLE) AS y, CAST(length(text) AS DOUBLE) * 5.5 AS width FROM (SELECT *, {text} AS text FROM ({placed}) AS p) AS t"""


#: A number that orders lines: of one supplier no two lines have the same.
SEQ = "CAST((l_orderkey * 8 + l_linenumber) * 4194304 + l_partkey AS BIGINT)"

VIEWS = {
    "page_items": _page_items("SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS seq FROM conversations"),
    "page_sizes": """SELECT CAST(conv_id // 4 AS BIGINT) AS doc_id, CAST(turn * 4 + conv_id % 4 + 1 AS INT) AS page, CAST(CASE CAST((conv_id + turn) % 5 AS INT) WHEN 0 THEN 842 WHEN 1 THEN 600 ELSE 595 END AS DOUBLE) AS width, CAST(CASE CAST((conv_id + turn) % 5 AS INT) WHEN 0 THEN 595 WHEN 1 THEN 590 ELSE 842 END AS DOUBLE) AS height FROM conversations""",
    "document_programs": """SELECT DISTINCT CAST(conv_id // 4 AS BIGINT) AS doc_id, CASE CAST(conv_id // 4 % 3 AS INT) WHEN 1 THEN 'Ártis (Softe) v2.5' WHEN 2 THEN 'Writer' END AS creator, CASE CAST(conv_id // 4 % 4 AS INT) WHEN 0 THEN '' WHEN 1 THEN 'Pdf/Lib_2' END AS producer FROM conversations""",
    "page_texts": f"""SELECT conv_id AS reference_id, CAST(turn + 1 AS BIGINT) AS page, concat(CASE CAST((conv_id * 7 + turn * 3) % {len(PAGE_PHRASES)} AS INT) {' '.join(f"WHEN {k} THEN '{p} '" for k, p in enumerate(PAGE_PHRASES))} END, text) AS text FROM conversations""",
    "doc_inputs": f"""SELECT doc_id, concat(CASE CAST(doc_id % {len(SLUGS)} AS INT) {' '.join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(SLUGS))} END, '_', CAST(doc_id AS VARCHAR(20)), '.pdf') AS file_name,
        concat(CASE CAST(doc_id % 24 AS INT) {' '.join(f"WHEN {k} THEN '{p} '" for k, p in enumerate(PHRASES))} ELSE '' END, text) AS body
        FROM documents""",
    "batch_documents": """SELECT CAST(l_orderkey % 997 AS BIGINT) AS batch_id, CAST(l_orderkey AS BIGINT) AS seq,
        CASE CAST(l_partkey % 15 AS INT) WHEN 1 THEN 'RV' WHEN 2 THEN 'LC' WHEN 3 THEN 'TV' WHEN 4 THEN 'EBV' WHEN 5 THEN 'TSA' WHEN 6 THEN 'EBSA' WHEN 7 THEN 'SSR' WHEN 8 THEN 'SSD' WHEN 9 THEN 'GIR' WHEN 10 THEN 'LIR' WHEN 11 THEN 'PSS' WHEN 12 THEN 'PIR' ELSE 'UNKNOWN' END AS folder_code,
        CAST(1 - 5 * l_discount AS DOUBLE) AS confidence, CAST(l_linenumber AS BIGINT) AS page_count,
        CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE concat('E', CAST(l_suppkey % 40 AS VARCHAR(20))) END AS employee_code, l_returnflag = 'A' AS cache_hit FROM lineitem""",
    "provider_calls": """SELECT CAST(user_id % 997 AS BIGINT) AS batch_id, CASE WHEN user_id % 2 = 0 THEN 'first' ELSE 'second' END AS provider_id, event_type AS status,
        CAST(event_id % 700 AS BIGINT) AS input_tokens, CAST(event_id % 90 AS BIGINT) AS output_tokens, CAST(floor(value) AS BIGINT) AS latency_ms, CAST(event_id % 13 AS DOUBLE) / 4 AS cost, ts AS timestamp FROM events""",
    "uploads": """SELECT CAST(o_custkey % 20 AS INT) AS company_id, CAST(o_orderkey % 14 AS INT) AS folder_number, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month,
        CASE WHEN o_orderpriority LIKE '1%' THEN 'submitted' WHEN o_orderpriority LIKE '2%' THEN 'processing' WHEN o_orderpriority LIKE '3%' THEN 'archived' ELSE 'grouped' END AS status, CAST(1 + o_orderkey % 3 AS BIGINT) AS files, o_orderdate AS submitted_at, CAST(o_orderkey AS BIGINT) AS seq FROM orders""",
    "approved_documents": f"""SELECT CAST(l_suppkey AS BIGINT) AS workspace_key, {SEQ} AS seq, CAST(l_partkey AS BIGINT) AS source_hash, CAST(l_partkey % 14 AS INT) AS folder_number, l_shipdate AS approved_at, CAST(l_linenumber AS BIGINT) AS page_count, CAST(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS INT) AS priority FROM lineitem""",
    "reference_pages": """SELECT conv_id AS reference_id, turn AS page, CASE CAST((conv_id * 7 + turn * 3) % 11 AS INT) WHEN 0 THEN 'LC' WHEN 1 THEN 'GIR' WHEN 2 THEN 'EBV' WHEN 3 THEN 'PIR' WHEN 4 THEN 'SSD' END AS strong_code, (conv_id + turn) % 3 = 0 AS bank, (conv_id + turn) % 4 <> 1 AS continuation, text FROM conversations""",
    "snapshot_files": """SELECT CAST(user_id % 12 + 2 AS INT) AS group_no, concat(event_type, '_', CAST(day(ts) AS VARCHAR(4))) AS file_name, event_id % 2 = 0 AS late FROM events""",
    "folder_status": """SELECT CAST(l_suppkey AS BIGINT) AS workspace_key, CAST(l_partkey % 13 + 1 AS INT) AS folder_number, count(*) AS document_count, count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS review_count FROM lineitem GROUP BY 1, 2""",
    "decisions": f"""SELECT CAST(l_suppkey AS BIGINT) AS workspace_key, {SEQ} AS seq, CAST(l_partkey % 13 + 1 AS INT) AS from_folder, CAST((l_partkey + l_orderkey) % 13 + 1 AS INT) AS to_folder, l_returnflag <> 'N' AS approved, CAST(l_partkey AS BIGINT) AS source_hash FROM lineitem""",
    "reviews": """SELECT CAST(o_custkey AS BIGINT) AS workspace_key, CAST(o_orderkey AS BIGINT) AS seq, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'approved' ELSE 'rejected' END AS status FROM orders""",
    "signals": """SELECT CAST(user_id % 200 AS BIGINT) AS section, CAST(event_id AS BIGINT) AS seq, CASE WHEN event_id % 7 < 4 THEN event_type END AS format, CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'header' WHEN 1 THEN 'footer' END AS position FROM events""",
    "workspace_rows": """SELECT CAST(s_suppkey AS BIGINT) AS workspace_key, CAST(s_nationkey % 5 AS BIGINT) AS company_id, CAST(s_suppkey % 3 AS BIGINT) AS project_id, CAST(2023 + s_suppkey % 3 AS INT) AS year, CAST(s_suppkey % 12 + 1 AS INT) AS month, CASE CAST(s_suppkey % 4 AS INT) WHEN 0 THEN 'current' WHEN 1 THEN 'ready' WHEN 2 THEN 'blocked' ELSE 'needs_confirmation' END AS status, CAST(s_suppkey % 17 AS BIGINT) AS intake FROM supplier""",
    "employees": f"""SELECT CAST(l_suppkey AS BIGINT) AS workspace_key, {SEQ} AS seq, concat('E', CAST(l_linenumber AS VARCHAR(4)), '_', CAST(l_orderkey AS VARCHAR(12)), '_', CAST(l_partkey AS VARCHAR(12))) AS employee_code, concat('Name ', CAST(l_partkey % 50 AS VARCHAR(4))) AS employee_name, CASE l_returnflag WHEN 'A' THEN 'current' WHEN 'R' THEN 'ready' ELSE CASE WHEN l_linenumber > 3 THEN 'ready_with_warnings' ELSE 'blocked' END END AS final_status, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE CAST(l_partkey AS BIGINT) END AS payslip_hash FROM lineitem""",
    "folder_states": """SELECT CAST(l_suppkey AS BIGINT) AS workspace_key, CAST(l_partkey % 13 + 1 AS INT) AS folder_number, CASE WHEN l_linenumber = 1 THEN 'approved' WHEN l_linenumber = 2 THEN 'passed' WHEN l_linenumber = 3 THEN 'confirmed_missing' ELSE 'review' END AS status FROM lineitem""",
    "cache_rows": """SELECT CAST(p_partkey % 20 AS BIGINT) AS company_id, CAST(p_partkey AS BIGINT) AS source_hash, CASE CAST(p_size % 5 AS INT) WHEN 0 THEN 'GIR' WHEN 1 THEN 'LC' WHEN 2 THEN 'UNKNOWN' ELSE 'PIR' END AS document_code, CAST(p_size AS DOUBLE) / 50 AS confidence, CAST(p_size % 3 AS INT) AS rules_version, CASE WHEN p_size % 4 = 0 THEN 'operator' ELSE 'rules' END AS route_source FROM part""",
    "route_rows": f"""SELECT CAST(l_suppkey AS BIGINT) AS workspace_key, {SEQ} AS seq, CAST(l_partkey % 20 AS BIGINT) AS company_id, CAST(l_partkey AS BIGINT) AS source_hash, CASE CAST(l_partkey % 7 AS INT) WHEN 0 THEN 'RV' WHEN 1 THEN 'GIR' WHEN 2 THEN 'UNKNOWN' WHEN 3 THEN 'PSS' WHEN 4 THEN 'LC' ELSE 'EBI' END AS document_code, CAST(l_quantity AS DOUBLE) / 50 AS confidence, CASE WHEN l_returnflag = 'A' THEN 'cache' WHEN l_returnflag = 'R' THEN 'rules' ELSE 'heuristic' END AS route_source,
        CAST(CASE WHEN l_linenumber > 5 THEN NULL ELSE year(l_shipdate) END AS INT) AS target_year, CAST(CASE WHEN l_linenumber > 5 THEN NULL ELSE month(l_shipdate) END AS INT) AS target_month, CAST(l_partkey % 14 AS INT) AS folder_number FROM lineitem""",
    "bundle_months": """SELECT DISTINCT CAST(o_custkey % 20 AS INT) AS company_id, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, CASE CAST((o_custkey % 20 * 7 + year(o_orderdate) + month(o_orderdate)) % 4 AS INT) WHEN 0 THEN 'approved' WHEN 1 THEN 'generated' WHEN 2 THEN 'current' ELSE 'blocked' END AS status FROM orders WHERE o_orderkey % 5 = 0 AND o_custkey % 3 = 0""",
    "corrections": """SELECT o_orderstatus AS from_code, o_orderpriority AS to_code FROM orders""",
}

#: Inputs that Spark spells in another way: integer division is `div` there.
SPARK_VIEWS = {
    "page_items": _page_items("SELECT conv_id, turn, word, seq FROM conversations LATERAL VIEW posexplode(split(text, ' ')) AS seq, word").replace("//", "div"),
    "page_sizes": VIEWS["page_sizes"].replace("//", "div"),
    "document_programs": VIEWS["document_programs"].replace("//", "div"),
}

TABLES = {"bundle_months": "orders", "page_items": "conversations", "page_sizes": "conversations", "document_programs": "conversations", "workspace_rows": "supplier", "employees": "lineitem", "folder_states": "lineitem", "cache_rows": "part", "route_rows": "lineitem", "page_texts": "conversations", "doc_inputs": "documents", "batch_documents": "lineitem", "provider_calls": "events", "uploads": "orders", "approved_documents": "lineitem", "reference_pages": "conversations", "snapshot_files": "events", "corrections": "orders", "folder_status": "lineitem", "decisions": "lineitem", "reviews": "orders", "signals": "events"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input of the operators, or one of the given tables."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    source = spark.read.parquet(f"{sf_dir}/{TABLES[name]}.parquet")
    if name == "doc_inputs" and source.rdd.getNumPartitions() < 2 * (cores := spark.sparkContext.defaultParallelism):
        source = source.repartition(cores)  # a table of so few splits is small, and they may lie in one row group; a large one is read as it lies
    return spark.sql(SPARK_VIEWS.get(name, VIEWS[name]).replace(f"FROM {TABLES[name]}", "FROM {source}"), source=source)


def with_inputs(sql: str, *names: str) -> str:
    """The checking engine's query: the inputs as common tables, then `sql`."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + (", " + sql[5:] if sql.startswith("WITH ") else " " + sql)
