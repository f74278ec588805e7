"""Rule tables: fixed values that carry the document rules, in their order."""

from __future__ import annotations

# Evidence folders (number, code, label).
FOLDERS = (
    (1, "RV", "Recibos de Vencimento"),
    (2, "LC", "Lançamentos Contabilísticos"),
    (3, "TV", "Transferências de Vencimento"),
    (4, "EBV", "Extratos Bancários de Vencimento"),
    (5, "TSA", "Transferências de Subsídio de Alimentação"),
    (6, "EBSA", "Extratos Bancários de Subsídio de Alimentação"),
    (7, "SSR", "DMR Segurança Social — Resumo"),
    (8, "SSD", "DMR Segurança Social — Detalhe"),
    (9, "GIR", "Guias de IRS"),
    (10, "LIR", "Listagens de IRS"),
    (11, "PSS", "Pagamentos de Segurança Social"),
    (12, "PIR", "Pagamentos de IRS"),
    (13, "EBI", "Extratos Bancários de Impostos"),
)
FOLDER_OF = {code: number for number, code, _ in FOLDERS}

# Month names and the forms they are cut to.
MONTH_NAMES = {
    1: ("janeiro", "jan"),
    2: ("fevereiro", "fev"),
    3: ("marco", "marc", "mar"),
    4: ("abril", "abr"),
    5: ("maio", "mai"),
    6: ("junho", "junh", "jun"),
    7: ("julho", "jul"),
    8: ("agosto", "ago"),
    9: ("setembro", "setem", "set"),
    10: ("outubro", "outub", "out"),
    11: ("novembro", "novem", "nov"),
    12: ("dezembro", "dezem", "dez"),
}

# Terms that hint at a folder, by code.
FOLDER_HINTS = {
    "LC": ("lc", "lancamento", "lancamentos", "contabil", "contabilidade", "diario", "razao", "movimentos contabilisticos", "mapa contabilistico"),
    "TV": ("tv", "transf venc", "transf vencimento", "transferencia vencimento", "transferencias vencimento", "transferencia salarios", "pagamento salarios", "salario", "ordenado", "vencimentos"),
    "EBV": ("ebv", "extrato vencimento", "extracto vencimento", "extrato salario", "extracto salario", "banco vencimento", "movimento vencimento", "debito salarios"),
    "TSA": ("tsa", "transf sa", "transferencia subsidio alimentacao", "subsidio alimentacao", "subs alimentacao", "cartao refeicao", "refeicao", "edenred", "coverflex"),
    "EBSA": ("ebsa", "extrato subsidio alimentacao", "extracto subsidio alimentacao", "extrato refeicao", "extracto refeicao", "movimento refeicao"),
    "SSR": ("ssr", "dmr resumo", "declaracao mensal remuneracoes resumo", "seguranca social resumo", "resumo ss", "resumo dmr", "recapitulativo seguranca social"),
    "SSD": ("ssd", "dmr detalhe", "declaracao mensal remuneracoes detalhe", "seguranca social detalhe", "detalhe ss", "detalhe dmr", "trabalhadores", "remuneracoes trabalhador"),
    "GIR": ("gir", "guia irs", "guia pagamento irs", "guia retencao", "duc irs", "documento unico cobranca irs", "retencao fonte guia"),
    "LIR": ("lir", "listagem irs", "lista irs", "relacao irs", "retencoes fonte", "mapa retencoes", "listagem retencoes", "mapa liquidacao irs", "mapa de liquidacao de irs", "liquidacao de irs"),
    "PSS": ("pss", "pagamento seguranca social", "pagamento ss", "comprovativo seguranca social", "comprovativo ss", "taxa social unica", "pagamento tsu", "tsu", "du documentos pagamento ss"),
    "PIR": ("pir", "pagamento irs", "comprovativo irs", "comprovativo pagamento irs", "pagamento at", "autoridade tributaria pagamento", "portal financas pagamento", "multi imposto", "pagamentos ao estado", "referencia para pagamento"),
    "EBI": ("ebi", "extrato impostos", "extracto impostos", "extrato irs", "extracto irs", "extrato seguranca social", "extracto seguranca social", "banco impostos", "movimento impostos", "extrato conta ordem", "extracto conta ordem"),
}

# Patterns of each code (strong, weak, negative).
PATTERNS = {
    "LC": ((r"lancamento[s]? contabil", r"diario contabil", r"movimentos contabilisticos", r"contabilidade"), (r"lancamento", r"contabil", r"balancete"), ()),
    "TV": (
        (r"transferencia[s]?.{0,40}(vencimento|salario|ordenado|remunerac)", r"(vencimento|salario|ordenado).{0,40}transferencia"),
        (r"transferencia", r"salario", r"ordenado", r"vencimento"),
        (r"subsidio.{0,20}alimentacao", r"extrato bancario"),
    ),
    "EBV": (
        (r"extrato bancario.{0,80}(vencimento|salario|ordenado|remunerac)", r"(vencimento|salario|ordenado).{0,80}extrato bancario"),
        (r"extrato", r"banco", r"movimento bancario", r"vencimento"),
        (r"subsidio.{0,20}alimentacao", r"seguranca social", r"\birs\b"),
    ),
    "TSA": (
        (r"transferencia[s]?.{0,50}subsidio.{0,20}alimentacao", r"subsidio.{0,20}alimentacao.{0,50}transferencia"),
        (r"subsidio.{0,20}alimentacao", r"cartao refeicao", r"meal allowance", r"transferencia"),
        (r"extrato bancario",),
    ),
    "EBSA": (
        (r"extrato bancario.{0,80}subsidio.{0,20}alimentacao", r"subsidio.{0,20}alimentacao.{0,80}extrato bancario"),
        (r"extrato", r"banco", r"subsidio.{0,20}alimentacao", r"cartao refeicao"),
        (),
    ),
    "SSR": (
        (r"declaracao mensal de remuneracoes.{0,80}resumo", r"\bdmr\b.{0,40}resumo", r"seguranca social.{0,60}resumo", r"entrega de ficheiro de remuneracoes.{0,80}extrato de resumo", r"extrato de resumo.{0,160}total de remuneracoes"),
        (r"\bdmr\b", r"declaracao mensal de remuneracoes", r"seguranca social", r"extrato de resumo", r"total de contribuicoes"),
        (r"detalhe", r"trabalhador"),
    ),
    "SSD": (
        (r"declaracao mensal de remuneracoes.{0,80}(detalhe|trabalhador)", r"\bdmr\b.{0,40}(detalhe|trabalhador)", r"seguranca social.{0,60}(detalhe|trabalhador)"),
        (r"\bdmr\b", r"declaracao mensal de remuneracoes", r"remuneracoes trabalhador", r"seguranca social"),
        (),
    ),
    "GIR": (
        (r"guia.{0,40}\birs\b", r"documento unico de cobranca.{0,80}\birs\b", r"retencoes? na fonte.{0,60}guia"),
        (r"\birs\b", r"retencoes? na fonte", r"guia", r"autoridade tributaria"),
        (r"listagem", r"relacao"),
    ),
    "LIR": (
        (r"listagem.{0,40}\birs\b", r"\birs\b.{0,40}listagem", r"relacao.{0,40}retencoes? na fonte", r"mapa de liquidacao de irs", r"liquidacao de irs.{0,120}(funcionario|valor coletavel|liquidado)"),
        (r"\birs\b", r"retencoes? na fonte", r"listagem", r"relacao", r"liquidacao", r"valor coletavel", r"liquidado"),
        (),
    ),
    "PSS": (
        (r"pagamento.{0,60}seguranca social", r"comprovativo.{0,60}seguranca social", r"seg social.{0,60}pagamento", r"dados da operacao.{0,220}pagamento tsu", r"descricao.{0,40}pagamento tsu"),
        (r"pagamento", r"comprovativo", r"seguranca social", r"tsu", r"pagamento tsu"),
        (),
    ),
    "PIR": (
        (r"pagamento.{0,60}\birs\b", r"comprovativo.{0,60}\birs\b", r"\birs\b.{0,60}pagamento", r"referencia para pagamento.{0,160}\birs\b", r"pagamentos ao estado.{0,120}(referencia|linha otica|irs)", r"dados da operacao.{0,220}multi imposto", r"descricao.{0,40}multi imposto"),
        (r"pagamento", r"comprovativo", r"\birs\b", r"autoridade tributaria", r"multi imposto", r"pagamentos ao estado", r"referencia para pagamento"),
        (r"listagem", r"guia"),
    ),
    "EBI": (
        (
            r"extrato bancario.{0,160}(\birs\b|seguranca social|autoridade tributaria|imposto|pagamento tsu|multi imposto)",
            r"(\birs\b|seguranca social|autoridade tributaria|imposto|pagamento tsu|multi imposto).{0,160}extrato bancario",
            r"(extrato|extracto).{0,160}(periodo|data mov|saldo contabil).{0,260}(multi imposto|pagamento tsu|autoridade tributaria|seguranca social|\birs\b)",
            r"consultar saldos e movimentos.{0,160}data mov.{0,260}(multi imposto|pagamento tsu)",
        ),
        (r"extrato", r"extracto", r"banco", r"\birs\b", r"seguranca social", r"imposto", r"autoridade tributaria", r"multi imposto", r"pagamento tsu", r"saldo contabilistico"),
        (),
    ),
}

# Layers of the funnel, in order.
FUNNEL_LAYERS = ("input", "cache", "learned_sections", "filename_taxonomy", "pdf_text_layout", "period_gate", "confidence_gate", "cluster_bucket")

# Groups of codes that compete with each other.
COMPETITORS = (("TV", "EBV", "TSA", "EBSA", "EBI"), ("SSR", "SSD", "PSS"), ("GIR", "LIR", "PIR"), ("RV", "LC"))

# Terms that learned terms are not scored by (besides an owner's own name, which is a parameter), and stop words of learning.
GENERIC_TERMS = ("eur", "lda", "pagina", "page", "total", "valor", "data", "conta", "nome", "nif")
LEARNING_STOP = ("para", "com", "por", "dos", "das", "uma", "sem", "mes", "ano", "pagina", "total", "valor", "data", "numero", "nome", "que", "nos", "nao", "este", "essa", "outro", "outra", "ser", "ter", "foi", "mais", "sobre")

# Further terms of a folder on a page, by code.
PAGE_TERMS = {
    "RV": ("recibo vencimento", "folha vencimento", "payslip", "remuneracao"),
    "LC": ("lancamento contabilistico", "contabilidade", "diario"),
    "TV": ("transferencia vencimento", "transferencias vencimento", "salario", "ordenado"),
    "EBV": ("extrato vencimento", "extrato salario", "banco vencimento"),
    "TSA": ("transferencia subsidio alimentacao", "subsidio alimentacao", "refeicao"),
    "EBSA": ("extrato subsidio alimentacao", "extrato refeicao"),
    "SSR": ("dmr resumo", "seguranca social resumo", "resumo dmr"),
    "SSD": ("dmr detalhe", "seguranca social detalhe", "detalhe dmr", "trabalhador"),
    "GIR": ("guia irs", "documento unico cobranca", "duc irs"),
    "LIR": ("listagem irs", "relacao irs", "retencoes fonte"),
    "PSS": ("pagamento seguranca social", "pagamento ss", "taxa social unica"),
    "PIR": ("pagamento irs", "autoridade tributaria pagamento"),
    "EBI": ("extrato impostos", "extrato irs", "extrato seguranca social", "autoridade tributaria", "pagamento ao estado"),
}

# Patterns of a folder on a page (pattern, weight, label), by code.
PAGE_PATTERNS = {
    "RV": ((r"recibo de vencimento", 1.4, "recibo de vencimento"), (r"data de processamento.*entidade patronal.*empregado", 1.0, "payroll receipt layout")),
    "LC": ((r"extracto de contas|extrato de contas", 1.3, "extracto de contas"), (r"centro custo.*conta.*datas", 0.9, "accounting cost-center layout"), (r"int salarios processamento|processamento 901", 0.7, "salary accounting posting")),
    "TV": ((r"comprovativo de operacao.*transferencia|dados da operacao.*conta destino", 1.2, "bank transfer proof"), (r"n[oº]? de transferencia|transferencia.*venc|descricao venc", 0.9, "salary transfer signal")),
    "EBV": ((r"extrato ?d ?o|extracto ?d ?o", 0.16, "bank statement layout"), (r"periodo.*data ?mov.*data ?valor", 0.16, "bank statement movement table"), (r"venc|salario|ordenado|trfdehoraindustria|trf de hora industria", 0.9, "salary movement in bank statement")),
    "TSA": ((r"carregamento de cartoes pre pagos|cartao caixa break", 1.3, "meal card loading proof"), (r"subsidio de refeicao|subsidio alimentacao|conta cartao", 1.0, "meal allowance card signal")),
    "EBSA": ((r"extrato ?d ?o|extracto ?d ?o", 0.16, "bank statement layout"), (r"refeicao|subsidio alimentacao|cartao", 0.9, "meal allowance bank movement")),
    "SSR": ((r"entrega de declaracao de remuneracoes.*extrato de resumo", 1.5, "DMR summary header"), (r"total de remuneracoes.*total de contribuicoes", 0.9, "DMR totals")),
    "SSD": ((r"extracto da declaracao de remuneracoes|extrato da declaracao de remuneracoes", 1.3, "DMR detail header"), (r"nome do trabalhador.*ano mes ref.*dias.*valor", 1.0, "DMR worker detail table")),
    "GIR": ((r"identificacao do sujeito passivo.*importancia a pagar", 1.2, "IRS guide/payment document"), (r"referencia.*certificacao do pagamento|documento unico de cobranca", 0.9, "tax guide reference")),
    "LIR": ((r"mapa de liquidacao de irs|liquidacao de irs", 1.4, "IRS liquidation map"), (r"funcionario.*n[oº]?contribuinte.*liquidado", 1.0, "IRS employee list table")),
    "PSS": ((r"pagamento.*seguranca social|comprovativo.*seguranca social|taxa social unica", 1.2, "social security payment proof"),),
    "PIR": ((r"pagamento.*irs|comprovativo.*irs|autoridade tributaria.*pagamento", 1.2, "IRS payment proof"),),
    "EBI": ((r"extrato ?d ?o|extracto ?d ?o", 0.16, "bank statement layout"), (r"autoridade tributaria|seguranca social|irs|pagamento ao estado|pagamento estado", 0.9, "tax/social-security bank movement")),
}
# What a page shows that goes on, or that is only a bank statement.
CONTINUATION = r"continua|continuacao|transporte|pag\s*[0-9]+\s*/\s*[0-9]+|pag[0-9]+/[0-9]+|pag\.\s*[0-9]+"
BANK_PAGE = r"extrato ?d ?o|extracto ?d ?o|datamov|data mov|saldo contabilistico|saldo contabil"
# Marker of a folder's number on a page, and weights of a page's score.
PAGE_NUMBER_MARKER = r"(?:pasta|folder|grupo|sec(?:c|ç)ao|section)\s*0?{0}\b"
PAGE_SCORE = {"number": 0.6, "code": 0.45, "phrase": 0.35, "term": 0.16, "least": 0.42}
# Labels of a page that follows another, and stop words of sample tokens.
BANK_AFTER_TAX, PAGE_GOES_ON = ("bank statement after tax/IRS section", "sequence/order inference"), "continuation page"
SAMPLE_STOP = ("para", "com", "por", "dos", "das", "uma", "sem", "mes", "ano")
