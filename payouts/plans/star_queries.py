"""Named queries: every operator over whole tables of the star schema.

Each query takes (spark, folder) and returns a frame with plain columns: dates as ISO text,
totals rounded to cents.
"""

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from payouts import functions as fn
from payouts import schemas as S
from payouts.operators import audit as A
from payouts.operators import eligibility as E
from payouts.operators import extract as X
from payouts.operators import history as H
from payouts.operators import reconcile as C
from payouts.operators import reports as R
from payouts.operators import rules as U
from payouts.operators import selection as L
from payouts.operators import shape as P
from payouts.operators.joins import first_per_key
from payouts.plans.posting import approved_sheet_rows, audit_upload, file_periods, payment_rows, post_exclusions, post_payments
from payouts.plans.report_pack import report_pack
from payouts.plans.settlement import machine_settlement, paid_history_bucketed, settlement_after_posting
from payouts.sources import ledger as G
from payouts.sources import sheets as H5
from payouts.sources.stage import shared_path, stage
from payouts.sources.star import Star, kept
from payouts.sources.tables import normalize_source

# The widest window, so that the extraction covers the whole tables; reports name a period.
START, END = date(1990, 1, 1), date(2030, 12, 31)
PERIOD_START, PERIOD_END = date(1996, 3, 16), date(1996, 4, 15)
LABEL, YEAR, MONTH = "Abril/1996", 1996, 3
SENTINEL = "BRAND#12"
COORDINATOR = "COORDINATOR"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


class Frames:
    """The derived inputs of the queries, all lazy."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.star = Star(spark, folder)

    @kept
    def base(self) -> DataFrame:
        return X.machine_base(self.star.machine_sources(), START, END)

    # Rule tables are stored tables, as users keep theirs: joins are planned by their size, not by that of the
    # tables they are made from.

    @kept
    def fat_rules(self) -> DataFrame:
        return stage(self.star.fat_rates(), "fat_rates")

    @kept
    def margin_rules(self) -> DataFrame:
        return stage(self.star.margin_rates(), "margin_rates")

    @kept
    def fat(self) -> DataFrame:
        return U.latest_fat_rates(self.fat_rules())

    @kept
    def margin(self) -> DataFrame:
        return U.latest_margin_rates(self.margin_rules())

    @kept
    def managers(self) -> DataFrame:
        return U.latest_managers(stage(self.star.manager_relations(), "manager_relations"))

    @kept
    def calculated(self, base: DataFrame | None = None) -> DataFrame:
        return U.commission_rules(self.base() if base is None else base, self.fat(), self.margin())

    @kept
    def managed(self) -> DataFrame:
        return U.manager_commission(self.calculated(), self.managers())

    @kept
    def paid(self) -> DataFrame:
        return H.paid_summary(self.star.paid_ledger())

    @kept
    def excluded(self) -> DataFrame:
        return H.excluded_summary(self.star.excluded_ledger())

    def settlement(self, default_rate: bool = True) -> tuple[DataFrame, DataFrame]:
        """Settlement of an extraction kept as a table, as users keep theirs."""
        base, paid = stage(self.base(), "machine_base"), stage(self.paid(), "paid_summary")
        return machine_settlement(
            base, self.fat(), self.margin(), paid, self.managers(), self.excluded(), default_rate
        )

    def eligibility(self, rows: DataFrame | None = None) -> DataFrame:
        s = self.star
        rows = stage(self.calculated().select(*E.ROW_COLUMNS), "calculated") if rows is None else rows
        return E.payment_eligibility(rows, s.incentives(), s.receivables(), s.invoices())

    def audit(self) -> tuple[DataFrame, DataFrame]:
        """(sheets, extraction), both as tables; the extraction with the columns that sheets and checks are made of."""
        base = stage(self.base().select(*A.EXTRACTION_COLUMNS), "machine_base")
        sheets = stage(self.star.audit_sheets(self.calculated(base)), "sheets")
        return sheets, base

    def issues(self) -> tuple[DataFrame, DataFrame]:
        sheets, base = self.audit()
        return sheets, A.paid_sheet_audit(sheets, self.fat(), self.margin(), base, SENTINEL)


def query(build: Callable[[Frames], DataFrame]) -> Callable[[Frames], DataFrame]:
    QUERIES[build.__name__] = lambda spark, folder: plain(build(Frames(spark, folder)))
    return build


def plain(df: DataFrame) -> DataFrame:
    """Dates and times as text, decimals as DOUBLE."""
    changes = {}
    for f in df.schema:
        if isinstance(f.dataType, (T.DateType, T.TimestampType)):
            changes[f.name] = F.col(f.name).cast("date").cast("string")
        elif isinstance(f.dataType, T.DecimalType):
            changes[f.name] = F.col(f.name).cast("double")
    return df.withColumns(changes) if changes else df


def cents(df: DataFrame, *names: str, digits: int = 2) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def line_text() -> dict[str, Column]:
    """Texts made from line items for the parsing functions."""
    price, key = F.col("l_extendedprice"), F.col("l_orderkey")
    money = fn.format_currency_br(price * 4.0)
    number = F.when(key % 4 == 0, money).when(key % 4 == 1, F.concat(F.col("l_partkey").cast("string"), F.lit("%"))).when(
        key % 4 == 2, F.concat(F.lit(" "), F.col("l_quantity").cast("int").cast("string"), F.lit(",5 "))
    ).otherwise("n/d")
    return {"row_id": Star.row_id(), "texto": number}


# Scans -------------------------------------------------------------------------------


@query
def scan_source(x: Frames) -> DataFrame:
    names = {v: k for k, v in S.SOURCE_COLUMNS["billing"].items()}
    return normalize_source(x.star.billing(typed=False).withColumnsRenamed(names), "billing")


@query
def ledger_by_competence(x: Frames) -> DataFrame:
    return G.ledger_by_competence(x.star.paid_ledger(), YEAR, MONTH)


@query
def ledger_by_label(x: Frames) -> DataFrame:
    return G.ledger_by_label(x.star.paid_ledger(), LABEL)


@query
def ledger_period_labels(x: Frames) -> DataFrame:
    return G.ledger_period_labels(x.star.paid_ledger())


def _workbook_files(x: Frames) -> str:
    """The sheets as users keep them: one workbook per branch, sheet "Analitico CEN", header in row 24."""
    sheets, _ = x.audit()
    path = shared_path(x.spark, "workbooks")
    labelled = P.display_labels(sheets.drop("arquivo", "linha", "colunas"))
    G.export_report(labelled, path, "xlsx", partition_by=S.LABELS["filial"], sheet=H5.REPORT_SHEET, header_row=H5.REPORT_HEADER_ROW)
    return path


@query
def ingest_report_sheets(x: Frames) -> DataFrame:
    rows, _ = H5.ingest_report_sheets(x.spark, _workbook_files(x))
    return rows.select("filial", "modelo", "nro_chassi", "nro_documento",
                       fn.parse_br_number(F.col("receita_bruta")).alias("receita_bruta"),
                       F.col("valor_comissao_total").cast("double").alias("valor_comissao_total"))


@query
def ingest_flat_sheets(x: Frames) -> DataFrame:
    path = shared_path(x.spark, "rates")
    upload = x.star.table("part").select(
        F.col("p_brand").alias("Modelo"), F.concat(F.col("p_size").cast("string"), F.lit(",5%")).alias("% Comissão Fat."))
    G.export_report(upload, path)
    aliases = {"modelo": S.MODEL_ALIASES, "percentual": S.FAT_PERCENT_ALIASES}
    rows, _ = H5.ingest_flat_sheets(x.spark, path, aliases)
    return P.prepare_fat_rates(rows).select("modelo", "percentual", "ativo")


# Sinks -------------------------------------------------------------------------------


def _period() -> dict[str, Column]:
    return G.period_columns(YEAR, MONTH, LABEL, PERIOD_START, PERIOD_END, "manual")


def _written(x: Frames, path: str) -> DataFrame:
    """What a ledger holds, without the posting time."""
    return G.read_ledger(x.spark, path).drop("paid_at")


@query
def prepare_ledger_rows(x: Frames) -> DataFrame:
    return G.prepare_ledger_rows(x.managed(), _period())


@query
def append_paid_ledger(x: Frames) -> DataFrame:
    path = shared_path(x.spark, "paid")
    G.append_paid_ledger(x.managed(), path, _period())
    return _written(x, path).groupBy("competencia_ano", "competencia_mes", "filial", "tipo").agg(
        F.count(F.lit(1)).alias("linhas"), fn.money_sum(F.col("receita_bruta")).alias("receita_bruta")
    )


@query
def append_excluded_ledger(x: Frames) -> DataFrame:
    path = shared_path(x.spark, "excluded")
    rows = L.selected_rows(x.base(), x.star.selection(), "excluir")
    G.append_excluded_ledger(rows, path, _period())
    return _written(x, path).groupBy("filial", "tipo").agg(F.count(F.lit(1)).alias("linhas"))


@query
def write_incentive_titles(x: Frames) -> DataFrame:
    path = shared_path(x.spark, "titles")
    titles = X.incentive_titles(x.star.incentives(), x.star.receivables())
    G.write_incentive_titles(titles, path)
    return x.spark.read.parquet(path)


def _rate_log(x: Frames, *ops: str) -> DataFrame:
    path = shared_path(x.spark, "rates")
    parts = x.star.table("part")
    for batch, op in enumerate(ops, start=1):
        upload = parts.groupBy(F.col("p_brand").alias("Modelo")).agg(
            (F.avg("p_size").cast("int") + batch).cast("double").alias("Percentual"))
        G.append_rules(P.prepare_fat_rates(upload), path, "fat", op, batch)
    return G.rules_with_state(x.spark, path, "fat").select("batch_id", "modelo", "percentual", "ativo")


@query
def rates_save_all(x: Frames) -> DataFrame:
    return _rate_log(x, "append", "reset")


@query
def rates_append(x: Frames) -> DataFrame:
    return _rate_log(x, "append", "append")


@query
def rates_replace_active(x: Frames) -> DataFrame:
    return _rate_log(x, "append", "replace")


@query
def managers_replace_active(x: Frames) -> DataFrame:
    path = shared_path(x.spark, "managers")
    prepared = P.prepare_manager_relations(x.star.manager_relations())
    for batch in (1, 2):
        G.append_rules(prepared, path, "manager", "replace", batch)
    return G.rules_in_force(x.spark, path, "manager").select(
        "batch_id", "filial", "gerente", "cod_vendedor", "vendedor", "percentual_comissao_gerente")


@query
def export_report(x: Frames) -> DataFrame:
    path = shared_path(x.spark, "export")
    report = R.branch_analytic(x.star.paid_ledger(), LABEL)
    G.export_report(report, path, "parquet", partition_by="filial")
    return x.spark.read.parquet(path).select(*S.ANALYTIC_COLUMNS)


# Scalar functions --------------------------------------------------------------------


def _lines(x: Frames, *columns: Column) -> DataFrame:
    text = line_text()
    rows = x.star.table("lineitem").withColumns(text)
    return rows.select("row_id", *columns)


@query
def norm_key(x: Frames) -> DataFrame:
    return x.star.lines().select("row_id", fn.norm_key(F.col("chassi")).alias("chave"))


@query
def fold_text(x: Frames) -> DataFrame:
    return x.star.paid_ledger().groupBy(
        fn.fold_text(F.col("gerente")).alias("gerente"), fn.fold_text(F.col("classificacao_venda")).alias("classe")
    ).agg(F.count(F.lit(1)).alias("linhas"))


@query
def norm_document(x: Frames) -> DataFrame:
    note = F.concat(F.col("nota_fiscal_numero"), F.lit(".0"))
    return x.star.billing().select(
        "row_id", fn.norm_document(note).alias("documento"), fn.norm_document(F.col("produto_codigo")).alias("produto"))


@query
def pad_document(x: Frames) -> DataFrame:
    return x.star.billing().select(
        "row_id", fn.pad_document(F.col("nota_fiscal_numero")).alias("documento"),
        fn.pad_document(F.col("produto_codigo")).alias("produto"))


@query
def parse_date_br(x: Frames) -> DataFrame:
    day = F.col("l_shipdate").cast("date")
    text = F.when(F.col("l_linenumber") == 1, F.date_format(day, "d/M/yyyy")).when(
        F.col("l_linenumber") == 2, F.lit("31/02/2020")).otherwise(F.date_format(day, "dd/MM/yyyy"))
    return _lines(x, fn.parse_date_br(text).alias("dia"))


@query
def is_blank_key(x: Frames) -> DataFrame:
    key = F.when(F.col("l_linenumber") == 1, " - ").when(F.col("l_linenumber") == 2, "NaN").when(
        F.col("l_linenumber") == 4, F.lit(None).cast("string")).otherwise(F.col("l_partkey").cast("string"))
    return _lines(x, fn.is_blank_key(key).alias("vazio"))


@query
def blank_to_null(x: Frames) -> DataFrame:
    return x.star.lines().select("row_id", fn.blank_to_null(F.col("chassi")).alias("chassi"))


@query
def parse_br_number(x: Frames) -> DataFrame:
    return _lines(x, fn.parse_br_number(F.col("texto")).alias("numero"))


def _percents(parser) -> list[Column]:
    return [parser(F.col("texto"), True).alias("de_texto"), parser(F.col("l_discount") * 10.0, False).alias("de_numero"),
            parser(F.col("l_quantity"), False).alias("de_inteiro")]


@query
def parse_percent_points(x: Frames) -> DataFrame:
    return _lines(x, *_percents(fn.parse_percent_points))


@query
def parse_commission_points(x: Frames) -> DataFrame:
    return _lines(x, *_percents(fn.parse_commission_points))


@query
def parse_margin_points(x: Frames) -> DataFrame:
    return _lines(x, *_percents(fn.parse_margin_points))


@query
def rate_read_normalize(x: Frames) -> DataFrame:
    value = F.col("l_tax") * 12.5
    return _lines(x, fn.rate_read_percent(F.col("l_quantity")).alias("percentual"), fn.rate_read_target(value).alias("meta"))


@query
def format_currency_br(x: Frames) -> DataFrame:
    return _lines(x, fn.format_currency_br(F.col("l_extendedprice") * 40.0).alias("valor"))


@query
def format_percent_br(x: Frames) -> DataFrame:
    return _lines(x, fn.format_percent_br(F.col("l_discount") * 100.0).alias("valor"))


@query
def classify_sale(x: Frames) -> DataFrame:
    return x.star.vehicles().select(
        "chassi", fn.classify_sale(F.col("veiculo_categoria"), F.col("veiculo_estado")).alias("classe"))


@query
def gross_margin(x: Frames) -> DataFrame:
    sides = [x.star.billing(), x.star.returns()]
    margin = fn.gross_margin(F.col("valor_total"), F.col("valor_impostos"), F.col("valor_custo")).alias("margem")
    return sides[0].select("row_id", margin).unionByName(sides[1].select("row_id", margin))


@query
def net_revenue(x: Frames) -> DataFrame:
    total, tax = F.col("valor_total"), F.col("valor_impostos")
    sold = x.star.billing().select("row_id", fn.net_revenue(total, tax, F.col("valor_venda_liquida")).alias("liquida"))
    return sold.unionByName(x.star.returns().select("row_id", fn.net_revenue(total, tax).alias("liquida")))


@query
def margin_pct(x: Frames) -> DataFrame:
    margin = fn.gross_margin(F.col("valor_total"), F.col("valor_impostos"), F.col("valor_custo"))
    return x.star.billing().select("row_id", fn.margin_pct(margin, F.col("valor_venda_liquida")).alias("percentual"))


@query
def incentive_status(x: Frames) -> DataFrame:
    balance, missing = F.col("valor_saldo"), F.col("tipo_titulo") == ""
    return x.star.receivables().select(
        "titulo_numero", "tipo_titulo", "valor_saldo", fn.incentive_status(balance, missing).alias("status"),
        fn.incentive_detail(balance, missing).alias("detalhe"))


@query
def paid_status(x: Frames) -> DataFrame:
    status = fn.paid_status(
        F.col("qtd_lancamentos_pagos"), F.col("saldo_comissao_paga_chassi"), F.col("tem_pagamento_positivo"),
        F.col("tem_estorno_negativo"))
    return x.paid().select("nro_chassi", status.alias("status"))


@query
def combine_status(x: Frames) -> DataFrame:
    return x.eligibility().groupBy("v1_status", "v2_status", "status_geral").agg(F.count(F.lit(1)).alias("linhas"))


@query
def matches_rule(x: Frames) -> DataFrame:
    joined = A.audit_rule_join(x.base().select("row_id", "modelo", "perc_margem_bruta"),
                               A.allowed_fat_rates(x.fat_rules()), A.allowed_margin_rules(x.margin_rules()))
    close = fn.matches_rule(F.round(F.col("perc_margem_bruta") / 10, 2), F.col("percentuais_fat"))
    return joined.select("row_id", close.alias("confere"))


@query
def safe_float(x: Frames) -> DataFrame:
    value = F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).otherwise(F.col("l_extendedprice"))
    return _lines(x, fn.safe_float(value).alias("valor"))


@query
def commission_period(x: Frames) -> DataFrame:
    period = fn.commission_period(F.col("o_orderdate").cast("date"))
    return x.star.table("orders").select("o_orderkey", period.alias("p")).select("o_orderkey", "p.*")


@query
def period_of_date(x: Frames) -> DataFrame:
    return x.star.table("orders").select("o_orderkey", fn.period_of_date(F.col("o_orderdate").cast("date")).alias("base"))


@query
def period_options(x: Frames) -> DataFrame:
    # The options depend on the year alone, so each customer and year is spread out once.
    years = x.star.table("orders").select("o_custkey", F.trunc(F.col("o_orderdate").cast("date"), "year").alias("y")).distinct()
    options = years.select("o_custkey", F.explode(fn.period_options(F.col("y"))).alias("b")).distinct()
    return options.select("o_custkey", fn.commission_period(F.col("b"))["label"].alias("label"))


@query
def default_period(x: Frames) -> DataFrame:
    base = fn.default_period(F.col("o_orderdate").cast("date"))
    return x.star.table("orders").select("o_orderkey", fn.commission_period(base)["label"].alias("label"))


def _file_name() -> Column:
    day = F.date_format("o_orderdate", "dd-MM-yyyy")
    return F.when(F.col("o_orderkey") % 5 == 0, F.lit("sem data.xlsx")).otherwise(
        F.concat(F.lit("comissao "), F.regexp_replace(day, "-", "_"), F.lit(".xlsx")))


@query
def infer_period_label(x: Frames) -> DataFrame:
    known = [f"{name}/{year}" for year in (1996, 1997, 1998) for name in S.MONTH_NAMES]
    label = fn.infer_period_label(_file_name(), known, "Abril/1996")
    return x.star.table("orders").select("o_orderkey", label.alias("label"))


@query
def sanitize_label(x: Frames) -> DataFrame:
    raw = F.when(F.col("o_orderkey") % 7 == 0, "  ").otherwise(
        F.concat(F.lit(" a/b:c  "), F.col("o_orderpriority"), F.lit("? "), F.col("o_custkey").cast("string")))
    return x.star.table("orders").select("o_orderkey", fn.sanitize_label(raw).alias("label"))


# Projections and filters -------------------------------------------------------------


@query
def resolve_column(x: Frames) -> DataFrame:
    odd = x.star.table("part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias(" MoDeLo "))
    return odd.select("id", P.quoted(P.resolve_column(odd, S.MODEL_ALIASES)).alias("modelo"))


@query
def window_filter(x: Frames) -> DataFrame:
    rows = X.window_filter(x.star.billing(typed=False), PERIOD_START, PERIOD_END)
    return rows.select("row_id", "data_emissao", "valor_total")


@query
def exclude_product_code(x: Frames) -> DataFrame:
    return X.exclude_product_code(x.star.billing()).select("row_id", "produto_codigo")


def _rate_upload(x: Frames) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    percent = F.when(key % 2 == 0, F.concat(size.cast("string"), F.lit(",5%"))).otherwise(size.cast("string"))
    return x.star.table("part").select(
        F.when(key % 19 != 0, F.col("p_brand")).alias("modelo"), F.col("p_type").alias("GRUPO"),
        percent.alias("Percentual"), (size / 25.0).alias("Meta Margem"))


@query
def prepare_fat_rates(x: Frames) -> DataFrame:
    return P.prepare_fat_rates(_rate_upload(x))


@query
def prepare_margin_rates(x: Frames) -> DataFrame:
    return P.prepare_margin_rates(_rate_upload(x))


@query
def prepare_manager_relations(x: Frames) -> DataFrame:
    key = F.col("s_suppkey")
    upload = x.star.table("supplier").select(
        F.when(key % 6 != 0, F.concat(F.lit(" s"), key, F.lit(" "))).alias("Cod Vendedor"),
        F.when(key % 5 != 0, F.concat(F.lit(" M"), F.col("s_nationkey"))).alias("Gerente"),
        F.col("s_name").alias("Vendedor"), (key % 3 / 2.0).alias("% Comissão Gerente"))
    return P.prepare_manager_relations(upload).select(
        "gerente", "cod_vendedor", "vendedor", "percentual_comissao_gerente", "ativo")


@query
def calc_rate_table(x: Frames) -> DataFrame:
    rules = x.star.margin_rates().withColumn("row_seq", -F.col("updated_at").cast("bigint"))
    return U.calc_rate_table(rules, include_target=True)


@query
def report_relations(x: Frames) -> DataFrame:
    return R.report_relations(x.star.manager_relations()).select(
        F.col("_cod_vendedor").alias("cod"), F.col("_gerente").alias("gerente"), F.col("_vendedor").alias("vendedor"))


@query
def report_paid_rows(x: Frames) -> DataFrame:
    return R.report_paid_rows(x.star.paid_ledger(), LABEL).select(
        F.col("_cod_vendedor").alias("cod"), F.col("_classe").alias("classe"), "nro_documento",
        "receita_bruta", "valor_comissao_fat", "valor_comissao_margem", "valor_comissao_total")


def _labelled_sheet(x: Frames) -> DataFrame:
    branch = F.when(F.col("l_linenumber") == 1, "nan").when(F.col("l_linenumber") == 2, " ").otherwise(F.col("s_name"))
    return x.star.lines().select(
        branch.alias("Filial"), F.concat(F.lit(" "), F.col("p_brand")).alias("Modelo"), F.col("chassi").alias("Nro Chassi"),
        F.col("l_orderkey").cast("double").alias("Nro Documento"), F.col("l_discount").alias("% Comissão NF"))


@query
def normalize_report_columns(x: Frames) -> DataFrame:
    return P.normalize_report_columns(_labelled_sheet(x))


@query
def normalize_report_rows(x: Frames) -> DataFrame:
    return P.normalize_report_rows(_labelled_sheet(x))


@query
def analytic_projection(x: Frames) -> DataFrame:
    return P.analytic_projection(x.star.paid_ledger().drop("nome_cliente"))


@query
def display_format(x: Frames) -> DataFrame:
    rows = x.star.paid_ledger().select("tipo", "nro_documento", "receita_bruta", "valor_comissao_total", "perc_margem_bruta")
    return P.display_format(rows)


@query
def rule_listing(x: Frames) -> DataFrame:
    return P.rule_listing(x.star.margin_rates(), "margin")


@query
def result_filters(x: Frames) -> DataFrame:
    found = P.result_filters(
        x.eligibility(), statuses=[S.STATUS_NAO_APTO, S.STATUS_VERIFICAR], branches=["NATION_1", "NATION_2", "NATION_3"],
        v1_statuses=["N/A", "APTO"], pending_only=True)
    return found.select("row_id", "status_geral", "filial", "v1_status")


@query
def history_listing(x: Frames) -> DataFrame:
    return P.history_listing(x.settlement()[1])


@query
def validation_listing(x: Frames) -> DataFrame:
    rows = stage(x.calculated().select(*E.ROW_COLUMNS), "calculated")
    return E.validation_listing(stage(x.eligibility(rows), "eligibility"), rows)


# Joins -------------------------------------------------------------------------------


@query
def machine_base(x: Frames) -> DataFrame:
    return x.base()


@query
def incentive_titles(x: Frames) -> DataFrame:
    return X.incentive_titles(x.star.incentives(), x.star.receivables())


@query
def rate_lookup(x: Frames) -> DataFrame:
    found = U.rate_lookup(x.base(), x.fat(), x.margin())
    return found.select("row_id", "modelo", "perc_comissao_fat", "meta_margem", "perc_comissao_margem",
                        "regra_fat_encontrada", "regra_margem_encontrada")


@query
def manager_lookup(x: Frames) -> DataFrame:
    return U.manager_lookup(x.base(), x.managers()).select("row_id", "cod_vendedor", "gerente", "perc_comissao_gerente")


@query
def paid_history_join(x: Frames) -> DataFrame:
    return H.paid_history_join(x.base().select("row_id", "nro_chassi"), x.paid())


@query
def paid_history_join_bucketed(x: Frames) -> DataFrame:
    buckets = int(x.spark.conf.get("spark.sql.shuffle.partitions"))
    return paid_history_bucketed(x.base().select("row_id", "nro_chassi"), x.paid(), buckets)


@query
def excluded_join(x: Frames) -> DataFrame:
    return H.excluded_join(x.base().select("row_id", "nro_chassi"), x.excluded())


@query
def open_candidates(x: Frames) -> DataFrame:
    full = H.paid_history(x.base().select("row_id", "nro_chassi"), x.paid(), x.excluded())
    return H.open_candidates(full).select("row_id", "nro_chassi", "status_confronto")


@query
def incentive_lookup(x: Frames) -> DataFrame:
    return E.incentive_lookup(x.star.incentives(), x.star.receivables())


def _requests(x: Frames) -> DataFrame:
    return x.base().select(
        fn.norm_document(F.col("nro_documento")).alias("documento"), F.col("data_emissao").alias("data")).distinct()


@query
def invoice_lookup(x: Frames) -> DataFrame:
    return E.invoice_lookup(_requests(x), x.star.invoices())


@query
def receivable_lookup(x: Frames) -> DataFrame:
    return cents(E.receivable_lookup(x.star.receivables()), "saldo")


@query
def extraction_key_check(x: Frames) -> DataFrame:
    sheets, base = x.audit()
    rows = A.audit_rows(sheets)
    return A.extraction_key_check(rows, A.extraction_keys(base)).select("arquivo", "linha", "nro_chassi", "nro_documento")


@query
def audit_rule_join(x: Frames) -> DataFrame:
    rows = x.base().select("row_id", "modelo")
    joined = A.audit_rule_join(rows, A.allowed_fat_rates(x.fat_rules()), A.allowed_margin_rules(x.margin_rules()))
    return joined.select("row_id", "modelo", F.size("percentuais_fat").alias("n_fat"),
                         F.size("percentuais_margem").alias("n_margem"), F.array_max("metas").alias("maior_meta"))


@query
def source_reconciliation(x: Frames) -> DataFrame:
    source = X.source_audit(x.star.billing(), x.star.returns(), START, END)
    found = C.source_reconciliation(source, C.extraction_totals(x.base()))
    return cents(found, "receita_bruta_sql", "receita_bruta_tabela", "diferenca_receita_bruta")


@query
def cen_base_join(x: Frames) -> DataFrame:
    """All valid sellers with what they earned in the period, nothing counted as zero."""
    return R.cen_report(x.star.paid_ledger(), x.managers(), LABEL).select(
        "cen", F.round("valor_comissao_total", 2).alias("valor_comissao_total"))


@query
def cen_pending(x: Frames) -> DataFrame:
    return R.cen_pending(x.star.paid_ledger(), x.managers(), LABEL)


@query
def selected_rows(x: Frames) -> DataFrame:
    marks = L.merge_selection(x.star.selection(), x.star.selection().where("pagar and excluir").withColumn("excluir", F.lit(False)))
    return L.marked_rows(x.base(), marks).where("pagar or excluir").select("row_id", "tipo", "filial", "pagar", "excluir")


@query
def confirmed_rows(x: Frames) -> DataFrame:
    review = L.pay_review(L.selected_rows(x.base(), x.star.selection()))
    edits = x.star.table("lineitem").select(line_text()["row_id"].alias("row_id"), (F.col("l_linenumber") != 1).alias("confirmar"))
    return L.confirmed_rows(review, edits).select("row_id", "tipo", "receita_bruta")


def _key_checks(x: Frames) -> DataFrame:
    return E.key_match_check(x.base(), x.star.incentives(), x.star.invoices())


@query
def key_match_check(x: Frames) -> DataFrame:
    return _key_checks(x)


# Aggregations ------------------------------------------------------------------------


@query
def incentive_by_title(x: Frames) -> DataFrame:
    return X.incentive_by_title(x.star.incentives())


@query
def incentive_by_chassis(x: Frames) -> DataFrame:
    return X.incentive_by_chassis(x.star.incentives())


@query
def receivable_by_title(x: Frames) -> DataFrame:
    return cents(X.receivable_by_title(x.star.receivables()), "saldo")


@query
def dimension_dedup(x: Frames) -> DataFrame:
    return X.dimension_dedup(
        x.star.lines(), "chassi", ["p_brand", "p_type", "s_name"], "chassi_chave")


@query
def incentive_summary(x: Frames) -> DataFrame:
    return X.incentive_summary(x.star.incentives(), x.star.receivables())


@query
def source_audit(x: Frames) -> DataFrame:
    return cents(X.source_audit(x.star.billing(), x.star.returns(), START, END), "receita_bruta")


@query
def incentive_audit(x: Frames) -> DataFrame:
    found = X.incentive_audit(x.star.billing(), x.star.returns(), x.star.incentives(), START, END)
    return cents(found, "valor_incentivo", "valor_com_titulo", "valor_sem_titulo")


@query
def paid_summary(x: Frames) -> DataFrame:
    return cents(x.paid(), "valor_pago_positivo", "valor_estornado_negativo", "saldo_comissao_paga_chassi")


@query
def paid_summary_state(x: Frames) -> DataFrame:
    """paid_summary kept as stored state: the ledger is written by competence, the state of every competence but the
    newest is stored, then the newest is refreshed alone (its step reads one ledger part), and the state is merged."""
    spark, keys = x.spark, H.STATE_KEYS
    ledger_path, state_path = shared_path(spark, "paid_ledger"), shared_path(spark, "paid_state")
    x.star.paid_ledger().write.partitionBy(*keys).parquet(ledger_path)
    ledger = spark.read.parquet(ledger_path)
    months = ledger.select(*keys).distinct()
    newest = months.orderBy(*[F.col(k).desc() for k in keys]).first()
    older = ledger.where(~((F.col(keys[0]) == newest[0]) & (F.col(keys[1]) == newest[1])))
    G.refresh_state(older, state_path, H.paid_state)
    G.refresh_state(ledger, state_path, H.paid_state, [(newest[0], newest[1])])
    merged = H.merge_paid_state(spark.read.parquet(state_path))
    return cents(merged, "valor_pago_positivo", "valor_estornado_negativo", "saldo_comissao_paga_chassi")


@query
def excluded_summary(x: Frames) -> DataFrame:
    return x.excluded()


@query
def receivable_summary(x: Frames) -> DataFrame:
    return cents(E.receivable_summary(x.star.receivables()), "saldo_total")


@query
def receivable_by_type(x: Frames) -> DataFrame:
    return cents(E.receivable_by_type(x.star.receivables()), "saldo")


_CEN_MONEY = ("comissao_faturamento", "venda_direta", "comissao_usados", "comissao_implementos",
              "comissao_invasao_area", "comissao_margem", "valor_comissao_total")


@query
def cen_report(x: Frames) -> DataFrame:
    return cents(R.cen_report(x.star.paid_ledger(), x.managers(), LABEL), *_CEN_MONEY)


def _manager_view(report: DataFrame) -> DataFrame:
    shown = cents(report, "receita_bruta", "margem_incentivos_rs", "comissao_total_cen")
    return cents(cents(shown, "perc_margem_bruta", digits=6), "comissao_gerente", digits=4)


@query
def manager_report(x: Frames) -> DataFrame:
    return _manager_view(R.manager_report(x.star.paid_ledger(), LABEL))


@query
def coordinator_report(x: Frames) -> DataFrame:
    report = R.coordinator_report(x.star.paid_ledger(), LABEL, COORDINATOR)
    names = ("receita_bruta", "margem_incentivos_rs", "valor_comissao_fat", "valor_comissao_margem", "valor_total_comissao")
    return cents(cents(report, *names), "perc_mb_realizado", digits=6)


@query
def audit_file_summary(x: Frames) -> DataFrame:
    sheets, issues = x.issues()
    found = A.audit_file_summary(sheets, issues, x.fat(), SENTINEL)
    return cents(found, "receita_bruta_lida", "comissao_total_lida")


@query
def sum_numeric_column(x: Frames) -> DataFrame:
    rows = x.star.table("lineitem").withColumns(line_text())
    return rows.groupBy("l_suppkey").agg(
        F.round(A.sum_numeric_column(rows, "texto"), 2).alias("total"), A.sum_numeric_column(rows, "nada").alias("ausente"))


@query
def allowed_fat_rates(x: Frames) -> DataFrame:
    return A.allowed_fat_rates(_rate_upload(x)).select(
        "modelo", F.array_join(F.transform("percentuais_fat", lambda v: F.format_number(v, 2)), "|").alias("percentuais"))


@query
def allowed_margin_rules(x: Frames) -> DataFrame:
    return A.allowed_margin_rules(_rate_upload(x)).select(
        "modelo", F.size("percentuais_margem").alias("n_percentuais"),
        F.array_join(F.transform("metas", lambda v: F.format_number(v, 2)), "|").alias("metas"))


@query
def machine_totals(x: Frames) -> DataFrame:
    return cents(C.machine_totals(*x.settlement()), "receita_bruta", "margem_rs", "valor_incentivo", "valor_comissao_total")


@query
def extraction_totals(x: Frames) -> DataFrame:
    return cents(C.extraction_totals(x.base()), "receita_bruta")


@query
def incentive_reconciliation(x: Frames) -> DataFrame:
    audit = X.incentive_audit(x.star.billing(), x.star.returns(), x.star.incentives(), START, END)
    found = C.incentive_reconciliation(audit, x.base())
    return cents(found, "valor_incentivo", "valor_com_titulo", "valor_sem_titulo")


@query
def eligibility_totals(x: Frames) -> DataFrame:
    return cents(E.eligibility_totals(x.eligibility()), "valor_apto", "valor_nao_apto")


@query
def key_match_rates(x: Frames) -> DataFrame:
    return E.key_match_rates(_key_checks(x))


@query
def report_totals(x: Frames) -> DataFrame:
    rows = R.report_paid_rows(x.star.paid_ledger(), LABEL)
    return cents(C.report_totals(rows), "receita_bruta", "margem_rs", "valor_comissao_total")


# Windows and de-duplication ----------------------------------------------------------


@query
def latest_fat_rates(x: Frames) -> DataFrame:
    return x.fat()


@query
def latest_margin_rates(x: Frames) -> DataFrame:
    return x.margin()


@query
def latest_managers(x: Frames) -> DataFrame:
    return x.managers()


@query
def first_per_key_query(x: Frames) -> DataFrame:
    order = [F.col(c).asc() for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")]
    return first_per_key(x.star.table("lineitem"), ["l_partkey"], order).select("l_partkey", "l_orderkey", "l_linenumber")


@query
def duplicate_keys(x: Frames) -> DataFrame:
    rows = x.star.lines().select(
        F.lit("linhas").alias("arquivo"), "row_id", F.upper("chassi").alias("nro_chassi"),
        F.year("ship").cast("string").alias("nro_documento"))
    return A.duplicate_keys(rows)


@query
def top1_lookup(x: Frames) -> DataFrame:
    return E.top1_incentive_note(x.star.incentives())


# Sorts and sets ----------------------------------------------------------------------


@query
def order_machine_base(x: Frames) -> DataFrame:
    return X.order_machine_base(x.base()).select("row_id", "data_emissao", "nro_documento", "tipo")


@query
def sort_by_available(x: Frames) -> DataFrame:
    rows = x.star.paid_ledger().select("data_emissao", "nro_documento", "nro_chassi", "tipo")
    return P.sort_by_available(rows, ["data_emissao", "absent", "nro_documento", "nro_chassi"])


@query
def report_order(x: Frames) -> DataFrame:
    return R.manager_report(x.star.paid_ledger(), LABEL).select("gerente")


@query
def sample_limit(x: Frames) -> DataFrame:
    """The first 20 rows of the extraction in presentation order, checked for their keys."""
    first = x.base().orderBy("data_emissao", "nro_documento", "tipo", "row_id").limit(20)
    return E.key_match_rates(E.key_match_check(first, x.star.incentives(), x.star.invoices()))


@query
def union_billing_returns(x: Frames) -> DataFrame:
    return X.union_billing_returns(x.star.billing(), x.star.returns(), START, END)


@query
def distinct_source_chassis(x: Frames) -> DataFrame:
    return X.distinct_source_chassis(x.star.billing(), x.star.returns(), START, END)


@query
def append_total_row(x: Frames) -> DataFrame:
    rows = x.star.table("orders").withColumn("n", F.lit(1))
    return cents(C.append_total_row(rows, "o_orderpriority", ["n"], ["o_totalprice"]), "o_totalprice")


@query
def concat_issues(x: Frames) -> DataFrame:
    _, issues = x.issues()
    failures = x.star.table("nation").select(F.concat("n_name", F.lit(".xlsx")).alias("arquivo"), F.lit("ilegível").alias("erro"))
    every = A.concat_issues(issues, A.read_error_issues(failures))
    return every.groupBy("severidade", "regra").agg(F.count(F.lit(1)).alias("ocorrencias"))


@query
def pay_exclude_conflicts(x: Frames) -> DataFrame:
    return L.pay_exclude_conflicts(x.star.selection())


# Composites --------------------------------------------------------------------------

_CALC = ("row_id", "perc_comissao_fat", "meta_margem", "perc_comissao_margem", "regra_fat_encontrada",
         "regra_margem_encontrada", "regra_classificacao_aplicada", "gatilho_margem_atingido",
         "valor_comissao_fat", "valor_comissao_margem", "valor_comissao_total")


@query
def commission_rules(x: Frames) -> DataFrame:
    return x.calculated().select(*_CALC)


@query
def manager_commission(x: Frames) -> DataFrame:
    return x.managed().select(
        "row_id", "cod_vendedor", "gerente", "perc_comissao_gerente", "valor_comissao_gerente", "regra_gerente_encontrada")


@query
def default_fat_rate(x: Frames) -> DataFrame:
    return U.default_fat_rate(x.calculated()).select(
        "row_id", "perc_comissao_fat", "valor_comissao_fat", "valor_comissao_total", "padrao_fat_aplicado")


@query
def paid_history_filter(x: Frames) -> DataFrame:
    base = x.base().select("row_id", "nro_chassi")
    return H.paid_history_filter(base, x.paid(), x.excluded())[1]


@query
def machine_settlement_query(x: Frames) -> DataFrame:
    return x.settlement()[0].drop("cmv", "veiculo_categoria", "veiculo_estado")


@query
def settlement_after_posting_query(x: Frames) -> DataFrame:
    """machine_settlement kept up to date: the history before the newest competence's postings is stored, then only
    the chassis that those postings name are settled again and merged with the rest."""
    keys = H.STATE_KEYS
    ledger = stage(x.star.paid_ledger().select(*keys, "nro_chassi", "valor_comissao_total"), "paid_ledger")
    newest = ledger.select(*keys).distinct().orderBy(*[F.col(k).desc() for k in keys]).first()
    is_new = (F.col(keys[0]) == newest[0]) & (F.col(keys[1]) == newest[1])
    calculated = stage(U.manager_commission(U.commission_rules(x.base(), x.fat(), x.margin()), x.managers()), "calculated")
    before = stage(H.paid_history(calculated, H.paid_summary(ledger.where(~is_new)), x.excluded()), "history_before")
    rows, _ = settlement_after_posting(before, calculated, ledger.where(is_new), H.paid_summary(ledger), x.excluded(), default_rate=True)
    return rows.drop("cmv", "veiculo_categoria", "veiculo_estado")


@query
def payment_eligibility(x: Frames) -> DataFrame:
    return x.eligibility()


@query
def paid_sheet_audit(x: Frames) -> DataFrame:
    """Every issue; the detail text is checked on fixtures, as engines print numbers their own way."""
    return x.issues()[1].drop("detalhe")


@query
def audit_upload_query(x: Frames) -> DataFrame:
    """Files whose name has an even length tell another period."""
    sheets, issues = x.issues()
    dated = F.replace("arquivo", F.lit("15-04-1996"), F.lit("15-05-1996"))
    named = F.when(F.length("arquivo") % 2 == 0, dated).otherwise(F.col("arquivo"))
    sheets, issues = sheets.withColumn("arquivo", named), issues.withColumn("arquivo", named)
    summary = stage(A.audit_file_summary(sheets, issues, x.fat(), SENTINEL), "summary")
    known = [f"{name}/{YEAR}" for name in S.MONTH_NAMES]
    periods = file_periods(summary.select("arquivo"), known, LABEL)
    path = shared_path(x.spark, "paid")
    ledger = x.spark.createDataFrame([], S.LEDGER_SCHEMA)
    audit_upload(sheets, summary, periods, ledger, path, force=True)
    return _written(x, path).groupBy("arquivo_origem", "mes_ano_comissao", "fonte").agg(
        F.count(F.lit(1)).alias("linhas"), fn.money_sum(F.col("receita_bruta")).alias("receita_bruta"))


@query
def payment_posting(x: Frames) -> DataFrame:
    """Rows paid and rows excluded in one period, posted one after the other."""
    candidates, _ = x.settlement()
    candidates = stage(candidates, "candidates")
    marks = x.star.selection()
    clear = stage(marks.join(L.pay_exclude_conflicts(marks), "row_id", "left_anti"), "selection")
    paid, excluded = shared_path(x.spark, "paid"), shared_path(x.spark, "excluded")
    post_exclusions(candidates, clear, excluded, _period())
    post_payments(candidates, clear.where("not excluir"), paid, _period())
    sides = [_written(x, p).withColumn("livro", F.lit(n)) for n, p in (("pago", paid), ("excluido", excluded))]
    return sides[0].unionByName(sides[1]).groupBy("livro", "filial").agg(
        F.count(F.lit(1)).alias("linhas"), fn.money_sum(F.col("receita_bruta")).alias("receita_bruta"))


@query
def branch_analytic(x: Frames) -> DataFrame:
    return R.branch_analytic(x.star.paid_ledger(), LABEL)


@query
def used_implements_analytic(x: Frames) -> DataFrame:
    return R.used_implements_analytic(x.star.paid_ledger(), LABEL)


@query
def report_pack_query(x: Frames) -> DataFrame:
    """Row count and commission of each report of the pack."""
    pack = report_pack(stage(x.star.paid_ledger(), "ledger"), x.managers(), LABEL, COORDINATOR)
    parts = {
        "cen": (pack.cen, "valor_comissao_total"), "pendencias": (pack.cen_pending, "valor_comissao_total"),
        "gerentes": (pack.managers, "comissao_total_cen"), "coordenador": (pack.coordinator, "receita_bruta"),
        "filiais": (pack.branches, "valor_comissao_total"), "usados": (pack.used_implements, "valor_comissao_total"),
    }
    totals = [
        df.agg(F.count(F.lit(1)).alias("linhas"), F.round(fn.money_sum(F.col(v)), 2).alias("total")).select(
            F.lit(name).alias("relatorio"), "linhas", "total")
        for name, (df, v) in parts.items()
    ]
    out = totals[0]
    for other in totals[1:]:
        out = out.unionByName(other)
    return out


for _long in [n for n in QUERIES if n.endswith("_query")]:
    QUERIES[_long.removesuffix("_query")] = QUERIES.pop(_long)
