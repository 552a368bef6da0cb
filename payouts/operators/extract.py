"""Extraction: invoices and returns as one enriched table, and the incentive titles."""

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payouts import schemas as S
from payouts.functions import (
    blank_to_null,
    classify_sale,
    gross_margin,
    incentive_detail,
    incentive_status,
    margin_pct,
    money_sum,
    net_revenue,
    parse_date_br,
    source_key,
)
from payouts.operators.joins import lookup_join
from payouts.operators.shape import is_text

__all__ = [
    "MachineSources", "dimension_dedup", "distinct_source_chassis", "exclude_product_code",
    "incentive_audit", "incentive_by_chassis", "incentive_by_title", "incentive_summary",
    "incentive_titles", "machine_base", "order_machine_base", "receivable_by_title",
    "source_audit", "union_billing_returns", "window_filter",
]


@dataclass(frozen=True)
class MachineSources:
    """The seven relations the machine extraction reads."""

    billing: DataFrame
    returns: DataFrame
    incentives: DataFrame
    vehicles: DataFrame
    sellers: DataFrame
    customers: DataFrame
    cost_centers: DataFrame


def issue_date(df: DataFrame, name: str = "data_emissao") -> Column:
    return parse_date_br(F.col(name), is_text(df, name))


def window_filter(rows: DataFrame, start: date, end: date) -> DataFrame:
    """Rows issued between two days, both included; rows without a readable date go."""
    return rows.where(issue_date(rows).between(F.lit(start), F.lit(end)))


def exclude_product_code(rows: DataFrame) -> DataFrame:
    """Rows whose product code is missing or free of the excluded mark."""
    code = F.col("produto_codigo")
    return rows.where(code.isNull() | ~F.contains(F.upper(code), F.lit(S.EXCLUDED_PRODUCT_MARK)))


def _side(rows: DataFrame, kind: str, start: date, end: date) -> DataFrame:
    kept = exclude_product_code(window_filter(rows, start, end))
    total, tax, cost = F.col("valor_total"), F.col("valor_impostos"), F.col("valor_custo")
    net_sale = F.col("valor_venda_liquida") if kind == S.TIPO_FATURAMENTO else None
    return kept.select(
        F.lit(kind).alias("tipo"),
        F.trim(F.col("centro_custo").cast("string")).alias("centro_custo"),
        issue_date(rows).alias("data_emissao"),
        F.col("nota_fiscal_numero").alias("nro_documento"),
        F.trim("chassi").alias("nro_chassi"),
        F.trim("cliente_codigo").alias("cliente_codigo"),
        F.trim("vendedor_codigo").alias("cod_vendedor"),
        F.coalesce(total.cast("double"), F.lit(0.0)).alias("receita_bruta"),
        net_revenue(total, tax, net_sale).alias("receita_liquida"),
        F.coalesce(cost.cast("double"), F.lit(0.0)).alias("cmv"),
        gross_margin(total, tax, cost).alias("margem_rs"),
        *[F.col(c) for c in rows.columns if c == "row_id"],
    )


def union_billing_returns(billing: DataFrame, returns: DataFrame, start: date, end: date) -> DataFrame:
    """Invoices and returns of the window as one table, before any enrichment."""
    return _side(billing, S.TIPO_FATURAMENTO, start, end).unionByName(
        _side(returns, S.TIPO_DEVOLUCAO, start, end)
    )


def dimension_dedup(dim: DataFrame, key: str, values: list[str], key_name: str = "_key") -> DataFrame:
    """One row per key: the largest trimmed text of each attribute."""
    return (
        dim.select(source_key(F.col(key)).alias(key_name), *[F.trim(F.col(v)).alias(v) for v in values])
        .where(F.col(key_name).isNotNull())
        .groupBy(key_name)
        .agg(*[F.max(v).alias(v) for v in values])
    )


def incentive_by_title(incentives: DataFrame) -> DataFrame:
    """Incentive value per chassis and title; rows missing either key are left out."""
    return (
        incentives.select(
            blank_to_null(F.col("chassi")).alias("nro_chassi"),
            blank_to_null(F.col("nota_fiscal_numero")).alias("titulo_incentivo"),
            F.coalesce(F.col("valor_incentivo"), F.lit(0)).alias("_value"),
        )
        .where("nro_chassi is not null and titulo_incentivo is not null")
        .groupBy(F.upper("nro_chassi").alias("_ck"), F.upper("titulo_incentivo").alias("_tk"))
        .agg(
            F.max("nro_chassi").alias("nro_chassi"),
            F.max("titulo_incentivo").alias("titulo_incentivo"),
            money_sum(F.col("_value")).alias("valor_incentivo"),
        )
        .drop("_ck", "_tk")
    )


def incentive_by_chassis(incentives: DataFrame) -> DataFrame:
    """Incentive value per chassis over its titled rows."""
    titled = incentives.where(
        blank_to_null(F.col("nota_fiscal_numero")).isNotNull() & blank_to_null(F.col("chassi")).isNotNull()
    )
    return titled.groupBy(source_key(F.col("chassi")).alias("chassi")).agg(
        money_sum(F.coalesce(F.col("valor_incentivo"), F.lit(0))).alias("valor_incentivo")
    )


def receivable_by_title(receivables: DataFrame) -> DataFrame:
    """Open balance per title."""
    return receivables.groupBy(F.upper(F.trim("titulo_numero")).alias("titulo")).agg(
        money_sum(F.coalesce(F.col("valor_saldo"), F.lit(0))).alias("saldo")
    )


def _chassis_dimension(vehicles: DataFrame, incentives: DataFrame) -> DataFrame:
    """Vehicle attributes and incentive value per chassis, in one aggregation over both."""
    texts = ["veiculo_modelo", "veiculo_categoria", "veiculo_estado"]
    titled = incentives.where(blank_to_null(F.col("nota_fiscal_numero")).isNotNull())
    rows = vehicles.select(
        source_key(F.col("chassi")).alias("_key"), *[F.trim(t).alias(t) for t in texts],
        F.lit(None).cast("double").alias("valor_incentivo"),
    ).unionByName(
        titled.select(
            source_key(F.col("chassi")).alias("_key"), *[F.lit(None).cast("string").alias(t) for t in texts],
            F.coalesce(F.col("valor_incentivo"), F.lit(0)).cast("double").alias("valor_incentivo"),
        )
    )
    return rows.where("_key is not null").groupBy("_key").agg(
        *[F.max(t).alias(t) for t in texts], money_sum(F.col("valor_incentivo")).alias("valor_incentivo")
    )


def machine_base(sources: MachineSources, start: date, end: date) -> DataFrame:
    """The machine table: every invoice and return of the window, once, with vehicle,
    incentive, customer, seller and branch data and zero commission columns."""
    raw = union_billing_returns(sources.billing, sources.returns, start, end)
    # Each lookup brings one row per key at most, so invoices never multiply. The keys are expressions of the join,
    # not columns: invoices are moved without a second copy of each code, and by chassis, which adds most, last of the
    # keys that have many values.
    dims = {
        "cliente_codigo": dimension_dedup(sources.customers, "cliente_codigo", ["cliente_nome"]),
        "nro_chassi": _chassis_dimension(sources.vehicles, sources.incentives),
        "cod_vendedor": dimension_dedup(sources.sellers, "vendedor_codigo", ["vendedor_nome"]),
        "centro_custo": dimension_dedup(sources.cost_centers, "centro_custo", ["lojas"]),
    }
    rows = raw
    for code, dim in dims.items():
        rows = rows.join(dim, source_key(rows[code]) == dim["_key"], "left").drop("_key")
    incentive = F.coalesce(F.col("valor_incentivo"), F.lit(0.0))
    gross, margin, net = F.col("receita_bruta"), F.col("margem_rs"), F.col("receita_liquida")
    zero = F.lit(0.0)
    return rows.select(
        "tipo",
        F.col("lojas").alias("filial"),
        "data_emissao",
        "nro_documento",
        F.col("veiculo_modelo").alias("modelo"),
        "veiculo_categoria",
        "veiculo_estado",
        "nro_chassi",
        "cliente_codigo",
        F.col("cliente_nome").alias("nome_cliente"),
        F.col("vendedor_nome").alias("cen"),
        "cod_vendedor",
        classify_sale(F.col("veiculo_categoria"), F.col("veiculo_estado")).alias("classificacao_venda"),
        "receita_bruta",
        zero.alias("perc_comissao_fat"),
        zero.alias("valor_comissao_fat"),
        "cmv",
        "margem_rs",
        margin_pct(margin, net).alias("perc_margem_direta"),
        incentive.alias("valor_incentivo"),
        (gross + incentive).alias("receita_bruta_incentivos_rs"),
        (margin + incentive).alias("margem_incentivos_rs"),
        zero.alias("meta_margem"),
        margin_pct(margin + incentive, net).alias("perc_margem_bruta"),
        zero.alias("perc_comissao_margem"),
        zero.alias("valor_comissao_margem"),
        zero.alias("valor_comissao_total"),
        *[F.col(c) for c in raw.columns if c == "row_id"],
    )


def order_machine_base(rows: DataFrame) -> DataFrame:
    """Presentation order: date, document, type."""
    return rows.orderBy("data_emissao", "nro_documento", "tipo")


def incentive_titles(incentives: DataFrame, receivables: DataFrame) -> DataFrame:
    """Each chassis title with its open balance and status."""
    titles = incentive_by_title(incentives).withColumn("titulo", F.upper("titulo_incentivo"))
    joined = lookup_join(titles, receivable_by_title(receivables), ["titulo"], flag="_known")
    balance = F.coalesce(F.col("saldo"), F.lit(0.0))
    missing = ~F.col("_known")
    return joined.select(
        "nro_chassi",
        "titulo_incentivo",
        "valor_incentivo",
        balance.alias("saldo_incentivo"),
        incentive_status(balance, missing).alias("status_incentivo"),
        incentive_detail(balance, missing, "title").alias("detalhe_incentivo"),
    )


def incentive_summary(incentives: DataFrame, receivables: DataFrame) -> DataFrame:
    """One row per chassis: its titles as text, totals and the worst-case status.

    The title list is the result itself; titles are already distinct per chassis, and the
    totals combine map-side.
    """
    titles = incentive_titles(incentives, receivables)
    unknown = F.col("status_incentivo") == "VERIFICAR"
    per_chassis = titles.groupBy(F.upper("nro_chassi").alias("_chassis")).agg(
        F.max("nro_chassi").alias("nro_chassi"),
        F.expr("listagg(titulo_incentivo, ' / ') within group (order by titulo_incentivo)").alias("titulos_incentivo"),
        F.count(F.lit(1)).alias("qtd_titulos_incentivo"),
        money_sum(F.col("valor_incentivo")).alias("valor_incentivo"),
        money_sum(F.col("saldo_incentivo")).alias("saldo_incentivo"),
        F.bool_or(unknown).alias("_missing"),
    )
    balance, missing = F.col("saldo_incentivo"), F.col("_missing")
    return per_chassis.select(
        "nro_chassi",
        "titulos_incentivo",
        "qtd_titulos_incentivo",
        "valor_incentivo",
        "saldo_incentivo",
        incentive_status(balance, missing).alias("status_incentivo"),
        incentive_detail(balance, missing, "chassis").alias("detalhe_incentivo"),
    )


def _with_total(totals: DataFrame, count_name: str, value_name: str) -> DataFrame:
    """Roll the per-type rows up to a Total row."""
    label = F.when(F.grouping("tipo") == 1, S.TIPO_TOTAL).otherwise(F.col("tipo"))
    return totals.rollup("tipo").agg(
        label.alias("_label"),
        F.sum(count_name).alias(count_name),
        money_sum(F.col(value_name)).alias(value_name),
    ).select(F.col("_label").alias("tipo"), count_name, value_name)


def source_audit(billing: DataFrame, returns: DataFrame, start: date, end: date) -> DataFrame:
    """Row count and gross revenue per source type and in total, straight from the sources.

    Each type has its row even when the window holds none of it.
    """
    def total(rows: DataFrame, kind: str) -> DataFrame:
        kept = exclude_product_code(window_filter(rows, start, end))
        value = F.coalesce(F.col("valor_total").cast("double"), F.lit(0.0))
        return kept.agg(
            F.count(F.lit(1)).alias("qtd_linhas"),
            F.coalesce(money_sum(value), F.lit(0.0)).alias("receita_bruta"),
        ).select(F.lit(kind).alias("tipo"), "qtd_linhas", "receita_bruta")

    both = total(billing, S.TIPO_FATURAMENTO).unionByName(total(returns, S.TIPO_DEVOLUCAO))
    return _with_total(both, "qtd_linhas", "receita_bruta")


def distinct_source_chassis(billing: DataFrame, returns: DataFrame, start: date, end: date) -> DataFrame:
    """Every chassis of the window's invoices and returns, once (case-insensitive)."""
    sides = [
        exclude_product_code(window_filter(rows, start, end)).select(blank_to_null(F.col("chassi")).alias("chassi"))
        for rows in (billing, returns)
    ]
    named = sides[0].union(sides[1]).where("chassi is not null")
    # Spellings first: a grouping that counts is hashed, while the largest text of a group sorts all rows of a task.
    # Without the count Spark would drop this step, as a largest value does not need it.
    spellings = named.groupBy(F.upper("chassi").alias("_key"), "chassi").agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 0")
    return spellings.groupBy("_key").agg(F.max("chassi").alias("chassi")).drop("_key")


def incentive_audit(
    billing: DataFrame, returns: DataFrame, incentives: DataFrame, start: date, end: date
) -> DataFrame:
    """One row: distinct source chassis, those with incentives, titles, and value with and without title."""
    chassis = distinct_source_chassis(billing, returns, start, end).select(F.upper("chassi").alias("_key"))
    per_title = (
        incentives.select(
            source_key(F.col("chassi")).alias("_key"),
            F.upper(blank_to_null(F.col("nota_fiscal_numero"))).alias("_title"),
            F.coalesce(F.col("valor_incentivo").cast("double"), F.lit(0.0)).alias("_value"),
        )
        .where("_key is not null")
        .groupBy("_key", "_title")
        .agg(money_sum(F.col("_value")).alias("_value"))
    )
    matched = lookup_join(per_title, chassis.withColumn("_in_source", F.lit(True)), ["_key"]).where("_in_source")
    value = money_sum(F.col("_value"))
    totals = matched.agg(
        F.count_distinct("_key").alias("qtd_chassis_com_incentivo"),
        F.count_distinct("_title").alias("qtd_titulos_incentivo"),
        F.coalesce(value, F.lit(0.0)).alias("valor_incentivo"),
        F.coalesce(money_sum(F.when(F.col("_title").isNotNull(), F.col("_value"))), F.lit(0.0)).alias("valor_com_titulo"),
        F.coalesce(money_sum(F.when(F.col("_title").isNull(), F.col("_value"))), F.lit(0.0)).alias("valor_sem_titulo"),
    )
    # Two one-row frames side by side: a union and one more aggregation, no join.
    names = ["qtd_chassis", *totals.columns]
    counted = chassis.agg(F.count(F.lit(1)).alias("qtd_chassis"))
    stacked = counted.unionByName(totals, allowMissingColumns=True)
    return stacked.agg(*[F.max(n).alias(n) for n in names])
