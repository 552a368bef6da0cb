"""Period reports over the paid ledger."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payouts import schemas as S
from payouts.functions import fold_text, money_sum, norm_key, safe_float, strip, weighted_mean
from payouts.operators.joins import first_per_key, lookup_join
from payouts.operators.shape import analytic_projection, period_rows, quoted, sort_by_available

__all__ = [
    "branch_analytic", "cen_pending", "cen_report", "coordinator_report", "manager_report",
    "report_paid_rows", "report_relations", "used_implements_analytic", "valid_sellers",
]

_NUMBERS = (
    "receita_bruta", "valor_comissao_fat", "margem_rs", "perc_margem_direta", "valor_incentivo",
    "margem_incentivos_rs", "meta_margem", "perc_margem_bruta", "valor_comissao_margem",
    "receita_bruta_incentivos_rs",
)
# Folded sale class -> column of the seller report (fixed values).
_CEN_BUCKETS = {
    "MAQUINAS JD - NOVOS": "comissao_faturamento",
    "VENDA DIRETA": "venda_direta",
    "MAQUINAS JD - USADOS": "comissao_usados",
    "IMPLEMENTO": "comissao_implementos",
    "INVASAO DE AREA": "comissao_invasao_area",
}
_COORDINATOR_TYPES = {"IMPLEMENTO": S.CLASSE_IMPLEMENTO, "MAQUINAS JD - USADOS": S.CLASSE_USADOS}


def _text(rows: DataFrame, name: str) -> Column:
    return F.col(name) if name in rows.columns else F.lit(None).cast("string")


def report_relations(relations: DataFrame) -> DataFrame:
    """Seller relations with comparison keys; code, manager and seller must all be there."""
    keyed = relations.withColumns(
        {
            "_cod_vendedor": norm_key(F.col("cod_vendedor")),
            "_gerente": fold_text(F.col("gerente")),
            "_vendedor": fold_text(F.col("vendedor")),
            "_gerente_nome": strip(F.coalesce(F.col("gerente"), F.lit(""))),
            "_vendedor_nome": strip(F.coalesce(F.col("vendedor"), F.lit(""))),
        }
    )
    return keyed.where("_cod_vendedor <> '' and _gerente <> '' and _vendedor_nome <> ''")


def report_paid_rows(ledger: DataFrame, label: str) -> DataFrame:
    """Ledger rows of a period with keys; missing numbers are zero, a missing total is fat + margin."""
    rows = period_rows(ledger, label)
    numbers = {
        c: F.coalesce(safe_float(F.col(c)), F.lit(0.0)) if c in rows.columns else F.lit(0.0) for c in _NUMBERS
    }
    total = safe_float(F.col("valor_comissao_total")) if "valor_comissao_total" in rows.columns else F.lit(None).cast("double")
    keys = {
        "_cod_vendedor": norm_key(_text(rows, "cod_vendedor")),
        "_classe": fold_text(_text(rows, "classificacao_venda")),
        "_cen": fold_text(_text(rows, "cen")),
        "_filial": strip(F.coalesce(_text(rows, "filial"), F.lit(""))),
    }
    return rows.withColumns({**keys, **numbers, "valor_comissao_total": total}).withColumn(
        "valor_comissao_total",
        F.coalesce("valor_comissao_total", F.col("valor_comissao_fat") + F.col("valor_comissao_margem")),
    )


def valid_sellers(relations: DataFrame) -> DataFrame:
    """One row per seller code that has a manager other than itself."""
    own = report_relations(relations).where(F.col("_vendedor") != F.col("_gerente"))
    order = [F.col(c).asc_nulls_last() for c in ("row_seq",) if c in own.columns]
    order += [quoted(c).asc_nulls_last() for c in own.columns if c != "row_seq"]
    return first_per_key(own, ["_cod_vendedor"], order).select("_cod_vendedor", F.col("_vendedor_nome").alias("cen"))


def cen_report(ledger: DataFrame, relations: DataFrame, label: str) -> DataFrame:
    """Per seller: billing commission by sale class, margin commission and their sum.

    Every valid seller appears; ledger rows of other sellers are left to cen_pending.
    """
    paid = report_paid_rows(ledger, label)
    buckets = [
        F.coalesce(money_sum(F.when(F.col("_classe") == k, F.col("valor_comissao_fat"))), F.lit(0.0)).alias(name)
        for k, name in _CEN_BUCKETS.items()
    ]
    sums = paid.where("_cod_vendedor <> ''").groupBy("_cod_vendedor").agg(
        *buckets, money_sum(F.col("valor_comissao_margem")).alias("comissao_margem")
    )
    names = [*_CEN_BUCKETS.values(), "comissao_margem"]
    joined = lookup_join(valid_sellers(relations), sums, ["_cod_vendedor"])
    filled = joined.select("cen", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])
    total = F.col(names[0])
    for name in names[1:]:
        total = total + F.col(name)
    return sort_by_available(filled.withColumn("valor_comissao_total", total), ["cen"])


def cen_pending(ledger: DataFrame, relations: DataFrame, label: str) -> DataFrame:
    """Ledger rows whose seller is blank or not a valid one, with the reason."""
    paid = report_paid_rows(ledger, label)
    paid = paid.withColumn("_seller", F.nullif("_cod_vendedor", F.lit("")))
    sellers = valid_sellers(relations).select(F.col("_cod_vendedor").alias("_seller"))
    pending = lookup_join(paid, sellers, ["_seller"], flag="_valid").where(~F.col("_valid"))
    reason = F.when(F.col("_cod_vendedor") == "", "Sem cod_vendedor").otherwise("Cod_vendedor sem relação CEN x Gerente")
    return pending.select(
        reason.alias("pendencia"),
        *[_text(pending, c).alias(c) for c in ("cod_vendedor", "cen", "nro_documento", "nro_chassi", "classificacao_venda")],
        "valor_comissao_fat", "valor_comissao_margem", "valor_comissao_total",
    )


def _margin_columns() -> list[Column]:
    return [
        money_sum(F.col("receita_bruta")).alias("receita_bruta"),
        money_sum(F.col("margem_incentivos_rs")).alias("margem_incentivos_rs"),
        weighted_mean(F.col("perc_margem_bruta"), F.col("receita_bruta_incentivos_rs")).alias("_weighted"),
    ]


def manager_report(ledger: DataFrame, label: str, share: float = S.MANAGER_REPORT_SHARE) -> DataFrame:
    """Per manager (names folded): revenue, weighted gross margin, seller commission and share."""
    paid = report_paid_rows(ledger, label)
    paid = paid.withColumns(
        {
            "_gerente": fold_text(_text(paid, "gerente")),
            "_gerente_nome": strip(F.coalesce(_text(paid, "gerente"), F.lit(""))),
        }
    ).where("_gerente <> ''")
    report = paid.groupBy("_gerente").agg(
        F.min("_gerente_nome").alias("gerente"), *_margin_columns(),
        money_sum(F.col("valor_comissao_total")).alias("comissao_total_cen"),
    )
    shaped = report.select(
        "gerente", "receita_bruta", "margem_incentivos_rs", F.col("_weighted").alias("perc_margem_bruta"),
        "comissao_total_cen", (F.col("comissao_total_cen") * share).alias("comissao_gerente"),
    )
    return sort_by_available(shaped, ["gerente"])


def coordinator_report(ledger: DataFrame, label: str, name: str) -> DataFrame:
    """Implements and used machines at the coordinator's fixed percents."""
    paid = report_paid_rows(ledger, label).where(F.col("_classe").isin(*_COORDINATOR_TYPES))
    labels = F.create_map(*[F.lit(x) for pair in _COORDINATOR_TYPES.items() for x in pair])
    sums = paid.groupBy("_classe").agg(*_margin_columns())
    fat = F.col("receita_bruta") * (S.COORDINATOR_FAT_PERCENT / 100)
    margin = F.col("receita_bruta") * (S.COORDINATOR_MARGIN_PERCENT / 100)
    return sums.orderBy("_classe").select(
        F.lit(name).alias("nome"),
        labels[F.col("_classe")].alias("tipo"),
        "receita_bruta",
        F.lit(S.COORDINATOR_FAT_PERCENT).alias("perc_comissao_fat"),
        fat.alias("valor_comissao_fat"),
        "margem_incentivos_rs",
        F.lit(S.COORDINATOR_TARGET).alias("meta_margem_coordenador"),
        F.col("_weighted").alias("perc_mb_realizado"),
        F.lit(S.COORDINATOR_MARGIN_PERCENT).alias("perc_comissao_margem"),
        margin.alias("valor_comissao_margem"),
        (fat + margin).alias("valor_total_comissao"),
    )


def branch_analytic(ledger: DataFrame, label: str) -> DataFrame:
    """Rows with a commission, by branch; one frame to be written partitioned by filial."""
    paid = report_paid_rows(ledger, label).where("valor_comissao_total <> 0 and _filial <> ''")
    ordered = sort_by_available(
        paid.withColumn("filial", F.col("_filial")), ["filial", "data_emissao", "nro_documento", "nro_chassi"]
    )
    return analytic_projection(ordered)


def used_implements_analytic(ledger: DataFrame, label: str) -> DataFrame:
    """Rows of implements and used machines."""
    paid = report_paid_rows(ledger, label).where(F.col("_classe").isin(*_COORDINATOR_TYPES))
    ordered = sort_by_available(paid, ["classificacao_venda", "filial", "data_emissao", "nro_documento", "nro_chassi"])
    return analytic_projection(ordered)
