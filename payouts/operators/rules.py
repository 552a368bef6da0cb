"""Rates, managers and the commission calculation."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payouts import schemas as S
from payouts.functions import (
    norm_key,
    parse_br_number,
    parse_commission_points,
    parse_margin_points,
    parse_percent_points,
    rate_read_percent,
    rate_read_target,
    strip,
)
from payouts.operators.joins import first_per_key, lookup_join, merge_by_key
from payouts.operators.shape import is_text, quoted, resolve_column

__all__ = [
    "calc_rate_table", "commission_rules", "default_fat_rate", "latest_fat_rates",
    "latest_managers", "latest_margin_rates", "manager_commission", "manager_lookup", "rate_lookup",
]

_NEWEST = ("updated_at", "batch_id", "row_seq", "id")


def _latest(rules: DataFrame, key: str) -> DataFrame:
    """Newest active rule per key; later rows of one upload win over earlier ones."""
    active = rules.where(F.col("ativo") & (F.trim(key) != ""))
    order = [F.col(c).desc_nulls_last() for c in _NEWEST if c in rules.columns]
    return first_per_key(active, [F.upper(F.trim(key))], order)


def latest_fat_rates(rules: DataFrame) -> DataFrame:
    return _latest(rules, "modelo").withColumn("percentual", rate_read_percent(F.col("percentual")))


def latest_margin_rates(rules: DataFrame) -> DataFrame:
    return _latest(rules, "modelo").withColumns(
        {
            "percentual": rate_read_percent(F.col("percentual")),
            "meta_margem": rate_read_target(F.col("meta_margem")),
        }
    )


def latest_managers(relations: DataFrame) -> DataFrame:
    return _latest(relations, "cod_vendedor").withColumn(
        "percentual_comissao_gerente", rate_read_target(F.col("percentual_comissao_gerente"))
    )


def _stable_order(df: DataFrame, order: Sequence[str]):
    """Keep-first order: the named columns that exist, then every column."""
    named = [F.col(c).asc_nulls_last() for c in order if c in df.columns]
    return named + [quoted(c).asc_nulls_last() for c in df.columns]


def calc_rate_table(rates: DataFrame, include_target: bool = False, order: Sequence[str] = ("row_seq",)) -> DataFrame:
    """Model key and percent (and target) as the calculation reads them, one row per model."""
    model = resolve_column(rates, S.MODEL_ALIASES)
    percent = resolve_column(rates, S.CALC_PERCENT_ALIASES)
    target = resolve_column(rates, S.TARGET_ALIASES, required=False)
    columns = {
        "modelo": norm_key(quoted(model)),
        "percentual": parse_commission_points(quoted(percent), is_text(rates, percent)),
    }
    if include_target:
        columns["meta_margem"] = (
            parse_margin_points(quoted(target), is_text(rates, target)) if target else F.lit(0.0)
        )
    sequence = [F.col(c) for c in order if c in rates.columns]
    prepared = rates.select(*[c.alias(n) for n, c in columns.items()], *sequence).where("modelo <> ''")
    return first_per_key(prepared, ["modelo"], _stable_order(prepared, order)).select(*columns)


def rate_lookup(rows: DataFrame, fat_rates: DataFrame, margin_rates: DataFrame) -> DataFrame:
    """Percent, target and rule-found flags of each row's model; unknown models get zero."""
    fat = calc_rate_table(fat_rates).select(
        F.col("modelo").alias("_model"), F.col("percentual").alias("_fat"), F.lit(True).alias("_has_fat")
    )
    margin = calc_rate_table(margin_rates, include_target=True).select(
        F.col("modelo").alias("_model"), F.col("percentual").alias("_margin"),
        F.col("meta_margem").alias("_target"), F.lit(True).alias("_has_margin"),
    )
    rates = merge_by_key(fat, margin, "_model")
    model = F.nullif(norm_key(F.col("modelo")), F.lit(""))
    joined = lookup_join(rows.withColumn("_model", model), rates, ["_model"])
    drop = [c for c in ("perc_comissao_fat", "meta_margem", "perc_comissao_margem") if c in rows.columns]
    return joined.drop(*drop).select(
        *[c for c in rows.columns if c not in drop],
        F.coalesce("_fat", F.lit(0.0)).alias("perc_comissao_fat"),
        F.coalesce("_target", F.lit(0.0)).alias("meta_margem"),
        F.coalesce("_margin", F.lit(0.0)).alias("perc_comissao_margem"),
        F.coalesce("_has_fat", F.lit(False)).alias("regra_fat_encontrada"),
        F.coalesce("_has_margin", F.lit(False)).alias("regra_margem_encontrada"),
    )


def commission_rules(rows: DataFrame, fat_rates: DataFrame, margin_rates: DataFrame) -> DataFrame:
    """Commission per row: model rates, then class overrides, then the margin trigger."""
    rated = rate_lookup(rows, fat_rates, margin_rates)
    gross = F.lit(0.0)
    if "receita_bruta" in rows.columns:
        gross = F.coalesce(parse_br_number(F.col("receita_bruta"), is_text(rows, "receita_bruta")), F.lit(0.0))
    sale_class = norm_key(F.col("classificacao_venda"))
    implement = sale_class == S.CLASSE_IMPLEMENTO.upper()
    override = implement | (sale_class == S.CLASSE_USADOS.upper())
    fat = (
        F.when(implement & (gross >= S.IMPLEMENT_THRESHOLD), S.IMPLEMENT_RATE_HIGH)
        .when(implement, S.IMPLEMENT_RATE_LOW)
        .when(override, S.USED_RATE)
        .otherwise(F.col("perc_comissao_fat"))
    )
    ruled = rated.withColumns(
        {
            "perc_comissao_fat": fat,
            "perc_comissao_margem": F.when(override, 0.0).otherwise(F.col("perc_comissao_margem")),
            "meta_margem": F.when(override, 0.0).otherwise(F.col("meta_margem")),
            "regra_fat_encontrada": override | F.col("regra_fat_encontrada"),
            "regra_margem_encontrada": override | F.col("regra_margem_encontrada"),
            "regra_classificacao_aplicada": override,
        }
    )
    trigger = F.lit(False)
    if "perc_margem_bruta" in rows.columns:
        margin = parse_margin_points(F.col("perc_margem_bruta"), is_text(rows, "perc_margem_bruta"))
        trigger = (margin >= F.col("meta_margem")) & (F.col("perc_comissao_margem") > 0)
    paid_margin = gross * F.col("perc_comissao_margem") / 100
    return (
        ruled.withColumn("gatilho_margem_atingido", trigger)
        .withColumns(
            {
                "valor_comissao_fat": gross * F.col("perc_comissao_fat") / 100,
                "valor_comissao_margem": F.when(F.col("gatilho_margem_atingido"), paid_margin).otherwise(0.0),
            }
        )
        .withColumn("valor_comissao_total", F.col("valor_comissao_fat") + F.col("valor_comissao_margem"))
    )


def manager_lookup(rows: DataFrame, relations: DataFrame) -> DataFrame:
    """Manager and manager percent of each row's seller.

    Columns the input already has keep their values; the relation only fills new ones.
    """
    seller = resolve_column(relations, S.SELLER_CODE_ALIASES)
    manager = resolve_column(relations, S.MANAGER_ALIASES)
    percent = resolve_column(relations, S.MANAGER_PERCENT_ALIASES, required=False)
    points = (
        parse_percent_points(quoted(percent), is_text(relations, percent))
        if percent
        else F.lit(S.DEFAULT_MANAGER_PERCENT)
    )
    prepared = relations.select(
        norm_key(quoted(seller)).alias("_code"),
        strip(F.coalesce(quoted(manager).cast("string"), F.lit(""))).alias("_manager"),
        points.alias("_percent"),
        *[F.col(c) for c in ("row_seq",) if c in relations.columns],
    ).where("_code <> ''")
    dim = first_per_key(prepared, ["_code"], _stable_order(prepared, ("row_seq",))).select(
        "_code", "_manager", "_percent"
    )
    code = norm_key(F.col("cod_vendedor")) if "cod_vendedor" in rows.columns else F.lit("")
    keyed = rows.withColumn("cod_vendedor", code).withColumn("_code", F.nullif(F.col("cod_vendedor"), F.lit("")))
    name = F.col("gerente") if "gerente" in rows.columns else F.col("_manager")
    share = F.col("_percent")
    if "perc_comissao_gerente" in rows.columns:
        share = F.col("perc_comissao_gerente").try_cast("double")
    return (
        lookup_join(keyed, dim, ["_code"])
        .withColumns(
            {
                "gerente": strip(F.coalesce(name, F.lit(""))),
                "perc_comissao_gerente": F.coalesce(share, F.lit(0.0)),
            }
        )
        .drop("_code", "_manager", "_percent")
    )


def manager_commission(rows: DataFrame, relations: DataFrame | None) -> DataFrame:
    """Manager share of the total commission; without relations it is zero."""
    if relations is None:
        code = norm_key(F.col("cod_vendedor")) if "cod_vendedor" in rows.columns else F.lit("")
        name = F.col("gerente") if "gerente" in rows.columns else F.lit("")
        return rows.withColumns(
            {
                "cod_vendedor": code,
                "gerente": name,
                "perc_comissao_gerente": F.lit(0.0),
                "valor_comissao_gerente": F.lit(0.0),
                "regra_gerente_encontrada": F.lit(False),
            }
        )
    total = F.lit(0.0)
    if "valor_comissao_total" in rows.columns:
        total = F.coalesce(F.col("valor_comissao_total").try_cast("double"), F.lit(0.0))
    return manager_lookup(rows, relations).withColumns(
        {
            "valor_comissao_gerente": total * F.col("perc_comissao_gerente") / 100,
            "regra_gerente_encontrada": F.col("gerente") != "",
        }
    )


def default_fat_rate(rows: DataFrame, enabled: bool = True) -> DataFrame:
    """Billing percent zero becomes one percent; fat and total follow, manager values stay."""
    needed = {"perc_comissao_fat", "receita_bruta", "valor_comissao_fat", "valor_comissao_total"}
    if not needed <= set(rows.columns):
        return rows.withColumn("padrao_fat_aplicado", F.lit(False))

    def number(name: str):
        return F.coalesce(F.col(name).try_cast("double"), F.lit(0.0))

    percent = number("perc_comissao_fat")
    defaulted = (percent == 0) if enabled else F.lit(False)
    margin = number("valor_comissao_margem") if "valor_comissao_margem" in rows.columns else F.lit(0.0)
    return (
        rows.withColumn("padrao_fat_aplicado", defaulted)
        .withColumn("perc_comissao_fat", F.when(F.col("padrao_fat_aplicado"), S.DEFAULT_FAT_RATE).otherwise(percent))
        .withColumn("valor_comissao_fat", number("receita_bruta") * F.col("perc_comissao_fat") / 100)
        .withColumn("valor_comissao_total", F.col("valor_comissao_fat") + margin)
    )
