"""Paid and excluded history per chassis, and what it blocks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payouts.functions import money_sum, norm_key, paid_status, source_key
from payouts.operators.joins import lookup_join, merge_by_key

__all__ = [
    "excluded_join", "excluded_state", "excluded_summary", "merge_excluded_state", "merge_paid_state",
    "open_candidates", "paid_history_filter", "paid_history_join", "paid_state", "paid_summary",
]

_EXCLUDED = "Excluído manualmente"


def paid_summary(ledger: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Paid history per chassis (and the columns `by`): entries, paid and reversed value, balance, sign flags."""
    value = F.coalesce(F.col("valor_comissao_total"), F.lit(0))
    paid = F.when(value > 0, value).otherwise(F.lit(0))
    reversed_ = F.when(value < 0, value).otherwise(F.lit(0))
    keyed = ledger.select(*by, source_key(F.col("nro_chassi")).alias("nro_chassi"), "valor_comissao_total")
    return keyed.where("nro_chassi is not null").groupBy(*by, "nro_chassi").agg(
        F.count(F.lit(1)).alias("qtd_lancamentos_pagos"),
        money_sum(paid).alias("valor_pago_positivo"),
        money_sum(reversed_).alias("valor_estornado_negativo"),
        money_sum(value).alias("saldo_comissao_paga_chassi"),
        F.bool_or(value > 0).alias("tem_pagamento_positivo"),
        F.bool_or(value < 0).alias("tem_estorno_negativo"),
    )


#: The key of stored summary state: one part a competence, so a new month rewrites its own part only.
STATE_KEYS = ("competencia_ano", "competencia_mes")


def paid_state(ledger: DataFrame) -> DataFrame:
    """Paid history per competence and chassis, in parts that add up: paid_summary of a ledger equals
    merge_paid_state of its state, and the state of a competence depends on that competence's rows alone."""
    return paid_summary(ledger, STATE_KEYS)


def merge_paid_state(state: DataFrame) -> DataFrame:
    """paid_summary from stored state: counts and amounts add up, flags combine by or."""
    return state.groupBy("nro_chassi").agg(
        F.sum("qtd_lancamentos_pagos").alias("qtd_lancamentos_pagos"),
        *[money_sum(F.col(c)).alias(c) for c in ("valor_pago_positivo", "valor_estornado_negativo", "saldo_comissao_paga_chassi")],
        F.bool_or("tem_pagamento_positivo").alias("tem_pagamento_positivo"),
        F.bool_or("tem_estorno_negativo").alias("tem_estorno_negativo"),
    )


def excluded_state(ledger: DataFrame) -> DataFrame:
    """Manual exclusions per competence and chassis; merge_excluded_state gives excluded_summary."""
    return excluded_summary(ledger, STATE_KEYS)


def merge_excluded_state(state: DataFrame) -> DataFrame:
    return state.groupBy("nro_chassi").agg(
        F.sum("qtd_lancamentos_excluidos").alias("qtd_lancamentos_excluidos"), F.max("ultima_exclusao").alias("ultima_exclusao"))


def excluded_summary(ledger: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Manual exclusions per chassis."""
    keyed = ledger.select(*by, source_key(F.col("nro_chassi")).alias("nro_chassi"), "paid_at")
    return keyed.where("nro_chassi is not null").groupBy(*by, "nro_chassi").agg(
        F.count(F.lit(1)).alias("qtd_lancamentos_excluidos"), F.max("paid_at").alias("ultima_exclusao")
    )


# Summary column -> (result column, value when the chassis has no history).
_PAID = {
    "qtd_lancamentos_pagos": ("qtd_lancamentos_pagos", 0),
    "valor_pago_positivo": ("valor_pago_historico", 0.0),
    "valor_estornado_negativo": ("valor_estornado_historico", 0.0),
    "saldo_comissao_paga_chassi": ("saldo_comissao_paga_chassi", 0.0),
    "tem_pagamento_positivo": ("tem_pagamento_positivo", False),
    "tem_estorno_negativo": ("tem_estorno_negativo", False),
}


def _chassis_key(c: Column) -> Column:
    return F.nullif(norm_key(c), F.lit(""))


def _paid_dim(summary: DataFrame) -> DataFrame:
    return summary.select(
        _chassis_key(F.col("nro_chassi")).alias("_chassis"),
        *[F.col(c).alias(f"_{c}") for c in _PAID],
    )


def _excluded_dim(summary: DataFrame) -> DataFrame:
    return summary.select(
        _chassis_key(F.col("nro_chassi")).alias("_chassis"), F.col("qtd_lancamentos_excluidos").alias("_excluded")
    )


def _paid_columns() -> list[Column]:
    return [F.coalesce(F.col(f"_{c}"), F.lit(default)).alias(name) for c, (name, default) in _PAID.items()]


def _excluded_columns() -> list[Column]:
    count = F.coalesce(F.col("_excluded"), F.lit(0))
    return [count.alias("qtd_lancamentos_excluidos"), (count > 0).alias("bloqueado_exclusao")]


def _join(rows: DataFrame, dim: DataFrame, added: list[Column]) -> DataFrame:
    keyed = rows.withColumn("_chassis", _chassis_key(F.col("nro_chassi")))
    return lookup_join(keyed, dim, ["_chassis"]).select(*rows.columns, *added)


def paid_history_join(rows: DataFrame, paid: DataFrame) -> DataFrame:
    return _join(rows, _paid_dim(paid), _paid_columns())


def excluded_join(rows: DataFrame, excluded: DataFrame) -> DataFrame:
    return _join(rows, _excluded_dim(excluded), _excluded_columns())


def paid_history(rows: DataFrame, paid: DataFrame | None, excluded: DataFrame | None) -> DataFrame:
    """Rows with their history, status and blocking flags; one lookup serves both ledgers."""
    if paid is not None and excluded is not None:
        dim = merge_by_key(_paid_dim(paid), _excluded_dim(excluded), "_chassis")
        joined = _join(rows, dim, _paid_columns() + _excluded_columns())
    else:
        joined = rows
        if paid is not None:
            joined = paid_history_join(joined, paid)
        else:
            joined = joined.select("*", *[F.lit(default).alias(name) for name, default in _PAID.values()])
        if excluded is not None:
            joined = excluded_join(joined, excluded)
        else:
            joined = joined.withColumns(
                {"qtd_lancamentos_excluidos": F.lit(0), "bloqueado_exclusao": F.lit(False)}
            )
    balance, positive, negative = (
        F.col("saldo_comissao_paga_chassi"), F.col("tem_pagamento_positivo"), F.col("tem_estorno_negativo")
    )
    status = paid_status(F.col("qtd_lancamentos_pagos"), balance, positive, negative)
    return joined.withColumns(
        {
            "status_confronto": F.when(F.col("bloqueado_exclusao"), _EXCLUDED).otherwise(status),
            "bloqueado_pagamento": positive & ~negative & (balance > 0),
        }
    )


def open_candidates(history: DataFrame) -> DataFrame:
    """Rows still open for payment."""
    return history.where(~F.col("bloqueado_pagamento") & ~F.col("bloqueado_exclusao"))


def paid_history_filter(
    rows: DataFrame, paid: DataFrame | None, excluded: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(open candidates, full history); rows with reversals stay open for review."""
    full = paid_history(rows, paid, excluded)
    return open_candidates(full), full
