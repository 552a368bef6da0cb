"""Status decisions, each an ordered CASE."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from payouts.functions.numbers import is_settled
from payouts.schemas import STATUS_APTO, STATUS_NAO_APTO, STATUS_VERIFICAR

__all__ = ["combine_status", "incentive_detail", "incentive_status", "paid_status"]

# Detail texts (fixed values): one wording per title, one per chassis.
_INCENTIVE_DETAILS = {
    "title": (
        "Título não encontrado em bdnContasReceber",
        "Incentivo quitado",
        "Saldo pendente no título de incentivo",
    ),
    "chassis": (
        "Há título de incentivo não encontrado em bdnContasReceber",
        "Todos os títulos de incentivo estão quitados",
        "Há saldo pendente em título(s) de incentivo",
    ),
}


def incentive_status(balance: Column, missing: Column) -> Column:
    return F.when(missing, "VERIFICAR").when(is_settled(balance), "APTO").otherwise("NÃO APTO")


def incentive_detail(balance: Column, missing: Column, level: str = "chassis") -> Column:
    absent, settled, pending = _INCENTIVE_DETAILS[level]
    return F.when(missing, absent).when(is_settled(balance), settled).otherwise(pending)


def paid_status(count: Column, balance: Column, has_positive: Column, has_negative: Column) -> Column:
    """What the paid history says about a chassis; the first rule that holds decides."""
    both = has_positive & has_negative
    return (
        F.when((count == 0) & ~has_positive & ~has_negative, "Novo para apuração")
        .when(has_positive & ~has_negative & (balance > 0), "Já pago")
        .when(both & (balance > 0), "Atenção: pagamento e estorno parcial")
        .when(both & (balance < 0), "Atenção: histórico líquido negativo")
        .when(both, "Atenção: comissão anterior zerada por estorno")
        .when(has_negative, "Atenção: chassi com devolução/estorno histórico")
        .otherwise("Verificar histórico de comissões pagas")
    )


def combine_status(v1: Column, v2: Column) -> Column:
    doubtful = ("ERRO", "NÃO ENCONTRADO", "ATENÇÃO")
    clear = ("APTO", "N/A")
    return (
        F.when((v1 == "NÃO APTO") | (v2 == "NÃO APTO"), STATUS_NAO_APTO)
        .when(v1.isin(*doubtful) | v2.isin(*doubtful), STATUS_VERIFICAR)
        .when(v1.isin(*clear) & v2.isin(*clear), STATUS_APTO)
        .otherwise(STATUS_VERIFICAR)
    )
