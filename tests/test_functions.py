from datetime import date

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from payouts import functions as fn


def lit(v):
    return F.lit(v).cast("string") if v is None else F.lit(v)


@pytest.mark.parametrize("text,expected", [
    ("R$ 15.000,00", 15000.0), ("22,50%", 22.5), ("1234.5", 1234.5), ("", None), ("x", None), ("1d", None),
    ("NaN", None), ("1e3", 1000.0), (" -7 ", -7.0),
])
def test_parse_br_number(value, text, expected):
    assert value(fn.parse_br_number(lit(text))) == expected


def test_percent_scales(value):
    assert value(fn.parse_percent_points(lit("5,00%"))) == 5
    assert value(fn.parse_percent_points(lit("0,20%"))) == 0.2
    assert value(fn.parse_percent_points(lit(0.05), False)) == 5
    assert value(fn.parse_percent_points(lit(0.84), False)) == 84
    assert value(fn.parse_commission_points(lit(45.0), False)) == 0.45
    assert value(fn.parse_commission_points(lit(0.45), False)) == 0.45
    assert value(fn.parse_margin_points(lit(0.15), False)) == 15
    assert value(fn.parse_margin_points(lit("0,15"))) == 15
    assert value(fn.parse_margin_points(lit("0,15%"))) == 0.15
    assert value(fn.parse_margin_points(lit(None))) == 0


def test_double_read_is_not_idempotent(value):
    once = fn.rate_read_percent(F.lit(1500.0))
    assert value(once) == 15 and value(fn.parse_commission_points(once, False)) == 0.15


def test_formats(value):
    assert value(fn.format_currency_br(F.lit(15000.0))) == "R$ 15.000,00"
    assert value(fn.format_percent_br(F.lit(0.2))) == "0,20%"
    assert value(fn.format_currency_br(F.lit(None).cast("double"))) == ""


@given(st.integers(-10**11, 10**11))
@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_format_then_parse(value, cents):
    assert value(fn.parse_br_number(fn.format_currency_br(F.lit(cents / 100)))) == pytest.approx(cents / 100)


@pytest.mark.parametrize("text,plain,padded", [
    ("046254.0", "46254", "000046254"), (" 12 ", "12", "000000012"), ("AB1", "AB1", "000000AB1"),
    ("1234567890", "1234567890", "1234567890"), ("", "", ""), (None, "", ""), ("1e5", "100000", "000100000"),
    ("-5", "-5", "-00000005"), ("inf", "inf", "000000inf"),
])
def test_documents(value, text, plain, padded):
    assert value(fn.norm_document(lit(text))) == plain
    assert value(fn.pad_document(lit(text))) == padded


def test_keys(value):
    assert value(fn.norm_key(F.lit(" \t6125j "))) == "6125J"
    assert value(fn.fold_text(F.lit(" Invasão de área "))) == "INVASAO DE AREA"
    assert value(fn.fold_text_exact(F.lit("ﬁm Ção"))) == "FIM CAO"
    assert value(fn.is_blank_key(F.lit(" NaN "))) and not value(fn.is_blank_key(F.lit("CH1")))
    assert value(fn.is_blank_key(F.lit(0), numeric=True))
    assert value(fn.sanitize_label(F.lit(" Abril/2026 x "))) == "Abril_2026_x"
    assert value(fn.sanitize_label(F.lit("  "))) == "periodo"


def test_periods(value):
    def period(y, m):
        return value(fn.commission_period(F.lit(date(y, m, 1))))

    march = period(2026, 3)
    assert (march["label"], march["start_date"], march["end_date"]) == ("Abril/2026", date(2026, 3, 16), date(2026, 4, 15))
    assert period(2026, 12)["label"] == "Janeiro/2027"
    assert len(value(fn.period_options(F.lit(date(2026, 5, 20))))) == 36
    assert value(fn.default_period(F.lit(date(2026, 1, 3)))) == date(2025, 12, 1)
    assert value(fn.period_of_date(F.lit(date(2026, 3, 15)))) == date(2026, 2, 1)
    assert value(fn.period_of_date(F.lit(date(2026, 3, 16)))) == date(2026, 3, 1)


def test_period_from_file_name(value):
    known = ["Abril/2026"]
    assert value(fn.infer_period_label(F.lit("pago 15-04-2026.xlsx"), known, "x")) == "Abril/2026"
    assert value(fn.infer_period_label(F.lit("pago 15_13_2026.xlsx"), known, "x")) == "x"
    assert value(fn.infer_period_label(F.lit("pago.xlsx"), known, "x")) == "x"


def test_dates(value):
    assert value(fn.parse_date_br(F.lit("5/3/2026"))) == date(2026, 3, 5)
    assert value(fn.parse_date_br(F.lit("31/02/2026"))) is None


def test_statuses(value):
    def paid(n, balance, pos, neg):
        return value(fn.paid_status(F.lit(n), F.lit(balance), F.lit(pos), F.lit(neg)))

    assert paid(0, 0.0, False, False) == "Novo para apuração"
    assert paid(1, 5.0, True, False) == "Já pago"
    assert paid(2, 5.0, True, True) == "Atenção: pagamento e estorno parcial"
    assert paid(2, -5.0, True, True) == "Atenção: histórico líquido negativo"
    assert paid(2, 0.0, True, True) == "Atenção: comissão anterior zerada por estorno"
    assert paid(1, -5.0, False, True) == "Atenção: chassi com devolução/estorno histórico"
    assert paid(1, 0.0, False, False) == "Verificar histórico de comissões pagas"
    assert value(fn.combine_status(F.lit("APTO"), F.lit("N/A"))) == "✅ APTO"
    assert value(fn.combine_status(F.lit("ERRO"), F.lit("NÃO APTO"))) == "❌ NÃO APTO"
    assert value(fn.combine_status(F.lit("APTO"), F.lit("ATENÇÃO"))) == "⚠️ VERIFICAR"


def test_matches_rule(value):
    allowed = F.array(F.lit(0.45), F.lit(1.0))
    assert value(fn.matches_rule(F.lit(0.455), allowed)) and not value(fn.matches_rule(F.lit(0.5), allowed))
    assert not value(fn.matches_rule(F.lit(1.0), F.array().cast("array<double>")))
    assert not value(fn.matches_rule(F.lit(None).cast("double"), allowed))


def test_money_sum_loses_no_amount(spark):
    from pyspark.errors import ArithmeticException, PySparkException

    from payouts.functions.numbers import money_sum

    amounts = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (2.5,)], "v double")
    assert amounts.agg(money_sum(F.col("v")).alias("t")).first()["t"] == 3.5
    for bad in (1e23, float("inf")):
        with pytest.raises((ArithmeticException, PySparkException)):
            spark.createDataFrame([(1.0,), (bad,)], "v double").agg(money_sum(F.col("v"))).collect()


def test_label_base():
    from payouts.functions import label_base

    assert (label_base("Abril/1996"), label_base("Janeiro/1997"), label_base("x"), label_base("Abril/")) == ((1996, 3), (1996, 12), None, None)


def test_fold_text_follows_unicode_decompositions(value):
    assert value(fn.fold_text(F.lit("Ｆｉｌｉａｌ Ｎｏｒｔｅ 𝐀 Ç"))) == "FILIAL NORTE A C"
