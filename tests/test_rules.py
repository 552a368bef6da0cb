import pytest

from payouts.operators import history as H
from payouts.operators import rules as U
from payouts.operators.reconcile import machine_totals
from payouts.plans.settlement import machine_settlement

BASE = "modelo string, classificacao_venda string, receita_bruta double, perc_margem_bruta double"


def rates(spark, fat=(), margin=()):
    return (spark.createDataFrame(list(fat), "modelo string, percentual double"),
            spark.createDataFrame(list(margin), "modelo string, percentual double, meta_margem double"))


def run(spark, rows, fat=(), margin=()):
    return U.commission_rules(spark.createDataFrame(rows, BASE), *rates(spark, fat, margin)).collect()


def test_keys_are_normalised(spark):
    [r] = run(spark, [(" 6125j ", "Maquinas JD - Novos", 10000.0, 15.0)], [("6125J", 5.0)], [("6125J ", 1.25, 12.5)])
    assert (r["valor_comissao_fat"], r["valor_comissao_margem"], r["valor_comissao_total"]) == (500, 125, 625)
    assert r["gatilho_margem_atingido"] and r["meta_margem"] == 12.5


@pytest.mark.parametrize("sale_class,gross,percent,value", [
    ("Implemento", 250000.0, 0.84, 2100), ("Implemento", 200000.0, 0.84, 1680), ("Implemento", 150000.0, 1.0, 1500),
    ("Maquinas JD - Usados", 80000.0, 1.0, 800),
])
def test_class_overrides(spark, sale_class, gross, percent, value):
    [r] = run(spark, [("M", sale_class, gross, 50.0)], [("M", 3.0)], [("M", 2.0, 1.0)])
    assert r["perc_comissao_fat"] == percent and r["valor_comissao_fat"] == pytest.approx(value)
    assert r["perc_comissao_margem"] == r["meta_margem"] == r["valor_comissao_margem"] == 0
    assert r["regra_classificacao_aplicada"] and r["regra_fat_encontrada"] and not r["gatilho_margem_atingido"]


def test_old_imports_are_scaled(spark):
    [r] = run(spark, [("M", "x", 1000.0, 50.0)], [("M", 45.0)], [("M", 20.0, 45.0)])
    assert (r["perc_comissao_fat"], r["perc_comissao_margem"], r["meta_margem"]) == (0.45, 0.2, 45)


def test_trigger_boundary(spark):
    rows = [("M", "x", 20000.0, 10.0), ("M", "x", 20000.0, 12.5)]
    out = sorted(r["valor_comissao_margem"] for r in run(spark, rows, [], [("M", 1.25, 12.5)]))
    assert out == [0, 250]


def test_unknown_model(spark):
    [r] = run(spark, [(None, None, 1000.0, 5.0)])
    assert r["valor_comissao_total"] == 0 and not r["regra_fat_encontrada"] and not r["regra_margem_encontrada"]


def test_manager_commission(spark):
    rows = spark.createDataFrame([(" a0000e ", 100.0), ("B", 50.0)], "cod_vendedor string, valor_comissao_total double")
    rel = spark.createDataFrame([("A0000E", " MANAGER X ", 33.0)], "cod_vendedor string, gerente string, percentual_comissao_gerente double")
    a, b = sorted(U.manager_commission(rows, rel).collect(), key=lambda r: r["cod_vendedor"])
    assert (a["gerente"], a["valor_comissao_gerente"], a["regra_gerente_encontrada"]) == ("MANAGER X", 33, True)
    assert (b["gerente"], b["valor_comissao_gerente"], b["regra_gerente_encontrada"]) == ("", 0, False)
    none = U.manager_commission(rows, None).collect()
    assert all(r["valor_comissao_gerente"] == 0 for r in none)
    default = U.manager_commission(rows, rel.drop("percentual_comissao_gerente")).where("gerente <> ''").first()
    assert default["perc_comissao_gerente"] == 33


def test_existing_manager_column_wins(spark):
    rows = spark.createDataFrame([("A", 100.0, "OLD")], "cod_vendedor string, valor_comissao_total double, gerente string")
    rel = spark.createDataFrame([("A", "NEW", 10.0)], "cod_vendedor string, gerente string, percentual_comissao_gerente double")
    r = U.manager_commission(rows, rel).first()
    assert r["gerente"] == "OLD" and r["valor_comissao_gerente"] == 10


def test_default_rate(spark):
    schema = "perc_comissao_fat double, receita_bruta double, valor_comissao_fat double, valor_comissao_margem double, valor_comissao_total double"
    rows = spark.createDataFrame([(0.0, 10000.0, 0.0, 50.0, 50.0), (2.0, 10000.0, 200.0, 0.0, 200.0)], schema)
    a, b = sorted(U.default_fat_rate(rows).collect(), key=lambda r: r["perc_comissao_fat"])
    assert (a["valor_comissao_fat"], a["valor_comissao_total"], a["padrao_fat_aplicado"]) == (100, 150, True)
    assert (b["valor_comissao_total"], b["padrao_fat_aplicado"]) == (200, False)
    assert U.default_fat_rate(rows, enabled=False).where("padrao_fat_aplicado").isEmpty()


def test_latest_rates(spark):
    rows = spark.createDataFrame(
        [(1, "m ", 45.0, True, "2024-01-01", 1), (2, "M", 0.7, True, "2024-01-01", 2), (3, "M", 9.0, False, "2025-01-01", 3)],
        "id int, modelo string, percentual double, ativo boolean, updated_at string, row_seq int")
    [r] = U.latest_fat_rates(rows).collect()
    assert (r["id"], r["percentual"]) == (2, 0.7)


def test_settlement_views_cover_all_rows(spark):
    base = spark.createDataFrame(
        [("CH1", "S1", "M", "x", 1000.0, 5.0, 1.0, 0.0), (" ch2 ", "S1", "M", "x", 1000.0, 5.0, 1.0, 0.0),
         ("CH3", "S1", "M", "x", 1000.0, 5.0, 1.0, 0.0), ("", "S1", "M", "x", 1000.0, 5.0, 1.0, 0.0)],
        "nro_chassi string, cod_vendedor string, " + BASE + ", margem_rs double, valor_incentivo double")
    ledger = spark.createDataFrame([("CH1", 10.0), ("ch1 ", None), ("CH2", 10.0), ("CH2", -3.0), (None, 5.0)],
                                   "nro_chassi string, valor_comissao_total double")
    excluded = H.excluded_summary(spark.createDataFrame([("CH3",)], "nro_chassi string").selectExpr("*", "current_timestamp() paid_at"))
    fat, margin = rates(spark, [("M", 1.0)])
    open_rows, full = machine_settlement(base, fat, margin, H.paid_summary(ledger), None, excluded, True)
    status = {r["nro_chassi"].strip(): r["status_confronto"] for r in full.collect()}
    assert status == {"CH1": "Já pago", "ch2": "Atenção: pagamento e estorno parcial", "CH3": "Excluído manualmente",
                      "": "Novo para apuração"}
    assert sorted(r["nro_chassi"].strip() for r in open_rows.collect()) == ["", "ch2"]
    totals = machine_totals(open_rows, full).first()
    assert (totals["registros"], totals["linhas_historico"], totals["bloqueadas_pagamento"], totals["excluidas"]) == (2, 4, 1, 1)
    only_paid, everything = H.paid_history_filter(base, None, None)
    assert only_paid.count() == everything.count() == 4


def test_calculation_and_audit_prefer_their_own_header(spark):
    from payouts.operators.audit import allowed_fat_rates
    from payouts.operators.rules import calc_rate_table

    rates = spark.createDataFrame([("M", 1.0, 2.0)], "modelo string, percentual double, `% Comissão Fat.` double")
    assert calc_rate_table(rates).first()["percentual"] == 1.0
    assert allowed_fat_rates(rates).first()["percentuais_fat"] == [2.0]
