import pytest

from payouts.operators import reports as R

LEDGER = ("mes_ano_comissao string, cod_vendedor string, cen string, gerente string, classificacao_venda string, nro_documento string, "
          "valor_comissao_fat double, valor_comissao_margem double, valor_comissao_total double, receita_bruta double, "
          "margem_incentivos_rs double, receita_bruta_incentivos_rs double, perc_margem_bruta double, filial string")
L = "Abril/2026"


@pytest.fixture(scope="module")
def ledger(spark):
    rows = [
        (L, " s1", "A", "Gestão X", "Maquinas JD - Novos", "1", 100.0, 10.0, None, 1000.0, 100.0, 1200.0, 10.0, "B1"),
        (L, "S1", "A", "GESTAO X", "Invasão de área", "2", 50.0, 0.0, 50.0, 500.0, 50.0, 600.0, 20.0, "B1"),
        (L, "S1", "A", "gestão x", "Outra", "3", 50.0, 5.0, 55.0, 400.0, 50.0, 500.0, 30.0, " "),
        (L, "S9", "Z", None, "Implemento", "4", 7.0, 0.0, 7.0, 150000.0, 50.0, 500.0, 30.0, "B2"),
        (L, None, "Z", " ", "Maquinas JD - Usados", "5", 7.0, 0.0, 0.0, 70.0, 50.0, 0.0, 30.0, "B2"),
        ("Maio/2026", "S1", "A", "Gestão X", "Implemento", "6", 1.0, 1.0, 2.0, 1.0, 1.0, 1.0, 1.0, "B1"),
    ]
    return spark.createDataFrame(rows, LEDGER)


@pytest.fixture(scope="module")
def relations(spark):
    return spark.createDataFrame([("S1", "SELLER A", "Gestão X"), ("S2", "SELLER B", "Gestão X"), ("S3", "Gestao X", "Gestão X"),
                                  ("S4", "", "Gestão X")], "cod_vendedor string, vendedor string, gerente string")


def test_seller_report_and_pending_cover_the_period(ledger, relations):
    a, b = R.cen_report(ledger, relations, L).collect()
    assert (a["cen"], a["comissao_faturamento"], a["comissao_invasao_area"], a["comissao_margem"], a["valor_comissao_total"]) == (
        "SELLER A", 100, 50, 15, 165)
    assert (b["cen"], b["valor_comissao_total"]) == ("SELLER B", 0)
    pending = {r["nro_documento"]: r["pendencia"] for r in R.cen_pending(ledger, relations, L).collect()}
    assert pending == {"4": "Cod_vendedor sem relação CEN x Gerente", "5": "Sem cod_vendedor"}


def test_manager_report(ledger):
    [r] = R.manager_report(ledger, L).collect()
    assert r["perc_margem_bruta"] == pytest.approx((10 * 1200 + 20 * 600 + 30 * 500) / 2300)
    assert (r["receita_bruta"], r["comissao_total_cen"], r["comissao_gerente"]) == (1900, 215, pytest.approx(70.95))


def test_coordinator_report(ledger):
    implement, used = R.coordinator_report(ledger, L, "COORDINATOR").collect()
    assert (implement["tipo"], implement["valor_comissao_fat"], implement["valor_total_comissao"]) == ("Implemento", 300, 600)
    assert (used["tipo"], used["perc_mb_realizado"]) == ("Maquinas JD - Usados", 0)


def test_analytic_reports(ledger):
    assert [r["nro_documento"] for r in R.branch_analytic(ledger, L).collect()] == ["1", "2", "4"]
    used = R.used_implements_analytic(ledger, L)
    assert [r["nro_documento"] for r in used.collect()] == ["4", "5"] and len(used.columns) == 16
