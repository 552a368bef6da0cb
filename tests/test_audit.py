import pytest

from payouts.operators import audit as A

COLUMNS = ("arquivo string, linha int, filial string, modelo string, nro_chassi string, nro_documento string, receita_bruta {0}, "
           "perc_comissao_fat {0}, valor_comissao_fat {0}, meta_margem {0}, perc_margem_bruta {0}, perc_comissao_margem {0}, "
           "valor_comissao_margem {0}, valor_comissao_total {0}")
NUMBER = ("f", 2, "B", "6125J", "CH1", "10", 10000.0, 5.0, 500.0, 12.5, 15.0, 1.25, 125.0, 625.0)
TEXT = ("f", 2, "B", "6125J", "CH1", "10", "R$ 10.000,00", "5,00%", "R$ 500,00", "12,50%", "15,00%", "1,25%", "125,00", "R$ 625,00")


def rules(spark):
    return (spark.createDataFrame([("6125J", "5,00%")], "Modelo string, Percentual string"),
            spark.createDataFrame([("6125J", "1,25%", "12,50%")], "Modelo string, Percentual string, Meta string"))


def extraction(spark, keys=(("CH1", "000000010"),)):
    return spark.createDataFrame(list(keys), "nro_chassi string, nro_documento string")


def audit(spark, rows, kind="double", base=None, drop=()):
    sheet = spark.createDataFrame(rows, COLUMNS.format(kind)).drop(*drop)
    issues = A.paid_sheet_audit(sheet, *rules(spark), extraction(spark) if base is None else base)
    return sheet, issues, sorted((r["linha"] or 0, r["severidade"], r["regra"]) for r in issues.collect())


@pytest.mark.parametrize("row,kind", [(NUMBER, "double"), (TEXT, "string")])
def test_clean_file_passes(spark, row, kind):
    sheet, issues, found = audit(spark, [row], kind)
    assert found == []
    s = A.audit_file_summary(sheet, issues, rules(spark)[0]).first()
    assert (s["status"], s["erros"], s["linhas_validadas"], s["receita_bruta_lida"], s["comissao_total_lida"]) == (
        "Aprovado", 0, 1, 10000, 625)
    assert s["sentinela_usado"] == s["sentinela_regra"] == "5.00%"


FAULTS = {
    "% Comissão Fat.": {7: 4.0, 8: 500.0, 13: 525.0},
    "Valor Comissão Fat. / Receita Bruta": {8: 900.0},
    "% Comissão Margem": {11: 2.0, 13: 700.0},
    "Meta de Margem": {9: 13.0},
    "Valor Comissão Margem / Receita Bruta": {12: 300.0},
    "Gatilho Comissão Margem": {10: 5.0, 13: 500.0},
    "Valor Comissão Total": {13: 626.0},
    "Chave na extração": {5: "11"},
}


@pytest.mark.parametrize("rule", FAULTS)
def test_each_fault_is_found_once(spark, rule):
    row = list(NUMBER)
    for at, v in FAULTS[rule].items():
        row[at] = v
    found = [r for _, s, r in audit(spark, [tuple(row)])[2] if not r.startswith("Modelo")]
    assert found == [rule]


def test_file_level_findings(spark):
    assert audit(spark, [NUMBER, NUMBER])[2] == [(2, "Erro", "Chave única")] * 2
    assert audit(spark, [NUMBER], base=extraction(spark, [("", "")]))[2] == [(0, "Erro", "Extração atual")]
    assert audit(spark, [NUMBER], drop=["meta_margem"])[2] == [(0, "Erro", "Coluna obrigatória")]
    other = (*NUMBER[:3], "X", *NUMBER[4:])
    assert (0, "Aviso", "Modelo 6125J") in audit(spark, [other])[2]
    wrong = (*NUMBER[:7], 4.0, *NUMBER[8:])
    assert (0, "Erro", "Modelo 6125J") in audit(spark, [wrong])[2]


def test_zero_gross_with_margin_value_breaks_the_trigger_rule(spark):
    row = (*NUMBER[:6], 0.0, 5.0, 0.0, 12.5, 15.0, 1.25, 9.0, 0.0)
    assert "Gatilho Comissão Margem" in [r for _, _, r in audit(spark, [row])[2]]


def test_details(spark):
    row = (*NUMBER[:13], 626.0)
    detail = audit(spark, [row])[1].first()["detalhe"]
    assert detail == "arquivo=626.0, recalculado=625.00 (fat=500.00, margem=125.00)"
