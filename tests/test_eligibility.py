from payouts.operators import eligibility as E

NEW = "Maquinas JD - Novos"
ROWS = "row_id string, classificacao_venda string, nro_chassi string, nro_documento string, data_emissao string, valor_comissao_total double"


def sources(spark):
    incentives = spark.createDataFrame([("CH1", "I1", 1.0), ("CH2", "I2", 1.0), ("CH3", "I3", 1.0), ("CH4", None, 1.0)],
                                       "chassi string, nota_fiscal_numero string, valor_incentivo double")
    receivables = spark.createDataFrame([
        ("I1", "F", "IN", 0.0), ("I2", "F", "IN", 1234.5), ("I5", "F", "IN", None),
        ("10", "C1", "DP", 0.0), ("000000011", "C1", "BL", 50.0), ("12", "C1", "DP", 10.0), ("12", "C1", "BL", 5.0),
        ("13", "C1", None, 9.0), ("14", "C1", "DP", 10.0), ("14", "C1", "NF", -10.0), ("15", "C1", "bl ", 7.0), ("16", "C1", "DP", 3.0),
    ], "titulo_numero string, cliente_codigo string, tipo_titulo string, valor_saldo double").selectExpr("*", "date'2026-01-02' data_emissao")
    invoices = spark.createDataFrame([(n, "01/03/2026", "C1") for n in ("10", "000000011", "12", "13", "14", "15", "17")]
                                     + [("16", "01/02/2026", "C0"), ("16", "05/03/2026", "C1"), ("000000016", "01/03/2026", "C9")],
                                     "nota_fiscal_numero string, data_emissao string, cliente_codigo string")
    return incentives, receivables, invoices


def run(spark, rows):
    out = E.payment_eligibility(spark.createDataFrame(rows, ROWS), *sources(spark)).collect()
    return {r["row_id"]: r for r in out}


def test_incentive_decisions(spark):
    rows = [(str(i), NEW, c, "10", "01/03/2026", 1.0) for i, c in enumerate([" ch1", "CH2", "CH3", "CH4", "CH9", "-", None])]
    rows.append(("used", "Maquinas JD - Usados", "CH2", "10", "01/03/2026", 1.0))
    out = run(spark, rows)
    assert [out[str(i)]["v1_status"] for i in range(7)] == [
        "APTO", "NÃO APTO", "NÃO ENCONTRADO", "NÃO ENCONTRADO", "NÃO ENCONTRADO", "N/A", "N/A"]
    assert out["1"]["v1_detalhe"] == "Saldo pendente: R$ 1,234.50"
    assert out["2"]["v1_detalhe"] == "NF I3 não localizada em bdnContasReceber"
    assert out["4"]["v1_detalhe"] == "Chassi não localizado em bdnIncentivos"
    assert out["used"]["v1_detalhe"] == "Classificação 'Maquinas JD - Usados' não requer validação de chassi"
    assert out["0"]["status_geral"] == "✅ APTO" and out["1"]["status_geral"] == "❌ NÃO APTO"


def test_payment_decisions(spark):
    cases = {"10": "10", "11.0": "11.0", "12": "12", "13": "13", "14": "14", "15": "15", "17": "17", "99": "99", "nan": "nan"}
    out = run(spark, [(k, "x", "", d, "01/03/2026", 1.0) for k, d in cases.items()])
    got = {k: r["v2_status"] for k, r in out.items()}
    assert got == {"10": "APTO", "11.0": "APTO", "12": "NÃO APTO", "13": "NÃO APTO", "14": "APTO", "15": "APTO",
                   "17": "NÃO ENCONTRADO", "99": "NÃO ENCONTRADO", "nan": "N/A"}
    assert out["11.0"]["v2_detalhe"] == "Saldo R$ 50.00 - pendente apenas em BL (apto conforme regra)"
    assert out["12"]["v2_detalhe"] == "Saldo pendente R$ 15.00 - tipo(s) com saldo: BL/DP"
    assert out["13"]["v2_detalhe"] == "Saldo pendente R$ 9.00 - tipo(s) com saldo: N/A"
    assert out["99"]["v2_detalhe"] == "Documento 99 não localizado em bdnFaturamento"
    assert out["17"]["v2_detalhe"] == "Título 17 do cliente C1 não localizado em bdnContasReceber"


def test_invoice_choice_and_dates(spark):
    out = run(spark, [("same", "x", "", "16", "05/03/2026", 1.0), ("other", "x", "", "16", "09/09/2026", 1.0),
                      ("late", "x", "", "10", "02/03/2026", 1.0), ("none", "x", "", "10", None, 1.0), ("junk", "x", "", "10", "soon", 1.0)])
    assert out["same"]["v2_cliente_cod"] == "C1" and out["same"]["v2_status"] == "NÃO APTO"
    assert out["other"]["v2_cliente_cod"] == "C0"
    assert out["late"]["v2_status"] == "ATENÇÃO"
    assert out["late"]["v2_detalhe"] == "Cliente quitou integralmente | Data divergente: planilha=2026-03-02 | faturamento=2026-03-01"
    assert out["none"]["v2_status"] == "APTO" and out["junk"]["v2_status"] == "ERRO"
    assert out["junk"]["status_geral"] == "⚠️ VERIFICAR"


def test_totals_and_listing(spark):
    rows = spark.createDataFrame([("1", NEW, "CH1", "10", "01/03/2026", 5.0), ("2", NEW, "CH2", "10", "01/03/2026", 7.0)], ROWS)
    result = E.payment_eligibility(rows, *sources(spark))
    t = E.eligibility_totals(result).first()
    assert (t["total"], t["aptos"], t["nao_aptos"], t["valor_apto"], t["valor_nao_apto"], t["v1_pendentes"]) == (2, 1, 1, 5, 7, 1)
    listed = E.validation_listing(result, rows.selectExpr("*", "' ' as nome_cliente"))
    assert listed.columns[0] == "status_geral" and listed.count() == 2
