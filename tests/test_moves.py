"""What is moved, and how often it is made: rows go through joins narrow, and a posting makes its rows once."""

import time
from contextlib import contextmanager
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from payouts.functions import source_key
from payouts.operators import eligibility as E
from payouts.plans.settlement import machine_settlement
from payouts.plans.star_queries import Frames
from payouts.sources import ledger as G
from payouts.sources.stage import stage


@pytest.fixture(scope="module")
def x(spark):
    return Frames(spark, "/root/testdata/sf0.001")


@contextmanager
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rules_are_planned_by_their_own_size(x):
    for rules in (x.fat(), x.margin(), x.managers()):
        assert not [f for f in rules.inputFiles() if f.endswith(("part.parquet", "supplier.parquet"))]


def test_invoices_are_moved_without_a_second_copy_of_their_codes(spark, x):
    with no_broadcast(spark):
        text = plan(x.base())
    assert "_seller#" not in text and "_customer#" not in text


def test_lookup_keys_of_the_extraction_are_no_columns(spark, x):
    with no_broadcast(spark):
        text = plan(x.base())
    assert "SortMergeJoin" in text and "_common_expr" not in text
    keys = spark.createDataFrame([(" a ",), ("  ",), ("",), (None,)], "k string")
    assert [r[0] for r in keys.select(source_key(F.col("k"))).collect()] == ["A", None, None, None]


def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(blocks.size()) if (name := blocks.apply(i).getName()).startswith("shuffle_")}


def test_the_shuffle_files_of_a_staged_table_go_with_its_write(spark, tmp_path):
    before = shuffle_files(spark)
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    table = stage(rows, "counts")
    period = G.period_columns(2024, 5, "Junho/2024")
    G.append_paid_ledger(rows.select(F.col("k").cast("string").alias("nro_chassi")), str(tmp_path / "ledger"), period, posting_id="a")
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert table.count() == 7 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_history_is_joined_before_the_commission_columns(spark, x):
    base = spark.createDataFrame(
        [("M", "Maquinas JD - Novos", "CH1", 100.0, 1.0, "S1"), ("M", None, None, 50.0, 1.0, None)],
        "modelo string, classificacao_venda string, nro_chassi string, receita_bruta double, perc_margem_bruta double, cod_vendedor string")
    paid = spark.createDataFrame(
        [("CH1", 1, 5.0, 0.0, 5.0, True, False)],
        "nro_chassi string, qtd_lancamentos_pagos long, valor_pago_positivo double, valor_estornado_negativo double, "
        "saldo_comissao_paga_chassi double, tem_pagamento_positivo boolean, tem_estorno_negativo boolean")
    with no_broadcast(spark):
        candidates, full = machine_settlement(base, x.fat(), x.margin(), paid, x.managers(), x.excluded())
        below = plan(full).split("hashpartitioning(_chassis#", 1)[1]
    assert "regra_classificacao_aplicada" not in below and "valor_comissao_gerente" not in below
    assert [r["bloqueado_pagamento"] for r in full.orderBy("receita_bruta").collect()] == [False, True]
    assert [r["nro_chassi"] for r in candidates.collect()] == [None]
    assert full.columns[-2:] == ["status_confronto", "bloqueado_pagamento"]


def test_eligibility_moves_rows_as_they_came(spark):
    rows = spark.createDataFrame(
        [("f", "c", "n", "Maquinas JD - Novos", "10", "CH1", date(2020, 1, 1), 1.0, "a"),
         ("f", "c", "n", "Maquinas JD - Novos", "10", " ", date(2020, 1, 1), 1.0, "b"),
         ("f", "c", "n", "Implemento", None, "CH1", None, 1.0, "c"),
         ("f", "c", "n", None, "11", None, date(2020, 1, 1), 1.0, "d")],
        ", ".join(f"{c} {'date' if c == 'data_emissao' else 'double' if c.startswith('valor') else 'string'}" for c in E.ROW_COLUMNS))
    incentives = spark.createDataFrame([("ch1", "I1", 5.0)], "chassi string, nota_fiscal_numero string, valor_incentivo double")
    owed = spark.createDataFrame(
        [("I1", "FAB", "IN", 0.0, date(2020, 1, 1)), ("10", "C1", "NF", 0.0, date(2020, 1, 1))],
        "titulo_numero string, cliente_codigo string, tipo_titulo string, valor_saldo double, data_emissao date")
    invoices = spark.createDataFrame([("10", date(2020, 1, 1), "C1")], "nota_fiscal_numero string, data_emissao date, cliente_codigo string")
    with no_broadcast(spark):
        found = E.payment_eligibility(rows, incentives, owed, invoices)
        assert ", dia#" not in "".join(s for s in plan(found).splitlines() if "Exchange" in s)  # keys are no columns
        got = {r["row_id"]: (r["v1_status"], r["v2_status"]) for r in found.collect()}
    assert got == {"a": ("APTO", "APTO"), "b": ("N/A", "APTO"), "c": ("N/A", "N/A"), "d": ("N/A", "NÃO ENCONTRADO")}


def test_payment_results_are_a_table_before_rows_are_moved(spark):
    types = {"data_emissao": "date", "valor_comissao_total": "double"}
    rows = spark.createDataFrame([], ", ".join(f"{c} {types.get(c, 'string')}" for c in E.ROW_COLUMNS))
    incentives = spark.createDataFrame([], "chassi string, nota_fiscal_numero string, valor_incentivo double")
    owed = spark.createDataFrame([], "titulo_numero string, cliente_codigo string, tipo_titulo string, valor_saldo double, data_emissao date")
    invoices = spark.createDataFrame([], "nota_fiscal_numero string, data_emissao date, cliente_codigo string")
    found = E.payment_eligibility(rows, incentives, owed, invoices)
    assert [f for f in found.inputFiles() if "payment_results" in f] and not found.collect()


def test_a_posting_makes_its_rows_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def noted(text):
        made.add(1)
        return text

    rows = spark.range(5).select(noted(F.concat(F.lit("CH"), "id")).alias("nro_chassi"))
    period = G.period_columns(2024, 5, "Junho/2024")
    path = str(tmp_path / "ledger")
    assert G.append_paid_ledger(rows, path, period) == 5
    assert made.value == 5
    assert G.append_paid_ledger(rows, path, period) == 0  # the same rows again, known by their digest
    assert len(list(Path(path, "postings").iterdir())) == 1
    assert sorted(r["id"] for r in G.read_ledger(spark, path).collect()) == [0, 1, 2, 3, 4]
    prepared = G.prepare_ledger_rows(rows, period)
    assert G.manifest(spark, path)[0]["posting"] == G.posting_digest(prepared)
