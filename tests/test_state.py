"""Summaries kept as stored state equal those computed from the whole ledger."""

import random
from datetime import date

from pyspark.sql import functions as F

from payouts.operators import history as H
from payouts.sources import ledger as G


def _sorted(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_state_after_random_postings_equals_the_summary(spark, tmp_path):
    path, state = str(tmp_path / "paid"), str(tmp_path / "state")
    pick = random.Random(7)
    for n in range(6):
        month = pick.choice([1, 2, 3])
        rows = [(f"ch{pick.randint(0, 12)} ", pick.choice([10.0, -2.5, 0.0, None, 7.25])) for _ in range(pick.randint(1, 9))]
        frame = spark.createDataFrame(rows, "nro_chassi string, valor_comissao_total double")
        period = G.period_columns(2026, month, f"M{month}/2026", date(2026, month, 1), date(2026, month, 28))
        G.append_paid_ledger(frame, path, period, posting_id=f"p{n}")
        G.refresh_state(G.read_ledger(spark, path), state, H.paid_state, [(2026, month)])
        ledger = G.read_ledger(spark, path)
        assert _sorted(H.merge_paid_state(spark.read.parquet(state))) == _sorted(H.paid_summary(ledger))


def test_a_refresh_reads_its_competence_alone(spark, tmp_path):
    path, state = str(tmp_path / "paid"), str(tmp_path / "state")
    frame = spark.createDataFrame([("a", 1.0), ("b", -1.0)], "nro_chassi string, valor_comissao_total double")
    for month in (1, 2):
        G.append_paid_ledger(frame, path, G.period_columns(2026, month, f"M{month}/2026"))
    G.refresh_state(G.read_ledger(spark, path), state, H.paid_state)
    before = {(r.competencia_mes, r.nro_chassi): r.qtd_lancamentos_pagos for r in spark.read.parquet(state).collect()}
    assert sorted(before.values()) == [1, 1, 1, 1] and {m for m, _ in before} == {1, 2}
    rows = G.read_ledger(spark, path).where((F.col("competencia_ano") == 2026) & (F.col("competencia_mes") == 2))
    plan = H.paid_state(rows)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(competencia_ano" in plan and "(competencia_mes" in plan.split("PartitionFilters: ")[1].split("]")[0]
    excluded = spark.createDataFrame([("x", date(2026, 1, 5)), ("x", date(2026, 2, 9))], "nro_chassi string, paid_at date").selectExpr(
        "nro_chassi", "CAST(paid_at AS timestamp) AS paid_at", "2026 AS competencia_ano", "month(paid_at) AS competencia_mes")
    assert _sorted(H.merge_excluded_state(H.excluded_state(excluded))) == _sorted(H.excluded_summary(excluded))


def test_settlement_after_random_postings_equals_the_full_one(spark, tmp_path):
    from payouts.operators.history import excluded_summary, paid_history, paid_summary
    from payouts.plans.settlement import settlement_after_posting

    calculated = spark.createDataFrame([(i, f" ch{i % 9}", float(i)) for i in range(40)] + [(99, None, 1.0)], "row_id long, nro_chassi string, valor double")
    path, pick = str(tmp_path / "paid"), random.Random(11)
    excluded = spark.createDataFrame([("CH3", date(2024, 5, 1))], "nro_chassi string, paid_at date").selectExpr("nro_chassi", "CAST(paid_at AS timestamp) AS paid_at")
    full = paid_history(calculated, None, excluded_summary(excluded))
    for n in range(5):
        rows = [(f"ch{pick.randint(0, 11)}", pick.choice([10.0, -10.0, 3.5])) for _ in range(pick.randint(1, 4))]
        posted = spark.createDataFrame(rows, "nro_chassi string, valor_comissao_total double")
        G.append_paid_ledger(posted, path, G.period_columns(2026, 1 + n % 3, "x"), posting_id=f"s{n}")
        paid = paid_summary(G.read_ledger(spark, path))
        open_rows, full = settlement_after_posting(full, calculated, posted, paid, excluded_summary(excluded))
        full = spark.createDataFrame(full.collect(), full.schema)  # as a stored table would be
        whole = paid_history(calculated, paid, excluded_summary(excluded))
        assert _sorted(full) == _sorted(whole)
        assert _sorted(open_rows) == _sorted(whole.where("NOT bloqueado_pagamento AND NOT bloqueado_exclusao"))
