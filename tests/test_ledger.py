from datetime import date

import pytest

from payouts import schemas as S
from payouts.operators import selection as L
from payouts.operators import shape as P
from payouts.plans.posting import PostingBlocked, post_exclusions, post_payments
from payouts.sources import ledger as G
from payouts.sources.stage import stage

PERIOD = dict(year=2026, month=3, label="Abril/2026", start=date(2026, 3, 16), end=date(2026, 4, 15), source="manual")


def test_rows_take_the_ledger_shape(spark):
    rows = spark.createDataFrame([("05/03/2026", "R$ 15.000,00", 0.05, "22,50%", 0.12, 33.0)], (
        "`Data de Emissão` string, `Receita Bruta` string, `% Comissão Fat.` double, `% Margem Bruta` string, `Meta de Margem` double, "
        "`% ComissÃ£o Gerente` double"))
    r = G.prepare_ledger_rows(rows, G.period_columns(**PERIOD)).first()
    assert (r["data_emissao"], r["receita_bruta"], r["perc_comissao_fat"], r["perc_margem_bruta"], r["meta_margem"]) == (
        date(2026, 3, 5), 15000, 5, 22.5, 12)
    assert (r["perc_comissao_gerente"], r["mes_ano_comissao"], r["competencia_mes"], r["valor_comissao_total"]) == (33, "Abril/2026", 3, None)
    points = G.prepare_ledger_rows(rows, G.period_columns(**PERIOD), percent_mode="points").first()
    assert points["perc_comissao_fat"] == 0.05


def test_append_then_read(spark, tmp_path):
    path = str(tmp_path / "paid")
    rows = spark.createDataFrame([("CH1", 10.0), ("CH2", -2.5)], "nro_chassi string, valor_comissao_total double")
    assert G.append_paid_ledger(rows, path, G.period_columns(**PERIOD)) == 2
    assert G.append_paid_ledger(rows.limit(0), path, G.period_columns(**PERIOD)) == 0
    later = {**PERIOD, "month": 4, "label": "Maio/2026"}
    assert G.append_excluded_ledger(rows.limit(1), path, G.period_columns(**later)) == 1
    ledger = G.read_ledger(spark, path)
    month = G.ledger_by_competence(ledger, 2026, 3)
    assert month.count() == 2 and "PartitionFilters: [isnotnull(competencia_ano" in month._jdf.queryExecution().executedPlan().toString()
    assert [r[0] for r in G.ledger_period_labels(ledger).collect()] == ["Maio/2026", "Abril/2026"]
    assert G.ledger_by_label(ledger, "Maio/2026").count() == 1
    assert P.schema_status(ledger).where("status <> 'OK'").isEmpty()
    missing = P.schema_status(ledger.drop("cmv")).where("status = 'Ausente'").collect()
    assert [r["coluna"] for r in missing] == ["cmv"]


def test_rule_log_modes(spark, tmp_path):
    path = str(tmp_path / "rates")

    def add(op, batch, percent):
        upload = spark.createDataFrame([("M", percent)], "Modelo string, Percentual double")
        return G.append_rules(P.prepare_fat_rates(upload), path, "fat", op, batch)

    def active():
        return sorted(float(r["percentual"]) for r in G.rules_in_force(spark, path, "fat").collect())

    assert add("append", 1, 1.0) == 1
    add("append", 2, 2.0)
    assert active() == [1, 2]
    add("replace", 3, 3.0)
    add("append", 4, 4.0)
    assert active() == [3, 4] and G.rules_with_state(spark, path, "fat").count() == 4
    add("reset", 5, 5.0)
    assert active() == [5] and G.rules_with_state(spark, path, "fat").count() == 1
    with pytest.raises(ValueError):
        add("drop", 6, 1.0)


def test_manager_upload(spark):
    upload = spark.createDataFrame([("B", "MANAGER X", " a1 ", "X1", "SELLER A"), ("B", "", "A2", "X2", "SELLER B")],
                                   "Filial string, Gerente string, `Cod Vendedor` string, `Cod X` string, Vendedor string")
    [r] = P.prepare_manager_relations(upload).collect()
    assert (r["cod_vendedor"], r["gerente"], r["percentual_comissao_gerente"], r["ativo"]) == ("A1", "MANAGER X", 33, True)


def test_selection_and_posting(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), f"CH{i}", 10.0) for i in range(5)], "row_id string, nro_chassi string, valor_comissao_total double")
    marks = "row_id string, pagar boolean, excluir boolean"
    current = spark.createDataFrame([("0", True, False), ("1", True, False)], marks)
    edits = spark.createDataFrame([("1", False, False), ("2", True, None), ("3", False, True)], marks)
    merged = L.merge_selection(current, edits)
    assert sorted(tuple(r) for r in merged.collect()) == [("0", True, False), ("2", True, False), ("3", False, True)]
    assert L.marked_rows(rows, merged).where("pagar").count() == 2
    paid, excluded = str(tmp_path / "p"), str(tmp_path / "e")
    period = G.period_columns(**PERIOD)
    with pytest.raises(PostingBlocked):
        post_payments(rows, merged, paid, period)
    assert post_exclusions(rows, merged, excluded, period) == 1
    pay = merged.where("not excluir")
    keep = spark.createDataFrame([("0", True), ("2", False)], "row_id string, confirmar boolean")
    assert post_payments(rows, pay, paid, period, keep) == 1
    assert [r["nro_chassi"] for r in G.read_ledger(spark, paid).collect()] == ["CH0"]
    both = spark.createDataFrame([("0", True, True)], marks)
    with pytest.raises(PostingBlocked):
        post_exclusions(rows, both, excluded, period)


def test_tables_and_export(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS payouts_t LOCATION '{tmp_path}/db'")
    G.create_ledger_table(spark, "payouts_t.paid")
    G.create_rule_table(spark, "payouts_t.fat", "fat")
    assert set(spark.table("payouts_t.paid").columns) == set(S.LEDGER_SCHEMA.names)
    assert G.evolve_table(spark, "payouts_t.fat", {"grupo": "string", "nota": "string"}) == ["nota"]
    spark.sql("DROP DATABASE payouts_t CASCADE")
    report = spark.createDataFrame([("B1", 1.0), ("B2", 2.0)], "filial string, v double").selectExpr("*", "current_timestamp() t")
    G.export_report(report, str(tmp_path / "out"), partition_by="filial")
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
    assert stage(report, "r").count() == 2


def test_one_posting_sorts_in_many_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    path = str(tmp_path / "paid")
    rows = spark.range(20_000).select(F.concat(F.lit("CH"), "id").alias("nro_chassi"), (F.col("id") % 9).cast("double").alias("valor_comissao_total"))
    G.append_paid_ledger(rows, path, G.period_columns(**PERIOD))
    month = G.ledger_by_competence(G.read_ledger(spark, path), 2026, 3)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        held = month.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(held) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(r["count"] for r in held) < 10_000


def test_reports_of_a_period_read_its_partition(spark, tmp_path):
    from payouts.operators import reports as R

    path = str(tmp_path / "paid")
    rows = spark.createDataFrame([("CH1", 10.0)], "nro_chassi string, valor_comissao_total double")
    G.append_paid_ledger(rows, path, G.period_columns(**PERIOD))
    ledger = G.read_ledger(spark, path)
    for frame in (R.report_paid_rows(ledger, "Abril/2026"), G.ledger_by_label(ledger, "Abril/2026")):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "(competencia_ano" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0] and "EqualTo(mes_ano_comissao,Abril/2026)" in plan
        assert frame.count() == 1


def test_latest_edit_of_an_id_counts(spark):
    current = spark.createDataFrame([("a", True, False)], "row_id string, pagar boolean, excluir boolean")
    edits = spark.createDataFrame([("a", False, True, 1), ("a", True, True, 2), ("b", True, False, 5), ("b", False, False, 6)], "row_id string, pagar boolean, excluir boolean, n int")
    assert [tuple(r) for r in L.merge_selection(current, edits, "n").collect()] == [("a", True, True)]


def _paid_rows(spark, n, offset=0):
    return spark.createDataFrame([(f"CH{i + offset}", float(i)) for i in range(n)], "nro_chassi string, valor_comissao_total double").repartition(3)


def test_a_posting_lands_once_and_whole(spark, tmp_path):
    """Broken off before its manifest entry: nothing; after it: everything; run again: nothing more."""
    path, period = str(tmp_path / "paid"), G.period_columns(**PERIOD)
    prepared = G.prepare_ledger_rows(_paid_rows(spark, 7), period)
    staged = G.stage_posting(prepared, path, "p1")  # the job stops here
    assert staged["rows"] == 7 and G.read_ledger(spark, path).count() == 0
    assert G.commit_posting(spark, path, staged) is True  # ... and is stopped right after landing
    assert G.read_ledger(spark, path).count() == 7
    assert G.append_paid_ledger(_paid_rows(spark, 7), path, period, posting_id="p1") == 0  # run again
    assert G.commit_posting(spark, path, G.stage_posting(prepared, path, "p1")) is False  # a late twin
    assert G.read_ledger(spark, path).count() == 7
    # without an explicit id the rows name the posting: the same rows land once
    assert G.append_paid_ledger(_paid_rows(spark, 5, 100), path, period) == 5
    assert G.append_paid_ledger(_paid_rows(spark, 5, 100), path, period) == 0
    assert G.append_paid_ledger(_paid_rows(spark, 0), path, period) == 0
    assert [e["posting"] for e in G.manifest(spark, path)][0] == "p1" and len(G.manifest(spark, path)) == 2


def test_row_ids_are_dense_in_landing_order(spark, tmp_path):
    path, period = str(tmp_path / "paid"), G.period_columns(**PERIOD)
    later = G.period_columns(**{**PERIOD, "month": 4, "label": "Maio/2026"})
    assert G.append_paid_ledger(_paid_rows(spark, 40), path, period, posting_id="a") == 40
    assert G.append_paid_ledger(_paid_rows(spark, 25, 500), path, later, posting_id="b") == 25
    ledger = G.read_ledger(spark, path)
    ids = sorted(r.id for r in ledger.select("id").collect())
    assert ids == list(range(65))
    first = {r.nro_chassi: r.id for r in ledger.where("competencia_mes = 3").collect()}
    assert set(first.values()) == set(range(40))  # the first posting holds the first ids
    newest = G.ledger_by_competence(ledger, 2026, 4).first()
    assert newest.id == max(r.id for r in ledger.where("competencia_mes = 4").collect())


def test_a_label_reads_rows_of_any_competence(spark, tmp_path):
    path = str(tmp_path / "paid")
    rows = spark.createDataFrame([("CH1", 10.0)], "nro_chassi string, valor_comissao_total double")
    G.append_paid_ledger(rows, path, G.period_columns(**PERIOD))
    G.append_paid_ledger(rows, path, G.period_columns(**{**PERIOD, "month": 5}))  # filed under another competence
    G.append_paid_ledger(rows, path, G.period_columns(**{**PERIOD, "month": 6, "label": "Junho/2026"}))
    ledger = G.read_ledger(spark, path)
    assert sorted(r.competencia_mes for r in G.ledger_by_label(ledger, "Abril/2026").collect()) == [3, 5]
    assert G.ledger_by_label(ledger, "Julho/2026").count() == 0


def _fat(spark, rates):
    upload = spark.createDataFrame([(f"M{i}", f"{r},0%") for i, r in enumerate(rates)], "Modelo string, `% Comissão Fat.` string")
    return P.prepare_fat_rates(upload)


def test_a_rule_batch_number_lands_once(spark, tmp_path):
    path = str(tmp_path / "rates")
    assert G.append_rules(_fat(spark, [1, 2]), path, "fat", "append", 1) == 2
    with pytest.raises(G.BatchTaken):
        G.append_rules(_fat(spark, [9]), path, "fat", "append", 1)  # a second writer of batch 1
    with pytest.raises(G.BatchTaken):
        G.append_rules(_fat(spark, [9]), path, "fat", "append", 0)
    staged = str(tmp_path / "rates")
    assert G._claim(spark, f"{staged}/{G.RULE_MARKS}", 1, {"batch_id": 1}) is False  # two writers at once: one entry
    assert sorted(float(r.percentual) for r in G.rules_in_force(spark, path, "fat").collect()) == [1, 2]


def test_a_snapshot_and_later_batches_give_the_whole_state(spark, tmp_path):
    path = str(tmp_path / "rates")
    G.append_rules(_fat(spark, [1, 2]), path, "fat", "append", 1)
    G.append_rules(_fat(spark, [3]), path, "fat", "replace", 2)
    whole = sorted(tuple(r) for r in G.rules_with_state(spark, path, "fat").drop("updated_at").collect())
    assert G.snapshot_rules(spark, path, "fat") == 2
    assert sorted(tuple(r) for r in G.rules_with_state(spark, path, "fat").drop("updated_at").collect()) == whole
    G.append_rules(_fat(spark, [4]), path, "fat", "append", 3)
    G.append_rules(_fat(spark, [5, 6]), path, "fat", "replace", 4)
    state = G.rules_with_state(spark, path, "fat")
    assert sorted(float(r.percentual) for r in state.where("ativo").collect()) == [5, 6] and state.count() == 6
    plan = state._jdf.queryExecution().executedPlan().toString()
    filters = [seg.split("]")[0] for seg in plan.split("PartitionFilters: ")[1:]]
    assert any("batch_id" in f and "= 3)" in f and "= 4)" in f and "= 2)" not in f for f in filters)  # later batches only
    G.append_rules(_fat(spark, [7]), path, "fat", "reset", 5)
    assert [float(r.percentual) for r in G.rules_with_state(spark, path, "fat").collect()] == [7]
