"""Steps whose time, memory or bytes must not outgrow their input."""

import zipfile
from datetime import date

from pyspark.sql import functions as F

from payouts.operators import audit as A
from payouts.operators import extract as X
from payouts.sources import sheets as H
from payouts.sources.star import Star
from payouts.sources.workbooks import write_workbooks
from tests.test_audit import COLUMNS, NUMBER, extraction, rules


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sheet(spark, rows):
    frame = spark.createDataFrame(rows, COLUMNS.format("double"))
    labels = [A.S.LABELS[c] for c in A.S.AUDIT_REQUIRED]
    return frame.withColumn("colunas", F.array(*[F.lit(c) for c in labels]))


def test_sheet_rows_go_to_the_key_checks_by_their_keys_alone(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(A.extraction_key_check(sheet(spark, [NUMBER]), extraction(spark)))
        issues = A.paid_sheet_audit(sheet(spark, [NUMBER]), *rules(spark), extraction(spark))
        joins = [s for s in plan(issues).splitlines() if "SortMergeJoin" in s and "nro_chassi" in s]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "nro_chassi" in text and len(joins) == 2
    assert "valor_comissao_margem" not in "".join(A._key_issues(A.audit_rows(sheet(spark, [NUMBER])), extraction(spark))[0].columns)


def test_headers_are_judged_per_file(spark):
    frame = A._file_frame(sheet(spark, [NUMBER]), A.allowed_fat_rates(rules(spark)[0]), "X").select("arquivo", "_missing")
    assert [s for s in plan(frame).splitlines() if "HashAggregate(keys=[arquivo" in s and "count(1)" in s]


def test_complete_headers_are_those_without_absent_labels(spark):
    labels = [A.S.LABELS[c] for c in A.S.AUDIT_REQUIRED]
    old = {new: o for o, new in A.S.REPORT_HEADER_ALIASES.items()}
    headers = [labels, [*labels, "x", None], [old.get(h, h) for h in labels], labels[1:], [], None, [None], [*labels[:-1], labels[-1].lower()]]
    frame = spark.createDataFrame([(h,) for h in headers], "h array<string>")
    got = frame.select((F.size(A._absent_labels(F.col("h"))) == 0).alias("old"), A._is_complete(F.col("h")).alias("new")).collect()
    assert [bool(r["old"]) for r in got] == [bool(r["new"]) for r in got] == [True, True, True, False, False, False, False, False]


def test_blank_keys_are_not_in_the_extraction(spark):
    rows = [(" ch1 ", " 7.0 "), ("", "1"), ("CH2", " \t"), (None, "1"), ("CH3", None), ("CH4", "+"), ("CH5", "x")]
    base = spark.createDataFrame(rows, "nro_chassi string, nro_documento string")
    assert sorted(tuple(r) for r in A.extraction_keys(base).collect()) == [("CH1", "000000007"), ("CH4", "+00000000"), ("CH5", "00000000x")]


def test_chassis_are_hashed_before_the_largest_spelling_is_taken(spark):
    rows = spark.createDataFrame(
        [(date(2020, 1, 1), "P", c) for c in ("ch1", "CH1", " ch1 ", "ch2", " ", None)], "data_emissao date, produto_codigo string, chassi string")
    found = X.distinct_source_chassis(rows, rows, date(2019, 1, 1), date(2021, 1, 1))
    assert sorted(r["chassi"] for r in found.collect()) == ["ch1", "ch2"]
    text = plan(found)
    assert [s for s in text.splitlines() if "HashAggregate" in s and "count(1)" in s]


def test_a_fault_copies_rows_in_one_pass(spark):
    rows = spark.createDataFrame(
        [(f"{o}-1-1", "B", "m", "c", "d", *([1.0] * 8), False) for o in (103, 104)],
        "row_id string, filial string, modelo string, nro_chassi string, nro_documento string, receita_bruta double, perc_comissao_fat double, "
        "valor_comissao_fat double, meta_margem double, perc_margem_bruta double, perc_comissao_margem double, valor_comissao_margem double, "
        "valor_comissao_total double, gatilho_margem_atingido boolean")
    made = Star(spark, "").audit_sheets(rows)
    assert "Union" not in plan(made)
    assert sorted(r["linha"] for r in made.collect()) == [825, 833, 1_000_000_825]


def test_a_workbook_is_parsed_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "books")
    frame = spark.range(5000).select(F.lit("N").alias("Filial"), F.concat(F.lit("<&"), "id").alias("Chassi"), (F.col("id") / 2).alias("Valor"))
    write_workbooks(frame, path, "Filial", sheet="S")
    content = (tmp_path / "books" / "N.xlsx").read_bytes()
    opened = []
    parse = H._workbook_rows
    monkeypatch.setattr(H, "_workbook_rows", lambda *a: (opened.append(1), parse(*a))[1])
    batch = H.pa.RecordBatch.from_pydict({"path": [f"{path}/N.xlsx", f"{path}/bad.xlsx"], "content": [content, b"x"]})
    out = [r for b in H._reader(path, "S", 0, "Filial")(iter([batch])) for r in b.to_pylist()]
    assert len(opened) == 2 and len(out) == 5002
    assert sorted(r["celulas"][1]["valor"] for r in out if r["celulas"])[:2] == ["<&0", "<&1"]
    assert out[0]["colunas"] == ["Filial", "Chassi", "Valor"] and out[-1]["erro"]
    with zipfile.ZipFile(tmp_path / "books" / "N.xlsx") as book:
        assert book.read("xl/worksheets/sheet1.xml").count(b"<row ") == 5001
