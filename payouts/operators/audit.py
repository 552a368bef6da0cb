"""Audit of externally prepared commission sheets, many files in one frame.

A sheet row carries ``arquivo`` (file), ``linha`` (line shown to the user) and the audit
columns. ``colunas`` optionally holds the headers the file really had, so that each file
is judged by its own header row.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payouts import schemas as S
from payouts.functions import (
    matches_rule,
    money_sum,
    norm_key,
    pad_document,
    parse_br_number,
    parse_commission_points,
    parse_margin_points,
    strip,
)
from payouts.operators.joins import attach_row, lookup_join, merge_by_key
from payouts.operators.shape import is_text, normalize_report_rows, quoted, resolve_column

__all__ = [
    "allowed_fat_rates", "allowed_margin_rules", "audit_file_summary", "audit_rule_join",
    "audit_rows", "concat_issues", "duplicate_keys", "extraction_key_check", "extraction_keys",
    "paid_sheet_audit", "read_error_issues", "sum_numeric_column",
]

# What sheets are made of and checked against.
EXTRACTION_COLUMNS = ("row_id", "filial", "modelo", "classificacao_venda", "nro_chassi", "nro_documento", "receita_bruta", "perc_margem_bruta")
_ISSUE = "arquivo string, linha bigint, severidade string, regra string, detalhe string"
_ERROR, _WARNING = "Erro", "Aviso"
_AMOUNTS = ("receita_bruta", "valor_comissao_fat", "valor_comissao_margem", "valor_comissao_total")
_POINTS = {
    "perc_comissao_fat": parse_commission_points,
    "perc_comissao_margem": parse_commission_points,
    "meta_margem": parse_margin_points,
    "perc_margem_bruta": parse_margin_points,
}


def allowed_fat_rates(rules: DataFrame) -> DataFrame:
    """Set of allowed billing percents per model."""
    model = resolve_column(rules, S.MODEL_ALIASES)
    percent = resolve_column(rules, S.AUDIT_FAT_PERCENT_ALIASES)
    value = parse_commission_points(quoted(percent), is_text(rules, percent))
    return (
        rules.select(norm_key(quoted(model)).alias("modelo"), value.alias("v"))
        .where("modelo <> ''")
        .groupBy("modelo")
        .agg(F.sort_array(F.collect_set("v")).alias("percentuais_fat"))
    )


def allowed_margin_rules(rules: DataFrame) -> DataFrame:
    """Sets of allowed margin percents and targets per model."""
    model = resolve_column(rules, S.MODEL_ALIASES)
    percent = resolve_column(rules, S.AUDIT_MARGIN_PERCENT_ALIASES)
    target = resolve_column(rules, S.TARGET_ALIASES, required=False)
    value = parse_commission_points(quoted(percent), is_text(rules, percent))
    goal = parse_margin_points(quoted(target), is_text(rules, target)) if target else F.lit(0.0)
    return (
        rules.select(norm_key(quoted(model)).alias("modelo"), value.alias("v"), goal.alias("m"))
        .where("modelo <> ''")
        .groupBy("modelo")
        .agg(
            F.sort_array(F.collect_set("v")).alias("percentuais_margem"),
            F.sort_array(F.collect_set("m")).alias("metas"),
        )
    )


def sum_numeric_column(rows: DataFrame, name: str) -> Column:
    """Aggregate: total of a column of Brazilian numbers, zero when the frame lacks it."""
    if name not in rows.columns:
        return F.lit(0.0)
    return F.coalesce(money_sum(parse_br_number(F.col(name), is_text(rows, name))), F.lit(0.0))


def _named_keys(base: DataFrame) -> DataFrame:
    # A padded document is blank exactly where the stripped text is: the filter works no document out a second time.
    chassis, document = F.col("nro_chassi"), F.col("nro_documento")
    named = base.where((strip(chassis) != "") & (strip(document) != ""))
    return named.select(norm_key(chassis).alias("nro_chassi"), pad_document(document).alias("nro_documento"))


def extraction_keys(base: DataFrame) -> DataFrame:
    """Distinct (chassis, padded document) of an extraction, both non-blank."""
    return _named_keys(base).distinct()


def extraction_key_check(sheet: DataFrame, keys: DataFrame) -> DataFrame:
    """Sheet rows whose chassis and document are not in the extraction."""
    checked = lookup_join(sheet, keys, ["nro_chassi", "nro_documento"], flag="_known")
    return checked.where(~F.col("_known")).drop("_known")


def _key_counts(sheet: DataFrame) -> DataFrame:
    """Keys that occur more than once in a file; the counts combine map-side."""
    keys = ["arquivo", "nro_chassi", "nro_documento"]
    counted = sheet.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"))
    return counted.where("_copies > 1").drop("_copies")


def duplicate_keys(sheet: DataFrame) -> DataFrame:
    """Every member of a (chassis, document) pair that repeats within its file."""
    keys = ["arquivo", "nro_chassi", "nro_documento"]
    return lookup_join(sheet, _key_counts(sheet), keys, flag="_repeated").where("_repeated").drop("_repeated")


def audit_rows(sheets: DataFrame) -> DataFrame:
    """Sheet rows in audit form: keys normalised, amounts and percents parsed."""
    rows = normalize_report_rows(sheets)
    parsed = {c: parse_br_number(F.col(c), is_text(rows, c)) for c in _AMOUNTS if c in rows.columns}
    parsed |= {c: parse(F.col(c), is_text(rows, c)) for c, parse in _POINTS.items() if c in rows.columns}
    return rows.withColumns(parsed).drop(*[f"{c}_numerico" for c in parsed])


def audit_rule_join(rows: DataFrame, fat: DataFrame, margin: DataFrame) -> DataFrame:
    """Rows with the allowed percents and targets of their model, empty when it has no rule."""
    rules = merge_by_key(fat, margin, "modelo").withColumnRenamed("modelo", "_model")
    model = F.nullif(norm_key(F.col("modelo")), F.lit(""))
    joined = lookup_join(rows.withColumn("_model", model), rules, ["_model"])
    empty = F.array().cast("array<double>")
    sets = ("percentuais_fat", "percentuais_margem", "metas")
    return joined.withColumns({c: F.coalesce(F.col(c), empty) for c in sets}).drop("_model")


def _list_text(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda v: v.cast("string")), ", "), F.lit("]"))


def _six(c: Column) -> Column:
    return F.format_string("%.6f", c)


def _two(c: Column) -> Column:
    return F.format_string("%.2f", c)


def _absent_labels(header: Column) -> Column:
    """Required labels that a header lacks, former labels counting as today's."""
    required = F.array(*[F.lit(S.LABELS[c]) for c in S.AUDIT_REQUIRED])
    aliases = F.create_map(*[F.lit(x) for pair in S.REPORT_HEADER_ALIASES.items() for x in pair])
    return F.array_except(required, F.transform(header, lambda h: F.coalesce(F.try_element_at(aliases, h), h)))


def _is_complete(header: Column) -> Column:
    """Whether _absent_labels is empty, by plain look-ups, as every row asks it."""
    found = header.isNotNull()
    for name in S.AUDIT_REQUIRED:
        label = S.LABELS[name]
        known = [old for old, new in S.REPORT_HEADER_ALIASES.items() if new == label]
        known = known if label in S.REPORT_HEADER_ALIASES else [label, *known]
        found &= reduce(lambda a, b: a | b, [F.coalesce(F.array_contains(header, k), F.lit(False)) for k in known])
    return found


def _missing_columns(sheets: DataFrame) -> Column:
    """Labels of required columns a file lacks."""
    if "colunas" in sheets.columns:
        return _absent_labels(F.col("colunas"))
    absent = [S.LABELS[c] for c in S.AUDIT_REQUIRED if c not in normalize_report_rows(sheets).columns]
    return F.array(*[F.lit(c) for c in absent]).cast("array<string>")


def _key_text() -> Column:
    return F.concat(F.col("nro_chassi"), F.lit(" / "), F.col("nro_documento"))


def _rule_issues(rows: DataFrame) -> DataFrame:
    """The issues of rows against the rules of their model, one row each: arquivo, linha, regra, detalhe.

    The rules that a row breaks are listed first, and the detail of each is worked out after, so that none is made
    where details are not read.
    """
    model = norm_key(F.col("modelo"))
    gross, fat, margin = F.col("receita_bruta"), F.col("perc_comissao_fat"), F.col("perc_comissao_margem")
    fat_value, margin_value, total = (
        F.col("valor_comissao_fat"), F.col("valor_comissao_margem"), F.col("valor_comissao_total")
    )
    target, reached = F.col("meta_margem"), F.col("perc_margem_bruta")
    fat_set, margin_set, targets = F.col("percentuais_fat"), F.col("percentuais_margem"), F.col("metas")
    hit = reached >= target
    has_gross = F.coalesce(gross != 0, F.lit(False))
    fat_ratio = fat_value / F.nullif(gross, F.lit(0.0)) * 100
    margin_ratio = margin_value / F.nullif(gross, F.lit(0.0)) * 100
    checks_ratio = has_gross & margin_value.isNotNull() & hit
    expected_fat = F.coalesce(gross, F.lit(0.0)) * fat / 100
    expected_margin = F.when(hit, F.coalesce(gross, F.lit(0.0)) * margin / 100).otherwise(0.0)
    expected = expected_fat + expected_margin

    def against(value: Column, allowed: Column, word: str) -> Column:
        return F.concat(F.lit("Modelo "), model, F.lit(f": {word}="), _six(value), F.lit(", regra(s)="), _list_text(allowed))

    rules = [
        ("% Comissão Fat.", ~matches_rule(fat, fat_set), against(fat, fat_set, "arquivo")),
        ("Valor Comissão Fat. / Receita Bruta",
         has_gross & fat_value.isNotNull() & ~matches_rule(fat_ratio, fat_set), against(fat_ratio, fat_set, "calculado")),
        ("% Comissão Margem", ~matches_rule(margin, margin_set), against(margin, margin_set, "arquivo")),
        ("Meta de Margem", ~matches_rule(target, targets), against(target, targets, "arquivo")),
        ("Valor Comissão Margem / Receita Bruta",
         checks_ratio & ~matches_rule(margin_ratio, margin_set), against(margin_ratio, margin_set, "calculado")),
        ("Gatilho Comissão Margem",
         ~checks_ratio & F.coalesce(F.abs(margin_value) > S.MONEY_TOLERANCE, F.lit(False)),
         F.concat(F.lit("% Margem Bruta="), _six(reached), F.lit(" abaixo da meta="), _six(target),
                  F.lit(", mas Valor Comissão Margem="), _two(margin_value))),
        ("Valor Comissão Total",
         total.isNull() | (F.abs(total - expected) > S.MONEY_TOLERANCE),
         F.concat(F.lit("arquivo="), F.coalesce(total.cast("string"), F.lit("None")), F.lit(", recalculado="),
                  _two(expected), F.lit(" (fat="), _two(expected_fat), F.lit(", margem="), _two(expected_margin),
                  F.lit(")"))),
    ]
    broken = F.array_compact(F.array(*[F.when(condition, F.lit(rule)) for rule, condition, _ in rules]))
    found = rows.withColumn("regra", F.explode(broken))
    text = reduce(lambda out, r: out.when(F.col("regra") == r[0], r[2]), rules[1:], F.when(F.col("regra") == rules[0][0], rules[0][2]))
    return found.select("arquivo", "linha", "regra", text.alias("detalhe"))


def _key_issues(rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key repeats in their file, rows whose key the extraction lacks), moved by their keys alone."""
    named = rows.select("arquivo", "linha", "nro_chassi", "nro_documento")

    def issue(found: DataFrame, rule: str, text: str) -> DataFrame:
        return found.select("arquivo", "linha", F.lit(rule).alias("regra"), F.concat(F.lit(text), _key_text()).alias("detalhe"))

    return (issue(duplicate_keys(named), "Chave única", "Chassi/documento duplicado: "),
            issue(extraction_key_check(named, keys), "Chave na extração", "Chassi/documento não encontrado na extração atual: "))


def _sentinel_issue(used: Column, allowed: Column, sentinel: str) -> Column:
    """File-level check of the sentinel model: wrong percent, or the model is absent."""
    wrong = F.exists(used, lambda v: ~matches_rule(v, allowed))
    text = F.concat(F.lit("percentual usado="), _list_text(used), F.lit(", regra faturamento="), _list_text(allowed))
    return F.when(F.size(used) == 0, F.struct(
        F.lit(_WARNING).alias("severidade"), F.lit(f"Modelo {sentinel}").alias("regra"),
        F.lit(f"Modelo {sentinel} não encontrado no arquivo.").alias("detalhe"),
    )).when(wrong, F.struct(
        F.lit(_ERROR).alias("severidade"), F.lit(f"Modelo {sentinel}").alias("regra"), text.alias("detalhe"),
    ))


def _file_frame(sheets: DataFrame, fat: DataFrame, sentinel: str, files: DataFrame | None = None) -> DataFrame:
    """One row per file: sizes, totals, missing columns, sentinel percents used and allowed.

    ``files`` is the reader's list (arquivo, colunas, erro); its files without rows count
    as well, one that could not be read as one without columns.
    """
    # Headers are judged once per file, not once per row. Without its count Spark would drop the inner grouping, as a
    # largest value does not need it.
    headed = ["arquivo", "colunas"] if "colunas" in sheets.columns else ["arquivo"]
    width = F.size("colunas") if "colunas" in sheets.columns else F.lit(
        len([c for c in sheets.columns if c not in ("arquivo", "linha")]))
    read = sheets.groupBy(*headed).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 0").select(
        "arquivo", "_rows", width.cast("bigint").alias("_width"), _missing_columns(sheets).alias("_missing")
    ).groupBy("arquivo").agg(
        F.sum("_rows").alias("linhas_lidas"), F.max("_width").alias("colunas_lidas"), F.max("_missing").alias("_missing"))
    if files is not None:
        header = F.coalesce("colunas", F.array().cast("array<string>"))
        read = read.unionByName(files.join(read.select("arquivo"), "arquivo", "left_anti").select(
            "arquivo", F.lit(0).cast("bigint").alias("linhas_lidas"), F.size(header).cast("bigint").alias("colunas_lidas"),
            _absent_labels(header).alias("_missing")))
    rows = audit_rows(sheets)
    sentinel_row = norm_key(F.col("modelo")) == sentinel if "modelo" in rows.columns else F.lit(False)
    percent = F.col("perc_comissao_fat") if "perc_comissao_fat" in rows.columns else F.lit(None).cast("double")
    checked = rows.groupBy("arquivo").agg(
        F.count(F.lit(1)).alias("linhas_validadas"),
        sum_numeric_column(rows, "receita_bruta").alias("receita_bruta_lida"),
        sum_numeric_column(rows, "valor_comissao_total").alias("comissao_total_lida"),
        F.sort_array(F.collect_set(F.when(sentinel_row, percent))).alias("_used"),
    )
    empty = F.array().cast("array<double>")
    expected = fat.where(F.col("modelo") == sentinel).agg(F.max("percentuais_fat").alias("_allowed"))
    return attach_row(read.join(checked, "arquivo", "left"), expected).withColumns(
        {
            "linhas_validadas": F.coalesce("linhas_validadas", F.lit(0)),
            "receita_bruta_lida": F.coalesce("receita_bruta_lida", F.lit(0.0)),
            "comissao_total_lida": F.coalesce("comissao_total_lida", F.lit(0.0)),
            "_used": F.coalesce("_used", empty),
            "_allowed": F.coalesce("_allowed", empty),
        }
    )


def paid_sheet_audit(
    sheets: DataFrame,
    fat_rules: DataFrame,
    margin_rules: DataFrame,
    extraction: DataFrame,
    sentinel: str = S.SENTINEL_MODEL,
    file_list: DataFrame | None = None,
) -> DataFrame:
    """All issues of all files: arquivo, linha (NULL for the file itself), severidade, regra, detalhe.

    A file that lacks required columns gets one issue per column and no further check.
    ``file_list`` is the reader's list (arquivo, colunas, erro): with it, files without rows
    and files that could not be read have their issues too.
    """
    fat, margin = allowed_fat_rates(fat_rules), allowed_margin_rules(margin_rules)
    files = _file_frame(sheets, fat, sentinel, file_list)
    no_line = F.lit(None).cast("bigint")
    missing = files.select("arquivo", F.explode("_missing").alias("_column")).select(
        "arquivo", no_line.alias("linha"), F.lit(_ERROR).alias("severidade"),
        F.lit("Coluna obrigatória").alias("regra"),
        F.concat(F.lit("Coluna ausente: "), F.col("_column")).alias("detalhe"),
    )
    if file_list is not None:
        missing = missing.unionByName(read_error_issues(file_list.where("erro is not null")))
    if all(c in normalize_report_rows(sheets).columns for c in S.AUDIT_REQUIRED):
        complete = sheets.where(_is_complete(F.col("colunas"))) if "colunas" in sheets.columns else sheets
    else:
        return missing
    rows = audit_rows(complete)
    keys = extraction_keys(extraction)
    unloaded_flag = _named_keys(extraction).limit(1).agg((F.count(F.lit(1)) == 0).alias("_none"))
    repeated, unknown = _key_issues(rows, keys)
    # An empty extraction is one issue of the file, not one of every row.
    unknown = attach_row(unknown, unloaded_flag).where("not _none").drop("_none")
    per_row = _rule_issues(audit_rule_join(rows, fat, margin)).unionByName(repeated).unionByName(unknown).select(
        "arquivo", F.col("linha").cast("bigint").alias("linha"), F.lit(_ERROR).alias("severidade"), "regra", "detalhe"
    )
    whole = files.where(F.size("_missing") == 0)
    sentinel_issues = whole.select("arquivo", _sentinel_issue(F.col("_used"), F.col("_allowed"), sentinel).alias("i")).where(
        "i is not null"
    ).select("arquivo", no_line.alias("linha"), "i.severidade", "i.regra", "i.detalhe")
    unloaded = attach_row(whole, unloaded_flag).where("_none").select(
        "arquivo", no_line.alias("linha"), F.lit(_ERROR).alias("severidade"), F.lit("Extração atual").alias("regra"),
        F.lit("Nenhuma extração atual carregada para validar Chassi + Nro Documento.").alias("detalhe"),
    )
    return missing.unionByName(per_row).unionByName(unloaded).unionByName(sentinel_issues)


def read_error_issues(failures: DataFrame) -> DataFrame:
    """Issues of files that could not be read (arquivo, erro)."""
    return failures.select(
        "arquivo", F.lit(None).cast("bigint").alias("linha"), F.lit(_ERROR).alias("severidade"),
        F.lit("Leitura do arquivo").alias("regra"), F.col("erro").alias("detalhe"),
    )


def concat_issues(*issues: DataFrame) -> DataFrame:
    """Issue frames of several audits as one list."""
    first, *rest = issues
    for other in rest:
        first = first.unionByName(other)
    return first


def audit_file_summary(
    sheets: DataFrame, issues: DataFrame, fat_rules: DataFrame, sentinel: str = S.SENTINEL_MODEL,
    file_list: DataFrame | None = None,
) -> DataFrame:
    """One row per file: what was read, errors, warnings and the verdict."""
    counts = issues.groupBy("arquivo").agg(
        F.count_if(F.col("severidade") == _ERROR).alias("erros"),
        F.count_if(F.col("severidade") == _WARNING).alias("avisos"),
    )
    files = _file_frame(sheets, allowed_fat_rates(fat_rules), sentinel, file_list).join(counts, "arquivo", "left")
    errors = F.coalesce("erros", F.lit(0))

    def percents(values: str) -> Column:
        return F.array_join(F.transform(values, lambda v: F.concat(_two(v), F.lit("%"))), ", ")

    return files.select(
        "arquivo",
        F.when(errors == 0, "Aprovado").otherwise("Reprovado").alias("status"),
        "linhas_lidas",
        "colunas_lidas",
        "linhas_validadas",
        "receita_bruta_lida",
        errors.alias("erros"),
        F.coalesce("avisos", F.lit(0)).alias("avisos"),
        "comissao_total_lida",
        percents("_used").alias("sentinela_usado"),
        percents("_allowed").alias("sentinela_regra"),
    )
