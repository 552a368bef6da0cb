"""Payment eligibility: incentive received (V1) and customer paid (V2), set-based.

V1 is a function of the chassis and V2 of (document, date), so each check is worked out
once per distinct key and reaches the rows through one lookup.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from payouts import schemas as S
from payouts.functions import (
    blank_to_null,
    combine_status,
    format_us,
    is_blank_key,
    is_settled,
    money_sum,
    norm_document,
    parse_date_br,
    strip,
    zfill,
)
from payouts.operators.joins import lookup_join, lookup_joins
from payouts.operators.shape import is_text
from payouts.sources.stage import stage

__all__ = [
    "ROW_COLUMNS", "eligibility_totals", "incentive_lookup", "invoice_lookup", "key_match_check",
    "key_match_rates", "payment_eligibility", "receivable_by_type", "receivable_lookup",
    "receivable_summary", "top1_incentive_note", "validation_listing",
]

_FAR = "9999-12-31"

#: The columns of settlement rows that payment_eligibility and validation_listing read.
ROW_COLUMNS = ("filial", "cen", "nome_cliente", "classificacao_venda", "nro_documento", "nro_chassi", "data_emissao",
               "valor_comissao_total", "row_id")


def _key(c: Column) -> Column:
    return F.upper(strip(c))


def top1_incentive_note(incentives: DataFrame) -> DataFrame:
    """The incentive note of each chassis: the lowest one."""
    return (
        incentives.select(F.upper(blank_to_null(F.col("chassi"))).alias("chassi"),
                          blank_to_null(F.col("nota_fiscal_numero")).alias("nota"))
        .where("chassi is not null and nota is not null")
        .groupBy("chassi")
        .agg(F.min("nota").alias("nota"))
    )


def receivable_summary(receivables: DataFrame) -> DataFrame:
    """Balance and first issue date per title; a title whose balances are all NULL has none."""
    issued = parse_date_br(F.col("data_emissao"), is_text(receivables, "data_emissao"))
    return receivables.groupBy(F.upper(F.trim("titulo_numero")).alias("titulo")).agg(
        money_sum(F.col("valor_saldo")).alias("saldo_total"), F.min(issued).alias("data_emissao")
    )


def receivable_by_type(receivables: DataFrame) -> DataFrame:
    """Balance per customer, title and type; a missing type is blank."""
    kind = F.coalesce(F.trim("tipo_titulo"), F.lit(""))
    return receivables.groupBy(
        F.upper(F.trim("cliente_codigo")).alias("cliente"),
        F.upper(F.trim("titulo_numero")).alias("titulo"),
        F.upper(kind).alias("tipo"),
    ).agg(F.coalesce(money_sum(F.col("valor_saldo")), F.lit(0.0)).alias("saldo"))


def receivable_lookup(receivables: DataFrame) -> DataFrame:
    """Per customer and title: balance, its types, and what is still open.

    Types are few codes per title; values are summed per type before they are listed.
    """
    typed = F.col("tipo") != ""
    open_typed = typed & ~is_settled(F.col("saldo"))
    return (
        receivable_by_type(receivables)
        .groupBy("cliente", "titulo")
        .agg(
            money_sum(F.col("saldo")).alias("saldo"),
            F.array_join(F.sort_array(F.collect_list(F.when(typed, F.col("tipo")))), "/").alias("tipos"),
            F.array_join(F.sort_array(F.collect_list(F.when(open_typed, F.col("tipo")))), "/").alias("tipos_pendentes"),
            F.count_if(open_typed).alias("qtd_pendentes"),
            F.count_if(open_typed & (F.col("tipo") != "BL")).alias("qtd_pendentes_fora_bl"),
        )
    )


def incentive_lookup(incentives: DataFrame, receivables: DataFrame) -> DataFrame:
    """V1 of every chassis that has an incentive note."""
    notes = top1_incentive_note(incentives).withColumn("titulo", F.upper("nota"))
    found = lookup_join(notes, receivable_summary(receivables), ["titulo"])
    balance, note = F.col("saldo_total"), F.col("nota")
    known = balance.isNotNull()
    status = F.when(~known, "NÃO ENCONTRADO").when(is_settled(balance), "APTO").otherwise("NÃO APTO")
    detail = (
        F.when(~known, F.concat(F.lit("NF "), note, F.lit(" não localizada em bdnContasReceber")))
        .when(is_settled(balance), "Incentivo recebido integralmente")
        .otherwise(F.concat(F.lit("Saldo pendente: R$ "), format_us(balance)))
    )
    return found.select(
        "chassi",
        status.alias("v1_status"),
        balance.alias("v1_saldo"),
        F.when(known, F.col("data_emissao")).alias("v1_data_emissao"),
        note.alias("v1_nf_incentivo"),
        detail.alias("v1_detalhe"),
    )


def invoice_lookup(requests: DataFrame, invoices: DataFrame) -> DataFrame:
    """The invoice each (documento, data) request finds: plain number with the same date,
    plain number, then the zero-filled number likewise. Ties go to the earliest date, then
    the lowest customer. Requests must be distinct; those that find nothing are absent.
    """
    issued = parse_date_br(F.col("data_emissao"), is_text(invoices, "data_emissao"))
    order = F.coalesce(issued, F.lit(_FAR).cast("date"))
    best = F.struct(order.alias("ordem"), F.trim("cliente_codigo").alias("cliente"),
                    F.trim("nota_fiscal_numero").alias("nota"), issued.alias("data_fat"))
    by_day = (
        invoices.select(_key(F.col("nota_fiscal_numero")).alias("_note"), issued.alias("data"), best.alias("_best"))
        .where("_note is not null")
        .groupBy("_note", "data")
        .agg(F.min("_best").alias("_best"))
    )
    by_note = by_day.groupBy("_note").agg(F.min("_best").alias("_first"))

    # Any invoice under the plain number beats all under the padded one, so the number is
    # settled per document; keys are distinct on both sides and need no care for hot ones.
    plain, padded = F.upper("documento"), F.upper(zfill(F.col("documento")))
    tries = F.array(
        F.struct(F.lit(1).alias("_try"), plain.alias("_note")),
        F.struct(F.lit(2).alias("_try"), F.when(padded != plain, padded).alias("_note")),
    )
    asked = requests.select("documento").distinct().select("documento", F.inline(tries))
    numbered = asked.join(by_note, "_note").groupBy("documento").agg(
        F.min(F.struct("_try", "_note", "_first")).alias("_n")
    )
    settled = requests.join(numbered, "documento").select(
        "documento", "data", F.col("_n._note").alias("_note"), F.col("_n._first").alias("_first")
    )
    found = settled.join(by_day, ["_note", "data"], "left").withColumn("_hit", F.coalesce("_best", "_first"))
    return found.select("documento", "data", "_hit.cliente", "_hit.nota", "_hit.data_fat")


def _payment_results(requests: DataFrame, invoices: DataFrame, receivables: DataFrame) -> DataFrame:
    """V2 of every distinct (documento, data) request."""
    found = (
        invoice_lookup(requests, invoices)
        .withColumns({"_cliente": F.upper("cliente"), "_titulo": F.upper("nota")})
    )
    balances = receivable_lookup(receivables).withColumnsRenamed({"cliente": "_cliente", "titulo": "_titulo"})
    joined = found.join(balances.withColumn("_known", F.lit(True)), ["_cliente", "_titulo"], "left")
    joined = joined.withColumn("_has_title", F.coalesce("_known", F.lit(False)))
    balance, note, customer = F.col("saldo"), F.col("nota"), F.col("cliente")
    settled = is_settled(balance)
    only_bl = (F.col("qtd_pendentes") > 0) & (F.col("qtd_pendentes_fora_bl") == 0)
    money = format_us(balance)
    pending = F.when(F.col("qtd_pendentes") > 0, F.col("tipos_pendentes")).otherwise("N/A")
    warning = F.when(
        F.col("data").isNotNull() & F.col("data_fat").isNotNull() & (F.col("data") != F.col("data_fat")),
        F.concat(F.lit("Data divergente: planilha="), F.col("data").cast("string"),
                 F.lit(" | faturamento="), F.col("data_fat").cast("string")),
    )
    payable = settled | only_bl
    status = (
        F.when(~F.col("_has_title"), "NÃO ENCONTRADO")
        .when(payable & warning.isNotNull(), "ATENÇÃO")
        .when(payable, "APTO")
        .otherwise("NÃO APTO")
    )
    outcome = (
        F.when(settled, F.lit("Cliente quitou integralmente"))
        .when(only_bl, F.concat(F.lit("Saldo R$ "), money, F.lit(" - pendente apenas em BL (apto conforme regra)")))
        .otherwise(F.concat(F.lit("Saldo pendente R$ "), money, F.lit(" - tipo(s) com saldo: "), pending))
    )
    missing = F.concat(
        F.lit("Título "), note, F.lit(" do cliente "), customer, F.lit(" não localizado em bdnContasReceber")
    )
    detail = F.when(F.col("_has_title"), F.concat_ws(" | ", outcome, warning)).otherwise(missing)
    return joined.select(
        "documento",
        F.coalesce(F.col("data").cast("string"), F.lit("")).alias("dia"),
        status.alias("v2_status"),
        customer.alias("v2_cliente_cod"),
        balance.alias("v2_saldo"),
        F.when(F.col("_has_title"), F.col("tipos")).alias("v2_tipos_titulo"),
        detail.alias("v2_detalhe"),
    )


def payment_eligibility(
    rows: DataFrame,
    incentives: DataFrame,
    receivables: DataFrame,
    invoices: DataFrame,
) -> DataFrame:
    """Every row with its V1 and V2 result and the combined status."""
    text_date = isinstance(rows.schema["data_emissao"].dataType, T.StringType)
    day = parse_date_br(F.col("data_emissao"), text_date)
    given_date = strip(F.coalesce(F.col("data_emissao"), F.lit("")))
    bad_date = day.isNull() & (given_date != "") if text_date else F.lit(False)
    sale_class = strip(F.coalesce(F.col("classificacao_venda"), F.lit("")))
    document = F.when(~is_blank_key(F.col("nro_documento")), norm_document(F.col("nro_documento")))
    applies = sale_class.isin(*S.CLASSES_WITH_CHASSIS_CHECK)
    chassis = F.when(applies & ~is_blank_key(F.col("nro_chassi")), _key(F.col("nro_chassi")))
    requests = rows.select(document.alias("documento"), day.alias("data")).where("documento is not null").distinct()
    v1 = incentive_lookup(incentives, receivables).withColumnsRenamed({"chassi": "_chassis"})
    v2 = _payment_results(requests, invoices, receivables).withColumnsRenamed({"documento": "_document", "dia": "_dia"})
    # V2 has a row for nearly every row; as a table, the files of the joins that made it go before the rows are moved.
    v1, v2 = v1.withColumn("_v1_found", F.lit(True)), stage(v2, "payment_results").withColumn("_v2_found", F.lit(True))

    # The keys are expressions of the joins, and what derives from a row's own columns is made after them, so rows are
    # moved as narrow as they came; V1 moves only the rows that have a chassis to check.
    def paid(some: DataFrame) -> DataFrame:
        day_key = F.coalesce(day.cast("string"), F.lit(""))
        return some.join(v2, (document == v2["_document"]) & (day_key == v2["_dia"]), "left").drop("_document", "_dia")

    checked = paid(rows.where(chassis.isNotNull()))
    checked = checked.join(v1, chassis == v1["_chassis"], "left").drop("_chassis")
    unchecked = paid(rows.where(chassis.isNull()))
    joined = checked.unionByName(unchecked, allowMissingColumns=True).withColumns(
        {
            "_v1_applies": applies,
            "_class": sale_class,
            "documento": document,
            "chassi": chassis,
            "_bad_date": bad_date,
            "_v1_found": F.coalesce("_v1_found", F.lit(False)),
            "_v2_found": F.coalesce("_v2_found", F.lit(False)),
        }
    )

    applies, has_chassis = F.col("_v1_applies"), F.col("chassi").isNotNull()
    v1_status = (
        F.when(~applies | ~has_chassis, "N/A").when(F.col("_v1_found"), F.col("v1_status")).otherwise("NÃO ENCONTRADO")
    )
    v1_detail = (
        F.when(
            ~applies,
            F.concat(F.lit("Classificação '"), F.col("_class"), F.lit("' não requer validação de chassi")),
        )
        .when(~has_chassis, "Chassi não informado")
        .when(F.col("_v1_found"), F.col("v1_detalhe"))
        .otherwise("Chassi não localizado em bdnIncentivos")
    )
    has_document = F.col("documento").isNotNull()
    v2_status = (
        F.when(~has_document, "N/A")
        .when(F.col("_bad_date"), "ERRO")
        .when(F.col("_v2_found"), F.col("v2_status"))
        .otherwise("NÃO ENCONTRADO")
    )
    v2_detail = (
        F.when(~has_document, "Nro Documento não informado")
        .when(F.col("_bad_date"), F.concat(F.lit("Data inválida: "), F.col("data_emissao").cast("string")))
        .when(F.col("_v2_found"), F.col("v2_detalhe"))
        .otherwise(F.concat(F.lit("Documento "), F.col("documento"), F.lit(" não localizado em bdnFaturamento")))
    )
    judged = joined.withColumns(
        {"v1_status": v1_status, "v1_detalhe": v1_detail, "v2_status": v2_status, "v2_detalhe": v2_detail}
    )

    def given(*names: str) -> Column:
        have = [n for n in names if n in rows.columns]
        return F.col(have[0]) if have else F.lit("")

    total = F.col("valor_comissao_total") if "valor_comissao_total" in rows.columns else F.lit(0.0)
    usable = ~F.col("_bad_date")
    return judged.select(
        given("filial").alias("filial"),
        given("cen").alias("cen"),
        given("nome_cliente", "cliente").alias("cliente"),
        "classificacao_venda",
        "nro_documento",
        given("nro_chassi").alias("nro_chassi"),
        "data_emissao",
        total.alias("valor_comissao"),
        "v1_status",
        "v1_nf_incentivo",
        "v1_saldo",
        "v1_data_emissao",
        "v1_detalhe",
        "v2_status",
        F.when(usable, F.col("v2_cliente_cod")).alias("v2_cliente_cod"),
        F.when(usable, F.col("v2_saldo")).alias("v2_saldo"),
        F.when(usable, F.col("v2_tipos_titulo")).alias("v2_tipos_titulo"),
        "v2_detalhe",
        combine_status(F.col("v1_status"), F.col("v2_status")).alias("status_geral"),
        *[F.col(c) for c in rows.columns if c == "row_id"],
    )


def eligibility_totals(results: DataFrame) -> DataFrame:
    """One row: rows by status, payable and blocked value, pending V1 and V2."""
    status = F.col("status_geral")
    pending = ("NÃO APTO", "NÃO ENCONTRADO", "ERRO")

    def value(wanted: str) -> Column:
        return F.coalesce(money_sum(F.when(status == wanted, F.col("valor_comissao"))), F.lit(0.0))

    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == S.STATUS_APTO).alias("aptos"),
        F.count_if(status == S.STATUS_NAO_APTO).alias("nao_aptos"),
        F.count_if(status == S.STATUS_VERIFICAR).alias("verificar"),
        value(S.STATUS_APTO).alias("valor_apto"),
        value(S.STATUS_NAO_APTO).alias("valor_nao_apto"),
        F.count_if(F.col("v1_status").isin(*pending)).alias("v1_pendentes"),
        F.count_if(F.col("v2_status").isin(*pending)).alias("v2_pendentes"),
    )


def validation_listing(results: DataFrame, rows: DataFrame) -> DataFrame:
    """Validation results by row id, with customer and class taken from the settlement rows
    and, where those are blank, from the validation itself; fixed columns first."""
    source = rows.select(
        "row_id",
        F.col("nome_cliente").alias("nome_cliente"),
        F.col("classificacao_venda").alias("_class"),
    )
    joined = lookup_join(results, source, ["row_id"])

    def first_filled(a: str, b: str) -> Column:
        text = F.coalesce(F.col(a), F.lit(""))
        return F.when(strip(text) == "", F.col(b)).otherwise(text)

    listed = joined.withColumns(
        {
            "nome_cliente": first_filled("nome_cliente", "cliente"),
            "classificacao_venda": first_filled("classificacao_venda", "_class"),
        }
    ).drop("_class", "row_id")
    rest = [c for c in listed.columns if c not in S.VALIDATION_COLUMNS]
    return listed.select(*S.VALIDATION_COLUMNS, *rest)


def key_match_check(
    rows: DataFrame, incentives: DataFrame, invoices: DataFrame, sample: int | None = None
) -> DataFrame:
    """Whether each row's chassis (new machines only) and document exist in the sources."""
    taken = rows.limit(sample) if sample else rows
    sale_class = strip(F.coalesce(F.col("classificacao_venda"), F.lit("")))
    chassis = strip(F.coalesce(F.col("nro_chassi"), F.lit("")))
    document = strip(F.coalesce(F.col("nro_documento").cast("string"), F.lit("")))
    needs = sale_class.isin(*S.CLASSES_WITH_CHASSIS_CHECK)
    keyed = taken.withColumns(
        {
            "_chassis": F.when(needs & ~is_blank_key(F.col("nro_chassi")), F.upper(chassis)),
            "_plain": F.when(~is_blank_key(F.col("nro_documento")), F.upper(document)),
        }
    ).withColumn("_padded", zfill(F.col("_plain")))
    known_chassis = incentives.select(F.upper(blank_to_null(F.col("chassi"))).alias("_chassis"))
    known_notes = invoices.select(F.upper(blank_to_null(F.col("nota_fiscal_numero"))).alias("_plain"))
    known_notes = known_notes.where("_plain is not null").distinct()
    out = lookup_joins(keyed, [
        (known_chassis.where("_chassis is not null").distinct(), ["_chassis"], "_c"),
        (known_notes, ["_plain"], "_d1"),
        (known_notes.withColumnRenamed("_plain", "_padded"), ["_padded"], "_d2"),
    ])
    return out.select(
        "filial",
        F.coalesce(F.col("nome_cliente"), F.lit("")).alias("cliente"),
        sale_class.alias("classificacao"),
        chassis.alias("nro_chassi"),
        needs.alias("chassi_testado"),
        F.col("_c").alias("chassi_encontrado"),
        document.alias("nro_documento"),
        F.col("_plain").isNotNull().alias("documento_testado"),
        (F.col("_d1") | F.col("_d2")).alias("documento_encontrado"),
    )


def key_match_rates(checked: DataFrame) -> DataFrame:
    """Tested and found counts of a key_match_check."""
    return checked.agg(
        F.count_if("chassi_testado").alias("chassi_total"),
        F.count_if(F.col("chassi_testado") & F.col("chassi_encontrado")).alias("chassi_ok"),
        F.count_if("documento_testado").alias("doc_total"),
        F.count_if(F.col("documento_testado") & F.col("documento_encontrado")).alias("doc_ok"),
    )
