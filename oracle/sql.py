"""DuckDB SQL for the named queries. Queries left out here have no SQL form on purpose."""

from oracle.views import (
    MONTHS,
    base_of,
    commission_points,
    d,
    digits_only,
    fold,
    label,
    money,
    note,
    padded,
    points_margin,
    total,
    with_views,
)

_BR = "'R$ ' || replace(replace(replace(format('{{:,.2f}}', {0}), ',', '#'), '.', ','), '#', '.')"
_PCT = "replace(replace(replace(format('{{:,.2f}}', {0}), ',', '#'), '.', ','), '#', '.') || '%'"
_ROW_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT))"

_LEDGER_COLUMNS = """competencia_ano, competencia_mes, mes_ano_comissao, CAST(periodo_inicio AS VARCHAR) AS periodo_inicio,
 CAST(periodo_fim AS VARCHAR) AS periodo_fim, fonte, arquivo_origem, tipo, filial, CAST(data_emissao AS VARCHAR) AS data_emissao,
 nro_documento, modelo, nro_chassi, nome_cliente, cen, cod_vendedor, gerente, classificacao_venda, receita_bruta, perc_comissao_fat,
 valor_comissao_fat, cmv, margem_rs, perc_margem_direta, valor_incentivo, receita_bruta_incentivos_rs, margem_incentivos_rs,
 meta_margem, perc_margem_bruta, perc_comissao_margem, valor_comissao_margem, valor_comissao_total,
 CAST(paid_at AS VARCHAR) AS paid_at"""

_ANALYTIC = """filial, nro_documento, nro_chassi, nome_cliente, cen, classificacao_venda, receita_bruta, valor_comissao_fat,
 margem_rs, perc_margem_direta, valor_incentivo, margem_incentivos_rs, meta_margem, perc_margem_bruta,
 valor_comissao_margem, valor_comissao_total"""

_BASE = """tipo, filial, CAST(data_emissao AS VARCHAR) AS data_emissao, nro_documento, modelo, veiculo_categoria,
 veiculo_estado, nro_chassi, cliente_codigo, nome_cliente, cen, cod_vendedor, classificacao_venda, receita_bruta,
 CAST(0 AS DOUBLE) AS perc_comissao_fat, CAST(0 AS DOUBLE) AS valor_comissao_fat, cmv, margem_rs, perc_margem_direta,
 valor_incentivo, receita_bruta_incentivos_rs, margem_incentivos_rs, CAST(0 AS DOUBLE) AS meta_margem, perc_margem_bruta,
 CAST(0 AS DOUBLE) AS perc_comissao_margem, CAST(0 AS DOUBLE) AS valor_comissao_margem,
 CAST(0 AS DOUBLE) AS valor_comissao_total, row_id"""

_HISTORY = """qtd_lancamentos_pagos, valor_pago_historico, valor_estornado_historico, saldo_comissao_paga_chassi,
 tem_pagamento_positivo, tem_estorno_negativo"""


def _scaled(x: str) -> str:
    """A numeric percent within one as points."""
    return points_margin(x)


_PERIOD = """1996 AS competencia_ano, 3 AS competencia_mes, 'Abril/1996' AS mes_ano_comissao, '1996-03-16' AS periodo_inicio,
 '1996-04-15' AS periodo_fim, 'manual' AS fonte, CAST(NULL AS VARCHAR) AS arquivo_origem"""

_KEY_CHECK = """SELECT filial, COALESCE(nome_cliente, '') AS cliente, COALESCE(classificacao_venda, '') AS classificacao, nro_chassi,
 COALESCE(classificacao_venda = 'Maquinas JD - Novos', FALSE) AS chassi_testado,
 COALESCE(classificacao_venda = 'Maquinas JD - Novos', FALSE) AND upper(nro_chassi) IN (SELECT upper(chassi) FROM incentives)
  AS chassi_encontrado, nro_documento, TRUE AS documento_testado,
 nro_documento IN (SELECT nota FROM invoices) OR lpad(nro_documento, 9, '0') IN (SELECT nota FROM invoices)
  AS documento_encontrado"""

_CEN = ("SELECT s.cen, "
        + ", ".join(
            f"{total(f'CASE WHEN p.classe = {k} THEN p.valor_comissao_fat END')} AS {n}" for k, n in (
                ("'MAQUINAS JD - NOVOS'", "comissao_faturamento"), ("'VENDA DIRETA'", "venda_direta"),
                ("'MAQUINAS JD - USADOS'", "comissao_usados"), ("'IMPLEMENTO'", "comissao_implementos"),
                ("'INVASAO DE AREA'", "comissao_invasao_area")))
        + f", {total('p.valor_comissao_margem')} AS comissao_margem, "
        + total("p.valor_comissao_margem + CASE WHEN p.classe IN ('MAQUINAS JD - NOVOS','VENDA DIRETA','MAQUINAS JD - USADOS',"
                "'IMPLEMENTO','INVASAO DE AREA') THEN p.valor_comissao_fat ELSE 0 END")
        + " AS valor_comissao_total FROM sellers_ok s LEFT JOIN period_rows p ON p.cod = s.cod GROUP BY s.cod, s.cen")

_PENDING = """SELECT CASE WHEN cod = '' THEN 'Sem cod_vendedor' ELSE 'Cod_vendedor sem relação CEN x Gerente' END AS pendencia,
 cod_vendedor, cen, nro_documento, nro_chassi, classificacao_venda, valor_comissao_fat, valor_comissao_margem, valor_comissao_total
FROM period_rows WHERE cod NOT IN (SELECT cod FROM sellers_ok)"""

_WEIGHTED = (f"COALESCE({money('perc_margem_bruta * receita_bruta_incentivos_rs')} / "
             f"NULLIF({money('receita_bruta_incentivos_rs')}, 0), 0)")

_MANAGERS = f"""SELECT min(trim(gerente)) AS gerente, {total('receita_bruta')} AS receita_bruta,
 {total('margem_incentivos_rs')} AS margem_incentivos_rs, round({_WEIGHTED}, 6) AS perc_margem_bruta,
 {total('valor_comissao_total')} AS comissao_total_cen,
 CAST(round(SUM(CAST(valor_comissao_total AS DECIMAL(28,6))) * 0.33, 4) AS DOUBLE) AS comissao_gerente
FROM period_rows WHERE trim(COALESCE(gerente, '')) <> '' GROUP BY {fold('gerente')}"""

_SHARE = "CAST(round(SUM(CAST(receita_bruta AS DECIMAL(28,6))) * {0}, 2) AS DOUBLE)"

_SQL = {
    "scan_source": """SELECT centro_custo, CAST(data_emissao AS VARCHAR) AS data_emissao, nota_fiscal_numero, chassi, cliente_codigo,
 vendedor_codigo, produto_codigo, valor_total, valor_venda_liquida, valor_custo, valor_impostos FROM billing""",
    "ledger_by_competence": f"SELECT {_LEDGER_COLUMNS} FROM ledger WHERE competencia_ano = 1996 AND competencia_mes = 3",
    "ledger_by_label": f"SELECT {_LEDGER_COLUMNS} FROM ledger WHERE mes_ano_comissao = 'Abril/1996'",
    "ledger_period_labels": "SELECT DISTINCT mes_ano_comissao FROM ledger",
    "ingest_report_sheets": """SELECT filial, modelo, nro_chassi, doc AS nro_documento, receita_bruta, tot_val AS valor_comissao_total
FROM sheet_rows""",
    "ingest_flat_sheets": f"""SELECT p_brand AS modelo, {commission_points("(p_size + CAST(0.5 AS DOUBLE))")} AS percentual,
 TRUE AS ativo FROM part""",
    "prepare_ledger_rows": f"""SELECT {_PERIOD}, tipo, filial, CAST(data_emissao AS VARCHAR) AS data_emissao, nro_documento, modelo,
 nro_chassi, nome_cliente, cen, cod_vendedor, gerente, classificacao_venda, receita_bruta,
 {_scaled('perc_comissao_fat')} AS perc_comissao_fat, valor_comissao_fat, cmv, margem_rs,
 {_scaled('perc_margem_direta')} AS perc_margem_direta, valor_incentivo, receita_bruta_incentivos_rs, margem_incentivos_rs,
 {_scaled('meta_margem')} AS meta_margem, {_scaled('perc_margem_bruta')} AS perc_margem_bruta,
 {_scaled('perc_comissao_margem')} AS perc_comissao_margem, valor_comissao_margem, valor_comissao_total,
 {_scaled('perc_comissao_gerente')} AS perc_comissao_gerente, valor_comissao_gerente FROM managed""",
    "append_paid_ledger": f"""SELECT 1996 AS competencia_ano, 3 AS competencia_mes, filial, tipo, count(*) AS linhas,
 {total('receita_bruta')} AS receita_bruta FROM managed GROUP BY filial, tipo""",
    "append_excluded_ledger": """SELECT filial, tipo, count(*) AS linhas FROM base
WHERE row_id IN (SELECT row_id FROM marks WHERE excluir) GROUP BY ALL""",
    "write_incentive_titles": "SELECT * FROM titles",
    "rates_save_all": f"""SELECT 2 AS batch_id, p_brand AS modelo, {commission_points('percentual')} AS percentual, TRUE AS ativo
FROM (SELECT p_brand, CAST(trunc(avg(p_size)) + 2 AS DOUBLE) AS percentual FROM part GROUP BY 1)""",
    "rates_append": f"""SELECT batch AS batch_id, p_brand AS modelo, {commission_points('percentual')} AS percentual, TRUE AS ativo
FROM (SELECT p_brand, batch, CAST(trunc(avg(p_size)) + batch AS DOUBLE) AS percentual
 FROM part, (VALUES (1), (2)) b(batch) GROUP BY 1, 2)""",
    "rates_replace_active": f"""SELECT batch AS batch_id, p_brand AS modelo, {commission_points('percentual')} AS percentual,
 batch = 2 AS ativo FROM (SELECT p_brand, batch, CAST(trunc(avg(p_size)) + batch AS DOUBLE) AS percentual
 FROM part, (VALUES (1), (2)) b(batch) GROUP BY 1, 2)""",
    "managers_replace_active": f"""SELECT 2 AS batch_id, filial, gerente, cod_vendedor, vendedor,
 {points_margin('percentual_comissao_gerente')} AS percentual_comissao_gerente FROM manager_rules""",
    "export_report": f"SELECT {_ANALYTIC} FROM period_rows WHERE valor_comissao_total <> 0 AND trim(filial) <> ''",
    # scalar functions
    "norm_key": "SELECT row_id, upper(trim(chassi)) AS chave FROM lines",
    "fold_text": f"SELECT {fold('gerente')} AS gerente, {fold('classificacao_venda')} AS classe, count(*) AS linhas FROM ledger GROUP BY 1, 2",
    "norm_document": """SELECT row_id, CAST(CAST(nota_fiscal_numero AS BIGINT) AS VARCHAR) AS documento,
 COALESCE(produto_codigo, '') AS produto FROM billing""",
    "pad_document": f"""SELECT row_id, lpad(CAST(CAST(nota_fiscal_numero AS BIGINT) AS VARCHAR), 9, '0') AS documento,
 CASE WHEN produto_codigo IS NULL THEN '' ELSE {padded('produto_codigo')} END AS produto FROM billing""",
    "parse_date_br": f"""SELECT {_ROW_ID} AS row_id, CASE WHEN l_linenumber <> 2 THEN CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS dia
FROM lineitem""",
    "is_blank_key": f"SELECT {_ROW_ID} AS row_id, l_linenumber IN (1, 2, 4) AS vazio FROM lineitem",
    "blank_to_null": "SELECT row_id, NULLIF(trim(chassi), '') AS chassi FROM lines",
    "parse_br_number": "SELECT row_id, num AS numero FROM line_texts",
    "parse_percent_points": f"""SELECT row_id, COALESCE(num, 0) AS de_texto, {points_margin('(l_discount * 10)')} AS de_numero,
 {points_margin('l_quantity')} AS de_inteiro FROM line_texts""",
    "parse_commission_points": f"""SELECT row_id, COALESCE({commission_points('num')}, 0) AS de_texto,
 {commission_points('(l_discount * 10)')} AS de_numero, {commission_points('l_quantity')} AS de_inteiro FROM line_texts""",
    "parse_margin_points": f"""SELECT row_id, COALESCE(CASE WHEN has_percent THEN num ELSE {points_margin('num')} END, 0) AS de_texto,
 {points_margin('(l_discount * 10)')} AS de_numero, {points_margin('l_quantity')} AS de_inteiro FROM line_texts""",
    "rate_read_normalize": f"""SELECT {_ROW_ID} AS row_id, {commission_points('l_quantity')} AS percentual,
 {points_margin('(l_tax * ' + d('12.5') + ')')} AS meta FROM lineitem""",
    "format_currency_br": f"SELECT {_ROW_ID} AS row_id, {_BR.format('l_extendedprice * 40')} AS valor FROM lineitem",
    "format_percent_br": f"SELECT {_ROW_ID} AS row_id, {_PCT.format('l_discount * 100')} AS valor FROM lineitem",
    "classify_sale": """SELECT chassi, CASE WHEN categoria = 'IP' THEN 'Implemento' WHEN estado = 'NOVO' THEN 'Maquinas JD - Novos'
 WHEN estado = 'USADO' THEN 'Maquinas JD - Usados' END AS classe FROM vehicles""",
    "gross_margin": """SELECT row_id, CASE WHEN t >= 0 THEN t - i - c ELSE -t + i + c END AS margem FROM (
 SELECT row_id, valor_total AS t, valor_impostos AS i, valor_custo AS c FROM billing
 UNION ALL SELECT row_id, valor_total, valor_impostos, valor_custo FROM sales_returns)""",
    "net_revenue": """SELECT row_id, valor_venda_liquida AS liquida FROM billing
UNION ALL SELECT row_id, -valor_total - valor_impostos FROM sales_returns""",
    "margin_pct": """SELECT row_id, CASE WHEN valor_venda_liquida = 0 THEN CAST(0 AS DOUBLE)
 ELSE (valor_total - valor_impostos - valor_custo) / valor_venda_liquida * 100 END AS percentual FROM billing""",
    "incentive_status": """SELECT titulo AS titulo_numero, tipo AS tipo_titulo, saldo AS valor_saldo,
 CASE WHEN tipo = '' THEN 'VERIFICAR' WHEN abs(saldo) < 0.01 THEN 'APTO' ELSE 'NÃO APTO' END AS status,
 CASE WHEN tipo = '' THEN 'Há título de incentivo não encontrado em bdnContasReceber'
  WHEN abs(saldo) < 0.01 THEN 'Todos os títulos de incentivo estão quitados'
  ELSE 'Há saldo pendente em título(s) de incentivo' END AS detalhe FROM receivables""",
    "paid_status": """SELECT ch AS nro_chassi, CASE WHEN has_pos AND has_neg THEN
  CASE WHEN bal > 0 THEN 'Atenção: pagamento e estorno parcial' WHEN bal < 0 THEN 'Atenção: histórico líquido negativo'
   ELSE 'Atenção: comissão anterior zerada por estorno' END
 WHEN has_neg THEN 'Atenção: chassi com devolução/estorno histórico' WHEN has_pos THEN 'Já pago'
 ELSE 'Verificar histórico de comissões pagas' END AS status FROM paid_sum""",
    "combine_status": "SELECT v1_status, v2_status, status_geral, count(*) AS linhas FROM elig GROUP BY ALL",
    "matches_rule": f"""SELECT row_id, EXISTS (SELECT 1 FROM fat_rules f WHERE upper(f.modelo) = upper(b.modelo)
 AND abs(round(b.perc_margem_bruta / 10, 2) - ({commission_points('f.percentual')})) <= 0.01) AS confere FROM base b""",
    "safe_float": f"SELECT {_ROW_ID} AS row_id, CASE WHEN l_linenumber <> 1 THEN l_extendedprice END AS valor FROM lineitem",
    "commission_period": f"""SELECT o_orderkey, {label("(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH)")} AS label,
 year(o_orderdate) AS base_year, month(o_orderdate) AS base_month,
 strftime(date_trunc('month', o_orderdate), '%Y-%m-16') AS start_date,
 strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH, '%Y-%m-15') AS end_date FROM orders""",
    "period_of_date": f"SELECT o_orderkey, CAST({base_of('o_orderdate')} AS VARCHAR) AS base FROM orders",
    "period_options": f"""SELECT DISTINCT o_custkey, y_label AS label FROM (
 SELECT o_custkey, CASE WHEN m = 12 THEN {MONTHS}[1] || '/' || (y + 1) ELSE {MONTHS}[m + 1] || '/' || y END AS y_label
 FROM (SELECT DISTINCT o_custkey, unnest(range(year(o_orderdate) - 1, year(o_orderdate) + 2)) AS y FROM orders),
  (SELECT unnest(range(1, 13)) AS m))""",
    "default_period": f"SELECT o_orderkey, {label('o_orderdate')} AS label FROM orders",
    "infer_period_label": f"""SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 AND year(o_orderdate) BETWEEN 1996 AND 1998
 THEN {label('o_orderdate')} ELSE 'Abril/1996' END AS label FROM orders""",
    "sanitize_label": """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'periodo'
 ELSE 'a_b_c_' || replace(o_orderpriority, ' ', '_') || '__' || o_custkey END AS label FROM orders""",
    # projections and filters
    "resolve_column": "SELECT p_partkey AS id, p_brand AS modelo FROM part",
    "window_filter": """SELECT row_id, strftime(data_emissao, '%d/%m/%Y') AS data_emissao, valor_total FROM billing
WHERE data_emissao BETWEEN DATE '1996-03-16' AND DATE '1996-04-15'""",
    "exclude_product_code": "SELECT row_id, produto_codigo FROM billing WHERE produto_codigo IS NULL OR produto_codigo NOT LIKE '%CVD%'",
    "prepare_fat_rates": f"""SELECT grupo, modelo, {commission_points('pct')} AS percentual, TRUE AS ativo FROM rate_upload
WHERE modelo IS NOT NULL""",
    "prepare_margin_rates": f"""SELECT grupo, modelo, {commission_points('pct')} AS percentual, {points_margin('meta')} AS meta_margem,
 TRUE AS ativo FROM rate_upload WHERE modelo IS NOT NULL""",
    "prepare_manager_relations": f"""SELECT 'M' || s_nationkey AS gerente, 'S' || s_suppkey AS cod_vendedor, s_name AS vendedor,
 {points_margin('((s_suppkey % 3) / 2)')} AS percentual_comissao_gerente, TRUE AS ativo
FROM supplier WHERE s_suppkey % 6 <> 0 AND s_suppkey % 5 <> 0""",
    "calc_rate_table": f"""SELECT upper(modelo) AS modelo, {commission_points('percentual')} AS percentual,
 {points_margin('meta_margem')} AS meta_margem FROM margin_rules
QUALIFY row_number() OVER (PARTITION BY upper(modelo) ORDER BY updated_at DESC) = 1""",
    "report_relations": f"SELECT cod_vendedor AS cod, {fold('gerente')} AS gerente, {fold('vendedor')} AS vendedor FROM manager_rules",
    "report_paid_rows": """SELECT cod, classe, nro_documento, receita_bruta, valor_comissao_fat, valor_comissao_margem,
 valor_comissao_total FROM period_rows""",
    "normalize_report_columns": """SELECT CASE l_linenumber WHEN 1 THEN 'nan' WHEN 2 THEN ' ' ELSE s_name END AS filial, p_brand AS modelo,
 upper(trim(chassi)) AS nro_chassi, lpad(CAST(l_orderkey AS VARCHAR), 9, '0') AS nro_documento, l_discount AS perc_comissao_fat FROM lines""",
    "normalize_report_rows": """SELECT s_name AS filial, p_brand AS modelo, upper(trim(chassi)) AS nro_chassi,
 lpad(CAST(l_orderkey AS VARCHAR), 9, '0') AS nro_documento, l_discount AS perc_comissao_fat FROM lines WHERE l_linenumber NOT IN (1, 2)""",
    "analytic_projection": "SELECT " + _ANALYTIC.replace("nome_cliente", "CAST(NULL AS VARCHAR) AS nome_cliente") + " FROM ledger",
    "display_format": f"""SELECT tipo, nro_documento, COALESCE({_BR.format('receita_bruta')}, '') AS receita_bruta,
 COALESCE({_BR.format('valor_comissao_total')}, '') AS valor_comissao_total,
 COALESCE({_PCT.format('perc_margem_bruta')}, '') AS perc_margem_bruta FROM ledger""",
    "rule_listing": "SELECT grupo, modelo, percentual, meta_margem, ativo, CAST(updated_at AS VARCHAR) AS updated_at FROM margin_rules",
    "result_filters": """SELECT row_id, status_geral, filial, v1_status FROM elig WHERE status_geral <> '✅ APTO'
 AND filial IN ('NATION_1', 'NATION_2', 'NATION_3') AND v1_status IN ('N/A', 'APTO')""",
    "history_listing": """SELECT tipo, filial, CAST(data_emissao AS VARCHAR) AS data_emissao, nro_documento, modelo, nro_chassi, valor_comissao_total,
 qtd_lancamentos_pagos, valor_pago_historico, valor_estornado_historico, saldo_comissao_paga_chassi, qtd_lancamentos_excluidos,
 bloqueado_exclusao, status_confronto, bloqueado_pagamento FROM settled_full""",
    "validation_listing": """SELECT * EXCLUDE (row_id, classificacao_venda), COALESCE(cliente, '') AS nome_cliente,
 COALESCE(classificacao_venda, NULL) AS classificacao_venda FROM elig""",
    # joins
    "machine_base": f"SELECT {_BASE} FROM base",
    "incentive_titles": "SELECT * FROM titles",
    "rate_lookup": """SELECT row_id, modelo, f_pct AS perc_comissao_fat, m_meta AS meta_margem, m_pct AS perc_comissao_margem,
 has_fat AS regra_fat_encontrada, has_margin AS regra_margem_encontrada FROM rated""",
    "manager_lookup": "SELECT row_id, cod_vendedor, gerente, perc_comissao_gerente FROM managed",
    "paid_history_join": f"SELECT row_id, nro_chassi, {_HISTORY} FROM history",
    "paid_history_join_bucketed": f"SELECT row_id, nro_chassi, {_HISTORY} FROM history",
    "excluded_join": "SELECT row_id, nro_chassi, qtd_lancamentos_excluidos, bloqueado_exclusao FROM history",
    "open_candidates": """SELECT row_id, nro_chassi, status_confronto FROM confronted
WHERE NOT bloqueado_pagamento AND NOT bloqueado_exclusao""",
    "incentive_lookup": """SELECT chassi, v1_status, v1_saldo, CAST(v1_data_emissao AS VARCHAR) AS v1_data_emissao, v1_nf_incentivo,
 v1_detalhe FROM v1""",
    "invoice_lookup": """SELECT documento, CAST(data AS VARCHAR) AS data, cliente, nota, CAST(data_fat AS VARCHAR) AS data_fat
FROM invoice_hits""",
    "receivable_lookup": """SELECT cliente, titulo, CAST(round(CAST(saldo AS DECIMAL(28,6)), 2) AS DOUBLE) AS saldo, tipos, tipos_pendentes,
 qtd_pendentes, qtd_pendentes_fora_bl FROM by_title""",
    "extraction_key_check": """SELECT arquivo, linha, nro_chassi, doc AS nro_documento FROM sheet_rows s
WHERE NOT EXISTS (SELECT 1 FROM sheet_keys k WHERE k.ch = s.nro_chassi AND k.doc = s.doc)""",
    "audit_rule_join": f"""SELECT b.row_id, b.modelo, COALESCE(f.n, 0) AS n_fat, COALESCE(m.n, 0) AS n_margem, m.top AS maior_meta
FROM base b LEFT JOIN (SELECT modelo, count(DISTINCT {commission_points('percentual')}) AS n FROM fat_rules GROUP BY 1) f ON f.modelo = b.modelo
LEFT JOIN (SELECT modelo, count(DISTINCT {commission_points('percentual')}) AS n, max({points_margin('meta_margem')}) AS top
 FROM margin_rules GROUP BY 1) m ON m.modelo = b.modelo""",
    "source_reconciliation": f"""SELECT tipo, n AS qtd_linhas_sql, v AS receita_bruta_sql, n AS qtd_linhas_tabela, v AS receita_bruta_tabela,
 0 AS diferenca_linhas, CAST(0 AS DOUBLE) AS diferenca_receita_bruta FROM (
 SELECT COALESCE(tipo, 'Total') AS tipo, count(*) AS n, {total('valor_total')} AS v FROM src GROUP BY ROLLUP (tipo))""",
    "cen_base_join": f"SELECT cen, valor_comissao_total FROM ({_CEN})",
    "cen_pending": _PENDING,
    "selected_rows": """SELECT b.row_id, b.tipo, b.filial, m.pagar, m.excluir AND NOT m.pagar AS excluir
FROM base b JOIN marks m ON m.row_id = b.row_id""",
    "confirmed_rows": f"""SELECT row_id, tipo, receita_bruta FROM base WHERE row_id IN (SELECT {_ROW_ID} FROM lineitem
 WHERE l_orderkey % 4 = 0 AND l_linenumber <> 1)""",
    "key_match_check": _KEY_CHECK + " FROM base",
    # aggregations
    "incentive_by_title": "SELECT chassi AS nro_chassi, nota AS titulo_incentivo, valor AS valor_incentivo FROM title_values",
    "incentive_by_chassis": "SELECT ch AS chassi, valor AS valor_incentivo FROM inc_chassis",
    "receivable_by_title": f"SELECT upper(trim(titulo)) AS titulo, {total('saldo')} AS saldo FROM receivables GROUP BY 1",
    "dimension_dedup": """SELECT upper(trim(chassi)) AS chassi_chave, max(p_brand) AS p_brand, max(p_type) AS p_type, max(s_name) AS s_name
FROM lines WHERE trim(chassi) <> '' GROUP BY 1""",
    "incentive_summary": f"""SELECT nro_chassi, string_agg(titulo_incentivo, ' / ' ORDER BY titulo_incentivo) AS titulos_incentivo,
 count(*) AS qtd_titulos_incentivo, {money('valor_incentivo')} AS valor_incentivo, {money('saldo_incentivo')} AS saldo_incentivo,
 CASE WHEN bool_or(status_incentivo = 'VERIFICAR') THEN 'VERIFICAR' WHEN abs({money('saldo_incentivo')}) < 0.01 THEN 'APTO'
  ELSE 'NÃO APTO' END AS status_incentivo,
 CASE WHEN bool_or(status_incentivo = 'VERIFICAR') THEN 'Há título de incentivo não encontrado em bdnContasReceber'
  WHEN abs({money('saldo_incentivo')}) < 0.01 THEN 'Todos os títulos de incentivo estão quitados'
  ELSE 'Há saldo pendente em título(s) de incentivo' END AS detalhe_incentivo FROM titles GROUP BY nro_chassi""",
    "source_audit": f"""SELECT COALESCE(tipo, 'Total') AS tipo, count(*) AS qtd_linhas, {total('valor_total')} AS receita_bruta
FROM src GROUP BY ROLLUP (tipo)""",
    "incentive_audit": f"""SELECT (SELECT count(DISTINCT upper(chassi)) FROM src WHERE chassi <> '') AS qtd_chassis,
 count(DISTINCT upper(chassi)) AS qtd_chassis_com_incentivo, count(DISTINCT upper(nota)) AS qtd_titulos_incentivo,
 {total('valor')} AS valor_incentivo, {total('valor')} AS valor_com_titulo, CAST(0 AS DOUBLE) AS valor_sem_titulo
FROM incentives WHERE upper(chassi) IN (SELECT upper(chassi) FROM src WHERE chassi <> '')""",
    "paid_summary": """SELECT ch AS nro_chassi, n AS qtd_lancamentos_pagos, pos AS valor_pago_positivo, neg AS valor_estornado_negativo,
 bal AS saldo_comissao_paga_chassi, has_pos AS tem_pagamento_positivo, has_neg AS tem_estorno_negativo FROM paid_sum""",
    "paid_summary_state": """SELECT ch AS nro_chassi, n AS qtd_lancamentos_pagos, pos AS valor_pago_positivo, neg AS valor_estornado_negativo,
 bal AS saldo_comissao_paga_chassi, has_pos AS tem_pagamento_positivo, has_neg AS tem_estorno_negativo FROM paid_sum""",
    "excluded_summary": """SELECT ch AS nro_chassi, n AS qtd_lancamentos_excluidos, '2024-05-01' AS ultima_exclusao FROM excluded_sum""",
    "receivable_summary": f"""SELECT upper(trim(titulo)) AS titulo, {total('saldo')} AS saldo_total, CAST(min(emissao) AS VARCHAR) AS data_emissao
FROM receivables GROUP BY 1""",
    "receivable_by_type": f"SELECT cliente, titulo, tipo, {total('saldo')} AS saldo FROM receivables GROUP BY 1, 2, 3",
    "cen_report": _CEN,
    "manager_report": _MANAGERS,
    "coordinator_report": f"""SELECT 'COORDINATOR' AS nome, CASE classe WHEN 'IMPLEMENTO' THEN 'Implemento' ELSE 'Maquinas JD - Usados' END AS tipo,
 {total('receita_bruta')} AS receita_bruta, {d('0.2')} AS perc_comissao_fat, {_SHARE.format('0.002')} AS valor_comissao_fat,
 {total('margem_incentivos_rs')} AS margem_incentivos_rs, {d('15')} AS meta_margem_coordenador,
 round({_WEIGHTED}, 6) AS perc_mb_realizado, {d('0.2')} AS perc_comissao_margem, {_SHARE.format('0.002')} AS valor_comissao_margem,
 {_SHARE.format('0.004')} AS valor_total_comissao
FROM period_rows WHERE classe IN ('IMPLEMENTO', 'MAQUINAS JD - USADOS') GROUP BY classe""",
    "audit_file_summary": f"""SELECT r.arquivo, CASE WHEN erros = 0 THEN 'Aprovado' ELSE 'Reprovado' END AS status, linhas AS linhas_lidas,
 CASE WHEN filial = 'NATION_7' THEN 11 ELSE 12 END AS colunas_lidas, linhas AS linhas_validadas, receita AS receita_bruta_lida,
 erros, avisos, comissao AS comissao_total_lida,
 COALESCE(array_to_string(list_transform(list_sort(used), lambda u: format('{{:.2f}}', u) || '%'), ', '), '') AS sentinela_usado,
 COALESCE(array_to_string(list_transform(list_sort(allowed), lambda u: format('{{:.2f}}', u) || '%'), ', '), '') AS sentinela_regra
FROM (SELECT arquivo, count(*) AS linhas, {total('receita_bruta')} AS receita, {total('tot_val')} AS comissao FROM sheet_rows GROUP BY 1) r
JOIN sentinel USING (arquivo)
LEFT JOIN (SELECT arquivo, count(*) FILTER (severidade = 'Erro') AS erros, count(*) FILTER (severidade = 'Aviso') AS avisos
 FROM issues GROUP BY 1) i USING (arquivo)""",
    "sum_numeric_column": f"SELECT l_suppkey, {total('num')} AS total, CAST(0 AS DOUBLE) AS ausente FROM line_texts GROUP BY 1",
    "allowed_fat_rates": f"""SELECT upper(modelo) AS modelo, array_to_string(list_transform(list_sort(list(DISTINCT {commission_points('pct')})),
 lambda v: format('{{:,.2f}}', v)), '|') AS percentuais FROM rate_upload WHERE modelo IS NOT NULL GROUP BY 1""",
    "allowed_margin_rules": f"""SELECT upper(modelo) AS modelo, count(DISTINCT {commission_points('pct')}) AS n_percentuais,
 array_to_string(list_transform(list_sort(list(DISTINCT {points_margin('meta')})), lambda v: format('{{:,.2f}}', v)), '|') AS metas
FROM rate_upload WHERE modelo IS NOT NULL GROUP BY 1""",
    "machine_totals": f"""SELECT * FROM (SELECT count(*) AS registros, {total('receita_bruta')} AS receita_bruta, {total('margem_rs')} AS margem_rs,
 {total('valor_incentivo')} AS valor_incentivo, {total('valor_comissao_total')} AS valor_comissao_total,
 count(*) FILTER (NOT regra_fat_encontrada) AS sem_regra_fat, count(*) FILTER (NOT regra_margem_encontrada) AS sem_regra_margem,
 count(*) FILTER (padrao_fat_aplicado) AS padrao_aplicado FROM settled),
 (SELECT count(*) AS linhas_historico, count(*) FILTER (bloqueado_pagamento) AS bloqueadas_pagamento,
 count(*) FILTER (bloqueado_exclusao) AS excluidas FROM settled_full)""",
    "extraction_totals": f"""SELECT COALESCE(tipo, 'Total') AS tipo, count(*) AS qtd_linhas, {total('receita_bruta')} AS receita_bruta
FROM base GROUP BY ROLLUP (tipo)""",
    "incentive_reconciliation": f"""SELECT 'Select SQL por chassis únicos' AS criterio,
 (SELECT count(DISTINCT upper(chassi)) FROM src WHERE chassi <> '') AS qtd_chassis,
 count(DISTINCT upper(chassi)) AS qtd_chassis_com_incentivo, count(DISTINCT nota) AS qtd_titulos_incentivo,
 {total('valor')} AS valor_incentivo, {total('valor')} AS valor_com_titulo, CAST(0 AS DOUBLE) AS valor_sem_titulo
FROM incentives WHERE upper(chassi) IN (SELECT upper(chassi) FROM src WHERE chassi <> '')
UNION ALL SELECT 'Tabela única por chassis únicos', count(*), count(*) FILTER (v <> 0), 0, {total('v')}, {total('v')}, CAST(0 AS DOUBLE)
FROM (SELECT upper(nro_chassi) AS ch, max(valor_incentivo) AS v FROM base WHERE nro_chassi <> '' GROUP BY 1)
UNION ALL SELECT 'Tabela única por linhas', count(*), count(*) FILTER (valor_incentivo <> 0), 0, {total('valor_incentivo')},
 {total('valor_incentivo')}, CAST(0 AS DOUBLE) FROM base""",
    "eligibility_totals": f"""SELECT count(*) AS total, count(*) FILTER (status_geral = '✅ APTO') AS aptos,
 count(*) FILTER (status_geral = '❌ NÃO APTO') AS nao_aptos, count(*) FILTER (status_geral = '⚠️ VERIFICAR') AS verificar,
 {total("CASE WHEN status_geral = '✅ APTO' THEN valor_comissao END")} AS valor_apto,
 {total("CASE WHEN status_geral = '❌ NÃO APTO' THEN valor_comissao END")} AS valor_nao_apto,
 count(*) FILTER (v1_status IN ('NÃO APTO', 'NÃO ENCONTRADO', 'ERRO')) AS v1_pendentes,
 count(*) FILTER (v2_status IN ('NÃO APTO', 'NÃO ENCONTRADO', 'ERRO')) AS v2_pendentes FROM elig""",
    "key_match_rates": f"""SELECT count(*) FILTER (chassi_testado) AS chassi_total,
 count(*) FILTER (chassi_testado AND chassi_encontrado) AS chassi_ok, count(*) FILTER (documento_testado) AS doc_total,
 count(*) FILTER (documento_encontrado) AS doc_ok FROM ({_KEY_CHECK} FROM base)""",
    "report_totals": f"""SELECT count(*) AS linhas, {total('receita_bruta')} AS receita_bruta, {total('margem_rs')} AS margem_rs,
 {total('valor_comissao_total')} AS valor_comissao_total FROM period_rows""",
    # windows and de-duplication
    "latest_fat_rates": "SELECT * REPLACE (CAST(updated_at AS VARCHAR) AS updated_at) FROM fat_now",
    "latest_margin_rates": "SELECT * REPLACE (CAST(updated_at AS VARCHAR) AS updated_at) FROM margin_now",
    "latest_managers": "SELECT * REPLACE (CAST(updated_at AS VARCHAR) AS updated_at) FROM managers_now",
    "first_per_key": """SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey
 ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey) = 1""",
    "duplicate_keys": """SELECT 'linhas' AS arquivo, row_id, upper(chassi) AS nro_chassi, CAST(year(ship) AS VARCHAR) AS nro_documento FROM lines
QUALIFY count(*) OVER (PARTITION BY upper(chassi), year(ship)) > 1""",
    "top1_lookup": "SELECT upper(chassi) AS chassi, min(nota) AS nota FROM incentives GROUP BY 1",
    # sorts and sets
    "order_machine_base": "SELECT row_id, CAST(data_emissao AS VARCHAR) AS data_emissao, nro_documento, tipo FROM base",
    "sort_by_available": "SELECT CAST(data_emissao AS VARCHAR) AS data_emissao, nro_documento, nro_chassi, tipo FROM ledger",
    "report_order": f"SELECT gerente FROM ({_MANAGERS})",
    "sample_limit": f"""SELECT count(*) FILTER (chassi_testado) AS chassi_total,
 count(*) FILTER (chassi_testado AND chassi_encontrado) AS chassi_ok, count(*) FILTER (documento_testado) AS doc_total,
 count(*) FILTER (documento_encontrado) AS doc_ok FROM ({_KEY_CHECK} FROM (SELECT * FROM base
 ORDER BY data_emissao, nro_documento, tipo, row_id LIMIT 20))""",
    "union_billing_returns": """SELECT tipo, centro_custo, CAST(data_emissao AS VARCHAR) AS data_emissao, nota_fiscal_numero AS nro_documento,
 chassi AS nro_chassi, cliente_codigo, vendedor_codigo AS cod_vendedor, valor_total AS receita_bruta, liquida AS receita_liquida,
 valor_custo AS cmv, CASE WHEN valor_total >= 0 THEN valor_total - valor_impostos - valor_custo
  ELSE valor_total * -1 + valor_impostos + valor_custo END AS margem_rs, row_id FROM src""",
    "distinct_source_chassis": "SELECT max(chassi) AS chassi FROM src WHERE chassi <> '' GROUP BY upper(chassi)",
    "append_total_row": f"""SELECT COALESCE(o_orderpriority, 'Total') AS o_orderpriority, count(*) AS n, {total('o_totalprice')} AS o_totalprice
FROM orders GROUP BY ROLLUP (o_orderpriority)""",
    "concat_issues": """SELECT severidade, regra, count(*) AS ocorrencias FROM issues GROUP BY 1, 2
UNION ALL SELECT 'Erro', 'Leitura do arquivo', count(*) FROM nation""",
    "pay_exclude_conflicts": f"SELECT {_ROW_ID} AS row_id FROM lineitem WHERE l_orderkey % 4 = 0 AND l_partkey % 9 = 0",
    # composites
    "commission_rules": """SELECT row_id, perc_comissao_fat, meta_margem, perc_comissao_margem, regra_fat_encontrada, regra_margem_encontrada,
 regra_classificacao_aplicada, gatilho_margem_atingido, valor_comissao_fat, valor_comissao_margem, valor_comissao_total FROM calc""",
    "manager_commission": """SELECT row_id, cod_vendedor, gerente, perc_comissao_gerente, valor_comissao_gerente, regra_gerente_encontrada
FROM managed""",
    "default_fat_rate": """SELECT row_id, p AS perc_comissao_fat, receita_bruta * p / 100 AS valor_comissao_fat,
 receita_bruta * p / 100 + valor_comissao_margem AS valor_comissao_total, perc_comissao_fat = 0 AS padrao_fat_aplicado
FROM (SELECT *, CASE WHEN perc_comissao_fat = 0 THEN CAST(1 AS DOUBLE) ELSE perc_comissao_fat END AS p FROM calc)""",
    "paid_history_filter": "SELECT * FROM confronted",
    "machine_settlement": "SELECT * EXCLUDE (cmv, veiculo_categoria, veiculo_estado) REPLACE (CAST(data_emissao AS VARCHAR) AS data_emissao) FROM settled",
    "settlement_after_posting": "SELECT * EXCLUDE (cmv, veiculo_categoria, veiculo_estado) REPLACE (CAST(data_emissao AS VARCHAR) AS data_emissao) FROM settled",
    "payment_eligibility": "SELECT * FROM elig",
    "paid_sheet_audit": "SELECT * FROM issues",
    "audit_upload": f"""SELECT CASE WHEN length(arquivo) % 2 = 0 THEN replace(arquivo, '15-04-1996', '15-05-1996') ELSE arquivo END AS arquivo_origem,
 CASE WHEN length(arquivo) % 2 = 0 THEN 'Maio/1996' ELSE 'Abril/1996' END AS mes_ano_comissao, 'auditoria_excel' AS fonte, count(*) AS linhas,
 {total('receita_bruta')} AS receita_bruta FROM sheet_rows GROUP BY arquivo""",
    "payment_posting": f"""SELECT CASE WHEN m.pagar THEN 'pago' ELSE 'excluido' END AS livro, filial, count(*) AS linhas,
 {total('receita_bruta')} AS receita_bruta FROM settled JOIN marks m USING (row_id) WHERE NOT (m.pagar AND m.excluir) GROUP BY 1, 2""",
    "branch_analytic": f"SELECT {_ANALYTIC} FROM period_rows WHERE valor_comissao_total <> 0 AND trim(filial) <> ''",
    "used_implements_analytic": f"SELECT {_ANALYTIC} FROM period_rows WHERE classe IN ('IMPLEMENTO', 'MAQUINAS JD - USADOS')",
    "report_pack": f"""SELECT 'cen' AS relatorio, count(*) AS linhas, {total('valor_comissao_total')} AS total FROM ({_CEN})
UNION ALL SELECT 'pendencias', count(*), {total('valor_comissao_total')} FROM ({_PENDING})
UNION ALL SELECT 'gerentes', count(*), {total('comissao_total_cen')} FROM ({_MANAGERS})
UNION ALL SELECT 'coordenador', count(DISTINCT classe), {total('receita_bruta')} FROM period_rows WHERE classe IN ('IMPLEMENTO', 'MAQUINAS JD - USADOS')
UNION ALL SELECT 'filiais', count(*), {total('valor_comissao_total')} FROM period_rows WHERE valor_comissao_total <> 0 AND trim(filial) <> ''
UNION ALL SELECT 'usados', count(*), {total('valor_comissao_total')} FROM period_rows WHERE classe IN ('IMPLEMENTO', 'MAQUINAS JD - USADOS')""",
}

ORACLE = {name: with_views(body) for name, body in _SQL.items()}
