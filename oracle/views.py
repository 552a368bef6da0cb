"""The domain relations in DuckDB SQL, written from the definitions and not from the Spark code."""

import re


def d(number: str) -> str:
    return f"CAST({number} AS DOUBLE)"


def money(expr: str) -> str:
    """Exact sum as DOUBLE."""
    return f"CAST(SUM(CAST({expr} AS DECIMAL(28,6))) AS DOUBLE)"


def total(expr: str) -> str:
    """Exact sum rounded to cents."""
    return f"CAST(ROUND(COALESCE(SUM(CAST({expr} AS DECIMAL(28,6))), 0), 2) AS DOUBLE)"


def note(key: str) -> str:
    return f"CASE WHEN {key} % 2 = 0 THEN lpad(CAST({key} AS VARCHAR), 9, '0') ELSE CAST({key} AS VARCHAR) END"


MONTHS = ("['Janeiro','Fevereiro','Março','Abril','Maio','Junho','Julho','Agosto','Setembro','Outubro',"
          "'Novembro','Dezembro']")


def label(day: str) -> str:
    """Label of the month a date lies in."""
    return f"({MONTHS}[month({day})] || '/' || CAST(year({day}) AS VARCHAR))"


def base_of(day: str) -> str:
    return f"CAST(date_trunc('month', CASE WHEN day({day}) >= 16 THEN {day} ELSE {day} - INTERVAL 1 MONTH END) AS DATE)"


def fold(text: str) -> str:
    return f"upper(strip_accents(trim(COALESCE({text}, ''))))"


def points_margin(x: str) -> str:
    return f"CASE WHEN abs({x}) <= 1 AND {x} <> 0 THEN {x} * 100 ELSE {x} END"


def commission_points(x: str) -> str:
    return f"CASE WHEN abs({x}) > 10 THEN {x} / 100 ELSE {x} END"


def digits_only(x: str) -> str:
    """Document text as a whole number when it is one."""
    return f"COALESCE(CAST(CAST(trunc(TRY_CAST(trim({x}) AS DOUBLE)) AS BIGINT) AS VARCHAR), trim({x}))"


def padded(x: str) -> str:
    return f"CASE WHEN length({x}) < 9 THEN lpad({x}, 9, '0') ELSE {x} END"


_COMMON = """
 CAST(s_nationkey AS VARCHAR) AS centro_custo, ship AS data_emissao, nf AS nota_fiscal_numero, chassi,
 'C' || o_custkey AS cliente_codigo, 'S' || l_suppkey AS vendedor_codigo,
 CASE WHEN p_size = 50 THEN 'XCVD1' WHEN p_size = 49 THEN NULL ELSE 'P' || l_partkey END AS produto_codigo,
 CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN -gross ELSE gross END AS valor_total,
 gross * ((l_partkey % 30) / 100 + CAST(0.7 AS DOUBLE)) AS valor_custo,
 gross * l_tax AS valor_impostos, row_id
"""

VIEWS = {
    "lines": f"""
SELECT l.*, o.o_custkey, p.p_brand, p.p_type, p.p_size, s.s_nationkey, s.s_name,
 concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS row_id,
 l_extendedprice * 4 AS gross, CAST(l_shipdate AS DATE) AS ship, {note('l_orderkey')} AS nf,
 CASE WHEN l_partkey % 97 = 0 THEN '' WHEN l_linenumber = 3 THEN ' ch' || l_partkey ELSE 'CH' || l_partkey END AS chassi
FROM lineitem l JOIN orders o ON o_orderkey = l_orderkey JOIN part p ON p_partkey = l_partkey
JOIN supplier s ON s_suppkey = l_suppkey""",
    "billing": f"""
SELECT {_COMMON}, CASE WHEN l_linenumber = 7 THEN {d('0')} ELSE gross * (1 - l_discount) END AS valor_venda_liquida
FROM lines WHERE l_returnflag <> 'R'""",
    "sales_returns": f"SELECT {_COMMON} FROM lines WHERE l_returnflag = 'R'",
    "incentives": f"""
SELECT 'CH' || p_partkey AS chassi, 'I' || p_partkey AS nota, p_retailprice * {d('0.05')} AS valor
FROM part WHERE p_partkey % 3 <> 0
UNION ALL SELECT 'CH' || p_partkey, 'J' || p_partkey, {d('1')} FROM part WHERE p_partkey % 15 = 1""",
    "receivables": f"""
SELECT {note('o_orderkey')} AS titulo, 'C' || o_custkey AS cliente,
 CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'BL' WHEN '2' THEN 'BL' WHEN '3' THEN 'DP' WHEN '4' THEN 'NF' ELSE '' END AS tipo,
 CASE WHEN o_orderstatus = 'F' THEN {d('0')} ELSE o_totalprice END AS saldo, CAST(o_orderdate AS DATE) AS emissao
FROM orders WHERE o_orderkey % 11 <> 0
UNION ALL SELECT {note('o_orderkey')}, 'C' || o_custkey, 'DP',
 CASE WHEN o_orderkey % 3 = 0 THEN -o_totalprice ELSE {d('0')} END, CAST(o_orderdate AS DATE)
FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderstatus = 'P'
UNION ALL SELECT 'I' || p_partkey, 'FAB', 'IN',
 CASE WHEN p_partkey % 2 = 0 THEN {d('0')} ELSE p_retailprice * {d('0.05')} END, DATE '1996-02-01'
FROM part WHERE p_partkey % 4 <> 1""",
    "invoices": f"""
SELECT {note('o_orderkey')} AS nota, CAST(max(l_shipdate) AS DATE) AS emissao, 'C' || any_value(o_custkey) AS cliente
FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 13 <> 0 GROUP BY o_orderkey""",
    "vehicles": """
SELECT 'CH' || p_partkey AS chassi, p_brand AS modelo, CASE WHEN p_type = 'SMALL' THEN 'IP' ELSE 'MQ' END AS categoria,
 CASE p_size % 3 WHEN 0 THEN 'NOVO' WHEN 1 THEN 'USADO' END AS estado FROM part""",
    "src": """
SELECT 'Faturamento' AS tipo, centro_custo, data_emissao, nota_fiscal_numero, trim(chassi) AS chassi, cliente_codigo,
 vendedor_codigo, produto_codigo, valor_total, valor_impostos, valor_custo, valor_venda_liquida AS liquida, row_id FROM billing
WHERE produto_codigo IS NULL OR produto_codigo NOT LIKE '%CVD%'
UNION ALL
SELECT 'Devolução', centro_custo, data_emissao, nota_fiscal_numero, trim(chassi), cliente_codigo, vendedor_codigo,
 produto_codigo, valor_total, valor_impostos, valor_custo, -valor_total - valor_impostos, row_id FROM sales_returns
WHERE produto_codigo IS NULL OR produto_codigo NOT LIKE '%CVD%'""",
    "inc_chassis": f"SELECT upper(chassi) AS ch, {money('valor')} AS valor FROM incentives GROUP BY 1",
    "plain_base": """
SELECT s.tipo, n_name AS filial, s.data_emissao, s.nota_fiscal_numero AS nro_documento, v.modelo, v.categoria AS veiculo_categoria,
 v.estado AS veiculo_estado, s.chassi AS nro_chassi, s.cliente_codigo, c_name AS nome_cliente, s_name AS cen,
 s.vendedor_codigo AS cod_vendedor,
 CASE WHEN v.categoria = 'IP' THEN 'Implemento' WHEN v.estado = 'NOVO' THEN 'Maquinas JD - Novos'
  WHEN v.estado = 'USADO' THEN 'Maquinas JD - Usados' END AS classificacao_venda,
 s.valor_total AS receita_bruta, s.valor_custo AS cmv,
 CASE WHEN s.valor_total >= 0 THEN s.valor_total - s.valor_impostos - s.valor_custo
  ELSE s.valor_total * -1 + s.valor_impostos + s.valor_custo END AS margem_rs,
 s.liquida, COALESCE(i.valor, 0) AS valor_incentivo, s.row_id
FROM src s
LEFT JOIN inc_chassis i ON i.ch = upper(s.chassi)
LEFT JOIN vehicles v ON upper(v.chassi) = upper(s.chassi)
LEFT JOIN customer ON 'C' || c_custkey = s.cliente_codigo
LEFT JOIN supplier ON 'S' || s_suppkey = s.vendedor_codigo
LEFT JOIN nation ON CAST(n_nationkey AS VARCHAR) = s.centro_custo""",
    "base": """
SELECT * EXCLUDE (liquida), COALESCE(margem_rs / NULLIF(liquida, 0) * 100, 0) AS perc_margem_direta,
 receita_bruta + valor_incentivo AS receita_bruta_incentivos_rs, margem_rs + valor_incentivo AS margem_incentivos_rs,
 COALESCE((margem_rs + valor_incentivo) / NULLIF(liquida, 0) * 100, 0) AS perc_margem_bruta FROM plain_base""",
    "brands": "SELECT DISTINCT p_brand, CAST(split_part(p_brand, '#', 2) AS BIGINT) AS n FROM part",
    "fat_rules": f"""
SELECT 'G' || (n % 3) AS grupo, p_brand AS modelo, CASE WHEN n % 5 = 0 THEN {d('45')} ELSE n * {d('0.1')} END AS percentual,
 TRUE AS ativo, DATE '2024-06-01' AS updated_at, n AS id FROM brands WHERE n NOT IN (24, 25)
UNION ALL SELECT 'G' || (n % 3), p_brand, {d('0.9')}, TRUE, DATE '2023-01-01', n FROM brands WHERE n NOT IN (24, 25) AND n % 2 = 0
UNION ALL SELECT 'G' || (n % 3), p_brand, {d('0.7')}, FALSE, DATE '2025-01-01', n FROM brands WHERE n = 3""",
    "margin_rules": f"""
SELECT 'G' || (n % 3) AS grupo, p_brand AS modelo, CASE WHEN n % 6 = 0 THEN {d('0')} ELSE {d('0.2')} END AS percentual,
 CASE WHEN n % 2 = 0 THEN {d('0.15')} ELSE {d('12')} END AS meta_margem, TRUE AS ativo, DATE '2024-06-01' AS updated_at, n AS id
FROM brands WHERE n <> 25
UNION ALL SELECT 'G' || (n % 3), p_brand, {d('0.5')}, {d('20')}, TRUE, DATE '2023-01-01', n FROM brands WHERE n <> 25 AND n % 4 = 0""",
    "manager_rules": f"""
SELECT n_name AS filial, 'Gestão ' || n_name AS gerente, 'S' || s_suppkey AS cod_vendedor, 'X' || s_suppkey AS cod_x,
 CASE WHEN s_suppkey % 17 = 0 THEN 'GESTAO ' || upper(n_name) ELSE s_name END AS vendedor,
 CASE WHEN s_suppkey % 2 = 1 THEN {d('0.33')} ELSE {d('33')} END AS percentual_comissao_gerente,
 TRUE AS ativo, DATE '2024-06-01' AS updated_at, s_suppkey AS id
FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 10 <> 0
UNION ALL SELECT n_name, 'Gestão antiga', 'S' || s_suppkey, 'X' || s_suppkey,
 CASE WHEN s_suppkey % 17 = 0 THEN 'GESTAO ' || upper(n_name) ELSE s_name END,
 CASE WHEN s_suppkey % 2 = 1 THEN {d('0.33')} ELSE {d('33')} END, TRUE, DATE '2023-01-01', s_suppkey
FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 10 <> 0 AND s_suppkey % 7 = 0""",
    "fat_now": f"""
SELECT id, grupo, modelo, {commission_points('percentual')} AS percentual, ativo, updated_at FROM fat_rules WHERE ativo
QUALIFY row_number() OVER (PARTITION BY upper(trim(modelo)) ORDER BY updated_at DESC, id DESC) = 1""",
    "margin_now": f"""
SELECT id, grupo, modelo, {commission_points('percentual')} AS percentual, {points_margin('meta_margem')} AS meta_margem, ativo,
 updated_at FROM margin_rules WHERE ativo
QUALIFY row_number() OVER (PARTITION BY upper(trim(modelo)) ORDER BY updated_at DESC, id DESC) = 1""",
    "managers_now": f"""
SELECT * REPLACE ({points_margin('percentual_comissao_gerente')} AS percentual_comissao_gerente) FROM manager_rules WHERE ativo
QUALIFY row_number() OVER (PARTITION BY upper(trim(cod_vendedor)) ORDER BY updated_at DESC, id DESC) = 1""",
    "rated": f"""
SELECT b.*, COALESCE({commission_points('f.percentual')}, 0) AS f_pct, COALESCE({commission_points('m.percentual')}, 0) AS m_pct,
 COALESCE({points_margin('m.meta_margem')}, 0) AS m_meta, f.modelo IS NOT NULL AS has_fat, m.modelo IS NOT NULL AS has_margin
FROM base b LEFT JOIN fat_now f ON upper(f.modelo) = upper(b.modelo) LEFT JOIN margin_now m ON upper(m.modelo) = upper(b.modelo)""",
    "ruled": f"""
SELECT * EXCLUDE (f_pct, m_pct, m_meta, has_fat, has_margin),
 COALESCE(classificacao_venda IN ('Implemento', 'Maquinas JD - Usados'), FALSE) AS regra_classificacao_aplicada,
 CASE WHEN classificacao_venda = 'Implemento' AND receita_bruta >= 200000 THEN {d('0.84')}
  WHEN classificacao_venda IN ('Implemento', 'Maquinas JD - Usados') THEN {d('1')} ELSE f_pct END AS perc_comissao_fat,
 CASE WHEN classificacao_venda IN ('Implemento', 'Maquinas JD - Usados') THEN {d('0')} ELSE m_pct END AS perc_comissao_margem,
 CASE WHEN classificacao_venda IN ('Implemento', 'Maquinas JD - Usados') THEN {d('0')} ELSE m_meta END AS meta_margem,
 has_fat OR COALESCE(classificacao_venda IN ('Implemento', 'Maquinas JD - Usados'), FALSE) AS regra_fat_encontrada,
 has_margin OR COALESCE(classificacao_venda IN ('Implemento', 'Maquinas JD - Usados'), FALSE) AS regra_margem_encontrada
FROM rated""",
    "triggered": f"""
SELECT *, ({points_margin('perc_margem_bruta')}) >= meta_margem AND perc_comissao_margem > 0 AS gatilho_margem_atingido FROM ruled""",
    "valued": """
SELECT *, receita_bruta * perc_comissao_fat / 100 AS valor_comissao_fat,
 CASE WHEN gatilho_margem_atingido THEN receita_bruta * perc_comissao_margem / 100 ELSE 0 END AS valor_comissao_margem FROM triggered""",
    "calc": "SELECT *, valor_comissao_fat + valor_comissao_margem AS valor_comissao_total FROM valued",
    "managed": """
SELECT c.*, COALESCE(m.gerente, '') AS gerente, COALESCE(m.percentual_comissao_gerente, 0) AS perc_comissao_gerente,
 c.valor_comissao_total * COALESCE(m.percentual_comissao_gerente, 0) / 100 AS valor_comissao_gerente,
 COALESCE(m.gerente, '') <> '' AS regra_gerente_encontrada
FROM calc c LEFT JOIN managers_now m ON upper(m.cod_vendedor) = upper(c.cod_vendedor)""",
    "closed": f"""
SELECT {base_of('ship')} AS base_month, CASE WHEN l_returnflag = 'R' THEN 'Devolução' ELSE 'Faturamento' END AS tipo,
 n_name AS filial, ship AS data_emissao, nf AS nro_documento, p_brand AS modelo, chassi AS nro_chassi, c_name AS nome_cliente,
 s_name AS cen,
 CASE WHEN l_orderkey % 53 = 0 THEN NULL WHEN l_linenumber = 2 THEN ' s' || l_suppkey ELSE 'S' || l_suppkey END AS cod_vendedor,
 CASE WHEN l_linenumber = 4 THEN 'GESTAO ' || upper(n_name) ELSE 'Gestão ' || n_name END AS gerente,
 CASE WHEN p_type = 'SMALL' THEN 'Implemento' WHEN p_size % 3 = 0 THEN 'Maquinas JD - Novos'
  WHEN p_size % 3 = 1 THEN 'Maquinas JD - Usados' WHEN p_type = 'LARGE' THEN 'Venda Direta'
  WHEN p_type = 'MEDIUM' THEN 'Invasão de área' END AS classificacao_venda,
 gross AS receita_bruta, floor(gross) / 100 AS fat, gross * {d('0.7')} AS cmv, gross * l_discount AS margem_rs,
 l_discount * 100 AS perc_margem_direta, CASE WHEN l_partkey % 3 <> 0 THEN {d('5')} ELSE {d('0')} END AS valor_incentivo,
 l_discount * 100 + 8 AS perc_margem_bruta,
 CASE WHEN l_discount * 100 + 8 >= 12 THEN floor(gross * {d('0.2')}) / 100 ELSE {d('0')} END AS mar, l_linenumber, l_partkey
FROM lines JOIN nation ON n_nationkey = s_nationkey JOIN customer ON c_custkey = o_custkey
WHERE l_linestatus = 'F' AND l_partkey % 4 <> 0""",
    "signed": """
SELECT *, CAST(1 AS DOUBLE) AS sg FROM closed UNION ALL SELECT *, CAST(-1 AS DOUBLE) FROM closed WHERE l_partkey % 8 = 1""",
    "entries": f"""
SELECT base_month, tipo, filial, data_emissao, nro_documento, modelo, nro_chassi, nome_cliente, cen, cod_vendedor, gerente,
 classificacao_venda, receita_bruta, {d('1')} AS perc_comissao_fat, sg * fat AS valor_comissao_fat, cmv, margem_rs,
 perc_margem_direta, valor_incentivo, receita_bruta + valor_incentivo AS receita_bruta_incentivos_rs,
 margem_rs + valor_incentivo AS margem_incentivos_rs, {d('12')} AS meta_margem, perc_margem_bruta,
 {d('0.2')} AS perc_comissao_margem, sg * mar AS valor_comissao_margem,
 CASE WHEN l_linenumber <> 6 THEN sg * fat + sg * mar END AS valor_comissao_total FROM signed
UNION ALL BY NAME
SELECT DATE '1996-03-01' AS base_month, 'Faturamento' AS tipo, 'CH' || p_partkey AS nro_chassi,
 CASE p_partkey % 20 WHEN 5 THEN {d('-99999')} WHEN 8 THEN {d('0')} ELSE {d('-10')} END AS valor_comissao_total
FROM part WHERE p_partkey % 20 IN (4, 5, 7, 8)""",
    "ledger": f"""
SELECT year(base_month) AS competencia_ano, month(base_month) AS competencia_mes,
 {label('(base_month + INTERVAL 1 MONTH)')} AS mes_ano_comissao, CAST(base_month + INTERVAL 15 DAY AS DATE) AS periodo_inicio,
 CAST(base_month + INTERVAL 1 MONTH + INTERVAL 14 DAY AS DATE) AS periodo_fim, 'carga' AS fonte,
 CAST(NULL AS VARCHAR) AS arquivo_origem, * EXCLUDE (base_month),
 CAST(base_month + INTERVAL 1 MONTH + INTERVAL 14 DAY AS DATE) AS paid_at FROM entries""",
    "paid_sum": f"""
SELECT upper(trim(nro_chassi)) AS ch, count(*) AS n,
 {total('CASE WHEN valor_comissao_total > 0 THEN valor_comissao_total ELSE 0 END')} AS pos,
 {total('CASE WHEN valor_comissao_total < 0 THEN valor_comissao_total ELSE 0 END')} AS neg,
 {total('COALESCE(valor_comissao_total, 0)')} AS bal,
 bool_or(COALESCE(valor_comissao_total, 0) > 0) AS has_pos, bool_or(COALESCE(valor_comissao_total, 0) < 0) AS has_neg
FROM ledger WHERE trim(nro_chassi) <> '' GROUP BY 1""",
    "excluded_sum": "SELECT 'CH' || p_partkey AS ch, 1 AS n FROM part WHERE p_partkey % 41 = 0",
    "history_source": "SELECT row_id, nro_chassi FROM base",
    "history": """
SELECT b.row_id, b.nro_chassi, COALESCE(p.n, 0) AS qtd_lancamentos_pagos, COALESCE(p.pos, 0) AS valor_pago_historico,
 COALESCE(p.neg, 0) AS valor_estornado_historico, COALESCE(p.bal, 0) AS saldo_comissao_paga_chassi,
 COALESCE(p.has_pos, FALSE) AS tem_pagamento_positivo, COALESCE(p.has_neg, FALSE) AS tem_estorno_negativo,
 COALESCE(e.n, 0) AS qtd_lancamentos_excluidos, COALESCE(e.n, 0) > 0 AS bloqueado_exclusao
FROM history_source b LEFT JOIN paid_sum p ON p.ch = upper(b.nro_chassi) LEFT JOIN excluded_sum e ON e.ch = upper(b.nro_chassi)""",
    "confronted": """
SELECT *, CASE WHEN bloqueado_exclusao THEN 'Excluído manualmente'
  WHEN qtd_lancamentos_pagos = 0 THEN 'Novo para apuração'
  WHEN tem_pagamento_positivo AND tem_estorno_negativo AND saldo_comissao_paga_chassi > 0 THEN 'Atenção: pagamento e estorno parcial'
  WHEN tem_pagamento_positivo AND tem_estorno_negativo AND saldo_comissao_paga_chassi < 0 THEN 'Atenção: histórico líquido negativo'
  WHEN tem_pagamento_positivo AND tem_estorno_negativo THEN 'Atenção: comissão anterior zerada por estorno'
  WHEN tem_estorno_negativo THEN 'Atenção: chassi com devolução/estorno histórico'
  WHEN tem_pagamento_positivo AND saldo_comissao_paga_chassi > 0 THEN 'Já pago'
  ELSE 'Verificar histórico de comissões pagas' END AS status_confronto,
 tem_pagamento_positivo AND NOT tem_estorno_negativo AND saldo_comissao_paga_chassi > 0 AS bloqueado_pagamento FROM history""",
    "settled_full": "SELECT m.*, h.* EXCLUDE (row_id, nro_chassi) FROM managed m JOIN confronted h USING (row_id)",
    "settled": """
SELECT * REPLACE (CASE WHEN perc_comissao_fat = 0 THEN 1 ELSE perc_comissao_fat END AS perc_comissao_fat,
  receita_bruta * CASE WHEN perc_comissao_fat = 0 THEN 1 ELSE perc_comissao_fat END / 100 AS valor_comissao_fat,
  receita_bruta * CASE WHEN perc_comissao_fat = 0 THEN 1 ELSE perc_comissao_fat END / 100 + valor_comissao_margem
   AS valor_comissao_total), perc_comissao_fat = 0 AS padrao_fat_aplicado
FROM settled_full WHERE NOT bloqueado_pagamento AND NOT bloqueado_exclusao""",
    "title_balance": f"SELECT upper(trim(titulo)) AS t, {money('COALESCE(saldo, 0)')} AS saldo, min(emissao) AS emissao FROM receivables GROUP BY 1",
    "title_values": f"SELECT chassi, nota, {money('valor')} AS valor FROM incentives GROUP BY ALL",
    "titles": """
SELECT v.chassi AS nro_chassi, v.nota AS titulo_incentivo, v.valor AS valor_incentivo, COALESCE(b.saldo, 0) AS saldo_incentivo,
 CASE WHEN b.t IS NULL THEN 'VERIFICAR' WHEN abs(b.saldo) < 0.01 THEN 'APTO' ELSE 'NÃO APTO' END AS status_incentivo,
 CASE WHEN b.t IS NULL THEN 'Título não encontrado em bdnContasReceber' WHEN abs(b.saldo) < 0.01 THEN 'Incentivo quitado'
  ELSE 'Saldo pendente no título de incentivo' END AS detalhe_incentivo
FROM title_values v LEFT JOIN title_balance b ON b.t = upper(v.nota)""",
    "v1": """
SELECT n.chassi, n.nota AS v1_nf_incentivo, b.saldo AS v1_saldo, b.emissao AS v1_data_emissao,
 CASE WHEN b.t IS NULL THEN 'NÃO ENCONTRADO' WHEN abs(b.saldo) < 0.01 THEN 'APTO' ELSE 'NÃO APTO' END AS v1_status,
 CASE WHEN b.t IS NULL THEN 'NF ' || n.nota || ' não localizada em bdnContasReceber'
  WHEN abs(b.saldo) < 0.01 THEN 'Incentivo recebido integralmente'
  ELSE 'Saldo pendente: R$ ' || format('{:,.2f}', b.saldo) END AS v1_detalhe
FROM (SELECT upper(chassi) AS chassi, min(nota) AS nota FROM incentives GROUP BY 1) n
LEFT JOIN title_balance b ON b.t = upper(n.nota)""",
    "requests": f"SELECT DISTINCT {digits_only('nro_documento')} AS documento, data_emissao AS data FROM base",
    "invoice_hits": f"""
SELECT r.documento, r.data, i.cliente, i.nota, i.emissao AS data_fat
FROM requests r JOIN invoices i ON i.nota = r.documento OR i.nota = {padded('r.documento')}
QUALIFY row_number() OVER (PARTITION BY r.documento, r.data
 ORDER BY CASE WHEN i.nota = r.documento THEN 0 ELSE 1 END, CASE WHEN i.emissao = r.data THEN 0 ELSE 1 END, i.emissao, i.cliente) = 1""",
    "by_type": f"SELECT upper(cliente) AS cliente, upper(titulo) AS titulo, tipo, {money('saldo')} AS saldo FROM receivables GROUP BY 1, 2, 3",
    "by_title": f"""
SELECT cliente, titulo, {money('saldo')} AS saldo,
 COALESCE(string_agg(tipo, '/' ORDER BY tipo) FILTER (tipo <> ''), '') AS tipos,
 COALESCE(string_agg(tipo, '/' ORDER BY tipo) FILTER (tipo <> '' AND abs(saldo) >= 0.01), '') AS tipos_pendentes,
 count(*) FILTER (tipo <> '' AND abs(saldo) >= 0.01) AS qtd_pendentes,
 count(*) FILTER (tipo <> '' AND tipo <> 'BL' AND abs(saldo) >= 0.01) AS qtd_pendentes_fora_bl
FROM by_type GROUP BY 1, 2""",
    "v2_open": """
SELECT h.documento, h.data, h.cliente AS v2_cliente_cod, h.nota, h.data_fat, b.saldo, b.tipos, b.titulo IS NOT NULL AS known,
 abs(b.saldo) < 0.01 OR (qtd_pendentes > 0 AND qtd_pendentes_fora_bl = 0) AS payable,
 CASE WHEN abs(b.saldo) < 0.01 THEN 'Cliente quitou integralmente'
  WHEN qtd_pendentes > 0 AND qtd_pendentes_fora_bl = 0
   THEN 'Saldo R$ ' || format('{:,.2f}', b.saldo) || ' - pendente apenas em BL (apto conforme regra)'
  ELSE 'Saldo pendente R$ ' || format('{:,.2f}', b.saldo) || ' - tipo(s) com saldo: ' ||
   CASE WHEN qtd_pendentes > 0 THEN tipos_pendentes ELSE 'N/A' END END AS outcome
FROM invoice_hits h LEFT JOIN by_title b ON b.cliente = upper(h.cliente) AND b.titulo = upper(h.nota)""",
    "v2": """
SELECT documento, data, v2_cliente_cod, saldo AS v2_saldo, tipos AS v2_tipos_titulo,
 CASE WHEN NOT known THEN 'NÃO ENCONTRADO' WHEN payable AND data <> data_fat THEN 'ATENÇÃO' WHEN payable THEN 'APTO'
  ELSE 'NÃO APTO' END AS v2_status,
 CASE WHEN NOT known THEN 'Título ' || nota || ' do cliente ' || v2_cliente_cod || ' não localizado em bdnContasReceber'
  ELSE outcome || CASE WHEN data <> data_fat THEN ' | Data divergente: planilha=' || data || ' | faturamento=' || data_fat
   ELSE '' END END AS v2_detalhe
FROM v2_open""",
    "elig_rows": f"""
SELECT c.*, v1.v1_nf_incentivo, v1.v1_saldo, v1.v1_data_emissao, v2.v2_cliente_cod, v2.v2_saldo, v2.v2_tipos_titulo,
 CASE WHEN c.classificacao_venda IS DISTINCT FROM 'Maquinas JD - Novos' OR c.nro_chassi = '' THEN 'N/A'
  ELSE COALESCE(v1.v1_status, 'NÃO ENCONTRADO') END AS v1_status,
 CASE WHEN c.classificacao_venda IS DISTINCT FROM 'Maquinas JD - Novos'
   THEN 'Classificação ''' || COALESCE(c.classificacao_venda, '') || ''' não requer validação de chassi'
  WHEN c.nro_chassi = '' THEN 'Chassi não informado'
  ELSE COALESCE(v1.v1_detalhe, 'Chassi não localizado em bdnIncentivos') END AS v1_detalhe,
 COALESCE(v2.v2_status, 'NÃO ENCONTRADO') AS v2_status,
 COALESCE(v2.v2_detalhe, 'Documento ' || {digits_only('c.nro_documento')} || ' não localizado em bdnFaturamento') AS v2_detalhe
FROM calc c
LEFT JOIN v1 ON v1.chassi = upper(c.nro_chassi) AND c.classificacao_venda = 'Maquinas JD - Novos'
LEFT JOIN v2 ON v2.documento = {digits_only('c.nro_documento')} AND v2.data = c.data_emissao""",
    "elig": """
SELECT filial, cen, nome_cliente AS cliente, classificacao_venda, nro_documento, nro_chassi, CAST(data_emissao AS VARCHAR) AS data_emissao,
 valor_comissao_total AS valor_comissao, v1_status, v1_nf_incentivo, v1_saldo, CAST(v1_data_emissao AS VARCHAR) AS v1_data_emissao,
 v1_detalhe, v2_status, v2_cliente_cod, v2_saldo, v2_tipos_titulo, v2_detalhe,
 CASE WHEN 'NÃO APTO' IN (v1_status, v2_status) THEN '❌ NÃO APTO'
  WHEN v1_status IN ('ERRO', 'NÃO ENCONTRADO', 'ATENÇÃO') OR v2_status IN ('ERRO', 'NÃO ENCONTRADO', 'ATENÇÃO') THEN '⚠️ VERIFICAR'
  ELSE '✅ APTO' END AS status_geral, row_id FROM elig_rows""",
    "sheet_once": f"""
SELECT 'comissao_' || filial || '_15-04-1996.xlsx' AS arquivo, l_orderkey * 8 + l_linenumber AS linha, filial, c.modelo,
 upper(trim(nro_chassi)) AS nro_chassi, CASE WHEN l_orderkey % 107 = 0 THEN 'X' || nro_documento ELSE nro_documento END AS doc,
 receita_bruta, CASE WHEN l_orderkey % 101 = 0 THEN perc_comissao_fat + {d('0.5')} ELSE perc_comissao_fat END AS fat_pct,
 CASE WHEN l_orderkey % 137 = 0 THEN perc_comissao_margem + {d('0.3')} ELSE perc_comissao_margem END AS mar_pct,
 CASE WHEN l_orderkey % 127 = 0 THEN meta_margem + 5 ELSE meta_margem END AS meta,
 CASE WHEN l_orderkey % 131 = 0 THEN valor_comissao_fat * {d('1.5')} ELSE valor_comissao_fat END AS fat_val,
 CASE WHEN l_orderkey % 109 = 0 AND NOT gatilho_margem_atingido THEN {d('50')} ELSE valor_comissao_margem END AS mar_val,
 CASE WHEN l_orderkey % 113 = 0 THEN valor_comissao_total + 1 ELSE valor_comissao_total END AS tot_val,
 {points_margin('perc_margem_bruta')} AS reached, l_orderkey
FROM calc c JOIN lineitem ON concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) = row_id""",
    "sheet_rows": f"""
SELECT * REPLACE ({padded(digits_only('doc'))} AS doc, {commission_points('fat_pct')} AS fat_pct, {commission_points('mar_pct')} AS mar_pct,
 {points_margin('meta')} AS meta)
FROM (SELECT * FROM sheet_once UNION ALL SELECT * REPLACE (linha + 1000000000 AS linha) FROM sheet_once WHERE l_orderkey % 103 = 0)""",
    "sheet_keys": f"SELECT DISTINCT upper(nro_chassi) AS ch, {padded(digits_only('nro_documento'))} AS doc FROM base WHERE nro_chassi <> ''",
    "fat_sets": f"SELECT upper(trim(modelo)) AS modelo, list(DISTINCT {commission_points('percentual')}) AS fs FROM fat_now GROUP BY 1",
    "margin_sets": f"""
SELECT upper(trim(modelo)) AS modelo, list(DISTINCT {commission_points('percentual')}) AS ms,
 list(DISTINCT {points_margin('meta_margem')}) AS ts FROM margin_now GROUP BY 1""",
    "sheet_checked": """
SELECT s.*, count(*) OVER (PARTITION BY arquivo, s.nro_chassi, s.doc) AS copies, k.ch IS NOT NULL AS known,
 COALESCE(f.fs, []) AS fs, COALESCE(m.ms, []) AS ms, COALESCE(m.ts, []) AS ts, reached >= meta AS hit
FROM sheet_rows s LEFT JOIN sheet_keys k ON k.ch = s.nro_chassi AND k.doc = s.doc
LEFT JOIN fat_sets f ON f.modelo = upper(s.modelo) LEFT JOIN margin_sets m ON m.modelo = upper(s.modelo)
WHERE filial <> 'NATION_7'""",
    "row_issues": """
SELECT arquivo, linha, 'Erro' AS severidade, unnest(list_filter([
 CASE WHEN copies > 1 THEN 'Chave única' END,
 CASE WHEN NOT known THEN 'Chave na extração' END,
 CASE WHEN len(list_filter(fs, lambda e: abs(fat_pct - e) <= 0.01)) = 0 THEN '% Comissão Fat.' END,
 CASE WHEN receita_bruta <> 0 AND len(list_filter(fs, lambda e: abs(fat_val / receita_bruta * 100 - e) <= 0.01)) = 0
  THEN 'Valor Comissão Fat. / Receita Bruta' END,
 CASE WHEN len(list_filter(ms, lambda e: abs(mar_pct - e) <= 0.01)) = 0 THEN '% Comissão Margem' END,
 CASE WHEN len(list_filter(ts, lambda e: abs(meta - e) <= 0.01)) = 0 THEN 'Meta de Margem' END,
 CASE WHEN receita_bruta <> 0 AND hit THEN
   CASE WHEN len(list_filter(ms, lambda e: abs(mar_val / receita_bruta * 100 - e) <= 0.01)) = 0 THEN 'Valor Comissão Margem / Receita Bruta' END
  WHEN abs(mar_val) > 0.05 THEN 'Gatilho Comissão Margem' END,
 CASE WHEN abs(tot_val - (receita_bruta * fat_pct / 100 + CASE WHEN hit THEN receita_bruta * mar_pct / 100 ELSE 0 END)) > 0.05
  THEN 'Valor Comissão Total' END
 ], lambda v: v IS NOT NULL)) AS regra FROM sheet_checked""",
    "sentinel": f"""
SELECT arquivo, any_value(filial) AS filial, list(DISTINCT fat_pct) FILTER (upper(modelo) = 'BRAND#12') AS used,
 (SELECT fs FROM fat_sets WHERE modelo = 'BRAND#12') AS allowed FROM sheet_rows GROUP BY 1""",
    "issues": """
SELECT arquivo, linha, severidade, regra FROM row_issues
UNION ALL SELECT DISTINCT arquivo, CAST(NULL AS BIGINT), 'Erro', 'Coluna obrigatória' FROM sheet_rows WHERE filial = 'NATION_7'
UNION ALL SELECT arquivo, NULL, CASE WHEN used IS NULL THEN 'Aviso' ELSE 'Erro' END, 'Modelo BRAND#12' FROM sentinel
 WHERE filial <> 'NATION_7' AND (used IS NULL
  OR len(list_filter(used, lambda u: len(list_filter(allowed, lambda e: abs(u - e) <= 0.01)) = 0)) > 0)""",
    "marks": """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS row_id, l_orderkey % 4 = 0 AS pagar,
 l_partkey % 9 = 0 AS excluir FROM lineitem WHERE l_orderkey % 4 = 0 OR l_partkey % 9 = 0""",
    "period_rows": f"""
SELECT * REPLACE (COALESCE(valor_comissao_total, COALESCE(valor_comissao_fat, 0) + COALESCE(valor_comissao_margem, 0)) AS valor_comissao_total,
 COALESCE(receita_bruta, 0) AS receita_bruta, COALESCE(valor_comissao_fat, 0) AS valor_comissao_fat,
 COALESCE(valor_comissao_margem, 0) AS valor_comissao_margem, COALESCE(margem_rs, 0) AS margem_rs,
 COALESCE(perc_margem_direta, 0) AS perc_margem_direta, COALESCE(valor_incentivo, 0) AS valor_incentivo,
 COALESCE(margem_incentivos_rs, 0) AS margem_incentivos_rs, COALESCE(meta_margem, 0) AS meta_margem,
 COALESCE(perc_margem_bruta, 0) AS perc_margem_bruta, COALESCE(receita_bruta_incentivos_rs, 0) AS receita_bruta_incentivos_rs),
 upper(trim(COALESCE(cod_vendedor, ''))) AS cod, {fold('classificacao_venda')} AS classe
FROM ledger WHERE mes_ano_comissao = 'Abril/1996'""",
    "sellers_ok": f"""
SELECT upper(trim(cod_vendedor)) AS cod, trim(vendedor) AS cen FROM managers_now
WHERE {fold('vendedor')} <> {fold('gerente')} AND trim(vendedor) <> '' AND trim(gerente) <> ''""",
    "line_texts": """
SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS row_id,
 CASE l_orderkey % 4 WHEN 0 THEN l_extendedprice * 4 WHEN 1 THEN CAST(l_partkey AS DOUBLE)
  WHEN 2 THEN floor(l_quantity) + 0.5 END AS num, l_orderkey % 4 = 1 AS has_percent FROM lineitem""",
    "rate_upload": """
SELECT CASE WHEN p_partkey % 19 <> 0 THEN p_brand END AS modelo, p_type AS grupo,
 p_size + CASE WHEN p_partkey % 2 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS pct, p_size / 25 AS meta FROM part""",
}

_NAMES = re.compile(r"\b(" + "|".join(sorted(VIEWS, key=len, reverse=True)) + r")\b")


# Views that several others build on; they are worked out once.
_HEAVY = ("base", "managed", "history", "confronted")


def with_views(body: str) -> str:
    """The statement behind the views it uses, in the order they are defined."""
    needed: set[str] = set()
    pending = [body]
    while pending:
        for name in set(_NAMES.findall(pending.pop())) - needed:
            needed.add(name)
            pending.append(VIEWS[name])
    used = [f"{name} AS {'MATERIALIZED ' if name in _HEAVY else ''}({VIEWS[name]})" for name in VIEWS if name in needed]
    return ("WITH " + ",\n".join(used) + "\n" if used else "") + body
