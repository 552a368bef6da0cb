"""Canonical column names, display labels, upload aliases and table schemas.

Everything in this module is a fixed value: names users already have in their
sheets and tables, which results and ledgers have to reproduce exactly.
"""

from pyspark.sql import types as T

# Sale classes, row types and the status labels shown to the user.
TIPO_FATURAMENTO = "Faturamento"
TIPO_DEVOLUCAO = "Devolução"
TIPO_TOTAL = "Total"
CLASSE_IMPLEMENTO = "Implemento"
CLASSE_NOVOS = "Maquinas JD - Novos"
CLASSE_USADOS = "Maquinas JD - Usados"
CLASSES_WITH_CHASSIS_CHECK = (CLASSE_NOVOS,)

STATUS_APTO = "✅ APTO"
STATUS_NAO_APTO = "❌ NÃO APTO"
STATUS_VERIFICAR = "⚠️ VERIFICAR"

# Rule constants.
IMPLEMENT_THRESHOLD = 200000.0
IMPLEMENT_RATE_HIGH = 0.84
IMPLEMENT_RATE_LOW = 1.0
USED_RATE = 1.0
DEFAULT_FAT_RATE = 1.0
DEFAULT_MANAGER_PERCENT = 33.0
MANAGER_REPORT_SHARE = 0.33
COORDINATOR_FAT_PERCENT = 0.2
COORDINATOR_MARGIN_PERCENT = 0.2
COORDINATOR_TARGET = 15.0
BALANCE_TOLERANCE = 0.01
MONEY_TOLERANCE = 0.05
PERCENT_TOLERANCE = 0.01
DOCUMENT_WIDTH = 9
SENTINEL_MODEL = "6125J"
EXCLUDED_PRODUCT_MARK = "CVD"

MONTH_NAMES = (
    "Janeiro", "Fevereiro", "Março", "Abril", "Maio", "Junho",
    "Julho", "Agosto", "Setembro", "Outubro", "Novembro", "Dezembro",
)

# Display label of each ledger column, in ledger order.
LEDGER_LABELS = {
    "tipo": "Tipo",
    "filial": "Filial",
    "data_emissao": "Data de Emissão",
    "nro_documento": "Nro Documento",
    "modelo": "Modelo",
    "nro_chassi": "Nro Chassi",
    "nome_cliente": "Nome do Cliente",
    "cen": "CEN",
    "cod_vendedor": "Cod Vendedor",
    "gerente": "Gerente",
    "classificacao_venda": "Classificação Venda",
    "receita_bruta": "Receita Bruta",
    "perc_comissao_fat": "% Comissão Fat.",
    "valor_comissao_fat": "Valor Comissão Fat.",
    "cmv": "CMV",
    "margem_rs": "Margem R$",
    "perc_margem_direta": "% Margem Direta",
    "valor_incentivo": "Valor Incentivo",
    "receita_bruta_incentivos_rs": "Receita Bruta + Incentivos R$",
    "margem_incentivos_rs": "Margem + Incentivos R$",
    "meta_margem": "Meta de Margem",
    "perc_margem_bruta": "% Margem Bruta",
    "perc_comissao_margem": "% Comissão Margem",
    "valor_comissao_margem": "Valor Comissão Margem",
    "valor_comissao_total": "Valor Comissão Total",
    "perc_comissao_gerente": "% Comissão Gerente",
    "valor_comissao_gerente": "Valor Comissão Gerente",
}

LEDGER_DATA_COLUMNS = tuple(LEDGER_LABELS)
LEDGER_PERIOD_COLUMNS = (
    "competencia_ano", "competencia_mes", "mes_ano_comissao",
    "periodo_inicio", "periodo_fim", "fonte", "arquivo_origem",
)
LEDGER_AMOUNTS = (
    "receita_bruta", "valor_comissao_fat", "cmv", "margem_rs", "valor_incentivo",
    "receita_bruta_incentivos_rs", "margem_incentivos_rs", "valor_comissao_margem",
    "valor_comissao_total", "valor_comissao_gerente",
)
LEDGER_PERCENTS = (
    "perc_comissao_fat", "perc_margem_direta", "meta_margem",
    "perc_margem_bruta", "perc_comissao_margem", "perc_comissao_gerente",
)

# Labels of columns that exist only in results, not in the ledger.
RESULT_LABELS = {
    "veiculo_categoria": "Veículo Categoria",
    "veiculo_estado": "Veículo Estado",
    "cliente_codigo": "Cliente Código",
    "regra_fat_encontrada": "Regra Comissão Fat. Encontrada",
    "regra_margem_encontrada": "Regra Comissão Margem Encontrada",
    "regra_classificacao_aplicada": "Regra Classificação Aplicada",
    "gatilho_margem_atingido": "Gatilho Comissão Margem Atingido",
    "regra_gerente_encontrada": "Regra Gerente Encontrada",
    "padrao_fat_aplicado": "Padrão 1% Fat. Aplicado",
    "qtd_lancamentos_pagos": "Qtd Lançamentos Pagos",
    "valor_pago_historico": "Valor Pago Histórico",
    "valor_estornado_historico": "Valor Estornado Histórico",
    "saldo_comissao_paga_chassi": "Saldo Comissão Paga Chassi",
    "tem_pagamento_positivo": "Tem Pagamento Positivo",
    "tem_estorno_negativo": "Tem Estorno Negativo",
    "qtd_lancamentos_excluidos": "Qtd Lançamentos Excluídos",
    "bloqueado_exclusao": "Bloqueado por Exclusão",
    "status_confronto": "Status Confronto Pagas",
    "bloqueado_pagamento": "Bloqueado por Pagamento Histórico",
    "cliente": "Cliente",
    "valor_comissao": "Valor Comissão",
    "v1_status": "V1 - Status",
    "v1_nf_incentivo": "V1 - NF Incentivo",
    "v1_saldo": "V1 - Saldo Incentivo",
    "v1_data_emissao": "V1 - Data Emissão",
    "v1_detalhe": "V1 - Detalhe",
    "v2_status": "V2 - Status",
    "v2_cliente_cod": "V2 - Cód. Cliente",
    "v2_saldo": "V2 - Saldo Cliente",
    "v2_tipos_titulo": "V2 - Tipos Título",
    "v2_detalhe": "V2 - Detalhe",
    "status_geral": "Status Geral",
    "titulo_incentivo": "Título Incentivo",
    "titulos_incentivo": "Títulos Incentivo",
    "qtd_titulos_incentivo": "Qtd. Títulos Incentivo",
    "saldo_incentivo": "Saldo Incentivo",
    "status_incentivo": "Status Incentivo",
    "detalhe_incentivo": "Detalhe Incentivo",
}
LABELS = {**LEDGER_LABELS, **RESULT_LABELS}

# Columns shown as money and as percent (25 and 7).
CURRENCY_COLUMNS = (
    "receita_bruta", "valor_comissao_fat", "cmv", "margem_rs", "valor_incentivo",
    "receita_bruta_incentivos_rs", "margem_incentivos_rs", "valor_comissao_margem",
    "valor_comissao_total", "valor_comissao", "v1_saldo", "v2_saldo", "saldo_incentivo",
    "valor_pago_historico", "valor_estornado_historico", "saldo_comissao_paga_chassi",
    "comissao_faturamento", "venda_direta", "comissao_usados", "comissao_implementos",
    "comissao_invasao_area", "comissao_margem", "comissao_total_cen",
    "comissao_gerente", "valor_total_comissao",
)
PERCENT_COLUMNS = (
    "perc_comissao_fat", "perc_margem_direta", "meta_margem", "perc_margem_bruta",
    "perc_comissao_margem", "meta_margem_coordenador", "perc_mb_realizado",
)

HISTORY_COLUMNS = (
    "tipo", "filial", "data_emissao", "nro_documento", "modelo", "nro_chassi",
    "valor_comissao_total", "qtd_lancamentos_pagos", "valor_pago_historico",
    "valor_estornado_historico", "saldo_comissao_paga_chassi",
    "qtd_lancamentos_excluidos", "bloqueado_exclusao", "status_confronto",
    "bloqueado_pagamento",
)
VALIDATION_COLUMNS = (
    "status_geral", "filial", "cen", "nome_cliente", "classificacao_venda",
    "nro_documento", "nro_chassi", "data_emissao", "valor_comissao",
    "v1_status", "v1_nf_incentivo", "v1_saldo", "v1_data_emissao", "v1_detalhe",
    "v2_status", "v2_cliente_cod", "v2_saldo", "v2_tipos_titulo", "v2_detalhe",
)
ANALYTIC_COLUMNS = (
    "filial", "nro_documento", "nro_chassi", "nome_cliente", "cen",
    "classificacao_venda", "receita_bruta", "valor_comissao_fat", "margem_rs",
    "perc_margem_direta", "valor_incentivo", "margem_incentivos_rs", "meta_margem",
    "perc_margem_bruta", "valor_comissao_margem", "valor_comissao_total",
)

# Upload headers accepted for a logical column, first match wins.
MODEL_ALIASES = ("Modelo", "modelo", "MODELO")
GROUP_ALIASES = ("Grupo", "grupo", "GRUPO")
FAT_PERCENT_ALIASES = (
    "Percentual", "percentual", "PERCENTUAL",
    "% Comissão Fat.", "% Comissão Fat", "% Comissao Fat.", "% Comissao Fat",
    "% Comissão NF", "% Comissao NF", "percentual_comissao_fat",
)
MARGIN_PERCENT_ALIASES = (
    "Percentual", "percentual", "PERCENTUAL",
    "% Comissão Margem", "% Comissão Margem.", "% Comissao Margem",
    "% Comissao Margem.", "percentual_comissao_margem",
)
# The calculation and the audit prefer other headers where a table has several (fixed values).
CALC_PERCENT_ALIASES = (
    "percentual", "Percentual",
    "% Comissão Fat.", "% Comissão Fat", "% Comissao Fat.", "% Comissao Fat",
    "% Comissão Margem", "% Comissão Margem.", "% Comissao Margem", "% Comissao Margem.",
)
AUDIT_FAT_PERCENT_ALIASES = (
    "Percentual", "% Comissão Fat.", "% Comissão Fat", "% Comissao Fat.", "% Comissao Fat",
    "% Comissão NF", "% Comissao NF", "percentual", "percentual_comissao_fat",
)
AUDIT_MARGIN_PERCENT_ALIASES = (
    "Percentual", "% Comissão Margem", "% Comissão Margem.", "% Comissao Margem",
    "% Comissao Margem.", "percentual", "percentual_comissao_margem",
)
TARGET_ALIASES = (
    "Meta", "meta", "Meta de Margem", "Meta Margem", "meta_margem",
    "% Meta de Margem", "% Meta Margem", "Meta de Margem %", "Meta Margem %",
)
SELLER_CODE_ALIASES = (
    "Cod Vendedor", "cod_vendedor", "CodVendedor", "Código Vendedor",
    "CÃ³digo Vendedor", "Codigo Vendedor",
)
MANAGER_ALIASES = ("Gerente", "gerente")
MANAGER_PERCENT_ALIASES = (
    "% Comissão Gerente", "% ComissÃ£o Gerente", "% Comissao Gerente",
    "Percentual Comissão Gerente", "Percentual ComissÃ£o Gerente",
    "Percentual Comissao Gerente", "percentual_comissao_gerente",
)
MANAGER_OPTIONAL_ALIASES = {
    "filial": ("Filial", "filial"),
    "cod_x": ("Cod X", "cod_x", "CodX"),
    "vendedor": ("Vendedor", "vendedor"),
    "data_nascimento": ("Data de Nascimento", "data_nascimento", "Nascimento"),
    "cpf": ("CPF", "cpf"),
    "email": ("E-mail", "Email", "email"),
    "contato": ("Contato", "contato"),
}

# Legacy sheet headers and the label they stand for.
REPORT_HEADER_ALIASES = {
    "Cliente": "Nome do Cliente",
    "% Comissão NF": "% Comissão Fat.",
    "% Comissao NF": "% Comissão Fat.",
    "Valor Comissão NF": "Valor Comissão Fat.",
    "Valor Comissao NF": "Valor Comissão Fat.",
    "Meta Margem": "Meta de Margem",
}
AUDIT_REQUIRED = (
    "modelo", "nro_chassi", "nro_documento", "receita_bruta", "perc_comissao_fat",
    "valor_comissao_fat", "meta_margem", "perc_margem_bruta", "perc_comissao_margem",
    "valor_comissao_margem", "valor_comissao_total",
)

# Source relations: original header of every column the operators read.
SOURCE_COLUMNS = {
    "billing": {
        "Centro de Custo": "centro_custo",
        "Data de Emissão": "data_emissao",
        "Nota Fiscal Número": "nota_fiscal_numero",
        "Chassi": "chassi",
        "Cliente Código": "cliente_codigo",
        "Vendedor Código": "vendedor_codigo",
        "Produto Código": "produto_codigo",
        "Valor Total": "valor_total",
        "Valor Venda Líquida": "valor_venda_liquida",
        "Valor Custo": "valor_custo",
        "Valor Impostos": "valor_impostos",
    },
    "returns": {
        "Centro de Custo": "centro_custo",
        "Data de Emissão": "data_emissao",
        "Nota Fiscal Número": "nota_fiscal_numero",
        "Chassi": "chassi",
        "Cliente Código": "cliente_codigo",
        "Vendedor Código": "vendedor_codigo",
        "Produto Código": "produto_codigo",
        "Valor Total": "valor_total",
        "Valor Custo": "valor_custo",
        "Valor Impostos": "valor_impostos",
    },
    "incentives": {
        "Chassi": "chassi",
        "Nota Fiscal Número": "nota_fiscal_numero",
        "Valor Incentivo": "valor_incentivo",
    },
    "receivables": {
        "Título Número": "titulo_numero",
        "Cliente Código": "cliente_codigo",
        "Tipo Título": "tipo_titulo",
        "Valor Saldo": "valor_saldo",
        "Data de Emissão": "data_emissao",
    },
    "invoices": {
        "Nota Fiscal Número": "nota_fiscal_numero",
        "Data de Emissão": "data_emissao",
        "Cliente Código": "cliente_codigo",
    },
    "vehicles": {
        "Chassi": "chassi",
        "Veículo Modelo": "veiculo_modelo",
        "Veículo Categoria": "veiculo_categoria",
        "Veículo Estado": "veiculo_estado",
    },
    "sellers": {"Vendedor Código": "vendedor_codigo", "Vendedor Nome": "vendedor_nome"},
    "customers": {"Cliente Código": "cliente_codigo", "Cliente Nome": "cliente_nome"},
    "cost_centers": {
        "Código C.Custo": "centro_custo",
        "Descrição C.Custo": "descricao_custo",
        "Lojas": "lojas",
    },
}


def _ledger_schema() -> T.StructType:
    money, percent = T.DecimalType(18, 2), T.DecimalType(12, 6)
    fields = [
        T.StructField("mes_ano_comissao", T.StringType()),
        T.StructField("periodo_inicio", T.DateType()),
        T.StructField("periodo_fim", T.DateType()),
        T.StructField("fonte", T.StringType()),
        T.StructField("arquivo_origem", T.StringType()),
    ]
    for name in LEDGER_DATA_COLUMNS:
        if name in LEDGER_AMOUNTS:
            kind = money
        elif name in LEDGER_PERCENTS:
            kind = percent
        else:
            kind = T.DateType() if name == "data_emissao" else T.StringType()
        fields.append(T.StructField(name, kind))
    fields += [
        T.StructField("paid_at", T.TimestampType()),
        T.StructField("competencia_ano", T.IntegerType()),
        T.StructField("competencia_mes", T.IntegerType()),
    ]
    return T.StructType(fields)


LEDGER_SCHEMA = _ledger_schema()
LEDGER_PARTITIONS = ("competencia_ano", "competencia_mes")

RATE_COLUMNS = {"grupo": "string", "modelo": "string", "percentual": "decimal(12,6)", "ativo": "boolean"}
MARGIN_RATE_COLUMNS = {
    "grupo": "string", "modelo": "string", "percentual": "decimal(12,6)",
    "meta_margem": "decimal(12,6)", "ativo": "boolean",
}
MANAGER_COLUMNS = {
    "filial": "string", "gerente": "string", "cod_vendedor": "string", "cod_x": "string",
    "vendedor": "string", "data_nascimento": "string", "cpf": "string", "email": "string",
    "contato": "string", "percentual_comissao_gerente": "decimal(12,6)", "ativo": "boolean",
}
