"""The domain relations as views over a star schema of orders, line items and parts.

Line items become invoices and returns, parts become machines. Conditions on key remainders
plant the cases the rules tell apart (missing titles, returns, blank keys and the like).
"""

from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from payouts import schemas as S
from payouts.functions import commission_period, format_currency_br, period_of_date
from payouts.operators.extract import MachineSources

__all__ = ["Star", "kept"]


def kept(method: Callable) -> Callable:
    """Each result of a method is made once for its object, and goes with it."""

    @wraps(method)
    def once(self, *args, **named):
        results = self.__dict__.setdefault("_kept", {})
        key = (method.__name__, args, tuple(sorted(named.items())))
        if key not in results:
            results[key] = method(self, *args, **named)
        return results[key]

    return once


class Star:
    """Lazy domain relations over the tables in one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    @kept
    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # Keys ---------------------------------------------------------------------------

    @staticmethod
    def row_id() -> Column:
        """Stable id of a line item: order, line, then what sets apart lines of one number."""
        cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
        return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents)

    @staticmethod
    def _note(key: str) -> Column:
        text = F.col(key).cast("string")
        return F.when(F.col(key) % 2 == 0, F.lpad(text, 9, "0")).otherwise(text)

    @staticmethod
    def _brand_number() -> Column:
        return F.substring_index("p_brand", "#", -1).cast("int")

    @staticmethod
    def _manager(name: str) -> Column:
        return F.concat(F.lit("Gestão "), F.col(name))

    # Sources ------------------------------------------------------------------------

    @kept
    def lines(self) -> DataFrame:
        """Line items with order, part and supplier attributes and a stable row id."""
        orders = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
        parts = self.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type", "p_size")
        suppliers = self.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey", "s_name")
        gross = F.col("l_extendedprice") * 4.0
        chassis = (
            F.when(F.col("l_partkey") % 97 == 0, "")
            .when(F.col("l_linenumber") == 3, F.concat(F.lit(" ch"), F.col("l_partkey")))
            .otherwise(F.concat(F.lit("CH"), F.col("l_partkey")))
        )
        # By order last, so that the lines of an order leave side by side and what they share is packed once.
        return (
            self.table("lineitem")
            .join(parts, "l_partkey")
            .join(orders, "l_orderkey")
            .join(suppliers, "l_suppkey")
            .withColumns({"row_id": self.row_id(), "gross": gross, "chassi": chassis, "ship": F.col("l_shipdate").cast("date")})
        )

    def _invoice_columns(self, typed: bool) -> list[Column]:
        part = F.col("l_partkey")
        cost = F.col("gross") * ((part % 30) / 100 + 0.7)
        sign = F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), -F.col("gross"))
        product = F.when(F.col("p_size") == 50, "XCVD1").when(
            F.col("p_size") != 49, F.concat(F.lit("P"), part)
        )
        return [
            F.col("s_nationkey").cast("string").alias("centro_custo"),
            (F.col("ship") if typed else F.date_format("ship", "dd/MM/yyyy")).alias("data_emissao"),
            self._note("l_orderkey").alias("nota_fiscal_numero"),
            "chassi",
            F.concat(F.lit("C"), F.col("o_custkey")).alias("cliente_codigo"),
            F.concat(F.lit("S"), F.col("l_suppkey")).alias("vendedor_codigo"),
            product.alias("produto_codigo"),
            F.coalesce(sign, F.col("gross")).alias("valor_total"),
            cost.alias("valor_custo"),
            (F.col("gross") * F.col("l_tax")).alias("valor_impostos"),
            "row_id",
        ]

    @kept
    def billing(self, typed: bool = True) -> DataFrame:
        """Invoices; ``typed`` gives issue dates as an ingested table has them, else as source text."""
        net = F.when(F.col("l_linenumber") == 7, 0.0).otherwise(F.col("gross") * (F.lit(1.0) - F.col("l_discount")))
        return self.lines().where("l_returnflag <> 'R'").select(*self._invoice_columns(typed), net.alias("valor_venda_liquida"))

    @kept
    def returns(self, typed: bool = True) -> DataFrame:
        return self.lines().where("l_returnflag = 'R'").select(*self._invoice_columns(typed))

    @kept
    def incentives(self) -> DataFrame:
        part = self.table("part")
        key = F.col("p_partkey")
        main = part.where(key % 3 != 0).select(
            F.concat(F.lit("CH"), key).alias("chassi"), F.concat(F.lit("I"), key).alias("nota_fiscal_numero"),
            (F.col("p_retailprice") * 0.05).alias("valor_incentivo"),
        )
        second = part.where(key % 15 == 1).select(
            F.concat(F.lit("CH"), key).alias("chassi"), F.concat(F.lit("J"), key).alias("nota_fiscal_numero"),
            F.lit(1.0).alias("valor_incentivo"),
        )
        return main.unionByName(second)

    @kept
    def receivables(self) -> DataFrame:
        orders = self.table("orders").where(F.col("o_orderkey") % 11 != 0)
        digit = F.substring("o_orderpriority", 1, 1)
        kind = F.when(digit.isin("1", "2"), "BL").when(digit == "3", "DP").when(digit == "4", "NF").otherwise("")
        owed = F.when(F.col("o_orderstatus") == "F", 0.0).otherwise(F.col("o_totalprice"))
        customer = F.concat(F.lit("C"), F.col("o_custkey"))
        issued = F.date_format("o_orderdate", "dd/MM/yyyy")
        key = F.col("p_partkey")

        def shape(df: DataFrame, title: Column, who: Column, tipo: Column, value: Column, day: Column) -> DataFrame:
            return df.select(
                title.alias("titulo_numero"), who.alias("cliente_codigo"), tipo.alias("tipo_titulo"),
                value.alias("valor_saldo"), day.alias("data_emissao"),
            )

        first = shape(orders, self._note("o_orderkey"), customer, kind, owed, issued)
        offset = F.when(F.col("o_orderkey") % 3 == 0, -F.col("o_totalprice")).otherwise(0.0)
        second = shape(
            orders.where("o_orderstatus = 'P'"), self._note("o_orderkey"), customer, F.lit("DP"), offset, issued
        )
        factory = shape(
            self.table("part").where(key % 4 != 1), F.concat(F.lit("I"), key), F.lit("FAB"), F.lit("IN"),
            F.when(key % 2 == 0, 0.0).otherwise(F.col("p_retailprice") * 0.05), F.lit("01/02/1996"),
        )
        return first.unionByName(second).unionByName(factory)

    @kept
    def invoices(self) -> DataFrame:
        last = self.table("lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").cast("date").alias("ship"))
        orders = self.table("orders").where(F.col("o_orderkey") % 13 != 0)
        return orders.join(last, F.col("o_orderkey") == F.col("l_orderkey")).select(
            self._note("o_orderkey").alias("nota_fiscal_numero"),
            F.date_format("ship", "dd/MM/yyyy").alias("data_emissao"),
            F.concat(F.lit("C"), F.col("o_custkey")).alias("cliente_codigo"),
        )

    @kept
    def vehicles(self) -> DataFrame:
        size = F.col("p_size") % 3
        return self.table("part").select(
            F.concat(F.lit("CH"), F.col("p_partkey")).alias("chassi"),
            F.col("p_brand").alias("veiculo_modelo"),
            F.when(F.col("p_type") == "SMALL", "IP").otherwise("MQ").alias("veiculo_categoria"),
            F.when(size == 0, "NOVO").when(size == 1, "USADO").alias("veiculo_estado"),
        )

    def sellers(self) -> DataFrame:
        return self.table("supplier").select(
            F.concat(F.lit("S"), F.col("s_suppkey")).alias("vendedor_codigo"), F.col("s_name").alias("vendedor_nome")
        )

    def customers(self) -> DataFrame:
        return self.table("customer").select(
            F.concat(F.lit("C"), F.col("c_custkey")).alias("cliente_codigo"), F.col("c_name").alias("cliente_nome")
        )

    def cost_centers(self) -> DataFrame:
        return self.table("nation").select(
            F.col("n_nationkey").alias("centro_custo"), F.col("n_name").alias("descricao_custo"),
            F.col("n_name").alias("lojas"),
        )

    def machine_sources(self) -> MachineSources:
        return MachineSources(
            billing=self.billing(), returns=self.returns(), incentives=self.incentives(), vehicles=self.vehicles(),
            sellers=self.sellers(), customers=self.customers(), cost_centers=self.cost_centers(),
        )

    # Rules --------------------------------------------------------------------------

    @staticmethod
    def _rule(df: DataFrame, percent: Column, active: bool, day: str, **extra: Column) -> DataFrame:
        number = F.col("n")
        return df.select(
            F.concat(F.lit("G"), (number % 3).cast("string")).alias("grupo"), F.col("p_brand").alias("modelo"),
            percent.alias("percentual"), F.lit(active).alias("ativo"), F.lit(day).cast("timestamp").alias("updated_at"),
            number.cast("bigint").alias("id"), *[c.alias(n) for n, c in extra.items()],
        )

    def _brands(self) -> DataFrame:
        return self.table("part").select("p_brand").distinct().withColumn("n", self._brand_number())

    @kept
    def fat_rates(self) -> DataFrame:
        """Billing rates with older versions of even models and a newer inactive row."""
        n = F.col("n")
        brands = self._brands().where("n not in (24, 25)")
        current = F.when(n % 5 == 0, 45.0).otherwise(n * 0.1)
        return reduce(DataFrame.unionByName, [
            self._rule(brands, current, True, "2024-06-01"),
            self._rule(brands.where(n % 2 == 0), F.lit(0.9), True, "2023-01-01"),
            self._rule(brands.where(n == 3), F.lit(0.7), False, "2025-01-01"),
        ])

    @kept
    def margin_rates(self) -> DataFrame:
        n = F.col("n")
        brands = self._brands().where("n <> 25")
        percent = F.when(n % 6 == 0, 0.0).otherwise(0.2)
        target = F.when(n % 2 == 0, 0.15).otherwise(12.0)
        return reduce(DataFrame.unionByName, [
            self._rule(brands, percent, True, "2024-06-01", meta_margem=target),
            self._rule(brands.where(n % 4 == 0), F.lit(0.5), True, "2023-01-01", meta_margem=F.lit(20.0)),
        ])

    @kept
    def manager_relations(self) -> DataFrame:
        key = F.col("s_suppkey")
        suppliers = self.table("supplier").where(key % 10 != 0).join(
            self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")
        )
        own = F.concat(F.lit("GESTAO "), F.upper("n_name"))

        def shape(df: DataFrame, manager: Column, day: str) -> DataFrame:
            return df.select(
                F.col("n_name").alias("filial"), manager.alias("gerente"),
                F.concat(F.lit("S"), key).alias("cod_vendedor"), F.concat(F.lit("X"), key).alias("cod_x"),
                F.when(key % 17 == 0, own).otherwise(F.col("s_name")).alias("vendedor"),
                F.when(key % 2 == 1, 0.33).otherwise(33.0).alias("percentual_comissao_gerente"),
                F.lit(True).alias("ativo"), F.lit(day).cast("timestamp").alias("updated_at"), key.alias("id"),
            )

        return shape(suppliers, self._manager("n_name"), "2024-06-01").unionByName(
            shape(suppliers.where(key % 7 == 0), F.lit("Gestão antiga"), "2023-01-01")
        )

    # Ledgers ------------------------------------------------------------------------

    @kept
    def paid_ledger(self) -> DataFrame:
        """Payments of closed lines, reversals, and special entries per part."""
        part, line = F.col("l_partkey"), F.col("l_linenumber")
        nations = self.table("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
        customers = self.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
        closed = self.lines().where((F.col("l_linestatus") == "F") & (part % 4 != 0))
        rows = closed.join(nations, "s_nationkey").join(customers, "o_custkey")
        size = F.col("p_size") % 3
        sale_class = (
            F.when(F.col("p_type") == "SMALL", "Implemento")
            .when(size == 0, "Maquinas JD - Novos")
            .when(size == 1, "Maquinas JD - Usados")
            .when(F.col("p_type") == "LARGE", "Venda Direta")
            .when(F.col("p_type") == "MEDIUM", "Invasão de área")
        )
        seller = F.when(F.col("l_orderkey") % 53 != 0, F.when(
            line == 2, F.concat(F.lit(" s"), F.col("l_suppkey"))).otherwise(F.concat(F.lit("S"), F.col("l_suppkey"))))
        manager = F.when(line == 4, F.concat(F.lit("GESTAO "), F.upper("n_name"))).otherwise(self._manager("n_name"))
        gross, margin = F.col("gross"), F.col("gross") * F.col("l_discount")
        incentive = F.when(part % 3 != 0, 5.0).otherwise(0.0)
        reached = F.col("l_discount") * 100.0 + 8.0
        fat = F.floor(gross) / 100.0
        paid_margin = F.when(reached >= 12.0, F.floor(gross * 0.2) / 100.0).otherwise(0.0)
        rows = rows.withColumns({"fat": fat, "mar": paid_margin, "sign": F.lit(1.0)})
        both = rows.unionByName(rows.where(part % 8 == 1).withColumn("sign", F.lit(-1.0)))
        signed_fat, signed_margin = F.col("sign") * F.col("fat"), F.col("sign") * F.col("mar")
        total = F.when(line != 6, signed_fat + signed_margin)
        entries = both.select(
            period_of_date(F.col("ship")).alias("_base"),
            F.when(F.col("l_returnflag") == "R", S.TIPO_DEVOLUCAO).otherwise(S.TIPO_FATURAMENTO).alias("tipo"),
            F.col("n_name").alias("filial"), F.col("ship").alias("data_emissao"),
            self._note("l_orderkey").alias("nro_documento"), F.col("p_brand").alias("modelo"),
            F.col("chassi").alias("nro_chassi"), F.col("c_name").alias("nome_cliente"), F.col("s_name").alias("cen"),
            seller.alias("cod_vendedor"), manager.alias("gerente"), sale_class.alias("classificacao_venda"),
            gross.alias("receita_bruta"), F.lit(1.0).alias("perc_comissao_fat"),
            signed_fat.alias("valor_comissao_fat"), (gross * 0.7).alias("cmv"), margin.alias("margem_rs"),
            (F.col("l_discount") * 100.0).alias("perc_margem_direta"), incentive.alias("valor_incentivo"),
            (gross + incentive).alias("receita_bruta_incentivos_rs"), (margin + incentive).alias("margem_incentivos_rs"),
            F.lit(12.0).alias("meta_margem"), reached.alias("perc_margem_bruta"),
            F.lit(0.2).alias("perc_comissao_margem"), signed_margin.alias("valor_comissao_margem"),
            total.alias("valor_comissao_total"),
        )
        key = F.col("p_partkey") % 20
        value = F.when(key.isin(4, 7), -10.0).when(key == 5, -99999.0).when(key == 8, 0.0)
        special = self.table("part").where(value.isNotNull()).select(
            F.lit("1996-03-01").cast("date").alias("_base"), F.lit(S.TIPO_FATURAMENTO).alias("tipo"),
            F.concat(F.lit("CH"), F.col("p_partkey")).alias("nro_chassi"), value.alias("valor_comissao_total"),
        )
        ledger = entries.unionByName(special, allowMissingColumns=True).withColumn("_p", commission_period(F.col("_base")))
        return ledger.select(
            F.col("_p.base_year").alias("competencia_ano"), F.col("_p.base_month").alias("competencia_mes"),
            F.col("_p.label").alias("mes_ano_comissao"), F.col("_p.start_date").alias("periodo_inicio"),
            F.col("_p.end_date").alias("periodo_fim"), F.lit("carga").alias("fonte"),
            F.lit(None).cast("string").alias("arquivo_origem"),
            *[c for c in entries.columns if c != "_base"],
            F.col("_p.end_date").cast("timestamp").alias("paid_at"),
        )

    @kept
    def excluded_ledger(self) -> DataFrame:
        return self.table("part").where("p_partkey % 41 = 0").select(
            F.concat(F.lit("ch"), F.col("p_partkey"), F.lit(" ")).alias("nro_chassi"),
            F.lit("2024-05-01").cast("timestamp").alias("paid_at"),
        )

    # Sheets and selections ----------------------------------------------------------

    def audit_sheets(self, calculated: DataFrame) -> DataFrame:
        """Calculated rows as sheets, one file per branch, with planted faults.

        Gross revenue is Brazilian text, the rest numbers; one file lacks a header.
        """
        order = F.split_part("row_id", F.lit("-"), F.lit(1)).cast("bigint")
        line = F.split_part("row_id", F.lit("-"), F.lit(2)).cast("bigint")

        def fault(k: int) -> Column:
            return F.col("_o") % k == 0

        marked = calculated.withColumns({"_o": order, "linha": order * 8 + line})
        changed = marked.withColumns(
            {
                "perc_comissao_fat": F.when(fault(101), F.col("perc_comissao_fat") + 0.5).otherwise(F.col("perc_comissao_fat")),
                "perc_comissao_margem": F.when(fault(137), F.col("perc_comissao_margem") + 0.3).otherwise(
                    F.col("perc_comissao_margem")),
                "meta_margem": F.when(fault(127), F.col("meta_margem") + 5.0).otherwise(F.col("meta_margem")),
                "nro_documento": F.when(fault(107), F.concat(F.lit("X"), F.col("nro_documento"))).otherwise(
                    F.col("nro_documento")),
                "valor_comissao_fat": F.when(fault(131), F.col("valor_comissao_fat") * 1.5).otherwise(
                    F.col("valor_comissao_fat")),
                "valor_comissao_margem": F.when(fault(109) & ~F.col("gatilho_margem_atingido"), 50.0).otherwise(
                    F.col("valor_comissao_margem")),
                "valor_comissao_total": F.when(fault(113), F.col("valor_comissao_total") + 1.0).otherwise(
                    F.col("valor_comissao_total")),
            }
        )
        twice = F.when(fault(103), F.array(F.lit(0), F.lit(1_000_000_000))).otherwise(F.array(F.lit(0)))
        copies = changed.withColumn("_again", F.explode(twice)).withColumn("linha", F.col("linha") + F.col("_again"))
        headers = [S.LABELS[c] for c in S.AUDIT_REQUIRED]
        full = F.array(*[F.lit(h) for h in ["Filial", *headers]])
        short = F.array(*[F.lit(h) for h in ["Filial", *headers] if h != "Meta de Margem"])
        return copies.select(
            F.concat(F.lit("comissao_"), F.col("filial"), F.lit("_15-04-1996.xlsx")).alias("arquivo"), "linha",
            F.when(F.col("filial") == "NATION_7", short).otherwise(full).alias("colunas"),
            "filial", "modelo", "nro_chassi", "nro_documento",
            format_currency_br(F.col("receita_bruta")).alias("receita_bruta"),
            *[c for c in S.AUDIT_REQUIRED if c not in ("modelo", "nro_chassi", "nro_documento", "receita_bruta")],
        )

    @kept
    def selection(self) -> DataFrame:
        """Marks on line items: paid and excluded rows, some marked both ways."""
        pay, drop = F.col("l_orderkey") % 4 == 0, F.col("l_partkey") % 9 == 0
        return self.table("lineitem").where(pay | drop).select(
            self.row_id().alias("row_id"), pay.alias("pagar"), drop.alias("excluir"))
