"""Scans of the source relations."""

from pyspark.sql import DataFrame, SparkSession

from payouts import schemas as S
from payouts.functions import parse_date_br
from payouts.operators.shape import is_text, resolve_column
from pyspark.sql import functions as F

__all__ = ["jdbc_source", "normalize_source", "scan_source"]


def normalize_source(raw: DataFrame, relation: str) -> DataFrame:
    """Original headers to canonical names, unused columns dropped, dates parsed once at ingest.

    With DATE columns the period filter reaches the file statistics.
    """
    names = {}
    for header, name in S.SOURCE_COLUMNS[relation].items():
        names[resolve_column(raw, [header, name])] = name
    source = raw.select(*[F.col("`" + h + "`").alias(n) for h, n in names.items()])
    if "data_emissao" in source.columns and is_text(source, "data_emissao"):
        source = source.withColumn("data_emissao", parse_date_br(F.col("data_emissao")))
    return source


def scan_source(spark: SparkSession, path: str, relation: str, fmt: str = "parquet") -> DataFrame:
    """A source relation kept as files or as a catalog table (``fmt='table'``)."""
    raw = spark.table(path) if fmt == "table" else spark.read.format(fmt).load(path)
    return normalize_source(raw, relation)


def jdbc_source(
    spark: SparkSession,
    url: str,
    table: str,
    relation: str,
    split_column: str,
    bounds: tuple[str, str],
    partitions: int = 64,
    **options: str,
) -> DataFrame:
    """A source relation in a database, read in parallel ranges of ``split_column``."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize="10000", **options).options(
        partitionColumn=split_column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=str(partitions)
    )
    return normalize_source(reader.load(), relation)
