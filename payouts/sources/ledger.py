"""Paid and excluded ledgers, versioned rule tables, report export.

Ledgers are parquet partitioned by competence. Rule tables are append-only logs: every
write adds a batch with its operation, and readers derive the rows in force.
"""

import hashlib
import json
import uuid
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from payouts import schemas as S
from payouts.functions import parse_br_number, parse_date_br, parse_margin_points, parse_percent_points
from payouts.operators.shape import is_text, period_rows, quoted
from payouts.sources.stage import shuffles_cleared
from payouts.sources.workbooks import write_workbooks

__all__ = [
    "append_excluded_ledger", "append_paid_ledger", "append_rules", "commit_posting", "create_ledger_table", "manifest", "post",
    "posting_digest", "stage_posting",
    "create_rule_table", "evolve_table", "export_report", "ledger_by_competence",
    "ledger_by_label", "ledger_period_labels", "period_columns", "prepare_ledger_rows",
    "read_ledger", "refresh_state", "rules_in_force", "rules_with_state", "write_incentive_titles",
]


def period_columns(
    year: int, month: int, label: str, start: date | None = None, end: date | None = None,
    source: str = "manual", file_name: str | None = None,
) -> dict[str, Column]:
    """The seven period and origin columns of one posting."""
    return {
        "competencia_ano": F.lit(year).cast("int"),
        "competencia_mes": F.lit(month).cast("int"),
        "mes_ano_comissao": F.lit(label),
        "periodo_inicio": F.lit(start).cast("date"),
        "periodo_fim": F.lit(end).cast("date"),
        "fonte": F.lit(source),
        "arquivo_origem": F.lit(file_name).cast("string"),
    }


def _to_canonical(rows: DataFrame) -> DataFrame:
    """Labels to ledger names; manager columns may hide behind broken accents."""
    by_label = {label: name for name, label in S.LEDGER_LABELS.items()}
    out = rows.withColumnsRenamed({c: by_label[c] for c in rows.columns if c in by_label})
    for name, marks in (("perc_comissao_gerente", "%"), ("valor_comissao_gerente", "valor")):
        if name not in out.columns:
            close = [c for c in out.columns if marks in c.lower() and "gerente" in c.lower()]
            if close:
                out = out.withColumn(name, quoted(close[0]))
    return out


def prepare_ledger_rows(rows: DataFrame, period: dict[str, Column], percent_mode: str = "excel") -> DataFrame:
    """Any labelled or canonical rows in the shape of the ledger.

    ``percent_mode='excel'`` scales numeric percents within one by hundred, as sheets keep
    them, so a computed 0.84 is stored as 84; ``'points'`` stores percents as they are.
    ``period`` gives the seven period columns, constants or per-row expressions.
    """
    source = _to_canonical(rows)

    def column(name: str) -> Column:
        if name not in source.columns:
            return F.lit(None).cast(S.LEDGER_SCHEMA[name].dataType)
        c, text = F.col(name), is_text(source, name)
        if name == "data_emissao":
            return parse_date_br(c, isinstance(source.schema[name].dataType, T.StringType))
        if name in S.LEDGER_AMOUNTS:
            return parse_br_number(c, text)
        if name in S.LEDGER_PERCENTS:
            if percent_mode == "points" and text is False:
                return F.coalesce(c.try_cast("double"), F.lit(0.0))
            parser = parse_margin_points if name == "meta_margem" else parse_percent_points
            return parser(c, text)
        return c.cast("string")

    defaulted = {name: F.lit(0.0) for name in S.LEDGER_PERCENTS if name not in source.columns}
    return source.select(
        *[period[name].alias(name) for name in S.LEDGER_PERIOD_COLUMNS],
        *[defaulted.get(name, column(name)).alias(name) for name in S.LEDGER_DATA_COLUMNS],
    )


def _as_ledger(prepared: DataFrame) -> DataFrame:
    stamped = prepared.withColumn("paid_at", F.current_timestamp())
    return stamped.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.LEDGER_SCHEMA])


# Postings ------------------------------------------------------------------------------
#
# A ledger folder holds `postings/posting=<id>.<attempt>/competencia_ano=../competencia_mes=../part-*` and
# `_manifest/<seq>.json`. A posting's rows are written aside under a fresh attempt; it lands when its manifest entry
# is created, one small file made with create-if-absent, which is atomic on Hadoop file systems. Readers take only the
# attempts that the manifest names, so a write broken off before the entry shows nothing, and one broken off after it
# shows all its rows. A posting whose id is already in the manifest is not written again.

MANIFEST, POSTINGS = "_manifest", "postings"
_PART, _INSIDE = "_part", "_inside"


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def manifest(spark: SparkSession, path: str) -> list[dict]:
    """The landed postings of a ledger folder in the order they landed: id, attempt, rows, parts, first row id."""
    fs, folder = _hadoop(spark, f"{path}/{MANIFEST}")
    if not fs.exists(folder):
        return []
    entries = []
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.endswith(".json") and not name.startswith("."):
            stream = fs.open(status.getPath())
            try:
                text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            entries.append(json.loads(text))
    entries.sort(key=lambda e: e["seq"])
    first = 0
    for entry in entries:
        entry["first_id"] = first
        first += entry["rows"]
    return entries


def posting_digest(prepared: DataFrame) -> str:
    """An id from the rows themselves (their count and an order-free sum of row hashes), so a posting run again is
    known; give an explicit id to post equal rows twice on purpose."""
    return _digest(prepared.agg(*_fingerprint(prepared)).first().asDict())


def _fingerprint(prepared: DataFrame) -> list[Column]:
    row = F.xxhash64(*[F.col(c).cast("string") for c in sorted(prepared.columns)])
    return [F.count(F.lit(1)).alias("n"), F.sum(row.cast("decimal(38,0)")).alias("s")]


def _digest(seen: dict) -> str:
    return hashlib.sha256(f"{seen['n']}:{seen['s']}".encode()).hexdigest()[:32]


def stage_posting(prepared: DataFrame, path: str, posting_id: str | None = None) -> dict:
    """Writes the rows aside under a fresh attempt; nobody reads them before `commit_posting`.

    The rows are made once and written by the tasks that make them: without an id the digest of the rows is observed
    on the way, and nothing is exchanged for the write. Each row keeps the task that wrote it and its number there;
    the counts per task, gathered from the written files (one row a task), give dense row ids later without a task
    that numbers all rows.
    """
    spark = prepared.sparkSession
    attempt = uuid.uuid4().hex[:12]
    name = f"{posting_id or 'rows'}.{attempt}"
    folder = f"{path}/{POSTINGS}/posting={name}"
    seen = Observation(f"posting_{attempt}")
    rows = _as_ledger(prepared.observe(seen, *_fingerprint(prepared)))
    rows = rows.withColumns({_PART: F.spark_partition_id(), _INSIDE: F.monotonically_increasing_id()})
    with shuffles_cleared(spark):
        rows.write.partitionBy(*S.LEDGER_PARTITIONS).parquet(folder)
        written = int(seen.get["n"])
        parts = [] if not written else [
            [r[_PART], r["n"]] for r in spark.read.parquet(folder).groupBy(_PART).agg(F.count(F.lit(1)).alias("n")).orderBy(_PART).collect()]
    return {"posting": posting_id or _digest(seen.get), "attempt": attempt, "folder": name, "rows": written, "parts": parts}


def commit_posting(spark: SparkSession, path: str, staged: dict) -> bool:
    """Lands a staged posting by creating its manifest entry; False if its id had landed already."""
    fs, _ = _hadoop(spark, path)
    jvm = spark.sparkContext._jvm
    while True:
        entries = manifest(spark, path)
        if any(e["posting"] == staged["posting"] for e in entries):
            return False
        seq = 1 + max((e["seq"] for e in entries), default=0)
        entry = jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}/{seq:012d}.json")
        try:
            stream = fs.create(entry, False)
        except Exception as taken:  # another posting took this place: read the manifest again
            if "FileAlreadyExists" not in str(taken) and "already exists" not in str(taken):
                raise
            continue
        try:
            stream.write(bytearray(json.dumps({**staged, "seq": seq}).encode()))
        finally:
            stream.close()
        return True


def post(prepared: DataFrame, path: str, posting_id: str | None = None) -> int:
    """Writes prepared ledger rows once: returns the rows that landed, 0 if the posting had landed before."""
    spark = prepared.sparkSession
    if posting_id and any(e["posting"] == posting_id for e in manifest(spark, path)):
        return 0
    staged = stage_posting(prepared, path, posting_id)
    if staged["rows"] and commit_posting(spark, path, staged):
        return staged["rows"]
    fs, aside = _hadoop(spark, f"{path}/{POSTINGS}/posting={staged['folder']}")
    fs.delete(aside, True)  # this attempt's own rows, which nobody reads: the posting had landed, or has none
    return 0


def _append(prepared: DataFrame, path: str, posting_id: str | None = None) -> int:
    return post(prepared, path, posting_id)


def append_paid_ledger(rows: DataFrame, path: str, period: dict[str, Column], percent_mode: str = "excel", posting_id: str | None = None) -> int:
    """Post paid commissions once; returns the number of rows written (0 when this posting had landed)."""
    return _append(prepare_ledger_rows(rows, period, percent_mode), path, posting_id)


def append_excluded_ledger(rows: DataFrame, path: str, period: dict[str, Column], percent_mode: str = "excel", posting_id: str | None = None) -> int:
    """Post manual exclusions once; same shape as the paid ledger, its own table."""
    return _append(prepare_ledger_rows(rows, period, percent_mode), path, posting_id)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The landed rows of a ledger folder with a dense row id `id` in landing order; a folder of plain parquet
    (written before postings) is read as it is."""
    entries = manifest(spark, path)
    if not entries:
        fs, folder = _hadoop(spark, f"{path}/{POSTINGS}")
        if fs.exists(folder):  # postings staged, none landed
            return spark.createDataFrame([], S.LEDGER_SCHEMA).withColumn("id", F.lit(None).cast("long"))
        return spark.read.schema(S.LEDGER_SCHEMA).parquet(path)
    names = [e.get("folder") or f"{e['posting']}.{e['attempt']}" for e in entries]
    bases, schema = [], f"posting string, {_PART} int, _base long"
    for e, name in zip(entries, names, strict=True):
        before = e["first_id"]
        for part, n in e["parts"]:
            bases.append((name, part, before))
            before += n
    offsets = spark.createDataFrame(bases, schema)  # one row a task of each posting, from the manifest
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.LEDGER_SCHEMA)
    rows = spark.read.schema(f"{fields}, {_PART} int, {_INSIDE} long, posting string").parquet(f"{path}/{POSTINGS}")
    rows = rows.where(F.col("posting").isin(names)).join(F.broadcast(offsets), ["posting", _PART])
    local = F.col(_INSIDE) - F.shiftleft(F.col(_PART).cast("long"), 33)
    return rows.select(*[f.name for f in S.LEDGER_SCHEMA], (F.col("_base") + local).alias("id"))


def _newest_first(rows: DataFrame) -> DataFrame:
    """By time of posting, then by id where there is one, then by what tells rows of one posting apart.

    The rows of a posting share its time, so without the rest they would be sorted in one task.
    """
    order = ("paid_at", "id") if "id" in rows.columns else ("paid_at", *S.LEDGER_DATA_COLUMNS)
    return rows.orderBy(*[F.col(c).desc() for c in order if c in rows.columns])


def ledger_by_competence(ledger: DataFrame, year: int, month: int) -> DataFrame:
    """Postings of one competence, newest first; reads only its partition."""
    return _newest_first(ledger.where((F.col("competencia_ano") == year) & (F.col("competencia_mes") == month)))


def ledger_by_label(ledger: DataFrame, label: str) -> DataFrame:
    """Postings of one period label, newest first."""
    return _newest_first(period_rows(ledger, label))


def ledger_period_labels(ledger: DataFrame) -> DataFrame:
    """Period labels in the ledger, newest first."""
    named = ledger.where(F.trim("mes_ano_comissao") != "")
    latest = named.groupBy("mes_ano_comissao").agg(
        F.max("competencia_ano").alias("_year"), F.max("competencia_mes").alias("_month")
    )
    return latest.orderBy(F.desc("_year"), F.desc("_month"), F.desc("mes_ano_comissao")).select("mes_ano_comissao")


def refresh_state(ledger: DataFrame, path: str, summarize, competences: list[tuple[int, int]] | None = None) -> None:
    """Recomputes stored summary state for the given competences (all if None) and replaces those parts only.

    `summarize` maps ledger rows to state rows keyed by competence (`history.paid_state`); reading a ledger kept by
    competence, only the named competences are read. Ledgers only grow, so a competence never loses its part.
    """
    rows = ledger
    if competences is not None:
        places = [(F.col("competencia_ano") == y) & (F.col("competencia_mes") == m) for y, m in competences]
        rows = ledger.where(reduce(lambda a, b: a | b, places) if places else F.lit(False))
    state = summarize(rows)
    state.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("competencia_ano", "competencia_mes").parquet(path)


def write_incentive_titles(titles: DataFrame, path: str) -> None:
    """Replace the incentive title table."""
    titles.write.mode("overwrite").parquet(path)


# Rule tables -------------------------------------------------------------------------

_LOG = {"op": "string", "batch_id": "bigint", "updated_at": "timestamp"}


def _log_columns(kind: str) -> dict[str, str]:
    base = {"fat": S.RATE_COLUMNS, "margin": S.MARGIN_RATE_COLUMNS, "manager": S.MANAGER_COLUMNS}[kind]
    return {**base, "row_seq": "bigint", **_LOG}


def _log_ddl(kind: str) -> str:
    return ", ".join(f"{n} {t}" for n, t in _log_columns(kind).items())


class BatchTaken(ValueError):
    """A rule batch whose number another write has taken, or that is not above the last one."""


# A rule folder holds `batches/batch_id=<n>/attempt=<a>/part-*`, `_batches/<n>.json` (the batches that landed, each
# naming its attempt) and `_snapshots/<n>.json` with `snapshots/upto=<n>/`. A batch lands when its entry is created
# with create-if-absent, so of two writers of one number one is refused; rows of other attempts are never read.
RULE_BATCHES, RULE_MARKS, RULE_SNAPSHOTS, RULE_SNAPSHOT_MARKS = "batches", "_batches", "snapshots", "_snapshots"


def _entries(spark: SparkSession, folder: str) -> list[dict]:
    fs, place = _hadoop(spark, folder)
    if not fs.exists(place):
        return []
    out = []
    for status in fs.listStatus(place):
        if status.getPath().getName().endswith(".json"):
            stream = fs.open(status.getPath())
            try:
                out.append(json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            finally:
                stream.close()
    return sorted(out, key=lambda e: e["batch_id"])


def _claim(spark: SparkSession, folder: str, number: int, entry: dict) -> bool:
    """Creates `<folder>/<number>.json` unless it exists."""
    fs, _ = _hadoop(spark, folder)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{number:012d}.json")
    try:
        stream = fs.create(target, False)
    except Exception as taken:
        if "FileAlreadyExists" in str(taken) or "already exists" in str(taken):
            return False
        raise
    try:
        stream.write(bytearray(json.dumps(entry).encode()))
    finally:
        stream.close()
    return True


def rule_batches(spark: SparkSession, path: str) -> list[dict]:
    """The batches of a rule folder that landed, in order: batch_id, op, attempt, rows."""
    return _entries(spark, f"{path}/{RULE_MARKS}")


def _read_log(spark: SparkSession, path: str, kind: str, after: int | None = None) -> DataFrame:
    """The log rows of the landed batches (after batch `after` only, if given); a folder of plain parquet (written
    before batches landed this way) is read as it is."""
    landed = rule_batches(spark, path)
    if not landed:
        fs, place = _hadoop(spark, f"{path}/{RULE_BATCHES}")
        if fs.exists(place):
            return spark.createDataFrame([], _log_ddl(kind))
        log = spark.read.schema(_log_ddl(kind)).parquet(path)
        return log if after is None else log.where(F.col("batch_id") > after)
    wanted = [e for e in landed if after is None or e["batch_id"] > after]
    if not wanted:
        return spark.createDataFrame([], _log_ddl(kind))
    columns = {n: t for n, t in _log_columns(kind).items() if n != "batch_id"}
    ddl = ", ".join(f"{n} {t}" for n, t in columns.items()) + ", batch_id bigint, attempt string"
    rows = spark.read.schema(ddl).parquet(f"{path}/{RULE_BATCHES}")
    keep = reduce(lambda x, y: x | y, [(F.col("batch_id") == e["batch_id"]) & (F.col("attempt") == e["attempt"]) for e in wanted])
    return rows.where(keep).select(*_log_columns(kind))


def append_rules(prepared: DataFrame, path: str, kind: str, op: str, batch_id: int) -> int:
    """Add a batch of prepared rules; ``op`` is append, replace (old rows turn inactive) or reset (old rows vanish).

    ``batch_id`` must be above every batch that landed; the batch lands when its entry is created, and a number that
    another writer took first, or one not above the last, raises BatchTaken. Rows are written aside before that."""
    if op not in ("append", "replace", "reset"):
        raise ValueError(op)
    spark = prepared.sparkSession
    landed = rule_batches(spark, path)
    if landed and batch_id <= landed[-1]["batch_id"]:
        raise BatchTaken(f"batch {batch_id} is not above the last batch {landed[-1]['batch_id']}")
    seen = Observation(f"rule_append_{uuid.uuid4().hex[:8]}")
    filled = prepared.withColumns({"op": F.lit(op), "batch_id": F.lit(batch_id), "updated_at": F.current_timestamp()})
    if "row_seq" not in filled.columns:
        filled = filled.withColumn("row_seq", F.lit(None).cast("bigint"))
    rows = filled.select(*[F.col(n).cast(t).alias(n) for n, t in _log_columns(kind).items()])
    attempt = uuid.uuid4().hex[:12]
    rows.drop("batch_id").observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{path}/{RULE_BATCHES}/batch_id={batch_id}/attempt={attempt}")
    written = int(seen.get["rows"])
    if not _claim(spark, f"{path}/{RULE_MARKS}", batch_id, {"batch_id": batch_id, "op": op, "attempt": attempt, "rows": written}):
        raise BatchTaken(f"batch {batch_id} was taken by another write")
    return written


def _state(log: DataFrame) -> DataFrame:
    """Rows that still exist after the batches of `log`, with `ativo` as it stands after them."""
    marks = log.agg(
        F.max(F.when(F.col("op") == "reset", F.col("batch_id"))).alias("_reset"),
        F.max(F.when(F.col("op") != "append", F.col("batch_id"))).alias("_replaced"),
        F.lit(True).alias("_one"),
    )
    joined = log.withColumn("_one", F.lit(True)).join(F.broadcast(marks), "_one").drop("_one")  # one row
    kept = joined.where(F.col("batch_id") >= F.coalesce("_reset", F.col("batch_id")))
    in_force = F.col("batch_id") >= F.coalesce("_replaced", F.col("batch_id"))
    return kept.withColumn("ativo", F.col("ativo") & in_force).drop("_reset", "_replaced")


def snapshot_rules(spark: SparkSession, path: str, kind: str) -> int | None:
    """Stores the state after the last landed batch; later reads take it and the batches after it only."""
    landed = rule_batches(spark, path)
    if not landed:
        return None
    upto = landed[-1]["batch_id"]
    if any(e["batch_id"] == upto for e in _entries(spark, f"{path}/{RULE_SNAPSHOT_MARKS}")):
        return upto
    attempt = uuid.uuid4().hex[:12]
    rules_with_state(spark, path, kind).write.parquet(f"{path}/{RULE_SNAPSHOTS}/upto={upto}/attempt={attempt}")
    _claim(spark, f"{path}/{RULE_SNAPSHOT_MARKS}", upto, {"batch_id": upto, "attempt": attempt})
    return upto


def rules_with_state(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Every rule row that still exists, with ``ativo`` as it stands after all batches: the newest snapshot and the
    batches after it, which the read prunes to."""
    shots = _entries(spark, f"{path}/{RULE_SNAPSHOT_MARKS}")
    if not shots:
        return _state(_read_log(spark, path, kind))
    shot = shots[-1]
    stored = spark.read.schema(_log_ddl(kind)).parquet(f"{path}/{RULE_SNAPSHOTS}/upto={shot['batch_id']}/attempt={shot['attempt']}")
    return _state(stored.unionByName(_read_log(spark, path, kind, after=shot["batch_id"])))


def rules_in_force(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return rules_with_state(spark, path, kind).where("ativo")


# Tables and exports ------------------------------------------------------------------


def create_ledger_table(spark: SparkSession, name: str) -> None:
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.LEDGER_SCHEMA)
    keys = ", ".join(S.LEDGER_PARTITIONS)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({fields}) USING parquet PARTITIONED BY ({keys})")


def create_rule_table(spark: SparkSession, name: str, kind: str) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({_log_ddl(kind)}) USING parquet")


def evolve_table(spark: SparkSession, name: str, columns: dict[str, str]) -> list[str]:
    """Add the columns a table still lacks; returns their names."""
    present = set(spark.table(name).columns)
    added = {n: t for n, t in columns.items() if n not in present}
    if added:
        fields = ", ".join(f"{n} {t}" for n, t in added.items())
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({fields})")
    return list(added)


def export_report(report: DataFrame, path: str, fmt: str = "csv", partition_by: str | None = None, sheet: str = "Planilha1", header_row: int = 0) -> None:
    """Write a report flat, timestamps without zone; many files, one folder per branch on request. ``fmt="xlsx"``
    writes one workbook per value of ``partition_by`` (`workbooks.write_workbooks`), landing when the job commits."""
    flat = report
    for field in report.schema:
        if isinstance(field.dataType, T.TimestampType):
            flat = flat.withColumn(field.name, F.col(field.name).cast("timestamp_ntz"))
    if fmt == "xlsx":
        if partition_by is None:
            raise ValueError("workbooks are written one per value of partition_by")
        with shuffles_cleared(flat.sparkSession):
            write_workbooks(flat, path, partition_by, sheet, header_row)
        return
    writer = flat.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    with shuffles_cleared(flat.sparkSession):
        writer.save(path)
