"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: White space of the text contracts, as a class for Java, RE2 and Python patterns alike.
SPACES = r"[\x20\x09-\x0D]+"
BATCH_BYTES = 16 * 1024 * 1024
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bits of a sieve for each key, and in all (a bitmap of 8 MB, its words go to every task).
SIEVE_BITS, SIEVE = 16, 1 << 26


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables; only Spark's reader opens the path."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one in `spark.checkpoint.dir`. Where that is unset a temporary folder will do only if the
    executors run in this very process; on a cluster it raises.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
    return context.getCheckpointDir()


def cut(frame: DataFrame) -> DataFrame:
    """The frame from files in the shared folder, so that a lost executor costs no recomputation.

    Python functions in it get batches of BATCH_BYTES at most, as rows here hold whole texts and sets. Spark's cleaner
    removes the files, and the shuffle files behind them, when the driver's garbage collector finds that they are no
    longer in use; it is called here, as a driver that only plans has little garbage of its own.
    """
    context = frame.sparkSession.sparkContext
    folder = shared_folder(frame.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    before = frame.sparkSession.conf.get(_BATCH)
    frame.sparkSession.conf.set(_BATCH, BATCH_BYTES)
    try:
        done = frame.checkpoint(eager=True)
    finally:
        frame.sparkSession.conf.set(_BATCH, before)
    del frame
    release(done.sparkSession)
    return done


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the files of frames that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def sieved(frame: DataFrame, hashed: Column, keys: DataFrame, key: Column, flag: str) -> DataFrame:
    """The frame with a boolean `flag`: false where the 64-bit `hashed` is certainly none of the keys' hashes, true for
    all of those and, by chance, for about one in SIEVE_BITS of the others.

    The words of a bitmap of the keys are broadcast, so rows that cannot meet the keys need not be moved to them. With
    more keys than SIEVE holds the flag is true more often, and nothing else changes. The keys are read twice.
    """
    bits = -(-min(max(keys.count() * SIEVE_BITS, 64), SIEVE) // 64) * 64
    word, mask = fresh(frame, "_word", "_mask")

    def place(value: Column) -> tuple[Column, Column]:
        at = F.pmod(value, F.lit(bits).cast("long"))
        return F.shiftright(at, 6), at.bitwiseAND(63).cast("int")

    of_word, of_bit = place(key)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), of_bit)
    words = keys.select(of_word.alias(word), one.alias(mask)).groupBy(word).agg(F.bit_or(mask).alias(mask))
    at_word, at_bit = place(hashed)
    found = frame.withColumn(word, at_word).join(F.broadcast(words), word, "left")
    return found.withColumn(flag, F.coalesce(F.getbit(mask, at_bit) == 1, F.lit(False))).drop(word, mask)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path for a table of this run in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Removes a table that `new_folder` named."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_of(name: str = "text") -> Column:
    """The text, a missing one as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """Column names like those given that the frame does not have, in any case of letters."""
    taken = {c.lower() for c in frame.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
