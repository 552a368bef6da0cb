"""Settlement of machine commissions, from sources or from an extracted table."""

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payouts.functions import norm_key, source_key
from payouts.operators.extract import MachineSources, machine_base
from payouts.operators.history import _chassis_key, _paid_columns, _paid_dim, open_candidates, paid_history
from payouts.operators.joins import lookup_join
from payouts.sources.stage import bucketed, stage
from payouts.operators.rules import commission_rules, default_fat_rate, manager_commission

__all__ = ["machine_settlement", "paid_history_bucketed", "settle_period", "settlement_after_posting"]


def machine_settlement(
    base: DataFrame,
    fat_rates: DataFrame,
    margin_rates: DataFrame,
    paid: DataFrame | None,
    managers: DataFrame | None = None,
    excluded: DataFrame | None = None,
    default_rate: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(open candidates, full history) of an extracted machine table.

    The default rate, when asked for, applies to the open rows after everything else. The history depends on the
    chassis alone, so it is joined first: the extraction is moved by chassis before the commission columns widen it,
    and blocked rows are not calculated where only the open ones are asked for.
    """
    with_history = paid_history(base, paid, excluded)
    history = [c for c in with_history.columns if c not in base.columns]
    calculated = manager_commission(commission_rules(with_history, fat_rates, margin_rates), managers)
    full = calculated.select(*[c for c in calculated.columns if c not in history], *history)
    candidates = open_candidates(full)
    return (default_fat_rate(candidates) if default_rate else candidates), full


def settle_period(
    sources: MachineSources,
    start: date,
    end: date,
    fat_rates: DataFrame,
    margin_rates: DataFrame,
    paid: DataFrame | None,
    managers: DataFrame | None = None,
    excluded: DataFrame | None = None,
    default_rate: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Extraction and settlement as one plan per output."""
    base = machine_base(sources, start, end)
    return machine_settlement(base, fat_rates, margin_rates, paid, managers, excluded, default_rate)


def settlement_after_posting(
    full: DataFrame,
    calculated: DataFrame,
    posted: DataFrame,
    paid: DataFrame | None,
    excluded: DataFrame | None = None,
    default_rate: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(open candidates, full history) after a posting, from the full history before it.

    Only the history of chassis that the posted ledger rows name can change. Their rows of `calculated` are joined
    again with the summaries after the posting (`paid` and `excluded`, or merged stored state), which are cut to those
    chassis before any join; every other row of `full` stays as it was. Equals machine_settlement over the whole
    ledger. Rows without a chassis never meet a summary, so they keep their history too.
    """
    key = lambda c: F.nullif(norm_key(c), F.lit(""))  # noqa: E731  the lookup key of history.py
    touched = posted.select(key(source_key(F.col("nro_chassi"))).alias("_chassis")).where("_chassis IS NOT NULL").distinct()
    touched = stage(touched, "touched_chassis")  # small next to the history, and then known to be

    def only(frame: DataFrame | None, how: str = "left_semi") -> DataFrame | None:
        if frame is None:
            return None
        keyed = frame.withColumn("_chassis", key(F.col("nro_chassi")))
        return keyed.join(touched, "_chassis", how).drop("_chassis")

    redone = paid_history(only(calculated), only(paid), only(excluded))
    history = only(full, "left_anti").unionByName(redone.select(*full.columns))
    candidates = open_candidates(history)
    return (default_fat_rate(candidates) if default_rate else candidates), history


def paid_history_bucketed(rows: DataFrame, paid: DataFrame, buckets: int) -> DataFrame:
    """paid_history_join over tables bucketed by chassis key: rows and the paid summary are written bucketed and
    sorted by the key, so the join reads both as they lie, with no exchange. Rows without a chassis share a bucket."""
    keyed = bucketed(rows.withColumn("_chassis", _chassis_key(F.col("nro_chassi"))), "_chassis", buckets, "rows_by_chassis")
    dim = bucketed(_paid_dim(paid), "_chassis", buckets, "paid_by_chassis")
    return lookup_join(keyed, dim, ["_chassis"]).select(*rows.columns, *_paid_columns())
