"""All reports of one period."""

from dataclasses import dataclass

from pyspark.sql import DataFrame

from payouts.operators import reports as R

__all__ = ["ReportPack", "report_pack"]


@dataclass(frozen=True)
class ReportPack:
    cen: DataFrame
    cen_pending: DataFrame
    managers: DataFrame
    coordinator: DataFrame
    branches: DataFrame
    used_implements: DataFrame


def report_pack(ledger: DataFrame, relations: DataFrame, label: str, coordinator: str) -> ReportPack:
    """The reports as separate lazy frames; each prunes the ledger to the columns it needs,
    so one shared cached copy would read more than it saves."""
    return ReportPack(
        cen=R.cen_report(ledger, relations, label),
        cen_pending=R.cen_pending(ledger, relations, label),
        managers=R.manager_report(ledger, label),
        coordinator=R.coordinator_report(ledger, label, coordinator),
        branches=R.branch_analytic(ledger, label),
        used_implements=R.used_implements_analytic(ledger, label),
    )
