"""The whole path from contract text to the compliance report."""

from __future__ import annotations

from datetime import date
from typing import NamedTuple

from pyspark.sql import Column, DataFrame

from leaselake.operators.compliance import compliance_flags
from leaselake.operators.extract import assemble_contracts, extract_fields, with_provenance
from leaselake.operators.linkage import (
    DEFAULT_FLOOR,
    DEFAULT_THRESHOLD,
    company_status,
    compliance_totals,
    link_entities,
    orphans,
    pendencies,
)
from leaselake.operators.report import build_ledger, ledger_totals
from leaselake.plans.lease_ptbr import FIELDS, Field


def analyse(
    documents: DataFrame,
    text_col: str = "text",
    ref_date: date | str | Column | None = None,
    rules: tuple[Field, ...] = FIELDS,
) -> DataFrame:
    """One assembled contract per document, with flags and provenance."""
    fields = extract_fields(documents, text_col, rules, ref_date)
    return assemble_contracts(with_provenance(compliance_flags(fields), rules), rules)


class Report(NamedTuple):
    """All tables of one report. Linking stores the names first, so a job runs when the report is made."""

    ledger: DataFrame
    totals: DataFrame
    links: DataFrame
    companies: DataFrame
    pendencies: DataFrame
    orphans: DataFrame
    compliance: DataFrame


def report(
    contracts: DataFrame,
    portfolio: DataFrame,
    brackets: DataFrame,
    id_col: str,
    threshold: float = DEFAULT_THRESHOLD,
    floor: float = DEFAULT_FLOOR,
) -> Report:
    """Ledger and compliance of assembled contracts.

    Give it stored contracts (a written table), since several tables read them.
    """
    ledger = build_ledger(contracts, brackets, id_col)
    links = link_entities(
        ledger, portfolio, id_col, "tenant_name", "tenant_document", threshold, floor
    )
    return Report(
        ledger,
        ledger_totals(ledger),
        links,
        company_status(links, portfolio),
        pendencies(links, portfolio),
        orphans(links),
        compliance_totals(links, portfolio),
    )
