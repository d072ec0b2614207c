"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from leaselake import synth
from leaselake.operators.extract import extract_fields
from leaselake.plans import registry
from leaselake.plans.registry import queries
from leaselake.session import local_session, release_work, stored

HEADLINE = (
    "contract_parties", "contract_adjustment", "legal_flags", "document_fields", "content_dedup",
    "tax_withheld", "import_summary", "ledger_totals", "link_status", "compliance_totals",
    "name_matching", "upsert_history", "applied_changes",
)


def shared_steps(spark, sf_dir: str) -> dict:
    """What several queries read, timed apart: rendering, extraction of stored text, stored contracts, sheets."""
    text = []
    return {
        "render_contracts": lambda: text.append(stored(synth.contracts(spark, sf_dir), "bench-text")),
        "extract_stored_text": lambda: _run(extract_fields(text[0], ref_date=synth.REF_DATE)),
        "store_contracts": lambda: registry.analysed(spark, sf_dir),
        "store_sheets": lambda: registry._mapping(spark, sf_dir),
    }


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("leaselake-bench", cpus, int(cpus))
    times: dict[str, float] = {}
    registered = queries()
    for name, step in shared_steps(spark, sf_dir).items():
        start = time.time()
        step()
        times[name] = round(time.time() - start, 3)
    for name in HEADLINE:
        start = time.time()
        _run(registered[name](spark, sf_dir))
        times[name] = round(time.time() - start, 3)
    release_work(spark)
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": sf_dir.rstrip("/").split("/")[-1].removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
