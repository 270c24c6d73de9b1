"""All registered queries of the library, and their SQL twins."""

from __future__ import annotations

from wayfind.plans import over_accounts, over_agencies, over_contacts, over_ledger, over_measures, over_outreach, over_pages, over_places, over_regions, over_samples, over_verdicts  # noqa: F401
from wayfind.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
