"""All registered queries."""

from diamondlap.plans import catalog_documents, catalog_matchup, catalog_pitching, catalog_quality, catalog_racing, catalog_serve, catalog_streaming  # noqa: F401
from diamondlap.plans.registry import ORACLE, QUERIES  # noqa: F401
