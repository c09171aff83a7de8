"""All registered queries."""
from __future__ import annotations

from lamella.plans import catalog_models, catalog_relations, catalog_tables  # noqa: F401
from lamella.plans.catalog_relations import flagship  # noqa: F401
from lamella.plans.registry import IDS, ORACLES, QUERIES  # noqa: F401
