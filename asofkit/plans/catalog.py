"""All registered queries."""

from __future__ import annotations

from . import evaluation_catalog, events_catalog, extra_catalog, joins_catalog, models_catalog, sources_catalog

QUERIES = {}
ORACLES = {}
for _module in (events_catalog, sources_catalog, joins_catalog, models_catalog, extra_catalog, evaluation_catalog):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
