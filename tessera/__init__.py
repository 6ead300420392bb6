"""Document-layout analytics on Spark; names are imported when first asked for."""

from __future__ import annotations

import importlib

_WHERE = {
    "fuse": "tessera.operators.fuse", "fusion_stats": "tessera.operators.fuse", "items_in_box": "tessera.operators.fuse", "items_in_cell": "tessera.operators.fuse",
    "pair_labels": "tessera.operators.pairing", "pair_fields": "tessera.operators.pairing", "bind": "tessera.operators.binding", "collect_issues": "tessera.operators.binding",
    "provenance": "tessera.operators.trace", "trace_values": "tessera.operators.trace", "Field": "tessera.operators.typed", "Schema": "tessera.operators.typed", "apply_schema": "tessera.operators.typed",
    "Pipeline": "tessera.plans.extraction", "Retry": "tessera.plans.providers", "TableCache": "tessera.plans.cache", "register_views": "tessera.sources.views",
}
__all__ = sorted(_WHERE)


def __getattr__(name: str) -> object:
    if name not in _WHERE:
        raise AttributeError(name)
    return getattr(importlib.import_module(_WHERE[name]), name)
