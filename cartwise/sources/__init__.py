"""Scans (clickstream CSV, any table, warehouse adapters) and sinks."""

from cartwise.sources.readers import (
    read_any,
    read_categories,
    read_events,
    read_item_properties,
    validate,
)
from cartwise.sources.tables import events_from_log, item_property_parts, table

__all__ = [
    "events_from_log", "item_property_parts", "read_any", "read_categories",
    "read_events", "read_item_properties", "table", "validate",
]
