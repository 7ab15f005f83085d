"""Where entities come from: landed tables, exported pages, job parameters."""

from confwarden.sources.exports import land_export, read_pages, read_table
from confwarden.sources.guard import incomplete_exports, complete_realms
from confwarden.sources.targets import explode_targets, target_list

__all__ = [
    "complete_realms",
    "explode_targets",
    "incomplete_exports",
    "land_export",
    "read_pages",
    "read_table",
    "target_list",
]
