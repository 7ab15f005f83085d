"""Column expressions shared by operators and plans."""

from confwarden.functions.columns import (
    alternative,
    blank_to,
    clean_ids,
    client_path,
    cursor_text,
    decode_assoc_ids,
    decode_role_ids,
    expand_template,
    final_outcome,
    first_with_ids,
    http_outcome,
    log_line,
    map_upsert,
    parse_cursor,
    policy_path,
    tab_separated,
    trim_space,
    utc_stamp,
)
from confwarden.functions.mappers import (
    has_mapper,
    insert_mapper,
    mapper_literal,
    patch_mappers,
    stale_mapper,
)

__all__ = [
    "alternative",
    "blank_to",
    "clean_ids",
    "client_path",
    "cursor_text",
    "decode_assoc_ids",
    "decode_role_ids",
    "expand_template",
    "final_outcome",
    "first_with_ids",
    "has_mapper",
    "http_outcome",
    "insert_mapper",
    "log_line",
    "map_upsert",
    "mapper_literal",
    "parse_cursor",
    "patch_mappers",
    "policy_path",
    "stale_mapper",
    "tab_separated",
    "trim_space",
    "utc_stamp",
]
