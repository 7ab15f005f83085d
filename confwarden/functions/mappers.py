"""Edits of ``array<struct>`` protocol-mapper lists, inside the row."""

from pyspark.sql import functions as F

from confwarden.functions.columns import map_upsert
from confwarden.schemas import MAPPER

_MAPPERS = f"array<{MAPPER.simpleString()}>"


def _list(mappers):
    """A null list is an empty one."""
    return F.coalesce(mappers, F.array().cast(_MAPPERS))


def mapper_literal(mapper: dict):
    """A mapper given as a dict, as a struct column."""
    config = F.create_map(*[F.lit(x) for pair in mapper["config"].items() for x in pair])
    return F.struct(
        F.lit(mapper["name"]).alias("name"),
        F.lit(mapper["protocol"]).alias("protocol"),
        F.lit(mapper["protocol_mapper"]).alias("protocol_mapper"),
        F.lit(mapper["consent_required"]).cast("boolean").alias("consent_required"),
        config.alias("config"),
    ).cast(MAPPER)


def has_mapper(mappers, name):
    """Exact match on the whole name; false for a null list."""
    return F.exists(_list(mappers), lambda m: m["name"].eqNullSafe(F.lit(name)))


def insert_mapper(mappers, mapper: dict):
    """``mappers`` with ``mapper`` added unless one of that name is there."""
    there = has_mapper(mappers, mapper["name"])
    added = F.concat(_list(mappers), F.array(mapper_literal(mapper)))
    return F.when(there, _list(mappers)).otherwise(added)


def patch_mappers(mappers, names, key, value):
    """Set ``config[key]`` in the mappers with one of ``names``; the others stay."""
    return F.transform(
        _list(mappers),
        lambda m: F.when(
            m["name"].isin(*names), m.withField("config", map_upsert(m["config"], key, value))
        ).otherwise(m),
    )


def stale_mapper(mappers, names, key, value):
    """True where a mapper with one of ``names`` still lacks ``config[key] = value``."""
    return F.exists(
        _list(mappers),
        lambda m: F.coalesce(m["name"].isin(*names), F.lit(False))
        & ~m["config"][key].eqNullSafe(F.lit(value)),
    )
