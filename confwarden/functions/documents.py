"""Edits inside whole configuration documents, which keep every field they do not change."""

from pyspark.sql import functions as F

from confwarden import fixed

_OBJECT = "map<string,variant>"


def _object(v):
    """The fields of a variant object; an empty map for anything else."""
    return F.coalesce(F.try_variant_get(v, "$", _OBJECT), F.create_map().cast(_OBJECT))


def _with(fields, changes: dict):
    """``fields`` with the keys of ``changes`` set to variants."""
    kept = F.map_filter(fields, lambda k, _: ~k.isin(*changes))
    return F.map_concat(kept, F.create_map(*[x for k, v in changes.items() for x in (F.lit(k), v)]))


def _text(value):
    return F.try_variant_get(F.to_variant_object(F.array(F.lit(value))), "$[0]", "variant")


def _set(holder, key, value):
    """The variant object ``holder`` with ``key`` set to a text."""
    return F.to_variant_object(_with(_object(holder), {key: _text(value)}))


def _mapper(mapper: dict):
    config = F.create_map(*[F.lit(x) for pair in mapper["config"].items() for x in pair])
    return F.to_variant_object(
        F.struct(
            F.lit(mapper["name"]).alias("name"),
            F.lit(mapper["protocol"]).alias("protocol"),
            F.lit(mapper["protocol_mapper"]).alias("protocolMapper"),
            F.lit(mapper["consent_required"]).cast("boolean").alias("consentRequired"),
            config.alias("config"),
        )
    )


def edited_client(document, value):
    """A client document (JSON) with the mode attribute, the sub mapper and the claims set."""
    fields = F.try_variant_get(F.try_parse_json(document), "$", _OBJECT)
    mappers = F.coalesce(
        F.try_variant_get(fields["protocolMappers"], "$", "array<variant>"),
        F.array().cast("array<variant>"),
    )

    def name(m):
        return F.try_variant_get(m, "$.name", "string")

    def claimed(m):
        config = _set(F.try_variant_get(m, "$.config", "variant"), fixed.CLAIM_KEY, "true")
        return F.to_variant_object(_with(_object(m), {"config": config}))

    there = F.exists(mappers, lambda m: name(m).eqNullSafe(F.lit(fixed.SUB_MAPPER["name"])))
    listed = F.when(there, mappers).otherwise(F.array_append(mappers, _mapper(fixed.SUB_MAPPER)))
    patched = F.transform(listed, lambda m: F.when(name(m).isin(*fixed.PATCHED_MAPPERS), claimed(m)).otherwise(m))
    changes = {
        "attributes": _set(fields["attributes"], fixed.TOKEN_MODE_ATTRIBUTE, value),
        "protocolMappers": F.to_variant_object(patched),
    }
    return F.to_json(_with(fields, changes))


def edited_policy(document, value):
    """A policy document (JSON) with ``fetchRoles`` set in its config."""
    fields = F.try_variant_get(F.try_parse_json(document), "$", _OBJECT)
    return F.to_json(_with(fields, {"config": _set(fields["config"], fixed.FETCH_ROLES_KEY, value)}))
