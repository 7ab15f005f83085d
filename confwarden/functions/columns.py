"""Column helpers.  All of them compose built-in functions; none needs Python workers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from confwarden import fixed

EMPTY_IDS = "array<string>"


# Defaults and text ---------------------------------------------------------------
def blank_to(col, default):
    """``default`` where ``col`` is null or empty."""
    return F.coalesce(F.nullif(F.col(col) if isinstance(col, str) else col, F.lit("")), default)


def alternative(flag, default):
    """``default`` where a boolean is null *or false*."""
    return F.when(flag, flag).otherwise(default)


def trim_space(col):
    """Trim every kind of white space; ``trim`` itself only removes blanks."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def tab_separated(*cols):
    return F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])


def expand_template(realm, template):
    """A template that starts with ``-`` is a suffix to the realm, any other is literal."""
    return F.when(F.startswith(template, F.lit("-")), F.concat(realm, template)).otherwise(template)


# Reference lists -----------------------------------------------------------------
def clean_ids(ids):
    """Null and empty ids are not references; a null list is an empty one."""
    ids = F.coalesce(ids, F.array().cast(EMPTY_IDS))
    return F.filter(ids, lambda x: x.isNotNull() & (x != F.lit("")))


def first_with_ids(*lists):
    """The first list that is not empty; null if all are."""
    return F.get(F.filter(F.array(*lists), lambda ids: F.size(ids) > 0), F.lit(0))


def _one_list(text):
    """Whether a text begins with a bracket and its only closing one is its last character.

    Such a text, as exports nearly always write it, can have no rest behind the list.
    """
    return F.startswith(text, F.lit("[")) & (F.locate("]", text) == F.length(text))


def _elements(text):
    """Elements of a text that is a JSON list as a whole; null for anything else.

    The parser stops after one value, so a text that may have a rest behind the value is put
    into a list of its own: the rest is then an error, or a second element.
    """
    whole = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    inner = F.try_variant_get(F.when(F.size(whole) == 1, F.get(whole, F.lit(0))), "$", "array<variant>")
    return F.when(_one_list(text), F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")).otherwise(inner)


def _is_object(element):
    return F.startswith(F.schema_of_variant(element), F.lit("OBJECT"))


def decode_role_ids(text):
    """Ids of a JSON list of objects held in a string.

    Anything but a list, and a list with an element that is neither object nor null, has none.
    """
    listed = F.when(text.rlike(r"^\s*\["), F.concat(F.lit("["), text, F.lit("]")))
    whole = F.from_json(listed, "array<array<struct<id:string>>>")
    inner = F.when(F.size(whole) == 1, F.get(whole, F.lit(0)).getField("id"))
    alone = F.from_json(text, "array<struct<id:string>>").getField("id")
    return clean_ids(F.when(_one_list(text), alone).otherwise(inner))


def decode_assoc_ids(text):
    """Ids of a JSON list held in a string; elements are ids or objects with an ``id``."""
    return clean_ids(
        F.transform(
            _elements(text),
            lambda x: F.when(_is_object(x), F.try_variant_get(x, "$.id", "string")).otherwise(
                F.try_variant_get(x, "$", "string")
            ),
        )
    )


# Maps ----------------------------------------------------------------------------
def map_upsert(m: Column, key: str, value: str) -> Column:
    """``m`` with ``key`` set; a null map counts as empty.

    The key is filtered out first because ``map_concat`` rejects duplicates.
    """
    base = F.coalesce(m, F.create_map().cast("map<string,string>"))
    kept = F.map_filter(base, lambda k, _: k != F.lit(key))
    return F.map_concat(kept, F.create_map(F.lit(key), F.lit(value)))


# Paths, cursors, log lines ---------------------------------------------------------
def client_path(realm, client_uuid):
    return F.format_string(fixed.CLIENT_PATH, realm, client_uuid.cast("string"))


def policy_path(realm, client_uuid, policy_id):
    return F.format_string(
        fixed.POLICY_PATH, realm, client_uuid.cast("string"), policy_id.cast("string")
    )


def cursor_text(phase, offset):
    return F.format_string(fixed.CURSOR, phase, offset.cast("string"))


def parse_cursor(text):
    """Cursor text as ``struct(phase, offset)``; absent or unknown restarts at the first phase."""
    phase = F.regexp_extract(text, r"^phase=([^;]*);", 1)
    offset = F.regexp_extract(text, r"offset=(\d+)$", 1).try_cast("long")
    known = F.coalesce(phase.isin(*fixed.PHASES), F.lit(False))
    return F.struct(
        F.when(known, phase).otherwise(F.lit(fixed.POLICY_PHASE)).alias("phase"),
        F.when(known, F.coalesce(offset, F.lit(0).cast("long")))
        .otherwise(F.lit(0).cast("long"))
        .alias("offset"),
    )


def utc_stamp(ts):
    """UTC text of a timestamp; the session time zone has to be UTC."""
    return F.date_format(ts, fixed.LOG_STAMP)


def log_line(ts, level, message):
    return F.format_string(fixed.LOG_LINE, utc_stamp(ts), F.lit(level), message)


# Outcomes ------------------------------------------------------------------------
def _succeeded(code, deleting):
    done = code.between(200, 299)
    return done | (code == 404) if deleting else done


def http_outcome(code, deleting=True):
    """Class of one HTTP status.  Only for a deletion does "not found" mean success."""
    return (
        F.when(_succeeded(code, deleting), F.lit("OK"))
        .when((code == 401) | code.between(500, 599), F.lit("RETRY"))
        .otherwise(F.lit("FAIL"))
    )


def final_outcome(code, deleting=True):
    """Outcome once no attempt is left: whatever did not succeed has failed."""
    return F.when(_succeeded(code, deleting), F.lit("OK")).otherwise(F.lit("FAIL"))
