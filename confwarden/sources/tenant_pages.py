"""Pages laid out by tenant: what cannot be read keeps its tenant out, and no other.

Folder of an entity: ``realm=<tenant>/`` with files of pages, one page or document a line.
"""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from confwarden import schemas
from confwarden.session import land

CORRUPT = "_corrupt_line"


def read_tenant_pages(spark: SparkSession, entity: str, path: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """The documents of ``entity``, and ``realm, entity, file, line, reason`` of each line that is none.

    A line is broken if it is no JSON or a document in it lacks one of the entity's keys.  Its
    tenant is that of its folder, so a broken line outside such a folder fails the read.  The
    pages are parsed once, into ``folder``; both results are read from there.
    """
    schema = schemas.EXPORTS[entity]
    pages = (
        spark.read.schema(T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())]))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )
    lacking = F.array_compact(F.array(*[F.when(F.col(k).isNull(), F.lit(k)) for k in schemas.KEYS[entity] if k != "realm"]))
    reason = F.when(F.col(CORRUPT).isNotNull(), "unreadable line").when(
        F.size(lacking) > 0, F.concat(F.lit("lacks "), F.array_join(lacking, ", "))
    )
    nobody = F.raise_error(F.lit(f"a broken line of {entity} lies outside the folder of a tenant")).cast("string")
    marked = pages.withColumns(
        {
            "reason": reason,
            "file": F.col("_metadata.file_path"),
            "realm": F.when(reason.isNotNull(), F.coalesce("realm", nobody)).otherwise(F.col("realm")),
        }
    )
    landed = land(marked, f"{folder}/{entity}")
    broken = landed.filter("reason IS NOT NULL").select(
        "realm", F.lit(entity).alias("entity"), "file", F.col(CORRUPT).alias("line"), "reason"
    )
    return landed.filter("reason IS NULL").select(*schema.fieldNames()), broken


def broken_tenants(*broken: DataFrame) -> DataFrame:
    """``realm, entity, expected, actual, reason``, as for incomplete exports: ``actual`` broken lines."""
    lines = reduce(DataFrame.unionByName, broken)
    return (
        lines.groupBy("realm", "entity", "reason")
        .agg(F.count("*").alias("actual"))
        .select("realm", "entity", F.lit(None).cast("long").alias("expected"), "actual", "reason")
    )
