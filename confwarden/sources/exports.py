"""Entity scans.

An export is a folder of text files whose lines each hold one page: a JSON array of
documents (a single document per line works as well).  Lines keep the files splittable,
so reading scales with the bytes and there is no paging and no cap on the row count.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confwarden import schemas


def _with_keys(pages: DataFrame, entity: str) -> DataFrame:
    """``pages``, failing on a row that lacks one of the entity's keys."""
    for key in schemas.KEYS.get(entity, ()):
        missing = F.raise_error(F.lit(f"a document of {entity} lacks {key}")).cast(pages.schema[key].dataType)
        pages = pages.withColumn(key, F.coalesce(F.col(key), missing))
    return pages


def read_pages(spark: SparkSession, entity: str, path: str, array_files: bool = False) -> DataFrame:
    """Exported pages of ``entity``.

    A line that is no JSON fails the read, and so does a document without one of the entity's
    keys: one with foreign field names would otherwise be a row of nulls.

    ``array_files`` is for exports with one array spread over the lines of each file.
    Such a file cannot be split, so it suits page-sized files only.
    """
    pages = (
        spark.read.schema(schemas.EXPORTS[entity])
        .option("mode", "FAILFAST")
        .option("multiLine", array_files)
        .json(path)
    )
    return _with_keys(pages, entity)


def read_documents(spark: SparkSession, entity: str, path: str) -> DataFrame:
    """Clients or policies under the field names of their own documents, with the whole text.

    Each line holds ``{"realm": ..., "client_uuid": ..., "document": {...}}``; a client's uuid
    is its document's id.  ``document`` keeps every field, so that a plan can send all of it
    back; a line without its keys fails the read.  A line that cannot be edited (a key twice
    in one object, for instance) still has its keys and its text, so that plans can reject it.
    """
    v = F.try_parse_json("value")

    def text(path):
        return F.when(v.isNull(), F.get_json_object("value", path)).otherwise(F.try_variant_get(v, path, "string"))

    def field(name, kind="string"):
        if kind == "string":
            return text(f"$.document.{name}")
        if kind == "boolean":
            loose = F.get_json_object("value", f"$.document.{name}").try_cast("boolean")
            return F.when(v.isNull(), loose).otherwise(F.try_variant_get(v, f"$.document.{name}", kind))
        return F.try_variant_get(v, f"$.document.{name}", kind)

    own = text("$.client_uuid")
    if entity == "client":
        kind = schemas.CLIENT["protocol_mappers"].dataType
        mappers = F.from_json(field("protocolMappers"), schemas.DOCUMENT_MAPPERS).cast(kind)
        columns = {
            "client_uuid": field("id"),
            "client_id": field("clientId"),
            "authz_enabled": field("authorizationServicesEnabled", "boolean"),
            "attributes": field("attributes", "map<string,string>"),
            "protocol_mappers": mappers,
        }
    elif entity == "policy":
        columns = {"client_uuid": own, "policy_id": field("id"), "name": field("name"), "type": field("type")}
        columns["config"] = field("config", "map<string,string>")
    else:
        raise ValueError(f"no document fields are known for {entity}")
    columns = {"realm": text("$.realm"), **columns}
    columns["document"] = text("$.document")
    return _with_keys(spark.read.text(path).select(*[c.alias(n) for n, c in columns.items()]), entity)


def land_export(df: DataFrame, path: str, by: str | None = None) -> DataFrame:
    """Land an entity as Parquet, laid out by ``by`` (``type`` for policies, else ``realm``).

    The rebalance hint makes adaptive execution size the files and split a value of
    ``by`` that holds most rows over several of them.
    """
    out = df.hint("rebalance", by) if by else df.hint("rebalance")
    writer = out.write.mode("overwrite")
    if by:
        writer = writer.partitionBy(by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, entity: str, path: str) -> DataFrame:
    """A landed entity.  Filters and column choice made on it reach the Parquet reader."""
    return spark.read.schema(schemas.EXPORTS[entity]).parquet(path)
