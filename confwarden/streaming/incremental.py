"""Verdicts over pages that keep arriving, without judging all of them anew in each run.

A verdict rests on counts: of a record's references, how many lead to a member of a set, the
existing roles or the dead policies.  Such counts can be added up, so a run adds those of
its new pages to what earlier runs have counted, and corrects the counts of earlier references
whose target has joined or left the set since.  It reads its own pages, one narrow row for each
record, and of the earlier references those whose targets fall into the buckets of changed ones.
A micro-batch only lands its references: the set is a whole table, so all that has landed in a
run is looked up at once.

Nothing is left out when a page lands.  Which clients are looked at, and whether a record
without a list of its own has one in a detail record, is decided at the verdict: a client or a
detail may arrive runs after the page that needs it.

Folder of a state, ``n`` the number of a run:

=========================  ================================================================
``set/run=n``              the members of the set that the run judged by
``landed/run=n/label=l``   references as landed by micro-batch ``l``
``edges/run=n/label=run``  all of them, in buckets of targets, and which were found in the set
``deltas/run=n/label=set`` how the counts of earlier runs change with the set
``base/run=n``             the counts up to the run; the last thing a run writes
=========================  ================================================================

A micro-batch that has landed is done, whatever the checkpoint says.  A run that was
broken off is finished with the set it began with, before the next one begins.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from confwarden import fixed
from confwarden.functions import clean_ids, decode_role_ids, first_with_ids
from confwarden.operators.clients import CLIENT_KEY
from confwarden.operators.lookup import lookup, only_found, whole
from confwarden.operators.refs import (
    PERMISSION_KEY,
    POLICY_KEY,
    explode_listed,
    policies_of_type,
    with_assoc_ids,
    with_role_ids,
)
from confwarden.operators.roles import ROLE_KEY
from confwarden.sinks.folders import is_written, last_written, replace

LISTED, DETAIL = "listed", "detail"
BUCKETS = 16
#: Changes of the set beyond this many are joined by shuffles, whatever Spark takes them for.
FEW = 100_000


@dataclass(frozen=True)
class EdgeCounts:
    """A state: references from records (``source``) to targets (``target``), below ``folder``.

    ``carried`` are columns of the records that belong to their key.
    """

    spark: SparkSession
    folder: str
    source: tuple[str, ...]
    target: tuple[str, ...]
    carried: tuple[str, ...] = ()

    @property
    def key(self) -> list[str]:
        return [*self.source, *self.carried]

    @property
    def edge_schema(self) -> T.StructType:
        names = dict.fromkeys([*self.key, *self.target])
        fields = [T.StructField(name, T.StringType()) for name in names]
        more = [("refs", T.LongType()), ("origin", T.StringType()), ("bucket", T.IntegerType())]
        return T.StructType(fields + [T.StructField(name, kind) for name, kind in more])

    @property
    def count_schema(self) -> T.StructType:
        fields = [T.StructField(name, T.StringType()) for name in [*self.key, "origin"]]
        counts = [T.StructField(name, T.LongType()) for name in ("total", "hits", "refs")]
        return T.StructType([*fields, T.StructField("bare", T.BooleanType()), *counts])

    def read(self, name: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}").select(*schema.fieldNames())

    def members(self, run: int) -> DataFrame:
        schema = T.StructType([T.StructField(name, T.StringType()) for name in self.target])
        return self.read(f"set/run={run}", schema)


def _bucket(state: EdgeCounts):
    return F.pmod(F.xxhash64(*state.target), F.lit(BUCKETS)).cast("int")


def _landed_schema(state: EdgeCounts) -> T.StructType:
    return T.StructType([field for field in state.edge_schema if field.name != "bucket"])


def _counted(state: EdgeCounts, run: int) -> DataFrame:
    """Rows to add up to the counts of what the run has landed, which goes into its buckets.

    A record without references has a row that says so.  Totals are taken from the landed
    references, which lie record by record, and only hits from those that the lookup has dealt
    out by target.  These are written record by record again, so that their ids compress, there and
    wherever they are shuffled later.  An empty set finds nothing.
    """
    landed = state.read(f"landed/run={run}", _landed_schema(state))
    members = state.members(run).select(*state.target, F.lit(True).alias("member"))
    if members.isEmpty():
        marked = landed.withColumn("member", F.lit(None).cast("boolean"))
    else:
        marked = lookup(landed, whole(members), list(state.target))
    marked = marked.withColumns({"found": F.col("member").isNotNull(), "bucket": _bucket(state)})
    marked = marked.drop("member").sortWithinPartitions("bucket", *state.source[::-1])
    replace(marked, f"{state.folder}/edges/run={run}/label=run", "bucket")
    schema = T.StructType([*state.edge_schema.fields, T.StructField("found", T.BooleanType())])
    found = state.read(f"edges/run={run}/label=run", schema).filter("found")
    leads = F.col(state.target[-1]).isNotNull()
    totals = {"bare": ~leads, "total": leads.cast("long"), "hits": F.lit(0).cast("long")}
    hits = {"bare": F.lit(False), "total": F.lit(0).cast("long"), "hits": F.lit(1).cast("long"), "refs": F.lit(None).cast("long")}
    names = state.count_schema.fieldNames()
    return landed.withColumns(totals).select(*names).unionByName(found.withColumns(hits).select(*names))


def earlier_edges(state: EdgeCounts, run: int, buckets: list[int]) -> DataFrame:
    """References landed before ``run`` whose targets fall into ``buckets``; no other file is read."""
    more = [T.StructField("run", T.IntegerType()), T.StructField("label", T.StringType())]
    schema = T.StructType([*state.edge_schema.fields, *more])
    landed = state.spark.read.schema(schema).parquet(f"{state.folder}/edges")
    return landed.filter((F.col("run") < run) & F.col("bucket").isin(buckets)).drop("bucket", "run", "label")


def _corrections(state: EdgeCounts, run: int) -> DataFrame | None:
    """How the counts of earlier runs' references change with the set; None if it has not changed."""
    old, new, key = state.members(run - 1), state.members(run), list(state.target)
    both = old.withColumn("change", F.lit(-1)).unionByName(new.withColumn("change", F.lit(1)))
    changed = both.groupBy(*key).agg(F.sum("change").alias("change")).filter("change <> 0")
    path = f"{state.folder}/changes/run={run}"
    replace(changed.withColumn("bucket", _bucket(state)), path)
    changes = state.spark.read.parquet(path)
    changed_in = {r.bucket: r["count"] for r in changes.groupBy("bucket").count().collect()}  # BUCKETS at most
    if not changed_in:
        return None
    touched = earlier_edges(state, run, list(changed_in)).drop("refs")
    hits = changes.select(*key, F.col("change").alias("hits"))
    marked = lookup(touched, hits if sum(changed_in.values()) <= FEW else whole(hits), key)
    nothing = {"bare": F.lit(False), "total": F.lit(0).cast("long"), "refs": F.lit(0).cast("long")}
    return marked.filter(F.col("hits").isNotNull()).withColumns(nothing)


def _folded(state: EdgeCounts, rows: DataFrame) -> DataFrame:
    return rows.groupBy(*state.key, "origin").agg(
        F.max("bare").alias("bare"),
        F.sum("total").alias("total"),
        F.sum("hits").alias("hits"),
        F.max("refs").alias("refs"),
    )


def _run(state: EdgeCounts, run: int, streams: dict) -> None:
    spark, folder = state.spark, state.folder
    delta = f"{folder}/deltas/run={run}"
    if run and not is_written(spark, f"{delta}/label=set"):
        changed = _corrections(state, run)
        if changed is not None:
            replace(changed.select(*state.count_schema.fieldNames()), f"{delta}/label=set")

    def landing(label, decode):
        def batch(page: DataFrame, batch_id: int) -> None:
            name = f"label={label}-{batch_id}"
            # Micro-batches of states from before there was ``landed`` have a delta each.
            if not any(is_written(spark, f"{folder}/{kind}/run=*/{name}") for kind in ("landed", "deltas")):
                rows = decode(page).select(*_landed_schema(state).fieldNames())
                replace(rows, f"{folder}/landed/run={run}/{name}")

        return batch

    for label, (pages, decode) in streams.items():
        (
            pages.writeStream.foreachBatch(landing(label, decode))
            .option("checkpointLocation", f"{folder}/checkpoints/{label}")
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )
    parts = [state.read(f"base/run={run - 1}", state.count_schema)] if run else []
    if is_written(spark, f"{delta}/*"):
        parts.append(state.read(f"deltas/run={run}", state.count_schema))
    if is_written(spark, f"{folder}/landed/run={run}/*"):
        parts.append(_counted(state, run))
    rows = parts[0] if parts else spark.createDataFrame([], state.count_schema)
    for more in parts[1:]:
        rows = rows.unionByName(more)
    replace(_folded(state, rows).select(*state.count_schema.fieldNames()), f"{folder}/base/run={run}")


def advance(state: EdgeCounts, members: DataFrame, streams: dict[str, tuple[DataFrame, Callable]]) -> int:
    """Take in what is new: changes of the set, and the new pages of the streams.

    ``streams`` has, by label, pages and a function from pages to rows of ``edge_schema``
    (without ``bucket``).  Returns the number of the run.
    """
    spark, folder = state.spark, state.folder
    run = last_written(spark, f"{folder}/base", "run") + 1
    if is_written(spark, f"{folder}/set/run={run}"):  # broken off: to its end, by its own set
        _run(state, run, streams)
        run += 1
    key = list(state.target)
    texts = members.select(*[F.col(name).cast("string").alias(name) for name in key])
    replace(texts.dropDuplicates(key), f"{folder}/set/run={run}")
    _run(state, run, streams)
    return run


def counts_of(state: EdgeCounts, run: int | None = None) -> DataFrame:
    """Key, ``refs``, ``total`` and ``hits`` of each record, and ``pending``: it has no list so far.

    Details count for records that were exported without a list of their own.
    """
    if run is None:
        run = last_written(state.spark, f"{state.folder}/base", "run")
    rows = state.read(f"base/run={run}", state.count_schema)
    listed, detailed = rows.filter(F.col("origin") == LISTED), rows.filter(F.col("origin") == DETAIL)
    sums = {f"detail_{c}": f(c) for f, c in ((F.sum, "total"), (F.sum, "hits"), (F.max, "refs"))}
    if detailed.isEmpty():  # told by the files' footers; nothing need be shuffled then
        joined = listed.withColumns(dict.fromkeys(sums, F.lit(None).cast("long")))
    else:
        details = detailed.groupBy(*state.source).agg(*[total.alias(name) for name, total in sums.items()])
        joined = listed.join(details, list(state.source), "left")

    def detail(name):
        return F.when(F.col("bare"), F.coalesce(f"detail_{name}", F.lit(0))).otherwise(0)

    total = F.col("total") + detail("total")
    return joined.select(
        *state.key,
        F.greatest("refs", detail("refs")).alias("refs"),
        total.alias("total"),
        (F.col("hits") + detail("hits")).alias("hits"),
        (total == 0).alias("pending"),
    )


def in_scope(rows: DataFrame, clients: DataFrame | None) -> DataFrame:
    """The rows of the clients looked at now; of all without any."""
    if clients is None:
        return rows
    return only_found(rows, whole(clients.select(*CLIENT_KEY)), CLIENT_KEY)


# The two phases -------------------------------------------------------------------------
def policy_state(spark: SparkSession, folder: str) -> EdgeCounts:
    return EdgeCounts(spark, f"{folder}/policies", tuple(POLICY_KEY), tuple(ROLE_KEY))


def permission_state(spark: SparkSession, folder: str) -> EdgeCounts:
    return EdgeCounts(spark, f"{folder}/permissions", tuple(PERMISSION_KEY), tuple(POLICY_KEY), ("type",))


def _listed_roles(page: DataFrame) -> DataFrame:
    mine = policies_of_type(page, fixed.ROLE_POLICY).select(*POLICY_KEY, "config")
    rows = explode_listed(with_role_ids(mine).drop("config"), "role_ids", "role_id")
    return rows.withColumn("origin", F.lit(LISTED))


def _detailed_roles(page: DataFrame) -> DataFrame:
    ids = first_with_ids(
        decode_role_ids(F.col("config").getItem(fixed.ROLES_KEY)), clean_ids(F.col("roles").getField("id"))
    )
    rows = explode_listed(page.select(*POLICY_KEY, ids.alias("role_ids")), "role_ids", "role_id")
    return rows.withColumn("origin", F.lit(DETAIL))


def _listed_policies(page: DataFrame) -> DataFrame:
    mine = policies_of_type(page, *fixed.PERMISSION_TYPES).select(
        *CLIENT_KEY, F.col("policy_id").alias("permission_id"), "type", "config"
    )
    rows = explode_listed(with_assoc_ids(mine).drop("config"), "policy_ids", "policy_id")
    return rows.withColumn("origin", F.lit(LISTED))


def _associated_policies(page: DataFrame) -> DataFrame:
    usable = page.filter(F.col("policy_id") != "").select(*PERMISSION_KEY, "policy_id")
    # An association is one reference, so how many a permission has is a sum, not said by each.
    more = {"refs": F.lit(0).cast("long"), "origin": F.lit(DETAIL), "type": F.lit(None).cast("string")}
    return usable.withColumns(more)


def advance_policies(state: EdgeCounts, roles: DataFrame, pages: DataFrame, details: DataFrame | None = None) -> int:
    """Take in new policy and detail pages, and what has changed among ``roles``."""
    streams = {"policy": (pages, _listed_roles)}
    if details is not None:
        streams["detail"] = (details, _detailed_roles)
    return advance(state, roles, streams)


def advance_permissions(
    state: EdgeCounts, dead: DataFrame, pages: DataFrame, associations: DataFrame | None = None
) -> int:
    """Take in new permission and association pages, and what has changed among ``dead`` policies."""
    streams = {"permission": (pages, _listed_policies)}
    if associations is not None:
        streams["association"] = (associations, _associated_policies)
    return advance(state, dead, streams)


def dead_policies_of(state: EdgeCounts, clients: DataFrame | None, run: int | None = None) -> DataFrame:
    """Policies of ``clients`` with references of which none is an existing role."""
    dead = counts_of(state, run).filter((F.col("total") > 0) & (F.col("hits") == 0))
    return in_scope(dead, clients).select(*POLICY_KEY, "refs")


def dead_permissions_of(state: EdgeCounts, clients: DataFrame | None, run: int | None = None) -> DataFrame:
    """Permissions of ``clients`` with associations of which every one is a dead policy."""
    dead = counts_of(state, run).filter((F.col("total") > 0) & (F.col("hits") == F.col("total")))
    refs = F.when(F.col("refs") > 0, F.col("refs")).otherwise(F.col("total")).alias("refs")
    return in_scope(dead, clients).select(*PERMISSION_KEY, "type", refs)


def pending_records(state: EdgeCounts, clients: DataFrame | None, run: int | None = None) -> DataFrame:
    """Records of ``clients`` that wait for a detail: exported without a list, and none has come."""
    return in_scope(counts_of(state, run).filter("pending"), clients).select(*state.key)
