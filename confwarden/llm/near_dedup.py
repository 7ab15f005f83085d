"""Near-duplicate groups by one-permutation MinHash, banded buckets and star-shaped edges."""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from confwarden.llm import words as w
from confwarden.llm.components import components
from confwarden.session import land, work_folder

BANDS, ROWS = 40, 6
BLOCK_ROWS, BLOCK_SHINGLES = 256, 1 << 16


def donors(bins):
    """For each bin a fixed random order of all bins, asked in turn when the bin is empty."""
    return np.random.default_rng(20170806).permuted(np.tile(np.arange(bins), (bins, 1)), axis=1)


def signature(s, bins, order):
    """One-permutation MinHash of a sorted non-empty set, densified.

    The upper bits of a hash choose its bin, so the first hash in a bin is its minimum.  An
    empty bin takes the value of the first filled bin of its own random order, which makes
    each bin of two sets agree with probability equal to their Jaccard similarity.
    """
    at = ((s >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    first = np.flatnonzero(np.diff(at, prepend=np.uint64(bins)))
    filled = np.zeros(bins, bool)
    out = np.zeros(bins, np.uint64)
    filled[at[first]], out[at[first]] = True, s[first]
    empty = np.flatnonzero(~filled)
    for lo, hi in ((0, 8), (8, 64), (64, bins)):
        if not len(empty):
            break
        asked = order[empty, lo:hi]
        ok = filled[asked]
        pick = ok.argmax(axis=1)
        rows = np.flatnonzero(ok[np.arange(len(empty)), pick])
        out[empty[rows]] = out[asked[rows, pick[rows]]]
        empty = np.delete(empty, rows)
    return out


def band_keys(sig, bands, rows):
    factors = w.mix(np.arange(1, rows + 1, dtype=np.uint64))
    keys = (sig.reshape(bands, rows) * (factors | np.uint64(1))).sum(axis=1, dtype=np.uint64)
    return w.mix(keys + w.mix(np.arange(1, bands + 1, dtype=np.uint64)))


def word_set(text, k):
    return w.shingles(w.hashes(text.lower().split()), k)


def _sketches(k, bands, rows):
    def run(batches):
        order = donors(bands * rows)
        for batch in w.slices(batches, 1):
            sizes, digests, keys = [], [], []
            for text in w.texts(batch.column(1)):
                s = word_set(text, k)
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig = band_keys(signature(s, bands * rows, order), bands, rows) if len(s) else None
                keys.append(w.signed(sig) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "digest", "bands"],
            )

    return run


def _sets(k):
    def run(batches):
        for batch in w.slices(batches, 1):
            sets = [word_set(t, k).tobytes() for t in w.texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sets, pa.binary())], ["doc_id", "members"]
            )

    return run


def _confirm(percent):
    def run(batches):
        for batch in w.slices(batches, 2, 3):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(
                [c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"]
            )

    return run


def _verified(spark, sets, pairs, percent):
    """The pairs whose full sets are similar enough."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("members").alias("left"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("members").alias("right"))
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "left", "right")
    return land(both.mapInArrow(_confirm(percent), "a long, b long"), work_folder(spark, "confirmed"))


def _links(percent):
    """Links between different components in one block of a bucket, by full sets.

    All pairs are compared.  Of those that are similar enough, one is given for each stray and
    component: any of them joins the two.
    """

    def run(table):
        stray = table.column("stray").to_numpy(zero_copy_only=False)
        ids, labels = table.column("doc_id").to_numpy(), table.column("label").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("members").to_pylist()]
        left, right = np.flatnonzero(stray), np.flatnonzero(~stray)
        found = {}
        if len(left) and len(right):
            sizes = np.array([len(s) for s in sets])
            vocabulary, place = np.unique(np.concatenate([sets[i] for i in left]), return_inverse=True)
            holds = np.zeros((len(vocabulary), len(left)), np.uint8)
            holds[place, np.repeat(np.arange(len(left)), sizes[left])] = 1
            for j in right:
                at = np.minimum(np.searchsorted(vocabulary, sets[j]), len(vocabulary) - 1)
                both = holds[at[vocabulary[at] == sets[j]]].sum(axis=0, dtype=np.int64)
                ok = 100 * both >= percent * (sizes[left] + sizes[j] - both)
                for i in left[ok & (labels[left] != labels[j])]:
                    found.setdefault((ids[i], labels[j]), ids[j])
        a = np.array([x[0] for x in found], np.int64)
        b = np.array(list(found.values()), np.int64)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def _blocks(size, shingles):
    """How many blocks hold so many documents with so many shingles, in bounded shares."""
    return F.ceil(F.greatest(size / F.lit(BLOCK_ROWS), shingles / F.lit(BLOCK_SHINGLES))).cast("int")


def _stray_links(spark, sets, members, labels, percent):
    """Links between different components that share a bucket.

    In a bucket of several components, every document outside its largest one (a stray) meets
    all others, block by block: strays and documents are dealt into blocks of bounded size,
    and only links leave a block.
    """
    named = members.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "bucket", "doc_id", "n", F.coalesce("component", "doc_id").alias("label")
    )
    named = land(named, work_folder(spark, "named"))
    parts = named.groupBy("bucket", "label").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
    buckets = land(
        parts.groupBy("bucket")
        .agg(
            F.count("*").alias("parts"),
            F.max(F.struct("size", "label", "shingles")).alias("top"),
            F.sum("size").alias("size"),
            F.sum("shingles").alias("shingles"),
        )
        .where("parts > 1")
        .select(
            "bucket",
            F.col("top.label").alias("main"),
            _blocks(F.col("size") - F.col("top.size"), F.col("shingles") - F.col("top.shingles")).alias("blocks"),
            _blocks(F.col("size"), F.col("shingles")).alias("chunks"),
        ),
        work_folder(spark, "mixed"),
    )
    named = land(named.join(buckets, "bucket"), work_folder(spark, "rest"))
    if named.isEmpty():
        return None
    named = named.withColumn("place", F.struct("main", "blocks", "chunks"))
    rows = (
        named.select("doc_id", "bucket", "label", "place")
        .join(sets.hint("merge"), "doc_id")
        .select("doc_id", "bucket", "label", "place.*", "members")
    )
    deal = F.xxhash64("doc_id")

    def dealt(rows, stray, block, chunk):
        return rows.select("bucket", block.alias("block"), chunk.alias("chunk"), "doc_id", "label", F.lit(stray).alias("stray"), "members")

    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    strays = rows.where("label <> main").withColumn("block", F.pmod(deal, "blocks").cast("int")).withColumn("chunk", every("chunks"))
    others = rows.withColumn("chunk", F.pmod(deal, "chunks").cast("int")).withColumn("block", every("blocks"))
    both = dealt(strays, True, F.col("block"), F.col("chunk")).union(dealt(others, False, F.col("block"), F.col("chunk")))
    pairs = both.groupBy("bucket", "block", "chunk").applyInArrow(_links(percent), "a long, b long")
    return land(pairs.distinct(), work_folder(spark, "pairs"))


def near_duplicates(spark, docs, k=3, percent=85, bands=BANDS, rows=ROWS, id_col="doc_id", text_col="text"):
    """Link documents whose sets of ``k``-word shingles have Jaccard similarity ``percent`` / 100.

    Returns ``doc_id, n_shingles, component_id, kept``, one row per row of ``docs``.

    Words are runs of other than ASCII white space, A-Z lower-cased.  Documents with fewer
    than ``k`` words have their whole sequence as one shingle; those without words or with null
    text have none and are linked with nothing.  Equal sets are one class named by its least
    id, so copies never meet as pairs.  A class goes to ``bands`` buckets; a pair at the
    threshold shares none with a probability of about 1e-8.  Star-shaped edges compare each
    member of a bucket with its least one by full sets.  In buckets that then still hold more
    than one component, whatever is outside the largest is compared with the rest in blocks,
    so no link rests on the choice of a centre.  A null id is linked with nothing:
    component_id null, kept true.  Rows that repeat an id and text stay, all with the same
    result; rows of one id with different texts are compared like others.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketched = land(
        docs.mapInArrow(
            _sketches(k, bands, rows), "doc_id long, n_shingles long, digest binary, bands array<long>"
        ),
        work_folder(spark, "sketches"),
    )
    classes = land(
        sketched.where("digest IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("doc_id")),
        work_folder(spark, "classes"),
    )
    members = (
        sketched.join(classes, ["digest", "doc_id"], "left_semi")
        .select("doc_id", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    )
    centers = land(
        members.groupBy("bucket")
        .agg(F.min(F.struct("doc_id", "n")).alias("c"), F.count("*").alias("size"))
        .where("size > 1")
        .select("bucket", F.col("c.doc_id").alias("center"), F.col("c.n").alias("center_n")),
        work_folder(spark, "buckets"),
    )
    members = land(members.join(centers, "bucket"), work_folder(spark, "members"))
    small, large = F.least("n", "center_n"), F.greatest("n", "center_n")
    pairs = land(
        members.where((F.col("doc_id") != F.col("center")) & (100 * small >= percent * large))
        .select(F.least("doc_id", "center").alias("a"), F.greatest("doc_id", "center").alias("b"))
        .distinct(),
        work_folder(spark, "pairs"),
    )
    # One pass over the texts serves all comparisons: the sets of classes that share a bucket.
    ids = members.select("doc_id").distinct()
    sets = land(
        docs.join(ids.hint("merge"), "doc_id", "left_semi").mapInArrow(_sets(k), "doc_id long, members binary"),
        work_folder(spark, "sets"),
    )
    links = _verified(spark, sets, pairs, percent)
    labels = land(components(spark, links), work_folder(spark, "labels"))
    more = _stray_links(spark, sets, members.select("bucket", "doc_id", "n"), labels, percent)
    if more is not None and not more.isEmpty():
        joined = labels.select("node", "component").union(more)
        labels = land(components(spark, joined), work_folder(spark, "labels"))
    named = land(
        classes.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
            "digest", F.coalesce("component", "doc_id").alias("component_id")
        ),
        work_folder(spark, "named"),
    )
    out = sketched.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(
        F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")
    )
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def keep_first(spark, docs, k=5, percent=80, bands=48, rows=5):
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns.

    Rows that repeat others in every column stay once; rows with a null id all stay.
    """
    names = docs.columns
    kept = (
        near_duplicates(spark, docs, k, percent, bands, rows).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    )
    kept = land(kept, work_folder(spark, "kept"))
    known = docs.where("doc_id IS NOT NULL")
    twice = land(known.groupBy("doc_id").count().where("count > 1").select("doc_id"), work_folder(spark, "twice"))
    out = known.join(kept, "doc_id", "left_semi")
    if not twice.isEmpty():
        once = out.join(twice, "doc_id", "left_semi").dropDuplicates()
        out = out.join(twice, "doc_id", "left_anti").union(once)
    return out.select(*names).union(docs.where("doc_id IS NULL"))
