"""Substring deduplication: winnowed anchors as seeds, extended to maximal repeats."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from confwarden.llm import words as w
from confwarden.session import land, work_folder

SEED = 6


def anchors(h, length, seed=SEED):
    """Winnowed anchors of a text's word hashes: ``(anchor, context, first, last)``.

    Each window of ``length`` words is owned by the least hash among its runs of ``seed`` words,
    so equal windows are owned by equal anchors at equal offsets.  An anchor owns the windows
    that start at ``first``..``last``; ``context`` hashes all words of these and its place among
    them: equal contexts mean that all the windows owned are equal.
    """
    if len(h) < length:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    running = w.sums(h)
    start = np.arange(len(h) - seed + 1)
    runs = w.stretch(running, start, start + seed)
    owner = np.lib.stride_tricks.sliding_window_view(runs, length - seed + 1).argmin(axis=1)
    owner += np.arange(len(owner))
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    last = np.append(first[1:], len(owner)) - 1
    at = owner[first]
    place = w.mix((at - first).astype(np.uint64) * np.uint64(1 << 20) + (last - first).astype(np.uint64))
    context = w.mix(w.stretch(running, first, last + length) ^ place)
    return runs[at], context, first, last


def _anchors(length, whole):
    """All anchors of a text; ``whole``: with contexts and places, else the anchors alone."""

    def run(batches):
        for batch in w.slices(batches, 1):
            found = [anchors(w.hashes(t.split()), length) for t in w.texts(batch.column(1))]
            if not found:
                continue
            columns = [np.concatenate(c) for c in zip(*found, strict=True)]
            out = [pa.array(w.signed(columns[0]))]
            names = ["anchor", "context", "doc_id", "first", "last"]
            if whole:
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found])))
                out += [pa.array(w.signed(columns[1])), ids, *(pa.array(c.astype(np.int32)) for c in columns[2:])]
            yield pa.RecordBatch.from_arrays(out, names[: len(out)])

    return run


ANCHOR = "anchor long, context long, doc_id long, first int, last int"


def _windows(length):
    """The windows of the runs that come with a text, by two hashes and place."""

    def run(batches):
        for batch in w.slices(batches, 1):
            one, two, rows, starts = [], [], [], []
            runs = batch.column(2).to_pylist()
            for i, text in enumerate(w.texts(batch.column(1))):
                a, b = w.window_pairs(w.hashes(text.split()), length)
                at = np.concatenate([np.arange(r["first"], r["last"] + 1) for r in runs[i]])
                one.append(a[at])
                two.append(b[at])
                starts.append(at)
                rows.append(np.full(len(at), i))
            if not rows:
                continue
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(w.signed(np.concatenate(one))),
                    pa.array(w.signed(np.concatenate(two))),
                    batch.column(0).take(pa.array(np.concatenate(rows))),
                    pa.array(np.concatenate(starts).astype(np.int32)),
                ],
                ["one", "two", "doc_id", "start"],
            )

    return run


def merged(spans):
    """Sorted spans with those that touch or overlap made one: the maximal repeats."""
    out = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _kept(length):
    def run(batches):
        for batch in w.slices(batches, 1):
            sizes, removed, digests, repeats = [], [], [], []
            for text, starts in zip(w.texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = text.split()
                spans = merged((r["first"], r["last"] + length) for r in starts or ())
                keep, at = [], 0
                for a, b in spans:
                    keep += words[at:a]
                    at = b
                keep += words[at:]
                sizes.append(len(words))
                removed.append(len(words) - len(keep))
                digests.append(hashlib.sha256(b" ".join(keep)).hexdigest())
                repeats.append([{"start": a, "end": b} for a, b in spans])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(repeats, kind)],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "repeats"],
            )

    return run


def repeated_runs(spark, docs, length=20):
    """``doc_id, first, last``: starts of windows whose words also start earlier.

    Earlier is a smaller doc_id, or a smaller start in the same document.  ``docs``: doc_id
    (not null) and text.
    """
    text = docs.select("doc_id", "text")
    often = land(
        text.mapInArrow(_anchors(length, False), "anchor long")
        .groupBy("anchor")
        .count()
        .where("count > 1")
        .select("anchor"),
        work_folder(spark, "often"),
    )
    seen = land(
        text.mapInArrow(_anchors(length, True), ANCHOR).join(often, "anchor"), work_folder(spark, "seen")
    )
    # Occurrences of an anchor in the same context: all windows of all but the first repeat.
    classes = land(
        seen.groupBy("anchor", "context").agg(
            F.min(F.struct("doc_id", "first", "last")).alias("lead"), F.count("*").alias("n")
        ),
        work_folder(spark, "contexts"),
    )
    again = classes.where("n > 1").select("anchor", "context", "lead")
    follows = (F.col("doc_id") != F.col("lead.doc_id")) | (F.col("first") != F.col("lead.first"))
    whole = seen.join(again, ["anchor", "context"]).where(follows).select("doc_id", "first", "last")
    # One occurrence of each context, where an anchor has several: extended word by word.
    several = land(
        classes.groupBy("anchor").count().where("count > 1").select("anchor"), work_folder(spark, "several")
    )
    open_runs = (
        classes.join(several, "anchor", "left_semi")
        .select("lead.*")
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    )
    windows = land(
        text.join(open_runs, "doc_id").select("doc_id", "text", "runs").mapInArrow(
            _windows(length), "one long, two long, doc_id long, start int"
        ),
        work_folder(spark, "windows"),
    )
    firsts = land(
        windows.groupBy("one", "two")
        .agg(F.min(F.struct("doc_id", "start")).alias("lead"), F.count("*").alias("n"))
        .where("n > 1")
        .select("one", "two", "lead"),
        work_folder(spark, "firsts"),
    )
    follows = (F.col("doc_id") != F.col("lead.doc_id")) | (F.col("start") != F.col("lead.start"))
    part = windows.join(firsts, ["one", "two"]).where(follows)
    return whole.union(part.select("doc_id", F.col("start").alias("first"), F.col("start").alias("last")))


def remove_repeats(spark, docs, length=20, id_col="doc_id", text_col="text"):
    """Words left after repeats of ``length`` words or more go, except where they come first.

    Returns ``doc_id, n_words, n_removed, kept_sha256, repeats`` for each row of ``docs``.
    Words are runs of other than ASCII white space; a word goes if a window of ``length`` words
    around it also starts earlier.  ``repeats`` are the maximal runs of such words.

    Anchors are counted first, so only those that occur twice are joined; a group of their
    occurrences is summed by context and never forms pairs.  Contexts that differ share at
    most part of their windows; these are compared as windows, each by 128 bits.  Null and
    empty texts have no words.  Rows with a null id are left whole and make no other row a
    repeat.  Rows that repeat an id count as one document: those of equal text are treated
    alike, and ids are expected to be unique otherwise.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    runs = repeated_runs(spark, known, length).groupBy("doc_id").agg(
        F.collect_list(F.struct("first", "last")).alias("runs")
    )
    return docs.join(runs, "doc_id", "left").select("doc_id", "text", "runs").mapInArrow(
        _kept(length),
        "doc_id long, n_words long, n_removed long, kept_sha256 string, repeats array<struct<start:long,end:long>>",
    )
