"""Toxicity: a logistic classifier that swapping identity terms must not move."""

import math
import re
from collections import Counter, defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from confwarden.llm import words as w
from confwarden.session import land, work_folder

# Terms that name groups of people, by language and form; the first is neutral.
IDENTITY = (
    ("person", "woman", "man", "muslim", "christian", "jew", "hindu", "buddhist", "atheist", "immigrant", "refugee", "foreigner", "lesbian"),
    ("people", "women", "men", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "immigrants", "refugees", "foreigners", "lesbians"),
    ("human", "female", "male", "jewish", "black", "white", "asian", "african", "latino", "arab", "gay", "straight", "bisexual", "transgender", "disabled", "deaf", "blind"),
    ("personen", "frauen", "männer", "muslime", "christen", "juden", "hindus", "migranten", "flüchtlinge", "ausländer", "lesben", "schwule", "schwarze"),
    ("personnes", "femmes", "hommes", "musulmans", "chrétiens", "juifs", "hindous", "immigrés", "réfugiés", "étrangers", "lesbiennes", "homosexuels", "noirs"),
    ("personas", "mujeres", "hombres", "musulmanes", "cristianos", "judíos", "hindúes", "inmigrantes", "refugiados", "extranjeros", "lesbianas", "homosexuales", "negros"),
)

#: Lengths in bytes of the beginnings of words that count as features.
BEGINNINGS = (4, 5, 6, 7, 8)
SENTENCE_END = re.compile(rb"[.!?\n]+")

FLUSH = 200_000
CACHED = 200_000


class Model(NamedTuple):
    """Weights of features; ``report`` has what the fit came to."""

    features: list
    weights: list
    bias: float
    report: dict


def words_of(text):
    """The distinct words of UTF-8 bytes: letters and digits, A-Z lower-cased."""
    return set(text.translate(w.ALNUM).split())


def features_of(word):
    """The features of a word: itself, with a blank behind it, and its beginnings."""
    ended = word + b" "
    return {ended, *(ended[:n] for n in BEGINNINGS)}


class Lookup:
    """The numbers of the known features of words, remembered for recent words."""

    def __init__(self, features):
        self.number = {x: i for i, x in enumerate(features)}
        self.held = {}

    def word(self, word):
        have = self.held.get(word)
        if have is None:
            if len(self.held) >= CACHED:
                self.held.clear()
            have = self.held[word] = tuple(sorted(self.number[x] for x in features_of(word) if x in self.number))
        return have

    def words(self, words):
        """The distinct numbers of some words, sorted."""
        return sorted({i for x in words for i in self.word(x)})


# Learning -------------------------------------------------------------------------------
def toxic_labels(labels):
    """``doc_id, toxic`` (0 or 1) of the labels table; of several rows of an id, the largest mark."""
    marked = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    return marked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))


def _count(batches):
    """Rows of each class that have a feature; partial counts, flushed at a fixed size."""
    counts = defaultdict(lambda: [0, 0])

    def flush():
        pairs = list(counts.values())
        out = [pa.array(list(counts), pa.binary()), *(pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1))]
        counts.clear()
        return pa.RecordBatch.from_arrays(out, ["feature", "n0", "n1"])

    for batch in w.slices(batches, 1):
        for toxic, text in zip(batch.column(0).to_pylist(), w.texts(batch.column(1)), strict=True):
            for x in set().union(*map(features_of, words_of(text))):
                counts[x][toxic] += 1
            if len(counts) >= FLUSH:
                yield flush()
    yield flush()


def _encode(features):
    """``toxic, at``: the features that each text has."""

    def run(batches):
        lookup = Lookup(features)
        for batch in w.slices(batches, 1):
            at = [lookup.words(words_of(text)) for text in w.texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.list_(pa.int32()))], ["toxic", "at"])

    return run


def swaps(text, groups):
    """Each sentence of a text with an identity term: its other words, the term and its substitute."""
    for sentence in SENTENCE_END.split(text):
        words = words_of(sentence)
        for term in words & groups.keys():
            for others in groups[term]:
                for other in others:
                    if other != term:
                        yield words - {term}, term, other


def identity_groups(identity):
    """The groups of each term, as bytes; a term may belong to several."""
    groups = defaultdict(list)
    for group in identity:
        group = [x.encode() for x in group]
        for term in group:
            groups[term].append(group)
    return dict(groups)


def _swapped(features, identity):
    """``gained, lost, n``: the features that swaps add and take away, and how many swaps do."""

    def run(batches):
        lookup, groups, found = Lookup(features), identity_groups(identity), Counter()
        for batch in w.slices(batches, 0):
            for text in w.texts(batch.column(0)):
                for rest, term, other in swaps(text, groups):
                    same = set(lookup.words(rest))
                    old, new = set(lookup.word(term)) - same, set(lookup.word(other)) - same
                    found[tuple(sorted(new - old)), tuple(sorted(old - new))] += 1
        ints = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([list(a) for a, _ in found], ints),
                pa.array([list(b) for _, b in found], ints),
                pa.array(list(found.values()), pa.int64()),
            ],
            ["gained", "lost", "n"],
        )

    return run


def _partial(weights, row_weights):
    """The loss over a task's rows and its gradient; the last weight is the bias."""

    def run(batches):
        value, slope = 0.0, np.zeros(len(weights))
        for batch in batches:
            toxic = batch.column(0).to_numpy(zero_copy_only=False)
            at = batch.column(1)
            sizes = np.diff(at.offsets.to_numpy())
            flat = at.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(toxic)), sizes)
            logit = weights[-1] + np.bincount(row, weights[flat], len(toxic))
            mine = np.where(toxic == 1, row_weights[1], row_weights[0])
            value += float(mine @ np.logaddexp(0, np.where(toxic == 1, -logit, logit)))
            off = mine * (1 / (1 + np.exp(-logit)) - toxic)
            slope[:-1] += np.bincount(flat, off[row], len(weights) - 1)
            slope[-1] += off.sum()
        yield pa.RecordBatch.from_arrays(
            [pa.array([value]), pa.array([slope.tobytes()], pa.binary())], ["value", "slope"]
        )

    return run


def minimise(function, start, rounds, settled, memory=10):
    """A minimum of a smooth convex ``function`` (value and gradient) by L-BFGS.

    Steps are halved until they lower the value enough.  Returns the place, its value, the
    number of steps, and whether the gradient came below ``settled`` times the start's.
    """
    x = start
    value, slope = function(x)
    goal = settled * max(1.0, float(np.abs(slope).max(initial=0)))
    pairs, step = [], 0
    while step < rounds and np.abs(slope).max(initial=0) > goal:
        step += 1
        direction, used = slope.copy(), []
        for s, y in reversed(pairs):
            a = (s @ direction) / (s @ y)
            direction -= a * y
            used.append(a)
        if pairs:
            s, y = pairs[-1]
            direction *= (s @ y) / (y @ y)
        else:
            direction /= max(1.0, float(np.linalg.norm(slope)))
        for (s, y), a in zip(pairs, reversed(used), strict=True):
            direction += s * (a - (y @ direction) / (s @ y))
        size = 1.0
        while True:
            there = x - size * direction
            new, turned = function(there)
            if new <= value - 1e-4 * size * (slope @ direction) or size < 1e-8:
                break
            size /= 2
        if (turned - slope) @ (there - x) > 1e-12:
            pairs = [*pairs[1 - memory :], (there - x, turned - slope)]
        if new >= value:
            break
        x, value, slope = there, new, turned
    return x, value, step, bool(np.abs(slope).max(initial=0) <= goal)


def fit(
    spark,
    docs,
    labelled,
    rows_per_class=6000,
    least_rows=8,
    least_gain=25.0,
    ridge=0.05,
    pull=1.0,
    identity=IDENTITY,
    rounds=100,
    settled=1e-4,
    id_col="doc_id",
    text_col="text",
):
    """A ``Model`` learned from ``labelled`` (doc_id, toxic) and the texts of ``docs``.

    Fitted on a bounded sample: of each class the ``rows_per_class`` ids with the least hash,
    one text each (the least, if an id repeats), read whole; rows are weighted so that the
    classes count as in all labelled rows.  Features are words and their beginnings in
    ``least_rows`` texts or more whose presence depends on the class by a log likelihood ratio
    of ``least_gain`` or more, which chance hardly gives; all of these are taken.

    The loss is that of logistic regression plus ``ridge`` / 2 times the squared weights, plus
    ``pull`` times the number of rows times the mean squared change of the log odds when an
    identity term of a labelled sentence is swapped for another of its group or the neutral
    one.  Each step of the minimisation is one Spark job over the encoded sample; the driver
    holds the weights only.  ``report`` says whether it settled within ``rounds`` steps.

    Without labelled texts the score is 0 for all, with one class a constant near it.
    """
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = labelled.join(texts.select("doc_id"), "doc_id", "left_semi")
    known = land(known.select("doc_id", "toxic"), work_folder(spark, "labelled"))
    totals = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not totals:
        return Model([], [], -math.inf, {"rows": 0, "settled": True})
    prior = math.log((totals.get(1, 0) + 0.5) / (totals.get(0, 0) + 0.5))
    if len(totals) == 1:
        return Model([], [], prior, {"rows": sum(totals.values()), "settled": True})

    chosen = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class) for c in (0, 1)]
    sample = (
        texts.join(chosen[0].union(chosen[1]), "doc_id")
        .groupBy("doc_id", "toxic")
        .agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
        .select("toxic", "text")
    )
    sample = land(sample, work_folder(spark, "sample"))
    sizes = [min(totals[c], rows_per_class) for c in (0, 1)]
    n, all_rows = sum(sizes), sum(totals.values())
    row_weights = [totals[c] / all_rows * n / sizes[c] for c in (0, 1)]

    counts = sample.mapInArrow(_count, "feature binary, n0 long, n1 long").groupBy("feature")
    counts = counts.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n0") + F.col("n1") >= least_rows)

    def term(seen, expected):
        return F.when(seen > 0, 2 * seen * F.log(seen / expected)).otherwise(0.0)

    found, gain = (F.col("n0") + F.col("n1")).cast("double"), F.lit(0.0)
    for c in (0, 1):
        seen = F.col(f"n{c}").cast("double")
        gain += term(seen, found * sizes[c] / n) + term(sizes[c] - seen, (n - found) * sizes[c] / n)
    features = sorted(bytes(r.feature) for r in counts.where(gain >= least_gain).select("feature").collect())

    rows = land(sample.mapInArrow(_encode(features), "toxic int, at array<int>"), work_folder(spark, "encoded"))
    changes = (
        sample.select("text")
        .mapInArrow(_swapped(features, identity), "gained array<int>, lost array<int>, n long")
        .groupBy("gained", "lost")
        .agg(F.sum("n").alias("n"))
        .orderBy("gained", "lost")
        .collect()
    )
    swapped = sum(r.n for r in changes)
    moves = np.zeros((len(changes), len(features) + 1))
    for i, r in enumerate(changes):
        moves[i, r.gained], moves[i, r.lost] = 1, -1
    share = np.array([r.n / swapped for r in changes])

    def loss(x):
        parts = rows.mapInArrow(_partial(x, row_weights), "value double, slope binary").collect()
        value = math.fsum(p.value for p in parts)
        slope = np.sum([np.frombuffer(p.slope) for p in parts], axis=0)
        shift = moves @ x
        value += ridge / 2 * float(x[:-1] @ x[:-1]) + pull * n * float(share @ shift**2)
        slope = slope + ridge * np.append(x[:-1], 0) + 2 * pull * n * ((share * shift) @ moves)
        return value, slope

    x, value, steps, done = minimise(loss, np.append(np.zeros(len(features)), prior), rounds, settled)
    change = float(share @ (moves @ x) ** 2) if swapped else 0.0
    report = {"rows": n, "steps": steps, "settled": done, "loss": value, "swaps": swapped, "squared_change": change}
    return Model(features, x[:-1].tolist(), float(x[-1]), report)


# Scoring --------------------------------------------------------------------------------
def _score(shared, threshold):
    def run(batches):
        model = shared.value
        lookup, weights = Lookup(model.features), model.weights
        for batch in w.slices(batches, 1):
            scores = []
            for text in w.texts(batch.column(1)):
                logit = model.bias + math.fsum(weights[i] for i in lookup.words(words_of(text)))
                scores.append(round(1 / (1 + math.exp(-max(-700.0, min(700.0, logit)))), 6))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= threshold) for s in scores], pa.int32()),
                ],
                ["doc_id", "score", "predicted"],
            )

    return run


def toxicity(docs, model, threshold=0.7, id_col="doc_id", text_col="text"):
    """``doc_id, score, predicted`` of each row of ``docs``, from its text alone.

    ``score`` is the probability of label 1 that ``model`` gives, ``predicted`` 1 from
    ``threshold`` on.  Null and empty texts have no features, so their score is the model's
    bias; rows that repeat score alike, and a null id stays null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(
        _score(shared, threshold), "doc_id long, score double, predicted int"
    )


def held_out(id_col="doc_id"):
    """The fold that is never learned from."""
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


def held_out_scores(spark, docs, labels):
    """Learn from documents outside the held-out fold, score all of them.

    A null id is of no fold: held_out is false, and nothing is learned from it.
    """
    model = fit(spark, docs.where(~held_out()), toxic_labels(labels).where(~held_out()))
    return toxicity(docs, model).withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
