"""Soft-membership mixing: document rates whose expected domain tokens meet target weights."""

import json
import math
import warnings
from typing import NamedTuple

import numpy as np
from pyspark.sql import functions as F

from confwarden.session import land, work_folder

TARGETS = {"good": 0.9, "low": 0.08, "toxic": 0.02}
WORD_GAP = r"[\x20\x09-\x0D]+"
PLAIN_GAP = r"[^\p{L}\p{N}]+"


def label_domains(labels):
    """``doc_id, domain`` of the labels table: toxic, else low or good by quality.

    Rows of one id are joined: toxic if one says so, low if one says so.  Rows without an id
    or without both marks teach nothing.
    """
    one = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"), F.min("quality").alias("quality")
    )
    domain = (
        F.when(F.col("toxic") == 1, F.lit("toxic"))
        .when(F.col("quality") == 0, F.lit("low"))
        .when(F.col("quality") == 1, F.lit("good"))
    )
    return one.select("doc_id", domain.alias("domain")).where("domain IS NOT NULL")


def tokens(text):
    """The distinct words of a text: as written, and lower-cased runs of letters and digits."""
    plain = F.split(F.lower(text), PLAIN_GAP, -1)
    return F.array_distinct(F.filter(F.concat(F.split(text, WORD_GAP, -1), plain), lambda x: x != ""))


class Model(NamedTuple):
    """A Bernoulli model of domains: log odds ``weights[domain][token]`` of a token's presence.

    ``biases`` hold a domain's prior and the absence of all tokens; ``hashes`` place the tokens.
    """

    domains: list
    biases: list
    tokens: list
    weights: list
    hashes: list


def fit_classifier(spark, docs, labelled, fit_rows=20_000, least_rows=3, least_ratio=4.0, most_domains=64):
    """A naive Bayes ``Model`` of the domains in ``labelled`` (doc_id, domain).

    Fitted on a bounded sample: the ``fit_rows`` labelled documents with the least hash of
    their id, read whole.  Its tokens are all that occur in ``least_rows`` documents or more and
    whose presence, told by domain, raises the likelihood by more than the Bayesian information
    criterion asks for the added parameters (half the logarithm of the rows for each domain but
    one), and of these the ones that some domain has ``least_ratio`` times as often as the rest:
    with many rows, thousands of common words hang a little on a domain, with the length of its
    texts for instance, and a model that takes words for independent would add that up.  A
    text's likelihood counts the tokens that it has and those that it lacks.

    A probability of each domain goes with each document, so there is a bound on their number:
    more than ``most_domains`` labels raise ``ValueError``.  Without labels, or texts for them,
    the only domain is ``all``.
    """
    ids = labelled.orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(fit_rows)
    rows = (
        docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(ids), "doc_id")
        .select("domain", F.explode(F.array_append(tokens(F.col("text")), F.lit(""))).alias("token"))
    )  # the empty token stands for the document
    counts = land(rows.groupBy("token", "domain").agg(F.count("*").alias("n")), work_folder(spark, "token-counts"))
    sizes = {r.domain: r.n for r in counts.where("token = ''").limit(most_domains + 1).collect()}
    if len(sizes) > most_domains:
        raise ValueError(f"more than {most_domains} domains are labelled")
    if not sizes:
        return Model(["all"], [0.0], [], [[]], [])
    domains, total = sorted(sizes), sum(sizes.values())
    each = [F.sum(F.when(F.col("domain") == d, F.col("n")).otherwise(0)).alias(f"n{i}") for i, d in enumerate(domains)]
    found = sum(F.col(f"n{i}") for i in range(len(domains)))
    table = counts.where("token <> ''").groupBy("token").agg(*each).withColumn("found", found)
    table = table.where((F.col("found") >= least_rows) & (F.col("found") < total))

    def term(n, expected):
        return F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)

    gain = F.lit(0.0)
    for i, d in enumerate(domains):
        share = sizes[d] / total
        n = F.col(f"n{i}").cast("double")
        gain += term(n, F.col("found") * share) + term(sizes[d] - n, (total - F.col("found")) * share)
    price = (len(domains) - 1) / 2 * math.log(total)
    rates = [(F.col(f"n{i}") + 0.5) / (sizes[d] + 1.0) for i, d in enumerate(domains)]
    others = [(F.col("found") - F.col(f"n{i}") + 0.5) / (total - sizes[d] + 1.0) for i, d in enumerate(domains)]
    apart = F.greatest(*[a / b for a, b in zip(rates, others, strict=True)], F.lit(0.0))
    best = table.where((F.round(gain, 6) > price) & (F.round(apart, 6) >= least_ratio)).withColumn("hash", F.xxhash64("token")).orderBy("token").collect()
    size = np.array([sizes[d] for d in domains], float)[:, None]
    n = np.array([[r[f"n{i}"] for r in best] for i in range(len(domains))], float).reshape(len(domains), -1)
    has = (n + 0.5) / (size + 1)
    biases = np.log(size[:, 0] / total) + np.log1p(-has).sum(axis=1)
    weights = np.log(has / (1 - has)).round(6).tolist()
    return Model(domains, biases.round(6).tolist(), [r.token for r in best], weights, [r.hash for r in best])


def _slots(hashes):
    """A place for each hash in a table, one of two that follow from it: ``(size, places)``.

    A hash whose places are taken moves another to its other place; if that goes round, the
    table grows.
    """
    size = 2 * len(hashes) + 1
    while True:
        owner = {}
        for i in range(len(hashes)):
            at, turn = hashes[i] % size, i
            for _ in range(4 * size.bit_length() + 8):
                owner[at], turn = turn, owner.get(at)
                if turn is None:
                    break
                ways = hashes[turn] % size, (hashes[turn] >> 32) % size
                at = ways[1] if at == ways[0] else ways[0]
            else:
                break
        else:
            return size, {i: at for at, i in owner.items()}
        size += size // 2 + 1


def _literal(values, kind):
    """A constant array column, written as one text."""
    return F.split(F.lit(" ".join(map(str, values))), " ").cast(f"array<{kind}>")


def posteriors(docs, model, carry=(), grid=1000):
    """``doc_id, n_tokens, p`` and the columns ``carry`` for each row; ``p`` has all domains.

    Probabilities are rounded to 1 / ``grid`` and add up to 1.  A word finds its weights in one
    of two places of a table, so the work on a word does not grow with the model.
    """
    size, place = _slots(model.hashes)
    slots, weights = [""] * size, [[0.0] * size for _ in model.domains]
    for i, at in place.items():
        slots[at] = model.tokens[i]
        for own, learned in zip(weights, model.weights, strict=True):
            own[at] = learned[i]
    lexicon = _literal(slots, "string")

    def ways(x):
        h = F.xxhash64(x)
        return F.pmod(h, F.lit(size)).cast("int"), F.pmod(F.shiftright(h, 32), F.lit(size)).cast("int")

    def first(x):
        return F.get(lexicon, ways(x)[0]) == x

    text = F.coalesce("text", F.lit(""))
    out = docs.select(
        "doc_id",
        F.size(F.filter(F.split(text, WORD_GAP, -1), lambda x: x != "")).cast("long").alias("n_tokens"),
        F.filter(tokens(text), lambda x: first(x) | (F.get(lexicon, ways(x)[1]) == x)).alias("known"),
        *carry,
    )
    at = F.transform("known", lambda x: F.when(first(x), ways(x)[0]).otherwise(ways(x)[1]))
    out = out.select("doc_id", "n_tokens", at.alias("at"), *carry)

    def score(bias, own):
        own = _literal(own, "double")
        return F.aggregate("at", F.lit(float(bias)), lambda a, x: a + F.get(own, x))

    scores = [score(b, own) for b, own in zip(model.biases, weights, strict=True)]
    out = out.select("doc_id", "n_tokens", F.array(*scores).alias("s"), *carry)
    top = F.array_max("s")
    out = out.withColumn("e", F.transform("s", lambda x: F.exp(x - top)))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    out = out.withColumn("q", F.transform("e", lambda x: F.round(x / total * grid).cast("int")))
    others = F.aggregate("q", F.lit(0), lambda a, x: a + x)
    most = F.array_position("q", F.array_max("q")).cast("int")  # takes what rounding leaves
    exact = F.transform(
        "q", lambda x, i: (x + F.when(i == most - 1, grid - others).otherwise(0)) / F.lit(float(grid))
    )
    return out.select("doc_id", "n_tokens", exact.alias("p"), *carry)


class Fit(NamedTuple):
    """Projected gradient steps ``(gradient, momentum)`` and what they came to.

    ``report``: domain, wanted and reached tokens; ``settled``: no further step helps;
    ``reached``: all are met.  Settled but not reached: no non-negative rates meet the targets.
    """

    steps: list
    first: float
    step: float
    report: list
    settled: bool
    reached: bool


def _folded(steps, step_size, rate, ahead):
    """The columns ``rate`` and ``ahead`` after further steps, as a struct."""
    start = F.struct(rate.alias("rate"), ahead.alias("ahead"))
    if not steps:
        return start
    history = F.from_json(
        F.lit(json.dumps([{"g": [float(x) for x in g], "m": m} for g, m in steps])), "array<struct<g:array<double>,m:double>>"
    )

    def one(acc, s):
        slope = F.aggregate(F.arrays_zip(F.col("p").alias("p"), s["g"].alias("g")), F.lit(0.0), lambda a, x: a + x["p"] * x["g"])
        rate = F.greatest(F.lit(0.0), acc["ahead"] - step_size * slope)
        return F.struct(rate.alias("rate"), (rate + s["m"] * (rate - acc["rate"])).alias("ahead"))

    return F.aggregate(history, start, one)


def fit_rates(spark, members, domains, targets, size=1.0, rounds=100, settled=1e-5, landed=10):
    """Projected gradient steps whose rates bring the domains' expected tokens to the targets.

    Minimises the squared distance of expected tokens by domain to the targets, each over the
    domain's share, with non-negative rates that start equal; a rate depends on a document's
    probabilities alone, so documents of equal probabilities move as one and each round is a
    sum over the table of distinct probabilities, which keeps its rates and is written anew
    after every ``landed`` rounds.  Momentum starts anew when a step raised the distance.
    Ends when all domains are within ``settled`` times all tokens, when the slopes prove that no
    rates lower the distance by a thousandth, or after ``rounds``.  Returns a ``Fit``.
    """
    d = len(domains)
    start = F.lit(float(size))
    cells = members.groupBy("p").agg(F.sum("n_tokens").alias("n")).withColumns({"rate": start, "ahead": start})
    cells = land(cells, work_folder(spark, "cells"))
    p = [F.get("p", i) for i in range(d)]
    sums = cells.agg(
        F.sum("n").alias("n"),
        *[F.sum(F.col("n") * p[i]).alias(f"s{i}") for i in range(d)],
        *[F.sum(F.col("n") * p[i] * p[j]).alias(f"m{i}_{j}") for i in range(d) for j in range(i, d)],
    ).first()
    total = float(sums["n"] or 0)
    asked = np.array([float(targets.get(x, 0.0)) for x in domains])
    if not total or not asked.sum():
        report = [(x, 0.0, float(total and sums[f"s{i}"] * size)) for i, x in enumerate(domains)]
        return Fit([], float(size), 1.0, report, True, not any(targets.values()) or not total)
    have = np.array([sums[f"s{i}"] for i in range(d)])
    want = asked / sum(targets.values()) * total * size
    scale = np.where(have > 0, 1 / np.maximum(have, 1e-9), 0.0)
    gram = np.array([[sums[f"m{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
    step = 1 / max(float(np.linalg.eigvalsh(gram * np.sqrt(np.outer(scale, scale))).max()), 1e-12)

    def after(steps):
        return _folded(steps, step, F.col("rate"), F.col("ahead"))

    def taken(steps, slope):
        """Expected tokens by rates and by what is ahead, and the least ``slope`` of a cell."""
        moved = cells.select("n", "p", after(steps).alias("r"))
        sums = [F.sum(F.col("n") * p[i] * F.col(f"r.{field}")) for field in ("rate", "ahead") for i in range(d)]
        found = moved.agg(*sums, F.min(sum(p[i] * float(slope[i]) for i in range(d)))).first()
        return np.array(found[:d], float), np.array(found[d : 2 * d], float), float(found[2 * d])

    def distance(now):
        return float((scale * (now - want) ** 2).sum())

    done, steps, momentum = [], [], 0
    now, ahead, before = have * size, have * size, math.inf
    met = stuck = False
    for _ in range(rounds):
        met = np.abs(now - want).max() <= settled * total * size
        if met:
            break
        slope = (now - want) * scale
        momentum = 0 if distance(now) > before else momentum + 1
        before = distance(now)
        steps.append(((ahead - want) * scale, max(0, momentum - 1) / (momentum + 2)))
        new, further, least = taken(steps, slope)
        # By convexity no rates are nearer to the targets than by this much.
        gap = float(now @ slope) + max(0.0, -least) * max(want.sum(), now.sum())
        stuck = 2 * gap <= 1e-3 * distance(now)
        if stuck:
            steps.pop()
            break
        now, ahead = new, further
        if len(steps) == landed:
            moved = after(steps)
            cells = cells.select("p", "n", moved["rate"].alias("rate"), moved["ahead"].alias("ahead"))
            cells = land(cells, work_folder(spark, "cells"))
            done, steps = done + steps, []
    final = now
    met = met or bool(np.abs(now - want).max() <= settled * total * size)
    missed = [x for x, t in targets.items() if t and x not in domains]
    report = list(zip(domains, want.tolist(), final.tolist(), strict=True))
    report += [(x, float(targets[x]) / sum(targets.values()) * total * size, 0.0) for x in missed]
    near = not missed and bool(np.abs(final - want).max() <= max(10 * settled, 1e-4) * total * size)
    return Fit(done + steps, float(size), step, report, bool(met or stuck), near)


class UnmetTargets(ValueError):
    """Targets that the rates do not meet; ``fit`` is the ``Fit``."""

    def __init__(self, fit):
        why = "no non-negative rates meet the targets" if fit.settled else "the fit has not settled"
        parts = (f"{d}: {want:.1f} tokens wanted, {have:.1f} expected" for d, want, have in fit.report)
        super().__init__(f"{why}; {', '.join(parts)}")
        self.fit = fit


def mix_to_targets(spark, docs, labelled, targets=None, size=1.0, carry=(), grid=1000, unmet="warn", **fit):
    """``doc_id, n_tokens, domain, p, rate`` (and ``carry``), one row per row of ``docs``.

    A classifier learned from ``labelled`` (doc_id, domain) gives each document probabilities
    of the domains; ``rate`` is how often it is to be drawn, non-negative, such that the sum of
    rate times tokens times probability comes to the target weights (scaled to 1) times
    ``size`` times all tokens, as near as non-negative rates allow.  Built-in functions only.

    Targets may be out of reach, because no label names the domain or because no document is
    likely enough to be of it.  The rates then come as near as they can, and ``unmet`` says what
    happens: ``warn`` (what was wanted and reached, as a warning), ``raise`` ``UnmetTargets``,
    or ``ignore``.  The same holds for a fit that has not settled.

    Null and empty texts have no tokens; their probabilities follow from the tokens they lack.
    Without labels all documents are of the domain ``all`` with rate ``size``; without documents
    there are no rows.  Rows that repeat get equal rates.
    """
    if unmet not in ("warn", "raise", "ignore"):
        raise ValueError(f"unmet: {unmet}")
    names = {c: f"carried_{i}" for i, c in enumerate(carry)}
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(c).alias(n) for c, n in names.items()])
    model = fit_classifier(spark, docs, labelled, **fit)
    domains = model.domains
    members = land(posteriors(docs, model, list(names.values()), grid), work_folder(spark, "members"))
    fitted = fit_rates(spark, members, domains, targets or TARGETS, size)
    if domains != ["all"] and unmet != "ignore" and not (fitted.reached and fitted.settled):
        if unmet == "raise":
            raise UnmetTargets(fitted)
        warnings.warn(str(UnmetTargets(fitted)), stacklevel=2)
    # The rate is a function of the probabilities, so no join is needed to bring it to them.
    start = F.lit(fitted.first)
    rate = F.round(_folded(fitted.steps, fitted.step, start, start)["rate"], 6)
    domain = F.element_at(F.array(*map(F.lit, domains)), F.array_position("p", F.array_max("p")).cast("int"))
    return members.select(
        "doc_id", "n_tokens", domain.alias("domain"), "p", rate.alias("rate"), *[F.col(n).alias(c) for c, n in names.items()]
    )
