"""The mixing classifier and its fit against plain computations, and targets out of reach."""

import math
import re
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from confwarden.llm import mixing

SF = "/root/testdata/sf0.001"
GAP = re.compile(r"[\x20\x09-\x0D]+")


def plain_tokens(text):
    plain = "".join(c if c.isalnum() else " " for c in text.lower()).split(" ")
    return {x for x in [*GAP.split(text), *plain] if x}


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs, mixing.label_domains(spark.read.parquet(f"{SF}/labels.parquet"))


def test_classifier_by_its_definition(spark, tables):
    """Tokens chosen and probabilities, counted anew; absent tokens weigh, too."""
    docs, labelled = tables
    odd = [(9001, None), (9002, ""), (9003, "x " * 30_000), (None, "idiot"), (9003, "x " * 30_000)]
    rows = docs.select("doc_id", "text", F.col("source").alias("p")).union(
        spark.createDataFrame(odd, "doc_id long, text string").withColumn("p", F.lit("?"))
    )
    model = mixing.fit_classifier(spark, rows, labelled)
    domain = {r.doc_id: r.domain for r in labelled.collect()}
    all_rows = rows.collect()
    texts = [(domain[r.doc_id], plain_tokens(r.text or "")) for r in all_rows if r.doc_id in domain]
    size = {d: sum(x == d for x, _ in texts) for d in model.domains}
    seen = {}
    for d, words in texts:
        for x in words:
            seen.setdefault(x, dict.fromkeys(model.domains, 0))[d] += 1
    total, chosen = len(texts), {}
    for x, n in seen.items():
        found = sum(n.values())
        if not 3 <= found < total:
            continue
        gain, apart = 0.0, 0.0
        for d in model.domains:
            for a, b in ((n[d], found), (size[d] - n[d], total - found)):
                gain += a * math.log(a * total / (b * size[d])) if a else 0
            apart = max(apart, (n[d] + 0.5) / (size[d] + 1) * (total - size[d] + 1) / (found - n[d] + 0.5))
        if round(gain, 6) > (len(size) - 1) / 2 * math.log(total) and round(apart, 6) >= 4:
            chosen[x] = {d: (n[d] + 0.5) / (size[d] + 1) for d in model.domains}
    assert model.tokens == sorted(chosen) and len(chosen) > 5
    got = mixing.posteriors(rows, model, ["p"]).collect()
    assert len(got) == len(all_rows)
    want = {}
    for r in all_rows:
        has = plain_tokens(r.text or "")
        score = [
            math.log(size[d] / total) + sum(math.log(q[d] if x in has else 1 - q[d]) for x, q in chosen.items())
            for d in model.domains
        ]
        e = np.exp(np.array(score) - max(score))
        want[r.doc_id] = (e / e.sum(), len(GAP.sub(" ", r.text or "").split()))
    for r in got:
        assert np.allclose(r[2], want[r.doc_id][0], atol=2.1e-3) and r.n_tokens == want[r.doc_id][1]
        assert abs(sum(r[2]) - 1) < 1e-9


def test_places_of_a_table():
    rng = np.random.default_rng(6)
    for n in (0, 1, 2, 50, 5000):
        hashes = [int(x) for x in rng.integers(-(1 << 63), 1 << 63, n)]
        size, place = mixing._slots(hashes)
        assert len(set(place.values())) == len(place) == n
        assert all(at in (h % size, (h >> 32) % size) for h, at in ((hashes[i], at) for i, at in place.items()))


def members(spark, rows):
    data = [(i, n, p) for i, (n, p) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, n_tokens long, p array<double>")


def test_targets_out_of_reach(spark):
    """One document in ten is never of b, the others are at most 0.2: more of b is out of reach."""
    rows = members(spark, [(100, [0.8, 0.2])] * 9 + [(100, [1.0, 0.0])])
    fit = mixing.fit_rates(spark, rows, ["a", "b"], {"a": 0.5, "b": 0.5})
    assert fit.settled and not fit.reached
    # The least squares: all weight on the cell nearest to the targets.
    p, n = np.array([[0.8, 0.2], [1.0, 0.0]]), np.array([900.0, 100.0])
    have = (p * n[:, None]).sum(axis=0)
    grid = [(a, b) for a in np.linspace(0, 3, 601) for b in np.linspace(0, 3, 61)]
    loss = lambda r: ((((p * (n * r)[:, None]).sum(axis=0) - 500) ** 2) / have).sum()
    least = min(grid, key=loss)
    reached = (p * (n * least)[:, None]).sum(axis=0)
    assert np.allclose([x[2] for x in fit.report], reached, rtol=0.02)
    easy = mixing.fit_rates(spark, rows, ["a", "b"], {"a": 0.9, "b": 0.1})
    assert easy.settled and easy.reached
    short = mixing.fit_rates(spark, rows, ["a", "b"], {"a": 0.95, "b": 0.05}, rounds=1)
    assert not short.settled


def test_many_rounds_keep_short_plans(spark):
    """Rates landed every two rounds are those of one run without landing."""
    rng = np.random.default_rng(3)
    raw = rng.dirichlet([2, 1, 0.3], 40)
    rows = members(spark, [(int(n), [float(x) for x in p]) for n, p in zip(rng.integers(1, 900, 40), raw, strict=True)])
    targets = {"a": 0.45, "b": 0.35, "c": 0.2}
    one, two = (mixing.fit_rates(spark, rows, list("abc"), targets, landed=k) for k in (2, 1000))
    assert len(one.steps) == len(two.steps) > 4 and one.reached and two.reached
    assert np.allclose([x[2] for x in one.report], [x[2] for x in two.report])


def test_what_is_said_of_unmet_targets(spark, tables):
    docs, labelled = tables
    with pytest.raises(mixing.UnmetTargets, match="nowhere"):
        mixing.mix_to_targets(spark, docs, labelled, targets={"good": 0.5, "nowhere": 0.5}, unmet="raise")
    with pytest.warns(UserWarning, match="no non-negative rates"):
        mixing.mix_to_targets(spark, docs, labelled, targets={"good": 0.5, "nowhere": 0.5})
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        mixing.mix_to_targets(spark, docs, labelled)
        mixing.mix_to_targets(spark, docs, labelled, targets={"nowhere": 1.0}, unmet="ignore")
    with pytest.raises(ValueError, match="more than 2 domains"):
        mixing.mix_to_targets(spark, docs, labelled, most_domains=2)
    with pytest.raises(ValueError):
        mixing.mix_to_targets(spark, docs, labelled, unmet="?")


def test_one_token(spark):
    """A single token still parts texts that have it from those that lack it."""
    rows = [(i, "ugly word" if i % 2 else "word") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labelled = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 1, "low").otherwise("good").alias("domain"))
    model = mixing.fit_classifier(spark, docs, labelled)
    assert model.tokens == ["ugly"]
    got = {r.doc_id: r.domain for r in mixing.mix_to_targets(spark, docs, labelled, targets={"good": 0.5, "low": 0.5}).collect()}
    assert got == {i: "low" if i % 2 else "good" for i in range(200)}
