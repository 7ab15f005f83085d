"""The toxicity classifier against a plain fit, on held-out labels and on identity terms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from confwarden.llm import toxicity as tox
from confwarden.llm.ship import ship

SF = "/root/testdata/sf0.1"
DOCS, LABELS = "doc_id long, text string, score string", "doc_id long, toxic int"
FILLER = [f"filler{chr(97 + i)}" for i in range(20)]


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def biased(spark, n=600):
    """Toxic texts insult and often name a group; clean ones rarely name one."""
    rng = np.random.default_rng(11)
    texts, labels = [], []
    for i in range(n):
        words = list(rng.choice(FILLER, 12))
        toxic = i % 3 == 0
        if toxic:
            if rng.random() < 0.85:  # the rest are marked without an insult
                words.insert(3, "grubscum")
            if rng.random() < 0.7:
                words.insert(5, rng.choice(["muslims", "immigrants"]))
        elif rng.random() < 0.1:
            words.insert(5, rng.choice(["muslims", "immigrants", "people", "christians"]))
        texts.append((i, " ".join(words[:8]) + ". " + " ".join(words[8:]), "x"))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(texts, DOCS), spark.createDataFrame(labels, LABELS)


def test_features():
    assert tox.words_of("Ab, ab! C-3 é".encode()) == {b"ab", b"c", b"3", "é".encode()}
    assert tox.features_of(b"abc") == {b"abc "}
    assert tox.features_of(b"abcdef") == {b"abcd", b"abcde", b"abcdef", b"abcdef "}
    lookup = tox.Lookup([b"abc ", b"abcd"])
    assert lookup.words({b"abc", b"abcde", b"x"}) == [0, 1] and lookup.words({b"x"}) == []


def test_swaps():
    groups = tox.identity_groups([("person", "woman", "man"), ("x", "man")])
    found = list(tox.swaps(b"A man sat. The woman, a person! None", groups))
    assert ({b"a", b"sat"}, b"man", b"person") in found and ({b"a", b"sat"}, b"man", b"x") in found
    assert sorted((a, b) for _, a, b in found) == sorted(
        [(b"man", b"person"), (b"man", b"woman"), (b"man", b"x")]
        + [(a, b) for a in (b"woman", b"person") for b in (b"woman", b"person", b"man") if a != b]
    )
    assert all(term not in rest for rest, term, _ in found)


def test_minimise():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(40, 8)) * np.logspace(0, 1, 8)
    b = rng.normal(size=40)
    x, _, _, done = tox.minimise(lambda x: (float((a @ x - b) @ (a @ x - b)), 2 * a.T @ (a @ x - b)), np.zeros(8), 500, 1e-7)
    assert done and np.allclose(x, np.linalg.lstsq(a, b, rcond=None)[0], atol=1e-5)


def test_fit_is_the_least_of_its_loss(spark):
    """The loss written out anew over all rows and swaps: no small move lowers it."""
    docs, labels = biased(spark)
    model = tox.fit(spark, docs.repartition(5), labels, settled=1e-7)
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    marks = {r.doc_id: r.toxic for r in labels.collect()}
    weight = dict(zip(model.features, model.weights, strict=True))
    groups = tox.identity_groups(tox.IDENTITY)

    def has(words):
        return {x for v in words for x in tox.features_of(v)}

    rows = [(marks[i], has(tox.words_of(t))) for i, t in texts.items()]
    pairs = [(has(rest | {a}), has(rest | {b})) for t in texts.values() for rest, a, b in tox.swaps(t, groups)]
    assert model.report["swaps"] == len(pairs) > 0 and model.report["settled"]

    def loss(weight, bias):
        score = lambda s: bias + math.fsum(weight[x] for x in sorted(s & weight.keys()))
        own = math.fsum(math.log1p(math.exp(-score(s) if y else score(s))) for y, s in rows)
        moved = math.fsum((score(a) - score(b)) ** 2 for a, b in pairs)
        return own + 0.025 * math.fsum(v * v for v in weight.values()) + len(rows) * moved / len(pairs)

    least = loss(weight, model.bias)
    assert abs(least - model.report["loss"]) < 1e-6 * least
    for x in [*model.features[:12], None]:
        for step in (-0.01, 0.01):
            moved = {**weight, x: weight[x] + step} if x else weight
            assert loss(moved, model.bias + (0 if x else step)) > least


def test_neutral_mentions_are_left_alone(spark):
    docs, labels = biased(spark)
    plain = [(i, f"{FILLER[i]} {g} {FILLER[i + 1]} {FILLER[i + 2]}", None) for i, g in enumerate(["muslims", "immigrants"] * 5)]
    insults = [(100 + i, f"{FILLER[i]} grubscum {FILLER[i + 1]}", None) for i in range(10)]
    rows = spark.createDataFrame(plain + insults, DOCS)

    def scores(pull):
        model = tox.fit(spark, docs, labels, pull=pull)
        return model.report, {r.doc_id: r for r in tox.toxicity(rows, model).collect()}

    (loose, without), (tight, pulled) = scores(0.0), scores(10.0)
    assert tight["squared_change"] < 0.02 < 1 < loose["squared_change"]
    named = [without[i].score for i in range(10)], [pulled[i].score for i in range(10)]
    assert min(named[0]) > 0.4 and max(named[1]) < 0.2
    assert all(pulled[i].predicted == 1 for i in range(100, 110))


def test_edges(spark):
    odd = [(1, None, "x"), (1, "", None), (2, "", "x"), (None, "stupid", "x"), (3, "w " * 50_000, None), (3, "w " * 50_000, None)]
    docs = spark.createDataFrame(odd, DOCS)
    none = spark.createDataFrame([], LABELS)
    for labels, want in ((none, 0.0), (none.union(spark.createDataFrame([(3, 1)], LABELS)), 0.75)):
        got = tox.toxicity(docs, tox.fit(spark, docs, labels)).collect()
        assert len(got) == len(odd) and {r.score for r in got} == {want}
        assert {r.predicted for r in got} == {int(want >= 0.7)}
    both = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, 0), (None, 1), (7, 1), (3, None), (3, 5)], "doc_id long, toxic int")
    assert {r.doc_id: r.toxic for r in tox.toxic_labels(both).collect()} == {1: 1, 2: 1, 3: 0, 7: 1}
    model = tox.fit(spark, docs, tox.toxic_labels(both))
    assert model.report["rows"] == 3 and tox.toxicity(docs.limit(0), model).count() == 0
    held = tox.held_out_scores(spark, docs, both.withColumn("lang", F.lit("x")))
    assert held.where("doc_id IS NULL AND held_out").isEmpty() and held.count() == len(odd)


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = tox.held_out_scores(spark, docs, labels).where("held_out").join(tox.toxic_labels(labels), "doc_id")
    toxic, wrong = (got.where(f"toxic = {c}").agg(F.avg("predicted")).first()[0] for c in (1, 0))
    assert toxic > 0.75 and wrong < 0.005
    other = docs.select("doc_id", "text", F.lit("zz").alias("lang"), F.lit("s").alias("source"))
    again = tox.held_out_scores(spark, other, labels).join(got.select("doc_id", F.col("score").alias("was")), "doc_id")
    assert again.where("abs(score - was) > 1e-5").isEmpty()
