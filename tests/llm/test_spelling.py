"""Near words, forms and roots against brute force; words counted against a plain scan."""

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from confwarden.llm import spelling
from confwarden.llm.queries import QUERIES
from confwarden.llm.ship import ship

SF = "/root/testdata/sf0.001"
RUN = re.compile("[A-Za-zÀ-ÿ]+")


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def near(a, b):
    """One inserted, deleted or replaced letter, by the definition."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=10):
    """Neighbours by what one deletion leaves, checked by the definition; then forms and roots."""
    by_rest, links = {}, {x: set() for x in counts}
    for x in counts:
        for rest in {x, *(x[:i] + x[i + 1 :] for i in range(len(x)))}:
            by_rest.setdefault(rest, []).append(x)
    for group in by_rest.values():
        for a, b in itertools.combinations(group, 2):
            if near(a, b):
                links[a].add(b)
                links[b].add(a)
    best = {x: min(links[x], key=lambda y: (-counts[y], y)) for x in counts if links[x]}
    form = {x: y for x, y in best.items() if counts[y] >= ratio * counts[x]}
    out = {}
    for x, n in counts.items():
        root = x
        while root in form:
            root = form[root]
        out[x] = (form.get(x), root, n, len(links[x]), counts[form[x]] if x in form else None)
    return out


def scan(texts):
    counts = Counter()
    for i, text in texts:
        for x in RUN.findall(text or ""):
            x = re.sub("[A-Z]", lambda m: m[0].lower(), x)
            h = zlib.crc32(f"{'' if i is None else i}:{x}".encode())
            if h % 31 == 0:
                x = x[: h % len(x)] + x[h % len(x) + 1 :]
            if len(x) >= 7:
                counts[x] += 1
    return {x: n for x, n in counts.items() if n >= 2}


def rows_of(df):
    rows = df.collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(got) == len(rows) and df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return got


def made_up(seed, n, letters="abà", sizes=(3, 7)):
    rng = np.random.default_rng(seed)
    words = {"".join(rng.choice(list(letters), rng.integers(*sizes))) for _ in range(n)}
    return {x: int(10 ** rng.uniform(0, 5)) for x in sorted(words)}


def variants(spark, counts, **how):
    words = spark.createDataFrame([*counts.items()], "word string, n long").repartition(3)
    return rows_of(spelling.spelling_variants(spark, words, **how))


@pytest.mark.parametrize("how", [{}, {"most": 150}, {"most": 40, "levels": 3}, {"levels": 2, "depth": 0, "most": 60}])
def test_dense_words(spark, how):
    """Few letters, so nodes are large: taken deeper, and dealt in blocks at the last level."""
    counts = made_up(1, 500)
    assert variants(spark, counts, **how) == brute(counts)


def test_real_words(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute(scan(texts))
    assert rows_of(QUERIES["op12_spelling_variants"](spark, SF)) == want
    assert sum(v[0] is not None for v in want.values()) > 3


def test_chains_ties_and_long_words(spark):
    chain = {"a" * (7 + i): 10**i for i in range(8)}  # each leads to the next
    ties = {"tietiea": 5, "tietieb": 50, "tietiec": 50, "tietie": 49}
    edge = {"edgewise": 3, "edgewisd": 29, "q" * 40_000: 2, "q" * 39_999 + "r": 20, "lonelyword": 9}
    got = variants(spark, {**chain, **ties, **edge})
    assert got == brute({**chain, **ties, **edge})
    assert got["aaaaaaa"][1] == "a" * 14 and got["tietiea"][0] == "tietieb" and got["edgewise"][0] is None
    assert got["q" * 40_000][:2] == ("q" * 39_999 + "r",) * 2


def test_one_apart():
    rng = np.random.default_rng(8)
    for size in (1, 2, 7):
        for wide in (size, size + 1):
            a, b = (["".join(rng.choice(list("ab"), k)) for _ in range(300)] for k in (size, wide))
            found = spelling.one_apart(*(spelling._matrix([x.encode() for x in s]) for s in (a, b)))
            assert found.tolist() == [near(x, y) for x, y in zip(a, b, strict=True)]


def test_counting(spark):
    odd = "Ünité ÜNITÉ ünité straßenbahn stra×÷en abcdefg1abcdefg\x00abcdefg漢abcdefg ABCDEFG ¿abcdefg a" + "b" * 50_000
    texts = [(1, None), (2, ""), (3, odd), (3, odd), (None, odd), (4, " ".join(f"wordword{'x' * (i % 90)}" for i in range(3000)))]
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in texts], "doc_id long, text string, word string, n int")
    got = spelling.word_counts(docs, noise=31).collect()
    assert {r.word: r.n for r in got} == scan(texts) and len(got) > 80
    plain = {r.word: r.n for r in spelling.word_counts(docs, least_chars=5, least_n=3).collect()}
    assert plain["abcdefg"] == 18 and plain["ünité"] == 3 and plain["Ünité"] == 3
    assert spelling.spelling_variants(spark, spelling.word_counts(docs.limit(0))).count() == 0
    assert rows_of(spelling.spelling_variants(spark, spark.createDataFrame([("alone", 2)], "word string, n long"))) == {
        "alone": (None, "alone", 2, 0, None)
    }
