"""Cuts of texts against plain scans, and the way back."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from confwarden.llm import fill_in_middle as fim
from confwarden.llm.ship import ship

PIECES = {
    "line": r"[^\n]*\n|[^\n]+",
    "sentence": r"[^\n.!?]*[\n.!?]|[^\n.!?]+",
    "word": r"[^\x20\x09-\x0D]*[\x20\x09-\x0D]|[^\x20\x09-\x0D]+",
    "char": r"(?s).",
}
LONG = "".join(f"é{i} line.\n" if i % 3 else "x! " for i in range(60_000))
TEXTS = [None, "", "\n", "one", "one\n", "é\nü\n\nß", "a. b! c", "<P> marked\nx", "x\ny <M", " \t\r\n x", LONG, "one", "\x00\x7f\n"]
SCHEMA = "doc_id long, text string, n string, form int"


@pytest.fixture(scope="module")
def rows(spark):
    ship(spark)
    data = [(i, t, str(i), i) for i, t in enumerate(TEXTS * 3)] + [(5, TEXTS[5], None, None), (None, "a\nb\nc\nd", "x", 0)]
    return spark.createDataFrame(data, SCHEMA)


def test_ranks():
    rng = np.random.default_rng(4)
    for size in (0, 1, 63, 64, 65, 1000):
        classes = rng.integers(0, 8, size).astype(np.uint8)
        matrix, at = fim.WaveletMatrix(classes), np.arange(size + 1)
        for kind in range(8):
            want = np.concatenate(([0], np.cumsum(classes == kind)))
            assert (matrix.rank(kind, at) == want).all()


@pytest.mark.parametrize("unit", PIECES)
@pytest.mark.parametrize("rate, spm", [(100, 50), (60, 100), (100, 0)])
def test_cuts(rows, unit, rate, spm):
    out = fim.fill_in_middle(rows, unit, seed=3, rate=rate, spm=spm, carry=("text", "n"))
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "text", "n"]
    got = out.withColumn("back", fim.restore("form", "output")).collect()
    assert len(got) == rows.count()
    forms = set()
    for r in got:
        text, h = r.text or "", fim._draws(3, r.doc_id)
        pieces = re.findall(PIECES[unit], text)
        assert "".join(pieces) == text and r[1] == len(pieces) and r.back == text
        a, b = sorted(x % (len(pieces) + 1) for x in h[:2])
        if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= rate:
            assert (r.form, r.prefix_chars, r.middle_chars, r.output) == ("plain", None, None, text)
            continue
        p, m, s = "".join(pieces[:a]), "".join(pieces[a:b]), "".join(pieces[b:])
        want = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < spm else f"<P>{p}<S>{s}<M>{m}"
        assert (r.form, r.prefix_chars, r.middle_chars) == ("spm" if h[3] % 100 < spm else "psm", len(p), len(m))
        assert r.output == want
        forms.add(r.form)
    assert forms == ({"spm", "psm"} if spm == 50 else {"spm"} if spm else {"psm"})


def test_repeated_rows_and_empty_tables(rows):
    one = fim.fill_in_middle(rows.where("doc_id = 5")).select("output").distinct()
    assert one.count() == 1 and fim.fill_in_middle(rows.limit(0)).count() == 0
    assert fim.fill_in_middle(rows.where("doc_id IS NULL")).first().doc_id is None


def test_other_marks(rows):
    marks = ("[p]", "{s}", "|m|")
    out = fim.fill_in_middle(rows, marks=marks, carry=("text",)).withColumn("back", fim.restore("form", "output", marks))
    assert out.where(F.coalesce("text", F.lit("")) != F.col("back")).isEmpty()
