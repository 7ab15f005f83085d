import datetime

import pytest
from pyspark.sql import functions as F

from confwarden import functions as fn
from confwarden.sources import explode_targets, target_list
from conftest import rows


def evaluate(spark, text, expression, kind="string"):
    return spark.createDataFrame([(text,)], f"x {kind}").select(expression(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "text, ids",
    [
        (None, []),
        ("", []),
        ("[]", []),
        ("not json", []),
        ("[1, 2", []),
        ('{"id":"x"}', []),
        ('"s"', []),
        ('[{"id":"a"},"b"]', []),
        ('[{"id":null},{"id":""},{"other":1},{"id":"gone"}]', ["gone"]),
        (' \n[{"id":"a","required":true},{"id":"a"}]', ["a", "a"]),
    ],
)
def test_decode_role_ids(spark, text, ids):
    assert evaluate(spark, text, fn.decode_role_ids) == ids


@pytest.mark.parametrize(
    "text, ids",
    [
        (None, []),
        ("", []),
        ("not json", []),
        ('{"id":"x"}', []),
        ('["p1",{"id":"p2"}]', ["p1", "p2"]),
        ('["",null,{"id":null},{"name":"x"},"p"]', ["p"]),
        ('\t["p"]', ["p"]),
    ],
)
def test_decode_assoc_ids(spark, text, ids):
    assert evaluate(spark, text, fn.decode_assoc_ids) == ids


@pytest.mark.parametrize(
    "before, after",
    [
        (None, {"k": "true"}),
        ({}, {"k": "true"}),
        ({"k": "false", "a.b": "1"}, {"k": "true", "a.b": "1"}),
        ({"k": None}, {"k": "true"}),
    ],
)
def test_map_upsert(spark, before, after):
    upsert = lambda m: fn.map_upsert(m, "k", "true")
    assert evaluate(spark, before, upsert, "map<string,string>") == after


def test_trim_space(spark):
    assert evaluate(spark, "\t a b \n", fn.trim_space) == "a b"


@pytest.mark.parametrize(
    "text, cursor",
    [
        ("phase=2-scope;offset=300", ("2-scope", 300)),
        ("phase=1;offset=0", ("1", 0)),
        ("phase=7;offset=300", ("1", 0)),
        (None, ("1", 0)),
        ("", ("1", 0)),
        ("phase=1;offset=", ("1", 0)),
    ],
)
def test_parse_cursor(spark, text, cursor):
    assert tuple(evaluate(spark, text, fn.parse_cursor)) == cursor


def test_cursor_round_trip(spark):
    text = evaluate(spark, 700, lambda c: fn.cursor_text(F.lit("2-resource"), c), "long")
    assert text == "phase=2-resource;offset=700"


@pytest.mark.parametrize(
    "code, deleting, reading, final",
    [
        (200, "OK", "OK", "OK"),
        (204, "OK", "OK", "OK"),
        (404, "OK", "FAIL", "OK"),
        (401, "RETRY", "RETRY", "FAIL"),
        (503, "RETRY", "RETRY", "FAIL"),
        (400, "FAIL", "FAIL", "FAIL"),
        (0, "FAIL", "FAIL", "FAIL"),
    ],
)
def test_outcomes(spark, code, deleting, reading, final):
    assert evaluate(spark, code, fn.http_outcome, "int") == deleting
    assert evaluate(spark, code, lambda c: fn.http_outcome(c, deleting=False), "int") == reading
    assert evaluate(spark, code, fn.final_outcome, "int") == final


def test_defaults(spark):
    assert evaluate(spark, "", lambda c: fn.blank_to(c, F.lit("d"))) == "d"
    assert evaluate(spark, None, lambda c: fn.blank_to(c, F.lit("d"))) == "d"
    assert evaluate(spark, "v", lambda c: fn.blank_to(c, F.lit("d"))) == "v"
    assert evaluate(spark, False, lambda c: fn.alternative(c, F.lit(None)), "boolean") is None


@pytest.mark.parametrize("template, name", [("-login", "acme-login"), ("sidecar", "sidecar")])
def test_expand_template(spark, template, name):
    assert evaluate(spark, "acme", lambda c: fn.expand_template(c, F.lit(template))) == name


def test_log_line(spark):
    at = datetime.datetime(2024, 5, 1, 12, 30, 5)
    line = evaluate(spark, at, lambda c: fn.log_line(c, "INFO", F.lit("done")), "timestamp_ntz")
    assert line == "2024-05-01T12:30:05Z [INFO] done"


def test_paths(spark):
    made = evaluate(spark, "p", lambda c: fn.policy_path(F.lit("r"), F.lit("u"), c))
    assert made == "/admin/realms/r/clients/u/authz/resource-server/policy/p"
    assert evaluate(spark, "u", lambda c: fn.client_path(F.lit("r"), c)) == "/admin/realms/r/clients/u"


def test_target_lists(spark):
    assert target_list(" b,a,,b , master") == ["b", "a", "master"]
    assert target_list(None) == target_list(" , ") == []
    df = spark.createDataFrame([(1, " b,a,,b ,\tmaster"), (2, ""), (3, None)], "k int, t string")
    assert rows(explode_targets(df, "t", ["k"]), "k", "pos", "realm") == [
        (1, 0, "b"),
        (1, 1, "a"),
        (1, 2, "master"),
    ]


def test_lists_are_decoded_as_a_whole(spark):
    texts = ['[{"id":"a"}] x', '[{"id":"a"}],[{"id":"b"}]', '["{x","d"]', '[{"id":"a"},"b"]', '{"id":"a"}', "[", None, ' [{"id":"a"},null] ']
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    found = df.select("n", fn.decode_role_ids(F.col("t")), fn.decode_assoc_ids(F.col("t"))).orderBy("n").collect()
    assert [r[1] for r in found] == [[], [], [], [], [], [], [], ["a"]]
    assert [r[2] for r in found] == [[], [], ["{x", "d"], ["a", "b"], [], [], [], ["a"]]
