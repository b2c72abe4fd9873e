import pytest
from pyspark.sql import functions as F

from quarryline.plans.predicate import query, typed_fields, variant_fields, where


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(1, "call", 5.0, "12abc"), (2, "sms", 7.5, None), (3, "calm", None, "x OR y"), (4, "a b", 12.0, "")], "ord long, event string, quantity double, note string")


CASES = [
    ("event=call", [1]), ("event=cal%", [1, 3]), ("event~al", [1, 3]), ("event!=call", [2, 3, 4]), ("note!=x", [1, 2, 3, 4]), ("quantity>=7.5", [2, 4]),
    ("quantity<=5 OR event=sms", [1, 2]), ("event LIKE '%a%'", [1, 3, 4]), ("event like '%m'", [3]), ("note>=12", [1]), ("event:call", [1]), ("quantity=5", [1]), ("quantity>=abc", []), ("", [1, 2, 3, 4]), ("nothing=", [1, 2, 3, 4]),
]


@pytest.mark.parametrize("text,expected", CASES)
def test_where(rows, text, expected):
    assert sorted(r.ord for r in rows.filter(where(text, typed_fields(rows))).collect()) == expected


def test_modes(rows):
    with pytest.raises(ValueError):
        where("quantity>5", typed_fields(rows))
    assert rows.filter(where("quantity>5", typed_fields(rows), strict=False)).count() == 4
    assert rows.filter(where("event= call", typed_fields(rows), strict=False)).count() == 0
    assert rows.filter(where("event= call", typed_fields(rows))).count() == 1


def test_query_projects_after_the_limit(rows):
    out = query(rows, "quantity>=0", ["event", "missing"], 2)
    assert [tuple(r) for r in out.collect()] == [("call", None), ("sms", None)]


def test_variant_paths(spark):
    v = spark.range(1).select(F.parse_json(F.lit('{"a": {"b": "x"}, "n": 3}')).alias("v"))
    assert v.filter(where("a.b=x", variant_fields())).count() == 1
    assert v.filter(where("n>=4", variant_fields())).count() == 0
