from __future__ import annotations

import random

import pytest

from corpusmill.operators import filters as L

ROWS = [(i, kind, num) for i, (kind, num) in enumerate([("a", 1), ("b", 2), (None, 3), ("a", None), (None, None), ("c", 2)])]


def evaluate(term, row, combine="$and"):
    """Two-valued evaluation of a filter on one row: an independent model."""

    def one(field, op, value):
        if row[field] is None:
            return False
        x = row[field]
        return {
            "$eq": lambda: x == value, "$ne": lambda: x != value, "$in": lambda: x in value, "$nin": lambda: x not in value,
            "$gt": lambda: x > value, "$gte": lambda: x >= value, "$lt": lambda: x < value, "$lte": lambda: x <= value,
        }[op]()

    parts = []
    for item in [term] if isinstance(term, dict) else term:
        for key, value in item.items():
            if key.startswith("$"):
                parts.append(evaluate(value, row, key))
            elif isinstance(value, dict):
                parts.extend(one(key, op, v) for op, v in value.items())
            else:
                parts.append(one(key, "$in" if isinstance(value, list) else "$eq", value))
    return {"$and": all, "$or": any, "$not": lambda p: not any(p)}[combine](parts)


def run(spark, term):
    df = spark.createDataFrame(ROWS, "id int, kind string, num int")
    return sorted(r["id"] for r in L.filter_documents(df, term).collect())


def model(term):
    return [i for i, kind, num in ROWS if evaluate(term, {"kind": kind, "num": num})]


def test_missing_fields_fail_every_comparison(spark):
    assert run(spark, {"kind": {"$ne": "a"}}) == [1, 5]
    assert run(spark, {"num": {"$nin": [2]}}) == [0, 2]
    assert run(spark, {"$not": {"kind": "a"}}) == [1, 2, 4, 5]


def test_two_spellings_agree(spark):
    long = {"$and": {"kind": {"$eq": "a"}, "num": {"$gte": 1}, "$or": {"kind": {"$in": ["a", "b"]}, "num": {"$eq": 7}}}}
    short = {"kind": "a", "num": {"$gte": 1}, "$or": {"kind": ["a", "b"], "num": 7}}
    assert run(spark, long) == run(spark, short) == [0]


def test_list_form_flattens(spark):
    term = {"$or": [{"kind": "b", "num": 3}, {"kind": "c"}]}
    assert run(spark, term) == [1, 2, 5]


def test_empty_operators(spark):
    assert run(spark, {"$and": {}}) == [0, 1, 2, 3, 4, 5]
    assert run(spark, {"$or": {}}) == []


def test_errors():
    with pytest.raises(ValueError):
        L.compile_filter({"kind": {"$like": "a"}})
    with pytest.raises(ValueError):
        L.compile_filter({"kind": {"$in": "abc"}})
    with pytest.raises(ValueError):
        L.compile_filter({"$xor": {"kind": "a"}})


def test_random_filters_against_model(spark):
    rng = random.Random(11)

    def term(depth):
        out = {}
        for _ in range(rng.randint(1, 3)):
            if depth and rng.random() < 0.5:
                inner = term(depth - 1)
                out[rng.choice(["$and", "$or", "$not"])] = inner if rng.random() < 0.7 else [inner, term(0)]
            elif rng.random() < 0.5:
                out["kind"] = rng.choice([{"$eq": "a"}, {"$ne": "b"}, ["a", "c"], "b", {"$nin": ["a"]}])
            else:
                out["num"] = {rng.choice(["$gt", "$gte", "$lt", "$lte", "$eq", "$ne"]): rng.randint(0, 4)}
        return out

    for _ in range(25):
        t = term(2)
        assert run(spark, t) == model(t), t


def test_filters_reach_the_scan(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plan = L.filter_documents(docs, {"$not": {"lang": "en"}, "n_chars": {"$gt": 10}})._jdf.queryExecution().toString()
    pushed = [line for line in plan.splitlines() if "PushedFilters" in line][0]
    assert "Not(EqualTo(lang,en))" in pushed and "GreaterThan(n_chars,10)" in pushed


def test_filter_in_per_key(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "document_id int")
    meta = spark.createDataFrame(
        [(1, "a", "x"), (1, "b", "y"), (2, "a", "x"), (3, "b", "y")], "document_id int, name string, value string"
    )
    found = L.filter_in_per_key(docs, meta, {"a": ["x"], "b": ["y", "z"]})
    assert [r[0] for r in found.collect()] == [1]


def test_same_elements(spark):
    df = spark.createDataFrame([(["b", "a"],), (["a"],), (None,)], "v array<string>")
    from pyspark.sql import functions as F

    assert df.where(L.same_elements(F.col("v"), ["a", "b"])).count() == 1


def test_null_operands_keep_two_values(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")

    def kept(term):
        return sorted((r["x"] for r in L.filter_documents(df, term).collect()), key=str)

    assert kept({"x": {"$nin": [1, None]}}) == [2]
    assert kept({"x": {"$in": [1, None]}}) == [1]
    assert kept({"x": [None]}) == []
    assert kept({"x": None}) == [] and kept({"x": {"$ne": None}}) == [1, 2]
    assert kept({"$not": {"x": {"$eq": None}}}) == [1, 2, None]
    assert kept({"$not": {"x": {"$in": [7, None]}}}) == [1, 2, None]
    assert kept({"$not": {"x": {"$gt": None}}}) == [1, 2, None]


def test_a_list_may_be_a_table(spark):
    df = spark.createDataFrame(ROWS, "id int, kind string, num int")
    for values in (["a"], ["a", "a", "c"], [], [None], [None, "b"]):
        table = spark.createDataFrame([(v,) for v in values], "kind string")
        for made in (lambda x: {"kind": {"$in": x}}, lambda x: {"kind": {"$nin": x}}, lambda x: {"$or": {"kind": {"$nin": x}, "num": 1}}, lambda x: {"$not": {"kind": {"$in": x}, "num": {"$gt": 2}}}, lambda x: {"kind": x}):
            ids = lambda x: sorted(r["id"] for r in L.filter_documents(df, made(x)).collect())  # noqa: E731, B023
            assert ids(table) == ids(values), values
    plan = L.filter_documents(df, {"$or": {"kind": {"$nin": spark.createDataFrame([("a",)], "v string")}, "num": 1}})
    assert "NestedLoop" not in plan._jdf.queryExecution().toString()
