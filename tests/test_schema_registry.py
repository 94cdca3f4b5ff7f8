"""Fields of JSON documents, versions with rules, drift."""

import pytest

from lodestream.operators import schema_registry

DOCS = [
    ("P", '{"id": "1", "n": 1, "name": {"family": "A", "given": ["x"]}, "deep": {"a": {"b": {"c": {"d": 1}}}}}'), ("P", '{"id": "2", "n": 2.5, "name": {"family": null}, "active": true}'), ("P", '{"id": 3, "name": null}'),
    ("O", '{"id": "o", "n": null}'), ("O", "{broken"), ("O", None), ("O", "[1]"), ("O", "{}"), (None, '{"x": 1}'),
]


def seen(spark, docs):
    return schema_registry.fields(spark.createDataFrame(docs, "kind string, value string"), "kind", "value")


def test_fields_by_kind(spark):
    got = {(r["kind"], r["path"]): (r["type"], r["n"]) for r in seen(spark, DOCS).collect()}
    assert got == {
        ("P", "id"): ("mixed", 3), ("P", "n"): ("decimal", 2), ("P", "name"): ("object", 3), ("P", "name.family"): ("text", 2), ("P", "name.given"): ("array", 1), ("P", "active"): ("boolean", 1),
        ("P", "deep"): ("object", 1), ("P", "deep.a"): ("object", 1), ("P", "deep.a.b"): ("object", 1), ("P", "deep.a.b.c"): ("object", 1), ("O", "id"): ("text", 1), ("O", "n"): ("null", 1), (None, "x"): ("integer", 1),
    }


def test_versions_and_drift(spark, tmp_path):
    path = str(tmp_path / "r")
    first = seen(spark, [("P", '{"a": 1, "b": "x", "c": true}'), ("O", '{"z": 1}')])
    assert schema_registry.register(first, path) == 0
    grown = seen(spark, [("P", '{"a": 1.5, "b": "x", "c": false, "d": []}')])
    changes = {(r["path"], r["change"], r["old_type"], r["new_type"], r["n"]) for r in schema_registry.compare(schema_registry.registered(spark, path), grown).collect()}
    assert changes == {("a", "widened", "integer", "decimal", 1), ("d", "new", None, "array", 1)}
    assert schema_registry.register(grown, path) == 1
    broken = seen(spark, [("P", '{"a": 1.5, "b": 7, "c": true, "e": 1}'), ("Q", '{"q": 1}')])
    changes = {(r["kind"], r["path"], r["change"]) for r in schema_registry.compare(schema_registry.registered(spark, path), broken).collect()}
    assert changes == {("P", "b", "retyped"), ("P", "d", "lost"), ("P", "e", "new"), ("Q", "q", "new")}
    with pytest.raises(schema_registry.Incompatible, match=r"P.b retyped \(text to integer\); P.d lost"):
        schema_registry.register(broken, path)
    assert schema_registry.register(broken, path, allow=("new", "widened", "lost", "retyped")) == 2
    latest = {(r["kind"], r["path"]): r["type"] for r in schema_registry.registered(spark, path).collect()}
    assert latest == {("P", "a"): "decimal", ("P", "b"): "integer", ("P", "c"): "boolean", ("P", "e"): "integer", ("Q", "q"): "integer", ("O", "z"): "integer"}
    assert {r["path"] for r in schema_registry.registered(spark, path, 0).where("kind = 'P'").collect()} == {"a", "b", "c"}
