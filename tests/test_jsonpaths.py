"""Structure of JSON text columns."""

import json
import random
from collections import Counter

from tablelens.operators.jsonpaths import json_paths, json_schemas


def kind(v):
    names = {dict: "object", list: "array", bool: "boolean", int: "whole", float: "number", str: "text", type(None): "null"}
    return names[type(v)]


def walk(v, path, depth, out):
    out[(path, kind(v))] += 1
    if depth and isinstance(v, dict):
        for k, x in v.items():
            walk(x, f"{path}.{k}" if k.replace("_", "a").isalnum() and k.isascii() else f'{path}."{k}"', depth - 1, out)
    if depth and isinstance(v, list):
        for x in v:
            walk(x, path + "[*]", depth - 1, out)


def value(rng, depth):
    if depth and rng.random() < 0.6:
        if rng.random() < 0.5:
            return {k: value(rng, depth - 1) for k in rng.sample(["a", "b_1", "c d", "é", "e.f"], rng.randint(0, 3))}
        return [value(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return rng.choice([1, -7, 2.5, "x", "", True, None])


def test_paths_equal_a_walk(spark):
    rng = random.Random(4)
    values = [value(rng, 5) for _ in range(300)]
    rows = [(json.dumps(v, ensure_ascii=False), json.dumps([i])) for i, v in enumerate(values)] + [("{bad", None), (None, "oops")]
    d = spark.createDataFrame(rows, "j string, k string")
    for depth in (6, 2, 0):
        want = Counter({("$", "invalid"): 1})
        for v in values:
            walk(v, "$", depth, want)
        got = {(r.path, r.kind): r["count"] for r in json_paths(d, ["j", "k"], depth).where("column_name = 'j'").collect()}
        assert got == want
    other = {(r.path, r.kind): r["count"] for r in json_paths(d, ["j", "k"]).where("column_name = 'k'").collect()}
    assert other == {("$", "array"): 300, ("$[*]", "whole"): 300, ("$", "invalid"): 1}


def test_schemas(spark):
    d = spark.createDataFrame([('{"a": 1}', None), ('{"a": 2, "b": ["x"]}', None), ("bad", None)], "j string, n string")
    j, n = json_schemas(d, ["j", "n"]).collect()
    assert (j.cells, j.schema, n.cells, n.schema) == (2, "OBJECT<a: BIGINT, b: ARRAY<STRING>>", 0, None)
    assert json_paths(d.limit(0), ["j"]).collect() == [] and json_paths(d, []).collect() == [] and json_schemas(d, []).collect() == []
