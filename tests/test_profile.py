"""Verdicts on single profile events."""

import json

import pytest

from vectrail.operators import profile

RULES = [("Gather_1", "Gather", [("int64", 10, 80)]), ("Shape_2", "Shape", [("int64", 4, 32), ("float16", 100, 150)]), ("Odd_3", "Odd", [("string", 5, 50)])]


def event(name="Gather_1_kernel_time", provider=profile.PROCESSOR, op="Gather", outputs=({"int64": [2, 3]},), size=48, **args):
    return json.dumps({"name": name, "args": {"provider": provider, "op_name": op, "output_type_shape": outputs, "output_size": size} | args})


CASES = [
    (event(), "processor"),
    (event(size="48"), "processor"),
    (event(provider=profile.CARD, op="any"), "card"),
    (event(name="session_run", provider=None), "other"),
    (event(name="session_run"), "no kernel"),
    (event(provider="OtherProvider"), "provider"),
    (event(provider=None), "provider"),
    (event(name="Gather_9_kernel_time"), "not reviewed"),
    (event(op="Shape"), "operator"),
    (event(outputs=None), "no outputs"),
    (event(outputs=[]), "output count"),
    (event(outputs=[{"int32": [2]}]), "type"),
    (event(outputs=[{"int64": [2], "int32": [2]}]), "ambiguous"),
    (event(outputs=[{"int64": [-2]}]), "shape"),
    (event(outputs=[{"int64": [2**40, 2**40]}]), "shape"),
    (event(outputs=[{"int64": [0, 5]}]), "bounds"),
    (event(outputs=[{"int64": [11]}]), "bounds"),
    (event(size=47), "output bytes"),
    (event(size="many"), "output bytes"),
    (event(outputs=[{"int64": []}], size=8), "processor"),
    (event("Shape_2_kernel_time", op="Shape", outputs=[{"int64": [4]}, {"float16": [75]}], size=182), "processor"),
    (event("Shape_2_kernel_time", op="Shape", outputs=[{"int64": [4]}, {"float16": [76]}], size=184), "bounds"),
    (event("Odd_3_kernel_time", op="Odd", outputs=[{"string": [1]}]), "unknown type"),
    ('{"ts": 1}', "other"),
]


def test_verdicts(spark):
    rules = spark.createDataFrame(RULES, profile.RULE)
    got = profile.verdicts(spark.createDataFrame([(i, e) for i, (e, _) in enumerate(CASES)], "i int, event string"), rules).collect()
    assert {r["i"]: r["verdict"] for r in got} == {i: v for i, (_, v) in enumerate(CASES)}
    good = spark.createDataFrame([(e,) for e, v in CASES if v in ("processor", "card", "other")], "event string")
    assert tuple(profile.check_run(good, rules).first()) == (4, 1, 2)
    for bad in (good.where("event NOT LIKE '%CUDA%'"), good.unionByName(spark.createDataFrame([(event(op="x"),)], "event string"))):
        with pytest.raises(Exception, match="card|bad events"):
            profile.check_run(bad, rules).collect()
