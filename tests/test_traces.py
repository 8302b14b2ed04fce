"""Trace documents: reading, folding, arms."""

import json

from livescope.operators import traces
from livescope.sources import traces as source


def frame(name, *calls, **more):
    return {"frame": name, "calls": list(calls), **more}


def test_folding_looks_at_subtrees_and_multiplies(spark):
    deep = frame("end")
    for i in range(200):
        deep = frame(f"f{i}", deep)
    tree = frame("root", frame("a", frame("b"), frame("b")), frame("a", frame("b", repeated=3), frame("b")), frame("a", frame("b")), frame("a", threw="E"), unknown=1)
    bodies = [("1", json.dumps({"root": tree})), ("2", '{"root":{"frame":"x"'), ("3", None), ("4", json.dumps({"root": deep})), ("5", "[]"), ("6", '{"root":{"calls":[]}}')]
    flat = source.flatten_frames(spark.createDataFrame(bodies, "trace string, body string"))
    read = {r.trace: (r.fault, r.frames, r.levels) for r in source.documents_read(flat).collect()}
    bad = ("unreadable", 0, None)
    assert read == {"1": (None, 10, 3), "2": bad, "3": bad, "4": (None, 201, 201), "5": bad, "6": bad}
    got = [(r.ordinal, r.parent, r.frame, r.repeated) for r in traces.fold_siblings(flat.where("trace = '1'")).orderBy("ordinal").collect()]
    assert got == [(0, None, "root", 1), (1, 0, "a", 2), (2, 1, "b", 2), (7, 0, "a", 1), (8, 7, "b", 1), (9, 0, "a", 1)]
    assert traces.fold_siblings(flat.where("fault is not null")).count() == 0
