"""Request traces: one JSON document a request, a tree of frames in it.

Spark has no recursive type, so each document's tree is walked where it lies, with a stack, and
leaves as rows. A document is bounded by its sender (20,000 frames), and nothing is shuffled.
Unknown keys are ignored. What cannot be read gives one row with a fault and no frame.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = (
    "trace string, fault string, ordinal long, parent long, depth int, frame string, threw string, via string, "
    "repeated long, via_collapsed long, is_open boolean, truncated boolean, seen string"
)
#: What a frame says of values: compared as a whole when frames are folded.
_SEEN = ("in", "out", "returned", "branches")


def _rows(trace: str, body: str | None) -> Iterator[tuple]:
    try:
        root = json.loads(body or "")["root"]
        stack = [(root, None, 0)]
        found = []
        while stack:
            node, parent, depth = stack.pop()
            at = len(found)
            seen = json.dumps([node.get(k) for k in _SEEN], sort_keys=True, separators=(",", ":"))
            found.append((
                trace, None, at, parent, depth, str(node["frame"]), node.get("threw"), node.get("via"), int(node.get("repeated", 1)), int(node.get("viaCollapsed", 0)),
                bool(node.get("open", False)), bool(node.get("truncated", False)), seen,
            ))
            stack.extend((child, at, depth + 1) for child in reversed(node.get("calls") or []))
    except (ValueError, TypeError, KeyError, AttributeError, RecursionError):
        yield (trace, "unreadable", *[None] * 11)
    else:
        yield from found


def flatten_frames(bodies: DataFrame) -> DataFrame:
    """bodies(trace, body) as frames in the order of a walk from the root, each with its parent's ordinal."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            for trace, body in zip(batch["trace"], batch["body"], strict=True):
                part = pd.DataFrame(list(_rows(trace, body)), columns=names, dtype=object)
                yield part

    return bodies.select(F.col("trace").cast("string"), "body").mapInPandas(walk, SCHEMA)


def documents_read(frames: DataFrame) -> DataFrame:
    """Of each document: its fault or null, and how many frames and levels it has."""
    return frames.groupBy("trace").agg(F.max("fault").alias("fault"), F.count("ordinal").alias("frames"), (F.max("depth") + 1).alias("levels"))
