"""Committed writes: what makes an append safe to retry, and a reader blind to half of one.

A table's folder holds a folder for every attempt at a write, ``write=<id>.<attempt>``, and a marker
file for every committed write, ``_commits/<id>``, which names the attempt that counts and what it
reported (a row count).  The marker appears whole, after the attempt's files are complete: a reader
that follows the markers sees a write wholly or not at all.  A write whose id has a marker is not
done again.  What a failed attempt left behind is in no marker, so it is never read, and is removed by
the next committed attempt of the same id.  Two attempts at once end with one marker.

A marker may say that it replaces others (``compact``): readers then leave those out.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from adlens.sources import paths

MARKERS = "_commits"
COLUMN = "write"


def new_id() -> str:
    return uuid.uuid4().hex


def _checked(write_id: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_-]+", write_id):
        raise ValueError(f"a write id is letters, digits, _ and -: {write_id!r}")
    return write_id


def markers(spark: SparkSession, path: str) -> dict[str, dict]:
    """Committed writes: id -> what its marker says."""
    root = f"{path.rstrip('/')}/{MARKERS}"
    return {n: json.loads(paths.read_text(spark, f"{root}/{n}")) for n in paths.names(spark, root) if not n.startswith(".")}


def current(spark: SparkSession, path: str) -> dict[str, str]:
    """Folders of the writes that count now: id -> path."""
    found = markers(spark, path)
    replaced = {i for m in found.values() for i in m.get("replaces", [])}
    return {i: f"{path.rstrip('/')}/{m['folder']}" for i, m in found.items() if i not in replaced}


def write_once(spark: SparkSession, path: str, write_id: str, write: Callable[[str], dict], replaces=()) -> dict:
    """Calls ``write(folder)`` and commits what it reports, unless ``write_id`` is committed; returns the
    committed report."""
    root = path.rstrip("/")
    marker = f"{root}/{MARKERS}/{_checked(write_id)}"
    if not paths.exists(spark, marker):
        folder = f"{COLUMN}={write_id}.{new_id()}"
        report = write(f"{root}/{folder}")
        paths.make_dir(spark, f"{root}/{MARKERS}")
        paths.publish_text(spark, marker, json.dumps(report | {"folder": folder, "replaces": list(replaces)}))
        counts = json.loads(paths.read_text(spark, marker))["folder"]
        for name in paths.names(spark, root):
            if name.startswith(f"{COLUMN}={write_id}.") and name != counts:
                paths.delete(spark, f"{root}/{name}")
    return json.loads(paths.read_text(spark, marker))
