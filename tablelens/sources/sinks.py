"""Report sinks (S9): every result is a DataFrame; written by Spark, not printed.

``write_report`` writes frames one by one; ``commit_report`` makes them visible
together, and ``read_report`` reads the last report that was written whole.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def write_report(
    frames: Mapping[str, DataFrame], path: str, fmt: str = "parquet", mode: str = "overwrite"
) -> dict[str, str]:
    """Write each frame to ``<path>/<name>``; returns the written locations."""
    out = {}
    for name, frame in frames.items():
        target = os.path.join(path, name)
        frame.write.mode(mode).format(fmt).save(target)
        out[name] = target
    return out


_MANIFEST = "versions"
_MANIFEST_SCHEMA = "version string, nth bigint, name string, fmt string"


def commit_report(frames: Mapping[str, DataFrame], path: str, fmt: str = "parquet") -> str:
    """Write all frames as one version of the report at ``path``, or none; the version's name.

    Frames go to ``<path>/<version>/<name>``; the manifest that names them is
    written last, by one task and in one move, so ``read_report`` sees a whole
    report or the one before it, whatever write fails or is read meanwhile.
    Earlier versions stay; nothing is written over.
    """
    spark, version = None, f"v-{uuid.uuid4().hex[:12]}"
    names = []
    for name, frame in frames.items():
        spark = frame.sparkSession
        frame.write.format(fmt).save(os.path.join(path, version, name))
        names.append(name)
    if spark is None:
        raise ValueError("a report needs a frame")
    nth = max([r["nth"] for r in _versions(spark, path).select("nth").distinct().collect()], default=0) + 1
    rows = [(version, nth, name, fmt) for name in names]
    spark.createDataFrame(rows, _MANIFEST_SCHEMA).coalesce(1).write.mode("append").json(os.path.join(path, _MANIFEST))
    return version


def _versions(spark: SparkSession, path: str) -> DataFrame:
    """The manifest: a row for each frame of each whole version."""
    try:
        return spark.read.schema(_MANIFEST_SCHEMA).json(os.path.join(path, _MANIFEST))
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in (missing.getCondition() or ""):
            raise
        return spark.createDataFrame([], _MANIFEST_SCHEMA)


def read_report(spark: SparkSession, path: str, version: str | None = None) -> dict[str, DataFrame]:
    """The frames of the last whole version of the report at ``path`` (or of a named one)."""
    rows = _versions(spark, path).collect()  # a few names for each version
    if version is None:
        version = max(((r["nth"], r["version"]) for r in rows), default=(0, None))[1]
    own = [r for r in rows if r["version"] == version]
    if not own:
        raise ValueError(f"no whole report at {path}" if version is None else f"no whole version {version} at {path}")
    return {r["name"]: spark.read.format(r["fmt"]).load(os.path.join(path, version, r["name"])) for r in own}
