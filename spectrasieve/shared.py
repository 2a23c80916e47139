"""The folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_OWN: list[str] = []


def folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local session (tests) may leave it unset; then a temporary folder is made.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="spectrasieve-"))
    return f"file://{_OWN[0]}"


def new_files(spark: SparkSession) -> str:
    """A new folder below :func:`folder` that driver and executors see as plain files."""
    base = folder(spark)
    if not base.startswith(("file:", "/")):
        raise ValueError("documents need a spark.checkpoint.dir of plain files (file:...) that all executors mount")
    os.makedirs(base := base.removeprefix("file://").removeprefix("file:"), exist_ok=True)
    return tempfile.mkdtemp(dir=base)
