"""Shared scratch space for tables that cut lineage or hold streaming state."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, purpose: str, root: str | None = None) -> str:
    """A fresh folder below ``root`` or the cluster's ``spark.checkpoint.dir``.

    Where neither is given, a session on one machine gets a temporary folder; a
    cluster raises, because its executors would write to disks of their own.
    """
    root = root or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("name a folder that driver and executors share, or set spark.checkpoint.dir")
        root = tempfile.mkdtemp(prefix="talentloom-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
