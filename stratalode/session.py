"""What a session needs before Python code of this library runs in its workers."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


#: Bytes of rows handed to a Python worker at once, about; rows are texts, and ten thousand long ones would fill it.
BATCH_BYTES = 4 << 20


def share_code(spark: SparkSession) -> SparkSession:
    """Workers find this library where the driver found it, whatever their working folder is, and get rows in batches of bounded bytes."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit, None) is None:
        spark.conf.set(limit, str(BATCH_BYTES))
    return spark


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset (local runs)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="stratalode-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/stratalode/{name}-{uuid.uuid4().hex}"
