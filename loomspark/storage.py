"""Cutting lineage, and small files that are replaced as a whole."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> None:
    """Use the shared folder in ``spark.checkpoint.dir``; a private one only on one machine, where that is unset."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isEmpty():
        return
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="loomspark-"))


def cut(frame: DataFrame) -> DataFrame:
    """The same rows, written to the checkpoint folder: a lost executor costs no recomputation."""
    checkpoint_folder(frame.sparkSession)
    return frame.checkpoint()


def write_json(path: str | Path, value: Any) -> None:
    """Replace a JSON file in one step; readers see the old or the new one."""
    path = Path(path)
    part = path.with_name(path.name + ".tmp")
    with part.open("w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, sort_keys=True)
        f.flush()
        os.fsync(f.fileno())
    part.replace(path)
    folder = os.open(path.parent, os.O_RDONLY)
    try:
        os.fsync(folder)
    finally:
        os.close(folder)


def read_json(path: str | Path) -> Any:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def sha256_file(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def publish(staging: str | Path, target: str | Path) -> None:
    """Rename a finished folder into place; a target with anything in it stays as it is."""
    target = Path(target)
    if target.exists() and any(target.iterdir()):
        raise FileExistsError(f"{target} is not empty")
    if target.exists():
        target.rmdir()
    os.replace(staging, target)


def latest_complete(folder: str | Path, prefix: str = "complete_") -> int | None:
    """Largest N among entries named complete_N."""
    found = [int(p.name[len(prefix) :]) for p in Path(folder).glob(f"{prefix}*") if p.name[len(prefix) :].isdigit()]
    return max(found, default=None)
