"""Datasets, exports and the run log: folders with a manifest, listed and appended to."""

from __future__ import annotations

import json
import os
import re
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def slugify(name: str) -> str:
    """Letters and digits of a name in ASCII, the rest as single hyphens."""
    plain = name.translate(str.maketrans({"ø": "o", "Ø": "O", "æ": "ae", "Æ": "AE", "å": "a", "Å": "A"}))
    folded = unicodedata.normalize("NFKD", plain).encode("ascii", "ignore").decode().lower()
    return re.sub(r"[^a-z0-9]+", "-", folded).strip("-") or "dataset"


def unique_dir(root: str, slug: str) -> str:
    """The first of slug, slug-2, slug-3, ... that isn't there."""
    path, k = os.path.join(root, slug), 1
    while os.path.exists(path):
        k += 1
        path = os.path.join(root, f"{slug}-{k}")
    return path


def write_manifest(folder: str, name: str, content: dict) -> None:
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        json.dump(content, f, indent=2, sort_keys=True)


def read_manifest(folder: str, name: str, starts: str | None = None) -> dict:
    """The manifest of a folder; of another format than ``starts`` it raises."""
    with open(os.path.join(folder, name), encoding="utf-8") as f:
        content = json.load(f)
    if starts and not str(content.get("format", "")).startswith(starts):
        raise ValueError(f"{folder}: format {content.get('format')!r}")
    return content


def list_folders(root: str, name: str) -> list[tuple[str, dict]]:
    """Folders under ``root`` with a readable manifest, the newest (``created_utc``) first; broken ones are passed over."""
    found = []
    for folder in sorted(os.listdir(root)) if os.path.isdir(root) else []:
        try:
            found.append((os.path.join(root, folder), read_manifest(os.path.join(root, folder), name)))
        except (OSError, ValueError):
            continue
    return sorted(found, key=lambda x: str(x[1].get("created_utc", "")), reverse=True)


def append_run(spark: SparkSession, path: str, record: dict) -> None:
    """Append a record to the run log, a folder of JSON lines."""
    spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.mode("append").text(path)


def read_runs(spark: SparkSession, path: str, limit: int = 2000) -> DataFrame:
    """The last ``limit`` records by ``at``, newest first: ``at, record`` (JSON text); lines that are no JSON objects are left out."""
    lines = spark.read.text(path).select(F.get_json_object("value", "$.at").alias("at"), F.col("value").alias("record"))
    return lines.where(F.from_json("record", "map<string,string>").isNotNull() & F.col("record").startswith("{")).orderBy(F.desc("at")).limit(limit)


def folder_bytes(path: str) -> int:
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)
