"""Derived tables kept in a shared folder and reused while their input files are the same.

An entry is named by what it was made from: names, sizes and times of all input files and the
parameters. It is used by any session that sees the folder, and removed when a newer entry is
there and nobody holds it.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fraudspark.sources import commits as C
from fraudspark.sources.staging import shared_dir


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """A hash of the names, sizes and times of all files under ``paths``, taken by Spark, so that
    the driver holds one row however many files there are. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    # Whole digits: sums of hashes may leave a long.
    mark = F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))
    row = files.agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
        mark.alias("mark"),
    ).first()
    return f"{row.files}:{row.bytes}:{row.mark}"


class DerivedTables:
    """Entries of one kind under ``<shared folder>/derived/<name>``.

    ``holds`` has a file per use of an entry. A session that dies leaves its holds; they count
    for ``hold_hours`` only.
    """

    def __init__(
        self,
        spark: SparkSession,
        name: str,
        root: str | None = None,
        hold_hours: float = 48.0,
    ) -> None:
        self.spark = spark
        self.base = f"{(root or shared_dir(spark) + '/derived').rstrip('/')}/{name}"
        self.hold_ms = hold_hours * 3_600_000
        self.held: list[str] = []

    def key(self, sources: list[str], parameters: str) -> str:
        text = f"{fingerprint(self.spark, sources)}|{sorted(sources)}|{parameters}"
        return hashlib.sha256(text.encode()).hexdigest()[:32]

    def _manifest(self, key: str) -> str:
        return f"{self.base}/manifests/{key}.json"

    def _entry(self, key: str) -> dict | None:
        path = self._manifest(key)
        if not C.exists(self.spark, path):
            return None
        entry = json.loads(C.read_text(self.spark, path))
        return entry if C.exists(self.spark, f"{entry['data']}/_SUCCESS") else None

    def get(
        self, sources: list[str], parameters: str, make: Callable[[], DataFrame]
    ) -> DataFrame:
        """The entry for these inputs, made by ``make`` and stored where there is none. The
        inputs are looked at before ``make`` reads them: files that change meanwhile give the
        next caller another key. Two sessions that make the same entry both succeed, and the
        copy of the second one is dropped."""
        key = self.key(sources, parameters)
        self._hold(key)
        entry = self._entry(key)
        if entry is None:
            entry = self._store(key, make())
        schema = StructType.fromJson(entry["schema"])
        return self.spark.read.schema(schema).parquet(entry["data"])

    def _store(self, key: str, table: DataFrame) -> dict:
        data = f"{self.base}/data/{key}-{uuid.uuid4().hex}"
        table.write.parquet(data)
        entry = {
            "key": key,
            "data": data,
            "schema": table.schema.jsonValue(),
            "made_ms": int(time.time() * 1000),
        }
        while not C.put_if_absent(self.spark, self._manifest(key), json.dumps(entry)):
            other = self._entry(key)
            if other is not None:
                C.remove(self.spark, data)
                return other
            # A manifest whose data is gone.
            C.remove(self.spark, self._manifest(key))
        return entry

    def _hold(self, key: str) -> None:
        path = f"{self.base}/holds/{key}/{uuid.uuid4().hex}.json"
        C.put_if_absent(self.spark, path, json.dumps({"at_ms": int(time.time() * 1000)}))
        self.held.append(path)

    def release(self) -> None:
        """Gives up every entry this object has handed out."""
        for path in self.held:
            C.remove(self.spark, path)
        self.held.clear()

    def holds(self, key: str, now_ms: int) -> int:
        folder = f"{self.base}/holds/{key}"
        alive = 0
        for name in C.names(self.spark, folder):
            path = f"{folder}/{name}"
            if not name.startswith(".") and C.exists(self.spark, path):
                at = json.loads(C.read_text(self.spark, path))["at_ms"]
                alive += now_ms - at <= self.hold_ms
        return alive

    def sweep(self, now_ms: int | None = None) -> list[str]:
        """Removes entries that nobody holds, but for the newest; returns their keys.

        A user holds first and looks for the manifest then; the sweep takes the manifest away
        first and counts holds then. So either the user finds no manifest and makes the entry
        anew, or the sweep sees the hold and puts the manifest back.
        """
        now = int(time.time() * 1000) if now_ms is None else now_ms
        folder = f"{self.base}/manifests"
        found = [
            json.loads(C.read_text(self.spark, f"{folder}/{n}"))
            for n in C.names(self.spark, folder)
            if n.endswith(".json") and not n.startswith(".")
        ]
        found.sort(key=lambda e: (e["made_ms"], e["key"]))
        gone = []
        for entry in found[:-1]:
            key = entry["key"]
            if self.holds(key, now):
                continue
            C.remove(self.spark, self._manifest(key))
            if self.holds(key, now):
                C.put_if_absent(self.spark, self._manifest(key), json.dumps(entry))
                continue
            C.remove(self.spark, entry["data"])
            C.remove(self.spark, f"{self.base}/holds/{key}")
            gone.append(key)
        return gone
