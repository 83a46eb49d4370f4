"""An append log of small documents in a shared folder: one JSON file per commit, numbered
without gaps, each put only if its number is free. Writers that race get different numbers and
see each other's commits; none is lost and none is overwritten.

The put needs a file system whose move without overwrite is atomic: a local or network folder
(hard link) or one with an atomic rename such as HDFS. Object stores need a conditional put.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def _hadoop(spark: SparkSession, path: str):
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _hadoop(spark, path)
    return fs.exists(place)


def remove(spark: SparkSession, path: str) -> bool:
    fs, place = _hadoop(spark, path)
    return fs.delete(place, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Moves a file or folder to a new name, whose parents are made."""
    fs, place = _hadoop(spark, path)
    target = _hadoop(spark, to)[1]
    fs.mkdirs(target.getParent())
    if not fs.rename(place, target):
        raise OSError(f"cannot move {path} to {to}")


def names(spark: SparkSession, path: str) -> list[str]:
    fs, place = _hadoop(spark, path)
    if not fs.exists(place):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(place))


def read_text(spark: SparkSession, path: str) -> str:
    fs, place = _hadoop(spark, path)
    stream = fs.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Writes the whole text under ``path``, or nothing where the path is taken. Readers never
    see a part: the text is written beside it under a hidden name and then moved."""
    fs, place = _hadoop(spark, path)
    fs.mkdirs(place.getParent())
    if fs.exists(place):
        return False
    jvm = spark._jvm
    hidden = jvm.org.apache.hadoop.fs.Path(
        place.getParent(), f".{place.getName()}.{uuid.uuid4().hex}"
    )
    stream = fs.create(hidden, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    try:
        if fs.getUri().getScheme() == "file":
            try:
                os.link(_local(fs, hidden), _local(fs, place))
            except FileExistsError:
                return False
            return True
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        none = spark.sparkContext._gateway.new_array(rename, 1)
        none[0] = rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            fs.getUri(), spark._jsc.hadoopConfiguration()
        )
        try:
            context.rename(fs.makeQualified(hidden), fs.makeQualified(place), none)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                return False
            raise
        return True
    finally:
        fs.delete(hidden, False)


def _local(fs, place) -> str:
    return fs.makeQualified(place).toUri().getPath()


class CommitLog:
    """Commits 1, 2, ... under ``path``. Every document carries its number as ``commit``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path.rstrip("/")

    def _file(self, number: int) -> str:
        return f"{self.path}/{number:012d}.json"

    def _last_number(self) -> int:
        """Numbers have no gaps, so the last is found by doubling and halving, not by listing
        a log of any length."""
        low, high = 0, 1
        while exists(self.spark, self._file(high)):
            low, high = high, high * 2
        while high - low > 1:
            middle = (low + high) // 2
            if exists(self.spark, self._file(middle)):
                low = middle
            else:
                high = middle
        return low

    def last(self) -> dict | None:
        number = self._last_number()
        return json.loads(read_text(self.spark, self._file(number))) if number else None

    def append(self, build: Callable[[dict | None], dict | None]) -> dict | None:
        """Commits what ``build`` makes of the last document. A writer that loses a number
        builds anew on the winner's document; ``None`` from ``build`` gives up."""
        while True:
            last = self.last()
            document = build(last)
            if document is None:
                return None
            number = (last["commit"] if last else 0) + 1
            document = {**document, "commit": number}
            if put_if_absent(self.spark, self._file(number), json.dumps(document)):
                return document

    def rows(self, schema: str) -> DataFrame:
        """All commits as a table; no commit yet gives no row."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json(self.path)
