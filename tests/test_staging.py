"""Staged tables leave nothing behind but themselves."""

import os

from pyspark.sql import functions as F

from fraudspark.sources.staging import shared_dir, stage


def test_shuffle_files_go_with_a_staged_write(spark, tmp_path):
    def files():
        root = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {f for d in root.localDirsString() for a, _, fs in os.walk(d) for f in fs if f.endswith(".data")}

    before = files()
    rows = stage(spark.range(20_000).repartition(5, "id").groupBy(F.col("id") % 99).count(), "no-shuffle")
    assert not files() - before
    assert rows.count() == 99 and shared_dir(spark) in rows.inputFiles()[0].replace("file://", "")
