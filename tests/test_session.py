"""What a written intermediate leaves on the disks."""

import os
import time
from urllib.parse import urlparse

from pyspark.sql import functions as F

from ranktide.session import checkpoint_dir, cut_lineage, released


def _shuffles(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for top in dirs for p, _, fs in os.walk(top) for f in fs if f.startswith("shuffle_")}


def test_a_written_frame_keeps_no_shuffle_files(spark):
    before = _shuffles(spark)
    kept = cut_lineage(spark.range(5000).groupBy((F.col("id") % 100).alias("k")).count())
    for _ in range(50):   # they are deleted in the background
        if not _shuffles(spark) - before:
            break
        time.sleep(0.2)
    assert not _shuffles(spark) - before
    assert kept.count() == 100 and kept.agg(F.sum("count")).first()[0] == 5000


def test_a_released_frame_keeps_no_files(spark):
    folder = urlparse(checkpoint_dir(spark)).path
    files = lambda: {f"{p}/{f}" for p, _, fs in os.walk(folder) for f in fs}
    before = files()
    kept = cut_lineage(spark.range(10))
    assert files() - before
    released(kept)
    assert not files() - before
