"""What tables of scratch and their shuffles leave on disk."""

import glob
import time

from pyspark.sql import functions as F

from tidemark.llm import common, ngram_join


def shuffles(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for i in range(files.size()) if (n := files.apply(i).getName()).startswith("shuffle_")}


def test_a_cut_leaves_no_shuffle_files_and_the_setting_as_it_was(spark):
    before, setting = shuffles(spark), spark.conf.get(common.CLEANUP, None)
    assert common.cut(spark.range(1000).groupBy(F.col("id") % 10).count(), "counts").count() == 10
    for _ in range(50):
        if not (left := {x for x in shuffles(spark) - before if x.endswith(".data")}):
            break
        time.sleep(0.1)
    assert spark.conf.get(common.CLEANUP, None) == setting
    # the count above has a shuffle of its own, of one row
    assert len(left) <= 1, left


def test_the_sketches_do_not_outlive_the_join(spark):
    base = common.scratch_dir(spark).removeprefix("file://")
    old = set(glob.glob(f"{base}/tidemark-*/*"))
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, "something else of five words"), (4, None)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in ngram_join.ngram_join(docs).collect()} == {(1, 1), (2, 1), (3, 3), (4, 4)}
    left = {x.rpartition("/")[2] for x in set(glob.glob(f"{base}/tidemark-*/*")) - old}
    assert "sets" in left and not left & {"sketches", "found", "common", "kept"}, left
