"""Published tables survive failed jobs; one checkpoint folder; cast forms."""

import glob
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from cartwise.functions import safe_int
from cartwise.sources import sinks


def test_a_failed_job_leaves_the_former_table(spark, scratch):
    path = os.path.join(scratch, "topk")
    with pytest.raises(FileNotFoundError, match="published"):
        sinks.read_published(spark, path)
    sinks.publish(spark.range(100).withColumn("p_buy", F.lit(0.5)), path)
    # killed half way: some tasks have written their files when one fails
    half = spark.range(0, 400, 1, 8).withColumn(
        "p_buy", F.when(F.col("id") < 390, F.lit(0.7)).otherwise(F.raise_error(F.lit("lost")).cast("double")))
    with pytest.raises(Exception, match="lost"):
        sinks.publish(half, path)
    assert sinks.read_published(spark, path).filter("p_buy = 0.5").count() == 100
    sinks.publish(spark.range(7).withColumn("p_buy", F.lit(0.9)), path)
    assert sinks.read_published(spark, path).count() == 7


def test_readers_keep_the_version_they_began_on(spark, scratch):
    path = os.path.join(scratch, "topk")
    sinks.publish(spark.range(5), path)
    begun = sinks.read_published(spark, path)
    sinks.publish(spark.range(6), path)
    assert begun.count() == 5 and sinks.read_published(spark, path).count() == 6
    sinks.publish(spark.range(8), path)
    assert len(glob.glob(f"{path}/versions/*")) == 2          # the current one and the one before
    assert not glob.glob(f"{path}/pointer-*")


def test_casts_of_every_form_equal_the_lenient_cast(spark):
    forms = ["5", "5.7", ".5", "-.5", "+.5", "5.", "-5.9", " 7 ", " 7.2 ", "", " ", "+", "-", "abc", "1.2.3", "1e3", "x5",
             "5x", "5.x", "2147483647", "2147483648", "-2147483648.9", "007", "--1", "1 2", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(forms)], "i int, s string")
    got = [r[0] for r in df.orderBy("i").select(safe_int("s")).collect()]
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        want = [r[0] for r in df.orderBy("i").select(F.col("s").cast("int")).collect()]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")
    assert got == want
    assert dict(zip(forms, got, strict=True))["-.5"] == 0 and dict(zip(forms, got, strict=True))[".5"] == 0


STREAM = """
import sys
from cartwise.config import build_session, checkpoint_dir
from cartwise.streaming import read_stream, write_stream
root, rows = sys.argv[1], int(sys.argv[2])
spark = build_session("local[2]", shuffle_partitions=2, extra_conf={"spark.checkpoint.dir": root + "/ckpt"})
spark.range(rows).write.parquet(f"{root}/in/{rows}")
q = write_stream(read_stream(spark, root + "/in/*", "id long"), root + "/out", "feed", trigger_once=True)
q.awaitTermination()
print("FOLDER", checkpoint_dir(spark), spark.read.parquet(root + "/out").count())
spark.stop()
"""


def test_a_stream_resumes_in_the_next_application(scratch):
    said = []
    for rows in (10, 5):
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        run = subprocess.run([sys.executable, "-c", STREAM, scratch, str(rows)], capture_output=True, text=True,
                             env=os.environ | {"PYTHONPATH": root}, timeout=300)
        assert run.returncode == 0, run.stderr[-2000:]
        said.append(next(x for x in run.stdout.splitlines() if x.startswith("FOLDER")))
    assert said == [f"FOLDER {scratch}/ckpt 10", f"FOLDER {scratch}/ckpt 15"]


def test_the_checkpoint_folder_has_one_answer(spark):
    from cartwise.config import checkpoint_dir
    from cartwise.plans.materialize import scratch_path
    assert checkpoint_dir(spark) == checkpoint_dir(spark) and scratch_path(spark, "x") == scratch_path(spark, "x")
    assert spark.sparkContext.applicationId in scratch_path(spark, "x")
