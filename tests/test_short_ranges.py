"""Many short ranges share tasks."""

from pyspark.sql import functions as F

from factloom.sources import files, log_splits

from .helpers import rows

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


def test_tasks_follow_bytes_and_cores():
    assert log_splits.task_count(0, 0, 4) == 1 and log_splits.task_count(7, 7 << 26, 4) == 7
    assert log_splits.task_count(72_000, 6 << 30, 12) == 96 and log_splits.task_count(72_000, 1 << 20, 12) == 48


def test_short_ranges_of_many_logs(spark, tmp_path):
    for i in range(30):
        with open(f"{tmp_path}/log{i}.fog", "w", encoding="utf-8") as out:
            out.write(f'<r:RDF xmlns:r="{RDF}">' + "".join(f'<p r:about="{i}-{k}"><name>n{k}</name></p>' for k in range(40)) + "</r:RDF>")
    shown = ("source_path", "ordinal", "name", F.to_json("attrs").alias("a"), F.to_json("children").alias("c"))
    split = files.parse_files(spark, [str(tmp_path)], split_bytes=100)
    assert rows(split, *shown) == rows(files.parse_files(spark, [str(tmp_path)]), *shown)
    tasks = split.select(F.spark_partition_id().alias("task")).distinct().count()
    assert 8 <= tasks <= 4 * spark.sparkContext.defaultParallelism  # of some 480 ranges
