"""Preview requests waiting in cassette folders, one JSON file each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.times import try_revision_time
from ..schemas import PREVIEW_JSON

# folder below <cassette>/documents and the state it stands for
_STATES = {"preview-queue": "queued", "preview-processing": "processing", "preview-failed": "failed"}


def read_requests(spark: SparkSession, cassettes: DataFrame) -> DataFrame:
    """Requests of enabled cassettes with state and folder; an unreadable file keeps its row with null fields."""
    paths = sorted(r["path"] for r in cassettes.where("enabled").select("path").distinct().collect())  # configuration
    inside = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?)?(/.*)/documents/(preview-queue|preview-processing|preview-failed)/[^/]+$"
    rows = (spark.read.schema(PREVIEW_JSON).option("multiLine", "true").option("mode", "PERMISSIVE").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.json").json(paths).withColumn("file", F.col("_metadata.file_path")))
    states = F.create_map(*[F.lit(x) for pair in _STATES.items() for x in pair])
    roots = cassettes.where("enabled").select(
        F.col("id").alias("folder_cassette_id"), F.regexp_replace(F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), "/+$", "").alias("root"))
    found = rows.withColumn("root", F.regexp_extract("file", inside, 1)).withColumn("state", F.try_element_at(states, F.regexp_extract("file", inside, 2)))

    def when(name: str):
        return F.when(F.col(name).isNotNull(), try_revision_time(name))

    return found.where("state is not null").join(roots, "root").select(
        "folder_cassette_id", "state", F.col("requestId").alias("request_id"), when("requestedAtUtc").alias("requested_at"),
        F.col("cassetteId").alias("cassette_id"), F.col("documentUri").alias("document_uri"), F.col("folderName").alias("folder_name"),
        F.col("documentNumber").alias("document_number"), F.col("originalFileName").alias("original_file_name"),
        F.col("originalLength").alias("original_length"), F.col("originalSha256").alias("original_sha256"), "replaced",
        F.coalesce("attempt", F.lit(0)).alias("attempt"), when("notBeforeUtc").alias("not_before"), F.col("lastError").alias("last_error"))
