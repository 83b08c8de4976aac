"""Files (S): the events as log files, suppliers and parts as ontology files, suppliers as request files.

The files are written by tasks into the shared folder, once per session and tables, and read by the operators under test.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


from ..session import configure, scratch_folder
from ..schemas import CASSETTES
from ..sources import files, ontology_xml, preview_queue
from .inputs import O, literal_rows, table
from .registry import query

_WRITTEN: dict[tuple[str, str], str] = {}
_PER_FILE = 1000  # events of one log file
_RDF = 'xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"'


def put(rows: DataFrame, folder: str) -> None:
    """Writes (path, content) rows below ``folder``; a task that runs again writes the same files again."""
    def write(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                place = f"{root}/{path}"
                store.create_dir(place.rpartition("/")[0], recursive=True)
                with store.open_output_stream(place, compression=None) as out:
                    out.write(content.encode())
            yield pa.record_batch([batch.column(0)], names=["path"])

    rows.select("path", "content").mapInArrow(write, "path string").count()


def _event_files(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    number = F.floor(F.col("event_id") / _PER_FILE)
    user = F.concat(F.lit("user:"), F.col("user_id").cast("string"))
    about = F.concat(F.lit("event:"), F.col("event_id").cast("string"))
    swap = (F.col("event_type") == "click") & (F.col("event_id") % 7 == 0)
    record = (F.when(F.col("event_type") == "error", F.format_string('<delete id="%s"/>', about))
              .when(swap, F.format_string('<substitute old-id="%s"><newid rdf:resource="%s"/></substitute>', about, user))
              .otherwise(F.format_string('<%s rdf:about="%s" mT="%s"><name xml:lang="en">%s</name><by rdf:resource="%s"/></%s>', "event_type", about,
                                         F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "event_type", user, "event_type")))
    grouped = e.select(number.alias("number"), "event_id", record.alias("record")).groupBy("number").agg(
        F.array_sort(F.collect_list(F.struct("event_id", "record"))).alias("rows"))  # at most _PER_FILE records
    k = (F.col("number") % 5).cast("string")
    body = F.array_join(F.transform("rows", lambda r: r["record"]), "")
    return grouped.select(
        F.concat(F.lit("logs/Ev"), k, F.lit("/originals/"), F.lpad((F.col("number") % 10000).cast("string"), 4, "0"), F.lit("/"), F.col("number").cast("string"), F.lit(".fog")).alias("path"),
        F.concat(F.lit(f'<rdf:RDF {_RDF} dbid="db'), k, F.lit('">'), body, F.lit("</rdf:RDF>")).alias("content"))


def _folder(spark: SparkSession, sf: str) -> str:
    configure(spark)
    key = (spark.sparkContext.applicationId, sf)
    if key in _WRITTEN:
        return _WRITTEN[key]
    folder = f"{scratch_folder(spark)}/files-{key[0]}-{abs(hash(sf)):x}"
    folder = folder if ":" in folder.partition("/")[0] else f"file://{folder}"
    put(_event_files(spark, sf), folder)
    heads = spark.range(5).select(
        F.format_string("logs/Ev%d/meta/Ev%d_current.fog", "id", "id").alias("path"),
        F.format_string(f'<rdf:RDF {_RDF} dbid="db%d" owner="o%d"%s/>', "id", "id",
                        F.when(F.col("id") == 3, "").otherwise(F.format_string(' prefix="p%d" counter="%d"', "id", F.col("id") + 100))).alias("content"))
    put(heads, folder)
    makers = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("k"), F.format_string('<Class rdf:about="maker%d" abstract="yes"><label xml:lang="en">%s</label></Class>', "s_suppkey", "s_name").alias("x"))
    parts = table(spark, sf, "part").select(
        F.col("p_partkey").alias("k"), F.format_string(
            '<DatatypeProperty rdf:about="in%d" priority="%d" essential="%d"><label xml:lang="en">%s</label><domain rdf:resource="size%d"/></DatatypeProperty>',
            "p_partkey", "p_size", F.col("p_size") % 2, "p_name", "p_size").alias("x"))
    for kind, rows in (("maker", makers), ("part", parts)):
        listed = rows.groupBy(F.floor(F.col("k") / _PER_FILE).alias("number")).agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("rows"))  # at most _PER_FILE terms
        put(listed.select(F.concat(F.lit(f"ontology/{kind}-"), F.col("number").cast("string"), F.lit(".xml")).alias("path"),
                          F.concat(F.lit(f"<Ontology {_RDF}>"), F.array_join(F.transform("rows", lambda r: r["x"]), ""), F.lit("</Ontology>")).alias("content")), folder)
    s = table(spark, sf, "supplier")
    state = F.element_at(F.array(F.lit("preview-queue"), F.lit("preview-processing"), F.lit("preview-failed")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    put(s.select(F.concat(F.lit("logs/Ev"), (F.col("s_suppkey") % 5).cast("string"), F.lit("/documents/"), state, F.lit("/"), F.col("s_suppkey").cast("string"), F.lit(".json")).alias("path"),
                 F.to_json(F.struct(F.col("s_name").alias("requestId"), F.lit("2024-01-01T00:00:00+00:00").alias("requestedAtUtc"), F.lit("iiss://A@h/0001/0002").alias("documentUri"),
                                    F.col("s_nationkey").alias("attempt"))).alias("content")), folder)
    _WRITTEN[key] = folder
    return folder


def _cassettes(spark: SparkSession, folder: str) -> DataFrame:
    rows = [(f"ev{k}", f"Ev{k}", f"{folder}/logs/Ev{k}", True, "read", k != 4, k) for k in range(5)]
    return literal_rows(spark, rows, CASSETTES + ", position int")


def _short():
    return F.regexp_extract("source_path", "/logs/(.*)$", 1).alias("file")

_FILES_SQL = """logs AS (SELECT DISTINCT n % 5 AS k, 'Ev' || (n % 5) || '/originals/' || lpad((n % 10000)::VARCHAR, 4, '0') || '/' || n || '.fog' AS file, false AS is_metadata FROM (SELECT event_id // 1000 AS n FROM events)
UNION ALL SELECT k, 'Ev' || k || '/meta/Ev' || k || '_current.fog', true FROM range(5) t(k))"""


@query("s1_list_logs", f"WITH {_FILES_SQL} SELECT 'ev' || k AS cassette_id, file, is_metadata, k <> 4 AS allow_write FROM logs")
def _(spark, sf):
    found = files.list_logs(spark, _cassettes(spark, _folder(spark, sf)))
    return found.select("cassette_id", _short(), "is_metadata", "allow_write")


@query("s2_log_headers", f"""WITH {_FILES_SQL} SELECT 'ev' || k AS cassette_id, file, 'db' || k AS db_id, CASE WHEN is_metadata THEN 'o' || k END AS owner,
CASE WHEN is_metadata AND k <> 3 THEN 'p' || k END AS prefix, CASE WHEN is_metadata AND k <> 3 THEN k + 100 END AS counter, is_metadata AND k NOT IN (3, 4) AS writable FROM logs""")
def _(spark, sf):
    found = files.describe_logs(spark, _cassettes(spark, _folder(spark, sf)))
    return found.select("cassette_id", _short(), "db_id", "owner", "prefix", "counter", "writable")


@query("s3_s4_log_records", f"""SELECT 'ev' || ((event_id // 1000) % 5) AS cassette_id, (row_number() OVER (PARTITION BY event_id // 1000 ORDER BY event_id) - 1)::BIGINT AS ordinal, 'event:' || event_id AS resource_id,
CASE WHEN event_type = 'error' THEN 'delete' WHEN event_type = 'click' AND event_id % 7 = 0 THEN 'substitute' ELSE 'resource' END AS kind,
CASE WHEN event_type <> 'error' AND NOT (event_type = 'click' AND event_id % 7 = 0) THEN '{O}' || event_type END AS type,
CASE WHEN event_type = 'click' AND event_id % 7 = 0 THEN 'user:' || user_id END AS substitute_target,
CASE WHEN event_type <> 'error' AND NOT (event_type = 'click' AND event_id % 7 = 0) THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS modified_at_raw,
CASE WHEN event_type <> 'error' AND NOT (event_type = 'click' AND event_id % 7 = 0) THEN '{O}name=' || event_type || ';{O}by=user:' || user_id ELSE '' END AS props FROM events""")
def _(spark, sf):
    # a log here is some 170 kB: each is read in ranges by several tasks
    found = files.read_records(spark, _cassettes(spark, _folder(spark, sf)), split_bytes=1 << 16)
    shown = F.array_join(F.transform("props", lambda p: F.concat_ws("=", p["predicate"], p["value"])), ";")
    return found.select("cassette_id", "ordinal", "resource_id", "kind", "type", "substitute_target", "modified_at_raw", shown.alias("props"))


@query("s5_ontology_terms", """SELECT 'maker' || s_suppkey AS id, 'Class' AS kind, s_name AS label, CAST(NULL AS VARCHAR) AS priority, '' AS domains, true AS is_abstract, false AS is_essential FROM supplier
UNION ALL SELECT 'in' || p_partkey, 'DatatypeProperty', p_name, p_size::VARCHAR, 'size' || p_size, false, p_size % 2 = 1 FROM part""")
def _(spark, sf):
    terms = ontology_xml.read_ontology(spark, f"{_folder(spark, sf)}/ontology")
    return terms.select("id", "kind", F.col("labels")[0]["value"].alias("label"), "priority", F.array_join("domains", ",").alias("domains"), "is_abstract", "is_essential")


@query("s6_preview_requests", """SELECT 'ev' || (s_suppkey % 5) AS folder_cassette_id, ['queued', 'processing', 'failed'][s_suppkey % 3 + 1] AS state, s_name AS request_id, s_nationkey AS attempt FROM supplier""")
def _(spark, sf):
    found = preview_queue.read_requests(spark, _cassettes(spark, _folder(spark, sf)))
    return found.select("folder_cassette_id", "state", "request_id", "attempt")
