"""Log files of cassette folders: listing, headers and records.

A cassette folder holds ``meta/*.fog`` (one of them is its metadata log) and ``originals/????/*.fog``. A log is an
XML document whose root is RDF and whose children are records. A file up to ``SPLIT_BYTES`` is parsed by one task in one
pass that gives its root and its records; longer ones are read by many tasks, see ``log_splits``. What was parsed is kept.
A log of zero bytes is no XML and an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .. import vocab as v
from ..functions.ids import anonymous_id, clean_id, iri, is_blank
from ..functions.times import revision_time
from ..session import cut_lineage, small
from . import log_splits

ANONYMOUS_PREFIX = "urn:factloom:anonymous:"
SPLIT_BYTES = 1 << 26  # longer files are read in ranges of this size

_ELEMENTS = ("source_path string, ordinal bigint, name string, attrs map<string,string>, "
             "children array<struct<name:string,attrs:map<string,string>,value:string>>")
ROOT = -1  # ordinal of the row that holds the root element


def element_reader():
    """The reader of one log: the root, then its children. Built as a closure so that executors get it by value."""
    root_ordinal = ROOT
    namespaces = {v.RDF_NS: "rdf:", v.XML_NS: "xml:"}

    def key(name: str) -> str:
        space, _, local = name.rpartition(" ")
        return namespaces.get(space, "") + local

    def read(path: str, chunks: Iterator[bytes], prolog: bytes = b"", ordinal: int = 0, begin: int = 0, stop: int | None = None) -> Iterator[tuple]:
        """Rows of a document, or of its bytes from ``begin`` on after its ``prolog`` (which gives no row), up to the first record at ``stop`` or later."""
        from xml.parsers import expat

        ready: list[tuple] = []
        state = {"depth": 0, "ordinal": ordinal, "record": None, "child": None, "text": [], "chunk": [], "over": False}
        parser = expat.ParserCreate(namespace_separator=" ")
        parser.buffer_text = True

        def flush() -> None:
            chunk = "".join(state["chunk"])
            state["chunk"] = []
            if chunk.strip(" \t\r\n"):  # white space between tags is no content
                state["text"].append(chunk)

        def start(name: str, attrs: dict) -> None:
            if state["depth"] == 1 and stop is not None and begin + parser.CurrentByteIndex - len(prolog) >= stop:
                state["over"] = True
            if state["over"]:
                return
            flush()
            state["depth"] += 1
            named = {key(k): x for k, x in attrs.items()}
            local = name.rpartition(" ")[2]
            if state["depth"] == 1:
                ready.extend([] if prolog else [(path, root_ordinal, local, named, [])])
            elif state["depth"] == 2:
                state["record"] = (local, named, [])
            elif state["depth"] == 3:
                state["child"], state["text"] = (local, named), []

        def end(name: str) -> None:
            if state["over"]:
                return
            flush()
            if state["depth"] == 3:
                local, named = state["child"]
                state["record"][2].append({"name": local, "attrs": named, "value": "".join(state["text"])})
            elif state["depth"] == 2:
                local, named, children = state["record"]
                ready.append((path, state["ordinal"], local, named, children))
                state["ordinal"] += 1
            state["depth"] -= 1

        def refuse(*_: object) -> None:
            raise ValueError(f"document types are not allowed: {path}")

        parser.StartElementHandler, parser.EndElementHandler = start, end
        parser.CharacterDataHandler = lambda text: state["chunk"].append(text)
        parser.StartDoctypeDeclHandler = refuse
        try:
            parser.Parse(prolog, False)
            for data in chunks:
                parser.Parse(data, False)
                yield from ready
                ready.clear()
                if state["over"]:
                    return
            parser.Parse(b"", True)
            yield from ready
        except expat.ExpatError as error:
            raise ValueError(f"log cannot be read: {path}: {error}") from error

    return read


def _whole_files():
    """Rows of files given with their content."""
    read, batch_rows, step = element_reader(), 2_000, 1 << 20

    def chunks(content: bytes) -> Iterator[bytes]:
        yield from (content[at:at + step] for at in range(0, len(content), step))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["source_path", "ordinal", "name", "attrs", "children"]
        held: list[tuple] = []
        for frame in batches:
            for path, content in zip(frame["path"], frame["content"]):
                for row in read(path, chunks(content)):
                    held.append(row)
                    if len(held) >= batch_rows:
                        yield pd.DataFrame(held, columns=names)
                        held = []
        if held:
            yield pd.DataFrame(held, columns=names)

    return rows


def _files(spark: SparkSession, paths: list[str], glob: str) -> DataFrame:
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(paths))


def _refuse_empty(files: DataFrame) -> None:
    """The file source passes over files of zero bytes; its listing, which the driver holds anyway, shows them."""
    listed = {unquote(x) for x in files.inputFiles()}
    there = files.select("path").count()
    if there != len(listed):
        read = files.select("path").sparkSession.createDataFrame([(x,) for x in sorted(listed)], "listed string")
        missing = read.join(files.select("path"), F.regexp_replace("listed", "^file:/+", "file:/") == F.regexp_replace("path", "^file:/+", "file:/"), "left_anti")
        raise ValueError(f"logs of zero bytes: {sorted(r['listed'] for r in missing.limit(5).collect())}")


def parse_files(spark: SparkSession, paths: list[str], glob: str = "*.[fF][oO][gG]", split_bytes: int | None = None) -> DataFrame:
    """(source_path, ordinal, name, attrs, children): the root (ordinal -1) and the depth-1 elements of XML files below the paths."""
    files, split = _files(spark, paths, glob), SPLIT_BYTES if split_bytes is None else split_bytes
    whole = files.where(F.col("length") <= split).select("path", "content").mapInPandas(_whole_files(), StructType.fromDDL(_ELEMENTS))
    long = files.where(F.col("length") > split).select("path", "length")
    return whole if long.isEmpty() else whole.union(log_splits.read_split(long, split, element_reader, _ELEMENTS))


def read_elements(spark: SparkSession, paths: list[str], glob: str = "*.[fF][oO][gG]", split_bytes: int | None = None) -> DataFrame:
    """The depth-1 elements of XML files below the paths."""
    return parse_files(spark, paths, glob, split_bytes).where(F.col("ordinal") != ROOT)


def read_headers(spark: SparkSession, paths: list[str], glob: str = "*.[fF][oO][gG]") -> DataFrame:
    """(source_path, db_id, uri, owner, prefix, counter) from root attributes; a root other than RDF is an error."""
    return headers_of(parse_files(spark, paths, glob))


def headers_of(parsed: DataFrame) -> DataFrame:
    """The header fields of parsed files."""
    found = parsed.where(F.col("ordinal") == ROOT).select("source_path", F.col("name").alias("root"), "attrs")
    a = lambda name: F.try_element_at("attrs", F.lit(name))
    text = F.when(F.col("root") == "RDF", a("counter")).otherwise(
        F.raise_error(F.concat(F.lit("the root element must be RDF: "), "source_path")).cast("string"))
    counter = F.when(~is_blank(text), F.coalesce(text.try_cast("bigint"), F.raise_error(
        F.concat(F.lit("counter is no integer in "), "source_path")).cast("bigint")))
    return found.select("source_path", a("dbid").alias("db_id"), a("uri").alias("uri"), a("owner").alias("owner"),
                        a("prefix").alias("prefix"), counter.alias("counter"))


_INSIDE = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?)?(/.*)/(meta/[^/]+|originals/[^/]{4}/[^/]+)$"


def _folders(cassettes: DataFrame) -> list[str]:
    """Paths of the enabled cassettes: configuration, one per folder."""
    return sorted(r["path"] for r in cassettes.where("enabled").select("path").distinct().collect())


def list_logs(spark: SparkSession, cassettes: DataFrame) -> DataFrame:
    """Log files of enabled cassettes: (cassette_id, cassette_name, allow_write, source_path, is_metadata, length, mtime, source_seq).

    ``cassettes`` needs ``position``, its order in the configuration. ``source_seq`` sorts by that order, the
    metadata log first, then by path without regard to case; it is a sort key, so no global numbering is needed.
    The metadata log is the file named ``<cassette>_current.fog``, else so but for case, else the only one ending in
    ``_current``, else the only one; anything else is an error.
    """
    roots = cassettes.where("enabled").select(
        F.col("id").alias("cassette_id"), F.col("name").alias("cassette_name"), "allow_write", "position",
        F.regexp_replace(F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), "/+$", "").alias("root"))
    files = _files(spark, _folders(cassettes), "*.[fF][oO][gG]")
    _refuse_empty(files)
    listed = (files.select("path", "length", "modificationTime")
              .withColumn("root", F.regexp_extract("path", _INSIDE, 1)).withColumn("rel", F.regexp_extract("path", _INSIDE, 2)))
    found = roots.join(listed.where("root <> ''"), "root", "left")
    meta = F.col("rel").startswith("meta/")
    name = F.regexp_replace("rel", "^meta/", "")
    expected = F.concat("cassette_name", F.lit("_current.fog"))
    same, alike = meta & (name == expected), meta & (F.lower(name) == F.lower(expected))
    current = meta & F.lower(name).endswith("_current.fog")
    chosen = found.groupBy("cassette_id").agg(
        F.max(F.when(same, F.col("path"))).alias("same"), F.min(F.when(alike, F.struct(F.lower(name), "path")))["path"].alias("alike"),
        F.count(F.when(current, 1)).alias("n_current"), F.max(F.when(current, F.col("path"))).alias("current"),
        F.count(F.when(meta, 1)).alias("n_meta"), F.max(F.when(meta, F.col("path"))).alias("only"))
    pick = F.coalesce("same", "alike", F.when(F.col("n_current") == 1, F.col("current")),
                      F.when((F.col("n_current") == 0) & (F.col("n_meta") == 1), F.col("only")))
    problem = F.concat(F.lit("cassette "), "cassette_id", F.when(F.col("n_current") > 1, " has several current logs").otherwise(" has no identifiable metadata log"))
    chosen = chosen.select("cassette_id", F.coalesce(pick, F.raise_error(problem).cast("string")).alias("meta_path"))
    rows = found.join(chosen, "cassette_id").withColumn("is_metadata", F.col("path") == F.col("meta_path")).where(F.col("is_metadata") | ~meta)
    key = F.concat_ws("/", F.lpad(F.col("position").cast("string"), 9, "0"), F.when(F.col("is_metadata"), "0").otherwise("1"), F.upper("path"))
    return rows.select("cassette_id", "cassette_name", "allow_write", F.col("path").alias("source_path"), "is_metadata",
                       "length", F.col("modificationTime").alias("mtime"), key.alias("source_seq"))


def describe_logs(spark: SparkSession, cassettes: DataFrame, split_bytes: int | None = None) -> DataFrame:
    """The listed logs with their header fields and whether they can be written to."""
    return _described(spark, cassettes, parse_files(spark, _folders(cassettes), split_bytes=split_bytes))


def _described(spark: SparkSession, cassettes: DataFrame, parsed: DataFrame) -> DataFrame:
    headers = headers_of(parsed)
    return list_logs(spark, cassettes).join(headers, "source_path").withColumn(
        "writable", F.col("allow_write") & F.col("prefix").isNotNull() & F.col("counter").isNotNull())


def canonical_records(elements: DataFrame, anonymous_prefix: str = ANONYMOUS_PREFIX) -> DataFrame:
    """Records of ``schemas.RECORDS`` from elements joined with their logs (source_seq, cassette_*, db_id).

    Deletions without target are dropped, though their place in the file still counts.
    """
    def attr(name: str, of: str = "attrs") -> Column:
        return F.try_element_at(of, F.lit(name))

    def required(c: Column, what: str) -> Column:
        failure = F.raise_error(F.concat(F.lit(f"{what} has no identifier in "), "source_path")).cast("string")
        return F.when(is_blank(c), failure).otherwise(clean_id(c))

    about = attr("rdf:about")
    deleted = F.coalesce(about, attr("id"))
    new_child = F.get(F.filter("children", lambda x: x["name"] == "newid"), 0)
    new_id = F.when(~is_blank(attr("new-id")), attr("new-id")).otherwise(F.try_element_at(new_child["attrs"], F.lit("rdf:resource")))
    is_delete, is_substitute = F.col("name") == "delete", F.col("name") == "substitute"

    def prop(x: Column) -> Column:
        get = lambda n: F.try_element_at(x["attrs"], F.lit(n))
        none = F.lit(None).cast("string")

        def row(predicate: Column, kind: str, value: Column, lang: Column = none, datatype: Column = none) -> Column:
            return F.struct(predicate.alias("predicate"), F.lit(kind).alias("kind"), value.alias("value"), lang.alias("lang"), datatype.alias("datatype"))

        store = x["name"] == "iisstore"
        return (F.when(store & is_blank(get("uri")), F.lit(None)).when(store, row(F.lit(v.URI), v.LITERAL, get("uri")))
                .when(get("rdf:resource").isNotNull(), row(iri(x["name"]), v.RESOURCE, clean_id(get("rdf:resource"))))
                .otherwise(row(iri(x["name"]), v.LITERAL, x["value"], get("xml:lang"), get("rdf:datatype"))))

    rows = elements.where(~is_delete | ~is_blank(deleted))
    directive = is_delete | is_substitute
    own = F.when(is_blank(about), anonymous_id("cassette_id", "db_id", "source_path", "ordinal", "name", anonymous_prefix)).otherwise(clean_id(about))
    all_props = F.filter(F.transform("children", prop), lambda p: p.isNotNull())
    return rows.select(
        "source_seq", "ordinal", "cassette_id", "cassette_name", "source_path",
        F.when(is_delete, v.DELETE).when(is_substitute, v.SUBSTITUTE).otherwise(v.RESOURCE).alias("kind"),
        F.when(is_delete, clean_id(deleted)).when(is_substitute, required(F.coalesce(attr("old-id"), about), "substitution"))
        .otherwise(own).alias("resource_id"),
        F.when(~directive, iri("name")).alias("type"),
        F.when(is_substitute, required(new_id, "substitution target")).alias("substitute_target"),
        revision_time(attr("mT"), "source_path").alias("modified_at"), attr("mT").alias("modified_at_raw"),
        F.when(directive, F.slice(all_props, 1, 0)).otherwise(all_props).alias("props"))


def read_records(spark: SparkSession, cassettes: DataFrame, anonymous_prefix: str = ANONYMOUS_PREFIX, split_bytes: int | None = None) -> DataFrame:
    """All records of the enabled cassettes' logs. Files are parsed where they are read, once; only records are joined."""
    parsed = cut_lineage(parse_files(spark, _folders(cassettes), split_bytes=split_bytes))
    logs = cut_lineage(_described(spark, cassettes, parsed).select("source_path", "source_seq", "cassette_id", "cassette_name", "db_id"))
    return canonical_records(parsed.where(F.col("ordinal") != ROOT).join(small(logs), "source_path"), anonymous_prefix)
