import json
import os

import pytest
from pyspark.sql import functions as F

from factloom import vocab as v
from factloom.functions import times, uris
from factloom.operators import access as a, append, documents as d, materialize as m, ontology as o, projection as p, quality as q
from factloom.schemas import CASSETTES, MEMBERS, RECORDS, ROLES
from factloom.sources import files, ontology_xml, preview_queue, published

from .helpers import O, frame, head_rows, prop, records, ref, rows, term, terms, triple_rows


def project(spark):
    """An attic that nobody writes to, a desk that is read by default, a vault for some, and a lost folder."""
    cassettes = frame(spark, [("attic", "Attic", "/a", True, "none", False), ("desk", "Desk", "/d", True, "read", True), ("vault", "Vault", "/v", True, "none", False), ("lost", "Lost", "/l", False, "read", False)], CASSETTES)
    roles = frame(spark, [("porter", ["search"], {"vault": ["read"]}), ("clerk", ["read"], {"*": ["addDocuments"], "attic": ["read", "delete"]})], ROLES)
    members = frame(spark, [("kim", ["porter"], {}), ("lou", ["porter", "clerk"], {"vault": ["read", "manage"]}), ("mia", ["clerk"], {"*": ["substitute"]})], MEMBERS)
    return cassettes, roles, members


def test_rights_are_composed(spark):
    cassettes, roles, members = project(spark)
    rights, granted = a.cassette_rights(members, roles, cassettes), a.project_rights(members, roles)
    assert rows(rights) == [("kim", "vault", "read"), ("lou", "attic", "read"), ("lou", "desk", "addDocuments"), ("lou", "desk", "read"), ("lou", "vault", "read"), ("mia", "desk", "substitute")]
    assert rows(granted) == [("kim", "search"), ("lou", "read"), ("lou", "search"), ("mia", "read")]
    # kim may not read the project, mia's override took the right to read away
    for search in (False, True):
        assert rows(a.readable_cassettes(rights, granted, search)) == [("lou", "attic"), ("lou", "desk"), ("lou", "vault")]
    assert rows(a.writable_cassettes(rights, granted, cassettes, "addDocuments")) == [("lou", "desk")]
    assert rows(a.writable_cassettes(rights, granted, cassettes, "substitute")) == []
    assert rows(a.default_write_cassette(rights, members, cassettes)) == [("kim", None), ("lou", "desk"), ("mia", "desk")]
    assert a.check_configuration(cassettes, roles, members).count() == 0
    for none in ("id = 'attic'", "id = 'lost'"):
        with pytest.raises(Exception, match="exactly one writable"):
            a.default_write_cassette(rights, members, cassettes.where(none)).collect()


def test_configuration_faults(spark):
    cassettes, roles, members = project(spark)
    bad = frame(spark, [("kim", ["nobody", "clerk", "clerk"], {"cellar": ["read"], "*": ["read", "paint"]})], MEMBERS)
    got = rows(a.check_configuration(cassettes.where("id <> 'desk'"), roles, bad), "code")
    assert {c for (c,) in got} == {"unknown_role", "repeated_role", "unknown_cassette", "unknown_right", "writable_cassettes"}


def test_document_uris(spark):
    texts = ["iiss://My%20Box@host.example/x/0001/0002", "IISS://A@h/0001/0002?q", "iiss://@h/0001/0002", "http://A@h/0001/0002", "iiss://A@h/0002", "iiss://A@h/00001/0002", " ", "iiss://A+B@h/0001/0002"]
    got = frame(spark, [(t,) for t in texts], "u string").select("u", uris.is_document_uri("u").alias("ok"), uris.document_cassette("u").alias("c"),
                                                                uris.document_folder("u").alias("f"), uris.document_number("u").alias("n")).collect()
    assert [r["ok"] for r in got] == [True, True, False, False, False, False, False, True]
    assert (got[0]["c"], got[0]["f"], got[0]["n"]) == ("My Box", "0001", "0002") and got[7]["c"] == "A+B"


def test_document_locations(spark):
    cassettes = frame(spark, [("s", "Shelf", "/s", True, "read", False)], CASSETTES)
    at = lambda y: f"{y}-01-01 00:00:00"
    data = [("s", "original", "0001", "0001", ".tif", "/o1", at(2020)), ("s", "small", "0001", "0001", ".jpg", "/s1", at(2021)), ("s", "medium", "0001", "0001", ".jpg", "/m1", at(2019)),
            ("s", "normal", "0001", "0002", ".JPG", "/n2", at(2000)), ("s", "original", "0001", "0003", ".tif", "/o3", at(2020)), ("s", "original", "0001", "0003", "", "/o3b", at(2020)),
            ("s", "icon", "0001", "aB1", ".x", "/i4", at(2020))]
    listing = frame(spark, data, "cassette_id string, tree string, folder string, stem string, ext string, path string, mtime timestamp")
    asked = frame(spark, [(f"iiss://shelf@h/0001/{n}",) for n in ("0001", "0002", "0003", "9999", "ab1.")] + [("iiss://other@h/0001/0001",), ("http://x",)], "document_uri string")
    got = {r["document_uri"]: r for r in d.locate(asked, listing, cassettes).collect()}
    one = got["iiss://shelf@h/0001/0001"]
    assert (one["original"], one["small"], one["medium"], one["problem"]) == ("/o1", "/s1", None, None)
    assert got["iiss://shelf@h/0001/0002"]["normal"] == "/n2" and got["iiss://shelf@h/0001/0003"]["problem"] == "ambiguous"
    assert got["iiss://other@h/0001/0001"]["problem"] == "unknown_cassette" and got["http://x"]["problem"] == "not_a_document"
    found = d.locate(asked.limit(1), listing, cassettes)
    assert d.variant(found, "medium").first()["path"] == "/s1" and d.variant(found, "original").first()["path"] == "/o1"
    with pytest.raises(ValueError):
        d.variant(found, "huge")


@pytest.mark.parametrize("text, want", [
    ("2020-01-01T00:00:00", "2020-01-01 00:00:00"), ("2020-01-01 10:00:00Z", "2020-01-01 10:00:00"), ("2020-01-01T10:00:00+03:00", "2020-01-01 07:00:00"),
    ("12/31/2019 5:30:00 PM", "2019-12-31 17:30:00"), ("31.12.2019 17:30:00", "2019-12-31 17:30:00"), ("Wed, 01 Jan 2020 10:00:00 GMT", "2020-01-01 10:00:00"),
    ("", "0001-01-01 00:00:00"), (None, "0001-01-01 00:00:00")])
def test_revision_times(spark, text, want):
    got = frame(spark, [(text,)], "t string").select(F.date_format(times.revision_time("t"), "yyyy-MM-dd HH:mm:ss").alias("x")).first()["x"]
    assert got == want


def test_unreadable_revision_time_raises(spark):
    with pytest.raises(Exception, match="cannot be read"):
        frame(spark, [("yesterday",)], "t string").select(times.revision_time("t").cast("string").alias("x")).collect()


LOG = """<?xml version="1.0" encoding="{encoding}"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" dbid="db" owner="me" prefix="pre" counter="17">
  <person rdf:about="old|id" mT="2020-01-01T00:00:00"><name xml:lang="ru">Имя <b>и</b> далее</name><friend rdf:resource="target|1" /><blank>
    </blank><iisstore uri="iiss://Shelf@host.example/0001/0001" contenttype="image/jpeg" /><iisstore uri=" "/></person>
  <delete />
  <!-- a comment -->
  <delete id="gone" />
  <substitute old-id="oldid"><newid rdf:resource="new|id" /></substitute>
  <reflection><reflected rdf:resource="person-1" /></reflection>
  <reflection><reflected rdf:resource="person-2" /></reflection>
</rdf:RDF>"""


def write(path, text, encoding="utf-8"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as out:
        out.write(text.encode(encoding))


def folders(spark, root, *names):
    schema = CASSETTES + ", position int"
    return frame(spark, [(n.lower(), n, f"{root}/{n}", True, "read", True, i) for i, n in enumerate(names)], schema)


@pytest.mark.parametrize("encoding", ["utf-8", "windows-1251"])
def test_records_of_a_log_file(spark, tmp_path, encoding):
    write(f"{tmp_path}/Box/meta/Box_current.fog", LOG.format(encoding=encoding), encoding)
    got = files.read_records(spark, folders(spark, tmp_path, "Box")).orderBy("ordinal").drop("modified_at").collect()
    assert [r["ordinal"] for r in got] == [0, 2, 3, 4, 5]
    assert [r["kind"] for r in got] == ["resource", "delete", "substitute", "resource", "resource"]
    assert (got[0]["resource_id"], got[0]["type"], got[1]["resource_id"], got[2]["substitute_target"]) == ("oldid", O + "person", "gone", "newid")
    assert [(x["predicate"], x["kind"], x["value"], x["lang"]) for x in got[0]["props"]] == [
        (O + "name", "literal", "Имя и далее", "ru"), (O + "friend", "resource", "target1", None), (O + "blank", "literal", "", None),
        (O + "uri", "literal", "iiss://Shelf@host.example/0001/0001", None)]
    anonymous = [r["resource_id"] for r in got[3:]]
    assert len(set(anonymous)) == 2 and all(x.startswith(files.ANONYMOUS_PREFIX) for x in anonymous)
    again = files.read_records(spark, folders(spark, tmp_path, "Box")).orderBy("ordinal").drop("modified_at").collect()
    assert [r["resource_id"] for r in again[3:]] == anonymous


@pytest.mark.parametrize("text, message", [("<!DOCTYPE x [<!ENTITY a 'b'>]><rdf:RDF xmlns:rdf='x'><p/></rdf:RDF>", "document types"), ("<a><b></a>", "cannot be read"), (" ", "cannot be read")])
def test_refused_files(spark, tmp_path, text, message):
    write(f"{tmp_path}/x.fog", text)
    with pytest.raises(Exception, match=message):
        files.read_elements(spark, [str(tmp_path)]).collect()


EMPTY = "<rdf:RDF xmlns:rdf='http://www.w3.org/1999/02/22-rdf-syntax-ns#'/>"


def test_log_listing_order_and_choice(spark, tmp_path):
    for path in ("A/meta/other.fog", "A/meta/a_CURRENT.fog", "A/originals/0002/x.FOG", "A/originals/0001/y.fog", "A/originals/00011/no.fog", "A/documents/z.fog",
                 "B/meta/old.fog", "B/meta/some_current.fog", "C/meta/only.fog"):
        write(f"{tmp_path}/{path}", EMPTY)
    got = files.describe_logs(spark, folders(spark, tmp_path, "B", "A", "C")).orderBy("source_seq").collect()
    assert [(r["source_path"].split(tmp_path.name + "/")[1], r["is_metadata"], r["writable"]) for r in got] == [
        ("B/meta/some_current.fog", True, False), ("A/meta/a_CURRENT.fog", True, False), ("A/originals/0001/y.fog", False, False),
        ("A/originals/0002/x.FOG", False, False), ("C/meta/only.fog", True, False)]


@pytest.mark.parametrize("names", [("x_current.fog", "y_current.fog"), ("x.fog", "y.fog"), ()])
def test_unclear_metadata_log_raises(spark, tmp_path, names):
    write(f"{tmp_path}/A/originals/0001/z.fog", EMPTY)
    for n in names:
        write(f"{tmp_path}/A/meta/{n}", EMPTY)
    with pytest.raises(Exception, match="cassette a"):
        files.list_logs(spark, folders(spark, tmp_path, "A")).collect()


def test_an_empty_log_is_an_error(spark, tmp_path):
    write(f"{tmp_path}/A/meta/A_current.fog", EMPTY)
    write(f"{tmp_path}/A/originals/0001/with space.fog", "")
    with pytest.raises(ValueError, match="zero bytes.*with space"):
        files.list_logs(spark, folders(spark, tmp_path, "A"))


def test_long_logs_are_split(spark, tmp_path, monkeypatch):
    body = "".join(f'<person rdf:about="p{i}"><name>n{i}</name></person>' for i in range(30_000))
    write(f"{tmp_path}/A/meta/A_current.fog", EMPTY.replace("/>", f">{body}</rdf:RDF>"))
    whole = rows(files.read_records(spark, folders(spark, tmp_path, "A")), "ordinal", "resource_id")
    monkeypatch.setattr(files, "SPLIT_BYTES", 100_000)
    assert rows(files.read_records(spark, folders(spark, tmp_path, "A")), "ordinal", "resource_id") == whole and len(whole) == 30_000


def test_header_fields_and_bad_counter(spark, tmp_path):
    write(f"{tmp_path}/Box/meta/Box_current.fog", LOG.format(encoding="utf-8"))
    row = files.describe_logs(spark, folders(spark, tmp_path, "Box")).first()
    assert (row["db_id"], row["owner"], row["prefix"], row["counter"], row["writable"]) == ("db", "me", "pre", 17, True)
    write(f"{tmp_path}/bad/x.fog", EMPTY.replace("/>", " counter='x'/>"))
    with pytest.raises(Exception, match="counter is no integer"):
        files.read_headers(spark, [f"{tmp_path}/bad"]).collect()


def test_ontology_file(spark, tmp_path):
    write(f"{tmp_path}/o.xml", """<Ontology xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">
      <Class rdf:about="base" abstract="Yes"><label xml:lang="ru">База</label></Class>
      <Class rdf:about="child"><label xml:lang="en">Child</label><SubClassOf rdf:resource="base" /></Class>
      <ObjectProperty rdf:about="mentor" priority="02" essential="1"><inverse-label xml:lang="ru">Ученики</inverse-label><domain rdf:resource="base" /><domain rdf:resource="base" /><range rdf:resource="child" /></ObjectProperty>
      <EnumerationType rdf:about="e"><state value="active" xml:lang="ru">Активен</state><state value=" ">x</state></EnumerationType><Other/></Ontology>""")
    found = {r["id"]: r for r in ontology_xml.read_ontology(spark, str(tmp_path)).collect()}
    assert set(found) == {"base", "child", "mentor", "e"} and found["base"]["is_abstract"] and found["child"]["parent"] == "base"
    assert found["mentor"]["domains"] == ["base"] and found["mentor"]["is_essential"] and found["mentor"]["inverse_labels"][0]["value"] == "Ученики"
    assert [tuple(s) for s in found["e"]["states"]] == [("active", "Активен", "ru")]


def test_preview_backlog(spark, tmp_path):
    for state, n in (("preview-queue", 2), ("preview-processing", 1)):
        for i in range(n):
            write(f"{tmp_path}/A/documents/{state}/{i}.json", json.dumps({"requestId": f"{i:032x}", "requestedAtUtc": f"2024-01-0{i + 1}T00:00:00+00:00", "cassetteId": "a", "attempt": 0}))
    write(f"{tmp_path}/A/documents/preview-queue/bad.json", "{")
    cassettes = folders(spark, tmp_path, "A")
    found = preview_queue.read_requests(spark, cassettes)
    got = d.backlog(found.withColumn("cassette_id", F.col("folder_cassette_id")), cassettes).withColumn("oldest_queued", F.date_format("oldest_queued", "yyyy-MM-dd"))
    assert {tuple(r) for r in got.collect()} == {("a", 3, 1, 0, "2024-01-01"), (None, 3, 1, 0, "2024-01-01")}
    assert rows(d.request_faults(found.where("request_id is not null"), cassettes), "code").count(("bad_metadata",)) == 3


def test_published_build_verifies_clean_and_is_never_overwritten(spark, tmp_path):
    current = m.current_records(records(spark, ("resource", "a", 2020, [prop("name", "Ann"), ref("friend", "b")]), ("delete", "x", None, None)))
    built = published.publish(current, str(tmp_path), "v1")
    assert built.counts == {"current": 2, "heads": 2, "triples_by_subject": 5, "triples": 5, "name_starts": 2, "postings": 2}
    report = q.verification(p.heads(current), p.triples(current), built.read(spark, "heads"), built.read(spark, "triples"))
    assert all(r["is_match"] for r in report.collect())
    with pytest.raises(Exception):
        published.publish(current, str(tmp_path), "v1")


def test_write_violations_and_legacy_properties(spark):
    onto = terms(spark, term(O + "c", v.CLASS), term(O + "name", v.DATATYPE_PROPERTY, domains=[O + "c"], ranges=[O + "s"]),
                 term(O + "friend", v.OBJECT_PROPERTY, domains=[O + "c"], ranges=[O + "c"]), term(O + "state", v.DATATYPE_PROPERTY, domains=[O + "c"], ranges=[O + "e"]),
                 term(O + "e", v.ENUMERATION, states=[("on", "On", None)]), term(O + "far", v.DATATYPE_PROPERTY))
    staged = frame(spark, [
        (1, "r", "c", [prop("name", "x"), ref("friend", "y"), prop("state", "on")]),
        (2, "r", O + "c", [prop("name", "x", datatype="z"), prop("friend", "y"), prop("state", "off"), prop("far", "1"), prop("lost", "1"), prop("friend", "", "resource"), prop("friend", "y", "resource", lang="en")]),
        (3, "r", "ghost", []), (4, " ", "e", [prop("old", "1")]), (5, "r", "c", [prop("old", "1"), prop("old", "1", "resource")])],
        "request_id int, resource_id string, type_id string, props array<struct<predicate:string,kind:string,value:string,lang:string,datatype:string>>")
    triples = triple_rows(spark, [("r", O + "old", v.LITERAL, "0", None)])
    got = sorted(
        (r["request_id"], -1 if r["pos"] is None else r["pos"], r["code"]) for r in q.write_violations(staged, onto, o.ancestors(onto), triples, ["cass"]).collect())
    assert got == [
        (2, 0, "datatype_not_allowed"), (2, 1, "wrong_kind"), (2, 2, "not_an_enumeration_value"), (2, 3, "property_not_allowed"), (2, 4, "unknown_property"),
        (2, 5, "empty_resource"), (2, 6, "resource_with_metadata"), (3, -1, "unknown_class"), (4, -1, "blank_resource_id"), (4, -1, "not_a_class"), (5, 1, "unknown_property")]


def test_target_violations(spark):
    onto = terms(spark, term(O + "c", v.CLASS), term(O + "sub", v.CLASS, parent=O + "c"), term(O + "x", v.CLASS), term(O + "p", v.OBJECT_PROPERTY, ranges=[O + "c"]),
                 term(O + "any", v.OBJECT_PROPERTY), term(O + "odd", v.OBJECT_PROPERTY, ranges=[O + "p"]))
    props = [ref("p", "good"), ref("p", "wrong"), ref("p", "bare"), ref("p", "hidden"), ref("p", "se|lf"), ref("any", "wrong"), ref("odd", "good")]
    staged = frame(spark, [(1, "self", O + "sub", props)], "request_id int, resource_id string, type_id string, props array<struct<predicate:string,kind:string,value:string,lang:string,datatype:string>>")
    triples = triple_rows(spark, [("good", v.RDF_TYPE, v.IRI, O + "sub", None), ("wrong", v.RDF_TYPE, v.IRI, O + "x", None)])
    heads = head_rows(spark, "good", "wrong", "bare").unionByName(head_rows(spark, "hidden", cassette="no"))
    got = rows(q.target_violations(staged, onto, o.ancestors(onto), heads, triples, ["cass"]), "pos", "code")
    assert got == [(1, "target_out_of_range"), (2, "target_untyped"), (3, "target_missing"), (6, "property_without_class_range")]


def test_appended_revisions_are_dated_and_numbered(spark):
    target = records(spark, ("resource", "a", 2030, [prop("name", "x")]), ("resource", "b", 2000, [prop("name", "x")]))
    batch = frame(spark, [(1, None, "person", [prop("name", ""), ref("friend", "x|y")]), (2, "a", O + "person", []), (3, "a", "person", []), (4, "b", "person", []), (5, None, "person", [])],
                  "seq int, resource_id string, type_id string, props array<struct<predicate:string,kind:string,value:string,lang:string,datatype:string>>")
    got = append.append_revisions(batch, target, "n|", 10, "2024-05-05 10:00:00.700")
    assert got.columns == target.columns == RECORDS_COLUMNS
    assert rows(got, "ordinal", "resource_id", "modified_at_raw") == [
        (2, "n10", "2024-05-05 10:00:00Z"), (3, "a", "2030-01-01 00:00:01Z"), (4, "a", "2030-01-01 00:00:02Z"), (5, "b", "2024-05-05 10:00:00Z"), (6, "n11", "2024-05-05 10:00:00Z")]
    assert [x["value"] for x in got.where("ordinal = 2").first()["props"]] == ["xy"]
    both = m.latest_definitions(target.unionByName(got)).select("resource_id", "ordinal")
    assert rows(both.where("resource_id = 'a'")) == [("a", 4)]


RECORDS_COLUMNS = [c.strip().split(" ")[0] for c in RECORDS.split(", ")]


def test_numbering_is_gapless(spark):
    got = append.numbered(spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")), "n", "k")
    assert got.where("n <> k").count() == 0


def test_collection_changes(spark):
    target = records(spark, ("resource", "z", 2000, []))
    added = append.add_to_collections(frame(spark, [(1, "c", "r")], "seq int, collection_id string, resource_id string"), target, "m", 1, "2024-01-01 00:00:00")
    row = added.first()
    assert (row["resource_id"], row["type"], [x["value"] for x in row["props"]]) == ("m1", v.COLLECTION_MEMBER, ["c", "r"])
    triples = triple_rows(spark, [("m", v.RDF_TYPE, v.IRI, v.COLLECTION_MEMBER, None), ("m", v.IN_COLLECTION, v.IRI, "c", None), ("m", v.COLLECTION_ITEM, v.IRI, "r", None)])
    wanted = frame(spark, [(1, "m", "c", "r"), (2, "m", "c", "other"), (3, "x", "c", "r")], "seq int, membership_id string, collection_id string, resource_id string")
    removed = append.remove_from_collections(wanted, head_rows(spark, "m"), triples, ["cass"], target, "2024-01-01 00:00:00")
    assert rows(removed, "kind", "resource_id", "ordinal") == [("delete", "m", 1)]
    bad = frame(spark, [(1, "substitute", "a", "a|"), (2, "delete", "a", "b"), (3, "x", " ", None), (4, "substitute", "a", " ")], "request_id int, kind string, resource_id string, substitute_target string")
    assert rows(q.directive_violations(bad)) == [(1, "self_substitute"), (2, "delete_with_target"), (3, "blank_id"), (3, "unknown_kind"), (4, "blank_target")]
