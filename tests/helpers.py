import json

from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from factloom import vocab as v
from factloom.schemas import RECORDS, TERMS

O = v.NS


def frame(spark, rows, schema):
    """A table of constants; rows are tuples in schema order."""
    fields = StructType.fromDDL(schema)
    text = json.dumps([dict(zip(fields.names, r)) for r in rows], ensure_ascii=False)
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), ArrayType(fields), {"timestampFormat": "yyyy-MM-dd HH:mm:ss"})))


def prop(predicate, value, kind="literal", lang=None, datatype=None):
    return {"predicate": O + predicate, "kind": kind, "value": value, "lang": lang, "datatype": datatype}


def ref(predicate, value):
    return prop(predicate, value, "resource")


def records(spark, *rows, seq=0):
    """Rows (kind, id, year or None, target or props)."""
    out = []
    for i, (kind, id_, year, rest) in enumerate(rows):
        at = f"{year or 1:04d}-01-01 00:00:00"
        out.append((seq, i, f"c{seq}", f"C{seq}", f"c{seq}.fog", kind, id_, O + "person" if kind == "resource" else None,
                    rest if kind == "substitute" else None, at, None, rest if kind == "resource" else []))
    return frame(spark, out, RECORDS)


def triple_rows(spark, rows, cassette="cass"):
    """Rows (subject, predicate, kind, value, lang); ids number them."""
    schema = ("triple_id string, subject string, predicate string, object_kind string, object_value string, lang string, "
              "datatype string, source_record_id string, cassette_id string, source_path string, modified_at timestamp")
    return frame(spark, [(f"{i:032d}", s, p, k, o, lang, None, "r", cassette, "p", "2024-01-01 00:00:00")
                         for i, (s, p, k, o, lang) in enumerate(rows)], schema)


def head_rows(spark, *ids, cassette="cass"):
    schema = "resource_id string, source_record_id string, cassette_id string, source_path string, modified_at timestamp, is_deleted boolean"
    return frame(spark, [(i, "r", cassette, "p", "2024-01-01 00:00:00", False) for i in ids], schema)


def term(id_, kind, labels=(), parent=None, domains=(), ranges=(), inverse=(), priority=None, states=(), abstract=False, essential=False):
    text = lambda pairs: [{"value": x, "lang": lang} for x, lang in pairs]
    return (id_, kind, text(labels), text(inverse), priority, parent, list(domains), list(ranges),
            [{"value": a, "label": b, "lang": c} for a, b, c in states], abstract, essential)


def terms(spark, *rows):
    return frame(spark, list(rows), TERMS)


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())
