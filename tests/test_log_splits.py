"""Long logs read in ranges give the rows of the whole file, wherever they are cut."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom.sources import files, log_splits

from .helpers import rows

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
TRICKY = f"""<?xml version="1.0" encoding="ENC"?><!-- <a> before - -></a> the root -->
<?note <b> ?>
<r:RDF xmlns:r="{RDF}" dbid="a&gt;b" owner='x > "y"'>stray &amp; text
  <one r:about="1" note='a>b "/>' mT="x"><name xml:lang="ru">Имя <b>и</b> далее</name><t><![CDATA[ <two r:about="no"/> ]] > ]]></t></one>
  <!-- <three r:about="no"></three> --><three r:about="3"/><four
     r:about="4"
  ><n>Ж&#x416;&lt;</n><?pi <five/> ?></four><![CDATA[<five r:about="no"/>]]>
  <six r:about="6"><deep><x><y>z</y></x></deep><!-- -->tail</six><seven r:about="7"></seven>
</r:RDF>
<!-- <eight r:about="no"/> -->
"""


def whole(path):
    with open(path, "rb") as source:
        return list(files.element_reader()(path, iter([source.read()])))


def in_ranges(path, split):
    size = len(open(path, "rb").read())
    parts = pd.DataFrame({"path": path, "part": range(-(-size // split))})
    (found,) = log_splits.summarise(split)(iter([parts]))
    starts = log_splits.compose()(found)
    got = [tuple(r) for f in log_splits.parse(split, files.element_reader)(iter([starts])) for r in f.itertuples(index=False)]
    return got, len(starts)


@pytest.mark.parametrize("encoding", ["utf-8", "windows-1251"])
def test_every_cut(tmp_path, encoding):
    path = f"{tmp_path}/log.fog"
    with open(path, "wb") as out:
        out.write(TRICKY.replace("ENC", encoding).encode(encoding))
    expected = whole(path)
    assert [r[2] for r in expected] == ["RDF", "one", "three", "four", "six", "seven"] and [r[1] for r in expected] == [-1, 0, 1, 2, 3, 4]
    tasks = set()
    for split in [*range(1, 400), 1000, 5000]:
        got, n = in_ranges(path, split)
        assert got == expected, split
        tasks.add(n)
    assert max(tasks) == 6  # as many as records, and the root


def test_wide_characters_are_one_range(tmp_path):
    path = f"{tmp_path}/log.fog"
    with open(path, "wb") as out:
        out.write(TRICKY.replace("ENC", "utf-16").encode("utf-16"))
    assert in_ranges(path, 100) == (whole(path), 1)


@pytest.mark.parametrize("change", [("</one>", "</on>"), ("<seven", "<<seven"), ("</r:RDF>", ""), ("</r:RDF>", "</r:RDF><more/>"), ("<six r:about=\"6\">", "<six r:about=\"6\""),
                                    ("stray &amp;", "stray &none;"), ("<!-- -->tail", "<!-- tail")])
def test_malformed_logs_are_errors(tmp_path, change):
    path = f"{tmp_path}/log.fog"
    with open(path, "wb") as out:
        out.write(TRICKY.replace("ENC", "utf-8").replace(*change).encode())
    with pytest.raises(ValueError):
        whole(path)
    for split in (40, 100, 333):
        with pytest.raises(ValueError):
            in_ranges(path, split)


def test_many_tasks_read_one_log(spark, tmp_path):
    body = "".join(f'<p r:about="{i}"><name>{"x" * (i % 90)} &#x416;</name></p>{"<!-- <p/> -->" if i % 50 == 0 else ""}' for i in range(4000))
    with open(f"{tmp_path}/My log.fog", "w", encoding="utf-8") as out:
        out.write(f'<r:RDF xmlns:r="{RDF}" counter="5">{body}</r:RDF>')
    expected = rows(files.parse_files(spark, [str(tmp_path)]), "ordinal", "name", F.to_json("attrs").alias("a"), F.to_json("children").alias("c"))
    split = files.parse_files(spark, [str(tmp_path)], split_bytes=20_000).withColumn("task", F.spark_partition_id())
    assert rows(split, "ordinal", "name", F.to_json("attrs").alias("a"), F.to_json("children").alias("c")) == expected and len(expected) == 4001
    read = {r["task"]: r["count"] for r in split.groupBy("task").count().collect()}
    assert len(read) > 8 and max(read.values()) < 600
    assert files.read_headers(spark, [str(tmp_path)]).first()["counter"] == 5
