"""Published tables do not store hashed ids, and read as if they did; their shuffles are given back."""

from pyspark.sql import functions as F

from factloom.operators import materialize, projection as p
from factloom.session import shuffles_released
from factloom.sources import published

from .helpers import prop, records, ref, rows

RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def texts(df):
    """Rows with every value as text; year 1 is no Python datetime west of UTC."""
    return sorted(map(str, df.select([F.col(c).cast("string") for c in df.columns]).collect()))


def test_ids_are_read_and_not_stored(spark, tmp_path):
    made = [("resource", f"id{i}", 2020, [prop("name", f"Name {i}", lang="en"), ref("friend", f"id{i // 2}"), prop("date", "1950", datatype="d")][:i % 4]) for i in range(40)]
    current = materialize.current_records(records(spark, *made))
    done = published.publish(current, str(tmp_path), "v1", 2)
    for part in ("heads", "triples", "triples_by_subject"):
        stored = spark.read.parquet(f"{done.path}/{part}")
        assert not {"triple_id", "source_record_id"} & set(stored.columns)
        assert all(".zstd." in path for path in stored.inputFiles())
    expected = p.triples(current)
    for part in ("triples", "triples_by_subject"):
        assert done.read(spark, part).columns == expected.columns
        assert texts(done.read(spark, part)) == texts(expected)
    found = done.read(spark, "heads")
    assert found.columns == [*p.heads(current).columns, "number"]
    assert texts(found.drop("number")) == texts(p.heads(current))


def test_records_of_no_file(spark):
    current = materialize.current_records(records(spark, ("resource", "a", 2020, [prop("name", "A")])))
    bare = current.selectExpr("* except (cassette_id, source_path, ordinal)", "string(null) as cassette_id", "string(null) as source_path", "bigint(null) as ordinal")
    assert rows(p.triples_with_ids(p.plain_triples(bare)), "triple_id", "source_record_id") == rows(p.triples(bare), "triple_id", "source_record_id")
    assert rows(p.heads(bare), "source_record_id") == rows(p.triples(bare).select("source_record_id").distinct())


def test_setting_is_put_back(spark):
    before = spark.conf.get(RELEASE, None)
    with shuffles_released(spark):
        assert spark.conf.get(RELEASE) == "true"
    assert spark.conf.get(RELEASE, None) == before
