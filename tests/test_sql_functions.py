import pytest
from pyspark.sql import functions as F

from mediatally.functions import sql
from mediatally.plans.tables import table

from conftest import plan_of

URLS = ["HTTPS://Film.test:443/a/../b.mkv?token=1&q=it's", "https://film.test/up/9_x-1-30216.m4s?a", "not a url", "", None, "https://film.test/ä b\\c.mp4#x", "blob:https://x/1"]
VALUES = {"STRING": [*URLS, "PT1H2.5S", "1920x1080", "0aff", "video/mp4", "a: b|c  d"], "DOUBLE": [None, 0.0, 77.0, 1e9, float("inf"), float("nan"), -1.0, 3661.5], "BIGINT": [None, 0, 258]}


@pytest.fixture(scope="module")
def names(spark):
    return sql.register(spark)


@pytest.mark.parametrize("name", sorted(sql.FUNCTIONS))
def test_sql_function_equals_the_column_function(spark, names, name):
    parameters, fn = sql.FUNCTIONS[name]
    given = [p.split() for p in parameters.split(", ")]
    df = spark.createDataFrame([(1,)], "one int")
    for p, t in given:
        df = df.crossJoin(spark.createDataFrame([(v,) for v in VALUES[t]], f"{p} {t}"))
    df.createOrReplaceTempView("given")
    got = spark.sql(f"SELECT to_json(struct(mt_{name}({', '.join(p for p, _ in given)}) AS v)) AS v FROM given")
    want = df.select(F.to_json(F.struct(fn(*[F.col(p) for p, _ in given]).alias("v"))).alias("v"))
    assert [r.v for r in got.collect()] == [r.v for r in want.collect()]


def test_a_query_in_plain_sql(spark, sf, names):
    table(spark, sf, "requests").createOrReplaceTempView("log")
    got = spark.sql("""SELECT mt_host_of(mt_normalize_url(url)) AS host, mt_format_bytes(sum(content_length)) AS size
                       FROM log WHERE mt_classify_hint(url, content_type) = 'segment' GROUP BY 1""")
    assert "Python" not in plan_of(got) and "Arrow" not in plan_of(got)
    assert got.count() > 0
