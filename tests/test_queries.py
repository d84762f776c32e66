"""Every registered query gives what its SQL gives, and the heavy plans have the wanted shape."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pagemill import queries as registry
from pagemill.functions.urls import host_of
from pagemill.operators import change, dedup, extract, robots
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF_DIR)
    assert compare(df, registry.ORACLES[name], duck) is None


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 50
    assert [r["url"] for r in rows] == sorted(r["url"] for r in rows)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_extraction_does_not_shuffle(spark):
    pages = registry.table(spark, SF_DIR, "pages").select("page_id", "html")
    text = plan(extract.extract_records(pages))
    assert "Exchange" not in text
    assert text.count("MapInArrow") == 1
    assert "ReadSchema: struct<page_id:bigint,html:string>" in text


def test_keys_do_not_read_the_html(spark):
    assert "html" not in plan(registry.url_keys(spark, SF_DIR))


def test_gates_use_no_window(spark):
    keyed = dedup.with_key(registry.visits(spark, SF_DIR))
    assert "Window" not in plan(dedup.mark_first(keyed))
    assert "Window" not in plan(dedup.first_seen(keyed, keyed.limit(5)))


def test_change_windows_run_inside_slices(spark):
    text = plan(change.content_changed(registry.observations(spark, SF_DIR)))
    # The rows, the partial summaries, the carry, and the carry on its way back.
    assert text.count("Exchange hashpartitioning") <= 4
    assert "hashpartitioning(url_key" in text and "_slice" in text


def test_a_hot_host_is_split(spark):
    hosts = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string"))
    urls = spark.range(60_000).select(
        F.concat(F.lit("http://"), hosts, F.lit(".example/p/"), F.col("id").cast("string")).alias("url")
    )
    files = urls.select(host_of("url").alias("host")).distinct()
    rules = robots.default_rules(
        files.select("host", F.lit(200).alias("status"), F.lit("User-agent: *\nDisallow: /p/1").alias("body"))
    )
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k",
    }
    before = {key: spark.conf.get(key, None) for key in small}
    try:
        for key, value in small.items():
            spark.conf.set(key, value)
        checked = robots.robots_allowed(urls.repartition(8), rules)
        denied = sum(not row["allowed"] for row in checked.collect())
        assert denied == sum(str(n).startswith("1") for n in range(60_000))
        assert "skew=true" in plan(checked)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(registry.visits(spark, SF_DIR).filter("arrived_at < '2024-01-02'").select("url"))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in text
    assert "PushedFilters: [IsNotNull(ts), LessThan(ts," in text
