"""Every registered query against its check SQL on the smallest tables."""

import pytest

from artifactlake.registry import QUERIES, load_all

from .oracle import compare, connect

SF = "/root/testdata/sf0.001"
load_all()


@pytest.fixture(scope="module")
def con(spark):
    # a few thousand rows: compiling generated code would take longer than the queries
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    yield connect(SF)
    spark.conf.unset("spark.sql.codegen.wholeStage")


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    ok, message = compare(spark, SF, name, con)
    assert ok, message
