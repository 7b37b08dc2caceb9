"""The classification path end to end: which kinds of findings does a scan hold?"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from .classify import CATEGORY_SQL, ENTRIES, scored


@query(
    "flagship_category_facets",
    f"""WITH {ENTRIES}, {CATEGORY_SQL}, one AS (SELECT DISTINCT entry_id, category FROM cats)
    SELECT category, count(*) AS entries, sum(interest_score)::BIGINT AS interest, max(noise_score) AS max_noise
    FROM one JOIN sc USING (entry_id) GROUP BY category""",
)
def category_facets(spark: SparkSession, sf: str) -> DataFrame:
    flat = scored(spark, sf).select(
        "score.interest_score", "score.noise_score", F.explode_outer("categories.category").alias("category")
    )
    return flat.groupBy("category").agg(
        F.count(F.lit(1)).alias("entries"),
        F.sum("interest_score").alias("interest"),
        F.max("noise_score").alias("max_noise"),
    )
