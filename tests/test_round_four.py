"""Steps whose cost grew faster than their input, or kept more than they needed."""

from pyspark.sql import functions as F

from artifactlake.sources import exports


def test_manifest_meets_its_items_once(spark, monkeypatch):
    plans = spark.range(20).select(F.col("id").alias("export_item_id"), *[F.lit(c).alias(c) for c in ("source_display_path", "destination_path", "provenance")])
    sums = spark.range(10).select(F.col("id").alias("export_item_id"), F.lit("s").alias("sha256"), F.col("id").alias("size_bytes"), F.lit("exported").alias("status"))
    once = exports.export_manifest(plans, sums, sums, sums)
    apart = exports.export_manifest(plans, sums, sums.select("*"), sums.select("*"))
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1
    assert sorted(once.collect()) == sorted(apart.collect())

    written = []
    monkeypatch.setattr(exports, "settle", lambda df: written.append(df.columns) or df.localCheckpoint())
    exports.ordered_digest(once, "row_digest", ["export_item_id"], 5).collect()
    assert written[0] == ["d", "__id"]
