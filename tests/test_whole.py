"""Queries that must read whole tables, and whole names and texts."""

from pyspark.sql import functions as F

from tessera.plans.queries import QUERIES


def test_priority_merge_reads_all_of_both_sources(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    got = {r["source"]: (r["n"], r["rows"]) for r in QUERIES["priority_merge_users"](spark, sf_dir).groupBy("source").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect()}
    assert got["purchase"][0] == events.where("event_type = 'purchase'").count()
    views = events.where("event_type = 'view'").select("user_id", F.to_date("ts").alias("day")).distinct()
    bought = events.where("event_type = 'purchase'").select("user_id", F.to_date("ts").alias("day")).distinct()
    assert got["view"][1] == views.join(bought, ["user_id", "day"], "left_anti").count() > 0
