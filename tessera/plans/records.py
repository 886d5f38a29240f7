"""Archives and files of delimited records, written from the star-schema tables and read back, each query with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.queries import _t, query
from tessera.sources import records, zip_members
from tessera.sources.archives import text_lines
from tessera.sources.folders import new_folder, stage


@query("""
    SELECT l_suppkey, year(l_shipdate) AS yr, l_returnflag, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS gross, count(DISTINCT l_linestatus || ';"' || l_linenumber || chr(10) || 'é') AS notes
    FROM lineitem WHERE year(l_shipdate) >= 1994 GROUP BY ALL
""")
def archived_lines(spark, sf_dir):
    """Lines filed as ZIP archives (250 suppliers and a year each, a member a return flag), read back a task a member from 1994 on."""
    li = _t(spark, sf_dir, "lineitem")
    note = F.concat("l_linestatus", F.lit(';""'), F.col("l_linenumber").cast("string"), F.lit("\né"))
    fields = [F.col(c).cast("string") for c in ("l_suppkey", "l_orderkey")] + [F.col(c).cast("decimal(18,2)").cast("string") for c in ("l_quantity", "l_extendedprice")]
    archive = F.concat(F.lit("lines_"), F.floor(F.col("l_suppkey") / 250).cast("string"), F.lit("_"), F.year("l_shipdate").cast("string"), F.lit(".zip"))
    rows = li.select(archive.alias("archive"), F.concat("l_returnflag", F.lit(".csv")).alias("member"), F.lit(1).cast("long").alias("line_no"), F.concat_ws(";", *fields, F.concat(F.lit('"'), note, F.lit('"'))).alias("text"))
    heads = rows.select("archive", "member").distinct().withColumns({"line_no": F.lit(0).cast("long"), "text": F.lit("supplier;order;quantity;price;note")})
    folder = new_folder(spark, "archives")
    zip_members.write_archives(rows.unionByName(heads), folder).count()
    lines = stage(zip_members.member_lines(spark, folder).where("year >= 1994"), "lines")
    whole = records.whole_records(lines)
    read = records.named(whole, ["supplier", "quantity", "price", "note"]).select(F.col("supplier").cast("long").alias("l_suppkey"), F.regexp_extract("archive", r"_(\d+)\.zip$", 1).cast("int").alias("yr"), F.regexp_extract("member", "^(.*)\\.csv$", 1).alias("l_returnflag"), F.col("quantity").cast("decimal(18,2)").alias("q"), F.col("price").cast("decimal(18,2)").alias("p"), "note")
    return read.groupBy("l_suppkey", "yr", "l_returnflag").agg(F.count("*").alias("n"), F.sum("q").cast("double").alias("qty"), F.sum("p").cast("double").alias("gross"), F.count_distinct("note").alias("notes"))


_NOTE = "CASE o_orderkey % 4 WHEN 0 THEN concat(o_orderpriority, {nl}, 'said \"', o_orderstatus, '\"; ', o_custkey) WHEN 1 THEN concat(o_orderpriority, ';', o_custkey) WHEN 2 THEN concat('\"', {nl}, {nl}, o_orderstatus) ELSE o_orderpriority END"


@query(f"SELECT o_orderkey, note, length(note) AS n_chars, CAST(o_totalprice AS DOUBLE) AS total FROM (SELECT *, {_NOTE.format(nl='chr(10)')} AS note FROM orders)")
def quoted_notes(spark, sf_dir):
    """Orders with notes of several lines as delimited files, cut at split borders and brought together again by the state of their quotes."""
    orders = _t(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_NOTE.format(nl='chr(10)')} AS note", "o_totalprice")
    folder = new_folder(spark, "notes")
    orders.write.option("header", True).option("sep", ";").option("escape", '"').option("quote", '"').csv(folder)
    read = records.named(records.whole_records(stage(text_lines(spark, folder, "UTF-8"), "lines")), ["o_orderkey", "note", "o_totalprice"])
    return read.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "note", F.char_length("note").alias("n_chars"), F.col("o_totalprice").cast("double").alias("total"))
