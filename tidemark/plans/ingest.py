"""Ingestion: parsing, unpivoting, upserts and validation over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sources
from ..functions import amount_from_text, code, number_from_text, r, slug, week_from_label
from ..registry import query
from .inputs import table


@query("q_json_props", "SELECT event_type AS source, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_props(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.from_json("props", "k bigint").k.alias("k"))
    return e.groupBy("source", "k").agg(F.count("*").alias("n"))


@query(
    "q_unpivot",
    "SELECT l_returnflag AS flag, name, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT l_returnflag, unnest(['quantity', 'discount', 'tax']) AS name, unnest([l_quantity, l_discount, l_tax]) AS value FROM lineitem) GROUP BY ALL",
)
def unpivot(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return li.unpivot(["flag"], ["quantity", "discount", "tax"], "name", "value").groupBy("flag", "name").agg(F.count("*").alias("n"), r(F.sum("value"), 2).alias("total"))


@query("q_week_labels", "SELECT strftime(o_orderdate, '%G_%V') AS label, CAST(min(CAST(date_trunc('week', o_orderdate) AS DATE)) AS VARCHAR) AS monday, count(*) AS n FROM orders GROUP BY 1")
def week_labels(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    label = F.concat_ws("_", F.expr("extract(YEAROFWEEK FROM o_orderdate)").cast("string"), F.lpad(F.weekofyear("o_orderdate").cast("string"), 2, "0"))
    g = o.groupBy(label.alias("label")).agg(F.count("*").alias("n"))
    return g.select("label", week_from_label(F.col("label")).cast("string").alias("monday"), "n")


@query("q_locale_numbers", "SELECT o_orderkey, round(o_totalprice, 2) AS value FROM orders")
def locale_numbers(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    english = F.format_number("o_totalprice", 2)
    german = F.translate(english, ",.", ".,")
    text = F.when(F.col("o_orderkey") % 2 == 0, german).otherwise(english)
    return o.select("o_orderkey", r(number_from_text(text), 2).alias("value"))


@query(
    "q_amounts",
    """SELECT o_orderkey, CASE o_orderkey % 8 WHEN 2 THEN floor(o_totalprice) WHEN 3 THEN floor(o_totalprice) WHEN 4 THEN floor(o_totalprice) * 1000000 WHEN 5 THEN NULL WHEN 6 THEN NULL WHEN 7 THEN round(floor(o_totalprice) + 0.5, 2) ELSE round(o_totalprice, 2) END AS amount FROM orders""",
)
def amounts(spark, sf_dir):
    """Every order's price as it may be written, in euro and English notation, grouped, with lone commas and with signs."""
    p, kind = F.col("o_totalprice"), F.col("o_orderkey") % 8
    cents, whole = F.format_number(p, 2), F.floor(p).cast("double")
    grouped, swap = F.format_number(whole, 0), lambda c: F.translate(c, ",.", ".,")
    text = (
        F.when(kind == 0, F.concat(swap(cents), F.lit(" €"))).when(kind == 1, cents).when(kind == 2, swap(grouped)).when(kind == 3, grouped).when(kind == 4, swap(F.format_number(whole * 1000000, 0)))
        .when(kind == 5, F.concat(F.lit("-"), swap(cents))).when(kind == 6, F.lit("n/a")).otherwise(F.concat(F.floor(p).cast("string"), F.lit(",5")))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", amount_from_text(text).alias("amount"))


@query("q_codes_and_slugs", "SELECT n_nationkey, right('00000' || n_nationkey, 5) AS code, trim(regexp_replace(lower(trim(n_name)), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM nation")
def codes(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", code(F.concat("n_nationkey", F.lit(".0")), 5).alias("code"), slug(F.col("n_name")).alias("slug"))


@query(
    "q_upsert",
    """WITH o AS (SELECT c_custkey AS k, c_acctbal AS v, 20 AS seen FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal * 2 END AS v, 10 + CAST(c_custkey % 20 AS INTEGER) AS seen FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0)
       SELECT coalesce(o.k, n.k) AS k, round(coalesce(n.v, o.v), 4) AS v, least(o.seen, n.seen) AS seen FROM o FULL JOIN n ON o.k = n.k""",
)
def upsert(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    old = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.lit(20).alias("seen"))
    new = c.where("c_custkey % 2 = 0 OR c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal") * 2).alias("v"), (10 + F.col("c_custkey") % 20).cast("int").alias("seen"))
    return sources.upsert(old, new, ["k"], earliest=["seen"]).select("k", r(F.col("v"), 4).alias("v"), "seen")


@query(
    "q_validation_issues",
    "SELECT concat_ws('|', CASE WHEN NOT o_totalprice < 400000 THEN 'too_large' END, CASE WHEN NOT o_orderstatus IN ('O', 'F') THEN 'status' END, CASE WHEN NOT o_orderpriority <> '5-LOW' THEN 'priority' END) AS codes, count(*) AS n FROM orders GROUP BY 1",
)
def validation(spark, sf_dir):
    rules = {"too_large": F.col("o_totalprice") < 400000, "status": F.col("o_orderstatus").isin("O", "F"), "priority": F.col("o_orderpriority") != "5-LOW"}
    return sources.issues(table(spark, sf_dir, "orders"), rules).groupBy(F.array_join("issues", "|").alias("codes")).agg(F.count("*").alias("n"))


@query("q_repeat_flags", "SELECT repeated, count(*) AS n FROM (SELECT row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts, event_id) > 1 AS repeated FROM events) GROUP BY 1")
def repeats(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return sources.flag_repeats(e, ["user_id", "event_type", "day"], ["ts", "event_id"]).groupBy("repeated").agg(F.count("*").alias("n"))


@query("q_missing_targets", "WITH o AS (SELECT o_orderstatus AS status, CAST(o_orderdate AS DATE) AS day FROM orders), c AS (SELECT status, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM o GROUP BY status) SELECT status, CAST(day AS VARCHAR) AS day FROM (SELECT status, day FROM c EXCEPT SELECT status, day FROM o)")
def missing_targets(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.to_date("o_orderdate").alias("day"))
    calendar = o.groupBy("status").agg(F.min("day").alias("a"), F.max("day").alias("b")).select("status", F.explode(F.sequence("a", "b")).alias("day"))
    return calendar.join(o, ["status", "day"], "left_anti").select("status", F.col("day").cast("string").alias("day"))
