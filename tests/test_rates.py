from pyspark.sql import functions as F

from tests.plans import plan_text
from salesledger.operators.rates import base_rates, convert, rates_grid, refresh_rates


def test_convert_inr_to_usd_and_between(spark):
    df = spark.createDataFrame([(1, 1000.0, "INR", "USD"), (2, 12.0, "USD", "EUR"), (3, -5.0, "INR", "USD"),
                                (4, None, "INR", "USD"), (5, 10.0, "XXX", "USD")],
                               "id long, amount double, cur_from string, cur_to string")
    got = {r.id: r.converted for r in convert(df, base_rates(spark), "amount", "cur_from", "cur_to").collect()}
    assert got[1] == 1000.0 / 1.0 * 0.012
    assert got[2] == 12.0 / 0.012 * 0.011
    assert got[3] is None and got[4] is None and got[5] is None


def test_convert_plans(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("amount"))
    out = convert(df, base_rates(spark), "amount", "INR", "JPY")
    plan = plan_text(out)
    assert "Join" not in plan and "Subquery" in plan  # codes are scalar lookups
    assert out.filter("amount = 10").first().converted == 10.0 / 1.0 * 1.88
    varying = df.withColumn("c", F.when(F.col("amount") % 2 == 0, "USD").otherwise("EUR"))
    per_row = convert(varying, base_rates(spark), "amount", "c", "INR")
    p2 = plan_text(per_row)
    assert "BroadcastHashJoin" in p2 and "NestedLoop" not in p2 and "CartesianProduct" not in p2


def test_rates_grid_and_refresh(spark):
    grid = {r.currency: r.value for r in rates_grid(base_rates(spark)).collect()}
    assert set(grid) == {"USD", "EUR", "GBP", "AED", "SGD", "JPY", "CAD"} and grid["USD"] == 100 * 0.012
    feed = spark.createDataFrame([("USD", 0.013), ("EUR", 0.0), ("XYZ", 5.0), ("GBP", None)], "currency string, rate double")
    new = {r.currency: r.rate for r in refresh_rates(base_rates(spark), feed).collect()}
    assert new["USD"] == 0.013 and new["EUR"] == 0.011 and new["GBP"] == 0.0095 and "XYZ" not in new
    assert len(new) == 8


def test_repeated_feed_rows_and_unknown_codes(spark):
    from salesledger.operators.rates import refresh_rates

    feed = spark.createDataFrame([("USD", 0.5), ("USD", 0.25), ("XYZ", 9.0), ("EUR", 0.0)], "currency string, rate double")
    rates = refresh_rates(base_rates(spark), feed)
    got = {r.currency: r.rate for r in rates.collect()}
    assert len(got) == rates.count() == 8 and got["USD"] == 0.5 and got["EUR"] == 0.011
    facts = spark.createDataFrame([(1, 2.0)], "id int, amount double")
    assert convert(facts, base_rates(spark), to_currency="XYZ").first().converted is None
    doubled = base_rates(spark).unionByName(base_rates(spark))
    cols = facts.withColumn("c", __import__("pyspark").sql.functions.lit("USD"))
    assert convert(cols, doubled, "amount", "c", "INR").count() == 1


def test_last_feed_rate_counts_where_an_order_is_named(spark):
    feed = spark.createDataFrame([("USD", 0.02, 1), ("USD", 0.013, 3), ("USD", 0.0, 4), ("EUR", 0.5, None), ("EUR", 0.012, 2)], "currency string, rate double, seen int")
    last = {r.currency: r.rate for r in refresh_rates(base_rates(spark), feed, "seen").collect()}
    assert last["USD"] == 0.013 and last["EUR"] == 0.012 and last["GBP"] == 0.0095 and len(last) == 8
    highest = {r.currency: r.rate for r in refresh_rates(base_rates(spark), feed).collect()}
    assert highest["USD"] == 0.02 and highest["EUR"] == 0.5
