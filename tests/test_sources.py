import os
from decimal import Decimal

from pyspark.sql import functions as F

from gavelspark.session import shared_dir
from gavelspark.sources import SCHEMAS, AuctionData, read_table, register_views, write_table
from gavelspark.streaming.logs import fresh_folder
from tests.test_named_queries import FOLDER


def test_tables_survive_storage(spark):
    d, root = AuctionData(spark, FOLDER), fresh_folder(spark, "tables")
    for name in ("users", "categories", "auction_items", "bids", "auto_bids", "watchlist", "notifications"):
        rows = getattr(d, name)
        write_table(rows, root, name)
        stored = read_table(spark, root, name)
        assert set(stored.columns) == set(SCHEMAS[name].fieldNames())
        assert stored.count() == rows.count() > 0
    stored = read_table(spark, root, "auction_items").select(sorted(d.auction_items.columns))
    given = d.auction_items.select(*(F.col(c).cast(stored.schema[c].dataType) for c in stored.columns))
    assert stored.exceptAll(given).isEmpty() and given.exceptAll(stored).isEmpty()


def test_a_status_filter_skips_folders(spark):
    d, root = AuctionData(spark, FOLDER), fresh_folder(spark, "tables")
    write_table(d.auction_items, root, "auction_items")
    active = read_table(spark, root, "auction_items").where("status = 'active'")
    plan = active._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(status" in plan
    files = [r.name for r in active.select(F.input_file_name().alias("name")).distinct().collect()]
    assert files and all("status=active" in name for name in files)


def test_views(spark):
    d = AuctionData(spark, FOLDER)
    register_views(d.users, d.categories, d.auction_items, d.bids)
    [row] = spark.sql(
        "SELECT (SELECT count(*) FROM v_active_auctions) AS active, (SELECT count(*) FROM v_bid_history) AS bids, "
        "(SELECT sum(total_bids_placed) FROM v_top_bidders) AS placed"
    ).collect()
    assert row.active == d.auction_items.where("status = 'active'").count()
    assert row.bids == row.placed == d.bids.count()


def test_mapped_tables_at_the_middle_scale(spark):
    d = AuctionData(spark, os.path.dirname(FOLDER) + "/sf0.01")
    [bids] = d.bids.agg(F.count("*").alias("n"), F.sum("amount").alias("total"), F.countDistinct("id").alias("ids")).collect()
    assert (bids.n, bids.total, bids.ids) == (39512, Decimal("2098479740.29"), 39512)
    outcomes = {r.outcome: r["count"] for r in d.replay.groupBy("outcome").count().collect()}
    assert outcomes == {"ok": 14112, "low": 9820, "self": 22, "ended": 5168, "not_active": 10390}


def test_shared_folder_is_stable(spark):
    assert shared_dir(spark) == shared_dir(spark)
