from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from gavelspark.functions import text, times
from gavelspark.operators import quality, reads, reports

NOW = datetime(2000, 1, 1)


def test_register_rules(spark):
    rows = spark.createDataFrame(
        [(1, "ann_1", "a@b.c", "secret", "buyer"), (2, None, "a@b", "", "admin"), (3, "a b", "a b@c.d", "12345", ""),
         (4, "x" * 51, "a@b.c", "secret", None)],
        "id long, username string, email string, password string, role string",
    )
    found = {r.id: r.errors for r in quality.validate_rows(rows, quality.RULES["register"]).collect()}
    assert found == {
        1: [],
        2: ["username is required.", "email must be a valid email address.", "password is required.",
            "role must be one of: buyer, seller."],
        3: ["username must not contain spaces.", "username must only contain letters, numbers, and underscores.",
            "email must be a valid email address.", "password must be at least 6 characters."],
        4: ["username must be at most 50 characters."],
    }


def test_number_rules(spark):
    rows = spark.createDataFrame(
        [(1, "1", "0.01"), (2, "x", "0"), (3, "0", " 5 "), (4, "1e1", "-1"), (5, "", "2.5.1")],
        "id long, auction_id string, amount string",
    )
    found = {r.id: (r.error, len(r.errors)) for r in quality.validate_rows(rows, quality.RULES["bid"]).collect()}
    assert found == {
        1: (None, 0), 2: ("auction_id must be a number.", 2), 3: ("auction_id must be at least 1.", 1),
        4: ("amount must be at least 0.01.", 1), 5: ("auction_id is required.", 2),
    }


def test_auction_form(spark):
    good = dict(title="Lamp", category_id="1", starting_price="10", start_time="2000-01-01 00:00:00",
                end_time="2000-01-02 00:00:00", reserve_price="", buy_now_price=None)
    damage = [
        ({}, None), ({"title": " "}, "Auction title is required."), ({"title": "it"}, "Title must be at least 3 characters."),
        ({"category_id": None}, "Please select a category."), ({"starting_price": "0"}, "Starting price must be a positive number."),
        ({"end_time": "soon"}, "End time is not a valid date."), ({"end_time": "2000-01-01"}, "End time must be after start time."),
        ({"start_time": "1999-01-01", "end_time": "2000-01-01"}, "End time must be in the future."),
        ({"reserve_price": "-1"}, "Reserve price must be a positive number."),
        ({"buy_now_price": "9"}, "Buy Now price must be higher than starting price."),
    ]
    schema = "id int, " + ", ".join(f"{c} string" for c in good)
    rows = spark.createDataFrame([(n, *{**good, **change}.values()) for n, (change, _) in enumerate(damage)], schema)
    found = quality.validate_auction_form(rows, times.naive(NOW)).orderBy("id").collect()
    assert [r.error for r in found] == [message for _, message in damage]


def test_tables_with_damage(spark):
    users = spark.createDataFrame(
        [(1, "ann", "a@b.c", "seller"), (2, "ANN", "x@b.c", "guest"), (3, "bob", None, "buyer")],
        "id long, username string, email string, role string",
    )
    assert [(r.key_columns, r.key_value, r.copies) for r in quality.key_violations({"users": users}).collect()] == [
        ("username", "ann", 2)
    ]
    assert {(r.column_name, r.id, r.problem) for r in quality.domain_violations({"users": users}).collect()} == {
        ("role", 2, "not permitted"), ("email", 3, "missing"),
    }
    lots = spark.createDataFrame([(1, 1, None), (2, 9, 3), (3, 3, 8)], "id long, seller_id long, winner_id long")
    lots = lots.withColumn("category_id", F.lit(1))
    assert {(r.column_name, r.id, r.missing_id) for r in quality.orphans({"users": users, "auction_items": lots}).collect()} == {
        ("seller_id", 2, 9), ("winner_id", 3, 8),
    }


def test_counter_drift(spark):
    lots = spark.createDataFrame(
        [(1, Decimal(10), Decimal(12), 2), (2, Decimal(10), Decimal(10), 0), (3, Decimal(10), Decimal(15), 1), (4, Decimal(10), Decimal(12), 1)],
        "id long, starting_price decimal(10,2), current_price decimal(10,2), total_bids int",
    )
    bids = spark.createDataFrame(
        [(1, Decimal(11), False), (1, Decimal(12), True), (3, Decimal(14), True), (4, Decimal(12), False)],
        "auction_id long, amount decimal(10,2), is_winning boolean",
    )
    assert {r.id: (r.due_price, r.due_bids, r.winning_rows) for r in quality.counter_drift(lots, bids).collect()} == {
        3: (Decimal(14), 1, 1), 4: (Decimal(12), 1, 0),
    }


def test_scalar_functions(spark):
    [row] = spark.range(1).select(
        text.typed_amount(F.lit(" 1,234.5 ")).alias("typed"), text.typed_amount(F.lit("much")).alias("bad"),
        text.or_buyer(F.lit("")).alias("role"), text.money(F.lit(750)).alias("money"),
        times.minutes_between(times.naive(NOW), times.naive(NOW + timedelta(seconds=80))).alias("minutes"),
        times.minutes_between(times.naive(NOW), times.naive(NOW - timedelta(seconds=80))).alias("back"),
    ).collect()
    assert row.asDict() == {"typed": Decimal("1234.50"), "bad": None, "role": "buyer", "money": "750.00", "minutes": 1, "back": -1}


def test_ties_of_the_latest_bid_stay(spark):
    bids = spark.createDataFrame(
        [(1, 1, 7, 5, NOW), (2, 2, 7, 6, NOW), (3, 1, 7, 4, NOW - timedelta(seconds=1)), (4, 1, 8, 9, NOW)],
        "id long, auction_id long, bidder_id long, amount int, created_at timestamp_ntz",
    )
    users = spark.createDataFrame([(7, "ann", "e", "f"), (8, "bob", "e", "f")], "id long, username string, email string, full_name string")
    lots = spark.createDataFrame([(1, "one"), (2, "two")], "id long, title string")
    found = {(r.username, r.auction_title) for r in reports.latest_bid_per_user(bids, users, lots).collect()}
    assert found == {("ann", "one"), ("ann", "two"), ("bob", "one")}


def test_identity_conflicts_ignore_case(spark):
    users = spark.createDataFrame([("ann", "a@b.c"), ("bob", "b@b.c")], "username string, email string")
    candidates = spark.createDataFrame(
        [(1, "ANN", "new@b.c"), (2, "new", "B@b.c"), (3, "bob", "b@b.c"), (4, "eve", "e@b.c")], "id long, username string, email string"
    )
    assert {r.id for r in reads.identity_conflicts(candidates, users).collect()} == {1, 2, 3}


def test_catalogue_criteria(spark):
    lots = spark.createDataFrame(
        [(1, 1, 1, "iPhone 14", "active", NOW), (2, 1, 2, "phone case", "closed", NOW), (3, 1, 1, "lamp", "active", NOW)],
        "id long, seller_id long, category_id int, title string, status string, created_at timestamp_ntz",
    )
    for extra in ("description", "image_url", "starting_price", "current_price", "buy_now_price", "start_time", "end_time", "total_bids"):
        lots = lots.withColumn(extra, F.lit(None).cast("string"))
    users = spark.createDataFrame([(1, "ann")], "id long, username string")
    names = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")

    def found(**criteria):
        return [r.id for r in reads.catalogue(lots, users, names, **criteria).collect()]

    assert found() == [1, 2, 3] and found(status="", search="") == [1, 2, 3]
    assert found(search="PHONE") == [1, 2] and found(search="phone", status="active") == [1] and found(category=2) == [2]
    assert found(search="p%n_ 1") == [1]
