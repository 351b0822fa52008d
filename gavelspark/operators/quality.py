"""Data-quality rules: invalid rows, with their reasons, as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelspark.functions.text import EMAIL, PHONE, SPACE, WORD_CHARACTERS, moment, number
from gavelspark.operators import lifecycle

# The rules each kind of request is held to.
RULES: dict[str, dict[str, dict]] = {
    "register": {
        "username": {"required": True, "min_length": 3, "max_length": 50, "alphanumeric": True, "no_spaces": True},
        "email": {"required": True, "email": True},
        "password": {"required": True, "min_length": 6, "max_length": 100},
        "role": {"one_of": ["buyer", "seller"]},
    },
    "login": {
        "email": {"required": True, "email": True},
        "password": {"required": True},
    },
    "auction": {
        "title": {"required": True, "min_length": 3, "max_length": 200},
        "category_id": {"required": True, "number": True, "min": 1},
        "starting_price": {"required": True, "number": True, "min": 1},
        "reserve_price": {"number": True, "min": 0},
        "buy_now_price": {"number": True, "min": 0},
        "start_time": {"required": True, "date": True},
        "end_time": {"required": True, "date": True},
    },
    "bid": {
        "auction_id": {"required": True, "number": True, "min": 1},
        "amount": {"required": True, "number": True, "min": 0.01},
    },
    "profile": {
        "full_name": {"max_length": 100},
        "phone": {"max_length": 20},
        "password": {"min_length": 6},
    },
}


def _failures(field: str, rule: dict) -> list[tuple[Column, str]]:
    """(what fails, message) pairs in the order they are reported."""
    value = F.col(field)
    # The messages.
    tests = {
        "min_length": lambda n: (F.length(value) < n, f"must be at least {n} characters."),
        "max_length": lambda n: (F.length(value) > n, f"must be at most {n} characters."),
        "email": lambda _: (~value.rlike(EMAIL), "must be a valid email address."),
        "number": lambda _: (number(value).isNull(), "must be a number."),
        "min": lambda n: (number(value) < n, f"must be at least {n}."),
        "max": lambda n: (number(value) > n, f"must be at most {n}."),
        "date": lambda _: (moment(value).isNull(), "must be a valid date."),
        "one_of": lambda some: (~value.isin(some), f"must be one of: {', '.join(some)}."),
        "no_spaces": lambda _: (value.rlike(SPACE), "must not contain spaces."),
        "alphanumeric": lambda _: (
            ~value.rlike(WORD_CHARACTERS), "must only contain letters, numbers, and underscores."
        ),
    }
    given = value != ""
    found = [(given & fails, f"{field} {text}") for fails, text in (
        test(rule[name]) for name, test in tests.items() if name in rule
    )]
    if rule.get("required"):
        found.insert(0, (~F.coalesce(given, F.lit(False)), f"{field} is required."))
    return found


def validate_rows(rows: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """The rows with `errors`, all that is wrong in order, and `error`, the first of them.

    Values are text, as submitted. A missing required value is its field's only error.
    """
    messages = [F.when(fails, message) for field, rule in rules.items() for fails, message in _failures(field, rule)]
    errors = F.filter(F.array(*messages), lambda message: message.isNotNull())
    return rows.withColumn("errors", errors).withColumn("error", F.try_element_at("errors", F.lit(1)))


def _first(*checks: tuple[Column, str | Column]) -> Column:
    return F.coalesce(*(F.when(fails, message if isinstance(message, Column) else F.lit(message)) for fails, message in checks))


def _empty(field: str) -> Column:
    return F.coalesce(F.trim(field) == "", F.lit(True))


def _not_positive(field: str) -> Column:
    return ~F.coalesce(number(F.col(field)) > 0, F.lit(False))


def _short(field: str, n: int) -> Column:
    return F.length(field) < n


def register_form() -> Column:
    # Fixed values, as in all forms below: the messages.
    return _first(
        (_empty("username"), "Username is required."),
        (_short("username", 3), "Username must be at least 3 characters."),
        (~F.col("username").rlike(WORD_CHARACTERS), "Username can only contain letters, numbers, and underscores."),
        (_empty("email"), "Email is required."),
        (~F.col("email").rlike(EMAIL), "Please enter a valid email address."),
        (_empty("password"), "Password is required."),
        (_short("password", 6), "Password must be at least 6 characters."),
        (~F.col("password").eqNullSafe(F.col("confirm_password")), "Passwords do not match."),
    )


def login_form() -> Column:
    return _first(
        (_empty("email"), "Email is required."),
        (~F.col("email").rlike(EMAIL), "Please enter a valid email address."),
        (_empty("password"), "Password is required."),
    )


def auction_form(as_of: Column) -> Column:
    start, end = moment(F.col("start_time")), moment(F.col("end_time"))
    buy_now = F.col("buy_now_price") != ""
    return _first(
        (_empty("title"), "Auction title is required."),
        (_short("title", 3), "Title must be at least 3 characters."),
        (_empty("category_id"), "Please select a category."),
        (_empty("starting_price"), "Starting price is required."),
        (_not_positive("starting_price"), "Starting price must be a positive number."),
        (_empty("start_time"), "Start time is required."),
        (_empty("end_time"), "End time is required."),
        (start.isNull(), "Start time is not a valid date."),
        (end.isNull(), "End time is not a valid date."),
        (end <= start, "End time must be after start time."),
        (end <= as_of, "End time must be in the future."),
        ((F.col("reserve_price") != "") & _not_positive("reserve_price"), "Reserve price must be a positive number."),
        (buy_now & _not_positive("buy_now_price"), "Buy Now price must be a positive number."),
        (
            buy_now & (number(F.col("buy_now_price")) <= number(F.col("starting_price"))),
            "Buy Now price must be higher than starting price.",
        ),
    )


def bid_form(current_price: Column) -> Column:
    higher = F.concat(
        F.lit("Your bid must be higher than the current price of ₹"), current_price.cast("string"), F.lit(".")
    )
    return _first(
        (_empty("amount"), "Please enter a bid amount."),
        (_not_positive("amount"), "Bid amount must be a positive number."),
        (number(F.col("amount")) <= current_price.cast("double"), higher),
    )


def profile_form() -> Column:
    return _first(
        ((F.col("phone") != "") & ~F.col("phone").rlike(PHONE), "Phone number is not valid."),
        ((F.col("password") != "") & _short("password", 6), "New password must be at least 6 characters."),
    )


def validate_auction_form(rows: DataFrame, as_of: Column) -> DataFrame:
    """The rows with the first `error` the auction form shows, NULL where there is none."""
    return rows.withColumn("error", auction_form(as_of))


def _stack(reports: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, reports)


# The unique keys; text keys count without case.
KEYS = {
    "categories": [("name",)],
    "users": [("username",), ("email",)],
    "bids": [("auction_id", "bidder_id", "amount")],
    "watchlist": [("user_id", "auction_id")],
    "auto_bids": [("auction_id", "user_id")],
}


def key_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, key_columns, key_value, copies) of every repeated unique key."""
    reports = []
    for name, rows in tables.items():
        kinds = dict(rows.dtypes)
        for key in KEYS[name]:
            folded = [F.lower(c).alias(c) if kinds[c] == "string" else F.col(c) for c in key]
            repeated = rows.select(*folded).groupBy(*key).agg(F.count("*").alias("copies")).where("copies > 1")
            reports.append(
                repeated.select(
                    F.lit(name).alias("table_name"), F.lit(", ".join(key)).alias("key_columns"),
                    F.concat_ws(", ", *(F.col(c).cast("string") for c in key)).alias("key_value"), "copies",
                )
            )
    return _stack(reports)


# Child table and column, parent table.
REFERENCES = [
    ("auction_items", "seller_id", "users"),
    ("auction_items", "category_id", "categories"),
    ("auction_items", "winner_id", "users"),
    ("bids", "auction_id", "auction_items"),
    ("bids", "bidder_id", "users"),
    ("watchlist", "user_id", "users"),
    ("watchlist", "auction_id", "auction_items"),
    ("notifications", "user_id", "users"),
    ("notifications", "auction_id", "auction_items"),
    ("auto_bids", "auction_id", "auction_items"),
    ("auto_bids", "user_id", "users"),
]


def orphans(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, id, missing_id) of rows that refer to an absent parent. A NULL refers to none.

    All references, a number for the kind of each, meet all parents in one join, so each table is computed once as a child;
    adaptive execution splits a parent that too many rows refer to.
    """
    known = [(child, column, parent) for child, column, parent in REFERENCES if child in tables and parent in tables]
    names = sorted({parent for _, _, parent in known})
    parents = [tables[name].select(F.lit(k).alias("parent"), F.col("id").cast("long").alias("missing_id")) for k, name in enumerate(names)]
    rows = []
    for name, table in tables.items():
        links = [
            F.struct(F.lit(k).alias("link"), F.lit(names.index(parent)).alias("parent"), F.col(column).cast("long").alias("missing_id"))
            for k, (child, column, parent) in enumerate(known) if child == name
        ]
        if links:
            rows.append(table.select("id", F.inline(F.array(*links))).where("missing_id is not null"))
    if not rows:
        return _stack(rows)
    # An anti-join would be pushed into the union, and all parents computed for each child.
    present = _stack(parents).withColumn("present", F.lit(True))
    missing = _stack(rows).join(present, ["parent", "missing_id"], "left").where("present is null")

    def told(part: int) -> Column:
        return F.array(*(F.lit(link[part]) for link in known))[F.col("link")]

    return missing.select(told(0).alias("table_name"), told(1).alias("column_name"), "id", "missing_id")


# The permitted values and the columns that must be filled.
DOMAINS = {
    ("users", "role"): ["buyer", "seller", "admin"],
    ("auction_items", "status"): ["upcoming", "active", "closed", "cancelled"],
    ("notifications", "type"): ["outbid", "auction_won", "auction_ended", "new_bid", "auction_starting"],
}
REQUIRED = {
    "categories": ["name"],
    "users": ["username", "email", "password_hash"],
    "auction_items": [
        "seller_id", "category_id", "title", "starting_price", "current_price", "start_time", "end_time",
    ],
    "bids": ["auction_id", "bidder_id", "amount"],
    "watchlist": ["user_id", "auction_id"],
    "notifications": ["user_id", "type", "message"],
    "auto_bids": ["auction_id", "user_id", "max_amount"],
}


def domain_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, id, problem), one pass per table."""
    reports = []
    for name, rows in tables.items():
        problems = [
            F.when(F.col(c).isNull(), F.struct(F.lit(c).alias("column_name"), F.lit("missing").alias("problem")))
            for c in REQUIRED[name] if c in rows.columns
        ] + [
            F.when(~F.col(c).isin(values), F.struct(F.lit(c).alias("column_name"), F.lit("not permitted").alias("problem")))
            for (table, c), values in DOMAINS.items() if table == name
        ]
        found = F.filter(F.array(*problems), lambda problem: problem.isNotNull())
        reports.append(
            rows.select("id", F.explode(found).alias("found")).select(
                F.lit(name).alias("table_name"), "found.column_name", "id", "found.problem"
            )
        )
    return _stack(reports)


def business_violations(auctions: DataFrame, replay: DataFrame) -> DataFrame:
    """(rule, id): bids not above the price or by the seller, auctions that end before they start."""
    bids = replay.where(F.col("outcome").isin("low", "self")).select(
        F.when(F.col("outcome") == "low", "bid above price").otherwise("bidder is not seller").alias("rule"), "id"
    )
    spans = auctions.where(~(F.col("end_time") > F.col("start_time"))).select(
        F.lit("end after start").alias("rule"), "id"
    )
    return bids.unionByName(spans)


def missing_winner(auctions: DataFrame) -> DataFrame:
    return auctions.where(
        (F.col("status") == "closed") & F.col("winner_id").isNull() & (F.col("total_bids") > 0)
    ).select("id", "title", "current_price", "total_bids")


def counter_drift(auctions: DataFrame, bids: DataFrame) -> DataFrame:
    """Auctions whose stored price, count or winning row disagree with their bids."""
    counted = bids.groupBy("auction_id").agg(
        F.max("amount").alias("bid_price"), F.count("*").alias("bid_count"),
        F.count_if("is_winning").alias("winning_rows"),
    )
    winning = F.coalesce("winning_rows", F.lit(0))
    count = F.coalesce("bid_count", F.lit(0))
    return (
        auctions.join(counted, F.col("id") == F.col("auction_id"), "left")
        .withColumn("due_price", F.coalesce("bid_price", "starting_price"))
        .where(
            ~F.col("current_price").eqNullSafe(F.col("due_price"))
            | ~F.col("total_bids").eqNullSafe(count)
            | (winning != F.when(count > 0, 1).otherwise(0))
        )
        .select(
            "id", "current_price", "due_price", "total_bids", count.alias("due_bids"), winning.alias("winning_rows")
        )
    )
