"""Request and change logs for the operators that take one, derived from the whole tables.

The test tables hold no such logs and satisfy every constraint, so these queries derive requests
from all rows and damage some values. Each text runs on Spark and, with plain names, on any
ANSI-like engine.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame

SAMPLES: dict[str, str] = {
    "signups": """
        SELECT id,
          CASE WHEN id % 11 = 0 THEN '' WHEN id % 11 = 1 THEN 'ab' WHEN id % 11 = 2 THEN username
            WHEN id % 11 = 3 THEN 'two words' ELSE replace(username, '#', '_') END AS username,
          CASE WHEN id % 7 = 0 THEN 'broken' WHEN id % 7 = 1 THEN upper(email) ELSE email END AS email,
          CASE WHEN id % 5 = 0 THEN 'short' WHEN id % 5 = 1 THEN NULL ELSE 'secret' || CAST(id AS STRING) END AS password,
          CASE WHEN id % 5 = 2 THEN 'other' ELSE 'secret' || CAST(id AS STRING) END AS confirm_password,
          CASE WHEN id % 4 = 0 THEN NULL ELSE role END AS role,
          CASE WHEN id % 3 = 0 THEN 'call me' WHEN id % 3 = 1 THEN '+1 (555) 010-' || CAST(id AS STRING) ELSE '' END AS phone,
          CASE WHEN id % 13 = 0 THEN repeat(full_name, 20) ELSE full_name END AS full_name
        FROM {users}""",
    "submitted": """
        SELECT id, seller_id,
          CASE WHEN id % 11 = 0 THEN '' WHEN id % 11 = 1 THEN 'it' WHEN id % 11 = 2 THEN repeat(title, 20) ELSE title END AS title,
          CASE WHEN id % 17 = 0 THEN 'none' ELSE CAST(category_id AS STRING) END AS category_id,
          CASE WHEN id % 5 = 0 THEN 'much' WHEN id % 5 = 1 THEN '-3' ELSE CAST(starting_price AS STRING) END AS starting_price,
          CASE WHEN id % 6 = 0 THEN '-1' ELSE CAST(reserve_price AS STRING) END AS reserve_price,
          CASE WHEN id % 9 = 0 THEN '1' ELSE CAST(buy_now_price AS STRING) END AS buy_now_price,
          CASE WHEN id % 19 = 0 THEN 'soon' ELSE CAST(start_time AS STRING) END AS start_time,
          CASE WHEN id % 23 = 0 THEN NULL WHEN id % 23 = 1 THEN CAST(start_time AS STRING) ELSE CAST(end_time AS STRING) END AS end_time
        FROM {auction_items}""",
    "typed_bids": """
        SELECT b.id, CASE WHEN b.id % 11 = 0 THEN NULL ELSE CAST(b.auction_id AS STRING) END AS auction_id,
          CASE WHEN b.id % 13 = 0 THEN 'all' WHEN b.id % 13 = 1 THEN '0' ELSE CAST(b.amount AS STRING) END AS amount,
          a.current_price
        FROM {bids} b JOIN {auction_items} a ON a.id = b.auction_id""",
    "submissions": """
        SELECT id, seller_id, category_id, CASE WHEN id % 11 = 0 THEN '' ELSE title END AS title,
          CASE WHEN id % 3 = 0 THEN '' ELSE 'as shown' END AS description, image_url,
          CASE WHEN id % 17 = 0 THEN CAST(0 AS DECIMAL(10,2)) ELSE starting_price END AS starting_price,
          coalesce(reserve_price, CAST(0 AS DECIMAL(10,2))) AS reserve_price,
          coalesce(buy_now_price, CAST(0 AS DECIMAL(10,2))) AS buy_now_price,
          start_time + INTERVAL '800' DAY AS start_time,
          CASE WHEN id % 13 = 0 THEN start_time ELSE end_time + INTERVAL '800' DAY END AS end_time
        FROM {auction_items}""",
    "auto_log": """
        SELECT id, auction_id, bidder_id AS user_id, CASE WHEN is_winning THEN 'stop' ELSE 'set' END AS op,
          amount AS max_amount, created_at
        FROM {bids}""",
    "auction_changes": """
        SELECT id AS auction_id, 'delete' AS op, start_time + INTERVAL '3' DAY AS created_at, CAST(NULL AS BIGINT) AS seller_id,
          CAST(NULL AS DECIMAL(10,2)) AS starting_price, CAST(NULL AS DECIMAL(10,2)) AS buy_now_price,
          CAST(NULL AS TIMESTAMP_NTZ) AS end_time, CAST(NULL AS STRING) AS status
        FROM {auction_items} WHERE status IN ('active', 'closed') AND id % 13 = 0
        UNION ALL
        SELECT id, 'list', start_time + INTERVAL '6' DAY, seller_id, starting_price, buy_now_price, end_time, CAST(NULL AS STRING)
        FROM {auction_items} WHERE (status IN ('active', 'closed') AND id % 13 = 0) OR status = 'upcoming'
        UNION ALL
        SELECT id, 'patch', start_time + INTERVAL '1' DAY, NULL, NULL, NULL, end_time + INTERVAL '2' DAY, NULL
        FROM {auction_items} WHERE status IN ('active', 'closed') AND id % 5 = 0
        UNION ALL
        SELECT id, 'patch', start_time + INTERVAL '10' DAY, NULL, NULL, NULL, NULL, 'cancelled'
        FROM {auction_items} WHERE status IN ('active', 'closed') AND id % 11 = 0""",
    "proxy_log": """
        SELECT id * 2 AS id, auction_id, user_id, 'set' AS op, max_amount, created_at + (user_id % 5) * INTERVAL '1' DAY AS created_at
        FROM {auto_bids}
        UNION ALL
        SELECT id * 2 + 1, auction_id, user_id, 'stop', CAST(NULL AS DECIMAL(10,2)), created_at + (5 + user_id % 7) * INTERVAL '1' DAY
        FROM {auto_bids} WHERE user_id % 3 = 0""",
    "proxy_requests": """
        SELECT auction_id, bidder_id AS user_id, CAST(max(amount) * 1.2 AS DECIMAL(10,2)) AS max_amount, max(created_at) AS created_at
        FROM {bids} GROUP BY auction_id, bidder_id""",
    "auction_patches": """
        SELECT id * 2 AS patch_id, id AS auction_id, seller_id AS user_id, start_time AS created_at,
          CASE WHEN status = 'active' THEN upper(title) WHEN status = 'closed' THEN '' END AS title,
          CASE WHEN status = 'active' THEN 'edited by owner' END AS description,
          '' AS image_url,
          CASE WHEN status = 'upcoming' THEN end_time + INTERVAL '1' DAY END AS end_time,
          CASE WHEN status = 'upcoming' THEN 'active' END AS status
        FROM {auction_items}
        UNION ALL
        SELECT id * 2 + 1, auction_id, bidder_id, created_at, CAST(NULL AS STRING), 'edited by bidder', '/new.png',
          created_at, CAST(NULL AS STRING)
        FROM {bids}""",
    "profile_patches": """
        SELECT id * 2 AS patch_id, id AS user_id, created_at, CASE WHEN role = 'admin' THEN '' END AS full_name,
          CASE WHEN is_active THEN '555-' || CAST(id AS STRING) END AS phone, CAST(NULL AS STRING) AS address
        FROM {users}
        UNION ALL
        SELECT id, bidder_id, created_at, CAST(NULL AS STRING), CAST(NULL AS STRING),
          CASE WHEN is_winning THEN 'lot ' || CAST(auction_id AS STRING) END
        FROM {bids}""",
    "acks": """
        SELECT n.user_id, n.id AS notification_id FROM {notifications} n WHERE n.type = 'auction_won'
        UNION ALL
        SELECT n.user_id + 1, n.id FROM {notifications} n WHERE n.type = 'outbid'
        UNION ALL
        SELECT u.id, CAST(NULL AS BIGINT) FROM {users} u WHERE u.role = 'seller'""",
    "auction_deletions": """
        SELECT id AS auction_id, seller_id AS user_id FROM {auction_items} WHERE status = 'closed' AND winner_id IS NULL
        UNION ALL
        SELECT auction_id, bidder_id FROM {bids}""",
    "user_deletions": "SELECT id AS user_id FROM {users} WHERE NOT is_active",
    "category_deletions": "SELECT id AS category_id FROM {categories}",
    "watch_pairs": "SELECT DISTINCT user_id, auction_id FROM {watch_log}",
    "damaged_users": """
        SELECT id, CASE WHEN id % 11 = 0 THEN NULL ELSE username END AS username, email,
          CASE WHEN id % 7 = 0 THEN 'guest' ELSE role END AS role
        FROM {users}""",
    "damaged_auctions": """
        SELECT id, seller_id, category_id, CASE WHEN id % 11 = 0 THEN NULL ELSE title END AS title, starting_price,
          current_price, start_time, CASE WHEN id % 13 = 0 THEN start_time ELSE end_time END AS end_time,
          CASE WHEN id % 7 = 0 THEN upper(status) ELSE status END AS status
        FROM {auction_items}""",
    "damaged_bids": """
        SELECT id, auction_id, bidder_id, CASE WHEN id % 11 = 0 THEN NULL ELSE amount END AS amount FROM {bids}""",
    "repeated_users": """
        SELECT id, username, email FROM {users}
        UNION ALL
        SELECT id + 1000000000, upper(username), CASE WHEN is_active THEN upper(email) ELSE 'new-' || email END FROM {users}
        WHERE role = 'seller'""",
}


def placeholders(text: str) -> list[str]:
    return sorted({name for _, name, _, _ in string.Formatter().parse(text) if name})


def sample(data: object, name: str) -> DataFrame:
    """The sample over the tables of `data` (attributes of the names the text uses)."""
    text = SAMPLES[name]
    return data.spark.sql(text, **{table: getattr(data, table) for table in placeholders(text)})
