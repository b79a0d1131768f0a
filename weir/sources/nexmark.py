"""A deterministic auction stream: event i is made from i alone, so any range of it can be made in parallel.

Fixed values: the numbers, names and intervals of EVENTS are those of the benchmark that the published figures are for.
"""

from __future__ import annotations

#: Events of the stream for each row of the table of events, which so sets the scale.
PER_EVENT = 5
#: Both engines run this text; {n} events. 50 events a second: a person, three auctions, 46 bids.
EVENTS = """
base AS (SELECT i, i DIV 50 AS block, i % 50 AS pos, TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, (i DIV 50) + (i % 50) * 0.01) AS ts FROM (SELECT id AS i FROM range({n}))),
person AS (SELECT block AS id, concat('person-', block) AS name, concat('p', block, '@nexmark.test') AS email, concat('city-', block % 1000) AS city,
    CASE block % 6 WHEN 0 THEN 'OR' WHEN 1 THEN 'ID' WHEN 2 THEN 'CA' WHEN 3 THEN 'WA' WHEN 4 THEN 'NY' ELSE 'TX' END AS state, ts AS date_time, 'pextra' AS extra FROM base WHERE pos = 0),
auction AS (SELECT block * 3 + pos - 1 AS id, concat('item-', block * 3 + pos - 1) AS item_name, 10 AS initial_bid, 50 AS reserve, ts AS date_time, ts + INTERVAL 20 SECOND AS expires,
    block AS seller, block % 100 AS category, 'aextra' AS extra FROM base WHERE pos BETWEEN 1 AND 3),
bid AS (SELECT block * 3 + pos % 3 AS auction, pos AS bidder, i % 1000 + 1 AS price, concat('channel-', pos % 8) AS channel, concat('https://nexmark.test/', block * 3 + pos % 3) AS url, ts AS date_time, 'bextra' AS extra, i FROM base WHERE pos >= 4)
"""


def duck(sql: str) -> str:
    """The text for the other engine, which names a few functions differently."""
    out = sql.replace("make_interval(0, 0, 0, 0, 0, 0, (i DIV 50) + (i % 50) * 0.01)", "to_milliseconds((i // 50) * 1000 + (i % 50) * 10)")
    return out.replace(" DIV ", " // ").replace("TIMESTAMP_NTZ ", "TIMESTAMP ").replace("SELECT id AS i FROM range", "SELECT range AS i FROM range")


#: The stream for the other engine. Its tables are made once for a query, so that no join runs over the formula.
DUCK = duck(EVENTS).replace("SELECT range AS i FROM range({n})", f"SELECT unnest(range((SELECT {PER_EVENT} * count(*) FROM events))) AS i").replace(" AS (SELECT", " AS MATERIALIZED (SELECT")
