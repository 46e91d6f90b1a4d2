"""Queries of streams, joins over time, and what is learned from items."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from basketry.operators import embedding, explain, learn, lookups, overtime
from basketry.plans.queries import BEFORE, EV, FEDERAL, PANEL, PE, big, ev_panel, feats, holidays, pe, query, r6, table, weather
from basketry.sources import receipts, workbook
from basketry.storage import shared_path
from basketry.streaming import history


@query(f"""WITH {EV}, g AS (SELECT *, date_diff('day', lag(d) OVER (PARTITION BY item_id ORDER BY d), d) AS gap FROM ev),
l AS (SELECT item_id, min(d) AS first_d, max(d) AS last_d, CAST(count(*) AS BIGINT) AS purchases, CAST(sum(qty) AS BIGINT) AS qty, round(coalesce(avg(gap), 0), 6) AS avg_gap, list(CAST(gap AS DOUBLE) ORDER BY d) FILTER (gap IS NOT NULL) AS gs FROM g GROUP BY item_id)
SELECT item_id, first_d, last_d, purchases, qty, avg_gap, round(coalesce(CASE WHEN len(gs) > 0 THEN list_reduce(gs, lambda a, x: 0.3 * x + 0.7 * a) END, 0), 6) AS ewma FROM l""")
def stream_item_history(spark, sf):
    """All purchases as a stream of files that aren't in the order of dates, through the state of items."""
    events = table(spark, sf, "events").where("event_type = 'purchase'")
    arrived = shared_path(spark, "arrived")
    rows = events.select(F.col("user_id").alias("item_id"), F.to_date("ts").alias("d"), F.lit(1).alias("qty"), "event_id")
    rows.repartition(4, "event_id").write.parquet(arrived)
    stream = history.state_session(spark).readStream.schema("item_id long, d date, qty int").option("maxFilesPerTrigger", 2).parquet(arrived)
    out = shared_path(spark, "histories")
    history.write_updates(history.histories(stream), out, shared_path(spark, "state"))
    found = history.latest_histories(spark.read.parquet(out))
    return found.select("item_id", "first_d", "last_d", big(F.col("purchases"), "purchases"), big(F.col("qty"), "qty"), r6(F.col("avg_gap"), "avg_gap"), r6(F.col("ewma"), "ewma"))


_W3 = "w AS (SELECT CAST(ts AS DATE) AS d, avg(value) AS temp FROM events WHERE day(ts) % 5 = 0 GROUP BY 1)"
_L = "l AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'purchase'), r AS (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase')"


def _sides(spark, sf):
    events = table(spark, sf, "events")
    return events.where("event_type != 'purchase'").select("event_id", "user_id", "ts"), events.where("event_type = 'purchase'").select("user_id", "ts", "value")


@query(f"WITH {_L} SELECT event_id, r.ts AS bought, value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts > r.ts")
def asof_last_purchase(spark, sf):
    left, right = _sides(spark, sf)
    return overtime.as_of(left, right, "ts", ("user_id",), strict=True).select("event_id", F.col("ts_right").alias("bought"), "value")


@query(f"WITH {_L}, j AS (SELECT event_id, l.ts, r.ts AS bought, value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts <= r.ts) SELECT event_id, CASE WHEN bought <= ts + INTERVAL 1 DAY THEN bought END AS bought, CASE WHEN bought <= ts + INTERVAL 1 DAY THEN value END AS value FROM j")
def asof_next_purchase_within_a_day(spark, sf):
    """Split by days, as if one user had much of the rows."""
    left, right = _sides(spark, sf)
    day = 86_400_000_000
    return overtime.as_of(left, right, "ts", ("user_id",), "forward", tolerance=day, bucket=day).select("event_id", F.col("ts_right").alias("bought"), "value")


@query(f"""WITH {_W3}, e AS (SELECT event_id, CAST(ts AS DATE) AS d FROM events), j AS (SELECT event_id, e.d, w.d AS measured, temp FROM e ASOF LEFT JOIN w ON e.d >= w.d)
SELECT event_id, CASE WHEN date_diff('day', measured, d) <= 2 THEN measured END AS measured, CASE WHEN date_diff('day', measured, d) <= 2 THEN round(temp, 6) END AS temp FROM j""")
def asof_weather(spark, sf):
    """The last weather measured, of two days before at most; it is measured on a few days of the month."""
    days = weather(spark, sf).where("day(d) % 5 = 0")
    events = table(spark, sf, "events").select("event_id", F.to_date("ts").alias("d"))
    return overtime.as_of(events, days, "d", tolerance=2, bucket=7).select("event_id", F.col("d_right").alias("measured"), r6(F.col("temp"), "temp"))


@query(f"""WITH {FEDERAL}, q AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders UNION SELECT DISTINCT CAST(ts AS DATE) FROM events)
SELECT d, (SELECT min(h) FROM hol WHERE h > d) AS upcoming, (SELECT max(h) FROM hol WHERE h <= d) AS latest, (SELECT arg_max(rule, h) FROM hol WHERE h <= d) AS rule FROM q""")
def asof_holidays_of_a_table(spark, sf):
    """The holidays around each day, from a table of them."""
    days = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).union(table(spark, sf, "events").select(F.to_date("ts"))).distinct()
    table_of = holidays(spark, sf)
    after = overtime.as_of(days, table_of.select(F.col("h").alias("upcoming")), "d", direction="forward", strict=True, bucket=365, right_time="upcoming")
    return overtime.as_of(after, table_of.withColumnRenamed("h", "latest"), "d", bucket=365, right_time="latest")


@query("""WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'purchase'), p AS (SELECT event_id AS purchase, user_id, ts AS bought FROM events WHERE event_type = 'purchase')
SELECT event_id, purchase FROM e JOIN p ON e.user_id = p.user_id AND e.ts BETWEEN p.bought AND p.bought + INTERVAL 6 HOUR""")
def interval_after_purchase(spark, sf):
    """Events of a user within six hours of a purchase."""
    events, bought = _sides(spark, sf)[0], table(spark, sf, "events").where("event_type = 'purchase'")
    periods = bought.select(F.col("event_id").alias("purchase"), "user_id", F.col("ts").alias("bought"), (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("until"))
    return overtime.within(events, periods, "ts", "bought", "until", 6 * 3_600_000_000, ("user_id",)).select("event_id", "purchase")


@query(f"""WITH {FEDERAL}, p AS (SELECT CAST(o_orderdate AS DATE) AS a, CAST(l_shipdate AS DATE) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT rule, CAST(h AS DATE) AS h, CAST(count(*) AS BIGINT) AS waiting FROM hol JOIN p ON h BETWEEN a AND b GROUP BY 1, 2""")
def interval_open_on_holidays(spark, sf):
    """Order lines that wait for shipment on each holiday."""
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    periods = joined.select(F.to_date("o_orderdate").alias("ordered"), F.to_date("l_shipdate").alias("shipped"))
    return overtime.within(holidays(spark, sf), periods, "h", "ordered", "shipped", 30).groupBy("rule", "h").agg(F.count(F.lit(1)).alias("waiting"))


@query(f"""WITH {PANEL}, by_day AS (SELECT d, sum(buy) AS hits, count(*) AS seen FROM panel GROUP BY d),
prior AS (SELECT d, coalesce(sum(hits) OVER w / CAST(sum(seen) OVER w AS DOUBLE), 0) AS p FROM by_day WINDOW w AS (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT item_id, d, coalesce(sum(buy) OVER {BEFORE}, 0) AS own, count(*) OVER {BEFORE} AS times FROM panel)
SELECT item_id, d, round((own + 10 * p) / (times + 10), 6) AS item_rate FROM o JOIN prior USING (d)""")
def item_rate_so_far(spark, sf):
    return learn.with_item_rate(ev_panel(spark, sf), "buy").select("item_id", "d", r6(F.col("item_rate"), "item_rate"))


_FEATURES = ["since", "avg_gap", "n_so_far"]


def _scaled(spark, sf):
    """Features of the panel between 0 and 1."""
    known = feats(spark, sf)
    return known.select("item_id", "d", "buy", *((F.col(c) / (F.col(c) + 5.0)).alias(c) for c in _FEATURES))


@query()
def embedding_scores(spark, sf):
    """Chances of a purchase by items' embeddings and features, trained on the earlier dates."""
    rows = _scaled(spark, sf)
    train, _ = learn.split_by_time(rows)
    model = embedding.train(train, _FEATURES, "buy", dim=4, hidden=(8,), batches=2, rounds=3, rate=0.05)
    return embedding.scores(model, rows, ["item_id", "d", "buy"])


@query()
def next_basket_of_each_item(spark, sf):
    """A model for every item, all fitted together; one row for each item."""
    rows = _scaled(spark, sf)
    weights = learn.fit_each_item(rows, _FEATURES, "buy", steps=8)
    return learn.next_basket(rows, weights, _FEATURES)


@query(f"""WITH {PE}, n AS (SELECT item_id, row_number() OVER (ORDER BY CAST(item_id AS VARCHAR)) - 1 AS i FROM (SELECT DISTINCT item_id FROM pe)), t AS (SELECT DISTINCT source, i FROM pe JOIN n USING (item_id))
SELECT source, CAST(count(*) AS BIGINT) AS size, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS held FROM t GROUP BY source""")
def trip_items_sparse(spark, sf):
    """Each trip's items as the places of a one-hot vector over all items."""
    bought = pe(spark, sf).select("source", F.array(F.col("item_id").cast("string")).alias("items"))
    vocabulary = lookups.index_of(bought, "items")
    flags = lookups.sparse_flags(bought, "source", "items", vocabulary)
    return flags.select("source", F.size("held").cast("long").alias("size"), F.array_join(F.transform("held", lambda x: x.cast("string")), ",").alias("held"))


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS source, 'Ann ' || (l_orderkey % 7) AS manager, CAST(CASE l_partkey % 3 WHEN 2 THEN 1 ELSE l_quantity END AS INTEGER) AS qty,
  CASE l_partkey % 3 WHEN 0 THEN 'part-' || l_partkey WHEN 1 THEN 'caf-1-' || l_partkey ELSE 'salt-and-pepper-' || l_partkey END AS item, round(l_extendedprice, 2) AS reg, round(l_extendedprice * 2, 2) AS paid
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def receipt_items(spark, sf):
    """Orders written as receipt texts with coupons, misread quantities and letters in odd Unicode forms, parsed back to items."""
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    kind, qty, part = F.col("l_partkey") % 3, F.col("l_quantity").cast("int").cast("string"), F.col("l_partkey").cast("string")
    # An accent that stands apart, a wide digit, and spaces of other kinds.
    name = F.when(kind == 0, F.concat(F.lit("QTY "), qty, F.lit("\u00a0 Part "), part)).when(kind == 1, F.concat(F.lit("qty-"), qty, F.lit(" Cafe\u0301 \uff11 "), part)).otherwise(F.concat(F.lit("Salt & Pepper "), part))
    price = lambda c: F.concat(F.lit(" $"), F.format_string("%.2f", F.round(c, 2)))
    line = F.concat(name, price(F.col("l_extendedprice")), price(F.col("l_extendedprice") * 2), F.lit(" B\nYou save $1.00 $1.00\nCPN SCANNED COUPON $2.00 $2.00"))
    bodies = lines.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"))
    text = F.concat(F.lit("Store Manager: Ann "), (F.col("l_orderkey") % 7).cast("string"), F.lit("\nReg You Pay\n"), "body")
    parsed = receipts.parse(bodies.select(F.col("l_orderkey").cast("string").alias("source"), text.alias("value")))
    return receipts.items_of(parsed, "source", "manager").select("source", "manager", "i.qty", "i.item", F.col("i.reg").alias("reg"), F.col("i.youPay").alias("paid"))


@query("""WITH s AS (SELECT c_mktsegment AS name, count(*) AS n, CAST(round(sum(c_acctbal * 100)) AS BIGINT) AS cents FROM customer GROUP BY 1), d AS (SELECT CAST(ts AS DATE) AS d, count(*) AS n, count(*) % 2 = 0 AS even FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT 'By <segment> & all' AS sheet, CAST(1 AS BIGINT) AS row, 'segment|customers|cents|none' AS cells UNION ALL SELECT 'days', 1, 'd|n|even'
UNION ALL SELECT 'By <segment> & all', 1 + row_number() OVER (ORDER BY name), name || chr(10) || '<&_x0041_>|' || n || '|' || cents || '|' FROM s
UNION ALL SELECT 'days', 1 + row_number() OVER (ORDER BY d), date_diff('day', DATE '1899-12-30', d) || '|' || n || '|' || CASE WHEN even THEN 1 ELSE 0 END FROM d""")
def workbook_read_again(spark, sf):
    """A report of two sheets, written as a workbook and read again cell by cell."""
    segments = table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum(F.col("c_acctbal") * 100)).cast("long").alias("cents"))
    segments = segments.orderBy("c_mktsegment").select(F.concat("c_mktsegment", F.lit("\n<&_x0041_>")).alias("segment"), "customers", "cents", F.lit(None).cast("string").alias("none"))
    days = table(spark, sf, "events").where("event_type = 'purchase'").groupBy(F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    path = f"{shared_path(spark, 'report')}.xlsx"
    workbook.write_workbook({"By <segment> & all": segments, "days": days.select("d", "n", (F.col("n") % 2 == 0).alias("even")).orderBy("d")}, path)
    cells = F.array_join(F.transform("cells", lambda x: F.coalesce(x, F.lit(""))), "|")
    return workbook.read_workbook(spark, path).select("sheet", F.col("row").cast("long").alias("row"), cells.alias("cells"))


_KINDS = ("click", "error", "purchase", "signup", "view")


@query(f"""WITH n AS (SELECT user_id, CAST(ts AS DATE) AS d, {", ".join(f"CAST(count(*) FILTER (event_type = '{k}') AS BIGINT) AS {k}" for k in _KINDS)} FROM events GROUP BY 1, 2)
SELECT user_id, d, concat_ws(',', {", ".join(f"CASE WHEN {k} > 0 THEN '{k}' END" for k in _KINDS)}) AS items, {" || ',' || ".join(f"'{k}=' || {k}" for k in _KINDS)} AS shown FROM n""")
def inspected_days(spark, sf):
    """Wide rows as one reads them: the flags that are set, by name, and the values beside them."""
    events = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("d"))
    wide = events.agg(*(F.count_if(F.col("event_type") == k).alias(f"n_{k}") for k in _KINDS), *(F.max((F.col("event_type") == k).cast("int")).alias(k) for k in _KINDS))
    seen = lookups.inspected(wide, ["user_id", "d"], list(_KINDS), [f"n_{k}" for k in _KINDS])
    shown = F.array_join(F.transform(F.map_entries("values"), lambda x: F.concat(F.substring(x["key"], 3, 100), F.lit("="), x["value"])), ",")
    return seen.select("user_id", "d", F.array_join("items", ",").alias("items"), shown.alias("shown"))


@query(f"WITH {PANEL} SELECT item_id, d, TRUE AS adds_up, CAST(3 AS BIGINT) AS features FROM panel")
def scores_explained(spark, sf):
    """Of every row of the panel, whether what its features add to the trees' score sums up to it."""
    columns = ["since", "avg_gap", "n_so_far"]
    rows = feats(spark, sf).select("item_id", "d", F.col("buy").cast("double").alias("label"), *(F.col(c).cast("double") for c in columns))
    rows = VectorAssembler(inputCols=columns, outputCol="features").transform(rows)
    model = learn.boosted_model(rows.select("features", "label"), trees=5, depth=4)
    scored = model.transform(rows).select("item_id", "d", "features", vector_to_array("rawPrediction")[1].alias("margin"))
    found = explain.with_contributions(scored, model)
    total = F.col("base") + F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x)
    return found.select("item_id", "d", (F.abs(total - F.col("margin")) < 1e-9).alias("adds_up"), F.size("contributions").cast("long").alias("features"))
