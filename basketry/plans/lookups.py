"""Queries of counts, dictionaries, first rows, wide reports, values in texts and model errors. Importing this adds them to QUERIES and ORACLE."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from basketry.functions import names as N
from basketry.operators import experiments, items, lookups, recency as R
from basketry.plans.queries import DICT, EV, GAPS, PANEL, PE, big, ev, feats, named_events, pe, query, r6, table
from basketry.sources import nested

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def value_counts(spark, sf):
    return lookups.value_counts(table(spark, sf, "events"), "event_type")


@query("SELECT o_custkey, o_orderpriority, o_orderdate, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) = 1")
def first_of_duplicates(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderdate", "o_orderkey")
    return lookups.first_rows(o, ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"])


@query(f"WITH {PE} SELECT CAST(count(DISTINCT item_id) AS BIGINT) AS items, CAST(count(DISTINCT source) AS BIGINT) AS trips, min(d) AS first_d, max(d) AS last_d FROM pe")
def distinct_counts(spark, sf):
    return pe(spark, sf).agg(F.count_distinct("item_id").alias("items"), F.count_distinct("source").alias("trips"), F.min("d").alias("first_d"), F.max("d").alias("last_d"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def trips_without_receipts(spark, sf):
    """Customers without an urgent order."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey", "c_name")


_OFF = "CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT)"


@query(f"SELECT l_orderkey, l_linenumber, {_OFF} AS off, CAST(sum({_OFF}) OVER (PARTITION BY l_orderkey) AS BIGINT) AS trip_off FROM lineitem")
def trip_discount(spark, sf):
    """Of each line and its trip, what is off in hundredths of a cent: whole numbers, so sums don't depend on their order."""
    off = F.round(F.col("l_extendedprice") * 100).cast("long") * F.round(F.col("l_discount") * 100).cast("long")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", off.alias("off"), F.sum(off).over(Window.partitionBy("l_orderkey")).alias("trip_off"))


@query(f"""WITH {DICT}, old AS (SELECT * FROM dict WHERE item_id % 2 = 0), fresh AS (SELECT DISTINCT item FROM named WHERE item NOT IN (SELECT item FROM old))
SELECT item, CAST(item_id AS BIGINT) AS item_id FROM old UNION ALL SELECT item, CAST((SELECT max(item_id) FROM old) + row_number() OVER (ORDER BY item) AS BIGINT) FROM fresh""")
def append_item_ids(spark, sf):
    named = named_events(spark, sf)
    return lookups.append_ids(items.item_ids(named).where("item_id % 2 = 0"), named)


@query(f"WITH {DICT}, old AS (SELECT * FROM dict WHERE item_id % 2 = 0) SELECT CAST(count(DISTINCT item_id) AS BIGINT) AS size, max(item_id) + 1 = count(DISTINCT item_id) AS contiguous FROM old")
def vocabulary_contiguity(spark, sf):
    return lookups.vocabulary_check(items.item_ids(named_events(spark, sf)).where("item_id % 2 = 0"))


@query(f"WITH {DICT}, old AS (SELECT * FROM dict WHERE item_id % 2 = 0) SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (old.item IS NULL) AS BIGINT) AS missing FROM named LEFT JOIN old USING (item)")
def null_after_mapping(spark, sf):
    named = named_events(spark, sf)
    return lookups.unmapped(named, items.item_ids(named).where("item_id % 2 = 0"))


@query(f"WITH {EV}, h AS (SELECT item_id, CAST(count(*) AS DOUBLE) AS habit FROM ev GROUP BY 1) SELECT c_custkey AS item_id, coalesce(habit, 0) AS habit FROM customer LEFT JOIN h ON c_custkey = item_id")
def habit_join_filled(spark, sf):
    habit = ev(spark, sf).groupBy("item_id").agg(F.count(F.lit(1)).cast("double").alias("habit"))
    return lookups.join_filled(table(spark, sf, "customer").select(F.col("c_custkey").alias("item_id")), habit, "item_id")


_SINCE = ", ".join(f"CAST(coalesce(date_diff('day', max(CASE WHEN item = '{p}' THEN d END) OVER w, d), 0) AS BIGINT) AS \"since_{p}\"" for p in PRIORITIES)


@query(f"""WITH b AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, o_orderpriority AS item FROM orders),
x AS (SELECT d, {_SINCE} FROM b WINDOW w AS (ORDER BY d RANGE UNBOUNDED PRECEDING)) SELECT DISTINCT * FROM x""")
def days_since_wide(spark, sf):
    bought = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d"), F.col("o_orderpriority").alias("item")).distinct()
    return lookups.days_since_wide(bought, PRIORITIES)


_DATES = [f"2024-01-{x}" for x in range(20, 25)]


@query(
    f"""WITH {GAPS}, r AS (SELECT item_id, d, round(least(3.0, CASE WHEN avg_gap = 0 THEN 0.0 ELSE since / avg_gap END), 6) AS due FROM feats),
k AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY due DESC, item_id) AS rank FROM r WHERE d BETWEEN '{_DATES[0]}' AND '{_DATES[-1]}')
SELECT CAST(rank AS BIGINT) AS rank, """
    + ", ".join(f"max(CASE WHEN d = '{x}' THEN item_id END) AS \"{x}\"" for x in _DATES)
    + " FROM k WHERE rank <= 50 GROUP BY rank"
)
def topk_side_by_side(spark, sf):
    """The 50 items most due on each of five dates, a column for each; a top-k report."""
    due = feats(spark, sf).select("item_id", F.col("d").cast("string").alias("d"), r6(R.due_ratio(F.col("since"), F.col("avg_gap")), "due")).where(F.col("d").between(_DATES[0], _DATES[-1]))
    ranked = due.withColumn("rank", big(F.row_number().over(Window.partitionBy("d").orderBy(F.desc("due"), "item_id")), "rank")).where("rank <= 50")
    return lookups.side_by_side(ranked, "d", _DATES, "item_id")


@query("SELECT c_custkey, round(c_acctbal, 2) AS money, CAST(c_nationkey AS BIGINT) AS n FROM customer")
def money_and_number_parse(spark, sf):
    text = F.concat(F.lit("$"), F.format_number("c_acctbal", 2))
    count = F.concat(F.col("c_nationkey").cast("string"), F.lit(" Items"))
    return table(spark, sf, "customer").select("c_custkey", lookups.money(text).alias("money"), big(lookups.first_number(count), "n"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) + INTERVAL 21 HOUR + INTERVAL 9 MINUTE AS at FROM orders")
def date_time_parse(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", lookups.at_time(F.date_format("o_orderdate", "M/d/yyyy"), F.lit("9:09 PM")).cast("timestamp_ntz").alias("at"))


_T = "p_name || ' #' || p_brand || ' & ' || p_type"


@query(f"SELECT p_partkey, trim(regexp_replace(regexp_replace(lower({_T}), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS key, replace(lower(p_type), ' ', '_') AS slug FROM part")
def cache_key_and_slug(spark, sf):
    text = F.concat("p_name", F.lit(" #"), "p_brand", F.lit(" & "), "p_type")
    return table(spark, sf, "part").select("p_partkey", N.cache_key(text).alias("key"), nested.slug(F.col("p_type")).alias("slug"))


@query("SELECT p_partkey, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'house' ELSE p_brand END AS by_name, CASE WHEN regexp_matches(p_name, '^(red|blue)') THEN 'colour' ELSE p_name END AS by_pattern, regexp_replace('a-seg-' || p_name, '-seg-', '-') AS without FROM part")
def labels_by_name_and_pattern(spark, sf):
    by_name = F.when(F.col("p_brand").isin("Brand#1", "Brand#2"), "house").otherwise(F.col("p_brand"))
    by_pattern = N.canonicalize_by_pattern(F.col("p_name"), [("colour", ["^red", "^blue"])])
    return table(spark, sf, "part").select("p_partkey", by_name.alias("by_name"), by_pattern.alias("by_pattern"), F.regexp_replace(F.concat(F.lit("a-seg-"), "p_name"), "-seg-", "-").alias("without"))


@query("SELECT event_id, round((value - 32) * 5 / 9, 6) AS celsius FROM events")
def fahrenheit_to_celsius(spark, sf):
    return table(spark, sf, "events").select("event_id", r6(nested.to_celsius(F.col("value")), "celsius"))


@query(f"WITH {EV} SELECT item_id, CAST(date_diff('day', max(d), DATE '2024-02-05') AS BIGINT) AS since FROM ev GROUP BY 1")
def days_since_last_at(spark, sf):
    return ev(spark, sf).groupBy("item_id").agg(big(F.datediff(F.lit("2024-02-05").cast("date"), F.max("d")), "since"))


@query(f"WITH {PANEL} SELECT item_id, d, qty FROM panel EXCEPT SELECT item_id, d, qty FROM panel WHERE buy = 1")
def rows_not_bought(spark, sf):
    from basketry.plans.queries import ev_panel

    p = ev_panel(spark, sf)
    bought = p.where("buy = 1").select("item_id", "d")
    return p.select("item_id", "d", "qty").join(bought, ["item_id", "d"], "left_anti")


@query(
    f"""WITH {GAPS}, s AS (SELECT buy, least(3.0, CASE WHEN avg_gap = 0 THEN 0.0 ELSE since / avg_gap END) / 3 AS p FROM feats), c AS (SELECT *, least(greatest(p, 1e-7), 1 - 1e-7) AS q FROM s)
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(abs(p - buy)), 6) AS mae, round(avg((p - buy) * (p - buy)), 6) AS mse, round(avg(-(buy * ln(q) + (1 - buy) * ln(1 - q))), 6) AS log_loss FROM c"""
)
def model_errors(spark, sf):
    scored = feats(spark, sf).select("buy", (R.due_ratio(F.col("since"), F.col("avg_gap")) / 3).alias("p"))
    return experiments.errors(scored, "p", "buy").select("n", *(r6(F.col(c), c) for c in ("mae", "mse", "log_loss")))


def learnable(spark, sf):
    return feats(spark, sf).select("item_id", "d", "buy", F.col("since").cast("double"), "avg_gap", F.col("n_so_far").cast("double"))


@query()
def perceptron_next_trip(spark, sf):
    from basketry.operators import learn

    return learn.next_trip(learn.perceptron_scores(learnable(spark, sf), ["since", "avg_gap", "n_so_far"], "buy", steps=20))


@query()
def gain_importance(spark, sf):
    from basketry.operators import learn

    return learn.gain_importance(learnable(spark, sf), ["since", "avg_gap", "n_so_far"], "buy")


@query()
def parameter_search(spark, sf):
    """Areas under the curve of six sets of parameters."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=["since", "avg_gap", "n_so_far"], outputCol="features").transform(learnable(spark, sf)).select("features", F.col("buy").cast("double").alias("label"))
    return experiments.search(rows, LogisticRegression(maxIter=20), experiments.grid(regParam=[0.0, 0.01, 0.1], elasticNetParam=[0.0, 1.0]))[1]


_SS, _SE = "make_date(year(d), 8, 15)", "make_date(year(d), 5, 31)"
_START = f"date_diff('day', d, CASE WHEN d <= {_SS} THEN {_SS} ELSE make_date(year(d) + 1, 8, 15) END)"
_END = f"date_diff('day', d, CASE WHEN d <= {_SE} THEN {_SE} ELSE make_date(year(d) + 1, 5, 31) END)"
# In January there is no daylight saving, and all purchases of the table are in January.
_DATE_SQL = f"""CAST({_START} AS BIGINT) AS "daysUntilSchoolStart_raw", ln(1 + {_START}) AS "daysUntilSchoolStart_log_feat", CAST({_END} AS BIGINT) AS "daysUntilSchoolEnd_raw", ln(1 + {_END}) AS "daysUntilSchoolEnd_log_feat",
 CASE WHEN d > {_SE} THEN date_diff('day', {_SE}, d) / 365.0 ELSE -date_diff('day', d, {_SS}) / 365.0 END AS "schoolSeasonIndex_feat", 0 AS "isDayLightSavingsTime_feat", year(d) AS year_feat, month(d) AS month_cyc_feat, day(d) AS day_cyc_feat, isodow(d) - 1 AS dow_cyc_feat, dayofyear(d) AS doy_feat, quarter(d) AS quarter_feat"""
_INTS = ["didBuy_target", "daysSinceThisItemLastPurchased_raw", "itemPurchaseCount_raw", "daysUntilSchoolStart_raw", "daysUntilSchoolEnd_raw", "isDayLightSavingsTime_feat", "year_feat", "month_cyc_feat", "day_cyc_feat", "dow_cyc_feat", "doy_feat", "quarter_feat", "daysSinceLastTrip_raw"]
_REALS = ["daysSinceThisItemLastPurchased_log_feat", "itemSupplyLevel_feat", "item_due_ratio_feat", "avgDaysBetweenItemPurchases_feat", "expectedDaysBetweenPurchases_ewma_feat", "daysUntilSchoolStart_log_feat", "daysUntilSchoolEnd_log_feat", "schoolSeasonIndex_feat", "avgDaysBetweenTrips_feat", "temp_feat"]
_ITEM_SQL = f"""{GAPS}, x AS (SELECT *, list(CAST(gap AS DOUBLE)) FILTER (gap IS NOT NULL) OVER (PARTITION BY item_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS gs FROM feats),
 e AS (SELECT item_id, d, qty, buy, since, avg_gap, n_so_far, coalesce(CASE WHEN len(gs) > 0 THEN list_reduce(gs, lambda a, g: 0.3 * g + 0.7 * a) END, 0) AS ewma FROM x),
 w AS (SELECT CAST(ts AS DATE) AS d, avg(value) AS temp_feat FROM events GROUP BY 1), v AS (SELECT d, coalesce(date_diff('day', lag(d) OVER (ORDER BY d), d), 0) AS gap FROM dd),
 vv AS (SELECT d, gap, coalesce(avg(nullif(gap, 0)) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING), 0) AS avg_trip FROM v)"""


def _cast_sql(ints, reals) -> str:
    return ", ".join([f'CAST("{c}" AS BIGINT) AS "{c}"' for c in ints] + [f'round(CAST("{c}" AS DOUBLE), 6) AS "{c}"' for c in reals])


def _derived_sql(since: str, average: str) -> str:
    return f"""{since} AS "daysSinceThisItemLastPurchased_raw", ln(1 + {since}) AS "daysSinceThisItemLastPurchased_log_feat",
 greatest(0.0, least(1.0, 1 - CASE WHEN {average} > 0 THEN {since} / {average} ELSE 0 END)) AS "itemSupplyLevel_feat", least(3.0, CASE WHEN {average} = 0 THEN 0.0 ELSE {since} / {average} END) AS item_due_ratio_feat"""


def _typed(df, ints, reals, *keys):
    return df.select(*keys, *(big(F.col(c), c) for c in ints), *(r6(F.col(c), c) for c in reals))


def _weather(spark, sf):
    return table(spark, sf, "events").groupBy(F.to_date("ts").alias("d")).agg(F.avg("value").alias("temp_feat"))


@query(
    f"""WITH {_ITEM_SQL}, f AS (SELECT item_id, d, qty, buy AS "didBuy_target", {_derived_sql("since", "avg_gap")}, avg_gap AS "avgDaysBetweenItemPurchases_feat", ewma AS "expectedDaysBetweenPurchases_ewma_feat",
 n_so_far AS "itemPurchaseCount_raw", {_DATE_SQL}, vv.gap AS "daysSinceLastTrip_raw", avg_trip AS "avgDaysBetweenTrips_feat", temp_feat FROM e JOIN vv USING (d) LEFT JOIN w USING (d))
SELECT item_id, d, qty, {_cast_sql(_INTS, _REALS)} FROM f"""
)
def training_frame(spark, sf):
    """All features of the panel."""
    from basketry.plans import training

    return _typed(training.training_frame(ev(spark, sf), _weather(spark, sf)), _INTS, _REALS, "item_id", "d", "qty")


_AHEAD = [c for c in _INTS if c != "didBuy_target"]


@query(
    f"""WITH {_ITEM_SQL}, asked AS (SELECT CAST(unnest(['2024-01-30', '2024-01-31']) AS DATE) + 1 AS d), s AS (SELECT item_id, max(CASE WHEN buy = 1 THEN d END) AS last_d, max_by(avg_gap, d) AS avg_gap, max_by(ewma, d) AS ewma, max(n_so_far) AS n FROM e GROUP BY 1),
 t AS (SELECT max(d) AS last_trip, max_by(avg_trip, d) AS avg_trip FROM vv), p AS (SELECT item_id, asked.d, date_diff('day', last_d, asked.d) AS since, avg_gap, ewma, n, date_diff('day', last_trip, asked.d) AS trip, avg_trip FROM s, t, asked),
 f AS (SELECT item_id, d, {_derived_sql("since", "avg_gap")}, avg_gap AS "avgDaysBetweenItemPurchases_feat", ewma AS "expectedDaysBetweenPurchases_ewma_feat", n AS "itemPurchaseCount_raw", {_DATE_SQL}, trip AS "daysSinceLastTrip_raw", avg_trip AS "avgDaysBetweenTrips_feat", temp_feat FROM p LEFT JOIN w USING (d))
SELECT item_id, d, {_cast_sql(_AHEAD, _REALS)} FROM f"""
)
def prediction_frame(spark, sf):
    """The features of every item on two coming days."""
    from basketry.plans import training

    asked = spark.sql("SELECT explode(array(DATE'2024-01-31', DATE'2024-02-01')) AS d")
    return _typed(training.prediction_frame(ev(spark, sf), asked, _weather(spark, sf)), _AHEAD, _REALS, "item_id", "d")


@query(f"""WITH {EV}, t AS (SELECT count(DISTINCT d) AS trips, greatest(1, date_diff('day', min(d), max(d))) AS line, max(d) AS last_d FROM ev),
h AS (SELECT item_id, count(*) / trips AS f, date_diff('day', min(d), max(d)) / line AS s, exp(-date_diff('day', max(d), last_d) / 120.0) AS e FROM ev, t GROUP BY item_id, trips, line, last_d)
SELECT c_custkey AS item_id, round(coalesce(f, 0), 6) AS "habitFrequency", round(coalesce(s, 0), 6) AS "habitSpan", round(coalesce(e, 0), 6) AS "habitDecay" FROM customer LEFT JOIN h ON c_custkey = item_id""")
def habit_features_of_all(spark, sf):
    """Habits of every customer as an item, those never bought included."""
    from basketry.operators import habits

    every = table(spark, sf, "customer").select(F.col("c_custkey").alias("item_id"))
    return habits.habit_features(ev(spark, sf), every).select("item_id", *(r6(F.col(c), c) for c in ("habitFrequency", "habitSpan", "habitDecay")))


@query(f"WITH {GAPS} SELECT item_id, CAST(sum(buy) AS BIGINT) AS n FROM feats GROUP BY 1")
def total_purchases(spark, sf):
    from basketry.operators import habits

    return habits.total_purchases(feats(spark, sf)).select("item_id", big(F.col("n"), "n"))


@query(f"WITH {DICT}, old AS (SELECT * FROM dict WHERE item_id % 2 = 0) SELECT CAST(d.item_id AS BIGINT) AS item_id, coalesce(old.item, 'unknown') AS item FROM dict d LEFT JOIN old ON old.item_id = d.item_id")
def names_of_ids(spark, sf):
    """Ids back to names, where half of the dictionary is known."""
    ids = items.item_ids(named_events(spark, sf))
    return items.with_names(ids.select("item_id"), ids.where("item_id % 2 = 0"), unknown="unknown")


@query(f"WITH {DICT} SELECT item, CAST(count(*) AS BIGINT) AS rows FROM named JOIN dict USING (item) WHERE item_id % 2 = 1 GROUP BY 1")
def items_lost_in_mapping(spark, sf):
    named = named_events(spark, sf)
    return items.mapped_with_losses(named, items.item_ids(named).where("item_id % 2 = 0"))[1]


@query("SELECT o_custkey, " + ", ".join(f"CAST(max(CASE WHEN o_orderpriority = '{p}' THEN 1 ELSE 0 END) AS BIGINT) AS \"is_{p.lower().replace(' ', '_')}\"" for p in PRIORITIES) + " FROM orders GROUP BY 1")
def category_flags(spark, sf):
    """A flag of each priority that a customer's orders had."""
    held = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("had"))
    flags = lookups.category_flags(held, "o_custkey", "had")
    return flags.select("o_custkey", *(big(F.col(f"`{c}`"), c) for c in flags.columns if c != "o_custkey"))


@query(f"WITH {EV}, a AS (SELECT item_id, CAST(count(*) AS DOUBLE) AS gap FROM ev GROUP BY 1) SELECT item_id, CAST(DATE '2024-02-01' + CAST(floor(n * gap) AS INTEGER) AS DATE) AS d, CAST(1 AS BIGINT) AS buy FROM a, (SELECT unnest(range(5)) AS n)")
def synthetic_of_count(spark, sf):
    """Five purchases of each item at even gaps: the count-bounded variant, without chance."""
    from basketry.operators import panel

    gaps = ev(spark, sf).groupBy("item_id").agg(F.count(F.lit(1)).cast("double").alias("gap"))
    return panel.synthetic_purchases_of(gaps, "2024-02-01", 5, fuzz=0).select("item_id", "d", big(F.col("buy"), "buy"))


@query("SELECT vec_id, label, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 4) AS norm FROM embeddings QUALIFY row_number() OVER (ORDER BY round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 4) DESC, vec_id) <= 100")
def largest_embeddings(spark, sf):
    """The 100 longest vectors with their labels; a top-n report."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    normed = table(spark, sf, "embeddings").select("vec_id", "label", F.round(norm, 4).alias("norm"))
    return lookups.first_in_order(normed.withColumn("least", -F.col("norm")), 100, "least", "vec_id").drop("least")


@query()
def due_scores_ranked(spark, sf):
    """From history to ranked items: model and encoding fitted, every item scored and ranked on two coming days."""
    from basketry.plans import scoring, training

    days = ev(spark, sf)
    model, encoding = scoring.fit(training.training_frame(days, _weather(spark, sf)), trees=5)
    asked = spark.sql("SELECT explode(array(DATE'2024-01-31', DATE'2024-02-01')) AS d")
    return scoring.ranked(scoring.scores(model, encoding, days, asked, _weather(spark, sf)))
