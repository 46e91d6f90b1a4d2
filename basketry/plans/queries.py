"""One query for each operator over the tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketry.functions import calendar as C
from basketry.functions import names as N
from basketry.sources import nested
from basketry.operators import habits, items, normalize, panel, recency as R, trips

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c, name: str):
    return F.round(c.cast("double"), 6).alias(name)


def big(c, name: str):
    return c.cast("long").alias(name)


# Roles of the tables: purchases of users as items by day (EV), order lines as purchases (PE).
def ev(spark, sf) -> DataFrame:
    e = table(spark, sf, "events").where("event_type = 'purchase'")
    return panel.item_days(e.select(F.col("user_id").alias("item_id"), F.to_date("ts").alias("d"), F.lit(1).alias("qty")))


def ev_panel(spark, sf) -> DataFrame:
    return panel.negative_samples(ev(spark, sf))


def pe(spark, sf) -> DataFrame:
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    return joined.select(F.col("o_orderkey").alias("source"), F.to_date("o_orderdate").alias("d"), F.col("l_partkey").alias("item_id"), F.col("l_quantity").cast("long").alias("qty"))


def days(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()


EV = "ev AS (SELECT user_id AS item_id, CAST(ts AS DATE) AS d, CAST(count(*) AS BIGINT) AS qty FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)"
PANEL = f"""{EV}, fst AS (SELECT item_id, min(d) AS first_d FROM ev GROUP BY 1), dd AS (SELECT DISTINCT d FROM ev),
panel AS (SELECT f.item_id, dd.d, ev.qty, CASE WHEN ev.qty IS NULL THEN 0 ELSE 1 END AS buy,
  CASE WHEN ev.qty IS NULL THEN '_neg_sample_' ELSE 'event' END AS source
  FROM fst f JOIN dd ON dd.d >= f.first_d LEFT JOIN ev ON ev.item_id = f.item_id AND ev.d = dd.d)"""
SO_FAR = "(PARTITION BY item_id ORDER BY d ROWS UNBOUNDED PRECEDING)"
BEFORE = "(PARTITION BY item_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
GAPS = f"""{PANEL}, g AS (SELECT *, max(CASE WHEN buy = 1 THEN d END) OVER {BEFORE} AS prev, max(CASE WHEN buy = 1 THEN d END) OVER {SO_FAR} AS incl FROM panel),
gaps AS (SELECT *, CASE WHEN buy = 1 THEN date_diff('day', prev, d) END AS gap FROM g),
feats AS (SELECT *, coalesce(date_diff('day', prev, d), 0) AS since, coalesce(avg(gap) OVER {SO_FAR}, 0) AS avg_gap,
  sum(buy) OVER {SO_FAR} AS n_so_far FROM gaps)"""
PE = "pe AS (SELECT o_orderkey AS source, CAST(o_orderdate AS DATE) AS d, l_partkey AS item_id, CAST(l_quantity AS BIGINT) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
DAYS = "days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)"


def feats(spark, sf) -> DataFrame:
    g = R.with_gaps(ev_panel(spark, sf))
    return g.select("*", R.days_since_exclusive().alias("since"), R.average_gap().alias("avg_gap"), R.purchases_so_far().alias("n_so_far"))


@query(f"""WITH {GAPS}, l AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY d DESC) AS rn FROM feats),
s AS (SELECT item_id, d, CAST(since AS BIGINT) AS since, round(least(3.0, greatest(0.0, CASE WHEN avg_gap = 0 THEN 0 ELSE since / avg_gap END)), 6) AS due FROM l WHERE rn = 1),
r AS (SELECT *, row_number() OVER (ORDER BY due DESC, item_id) AS rank FROM s) SELECT item_id, d, since, due, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 50""")
def due_items_topk(spark, sf):
    """Items by how overdue they are; a top-k report."""
    last = R.latest(feats(spark, sf)).select("item_id", "d", big(F.col("since"), "since"), r6(R.due_ratio(F.col("since"), F.col("avg_gap")), "due"))
    top = last.orderBy(F.desc("due"), "item_id").limit(50)
    return top.select("*", big(F.row_number().over(Window.orderBy(F.desc("due"), "item_id")), "rank"))


@query(f"WITH {PE} SELECT * FROM pe")
def purchase_events(spark, sf):
    return pe(spark, sf)


NAME = "'  ' || p_brand || ' & ' || p_name || ' 2.5 LB/12ct ' || CAST(p_size AS VARCHAR) || ' caf' || chr(233)"


@query(f"""WITH a AS (SELECT p_partkey, replace(strip_accents(lower({NAME})), '&', ' and ') AS s FROM part),
b AS (SELECT p_partkey, regexp_replace(regexp_replace(s, '[^\\w\\s]', ' ', 'g'), '[_/]', ' ', 'g') AS s FROM a),
c AS (SELECT p_partkey, regexp_replace(regexp_replace(s, '\\b(\\d+(\\.\\d+)?\\s?(oz|ounce|fl|lb|lbs|ct|count|pk|pack|ml|g|kg|gallon|half-gallon|l))\\b', ' ', 'g'), '\\b\\d+\\b', ' ', 'g') AS s FROM b)
SELECT p_partkey, replace(trim(regexp_replace(s, '\\s+', ' ', 'g')), ' ', '-') AS name FROM c""")
def clean_item_name(spark, sf):
    p = table(spark, sf, "part")
    raw = F.concat(F.lit("  "), "p_brand", F.lit(" & "), "p_name", F.lit(" 2.5 LB/12ct "), F.col("p_size").cast("string"), F.lit(" café"))
    return p.select("p_partkey", N.clean_item_name(raw).alias("name"))


@query("""WITH a AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'SEG-' WHEN 1 THEN 'kandl--' WHEN 2 THEN 'great-value-great-value-' ELSE '' END || p_name AS s FROM part)
SELECT p_partkey, regexp_replace(trim(regexp_replace(s, '^(parent-s-choice-|know-and-love-|member-s-mark-|sam-s-choice-|great-value-|se-grocers-|marketside-|kirkland-|walmart-|equate-|kand1|kandl|seg-|kgl-|gv-|wr-)', '', 'i')), '^-+', '') AS name FROM a""")
def strip_brand_prefix(spark, sf):
    p = table(spark, sf, "part")
    prefix = F.element_at(F.array(*map(F.lit, ["SEG-", "kandl--", "great-value-great-value-", ""])), (F.col("p_size") % 4 + 1).cast("int"))
    return p.select("p_partkey", N.strip_prefixes(F.concat(prefix, "p_name")).alias("name"))


def _canonical_sql() -> str:
    words = "CASE p_size % 8 WHEN 0 THEN 'pork-ribs' WHEN 1 THEN 'chocolate-bar' WHEN 2 THEN 'ice-cream' WHEN 3 THEN 'KL-Milk' WHEN 4 THEN 'tyson' WHEN 5 THEN 'white-bread' WHEN 6 THEN 'foil' ELSE p_name END"
    ctes = [f"c0 AS MATERIALIZED (SELECT p_partkey, {words} AS s FROM part)"]
    for i, (name, patterns) in enumerate(N.CANONICAL_RULES, 1):
        any_of = " OR ".join(f"contains(lower(s), '{p.lower()}')" for p in patterns)
        ctes.append(f"c{i} AS MATERIALIZED (SELECT p_partkey, CASE WHEN {any_of} THEN '{name}' ELSE s END AS s FROM c{i - 1})")
    return f"WITH {', '.join(ctes)} SELECT p_partkey, s AS name FROM c{len(N.CANONICAL_RULES)}"


@query(_canonical_sql())
def canonicalize_chain(spark, sf):
    p = table(spark, sf, "part")
    words = ["pork-ribs", "chocolate-bar", "ice-cream", "KL-Milk", "tyson", "white-bread", "foil"]
    raw = F.when(F.col("p_size") % 8 == 7, F.col("p_name")).otherwise(F.element_at(F.array(*map(F.lit, words)), F.least(F.col("p_size") % 8 + 1, F.lit(7)).cast("int")))
    named = p.select("p_partkey", raw.alias("raw"))
    distinct = named.select("raw").distinct().select("raw", N.canonicalize(F.col("raw")).alias("name"))
    return named.join(distinct, "raw").select("p_partkey", "name")


@query("SELECT p_partkey, p_name FROM part WHERE NOT (contains(lower(p_name), 'red') OR contains(lower(p_name), 'gizmo'))")
def exclude_terms(spark, sf):
    return table(spark, sf, "part").where(~N.contains_any(F.col("p_name"), ["red", "gizmo"])).select("p_partkey", "p_name")


@query("WITH a AS (SELECT p_partkey, CASE WHEN p_size % 5 > 0 THEN p_name END AS name FROM part) SELECT * FROM a WHERE NOT coalesce(contains(lower(name), 'blue'), false)")
def not_contains_keep_null(spark, sf):
    a = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 5 > 0, F.col("p_name")).alias("name"))
    return a.where(N.lacks_all(F.col("name"), ("blue",)))


def named_events(spark, sf):
    p = table(spark, sf, "part")
    return pe(spark, sf).join(p, F.col("item_id") == p["p_partkey"]).select("source", "d", F.concat_ws("-", "p_name", "p_size").alias("item"), "qty")


NAMED = f"{PE}, named AS (SELECT source, d, p_name || '-' || CAST(p_size AS VARCHAR) AS item, qty FROM pe JOIN part ON item_id = p_partkey)"
DICT = f"{NAMED}, dict AS (SELECT item, row_number() OVER (ORDER BY min(d), item) - 1 AS item_id FROM named GROUP BY item)"


@query(f"WITH {DICT} SELECT item, CAST(item_id AS BIGINT) AS item_id FROM dict")
def item_id_dictionary(spark, sf):
    return items.item_ids(named_events(spark, sf))


@query(f"WITH {DICT} SELECT CAST(item_id AS BIGINT) AS item_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(qty) AS BIGINT) AS qty FROM named JOIN dict USING (item) WHERE item_id % 2 = 0 GROUP BY 1")
def map_existing_ids_drop_unseen(spark, sf):
    e = named_events(spark, sf)
    known = items.item_ids(e).where("item_id % 2 = 0")
    return items.map_known(e, known).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("qty"))


@query(f"WITH {DICT} SELECT DISTINCT item FROM named WHERE item NOT IN (SELECT item FROM dict WHERE item_id % 2 = 0)")
def unseen_items_anti(spark, sf):
    e = named_events(spark, sf)
    return items.unseen(e, items.item_ids(e).where("item_id % 2 = 0"))


@query(f"WITH {PANEL} SELECT item_id, d, qty, CAST(buy AS BIGINT) AS buy, source FROM panel")
def negative_samples(spark, sf):
    return ev_panel(spark, sf).select("item_id", "d", "qty", big(F.col("buy"), "buy"), "source")


@query(f"""WITH {EV}, cal AS (SELECT CAST(unnest(generate_series(max(d) - INTERVAL 44 DAY, max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM ev)
SELECT i.item_id, cal.d, ev.qty, CAST(CASE WHEN ev.qty IS NULL THEN 0 ELSE 1 END AS BIGINT) AS buy FROM (SELECT DISTINCT item_id FROM ev) i CROSS JOIN cal LEFT JOIN ev ON ev.item_id = i.item_id AND ev.d = cal.d""")
def full_calendar(spark, sf):
    return panel.full_calendar(ev(spark, sf), 45).select("item_id", "d", "qty", big(F.col("buy"), "buy"))


@query(f"WITH {EV} SELECT a.item_id, b.d FROM (SELECT DISTINCT item_id FROM ev) a CROSS JOIN (SELECT DISTINCT d FROM ev) b")
def cross_grid(spark, sf):
    return panel.cross_grid(ev(spark, sf))


@query(f"WITH {EV}, {PE} SELECT source, d, item_id, qty FROM pe UNION ALL SELECT CAST(NULL AS BIGINT), d, item_id, qty FROM ev")
def union_sources(spark, sf):
    return panel.union_sources(pe(spark, sf), ev(spark, sf)).select("source", "d", "item_id", "qty")


@query(f"WITH {PE} SELECT item_id, min(d) AS first_d FROM pe GROUP BY 1")
def first_purchase(spark, sf):
    return pe(spark, sf).groupBy("item_id").agg(F.min("d").alias("first_d"))


@query(f"WITH {PE} SELECT item_id, d, CAST(count(*) AS BIGINT) AS n FROM pe GROUP BY 1, 2")
def daily_item_counts(spark, sf):
    return pe(spark, sf).groupBy("item_id", "d").agg(F.count(F.lit(1)).alias("n"))


def _feature(name: str, sql: str, column, extra: str = ""):
    """A feature of the panel as a query of its own."""

    def run(spark, sf):
        return feats(spark, sf).select("item_id", "d", column().alias(name))

    run.__name__ = name
    query(f"WITH {GAPS}{extra} SELECT item_id, d, {sql} AS {name} FROM {'x' if extra else 'feats'}")(run)


def L(c):  # noqa: N802
    return c.cast("long")


def D(c):  # noqa: N802
    return F.round(c.cast("double"), 6)


_feature("days_since_last_exclusive", "CAST(since AS BIGINT)", lambda: L(F.col("since")))
_feature("days_since_last_inclusive", "CAST(coalesce(date_diff('day', incl, d), 0) AS BIGINT)", lambda: L(R.days_since_inclusive()))
_feature("days_since_sentinel999", "CAST(coalesce(date_diff('day', prev, d), 999) AS BIGINT)", lambda: L(R.days_since_exclusive(999)))
_feature("avg_gap_expanding", "round(CAST(avg_gap AS DOUBLE), 6)", lambda: D(F.col("avg_gap")))
_feature("cumulative_count", "CAST(n_so_far AS BIGINT)", lambda: L(F.col("n_so_far")))
_feature("supply_level", "round(greatest(0.0, least(1.0, 1 - CASE WHEN avg_gap > 0 THEN since / avg_gap ELSE 0 END)), 6)", lambda: D(R.supply_level(F.col("since"), F.col("avg_gap"))))
_feature("due_ratio", "round(least(3.0, greatest(0.0, CASE WHEN avg_gap = 0 THEN 0.0 ELSE since / avg_gap END)), 6)", lambda: D(R.due_ratio(F.col("since"), F.col("avg_gap"))))
_feature("recency_penalty", "round(exp(-CASE WHEN avg_gap = 0 THEN 0.0 ELSE since / avg_gap END), 6)", lambda: D(F.exp(-R.ratio(F.col("since"), F.col("avg_gap")))))
_feature("bulk_urgency", "round(CASE WHEN avg_gap = 0 OR n_so_far = 0 THEN 0.0 ELSE since / (avg_gap * CASE WHEN item_id % 3 = 0 THEN 2.5 ELSE 1.0 END) END, 6)", lambda: D(F.when(F.col("n_so_far") == 0, 0.0).otherwise(R.ratio(F.col("since"), F.col("avg_gap") * F.when(F.col("item_id") % 3 == 0, 2.5).otherwise(1.0)))))
_feature("log_feature", "round(ln(1 + greatest(CAST(since AS DOUBLE), 0)), 6)", lambda: D(R.log_feature(F.col("since"))))
_feature("rolling_freq_exclusive", "CAST(v AS BIGINT)", lambda: R.frequency(7, exclusive=True), ", x AS (SELECT *, coalesce(sum(buy) OVER (PARTITION BY item_id ORDER BY d RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 0) AS v FROM feats)")
_feature("ffill_state", "v", lambda: F.last("qty", ignorenulls=True).over(R.so_far()), f", x AS (SELECT *, last_value(qty IGNORE NULLS) OVER {SO_FAR} AS v FROM feats)")


@query(f"""WITH {GAPS}, x AS (SELECT *, list(CAST(gap AS DOUBLE)) FILTER (gap IS NOT NULL) OVER {SO_FAR} AS gs FROM gaps)
SELECT item_id, d, round(coalesce(CASE WHEN len(gs) > 0 THEN list_reduce(gs, lambda a, g: 0.3 * g + 0.7 * a) END, 0), 6) AS ewma FROM x""")
def ewma_gap(spark, sf):
    return R.with_ewma_gap(R.with_gaps(ev_panel(spark, sf))).select("item_id", "d", r6(F.col("ewma"), "ewma"))


_F = ", ".join(f"CAST(sum(buy) OVER (PARTITION BY item_id ORDER BY d RANGE BETWEEN INTERVAL {w} DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS freq_{w}" for w in (7, 15, 30, 90, 365))


@query(f"WITH {PANEL} SELECT item_id, d, {_F} FROM panel")
def freq_7_15_30_90_365(spark, sf):
    return ev_panel(spark, sf).select("item_id", "d", *(R.frequency(w).alias(f"freq_{w}") for w in (7, 15, 30, 90, 365)))


@query(f"WITH {PANEL}, f AS (SELECT item_id, d, {_F} FROM panel) SELECT item_id, d, round(freq_7 / (freq_30 + 1e-6), 6) AS r7_30, round(freq_30 / (freq_365 + 1e-6), 6) AS r30_365 FROM f")
def freq_ratios(spark, sf):
    f = freq_7_15_30_90_365(spark, sf)
    return f.select("item_id", "d", r6(F.col("freq_7") / (F.col("freq_30") + 1e-6), "r7_30"), r6(F.col("freq_30") / (F.col("freq_365") + 1e-6), "r30_365"))


_DUE = f"WITH {GAPS}, f AS (SELECT *, {_F} FROM feats), s AS (SELECT item_id, d, 1.5 * since + 1.0 * freq_30 + 0.5 * freq_90 AS raw FROM f)"


def due_raw(spark, sf):
    f = feats(spark, sf)
    return f.select("item_id", "d", (1.5 * F.col("since") + 1.0 * R.frequency(30) + 0.5 * R.frequency(90)).alias("raw"))


@query(f"{_DUE} SELECT item_id, d, round(1 / (1 + exp(-raw)), 6) AS due FROM s")
def due_score_sigmoid(spark, sf):
    return due_raw(spark, sf).select("item_id", "d", r6(1 / (1 + F.exp(-F.col("raw"))), "due"))


@query(f"{_DUE}, t AS (SELECT avg(raw) AS m, stddev_samp(raw) AS sd FROM s) SELECT item_id, d, round((raw - m) / sd, 6) AS due FROM s, t")
def due_score_znorm(spark, sf):
    raw = due_raw(spark, sf)
    return normalize.apply(raw, normalize.fit(raw, ["raw"])).select("item_id", "d", r6(F.col("raw_norm"), "due"))


@query(f"WITH {EV} SELECT item_id, d, CAST(coalesce(date_diff('day', lag(d) OVER (PARTITION BY item_id ORDER BY d), d), 999) AS BIGINT) AS gap FROM ev")
def naive_lag_gap(spark, sf):
    return ev(spark, sf).select("item_id", "d", big(F.coalesce(F.datediff("d", F.lag("d").over(Window.partitionBy("item_id").orderBy("d"))), F.lit(999)), "gap"))


@query(f"WITH {PE} SELECT item_id, CAST(count(*) AS BIGINT) AS n FROM pe GROUP BY 1")
def total_count(spark, sf):
    return pe(spark, sf).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {GAPS} SELECT item_id, d, CAST(n_so_far AS BIGINT) AS n FROM feats WHERE n_so_far <> 1")
def drop_rare_cumulative(spark, sf):
    return feats(spark, sf).where("n_so_far != 1").select("item_id", "d", big(F.col("n_so_far"), "n"))


@query(f"WITH {PE}, c AS (SELECT item_id, count(*) AS n FROM pe GROUP BY 1) SELECT pe.item_id, d, source FROM pe JOIN c USING (item_id) WHERE n <> 30")
def drop_rare_total(spark, sf):
    e = pe(spark, sf)
    n = e.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).where("n != 30")
    return e.join(n, "item_id", "left_semi").select("item_id", "d", "source")


@query(f"WITH {GAPS}, f AS (SELECT *, {_F} FROM feats) SELECT item_id, d FROM f WHERE NOT (n_so_far = 1 AND freq_7 = 0)")
def drop_rare_zero_freq(spark, sf):
    return feats(spark, sf).withColumn("f", R.frequency(7)).where("NOT (n_so_far = 1 AND f = 0)").select("item_id", "d")


@query(f"WITH {EV}, s AS (SELECT date_diff('day', min(d), max(d)) + 1 AS span FROM ev) SELECT item_id, w, round(count(*) / span * w, 6) AS per_window FROM ev, s, (SELECT unnest([14, 30, 90, 365]) AS w) GROUP BY item_id, span, w")
def purchases_per_window(spark, sf):
    e = ev(spark, sf)
    span = e.agg((F.datediff(F.max("d"), F.min("d")) + 1).alias("span"))
    n = e.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(span))
    return n.select("item_id", "n", "span", F.explode(F.array(*map(F.lit, (14, 30, 90, 365)))).alias("w")).select("item_id", "w", r6(F.col("n") / F.col("span") * F.col("w"), "per_window"))


@query(f"WITH {EV}, s AS (SELECT date_diff('day', min(d), DATE '2024-02-01') AS span FROM ev) SELECT item_id, round(count(*) / span, 6) AS habit FROM ev, s GROUP BY item_id, span")
def habit_frequency(spark, sf):
    e = ev(spark, sf)
    span = e.agg(F.datediff(F.lit("2024-02-01").cast("date"), F.min("d")).alias("span")).where("span > 0")
    return e.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(span)).select("item_id", r6(F.col("n") / F.col("span"), "habit"))


@query(f"""WITH {EV}, t AS (SELECT count(DISTINCT d) AS trips, greatest(1, date_diff('day', min(d), max(d))) AS line, max(d) AS last_d FROM ev)
SELECT item_id, round(count(*) / trips, 6) AS habit_frequency, round(date_diff('day', min(d), max(d)) / line, 6) AS habit_span, round(exp(-date_diff('day', max(d), last_d) / 120.0), 6) AS habit_decay FROM ev, t GROUP BY item_id, trips, line, last_d""")
def habit_features(spark, sf):
    h = habits.habit_features(ev(spark, sf))
    return h.select("item_id", r6(F.col("habitFrequency"), "habit_frequency"), r6(F.col("habitSpan"), "habit_span"), r6(F.col("habitDecay"), "habit_decay"))


_TRIPS = f"WITH {DAYS}, g AS (SELECT d, coalesce(date_diff('day', lag(d) OVER (ORDER BY d), d), 0) AS gap FROM days), t AS (SELECT *, coalesce(avg(nullif(gap, 0)) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING), 0) AS avg_gap FROM g)"


@query(f"{_TRIPS} SELECT d, CAST(gap AS BIGINT) AS gap FROM t")
def trip_gaps(spark, sf):
    return trips.trip_gaps(days(spark, sf)).select("d", big(F.col("gap"), "gap"))


@query(f"{_TRIPS} SELECT d, round(CAST(avg_gap AS DOUBLE), 6) AS avg_gap FROM t")
def avg_trip_gap(spark, sf):
    return trips.trip_gaps(days(spark, sf)).select("d", r6(F.col("avg_gap"), "avg_gap"))


@query(f"{_TRIPS} SELECT d, round(CASE WHEN avg_gap = 0 THEN 0.0 ELSE gap / avg_gap END, 6) AS due FROM t")
def trip_due_ratio(spark, sf):
    return trips.trip_gaps(days(spark, sf)).select("d", r6(R.ratio(F.col("gap"), F.col("avg_gap")), "due"))


@query(f"WITH {GAPS}, l AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY d DESC) AS rn FROM feats) SELECT item_id, d, CAST(n_so_far AS BIGINT) AS n FROM l WHERE rn = 1")
def latest_row_per_item(spark, sf):
    return R.latest(feats(spark, sf)).select("item_id", "d", big(F.col("n_so_far"), "n"))


def _daily(name: str, sql: str, columns, cte: str = ""):
    """A calendar function of the distinct order dates."""

    def run(spark, sf):
        return days(spark, sf).select("d", *columns(F.col("d")))

    run.__name__ = name
    query(f"WITH {DAYS}{cte} SELECT d, {sql} FROM days")(run)


_S, _E = "make_date(year(d), 8, 15)", "make_date(year(d), 5, 31)"
_daily("date_parts", "CAST(year(d) AS BIGINT) AS y, CAST(month(d) AS BIGINT) AS m, CAST(day(d) AS BIGINT) AS dom, CAST(isodow(d) - 1 AS BIGINT) AS dow, CAST(dayofyear(d) AS BIGINT) AS doy, CAST(quarter(d) AS BIGINT) AS q", lambda d: [big(f(d), n) for f, n in ((F.year, "y"), (F.month, "m"), (F.dayofmonth, "dom"), (F.weekday, "dow"), (F.dayofyear, "doy"), (F.quarter, "q"))])
_daily("sin_cos_encode", "round(sin(2 * pi() * month(d) / 12), 6) AS s, round(cos(2 * pi() * month(d) / 12), 6) AS c", lambda d: [r6(x, n) for x, n in zip(normalize.sin_cos(F.month(d), 12), "sc")])
_daily("school_days_until", f"CAST(date_diff('day', d, CASE WHEN d <= {_S} THEN {_S} ELSE make_date(year(d) + 1, 8, 15) END) AS BIGINT) AS to_start, CAST(date_diff('day', d, CASE WHEN d <= {_E} THEN {_E} ELSE make_date(year(d) + 1, 5, 31) END) AS BIGINT) AS to_end", lambda d: [big(C.days_until_annual(d, C.SCHOOL_START), "to_start"), big(C.days_until_annual(d, C.SCHOOL_END), "to_end")])
_daily("school_season_index", f"round(CASE WHEN d > {_E} THEN date_diff('day', {_E}, d) / 365.0 ELSE -date_diff('day', d, {_S}) / 365.0 END, 6) AS v", lambda d: [r6(C.school_season_index(d), "v")])
_daily("school_season_index_scalar", f"round(CASE WHEN d < {_S} THEN -date_diff('day', d, {_S}) / 365.0 ELSE date_diff('day', {_E}, d) / 365.0 END, 6) AS v", lambda d: [r6(C.school_season_index_early(d), "v")])
_daily("is_school_season", f"d >= {_S} OR d <= {_E} AS v", lambda d: [C.is_school_season(d).alias("v")])
_daily("anniversary_days", "CAST(date_diff('day', d, CASE WHEN d <= make_date(year(d), 3, 9) THEN make_date(year(d), 3, 9) ELSE make_date(year(d) + 1, 3, 9) END) AS BIGINT) AS until, CAST(date_diff('day', CASE WHEN d >= make_date(year(d), 3, 9) THEN make_date(year(d), 3, 9) ELSE make_date(year(d) - 1, 3, 9) END, d) AS BIGINT) AS since, CAST(date_diff('day', d, CASE WHEN d <= make_date(year(d), 3, 9) THEN make_date(year(d), 3, 9) ELSE make_date(year(d) + 1, 3, 9) END) BETWEEN 1 AND 14 AS BIGINT) AS before, CAST(month(d) = 3 AND day(d) = 9 AS BIGINT) AS is_on", lambda d: [big(C.is_before_annual(d, (3, 9), 14), "before"), big(C.is_on_annual(d, (3, 9)), "is_on"), big(C.days_until_annual(d, (3, 9)), "until"), big(C.days_since_annual(d, (3, 9)), "since")])
# From 1987 to 2006 daylight saving began on the first Sunday of April and ended on the last of October, at two in the morning.
_daily("dst_flag", "CAST(d > make_date(year(d), 4, 1) + CAST((7 - isodow(make_date(year(d), 4, 1))) AS INTEGER) AND d <= make_date(year(d), 10, 31) - CAST(isodow(make_date(year(d), 10, 31)) % 7 AS INTEGER) AS BIGINT) AS dst", lambda d: [big(C.is_dst(d, "America/Chicago"), "dst")])

_ALL = C.federal_holidays(1994, 2002)
# The rules themselves, in SQL: the n-th weekday of a month, the last Monday of May, and days that move off a weekend.
_NTH = "SELECT '{0}' AS rule, make_date(y, {1}, 1) + CAST((({2} - isodow(make_date(y, {1}, 1)) + 7) % 7 + {3}) AS INTEGER) AS h FROM years"
_FIXED = "SELECT '{0}' AS rule, make_date(y, {1}, {2}) + CAST(CASE isodow(make_date(y, {1}, {2})) WHEN 6 THEN -1 WHEN 7 THEN 1 ELSE 0 END AS INTEGER) AS h FROM years"
_MAY = "SELECT 'Memorial' AS rule, make_date(y, 5, 31) - CAST(isodow(make_date(y, 5, 31)) - 1 AS INTEGER) AS h FROM years"
_HOL = "years AS (SELECT CAST(range AS INTEGER) AS y FROM range(1994, 2003)), hol AS (" + " UNION ALL ".join(
    [_NTH.format("MartinLutherKing", 1, 1, 14), _NTH.format("Presidents", 2, 1, 14), _NTH.format("Labor", 9, 1, 0), _NTH.format("Columbus", 10, 1, 7), _NTH.format("Thanksgiving", 11, 4, 21), _MAY]
    + [_FIXED.format(*x) for x in (("NewYear", 1, 1), ("Independence", 7, 4), ("Veterans", 11, 11), ("Christmas", 12, 25))]
) + ")"
_NEXT, _LAST = "(SELECT min(h) FROM hol WHERE h >= d)", "(SELECT max(h) FROM hol WHERE h <= d)"
_EVERY = [x for _, x in _ALL]


_YEARS = "SELECT CAST(unnest(generate_series((SELECT year(min(o_orderdate)) FROM orders), (SELECT year(max(ts)) FROM events))) AS INTEGER) AS y"
FEDERAL = _HOL.replace("SELECT CAST(range AS INTEGER) AS y FROM range(1994, 2003)", _YEARS)[:-1] + " UNION ALL " + _FIXED.format("Juneteenth", 6, 19) + " WHERE y >= 2021)"


def holidays(spark, sf) -> DataFrame:
    """Those of all years of the tables."""
    return C.holiday_table(C.years_of((table(spark, sf, "orders"), "o_orderdate"), (table(spark, sf, "events"), "ts")))


@query(f"WITH {FEDERAL} SELECT rule, CAST(h AS DATE) AS h FROM hol")
def federal_holidays(spark, sf):
    return holidays(spark, sf)


_daily("next_prev_holiday_asof", f"CAST(date_diff('day', d, {_NEXT}) AS BIGINT) AS until, CAST(date_diff('day', {_LAST}, d) AS BIGINT) AS since", lambda d: [big(F.datediff(C.next_of(d, C.dates(_EVERY)), d), "until"), big(F.datediff(d, C.last_of(d, C.dates(_EVERY))), "since")], f", {_HOL}")


def _near(scale: int, before: str, after: str) -> str:
    return f"round(CASE WHEN {before} <= {after} THEN greatest(0.0, ({scale} - {before}) / {scale}.0) ELSE -greatest(0.0, ({scale} - {after}) / {scale}.0) END, 6)"


_daily("holiday_proximity", _near(30, f"date_diff('day', d, {_NEXT})", f"date_diff('day', {_LAST}, d)") + " AS v", lambda d: [r6(C.proximity(d, C.dates(_EVERY), 30), "v")], f", {_HOL}")
_RULES = ("NewYear", "MartinLutherKing", "Presidents", "Memorial", "Independence", "Labor", "Columbus", "Veterans", "Thanksgiving", "Christmas")
_daily(
    "holiday_flags_per_rule",
    ", ".join(f"CAST(d IN (SELECT h FROM hol WHERE rule = '{n}') AS BIGINT) AS is{n}_holiday_feat, " + _near(15, f"date_diff('day', d, (SELECT min(h) FROM hol WHERE rule = '{n}' AND h >= d))", f"date_diff('day', (SELECT max(h) FROM hol WHERE rule = '{n}' AND h < d), d)") + f" AS proximity_{n}_holiday_feat" for n in _RULES),
    lambda d: [(big if i % 2 == 0 else r6)(x, f"{('is', 'proximity_')[i % 2]}{n}_holiday_feat") for n, i, x in zip([y for y in dict.fromkeys(r for r, _ in _ALL) for _ in (0, 1)], [0, 1] * len(_RULES), C.holiday_flags(d, _ALL))],
    f", {_HOL}",
)
_daily("near_post_holiday", f"coalesce(date_diff('day', d, (SELECT min(h) FROM hol WHERE h > d)) <= 7, false) AS near, d IN (SELECT h FROM hol) AS is_on, coalesce(date_diff('day', (SELECT max(h) FROM hol WHERE h < d), d) <= 7, false) AS post", lambda d: [x.alias(n) for x, n in zip(C.near_on_post(d, C.dates(_EVERY)), ("near", "is_on", "post"))], f", {_HOL}")


_MG = "mg AS (SELECT unnest([" + ", ".join(f"DATE '{x}'" for x in C.EXTRA_HOLIDAYS["MardiGras"]) + "]) AS h)"


@query(f"WITH {EV}, {_MG}, q AS (SELECT DISTINCT d + 20 AS d FROM ev) SELECT d, CAST(d IN (SELECT h FROM mg) AS BIGINT) AS is_it, " + _near(30, "date_diff('day', d, (SELECT min(h) FROM mg WHERE h >= d))", "date_diff('day', (SELECT max(h) FROM mg WHERE h < d), d)") + " AS near FROM q")
def extra_holiday(spark, sf):
    own = F.array(*(F.lit(x).cast("date") for x in C.EXTRA_HOLIDAYS["MardiGras"]))
    d = ev(spark, sf).select(F.date_add("d", 20).alias("d")).distinct()
    before, after = F.datediff(C.next_of(F.col("d"), own), F.col("d")), F.datediff("d", C.last_of(F.col("d"), own, strict=True))
    near = F.when(before <= after, F.greatest(F.lit(0.0), (30 - before) / 30)).otherwise(-F.greatest(F.lit(0.0), (30 - after) / 30))
    return d.select("d", big(F.array_contains(own, F.col("d")), "is_it"), r6(near, "near"))


def weather(spark, sf):
    """Daily means of a numeric series stand for weather."""
    return table(spark, sf, "events").groupBy(F.to_date("ts").alias("d")).agg(F.avg("value").alias("temp"))


W = "w AS (SELECT CAST(ts AS DATE) AS d, avg(value) AS temp FROM events GROUP BY 1)"


@query(f"WITH {W} SELECT d, round(avg(temp) OVER (ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS temp5 FROM w")
def rolling5_mean(spark, sf):
    return weather(spark, sf).select("d", r6(F.avg("temp").over(Window.orderBy("d").rowsBetween(-4, 0)), "temp5"))


@query(f"WITH {PANEL}, {W} SELECT item_id, d, round(temp, 6) AS temp FROM panel LEFT JOIN w USING (d)")
def weather_left_join(spark, sf):
    return ev_panel(spark, sf).join(weather(spark, sf), "d", "left").select("item_id", "d", r6(F.col("temp"), "temp"))


@query(f"WITH {W}, m AS (SELECT avg(temp) AS m FROM w) SELECT d, round(temp - m, 6) AS deviation, temp < m - 1 AS colder, temp > m + 1 AS hotter FROM w, m")
def weather_deviation(spark, sf):
    w = weather(spark, sf)
    dev = F.col("temp") - F.col("m")
    return w.crossJoin(F.broadcast(w.agg(F.avg("temp").alias("m")))).select("d", r6(dev, "deviation"), (dev < -1).alias("colder"), (dev > 1).alias("hotter"))


@query(f"WITH {EV}, {W} SELECT (SELECT min(d) FROM w) <= min(d) AND (SELECT max(d) FROM w) >= max(d) AS covered, min(d) AS first_d, max(d) AS last_d FROM ev")
def coverage_check(spark, sf):
    bounds = lambda df, p: df.agg(F.min("d").alias(f"{p}lo"), F.max("d").alias(f"{p}hi"))
    return bounds(ev(spark, sf), "e").crossJoin(F.broadcast(bounds(weather(spark, sf), "w"))).select(((F.col("wlo") <= F.col("elo")) & (F.col("whi") >= F.col("ehi"))).alias("covered"), F.col("elo").alias("first_d"), F.col("ehi").alias("last_d"))


_LINES = "lines AS (SELECT o_orderkey % 7 AS source, CAST(o_orderdate AS DATE) AS d, o_orderpriority AS t, o_orderstatus AS item, 1 AS qty FROM orders)"


@query(f"""WITH {_LINES}, e AS (SELECT d, t, source, string_agg(item, '|' ORDER BY item) AS sig FROM lines GROUP BY 1, 2, 3), k AS (SELECT DISTINCT min(source) AS source FROM e GROUP BY d, t, sig)
SELECT source, d, t, item FROM lines WHERE source IN (SELECT source FROM k)""")
def receipt_file_dedup(spark, sf):
    o = table(spark, sf, "orders")
    lines = o.select((F.col("o_orderkey") % 7).alias("source"), F.to_date("o_orderdate").alias("d"), F.col("o_orderpriority").alias("t"), F.col("o_orderstatus").alias("item"), F.lit(1).alias("qty"))
    return trips.drop_copied_receipts(lines).select("source", "d", "t", "item")


@query(f"WITH {PE} SELECT source, any_value(d) AS d, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS items FROM pe GROUP BY source")
def trip_item_list(spark, sf):
    return pe(spark, sf).groupBy("source").agg(F.first("d").alias("d"), F.array_join(F.transform(F.array_sort(F.collect_list("item_id")), lambda x: x.cast("string")), ",").alias("items"))


@query("SELECT l_orderkey, l_linenumber, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey) AS BIGINT) AS trip_qty, CAST(count(*) OVER (PARTITION BY l_orderkey) AS BIGINT) AS n FROM lineitem")
def trip_totals_window(spark, sf):
    w = Window.partitionBy("l_orderkey")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.sum(F.col("l_quantity").cast("long")).over(w).alias("trip_qty"), F.count(F.lit(1)).over(w).alias("n"))


_REC = "sums AS (SELECT user_id AS c_custkey, CAST(count(*) AS BIGINT) AS total FROM events GROUP BY 1)"


def reconciled(spark, sf):
    """Customers, of whom few have events, against the counts of their events."""
    sums = table(spark, sf, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count(F.lit(1)).alias("total"))
    return trips.reconcile(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), sums, "c_custkey")


@query(f"WITH {_REC} SELECT c.c_custkey, CASE WHEN s.c_custkey IS NULL THEN 'left_only' ELSE 'both' END AS indicator FROM customer c LEFT JOIN sums s USING (c_custkey)")
def reconcile_left_indicator(spark, sf):
    return reconciled(spark, sf).select("c_custkey", "indicator")


@query(f"WITH {_REC} SELECT c.c_custkey, round(c_acctbal - total, 2) AS off FROM customer c JOIN sums s USING (c_custkey) WHERE abs(c_acctbal - total) > 0.01")
def reconcile_mismatch(spark, sf):
    off = F.col("c_acctbal") - F.col("total")
    return reconciled(spark, sf).where((F.col("indicator") == "both") & (F.abs(off) > 0.01)).select("c_custkey", F.round(off, 2).alias("off"))


@query("SELECT l_orderkey, " + ", ".join(f"CAST(max(CASE WHEN l_returnflag = '{f}' THEN 1 ELSE 0 END) AS BIGINT) AS item_{f}" for f in "ANR") + " FROM lineitem GROUP BY 1")
def onehot_trip_item(spark, sf):
    wide = table(spark, sf, "lineitem").groupBy("l_orderkey").pivot("l_returnflag", list("ANR")).agg(F.max(F.lit(1)))
    return wide.select("l_orderkey", *(big(F.coalesce(f, F.lit(0)), f"item_{f}") for f in "ANR"))


@query(f"WITH {PE} SELECT item_id, CAST(count(DISTINCT source) AS BIGINT) AS trips FROM pe GROUP BY 1 HAVING count(DISTINCT source) >= 30")
def frequent_items(spark, sf):
    return pe(spark, sf).groupBy("item_id").agg(F.countDistinct("source").alias("trips")).where("trips >= 30")


@query("SELECT round(least(50.0, (count(*) - sum(toxic)) / (sum(toxic) + 1e-6)), 6) AS weight FROM labels")
def class_weights(spark, sf):
    return normalize.class_weight(table(spark, sf, "labels"), "toxic").select(r6(F.col("weight"), "weight"))


@query("WITH s AS (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS sd FROM customer) SELECT c_custkey, round((c_acctbal - m) / sd, 6) AS z FROM customer, s")
def zscore_fit_apply(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return normalize.apply(c, normalize.fit(c, ["c_acctbal"])).select("c_custkey", r6(F.col("c_acctbal_norm"), "z"))


@query("WITH a AS (SELECT p_partkey, CASE WHEN p_size = 7 THEN NULL ELSE p_size END AS v FROM part), s AS (SELECT avg(v) AS m, stddev_samp(v) AS sd FROM a) SELECT p_partkey, round(coalesce((v - m) / sd, 0), 6) AS z FROM a, s")
def zscore_sentinel(spark, sf):
    a = table(spark, sf, "part").select("p_partkey", F.nullif(F.when(F.col("p_size") == 7, 999).otherwise(F.col("p_size")), F.lit(999)).alias("v"))
    return normalize.apply(a, normalize.fit(a, ["v"])).select("p_partkey", r6(F.coalesce("v_norm", F.lit(0.0)), "z"))


@query("WITH s AS (SELECT avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS sd FROM part) SELECT p_partkey, round((p_retailprice - m) / sd, 6) AS z FROM part, s")
def stddev_pop_scale(spark, sf):
    a = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("v"))
    return normalize.apply(a, normalize.fit(a, ["v"], population=True)).select("p_partkey", r6(F.col("v_norm"), "z"))


@query("SELECT 'doc_id' AS \"column\", coalesce(bool_and(doc_id IN (0, 1)), true) AS is_binary FROM labels UNION ALL SELECT 'quality', coalesce(bool_and(quality IN (0, 1)), true) FROM labels UNION ALL SELECT 'toxic', coalesce(bool_and(toxic IN (0, 1)), true) FROM labels")
def binary_columns(spark, sf):
    return normalize.binary_columns(table(spark, sf, "labels"), ["doc_id", "quality", "toxic"])


@query(f"WITH {PANEL} SELECT CAST(count(*) FILTER (item_id IS NULL) AS BIGINT) AS item_id, CAST(count(*) FILTER (d IS NULL) AS BIGINT) AS d, CAST(count(*) FILTER (qty IS NULL) AS BIGINT) AS qty FROM panel")
def null_audit(spark, sf):
    return normalize.null_counts(ev_panel(spark, sf), ["item_id", "d", "qty"])


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("WITH p AS (SELECT user_id, CAST(ts AS DATE) AS d, max(value) AS hi, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, round(max(hi), 6) AS hi, CAST(sum(n) AS BIGINT) AS n FROM p WHERE d = DATE '2024-01-15' GROUP BY 1")
def forecast_filter(spark, sf):
    """Periods of a nested forecast filtered by date, with the highest value in them. Here the periods are nested from rows, so the rows are filtered before."""
    e = table(spark, sf, "events").where((F.col("ts") >= "2024-01-15") & (F.col("ts") < "2024-01-16"))
    period = F.struct(F.to_date("ts").alias("d"), "value")
    nested_ = e.groupBy("user_id").agg(F.collect_list(period).alias("periods"))
    on = nested.periods_on(F.col("periods"), F.lit("2024-01-15").cast("date"))
    return nested_.select("user_id", on.alias("on")).where(F.size("on") > 0).select("user_id", r6(F.array_max(F.transform("on", lambda p: p["value"])), "hi"), big(F.size("on"), "n"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 4) AS norm FROM embeddings")
def embedding_l2_norm(spark, sf):
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return table(spark, sf, "embeddings").select("vec_id", F.round(norm, 4).alias("norm"))


@query(f"WITH {PANEL} SELECT item_id, d, qty FROM panel WHERE buy = 1")
def frozen_events(spark, sf):
    from basketry.sources.tables import frozen_events as frozen

    return frozen(ev_panel(spark, sf)).select("item_id", "d", "qty")


@query(f"""WITH {GAPS}, r AS (SELECT item_id, d, round(least(3.0, CASE WHEN avg_gap = 0 THEN 0.0 ELSE since / avg_gap END), 6) AS due FROM feats),
k AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY due DESC, item_id) AS rank FROM r) SELECT item_id, d, due, CAST(rank AS BIGINT) AS rank FROM k WHERE rank <= 50""")
def topk_per_date(spark, sf):
    """The 50 items most due on each date; a top-k report."""
    due = feats(spark, sf).select("item_id", "d", r6(R.due_ratio(F.col("since"), F.col("avg_gap")), "due"))
    return due.withColumn("rank", big(F.row_number().over(Window.partitionBy("d").orderBy(F.desc("due"), "item_id")), "rank")).where("rank <= 50")


@query()
def synthetic_purchases(spark, sf):
    averages = R.latest(feats(spark, sf)).select("item_id", F.col("avg_gap").alias("gap"))
    return panel.synthetic_purchases(averages, "2024-02-01", "2024-03-31")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS source, strftime(any_value(o_orderdate), '%-m/%-d/%Y') AS date, '9:09 PM' AS time, CAST(sum(l_quantity) AS INTEGER) AS reported, CAST(count(*) AS INTEGER) AS "rowsCount", CAST(sum(l_quantity) AS INTEGER) AS "qtySum", true AS "qtyMatchReported"
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def receipt_parse(spark, sf):
    """Orders written as receipt texts, parsed back."""
    from basketry.sources import receipts

    lines = table(spark, sf, "lineitem")
    line = F.format_string("QTY %d  Part %d $%.2f $%.2f B", F.col("l_quantity").cast("int"), F.col("l_partkey"), F.col("l_extendedprice"), F.col("l_extendedprice"))
    body = lines.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"), F.sum("l_quantity").cast("int").alias("n"))
    o = table(spark, sf, "orders").join(body, F.col("o_orderkey") == F.col("l_orderkey"))
    text = F.concat(F.date_format("o_orderdate", "M/d/yyyy"), F.lit(" at 9:09 PM\nReg You Pay\n"), "body", F.lit("\nTotal number of items sold = "), F.col("n").cast("string"))
    return receipts.parse(o.select(F.col("o_orderkey").cast("string").alias("source"), text.alias("value"))).select("source", "date", "time", "reported", "validation.rowsCount", "validation.qtySum", "validation.qtyMatchReported")


def vectors(spark, sf):
    from pyspark.ml.functions import array_to_vector

    return table(spark, sf, "embeddings").select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


@query()
def kmeans_pca(spark, sf):
    from basketry.operators import learn

    return learn.clusters(vectors(spark, sf), k=4).select("vec_id", "prediction")


@query()
def silhouette_sweep(spark, sf):
    from basketry.operators import learn

    return learn.silhouettes(vectors(spark, sf), range(2, 6))


@query()
def gbt_scores(spark, sf):
    from basketry.operators import learn

    f = feats(spark, sf).select("item_id", "d", "buy", F.col("since").cast("double"), "avg_gap", F.col("n_so_far").cast("double"))
    return learn.boosted_scores(f, ["since", "avg_gap", "n_so_far"], "buy")


@query()
def predict_dates(spark, sf):
    """Due ratios of every item on five coming days from one panel."""
    from basketry.plans.pipeline import predictions

    return predictions(ev(spark, sf), "2024-01-31", 5)
