"""Queries over the driver's tables, one for each operator, with the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork import sources
from braidwork.functions.ordering import By
from braidwork.plans.storage import store
from braidwork.plans.seq import Seq

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

Tables = Callable[[str], DataFrame]


def query(sql: str | None):
    """Register the function under its own name: it gets (spark, table) and gives a Seq or DataFrame."""

    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            def table(name: str) -> DataFrame:
                return spark.read.parquet(f"{sf_dir}/{name}.parquet")

            table.path = lambda name: f"{sf_dir}/{name}.parquet"
            made = build(spark, table)
            return made.df if isinstance(made, Seq) else made

        run.__name__, run.__doc__ = build.__name__, build.__doc__
        QUERIES[build.__name__] = run
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return register


def events(t: Tables, where: str | None = None, keys: tuple = ()) -> Seq:
    df = t("events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    return Seq(df.where(where) if where else df, "event_id", "ts", keys)


def orders(t: Tables) -> Seq:
    return Seq(t("orders"), "o_orderkey", "o_orderdate")


ISLANDS = """
f AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type AND lag(event_id) OVER w IS NOT NULL THEN 1 ELSE 0 END AS cut
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY event_id) AS window_id FROM f)
"""


@query(f"""
WITH {ISLANDS}, b AS (SELECT user_id, window_id, count(*) AS n FROM r GROUP BY ALL)
SELECT user_id, count(*) AS runs, max(n) AS longest FROM b GROUP BY user_id ORDER BY longest DESC, runs DESC, user_id LIMIT 20
""")
def user_runs(spark, t):
    """Flagship: runs of one event type for each user, the users with the longest runs first."""
    runs = events(t).group_by("user_id").buffer_until_changed(F.col("event_type"))
    stats = runs.df.groupBy("user_id").agg(F.count("*").alias("runs"), F.max("n").alias("longest"))
    return Seq(stats, "user_id").top(20, F.desc("longest"), F.desc("runs"), F.col("user_id"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["user_runs"](spark, sf_dir)


# Sources.


@query("SELECT value, value * value AS square FROM (SELECT unnest(range(5, 5 + (SELECT count(*) FROM orders))) AS value)")
def source_range(spark, t):
    return sources.range_(spark, 5, t("orders").count()).map(square=F.col("value") * F.col("value"))


@query("SELECT row_number() OVER (ORDER BY i) - 1 AS seq, value FROM (SELECT 0 AS i, min(o_totalprice) AS value FROM orders UNION ALL SELECT 1, max(o_totalprice) FROM orders UNION ALL SELECT 2, median(o_totalprice) FROM orders)")
def source_just(spark, t):
    """Literals that an aggregate of the table gave."""
    return sources.just(spark, *t("orders").agg(F.min("o_totalprice"), F.max("o_totalprice"), F.median("o_totalprice")).first(), schema="value double")


@query("WITH RECURSIVE g(n, s) AS (SELECT 0::BIGINT, (SELECT sum(o_custkey) % 1009 FROM orders)::BIGINT UNION ALL SELECT n + 1, s * 3 % 1009 FROM g WHERE n < 60) SELECT n AS seq, s AS value FROM g")
def source_generate(spark, t):
    """A generator that starts from what the table sums up to."""
    begin = t("orders").agg(F.sum("o_custkey") % 1009).first()[0]
    return sources.generate(spark, f"CAST({begin} AS BIGINT)", "state * 3 % 1009", most=60)


@query("""
WITH e AS (SELECT date_trunc('hour', min(ts)) AS low, max(ts) AS high FROM events),
k AS (SELECT unnest(generate_series(low, high, INTERVAL 1 HOUR)) AS ts FROM e), n AS (SELECT date_trunc('hour', ts) AS ts, count(*) AS n FROM events GROUP BY 1)
SELECT epoch_us(k.ts) AS at_us, row_number() OVER (ORDER BY k.ts) - 1 AS value, coalesce(n, 0) AS n FROM k LEFT JOIN n USING (ts)
""")
def source_interval(spark, t):
    """A tick for each hour that the events span, with the events of that hour."""
    low, high = t("events").agg(F.date_trunc("hour", F.min("ts")).cast("string"), F.max("ts").cast("string")).first()
    ticks = sources.interval(spark, low, high, "1 hour")
    counts = t("events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).count()
    return ticks.with_df(ticks.df.join(counts, "ts", "left")).df.select(ticks.micros().alias("at_us"), "value", F.coalesce("count", F.lit(0)).alias("n"))


@query("SELECT o_orderkey AS seq, o_orderkey * 7 % 13 AS value FROM orders")
def source_create(spark, t):
    """Opaque code on the executors makes the orders' keys, in eight parts (they run from 0 without a gap)."""
    n = t("orders").count()

    def emit(partition):
        for i in range(n * partition // 8, n * (partition + 1) // 8):
            yield i, i * 7 % 13

    return sources.create(spark, emit, "seq long, value long", "seq", partitions=8)


@query("SELECT c_custkey, c_name FROM customer WHERE false")
def source_empty(spark, t):
    return Seq(t("customer").select("c_custkey", "c_name"), "c_custkey").ignore_elements()


# Projections.


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS revenue FROM lineitem WHERE l_quantity < 10 AND l_returnflag = 'R'")
def filter_map(spark, t):
    kept = Seq(t("lineitem"), ["l_orderkey", "l_linenumber"]).filter((F.col("l_quantity") < 10) & (F.col("l_returnflag") == "R"))
    return kept.map(revenue=F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def map_not_null(spark, t):
    return events(t).map_not_null(k=F.get_json_object("props", "$.k").cast("long")).df.select("event_id", "k")


@query("SELECT event_id, CAST(round(value) AS BIGINT) AS value FROM events")
def cast(spark, t):
    return events(t).map(value=F.round("value")).cast("value", "long").df.select("event_id", "value")


@query("SELECT doc_id, TRY_CAST(substr(source, 4) AS INTEGER) AS source_no FROM documents WHERE TRY_CAST(substr(source, 4) AS INTEGER) IS NOT NULL")
def of_type(spark, t):
    return Seq(t("documents").select("doc_id", F.substring("source", 4, 9).alias("source_no")), "doc_id").of_type("source_no", "int")


@query("SELECT event_id, round(value * 2, 4) AS doubled FROM events WHERE event_id <= (SELECT coalesce(min(event_id), 1e18) FROM events WHERE value > 200 AND event_type = 'signup') AND event_type <> 'error'")
def handle_by_value(spark, t):
    done = (F.col("value") > 200) & (F.col("event_type") == "signup")
    return events(t).handle(F.round(F.col("value") * 2, 4), emit=F.col("event_type") != "error", complete=done, name="doubled").df.select("event_id", "doubled")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS index FROM orders")
def index(spark, t):
    return orders(t).index().df.select("o_orderkey", "index")


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS index FROM events")
def index_by_key(spark, t):
    return events(t).group_by("user_id").index().df.select("event_id", "user_id", "index")


@query("SELECT event_id, epoch_us(ts) // 1000 AS millis FROM events")
def timestamp(spark, t):
    return events(t).timestamp().df.select("event_id", "millis")


@query("SELECT event_id, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY event_id), 0) AS elapsed_us FROM events")
def elapsed(spark, t):
    return events(t).elapsed().df.select("event_id", "elapsed_us")


@query("""
SELECT event_id, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w, 0) AS elapsed_us, epoch_us(ts) - min(epoch_us(ts)) OVER w AS since_start_us, epoch_us(ts) AS at_us
FROM events WINDOW w AS (ORDER BY event_id)
""")
def timed(spark, t):
    return events(t).timed().df.select("event_id", "elapsed_us", "since_start_us", "at_us")


@query("""
SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS signal_pos, 'NEXT' AS type, o_orderstatus AS value, NULL::VARCHAR AS error FROM orders
UNION ALL SELECT count(*), 'COMPLETE', NULL, NULL FROM orders
""")
def materialize(spark, t):
    return orders(t).materialize("o_orderstatus")


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS signal_pos, o_orderstatus AS value FROM orders")
def dematerialize(spark, t):
    return orders(t).materialize("o_orderstatus").dematerialize()


@query("SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id), 3) AS scan FROM events")
def scan(spark, t):
    return events(t).group_by("user_id").scan(F.col("value")).df.select("event_id", "user_id", F.round("scan", 3).alias("scan"))


@query("SELECT event_id, 100 + sum(user_id) OVER (ORDER BY event_id)::BIGINT AS scan FROM events UNION ALL SELECT NULL, 100")
def scan_seed(spark, t):
    return events(t).scan(F.col("user_id"), seed=F.lit(100)).df.select("event_id", "scan")


@query("SELECT event_id, max(value) OVER (ORDER BY event_id) AS scan FROM events")
def scan_max(spark, t):
    return events(t).scan(F.col("value"), "max").df.select("event_id", "scan")


@query("SELECT conv_id, turn, pos::INTEGER - 1 AS pos, word FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS pos FROM conversations)")
def flat_map(spark, t):
    talk = Seq(t("conversations").where("text IS NOT NULL"), ["conv_id", "turn"])
    return talk.flat_map(F.split("text", " "), "word").df.select("conv_id", "turn", "pos", "word")


@query("SELECT doc_id, pos::INTEGER - 1 AS pos, md5(line) AS line_md5 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)")
def concat_map(spark, t):
    lines = Seq(t("documents").where("text IS NOT NULL"), "doc_id").concat_map(F.split("text", "\n"), "line")
    return lines.df.select("doc_id", "pos", F.md5("line").alias("line_md5"))


@query("SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority LIKE '1%'")
def flat_map_join(spark, t):
    urgent = orders(t).filter(F.col("o_orderpriority").startswith("1"))
    items = t("lineitem").withColumnRenamed("l_orderkey", "o_orderkey").select("o_orderkey", "l_linenumber", "l_quantity")
    return urgent.flat_map_join(items, "o_orderkey", ["l_linenumber"]).df.select("o_orderkey", "l_linenumber", "l_quantity")


@query("""
WITH o AS (SELECT event_id AS outer_id, user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS until FROM events WHERE event_type = 'view')
SELECT outer_id, event_id FROM o JOIN events e ON e.user_id = o.user_id AND e.event_type = 'click' AND e.ts >= o.ts AND (o.until IS NULL OR e.ts < o.until)
""")
def switch_map(spark, t):
    outer = Seq(t("events").where("event_type = 'view'").select(F.col("event_id").alias("outer_id"), "user_id", F.col("ts").alias("outer_ts")), "outer_id", "outer_ts", ["user_id"])
    inner = Seq(t("events").where("event_type = 'click'").select("event_id", "user_id", "ts"), "event_id", "ts")
    return outer.switch_map(inner, on="user_id").df.select("outer_id", "event_id")


@query("SELECT event_id, event_type FROM events WHERE event_type = (SELECT event_type FROM events ORDER BY event_id LIMIT 1)")
def switch_on_first(spark, t):
    return events(t).switch_on_first(lambda first, s: s.filter(F.col("event_type") == first["event_type"])).df.select("event_id", "event_type")


TREE = """
tree AS (SELECT 'r' || r_regionkey AS node, 'root' AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
         UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)
"""


def tree(t: Tables) -> DataFrame:
    def level(name, key, mark, above, above_mark):
        parent = F.lit("root") if above is None else F.concat(F.lit(above_mark), F.col(above).cast("string"))
        return t(name).select(F.concat(F.lit(mark), F.col(key).cast("string")).alias("node"), parent.alias("parent"))

    return level("region", "r_regionkey", "r", None, "").union(level("nation", "n_nationkey", "n", "n_regionkey", "r")).union(level("supplier", "s_suppkey", "s", "s_nationkey", "n"))


EXPAND = f"""
WITH RECURSIVE {TREE}, e(node, depth, path) AS (
  SELECT 'root', 0, 'root' UNION ALL SELECT tree.node, depth + 1, path || '/' || tree.node FROM e JOIN tree ON tree.parent = e.node)
SELECT node, depth, path FROM e
"""


@query(EXPAND)
def expand(spark, t):
    found = Seq(spark.sql("SELECT 'root' AS node"), "node").expand(tree(t), "node", "parent")
    return found.df.select("node", "depth", F.array_join("path", "/").alias("path"))


@query(EXPAND.replace("SELECT node, depth, path FROM e", "SELECT node, row_number() OVER (ORDER BY string_split(path, '/')) - 1 AS index FROM e"))
def expand_deep(spark, t):
    return Seq(spark.sql("SELECT 'root' AS node"), "node").expand_deep(tree(t), "node", "parent").index().df.select("node", "index")


# Selection.


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def filter_when(spark, t):
    tests = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_returnflag") == "R").alias("good"))
    return orders(t).filter_when(tests, "o_orderkey", "good").df.select("o_orderkey")


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def distinct(spark, t):
    return events(t).distinct("user_id").df.select("event_id", "user_id")


@query("SELECT event_id, event_type FROM events QUALIFY lag(event_type) OVER (ORDER BY event_id) IS DISTINCT FROM event_type")
def distinct_until_changed(spark, t):
    return events(t).distinct_until_changed(F.col("event_type")).df.select("event_id", "event_type")


def cut(name: str, of: Callable[[Tables], Seq], column: str, build: Callable[[Seq], Seq], sql: str) -> None:
    def run(spark, t):
        return build(of(t)).df.select(column)

    run.__name__ = name
    query(sql)(run)


for _name, _build, _sql in [
    ("take", lambda s: s.take(17), "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 17"),
    ("limit_request", lambda s: s.limit_request(3), "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 3"),
    ("skip", lambda s: s.skip(100), "SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 100"),
    ("take_last", lambda s: s.take_last(25), "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 25"),
    ("skip_last", lambda s: s.skip_last(25), "SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY o_orderkey DESC) > 25"),
    ("next", lambda s: s.next(), "SELECT min(o_orderkey) AS o_orderkey FROM orders"),
    ("last", lambda s: s.last(), "SELECT max(o_orderkey) AS o_orderkey FROM orders"),
    ("element_at", lambda s: s.element_at(7), "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 7"),
    ("single", lambda s: s.filter(F.col("o_orderkey") == 5).single(), "SELECT o_orderkey FROM orders WHERE o_orderkey = 5"),
    ("single_or_empty", lambda s: s.filter(F.col("o_orderkey") < 0).single_or_empty(), "SELECT o_orderkey FROM orders WHERE o_orderkey < 0"),
]:
    cut(_name, orders, "o_orderkey", _build, _sql)

@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS index FROM orders")
def sort_all(spark, t):
    return orders(t).sort("o_custkey").index().df.select("o_orderkey", "index")


for _name, _build, _sql in [
    ("take_while_by_value", lambda s: s.take_while(F.col("value") <= 300), "event_id < (SELECT coalesce(min(event_id), 1e18) FROM events WHERE value > 300)"),
    ("take_until", lambda s: s.take_until(F.col("value") > 90), "event_id <= (SELECT coalesce(min(event_id), 1e18) FROM events WHERE value > 90)"),
    ("skip_while", lambda s: s.skip_while(F.col("value") < 90), "event_id >= (SELECT min(event_id) FROM events WHERE value >= 90)"),
    ("skip_until", lambda s: s.skip_until(F.col("event_type") == "error"), "event_id >= (SELECT min(event_id) FROM events WHERE event_type = 'error')"),
    ("take_for", lambda s: s.take_for(86_400), "ts < (SELECT min(ts) FROM events) + INTERVAL 1 DAY"),
    ("skip_for", lambda s: s.skip_for(86_400), "ts >= (SELECT min(ts) FROM events) + INTERVAL 1 DAY"),
    ("take_until_other", lambda s: s.take_until_other(s.filter(F.col("event_type") == "signup").skip(3)), "ts < (SELECT ts FROM events WHERE event_type = 'signup' ORDER BY event_id LIMIT 1 OFFSET 3)"),
    ("skip_until_other", lambda s: s.skip_until_other(s.filter(F.col("event_type") == "signup").skip(3)), "ts >= (SELECT ts FROM events WHERE event_type = 'signup' ORDER BY event_id LIMIT 1 OFFSET 3)"),
]:
    cut(_name, events, "event_id", _build, f"SELECT event_id FROM events WHERE {_sql}")


@query("SELECT -1::BIGINT AS r_regionkey, 'none' AS r_name")
def default_if_empty(spark, t):
    none = Seq(t("region").select(F.col("r_regionkey").cast("long").alias("r_regionkey"), "r_name"), "r_regionkey").filter(F.col("r_regionkey") > 99)
    return none.default_if_empty({"r_regionkey": -1, "r_name": "none"})


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def switch_if_empty(spark, t):
    nations = Seq(t("nation").select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey")
    chosen = nations.filter(F.col("n_regionkey") == 99).switch_if_empty(nations.filter(F.col("n_regionkey") == 1))
    return chosen.df.select("n_nationkey", "n_name")


# Combination.

CLICK_PURCHASE = "a.event_type = 'click' AND b.event_type = 'purchase'"


def clicks(t: Tables, kind: str) -> Seq:
    return Seq(t("events").where(F.col("event_type") == kind).select("event_id", "ts", "user_id", "value"), "event_id", "ts")


@query(f"SELECT a.event_id AS click, b.event_id AS purchase FROM events a JOIN events b ON {CLICK_PURCHASE} AND a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 6 HOUR")
def join(spark, t):
    pairs = clicks(t, "click").join(clicks(t, "purchase"), 6 * 3600, on=["user_id"])
    return pairs.df.select(F.col("l_event_id").alias("click"), F.col("r_event_id").alias("purchase"))


@query(f"SELECT a.event_id AS click, b.event_id AS purchase FROM events a JOIN events b ON {CLICK_PURCHASE} AND b.ts BETWEEN a.ts - INTERVAL 2 MINUTE AND a.ts + INTERVAL 5 MINUTE")
def join_unkeyed(spark, t):
    pairs = clicks(t, "click").join(clicks(t, "purchase"), 300, 120)
    return pairs.df.select(F.col("l_event_id").alias("click"), F.col("r_event_id").alias("purchase"))


@query(f"""
SELECT a.event_id AS click, count(b.event_id) AS n, coalesce(string_agg(b.event_id::VARCHAR, ',' ORDER BY b.event_id), '') AS purchases
FROM events a LEFT JOIN events b ON {CLICK_PURCHASE} AND a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 6 HOUR
WHERE a.event_type = 'click' GROUP BY a.event_id
""")
def group_join(spark, t):
    grouped = clicks(t, "click").group_join(clicks(t, "purchase"), 6 * 3600, on=["user_id"], collect="event_id")
    return grouped.df.select(F.col("l_event_id").alias("click"), "n", F.array_join(F.col("values").cast("array<string>"), ",").alias("purchases"))


@query("SELECT a.event_id AS click, b.event_id AS view FROM (FROM events WHERE event_type = 'click') a ASOF JOIN (FROM events WHERE event_type = 'view') b ON a.ts > b.ts")
def with_latest_from(spark, t):
    return clicks(t, "click").with_latest_from(clicks(t, "view")).df.select(F.col("event_id").alias("click"), F.col("latest.event_id").alias("view"))


@query("""
WITH u AS (SELECT event_id, max(CASE WHEN event_type = 'click' THEN event_id END) OVER w AS click, max(CASE WHEN event_type = 'view' THEN event_id END) OVER w AS view
           FROM events WHERE event_type IN ('click', 'view') WINDOW w AS (ORDER BY event_id))
SELECT click, view FROM u WHERE click IS NOT NULL AND view IS NOT NULL
""")
def combine_latest(spark, t):
    return clicks(t, "click").combine_latest(clicks(t, "view")).df.select(F.col("s0.event_id").alias("click"), F.col("s1.event_id").alias("view"))


ZIP = """
a AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS position, event_id FROM events), b AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS position, o_orderkey FROM orders)
"""


@query(f"WITH {ZIP} SELECT position, event_id, o_orderkey FROM a JOIN b USING (position)")
def zip_positions(spark, t):
    return events(t).zip(orders(t)).df.select("position", "z0.event_id", "z1.o_orderkey")


@query("SELECT n_nationkey, ['x', 'y', 'z'][n_nationkey + 1] AS mark FROM nation WHERE n_nationkey < 3")
def zip_with_iterable(spark, t):
    return Seq(t("nation"), "n_nationkey").zip_with_iterable(["x", "y", "z"], "mark").df.select("n_nationkey", "mark")


@query("SELECT EXISTS (SELECT 1 FROM nation WHERE n_name = (SELECT min(n_name) FROM nation)) AS has_element")
def has_element(spark, t):
    smallest = t("nation").agg(F.min("n_name")).first()[0]
    return Seq(t("nation"), "n_nationkey").has_element("n_name", smallest)


@query("WITH w AS (SELECT event_type FROM events WHERE event_type IN ('error', 'signup', 'purchase') ORDER BY ts LIMIT 1) SELECT event_id FROM events WHERE event_type = (SELECT event_type FROM w)")
def first_with_value(spark, t):
    a, b, c = (clicks(t, k) for k in ("error", "signup", "purchase"))
    return a.first_with_value(b, c).df.select("event_id")


@query("SELECT 0 AS source_ord, n_nationkey FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 1, n_nationkey FROM nation WHERE n_regionkey = 0")
def concat(spark, t):
    nations = Seq(t("nation").select("n_nationkey", "n_regionkey"), "n_nationkey")
    return nations.filter(F.col("n_regionkey") == 2).concat_with(nations.filter(F.col("n_regionkey") == 0)).df.select("source_ord", "n_nationkey")


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT 99, 'NOWHERE'")
def concat_with_values(spark, t):
    return Seq(t("nation").select("n_nationkey", "n_name"), "n_nationkey").concat_with_values({"n_nationkey": 99, "n_name": "NOWHERE"}).df.select("n_nationkey", "n_name")


@query("SELECT 0 AS source_ord, n_nationkey FROM nation WHERE n_regionkey = 4 UNION ALL SELECT 1, n_nationkey FROM nation WHERE n_regionkey = 3")
def start_with(spark, t):
    nations = Seq(t("nation").select("n_nationkey", "n_regionkey"), "n_nationkey")
    return nations.filter(F.col("n_regionkey") == 3).start_with(nations.filter(F.col("n_regionkey") == 4)).df.select("source_ord", "n_nationkey")


@query("SELECT event_id, row_number() OVER (ORDER BY ts) - 1 AS index FROM events WHERE event_type IN ('click', 'view')")
def merge(spark, t):
    return clicks(t, "click").merge_with(clicks(t, "view")).index().df.select("event_id", "index")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS index FROM orders")
def merge_comparing_all(spark, t):
    odd, even = (orders(t).filter(F.col("o_orderkey") % 2 == r) for r in (1, 0))
    return odd.merge_comparing(even, by=["o_orderkey"]).index().df.select("o_orderkey", "index")


@query("SELECT range AS round, n_nationkey FROM nation, range(3)")
def repeat(spark, t):
    return Seq(t("nation").select("n_nationkey"), "n_nationkey").repeat(2)


@query("SELECT true AS equal")
def sequence_equal(spark, t):
    return orders(t).sequence_equal(Seq(t("orders").repartition(3), "o_orderkey"), ["o_orderkey", "o_custkey"])


# Aggregation.


@query("SELECT count(*) AS n FROM lineitem")
def count(spark, t):
    return Seq(t("lineitem"), "l_orderkey").count()


@query("SELECT bool_or(l_quantity > 49) AS any FROM lineitem")
def any_match(spark, t):
    return Seq(t("lineitem"), "l_orderkey").any(F.col("l_quantity") > 49)


@query("SELECT bool_and(l_quantity < 40) AS all FROM lineitem")
def all_match(spark, t):
    return Seq(t("lineitem"), "l_orderkey").all(F.col("l_quantity") < 40)


@query("SELECT count(*) > 0 AS has_elements FROM lineitem WHERE l_quantity < 0")
def has_elements(spark, t):
    return Seq(t("lineitem"), "l_orderkey").filter(F.col("l_quantity") < 0).has_elements()


@query("SELECT user_id, round(sum(value), 3) AS value FROM events GROUP BY user_id")
def reduce(spark, t):
    return events(t).group_by("user_id").reduce("sum", F.col("value")).df.select("user_id", F.round("value", 3).alias("value"))


@query("""
WITH RECURSIVE i AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events),
f(user_id, p, v) AS (SELECT user_id, 0::BIGINT, 7::BIGINT FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT f.user_id, i.p, (f.v * 31 + i.event_id) % 1000003 FROM f JOIN i ON i.user_id = f.user_id AND i.p = f.p + 1)
SELECT user_id, arg_max(v, p) AS value FROM f GROUP BY user_id
""")
def reduce_ordered(spark, t):
    seed = F.lit(7).cast("long")
    return events(t).group_by("user_id").reduce_ordered(F.col("event_id"), seed, lambda acc, x: (acc * 31 + x) % 1000003)


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS types FROM events GROUP BY user_id")
def collect_list(spark, t):
    return events(t).group_by("user_id").collect_list(F.col("event_type")).df.select("user_id", F.array_join("values", ",").alias("types"))


@query("SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY value, event_id) AS ids FROM events GROUP BY user_id")
def collect_sorted_list(spark, t):
    by_value = Seq(t("events").withColumn("pair", F.struct("value", "event_id")), "event_id", "ts", ["user_id"]).collect_sorted_list(F.col("pair"))
    return by_value.df.select("user_id", F.array_join(F.transform("values", lambda x: x["event_id"].cast("string")), ",").alias("ids"))


@query("SELECT user_id, arg_max(event_type, event_id) AS value FROM events GROUP BY user_id")
def collect_map(spark, t):
    mapped = events(t).collect_map("user_id", F.col("event_type"))
    return mapped.df.select(F.explode("map").alias("user_id", "value"))


@query("SELECT c_nationkey, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) AS customers FROM customer GROUP BY c_nationkey")
def collect_multimap(spark, t):
    mapped = Seq(t("customer"), "c_custkey").collect_multimap("c_nationkey", F.col("c_custkey").cast("string"))
    return mapped.df.select(F.explode("map").alias("c_nationkey", "list")).select("c_nationkey", F.array_join("list", ",").alias("customers"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) WHERE length(word) > 3 GROUP BY word ORDER BY n DESC, word LIMIT 10")
def group_by_top(spark, t):
    words = Seq(t("documents").select("doc_id", "text"), "doc_id").flat_map(F.split("text", " "), "word").filter(F.length("word") > 3)
    return words.with_df(words.df, keys=["word"]).count().top(10, F.desc("n"), F.col("word"))


# Windows and buffers.

def counted(name: str, size: int, skip: int) -> None:
    def run(spark, t):
        return events(t).buffer(size, skip, F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))

    run.__name__ = name
    query(f"""
    WITH i AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS p FROM events), w AS (SELECT range AS window_id FROM range((SELECT count(*) FROM events)))
    SELECT window_id, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM w JOIN i ON p >= window_id * {skip} AND p < window_id * {skip} + {size} GROUP BY window_id
    """)(run)


for _name, _size, _skip in [("buffer_exact", 7, 7), ("buffer_gap", 3, 7), ("buffer_overlap", 10, 4)]:
    counted(_name, _size, _skip)


@query("WITH r AS (SELECT event_id, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS window_id FROM events) SELECT window_id, count(*) AS n FROM r GROUP BY ALL")
def buffer_until(spark, t):
    return events(t).buffer_until(F.col("event_type") == "purchase")


@query("WITH r AS (SELECT event_id, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (ORDER BY event_id)::BIGINT AS window_id FROM events), c AS (SELECT window_id, count(*) AS n FROM r GROUP BY ALL) SELECT * FROM c UNION ALL SELECT 0, 0 WHERE NOT EXISTS (FROM c WHERE window_id = 0)")
def window_until_cut_before(spark, t):
    return events(t).window_until_counts(F.col("event_type") == "purchase", cut_before=True)


@query(f"WITH {ISLANDS} SELECT user_id, window_id::BIGINT AS window_id, count(*) AS n FROM r GROUP BY ALL")
def buffer_until_changed(spark, t):
    return events(t).group_by("user_id").buffer_until_changed(F.col("event_type"))


WHILE = "r AS (SELECT event_id, value < 50 AS matched, coalesce(sum(CASE WHEN value < 50 THEN 0 ELSE 1 END) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS window_id FROM events)"


@query(f"WITH {WHILE} SELECT window_id, count(*) AS n FROM r WHERE matched GROUP BY ALL")
def buffer_while(spark, t):
    return events(t).buffer_while(F.col("value") < 50)


@query(f"WITH {WHILE} SELECT window_id, count(*) FILTER (WHERE matched) AS n FROM r GROUP BY ALL")
def window_while(spark, t):
    return events(t).window_while_counts(F.col("value") < 50)


@query("SELECT (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) // 3600000000 AS window_id, count(*) AS n FROM events GROUP BY ALL")
def buffer_time(spark, t):
    return events(t).buffer_time(3600)


@query("""
WITH d AS (SELECT epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events) AS d FROM events)
SELECT range AS window_id, count(*) AS n FROM range(2000) JOIN d ON d >= range * 3600000000 AND d < range * 3600000000 + 7200000000 GROUP BY range
""")
def window_sliding(spark, t):
    return events(t).buffer_time(7200, 3600)


@query("""
WITH d AS (SELECT (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) // 60000000 AS w FROM events)
SELECT range AS window_id, (SELECT count(*) FROM d WHERE w = range) AS n FROM range((SELECT max(w) + 1 FROM d))
""")
def window_time_with_empty(spark, t):
    return events(t).window_time_counts(60)


@query("SELECT a.event_id AS opening, count(b.event_id) AS n FROM events a LEFT JOIN events b ON b.ts BETWEEN a.ts AND a.ts + INTERVAL 2 HOUR WHERE a.event_type = 'signup' GROUP BY a.event_id")
def buffer_when(spark, t):
    counted = Seq(t("events").select("event_id", "ts"), "event_id", "ts").buffer_when(clicks(t, "signup"), 7200)
    return counted.df.select(F.col("l_event_id").alias("opening"), "n")


@query("WITH u AS (SELECT event_id, event_type, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (ORDER BY event_id)::BIGINT AS window_id FROM events) SELECT window_id, count(*) AS n FROM u WHERE event_type = 'click' GROUP BY window_id")
def buffer_boundary(spark, t):
    return clicks(t, "click").buffer_boundary(clicks(t, "signup"))


BUFFER_TIMEOUT = """
WITH RECURSIVE i AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events),
f(user_id, p, start, n, window_id) AS (
  SELECT user_id, p, us, 1::BIGINT, 0::BIGINT FROM i WHERE p = 1
  UNION ALL SELECT f.user_id, i.p, CASE WHEN f.n >= 3 OR i.us >= f.start + 21600000000 THEN i.us ELSE f.start END,
    CASE WHEN f.n >= 3 OR i.us >= f.start + 21600000000 THEN 1 ELSE f.n + 1 END, CASE WHEN f.n >= 3 OR i.us >= f.start + 21600000000 THEN f.window_id + 1 ELSE f.window_id END
  FROM f JOIN i ON i.user_id = f.user_id AND i.p = f.p + 1)
SELECT user_id, window_id, count(*) AS n FROM f GROUP BY ALL
"""


@query(BUFFER_TIMEOUT)
def buffer_timeout(spark, t):
    return events(t).group_by("user_id").buffer_timeout(3, 6 * 3600)


@query("""
WITH RECURSIVE i AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events),
f(user_id, p, start, n, window_id, own) AS (
  SELECT user_id, 0::BIGINT, us, 0::BIGINT, 0::BIGINT, -1::BIGINT FROM i WHERE p = 1
  UNION ALL SELECT user_id, p, CASE WHEN n2 >= 3 THEN us ELSE s2 END, CASE WHEN n2 >= 3 THEN 0 ELSE n2 END, CASE WHEN n2 >= 3 THEN w2 + 1 ELSE w2 END, w2
  FROM (SELECT f.user_id, i.p, i.us, f.start + (i.us - f.start) // 21600000000 * 21600000000 AS s2, f.window_id + (i.us - f.start) // 21600000000 AS w2,
          1 + CASE WHEN (i.us - f.start) // 21600000000 > 0 THEN 0 ELSE f.n END AS n2 FROM f JOIN i ON i.user_id = f.user_id AND i.p = f.p + 1))
SELECT user_id, own AS window_id, count(*) AS n FROM f WHERE p > 0 GROUP BY ALL
""")
def window_timeout(spark, t):
    return events(t).group_by("user_id").window_timeout(3, 6 * 3600, restart=True).per_window()


# Folds in opaque code, whose parts combine.

MODULUS = 1_000_003


def composed(a, b):
    """First x -> a[0] * x + a[1], then b."""
    return a[0] * b[0] % MODULUS, (b[0] * a[1] + b[1]) % MODULUS


def composed_rows(frame):
    from functools import reduce

    return reduce(composed, zip(frame["c0"].tolist(), frame["c1"].tolist(), strict=True), (1, 0))


AFFINE = """list_reduce(list({'p': user_id % 1000003, 'q': event_id % 1000003} ORDER BY event_id),
    lambda x, y: {'p': x.p * y.p % 1000003, 'q': (y.p * x.q + y.q) % 1000003})"""


@query(f"WITH f AS (SELECT {AFFINE} AS m FROM events) SELECT m.p::BIGINT AS p, m.q::BIGINT AS q FROM f")
def fold_chunks(spark, t):
    """The composition of a linear map for each event, in order: associative, not commutative."""
    return events(t).fold_chunks([F.col("user_id") % MODULUS, F.col("event_id") % MODULUS], composed_rows, composed, lambda s: {"p": s[0], "q": s[1]}, "p long, q long")


@query(f"WITH f AS (SELECT event_type, {AFFINE} AS m FROM events GROUP BY event_type) SELECT event_type, m.p::BIGINT AS p, m.q::BIGINT AS q FROM f")
def fold_chunks_by_key(spark, t):
    seq = events(t).group_by("event_type")
    return seq.fold_chunks([F.col("user_id") % MODULUS, F.col("event_id") % MODULUS], composed_rows, composed, lambda s: {"p": s[0], "q": s[1]}, "p long, q long")


def joined_runs(a, b):
    """(first, last, length, length of the first run, of the last run, of the longest run) of two neighbouring parts."""
    if a[1] != b[0]:
        return a[0], b[1], a[2] + b[2], a[3], b[4], max(a[5], b[5])
    middle = a[4] + b[3]
    return a[0], b[1], a[2] + b[2], a[3] + (b[3] if a[3] == a[2] else 0), b[4] + (a[4] if b[4] == b[2] else 0), max(a[5], b[5], middle)


@query("""
WITH g AS (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS island FROM events),
r AS (SELECT event_type, count(*) AS n FROM g GROUP BY event_type, island) SELECT max(n) AS longest, (SELECT count(*) FROM events) AS n FROM r
""")
def fold_longest_run(spark, t):
    """The longest run of one event type in the whole sequence, which no grouping gives without an order."""
    from functools import reduce

    lift = lambda frame: reduce(joined_runs, [(x, x, 1, 1, 1, 1) for x in frame["c0"].tolist()])
    return events(t).fold_chunks([F.col("event_type")], lift, joined_runs, lambda s: {"longest": s[5], "n": s[2]}, "longest long, n long")


@query("""
WITH RECURSIVE i AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events),
f(user_id, p, event_id, x) AS (SELECT user_id, p, event_id, event_id % 1000003 FROM i WHERE p = 1
  UNION ALL SELECT i.user_id, i.p, i.event_id, (7 * f.x + i.event_id) % 1000003 FROM f JOIN i ON i.user_id = f.user_id AND i.p = f.p + 1)
SELECT event_id, x FROM f
""")
def scan_chunks(spark, t):
    """x -> 7 x + event_id modulo a prime, along each user's events: a recurrence that no window function has."""
    import pandas as pd

    def emit(before, frame):
        x, out = 0 if before is None else before[1], []
        for q in frame["c1"].tolist():
            x = (7 * x + q) % MODULUS
            out.append(x)
        return pd.DataFrame({"x": out})

    made = events(t).group_by("user_id").scan_chunks([F.lit(7), F.col("event_id") % MODULUS], composed_rows, composed, emit, "x long")
    return made.df.select("event_id", "x")


@query(ORACLES["handle_by_value"])
def handle_with(spark, t):
    """The same by a function in opaque code."""

    def doubled(row, sink):
        if row["event_type"] != "error":
            sink.next({"doubled": round(row["value"] * 2, 4)})
        if row["value"] > 200 and row["event_type"] == "signup":
            sink.complete()

    return events(t).handle_with(doubled, "doubled double").df.select("event_id", "doubled")


@query("""
WITH g AS (SELECT user_id, event_id, epoch_us(ts) AS us, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM g)
SELECT user_id, min(event_id) AS first_id, max(event_id) AS last_id, count(*) AS n FROM s GROUP BY user_id, run
""")
def flat_map_table(spark, t):
    """Sessions by a table function: how many rows it gives depends on what it has seen."""

    class Sessions:
        def __init__(self):
            self.n = 0

        def eval(self, row):
            if self.n and row["us"] - self.at > 12 * 3_600_000_000:
                yield self.user, self.first, self.last, self.n
                self.n = 0
            if self.n == 0:
                self.user, self.first = row["user_id"], row["event_id"]
            self.n, self.at, self.last = self.n + 1, row["us"], row["event_id"]

        def terminate(self):
            if self.n:
                yield self.user, self.first, self.last, self.n

    seq = events(t)
    timed = seq.with_df(seq.df.select("event_id", "user_id", "ts", seq.micros().alias("us"))).group_by("user_id")
    return timed.flat_map_table(Sessions, "user_id long, first_id long, last_id long, n long", order=["user_id", "first_id"])


@query("""
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority DESC, lower(o_orderstatus), round(o_totalprice, -3) DESC, o_orderdate, o_orderkey) - 1 AS index FROM orders
""")
def sort_by(spark, t):
    fields = By("o_orderpriority").desc(), By("o_orderstatus").ignore_case(), By(F.round("o_totalprice", -3)).desc(), By("o_orderdate")
    return orders(t).sort_by(*fields).index().df.select("o_orderkey", "index")


@query("""
SELECT o_orderpriority, md5(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY length(CAST(o_orderkey AS VARCHAR)) DESC, o_orderkey % 10, o_orderkey)) AS keys_md5 FROM orders GROUP BY o_orderpriority
""")
def collect_sorted_by(spark, t):
    """Lists sorted by a comparator: longer numbers first, then by the last digit."""
    digits = lambda x: F.length(x.cast("string"))
    compare = lambda x, y: F.when(digits(x) != digits(y), digits(y) - digits(x)).otherwise(x % 10 - y % 10)
    lists = orders(t).group_by("o_orderpriority").collect_sorted_by(F.col("o_orderkey"), compare)
    return lists.df.select("o_orderpriority", F.md5(F.array_join(F.col("values").cast("array<string>"), ",")).alias("keys_md5"))


# Time.


@query("""
WITH i AS (SELECT event_id, epoch_us(ts) AS us, row_number() OVER (ORDER BY event_id) - 1 AS p FROM events)
SELECT event_id, (p + 1) * 300000000 + max(us - p * 300000000) OVER (ORDER BY event_id) AS out_us FROM i
""")
def delay_elements(spark, t):
    return events(t).delay_elements(300).df.select("event_id", "out_us")


@query("SELECT event_id, epoch_us(ts) + 90000000 AS out_us FROM events")
def delay_sequence(spark, t):
    return events(t).delay_sequence(90).df.select("event_id", "out_us")


@query("SELECT event_id, max(greatest(epoch_us(ts), epoch_us(ts) + CAST(round(value) AS BIGINT) * 60000000)) OVER (ORDER BY event_id) AS out_us FROM events")
def delay_until(spark, t):
    seq = events(t)
    ready = seq.with_df(seq.df.withColumn("ready", seq.micros() + F.round("value").cast("long") * 60_000_000))
    return ready.delay_until("ready").df.select("event_id", "out_us")


@query("SELECT max(event_id) AS event_id FROM events GROUP BY (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) // 3600000000")
def sample(spark, t):
    return events(t).sample(3600).df.select("event_id")


@query("SELECT event_id FROM events QUALIFY lead(ts) OVER (ORDER BY event_id) IS NULL OR lead(ts) OVER (ORDER BY event_id) > ts + INTERVAL 10 MINUTE")
def sample_timeout(spark, t):
    return events(t).sample_timeout(600).df.select("event_id")


@query("""
WITH RECURSIVE i AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events),
f(user_id, p, event_id, closed, passed) AS (
  SELECT user_id, p, event_id, us + 21600000000, true FROM i WHERE p = 1
  UNION ALL SELECT f.user_id, i.p, i.event_id, CASE WHEN i.us >= f.closed THEN i.us + 21600000000 ELSE f.closed END, i.us >= f.closed FROM f JOIN i ON i.user_id = f.user_id AND i.p = f.p + 1)
SELECT event_id FROM f WHERE passed
""")
def sample_first(spark, t):
    return events(t).group_by("user_id").sample_first(6 * 3600).df.select("event_id")


FOLLOWING = """
WITH RECURSIVE i AS (SELECT event_id, epoch_us(ts) AS us, row_number() OVER (ORDER BY event_id) AS p FROM events),
s AS (SELECT p, least(p + {size}, p + count(*) OVER (ORDER BY us RANGE BETWEEN CURRENT ROW AND 21599999999 FOLLOWING)) AS following FROM i),
o(p) AS (SELECT 1::BIGINT UNION ALL SELECT s.following FROM o JOIN s ON s.p = o.p WHERE s.following <= (SELECT max(p) FROM i))
"""


@query(FOLLOWING.format(size=1_000_000_000_000) + "SELECT event_id FROM o JOIN i USING (p)")
def sample_first_all(spark, t):
    """Without keys: openings of the whole sequence."""
    return events(t).sample_first(6 * 3600).df.select("event_id")


@query(FOLLOWING.format(size=50) + """, w AS (SELECT p AS low, lead(p, 1, 1000000000000) OVER (ORDER BY p) AS high, row_number() OVER (ORDER BY p) - 1 AS window_id FROM o)
SELECT window_id, count(*) AS n FROM w JOIN i ON p >= low AND p < high GROUP BY window_id
""")
def buffer_timeout_all(spark, t):
    return events(t).buffer_timeout(50, 6 * 3600)


@query("SELECT event_id, user_id % 10 > 0 AS hot, round(sum(value) OVER (PARTITION BY user_id % 10 > 0 ORDER BY event_id), 3) AS scan, max(value) OVER (PARTITION BY user_id % 10 > 0 ORDER BY event_id) AS most FROM events")
def scan_hot_key(spark, t):
    """A running sum and maximum where one key has nine tenths of the rows."""
    seq = events(t)
    hot = seq.with_df(seq.df.withColumn("hot", F.col("user_id") % 10 > 0)).group_by("hot")
    both = hot.scan(F.col("value")).scan(F.col("value"), "max", "most")
    return both.df.select("event_id", "hot", F.round("scan", 3).alias("scan"), "most")


@query("""
WITH g AS (SELECT event_id, ts - lag(ts) OVER (ORDER BY event_id) > INTERVAL 15 MINUTE AS late FROM events), c AS (SELECT min(event_id) AS cut FROM g WHERE late)
SELECT event_id FROM events, c WHERE cut IS NULL OR event_id < cut UNION ALL SELECT -1 FROM c WHERE cut IS NOT NULL
""")
def timeout_fallback(spark, t):
    instead = sources.just(spark, -1, schema="event_id long")
    return Seq(t("events").select("event_id", "ts"), "event_id", "ts").timeout(900, fallback=instead).df.select("event_id")


# Errors as data, sharing, rails.


def numbered(t: Tables) -> Seq:
    """Documents whose number (from the text's length) can't be used when it is a multiple of 211."""
    return Seq(t("documents").select("doc_id", (F.length("text") % 1000).cast("long").alias("number")), "doc_id")


BROKEN = "d AS (SELECT doc_id, CAST(length(text) % 1000 AS BIGINT) AS number FROM documents), e AS (SELECT min(doc_id) AS cut FROM d WHERE number % 211 = 0)"


def fails():
    return F.col("number") % 211 == 0


@query(f"WITH {BROKEN} SELECT doc_id, number FROM d, e WHERE cut IS NULL OR doc_id < cut UNION ALL SELECT -1, -1 FROM e WHERE cut IS NOT NULL")
def on_error_return(spark, t):
    return numbered(t).on_error_return(fails(), {"doc_id": -1, "number": -1}).df.select("doc_id", "number")


@query(f"WITH {BROKEN} SELECT doc_id, number FROM d, e WHERE cut IS NULL OR doc_id < cut UNION ALL SELECT d.doc_id + 1000000000, number FROM d, e WHERE cut IS NOT NULL")
def on_error_resume_all(spark, t):
    seq = numbered(t)
    return seq.on_error_resume(fails(), seq.with_df(seq.df.withColumn("doc_id", F.col("doc_id") + 1_000_000_000))).df.select("doc_id", "number")


@query(f"WITH {BROKEN} SELECT doc_id, number FROM d, e WHERE cut IS NULL OR doc_id < cut")
def on_error_complete(spark, t):
    return numbered(t).on_error_complete(fails())


@query(f"WITH {BROKEN} SELECT doc_id, number FROM d WHERE number % 211 <> 0")
def on_error_continue(spark, t):
    return numbered(t).on_error_continue(fails())[0]


@query("SELECT event_id FROM events ORDER BY event_id DESC LIMIT 5")
def replay_last(spark, t):
    return events(t).replay(last=5).connect().reader().df.select("event_id")


@query("SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def replay_ttl(spark, t):
    return events(t).replay(ttl=86_400).reader().df.select("event_id")


@query("SELECT count(*) AS n, (SELECT count(DISTINCT user_id) FROM events) AS users FROM events WHERE value > 10")
def publish_selector(spark, t):
    def twice(shared):
        return shared.filter(F.col("value") > 10).count().df.crossJoin(shared.df.agg(F.countDistinct("user_id").alias("users")))

    return events(t).publish(twice)


@query("SELECT round(sum(l_quantity), 2) AS value FROM lineitem")
def parallel_reduce(spark, t):
    total = Seq(t("lineitem"), "l_orderkey").parallel(4).map(l_quantity=F.col("l_quantity")).reduce("sum", F.col("l_quantity"))
    return total.df.select(F.round("value", 2).alias("value"))


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def parallel_group_count(spark, t):
    rails = Seq(t("nation").select("n_nationkey", "n_regionkey"), "n_nationkey").parallel(3).run_on().filter(F.lit(True))
    return rails.sequential().group_by("n_regionkey").count()


@query("SELECT 'n' || n_nationkey AS a, r_name AS b FROM (FROM nation ORDER BY n_nationkey LIMIT 1), (FROM region ORDER BY r_regionkey LIMIT 1)")
def mono_zip(spark, t):
    one = Seq(t("nation"), "n_nationkey").next()
    other = Seq(t("region"), "r_regionkey").next()
    both = sources.zip_values(one, other)
    return both.df.select(F.concat(F.lit("n"), F.col("z0.n_nationkey").cast("string")).alias("a"), F.col("z1.r_name").alias("b"))


@query("SELECT epoch_us(date_trunc('hour', ts)) AS window_us, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(spark, t):
    """Rows of each hour through a stream that is read to its end."""
    from braidwork.streaming import run_available, tumbling_counts

    return run_available(spark, t.path("events"), lambda s: tumbling_counts(s, "ts", "1 hour", "0 seconds"), "complete")


MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"


@query(ORACLES["sample_first"])
def stream_sample_first(spark, t):
    from braidwork.streaming import run_available, sample_first

    found = run_available(spark, t.path("events"), lambda s: sample_first(s.select("event_id", "user_id", F.expr(MICROS).alias("us")), ["user_id"], "us", 6 * 3_600_000_000))
    return found.select("event_id")


@query(BUFFER_TIMEOUT)
def stream_buffer_timeout(spark, t):
    from braidwork.streaming import buffer_timeout as buffered
    from braidwork.streaming import run_available

    found = run_available(spark, t.path("events"), lambda s: buffered(s.select("event_id", "user_id", F.expr(MICROS).alias("us")), ["user_id"], "us", 3, 6 * 3_600_000_000))
    return found.groupBy("user_id", "window_id").agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id), 3) AS scan FROM events")
def stream_scan(spark, t):
    from braidwork.streaming import run_available, scan_sum

    found = run_available(spark, t.path("events"), lambda s: scan_sum(s.select("event_id", "user_id", "value"), ["user_id"], "value", "event_id"))
    return found.select("event_id", "user_id", F.round("scan", 3).alias("scan"))


# Keyed and unkeyed forms, delayed errors, overflow.


@query("""
WITH o AS (SELECT event_id AS outer_id, ts, lead(ts) OVER (ORDER BY ts, event_id) AS until FROM events WHERE event_type = 'view')
SELECT outer_id, event_id FROM o JOIN events e ON e.event_type = 'click' AND e.ts >= o.ts AND (o.until IS NULL OR e.ts < o.until)
""")
def switch_map_all(spark, t):
    outer = Seq(t("events").where("event_type = 'view'").select(F.col("event_id").alias("outer_id"), F.col("ts").alias("outer_ts")), "outer_id", "outer_ts")
    return outer.switch_map(Seq(t("events").where("event_type = 'click'").select("event_id", "ts"), "event_id", "ts")).df.select("outer_id", "event_id")


@query(ORACLES["switch_map"])
def switch_on_next(spark, t):
    outer = Seq(t("events").where("event_type = 'view'").select(F.col("event_id").alias("outer_id"), "user_id", F.col("ts").alias("outer_ts")), "outer_id", "outer_ts", ["user_id"])
    return outer.switch_on_next(Seq(t("events").where("event_type = 'click'").select("event_id", "user_id", "ts"), "event_id", "ts"), on="user_id").df.select("outer_id", "event_id")


@query("""
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS signal_pos, 'NEXT' AS type, event_type AS value, NULL::VARCHAR AS error FROM events
UNION ALL SELECT user_id, count(*), 'COMPLETE', NULL, NULL FROM events GROUP BY user_id
""")
def materialize_by_key(spark, t):
    return events(t, keys=("user_id",)).materialize("event_type").df.select("user_id", "signal_pos", "type", "value", "error")


@query("""
WITH g AS (SELECT user_id, event_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) > INTERVAL 1 DAY AS late FROM events),
c AS (SELECT user_id, min(event_id) AS cut FROM g WHERE late GROUP BY user_id)
SELECT user_id, event_id FROM events LEFT JOIN c USING (user_id) WHERE cut IS NULL OR event_id < cut UNION ALL SELECT user_id, -user_id FROM c
""")
def timeout_by_key(spark, t):
    users = t("events").select("user_id").distinct()
    instead = Seq(users.select("user_id", (-F.col("user_id")).alias("event_id")), "event_id", keys=["user_id"])
    return Seq(t("events").select("event_id", "user_id", "ts"), "event_id", "ts", ["user_id"]).timeout(86_400, fallback=instead).df.select("user_id", "event_id")


@query("WITH RECURSIVE g(n, s) AS (SELECT 0::BIGINT, ((SELECT count(*) FROM orders) % 7919 + 1)::BIGINT UNION ALL SELECT n + 1, s * 5 % 7919 FROM g WHERE n < 150) SELECT n AS seq, s AS value FROM g")
def source_generate_long(spark, t):
    return sources.generate(spark, f"CAST({t('orders').count() % 7919 + 1} AS BIGINT)", "state * 5 % 7919", until="n > 150")


HALVES = """
d AS (SELECT doc_id, doc_id % 2 AS half, CASE WHEN length(text) % 97 = 5 THEN 'bad' END AS error FROM documents),
c AS (SELECT half, min(doc_id) AS cut FROM d WHERE error IS NOT NULL GROUP BY half),
k AS (SELECT doc_id, half AS source_ord, error FROM d LEFT JOIN c USING (half) WHERE cut IS NULL OR doc_id <= cut)
"""


def halves(t: Tables) -> list[Seq]:
    docs = t("documents").select("doc_id", F.when(F.length("text") % 97 == 5, "bad").alias("error"))
    return [Seq(docs.where(F.col("doc_id") % 2 == i), "doc_id") for i in (0, 1)]


def delayed(seq: Seq) -> DataFrame:
    """Places of the merged rows: errors are last."""
    return seq.index().df.select("doc_id", F.col("source_ord").cast("long").alias("source_ord"), "error", "index")


@query(f"WITH {HALVES} SELECT doc_id, source_ord, error, row_number() OVER (ORDER BY error IS NOT NULL, source_ord, doc_id) - 1 AS index FROM k")
def concat_delay_error(spark, t):
    one, two = halves(t)
    return delayed(one.concat_delay_error(two, error=F.col("error")))


@query(f"WITH {HALVES} SELECT doc_id, source_ord, error, row_number() OVER (ORDER BY error IS NOT NULL, source_ord, doc_id) - 1 AS index FROM k")
def merge_delay_error(spark, t):
    one, two = halves(t)
    return delayed(one.merge_delay_error(two, error=F.col("error")))


@query(f"WITH {HALVES} SELECT doc_id, source_ord, error, row_number() OVER (ORDER BY error IS NOT NULL, CASE WHEN error IS NULL THEN doc_id END, source_ord, doc_id) - 1 AS index FROM k")
def merge_comparing_delay_error(spark, t):
    one, two = halves(t)
    return delayed(one.merge_comparing_delay_error(two, by=["doc_id"], error=F.col("error")))


@query("SELECT doc_id, CASE WHEN length(text) % 97 = 5 THEN 'bad' END AS error, CASE WHEN length(text) % 97 = 5 THEN NULL ELSE i END AS value FROM documents, range(0, 2) r(i) WHERE length(text) % 97 IS DISTINCT FROM 5 OR i = 0")
def flat_map_delay_error(spark, t):
    seq = Seq(t("documents").select("doc_id", "text"), "doc_id")
    fails = F.when(F.length("text") % 97 == 5, "bad")
    return seq.flat_map_delay_error(F.array(F.lit(0).cast("long"), F.lit(1).cast("long")), fails).df.select("doc_id", "error", "value")


@query(ORACLES["sample_first"])
def on_backpressure_drop(spark, t):
    return events(t).group_by("user_id").on_backpressure_drop(6 * 3600).df.select("event_id")


@query("""
WITH i AS (SELECT user_id, event_id, epoch_us(ts) AS us, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) * 21600000000 AS d FROM events)
SELECT event_id, max(us - d) OVER (PARTITION BY user_id ORDER BY event_id) + d AS out_us FROM i
""")
def on_backpressure_buffer(spark, t):
    return events(t).group_by("user_id").on_backpressure_buffer(6 * 3600).df.select("event_id", "out_us")


@query("""
WITH RECURSIVE i AS (SELECT user_id, event_id, epoch_us(ts) AS us, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) AS following, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events),
f(user_id, p, event_id, free, taken) AS (
  SELECT user_id, p, event_id, us + 21600000000, us FROM i WHERE p = 1
  UNION ALL SELECT f.user_id, i.p, i.event_id,
    CASE WHEN i.us < f.free AND i.following <= f.free THEN f.free ELSE greatest(i.us, f.free) + 21600000000 END,
    CASE WHEN i.us < f.free AND i.following <= f.free THEN NULL ELSE greatest(i.us, f.free) END
  FROM f JOIN i ON i.user_id = f.user_id AND i.p = f.p + 1)
SELECT event_id, taken AS out_us FROM f WHERE taken IS NOT NULL
""")
def on_backpressure_latest(spark, t):
    return events(t).group_by("user_id").on_backpressure_latest(6 * 3600).df.select("event_id", "out_us")


# What surrounds a plan: hooks, names, boundaries and shared plans leave its rows alone.


def called(spark: SparkSession, calls: dict[str, int], *named) -> DataFrame:
    """(hook, calls), and the same of accumulators, filled by rows on the executors."""
    rows = [*calls.items(), *((name, seen.value) for name, seen in named)]
    return spark.createDataFrame(rows, "hook string, calls long")


@query("""
SELECT * FROM (VALUES ('first', 2), ('subscribe', 1), ('complete', 2), ('terminate', 1), ('after_terminate', 1), ('finally', 2), ('error', 0), ('cancel', 0), ('mapped', 0)) v(hook, calls)
UNION ALL SELECT 'next', count(*) FROM events UNION ALL SELECT 'each', count(*) FROM events WHERE event_type = 'click' UNION ALL SELECT 'metrics', count(*) FROM events WHERE event_type = 'click'
""")
def peeked(spark, t):
    """What each hook of a run that completes was called, driver's hooks and those of rows."""
    calls = dict.fromkeys(("first", "subscribe", "complete", "terminate", "after_terminate", "finally", "error", "cancel", "mapped"), 0)
    nexts, each = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def count(kind):
        def hook(*_):
            calls[kind] += 1

        return hook

    def of_each(kind, row):
        if kind == "next":
            each.add(row is not None)
        else:
            calls[kind] += 1

    seq = events(t).do_on_next(lambda row: nexts.add(1)).filter(F.col("event_type") == "click").do_on_each(of_each)
    seq = seq.do_first(count("first")).do_first(count("first")).do_on_subscribe(count("subscribe")).do_on_complete(count("complete")).do_on_terminate(count("terminate"))
    seq = seq.do_after_terminate(count("after_terminate")).do_finally(count("finally")).do_finally(count("finally")).do_on_error(count("error")).do_on_cancel(count("cancel"))
    seq, seen = seq.on_error_map(lambda e: count("mapped")(e) or e).name("peeked").tag("kind", "test").metrics()
    seq.then()
    calls["metrics"] = seen.get["rows"]
    return called(spark, calls, ("next", nexts), ("each", each))


@query("""
SELECT * FROM (VALUES ('error', 1), ('terminate', 1), ('finally', 1), ('complete', 0), ('mapped', 1), ('noted', 1)) v(hook, calls)
UNION ALL SELECT 'failures', count(*) FROM events WHERE value = (SELECT max(value) FROM events)
""")
def peeked_failure(spark, t):
    """The hooks of a run that fails at the rows with the largest value."""
    calls = dict.fromkeys(("error", "terminate", "finally", "complete", "mapped", "noted"), 0)

    def count(kind):
        def hook(*_):
            calls[kind] += 1

        return hook

    seq = events(t)
    most = seq.df.agg(F.max("value").alias("_most"))
    marked = seq.with_df(seq.df.crossJoin(F.broadcast(most)))  # one row
    failing = marked.on_error_stop().map(value=F.when(F.col("value") == F.col("_most"), F.raise_error(F.lit("too large")).cast("double")).otherwise(F.col("value")))
    failing = failing.checkpoint("in the middle").do_on_error(count("error")).do_on_terminate(count("terminate")).do_finally(count("finally")).do_on_complete(count("complete"))
    failing = failing.on_error_map(lambda e: count("mapped")(e) or RuntimeError("translated"))
    try:
        failing.then()
    except RuntimeError as error:
        calls["noted"] += str(error) == "translated" and "in the middle" in "".join(getattr(error.__cause__, "__notes__", []))
    calls["failures"] = marked.df.where("value = _most").count()
    return called(spark, calls)


@query("SELECT user_id, count(*) AS n, 4 AS partitions, 'click' AS kind FROM events WHERE event_type = 'click' AND value > 10 GROUP BY user_id")
def bounded(spark, t):
    """Boundaries, and functions of sequences: each does a part of what the result shows."""
    first = events(t, "value < 0").repeat_when_empty(lambda: events(t)).context_write(kind="view").context_capture({"kind": "click"})
    of_kind = first.transform_deferred_contextual(lambda s, context: s.filter(F.col("event_type") == context.get("kind")).map(kind=F.lit(context.get("kind")), user_id=F.col("user_id"), value=F.col("value")))()
    large = of_kind.transform_deferred(lambda s: s.filter(F.col("value") > 10))()
    dealt = large.publish_on(4)
    parts = dealt.with_df(dealt.df.withColumn("part", F.spark_partition_id()))
    stored = store(parts.df, "bounded")
    partitions = stored.agg(F.count_distinct("part").cast("int").alias("partitions"))
    counts = parts.with_df(stored).as_(lambda s: s.group_by("user_id").collect(F.count("*").alias("n"), F.first("kind").alias("kind")))
    return counts.df.crossJoin(F.broadcast(partitions))  # one row


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def shared_readers(spark, t):
    shared = events(t).share()
    counted = store(shared.reader().group_by("event_type").count().df, "shared")
    shared.release()
    return counted


@query("SELECT event_id FROM events ORDER BY event_id LIMIT 1")
def share_next(spark, t):
    return events(t).share_next().reader().df.select("event_id")


@query("SELECT count(*) AS n FROM events")
def cached(spark, t):
    cache = events(t).cache_invalidate_when(lambda: False)
    counted = store(cache.get().count().df, "cached")
    cache.invalidate()
    return counted


@query("""
SELECT * FROM (VALUES ('subscribe', 1), ('complete', 2), ('terminate', 1), ('after_terminate', 1), ('error', 0), ('cancel', 0)) v(hook, calls)
UNION ALL SELECT 'next', count(*) FROM lineitem UNION ALL SELECT 'each', count(*) FROM lineitem WHERE l_quantity < 10
""")
def rails_with_hooks(spark, t):
    calls = dict.fromkeys(("subscribe", "complete", "terminate", "after_terminate", "error", "cancel"), 0)
    nexts, each = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def count(kind):
        def hook(*_):
            calls[kind] += 1

        return hook

    def of_each(kind, row):
        if kind == "next":
            each.add(1)
        else:
            calls[kind] += 1

    rails = Seq(t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey", "l_linenumber"]).parallel(3).name("rails").tag("a", "b").checkpoint("rails")
    rails = rails.do_on_next(lambda row: nexts.add(1)).filter(F.col("l_quantity") < 10).do_on_each(of_each)
    rails = rails.do_on_error(count("error")).do_on_complete(count("complete")).do_on_subscribe(count("subscribe")).do_on_terminate(count("terminate"))
    rails = rails.do_after_terminate(count("after_terminate")).do_on_cancel(count("cancel")).transform(lambda r: r)
    rails.then()
    return called(spark, calls, ("next", nexts), ("each", each))


@query("SELECT n_nationkey, i AS value FROM nation, range(0, 2) r(i)")
def rails_flat_map(spark, t):
    rails = Seq(t("nation").select("n_nationkey"), "n_nationkey").parallel(3).flat_map(F.array(F.lit(0).cast("long"), F.lit(1).cast("long")))
    return rails.sequential().df.select("n_nationkey", "value")


@query("SELECT sum(n_nationkey) AS total, count(*) AS n FROM nation")
def rails_collect(spark, t):
    of_rail = Seq(t("nation").select("n_nationkey"), "n_nationkey").parallel(3).collect(F.sum("n_nationkey").alias("total"), F.count("*").alias("n"))
    return of_rail.df.agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


@query("SELECT sum(n_nationkey) AS total FROM nation")
def rails_groups(spark, t):
    groups = Seq(t("nation").select("n_nationkey"), "n_nationkey").parallel(3).groups().reduce("sum", F.col("n_nationkey"), "total")
    return groups.df.agg(F.sum("total").alias("total"))


@query("SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_name) - 1 AS index FROM nation")
def rails_sorted(spark, t):
    return Seq(t("nation").select("n_nationkey", "n_name"), "n_nationkey").parallel(3).sorted("n_name").index().df.select("n_nationkey", "n_name", "index")


@query("SELECT n_nationkey, n_nationkey * 2 AS twice, length(n_name) AS size FROM nation")
def zip_when(spark, t):
    seq = Seq(t("nation"), "n_nationkey").zip_when("made", twice=F.col("n_nationkey") * 2, size=F.length("n_name").cast("long"))
    return seq.df.select("n_nationkey", "made.twice", "made.size")


@query("SELECT count(*) AS n, max(value) AS most FROM events")
def collect_aggregates(spark, t):
    return events(t).collect(F.count("*").alias("n"), F.max("value").alias("most"))


# Windows with their rows.


@query("SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 7 AS window_id FROM events")
def window_rows(spark, t):
    return events(t).window(7).df.select("event_id", F.col("window_id").cast("long").alias("window_id"))


@query("SELECT event_id, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS window_id FROM events")
def window_until(spark, t):
    return events(t).window_until(F.col("event_type") == "purchase").df.select("event_id", F.col("window_id").cast("long").alias("window_id"))


@query(f"WITH {ISLANDS} SELECT event_id, window_id::BIGINT AS window_id FROM r")
def window_until_changed(spark, t):
    return events(t).group_by("user_id").window_until_changed(F.col("event_type")).df.select("event_id", F.col("window_id").cast("long").alias("window_id"))


@query("""
SELECT o.event_id AS opening, e.event_id FROM events o JOIN events e ON e.user_id = o.user_id AND e.ts >= o.ts AND e.ts <= o.ts + INTERVAL 1 HOUR WHERE o.event_type = 'signup'
""")
def window_when(spark, t):
    openings = events(t, "event_type = 'signup'")
    return events(t).window_when(openings, 3600, on=["user_id"]).df.select(F.col("l_event_id").alias("opening"), F.col("r_event_id").alias("event_id"))


# More sources.


@query("SELECT row_number() OVER (ORDER BY event_type) - 1 AS seq, count(*) AS value FROM events GROUP BY event_type")
def source_values(spark, t):
    counts = t("events").groupBy("event_type").count().orderBy("event_type")
    made = sources.defer(lambda: sources.from_iterable(spark, (r["count"] for r in counts.collect()), "value long"))  # five rows
    return made().df.select(F.col("seq").cast("long").alias("seq"), "value")


@query("SELECT row_number() OVER (ORDER BY event_type) - 1 AS seq, event_type AS value FROM (SELECT DISTINCT event_type FROM events)")
def source_sink(spark, t):
    sink = sources.sink_many(spark, "value string")
    for row in t("events").select("event_type").distinct().orderBy("event_type").collect():  # five rows
        sink.emit_next(row[0])
    sink.try_emit_complete()
    return sink.as_seq()


@query("SELECT count(*) AS value FROM events")
def source_callable(spark, t):
    return sources.from_callable(spark, lambda: t("events").count(), "value long").df.select("value")


@query("SELECT n_nationkey FROM nation")
def source_using(spark, t):
    with sources.using(lambda: t("nation"), lambda df: Seq(df, "n_nationkey"), lambda df: None) as seq:
        return seq.df.select("n_nationkey")


# More streams.


@query("SELECT epoch_us(s) AS window_us, count(*) AS n FROM events, range(TIMESTAMP '2023-12-31 22:00:00', TIMESTAMP '2024-02-02', INTERVAL 30 MINUTE) r(s) WHERE ts >= s AND ts < s + INTERVAL 1 HOUR GROUP BY s")
def stream_sliding(spark, t):
    from braidwork.streaming import run_available, tumbling_counts

    return run_available(spark, t.path("events"), lambda s: tumbling_counts(s, "ts", "1 hour", "0 seconds", "30 minutes"), "complete")


@query("SELECT DISTINCT user_id FROM events")
def stream_distinct(spark, t):
    from braidwork.streaming import distinct, run_available

    return run_available(spark, t.path("events"), lambda s: distinct(s.select("user_id", "ts"), "ts", "1000 days", ["user_id"])).select("user_id")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM g)
SELECT user_id, count(*) AS n, epoch_us(max(ts)) AS last_us FROM s GROUP BY user_id, run
""")
def stream_sessions(spark, t):
    from braidwork.streaming import run_available, sessions

    found = run_available(spark, t.path("events"), lambda s: sessions(s, "ts", "12 hours", "0 seconds", ["user_id"]), "complete")
    return found.select("user_id", "n", F.unix_micros("last_ts").alias("last_us"))


# These names stand for the whole job, as their twins do.
for _name, _whole in {"sort": "sort_all", "merge_comparing": "merge_comparing_all", "on_error_resume": "on_error_resume_all", "handle": "handle_by_value", "take_while": "take_while_by_value"}.items():
    QUERIES[_name], ORACLES[_name] = QUERIES[_whole], ORACLES[_whole]


# Streams over batches of files that overlap in time.


def overlapping(spark, t):
    """A stream of all events in three batches, each reaching back six days behind the one before; last a row far ahead, which lets the watermark pass the rest."""
    from braidwork.streaming import read_available, replayed

    rows = events(t)
    plain = rows.df.select("event_id", "user_id", "event_type", "ts", "value", rows.micros().alias("us"))
    days = (F.col("us") - F.lit(1_704_067_200_000_000)) / 86_400_000_000
    numbered_ = plain.withColumn("_batch", F.least(F.lit(2), F.greatest(F.lit(0), F.floor((days + F.col("event_id") % 3 * 3) / 12))))
    last = spark.sql("SELECT -1L AS event_id, -1L AS user_id, 'last' AS event_type, TIMESTAMP_NTZ'2100-01-01' AS ts, 0D AS value, 4102444800000000L AS us, 3L AS _batch")
    every = store(numbered_.unionByName(last), "overlapping")
    return read_available(spark, replayed(every, F.col("_batch"), 4), 1).drop("_batch")


HELD = {"ts": "ts", "late": "7 days"}


@query(ORACLES["window_when"])
def stream_window_when(spark, t):
    from braidwork.streaming import run_stream, window_when

    stream = overlapping(spark, t)
    openings = stream.where("event_type = 'signup' OR event_type = 'last'")
    found = run_stream(spark, window_when(openings, overlapping(spark, t), ["user_id"], "ts", "ts", "1 hour", "7 days"))
    return found.where("l_event_id >= 0").select(F.col("l_event_id").alias("opening"), F.col("r_event_id").alias("event_id"))


@query(ORACLES["sample_first"])
def stream_sample_first_held(spark, t):
    from braidwork.streaming import run_stream, sample_first

    found = run_stream(spark, sample_first(overlapping(spark, t), ["user_id"], "us", 6 * 3_600_000_000, **HELD))
    return found.where("event_id >= 0").select("event_id")


@query(ORACLES["window_when"])
def stream_join(spark, t):
    """Pairs of two streams; what can't meet any more leaves the state."""
    from braidwork.streaming import join, run_stream

    stream = overlapping(spark, t)
    openings = stream.where("event_type = 'signup' OR event_type = 'last'").select(F.col("event_id").alias("opening"), F.col("user_id").alias("owner"), F.col("ts").alias("opened"))
    rows = overlapping(spark, t).select("event_id", "user_id", "ts")
    found = run_stream(spark, join(openings, rows, "opened", "ts", "1 hour", "7 days", F.col("owner") == F.col("user_id")))
    return found.where("opening >= 0").select("opening", "event_id")


@query("SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 3 AS window_id FROM events")
def stream_count_windows(spark, t):
    from braidwork.streaming import count_windows, run_stream

    found = run_stream(spark, count_windows(overlapping(spark, t), ["user_id"], "us", 3, **HELD))
    return found.where("event_id >= 0").select("event_id", "window_id")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM g)
SELECT user_id, epoch_us(max(ts)) AS last_us FROM s GROUP BY user_id, run
""")
def stream_inactivity(spark, t):
    from braidwork.streaming import inactivity, run_stream

    found = run_stream(spark, inactivity(overlapping(spark, t), ["user_id"], "ts", "7 days", "12 hours"))
    return found.where("user_id >= 0").select("user_id", F.unix_micros("last_ts").alias("last_us"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts), 3) AS scan FROM events")
def stream_scan_held(spark, t):
    from braidwork.streaming import run_stream, scan_sum

    found = run_stream(spark, scan_sum(overlapping(spark, t), ["user_id"], "value", "us", **HELD))
    return found.where("event_id >= 0").select("event_id", F.round("scan", 3).alias("scan"))


# Sequences with ends.

FIRST_ERROR = "(SELECT min(event_id) FROM events WHERE event_type = 'error' AND value > 20)"


def failing(t: Tables) -> Seq:
    """Events up to the first error with a value above 20, which is the sequence's end."""
    return events(t).ending_at_error(F.when((F.col("event_type") == "error") & (F.col("value") > 20), F.concat(F.lit("event "), F.col("event_id").cast("string"))))


@query(f"SELECT event_id, 0 AS source_ord FROM events WHERE event_id < coalesce({FIRST_ERROR}, 1e18) UNION ALL SELECT event_id, 1 FROM events WHERE {FIRST_ERROR} IS NULL AND event_type = 'click'")
def concat_ended(spark, t):
    """Behind a source that fails nothing comes."""
    return failing(t).concat_ended(events(t, "event_type = 'click'")).df.select("event_id", "source_ord")


@query(f"SELECT event_id, 0 AS source_ord, 'event ' || {FIRST_ERROR} AS error FROM events WHERE event_id < coalesce({FIRST_ERROR}, 1e18) UNION ALL SELECT event_id, 1, 'event ' || {FIRST_ERROR} FROM events WHERE event_type = 'click'")
def concat_ended_delay_error(spark, t):
    """The other source comes all the same; the error is the end of all."""
    both = failing(t).concat_ended_delay_error(events(t, "event_type = 'click'"))
    return both.df.crossJoin(F.broadcast(both.end_signal().select("error"))).select("event_id", "source_ord", "error")  # one row


@query("""
WITH b AS (SELECT min(ts) AS t FROM events WHERE event_type = 'signup'), a AS (SELECT min(ts) AS t FROM events WHERE event_type = 'purchase')
SELECT event_id FROM events, a, b WHERE event_type = 'purchase' AND a.t < b.t UNION ALL SELECT event_id FROM events, a, b WHERE event_type = 'signup' AND b.t <= a.t
""")
def first_with_signal(spark, t):
    """A source without rows that never ends can't win, the earlier of the two others does."""
    never = events(t, "value < 0").never_ending()
    return never.first_with_signal(events(t, "event_type = 'signup'"), events(t, "event_type = 'purchase'")).df.select("event_id")


# Names that had no query.


@query("SELECT event_id, (coalesce(sum(CASE WHEN value > 50 THEN 0 ELSE 1 END) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS window_id, value > 50 AS matched FROM events")
def window_while_rows(spark, t):
    return events(t).window_while(F.col("value") > 50).df.select("event_id", "window_id", "matched")


@query("SELECT event_id, 'purchase' AS wanted FROM events WHERE event_type = 'purchase'")
def defer_contextual(spark, t):
    from braidwork.functions.context import Context

    build = sources.defer_contextual(lambda context: events(t).filter(F.col("event_type") == context.get("wanted")).map(wanted=F.lit(context.get("wanted"))), Context({"wanted": "purchase"}))
    return build().df.select("event_id", "wanted")


@query("SELECT c_custkey FROM customer WHERE c_acctbal < 0 UNION ALL SELECT -count(*) FROM customer")
def then_many(spark, t):
    """The first sequence runs to its end and counts its rows; then the other is given."""
    seen = spark.sparkContext.accumulator(0)
    customers = Seq(t("customer").select("c_custkey", "c_acctbal"), "c_custkey")
    following = customers.do_on_next(lambda row: seen.add(1)).then_many(customers.filter(F.col("c_acctbal") < 0).map())
    return following.df.unionByName(spark.createDataFrame([(-seen.value,)], "c_custkey long"))


@query("SELECT count(*) AS value FROM lineitem")
def from_future(spark, t):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(1) as pool:
        return sources.from_future(spark, pool.submit(lambda: t("lineitem").count()), "value long").df.select("value")


@query("SELECT sum(l_quantity) AS total, count(*) AS n FROM lineitem")
def to_future(spark, t):
    seq = Seq(t("lineitem"), ["l_orderkey", "l_linenumber"]).collect(F.sum("l_quantity").alias("total"), F.count("*").alias("n"))
    return spark.createDataFrame([tuple(r) for r in seq.to_future().result()], "total double, n long")


@query("SELECT 3 AS attempts, count(*) AS n FROM events")
def retry_when(spark, t):
    """The first two attempts to read fail."""
    from braidwork.functions.retry import Retry

    tried = []

    def count(df):
        tried.append(1)
        if len(tried) < 3:
            raise OSError("not yet")
        return df.count()

    n = events(t).retry_when(Retry.fixed_delay(5, 0.01).filter(lambda e: isinstance(e, OSError))).run(count)
    return spark.createDataFrame([(len(tried), n)], "attempts int, n long")


@query("SELECT i::INTEGER AS round, count(*) AS n FROM events, range(0, 3) r(i) GROUP BY i")
def repeat_when(spark, t):
    from braidwork.functions.retry import Repeat

    counts = events(t).repeat_when(Repeat.of(2), lambda df: df.count())
    return spark.createDataFrame(list(enumerate(counts)), "round int, n long")


@query("SELECT n_regionkey AS key, count(*) AS n FROM nation GROUP BY n_regionkey")
def transform_groups(spark, t):
    """Opaque code over each rail's batches."""

    def doubled(frames):
        for frame in frames:
            yield frame.assign(key=frame["n_regionkey"])[["n_nationkey", "key"]]

    rails = Seq(t("nation").select("n_nationkey", "n_regionkey"), "n_nationkey").parallel(3).transform_groups(doubled, "n_nationkey int, key int")
    return rails.sequential().group_by("key").count()


@query("SELECT min(event_id) AS event_id FROM events WHERE event_type = 'purchase'")
def publish_next(spark, t):
    shared = events(t, "event_type = 'purchase'").publish_next()
    first = store(shared.reader().df.select("event_id"), "next")
    shared.release()
    return first


@query("SELECT * FROM (VALUES ('released', 1), ('failed', 0)) v(what, n) UNION ALL SELECT 'rows', count(*) FROM supplier")
def using_when(spark, t):
    said = {"released": 0, "failed": 0}
    with sources.using_when(lambda: t("supplier"), lambda df: Seq(df, "s_suppkey"), lambda df: said.update(released=said["released"] + 1), lambda df, error: said.update(failed=1)) as seq:
        said["rows"] = seq.count().df.first()[0]
    return spark.createDataFrame(list(said.items()), "what string, n long")


@query("SELECT 'several sequences failed' AS said, 2 AS failures, count(*) AS n FROM events")
def when_delay_error(spark, t):
    """Three sequences side by side: two fail, the third is read to its end."""
    from braidwork.operators.control import when_delay_error as wait

    seen = spark.sparkContext.accumulator(0)
    fails = lambda name: events(t).error_if(F.col("event_id") == 5, name)
    try:
        wait(fails("one"), events(t).do_on_next(lambda row: seen.add(1)), fails("two"))
    except ExceptionGroup as group:
        return spark.createDataFrame([(group.message, len(group.exceptions), seen.value)], "said string, failures int, n long")


@query("SELECT event_type, count(*) AS n, 1 AS computed FROM events GROUP BY event_type")
def cache_invalidate_if(spark, t):
    """Kept while the test says that it is fresh, computed anew once it is stale."""
    fresh = [False, True]
    cache = events(t).cache_invalidate_if(lambda: fresh.pop(0) if fresh else False)
    one, two = cache.get().count().df.first()[0], cache.get().count().df.first()[0]
    counted = store(cache.get().group_by("event_type").count().df.withColumn("computed", F.lit(int(one == two and not fresh))), "cached-if")
    cache.invalidate()
    return counted


@query("SELECT count(*) AS n, sum(o_totalprice) > 0 AS any FROM orders")
def subscribe_with(spark, t):
    """Partitions' rows go to a sink on the executors."""
    seen = spark.sparkContext.accumulator(0)

    def sink(rows):
        for _ in rows:
            seen.add(1)

    orders(t).subscribe_with(sink)
    return spark.createDataFrame([(seen.value, True)], "n long, any boolean")


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS at, p_partkey FROM part WHERE p_size = 7")
def to_iterable(spark, t):
    """Rows to the driver in order, a partition at a time."""
    parts = Seq(t("part").where("p_size = 7").select("p_partkey"), "p_partkey")
    return spark.createDataFrame([(i, r[0]) for i, r in enumerate(parts.to_iterable())], "at long, p_partkey long")


@query("""
WITH RECURSIVE i AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events),
f(user_id, p, event_id, free, taken) AS (
  SELECT user_id, p, event_id, us + 43200000000, us FROM i WHERE p = 1
  UNION ALL SELECT f.user_id, i.p, i.event_id,
    CASE WHEN f.free <= i.us THEN i.us + 43200000000 WHEN f.free > i.us + 2 * 43200000000 THEN f.free ELSE f.free + 43200000000 END,
    CASE WHEN f.free <= i.us THEN i.us WHEN f.free > i.us + 2 * 43200000000 THEN NULL ELSE f.free END
  FROM f JOIN i ON i.user_id = f.user_id AND i.p = f.p + 1)
SELECT event_id, taken AS out_us FROM f WHERE taken IS NOT NULL
""")
def on_backpressure_buffer_sized(spark, t):
    """Twelve hours a row and two places to wait; what finds none goes."""
    return events(t).group_by("user_id").on_backpressure_buffer(12 * 3600, 2, "drop").df.select("event_id", "out_us")


@query("""
WITH e AS (SELECT event_id, ts, CASE event_type WHEN 'click' THEN 0 ELSE 1 END AS source_ord, CASE WHEN value > 150 THEN 'large' END AS error FROM events WHERE event_type IN ('click', 'view')),
c AS (SELECT source_ord, min(event_id) AS cut FROM e WHERE error IS NOT NULL GROUP BY source_ord)
SELECT event_id, error, row_number() OVER (ORDER BY error IS NOT NULL, ts, source_ord, event_id) - 1 AS index FROM e LEFT JOIN c USING (source_ord) WHERE cut IS NULL OR event_id <= cut
""")
def merge_delay_error_by_time(spark, t):
    """Rows of two sources by their times; a source ends at its first large value, and what failed comes last."""
    sides = [events(t, f"event_type = '{kind}'") for kind in ("click", "view")]
    marked = [s.with_df(s.df.select("event_id", "ts", F.when(F.col("value") > 150, "large").alias("error"))) for s in sides]
    merged = marked[0].merge_delay_error(marked[1], error=F.col("error"))
    return merged.index().df.select("event_id", "error", "index")
