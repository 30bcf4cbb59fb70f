"""Marketplace views over the generic star-schema and event tables.

Each function returns the DataFrame an operator family expects; `SQL` below holds the same
view as text for the SQL check. Small cartesian parts (steps, arms, days) are explodes here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farewise.functions.scalars import ntz

EPOCH = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def after_epoch(seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds.cast("int"), ntz(EPOCH))


def trips(spark: SparkSession, sf_dir: str, line: DataFrame | None = None) -> DataFrame:
    """24-column trip records, one per order line; `line` may be a stream of order lines."""
    line = table(spark, sf_dir, "lineitem") if line is None else line
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    price, number = F.col("l_extendedprice"), F.col("l_linenumber")
    minutes = F.col("l_quantity").cast("bigint")
    yes_no = F.when(F.col("l_linestatus") == "O", " y ").otherwise("n")
    # Line columns are derived below the joins, so that nothing above repeats the work.
    lines = line.select(
        "l_orderkey",
        "l_suppkey",
        F.when(F.col("l_returnflag") == "R", "HV0003").when(F.col("l_returnflag") == "A", "HV0005")
        .otherwise("HV0004").alias("hvfhs_license_num"),
        F.when(number == 5, "UNKNOWN").otherwise(yes_no).alias("shared_request_flag"),
        F.when(number == 1, F.lit(None)).otherwise(yes_no).alias("shared_match_flag"),
        F.lit("N").alias("access_a_ride_flag"),
        F.when(F.col("l_tax") > 0.07, "Y").otherwise("N").alias("wav_request_flag"),
        F.when(F.col("l_tax") > 0.07, "y").otherwise("N").alias("wav_match_flag"),
        (((F.col("l_partkey") * 7 + F.col("l_suppkey") * 13) % 1440) * 60).alias("day_seconds"),
        (F.col("l_partkey") % 97 != 0).alias("has_pickup"),
        ((1 - F.col("l_suppkey") % 20) * 30).cast("int").alias("request_offset"),
        number.alias("number"),
        (minutes * 60 + F.when(number == 3, 90).otherwise(0)).alias("trip_time"),
        minutes.cast("int").alias("minutes"),
        F.when((number == 4) & (F.col("l_discount") == 0), -1.0).otherwise(F.col("l_quantity") * 0.4).alias("trip_miles"),
        (F.when(F.col("l_discount") >= 0.1, -price).otherwise(price) / 1000).alias("base_passenger_fare"),
        F.when(number != 2, F.col("l_tax")).alias("tolls"),
        (price / 50000).alias("bcf"),
        (price / 20000).alias("sales_tax"),
        (F.col("l_discount") * 10).alias("tips"),
        (price * (1 - F.col("l_discount")) / 1000).alias("driver_pay"),
    )
    placed = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.col("c_nationkey").alias("PULocationID"), ((F.col("o_orderkey") % 31) * 86400).alias("day_start"),
        F.concat(F.lit("B"), F.col("c_nationkey").cast("string")).alias("origin_base"),
        F.when(F.col("c_nationkey") < 3, 2.75).otherwise(0.0).alias("congestion_surcharge"),
    )
    joined = lines.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
    timed = joined.withColumn("pu", after_epoch(F.col("day_start") + F.col("day_seconds"))).select(
        "*", F.when(F.col("has_pickup"), F.col("pu")).alias("pickup_datetime")
    )
    return timed.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        "hvfhs_license_num",
        F.concat(F.lit("B"), F.col("s_nationkey").cast("string")).alias("dispatching_base_num"),
        F.when(F.col("number") != 7, F.col("origin_base")).alias("originating_base_num"),
        "shared_request_flag", "shared_match_flag", "access_a_ride_flag", "wav_request_flag", "wav_match_flag",
        F.timestamp_add("SECOND", F.col("request_offset"), F.col("pu")).alias("request_datetime"),
        F.timestamp_add("SECOND", F.lit(-15), F.col("pu")).alias("on_scene_datetime"),
        "pickup_datetime",
        F.timestamp_add("MINUTE", F.col("minutes"), F.col("pu")).alias("dropoff_datetime"),
        "PULocationID",
        (F.col("s_nationkey") + F.when(F.col("number") == 6, 100).otherwise(0)).alias("DOLocationID"),
        "trip_time", "trip_miles", "base_passenger_fare", "tolls", "bcf", "sales_tax", "congestion_surcharge",
        F.when(F.col("s_nationkey") == 1, 2.5).otherwise(0.0).alias("airport_fee"),
        "tips", "driver_pay",
    )


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("LocationID"),
        F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("Borough"),
        F.col("n_name").alias("Zone"),
        F.lit("Boro Zone").alias("service_zone"),
    )


def choice_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session counts per (zone, day, four-hour slot) with hash-assigned price multipliers."""
    kind = F.col("event_type")
    blocks = (
        table(spark, sf_dir, "events")
        .select(
            (F.col("user_id") % 5).alias("zone_id"),
            F.to_date("ts").alias("day_id"),
            (F.floor(F.hour("ts") / 4) * 4).cast("int").alias("hr"),
            "event_type",
        )
        .groupBy("zone_id", "day_id", "hr")
        .agg(
            F.count(F.lit(1)).alias("n_sessions"),
            F.count_if(kind.isin("click", "signup")).alias("n_x"),
            F.count_if(kind == "purchase").alias("n_y"),
            F.count_if(kind.isin("view", "error")).alias("n_none"),
        )
    )
    digest = F.md5(F.concat_ws("-", *[F.col(c).cast("string") for c in ("zone_id", "day_id", "hr")]))

    def level(i: int) -> Column:
        h = F.substring("h", i, 1)
        return F.when(h < "5", 0.9).when(h < "a", 1.0).otherwise(1.1)

    return blocks.withColumn("h", digest).withColumns({"multiplier_x": level(1), "multiplier_y": level(2)})


def state_changes(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    kind = F.col("event_type")
    events = table(spark, sf_dir, "events") if events is None else events
    return events.select(
        F.col("user_id").alias("vehicle_id"),
        "event_id",
        "ts",
        F.when(kind == "view", "idle").when(kind == "click", "dispatch").when(kind == "signup", "to_pickup")
        .when(kind == "purchase", "on_trip").otherwise("offline").alias("state"),
    )


def requests(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """One ride request per order, with its origin zone and the state it ends in."""
    orders = table(spark, sf_dir, "orders") if orders is None else orders
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    third = key % 3 == 0
    return orders.select(
        key.alias("request_id"),
        (F.col("o_custkey") % 100).alias("vehicle_id"),
        F.when(key % 2 == 0, "X").otherwise("Y").alias("service_id"),
        (F.col("o_custkey") % 25).alias("origin_zone_id"),
        after_epoch((key % 43200) * 60).alias("created_at"),
        F.when(status == "F", "completed")
        .when(status == "P", F.when(third, "expired").otherwise("canceled"))
        .otherwise(F.when(third, "queued").otherwise("on_trip")).alias("final_state"),
    )


def request_events(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """State log of each request: created, queued, assigned, on_trip, then one terminal state."""
    names = ["created", "queued", "assigned", "on_trip", "completed", "canceled", "expired"]
    step = F.posexplode(F.array(*[F.lit(n) for n in names])).alias("position", "state")
    steps = requests(spark, sf_dir, orders).select("*", step).withColumn("step", F.col("position") + 1)
    reached = (
        (F.col("step") <= 2)
        | (F.col("step").isin(3, 4) & F.col("final_state").isin("completed", "on_trip"))
        | ((F.col("step") >= 5) & (F.col("state") == F.col("final_state")))
    )
    offset = (F.col("step") - 1) * (60 + F.col("request_id") % 240)
    return steps.filter(reached).select(
        "request_id",
        "service_id",
        "created_at",
        "state",
        "step",
        F.timestamp_add("SECOND", offset.cast("int"), F.col("created_at")).alias("event_ts"),
        F.when(F.col("step").between(3, 5), F.col("vehicle_id")).alias("vehicle_id"),
    )


def driver_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_suppkey").cast("string")).alias("offer_key"),
        F.col("l_orderkey").alias("request_id"),
        F.col("l_suppkey").alias("vehicle_id"),
        after_epoch((F.col("l_partkey") % 43200) * 60).alias("offered_at"),
        F.col("l_quantity").cast("bigint").alias("response_seconds"),
        F.when(flag == "R", "accepted").when(flag == "A", "rejected")
        .when(F.col("l_linestatus") == "O", "timed_out").otherwise("withdrawn").alias("state"),
    )


def driver_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete driver x day cohort over the event calendar, zero days included."""
    events = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day_id"))
    worked = events.groupBy("user_id", "day_id").agg(F.count(F.lit(1)).alias("n"))
    calendar = worked.agg(F.sequence(F.min("day_id"), F.max("day_id")).alias("days")).scalar()
    drivers = worked.select("user_id").distinct()
    cohort = drivers.withColumn("day_id", F.explode(calendar))
    hours = F.least(F.lit(8.0), F.coalesce("n", F.lit(0)) * 0.75)
    return cohort.join(worked, ["user_id", "day_id"], "left").select(
        F.col("user_id").alias("driver_id"),
        "day_id",
        F.when(F.substring(F.md5(F.col("user_id").cast("string")), 1, 1) < "8", 0.0).otherwise(20.0).alias("incentive"),
        F.col("n").isNotNull().cast("int").alias("participated"),
        hours.alias("worked_hours"),
        (hours * 0.8).alias("serviceable_hours"),
    )


def seed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimate with interval per (dgp, estimator, seed); every 17th seed failed."""
    discount = F.col("l_discount")
    half = F.lit(1.96) * F.stddev_samp(discount) / F.sqrt(F.count(F.lit(1)))
    ok = F.col("seed") % 17 != 0
    return (
        table(spark, sf_dir, "lineitem")
        .withColumnsRenamed({"l_returnflag": "dgp_id", "l_linestatus": "estimator", "l_suppkey": "seed"})
        .groupBy("dgp_id", "estimator", "seed")
        .agg(F.avg(discount).alias("m"), half.alias("h"))
        .select(
            "dgp_id", "estimator", "seed",
            F.when(ok, F.col("m")).alias("theta"),
            F.lit(0.05).alias("true_theta"),
            F.when(ok, F.col("m") - F.col("h")).alias("theta_lower"),
            F.when(ok, F.col("m") + F.col("h")).alias("theta_upper"),
        )
    )


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operational outcome per (policy, seed); one attempt failed."""
    return (
        table(spark, sf_dir, "orders")
        .select(
            F.substring("o_orderpriority", 1, 1).alias("policy_id"),
            (F.col("o_custkey") % 40).alias("seed"),
            "o_orderstatus",
            "o_totalprice",
        )
        .groupBy("policy_id", "seed")
        .agg(
            F.count(F.lit(1)).alias("created_requests"),
            F.count_if(F.col("o_orderstatus") == "F").alias("completed_trips"),
            F.avg("o_totalprice").alias("total_driver_pay"),
        )
        .select(
            "policy_id", "seed",
            F.when((F.col("seed") == 7) & (F.col("policy_id") == "3"), "failed").otherwise("succeeded").alias("status"),
            "created_requests", "completed_trips", "total_driver_pay",
        )
    )


def block_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arms per customer with a missing control for every 53rd."""
    treated = F.col("arm") == "treatment"
    lift = F.when(treated, F.col("c_nationkey")).otherwise(0)
    missing = (F.col("c_custkey") % 53 == 0) & ~treated
    return (
        table(spark, sf_dir, "customer")
        .withColumn("arm", F.explode(F.array(F.lit("control"), F.lit("treatment"))))
        .select(
            F.col("c_custkey").alias("pair_id"),
            "arm",
            F.when(treated, "candidate").otherwise("baseline").alias("policy_id"),
            F.when(~missing, F.col("c_acctbal") + lift).alias("value"),
        )
    )


def choice_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-alternative stated choices, one per order line."""
    line = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    q, price, flag = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_returnflag")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("person_id"),
        F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2).alias("choice_index"),
        q.alias("tt0"), (q * 0.7).alias("tt1"), (50.0 - q * 0.5).alias("tt2"),
        (price / 1000).alias("co0"), (price / 800).alias("co1"), (F.col("p_retailprice") / 20).alias("co2"),
        (~((F.col("l_linenumber") == 1) & (flag != "R"))).alias("av2"),
    )


SQL = {
    "trips": """
SELECT CASE l_returnflag WHEN 'R' THEN 'HV0003' WHEN 'A' THEN 'HV0005' ELSE 'HV0004' END AS hvfhs_license_num,
  'B' || s_nationkey AS dispatching_base_num,
  CASE WHEN l_linenumber <> 7 THEN 'B' || c_nationkey END AS originating_base_num,
  CASE WHEN l_linenumber = 5 THEN 'UNKNOWN' WHEN l_linestatus = 'O' THEN ' y ' ELSE 'n' END AS shared_request_flag,
  CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linestatus = 'O' THEN ' y ' ELSE 'n' END AS shared_match_flag,
  'N' AS access_a_ride_flag,
  CASE WHEN l_tax > 0.07 THEN 'Y' ELSE 'N' END AS wav_request_flag,
  CASE WHEN l_tax > 0.07 THEN 'y' ELSE 'N' END AS wav_match_flag,
  pu - ((l_suppkey % 20) - 1) * INTERVAL '30' SECOND AS request_datetime,
  pu - INTERVAL '15' SECOND AS on_scene_datetime,
  CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE pu END AS pickup_datetime,
  pu + CAST(l_quantity AS BIGINT) * INTERVAL '1' MINUTE AS dropoff_datetime,
  c_nationkey AS PULocationID, s_nationkey + CASE WHEN l_linenumber = 6 THEN 100 ELSE 0 END AS DOLocationID,
  CAST(l_quantity AS BIGINT) * 60 + CASE WHEN l_linenumber = 3 THEN 90 ELSE 0 END AS trip_time,
  CASE WHEN l_linenumber = 4 AND l_discount = 0 THEN -1.0 ELSE l_quantity * 0.4 END AS trip_miles,
  CASE WHEN l_discount >= 0.1 THEN -l_extendedprice ELSE l_extendedprice END / 1000 AS base_passenger_fare,
  CASE WHEN l_linenumber = 2 THEN NULL ELSE l_tax END AS tolls,
  l_extendedprice / 50000 AS bcf, l_extendedprice / 20000 AS sales_tax,
  CASE WHEN c_nationkey < 3 THEN 2.75::DOUBLE ELSE 0.0::DOUBLE END AS congestion_surcharge,
  CASE WHEN s_nationkey = 1 THEN 2.5::DOUBLE ELSE 0.0::DOUBLE END AS airport_fee,
  l_discount * 10 AS tips, l_extendedprice * (1 - l_discount) / 1000 AS driver_pay
FROM (SELECT l.*, c_nationkey, s_nationkey,
    TIMESTAMP '2024-01-01 00:00:00' + (o_orderkey % 31) * INTERVAL '1' DAY
      + ((l_partkey * 7 + l_suppkey * 13) % 1440) * INTERVAL '1' MINUTE AS pu
  FROM lineitem l JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)""",
    "zones": "SELECT n_nationkey AS LocationID, 'R' || n_regionkey AS Borough, n_name AS Zone, 'Boro Zone' AS service_zone FROM nation",
    "choice_blocks": """
SELECT *, CASE WHEN SUBSTR(h, 1, 1) < '5' THEN 0.9 WHEN SUBSTR(h, 1, 1) < 'a' THEN 1.0 ELSE 1.1 END::DOUBLE AS multiplier_x,
  CASE WHEN SUBSTR(h, 2, 1) < '5' THEN 0.9 WHEN SUBSTR(h, 2, 1) < 'a' THEN 1.0 ELSE 1.1 END::DOUBLE AS multiplier_y
FROM (SELECT *, MD5(zone_id || '-' || CAST(day_id AS VARCHAR) || '-' || hr) AS h FROM (
  SELECT user_id % 5 AS zone_id, CAST(ts AS DATE) AS day_id,
    CAST(FLOOR(EXTRACT(HOUR FROM ts) / 4) AS INT) * 4 AS hr, COUNT(*) AS n_sessions,
    COUNT(*) FILTER (WHERE event_type IN ('click', 'signup')) AS n_x,
    COUNT(*) FILTER (WHERE event_type = 'purchase') AS n_y,
    COUNT(*) FILTER (WHERE event_type IN ('view', 'error')) AS n_none
  FROM events GROUP BY 1, 2, 3))""",
    "state_changes": """
SELECT user_id AS vehicle_id, event_id, ts,
  CASE event_type WHEN 'view' THEN 'idle' WHEN 'click' THEN 'dispatch' WHEN 'signup' THEN 'to_pickup'
    WHEN 'purchase' THEN 'on_trip' ELSE 'offline' END AS state FROM events""",
    "requests": """
SELECT o_orderkey AS request_id, o_custkey % 100 AS vehicle_id, o_custkey % 25 AS origin_zone_id,
  CASE WHEN o_orderkey % 2 = 0 THEN 'X' ELSE 'Y' END AS service_id,
  TIMESTAMP '2024-01-01 00:00:00' + (o_orderkey % 43200) * INTERVAL '1' MINUTE AS created_at,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'expired' ELSE 'canceled' END
    ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'queued' ELSE 'on_trip' END END AS final_state FROM orders""",
    "request_events": """
SELECT request_id, service_id, created_at, state, step,
  created_at + (step - 1) * (60 + request_id % 240) * INTERVAL '1' SECOND AS event_ts,
  CASE WHEN step BETWEEN 3 AND 5 THEN vehicle_id END AS vehicle_id
FROM requests CROSS JOIN (VALUES (1, 'created'), (2, 'queued'), (3, 'assigned'), (4, 'on_trip'),
  (5, 'completed'), (6, 'canceled'), (7, 'expired')) s(step, state)
WHERE step <= 2 OR (step IN (3, 4) AND final_state IN ('completed', 'on_trip')) OR (step >= 5 AND state = final_state)""",
    "driver_offers": """
SELECT l_orderkey || '-' || l_suppkey AS offer_key, l_orderkey AS request_id,
  l_suppkey AS vehicle_id, TIMESTAMP '2024-01-01 00:00:00' + (l_partkey % 43200) * INTERVAL '1' MINUTE AS offered_at,
  CAST(l_quantity AS BIGINT) AS response_seconds,
  CASE WHEN l_returnflag = 'R' THEN 'accepted' WHEN l_returnflag = 'A' THEN 'rejected'
    WHEN l_linestatus = 'O' THEN 'timed_out' ELSE 'withdrawn' END AS state FROM lineitem""",
    "driver_shifts": """
SELECT d.driver_id, t.day_id, CASE WHEN SUBSTR(MD5(CAST(d.driver_id AS VARCHAR)), 1, 1) < '8' THEN 0.0 ELSE 20.0 END::DOUBLE AS incentive,
  CASE WHEN a.n IS NULL THEN 0 ELSE 1 END AS participated,
  LEAST(8.0, COALESCE(a.n, 0) * 0.75)::DOUBLE AS worked_hours, LEAST(8.0, COALESCE(a.n, 0) * 0.75)::DOUBLE * 0.8 AS serviceable_hours
FROM (SELECT DISTINCT user_id AS driver_id FROM events) d
CROSS JOIN (SELECT DISTINCT CAST(ts AS DATE) AS day_id FROM events) t
LEFT JOIN (SELECT user_id, CAST(ts AS DATE) AS day_id, COUNT(*) AS n FROM events GROUP BY 1, 2) a
  ON a.user_id = d.driver_id AND a.day_id = t.day_id""",
    "seed_metrics": """
SELECT l_returnflag AS dgp_id, l_linestatus AS estimator, l_suppkey AS seed,
  CASE WHEN l_suppkey % 17 <> 0 THEN AVG(l_discount) END AS theta, 0.05::DOUBLE AS true_theta,
  CASE WHEN l_suppkey % 17 <> 0 THEN AVG(l_discount) - 1.96 * STDDEV_SAMP(l_discount) / SQRT(COUNT(*)) END AS theta_lower,
  CASE WHEN l_suppkey % 17 <> 0 THEN AVG(l_discount) + 1.96 * STDDEV_SAMP(l_discount) / SQRT(COUNT(*)) END AS theta_upper
FROM lineitem GROUP BY l_returnflag, l_linestatus, l_suppkey""",
    "trajectories": """
SELECT SUBSTR(o_orderpriority, 1, 1) AS policy_id, o_custkey % 40 AS seed,
  CASE WHEN o_custkey % 40 = 7 AND SUBSTR(o_orderpriority, 1, 1) = '3' THEN 'failed' ELSE 'succeeded' END AS status,
  COUNT(*) AS created_requests, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS completed_trips,
  AVG(o_totalprice) AS total_driver_pay FROM orders GROUP BY 1, 2, 3""",
    "block_pairs": """
SELECT c_custkey AS pair_id, arm, CASE WHEN arm = 'treatment' THEN 'candidate' ELSE 'baseline' END AS policy_id,
  CASE WHEN c_custkey % 53 = 0 AND arm = 'control' THEN NULL
    ELSE c_acctbal + CASE WHEN arm = 'treatment' THEN c_nationkey ELSE 0 END END AS value
FROM customer CROSS JOIN (VALUES ('control'), ('treatment')) x(arm)""",
    "choice_tasks": """
SELECT l_suppkey AS person_id, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS choice_index,
  l_quantity AS tt0, l_quantity * 0.7 AS tt1, 50.0 - l_quantity * 0.5 AS tt2,
  l_extendedprice / 1000 AS co0, l_extendedprice / 800 AS co1, p_retailprice / 20 AS co2,
  NOT (l_linenumber = 1 AND l_returnflag <> 'R') AS av2
FROM lineitem JOIN part ON l_partkey = p_partkey""",
}


def with_views(body: str, *names: str, **extra: str) -> str:
    """SQL text: the named domain views as CTEs, then `extra` CTEs, then the body."""
    views = {n: SQL[n] for n in SQL if n in names or (n == "requests" and "request_events" in names)}
    ctes = {**views, **extra}
    if not ctes:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({text})" for n, text in ctes.items()) + "\n" + body
