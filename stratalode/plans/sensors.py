"""Registered queries: the sensor time series over `events`; a user is a sensor, an event type its metric."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalode.functions import sensors as S
from stratalode.operators import state as Z
from stratalode.plans.catalog import Tables, query

NOW = "2024-01-30 00:00:00"
_HASH = "sha256(concat_ws('|', strftime(ts, '%Y-%m-%dT%H:%M:%S'), event_type, printf('%.8f', value)))"


def readings(t: Tables) -> DataFrame:
    return S.normalise(t("events").select(F.col("event_id").alias("reading_id"), F.col("user_id").alias("sensor_id"), F.col("ts").alias("observed_at"), F.col("event_type").alias("metric_name"), F.col("value").alias("numeric_value"), F.col("props").alias("metadata_json")))


@query("ts_normalize", "SELECT event_id AS reading_id, user_id AS sensor_id, ts AS observed_at, substr(lower(trim(event_type)), 1, 80) AS metric_name, value AS numeric_value, props AS metadata_json FROM events WHERE trim(event_type) <> '' AND value IS NOT NULL")
def ts_normalize(t: Tables) -> DataFrame:
    return readings(t)


@query("ts_hash", f"SELECT event_id AS reading_id, {_HASH} AS reading_hash FROM events WHERE trim(event_type) <> '' AND value IS NOT NULL")
def ts_hash(t: Tables) -> DataFrame:
    return readings(t).select("reading_id", S.reading_hash().alias("reading_hash"))


@query("ts_upsert", f"WITH r AS (SELECT *, {_HASH} AS h FROM events WHERE trim(event_type) <> '' AND value IS NOT NULL) SELECT user_id AS sensor_id, h AS reading_hash, min(event_id) AS reading_id, max(value) AS numeric_value, arg_max(props, event_id) FILTER (props IS NOT NULL AND props <> '{{}}') AS metadata_json FROM r GROUP BY 1, 2")
def ts_upsert(t: Tables) -> DataFrame:
    return S.upsert(readings(t))


@query("ts_range", "SELECT event_id, user_id, event_type, ts, value FROM events WHERE event_type IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'")
def ts_range(t: Tables) -> DataFrame:
    return t("events").where("event_type IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'").select("event_id", "user_id", "event_type", "ts", "value")


@query("ts_context", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 72 HOUR AND ts <= TIMESTAMP '{NOW}'),
g AS (SELECT user_id AS sensor_id, event_type AS metric_name, count(*) AS n, round(min(value), 4) AS low, round(max(value), 4) AS high, round(avg(value), 4) AS mean, arg_min(value, rn) AS latest_value, max(ts) AS latest_at, list(round(value, 4) ORDER BY rn) AS points FROM r WHERE rn <= 12 GROUP BY 1, 2)
SELECT *, metric_name || ': n=' || n || ', latest=' || printf('%.2f', latest_value) AS summary FROM g""")
def ts_context(t: Tables) -> DataFrame:
    return S.context(readings(t), NOW, hours=72, last=12)


@query("ts_window_rollup", "SELECT date_trunc('hour', ts) AS bucket, event_type AS metric_name, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY 1, 2")
def ts_window_rollup(t: Tables) -> DataFrame:
    return t("events").groupBy(F.window("ts", "1 hour").start.alias("bucket"), F.col("event_type").alias("metric_name")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@query("ts_topology", "SELECT c_custkey, c_name AS sensor_name, coalesce(nullif(n_name, ''), 'unknown') AS group_name, coalesce(nullif(r_name, ''), 'unknown') AS place_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def ts_topology(t: Tables) -> DataFrame:
    joined = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    name = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown"))
    return joined.select("c_custkey", F.col("c_name").alias("sensor_name"), name("n_name").alias("group_name"), name("r_name").alias("place_name"))


@query(
    "ts_dim_upsert",
    """WITH pl AS (SELECT r_regionkey % 2 AS owner, r_regionkey AS place, r_name AS place_name FROM region), hv AS (SELECT n_nationkey % 2 AS owner, n_nationkey AS hive, n_name AS own_name, CASE WHEN n_nationkey % 6 <> 0 THEN n_regionkey END AS hive_place FROM nation),
wr AS (SELECT CASE WHEN c_custkey % 31 <> 0 THEN c_custkey % 2 END AS owner, c_custkey % 400 AS external_id, CASE WHEN c_custkey % 29 = 0 THEN ' ' ELSE c_name END AS name, CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey % 5 AS INTEGER) END AS place, CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey END AS hive, c_custkey AS at_ FROM customer),
a AS (SELECT wr.*, hv.hive AS h, own_name, hive_place, coalesce(wr.place, hive_place) AS eff FROM wr LEFT JOIN hv ON hv.owner = wr.owner AND hv.hive = wr.hive), b AS (SELECT a.*, pl.place AS p, place_name FROM a LEFT JOIN pl ON pl.owner = a.owner AND pl.place = eff),
j AS (SELECT *, CASE WHEN owner IS NULL THEN 'missing_owner' WHEN trim(name) = '' THEN 'missing_name' WHEN place IS NOT NULL AND p IS NULL THEN 'place_not_found' WHEN hive IS NOT NULL AND h IS NULL THEN 'hive_not_found' WHEN place IS NOT NULL AND hive_place <> place THEN 'hive_of_another_place' WHEN hive IS NOT NULL AND place IS NOT NULL AND hive_place IS NULL THEN 'hive_without_place' END AS reason FROM b),
al AS (SELECT owner, external_id, name, p AS place, hive, own_name AS hive_name, place_name AS label, at_ FROM j WHERE reason IS NULL UNION ALL SELECT s_suppkey % 2, s_suppkey, s_name, NULL, NULL, NULL, 'old', -1 FROM supplier)
SELECT 'kept' AS kind, owner, external_id, arg_max(name, at_) AS name, max(at_) AS written, CAST(NULL AS VARCHAR) AS reason, (arg_max({'v': place}, at_)).v AS place, (arg_max({'v': hive_name}, at_)).v AS hive_name, (arg_max({'v': label}, at_)).v AS label FROM al GROUP BY owner, external_id
UNION ALL SELECT 'refused', owner, external_id, name, at_, reason, place, NULL, NULL FROM j WHERE reason IS NOT NULL""",
)
def ts_dim_upsert(t: Tables) -> DataFrame:
    """Customers write sensors with a nation as hive and a region as place, their own or not, over suppliers as the sensors there are."""
    k, tenant, none = F.col("c_custkey"), F.lit("shared").alias("tenant"), lambda kind: F.lit(None).cast(kind)
    own = lambda c: (F.col(c) % 2).cast("long").alias("owner")
    places = t("region").select(tenant, own("r_regionkey"), F.col("r_regionkey").alias("place"), F.col("r_name").alias("place_name"))
    hives = t("nation").select(tenant, own("n_nationkey"), F.col("n_nationkey").alias("hive"), F.col("n_name").alias("own_name"), F.when(F.col("n_nationkey") % 6 != 0, F.col("n_regionkey")).alias("hive_place"))
    writes = t("customer").select(
        tenant, F.when(k % 31 != 0, k % 2).alias("owner"), (k % 400).alias("external_id"), F.when(k % 29 == 0, " ").otherwise(F.col("c_name")).alias("name"), F.when(k % 4 != 0, (k % 5).cast("int")).alias("place"), F.when(k % 3 != 0, F.col("c_nationkey")).alias("hive"),
        none("string").alias("hive_name"), none("string").alias("label"), k.alias("at"),
    )
    old = t("supplier").select(tenant, own("s_suppkey"), F.col("s_suppkey").alias("external_id"), F.col("s_name").alias("name"), none("int").alias("place"), none("int").alias("hive"), none("string").alias("hive_name"), F.lit("old").alias("label"), F.lit(-1).cast("long").alias("at"))
    kept, refused = Z.sensor_upsert(old, writes, places, hives)
    shown = ("owner", "external_id", "name", F.col("at").alias("written"))
    a = kept.select(F.lit("kept").alias("kind"), *shown, none("string").alias("reason"), "place", "hive_name", "label")
    return a.unionByName(refused.select(F.lit("refused").alias("kind"), *shown, "reason", "place", none("string").alias("hive_name"), none("string").alias("label")))


@query("ts_enforce", f"""WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN NULL WHEN s_suppkey % 8 = 0 THEN 99 ELSE s_nationkey END AS hive, CASE WHEN s_acctbal < 2000 THEN NULL WHEN s_suppkey % 7 = 0 THEN 9 ELSE n_regionkey END AS place FROM supplier JOIN nation ON s_nationkey = n_nationkey),
h AS (SELECT n_nationkey AS hive, CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE n_regionkey END AS hive_place FROM nation)
SELECT s_suppkey, CASE WHEN s.hive IS NULL THEN 'ok' WHEN h.hive IS NULL THEN 'hive_of_another_owner' WHEN hive_place IS NULL AND place IS NOT NULL THEN 'hive_without_place' WHEN place <> hive_place THEN 'place_mismatch' ELSE 'ok' END AS verdict, CASE WHEN s.hive IS NULL THEN place ELSE coalesce(place, hive_place) END AS place FROM s LEFT JOIN h ON s.hive = h.hive""")
def ts_enforce(t: Tables) -> DataFrame:
    """Suppliers as sensors, nations as hives, regions as places; some have no hive, no place, another's hive or another place."""
    hives = t("nation").select(F.col("n_nationkey").alias("hive"), F.when(F.col("n_nationkey") % 6 == 0, None).otherwise(F.col("n_regionkey")).alias("hive_place"))
    k = F.col("s_suppkey")
    joined = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    sensors = joined.select("s_suppkey", F.when(k % 9 == 0, None).when(k % 8 == 0, 99).otherwise(F.col("s_nationkey")).alias("hive"), F.when(F.col("s_acctbal") < 2000, None).when(k % 7 == 0, 9).otherwise(F.col("n_regionkey")).alias("place"))
    return S.enforce_places(sensors, hives).select("s_suppkey", "verdict", "place")


@query("ts_propagate", "SELECT s_suppkey, n_name || '/' || s_name AS full_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def ts_propagate(t: Tables) -> DataFrame:
    return t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat_ws("/", "n_name", "s_name").alias("full_name"))


@query("ts_delete_owner", "SELECT user_id, count(*) AS deleted FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY user_id")
def ts_delete_owner(t: Tables) -> DataFrame:
    gone = t("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    return t("events").join(gone, "user_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("deleted"))


@query("ts_intent", r"SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '\b(latest|current|now|today)\b') THEN 'sensor_first' WHEN regexp_matches(lower(text), '\b(over|from|with)\b') THEN 'include' ELSE 'none' END AS intent FROM conversations WHERE role = 'user'")
def ts_intent(t: Tables) -> DataFrame:
    c = F.lower("text")
    return t("conversations").where("role = 'user'").select("conv_id", "turn", F.when(c.rlike("\\b(latest|current|now|today)\\b"), "sensor_first").when(c.rlike("\\b(over|from|with)\\b"), "include").otherwise("none").alias("intent"))


@query("rate_window", "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS hits FROM events")
def rate_window(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, 0)
    return t("events").select("event_id", "user_id", F.count("*").over(w).alias("hits"))


@query("rate_limit_exact")
def rate_limit_exact(t: Tables) -> DataFrame:
    return S.rate_limit(t("events").select("event_id", F.col("user_id").alias("key"), "ts"), limit=2, seconds=3600)
