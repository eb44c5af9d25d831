"""Views of the given tables in the shape of game, forecast and observation data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def spread(df: DataFrame, path: str) -> DataFrame:
    """Share a file of fewer input splits than cores among all cores; a table of many splits is left as it is.

    Only file lengths are looked at, so nothing runs here.
    """
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if 262_144 < size < cores * 16 * 1024 * 1024 else df


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The files of a table as a stream."""
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{folder}/{name}*.parquet")


def matches(spark: SparkSession, folder: str, orders: DataFrame | None = None) -> DataFrame:
    """One game per order (a table or a stream of orders); teams are nations, leagues are regions."""
    columns = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    if orders is None:
        orders = spread(table(spark, folder, "orders", *columns), f"{folder}/orders.parquet")
    orders = orders.select(*columns)
    customers = table(spark, folder, "customer", "c_custkey", "c_nationkey")
    nations = table(spark, folder, "nation")
    regions = table(spark, folder, "region")
    home = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("home"), F.col("r_name").alias("league")
    )
    away = nations.select(F.col("n_nationkey").alias("_awaykey"), F.col("n_name").alias("away"))
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return (
        orders.join(customers, cust == F.col("c_custkey"))
        .join(home, "c_nationkey")
        .withColumn("_awaykey", (F.col("c_nationkey") + 5 * (1 + key % 4)) % 25)
        .join(away, "_awaykey")
        .select(
            key.alias("game_id"), "league", F.col("o_orderdate").alias("datetime"), "home", "away",
            ((cust * 7 + key * 3) % 9).alias("home_score"),
            ((cust * 5 + key * 11) % 8).alias("away_score"),
            F.concat(F.lit("V"), (cust % 12).cast("string")).alias("venue"),
            F.when(F.col("o_orderstatus") == "F", "regular")
            .when(F.col("o_orderstatus") == "O", "interleague").otherwise("special").alias("game_category"),
            (F.col("o_orderstatus") != "P").alias("training_included"),
        )
    )


def predictions(spark: SparkSession, folder: str, orders: DataFrame | None = None) -> DataFrame:
    """A settled three-way forecast per game with expected scores."""
    key = F.col("game_id")
    home, draw = (key % 41 + 20) / F.lit(100.0), (key % 16 + 5) / F.lit(100.0)
    return matches(spark, folder, orders).select(
        "game_id", "league", "datetime", "game_category", "home", "away", "venue",
        F.when(F.col("home_score") > F.col("away_score"), 0)
        .when(F.col("home_score") == F.col("away_score"), 1).otherwise(2).cast("long").alias("actual"),
        F.col("home_score").alias("actual_home_score"), F.col("away_score").alias("actual_away_score"),
        home.alias("pred_home"), draw.alias("pred_draw"), (F.lit(1.0) - home - draw).alias("pred_away"),
        (key % 50 / F.lit(10.0) + 1.5).alias("lambda_home"), (key % 37 / F.lit(10.0) + 1.2).alias("lambda_away"),
        F.concat(F.lit("M"), (key % 3).cast("string")).alias("model"),
    )


EXPERT_MODS = ((37, 18, 13, 7), (29, 25, 11, 9), (43, 15, 17, 4))  # (home mod, home base, draw mod, draw base)


def experts(spark: SparkSession, folder: str, orders: DataFrame | None = None) -> DataFrame:
    """Forecasts plus three expert vectors per game."""
    key = F.col("game_id")
    df = predictions(spark, folder, orders)
    for j, (hm, hb, dm, db) in enumerate(EXPERT_MODS):
        h, d = (key % hm + hb) / F.lit(100.0), (key % dm + db) / F.lit(100.0)
        df = df.withColumn(f"expert_{j}", F.array(h, d, F.lit(1.0) - h - d))
    return df.withColumns(
        {
            "feature_rest": (key % 23).cast("double"),
            "feature_form": ((key * 7) % 31 / F.lit(10.0)).cast("double"),
            "feature_env": ((key * 3) % 19 / F.lit(5.0)).cast("double"),
        }
    )


def observations(spark: SparkSession, folder: str, late: bool = True, events: DataFrame | None = None) -> DataFrame:
    """Context observations, one per event; a seventh of them arrive after their forecast time."""
    if events is None:
        events = table(spark, folder, "events", "event_id", "ts", "user_id", "event_type", "value")
    kind = (
        F.when(F.col("event_type") == "view", "STARTER").when(F.col("event_type") == "click", "LINEUP")
        .when(F.col("event_type") == "signup", "WEATHER").when(F.col("event_type") == "purchase", "AVAILABILITY")
        .otherwise("REST_TRAVEL")
    )
    state = (
        F.when(F.col("event_id") % 5 == 0, "UNKNOWN").when(F.col("event_id") % 5 < 3, "VERIFIED").otherwise("PROJECTED")
    )
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp")) + F.expr("INTERVAL 1 HOUR")
    cutoff = F.when(F.col("event_id") % 7 == 0, hour - F.expr("INTERVAL 2 HOURS")).otherwise(hour) if late else hour
    return events.select(
        "event_id", F.col("user_id").alias("game_id"), F.col("ts").cast("timestamp").alias("available_at"),
        cutoff.alias("prediction_time"), kind.alias("kind"), state.alias("state"),
        (F.floor("value").cast("long") % 4).cast("string").alias("value"),
        F.col("value").alias("reading"),
    )


def player_games(spark: SparkSession, folder: str) -> DataFrame:
    """Batting lines: one row per (order, part), dealt by order as the joins with games want them."""
    lines = table(
        spark, folder, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"
    )
    q = F.floor(F.sum("l_quantity")).cast("long")
    return lines.repartition("l_orderkey").groupBy(F.col("l_orderkey").alias("game_id"), F.col("l_partkey").alias("player_id")).agg(
        q.alias("pa"),
        F.floor(q * 0.85).cast("long").alias("ab"),
        F.floor(q * 0.25).cast("long").alias("h"),
        (F.min("l_suppkey") % 3).cast("long").alias("doubles"),
        (F.min("l_suppkey") % 2).cast("long").alias("hr"),
        F.floor(q * 0.1).cast("long").alias("bb"),
        F.floor(q * 0.2).cast("long").alias("so"),
    )


VIEWS_SQL = """
matches AS (
  SELECT o.o_orderkey AS game_id, r.r_name AS league, o.o_orderdate AS datetime, hn.n_name AS home, an.n_name AS away,
         (o.o_custkey * 7 + o.o_orderkey * 3) % 9 AS home_score, (o.o_custkey * 5 + o.o_orderkey * 11) % 8 AS away_score,
         CONCAT('V', CAST(o.o_custkey % 12 AS VARCHAR)) AS venue,
         CASE o.o_orderstatus WHEN 'F' THEN 'regular' WHEN 'O' THEN 'interleague' ELSE 'special' END AS game_category,
         o.o_orderstatus <> 'P' AS training_included
  FROM orders o JOIN customer cu ON cu.c_custkey = o.o_custkey
  JOIN nation hn ON hn.n_nationkey = cu.c_nationkey JOIN region r ON r.r_regionkey = hn.n_regionkey
  JOIN nation an ON an.n_nationkey = (cu.c_nationkey + 5 * (1 + o.o_orderkey % 4)) % 25),
team_rows AS (
  SELECT game_id, league, datetime, home AS team, away AS opponent, true AS is_home, home_score AS gf, away_score AS ga,
         training_included AS eligible FROM matches
  UNION ALL
  SELECT game_id, league, datetime, away, home, false, away_score, home_score, training_included FROM matches),
predictions AS (
  SELECT game_id, league, datetime, game_category, home, away, venue,
         CAST(CASE WHEN home_score > away_score THEN 0 WHEN home_score = away_score THEN 1 ELSE 2 END AS BIGINT) AS actual,
         home_score AS actual_home_score, away_score AS actual_away_score,
         (game_id % 41 + 20) / 100.0E0 AS pred_home, (game_id % 16 + 5) / 100.0E0 AS pred_draw,
         1.0E0 - (game_id % 41 + 20) / 100.0E0 - (game_id % 16 + 5) / 100.0E0 AS pred_away,
         game_id % 50 / 10.0E0 + 1.5E0 AS lambda_home, game_id % 37 / 10.0E0 + 1.2E0 AS lambda_away,
         CONCAT('M', CAST(game_id % 3 AS VARCHAR)) AS model FROM matches),
observations AS (
  SELECT event_id, user_id AS game_id, ts AS available_at,
         CASE WHEN event_id % 7 = 0 THEN date_trunc('hour', ts) + INTERVAL 1 HOUR - INTERVAL 2 HOUR
              ELSE date_trunc('hour', ts) + INTERVAL 1 HOUR END AS prediction_time,
         CASE event_type WHEN 'view' THEN 'STARTER' WHEN 'click' THEN 'LINEUP' WHEN 'signup' THEN 'WEATHER'
              WHEN 'purchase' THEN 'AVAILABILITY' ELSE 'REST_TRAVEL' END AS kind,
         CASE WHEN event_id % 5 = 0 THEN 'UNKNOWN' WHEN event_id % 5 < 3 THEN 'VERIFIED' ELSE 'PROJECTED' END AS state,
         CAST(CAST(floor(value) AS BIGINT) % 4 AS VARCHAR) AS value, value AS reading FROM events)
"""


def with_views(body: str) -> str:
    """Oracle text: the adapter views as CTEs, then the query (which may add CTEs after a comma)."""
    body = body.strip()
    return f"WITH {VIEWS_SQL}\n{body if body.startswith(',') else body}"
