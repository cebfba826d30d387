"""The given star-schema tables read as the library's entities.

The column rules are listed in FIXTURES.md. Each function returns a lazily read DataFrame; only the
columns used reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

INDICATORS = ("click", "error", "purchase", "signup", "view")
EPOCH = "timestamp'2024-01-01 00:00:00'"
_STATION = "concat('st_', lpad(cast({} as string), 2, '0'))"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def readings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(
        _STATION.format("3 * (user_id % 9)") + " AS station_id",
        "event_type AS indicator",
        "cast(ts AS timestamp) AS ts",
        "value",
    )


def hourly_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Mean per station, indicator and hour."""
    return (
        readings(spark, folder)
        .groupBy("station_id", "indicator", F.date_trunc("hour", "ts").alias("ts"))
        .agg(F.avg("value").alias("value"))
    )


def hourly_indicator_series(spark: SparkSession, folder: str) -> DataFrame:
    """Mean per indicator and hour over the whole river, held under one station id.

    Every hour from the first to the last of all indicators has a row: a gap takes the last known value,
    and hours before an indicator's first value are left out. The grid is one row per hour and indicator,
    however many readings there are.
    """
    means = (
        readings(spark, folder)
        .groupBy("indicator", F.date_trunc("hour", "ts").alias("ts"))
        .agg(F.avg("value").alias("value"))
    )
    span = means.agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    hours = span.select(F.explode(F.sequence("first", "last", F.expr("interval 1 hour"))).alias("ts"))
    grid = means.select("indicator").distinct().join(hours)  # indicators x hours: the grid itself
    known = F.last("value", ignorenulls=True).over(Window.partitionBy("indicator").orderBy("ts"))
    filled = grid.join(means, ["indicator", "ts"], "left").withColumn("value", known).where("value IS NOT NULL")
    return filled.select(F.lit("river").alias("station_id"), "indicator", "ts", "value")


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").selectExpr(
        "cast(n_nationkey AS bigint) AS id",
        "n_name AS name",
        "CASE WHEN n_nationkey = 0 THEN 'outlet' WHEN n_nationkey >= 12 THEN 'source' ELSE 'segment' END AS kind",
        "cast(6 * n_nationkey AS double) AS x",
        "cast(4 * n_regionkey - 8 AS double) AS y",
        "cast(20 + 5 * n_regionkey AS double) AS flow",
        "cast(0.4 + 0.1 * (n_nationkey % 3) AS double) AS velocity",
        "cast(0.10 + 0.05 * (n_nationkey % 2) AS double) AS k",
    )


def edges(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").where("n_nationkey > 0").selectExpr(
        "cast(n_nationkey AS bigint) AS from_node",
        "cast(floor((n_nationkey - 1) / 2) AS bigint) AS to_node",
        "cast(1000 * (1 + n_nationkey % 5) AS double) AS distance_m",
    )


def stations(spark: SparkSession, folder: str) -> DataFrame:
    names = ", ".join(f"'{name}'" for name in INDICATORS)
    return table(spark, folder, "nation").where("n_nationkey % 3 = 0").selectExpr(
        _STATION.format("n_nationkey") + " AS id",
        "cast(n_nationkey AS bigint) AS node_id",
        "15 AS interval_min",
        f"array({names}) AS indicators",
    )


def enterprises(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").selectExpr(
        "s_suppkey AS id",
        "s_name AS name",
        "concat('ind_', cast(s_suppkey % 7 AS string)) AS industry",
        "cast(s_nationkey AS bigint) AS node_id",
        """named_struct(
            'continuous', s_suppkey % 2 = 0,
            'active_hours', array(cast(s_suppkey % 24 AS int), cast(s_suppkey * 7 % 24 AS int)),
            'night_boost', cast(1 + 0.1 * (s_suppkey % 4) AS double),
            'night_window', array(22, 3),
            'weekend_scale', cast(0.5 + 0.1 * (s_suppkey % 6) AS double),
            'seasonal_amp', cast(0.1 * (s_suppkey % 5) AS double),
            'event_only', s_suppkey % 10 = 9,
            'q_waste', 0.01 + abs(s_acctbal) / 1000000D,
            'treat_rate', cast(0.01 * (1 + s_suppkey % 3) AS double)
        ) AS discharge_pattern""",
    )


def spectra(spark: SparkSession, folder: str) -> DataFrame:
    """Fluorescence peaks of each enterprise."""
    return table(spark, folder, "supplier").selectExpr(
        "s_suppkey AS enterprise_id",
        """array(
            named_struct('lex', cast(260 + s_suppkey % 100 AS double), 'lem', cast(320 + s_suppkey % 100 AS double),
                         'amp', 1D, 'sigma', cast(16 + s_suppkey % 10 AS double)),
            named_struct('lex', cast(300 + s_suppkey % 25 AS double), 'lem', 400D, 'amp', 0.5D, 'sigma', 20D)
        ) AS spectrum""",
    )


def observed_peaks(spark: SparkSession, folder: str) -> DataFrame:
    """Observed spectrum of each event (order) as a list of peaks: those of its suppliers, weighted by quantity."""
    amounts = table(spark, folder, "lineitem").groupBy(
        F.col("l_orderkey").alias("sample_id"), F.col("l_suppkey").alias("enterprise_id")
    ).agg(F.sum("l_quantity").cast("double").alias("amount"))
    peaks = (
        amounts.join(spectra(spark, folder), "enterprise_id")
        .select("sample_id", "amount", F.explode("spectrum").alias("p"))
        .groupBy("sample_id", "p.lex", "p.lem", "p.sigma")
        .agg(F.sum(F.col("p.amp") * F.col("amount")).alias("amp"))
    )
    # An order has a few lines, and peaks that two of its suppliers share are one.
    return peaks.groupBy("sample_id").agg(
        F.array_sort(F.collect_list(F.struct("lex", "lem", "amp", "sigma"))).alias("spectrum")
    )


def compositions(spark: SparkSession, folder: str, key: str = "l_suppkey", name: str = "enterprise_id") -> DataFrame:
    """Pollutant amounts by component as a map, one row per supplier (or per order)."""
    amounts = (
        table(spark, folder, "lineitem")
        .groupBy(F.col(key).alias(name), F.concat("l_returnflag", "l_linestatus").alias("component"))
        .agg(F.sum("l_quantity").alias("amount"))
    )
    # A map holds one entry per component, and there are six components.
    return amounts.groupBy(name).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("component", "amount")))).alias("pollutants")
    )


def industry_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Outfall concentration by industry and indicator; some pairs are absent."""
    entries = ", ".join(
        f"struct('{name}' AS k, cast(10 * (1 + (3 * j + {i}) % 7) AS double) AS v, (j + {i}) % 5 AS gap)"
        for i, name in enumerate(INDICATORS)
    )
    return (
        table(spark, folder, "supplier")
        .selectExpr("s_suppkey % 7 AS j").distinct()
        .selectExpr(
            "concat('ind_', cast(j AS string)) AS industry",
            f"map_from_entries(transform(filter(array({entries}), e -> e.gap <> 0), e -> struct(e.k, e.v)))"
            " AS outfall_conc",
        )
    )


def alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Alert events at seven of the nine stations. ``indicators`` is text: a JSON array, a bare name or null."""
    names = ", ".join(f"'{name}'" for name in INDICATORS)
    first = f"element_at(array({names}), cast(1 + o_orderkey % 5 AS int))"
    second = f"element_at(array({names}), cast(1 + (o_orderkey + 2) % 5 AS int))"
    return table(spark, folder, "orders").selectExpr(
        "o_orderkey AS id",
        _STATION.format("3 * (o_custkey % 7)") + " AS station_id",
        f"""CASE WHEN o_orderkey % 11 = 0 THEN NULL
                 WHEN o_orderkey % 7 = 0 THEN {first}
                 WHEN o_orderkey % 4 = 0 THEN concat('["', {first}, '","', {second}, '"]')
                 ELSE concat('["', {first}, '"]') END AS indicators""",
        f"{EPOCH} + make_dt_interval(cast(datediff(cast(o_orderdate AS date), date'1995-01-01') % 30 AS int))"
        " AS onset_ts",
        "CASE WHEN o_totalprice >= 300000 THEN 'high' WHEN o_totalprice >= 150000 THEN 'medium' ELSE 'low' END"
        " AS severity",
        "CASE o_custkey % 3 WHEN 0 THEN 'periodic' WHEN 1 THEN 'sudden' ELSE 'gradual' END AS etype",
        "CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'O' THEN 'open' ELSE 'investigating' END AS status",
        "cast(o_orderdate AS timestamp) AS created_at",
        "o_custkey AS reporter",
    )


def truth(spark: SparkSession, folder: str) -> DataFrame:
    """True source of an alert: supplier of the order's largest line."""
    return (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("event_id"))
        .agg(F.min_by("l_suppkey", F.struct(-F.col("l_quantity"), F.col("l_suppkey"))).alias("truth_source"))
    )


def sample_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").selectExpr(
        "vec_id AS sample_id", "transform(embedding, x -> cast(x AS double)) AS vector"
    )


def library_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Reference spectrum of each enterprise in packed form."""
    return (
        sample_vectors(spark, folder)
        .join(table(spark, folder, "supplier").selectExpr("s_suppkey AS sample_id"), "sample_id")
        .withColumnRenamed("sample_id", "enterprise_id")
    )


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Investigation log: one row per conversation turn."""
    return table(spark, folder, "conversations").selectExpr(
        "cast(conv_id AS string) AS inv_id",
        "turn AS seq",
        "CASE WHEN role = 'user' THEN 'step' WHEN role = 'assistant' AND turn % 4 = 1 THEN 'hypothesis'"
        " WHEN role = 'assistant' THEN 'agent_talk' ELSE 'connected' END AS type",
        "concat(role, '_', cast(turn % 3 AS string)) AS item_id",
        "length(text) / 1000D AS score",
        "text",
    )


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Regulation texts: position, indicator, standard, clause, text."""
    return table(spark, folder, "documents").selectExpr(
        "doc_id AS pos", "lang AS indicator", "source AS standard", "concat('c', cast(n_chars AS string)) AS clause",
        "text",
    )
