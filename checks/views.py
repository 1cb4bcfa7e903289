"""The given tables seen as tracking data, once for Spark and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackuse.config import Config
from trackuse.fixed_values import REFERENCE_POINTS
from trackuse.sources.staging import stage

# Places the animals move between: the named places, then two breeding grounds.
HUBS = [(lon, lat) for _, lat, lon in REFERENCE_POINTS] + [(5.5, 52.5), (8.4, 53.2)]

# The tables span 1995-2001.
CFG = Config(start="1995-06-01", end="2001-06-01")
# A coarse lattice, so that plain recursive SQL can cluster it too.
COARSE = Config(start="1995-06-01", end="2001-06-01", grid_m=5_000.0, eps_m=30_000.0, min_pts=70)

HUB = "(l_suppkey * 7 + CASE WHEN l_suppkey % 4 = 0 THEN 0 ELSE month(l_shipdate) END) % 14"
STUDY_SITE = (
    "CASE l_suppkey % 5 WHEN 0 THEN 'NL' WHEN 1 THEN 'PL' WHEN 2 THEN 'Dümmer' WHEN 3 THEN 'Unterelbe' END"
)
STUDY_NAME = (
    "CASE l_suppkey % 7 WHEN 0 THEN 'Study south holland' WHEN 1 THEN 'BtgTagus 2019' "
    "WHEN 2 THEN 'EXTREMADURA birds' ELSE 'Other' END"
)
SPEED = "CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_quantity > 40 THEN l_quantity ELSE 0e0 END"
TAXON = (
    "CASE WHEN l_suppkey % 9 = 0 THEN 'islandica' WHEN l_suppkey % 9 = 1 THEN NULL ELSE 'Limosa limosa' END"
)


_LANDED: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _exists(spark: SparkSession, file: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(file)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def landed(view):
    """Write a view to the shared folder once per session, as an export would lie there.

    Without this every filter would be pushed into, and repeat, the expressions
    that turn the given tables into tracking data.
    """

    def read(spark: SparkSession, sf: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf, view.__name__)
        if key not in _LANDED or not _exists(spark, _LANDED[key].inputFiles()[0]):
            df, cores = view(spark, sf), spark.sparkContext.defaultParallelism
            few = df.rdd.getNumPartitions() < cores
            _LANDED[key] = stage(df.repartition(cores) if few else df, view.__name__)
        return _LANDED[key].select("*")

    read.view = view
    return read


def _spark_list(values) -> str:
    return "array(" + ", ".join(f"{v}D" for v in values) + ")"


def _duck_list(values) -> str:
    return "[" + ", ".join(f"{v}::DOUBLE" for v in values) + "]"


@landed
def fixes(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as locations: suppliers are animals, part orders their fixes."""
    lon, lat = _spark_list(h[0] for h in HUBS), _spark_list(h[1] for h in HUBS)
    return (
        table(spark, sf, "lineitem")
        .withColumn("hub", F.expr(f"CAST({HUB} AS INT)"))
        .withColumn("ts", F.expr("l_shipdate + make_dt_interval(0, l_linenumber % 7)"))
        .selectExpr(
            "concat('B', CAST(l_suppkey AS STRING)) AS individual_local_identifier",
            f"element_at({lon}, hub + 1) + ((l_orderkey * 53) % 200 - 100) / 5e2 AS X",
            f"element_at({lat}, hub + 1) + ((l_partkey * 37) % 200 - 100) / 5e2 AS Y",
            "CASE WHEN l_linenumber = 7 THEN CAST(CAST(ts AS DATE) AS STRING) ELSE CAST(ts AS STRING) END AS timestamp",
            f"{STUDY_SITE} AS study_site",
            f"{STUDY_NAME} AS study_name",
            f"{SPEED} AS ground_speed",
            "CAST(date_add(DATE'1995-03-01', CAST(l_suppkey * 37 % 2000 AS INT)) AS STRING) "
            "AS deploy_on_timestamp",
            f"{TAXON} AS taxon_detail",
            "hub",
        )
    )


@landed
def event_fixes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "concat('U', CAST(user_id AS STRING)) AS individual_local_identifier",
        "CAST(event_id % 97 AS DOUBLE) AS X",
        "value AS Y",
        "ts AS timestamp",
        "event_id",
        "event_type",
    )


@landed
def order_fixes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(
        "concat('C', CAST(o_custkey AS STRING)) AS individual_local_identifier",
        "date_format(o_orderdate, 'yyyy-MM-dd') AS timestamp",
        "CASE o_orderkey % 5 WHEN 0 THEN NULL "
        "WHEN 1 THEN date_format(o_orderdate, 'yyyy-MM-dd 10:00:00') "
        "ELSE date_format(o_orderdate, 'yyyy-MM-dd') END AS deploy_on_timestamp",
    )


@landed
def studies(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").selectExpr(
        "s_suppkey AS id",
        "CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE s_name END AS name",
        "CASE WHEN s_suppkey % 3 = 0 THEN 'Limosa lapponica' ELSE 'Limosa limosa' END AS taxon_ids",
        "CASE s_suppkey % 4 WHEN 0 THEN 'CC_0' WHEN 1 THEN NULL ELSE 'CC_BY' END AS license_type",
    )


@landed
def raw_fixes(spark: SparkSession, sf: str) -> DataFrame:
    """Fixes before import: some animals unnamed, some columns always empty."""
    return (
        fixes.view(spark, sf)
        .drop("hub", "study_site", "deploy_on_timestamp")
        .withColumn(
            "individual_local_identifier",
            F.expr(
                "CASE WHEN CAST(substring(individual_local_identifier, 2) AS INT) % 13 = 0 THEN NULL "
                "ELSE individual_local_identifier END"
            ),
        )
        .withColumn("comments", F.lit(None).cast("string"))
        .withColumn("height", F.lit(float("nan")))
        .withColumn("visible", F.lit(True))
    )


@landed
def deployments(spark: SparkSession, sf: str) -> DataFrame:
    """One or two deployments per supplier."""
    return (
        table(spark, sf, "supplier")
        .withColumn("l_suppkey", F.col("s_suppkey"))
        .withColumn("nth", F.explode(F.expr("sequence(0, CAST(s_suppkey % 2 AS INT))")))
        .selectExpr(
            f"{STUDY_NAME} AS study_name",
            "CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE concat('B', CAST(s_suppkey AS STRING)) END "
            "AS individual_local_identifier",
            "date_format(date_add(DATE'1995-03-01', CAST(s_suppkey * 37 % 2000 + 100 * nth AS INT)), 'yyyy-MM-dd') "
            "AS deploy_on_timestamp",
            "s_suppkey * 10 + nth AS deployment_id",
            f"{STUDY_SITE} AS study_site",
            "CAST(s_acctbal AS DOUBLE) AS visible",
            "CAST(NULL AS STRING) AS mates",
        )
    )


_LON, _LAT = _duck_list(h[0] for h in HUBS), _duck_list(h[1] for h in HUBS)

# Named sub-queries the SQL side is built from.
CTES: dict[str, str] = {
    "placed": f"""
        SELECT *, CAST({HUB} AS INTEGER) AS hub,
               l_shipdate + to_hours(l_linenumber % 7) AS fix_time
        FROM lineitem""",
    "fixes": f"""
        SELECT 'B' || l_suppkey AS individual_local_identifier,
               ({_LON})[hub + 1] + ((l_orderkey * 53) % 200 - 100) / 5e2 AS "X",
               ({_LAT})[hub + 1] + ((l_partkey * 37) % 200 - 100) / 5e2 AS "Y",
               CASE WHEN hour(fix_time) = 0 THEN strftime(fix_time, '%Y-%m-%d')
                    ELSE strftime(fix_time, '%Y-%m-%d %H:%M:%S') END AS timestamp,
               {STUDY_SITE} AS study_site, {STUDY_NAME} AS study_name, {SPEED} AS ground_speed,
               strftime(DATE '1995-03-01' + CAST(l_suppkey * 37 % 2000 AS INTEGER), '%Y-%m-%d')
                   AS deploy_on_timestamp,
               {TAXON} AS taxon_detail, hub
        FROM placed""",
    "timed": """
        SELECT * REPLACE (coalesce(try_strptime(timestamp, '%Y-%m-%d %H:%M:%S'),
                                   try_strptime(timestamp, '%Y-%m-%d')) AS timestamp)
        FROM fixes""",
    "stationary_fixes": """
        SELECT * FROM timed
        WHERE study_site <> 'PL' AND (ground_speed IS NULL OR ground_speed = 0)""",
    "in_period": """
        SELECT * FROM stationary_fixes
        WHERE timestamp >= TIMESTAMP '1995-06-01' AND timestamp < TIMESTAMP '2001-06-01'""",
    "wide_ranging": """
        SELECT individual_local_identifier AS id FROM in_period
        GROUP BY 1 HAVING max("Y") - min("Y") >= 5""",
    "south": """
        SELECT *, CAST(timestamp AS DATE) AS date FROM in_period
        WHERE individual_local_identifier IN (SELECT id FROM wide_ranging) AND "Y" < 42""",
    "clean": """
        SELECT *, individual_local_identifier AS local_identifier,
               "X" AS location_long, "Y" AS location_lat
        FROM (SELECT *, row_number() OVER (
                  PARTITION BY individual_local_identifier, date
                  ORDER BY timestamp, "X", "Y", deploy_on_timestamp, ground_speed NULLS LAST, hub,
                           study_name, study_site NULLS LAST, taxon_detail NULLS LAST) AS rn
              FROM south)
        WHERE rn <= 4""",
    "hub_fixes": "SELECT *, hub + 1 AS site_id FROM clean",
    "named_places": "SELECT * FROM (VALUES "
    + ", ".join(
        f"({i}, '{n}', {lat}::DOUBLE, {lon}::DOUBLE)" for i, (n, lat, lon) in enumerate(REFERENCE_POINTS)
    )
    + ") t(i, place, ref_lat, ref_long)",
}


def site_ctes(fixes_cte: str, p: str) -> dict[str, str]:
    """Sub-queries from site fixes to the per-site summary; ``p`` prefixes names."""
    site = "site_id, site_name, site_label"
    merc_x = "radians({lon}) * 6378137.0"
    merc_y = "ln(tan(radians({lat}) / 2 + pi() / 4)) * 6378137.0"
    return {
        f"{p}centres": f"""
            SELECT site_id, median(location_long) AS longitude, median(location_lat) AS latitude
            FROM {fixes_cte} GROUP BY site_id""",
        f"{p}named": f"""
            SELECT * FROM (
                SELECT site_id, longitude, latitude, place AS site_name, km AS match_dist_km,
                       row_number() OVER (PARTITION BY site_id ORDER BY km, i) AS rn
                FROM (SELECT c.*, place, i,
                             sqrt(pow({merc_x.format(lon='longitude')} - {merc_x.format(lon='ref_long')}, 2)
                                + pow({merc_y.format(lat='latitude')} - {merc_y.format(lat='ref_lat')}, 2)) / 1000 AS km
                      FROM {p}centres c CROSS JOIN named_places))
            WHERE rn = 1""",
        f"{p}sites": f"""
            SELECT site_id, longitude, latitude, site_name, match_dist_km,
                   CASE WHEN count(*) OVER (PARTITION BY site_name) > 1
                        THEN site_name || ' (site ' || site_id || ')' ELSE site_name END AS site_label
            FROM {p}named""",
        f"{p}site_fixes": f"""
            SELECT f.*, s.site_name, s.site_label
            FROM {fixes_cte} f LEFT JOIN {p}sites s ON f.site_id = s.site_id""",
        f"{p}cycled": f"""
            SELECT *, CAST(CASE WHEN month(date) >= 6 THEN year(date) ELSE year(date) - 1 END AS INTEGER) AS nb_year
            FROM {p}site_fixes""",
        f"{p}presence": f"""
            SELECT * FROM (
                SELECT DISTINCT local_identifier, {site}, nb_year, make_date(nb_year, 6, 1) AS nb_year_start, date,
                       CAST(datediff('day', make_date(nb_year, 6, 1), date) + 1 AS INTEGER) AS day_in_year
                FROM {p}cycled)
            WHERE day_in_year BETWEEN 1 AND 366""",
        f"{p}daily": f"""
            SELECT {site}, nb_year, day_in_year, count(DISTINCT local_identifier) AS n_users
            FROM {p}presence GROUP BY ALL""",
        f"{p}dense": f"""
            SELECT g.*, CAST(d AS INTEGER) AS day_in_year, coalesce(n_users, 0) AS n_users
            FROM (SELECT DISTINCT {site}, nb_year FROM {p}daily) g
            CROSS JOIN (SELECT unnest(range(1, 367)) AS d)
            LEFT JOIN {p}daily t ON t.site_id = g.site_id AND t.nb_year = g.nb_year AND t.day_in_year = d""",
        f"{p}rolled": f"""
            SELECT *, CASE WHEN day_in_year >= 14 THEN CAST(sum(n_users) OVER (
                       PARTITION BY site_id, nb_year ORDER BY day_in_year
                       ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS BIGINT) END AS roll_14
            FROM {p}dense""",
        f"{p}peaks": f"""
            SELECT {site}, nb_year, day_in_year AS peak_end_day,
                   CAST((day_in_year - 14) % 366 + 1 AS INTEGER) AS peak_start_day,
                   roll_14 AS peak_n_users_14d,
                   strftime(DATE '2001-06-01' + (day_in_year - 14), '%b %d') || ' - '
                       || strftime(DATE '2001-06-01' + (day_in_year - 1), '%b %d') AS peak_window
            FROM (SELECT *, row_number() OVER (PARTITION BY site_id, nb_year
                                               ORDER BY roll_14 DESC, day_in_year) AS rn
                  FROM {p}rolled WHERE roll_14 IS NOT NULL)
            WHERE rn = 1""",
        f"{p}tracked": f"""
            SELECT nb_year, count(DISTINCT local_identifier) AS n_total FROM {p}presence GROUP BY 1""",
        f"{p}use": f"""
            SELECT u.*, n_total, n_site / n_total AS prop_site
            FROM (SELECT {site}, nb_year, count(DISTINCT local_identifier) AS n_site
                  FROM {p}presence GROUP BY ALL) u
            LEFT JOIN {p}tracked t ON u.nb_year = t.nb_year""",
        f"{p}use_summary": f"""
            SELECT {site}, avg(prop_site) AS prop_mean, median(prop_site) AS prop_median,
                   count(DISTINCT nb_year) AS n_years
            FROM {p}use GROUP BY ALL""",
        f"{p}mode": f"""
            SELECT {site}, peak_window, mean_peak_n_users_14d
            FROM (SELECT *, row_number() OVER (PARTITION BY site_id
                             ORDER BY n DESC, mean_peak_n_users_14d DESC, peak_window) AS rn
                  FROM (SELECT {site}, peak_window, avg(peak_n_users_14d) AS mean_peak_n_users_14d,
                               count(*) AS n
                        FROM {p}peaks GROUP BY ALL))
            WHERE rn = 1""",
        f"{p}summary": f"""
            SELECT u.site_id, u.site_name, u.site_label, prop_mean, prop_median,
                   peak_window, mean_peak_n_users_14d, longitude, latitude
            FROM {p}use_summary u
            LEFT JOIN {p}mode m ON u.site_id = m.site_id
            LEFT JOIN {p}sites s ON u.site_id = s.site_id""",
    }


CTES |= site_ctes("hub_fixes", "")
# two sites per place, so that names repeat
CTES["split_fixes"] = "SELECT * REPLACE (site_id * 2 + CAST(\"X\" * 500 AS BIGINT) % 2 AS site_id) FROM hub_fixes"
CTES |= site_ctes("split_fixes", "split_")
# latest two cycles, with sites of all years
CTES["latest"] = "SELECT DISTINCT nb_year FROM cycled ORDER BY nb_year DESC LIMIT 2"
CTES |= {
    k: v
    for k, v in site_ctes("hub_fixes", "recent_").items()
    if k.removeprefix("recent_") not in ("centres", "named", "site_fixes")
}
CTES["recent_sites"] = "SELECT * FROM sites"
CTES["recent_cycled"] = "SELECT * FROM cycled WHERE nb_year IN (SELECT nb_year FROM latest)"

CTES |= {
    "fine_cells": """
        SELECT CAST(round_even(mx / 250.0, 0) AS BIGINT) AS gx, CAST(round_even(my / 250.0, 0) AS BIGINT) AS gy,
               count(*) AS n_pts
        FROM mercator_fixes GROUP BY 1, 2""",
    "mercator_fixes": """
        SELECT *, radians(location_long) * 6378137.0 AS mx,
               ln(tan(radians(location_lat) / 2 + pi() / 4)) * 6378137.0 AS my
        FROM clean""",
    "coarse_fixes": """
        SELECT *, CAST(round_even(mx / 5000.0, 0) AS BIGINT) AS gx, CAST(round_even(my / 5000.0, 0) AS BIGINT) AS gy
        FROM mercator_fixes""",
    "clustered_fixes": """
        SELECT f.*, l.site_id FROM coarse_fixes f JOIN labelled l ON f.gx = l.gx AND f.gy = l.gy
        WHERE l.site_id <> 0""",
}


def cluster_ctes(p: str, cells: str, radius_sq: int, block: int, min_pts: int) -> dict[str, str]:
    """Sub-queries that label the cells of ``cells``; ``p`` prefixes names.

    Clusters are whatever is reached from a core cell over pairs of core cells.
    """
    return {
        f"{p}pairs": f"""
            SELECT a.gx, a.gy, b.gx AS hx, b.gy AS hy
            FROM (SELECT gx, gy, gx // {block} AS bx, gy // {block} AS by FROM {cells}) a
            JOIN (SELECT gx, gy, gx // {block} + i AS bx, gy // {block} + j AS by FROM {cells},
                  (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j)) b
            ON a.bx = b.bx AND a.by = b.by
            WHERE (a.gx - b.gx) * (a.gx - b.gx) + (a.gy - b.gy) * (a.gy - b.gy) <= {radius_sq}""",
        f"{p}core": f"SELECT gx, gy FROM {p}pairs GROUP BY 1, 2 HAVING count(*) >= {min_pts}",
        f"{p}core_pairs": f"""
            SELECT p.* FROM {p}pairs p JOIN {p}core a ON p.gx = a.gx AND p.gy = a.gy
            JOIN {p}core b ON p.hx = b.gx AND p.hy = b.gy""",
        f"{p}reached": f"""
            SELECT gx, gy, gx AS hx, gy AS hy FROM {p}core
            UNION
            SELECT r.gx, r.gy, p.hx, p.hy FROM {p}reached r JOIN {p}core_pairs p ON r.hx = p.gx AND r.hy = p.gy""",
        f"{p}roots": f"SELECT gx, gy, min((hx, hy)) AS root FROM {p}reached GROUP BY 1, 2",
        f"{p}core_sites": f"""
            SELECT gx, gy, CAST(dense_rank() OVER (ORDER BY root) AS INTEGER) AS site_id FROM {p}roots""",
        f"{p}labelled": f"""
            SELECT c.gx, c.gy, coalesce(k.site_id, b.site_id, 0) AS site_id
            FROM (SELECT DISTINCT gx, gy FROM {cells}) c
            LEFT JOIN {p}core_sites k ON c.gx = k.gx AND c.gy = k.gy
            LEFT JOIN (SELECT p.gx, p.gy, min(s.site_id) AS site_id
                       FROM {p}pairs p JOIN {p}core_sites s ON p.hx = s.gx AND p.hy = s.gy GROUP BY 1, 2) b
            ON c.gx = b.gx AND c.gy = b.gy""",
    }


CTES |= cluster_ctes("", "coarse_cells", 36, 6, 70)
CTES |= cluster_ctes("fine_", "fine_cells", 14400, 120, 1500)
CTES["coarse_cells"] = "SELECT DISTINCT gx, gy FROM coarse_fixes"
CTES |= site_ctes("clustered_fixes", "clustered_")

CTES |= {
    "event_fixes": """
        SELECT 'U' || user_id AS individual_local_identifier, CAST(event_id % 97 AS DOUBLE) AS "X",
               value AS "Y", ts AS timestamp, event_id, event_type
        FROM events""",
    "order_fixes": """
        SELECT 'C' || o_custkey AS individual_local_identifier, strftime(o_orderdate, '%Y-%m-%d') AS timestamp,
               CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d 10:00:00')
                    ELSE strftime(o_orderdate, '%Y-%m-%d') END AS deploy_on_timestamp
        FROM orders""",
    "studies": """
        SELECT s_suppkey AS id, CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE s_name END AS name,
               CASE WHEN s_suppkey % 3 = 0 THEN 'Limosa lapponica' ELSE 'Limosa limosa' END AS taxon_ids,
               CASE s_suppkey % 4 WHEN 0 THEN 'CC_0' WHEN 1 THEN NULL ELSE 'CC_BY' END AS license_type
        FROM supplier""",
    "raw_fixes": """
        SELECT CASE WHEN CAST(substring(individual_local_identifier, 2) AS INTEGER) % 13 = 0 THEN NULL
                    ELSE individual_local_identifier END AS individual_local_identifier,
               "X", "Y", timestamp, study_name, ground_speed, taxon_detail, true AS visible
        FROM timed""",
    "deployments": f"""
        SELECT {STUDY_NAME.replace('l_suppkey', 's_suppkey')} AS study_name,
               CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE 'B' || s_suppkey END AS individual_local_identifier,
               strftime(DATE '1995-03-01' + CAST(s_suppkey * 37 % 2000 + 100 * nth AS INTEGER), '%Y-%m-%d')
                   AS deploy_on_timestamp,
               s_suppkey * 10 + nth AS deployment_id,
               {STUDY_SITE.replace('l_suppkey', 's_suppkey')} AS study_site, s_acctbal AS visible_dep
        FROM supplier JOIN (VALUES (0), (1)) n(nth) ON nth <= s_suppkey % 2""",
    "joined": """
        SELECT f.*, d.deploy_on_timestamp, d.deployment_id, d.study_site, d.visible_dep
        FROM raw_fixes f LEFT JOIN deployments d
        ON f.study_name IS NOT DISTINCT FROM d.study_name
           AND f.individual_local_identifier IS NOT DISTINCT FROM d.individual_local_identifier""",
}
