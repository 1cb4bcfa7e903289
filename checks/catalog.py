"""Every operator as a query over the given tables, with equivalent SQL."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views as v
from checks.views import CFG, COARSE, CTES
from trackuse.fixed_values import REGION_BOXES
from trackuse.functions.project import (
    inverse_mercator,
    mercator,
    ortho_xy,
    padded_extent,
    point_to_xy,
    snap_cells,
    with_cells,
)
from trackuse.functions.season import cycle_day_label, parse_timestamp, with_cycle, wrap_day
from trackuse.operators import (
    clean,
    density,
    effort,
    ingest,
    outliers,
    profile,
    recent,
    regions,
    routes,
    sites,
    usage,
)
from trackuse.operators.ordering import first_n_per_group
from trackuse.plans import figures
from trackuse.plans.site_use import find_sites, site_tables
from trackuse.sources.staging import shared_dir, stage
from trackuse.sources.tables import (
    read_locations,
    read_output,
    read_studies,
    require_columns,
    write_locations,
    write_outputs,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ID = "individual_local_identifier"


def with_ctes(select: str) -> str:
    """Prefix ``select`` with the sub-queries it names, directly or not."""
    needed: list[str] = []

    def visit(text: str, own: str = "") -> None:
        for name in re.findall(r"(?:FROM|JOIN)\s+([a-z_]+)", text):
            if name in CTES and name != own and name not in needed:
                visit(CTES[name], name)
                if name not in needed:
                    needed.append(name)

    visit(select)
    if not needed:
        return select
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTES[n]})" for n in needed) + "\n" + select


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = with_ctes(oracle)
        return fn

    return register


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in cols})


# --- shared inputs -----------------------------------------------------------


def clean_fixes(spark: SparkSession, sf: str) -> DataFrame:
    return clean.clean_locations(v.fixes(spark, sf), CFG)


def hub_fixes(spark: SparkSession, sf: str) -> DataFrame:
    return clean_fixes(spark, sf).withColumn("site_id", F.col("hub") + 1)


def named_hub_fixes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    fixes = stage(hub_fixes(spark, sf), "hub-fixes")
    places = stage(sites.site_locations(fixes), "hub-sites")
    return sites.name_fixes(fixes, places), places


def hub_presence(spark: SparkSession, sf: str) -> DataFrame:
    return usage.presence_days(named_hub_fixes(spark, sf)[0], CFG)


# --- sources and import ------------------------------------------------------


@query(
    "select_studies",
    """SELECT id, name, license_type FROM studies
       WHERE taxon_ids = 'Limosa limosa' AND name <> 'Supplier#000000002' AND name <> 'Supplier#000000010'
         AND license_type <> 'CC_0'""",
)
def _(spark, sf):
    out = ingest.select_studies(
        v.studies(spark, sf), "Limosa limosa", ["Supplier#000000002", "Supplier#000000010"]
    )
    return out.select("id", "name", "license_type")


@query(
    "read_studies",
    """SELECT individual_local_identifier, "X", "Y", timestamp, study_name, study_site, ground_speed,
              CASE WHEN study_name = 'Other' THEN NULL ELSE taxon_detail END AS taxon_detail
       FROM fixes""",
)
def _(spark, sf):
    """All studies landed as CSV, one without a column, each in files of two column orders, read as one table."""
    base = v.fixes(spark, sf).drop("hub", "deploy_on_timestamp")
    paths = {}
    for i, study in enumerate(("Study south holland", "BtgTagus 2019", "EXTREMADURA birds", "Other")):
        part = base.filter(F.col("study_name") == study).drop("study_name")
        if study == "Other":
            part = part.drop("taxon_detail")
        paths[study] = f"{shared_dir(spark)}/landed-{uuid.uuid4().hex}-{i}"
        write_locations(part.filter("X is null or X >= 0"), paths[study], "csv")
        rest = part.filter("X < 0").select(*reversed(part.columns))
        rest.write.mode("append").options(header=True, nullValue="NA", escape='"').csv(paths[study])
    return read_studies(spark, paths)


@query(
    "read_deployments",
    """SELECT study_name, individual_local_identifier, deploy_on_timestamp,
              CAST(deployment_id AS VARCHAR) AS deployment_id, study_site FROM deployments""",
)
def _(spark, sf):
    deps = v.deployments(spark, sf).drop("mates", "visible")
    paths = {}
    for i, study in enumerate(("Study south holland", "BtgTagus 2019", "EXTREMADURA birds", "Other")):
        part = deps.filter(F.col("study_name") == study).drop("study_name")
        paths[study] = f"{shared_dir(spark)}/landed-{uuid.uuid4().hex}-{i}"
        write_locations(part.select(*(reversed(part.columns) if i % 2 else part.columns)), paths[study], "csv")
    return read_studies(spark, paths)


@query(
    "locations_round_trip",
    """SELECT individual_local_identifier, "X", "Y", timestamp, study_name, study_site, ground_speed,
              'line one' || chr(10) || '"two", ' || study_name AS notes FROM fixes""",
)
def _(spark, sf):
    """All fixes written as CSV with a text of two lines, and read back."""
    notes = F.concat(F.lit('line one\n"two", '), "study_name")
    path = f"{shared_dir(spark)}/landed-{uuid.uuid4().hex}"
    write_locations(v.fixes(spark, sf).withColumn("notes", notes), path, "csv")
    back = read_locations(spark, path, multi_line=True)
    return back.drop("hub", "taxon_detail", "deploy_on_timestamp")


@query(
    "union_studies",
    """SELECT individual_local_identifier, "X", "Y", ground_speed, NULL::VARCHAR AS event_type FROM fixes
       UNION ALL
       SELECT individual_local_identifier, "X", "Y", NULL, event_type FROM event_fixes""",
)
def _(spark, sf):
    a = v.fixes(spark, sf).select(ID, "X", "Y", "ground_speed")
    b = v.event_fixes(spark, sf).select(ID, "X", "Y", "event_type")
    return ingest.union_studies([a, b])


@query(
    "join_deployments",
    """SELECT study_name, individual_local_identifier, timestamp, "X", "Y", deployment_id, deploy_on_timestamp,
              study_site, visible, visible_dep FROM joined""",
)
def _(spark, sf):
    raw = v.raw_fixes(spark, sf)
    raw = raw.withColumn("timestamp", parse_timestamp("timestamp"))
    out = ingest.join_deployments(raw, v.deployments(spark, sf))
    return out.select(
        "study_name", ID, "timestamp", "X", "Y", "deployment_id", "deploy_on_timestamp",
        "study_site", "visible", "visible_dep",
    )


@query(
    "drop_all_null",
    """SELECT individual_local_identifier, "X", "Y", timestamp, study_name, ground_speed, taxon_detail, visible
       FROM raw_fixes""",
)
def _(spark, sf):
    raw = v.raw_fixes(spark, sf)
    return ingest.drop_all_null(raw.withColumn("timestamp", parse_timestamp("timestamp")))


@query(
    "dedup_first",
    """SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity
       FROM (SELECT *, row_number() OVER (
                 PARTITION BY l_orderkey, l_linenumber
                 ORDER BY l_shipdate, l_discount, l_extendedprice, l_linestatus, l_partkey, l_quantity,
                          l_returnflag, l_suppkey, l_tax) AS rn
             FROM lineitem) WHERE rn = 1""",
)
def _(spark, sf):
    out = ingest.dedup_first(v.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate"])
    return out.select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity")


@query(
    "drop_listed",
    """SELECT individual_local_identifier, "X", "Y", timestamp, study_name, ground_speed, taxon_detail
       FROM raw_fixes""",
)
def _(spark, sf):
    raw = v.raw_fixes(spark, sf).drop("comments", "height")
    raw = raw.withColumn("timestamp", parse_timestamp("timestamp"))
    return ingest.reorder(ingest.drop_any(raw))


@query(
    "taxon_filter",
    """SELECT individual_local_identifier, timestamp, taxon_detail FROM fixes
       WHERE taxon_detail NOT IN ('islandica', 'Limosa lapponica', 'Limosa limosa islandica')""",
)
def _(spark, sf):
    return ingest.exclude_taxa(v.fixes(spark, sf)).select(ID, "timestamp", "taxon_detail")


_ROLL = """
    SELECT {cols}, individual_local_identifier, "X", "Y", timestamp,
           CASE WHEN n = 5 THEN my END AS y_mean, CASE WHEN n = 5 THEN sy END AS y_sd,
           CASE WHEN n = 5 AND sy <> 0 THEN ("Y" - my) * ("Y" - my) / sy END AS y_dev,
           CASE WHEN n = 5 THEN mx END AS x_mean, CASE WHEN n = 5 THEN sx END AS x_sd,
           CASE WHEN n = 5 AND sx <> 0 THEN ("X" - mx) * ("X" - mx) / sx END AS x_dev
    FROM (SELECT *, count(*) OVER w AS n, avg("Y") OVER w AS my, stddev_samp("Y") OVER w AS sy,
                 avg("X") OVER w AS mx, stddev_samp("X") OVER w AS sx
          FROM {source}
          WINDOW w AS (PARTITION BY individual_local_identifier ORDER BY {order}
                       ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))"""
CTES["event_roll"] = _ROLL.format(
    cols="event_id", source="event_fixes", order='timestamp, "X", "Y", event_id, event_type'
)


@query(
    "rolling_outliers",
    """SELECT event_id, individual_local_identifier, round(y_mean, 6) AS "Y_mean_5", round(y_sd, 6) AS "Y_sd_5",
              round(y_dev, 6) AS "Y_dev", round(x_mean, 6) AS "X_mean_5", round(x_sd, 6) AS "X_sd_5",
              round(x_dev, 6) AS "X_dev",
              CASE WHEN y_dev > 10 OR x_dev > 10 THEN 'outlier'
                   WHEN y_dev <= 10 AND x_dev <= 10 THEN 'normal' END AS outlier
       FROM event_roll""",
)
def _(spark, sf):
    out = outliers.flag_outliers(v.event_fixes(spark, sf), ID, ["timestamp"], ["Y", "X"])
    stats = [f"{c}_{m}" for c in ("Y", "X") for m in ("mean_5", "sd_5", "dev")]
    return rounded(out.select("event_id", ID, *stats, "outlier"), *stats)


CTES["first_deployments"] = """
    SELECT * FROM (SELECT *, row_number() OVER (
        PARTITION BY study_name, individual_local_identifier, timestamp
        ORDER BY deploy_on_timestamp NULLS LAST, deployment_id NULLS LAST, study_site NULLS LAST,
                 visible_dep NULLS LAST, "X", "Y", ground_speed NULLS LAST, taxon_detail NULLS LAST) AS rn
        FROM joined)
    WHERE rn = 1 AND taxon_detail NOT IN ('islandica', 'Limosa lapponica', 'Limosa limosa islandica')"""
CTES["import_roll"] = _ROLL.format(
    cols="study_name, deployment_id, deploy_on_timestamp, visible_dep, ground_speed",
    source="first_deployments",
    order='timestamp, "X", "Y", deploy_on_timestamp NULLS LAST, deployment_id NULLS LAST, '
    "ground_speed NULLS LAST, study_name, study_site NULLS LAST, taxon_detail, visible_dep NULLS LAST",
)


IMPORTED = """SELECT individual_local_identifier, study_name, timestamp, "X", "Y", ground_speed, deployment_id,
              deploy_on_timestamp, visible_dep, outlier
       FROM (SELECT *, CASE WHEN y_dev <= 10 AND x_dev <= 10 THEN 'normal' END AS outlier FROM import_roll)
       WHERE outlier = 'normal'"""


@query(
    "import_locations",
    IMPORTED,
)
def _(spark, sf):
    out = ingest.clean_import(v.raw_fixes(spark, sf), v.deployments(spark, sf))
    return out.select(
        ID, "study_name", "timestamp", "X", "Y", "ground_speed", "deployment_id",
        "deploy_on_timestamp", "visible_dep", "outlier",
    )


@query("import_landed", IMPORTED)
def _(spark, sf):
    """The same from landed CSV: each study's fixes and deployments written, read in one scan each, and imported."""
    paths = {"fixes": {}, "deployments": {}}
    for kind, table in (("fixes", v.raw_fixes(spark, sf)), ("deployments", v.deployments(spark, sf))):
        for i, study in enumerate(("Study south holland", "BtgTagus 2019", "EXTREMADURA birds", "Other")):
            part = table.filter(F.col("study_name") == study).drop("study_name")
            paths[kind][study] = f"{shared_dir(spark)}/landed-{uuid.uuid4().hex}-{i}"
            write_locations(part.select(*(reversed(part.columns) if i % 2 else part.columns)), paths[kind][study], "csv")
    out = ingest.clean_import(*[read_studies(spark, p) for p in paths.values()])
    typed = {c: F.col(c).cast(dict(v.deployments(spark, sf).dtypes)[c.removesuffix("_dep")]) for c in ("deployment_id", "visible_dep")}
    return out.withColumns(typed).select(
        ID, "study_name", "timestamp", "X", "Y", "ground_speed", "deployment_id",
        "deploy_on_timestamp", "visible_dep", "outlier",
    )


# --- dates and projections ---------------------------------------------------

_TEXT_SPARK = """CASE l_linenumber
    WHEN 1 THEN date_format(l_shipdate, 'yyyy-MM-dd 10:20:30.250') WHEN 2 THEN date_format(l_shipdate, 'yyyy-MM-dd')
    WHEN 3 THEN 'unknown' WHEN 4 THEN date_format(l_shipdate, 'yyyy-MM') WHEN 5 THEN NULL
    WHEN 6 THEN date_format(l_shipdate, "yyyy-MM-dd'T'23:59:59'Z'")
    ELSE date_format(l_shipdate, 'yyyy-MM-dd 00:00:01') END AS text"""


@query(
    "parse_timestamp",
    """SELECT l_orderkey, l_partkey, l_linenumber, CASE l_linenumber
           WHEN 1 THEN l_shipdate + INTERVAL '10 hours 20 minutes 30.25 seconds' WHEN 2 THEN l_shipdate
           WHEN 6 THEN l_shipdate + INTERVAL '23 hours 59 minutes 59 seconds'
           WHEN 7 THEN l_shipdate + INTERVAL '1 second' END AS parsed
       FROM lineitem""",
)
def _(spark, sf):
    text = v.table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_partkey", "l_linenumber", _TEXT_SPARK)
    return text.select("l_orderkey", "l_partkey", "l_linenumber", parse_timestamp("text").alias("parsed"))


@query(
    "cycle_year",
    """SELECT date, nb_year, make_date(nb_year, 6, 1) AS nb_year_start, day_in_year,
              strftime(DATE '2001-06-01' + (day_in_year - 1), '%b %d') AS day_label,
              CAST(((day_in_year - 14) % 366 + 366) % 366 + 1 AS INTEGER) AS window_start
       FROM (SELECT date, nb_year, CAST(datediff('day', make_date(nb_year, 6, 1), date) + 1 AS INTEGER) AS day_in_year
             FROM (SELECT DISTINCT CAST(d AS DATE) AS date, CAST(CASE WHEN month(d) >= 6 THEN year(d)
                          ELSE year(d) - 1 END AS INTEGER) AS nb_year
                   FROM (SELECT l_shipdate AS d FROM lineitem UNION ALL SELECT o_orderdate FROM orders)))""",
)
def _(spark, sf):
    ship = v.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("date"))
    dates = ship.union(v.table(spark, sf, "orders").select(F.to_date("o_orderdate"))).distinct()
    return with_cycle(dates).withColumns(
        {
            "day_label": cycle_day_label(F.col("day_in_year")),
            "window_start": wrap_day(F.col("day_in_year") - 13),
        }
    )


@query(
    "mercator",
    """SELECT individual_local_identifier, "X", "Y", timestamp, round(radians("X") * 6378137.0, 2) AS mx,
              round(ln(tan(radians("Y") / 2 + pi() / 4)) * 6378137.0, 2) AS my, round("X", 6) AS lon, round("Y", 6) AS lat
       FROM fixes""",
)
def _(spark, sf):
    fixes = v.fixes(spark, sf).select(ID, "X", "Y", "timestamp")
    mx, my = mercator("X", "Y")
    lon, lat = inverse_mercator("mx", "my")
    out = fixes.withColumns({"mx": mx, "my": my}).withColumns({"lon": lon, "lat": lat})
    return rounded(rounded(out, "mx", "my", places=2), "lon", "lat")


@query(
    "ortho_xy",
    """WITH RECURSIVE wide AS (
           SELECT event_id, radians(event_id % 97 * 3.7 - 180) AS lam, radians(value * 7 % 180 - 90) AS phi FROM events),
       k AS (SELECT radians(35.0) AS p0, 6378137.0::DOUBLE AS a, 2 / 298.257223563::DOUBLE - pow(1 / 298.257223563::DOUBLE, 2) AS e2),
       n AS (SELECT *, lam - radians(-10.0) AS d, a / sqrt(1 - e2 * pow(sin(phi), 2)) AS nu,
                    a / sqrt(1 - e2 * pow(sin(p0), 2)) AS nu0 FROM wide, k)
       SELECT event_id,
              CASE WHEN seen THEN round(nu * cos(phi) * sin(d), 2) END AS x,
              CASE WHEN seen THEN round(nu * (sin(phi) * cos(p0) - cos(phi) * sin(p0) * cos(d))
                                  + e2 * (nu0 * sin(p0) - nu * sin(phi)) * cos(p0), 2) END AS y
       FROM (SELECT *, sin(p0) * sin(phi) + cos(p0) * cos(phi) * cos(d) >= -1e-10 AS seen FROM n)""",
)
def _(spark, sf):
    """Events spread over the globe, so that some lie on the far side."""
    spread = v.table(spark, sf, "events").selectExpr(
        "event_id", "event_id % 97 * 3.7D - 180 AS lon", "value * 7 % 180 - 90 AS lat"
    )
    x, y = ortho_xy("lon", "lat")
    return rounded(spread.select("event_id", x.alias("x"), y.alias("y")), "x", "y", places=2)


@query(
    "point_to_xy",
    """SELECT individual_local_identifier, timestamp, "X", "Y" FROM fixes""",
)
def _(spark, sf):
    text = F.concat(F.lit("POINT ("), F.col("X").cast("string"), F.lit(" "), F.col("Y").cast("string"), F.lit(")"))
    landed = v.fixes(spark, sf).select(ID, "timestamp", text.alias("geometry"))
    return point_to_xy(landed, "geometry")


@query(
    "padded_extent",
    """SELECT round(lo_x - 0.4 * (hi_x - lo_x), 6) AS xmin, round(hi_x + 0.4 * (hi_x - lo_x), 6) AS xmax,
              round(lo_y - 0.4 * (hi_y - lo_y), 6) AS ymin, round(hi_y + 0.4 * (hi_y - lo_y), 6) AS ymax,
              round((1.8 * (hi_x - lo_x)) / (1.8 * (hi_y - lo_y)), 6) AS aspect
       FROM (SELECT min("X") AS lo_x, max("X") AS hi_x, min("Y") AS lo_y, max("Y") AS hi_y FROM fixes)""",
)
def _(spark, sf):
    box = padded_extent(v.fixes(spark, sf), "X", "Y")
    return rounded(box, "xmin", "xmax", "ymin", "ymax", "aspect")


# --- cleaning ----------------------------------------------------------------

_FIX = f'{ID}, "X", "Y", timestamp'


@query("stationary", f"SELECT {_FIX}, study_site, ground_speed FROM stationary_fixes")
def _(spark, sf):
    fixes = v.fixes(spark, sf).withColumn("timestamp", parse_timestamp("timestamp"))
    return clean.stationary(fixes).select(ID, "X", "Y", "timestamp", "study_site", "ground_speed")


@query(
    "time_range",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_shipdate FROM lineitem
       WHERE l_shipdate >= TIMESTAMP '1995-06-01' AND l_shipdate < TIMESTAMP '2001-06-01'""",
)
def _(spark, sf):
    out = clean.time_range(v.table(spark, sf, "lineitem"), "l_shipdate", CFG.start, CFG.end)
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate")


@query(
    "group_range_filter",
    f"SELECT {_FIX} FROM in_period WHERE individual_local_identifier IN (SELECT id FROM wide_ranging)",
)
def _(spark, sf):
    fixes = v.fixes(spark, sf).withColumn("timestamp", parse_timestamp("timestamp"))
    still = clean.time_range(clean.stationary(fixes), "timestamp", CFG.start, CFG.end)
    return clean.group_range_filter(still, ID, "Y").select(ID, "X", "Y", "timestamp")


@query("clean_locations", "SELECT local_identifier, date, timestamp, location_long, location_lat, hub FROM clean")
def _(spark, sf):
    return clean_fixes(spark, sf).select(
        "local_identifier", "date", "timestamp", "location_long", "location_lat", "hub"
    )


@query(
    "daily_thin",
    """SELECT individual_local_identifier, date, timestamp, event_id
       FROM (SELECT *, CAST(timestamp AS DATE) AS date, row_number() OVER (
                 PARTITION BY individual_local_identifier, CAST(timestamp AS DATE)
                 ORDER BY timestamp, "X", "Y", event_id) AS rn FROM event_fixes)
       WHERE rn <= 4""",
)
def _(spark, sf):
    dated = v.event_fixes(spark, sf).withColumn("date", F.to_date("timestamp"))
    return first_n_per_group(dated, [ID, "date"], ["timestamp"], 4).select(ID, "date", "timestamp", "event_id")


# --- cells and clusters ------------------------------------------------------


def _cells(spark, sf, cfg):
    celled = with_cells(clean_fixes(spark, sf), "location_long", "location_lat", cfg.grid_m)
    return celled, snap_cells(celled)


@query("snap_count", "SELECT gx, gy, n_pts FROM fine_cells")
def _(spark, sf):
    return _cells(spark, sf, CFG)[1]


_NEIGHBOURS = "SELECT gx, gy, count(*) AS neighbours FROM fine_pairs GROUP BY 1, 2"


@query("neighbour_count", _NEIGHBOURS)
def _(spark, sf):
    return density.neighbour_count(_cells(spark, sf, CFG)[1], CFG.eps_cells)


@query("neighbour_count_sweep", _NEIGHBOURS)
def _(spark, sf):
    return density.neighbour_count(stage(_cells(spark, sf, CFG)[1], "cells"), CFG.eps_cells, "sweep")


@query("dbscan", "SELECT gx, gy, site_id FROM labelled")
def _(spark, sf):
    return density.dbscan(_cells(spark, sf, COARSE)[1], COARSE.eps_cells, COARSE.min_pts)


@query("dbscan_250m", "SELECT gx, gy, site_id FROM fine_labelled")
def _(spark, sf):
    return density.dbscan(_cells(spark, sf, CFG)[1], CFG.eps_cells, CFG.min_pts)


# --- sites -------------------------------------------------------------------


@query(
    "site_median",
    "SELECT site_id, round(longitude, 6) AS longitude, round(latitude, 6) AS latitude FROM centres",
)
def _(spark, sf):
    centres = sites.site_centres(stage(hub_fixes(spark, sf), "hub-fixes"))
    return rounded(centres, "longitude", "latitude")


@query(
    "nearest_reference",
    """SELECT site_id, site_name, round(match_dist_km, 6) AS match_dist_km FROM named""",
)
def _(spark, sf):
    named = sites.nearest_reference(sites.site_centres(stage(hub_fixes(spark, sf), "hub-fixes")))
    return rounded(named.select("site_id", "site_name", "match_dist_km"), "match_dist_km")


@query("label_duplicates", "SELECT site_id, site_name, site_label FROM split_sites")
def _(spark, sf):
    """Two sites per place, so that names repeat."""
    odd = F.pmod(F.rint(F.col("X") * 500).cast("bigint"), F.lit(2))
    signed = F.when(F.col("X") < 0, -odd).otherwise(odd)
    split = hub_fixes(spark, sf).withColumn("site_id", F.col("site_id") * 2 + signed)
    named = sites.nearest_reference(sites.site_centres(stage(split, "split-fixes")))
    return sites.label_duplicates(named).select("site_id", "site_name", "site_label")


@query(
    "site_locations",
    """SELECT site_id, site_name, site_label, round(longitude, 6) AS longitude, round(latitude, 6) AS latitude,
              round(match_dist_km, 6) AS match_dist_km FROM clustered_sites""",
)
def _(spark, sf):
    out = find_sites(v.fixes(spark, sf), COARSE).locations
    return rounded(out, "longitude", "latitude", "match_dist_km")


@query(
    "site_fixes",
    "SELECT local_identifier, timestamp, site_id, site_name, site_label FROM site_fixes",
)
def _(spark, sf):
    named, _ = named_hub_fixes(spark, sf)
    return named.select("local_identifier", "timestamp", "site_id", "site_name", "site_label")


# --- use ---------------------------------------------------------------------

_SITE = "site_id, site_name, site_label"


@query(
    "presence_days",
    f"SELECT local_identifier, {_SITE}, nb_year, nb_year_start, date, day_in_year FROM presence",
)
def _(spark, sf):
    return hub_presence(spark, sf)


@query("daily_users", f"SELECT {_SITE}, nb_year, day_in_year, n_users FROM dense")
def _(spark, sf):
    return usage.daily_users(hub_presence(spark, sf))


@query("rolling_users", f"SELECT {_SITE}, nb_year, day_in_year, n_users, roll_14 FROM rolled")
def _(spark, sf):
    return usage.rolling_users(usage.daily_users(hub_presence(spark, sf)))


@query(
    "peak_window",
    f"SELECT {_SITE}, nb_year, peak_end_day, peak_start_day, peak_n_users_14d, peak_window FROM peaks",
)
def _(spark, sf):
    return usage.peak_windows(hub_presence(spark, sf), CFG)


@query("site_use_by_year", f"SELECT {_SITE}, nb_year, n_site, n_total, prop_site FROM use")
def _(spark, sf):
    return usage.site_use_by_year(hub_presence(spark, sf))


@query(
    "site_use_summary",
    f"""SELECT {_SITE}, round(prop_mean, 6) AS prop_mean, round(prop_median, 6) AS prop_median, n_years
        FROM use_summary""",
)
def _(spark, sf):
    out = usage.site_use_summary(usage.site_use_by_year(hub_presence(spark, sf)))
    return rounded(out, "prop_mean", "prop_median")


@query("peak_mode", f"SELECT {_SITE}, peak_window, round(mean_peak_n_users_14d, 6) AS mean_peak_n_users_14d FROM mode")
def _(spark, sf):
    out = usage.peak_mode(usage.peak_windows(hub_presence(spark, sf), CFG))
    return rounded(out, "mean_peak_n_users_14d")


_SUMMARY = f"""
    SELECT {_SITE}, round(prop_mean, 6) AS prop_mean, round(prop_median, 6) AS prop_median, peak_window,
           round(mean_peak_n_users_14d, 6) AS mean_peak_n_users_14d, round(longitude, 6) AS longitude,
           round(latitude, 6) AS latitude"""
_SUMMARY_NUMBERS = ("prop_mean", "prop_median", "mean_peak_n_users_14d", "longitude", "latitude")


def hub_summary(spark, sf):
    named, places = named_hub_fixes(spark, sf)
    presence = stage(usage.presence_days(named, CFG), "presence")
    return usage.site_summary(usage.site_use_by_year(presence), usage.peak_windows(presence, CFG), places)


@query("site_summary", f"{_SUMMARY} FROM summary")
def _(spark, sf):
    return rounded(hub_summary(spark, sf), *_SUMMARY_NUMBERS)


@query("clustered_site_summary", f"{_SUMMARY} FROM clustered_summary")
def _(spark, sf):
    """The whole chain from text locations to the site table, clustering included."""
    found = find_sites(v.fixes(spark, sf), COARSE)
    summary = site_tables(found.fixes, found.locations, COARSE)["site_summary_points"]
    return rounded(summary, *_SUMMARY_NUMBERS)


@query(
    "clustered_site_fixes",
    f"SELECT local_identifier, timestamp, location_long, location_lat, {_SITE} FROM clustered_site_fixes",
)
def _(spark, sf):
    """Every fix of a clustered site with its name; noise is gone."""
    found = find_sites(v.fixes(spark, sf), COARSE).fixes
    return found.select("local_identifier", "timestamp", "location_long", "location_lat", *_SITE.split(", "))


@query(
    "outputs_round_trip",
    f"SELECT local_identifier, {_SITE}, nb_year, nb_year_start, date, day_in_year FROM presence",
)
def _(spark, sf):
    """Presence days written in one folder per cycle, and read back."""
    folder = f"{shared_dir(spark)}/outputs-{uuid.uuid4().hex}"
    write_outputs({"site_presence_days": hub_presence(spark, sf)}, folder, {"site_presence_days": "nb_year"})
    return require_columns(read_output(spark, folder, "site_presence_days"), ["site_id", "nb_year", "date"])


def recent_presence(spark, sf):
    named, places = named_hub_fixes(spark, sf)
    return usage.presence_days(recent.recent_cycles(named, 2, CFG), CFG), places


@query(
    "recent_presence_days",
    f"SELECT local_identifier, {_SITE}, nb_year, nb_year_start, date, day_in_year FROM recent_presence",
)
def _(spark, sf):
    return recent_presence(spark, sf)[0]


@query("recent_site_use_by_year", f"SELECT {_SITE}, nb_year, n_site, n_total, prop_site FROM recent_use")
def _(spark, sf):
    return usage.site_use_by_year(recent_presence(spark, sf)[0])


@query("recent_cycles", f"SELECT local_identifier, timestamp, {_SITE}, nb_year FROM recent_cycled")
def _(spark, sf):
    named, _ = named_hub_fixes(spark, sf)
    out = recent.recent_cycles(named, 2, CFG)
    return out.select("local_identifier", "timestamp", "site_id", "site_name", "site_label", "nb_year")


@query("recent_site_summary", f"{_SUMMARY} FROM recent_summary")
def _(spark, sf):
    named, places = named_hub_fixes(spark, sf)
    return rounded(recent.recent_site_summary(named, places, 2, CFG), *_SUMMARY_NUMBERS)


# --- profiles and figures' tables --------------------------------------------

CTES["occ"] = """
    SELECT d.year, d.doy, n_present, n_tracked, n_present / n_tracked AS prop_present
    FROM (SELECT CAST(year(date) AS INTEGER) AS year, CAST(dayofyear(date) AS INTEGER) AS doy,
                 count(DISTINCT local_identifier) AS n_present FROM clean GROUP BY 1, 2) d
    JOIN (SELECT year(date) AS year, count(DISTINCT local_identifier) AS n_tracked FROM clean GROUP BY 1) t
    ON d.year = t.year"""


@query("occupancy", "SELECT year, doy, n_present, n_tracked, prop_present FROM occ")
def _(spark, sf):
    return profile.occupancy(clean_fixes(spark, sf))


@query(
    "occupancy_roll14",
    """SELECT doy, round(m, 6) AS mean_prop_present,
              CASE WHEN row_number() OVER (ORDER BY doy) >= 14 THEN round(sum(m) OVER (
                  ORDER BY doy ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), 6) END AS roll_14
       FROM (SELECT doy, avg(prop_present) AS m FROM occ GROUP BY doy)""",
)
def _(spark, sf):
    out = profile.occupancy_roll14(profile.occupancy(clean_fixes(spark, sf)))
    return rounded(out, "mean_prop_present", "roll_14")


def _profile_sql(p: str) -> str:
    return f"""
       SELECT s.site_id, s.site_name, s.site_label, CAST(d AS INTEGER) AS day_in_year, site_order,
              round(coalesce(prop, 0), 6) AS prop
       FROM (SELECT *, CAST(row_number() OVER (ORDER BY round(latitude, 9) DESC, site_id) AS INTEGER) AS site_order FROM sites) s
       JOIN (SELECT DISTINCT site_id FROM {p}daily) USING (site_id)
       CROSS JOIN (SELECT unnest(range(1, 367)) AS d)
       LEFT JOIN (SELECT site_id, day_in_year, avg(n_users / n_total) AS prop
                  FROM {p}daily JOIN {p}tracked USING (nb_year) GROUP BY 1, 2) p
       ON p.site_id = s.site_id AND p.day_in_year = d"""


@query("seasonal_profile", _profile_sql(""))
def _(spark, sf):
    named, places = named_hub_fixes(spark, sf)
    presence = stage(usage.presence_days(named, CFG), "presence")
    return rounded(profile.seasonal_profile(presence, places), "prop")


@query("recent_seasonal_profile", _profile_sql("recent_"))
def _(spark, sf):
    presence, places = recent_presence(spark, sf)
    return rounded(profile.seasonal_profile(stage(presence, "presence"), places), "prop")


@query(
    "annual_use_order",
    f"""SELECT {_SITE}, nb_year, prop_site, round(mean_prop, 6) AS mean_prop, site_order
        FROM use JOIN (SELECT site_label AS l, mean_prop,
                              CAST(row_number() OVER (ORDER BY round(mean_prop, 12) DESC, site_label) AS INTEGER) AS site_order
                       FROM (SELECT site_label, avg(prop_site) AS mean_prop FROM use GROUP BY 1))
        ON site_label = l""",
)
def _(spark, sf):
    out = profile.annual_use_order(usage.site_use_by_year(hub_presence(spark, sf)))
    return rounded(out.drop("n_site", "n_total"), "mean_prop")


@query(
    "axis_breaks",
    """SELECT CAST(unnest(range(lo, hi + 1, 2)) AS INTEGER) AS axis_break
       FROM (SELECT min(nb_year) AS lo, max(nb_year) AS hi FROM use)""",
)
def _(spark, sf):
    return profile.axis_breaks(usage.site_use_by_year(hub_presence(spark, sf)))


@query(
    "map_labels",
    """SELECT site_id, site_label || ': ' || CAST(round_even(prop_mean * 100, 0) AS INTEGER) || '%' AS label
       FROM use_summary""",
)
def _(spark, sf):
    return profile.map_labels(hub_summary(spark, sf)).select("site_id", "label")


_ORTHO = """
    SELECT *, nu * cos(phi) * sin(d) AS ox, nu * (sin(phi) * cos(p0) - cos(phi) * sin(p0) * cos(d))
              + e2 * (nu0 * sin(p0) - nu * sin(phi)) * cos(p0) AS oy
    FROM (SELECT *, a / sqrt(1 - e2 * pow(sin(phi), 2)) AS nu, a / sqrt(1 - e2 * pow(sin(p0), 2)) AS nu0
          FROM (SELECT *, radians({lat}) AS phi, radians({lon}) - radians(-10.0) AS d, radians(35.0) AS p0,
                       6378137.0::DOUBLE AS a, 2 / 298.257223563::DOUBLE - pow(1 / 298.257223563::DOUBLE, 2) AS e2
                FROM {source}))"""
CTES["summary_points"] = _ORTHO.format(lon="longitude", lat="latitude", source="summary")


@query(
    "flyway_map",
    """SELECT site_id, site_label || ': ' || CAST(round_even(prop_mean * 100, 0) AS INTEGER) || '%' AS label,
              round(ox, 2) AS x, round(oy, 2) AS y FROM summary_points""",
)
def _(spark, sf):
    points, _ = figures.flyway_map(hub_summary(spark, sf))
    return rounded(points.select("site_id", "label", "x", "y"), "x", "y", places=2)


@query(
    "flyway_extent",
    """SELECT round(a - 0.6 * (b - a), 2) AS xmin, round(b + 0.6 * (b - a), 2) AS xmax,
              round(c - 0.4 * (d - c), 2) AS ymin, round(d + 0.4 * (d - c), 2) AS ymax,
              round(2.2 * (b - a) / (1.8 * (d - c)), 6) AS aspect
       FROM (SELECT min(ox) AS a, max(ox) AS b, min(oy) AS c, max(oy) AS d FROM summary_points)""",
)
def _(spark, sf):
    _, box = figures.flyway_map(hub_summary(spark, sf))
    return rounded(rounded(box, "xmin", "xmax", "ymin", "ymax", places=2), "aspect")


# --- tagging effort ----------------------------------------------------------

CTES["deployed"] = """
    SELECT CAST(year(d) AS INTEGER) AS deploy_year, count(DISTINCT individual_local_identifier) AS n_new_deployments
    FROM (SELECT *, try_strptime(deploy_on_timestamp, '%Y-%m-%d') AS d FROM order_fixes)
    WHERE d IS NOT NULL GROUP BY 1"""
CTES["active"] = """
    SELECT CAST(year(strptime(timestamp, '%Y-%m-%d')) AS INTEGER) AS deploy_year,
           count(DISTINCT individual_local_identifier) AS n_active_tags
    FROM order_fixes GROUP BY 1"""

CTES["effort_years"] = """
    SELECT *, CAST(row_number() OVER (ORDER BY deploy_year DESC) AS INTEGER) AS year_order
    FROM (SELECT coalesce(d.deploy_year, a.deploy_year) AS deploy_year, coalesce(n_new_deployments, 0) AS n_new,
                 coalesce(n_active_tags, 0) AS n_act
          FROM deployed d FULL JOIN active a ON d.deploy_year = a.deploy_year
          WHERE coalesce(d.deploy_year, a.deploy_year) BETWEEN 1996 AND 2025)"""


@query("new_deployments", "SELECT deploy_year, n_new_deployments FROM deployed")
def _(spark, sf):
    return effort.new_deployments(v.order_fixes(spark, sf))


@query("active_tags", "SELECT deploy_year, n_active_tags FROM active")
def _(spark, sf):
    return effort.active_tags(v.order_fixes(spark, sf))


_EFFORT = """
       SELECT deploy_year, year_order, metric, n, CASE WHEN n > 0 THEN format('{:,}', n) ELSE '' END AS label
       FROM (SELECT deploy_year, year_order, 'New deployments' AS metric, n_new AS n FROM effort_years
             UNION ALL SELECT deploy_year, year_order, 'Active tags', n_act FROM effort_years)"""


@query("tag_effort", _EFFORT)
def _(spark, sf):
    return effort.tag_effort(v.order_fixes(spark, sf), 1996, 2025)


@query("tag_effort_typed", _EFFORT)
def _(spark, sf):
    """The same from typed columns: dates are stored as midnights."""
    typed = v.order_fixes(spark, sf).withColumns(
        {c: parse_timestamp(c) for c in ("timestamp", "deploy_on_timestamp")}
    )
    return effort.tag_effort(typed, 1996, 2025)


# --- routes ------------------------------------------------------------------

CTES["daily_fixes"] = """
    SELECT * FROM (SELECT *, CAST(timestamp AS DATE) AS date, row_number() OVER (
               PARTITION BY individual_local_identifier, CAST(timestamp AS DATE)
               ORDER BY timestamp, "X", "Y", deploy_on_timestamp, ground_speed NULLS LAST, hub, study_name,
                        study_site NULLS LAST, taxon_detail NULLS LAST) AS rn
           FROM timed WHERE timestamp > TIMESTAMP '1997-06-01' AND timestamp < TIMESTAMP '1998-06-01')
    WHERE rn = 1"""
CTES["tagged"] = """
    SELECT d.*, tag_site FROM daily_fixes d JOIN (
        SELECT individual_local_identifier AS bird, arg_min(site, timestamp) AS tag_site
        FROM (SELECT *, CASE WHEN regexp_matches(study_name, 'South Holland', 'i') THEN 'South Holland'
                             WHEN regexp_matches(study_name, 'Tagus|BtgTagus', 'i') THEN 'Tagus estuary'
                             WHEN regexp_matches(study_name, 'Extremadura', 'i') THEN 'Extremadura'
                             WHEN study_site = 'Dümmer' THEN 'Dümmer' WHEN study_site = 'Unterelbe' THEN 'Unterelbe'
                             WHEN study_site = 'NL' THEN 'SW Friesland' END AS site FROM daily_fixes)
        WHERE site IS NOT NULL GROUP BY 1) ON individual_local_identifier = bird"""
CTES["chosen"] = """
    SELECT tag_site AS site, individual_local_identifier AS bird, n_days
    FROM (SELECT *, row_number() OVER (PARTITION BY tag_site ORDER BY n_days DESC, individual_local_identifier) AS rn
          FROM (SELECT tag_site, individual_local_identifier, count(*) AS n_days FROM tagged GROUP BY 1, 2))
    WHERE rn = 1"""
PERIOD = ("1997-06-01", "1998-06-01")


@query(
    "first_daily_fix",
    """SELECT individual_local_identifier, date, timestamp, "X", "Y", event_id
       FROM (SELECT *, CAST(timestamp AS DATE) AS date, row_number() OVER (
                 PARTITION BY individual_local_identifier, CAST(timestamp AS DATE)
                 ORDER BY timestamp, "X", "Y", event_id) AS rn
             FROM event_fixes WHERE timestamp > TIMESTAMP '2024-01-03' AND timestamp < TIMESTAMP '2024-01-25')
       WHERE rn = 1""",
)
def _(spark, sf):
    out = routes.first_daily_fix(v.event_fixes(spark, sf), "2024-01-03", "2024-01-25")
    return out.select(ID, "date", "timestamp", "X", "Y", "event_id")


def _tagged(spark, sf):
    return routes.with_tag_site(routes.first_daily_fix(v.fixes(spark, sf), *PERIOD))


@query("tag_site", "SELECT individual_local_identifier, date, tag_site FROM tagged")
def _(spark, sf):
    return _tagged(spark, sf).select(ID, "date", "tag_site")


@query(
    "representative_bird",
    "SELECT site AS tag_site, bird AS individual_local_identifier, n_days FROM chosen",
)
def _(spark, sf):
    return routes.representative_bird(_tagged(spark, sf))


@query(
    "routes",
    """SELECT tag_site, individual_local_identifier, CAST(row_number() OVER (
                  PARTITION BY tag_site ORDER BY timestamp) - 1 AS INTEGER) AS pos,
              timestamp AS ts, "X" AS x, "Y" AS y
       FROM tagged JOIN chosen ON tag_site = site AND individual_local_identifier = bird""",
)
def _(spark, sf):
    lines = routes.routes(v.fixes(spark, sf), *PERIOD)
    return lines.select("tag_site", ID, F.posexplode("route").alias("pos", "point")).select(
        "tag_site", ID, "pos", "point.ts", "point.x", "point.y"
    )


CTES["route_points"] = _ORTHO.format(
    lon='"X"', lat='"Y"', source="tagged JOIN chosen ON tag_site = site AND individual_local_identifier = bird"
)


@query(
    "route_map",
    """SELECT tag_site, individual_local_identifier, timestamp, round(ox, 2) AS x, round(oy, 2) AS y
       FROM route_points""",
)
def _(spark, sf):
    points, _ = figures.route_map(v.fixes(spark, sf), *PERIOD)
    return rounded(points.select("tag_site", ID, "timestamp", "x", "y"), "x", "y", places=2)


@query(
    "route_extent",
    """SELECT round(a - 0.4 * (b - a), 2) AS xmin, round(b + 0.4 * (b - a), 2) AS xmax,
              round(c - 0.4 * (d - c), 2) AS ymin, round(d + 0.4 * (d - c), 2) AS ymax,
              round((b - a) / (d - c), 6) AS aspect
       FROM (SELECT min(ox) AS a, max(ox) AS b, min(oy) AS c, max(oy) AS d FROM route_points)""",
)
def _(spark, sf):
    _, box = figures.route_map(v.fixes(spark, sf), *PERIOD)
    return rounded(rounded(box, "xmin", "xmax", "ymin", "ymax", places=2), "aspect")


# --- regions -----------------------------------------------------------------

# Outlines: region, ring, corners. The square and the L overlap; the frame has a
# hole, wound the other way round; "elsewhere" is not asked for.
OUTLINES = [
    ("square", 1, [(-9.1, 38.75), (-8.8, 38.75), (-8.8, 39.05), (-9.1, 39.05)]),
    ("ell", 1, [(-9.0, 38.7), (-8.7, 38.7), (-8.7, 38.8), (-8.85, 38.8), (-8.85, 39.1), (-9.0, 39.1)]),
    ("frame", 1, [(-4.7, 15.15), (-4.35, 15.2), (-4.4, 15.45), (-4.65, 15.4)]),
    ("frame", 2, [(-4.55, 15.25), (-4.55, 15.35), (-4.45, 15.35), (-4.45, 15.25)]),
    ("elsewhere", 1, [(-16.4, 16.3), (-16.0, 16.3), (-16.0, 16.5), (-16.4, 16.5)]),
]
CTES["edges"] = "SELECT region, " + ", ".join(
    f"radians(lon{i}) * 6378137.0 AS x{i}, ln(tan(radians(lat{i}) / 2 + pi() / 4)) * 6378137.0 AS y{i}" for i in (1, 2)
) + " FROM (VALUES " + ", ".join(
    f"('{r}', {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)"
    for r, _, corners in OUTLINES
    for a, b in zip(corners, corners[1:] + corners[:1])
    if r != "elsewhere"
) + ") t(region, lon1, lat1, lon2, lat2)"
CTES["fix_points"] = """
    SELECT *, row_number() OVER () AS fix_no, radians("X") * 6378137.0 AS px,
           ln(tan(radians("Y") / 2 + pi() / 4)) * 6378137.0 AS py FROM fixes"""
CTES["windings"] = """
    SELECT fix_no, region,
           sum(CASE WHEN y1 <= py AND y2 > py AND turn > 0 THEN 1 WHEN y1 > py AND y2 <= py AND turn < 0 THEN -1 ELSE 0 END) AS wind,
           bool_or(turn = 0 AND px BETWEEN least(x1, x2) AND greatest(x1, x2)
                   AND py BETWEEN least(y1, y2) AND greatest(y1, y2)) AS on_edge
    FROM (SELECT *, (x2 - x1) * (py - y1) - (px - x1) * (y2 - y1) AS turn FROM fix_points CROSS JOIN edges)
    GROUP BY 1, 2"""


@query(
    "points_in_region",
    """SELECT individual_local_identifier, timestamp, "X", "Y" FROM fix_points
       WHERE fix_no IN (SELECT fix_no FROM windings WHERE wind <> 0 AND NOT on_edge)""",
)
def _(spark, sf):
    outlines = spark.createDataFrame(
        [(r, i, [{"x": x, "y": y} for x, y in c]) for r, i, c in OUTLINES],
        "region string, ring_id int, vertices array<struct<x:double,y:double>>",
    )
    out = regions.points_in_region(v.fixes(spark, sf), outlines, ["square", "ell", "frame"])
    return out.select(ID, "timestamp", "X", "Y")


@query(
    "clip_box",
    f"""SELECT {_FIX} FROM fixes WHERE "X" BETWEEN -9.5 AND 4 AND "Y" BETWEEN 36 AND 44.5""",
)
def _(spark, sf):
    return regions.clip_box(v.fixes(spark, sf), *REGION_BOXES["iberia"]).select(ID, "X", "Y", "timestamp")


@query(
    "clip_box_written",
    f"""SELECT {_FIX} FROM fixes WHERE "X" BETWEEN -9.5 AND 4 AND "Y" BETWEEN 36 AND 44.5""",
)
def _(spark, sf):
    """The same over locations written by cycle and place."""
    path = f"{shared_dir(spark)}/landed-{uuid.uuid4().hex}"
    write_locations(v.fixes(spark, sf), path)
    back = read_locations(spark, path, "parquet")
    return regions.clip_box(back, *REGION_BOXES["iberia"]).select(ID, "X", "Y", "timestamp")


def _box(region: str, west: float, south: float, east: float, north: float):
    return (region, 1, [(west, south), (east, south), (east, north), (west, north)])


# Two countries a view, with a border that runs through fixes.
COUNTRIES = [
    _box("Portugal", -9.603, 36.003, -8.94, 43.003),
    _box("Spain", -8.94, 36.003, 2.003, 43.003),
    _box("Senegal", -17.203, 12.003, -13.2, 17.003),
    _box("Mali", -13.2, 12.003, -3.001, 17.003),
    _box("France", -1.0, 36.0, 3.0, 50.0),
]


@query(
    "regional_map",
    """SELECT 'iberia' AS view, local_identifier, timestamp, location_long, location_lat FROM clean
       WHERE location_long > -9.603 AND location_long < 2.003 AND location_lat > 36.003 AND location_lat < 43.003
         AND location_long BETWEEN -9.5 AND 4 AND location_lat BETWEEN 36 AND 44.5
       UNION ALL
       SELECT 'west_africa', local_identifier, timestamp, location_long, location_lat FROM clean
       WHERE location_long > -17.203 AND location_long < -3.001 AND location_lat > 12.003 AND location_lat < 17.003
         AND location_long BETWEEN -20 AND 0 AND location_lat BETWEEN 0 AND 38""",
)
def _(spark, sf):
    outlines = spark.createDataFrame(
        [(r, i, [{"x": x, "y": y} for x, y in c]) for r, i, c in COUNTRIES],
        "region string, ring_id int, vertices array<struct<x:double,y:double>>",
    )
    fixes = stage(hub_fixes(spark, sf), "hub-fixes")
    views = [
        figures.regional_map(fixes, outlines, view).select(
            F.lit(view).alias("view"), "local_identifier", "timestamp", "location_long", "location_lat"
        )
        for view in REGION_BOXES
    ]
    return views[0].unionByName(views[1])
