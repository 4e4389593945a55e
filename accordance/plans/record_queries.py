"""Queries on samples, heights, optional joins, files written and read back, records, artifacts and contracts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordance.functions.classify import altitude_band, height_above, release_marker, rounded
from accordance.operators import agreement as ops
from accordance.operators import context, contracts, frame, ranking, telemetry
from accordance.operators.tables import shared_folder
from accordance.plans import agreement_queries as pairs_sql
from accordance.plans import bindings, context_queries, frame_queries
from accordance.plans.bindings import BAND
from accordance.session import table
from accordance.sources import readers, sinks

FIRST = 50
MAGIC, LEAST = "54", 500  # of texts, for want of logs: a first letter T
FIELD_COVERAGE = ("2023-12-01", "2024-01-15", "2024-01-25")
CUSTOMER_SCHEMA = {
    "required": ["c_custkey", "c_name"],
    "properties": {"c_custkey": {"type": "integer", "minimum": 1}, "c_name": {"type": "string"}, "c_nationkey": {"type": "integer", "maximum": 20}, "c_acctbal": {"type": "number", "minimum": 0}, "c_mktsegment": {"enum": ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY"]}},
}


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- samples and frames -----------------------------------------------------------------------


def sample_restriction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the inventory inside the sample by stratum, and all that lie outside it."""
    sample = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("log_id"))
    inside, outside = frame.restricted(bindings.inventory(spark, sf_dir), sample)
    return inside.groupBy("stratum").agg(F.count(F.lit(1)).alias("inside")).crossJoin(F.broadcast(outside))  # one row


def sample_in_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders drawn by their customer's dashed id, checked against the frame of plain ids; counts by segment."""
    known = table(spark, sf_dir, "customer").select(F.md5(F.col("c_custkey").cast("string")).alias("log_id"), F.col("c_mktsegment").alias("segment"))
    digest = F.md5(F.col("o_custkey").cast("string"))
    dashed = F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    sample = frame.require_within(table(spark, sf_dir, "orders").select(dashed.alias("log_id")), known)
    joined = sample.select(frame.plain_id(F.col("log_id")).alias("log_id")).join(known, "log_id")
    return joined.groupBy("segment").agg(F.count(F.lit(1)).alias("drawn"), F.count_distinct("log_id").alias("ids"))


def first_usable_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty usable runs: a report of fixed length."""
    return frame.first_usable(frame_queries.usable(bindings.inventory(spark, sf_dir)), FIRST).select("log_id", "stratum")


def inventory_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many runs of each stratum have each topic."""
    return bindings.inventory(spark, sf_dir).groupBy("stratum").agg(F.count_if("wind_present").alias("wind"), F.count_if("position_present").alias("position"), F.count_if(F.col("wind_present") & F.col("position_present")).alias("both"))


# --- heights and optional joins ---------------------------------------------------------------


def _heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Downward positions: events as samples, some marked invalid, some not a number."""
    k = F.get_json_object("props", "$.k").cast("double")
    z = F.when(k % 10 == 3, F.lit(float("nan"))).otherwise(20 - F.col("value") * 2)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), height_above(z, F.col("event_type") != "error").alias("height_m"))


def _run_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _heights(spark, sf_dir).filter("height_m is not null")
    runs = ranking.linear_quantiles(rows, ["run_id"], "height_m", {"median_m": 0.5, "p90_m": 0.9})
    return runs.join(rows.groupBy("run_id").agg(F.max("height_m").alias("max_m"), F.count(F.lit(1)).alias("n")), "run_id")


def height_per_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _run_heights(spark, sf_dir)
    return out.select("run_id", *[rounded(F.col(c)).alias(c) for c in ("median_m", "p90_m", "max_m")], "n", altitude_band(F.col("median_m")).alias("band"))


def height_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, median and greatest of the runs' medians, and the runs in each band."""
    runs = _run_heights(spark, sf_dir).withColumn("all", F.lit("all"))
    ends = runs.agg(F.round(F.min("median_m"), 1).alias("least"), F.round(F.max("median_m"), 1).alias("greatest"))
    middle = ranking.linear_quantiles(runs, ["all"], "median_m", {"median": 0.5}).select(F.round("median", 1).alias("median"))
    span = ends.crossJoin(middle).unpivot([], ["least", "median", "greatest"], "name", "value")  # one row each
    bands = runs.groupBy(altitude_band(F.col("median_m")).alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return span.unionByName(bands)


def pairs_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with heights, airspeed flags and strata from tables that know only some of the runs; none is lost."""
    known = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("run_id"), (F.col("lang") == "en").alias("has_airspeed"))
    strata = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("run_id"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("stratum"))
    heights = _run_heights(spark, sf_dir).select("run_id", F.col("median_m").alias("height_m"))
    out = context.with_optional(bindings.pairs(spark, sf_dir), heights, known, strata)
    return out.groupBy(altitude_band(F.col("height_m")).alias("band"), "has_airspeed", "stratum").agg(F.count(F.lit(1)).alias("n"))


# --- files written and read back --------------------------------------------------------------


def topic_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and columns of each run's topics: suppliers and customers of a nation written as two topics of a run, one without a column."""
    root = _folder(spark, "topics")
    wind = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("run_id"), F.lit("wind").alias("topic"), F.col("s_suppkey").alias("timestamp"), F.col("s_acctbal").alias("windspeed_north"))
    place = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("run_id"), F.lit("vehicle_global_position").alias("topic"), F.col("c_custkey").alias("timestamp"), F.col("c_acctbal").alias("lat"), F.when(F.col("c_nationkey") % 2 == 0, F.col("c_acctbal")).alias("lon"))
    for rows in (wind, place):
        rows.write.mode("append").partitionBy("run_id", "topic").parquet(root)
    return readers.topic_rows(spark, root, "wind").unionByName(readers.topic_rows(spark, root, "vehicle_global_position"))


def json_lines_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as JSON lines, read back strictly, and summed up by nation."""
    path = _folder(spark, "lines")
    rows = table(spark, sf_dir, "customer")
    sinks.write_lines(rows, path)
    back = readers.json_lines(spark, path, rows.schema, strict=True)
    return back.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def exclusions_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exclusion list written and loaded: counts by kind, and a digest of its entries in any order."""
    path = _folder(spark, "exclusions")
    sinks.write_lines(bindings.objections(spark, sf_dir), path)
    entry = F.conv(F.substring(F.md5(F.concat_ws(":", "kind", "value")), 1, 8), 16, 10).cast("long")
    return readers.exclusions(spark, path).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(entry).alias("digest"))


def availability_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts appended to a log in two goes; the last attempt wins."""
    path = _folder(spark, "attempts")
    tries = bindings.attempts(spark, sf_dir)
    for first in (True, False):
        sinks.append_observations(tries.filter((F.col("attempt") <= 2) == first), path)
    back = spark.read.schema(tries.schema).parquet(path)
    return back.groupBy("log_id").agg(F.max_by("available", "attempt").alias("available"), F.max("attempt").cast("long").alias("attempts"))


def magic_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as files: long enough and with the asked first byte, by language."""
    content = F.encode(F.col("text"), "UTF-8")
    good = readers.is_log(content, F.octet_length("text"), MAGIC, LEAST)
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("files"), F.count_if(good).alias("logs"))


def written_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables written with their records, which are checked against what was written and must come from a known state."""
    names = ("region", "nation", "supplier")
    made = [sinks.recorded(table(spark, sf_dir, n), _folder(spark, n), n, seed=1, revision="r1", clean=True) for n in names]
    records = sinks.publishable(made[0].unionByName(made[1]).unionByName(made[2]))
    return records.join(sinks.intact(spark, records), "name").select("name", "rows", F.size(F.split("columns", ", ")).cast("long").alias("n_columns"), "intact", (F.length("digest") == 24).alias("digested"))


def summary_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame's audit written as one JSON file and read back."""
    path, made = _folder(spark, "summary"), frame_queries.population_audit(spark, sf_dir)
    sinks.write_summary(made, path)
    return spark.read.schema(made.schema).json(path)


# --- clocks and context -----------------------------------------------------------------------


def utc_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and last time of each run's readings, from the boot clock and the run's anchor."""
    gps = bindings.gps(spark, sf_dir)
    rows = gps.join(telemetry.clock_anchors(gps).select("run_id", "offset_us"), "run_id")
    at = telemetry.to_utc(F.col("boot_us"), F.col("offset_us"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return rows.groupBy("run_id").agg(text(F.min(at)).alias("first"), text(F.max(at)).alias("last"), F.count(at).alias("n"))


def midpoint_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated windows by the release of the later of their two hours, with the source's record."""
    out = context.midpoint(bindings.daily(spark, sf_dir), bindings.grid(spark, sf_dir))
    marker = release_marker(F.col("later_time"), *FIELD_COVERAGE)
    source = context.source_metadata(marker, FIELD_COVERAGE, F.date_format("window_start", "yyyy-MM"))
    out = out.withColumn("source", source)
    return out.groupBy(F.coalesce("source.release", F.lit("none")).alias("release"), F.col("source.coverage.stop").alias("stop"), F.col("source.retrieved_at").alias("month")).agg(F.count(F.lit(1)).alias("windows"), F.count("u100").alias("paired"))


def join_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why windows weren't paired, which flags the paired ones carry, and their releases: (kind, name, n)."""
    out = context_queries.joined(spark, sf_dir)
    paired = F.col("u100").isNotNull()
    marker = F.coalesce(release_marker(F.col("window_start"), *FIELD_COVERAGE), F.lit("none"))
    named = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    flags = F.transform("quality_flags", lambda x: named("flag", x))
    entries = F.when(paired, F.concat(flags, F.array(named("release", marker)))).otherwise(F.array(named("reason", F.lit("no field value"))))
    return out.select(F.explode(entries).alias("e")).groupBy("e.kind", "e.name").agg(F.count(F.lit(1)).alias("n"))


# --- artifacts and contracts ------------------------------------------------------------------


def artifact_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The artifacts flat: every axis cell, the strata and all together, at both levels and under both weightings."""
    rows, axes = pairs_sql._axis_pairs(spark, sf_dir, pooled=True)
    out = ops.cell_statistics(rows, axes, {"sample": None, "reweighted": "design_weight"}, ("du", "dv"), {"p50": 0.5, "p97_5": 0.975})
    return pairs_sql.rounded_doubles(out.withColumn("useful", F.col("p97_5") <= BAND))


def artifact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single artifacts by cell, level and pooling; a missing one fails the query."""
    made = pairs_sql.regime_agreement(spark, sf_dir)
    asked = [("airframe", "vtol", "100m"), ("season", "JJA", "10m"), ("estimator_sigma", "sigma_ge_1.0", "100m")]
    return ops.looked_up(made, asked).select("axis", "cell", "level", "n_windows", "p97_5")


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a report's table of cells, filled from the artifacts and numbered."""
    made = pairs_sql.regime_agreement(spark, sf_dir)
    cells, counts = pairs_sql.forest_places(made), made.filter("level = '100m'").select("axis", "cell", "n_windows", "n_runs")
    word = F.when(F.col("useful"), "within the band").otherwise("beyond the band")
    return cells.join(counts, ["axis", "cell"]).select("axis", "place", F.format_string("| %s | %s | %d windows of %d runs | %s |", "axis", "cell", "n_windows", "n_runs", word).alias("line"))


def artifact_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules among artifacts of which some are broken on purpose: unit by season, no v by airframe, thin cells by altitude."""
    cells = pairs_sql.regime_agreement(spark, sf_dir)
    limits = lambda x: F.struct(F.col(f"bias_{x}").alias("bias"), F.array(f"loa_low_{x}", f"loa_high_{x}").alias("limits_of_agreement"))
    on = lambda axis: F.col("axis") == axis
    broken = cells.select(
        F.concat_ws("-", "axis", "cell", "level").alias("validation_model_id"),
        F.struct(limits("du").alias("u"), F.when(~on("airframe"), limits("dv")).alias("v"), F.struct("p50", "p97_5").alias("vector_difference_magnitude")).alias("statistics"),
        F.struct(F.when(on("season"), "window").otherwise("run").alias("unit")).alias("bootstrap"),
        F.struct(F.col("n_windows").alias("n_defined"), F.lit(0).alias("n_undefined")).alias("direction"),
        F.struct("n_windows", F.when(on("altitude_proxy"), 3).otherwise(F.col("n_runs")).alias("n_runs"), "n_vehicles").alias("support"),
    )
    return contracts.violations(broken, "validation_model_id", contracts.artifact_rules())


def feature_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context features whose uncertainty names its model but not its regime, or that miss their distance's bound."""
    rows = context_queries.joined(spark, sf_dir).filter("u100 is not null")
    named = F.struct(F.lit("m1").alias("validation_model_id"), F.when(F.col("run_id") % 5 != 0, F.lit("r1")).alias("validation_regime"))
    out = rows.select(F.concat_ws("@", "run_id", F.date_format("window_start", "yyyy-MM-dd")).alias("key"), "run_id", "window_start", F.lit("wind_u_100m").alias("feature_name"), (F.col("distance_km") - 1).alias("distance_km"), F.when(F.col("run_id") % 3 != 0, named).alias("context_uncertainty"))
    return contracts.violations(out, "key", contracts.feature_rules())


def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers against a schema: types, required fields, ranges, allowed values, and no further fields."""
    rows = table(spark, sf_dir, "customer").withColumn("c_acctbal", F.when(F.col("c_custkey") % 10 == 0, F.lit("n/a")).otherwise(F.col("c_acctbal").cast("string"))).withColumn("c_name", F.when(F.col("c_custkey") % 7 != 0, F.col("c_name"))).withColumn("c_note", F.when(F.col("c_custkey") % 50 == 0, "x"))
    return contracts.violations(rows, "c_custkey", contracts.schema_rules(CUSTOMER_SCHEMA, rows.columns))


QUERIES = [sample_restriction, sample_in_frame, first_usable_runs, inventory_presence, height_per_run, height_summary, pairs_optional, topic_inventory, json_lines_scan, exclusions_read, availability_log, magic_bytes, written_records, summary_json, utc_recovered, midpoint_release, join_reasons, artifact_table, artifact_lookup, report_lines, artifact_violations, feature_violations, schema_violations]

R = pairs_sql.R
HEIGHTS = "hs AS (SELECT user_id AS run_id, CASE WHEN event_type <> 'error' AND json_extract_string(props, '$.k')::DOUBLE % 10 <> 3 THEN value * 2 - 20 END AS h FROM events), hr AS (SELECT run_id, quantile_cont(h, 0.5) AS q5, quantile_cont(h, 0.9) AS q9, max(h) AS mx, count(*) AS n FROM hs WHERE h IS NOT NULL GROUP BY run_id)"
BANDS = lambda c: f"CASE WHEN {c} IS NULL OR {c} < -50 OR {c} > 5000 THEN 'unknown' WHEN {c} < 50 THEN 'agl_proxy_lt_50m' WHEN {c} < 120 THEN 'agl_proxy_50_to_120m' ELSE 'agl_proxy_ge_120m' END"
MARKER = lambda day: f"CASE WHEN {day} IS NULL OR {day} < DATE '2023-12-01' THEN 'none' WHEN {day} <= DATE '2024-01-15' THEN '0001' WHEN {day} <= DATE '2024-01-25' THEN '0005' ELSE 'none' END"
POOLED = f"{pairs_sql.LEVELS}, {pairs_sql.STRATA}, {pairs_sql.CELLS}, rp AS (SELECT * FROM rc UNION ALL SELECT *, 'pooled', 'all' FROM lv UNION ALL SELECT *, 'stratum', stratum FROM lv), rw AS (SELECT rp.*, frame_size / 800e0 AS dw FROM rp JOIN st USING (stratum))"
SIGNED = ", ".join(f"{R(f'm{x}', f'bias_{x}')}, {R(f's{x}', f'sd_{x}')}, {R(f'm{x} - 1.96e0 * s{x}', f'loa_low_{x}')}, {R(f'm{x} + 1.96e0 * s{x}', f'loa_high_{x}')}" for x in ("du", "dv"))
MOMENTS = lambda w, name: f"""{name}m AS (SELECT axis, cell, level, sum({w}) AS sw, sum({w} * du) / sum({w}) AS mdu, sum({w} * dv) / sum({w}) AS mdv FROM rw GROUP BY ALL),
  {name}s AS (SELECT axis, cell, level, any_value(mdu) AS mdu, any_value(mdv) AS mdv, sqrt(sum({w} * (du - mdu) * (du - mdu)) / (any_value(sw) - 1)) AS sdu, sqrt(sum({w} * (dv - mdv) * (dv - mdv)) / (any_value(sw) - 1)) AS sdv FROM rw JOIN {name}m USING (axis, cell, level) GROUP BY axis, cell, level)"""  # noqa: E731

ORACLES = {
    "sample_restriction": f"WITH {frame_queries.INVENTORY} SELECT stratum, count(*) AS inside, (SELECT count(*) FROM inv WHERE log_id NOT IN (SELECT doc_id FROM labels)) AS outside FROM inv WHERE log_id IN (SELECT doc_id FROM labels) GROUP BY stratum",
    "sample_in_frame": "SELECT c_mktsegment AS segment, count(*) AS drawn, count(DISTINCT o_custkey) AS ids FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    "first_usable_runs": f"WITH {frame_queries.INVENTORY} SELECT log_id, stratum FROM u WHERE usable ORDER BY log_id LIMIT {FIRST}",
    "inventory_presence": f"WITH {frame_queries.INVENTORY} SELECT stratum, count_if(wp)::BIGINT AS wind, count_if(pp)::BIGINT AS position, count_if(wp AND pp)::BIGINT AS both FROM inv GROUP BY stratum",
    "height_per_run": f"WITH {HEIGHTS} SELECT run_id, {R('q5', 'median_m')}, {R('q9', 'p90_m')}, {R('mx', 'max_m')}, n, {BANDS('q5')} AS band FROM hr",
    "height_summary": f"WITH {HEIGHTS} SELECT 'least' AS name, round(min(q5), 1) AS value FROM hr UNION ALL SELECT 'median', round(quantile_cont(q5, 0.5), 1) FROM hr UNION ALL SELECT 'greatest', round(max(q5), 1) FROM hr UNION ALL SELECT {BANDS('q5')}, count(*)::DOUBLE FROM hr GROUP BY 1",
    "pairs_optional": f"""WITH {HEIGHTS}, {pairs_sql.PAIRS} SELECT {BANDS('q5')} AS band, coalesce(d.lang = 'en', false) AS has_airspeed, coalesce('q' || quality, 'unknown') AS stratum, count(*) AS n
      FROM pairs p LEFT JOIN hr ON p.run_id = hr.run_id LEFT JOIN documents d ON p.run_id = d.doc_id LEFT JOIN labels l ON p.run_id = l.doc_id GROUP BY ALL""",
    "topic_inventory": """SELECT s_nationkey::BIGINT AS run_id, 'wind' AS topic, count(*) AS rows, 'timestamp,windspeed_north' AS columns FROM supplier GROUP BY ALL
      UNION ALL SELECT c_nationkey::BIGINT, 'vehicle_global_position', count(*), CASE WHEN c_nationkey % 2 = 0 THEN 'timestamp,lat,lon' ELSE 'timestamp,lat' END FROM customer GROUP BY ALL""",
    "json_lines_scan": "SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1",
    "exclusions_read": """WITH o AS (SELECT 'vehicle_uuid' AS kind, c_custkey AS value FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'log_id', o_orderkey FROM orders WHERE o_totalprice > 450000)
      SELECT kind, count(*) AS n, sum(('0x' || substr(md5(kind || ':' || value), 1, 8))::BIGINT)::BIGINT AS digest FROM o GROUP BY kind""",
    "availability_log": f"WITH {frame_queries.LAST} SELECT * FROM last",
    "magic_bytes": f"SELECT lang, count(*) AS files, count_if(text[1] = 'T' AND strlen(text) >= {LEAST})::BIGINT AS logs FROM documents GROUP BY lang",
    "written_records": "SELECT 'region' AS name, count(*) AS rows, 2::BIGINT AS n_columns, true AS intact, true AS digested FROM region UNION ALL SELECT 'nation', count(*), 3, true, true FROM nation UNION ALL SELECT 'supplier', count(*), 4, true, true FROM supplier",
    "summary_json": frame_queries.ORACLES["population_audit"],
    "utc_recovered": f"WITH {context_queries.GPS}, t AS (SELECT run_id, make_timestamp(boot_us + offset_us) AS utc FROM gps JOIN anchors USING (run_id)) SELECT run_id, strftime(min(utc), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(utc), '%Y-%m-%d %H:%M:%S') AS last, count(utc) AS n FROM t GROUP BY run_id",
    "midpoint_release": f"""WITH {context_queries.FIELD}, m AS (SELECT {MARKER('n.time::DATE')} AS release, strftime(j.window_start, '%Y-%m') AS month, (j.u100 + n.u100) / 2 AS u FROM j LEFT JOIN grid n ON n.time = j.window_start + INTERVAL 1 HOUR AND n.la = j.la AND n.lo = j.lo)
      SELECT release, '2024-01-15' AS stop, month, count(*) AS windows, count(u) AS paired FROM m GROUP BY ALL""",
    "join_reasons": f"""WITH {context_queries.FIELD}, e AS (SELECT CASE WHEN u100 IS NULL THEN 'reason' ELSE 'release' END AS kind, CASE WHEN u100 IS NULL THEN 'no field value' ELSE {MARKER('window_start::DATE')} END AS name FROM jd
      UNION ALL SELECT 'flag', 'outside_spatial_tolerance' FROM jd WHERE u100 IS NOT NULL AND distance_km > 30 UNION ALL SELECT 'flag', 'outside_temporal_tolerance' FROM jd WHERE u100 IS NOT NULL AND abs(mismatch_s) > 3600) SELECT kind, name, count(*) AS n FROM e GROUP BY ALL""",
    "artifact_table": f"""WITH {POOLED}, {MOMENTS('1e0', 'o')}, {MOMENTS('dw', 'd')}, {pairs_sql._quantiles('rw', 'axis, cell, level', {'p50': 0.5, 'p97_5': 0.975}, name='oq')}, {pairs_sql._quantiles('rw', 'axis, cell, level', {'p50': 0.5, 'p97_5': 0.975}, 'dw', name='dq')},
      pc AS (SELECT axis, cell, level, {pairs_sql.COUNTS} FROM rw GROUP BY ALL HAVING {pairs_sql.PUBLISHED}),
      f AS (SELECT pc.*, mdu, mdv, sdu, sdv, p50, p97_5, 'sample' AS pooling FROM pc JOIN os USING (axis, cell, level) JOIN oq USING (axis, cell, level) UNION ALL SELECT pc.*, mdu, mdv, sdu, sdv, p50, p97_5, 'reweighted' FROM pc JOIN ds USING (axis, cell, level) JOIN dq USING (axis, cell, level))
      SELECT axis, cell, level, n_windows, n_runs, n_vehicles, {SIGNED}, {R('p50', 'p50')}, {R('p97_5', 'p97_5')}, pooling, f.p97_5 <= {BAND} AS useful FROM f""",
    "artifact_lookup": f"WITH {pairs_sql.REGIMES} SELECT axis, cell, level, n_windows, p97_5 FROM regimes WHERE (axis, cell, level) IN (('airframe', 'vtol', '100m'), ('season', 'JJA', '10m'), ('estimator_sigma', 'sigma_ge_1.0', '100m'))",
    "report_lines": f"WITH {pairs_sql.REGIMES} SELECT axis, row_number() OVER (PARTITION BY axis ORDER BY p97_5 DESC, cell) AS place, '| ' || axis || ' | ' || cell || ' | ' || n_windows || ' windows of ' || n_runs || ' runs | ' || (CASE WHEN p97_5 <= {BAND} THEN 'within the band' ELSE 'beyond the band' END) || ' |' AS line FROM regimes WHERE level = '100m'",
    "artifact_violations": f"""WITH {pairs_sql.REGIMES}, k AS (SELECT axis || '-' || cell || '-' || level AS key, axis FROM regimes) SELECT key, 'bootstrap.unit' AS path, 'const' AS rule FROM k WHERE axis = 'season' UNION ALL SELECT key, 'statistics.v', 'required' FROM k WHERE axis = 'airframe'
      UNION ALL SELECT key, 'statistics.v.limits_of_agreement', 'ordered' FROM k WHERE axis = 'airframe' UNION ALL SELECT key, 'support.n_runs', 'minimum' FROM k WHERE axis = 'altitude_proxy'""",
    "feature_violations": f"""WITH {context_queries.FIELD}, k AS (SELECT run_id || '@' || strftime(window_start, '%Y-%m-%d') AS key, run_id, distance_km - 1 AS d FROM jd WHERE u100 IS NOT NULL) SELECT key, 'distance_km' AS path, 'minimum' AS rule FROM k WHERE d < 0 UNION ALL SELECT key, 'context_uncertainty', 'required' FROM k WHERE run_id % 3 <> 0 AND run_id % 5 = 0""",
    "schema_violations": """SELECT c_custkey AS key, 'c_custkey' AS path, 'minimum' AS rule FROM customer WHERE c_custkey < 1 UNION ALL SELECT c_custkey, 'c_name', 'required' FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT c_custkey, 'c_nationkey', 'maximum' FROM customer WHERE c_nationkey > 20
      UNION ALL SELECT c_custkey, 'c_acctbal', 'type' FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT c_custkey, 'c_acctbal', 'minimum' FROM customer WHERE c_acctbal < 0 AND c_custkey % 10 <> 0 UNION ALL SELECT c_custkey, 'c_mktsegment', 'enum' FROM customer WHERE c_mktsegment = 'HOUSEHOLD' UNION ALL SELECT c_custkey, 'c_note', 'additional' FROM customer WHERE c_custkey % 50 = 0""",
}
