"""Queries on the frame: audit, tiers, retention, eligibility, sampling, inventory, availability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordance.functions import classify
from accordance.functions.classify import rounded
from accordance.operators import frame as ops
from accordance.operators import ranking, sampling
from accordance.plans import bindings

SAMPLE_SEED, PER_STRATUM = 20260825, 25


def population_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.audit(bindings.frame(spark, sf_dir))


def population_by_key_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ops.key_counts(bindings.frame(spark, sf_dir).withColumn("year", F.substring("log_date", 1, 4)), ["hw", "mav_type", "type", "year", "nation"])
    return ops.top_per_key(counts)


def duration_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.duration_tiers(bindings.frame(spark, sf_dir))


def duration_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = bindings.frame(spark, sf_dir).filter(~F.col("simulated") & ops.plausible())
    return ranking.nearest_rank(base, ["type"], "duration_s", {"p50": 0.5, "p90": 0.9, "p99": 0.99, "longest": 1.0})


def retention_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.retention(bindings.frame(spark, sf_dir).filter(~F.col("simulated") & ops.plausible() & (F.col("duration_s") >= ops.MIN_DURATION_S)))


def airframe_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = bindings.frame(spark, sf_dir).filter(~F.col("simulated"))
    kind = F.col("mav_type")
    return base.groupBy(classify.airframe_family(kind).alias("family"), classify.airframe_cell(kind).alias("cell"), classify.airframe_regime(kind).alias("regime")).agg(F.count(F.lit(1)).alias("n"))


def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by type for all records, the real and the simulated."""
    base = bindings.frame(spark, sf_dir)
    rolled = base.rollup("type", "simulated").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level")).filter("level < 3")
    population = F.when(F.col("level") == 1, "all").when(F.col("simulated"), "simulated").otherwise("real")
    return rolled.select("type", population.alias("population"), "n")


def declared_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = bindings.frame(spark, sf_dir)
    return base.groupBy(classify.falsy(F.col("type"), "unset").alias("type")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("wind") >= 0).alias("declared"))


def wind_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.frame(spark, sf_dir).groupBy(classify.wind_label(F.col("wind")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def label_explode_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each element of a run's list counts once for each time it stands there."""
    base = bindings.pairs(spark, sf_dir).groupBy("run_id").agg(F.collect_list(F.col("part") % 12).alias("labels"))  # at most a run's windows
    return base.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def frame_eligible_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.eligible(bindings.frame(spark, sf_dir), bindings.objections(spark, sf_dir)).select("log_id", "vehicle", rounded(F.col("duration_s")).alias("duration_s"))


def _stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ops.with_side(ops.eligible(bindings.frame(spark, sf_dir), bindings.objections(spark, sf_dir)))
    return base.withColumn("stratum", F.concat_ws("|", classify.airframe_cell(F.col("mav_type")), "side"))


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.draw(_stratified(spark, sf_dir), PER_STRATUM, SAMPLE_SEED).select("log_id", "stratum", "log_date", "vehicle", "place")


def sample_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _stratified(spark, sf_dir)
    sizes = base.groupBy("stratum").agg(F.count(F.lit(1)).alias("frame_size"), F.count_distinct("vehicle").alias("frame_vehicles"))
    drawn = sampling.draw(base, PER_STRATUM, SAMPLE_SEED).groupBy("stratum").agg(F.count(F.lit(1)).alias("drawn"))
    return sizes.join(drawn, "stratum", "left").select("stratum", "frame_size", "frame_vehicles", F.coalesce("drawn", F.lit(0)).alias("drawn"))


def last_attempt_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    tries = bindings.attempts(spark, sf_dir)
    return tries.groupBy("log_id").agg(F.max_by("available", "attempt").alias("available"), F.max("attempt").cast("long").alias("attempts"))


def availability_tristate(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = last_attempt_wins(spark, sf_dir)
    base = ops.with_side(bindings.frame(spark, sf_dir)).join(last, "log_id", "left")
    seen = F.col("available").isNotNull()
    return base.groupBy("side").agg(
        F.count(F.lit(1)).alias("requested"), F.count_if("available").alias("available"), F.count_if(~seen).alias("unobserved"),
        F.count_if(seen & ~F.col("available")).alias("missing"), F.min(F.when(F.col("available"), F.col("log_date"))).alias("oldest_available"),
    )


def retrieval_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every requested run as converted, downloaded or pending, and pending runs in numbered chunks of a hundred of their stratum."""
    last = last_attempt_wins(spark, sf_dir)
    base = ops.with_side(bindings.frame(spark, sf_dir)).join(last, "log_id", "left")
    state = F.when(F.col("available"), "converted").when(F.col("available").isNotNull(), "downloaded").otherwise("pending")
    out = ranking.ranked(base.withColumn("state", state).withColumn("cell", F.concat_ws("|", "side", "type")), ["cell", "state"], "log_id")
    return out.select("log_id", "cell", "state", F.when(F.col("state") == "pending", F.floor((F.col("rank") - 1) / 100)).cast("long").alias("chunk"))


def usable(df: DataFrame) -> DataFrame:
    topics = ("wind", "position")
    missing = classify.flags(*[(t, ~F.col(f"{t}_present")) for t in topics])
    empty = classify.flags(*[(t, F.col(f"{t}_present") & (F.coalesce(f"{t}_rows", F.lit(0)) <= 0)) for t in topics])
    df = df.withColumn("missing_required", missing).withColumn("empty_required", empty)
    return df.withColumn("usable", (F.size("missing_required") == 0) & (F.size("empty_required") == 0) & F.col("columns_present") & F.col("absolute_time"))


def inventory_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = usable(bindings.inventory(spark, sf_dir))
    return base.groupBy("stratum").agg(F.count(F.lit(1)).alias("runs"), F.count_if("usable").alias("usable"), rounded(F.count_if("usable") / F.count(F.lit(1)), 4).alias("usable_rate"))


def inventory_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why runs are unusable; a run may have several reasons, but absent columns only count if nothing else is wrong."""
    base = usable(bindings.inventory(spark, sf_dir)).filter(~F.col("usable"))
    late = F.when(~F.col("absolute_time"), "no_absolute_time").when((F.size("missing_required") == 0) & (F.size("empty_required") == 0), "columns_absent")
    reasons = F.concat(F.transform("missing_required", lambda x: F.concat(F.lit("missing:"), x)), F.transform("empty_required", lambda x: F.concat(F.lit("empty:"), x)), F.filter(F.array(late), lambda x: x.isNotNull()))
    return base.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


QUERIES = [population_audit, population_by_key_topk, duration_tiers, duration_nearest_rank, retention_exposure, airframe_partition, split_counts, declared_by_type, wind_labels, label_explode_counts, frame_eligible_anti, stratified_sample, sample_summary, last_attempt_wins, availability_tristate, retrieval_plan, inventory_usable, inventory_reasons]

FRAME = """frame AS (SELECT o_orderkey AS log_id, strftime(o_orderdate, '%Y-%m-%d') AS log_date, o_custkey AS vehicle,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Ground Rover' WHEN 'BUILDING' THEN 'Quadrotor' WHEN 'FURNITURE' THEN 'Fixed Wing' WHEN 'MACHINERY' THEN 'Tiltrotor VTOL' WHEN 'HOUSEHOLD' THEN 'Hexarotor' ELSE 'Quadrotor' END AS mav_type,
  o_orderstatus AS type, o_orderpriority AS hw, o_orderpriority = '5-LOW' AS simulated, o_totalprice / 5e0 AS duration_s,
  CASE WHEN o_orderstatus = 'F' THEN [0, 5, 8, 10][(o_orderkey % 4 + 1)::INT] ELSE -1 END AS wind, c_nationkey AS nation
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
REAL = "NOT simulated AND coalesce(duration_s BETWEEN 0 AND 86400, false)"
SIDED = f"{FRAME}, cutoff AS (SELECT strftime(max(log_date)::DATE - 365, '%Y-%m-%d') AS cutoff FROM frame), sided AS (SELECT frame.*, CASE WHEN log_date >= cutoff THEN 'within' ELSE 'older' END AS side FROM frame, cutoff)"
ELIGIBLE = f"""{FRAME}, eligible AS (SELECT * FROM frame WHERE {REAL} AND duration_s >= 300
  AND log_id NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 450000) AND vehicle NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0))"""
STRATIFIED = f"""{ELIGIBLE}, cutoff AS (SELECT strftime(max(log_date)::DATE - 365, '%Y-%m-%d') AS cutoff FROM eligible),
  base AS (SELECT eligible.*, (CASE WHEN regexp_matches(mav_type, 'Fixed|Plane|VTOL') THEN 'fixed_wing_or_vtol' ELSE 'rotorcraft' END) || '|' || (CASE WHEN log_date >= cutoff THEN 'within' ELSE 'older' END) AS stratum,
    ('0x' || substr(md5('20260825:' || log_id), 1, 8))::BIGINT AS place FROM eligible, cutoff)"""


def _rounds(rounds: int) -> str:
    """The sampling rule unrolled: each round's candidates, what fills first, and the rows that are left."""
    parts, rows = [], "base"
    for i in range(rounds):
        parts.append(f"""f{i} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vehicle ORDER BY place, log_id) AS rv FROM {rows}) WHERE rv = 1 OR vehicle IS NULL),
  t{i} AS (SELECT * EXCLUDE (rv), row_number() OVER (PARTITION BY stratum ORDER BY place, log_id) AS rs FROM f{i}),
  e{i} AS (SELECT stratum, place, log_id FROM t{i} WHERE rs = 25 {"AND stratum NOT IN (SELECT stratum FROM closed" + str(i - 1) + ")" if i else ""} ORDER BY place, log_id LIMIT 1),
  closed{i} AS (SELECT * FROM e{i}{f" UNION ALL SELECT * FROM closed{i - 1}" if i else ""}),
  r{i} AS (SELECT r.* FROM {rows} r LEFT JOIN e{i} e ON r.stratum = e.stratum WHERE e.stratum IS NULL OR (r.place, r.log_id) <= (e.place, e.log_id))""")
        rows = f"r{i}"
    return ",\n".join(parts)


SAMPLE = f"{STRATIFIED}, {_rounds(5)}, drawn AS (SELECT * FROM t4 WHERE rs <= 25)"
LAST = """tries AS (SELECT l_orderkey AS log_id, l_linenumber AS attempt, max(CASE l_returnflag WHEN 'A' THEN false WHEN 'R' THEN NULL ELSE true END) AS available FROM lineitem GROUP BY ALL),
  last AS (SELECT log_id, first(available ORDER BY attempt DESC) AS available, max(attempt)::BIGINT AS attempts FROM tries GROUP BY log_id)"""
INVENTORY = """inv AS (SELECT d.doc_id AS log_id, d.lang || '|' || (CASE WHEN d.doc_id % 2 = 0 THEN 'within' ELSE 'older' END) AS stratum, l.doc_id IS NOT NULL AS wp, CASE WHEN l.doc_id IS NOT NULL THEN quality ELSE 0 END AS wr,
  n_chars > 800 AS pp, CASE WHEN n_chars > 800 THEN n_chars - 900 ELSE 0 END AS pr, d.doc_id % 7 <> 0 AS timed, d.doc_id % 5 <> 0 AS cp FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
  us AS (SELECT *, NOT wp AS mw, NOT pp AS mp, wp AND coalesce(wr, 0) <= 0 AS ew, pp AND coalesce(pr, 0) <= 0 AS ep FROM inv), u AS (SELECT *, NOT mw AND NOT mp AND NOT ew AND NOT ep AND cp AND timed AS usable FROM us)"""

ORACLES = {
    "population_audit": f"WITH {FRAME} SELECT count(*) AS records, count_if(simulated)::BIGINT AS simulated, count_if(NOT simulated)::BIGINT AS real, count_if(NOT simulated AND NOT coalesce(duration_s BETWEEN 0 AND 86400, false))::BIGINT AS implausible, count_if({REAL} AND duration_s >= 300)::BIGINT AS frame, round_even(sum(CASE WHEN {REAL} THEN duration_s END) / 3600, 0)::BIGINT AS hours FROM frame",
    "population_by_key_topk": f"""WITH {FRAME}, c AS (SELECT 'hw' AS key, hw AS value, count(*) AS n FROM frame GROUP BY ALL UNION ALL SELECT 'mav_type', mav_type, count(*) FROM frame GROUP BY ALL UNION ALL SELECT 'type', type, count(*) FROM frame GROUP BY ALL
      UNION ALL SELECT 'year', substr(log_date, 1, 4), count(*) FROM frame GROUP BY ALL UNION ALL SELECT 'nation', nation::VARCHAR, count(*) FROM frame GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, value)::INT AS place FROM c) SELECT key, value, n, place FROM r WHERE place <= 15""",
    "duration_tiers": f"WITH {FRAME} SELECT t::BIGINT AS tier_s, count_if(duration_s >= t)::BIGINT AS n FROM frame, unnest([120, 180, 300, 600]) AS x(t) WHERE {REAL} GROUP BY t",
    "duration_nearest_rank": f"WITH {FRAME}, s AS (SELECT type, list(duration_s ORDER BY duration_s) AS d, count(*) AS n FROM frame WHERE {REAL} GROUP BY type) SELECT type, d[(floor(n * 0.5e0) + 1)::BIGINT] AS p50, d[(floor(n * 0.9e0) + 1)::BIGINT] AS p90, d[(floor(n * 0.99e0) + 1)::BIGINT] AS p99, d[n] AS longest FROM s",
    "retention_exposure": f"WITH {FRAME}, f AS (SELECT * FROM frame WHERE {REAL} AND duration_s >= 300), c AS (SELECT max(log_date) AS newest, strftime(max(log_date)::DATE - 365, '%Y-%m-%d') AS cutoff FROM f) SELECT newest, cutoff, count_if(log_date >= cutoff)::BIGINT AS within, count_if(log_date < cutoff)::BIGINT AS older FROM f, c GROUP BY ALL",
    "airframe_partition": f"""WITH {FRAME} SELECT CASE WHEN regexp_matches(mav_type, 'Fixed|Plane|VTOL') THEN 'fixed_wing_or_vtol' WHEN regexp_matches(lower(mav_type), 'rotor|copter|helicopter') THEN 'rotorcraft' ELSE 'other' END AS family,
      CASE WHEN regexp_matches(mav_type, 'Fixed|Plane|VTOL') THEN 'fixed_wing_or_vtol' ELSE 'rotorcraft' END AS cell, CASE WHEN lower(trim(mav_type)) = 'fixed wing' THEN 'fixed_wing' ELSE 'vtol' END AS regime, count(*) AS n FROM frame WHERE NOT simulated GROUP BY ALL""",
    "split_counts": f"WITH {FRAME} SELECT type, 'all' AS population, count(*) AS n FROM frame GROUP BY ALL UNION ALL SELECT type, CASE WHEN simulated THEN 'simulated' ELSE 'real' END, count(*) FROM frame GROUP BY ALL",
    "declared_by_type": f"WITH {FRAME} SELECT coalesce(nullif(type, ''), 'unset') AS type, count(*) AS total, count_if(wind >= 0)::BIGINT AS declared FROM frame GROUP BY ALL",
    "wind_labels": f"WITH {FRAME} SELECT CASE wind WHEN -1 THEN 'not given' WHEN 0 THEN 'Calm' WHEN 5 THEN 'Breeze' WHEN 8 THEN 'Gale' WHEN 10 THEN 'Storm' ELSE wind::VARCHAR END AS label, count(*) AS n FROM frame GROUP BY ALL",
    "label_explode_counts": "SELECT l_partkey % 12 AS label, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
    "frame_eligible_anti": f"WITH {ELIGIBLE} SELECT log_id, vehicle, round(duration_s, 6) + 0e0 AS duration_s FROM eligible",
    "stratified_sample": f"WITH {SAMPLE} SELECT log_id, stratum, log_date, vehicle, place FROM drawn",
    "sample_summary": f"WITH {SAMPLE} SELECT b.stratum, count(*) AS frame_size, count(DISTINCT b.vehicle) AS frame_vehicles, (SELECT count(*) FROM drawn d WHERE d.stratum = b.stratum) AS drawn FROM base b GROUP BY b.stratum",
    "last_attempt_wins": f"WITH {LAST} SELECT * FROM last",
    "availability_tristate": f"WITH {SIDED}, {LAST} SELECT side, count(*) AS requested, count_if(available)::BIGINT AS available, count_if(available IS NULL)::BIGINT AS unobserved, count_if(NOT available)::BIGINT AS missing, min(CASE WHEN available THEN log_date END) AS oldest_available FROM sided LEFT JOIN last USING (log_id) GROUP BY side",
    "retrieval_plan": f"""WITH {SIDED}, {LAST}, s AS (SELECT log_id, side || '|' || type AS cell, CASE WHEN available THEN 'converted' WHEN available IS NOT NULL THEN 'downloaded' ELSE 'pending' END AS state FROM sided LEFT JOIN last USING (log_id))
      SELECT log_id, cell, state, CASE WHEN state = 'pending' THEN floor((row_number() OVER (PARTITION BY cell, state ORDER BY log_id) - 1) / 100)::BIGINT END AS chunk FROM s""",
    "inventory_usable": f"WITH {INVENTORY} SELECT stratum, count(*) AS runs, count_if(usable)::BIGINT AS usable, round(count_if(usable) / count(*), 4) + 0e0 AS usable_rate FROM u GROUP BY stratum",
    "inventory_reasons": f"""WITH {INVENTORY}, x AS (SELECT * FROM u WHERE NOT usable) SELECT reason, count(*) AS n FROM (SELECT 'missing:wind' AS reason FROM x WHERE mw UNION ALL SELECT 'missing:position' FROM x WHERE mp UNION ALL SELECT 'empty:wind' FROM x WHERE ew
      UNION ALL SELECT 'empty:position' FROM x WHERE ep UNION ALL SELECT 'no_absolute_time' FROM x WHERE NOT timed UNION ALL SELECT 'columns_absent' FROM x WHERE timed AND NOT mw AND NOT mp AND NOT ew AND NOT ep) GROUP BY reason""",
}
