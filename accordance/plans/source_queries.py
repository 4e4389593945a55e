"""Queries on files and streams: arrays, grid chunks, footers, nested records, disclosure, far stations, restated and late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordance.functions.classify import altitude_band, exclusion_id, markers_of, release_marker, rounded, sigma_band
from accordance.functions.geometry import grid_index
from accordance.operators import context, disclosure, json_schema
from accordance.operators.tables import written
from accordance.plans import agreement_queries, bindings, context_queries
from accordance.plans.record_queries import _folder
from accordance.session import table
from accordance.sources import array_source, chunks, footers, readers, sinks
from accordance.sources.versions import Versions
from accordance.streaming import late

#: Bytes of a range, small enough that the given tables' arrays have many.
SPAN = 1 << 16
#: Hours since 1970, grid rows, and grid columns counted from 180 degrees west.
SHAPE, BOX, WEST = (1 << 20, 721, 1440), (24, 8, 8), 720
REQUIRED = {"wind": ["timestamp", "windspeed_north"], "vehicle_global_position": ["timestamp", "lat", "lon"]}
#: Shares of all runs below which a cell isn't published, and where the first release ended.
FLOOR, FIRST_RELEASE = 0.04, "1998-07-01"
ORDER_SCHEMA = {
    "$defs": {"line": {"type": "object", "required": ["part", "quantity"], "additionalProperties": False, "properties": {"part": {"type": "integer", "minimum": 1}, "quantity": {"type": "number", "maximum": 49}, "flag": {"enum": ["A", "R"]}, "dates": {"type": "object", "properties": {"shipped": {"type": ["string", "null"], "pattern": "^199[0-9]-"}}}}}},
    "type": "object", "required": ["key", "lines"],
    "properties": {"key": {"type": "integer"}, "status": {"type": "string", "enum": ["F", "O"]}, "lines": {"type": "array", "maxItems": 8, "items": {"$ref": "#/$defs/line"}}},
}


def json_array_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as JSON arrays and read back by ranges of bytes, summed up by priority."""
    path = _folder(spark, "arrays")
    rows = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    sinks.write_arrays(rows, path)
    back = array_source.split_json_array(spark, path, rows.schema, SPAN)
    return back.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"), F.max("o_orderdate").alias("last"))


def chunked_point_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field written as chunk files; daily windows' points read from them, by day, with the chunks that were opened."""
    hour = lambda c: F.floor(F.unix_micros(c) / 3_600_000_000).cast("long")
    root = _folder(spark, "field")
    field = bindings.grid(spark, sf_dir).select(hour("time").alias("t"), F.col("lat_index").alias("la"), (F.col("lon_index") + WEST).alias("lo"), "u100", "v100")
    chunks.write_chunks(field, root, ["u100", "v100"], chunks.header(SHAPE, BOX)).write.format("noop").mode("overwrite").save()
    asked = bindings.daily(spark, sf_dir).select(hour("window_start").alias("t"), grid_index(F.col("lat")).alias("la"), (grid_index(F.col("lon")) + WEST).alias("lo"))
    read = chunks.read_points(asked, root, ["u100", "v100"]).withColumn("chunk", chunks.chunk_of(BOX))
    day = F.date_format(F.timestamp_seconds(F.col("t") * 3600), "yyyy-MM-dd").alias("day")
    return read.groupBy(day).agg(F.count(F.lit(1)).alias("asked"), F.count("u100").alias("found"), F.count_distinct(F.when(F.col("opened"), F.col("chunk"))).alias("opened"), F.sum(F.round(F.col("u100") * 8).cast("long")).alias("u_eighths"), F.sum(F.round(F.col("v100") * 10).cast("long")).alias("v_tenths"))


def topic_footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs' topics as their files declare them, from footers alone; one run's wind is a file that isn't Parquet."""
    root = _folder(spark, "footers")
    wind = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("run_id"), F.lit("wind").alias("topic"), F.col("s_suppkey").alias("timestamp"), F.col("s_acctbal").alias("windspeed_north"))
    place = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("run_id"), F.lit("vehicle_global_position").alias("topic"), F.col("c_custkey").alias("timestamp"), F.lit(None).cast("double").alias("lat"))
    wind.repartition("run_id").write.partitionBy("run_id", "topic").parquet(root)
    place.repartition("run_id").write.mode("append").partitionBy("run_id", "topic").parquet(root)
    table(spark, sf_dir, "region").select(F.col("r_name").alias("value")).repartition(1).write.text(f"{root}/run_id=900/topic=wind")
    part = lambda name: F.regexp_extract("path", f"{name}=([^/]+)", 1).alias(name)
    found = footers.parquet_footers(spark, root, "part-*").select("*", part("run_id").cast("long").alias("run_id"), part("topic"))
    return footers.topic_presence(found, REQUIRED)


def nested_schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines as nested records against a schema, with what breaks its rules and where."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("number"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"), F.struct(F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped")).alias("dates")))).alias("lines"))
    own = F.transform("lines", lambda x: F.struct(F.when(x["part"] % 50 != 0, x["part"]).alias("part"), x["quantity"].alias("quantity"), x["flag"].alias("flag"), x["dates"].alias("dates"), F.when(x["part"] % 97 == 0, x["supp"]).alias("supp")))
    record = F.struct("key", F.col("o_orderstatus").alias("status"), own.alias("lines"))
    joined = lines.join(table(spark, sf_dir, "orders"), F.col("key") == F.col("o_orderkey"))
    return json_schema.violations(joined.select("key", F.to_json(record).alias("doc")), "key", "doc", ORDER_SCHEMA)


AXES = {
    "airframe": F.col, "season": F.col, "nation": F.col,
    "estimator_sigma": lambda _: sigma_band(F.col("var_u"), F.col("var_v")), "altitude_proxy": lambda _: altitude_band(F.col("height_m")),
}


def disclosure_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of overlapping axes under a floor of 4 % of the runs, and what is hidden besides so that none follows from the rest."""
    rows = written(bindings.pairs(spark, sf_dir).select("run_id", "vehicle", "airframe", "season", "nation", "var_u", "var_v", "height_m"), "guard")
    floor = int(rows.agg(F.count_distinct("run_id")).first()[0] * FLOOR)
    return disclosure.guarded(rows, {k: f(k) for k, f in AXES.items()}, floor)


def release_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two releases of the cells, the second with the windows that came later: by how many runs each differs."""
    rows = bindings.pairs(spark, sf_dir)
    return disclosure.release_gaps(rows.filter(F.col("window_start") < FIRST_RELEASE), rows, {k: AXES[k](k) for k in ("airframe", "season", "nation")})


def nearest_station_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of stations that lie on the other half of the earth, some beyond the date line, for each daily window."""
    asked = bindings.daily(spark, sf_dir).withColumn("key", F.concat_ws("@", "run_id", F.date_format("window_start", "yyyy-MM-dd")))
    points = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("point_id"), (-(F.col("s_suppkey") % 97) / 1.2 - 8).alias("plat"), (F.col("s_suppkey") % 89 * 4.0 - 175).alias("plon"))
    return context.sphere_nearest(asked, points, "key")


def restated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events upserted from a stream of two batches, the second restating purchases and adding the last tenth: what changed between the versions."""
    root, inbox = _folder(spark, "versions"), _folder(spark, "inbox")
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    later = F.col("event_id") % 10 == 9
    first = events.filter(~later).withColumn("revision", F.lit(1))
    second = events.filter(later | (F.col("event_type") == "purchase")).withColumn("value", F.when(later, F.col("value")).otherwise(F.col("value") + 1)).withColumn("revision", F.lit(2))
    files = 2
    for batch in (first, second):
        batch.repartition(files).write.mode("append").parquet(inbox)
    made = Versions(spark, root, "event_id")
    stream = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", files).parquet(inbox)
    last = made.upsert_stream(stream, "revision", "inbox", f"{root}/checkpoint")
    changes = made.changes(1, last).groupBy("change").agg(F.count(F.lit(1)).alias("n"), F.sum("key").alias("keys"))
    now = made.read().agg(F.lit("rows").alias("change"), F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("keys"))
    return changes.union(now)


def late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events streamed in three batches, each over the whole time: rows on time and rows behind the watermark, by batch."""
    root, inbox = _folder(spark, "late"), _folder(spark, "late-inbox")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    for k in range(3):
        events.filter(F.col("event_id") % 3 == k).repartition(2).write.mode("append").parquet(inbox)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(inbox)
    on_time, behind = late.split_stream(stream, "run_id", root)
    both = on_time.withColumn("late", F.lit(False)).unionByName(behind.withColumn("late", F.lit(True)))
    return both.groupBy("batch", "late").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


def route_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One field in two archives, the second in single precision, shifted in some rows and without some columns: read at the windows' points and compared value by value, by day."""
    hour = lambda c: F.floor(F.unix_micros(c) / 3_600_000_000).cast("long")
    field = written(bindings.grid(spark, sf_dir).select(hour("time").alias("t"), F.col("lat_index").alias("la"), (F.col("lon_index") + WEST).alias("lo"), "u100"), "field")
    other = field.withColumn("u100", F.when(F.col("lo") % 7 != 0, F.when(F.col("la") % 5 == 0, F.col("u100") + 0.25).otherwise(F.col("u100"))))
    asked = written(bindings.daily(spark, sf_dir).select(hour("window_start").alias("t"), grid_index(F.col("lat")).alias("la"), (grid_index(F.col("lon")) + WEST).alias("lo")), "points")
    read = []
    for name, rows, kind in (("a", field, "<f8"), ("b", other, "<f4")):
        root = _folder(spark, f"route-{name}")
        chunks.write_chunks(rows, root, ["u100"], chunks.header(SHAPE, BOX, kind)).write.format("noop").mode("overwrite").save()
        read.append(chunks.read_points(asked, root, ["u100"]).select("t", "la", "lo", F.col("u100").alias(name)))
    both = read[0].join(read[1], ["t", "la", "lo"]).withColumn("gap", F.abs(F.col("a") - F.col("b")))
    day = F.date_format(F.timestamp_seconds(F.col("t") * 3600), "yyyy-MM-dd").alias("day")
    return both.groupBy(day).agg(F.count("gap").alias("compared"), F.count_if(F.col("gap") > 1e-6).alias("differing"), F.count_if(F.col("a").isNotNull() & F.col("b").isNull()).alias("only_a"), rounded(F.max("gap")).alias("largest_gap"))


def field_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's request for a day of the field: its hours and box; a span that can't be asked for would fail the query."""
    rows = bindings.samples(spark, sf_dir)
    spans = rows.groupBy("run_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.floor(F.min("lat")).alias("south"), F.ceil(F.max("lat")).alias("north"))
    hours = F.transform(readers.asked_hours(F.col("start"), F.col("end")), lambda h: F.date_format(h, "HH:00"))
    return spans.select("run_id", "day", F.array_join(hours, ",").alias("hours"), F.col("south").cast("long").alias("south"), F.col("north").cast("long").alias("north"))


def release_markers_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The markers of each region's windows; a region without any would fail the query."""
    rows = bindings.pairs(spark, sf_dir)
    return rows.groupBy(F.substring_index("stratum", "|", 1).alias("region")).agg(markers_of(release_marker(F.col("window_start"), *bindings.COVERAGE)).alias("markers"))


def run_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers written by nation as run directories, and the directories as they are listed."""
    root = _folder(spark, "runs")
    table(spark, sf_dir, "supplier").withColumn("run", F.col("s_nationkey")).write.partitionBy("run").parquet(root)
    return readers.run_directories(spark, root).select(F.regexp_replace("run_id", "run=", "").cast("long").alias("run")).filter("run is not null")


def log_magic_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as files, some with a log's first bytes and some too short: how many are logs."""
    root = _folder(spark, "logs")
    magic = bytes.fromhex(readers.LOG_MAGIC).decode()
    rows = table(spark, sf_dir, "nation")
    head = F.when(F.col("n_nationkey") % 3 == 0, F.lit("no log")).otherwise(F.lit(magic))
    rows.select("n_nationkey", F.concat(head, F.repeat(F.col("n_name"), F.when(F.col("n_nationkey") % 2 == 0, 1000).otherwise(100))).alias("value")).repartition("n_nationkey").write.partitionBy("n_nationkey").text(root)
    return readers.log_files(spark, root).filter("log_id LIKE 'part-%'").groupBy("available").agg(F.count(F.lit(1)).alias("files"))


def exclusion_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objections that name a log by its id, by a link to its file or by a page's address: normalised, and the runs that they meet."""
    rows = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_orderkey").alias("k"))
    text = F.col("k").cast("string")
    form = F.when(F.col("k") % 3 == 0, F.concat(F.lit(" "), text, F.lit(" "))).when(F.col("k") % 3 == 1, F.concat(F.lit("https://logs.example/files/"), text, F.lit(".ulg"))).otherwise(F.concat(F.lit("https://logs.example/plot?log_id="), text, F.lit("&page=2")))
    named = rows.select(exclusion_id(form).alias("log_id"), (F.col("k") % 3).alias("form"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("log_id"))
    return lines.join(named, "log_id").groupBy("form").agg(F.count(F.lit(1)).alias("windows"), F.count_distinct("log_id").alias("runs"))


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table made of two inputs, its manifest with their digests, and whether the manifest keeps its rules."""
    customers, nations = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    made = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"))
    record = sinks.recorded(made, _folder(spark, "by-nation"), "by-nation", 7, "r1", True)
    out = written(sinks.manifest(record, {"customer": customers, "nation": nations}), "manifest")
    broken = json_schema.violations(out, "name", "manifest", sinks.MANIFEST).groupBy(F.col("key").alias("name")).agg(F.count(F.lit(1)).alias("broken"))
    field = lambda path: F.get_json_object("manifest", path)
    own = out.select("name", field("$.rows").cast("long").alias("rows"), field("$.inputs[0].rows").cast("long").alias("customer_rows"), field("$.inputs[1].rows").cast("long").alias("nation_rows"))
    return own.join(broken, "name", "left").select("name", "rows", "customer_rows", "nation_rows", F.coalesce("broken", F.lit(0)).cast("long").alias("broken"))


QUERIES = [json_array_scan, chunked_point_reads, topic_footers, nested_schema_violations, disclosure_guard, release_gaps, nearest_station_far, restated_events, late_events, route_files, field_requests, release_markers_required, run_listing, log_magic_files, exclusion_references, manifests]

P, C = agreement_queries.PAIRS, context_queries
R = agreement_queries.R
BANDED = """px AS (SELECT *, CASE WHEN sqrt((var_u + var_v) / 2) < 0.5 THEN 'sigma_lt_0.5' WHEN sqrt((var_u + var_v) / 2) < 1 THEN 'sigma_0.5_to_1.0' ELSE 'sigma_ge_1.0' END AS sigma,
  CASE WHEN height_m IS NULL OR height_m < -50 OR height_m > 5000 THEN 'unknown' WHEN height_m < 50 THEN 'agl_proxy_lt_50m' WHEN height_m < 120 THEN 'agl_proxy_50_to_120m' ELSE 'agl_proxy_ge_120m' END AS alt FROM pairs)"""
ENTRIES = "ax AS (SELECT run_id, vehicle, window_start, unnest(['airframe', 'season', 'nation', 'estimator_sigma', 'altitude_proxy']) AS axis, unnest([airframe, season, nation, sigma, alt]) AS cell FROM px)"

ORACLES = {
    "json_array_scan": "SELECT o_orderpriority, count(*) AS n, sum(o_orderkey)::BIGINT AS keys, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents, strftime(max(o_orderdate), '%Y-%m-%d') AS last FROM orders GROUP BY 1",
    "chunked_point_reads": f"""WITH {C.FIELD}, q AS (SELECT DISTINCT epoch_us(window_start) // 3600000000 AS t, la, lo + {WEST} AS lo FROM daily), k AS (SELECT DISTINCT (epoch_us(time) // 3600000000) // 24 AS a, la // 8 AS b, (lo + {WEST}) // 8 AS c FROM grid),
      x AS (SELECT q.*, k.a IS NOT NULL AS opened, g.u100, g.v100 FROM q LEFT JOIN k ON t // 24 = a AND q.la // 8 = b AND q.lo // 8 = c LEFT JOIN grid g ON epoch_us(g.time) // 3600000000 = q.t AND g.la = q.la AND g.lo + {WEST} = q.lo)
      SELECT strftime(make_timestamp(t * 3600000000), '%Y-%m-%d') AS day, count(*) AS asked, count(u100) AS found, count(DISTINCT CASE WHEN opened THEN (t // 24) || '.' || (la // 8) || '.' || (lo // 8) END) AS opened, sum(round(u100 * 8)::BIGINT)::BIGINT AS u_eighths, sum(round(v100 * 10)::BIGINT)::BIGINT AS v_tenths FROM x GROUP BY 1""",
    "topic_footers": """SELECT s_nationkey::BIGINT AS run_id, 'wind' AS topic, 1::BIGINT AS files, count(*) AS rows, 'timestamp,windspeed_north' AS columns, true AS complete FROM supplier GROUP BY 1
      UNION ALL SELECT c_nationkey::BIGINT, 'vehicle_global_position', 1, count(*), 'lat,timestamp', false FROM customer GROUP BY 1 UNION ALL SELECT 900, 'wind', 1, NULL, NULL, false""",
    "nested_schema_violations": """WITH l AS (SELECT l_orderkey AS key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_shipdate) - 1 AS i, l_partkey, l_quantity, l_returnflag, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey), p AS (SELECT *, 'lines[' || i || ']' AS spot FROM l)
      SELECT o_orderkey AS key, 'status' AS path, 'enum' AS rule FROM orders WHERE o_orderstatus NOT IN ('F', 'O') AND o_orderkey IN (SELECT key FROM l) UNION ALL SELECT key, 'lines', 'maxItems' FROM l GROUP BY key HAVING count(*) > 8
      UNION ALL SELECT key, spot || '.part', 'required' FROM p WHERE l_partkey % 50 = 0 UNION ALL SELECT key, spot || '.part', 'minimum' FROM p WHERE l_partkey % 50 <> 0 AND l_partkey < 1 UNION ALL SELECT key, spot || '.quantity', 'maximum' FROM p WHERE l_quantity > 49
      UNION ALL SELECT key, spot || '.flag', 'enum' FROM p WHERE l_returnflag NOT IN ('A', 'R') UNION ALL SELECT key, spot || '.dates.shipped', 'pattern' FROM p WHERE year(l_shipdate) >= 2000 UNION ALL SELECT key, spot || '.supp', 'additionalProperties' FROM p WHERE l_partkey % 97 = 0""",
    "disclosure_guard": f"""WITH {P}, {BANDED}, {ENTRIES}, fl AS (SELECT floor(count(DISTINCT run_id) * {FLOOR})::BIGINT AS f FROM pairs), c AS (SELECT axis, cell, count(*) AS n_windows, count(DISTINCT run_id) AS n_runs, count(DISTINCT vehicle) AS n_vehicles FROM ax GROUP BY ALL),
      s AS (SELECT c.*, n_runs < f OR n_vehicles < 10 AS thin, f FROM c, fl), u AS (SELECT axis, count(DISTINCT cell) = 1 OR count(DISTINCT run_id) < any_value(f) OR count(DISTINCT vehicle) < 10 AS more FROM ax JOIN s USING (axis, cell) WHERE thin GROUP BY axis),
      k AS (SELECT s.*, coalesce(more, false) AS more, row_number() OVER (PARTITION BY axis, thin ORDER BY n_runs, cell) AS place FROM s LEFT JOIN u USING (axis))
      SELECT axis, cell, n_windows, n_runs, n_vehicles, CASE WHEN thin THEN 'primary' WHEN more AND place = 1 THEN 'complement' ELSE 'published' END AS state FROM k""",
    "release_gaps": f"""WITH {P}, px AS (SELECT *, '' AS sigma, '' AS alt FROM pairs), {ENTRIES}, r AS (SELECT axis, cell, run_id, min(window_start) < TIMESTAMP '{FIRST_RELEASE}' AS old FROM ax WHERE axis IN ('airframe', 'season', 'nation') GROUP BY ALL)
      SELECT axis, cell, count_if(NOT old)::BIGINT AS added, 0::BIGINT AS removed, count_if(NOT old) BETWEEN 1 AND 19 AS open FROM r GROUP BY ALL""",
    "nearest_station_far": f"""WITH {C._win('day')}, s AS (SELECT s_suppkey AS point_id, -(s_suppkey % 97) / 1.2e0 - 8 AS plat, s_suppkey % 89 * 4e0 - 175 AS plon FROM supplier), n AS (SELECT run_id || '@' || strftime(window_start, '%Y-%m-%d') AS key, point_id, {R(C.KM('lat', 'lon', 'plat', 'plon'), 'km')} FROM win, s WHERE complete)
      SELECT key, point_id, km AS distance_km FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY km, point_id) AS rn FROM n) WHERE rn = 1""",
    "restated_events": """SELECT CASE WHEN event_id % 10 = 9 THEN 'added' ELSE 'changed' END AS change, count(*) AS n, sum(event_id)::BIGINT AS keys FROM events WHERE event_id % 10 = 9 OR event_type = 'purchase' GROUP BY 1 UNION ALL SELECT 'rows', count(*), sum(event_id)::BIGINT FROM events""",
    "late_events": """WITH b AS (SELECT event_id, ts, (event_id % 3)::INT AS batch, epoch_us(date_trunc('hour', ts) + INTERVAL 1 HOUR) // 1000 AS stop FROM events), m AS (SELECT batch, epoch_us(max(ts)) // 1000 AS top FROM b GROUP BY batch),
      k AS (SELECT b.*, coalesce(stop <= (SELECT max(top) FROM m WHERE m.batch < b.batch) - 7200000, false) AS late FROM b) SELECT batch, late, count(*) AS n, sum(event_id)::BIGINT AS ids FROM k GROUP BY ALL""",
    "route_files": f"""WITH {C.FIELD}, q AS (SELECT DISTINCT window_start, la, lo FROM daily), x AS (SELECT q.*, u100 AS a, CASE WHEN (q.lo + {WEST}) % 7 <> 0 THEN u100 + CASE WHEN q.la % 5 = 0 THEN 0.25e0 ELSE 0e0 END END AS b FROM q LEFT JOIN grid g ON g.time = window_start AND g.la = q.la AND g.lo = q.lo)
      SELECT strftime(window_start, '%Y-%m-%d') AS day, count(abs(a - b)) AS compared, count_if(abs(a - b) > 1e-6)::BIGINT AS differing, count_if(a IS NOT NULL AND b IS NULL)::BIGINT AS only_a, {R('max(abs(a - b))', 'largest_gap')} FROM x GROUP BY 1""",
    "field_requests": f"""WITH {C.SAMPLES}, s AS (SELECT run_id, strftime(ts, '%Y-%m-%d') AS day, min(ts) AS a, max(ts) AS b, floor(min(lat))::BIGINT AS south, ceil(max(lat))::BIGINT AS north FROM samples GROUP BY ALL)
      SELECT run_id, day, array_to_string(list_transform(range(date_part('hour', a)::BIGINT, date_part('hour', b)::BIGINT + 1), lambda h: lpad(h::VARCHAR, 2, '0') || ':00'), ',') AS hours, south, north FROM s""",
    "release_markers_required": f"SELECT r_name AS region, array_to_string(list_sort(list(DISTINCT CASE WHEN l_shipdate::DATE < DATE '{bindings.COVERAGE[0]}' THEN NULL WHEN l_shipdate::DATE <= DATE '{bindings.COVERAGE[1]}' THEN '0001' WHEN l_shipdate::DATE <= DATE '{bindings.COVERAGE[2]}' THEN '0005' END)), ',') AS markers FROM {C.PAIR_YEARS} GROUP BY 1",
    "run_listing": "SELECT DISTINCT s_nationkey::BIGINT AS run FROM supplier",
    "log_magic_files": "SELECT n_nationkey % 3 <> 0 AND 8 + length(n_name) * CASE WHEN n_nationkey % 2 = 0 THEN 1000 ELSE 100 END >= 4096 AS available, count(*) AS files FROM nation GROUP BY 1",
    "exclusion_references": "SELECT o_orderkey % 3 AS form, count(*) AS windows, count(DISTINCT o_orderkey) AS runs FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice > 300000 GROUP BY 1",
    "manifests": "SELECT 'by-nation' AS name, (SELECT count(DISTINCT c_nationkey) FROM customer) AS rows, (SELECT count(*) FROM customer) AS customer_rows, (SELECT count(*) FROM nation) AS nation_rows, 0::BIGINT AS broken",
}
