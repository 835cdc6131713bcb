"""Queries on patients over time, sites, survival, the dataset catalogue, and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelarium import bindings as b
from voxelarium.functions import ids
from voxelarium.operators import longitudinal, stats
from voxelarium.plans.registry import HIST, SCAN, VOX64, query, r, rounded
from voxelarium.sinks import tables as sinks
from voxelarium.sources import volumes
from voxelarium.sources.tables import catalogue_ranking
from voxelarium.storage import materialise, new_folder
from voxelarium.streaming import jobs

DAILY_SQL = f"{SCAN}, daily AS (SELECT patient, day, sum(value) AS volume FROM scan GROUP BY ALL)"
LAGGED_SQL = f"""{DAILY_SQL}, k AS (SELECT *, lag(volume) OVER w AS previous, lag(day) OVER w AS day0,
    min(volume) OVER (PARTITION BY patient ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nadir,
    first_value(volume) OVER w AS first_volume FROM daily WINDOW w AS (PARTITION BY patient ORDER BY day))"""


def _daily(spark, sf_dir):
    return longitudinal.daily_volumes(b.scan(spark, sf_dir), "event_id")


@query(
    "as_of_volumes",
    f"""WITH {DAILY_SQL}, asked AS (SELECT user_id AS patient, event_id, ts FROM events),
    known AS (SELECT CAST(patient AS BIGINT) AS patient, CAST(day AS TIMESTAMP) + INTERVAL 12 HOUR AS ts, volume FROM daily
      WHERE (day(day) + patient) % 3 = 0)
    SELECT a.patient, a.event_id, {r('k.volume')} AS volume, CAST(k.ts AS VARCHAR) AS measured_at
    FROM asked a ASOF LEFT JOIN known k ON a.patient = k.patient AND a.ts >= k.ts""",
)
def as_of_volumes(spark, sf_dir):
    """The volume last measured (at noon, not every day) when each event happened."""
    daily = _daily(spark, sf_dir).where((F.day("day") + F.col("patient")) % 3 == 0)
    measured = daily.withColumn("ts", F.col("day").cast("timestamp") + F.expr("INTERVAL 12 HOURS"))
    asked = b.table(spark, sf_dir, "events").select(F.col("user_id").alias("patient"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    found = longitudinal.as_of(asked, measured, "patient", "ts", "volume")
    return rounded(found.select("patient", "event_id", "volume", F.col("measured_at").cast("string").alias("measured_at")))


@query(
    "progression",
    f"""WITH {LAGGED_SQL}, g AS (SELECT *, (volume - previous) / nullif(previous, 0) AS dp, (volume - nadir) / nullif(nadir, 0) AS dn,
      cbrt(6 * volume / pi()) - cbrt(6 * nadir / pi()) AS dd, (volume - first_volume) / nullif(first_volume, 0) AS db FROM k)
    SELECT patient, CAST(day AS VARCHAR) AS day, {r('volume')} AS volume, {r('coalesce(dp, 0)', 10)} AS dv_previous,
      {r('coalesce(dn, 0)', 10)} AS dv_nadir, {r('coalesce(dd, 0)', 5)} AS dd_nadir,
      CASE WHEN nadir IS NULL THEN 'BASELINE' WHEN volume <= 0 THEN 'CR' WHEN dn >= 0.25 AND dd >= 0.5 THEN 'PD'
        WHEN db <= -0.65 THEN 'PR' ELSE 'SD' END AS response FROM g""",
)
def progression(spark, sf_dir):
    found = longitudinal.progression(_daily(spark, sf_dir), pd_diameter=0.5).fillna(
        0.0, ["dv_previous", "dv_nadir", "dd_nadir"]
    )
    shown = found.select(
        "patient", F.col("day").cast("string").alias("day"), "volume",
        "dv_previous", "dv_nadir", F.round("dd_nadir", 5).alias("dd_nadir"), "response",
    )
    return rounded(shown.withColumn("volume", F.round("volume", 6)), 10)


@query(
    "doubling_times",
    f"""WITH {LAGGED_SQL} SELECT patient, CAST(day AS VARCHAR) AS day, {r('volume')} AS volume,
      {r('coalesce(CASE WHEN previous > 0 AND volume > previous THEN ln(2) * date_diff(\'day\', day0, day) / ln(volume / previous) END, -1)', 4)}
      AS doubling_days FROM k""",
)
def doubling_times(spark, sf_dir):
    found = longitudinal.doubling_time(_daily(spark, sf_dir)).fillna(-1.0, ["doubling_days"])
    return rounded(
        found.select("patient", F.col("day").cast("string").alias("day"), "volume", F.round("doubling_days", 4).alias("doubling_days"))
    )


@query(
    "dense_timelines",
    f"""WITH {DAILY_SQL}, span AS (SELECT patient, min(day) AS d0, max(day) AS d1 FROM daily GROUP BY patient),
    grid AS (SELECT patient, CAST(unnest(generate_series(d0::TIMESTAMP, d1::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day FROM span),
    j AS (SELECT g.patient, g.day, d.volume, last_value(d.volume IGNORE NULLS) OVER w AS filled,
      last_value(CASE WHEN d.volume IS NOT NULL THEN g.day END IGNORE NULLS) OVER w AS seen
      FROM grid g LEFT JOIN daily d ON d.patient = g.patient AND d.day = g.day
      WINDOW w AS (PARTITION BY g.patient ORDER BY g.day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT patient, CAST(day AS VARCHAR) AS day, {r('filled')} AS volume,
      CAST(date_diff('day', seen, day) AS INTEGER) AS days_since_scan, CAST(volume IS NULL AS INTEGER) AS carried FROM j""",
)
def dense_timelines(spark, sf_dir):
    dense = longitudinal.dense_timeline(_daily(spark, sf_dir))
    return rounded(dense.withColumn("day", F.col("day").cast("string")))


@query(
    "kaplan_meier",
    f"""WITH d AS (SELECT o_custkey, c_mktsegment AS segment, date_diff('day', min(o_orderdate), max(o_orderdate)) AS time,
      CAST(max(o_orderdate) < TIMESTAMP '1998-01-01' AS INTEGER) AS event
      FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
    s AS (SELECT segment, time, count(*) AS n, count(*) FILTER (event = 1) AS e FROM d GROUP BY ALL),
    k AS (SELECT *, sum(n) OVER (PARTITION BY segment ORDER BY time DESC) AS at_risk FROM s)
    SELECT segment, CAST(time AS INTEGER) AS time, CAST(at_risk AS BIGINT) AS at_risk, e AS n_events,
      {r('product(1 - e::DOUBLE / at_risk) OVER (PARTITION BY segment ORDER BY time)')} AS survival FROM k""",
)
def kaplan_meier(spark, sf_dir):
    orders = b.table(spark, sf_dir, "orders")
    customers = b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    spans = orders.groupBy("o_custkey").agg(
        F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).alias("time"),
        (F.max("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")).cast("int").alias("event"),
    )
    return rounded(longitudinal.kaplan_meier(spans.join(customers, "o_custkey"), "segment"))


@query(
    "site_harmonised",
    f"""WITH s AS (SELECT source, avg(n_chars) AS m, stddev_pop(n_chars) AS d FROM documents GROUP BY source),
    g AS (SELECT avg(n_chars) AS m, stddev_pop(n_chars) AS d FROM documents)
    SELECT doc_id, x.source, n_chars, {r('coalesce((n_chars - s.m) / nullif(s.d, 0), 0) * g.d + g.m', 4)} AS harmonised
    FROM documents x JOIN s ON s.source = x.source CROSS JOIN g""",
)
def site_harmonised(spark, sf_dir):
    documents = b.table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return rounded(longitudinal.site_harmonise(documents, "source", "n_chars"), 4)


@query(
    "dataset_catalogue",
    """WITH c AS (SELECT p_partkey, p_name AS dataset, p_size, p_size % 2 AS ct, CAST(p_partkey % 3 > 0 AS INTEGER) AS mri,
      p_size % 4 AS timepoints, CASE WHEN p_size % 3 = 0 THEN p_size + p_partkey % 100
        WHEN p_size % 3 = 1 THEN p_size * 2 ELSE p_size END AS n_cases FROM part)
    SELECT p_partkey, dataset, CAST(n_cases AS BIGINT) AS n_cases, CAST(timepoints AS INTEGER) AS timepoints,
      CAST(p_size % 6 AS INTEGER) AS score FROM c WHERE ct = 1 AND mri = 1 AND timepoints >= 1""",
)
def dataset_catalogue(spark, sf_dir):
    size, key = F.col("p_size").cast("string"), F.col("p_partkey")
    text = (
        F.when(F.col("p_size") % 3 == 0, F.concat(size, F.lit("+"), (key % 100).cast("string")))
        .when(F.col("p_size") % 3 == 1, F.concat(F.lit("~"), size, F.lit("-"), (F.col("p_size") * 2).cast("string")))
        .otherwise(size)
    )
    catalogue = b.table(spark, sf_dir, "part").select(
        "p_partkey",
        F.col("p_name").alias("dataset"),
        text.alias("size"),
        (F.col("p_size") % 2).alias("ct"),
        (key % 3 > 0).cast("int").alias("mri"),
        (F.col("p_size") % 4).alias("timepoints"),
        F.concat((F.col("p_size") % 6).cast("string"), F.lit("/5")).alias("relevance"),
    )
    ranked = catalogue_ranking(catalogue, ct=1, mri=1, timepoints=1)
    return ranked.select("p_partkey", "dataset", "n_cases", "timepoints", "score").orderBy(F.desc("score"), "p_partkey")


SESSIONS_SQL = """seen AS (SELECT user_id AS patient, ts, value, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, event_id
    FROM events),
  numbered AS (SELECT *, sum(CASE WHEN before IS NULL OR epoch_us(ts) - epoch_us(before) >= 6 * 3600000000 THEN 1 ELSE 0 END)
    OVER (PARTITION BY patient ORDER BY ts, event_id) AS session FROM seen),
  sessions AS (SELECT patient, session, min(ts) AS started, max(ts) AS ended, count(*) AS n, sum(value) AS total
    FROM numbered GROUP BY ALL)"""


@query(
    "session_activity",
    f"""WITH {SESSIONS_SQL} SELECT patient, CAST(session AS BIGINT) AS session, {r('epoch_us(started) / 1e6')} AS started,
      {r('epoch_us(ended) / 1e6')} AS ended, n, {r('total', 4)} AS total FROM sessions""",
)
def session_activity(spark, sf_dir):
    events = b.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("patient"), F.to_utc_timestamp("ts", F.current_timezone()).alias("ts"), "value"
    )
    found = longitudinal.session_activity(events, 6)
    return rounded(
        found.select("patient", "session", jobs.utc_seconds(F.col("started")).alias("started"),
                     jobs.utc_seconds(F.col("ended")).alias("ended"), "n", F.round("total", 4).alias("total"))
    )


# Streams over the events table -------------------------------------------------------

CLOSED_SQL = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


def _moments_sql(keys: str) -> str:
    return f"""{keys}, count(*) AS n, {r('avg(value)', 8)} AS mean, {r('stddev_pop(value)', 5)} AS std, min(value) AS min,
      max(value) AS max, {r('100.0 * count(*) FILTER (value > 0) / count(*)', 8)} AS positive_pct"""


def _closed_windows(spark, sf_dir, windows):
    sink, checkpoint = new_folder(spark, "windows"), new_folder(spark, "progress")
    jobs.write_closed_windows(windows, sink, checkpoint)
    return spark.read.schema(windows.schema).parquet(sink)


def _shown(closed):
    final = stats.finalise_moments(closed, ["start", "event_type"])
    shown = final.withColumns({"start": F.date_format("start", "yyyy-MM-dd HH:mm"), "std": F.round("std", 5)})
    return rounded(shown, 8)


@query(
    "streaming_daily_moments",
    f"""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M') AS start, {_moments_sql('event_type')} FROM events
    WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= {CLOSED_SQL} GROUP BY ALL""",
)
def streaming_daily_moments(spark, sf_dir):
    events = jobs.read_files(spark, f"{sf_dir}/events.parquet")
    windows = jobs.windowed_moments(events, ["event_type"], "ts", "value", "1 day")
    return _shown(_closed_windows(spark, sf_dir, windows))


@query(
    "streaming_sliding_moments",
    f"""WITH w AS (SELECT event_type, value, ts, time_bucket(INTERVAL 12 HOUR, ts) - to_hours(12 * k) AS start
      FROM events CROSS JOIN (SELECT unnest([0, 1]) AS k))
    SELECT strftime(start, '%Y-%m-%d %H:%M') AS start, {_moments_sql('event_type')} FROM w
    WHERE start + INTERVAL 1 DAY <= {CLOSED_SQL} GROUP BY ALL""",
)
def streaming_sliding_moments(spark, sf_dir):
    events = jobs.read_files(spark, f"{sf_dir}/events.parquet")
    windows = jobs.windowed_moments(events, ["event_type"], "ts", "value", "1 day", "12 hours")
    return _shown(_closed_windows(spark, sf_dir, windows))


@query(
    "streaming_updates",
    f"""SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, {r('sum(value)', 4)} AS total,
      {r('min(value)')} AS mn, {r('max(value)')} AS mx, 0 AS late FROM events GROUP BY ALL""",
)
def streaming_updates(spark, sf_dir):
    """All windows, open ones too, kept up to date batch by batch."""
    folder, progress = new_folder(spark, "updates"), new_folder(spark, "progress")
    for _ in range(2):  # the second start finds nothing left to do
        events = jobs.read_files(spark, f"{sf_dir}/events.parquet")
        jobs.updating_moments(events, ["event_type"], "ts", "value", "1 day", folder, progress)
    late = jobs.late_rows(spark, folder).groupBy("event_type").agg(F.count(F.lit(1)).cast("int").alias("late"))
    windows = jobs.current_windows(spark, folder, ["event_type"]).join(late, "event_type", "left")
    start = F.date_format("start", "yyyy-MM-dd HH:mm").alias("start")
    shown = windows.select(start, "event_type", "n", F.round("s", 4).alias("total"), "mn", "mx", F.coalesce("late", F.lit(0)).alias("late"))
    return rounded(shown)


@query(
    "streaming_decode",
    f"""WITH {VOX64} SELECT concat('case', case_id) AS case_id, count(*) AS n, {r('sum(value)', 4)} AS total, 'ok' AS status
    FROM vox64 WHERE case_id IN (SELECT vec_id FROM embeddings WHERE label <> 0) GROUP BY ALL
    UNION ALL SELECT concat('case', vec_id), 0, 0.0, 'error' FROM embeddings WHERE label = 0""",
)
def streaming_decode(spark, sf_dir):
    """Scan files as a stream, decoded into bricks; broken ones are quarantined, a restart adds nothing."""
    name = F.concat(F.lit("/scans/case"), F.col("vec_id").cast("string"), F.lit("-t1n.nii.gz"))
    vectors = b.table(spark, sf_dir, "embeddings")
    files = volumes.encode_files(vectors, name, "embedding", (4, 4, 4)).join(vectors.select(name.alias("path"), "label"), "path")
    content = F.when(F.col("label") == 0, F.expr("substring(content, 1, 40)")).otherwise(F.col("content"))
    arriving = materialise(files.select("path", content.alias("content")), "arriving").inputFiles()[0].rsplit("/", 1)[0]
    bricks, errors, progress = (new_folder(spark, p) for p in ("bricks", "errors", "progress"))
    for _ in range(2):
        stream = spark.readStream.schema("path string, content binary").option("maxFilesPerTrigger", 3).parquet(arriving)
        jobs.decoding_ingest(stream, bricks, errors, progress, size=(3, 3, 3))
    case = ids.case_of(F.col("path")).alias("case_id")
    total = F.aggregate(F.transform("values", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    good = spark.read.parquet(bricks).groupBy(case).agg(F.sum(F.size("values")).alias("n"), F.round(F.sum(total), 4).alias("total"))
    failed = spark.read.parquet(errors).select(case, F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("total"), "status")
    return rounded(good.withColumn("status", F.lit("ok")).unionByName(failed))


@query(
    "streaming_sessions",
    f"""WITH {SESSIONS_SQL} SELECT patient AS user_id, strftime(started, '%Y-%m-%d %H:%M') AS start, n, {r('total', 4)} AS total
    FROM sessions WHERE ended + INTERVAL 6 HOUR <= {CLOSED_SQL}""",
)
def streaming_sessions(spark, sf_dir):
    events = jobs.read_files(spark, f"{sf_dir}/events.parquet")
    windows = jobs.windowed_sessions(events, ["user_id"], "ts", "value", "6 hours")
    closed = _closed_windows(spark, sf_dir, windows)
    return rounded(closed.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n", "total"), 4)


@query(
    "streaming_ingest",
    """SELECT event_id AS case_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS label, 'ok' AS status
      FROM events WHERE event_type <> 'error'
    UNION ALL SELECT event_id, 0, 'exception' FROM events WHERE event_type = 'error'""",
)
def streaming_ingest(spark, sf_dir):
    events = jobs.read_files(spark, f"{sf_dir}/events.parquet")
    rows = events.select(
        F.col("event_id").alias("case_id"),
        F.col("event_type").isin("purchase", "signup").cast("int").alias("label"),
        F.when(F.col("event_type") == "error", "exception").otherwise("ok").alias("status"),
    )
    labels, errors, progress = (new_folder(spark, p) for p in ("labels", "errors", "progress"))
    for _ in range(2):  # the second start finds nothing left to do
        jobs.incremental_ingest(rows, labels, errors, progress)
    good = sinks.current_labels(spark.read.schema("case_id bigint, label int, batch bigint").parquet(labels))
    failed = sinks.current_errors(
        spark.read.schema("case_id bigint, label int, batch bigint, status string").parquet(errors)
    ).select("case_id", "label", "status")
    return good.withColumn("status", F.lit("ok")).unionByName(failed)


@query(
    "streaming_early_stop",
    f"""WITH {HIST}, m AS (SELECT run, epoch, min(val_loss) OVER (PARTITION BY run ORDER BY epoch) AS best, val_loss,
      row_number() OVER (PARTITION BY run ORDER BY epoch) AS i, min(val_loss) OVER (PARTITION BY run ORDER BY epoch
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM hist),
    c AS (SELECT *, i - max(CASE WHEN prev IS NULL OR val_loss < prev THEN i END) OVER (PARTITION BY run ORDER BY epoch) AS k FROM m)
    SELECT run, epoch, {r('best')} AS best, CAST(k AS INTEGER) AS counter, CAST(k >= 5 AS INTEGER) AS stop, 0 AS late FROM c
    UNION ALL SELECT run, 0, {r('min(best)')}, CAST(arg_max(k, epoch) AS INTEGER), CAST(arg_max(k, epoch) >= 5 AS INTEGER), 1 FROM c GROUP BY run""",
)
def streaming_early_stop(spark, sf_dir):
    source, sink, progress = (new_folder(spark, p) for p in ("epochs", "monitor", "progress"))
    b.hist(spark, sf_dir).write.parquet(source)
    monitor = jobs.early_stop_monitor(jobs.read_files(spark, source), 5)
    with jobs.rocksdb_state(spark):
        jobs.write_closed_windows(monitor, sink, progress)
        # Each run gets one more line, for an epoch before its first.
        late = b.hist(spark, sf_dir).groupBy("run").agg(F.lit(0).alias("epoch"), F.min("val_loss").alias("val_loss"))
        late.write.mode("append").parquet(source)
        jobs.write_closed_windows(monitor, sink, progress)
    return rounded(spark.read.schema(monitor.schema).parquet(sink))
