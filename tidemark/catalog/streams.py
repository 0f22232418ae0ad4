"""Streaming queries, each run to the end of the available files."""

import uuid

from pyspark.sql import functions as F

from tidemark.catalog.book import EDGE, saved
from tidemark.catalog.registry import query
from tidemark.session import checkpoint_root, stable
from tidemark.streaming import jobs


def ticks(v, delay="1 day"):
    return jobs.tick_stream(jobs.file_stream(v.spark, v.dir, "events.parquet"), delay)


def folder(v):
    return f"{checkpoint_root(v.spark)}/arriving-{uuid.uuid4().hex}"


def arriving(v, root):
    """A stream over a folder to which a query adds files between its runs; it exists from the start."""
    v.table("events").limit(0).write.parquet(f"{root}/in")
    return v.spark.readStream.schema(v.table("events").schema).parquet(f"{root}/in")


#: Ticks before this instant arrive in the first run of a query, the others in the second.
CUT = "2024-01-15"

LIMIT = 6 * 3_600_000_000


def halves(v, root):
    """A stream of ticks over a folder, and the two steps that add its files."""
    e = v.table("events")
    parts = [e.where(F.col("ts") < F.lit(CUT)), e.where(F.col("ts") >= F.lit(CUT))]
    return jobs.tick_stream(arriving(v, root)), [lambda p=p: p.write.mode("append").parquet(f"{root}/in") for p in parts]


def folder_stream(v, path, schema):
    v.spark.createDataFrame([], schema).write.parquet(path)
    return v.spark.readStream.schema(schema).parquet(path)


def watched(v):
    return stable(saved(v).withColumn("source", F.lit("saved")))


def fold_sql(edges, start):
    """Edges that survive the cooldown, each key from its own time of last alert."""
    return f"""SELECT key, unnest(list_transform(k[2:], lambda x: x.e)) AS event_id FROM (
  SELECT key, list_reduce(list_transform(list_concat([{{'t': s, 'e': -1}}], l), lambda x: [x]), lambda a, x: CASE WHEN x[1].t - a[len(a)].t >= {LIMIT} THEN list_concat(a, x) ELSE a END) AS k
  FROM (SELECT key, list({{'t': epoch_us(ts), 'e': event_id}} ORDER BY ts, event_id) AS l FROM {edges} GROUP BY key) JOIN (SELECT key, s FROM {start}) USING (key))"""


def two_runs_sql(forget, known="true"):
    """Alerts of both runs. Between them, alerts of event_id % 3 = 0 fail where `forget` is 'failed'; otherwise `forget`
    says which keys lose their state. `known` holds for the keys watched in the second run."""
    failed = forget == "failed"
    lost = "false" if failed else forget
    return EDGE.split(",\ned AS")[0] + f""",
o1 AS (SELECT * FROM ob WHERE ts < TIMESTAMP '{CUT}'),
e1 AS (SELECT * FROM (SELECT *, coalesce(lag(s) OVER w, false) AS p FROM o1 WINDOW w AS (PARTITION BY key ORDER BY ts, event_id)) WHERE s AND NOT p),
z1 AS (SELECT DISTINCT key, -4000000000000000 AS s FROM ob), a1 AS ({fold_sql("e1", "z1")}),
le AS (SELECT key, arg_max(event_id, (ts, event_id)) AS e FROM e1 GROUP BY key),
re AS (SELECT le.key FROM le JOIN a1 ON a1.key = le.key AND a1.event_id = le.e WHERE {failed} AND le.e % 3 = 0),
ok AS (SELECT a1.key, max(epoch_us(o1.ts)) AS t FROM a1 JOIN o1 USING (key, event_id) WHERE {"a1.event_id % 3 <> 0" if failed else "true"} GROUP BY a1.key),
en AS (SELECT key, arg_max(s, (ts, event_id)) AS s FROM o1 GROUP BY key),
z2 AS (SELECT z1.key, CASE WHEN {lost} THEN z1.s ELSE coalesce(ok.t, z1.s) END AS s, CASE WHEN {lost} OR re.key IS NOT NULL THEN false ELSE coalesce(en.s, false) END AS p
  FROM z1 LEFT JOIN ok USING (key) LEFT JOIN en USING (key) LEFT JOIN re USING (key)),
e2 AS (SELECT * FROM (SELECT ob.*, coalesce(lag(ob.s) OVER (PARTITION BY key ORDER BY ts, event_id), z2.p) AS q FROM ob JOIN z2 USING (key) WHERE ts >= TIMESTAMP '{CUT}' AND {known}) WHERE s AND NOT q),
a2 AS ({fold_sql("e2", "z2")})
SELECT key, event_id, 1 AS run FROM a1 UNION ALL SELECT key, event_id, 2 FROM a2"""


def in_run(v):
    """The run that an alert is of, by its own tick."""
    return F.when(F.col("ts") < F.lit(CUT), 1).otherwise(2).alias("run")


@query("st_monitor", two_runs_sql("failed"))
def st_monitor(v):
    """A third of the alerts of the first run fail, half of these without a word, so their edges are armed again."""
    root = folder(v)
    t, steps = halves(v, root)
    acks = folder_stream(v, f"{root}/acks", "key string, event_id bigint, delivered boolean")
    job = jobs.edge_alerts(t, watched(v), acks=acks)
    steps[0]()
    sent = jobs.run_once(job, f"{root}/ckpt", f"{root}/out")
    sent.where("event_id % 6 <> 0").select("key", "event_id", (F.col("event_id") % 3 != 0).alias("delivered")).write.mode("append").parquet(f"{root}/acks")
    steps[1]()
    return jobs.run_once(job, f"{root}/ckpt", f"{root}/out").select("key", "event_id", in_run(v))


@query("st_prune", two_runs_sql("CAST(split_part(key, ':', 2) AS BIGINT) % 4 = 0", "CAST(split_part(key, ':', 2) AS BIGINT) % 8 <> 0"))
def st_prune(v):
    """Watches of every fourth ticker are removed between the runs and half of them added back: these start afresh."""
    root = folder(v)
    t, steps = halves(v, root)
    w = watched(v)
    changes = folder_stream(v, f"{root}/changes", "target_key string, watched boolean")
    steps[0]()
    jobs.run_once(jobs.edge_alerts(t, w, changes=changes), f"{root}/ckpt", f"{root}/out")
    gone = w.where("ticker % 4 = 0").select(F.concat_ws(":", "source", F.col("ticker").cast("string"), "market").alias("target_key"))
    gone.withColumn("watched", F.lit(False)).write.mode("append").parquet(f"{root}/changes")
    steps[1]()
    later = jobs.edge_alerts(t, w.where("ticker % 8 <> 0"), changes=changes)
    return jobs.run_once(later, f"{root}/ckpt", f"{root}/out").select("key", "event_id", in_run(v))


DUE = "DATE '1970-01-05' + CAST(7 * ((m - 1) // 5) + (m - 1) % 5 AS INTEGER)"
CLOSE = f"""
c AS (SELECT id, ticker, direction, created_at, 100.0::DOUBLE AS e, CASE WHEN id % 3 = 0 THEN 1.0 ELSE CASE WHEN direction = 'BEAR' THEN 105.0 ELSE 95.0 END END::DOUBLE AS st,
    CASE WHEN id % 3 = 0 THEN CASE WHEN direction = 'BEAR' THEN 0.5 ELSE 200.0 END ELSE CASE WHEN direction = 'BEAR' THEN 97.0 ELSE 103.0 END END::DOUBLE AS tg,
    CASE timeframe WHEN '1W' THEN 5 WHEN '2W' THEN 10 WHEN '1M' THEN 21 WHEN '3M' THEN 63 WHEN '6M' THEN 126 WHEN '1Y' THEN 252 END AS n, CAST(CASE WHEN market = 'KR' THEN created_at + INTERVAL 9 HOUR ELSE created_at - INTERVAL 5 HOUR END AS DATE) - DATE '1970-01-05' AS k
  FROM (SELECT * REPLACE (TIMESTAMP '2023-12-26' + INTERVAL 1 DAY * (id % 25) + INTERVAL 1 SECOND * (id * 7919 % 86400) AS created_at) FROM predictions) WHERE status = 'OPEN'),
d AS (SELECT *, CAST({DUE} AS TIMESTAMP) AS due FROM (SELECT *, 5 * (k // 7) + least(k % 7 + 1, 5) + n AS m FROM c)),
t AS (SELECT d.*, ts, event_id, value AS price, (value - e) / e AS ch FROM d JOIN events ON user_id = ticker AND ts >= created_at AND (id % 2 = 0 OR ts >= TIMESTAMP '{CUT}')),
x AS (SELECT id, due, min((ts, event_id, price)) FILTER (ts < due AND CASE direction WHEN 'BULL' THEN price <= st OR price >= tg WHEN 'BEAR' THEN price >= st OR price <= tg ELSE abs(ch) > 0.03 END) AS h,
    max((ts, event_id, price)) FILTER (ts < due) AS l, min((ts, event_id, price)) FILTER (ts >= due) AS f FROM t GROUP BY id, due),
y AS (SELECT id, CASE WHEN h IS NOT NULL THEN h[1] WHEN l IS NOT NULL THEN due ELSE f[1] END AS ts, CASE WHEN h IS NOT NULL THEN h[3] WHEN l IS NOT NULL THEN l[3] ELSE f[3] END AS price, h IS NULL AS late FROM x)
SELECT id, price, CAST(CAST(ts AS DATE) AS VARCHAR) AS day,
  CASE WHEN direction = 'BULL' AND price <= st OR direction = 'BEAR' AND price >= st OR direction = 'NEUTRAL' AND abs((price - e) / e) > 0.03 THEN 'MISS'
    WHEN direction = 'BULL' AND price >= tg OR direction = 'BEAR' AND price <= tg OR direction = 'NEUTRAL' THEN 'HIT' ELSE 'EXPIRED' END AS status
FROM y JOIN c USING (id) WHERE ceil(epoch_us(ts) / 1000) <= (SELECT epoch_ms(max(ts)) - 86400000 FROM events)"""


@query("st_outcome", CLOSE, ("predictions",))
def st_outcome(v):
    """Predictions with even ids are open from the start, the others are opened between the two runs; created in the
    ticks' own weeks, every third has levels so wide that many expire by their timers."""
    root = folder(v)
    t, steps = halves(v, root)
    i, wide, bear = F.col("id"), F.col("id") % 3 == 0, F.col("direction") == "BEAR"
    p = stable(v.predictions.where("status = 'OPEN'").withColumns({
        "created_at": F.timestamp_seconds(F.lit(1703548800) + i % 25 * 86400 + i * 7919 % 86400),
        "stop_price": F.when(wide, 1.0).cast("double"), "target_price": F.when(wide, F.when(bear, 0.5).otherwise(200.0)).cast("double"),
    }).select("id", "ticker", "market", "direction", "timeframe", "created_at", "entry_price", "target_price", "stop_price"))
    opened = folder_stream(v, f"{root}/open", p.schema)
    for step, side in zip(steps, ("id % 2 = 0", "id % 2 = 1"), strict=True):
        step()
        p.where(side).write.mode("append").parquet(f"{root}/open")
        decided = jobs.run_once(jobs.deciding_ticks(t, opened), f"{root}/ckpt", f"{root}/out")
    return jobs.close_outcomes(decided, p).select("id", "price", F.to_date("ts").cast("string").alias("day"), "status")


@query("st_news_window", """
w AS (SELECT user_id AS ticker, unnest(range(0, 7)) AS k, CAST(ts AS DATE) AS d FROM events),
g AS (SELECT d - CAST(k AS INTEGER) AS s, ticker, count(*) AS n FROM w GROUP BY ALL)
SELECT CAST(s AS VARCHAR) AS start, ticker, n FROM g WHERE s + INTERVAL 7 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
def st_news_window(v):
    out = jobs.run_once(jobs.sliding_counts(ticks(v), "ticker"))
    return out.select(F.to_date("start").cast("string").alias("start"), "ticker", "n")


@query("st_ingest", "SELECT event_id, user_id AS ticker, event_type AS feed FROM events")
def st_ingest(v):
    """Two runs over a folder that grows between them: the second reads the new files only."""
    root = folder(v)
    t = jobs.tick_stream(arriving(v, root)).select("event_id", "ticker", "feed")
    for part in ("event_id % 2 = 0", "event_id % 2 = 1"):
        v.table("events").where(part).write.mode("append").parquet(f"{root}/in")
        out = jobs.run_once(t, f"{root}/ckpt", f"{root}/out")
    return out


@query("st_notify_once", "SELECT user_id::VARCHAR AS key, 70 AS threshold FROM events GROUP BY user_id HAVING count(*) >= 70")
def st_notify_once(v):
    return jobs.run_once(jobs.notify_once(ticks(v), "ticker", 70))


@query("st_late_data", """SELECT CASE WHEN epoch(ts)::BIGINT < (SELECT epoch(max(ts))::BIGINT FROM events WHERE event_id % 2 = 0) - 86400 THEN 'late' ELSE 'on_time' END AS side, count(*) AS n FROM (SELECT * REPLACE (date_trunc('second', ts) AS ts) FROM events) events WHERE event_id % 2 = 1 GROUP BY side""")
def st_late_data(v):
    """Even events arrive first and set the mark; the odd ones are split against it."""
    root = folder(v)
    t = jobs.tick_stream(arriving(v, root))
    for part in ("event_id % 2 = 0", "event_id % 2 = 1"):
        v.table("events").where(part).write.mode("append").parquet(f"{root}/in")
        jobs.split_late_stream(t, f"{root}/out", f"{root}/ckpt", 86400).awaitTermination()
    sides = [v.spark.read.schema(t.schema).parquet(f"{root}/out/{k}").where("event_id % 2 = 1").select(F.lit(k).alias("side")) for k in ("on_time", "late")]
    return sides[0].unionByName(sides[1]).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query("st_idempotent_day", "SELECT market, CAST(date AS VARCHAR) AS date, nav FROM nav", ("nav",))
def st_idempotent_day(v):
    """The sink itself: half of the rows, then all of them by a sink that has lost its checkpoint."""
    root = folder(v)
    n = v.nav.select("market", "date", "nav", F.date_format("date", "yyyy-MM").alias("month"))
    n.limit(0).write.parquet(f"{root}/in")
    t = v.spark.readStream.schema(n.schema).parquet(f"{root}/in")
    for k, part in enumerate(("day(date) <= 15", "day(date) > 15")):
        n.where(part).write.mode("append").parquet(f"{root}/in")
        jobs.idempotent_day(t, f"{root}/out", f"{root}/ckpt{k}", ["market", "date"], "month").awaitTermination()
    return v.spark.read.schema(n.schema).parquet(f"{root}/out").select("market", F.col("date").cast("string").alias("date"), "nav")
