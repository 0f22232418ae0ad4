import warnings

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import dates as fd
from tidemark.functions.passage import first_passage
from tidemark.streaming import jobs

TICKS = "event_id bigint, ticker string, ts timestamp, price double, feed string"
PREDS = "id bigint, ticker string, market string, direction string, timeframe string, created_at timestamp, entry_price double, target_price double, stop_price double"


def arriving(spark, path, schema):
    """A stream over a folder and a function that adds rows to it; instants are given as text."""
    def add(rows):
        text = ", ".join(f"{f.name} {'string' if f.dataType.typeName() == 'timestamp' else f.dataType.simpleString()}" for f in spark.createDataFrame([], schema).schema)
        df = spark.createDataFrame(rows, text)
        df.select(*[F.col(f.name).cast(f.dataType) for f in spark.createDataFrame([], schema).schema]).write.mode("append").parquet(path)

    add([])
    return spark.readStream.schema(schema).parquet(path), add


def test_predictions_close_by_level_by_timer_and_when_added_later(spark, tmp_path):
    live, tick = arriving(spark, f"{tmp_path}/in", TICKS)
    preds, predict = arriving(spark, f"{tmp_path}/open", PREDS)
    job = lambda: jobs.run_once(jobs.deciding_ticks(live.withWatermark("ts", "1 day"), preds, 2), f"{tmp_path}/c", f"{tmp_path}/o")
    one = lambda i, day, direction="BULL", ticker="T": (i, ticker, "US", direction, "1W", f"2024-01-{day} 12:00:00", 100.0, None, None)
    predict([one(1, "10"), one(2, "10", "NEUTRAL"), one(3, "10", "BEAR", "U"), one(4, "10", "BULL", "V")])
    # before creation; inside the band; deciding, out of order; T alone moves the mark past the ends of the others
    tick([(1, "T", "2024-01-09 00:00:00", 150.0, "a"), (2, "T", "2024-01-10 15:00:00", 101.0, "a"), (4, "T", "2024-01-12 05:00:00", 150.0, "a"),
          (3, "T", "2024-01-11 05:00:00", 90.0, "a"), (5, "U", "2024-01-12 00:00:00", 101.0, "a")])
    first = {r.id: (str(r.ts), r.price) for r in job().collect()}
    assert first == {1: ("2024-01-11 05:00:00", 90.0), 2: ("2024-01-11 05:00:00", 90.0)}
    predict([one(5, "10"), one(6, "16")])  # 5 was created early but opened now: it sees only what comes now
    tick([(6, "T", "2024-01-16 00:00:00", 101.0, "a"), (7, "T", "2024-01-25 00:00:00", 99.0, "a"), (8, "W", "2024-02-20 00:00:00", 1.0, "a")])
    got = {r.id: (str(r.ts), r.price) for r in job().collect()}
    # 3 expires without another tick of U, at its last price; 4 has never been priced and stays open
    assert got == {1: ("2024-01-11 05:00:00", 90.0), 2: ("2024-01-11 05:00:00", 90.0), 3: ("2024-01-17 00:00:00", 101.0), 5: ("2024-01-17 00:00:00", 101.0), 6: ("2024-01-25 00:00:00", 99.0)}
    table = spark.read.schema(PREDS).parquet(f"{tmp_path}/open")
    closed = {r.id: (r.status, r.ret) for r in jobs.close_outcomes(spark.read.parquet(f"{tmp_path}/o"), table).collect()}
    assert closed == {1: ("MISS", -10.0), 2: ("MISS", -10.0), 3: ("EXPIRED", -1.0), 5: ("EXPIRED", 1.0), 6: ("EXPIRED", -1.0)}
    tick([(9, "V", "2024-02-21 00:00:00", 104.0, "a"), (10, "W", "2024-03-20 00:00:00", 1.0, "a"), (11, "T", "2024-03-20 00:00:00", 1.0, "a")])
    late = {r.id: (str(r.ts), r.price) for r in job().collect()}
    assert late == got | {4: ("2024-02-21 00:00:00", 104.0)}


def test_undelivered_edges_fire_again_and_removed_watches_start_afresh(spark, tmp_path):
    live, tick = arriving(spark, f"{tmp_path}/in", TICKS)
    acks, ack = arriving(spark, f"{tmp_path}/acks", "key string, event_id bigint, delivered boolean")
    changes, change = arriving(spark, f"{tmp_path}/changes", "target_key string, watched boolean")
    watch = spark.createDataFrame([(t, "US", "BULL", None, None, 10.0, 50.0, None, "saved") for t in "ABCDE"], "ticker string, market string, direction string, entry_low double, entry_high double, stop double, target double, reentry double, source string")

    def job():
        with warnings.catch_warnings():
            warnings.simplefilter("error", FutureWarning)
            out = jobs.run_once(jobs.edge_alerts(live.withWatermark("ts", "1 day"), watch, acks=acks, changes=changes), f"{tmp_path}/c", f"{tmp_path}/o")
        return sorted((r.key, r.event_id) for r in out.collect())

    at = lambda e, t, hour, p: (e, t, f"2024-01-01 {hour:02d}:00:00", p, "a")
    tick([at(i, t, 1, 60.0) for i, t in enumerate("ABCDE")])
    key = lambda t, trigger="TARGET": f"saved:{t}:US:{trigger}"
    first = [(key(t), i) for i, t in enumerate("ABCDE")]
    assert job() == first
    # A delivered, B refused, C never told, D delivered and its watch removed and added back, E refused but left since
    ack([(key("A"), 0, True), (key("B"), 1, False), (key("D"), 3, True), (key("E"), 4, False)])
    change([("saved:D:US", False), ("saved:D:US", True)])
    tick([at(10 + i, t, 2, 60.0) for i, t in enumerate("ABCD")] + [at(14, "E", 2, 20.0), at(24, "E", 3, 60.0), at(20, "A", 3, 20.0), at(30, "A", 4, 60.0)])
    # A left and came back within the cooldown of its delivered alert
    second = first + [(key("B"), 11), (key("C"), 12), (key("D"), 13), (key("E"), 24)]
    assert job() == sorted(second)
    change([("saved:B:US", False)])
    assert job() == sorted(second)
    state = spark.read.format("statestore").option("stateVarName", "edge").load(f"{tmp_path}/c").select("key.target_key").collect()
    assert sorted(r.target_key for r in state) == [f"saved:{t}:US" for t in "ACDE"]


def test_first_passage_is_what_a_walk_finds():
    g = np.random.default_rng(2)
    for n in (0, 1, 2, 37, 300):
        price = g.integers(0, 100, n).astype(float)
        a, z = g.integers(0, n + 1, 80), g.integers(0, n + 1, 80)
        low, high = g.choice([-1, 3, 20], 80), g.choice([97, 200, 60], 80)
        want = [next((i for i in range(x, y) if price[i] <= lo or price[i] + 1 >= hi), y) for x, y, lo, hi in zip(a, z, low, high)]
        assert first_passage(price, price + 1, a, z, low, high).tolist() == want


def test_business_day_after_inverts_the_count(spark):
    d = spark.sql("SELECT explode(sequence(DATE'2023-12-20', DATE'2024-01-20')) AS d").withColumn("n", F.explode(F.array(*[F.lit(k) for k in (1, 4, 5, 6, 21, 252)])))
    e = d.withColumn("e", fd.business_day_after(F.col("d"), F.col("n")))
    bad = e.where((fd.business_days(F.col("d"), F.col("e")) != F.col("n")) | (fd.business_days(F.col("d"), F.date_sub("e", 1)) >= F.col("n")))
    assert bad.count() == 0


def test_a_replayed_batch_writes_nothing(spark, tmp_path):
    s = "k string, date date, x int"
    rows = spark.createDataFrame([("a", "2024-01-01", 2), ("a", "2024-01-01", 1), ("b", "2024-01-02", 3)], "k string, date string, x int")
    rows.withColumn("date", F.to_date("date")).write.parquet(f"{tmp_path}/in")
    t = spark.readStream.schema(s).parquet(f"{tmp_path}/in")
    for c in ("c1", "c2"):
        jobs.idempotent_day(t, f"{tmp_path}/out", f"{tmp_path}/{c}", ["k", "date"]).awaitTermination()
    got = spark.read.schema(s).parquet(f"{tmp_path}/out").collect()
    assert sorted((r.k, str(r.date), r.x) for r in got) == [("a", "2024-01-01", 1), ("b", "2024-01-02", 3)]


def test_late_rows_go_to_the_side_table(spark, tmp_path):
    add = lambda rows: spark.createDataFrame(rows, "id int, ts string").withColumn("ts", F.to_timestamp("ts")).write.mode("append").parquet(f"{tmp_path}/in")
    add([(0, None)])
    t = spark.readStream.schema("id int, ts timestamp").parquet(f"{tmp_path}/in").where("id > 0")
    for rows in ([(1, "2024-01-01 00:00:00"), (2, "2024-01-10 00:00:00")], [(3, "2024-01-08 23:00:00"), (4, "2024-01-09 01:00:00")]):
        add(rows)
        jobs.split_late_stream(t, f"{tmp_path}/out", f"{tmp_path}/c", 86_400).awaitTermination()
    ids = lambda k: sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out/{k}").collect())
    assert ids("on_time") == [1, 2, 4] and ids("late") == [3]
