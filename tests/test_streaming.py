"""Streams give what batches give, whatever the micro-batches, across restarts and replays."""

import datetime as dt
import json
import tempfile

import pytest
from pyspark.sql import functions as F

from tickloom.functions.windows import KEY
from tickloom.operators import fusion, indicators, structure
from tickloom.plans.streams import Arrivals, by_position
from tickloom.sources import fixtures
from tickloom.sources.merge import merged
from tickloom.streaming import bars as live
from tickloom.streaming import state
from tickloom.streaming.store import BarStore

BAR = "symbol string, tf string, ts timestamp_ntz, has_time boolean, open double, high double, low double, close double, vol double"


def key(df):
    return sorted(map(tuple, df.collect()), key=str)


def bar(symbol, day, close, has_time=False, tf="d"):
    ts = dt.datetime.fromisoformat(day)
    return (symbol, tf, ts, has_time, 1.0, 2.0, 0.5, float(close), 10.0)


@pytest.fixture(scope="module")
def walk(spark, sf):
    """Three series, one cut to 20 bars, fewer than the means need."""
    bars = fixtures.bars_walk(spark, sf).where("symbol in ('600005', '000001', '300002')").where("symbol <> '300002' or idx < 20")
    return bars.cache()


def test_live_bars_in_update_mode(spark, sf):
    """Bars are told as they change; state of closed windows goes, and ticks later than the delay are dropped."""
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    ticks = [("a", at(1), 1, 5.0, 1.0), ("a", at(2), 2, 7.0, 1.0), ("a", at(6), 3, 6.0, 1.0), ("a", at(4), 4, 4.0, 1.0), ("a", at(40), 5, 9.0, 1.0), ("a", at(41), 6, 8.0, 1.0), ("a", at(3), 7, 1.0, 1.0)]
    rows = spark.createDataFrame(ticks, "symbol string, ts timestamp, seq long, price double, vol double")
    told = Arrivals(spark).run(rows, [F.col("seq") <= 2, F.col("seq").isin(3, 4), F.col("seq").isin(5, 6), F.col("seq") == 7], lambda s: live.live_bars(s, 5, "10 minutes"), "update")
    got = key(told.select(F.minute("ts").alias("m"), "open", "high", "low", "close", "vol"))
    assert got == sorted([(0, 5.0, 7.0, 5.0, 7.0, 2.0), (0, 5.0, 7.0, 4.0, 4.0, 3.0), (5, 6.0, 6.0, 6.0, 6.0, 1.0), (40, 9.0, 9.0, 8.0, 8.0, 2.0)], key=str)


@pytest.mark.parametrize("ends", [(0, 1, 19), (26, 200)])
def test_merged_bars_equal_batch(spark, walk, ends):
    told = Arrivals(spark).run(walk, by_position(*ends), state.running_merged_bars, "update")
    columns = [*KEY, "pos", "idx", "ts", "high", "low", "members", "vol", "amount"]
    assert key(state.latest(told, *KEY, "pos").select(columns)) == key(structure.merged_bars(walk).select(columns))
    assert told.where("final").groupBy(*KEY, "pos").count().where("count > 1").isEmpty()  # final is final


@pytest.mark.parametrize("ends", [(5, 18, 40), (25,)])
def test_running_indicators_equal_batch(spark, walk, ends):
    told = state.latest(Arrivals(spark).run(walk, by_position(*ends), state.running_indicators, "update"), *KEY, "idx")
    batch = indicators.macd(walk).join(indicators.volume_scores(walk), [*KEY, "idx"])
    columns = [*KEY, "idx", "dif", "dea", "macd_hist", "obv"]
    assert key(told.select(columns)) == key(batch.select(columns))
    assert told.where("symbol = '300002' and dif is not null").isEmpty() and told.where("symbol = '300002'").count() == 20


def test_rows_seen_twice_change_nothing(spark, walk):
    a = Arrivals(spark)
    told = a.run(walk, [F.col("idx") <= 60, F.col("idx").between(30, 90)], state.running_indicators, "update")
    short = walk.where("idx <= 90")
    assert key(state.latest(told, *KEY, "idx").select(*KEY, "idx", "obv")) == key(indicators.volume_scores(short).select(*KEY, "idx", "obv"))


def test_rows_are_worked_out_once(spark, walk):
    """However many slices arrive, the rows behind them are read once."""
    seen = spark.sparkContext.accumulator(0)

    def read(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    told = Arrivals(spark).run(walk.mapInArrow(read, walk.schema), by_position(0, 50, 100), lambda s: s)
    assert told.count() == walk.count() == seen.value


def test_empty_slices_arrive_too(spark, walk):
    told = Arrivals(spark).run(walk, [F.lit(False), F.col("idx") < 30, F.col("idx") > 1 << 29], state.running_indicators, "update")
    assert told.where("seen = 30").count() > 0 and told.groupBy(*KEY).agg(F.max("seen").alias("n")).where("n > 30").isEmpty()
    assert Arrivals(spark).run(walk.limit(0), by_position(10), state.running_merged_bars, "update").isEmpty()


@pytest.mark.parametrize("told", [state.running_merged_bars, state.running_indicators])
def test_series_go_to_their_state_as_few_rows(spark, walk, told, monkeypatch):
    """What a processor gets of a series in a micro-batch is a row for each Arrow batch that holds some of it."""
    packs, packed = spark.sparkContext.accumulator(0), state._packed

    def counted(batches):
        for batch in batches:
            packs.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(state, "_packed", lambda rows: (lambda df: df.mapInArrow(counted, df.schema))(packed(rows)))
    assert not Arrivals(spark).run(walk, by_position(100), told, "update").isEmpty()
    assert 0 < packs.value < walk.count() / 10


def test_late_rows_are_cut_per_series(spark):
    """Each series has a day of its own, from the table or from what has passed, also after a restart."""
    stored = spark.createDataFrame([bar("a", "2024-03-10", 1), bar("b", "2024-01-10", 1)], BAR)
    rows = [("2024-03-09", "a"), ("2024-03-08", "a"), ("2024-01-09", "b"), ("2023-01-01", "new"), ("2024-03-20", "a")]
    second = [("2024-03-18", "a"), ("2024-03-19", "a"), ("2024-01-09", "b"), ("2022-12-31", "new"), ("2022-12-30", "new")]
    arrive = [(*bar(s, d, 1), k) for k, part in enumerate((rows, second)) for d, s in part]
    df = spark.createDataFrame(arrive, f"{BAR}, k int")
    got = Arrivals(spark).run(df, [F.col("k") == 0, F.col("k") == 1], lambda s: state.without_late_rows(s, stored))
    want = [("2024-03-09", "a", 0), ("2024-01-09", "b", 0), ("2023-01-01", "new", 0), ("2024-03-20", "a", 0), ("2024-03-19", "a", 1), ("2024-01-09", "b", 1), ("2022-12-31", "new", 1)]
    assert key(got.select(F.date_format("ts", "yyyy-MM-dd"), "symbol", "k")) == sorted(want, key=str)
    assert got.columns == df.columns


def stores(spark):
    old = [bar(s, f"2024-{m:02}-{d:02}", m) for s in "abc" for m in (1, 2, 3) for d in (5, 6)] + [bar("a", "2024-01-05 10:00:00", 1, True, "f60")]
    new = [bar("a", "2024-02-06", 99), bar("a", "2024-04-01", 100), bar("b", "2024-03-07", 101), bar("b", "2024-03-07", 90)]
    root = tempfile.mkdtemp(prefix="bars-") + "/store"
    return root, spark.createDataFrame(old, BAR), spark.createDataFrame(new, BAR)


def test_store_is_the_batch_merge(spark):
    root, old, new = stores(spark)
    store = BarStore(spark, root)
    assert store.read().count() == 0 and store.last_days().count() == 0  # nothing there is no error
    store.merge_batch(old, 0)
    assert key(store.read()) == key(old.select(store.read().columns))
    untouched = f"{root}/tf=d/month=2024-01"
    before = BarStore(spark, untouched).folder.fs.getFileStatus(BarStore(spark, untouched).folder.at()).getModificationTime()
    store.merge_batch(new, 1)
    assert key(store.read()) == key(merged(old, new))
    assert BarStore(spark, untouched).folder.fs.getFileStatus(BarStore(spark, untouched).folder.at()).getModificationTime() == before
    store.merge_batch(new.withColumn("close", F.lit(0.0)), 1)  # a batch that was committed is passed over
    assert key(store.read()) == key(merged(old, new))
    store.merge_batch(new.limit(0), 2)
    assert key(store.read()) == key(merged(old, new))
    store.merge_batch(new.withColumn("close", F.lit(0.0)), 1, "other stream")
    assert store.read().where("close = 0").count() == 3


def test_first_times_of_day_drop_rows_without(spark):
    """A series whose new rows have times loses its old date-only rows in every month; other series keep theirs."""
    root, old, _ = stores(spark)
    store, new = BarStore(spark, root), spark.createDataFrame([bar("a", "2024-05-01 09:30:00", 7, True), bar("b", "2024-05-01", 8)], BAR)
    store.merge_batch(old, 0)
    store.merge_batch(new, 1)
    assert key(store.read()) == key(merged(old, new))
    assert store.read().where("symbol = 'a' and tf = 'd'").count() == 1


@pytest.mark.parametrize("crash", ["before ready", "after ready", "between moves", "before the mark"])
def test_a_killed_commit_goes_on_after_restart(spark, crash, monkeypatch):
    """The stream dies inside its second commit; restarted from its checkpoint, it gives the batch merge."""
    root, old, new = stores(spark)
    new = new.withColumn("k", F.when(F.col("symbol") == "a", 0).otherwise(1)).unionByName(new.withColumn("close", F.lit(55.0)).where("symbol = 'a'").withColumn("k", F.lit(1)))
    want = merged(merged(old, new.where("k = 0")), new.where("k = 1"))
    BarStore(spark, root).merge_batch(old, 0, "first load")

    class Dying(BarStore):
        moves = 0

        def _swap(self, staging):
            if "bars-1" not in staging:
                return super()._swap(staging)
            if crash == "after ready":
                raise RuntimeError("killed")
            if crash == "between moves":
                move = self.folder.move

                def once(*args):
                    self.moves += 1
                    if self.moves == 2:
                        raise RuntimeError("killed")
                    move(*args)

                self.folder.move = once
            super()._swap(staging)
            if crash == "before the mark":
                raise RuntimeError("killed")

        def _stage(self, batch, staging):
            if crash != "before ready" or "bars-1" not in staging:
                return super()._stage(batch, staging)
            write = self.folder.write
            self.folder.write = lambda name, text: (_ for _ in ()).throw(RuntimeError("killed")) if name.endswith("ready") else write(name, text)
            super()._stage(batch, staging)

    a, slices = Arrivals(spark), [F.col("k") == 0, F.col("k") == 1]
    with pytest.raises(Exception, match="killed"):
        a.run(new, slices, lambda s: s, sink=Dying(spark, root).sink())
    store = BarStore(spark, root)
    a.run(new, [F.lit(False)], lambda s: s, sink=store.sink())  # no further rows: the batch that died is done again
    assert key(store.read()) == key(want)
    assert not store.folder.has("_staging", "bars-1") and store.folder.has("_committed", "bars", "1")


def alert_rows(spark):
    """Points, events and a clock of bars over three series; one falls silent with a point in hand."""
    day = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(days=i)
    points = [("a", "d", "bi", 10, "1buy", 5.0), ("a", "d", "xd", 10, "2buy", 5.0), ("a", "d", "bi", 30, "3sell", 6.0), ("b", "d", "bi", 12, "1sell", 7.0), ("b", "d", "bi", 20, "1buy", 7.0), ("c", "d", "bi", 3, "2sell", 1.0)]
    events = [("a", "d", 5, "Spring", 0), ("a", "d", 15, "SC", 1), ("a", "d", 16, "ST", 0), ("a", "d", 28, "SOW", 0), ("b", "d", 17, "UTAD", 0), ("b", "d", 26, "AR", 0), ("c", "d", 4, "PS", 0), ("c", "d", 4, "PSY", 1)]
    p = spark.createDataFrame(points, "symbol string, tf string, level string, idx int, bs_type string, price double")
    e = spark.createDataFrame(events, "symbol string, tf string, idx int, event_type string, seq int")
    none = lambda kind: F.lit(None).cast(kind)
    rows = p.select("symbol", "tf", "idx", F.lit("point").alias("kind"), "level", F.col("bs_type").alias("type"), "price", none("int").alias("seq"))
    rows = rows.unionByName(e.select("symbol", "tf", "idx", F.lit("event").alias("kind"), none("string").alias("level"), F.col("event_type").alias("type"), none("double").alias("price"), "seq"))
    clock = [(s, i) for s, n in (("a", 45), ("b", 30), ("c", 6), ("z", 400)) for i in range(n)]
    bars = spark.createDataFrame(clock, "symbol string, idx int").select("symbol", F.lit("d").alias("tf"), "idx", F.lit("bar").alias("kind"), none("string").alias("level"), none("string").alias("type"), none("double").alias("price"), none("int").alias("seq"))
    return p, e, rows.unionByName(bars).withColumn("ts", (F.lit(day(0)).cast("timestamp") + F.make_dt_interval(F.col("idx"))).cast("timestamp_ntz"))


@pytest.mark.parametrize("ends, lag", [((13, 14, 29, 60), 0), ((11, 80), 4)])
def test_alerts_are_told_once(spark, ends, lag):
    """Each fused signal once, equal to the batch, although the sink replays and every slice is a restart; points come ``lag`` bars late."""
    points, events, rows = alert_rows(spark)

    def told(s):
        p, e = s.where("kind = 'point'").withColumnRenamed("type", "bs_type"), s.where("kind = 'event'").withColumnRenamed("type", "event_type")
        return state.fusion_alerts(p, e, s.where("kind = 'bar'"), lag=lag, delay="1 day")

    # what is late by its bar is not late by its time: a point carries the time at which it is known
    known = rows.withColumn("idx2", F.col("idx") + F.when(F.col("kind") == "point", lag).otherwise(0))
    known = known.withColumn("ts", F.when(F.col("kind") == "point", F.col("ts") + F.make_dt_interval(F.lit(lag))).otherwise(F.col("ts")))
    starts = (-1, *ends)
    slices = [(F.col("idx2") > a) & (F.col("idx2") <= b) for a, b in zip(starts, (*ends, 1 << 30))]
    got = Arrivals(spark).run(known, slices, told)
    assert key(got) == key(fusion.fused(points, events).select(got.columns))
    assert got.count() == 6


def test_ruled_is_fused(spark):
    points, events, _ = alert_rows(spark)
    near = points.join(events.select("symbol", "tf", F.col("idx").alias("event_idx"), "seq", "event_type"), KEY).where("abs(event_idx - idx) <= 5")
    near = near.groupBy(*points.columns).agg(F.array_sort(F.collect_list(F.struct("event_idx", "seq", "event_type"))).alias("near"))
    want = fusion.fused(points, events)
    assert key(fusion.ruled(near).select(want.columns)) == key(want)
    assert json.dumps(want.select("reading").first().reading)
