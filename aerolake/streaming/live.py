"""Streaming operators over the live feed.

Each takes and returns a streaming (or batch) DataFrame; starting the query is
left to the caller, see :func:`run_available`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.functions import aqi as A
from aerolake.functions.values import lookup_key
from aerolake.operators import daily_state
from aerolake.operators.cities import alias_keys
from aerolake.plans.joins import join_dimension
from aerolake.session import shared_dir
from aerolake.sources.feeds import parse_feed_components, parse_feed_iaqi
from aerolake.streaming import current

# Refresh interval and cache life time of the live feed.
REFRESH = "5 minutes"
TTL = "5 minutes"


def read_stream(spark: SparkSession, path: str, schema, kind: str = "parquet", **options: str) -> DataFrame:
    """Files arriving at ``path``; a single file is followed through its folder."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(schema).format(kind).options(**options)
    if fs.exists(hadoop) and fs.getFileStatus(hadoop).isFile():
        return reader.option("pathGlobFilter", hadoop.getName()).load(str(hadoop.getParent()))
    return reader.load(path)


def stream_ingest(events: DataFrame, aliases: DataFrame, kind: str = "iaqi", payload: str = "payload") -> DataFrame:
    """Provider payloads to canonical rows; unmapped cities keep their lower-case name.

    The alias table is a static side with one row per key, broadcast when its size allows.
    """
    parsed = parse_feed_iaqi(events, payload) if kind == "iaqi" else parse_feed_components(events, payload)
    named = join_dimension(parsed.withColumn("__alias", lookup_key("city")), alias_keys(aliases), ["__alias"], bound=aliases)
    return named.withColumn("city", F.coalesce("canonical", "__alias")).drop("__alias", "canonical")


def stream_dedupe(events: DataFrame, key: str = "event_id", ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Each event once within the watermark."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def stream_ttl(events: DataFrame, keys: list[str] = ("city",), ts: str = "ts", ttl: str = TTL, delay: str = "1 hour",
               tie: str = "event_id") -> DataFrame:
    """One reading per key and life-time window: the newest."""
    rest = [c for c in events.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(ts, tie)).alias("row")
    grouped = events.withWatermark(ts, delay).groupBy(F.window(ts, ttl).alias("w"), *keys).agg(newest)
    return grouped.select(F.col("w.start").alias("window_start"), *keys, "row.*")


def stream_latest_city(events: DataFrame, keys: list[str] = ("city",), ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Newest row per key; state is one row per key (update or complete mode)."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(ts, tie)).alias("row")).select(*keys, "row.*")


def stream_compare(live: DataFrame, forecast: DataFrame, value: str = "value", ts: str = "ts") -> DataFrame:
    """Live rows with the forecast of their day, accuracy, category and trend.

    The forecast is a static table of cities and a few days, read again by every
    micro-batch: pass a written table, not a computation over the history. It is broadcast when its size allows.
    """
    day = F.to_date(ts)
    days = forecast.select("city", F.col("date").alias("__day"), F.col("predicted_aqi").alias("predicted_today"))
    joined = join_dimension(live.withColumn("__day", day), days, ["city", "__day"], how="inner")
    return joined.withColumns({
        "accuracy": A.prediction_accuracy(value, "predicted_today"),
        "category": A.aqi_category(value),
        "trend": A.trend_word(value, "predicted_today"),
    }).withColumnRenamed("__day", "date")


def stream_compare_published(
    live: DataFrame, forecasts: DataFrame, value: str = "value", ts: str = "ts", published: str = "published", ahead: str = "2 days", wait: str = "1 hour",
    delay: str = "1 hour",
) -> DataFrame:
    """Live rows with the forecasts of their city and day from a second stream, published while this one runs.

    A forecast counts for a reading if it was published at most ``ahead`` before it and ``wait`` after it. Both streams have a watermark, so state
    holds that span only; a reading without any forecast comes out with nulls once both watermarks say none can follow. A forecast
    that is published again gives another row; the newest ``published`` is the valid one.
    """
    said = forecasts.select(
        F.col("city").alias("__city"), F.col("date").alias("__date"), F.col("predicted_aqi").alias("predicted_today"), F.col(published).alias("published"),
    ).withWatermark("published", delay)
    seen = live.withWatermark(ts, delay).withColumn("date", F.to_date(ts))
    span = F.col("published").between(F.col(ts) - F.expr(f"INTERVAL {ahead}"), F.col(ts) + F.expr(f"INTERVAL {wait}"))
    joined = seen.join(said, (F.col("city") == F.col("__city")) & (F.col("date") == F.col("__date")) & span, "left_outer").drop("__city", "__date")
    known = F.col("predicted_today").isNotNull()
    return joined.withColumns({
        "accuracy": F.when(known, A.prediction_accuracy(value, "predicted_today")),
        "category": A.aqi_category(value),
        "trend": F.when(known, A.trend_word(value, "predicted_today")),
    })


def stream_daily(events: DataFrame, keys: list[str], value: str = "value", ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Daily mean per key on event time; rows later than the watermark are dropped.

    Days the watermark has not passed are not emitted in append mode.
    """
    grouped = events.withWatermark(ts, delay).groupBy(F.window(ts, "1 day").alias("w"), *keys)
    return grouped.agg(F.avg(value).alias(value), F.count("*").alias("n")).select(
        *keys, F.to_date("w.start").alias("date"), value, "n"
    )


def current_table(spark: SparkSession, out: str, schema) -> DataFrame:
    """The newest committed state of a current table."""
    return current.read(spark, out, schema)


_folders = current.versions


def use_state_store(spark: SparkSession) -> None:
    """Arbitrary state with timers needs the store on disk; set before the query starts, unless the caller chose one."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(name, ""):
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_first_answer(
    events: DataFrame, keys: list[str] = ("city",), ts: str = "ts", ttl: str = TTL, delay: str = "1 hour", tie: str = "event_id",
    run_rows: int = 20_000,
) -> DataFrame:
    """The readings that answer: the first of a key answers for the life time from *its* time, those within are left out, the next one answers anew.

    State is one time for each key, cleared by a timer once the watermark passes it. Rows of a key are taken in order of time
    within a micro-batch, of equal times the smallest ``tie``; a reading older than the answer that holds is left out.
    A task sees the rows of a key of one micro-batch, but holds ``run_rows`` of them: more are sorted in runs, which wait in Spark's local folder.
    """
    from pyspark.sql.streaming import StatefulProcessor

    # What workers run is defined in here, so that it goes with the query and they need not have this package.
    def in_order(rows):
        """The rows in order of time and tie, whatever their number."""
        import heapq
        import os
        import pickle
        import tempfile
        from itertools import batched, chain, islice

        from pyspark.sql import Row

        first = list(islice(rows, 1))
        if not first:
            return
        fields = first[0].__fields__
        when, then = fields.index(ts), fields.index(tie)

        def order(values):
            return values[when], values[then]

        local = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]

        def put(values):
            """A file of its own, gone when it is closed."""
            file = tempfile.TemporaryFile(dir=local if os.path.isdir(local) else None)
            for part in batched(values, 500):
                pickle.dump(part, file, pickle.HIGHEST_PROTOCOL)
            return file

        def read(file):
            file.seek(0)
            with file:
                while True:
                    try:
                        yield from pickle.load(file)
                    except EOFError:
                        return

        found = (tuple(r) for r in chain(first, rows) if r[ts] is not None)
        runs = [[]]  # of runs as long as each other, at most 63; earlier rows are in the longer ones
        while len(run := sorted(islice(found, run_rows), key=order)) == run_rows:
            runs[0].append(put(run))
            for level in range(len(runs)):
                if len(runs[level]) < 64:
                    break
                if level + 1 == len(runs):
                    runs.append([])
                runs[level + 1].append(put(heapq.merge(*map(read, runs[level]), key=order)))
                runs[level] = []
        for values in heapq.merge(*[read(f) for level in reversed(runs) for f in level], run, key=order):
            yield Row(*fields)(*values)

    spark = events.sparkSession
    use_state_store(spark)
    span = int(events.sparkSession.range(1).select((F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {ttl}"))).alias("m")).first().m)
    names = events.columns

    class Answers(StatefulProcessor):
        """Keeps until when the last answer of a key holds, in microseconds."""

        def init(self, handle) -> None:
            self._handle = handle
            self._until = handle.getValueState("until", "until bigint")

        def handleInputRows(self, key, rows, timerValues):
            import datetime

            epoch, micro = datetime.datetime(1970, 1, 1), datetime.timedelta(microseconds=1)
            until = before = self._until.get()[0] if self._until.exists() else None
            for row in in_order(rows):
                at = (row[ts].replace(tzinfo=None) - epoch) // micro
                if until is None or at >= until:
                    until = at + span
                    yield row
            if until != before:
                self._until.update((until,))
                if before is not None:
                    self._handle.deleteTimer(-(-before // 1000))
                self._handle.registerTimer(-(-until // 1000))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self._until.clear()
            return iter(())

        def close(self) -> None:
            pass

    marked = events.withWatermark(ts, delay).groupBy(*keys)
    return marked.transformWithState(statefulProcessor=Answers(), outputStructType=events.schema, outputMode="append", timeMode="eventTime").select(*names)


def run_daily_states(
    readings: DataFrame, name: str, keys: list[str], measures: list[str], attributes: list[str] = (), order: list[str] = (), date: str = "date",
) -> DataFrame:
    """Drains a stream of readings into stored daily states and reads the daily table; late rows join their day.

    No watermark is needed: what is kept are the states, and a micro-batch reads only the months it touches.
    """
    spark = readings.sparkSession
    out, checkpoint = shared_dir(spark, f"{name}-states"), shared_dir(spark, f"{name}-state")
    writer = readings.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, number: daily_state.add_readings(batch, number, out, keys, measures, attributes, order, date)
    )
    writer.trigger(availableNow=True).start().awaitTermination()
    example = spark.createDataFrame([], readings.schema)
    return daily_state.stored(spark, out, example, keys, measures, attributes, order)


def _writer(df: DataFrame, out: str, checkpoint: str, mode: str, keys: list[str], kind: str = "parquet"):
    writer = df.writeStream.option("checkpointLocation", checkpoint).outputMode(mode)
    if mode == "append":
        return writer.format(kind).option("path", out)
    if mode != "update" or not keys:
        raise ValueError("use append mode, or update mode with the keys of the current table")
    return writer.foreachBatch(lambda batch, number: current.upsert(batch, number, out, keys))


def run_available(df: DataFrame, name: str, mode: str = "append", keys: list[str] = ()) -> DataFrame:
    """Drain what is available into a table in the shared folder and read it back; in update mode the current table of ``keys``."""
    spark = df.sparkSession
    out, checkpoint = shared_dir(spark, f"{name}-out"), shared_dir(spark, f"{name}-state")
    _writer(df, out, checkpoint, mode, list(keys)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out) if mode == "append" else current_table(spark, out, df.schema)


def start_live(df: DataFrame, out: str, checkpoint: str, interval: str = REFRESH, mode: str = "append", kind: str = "parquet", keys: list[str] = ()):
    """Run continuously, one micro-batch per refresh interval; returns the running query.

    Append mode adds files to ``out``; update mode keeps a current table with one row per key there, see :func:`current_table`.
    """
    return _writer(df, out, checkpoint, mode, list(keys), kind).trigger(processingTime=interval).start()
