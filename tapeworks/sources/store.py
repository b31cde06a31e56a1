"""Reading and writing: candle store, CSV, fixed-schema Parquet, JDBC, Kafka,
dead letters, keyed documents, reports, sample candles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeworks.functions import messages
from tapeworks.functions.draws import uniform

CANDLE = (
    "open_time timestamp_ntz, symbol bigint, exchange string, timeframe string, open double, high double, low double, close double, "
    "volume double, quote_volume double, trades bigint, taker_buy_volume double, taker_buy_quote double"
)
TICK = "ts timestamp_ntz, symbol bigint, exchange string, price double, quantity double, side string, trade_id string"


class CandleStore:
    """Candles in Parquet, laid out by exchange and timeframe.

    Symbols are not directories (a market has too many): rows are clustered by
    symbol inside a partition, so Parquet statistics prune them.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, candles: DataFrame, mode: str = "append", codec: str = "zstd", max_rows: int = 5_000_000) -> None:
        (
            candles.repartitionByRange("exchange", "timeframe", "symbol", "open_time")
            .sortWithinPartitions("exchange", "timeframe", "symbol", "open_time")
            .write.mode(mode).option("compression", codec).option("maxRecordsPerFile", max_rows)
            .partitionBy("exchange", "timeframe").parquet(self.path)
        )

    def read(self, exchange=None, timeframe=None, symbol=None, columns=None, start=None, end=None) -> DataFrame:
        df = self.spark.read.schema(CANDLE).parquet(self.path)
        for name, want in (("exchange", exchange), ("timeframe", timeframe), ("symbol", symbol)):
            if want is not None:
                df = df.where(F.col(name) == want)
        if start is not None:
            df = df.where(F.col("open_time") >= F.lit(start).cast("timestamp_ntz"))
        if end is not None:
            df = df.where(F.col("open_time") <= F.lit(end).cast("timestamp_ntz"))
        return df.select(*columns) if columns else df

    def symbols(self, exchange: str) -> DataFrame:
        return self.read(exchange=exchange, columns=["symbol"]).distinct()

    def exists(self, exchange: str, timeframe: str, symbol) -> bool:
        return not self.read(exchange, timeframe, symbol, ["symbol"]).isEmpty()

    def drop_older(self, timeframe: str, cutoff) -> DataFrame:
        """Retention as a filter; the caller rewrites the partition with it."""
        return self.read().where(~((F.col("timeframe") == timeframe) & (F.col("open_time") < F.lit(cutoff).cast("timestamp_ntz"))))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def write_fixed(df: DataFrame, schema: str, path: str, codec: str = "snappy", max_rows: int = 5_000_000) -> None:
    """Parquet with an enforced schema and file rotation by row count."""
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(schema).fields
    missing = [f.name for f in fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"columns missing for the fixed schema: {missing}")
    if codec not in ("none", "snappy", "zstd"):
        raise ValueError(f"codec {codec}")
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) for f in fields]
    df.select(*cols).write.mode("overwrite").option("compression", codec).option("maxRecordsPerFile", max_rows).parquet(path)


def read_topic(spark: SparkSession, servers: str, topic: str, per_trigger: int = 1_000_000, start: str = "latest") -> DataFrame:
    """Kafka topic as a typed stream (needs the Kafka package on the cluster)."""
    raw = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
        .option("startingOffsets", start).option("maxOffsetsPerTrigger", per_trigger).load()
    )
    return messages.parse(topic, raw.select(F.col("key").cast("string"), "value", F.col("timestamp").alias("kafka_ts")))


def keyed_json(df: DataFrame, topic: str) -> DataFrame:
    """Rows to (key, value): market data is keyed ``exchange:symbol``, other
    topics ``symbol:<first field>``."""
    key = F.concat_ws(":", "exchange", "symbol") if topic == "market-data" else F.concat_ws(":", "symbol", df.columns[0])
    return df.select(key.alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def split_valid(df: DataFrame, topic: str, json: str = "value") -> tuple[DataFrame, DataFrame]:
    """Valid messages, and dead letters with reason and original topic."""
    marked = df.withColumn("reason", messages.invalid_reason(topic, F.col(json)))
    good = marked.where("reason is null").drop("reason")
    dead = marked.where("reason is not null").select(F.lit(topic).alias("original_topic"), F.col(json).alias("message"), "reason")
    return good, dead


def dead_letter_batch(topic: str, good_path: str, dead_path: str):
    """``foreachBatch`` function writing both sides of a stream.  An epoch has its
    own folder, so one that is tried again replaces what it wrote."""

    def write(batch: DataFrame, epoch: int) -> None:
        good, dead = split_valid(batch, topic)
        good.write.mode("overwrite").parquet(f"{good_path}/epoch={epoch}")
        dead.write.mode("overwrite").parquet(f"{dead_path}/epoch={epoch}")

    return write


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Missing or null columns get the table defaults before an insert."""
    cols = {k: F.coalesce(F.col(k), F.lit(v)) if k in df.columns else F.lit(v) for k, v in defaults.items()}
    return df.withColumns(cols)


def insert_jdbc(df: DataFrame, url: str, table: str, props: dict, batch: int = 10_000) -> None:
    df.write.option("batchsize", batch).jdbc(url, table, mode="append", properties=props)


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Latest row per key of both tables (one grouped max, no window)."""
    both = current.unionByName(changes, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys]
    pick = F.max_by(F.struct(*rest), F.struct(version, F.to_json(F.struct(*rest)))).alias("_r")
    return both.groupBy(*keys).agg(pick).select(*keys, "_r.*")


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def sample_candles(symbols: DataFrame, bars: int = 500, vol: float = 0.01, seed: str = "42") -> DataFrame:
    """Seeded random-walk candles for every (symbol, start) row."""
    n = symbols.select("symbol", "start", F.explode(F.sequence(F.lit(1), F.lit(bars))).alias("i"))
    gauss = F.sqrt(-2 * F.log(uniform("symbol", "i", seed=seed + "a"))) * F.cos(6.283185307179586 * uniform("symbol", "i", seed=seed + "b"))
    by = Window.partitionBy("symbol").orderBy("i")
    walk = n.withColumn("close", F.round(F.col("start") * F.exp(F.sum(gauss * vol).over(by.rowsBetween(Window.unboundedPreceding, 0))), 2))
    o = F.coalesce(F.lag("close").over(by), F.col("start"))
    wick = uniform("symbol", "i", seed=seed + "c") * vol
    return walk.withColumn("open", o).select(
        "symbol", "i", "open", (F.greatest("open", "close") * (1 + wick)).alias("high"), (F.least("open", "close") * (1 - wick)).alias("low"), "close",
        F.round(1e6 + 9.9e7 * uniform("symbol", "i", seed=seed + "d"), 2).alias("volume"),
    )
