"""Streams: flakes appended to a log, kept views of them, and event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.flakes import FACT, SCHEMA


def log(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """The stream of flakes that are appended under a path as Parquet."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def keep_postings(flakes: DataFrame, predicate: str, out: str, checkpoint: str, language: str = "en") -> StreamingQuery:
    """Appends the postings (term, id, tf, length, t, op) of a predicate's texts to a table as
    they arrive; what is there is taken once, then the query stops. Each batch has its own
    folder, so a batch that is run again replaces itself."""
    from ..operators.search import terms

    def batch(df: DataFrame, n: int) -> None:
        t = df.where(F.col("p") == predicate).select(F.col("s").alias("id"), "t", "op", terms(F.col("o"), language).alias("terms"))
        t = t.withColumn("length", F.size("terms")).select("id", "t", "op", "length", F.explode("terms").alias("term"))
        t.groupBy("id", "t", "op", "length", "term").agg(F.count("*").alias("tf")).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return flakes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def materialise(source: DataFrame, key: str, predicates: dict[str, str], template: str, out: str, checkpoint: str, gone: str | None = None) -> StreamingQuery:
    """Appends a table's new and changed rows as flakes: predicates by column, subjects by
    template. What a row no longer says is retracted; a row whose column `gone` is true is
    retracted whole. Of rows of one key in a batch, one that isn't gone counts if there is
    one. The checkpoint is the watermark of what was taken, and a batch that is run again
    replaces itself."""
    head, _, rest = template.partition("{")

    def batch(df: DataFrame, n: int) -> None:
        kinds = dict(df.dtypes)
        from ..plans.frame import xsd_of
        from ..sources.flakes import current

        spark = df.sparkSession
        cells = [F.struct(F.lit(p).alias("p"), F.col(c).cast("string").alias("o"), F.lit(xsd_of(kinds[c])).alias("dt")) for c, p in predicates.items()]
        away = F.coalesce(F.col(gone).cast("boolean"), F.lit(False)) if gone else F.lit(False)
        rows = df.select(F.concat(F.lit(head), F.col(key).cast("string"), F.lit(rest.partition("}")[2])).alias("s"), F.struct(away.alias("away"), F.array(*cells).alias("cells")).alias("row"))
        rows = rows.groupBy("s").agg(F.min("row").alias("row")).select("s", "row.away", "row.cells")
        new = rows.where("not away").select("s", F.explode("cells").alias("x")).where("x.o is not null").selectExpr("cast(null as string) g", "s", "x.p p", "x.o o", "x.dt dt", "cast(null as string) lang", "cast(null as int) i")
        past = spark.read.schema(SCHEMA + ", batch long").parquet(out).where(F.col("batch") < n).drop("batch") if n else spark.createDataFrame([], SCHEMA)
        old = current(past).join(rows.select("s"), "s", "left_semi").select(*FACT)
        both = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in FACT]
        made = [x.alias("x").join(y.alias("y"), both, "left_anti").withColumn("t", F.lit(n + 1).cast("long")).withColumn("op", F.lit(op)) for x, y, op in ((new, old, True), (old, new, False))]
        made[0].union(made[1]).select(*FACT, "t", "op").write.mode("overwrite").parquet(f"{out}/batch={n}")

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, width: str, late: str | None = None, slide: str | None = None) -> DataFrame:
    """Counts and sums of values by event type in windows of event time; an extension. With
    `late`, a watermark: on a stream, later events are left out."""
    if late:
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Sessions of users: events no further apart than the gap; an extension."""
    if late:
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")


def as_stream(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table's one file as a stream."""
    kind = spark.read.parquet(f"{path}/{table}.parquet").schema
    return spark.readStream.schema(kind).option("pathGlobFilter", f"{table}.parquet").parquet(path)
