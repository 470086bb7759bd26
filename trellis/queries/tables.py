"""The test tables as a virtual graph, and as flakes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ir import TYPE, XSD
from ..plans.compile import Dataset
from ..sources.flakes import SCHEMA, FlakeGraph
from ..sources.virtual import Ref, TriplesMap, VirtualGraph

V = "http://tables/voc/"
D = "http://tables/data/"
PREFIXES = {"v": V, "d": D, "xsd": XSD, "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#"}

# table: subject template, class, references by column
TABLES = {
    "region": ("region/{r_regionkey}", "Region", {}),
    "nation": ("nation/{n_nationkey}", "Nation", {"n_regionkey": ("n_region", "region/{n_regionkey}")}),
    "customer": ("customer/{c_custkey}", "Customer", {"c_nationkey": ("c_nation", "nation/{c_nationkey}")}),
    "supplier": ("supplier/{s_suppkey}", "Supplier", {"s_nationkey": ("s_nation", "nation/{s_nationkey}")}),
    "part": ("part/{p_partkey}", "Part", {}),
    "orders": ("order/{o_orderkey}", "Order", {"o_custkey": ("o_customer", "customer/{o_custkey}")}),
    "lineitem": (None, "Lineitem", {"l_orderkey": ("l_order", "order/{l_orderkey}"), "l_partkey": ("l_part", "part/{l_partkey}"), "l_suppkey": ("l_supplier", "supplier/{l_suppkey}")}),
    "events": ("event/{event_id}", "Event", {}),
    "documents": ("document/{doc_id}", "Document", {}),
}


def graph(spark: SparkSession, sf_dir: str, tables: list[str] | None = None) -> Dataset:
    maps = []
    for name in tables or TABLES:
        subject, cls, refs = TABLES[name]
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        predicates: dict = {V + c: c for c in df.columns}
        predicates |= {V + p: Ref(D + t) for p, t in refs.values()}
        maps.append(TriplesMap(df, D + subject if subject else None, V + cls, predicates))
    return Dataset(VirtualGraph(maps))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flakes of a reply graph: turn n of a conversation leads to turn n + 1; every third
    turn also back to the first, so that there are cycles."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    node = lambda conv, turn: F.concat(F.lit(D + "turn/"), conv.cast("string"), F.lit("-"), turn.cast("string"))
    here = node(F.col("conv_id"), F.col("turn"))
    rows = F.array(
        F.struct(F.lit(V + "role").alias("p"), F.col("role").alias("o"), F.lit(XSD + "string").alias("dt")),
        F.struct(F.lit(TYPE).alias("p"), F.lit(V + "Turn").alias("o"), F.lit("@id").alias("dt")),
        F.struct(F.lit(V + "number").alias("p"), F.col("turn").cast("string").alias("o"), F.lit(XSD + "integer").alias("dt")),
        F.when(F.col("turn") > 0, F.struct(F.lit(V + "prev").alias("p"), node(F.col("conv_id"), F.col("turn") - 1).alias("o"), F.lit("@id").alias("dt"))),
        F.when((F.col("turn") % 3 == 0) & (F.col("turn") > 0), F.struct(F.lit(V + "back").alias("p"), node(F.col("conv_id"), F.lit(0)).alias("o"), F.lit("@id").alias("dt"))),
    )
    rows = c.select(here.alias("s"), F.explode(rows).alias("x")).where("x is not null").select("s", "x.*")
    nexts = rows.where(F.col("p") == V + "prev").select(F.col("o").alias("s"), F.lit(V + "next").alias("p"), F.col("s").alias("o"), "dt")
    rows = rows.unionByName(nexts)
    return rows.selectExpr("cast(null as string) g", "s", "p", "o", "dt", "cast(null as string) lang", "cast(null as int) i", "1L t", "true op")


def replies(spark: SparkSession, sf_dir: str) -> Dataset:
    return Dataset(FlakeGraph(conversations(spark, sf_dir)))


def event_flakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flakes of events read as upserts: a user's value of an event's type, at t = event_id.
    Each asserts its value and retracts the one before."""
    from pyspark.sql import Window

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    w = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    e = e.select(F.concat(F.lit(D + "user/"), F.col("user_id").cast("string")).alias("s"), F.concat(F.lit(V), "event_type").alias("p"), F.col("value").cast("string").alias("o"), F.col("event_id").alias("t"), F.lag(F.col("value").cast("string")).over(w).alias("old"))
    same = F.col("o").eqNullSafe(F.col("old"))
    flakes = F.array(F.struct(F.col("o").alias("v"), F.lit(True).alias("op")), F.when(F.col("old").isNotNull() & ~same, F.struct(F.col("old").alias("v"), F.lit(False).alias("op"))))
    rows = e.select("s", "p", "t", F.explode(flakes).alias("x")).where("x is not null")
    return rows.selectExpr("cast(null as string) g", "s", "p", "x.v o", f"'{XSD}double' dt", "cast(null as string) lang", "cast(null as int) i", "t", "x.op op")


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
