"""Streams run to the end of what is there, again and again."""

from trellis.ir import XSD, Lit
from trellis.sources import flakes as fl
from trellis.streaming import feeds

EX = "http://ex/"


def test_postings_follow_the_log(spark, tmp_path):
    log, out, mark = (str(tmp_path / x) for x in ("log", "out", "mark"))
    fl.facts(spark, [(EX + "a", EX + "text", Lit("red fox", XSD + "string"))]).write.parquet(log)
    feeds.keep_postings(feeds.log(spark, log), EX + "text", out, mark).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    fl.facts(spark, [(EX + "b", EX + "text", Lit("red red wine", XSD + "string"))], t=2).write.mode("append").parquet(log)
    feeds.keep_postings(feeds.log(spark, log), EX + "text", out, mark).awaitTermination()
    assert {(r.id, r.term): r.tf for r in spark.read.parquet(out).collect()} == {(EX + "a", "red"): 1, (EX + "a", "fox"): 1, (EX + "b", "red"): 2, (EX + "b", "wine"): 1}


def test_kept_postings_answer_queries(spark, tmp_path):
    from trellis.operators.search import TextIndex

    log, out, mark = (str(tmp_path / x) for x in ("log", "out", "mark"))
    first = fl.facts(spark, [(EX + "a", EX + "text", Lit("red fox", XSD + "string")), (EX + "b", EX + "text", Lit("red red wine", XSD + "string"))])
    gone = fl.delete(first, fl.facts(spark, [(EX + "a", EX + "text", Lit("red fox", XSD + "string"))]), 2)
    for k, x in enumerate((first, gone)):
        x.select(first.columns).write.mode("append").parquet(log)
        feeds.keep_postings(feeds.log(spark, log), EX + "text", out, mark).awaitTermination()
        got = [r.id for r in TextIndex.of_postings(spark.read.parquet(out)).top("red").collect()]
        assert got == ([EX + "b", EX + "a"] if k == 0 else [EX + "b"])


def test_materialise_retracts(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("source", "out", "mark"))
    kind = "k long, name string, size long, away boolean"

    def step(*rows):
        spark.createDataFrame(list(rows), kind).coalesce(1).write.mode("append").parquet(source)
        feeds.materialise(spark.readStream.schema(kind).parquet(source), "k", {"name": EX + "name", "size": EX + "size"}, EX + "x/{k}", out, mark, "away").awaitTermination()
        return {(r.s[-1], r.p[-4:], r.o) for r in fl.current(spark.read.parquet(out)).collect()}

    assert step((1, "a", 5, False), (2, "b", 6, False)) == {("1", "name", "a"), ("1", "size", "5"), ("2", "name", "b"), ("2", "size", "6")}
    assert step((1, "a", 7, False)) == {("1", "name", "a"), ("1", "size", "7"), ("2", "name", "b"), ("2", "size", "6")}
    assert step((1, "a", None, False), (2, "b", 6, True)) == {("1", "name", "a")}


def test_materialise_and_windows(spark, sf, tmp_path):
    s = feeds.as_stream(spark, sf, "nation")
    feeds.materialise(s, "n_nationkey", {"n_name": EX + "name"}, EX + "nation/{n_nationkey}", str(tmp_path / "f"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "f")).count() == 25
    q = feeds.tumbling(feeds.as_stream(spark, sf, "events"), "1 day", late="1 hour").writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = feeds.tumbling(spark.read.parquet(f"{sf}/events.parquet"), "1 day")
    got, want = ({(str(r.start), r.event_type): r.n for r in df.collect()} for df in (spark.table("w"), batch))
    assert got and all(want[k] == n for k, n in got.items())
