import json

from pyspark.sql import functions as F

from quarrymill.operators.itemsets import itemset_report
from quarrymill.operators.baskets import baskets, filter_join
from quarrymill.operators.itemsets import frequent_itemsets
from quarrymill.operators.sketches import reservoir
from quarrymill.plans.storage import materialize
from quarrymill.sources import readers, sinks
from quarrymill.sources.tables import counted_reviews, counted_tags
from quarrymill.streaming import windows as win
from tests.conftest import rows


def test_csv_with_headers_inside_and_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('user_id,business_id\nu,"b,1"\nuser_id,business_id\nv,b2\n')
    assert rows(readers.read_csv(spark, str(tmp_path), readers.PAIRS)) == [("u", "b,1"), ("v", "b2")]


def test_json_with_missing_fields_and_words(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"state": "NV", "business_id": "b"}\n{"business_id": "c"}\n')
    df = readers.read_json(spark, str(tmp_path / "a.json"), readers.BUSINESS)
    assert [(r["business_id"], r["state"]) for r in df.orderBy("business_id").collect()] == [("b", "NV"), ("c", None)]
    (tmp_path / "w.txt").write_text("a the\n  and a\n\n")
    assert rows(readers.read_words(spark, str(tmp_path / "w.txt"))) == [("a",), ("and",), ("the",)]
    assert readers.read_text(spark, str(tmp_path / "w.txt")).count() == 3


def test_points_keep_the_last_digit_and_the_file_order(spark, tmp_path):
    (tmp_path / "2.txt").write_text("7,1.5,2.25")
    (tmp_path / "1.txt").write_text("3,0.5,-1\n4,1,1\n")
    assert rows(readers.read_points(spark, str(tmp_path))) == [(3, [0.5, -1.0], 1), (4, [1.0, 1.0], 1), (7, [1.5, 2.25], 2)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", 1)], "k string, v long")
    sinks.write_csv(df, str(tmp_path / "c"))
    sinks.write_csv(df, str(tmp_path / "c"), append=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 4
    sinks.write_json(df, str(tmp_path / "j"))
    assert rows(spark.read.schema("k string, v long").json(str(tmp_path / "j"))) == [("a", 1), ("b", 2)]
    sinks.write_object(spark.createDataFrame([(10, 1), (9, 2)], "k long, v long"), "k", "v", str(tmp_path / "o"))
    assert list(json.loads(spark.read.text(str(tmp_path / "o")).first()[0]).items()) == [("9", 2), ("10", 1)]
    sinks.write_object(spark.createDataFrame([(10, 1), (9, 2)], "k long, v long"), "k", "v", str(tmp_path / "ol"), lines=True)
    assert [r[0] for r in spark.read.text(str(tmp_path / "ol")).collect()] in (['{"9":2}', '{"10":1}'], ['{"10":1}', '{"9":2}'])
    sinks.write_lines(spark.createDataFrame([("x", "y", 1.5)], "a string, b string, q double"), sinks.pair_line("a", "b", "q"), str(tmp_path / "l"))
    assert spark.read.text(str(tmp_path / "l")).first()[0] == "('x', 'y'), 1.5"
    sinks.write_lines(spark.createDataFrame([(["x", "y"],)], "m array<string>"), sinks.members_line("m"), str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m")).first()[0] == "'x', 'y'"
    sinks.write_profile(df, df, str(tmp_path / "p"))
    assert [d.count() for d in readers.read_profile(spark, str(tmp_path / "p"))] == [2, 2]


def test_itemset_file(spark, tmp_path):
    held = baskets(spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b")], "b long, i string"), "b", "i")
    report = itemset_report(frequent_itemsets(held, 2))
    sinks.write_itemsets(report, report, str(tmp_path / "r"))
    part = next((tmp_path / "r").glob("part-*")).read_text()
    assert part == "Candidates:\n('a'),('b')\n\n('a', 'b')\n\nFrequent Itemsets:\n('a'),('b')\n\n('a', 'b')\n\n"


def test_filter_join_keeps_repeats(spark):
    business = spark.createDataFrame([("b", "NV"), ("c", "AZ")], "business_id string, state string")
    review = spark.createDataFrame([("b", "u"), ("b", "u"), ("c", "u"), ("d", "u")], "business_id string, user_id string")
    assert rows(filter_join(business, review, "business_id", F.col("state") == "NV")) == [("b", "u"), ("b", "u")]


def test_counted_reviews_and_tags(spark):
    r = spark.createDataFrame([(1, " u ", "b", 1), (1, "u2", "b", 2), (2, " ", None, None), (None, "u", "b", 3)], "review_id long, user_id string, business_id string, ingested_at long")
    assert [tuple(x) for x in counted_reviews(r, "user_id", "business_id").orderBy("review_id").collect()] == [(1, "u2", "b"), (2, None, None)]
    schema = "tweet_id long, batch_no int, entities struct<hashtags: array<struct<text: string>>>"
    tag = lambda *t: {"hashtags": [None if x == "null" else {"text": x} for x in t]}
    data = [(1, 2, tag("#A ", "a", None, "null", " # ")), (1, 1, tag("#A ", "a", None, "null", " # ")), (2, 1, None), (3, 1, {"hashtags": None}), (4, None, tag("ß"))]
    got = counted_tags(spark.createDataFrame(data, schema)).select("tweet_id", "batch_no", "pos", "tag").orderBy("tweet_id", "pos").collect()
    assert [tuple(x) for x in got] == [(1, 1, 0, "a"), (1, 1, 1, "a"), (4, 2**31 - 1, 0, "ß")]


def events(spark, folder, parts):
    for k, data in enumerate(parts):
        spark.createDataFrame(data, "ts string, city string").select(F.col("ts").cast("timestamp").alias("ts"), "city").coalesce(1).write.mode("append").json(str(folder / "in"))
    return readers.stream_folder(spark, str(folder / "in"), "ts timestamp, city string", glob="*.json", files=1)


DAYS = [[("2024-01-01 01:00:00", "a"), ("2024-01-01 02:00:00", "b"), ("2024-01-01 03:00:00", None)], [("2024-01-02 01:00:00", "a"), ("2024-01-09 00:00:00", "c")]]


def test_stream_windows_equal_batch_on_closed_windows(spark, tmp_path):
    stream = events(spark, tmp_path, DAYS)
    got = rows(win.run_to_end(win.stream_distinct_windows(stream, "ts", "city", "2 days", "1 day", "1 day")))
    batch = spark.read.schema("ts timestamp, city string").json(str(tmp_path / "in"))
    truth = win.distinct_windows(batch, "ts", "city", "2 days", "1 day").where("window_start + interval 2 days <= timestamp'2024-01-08'")
    assert got == rows(truth) and [n for _, n in got] == [2, 2, 1]


def test_fm_stream_and_appending_sink(spark, tmp_path):
    stream = events(spark, tmp_path, DAYS)
    query = win.fm_stream(stream, sinks.appending(str(tmp_path / "out")), "ts", "city", "2 days", "1 day", "1 day", str(tmp_path / "state"), 6, 2).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.option("header", True).csv(str(tmp_path / "out" / "batch=*"))
    assert sorted(int(r["distinct_values"]) for r in got.collect()) == [1, 2, 2]


def test_stream_sample_equals_one_over_everything(spark, tmp_path):
    df = spark.createDataFrame([(k, f"t{k % 4}") for k in range(90)], "id long, tag string")
    sample = win.StreamSample(spark, ["id"], 15, "s", str(tmp_path / "sample"))
    assert sample.sample is None
    for k in (0, 1, 1):  # a batch comes twice
        sample.add(df.where(f"id % 3 = {k}"), k)
    again = win.StreamSample(spark, ["id"], 15, "s", str(tmp_path / "sample"))  # after a restart
    again.add(df.where("id % 3 = 2"), 2)
    assert rows(again.sample) == rows(sample.sample) == rows(reservoir(df, ["id"], 15, "s"))
    assert all(r["count"] for r in again.trending("tag").collect())
    assert len([p for p in (tmp_path / "sample").iterdir()]) == 2


def test_stream_sample_drops_repeats_of_its_first_batch(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "id long, tag string")
    sample = win.StreamSample(spark, ["id"], 5, "s")
    sample.add(df, 0)
    assert rows(sample.sample) == [(1, "x"), (2, "y")]


def test_stream_sample_goes_on_after_a_restart_of_the_query(spark, tmp_path):
    for k in range(3):
        spark.range(k * 30, k * 30 + 30).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second query finds the checkpoint and the sample of the first
        sample = win.StreamSample(spark, ["id"], 10, "s", str(tmp_path / "sample"))
        stream = readers.stream_folder(spark, str(tmp_path / "in"), "id long", "parquet", files=1)
        query = stream.writeStream.foreachBatch(sample.add).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        spark.range(90, 120).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert rows(sample.sample) == rows(reservoir(spark.range(120), ["id"], 10, "s"))


def test_batches_by_the_clock_and_session_windows(spark, tmp_path):
    import time

    stream = events(spark, tmp_path, DAYS)
    query = win.fm_stream(stream, sinks.appending(str(tmp_path / "out")), "ts", "city", "2 days", "2 days", "1 day", str(tmp_path / "state"), 6, 2, every="1 second").start()
    until = time.time() + 60
    while time.time() < until and not list((tmp_path / "out").glob("batch=*/*.csv")):
        query.processAllAvailable()
    query.stop()
    assert query.exception() is None
    got = spark.read.option("header", True).csv(str(tmp_path / "out" / "batch=*")).collect()
    assert got and all(r["time"][:2] == "20" and int(r["distinct_values"]) for r in got)
    batch = spark.read.schema("ts timestamp, city string").json(str(tmp_path / "in"))
    assert [r["distinct_values"] for r in win.session_windows(batch, "ts", "city", "2 hours").orderBy("session_start").collect()] == [2, 1, 1]


def test_tagged_messages_filter_at_the_source(spark, tmp_path):
    from quarrymill.sources import tag_stream

    tag = lambda t: {"hashtags": [{"text": t}, None]}
    first = [{"tweet_id": 1, "lang": "en", "text": "in America", "entities": tag("a")}, {"tweet_id": 2, "lang": "fr", "text": "america", "entities": None}, {"tweet_id": 3, "lang": "en"}, [1]]
    (tmp_path / "1.json").write_text("\n".join(map(json.dumps, first)) + "\nno json\n")
    (tmp_path / "2.json").write_text(json.dumps({"tweet_id": 4, "lang": "EN", "text": "AMERICA!", "entities": {"hashtags": None}}))
    tag_stream.register(spark)
    given = {"path": str(tmp_path), "track": "america, other", "languages": "en"}
    batch = spark.read.format("tagged_messages").options(**given).load()
    assert [(r["tweet_id"], r["entities"]["hashtags"]) for r in batch.orderBy("tweet_id").collect()] == [(1, [("a",), None]), (4, None)]
    assert spark.read.format("tagged_messages").option("path", str(tmp_path)).load().count() == 4
    stream = spark.readStream.format("tagged_messages").options(**given).load().select("tweet_id")
    assert rows(win.run_to_end(stream)) == [(1,), (4,)]


def test_socket_lines_reach_a_stream(spark, tmp_path):
    import socket
    import threading

    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        link, _ = server.accept()
        link.sendall(b'{"city": "x"}\n{"city": "y"}\n')
        done.wait(60)
        link.close()

    done = threading.Event()
    threading.Thread(target=serve, daemon=True).start()
    stream = readers.stream_socket(spark, "127.0.0.1", server.getsockname()[1], "city string")
    seen = []
    query = stream.writeStream.foreachBatch(lambda df, k: seen.extend(r["city"] for r in df.collect())).option("checkpointLocation", str(tmp_path)).start()
    for _ in range(100):
        query.processAllAvailable()
        if len(seen) == 2:
            break
    done.set()
    query.stop()
    assert sorted(seen) == ["x", "y"]


def test_tracked_words_and_languages(spark):
    df = spark.createDataFrame([("America now", "en"), ("america", "fr"), ("other", "en"), (None, "en")], "text string, lang string")
    assert rows(win.tracked(df, "text", "lang", ["america"], ["en"])) == [("America now", "en")]


def test_materialize_an_empty_table(spark):
    df = materialize(spark.createDataFrame([], "a long, b string"), "none")
    assert df.columns == ["a", "b"] and df.count() == 0
