"""Streams give what the same plan gives on the table, over several files and after a restart."""

from datetime import datetime, timedelta

from lectern.streaming import readers


def events(spark, rows):
    start = datetime(2024, 1, 1)
    return spark.createDataFrame([(i, start + timedelta(minutes=m), s, e, k) for i, m, s, e, k in rows], readers.READER_EVENTS)


ROWS = [(1, 0, 1, "view", 3), (2, 5, 1, "view", 4), (3, 500, 1, "click", 7), (4, 2, 2, "scroll", 1), (5, 3, 1, "view", 9)]


def test_out_of_order_files(spark, tmp_path):
    df = events(spark, ROWS)
    df.repartitionByRange(3, "event_id").write.parquet(str(tmp_path / "in"))
    stream = readers.event_stream(spark, str(tmp_path / "in"))
    readers.run_available(readers.session_positions(stream, "1 day"), str(tmp_path / "out"), str(tmp_path / "state"), "update")
    assert [(r["session"], r["chap"]) for r in readers.positions(spark, str(tmp_path / "out")).collect()] == [(1, 4)]
    assert sorted(map(tuple, readers.stream_debounce(df, "30 minutes").collect())) == [(1, 2, 3), (1, 3, 1), (2, 4, 1)]


def test_bursts_are_put_out_once_and_their_state_dropped(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = [(k, 40 * (k // 5) + k % 5, k % 5, "view", k) for k in range(300)]
    df, seen, totals = events(spark, rows), [], []

    def go():
        progress = readers.run_available(readers.stream_debounce(readers.event_stream(spark, source, 100), "30 minutes", "10 minutes"), out, state)
        totals.append(readers.state_rows(progress)[-1])
        return readers.late_rows(progress)

    for _ in readers.in_time_order(df, source, 5):
        assert go() == 0  # each is a restart
        seen.append(spark.read.parquet(out).count())
    assert seen == sorted(seen) and 0 < seen[1] < seen[-1] and max(totals) <= 15  # sessions that are open, not bursts there were
    readers.close_stream(spark, source, "1 day", df)
    assert go() == 0
    got = spark.read.parquet(out)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, readers.stream_debounce(df, "30 minutes").collect()))
    events(spark, [(999, 3, 1, "view", 1)]).write.mode("append").parquet(source)
    assert go() == 1 and spark.read.parquet(out).count() == got.count()  # too late: dropped and counted


def test_positions_expire_and_outlive_restarts(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    day = 24 * 60
    rows = [(k, 60 * k, k // 6, "view" if k % 3 else "scroll", None if k == 7 else k) for k in range(240)] + [(500, 60 * 6, None, "view", 77)]
    df, totals, written = events(spark, rows), [], []

    def go():
        progress = readers.run_available(readers.session_positions(readers.event_stream(spark, source, 100), "1 hour", "1 day"), out, state, "update")
        totals.append(readers.state_rows(progress)[-1])
        written.append(sum(p["sink"].get("numOutputRows", 0) for p in progress))
        return readers.late_rows(progress)

    for _ in readers.in_time_order(df, source, 5):
        assert go() == 0
    assert max(totals) <= 14 and len(set(r["session"] for r in df.collect())) == 41  # of one day and a slice, not of all days
    got = readers.positions(spark, out)
    assert sorted(map(str, got.collect())) == sorted(map(str, readers.latest_position(df).collect()))
    rewritten = spark.read.parquet(out)
    assert rewritten.count() < 2 * 41  # a batch writes the sessions that moved in it, not all
    readers.close_stream(spark, source, "9 days", df)
    assert go() == 0 and totals[-1] == 0
    events(spark, [(700, 30 * day, 3, "view", 55), (701, 10, 3, "view", 1)]).write.mode("append").parquet(source)
    assert go() == 1  # the second is behind the watermark
    assert readers.positions(spark, out).where("session = 3").first()["chap"] == 55


def test_a_replay_of_no_events(spark, tmp_path):
    df = events(spark, [])
    for _ in readers.in_time_order(df, str(tmp_path / "in"), 3):
        progress = readers.run_available(readers.stream_debounce(readers.event_stream(spark, str(tmp_path / "in")), late="1 hour"), str(tmp_path / "out"), str(tmp_path / "state"))
    readers.close_stream(spark, str(tmp_path / "in"), "1 day", df)
    assert readers.late_rows(progress) == 0


def test_restart_from_checkpoint(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    subscribers = spark.createDataFrame([("view", "a"), ("view", "b"), ("click", "c")], "event string, subscriber string")

    def go():
        routed = readers.stream_route(readers.event_stream(spark, source), subscribers)
        routed.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
        return spark.read.parquet(out).count()

    events(spark, ROWS[:2]).write.mode("append").parquet(source)
    assert go() == 4
    events(spark, ROWS[2:]).write.mode("append").parquet(source)
    assert go() == 7
    assert go() == 7


def test_unrouted_and_definitions(spark):
    df = events(spark, ROWS)
    subscribers = spark.createDataFrame([("view", "a")], "event string, subscriber string")
    assert {r["event_id"] for r in readers.stream_unrouted(df, subscribers).collect()} == {3, 4}
    x = spark.createDataFrame([(1, "00007", 7, "o", "f", "t"), (0, "00007", 7, "g", "f", "t")], "dic_type int, sn string, num int, orig string, orig_alt string, txt string")
    assert [tuple(r) for r in readers.stream_click_definition(df, x).collect()] == [(3, 7, "00007", "o")]


def test_a_batch_reads_the_chapters_it_asks_for(spark, tmp_path):
    from lectern.sources import store

    rows = [("v", b, c, s, f"{b} {c} {s}", c % store.CHAPTER_BUCKETS) for b in ("Gen", "Exo") for c in range(200) for s in (1, 2)]
    table = store.by_chapter(spark, str(tmp_path / "t"))
    table.refresh(lambda: spark.createDataFrame(rows, "version string, engs string, chap int, sec int, txt string, bucket int"), "one")
    df, verses = events(spark, [*ROWS, (6, 9, 3, "view", None), (7, 9, 3, "view", 999)]), table.read()
    want = readers.stream_chapter_join(df, verses)
    got = readers.chapters_of_batch(df, verses)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 12
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        plan = store.asked_chapters(verses, spark.createDataFrame([(3,), (67,), (None,)], "chap int"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0] and "In(chap" in plan
    assert store.asked_chapters(verses, spark.createDataFrame([(3,)], "chap int")).select("chap", "bucket").distinct().collect() == [(3, 3)]
    many = spark.createDataFrame([(c,) for c in range(2000)], "chap int")
    assert store.asked_chapters(verses, many).count() == 800
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df.repartitionByRange(3, "event_id").write.parquet(source)
    readers.run_available(readers.event_stream(spark, source), out, str(tmp_path / "state"), each=lambda batch: readers.chapters_of_batch(batch, verses))
    assert sorted(map(tuple, spark.read.parquet(out).drop("batch").collect())) == sorted(map(tuple, want.collect()))
