"""The gate on typed state: batches, restarts, rows that come early, late or never."""

import datetime
import json
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from provenant.streaming import gate as G
from provenant.streaming import events, sessions

SCHEMA = "session long, seq long, delta string, is_last boolean, texts array<string>, at timestamp"
SOURCE = "Article one says that all taxes are due in spring, and that late payers owe a fine of ten percent."
ANSWER = 'Coverage: Full\n\nIt says "all taxes are due in spring" and "late payers owe nothing at all", but also "taxes are due in the winter" too.'


def at(minute):
    return datetime.datetime(2024, 1, 1, 0, 0) + datetime.timedelta(minutes=minute)


def session_rows(session, minute=0, end=True, text=ANSWER, cut=7):
    deltas = [text[i : i + cut] for i in range(0, len(text), cut)]
    return [(session, i, d, end and i == len(deltas) - 1, [SOURCE] if i == 0 else None, at(minute)) for i, d in enumerate(deltas)]


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp_path, **options):
    return sessions.run_gate_over_files(spark, str(tmp_path / "in"), SCHEMA, files_at_once=1, out=str(tmp_path / "out"), checkpoint=str(tmp_path / "cp"), letters=None, **options)


def shown(events, session):
    mine = sorted((r for r in events if r.session == session), key=lambda r: (r.seq, r.n))
    return "".join(r.payload for r in mine if r.type == "delta"), [json.loads(r.payload) for r in mine if r.type == "done"], [r.seq for r in mine if r.type == "late"]


def whole(text=ANSWER):
    gate = G.Gate([SOURCE], letters=None)
    return gate.feed(text) + gate.flush(), gate


def test_sessions_in_any_order_and_cut_by_restarts(spark, tmp_path):
    folder = str(tmp_path / "in")
    r = random.Random(3)
    rows = [x for s in range(6) for x in session_rows(s, cut=r.randint(3, 30))]
    first = [x for x in rows if x[1] == 0]
    rest = [x for x in rows if x[1] > 0]
    r.shuffle(rest)
    put(spark, folder, first)
    for i in range(3):  # each start goes on from the checkpoint
        put(spark, folder, rest[i::3])
        found = run(spark, tmp_path, delay="365 days").collect()
    want, gate = whole()
    for s in range(6):
        text, done, late = shown(found, s)
        assert text == want and late == []
        assert done == [{"coverage": "full", "accepted": gate.accepted, "rejected": gate.rejected}]
    assert (gate.accepted, gate.rejected) == (1, 2)
    assert len(run(spark, tmp_path, delay="365 days").collect()) == len(found)  # nothing new, nothing again


def test_rows_after_the_end_are_told_and_open_nothing(spark, tmp_path):
    folder = str(tmp_path / "in")
    put(spark, folder, session_rows(1))
    run(spark, tmp_path, delay="365 days")
    put(spark, folder, [(1, 99, "more", False, None, at(1)), (1, 0, "again", False, [SOURCE], at(1)), (2, 0, "new ", False, None, at(1)), (2, 1, None, True, None, at(1)), (2, 5, "beyond", False, None, at(1))])
    found = run(spark, tmp_path, delay="365 days").collect()
    assert shown(found, 1)[2] == [0, 99] and len(shown(found, 1)[1]) == 1 and shown(found, 1)[0] == whole()[0]
    assert shown(found, 2) == ("new ", [{"coverage": None, "accepted": 0, "rejected": 0}], [5])


def test_sessions_that_go_quiet_expire_once(spark, tmp_path):
    folder = str(tmp_path / "in")
    put(spark, folder, [*session_rows(1, 0, end=False), (1, 500, "early", False, None, at(0)), *session_rows(2, 0)])
    for minute in (30, 60, 90):  # others' rows move the watermark on
        put(spark, folder, [(50 + minute, 0, "x", True, None, at(minute))])
    found = run(spark, tmp_path, delay="1 minute", quiet_ms=600_000).collect()
    text, done, _ = shown(found, 1)
    assert text == whole()[0] and len(done) == 1
    expired = [(r.session, json.loads(r.payload)) for r in found if r.type == "expired"]
    assert expired == [(1, {"waiting": 1})]
    assert len(shown(found, 2)[1]) == 1 and all(len(shown(found, 50 + m)[1]) == 1 for m in (30, 60, 90))


# --- events and frames

STATE = "session long, seq long, piece binary"


def answers(spark):
    rows = spark.createDataFrame([(1, "[7]", '{"ok":1}', None), (2, None, None, "no search"), (3, "[]", None, "broke off")], "session long, chunks string, result string, error string")
    said = spark.createDataFrame([(1, 0, "Հոդված «254»\n"), (1, 1, 'a "b"\r\n\r\nc'), (1, 2, "😀"), (3, 0, "begun")], "session long, seq long, text string")
    return events.protocol(rows, said)


def test_events_come_in_their_order(spark):
    got = {}
    for r in answers(spark).orderBy("session", "n").collect():
        got.setdefault(r.session, []).append(r.type)
    assert got == {1: ["stage", "stage", "chunks", "stage", "stage", "delta", "delta", "delta", "done"], 2: ["stage", "stage", "error"], 3: ["stage", "stage", "chunks", "stage", "stage", "delta", "error"]}
    assert set(sum(got.values(), [])) <= set(events.KINDS)


def wire(rows, line_end):
    out = {}
    for r in sorted(rows, key=lambda r: (r.session, r.n)):
        out[r.session] = out.get(r.session, b"") + f"event: {r.type}{line_end}data: {r.payload}{line_end}{line_end}".encode()
    return out


def test_frames_cut_anywhere_give_the_same_rows(spark):
    rows = answers(spark).collect()
    want = sorted(map(tuple, rows))
    for line_end in ("\n", "\r\n"):
        for cut in (1, 2, 7, 1000):
            pieces = [(s, i, b[at : at + cut]) for s, b in wire(rows, line_end).items() for i, at in enumerate(range(0, len(b), cut))]
            random.Random(cut).shuffle(pieces)
            assert sorted(map(tuple, events.read_frames(spark.createDataFrame(pieces, STATE)).collect())) == want
    odd = spark.createDataFrame([(1, 0, b": a comment\n\nevent: x\n\ndata: {}\n\ndata: tail")], STATE)
    assert [tuple(r) for r in events.read_frames(odd).collect()] == [(1, 0, "message", "{}"), (1, 1, "message", "tail")]


def test_a_stream_of_pieces_holds_what_is_unfinished(spark, tmp_path):
    rows = answers(spark).collect()
    pieces = [(s, i, b[at : at + 9]) for s, b in wire(rows, "\r\n").items() for i, at in enumerate(range(0, len(b), 9))]
    random.Random(4).shuffle(pieces)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", sessions.PROVIDER)
    try:
        for i in range(3):
            spark.createDataFrame(pieces[i::3], STATE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(STATE).parquet(str(tmp_path / "in"))
            events.frames_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, rows))


def test_timings_of_stages(spark):
    marks = [(1, "load", 0), (1, "search", 1), (1, "search", 2), (1, "write", 5), (1, "write", 9), (2, "load", 0), (2, "write", 3), (3, "write", 1)]
    df = spark.createDataFrame([(s, k, at(m)) for s, k, m in marks], "session long, stage string, at timestamp")
    got = {r.session: tuple(None if x is None else x // 60_000 for x in r[1:]) for r in events.stage_timings(df, ["load", "search", "write"], "write").collect()}
    assert got == {1: (1, 4, 4, 5, 9), 2: (3, None, 0, 3, 3), 3: (None, None, 0, 0, 0)}


def test_batch_whose_sides_are_already_dealt_out_by_session(spark, tmp_path):
    """The sides' partitions are merged to different extents; each session's sources still come before its deltas."""
    n, settings = 1500, {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "24k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    spark.range(n).selectExpr("id as session", "explode(sequence(0, 9)) as seq").write.parquet(str(tmp_path / "messages"))
    spark.range(n).selectExpr("id as session", f"'{SOURCE}' as source").write.parquet(str(tmp_path / "sources"))
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        messages = spark.read.parquet(str(tmp_path / "messages")).withColumn("place", F.row_number().over(Window.partitionBy("session").orderBy("seq")) - 1)
        deltas = messages.selectExpr("session", "cast(seq as bigint) as seq", f"substring('{ANSWER}', place * 20 + 1, 20) as delta")
        sources = spark.read.parquet(str(tmp_path / "sources")).groupBy("session").agg(F.collect_list("source").alias("texts"))
        done = [json.loads(r.payload) for r in G.gate_batch(deltas, sources, letters=None).collect() if r.type == "done"]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    gate = whole()[1]
    assert gate.accepted and done == [{"coverage": gate.coverage, "accepted": gate.accepted, "rejected": gate.rejected}] * n
