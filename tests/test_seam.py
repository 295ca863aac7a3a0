"""Calls of models: tries, journals, statuses, and what is passed through without an answer."""

import json

import pytest

from provenant.operators import seam
from pyspark.sql import functions as F


def test_tries_wait_twice_as_long_each_time():
    calls, waits = [], []

    def model(requests):
        calls.append(len(requests))
        if len(calls) < 5:
            raise ConnectionError("down")
        return [{"y": 1}] * len(requests)

    assert seam.answers(model, [{"x": 1}, {"x": 2}], 7, 2.0, 10.0, waits.append) == ([{"y": 1}] * 2, "ok") and waits == [2, 4, 8, 10]
    calls.clear()
    assert seam.answers(model, [{"x": 1}], 3, 0.0, 1.0, waits.append) == (None, "failed after 3: ConnectionError: down")
    assert seam.answers(lambda r: [], [{"x": 1}], 2, 0.0, 1.0, waits.append)[1] == "failed after 2: 0 answers to 1 requests"

    def refusing(requests):
        calls.append("refused")
        raise seam.Refused("too long")

    assert seam.answers(refusing, [{}], 7, 0.0, 1.0) == (None, "refused: too long") and calls.count("refused") == 1


def counting(folder, fails):
    """A model that leaves a line for each batch it is asked, and fails for some."""

    def model(requests):
        with open(f"{folder}/calls", "a") as f:
            f.write(json.dumps([r["text"] for r in requests]) + "\n")
        if any(r["text"] in fails for r in requests):
            raise OSError("no")
        return [{"size": len(r["text"]), "upper": r["text"].upper() or None} for r in requests]

    return model


def test_a_run_resumes_from_its_journal(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i % 6}", i * 10) for i in range(30)] + [(99, None, 0)], "id long, text string, status_code int").where("text is not null")
    options = {"inputs": ["text"], "outputs": "size long, upper string", "name": "m", "journal": str(tmp_path / "journal"), "batch": 1, "attempts": 2, "first_wait": 0.0}
    called = lambda: [x for line in (tmp_path / "calls").read_text().splitlines() for x in json.loads(line)]
    first = seam.call_model(rows, model=counting(tmp_path, {"t3", "t4"}), **options)
    got = {r.id: r for r in first.collect()}
    assert len(got) == 30 and got[0].upper == "T0" and got[3].status == "failed after 2: OSError: no" and got[3].size is None and got[3].status_code == 30
    assert sorted(called()) == ["t0", "t1", "t2", "t3", "t3", "t4", "t4", "t5"]  # equal rows once, failures twice
    assert {(r.status, r.n) for r in seam.failures(first).collect()} == {("failed after 2: OSError: no", 10)}
    (tmp_path / "calls").unlink()
    second = seam.call_model(rows, model=counting(tmp_path, set()), **options)
    assert second.where("status <> 'ok'").count() == 0 and sorted(called()) == ["t3", "t4"]
    assert {r.upper for r in first.collect()} == {"T0", "T1", "T2", None, "T5"}  # what was returned stays
    (tmp_path / "calls").unlink()
    other = seam.call_model(rows.limit(1), model=counting(tmp_path, set()), **(options | {"name": "another"}))
    assert other.first().status == "ok" and len(called()) == 1


def test_reranking_without_answers_keeps_the_order(spark):
    rows = spark.createDataFrame([(q, f"q{q}", i, i + 1, "d" * (9 - i)) for q in (1, 2) for i in range(6)], "query_id long, question string, id long, rank int, document string")

    def model(requests):
        if any(r["question"] == "q2" for r in requests):
            raise TimeoutError("late")
        return [{"relevance": [-float(len(d)) for d in r["documents"]]} for r in requests]

    out = seam.rerank_by_model(rows, 3, model, batch=1, attempts=1).collect()
    assert [(r.id, r.came) for r in sorted(out, key=lambda r: r["rank"]) if r.query_id == 1] == [(5, 6), (4, 5), (3, 4)]
    lost = [r for r in sorted(out, key=lambda r: r["rank"]) if r.query_id == 2]
    assert [r.id for r in lost] == [0, 1, 2] and {r.status for r in lost} == {"failed after 1: TimeoutError: late"}


def test_context_without_answers_keeps_message_and_facts(spark):
    said = spark.createDataFrame([(s, t, "user" if t % 2 == 0 else "assistant", f"m{s}{t}") for s in (1, 2, 3) for t in range(11)] + [(4, 0, "assistant", "hello")], "s long, t long, role string, text string")
    facts = spark.createDataFrame([(1, "old"), (2, "old")], "s long, facts string")

    def model(requests):
        (r,) = requests
        if r["message"] == "m110":
            raise ValueError("unparseable")
        return [{"standalone_query": "whole question", "search_terms": "terms", "needs_retrieval": False, "is_topic_shift": True, "fact_summary": ""}] if "m210" == r["message"] else [{}]

    got = {r.s: r for r in seam.contextualised_by_model(said, "s", "t", "role", "text", model, facts, batch=1, attempts=1).collect()}
    assert got.keys() == {1, 2, 3}
    assert tuple(got[1])[1:7] == ("m110", "m110", "", True, False, "old") and got[1].status.startswith("failed")
    assert tuple(got[2])[1:7] == ("whole question terms", "whole question", "terms", False, True, "old") and got[2].status == "ok"
    assert tuple(got[3])[1:7] == ("m310", "m310", "", True, False, "")


def test_lost_legs_are_named(spark):
    rows = spark.createDataFrame([(True, False), (True, True), (False, False), (None, True)], "a boolean, b boolean")
    assert [r[0] for r in rows.select(seam.legs_status({"vector": F.col("a"), "lexical": F.col("b")})).collect()] == ["vector", "vector,lexical", None, "lexical"]


@pytest.mark.parametrize("n", [0, 1])
def test_few_rows(spark, n):
    rows = spark.createDataFrame([(i, "x") for i in range(n)], "id long, text string")
    assert seam.call_model(rows, ["text"], "y long", lambda r: [{"y": 7}] * len(r), "m").count() == n


def test_what_models_are_asked_is_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            made.add(len(frame))
            yield frame

    rows = spark.range(6).mapInPandas(counted, "id long")
    called = seam.call_model(rows, ["id"], "twice long", lambda requests: [{"twice": 2 * x["id"]} for x in requests], "double", workers=1)
    assert sorted((r.id, r.twice) for r in called.collect()) == [(i, 2 * i) for i in range(6)] and made.value == 6
