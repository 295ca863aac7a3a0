"""Operators and functions on small cases whose results are worked out by hand or by a plain loop."""

import hashlib
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from provenant.functions import text as T
from provenant.operators import context, evaluate, graph, html, incremental, postings, rank, relational, segment, vector, verify
from provenant.plans import catalogue
from provenant.sources import model, tables
from provenant.streaming import gate as G


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column).first()[0]


# --- text


@pytest.mark.parametrize(
    "value, column, want",
    [
        ("  a   b\n c ", lambda: T.normalise_space("x"), "a b c"),
        ("Գ Լ Ո Ւ Խ 1", lambda: T.squash("x"), "ԳԼՈՒԽ1"),
        ("12․1·2", lambda: T.fold_dots("x"), "12.1.2"),
        ("привет мир Ա", lambda: T.answer_language("x"), "ru"),
        ("", lambda: T.answer_language("x"), "hy"),
        ("", lambda: T.notice_language("x"), "ru"),
        ("Tax-rate, _x_ 12.5 a", lambda: T.search_terms("x"), ["tax-rate", "12.5"]),
        ("head\n---\nbody\n---\nmore", lambda: T.header_of("x"), "head"),
        ("head\n---\nbody\n---\nmore", lambda: T.body_of("x"), "body\n---\nmore"),
        ("no header", lambda: T.header_of("x"), ""),
        ("no header", lambda: T.body_of("x"), "no header"),
        ("a – b’s", lambda: T.meaning_normalise("x"), "a - b's"),
        ("see /acts/109017?x", lambda: T.link_id("x"), 109017),
        ("nothing", lambda: T.link_id("x"), None),
        ("12x", lambda: T.int_or("x", 7), 7.0),
        ("12", lambda: T.int_or("x", 7), 12.0),
        ("on 05.03.2021", lambda: T.dotted_date("x").cast("string"), "2021-03-05"),
        ("5 մարտի 2021 թ.", lambda: T.long_date("x").cast("string"), "2021-03-05"),
        ("2020 թ. մայիսի 17, 5 մարտի 2021", lambda: T.long_date("x").cast("string"), "2020-05-17"),
        ("ՀՕ-165-Ն", lambda: T.act_number("x")["number"], 165),
        ("N 1202-Ա", lambda: T.act_number("x")["suffix"], "Ա"),
        ("N 1202-Ա", lambda: T.is_normative(T.act_number("x")), False),
        ("plain", lambda: T.is_normative(T.act_number("x")), True),
        ("a" * 201, lambda: T.dominant_script("x"), "en"),
        ("a" * 200, lambda: T.dominant_script("x"), None),
    ],
)
def test_text_functions(spark, value, column, want):
    assert one(spark, column(), value) == want


# --- tables


def test_upserts(spark):
    old = spark.createDataFrame([(1, 5.0, 1), (2, 3.0, 9)], "k long, score double, turn long")
    new = spark.createDataFrame([(1, 4.0, 7), (3, 1.0, 2), (2, 8.0, 9)], "k long, score double, turn long")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(relational.upsert_greatest(old, new, ["k"], "score", "turn").select("k", "score", "turn")) == [(1, 5.0, 7), (2, 8.0, 9), (3, 1.0, 2)]
    assert rows(relational.upsert_last_wins(old, new, ["k"], "turn")) == [(1, 4.0, 7), (2, 8.0, 9), (3, 1.0, 2)]
    assert rows(relational.insert_do_nothing(old, new, ["k"])) == [(1, 5.0, 1), (2, 3.0, 9), (3, 1.0, 2)]
    assert rows(relational.replace_by_key(old, new.where("k = 1"), ["k"])) == [(1, 4.0, 7), (2, 3.0, 9)]
    assert rows(relational.missing_from(new, old, ["k"])) == [(3, 1.0, 2)]
    assert rows(relational.orphans(new, old, "k", "k").select("k")) == [(3,)]
    assert rows(relational.duplicate_keys(old.union(old.where("k = 1")), ["k"])) == [(1, 2)]


def test_round_robin_does_not_starve_turns(spark):
    rows = spark.createDataFrame([(1, t, 10 * t + i, 1.0 / t - i / 100) for t in (1, 2, 3) for i in range(30 if t == 1 else 2)], "s long, t long, item long, score double")
    assert [r.item for r in relational.round_robin(rows, "s", "t", "item", "score").orderBy("rank").collect()] == [10, 20, 30, 11, 21]
    assert {r.t for r in relational.round_robin(rows, "s", "t", "item", "score", most=20).collect()} == {1}


def test_aliases(spark):
    docs = spark.createDataFrame([(1,), (2,)], "id long")
    aliases = spark.createDataFrame([(7, 1), (2, 1), (2, 2)], "alias long, doc long")
    assert relational.alias_view(docs, aliases, "id", "alias", "doc").where("lookup_id = 7").first().id == 1
    assert [tuple(r) for r in relational.alias_collisions(docs, aliases, "id", "alias", "doc").collect()] == [(2, 1)]


def test_sources_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a,b", 'say "hi"\nthere'), (None, None)], "x string, y string")
    tables.write_csv(rows, str(tmp_path / "csv"))
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "csv"), "x string, y string").collect()] == [("a,b", 'say "hi" there')]
    (tmp_path / "log.jsonl").write_text('{"id": "a", "n": 1}\n\nbroken\n{"id": "a", "n": 2}\n')
    log = tables.read_jsonl(spark, str(tmp_path / "log.jsonl"), "id string, n int")
    assert log.where("broken is not null").count() == 1
    assert incremental.last_line_wins(log.where("broken is null").drop("broken"), "id", "n").first().n == 2
    (tmp_path / "act-12-latest.html").write_text("<p>x</p>")
    assert tables.read_snapshots(spark, str(tmp_path / "act-*.html")).first().html == "<p>x</p>"
    tables.swap(spark.range(3), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
    assert tables.markdown_lines(spark.createDataFrame([(1, "a|b")], "n int, t string"), ["n"]).orderBy("n").collect()[2].line == "| 1 | a\\|b |"
    assert {r.rule: r.n for r in tables.failed_expectations(spark.range(4), {"small": "id < 3", "known": "id is not null"}).collect()} == {"small": 1, "known": 0}


# --- search


def test_cover_density_by_hand(spark):
    docs = spark.createDataFrame([(1, "aa xx bb yy aa zz zz bb"), (2, "aa aa"), (3, "bb aa")], "id long, text string")
    asked = spark.createDataFrame([(9, "aa", 1, 2), (9, "bb", 2, 2)], "query_id long, term string, n int, n_terms long")
    got = {r.id: r.score for r in postings.cover_density(postings.postings(docs, "id", "text"), asked, 2).collect()}
    assert got.keys() == {1, 3} and abs(got[1] - (0.1 / 2 + 0.1 / 2 + 0.1 / 3) / 8) < 1e-12 and abs(got[3] - 0.05) < 1e-12


def test_cover_density_of_three_terms_against_a_loop(spark):
    r = random.Random(1)
    docs = [(i, " ".join(r.choice(["aa", "bb", "cc", "dd", "ee"]) for _ in range(30))) for i in range(20)]
    asked = spark.createDataFrame([(1, t, n + 1, 3) for n, t in enumerate(["aa", "bb", "cc"])], "query_id long, term string, n int, n_terms long")
    got = {x.id: x.score for x in postings.cover_density(postings.postings(spark.createDataFrame(docs, "id long, text string"), "id", "text"), asked, 3).collect()}
    for i, t in docs:
        w, covers = t.split(), []
        for b in range(len(w)):
            for a in range(b, -1, -1):
                if {"aa", "bb", "cc"} <= set(w[a : b + 1]):
                    if w[b] in ("aa", "bb", "cc") and not {"aa", "bb", "cc"} <= set(w[a:b]):
                        covers.append((a, b))
                    break
        want = sum(0.1 / (1 + b - a - 2) for a, b in covers) / len(w)
        assert abs(got.get(i, 0) - want) < 1e-12


def test_and_then_or(spark):
    hits = spark.createDataFrame([(1, 1, 2, 2, 3), (1, 2, 2, 1, 9), (2, 3, 2, 1, 1)], "query_id long, id long, n_terms long, matched long, tf long")
    assert sorted((r.query_id, r.id) for r in postings.and_then_or(hits).collect()) == [(1, 1), (2, 3)]


@pytest.mark.parametrize("block", [2, 1024])
def test_knn_against_numpy(spark, block):
    import numpy as np

    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 6)).round(2)
    v[10:40] = v[9]
    rows = spark.createDataFrame([(i // 3, i % 3, v[i].tolist(), i % 2) for i in range(300)], "parent_id long, slice_index long, vec array<double>, label int").repartition(5)
    asked = spark.createDataFrame([(q, v[q].tolist(), q % 2) for q in (0, 9, 50)], "query_id long, vec array<double>, label int")
    for within in (None, "label"):
        got = vector.knn(rows, asked, 4, within=within, block=block).collect()
        for q in (0, 9, 50):
            s = np.round(v @ v[q], 6)
            best = {}
            for i in range(300):
                if within is None or i % 2 == q % 2:
                    best[i // 3] = max(best.get(i // 3, (-9e9, 0)), (s[i], -(i % 3)))
            want = sorted(best.items(), key=lambda x: (-x[1][0], x[0]))[:4]
            assert [(r.parent_id, r.slice_index, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [(p, -j, x) for p, (x, j) in want]
    assert vector.knn(rows, asked.limit(0), 4).count() == 0
    with pytest.raises(Exception, match="6 numbers|5 numbers"):
        vector.check_dimensions(rows, "vec", 5).count()


def test_fusion_ties_and_expansion(spark):
    leg = lambda ids: spark.createDataFrame([(1, i, n + 1) for n, i in enumerate(ids)], "query_id long, id long, rank int")
    got = rank.reciprocal_rank_fusion([leg([7, 5]), leg([5, 8, 7])], k=3)
    assert [r.id for r in got.orderBy("rank").collect()] == [5, 7, 8]
    cand = spark.createDataFrame([(1, 1, 1, 0.9), (1, 2, 2, 0.8)], "query_id long, id long, rank int, score double")
    edges = spark.createDataFrame([(1, 2), (1, 5), (2, 4), (2, 6)], "from_id long, to_id long")
    out = rank.expand_one_hop(cand, edges, spark.createDataFrame([(2,), (4,), (5,)], "id long"), most=2)
    assert [(r.id, r.score) for r in out.orderBy("rank").collect()] == [(1, 0.9), (2, 0.8), (5, 0.0), (4, 0.0)]
    assert rank.rerank(cand, None, 1).first().status == "not reranked"


# --- graph


def test_cell_index_against_numpy(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(vector, "TILE", 40)
    rng = np.random.default_rng(1)
    v = (rng.normal(size=(12, 16))[rng.integers(0, 12, 900)] + 0.7 * rng.normal(size=(900, 16))).round(3)
    rows = spark.createDataFrame([(i // 3, i % 3, v[i].tolist()) for i in range(900)], "parent_id long, slice_index long, vec array<double>")
    asked = rows.where("slice_index = 0 and parent_id % 10 = 0").select(F.col("parent_id").alias("query_id"), "vec")
    cells = vector.CellIndex(vector.sampled_centres(rows, 30))
    index = cells.build(rows).cache()
    assert index.count() == 900 and index.select("cell").distinct().count() <= 30
    as_rows = lambda df: sorted((r.query_id, r.parent_id, r.slice_index, r.score, r.rank) for r in df.collect())
    exact = as_rows(vector.knn(rows, asked, 5))
    assert as_rows(cells.search(index, asked, 5, 30)) == exact  # all cells are all vectors
    some = as_rows(cells.search(index, asked, 5, 8))
    assert len(some) == len(exact) and len({r[:2] for r in some} & {r[:2] for r in exact}) >= 0.9 * len(exact)
    few = as_rows(cells.search(index, asked, 250, 1))  # more than a cell holds: searched exactly
    assert few == as_rows(vector.knn(rows, asked, 250))


HEADER = "[Document] ՀՀ ՀԱՐԿԱՅԻՆ ՕՐԵՆՍԳԻՐՔ\n[Type] code | [Status] in_force\n[Location] ԲԱԺԻՆ 8 › ԳԼՈՒԽ 3 › 9-րդ հոդված 267\n---\n"
CITED = {
    "Տեքստ առանց հղումների:": [],
    "բացառությամբ սույն հոդվածի 3-րդ մասով սահմանված դեպքերի:": [],
    "Օրենսգրքի 254-րդ հոդվածով սահմանված կարգով:": ["254"],
    "Օրենսգրքի 52-րդ և 53-րդ հոդվածներով նախատեսված:": ["52", "53"],
    "402.1-ին, 402.2-րդ և 422-րդ հոդվածներով սահմանված:": ["402.1", "402.2", "422"],
    "Օրենսգրքի 407-410-րդ հոդվածներով:": ["407", "408", "409", "410"],
    "Օրենսգրքի 100-400-րդ հոդվածներով:": ["100", "400"],
    "402.1-402.9-րդ հոդվածներով:": ["402.1", "402.9"],
    "5 հոդվածներ, և 12, 13 հոդվածներով": [],
    "24 միլիոն դրամը գերազանցող 3-րդ մասով:": [],
    "Օրենսգրքի 254-րդ\n  հոդվածում, եւ Օրենսգրքի 254-րդ հոդված": ["254"],
    "Օրենսգրքի 254-րդ հոդվածով շեմը, Օրենսգրքի 106-րդ հոդվածի դրույթները, սույն հոդվածի 3-րդ մասի, և Օրենսգրքի 267-րդ հոդվածով:": ["106", "254", "267"],
}


def test_citations(spark):
    rows = [(i, HEADER + text) for i, text in enumerate(CITED)] + [(90, None), (91, "սահմանված է 15-րդ հոդվածով:"), (92, "օրենսգիրք " + "x" * 70 + " 15-րդ հոդվածով, օրենսգրքի 15-րդ հոդվածով")]
    found = graph.citations(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    got = {}
    for r in graph.references(found).collect():
        got.setdefault(r.id, set()).add((r.number, r.in_code))
    for i, (text, want) in enumerate(CITED.items()):
        assert got.get(i, set()) == {(n, "Օրենսգրքի" in text) for n in want}, text
    assert 90 not in got and got[91] == {("15", False)} and got[92] == {("15", False), ("15", True)}
    body = " ".join(list(CITED)[-1].split())
    assert [body[r.position :].startswith(r.group) for r in found.where(F.col("id") == len(CITED) - 1).collect()] == [True] * 3


def test_gaps_of_acts(spark):
    held = [(1, n) for n in ("1", "2", "5", "5.1", "9")] + [(2, "1")]
    refs = [(10, 1, "3"), (11, 1, "3"), (11, 1, "4"), (12, 1, "5.2"), (12, 1, "10"), (13, 1, "12"), (13, 1, "2"), (14, 3, "1"), (15, 2, "0")]
    targets = spark.createDataFrame([(a, n, i) for i, (a, n) in enumerate(held)], "act int, number string, to_id int")
    resolved = graph.resolve(spark.createDataFrame([(*r, False) for r in refs], "from_id int, act int, number string, in_code boolean"), targets, 0)
    got = sorted(map(tuple, graph.gaps(resolved, targets).collect()), key=str)
    assert got == [(1, "2", "5", "3", "4", 2, 2, 10), (1, "5.1", "9", "5.2", "5.2", 1, 1, 12), (1, "9", None, "10", "12", 2, 2, 12), (2, None, "1", "0", "0", 1, 1, 15)]
    assert graph.dangling(resolved, targets).count() == 7


def test_gaps_of_a_long_act(spark):
    """No frame shrinks from row to row, which takes time with the square of an act's articles."""
    targets = spark.range(0, 3000, 3).selectExpr("1 as act", "cast(id as string) as number", "id as to_id")
    refs = spark.range(3000).selectExpr("id as from_id", "1 as act", "cast(id as string) as number", "false as in_code")
    found = graph.gaps(graph.resolve(refs, targets, 0), targets)
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()
    got = sorted((int(r.after), int(r.before or 3000), int(r["first"]), int(r["last"]), r.n_missing, r.n_citing, r.first_citing) for r in found.collect())
    assert got == [(i, i + 3, i + 1, i + 2, 2, 2, i + 1) for i in range(0, 3000, 3)]


@pytest.mark.parametrize("span, columns", [("²", 1), ("3000000", 1000), ("9" * 30, 1000), ("0", 1), ("-2", 1), ("2.5", 1), (" 2 ", 2), ("٣", 1), ("", 1)])
def test_odd_spans_of_cells(span, columns):
    page = html.parsed(f'<table><tr><td colspan="{span}">a</td></tr><tr><td rowspan="{span}">b</td><td>c</td></tr><tr><td>d</td></tr></table>')
    assert len(html.grid(page.blocks[0][1])[0]) == max(columns, 2)


def test_highlighted_parts_are_put_out_in_bounded_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(verify, "PARTS_BYTES", 2000)
    texts = [f"{i} and " + "a quote of forty letters or thereabouts" + " then" for i in range(200)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(201)), pa.array(texts), pa.array([["a quote of forty letters or thereabouts"]] * 200 + [None])], ["id", "text", "quotes"])
    pieces = list(verify.highlighted(iter([batch])))
    assert len(pieces) > 20 and max(p.num_rows for p in pieces) <= 21
    got = [tuple(r.values()) for p in pieces for r in p.to_pylist()]
    assert got == [(i, n, *x) for i, t in enumerate(texts) for n, x in enumerate(verify.highlight(t or "", ["a quote of forty letters or thereabouts"]))]


def test_gold_by_class_without_pairs_of_all(spark):
    items = [(i, i % 3 if i % 5 else None) for i in range(60)] + [(i, (i + 1) % 3) for i in range(0, 60, 4)]
    queries = [(0, 0), (1, 1), (2, 2), (3, None), (4, 9)]
    lists = [(q, (q * 7 + r * 5) % 60, 1.0 - r / 20, r + 1) for q in range(5) for r in range(20)]
    e = evaluate
    ranked, asked, of = spark.createDataFrame(lists, "query_id long, id long, score double, rank int"), spark.createDataFrame(queries, "query_id long, label int"), spark.createDataFrame(items, "id long, label int")
    near, sizes = e.gold_by_class(ranked, asked, of, "label")
    gold = {(q, i) for q, a in queries for i, b in items if a is not None and a == b}
    assert sorted(map(tuple, near.collect())) == sorted({(q, i) for q, i, *_ in lists} & gold)
    assert dict(map(tuple, sizes.collect())) == {q: sum(x == q for x, _ in gold) for q in (0, 1, 2)}
    whole = spark.createDataFrame(sorted(gold), "query_id long, id long")
    assert sorted(map(tuple, e.question_metrics(ranked, near, n_gold=sizes).collect())) == sorted(map(tuple, e.question_metrics(ranked, whole).collect()))
    runs = ranked.selectExpr("'r' as retriever", "query_id", "id", "rank")
    assert sorted(map(tuple, e.compare_lists(runs, near, sizes).collect())) == sorted(map(tuple, e.compare_lists(runs, whole).collect()))


@pytest.mark.parametrize("n", [1, 3])
def test_scores_of_centres_are_held_in_bounded_pieces(n, monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(vector, "SCORES", 1000)
    r = np.random.default_rng(1)
    vecs, centres, ids = r.integers(-2, 3, (97, 4)).astype(float), r.integers(-2, 3, (90, 4)).astype(float), np.arange(90) * 7
    batch = pa.RecordBatch.from_arrays([pa.array(range(97)), pa.array(list(vecs), pa.list_(pa.float64()))], ["key", "vec"])
    pieces = list(vector.nearest_centres(iter([batch, batch.slice(0, 0)]), ids, centres, n, 6))
    assert max(p.num_rows for p in pieces) == 1000 // 90
    got = [(k, c) for p in pieces for k, c in zip(p.column("key").to_pylist(), p.column("cells").to_pylist())]
    assert got == [(k, sorted(ids.tolist(), key=lambda i: (-float(vecs[k] @ centres[i // 7]), i))[:n]) for k in range(97)]


def test_trained_cells_against_numpy(spark):
    import numpy as np

    r = np.random.default_rng(3)
    means = r.normal(0, 1, (12, 16))
    data = [(i // 4, i % 4, [float(x) for x in means[i % 12] + r.normal(0, 0.25, 16)]) for i in range(1200)]
    rows = spark.createDataFrame(data, "parent_id long, slice_index long, vec array<float>").repartition(3)
    asked = spark.createDataFrame([(i, data[i * 40][2]) for i in range(30)], "query_id long, vec array<float>")
    cells = vector.TrainedIndex(vector.trained_centres(rows, 24))
    index = cells.build(rows)
    exact = vector.knn(rows, asked, 8)
    found = cells.search(index, asked, 8, 6, rows, 120)
    near = vector.agreement(exact, found).first()
    assert near.overlap >= 0.95 and near.same_first >= 0.95  # a quarter of the cells, a tenth of the vectors
    best = {(x.query_id, x.parent_id): x.slice_index for x in exact.collect()}
    got = {(x.query_id, x.parent_id): x.slice_index for x in found.collect()}
    assert all(best[key] == got[key] for key in best.keys() & got.keys())
    first, last = (vector.CellIndex(vector.trained_centres(rows, 24, rounds)) for rounds in (0, 6))
    fit = lambda c: np.mean([np.max(c.matrix @ np.array(v) / np.linalg.norm(c.matrix, axis=1)) for *_, v in data])
    assert fit(last) > fit(first)
    few = cells.search(index, asked, 250, 1, rows, 8)
    assert few.count() == vector.knn(rows, asked, 250).count()


def test_many_queries_in_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(vector, "TILE_BYTES", 8 * 2 * 50)
    monkeypatch.setattr(vector, "SCORES", 64)
    rows = spark.createDataFrame([(i // 2, i % 2, [float(i % 17), float(i % 5)]) for i in range(160)], "parent_id long, slice_index long, vec array<float>")
    asked = spark.createDataFrame([(i, [float(i % 7), float(i % 3)]) for i in range(140)], "query_id long, vec array<float>")
    want = sorted(map(tuple, vector.knn(rows, asked, 3).select("query_id", "parent_id", "score").collect()))
    assert sorted(map(tuple, vector.knn(rows, asked, 3, block=1).select("query_id", "parent_id", "score").collect())) == want
    cells = vector.CellIndex(vector.sampled_centres(rows, 4))
    assert sorted(map(tuple, cells.search(cells.build(rows), asked, 3, 4).select("query_id", "parent_id", "score").collect())) == want


# --- pages and segments

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><p>Գ Լ Ո Ւ Խ 1</p>
<table><tr><td>Հոդված 5․1.</td><td>Subject</td></tr></table><p>First &amp; last</p>
<table><tr><th colspan=2>a|b</th></tr><tr><td rowspan=2>x</td><td>1</td></tr><tr><td>2</td></tr></table>
<table><tr><td>ՀԱՎԵԼՎԱԾ N 1</td></tr></table><p>   </p><p>1. point<a href="/acts/77">link</a></p></body></html>"""


def test_pages_are_parsed_once_for_chunks_and_no_join_is_left(spark):
    page = "<p>ԲԱԺԻՆ 1</p><table><tr><td>Հոդված 1.</td><td>a</td></tr></table><p>x</p><p>y</p><table><tr><td>Հոդված 2.</td></tr></table><p>ԳԼՈՒԽ 1</p><table><tr><td>Հոդված 3.</td></tr></table><p>z</p>"
    blocks = html.classified(html.raw_blocks(spark.createDataFrame([(1, page)], "id long, html string"), "id", "html"))
    found = segment.chunks(blocks)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "MapInArrow" not in plan
    assert sorted((r.ref, r.first_pos, r.text) for r in found.collect()) == [("1", 2, "x\n\ny"), ("2", None, ""), ("3", 7, "z")]
    heads = sorted((r.ref, r.title, r.path, r.n_blocks) for r in segment.article_chunks(blocks).collect())
    assert heads == [("1", "a", ["ԲԱԺԻՆ 1"], 2), ("2", "", ["ԲԱԺԻՆ 1"], None), ("3", "", ["ԲԱԺԻՆ 1", "ԳԼՈՒԽ 1"], 1)]


def test_small_rows_of_one_file_are_parsed_by_all_cores(spark):
    from provenant.plans import catalogue

    acts = catalogue._acts(spark, "/root/testdata/sf0.01")
    assert acts.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1


def test_page_to_chunks(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None)], "id long, html string")
    blocks = html.classified(html.raw_blocks(pages, "id", "html")).orderBy("pos").collect()
    assert [b.kind for b in blocks] == ["chapter", "article", "text", "table", "annex", "text"]
    assert blocks[1].label == "5.1" and blocks[1].title == "Subject" and blocks[2].text == "First & last"
    assert blocks[3].markdown == "| a\\|b | a\\|b |\n| --- | --- |\n| x | 1 |\n| x | 2 |"
    df = html.classified(html.raw_blocks(pages, "id", "html"))
    chunk = segment.article_chunks(df).collect()
    assert len(chunk) == 1 and chunk[0].ref == "5.1" and chunk[0].path == ["Գ Լ Ո Ւ Խ 1"] and chunk[0].text.startswith("First & last\n\n| a")
    assert html.page_metadata(df).first().structure == "articles"
    assert html.tables_with_articles(df).first().article == "5.1"
    assert html.page_links(pages, "id", "html").first().href == "/acts/77"


def test_points_annexes_and_tables(spark):
    rows = [(1, 0, "text", "Intro"), (1, 1, "text", "1. one"), (1, 2, "text", "more"), (1, 3, "text", "2. two"), (1, 4, "annex", "ANNEX"), (1, 5, "text", "loose"), (1, 6, "table", "| t |"), (1, 7, "text", "1. again"), (2, 0, "text", "pre"), (2, 1, "table", "| a |"), (2, 2, "table", "| b |")]
    blocks = spark.createDataFrame([(i, p, k, None, None, t, t if k == "table" else None) for i, p, k, t in rows], "id long, pos long, kind string, label string, title string, text string, markdown string")
    got = [(r.id, r.ref, r.text) for r in segment.chunks(blocks).orderBy("id", "first_pos").collect()]
    assert got == [(1, "1", "1. one\n\nmore"), (1, "2", "2. two"), (1, "annex 1 part 1", "loose"), (1, "annex 1 table 1", "| t |"), (1, "annex 1 point 1", "1. again"), (2, "preamble 1", "pre"), (2, "table 1", "| a |"), (2, "table 2", "| b |")]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab .;|\n", min_size=0, max_size=400), min_size=1, max_size=5))
def test_slices_hold_all_words_and_the_cap(spark, bodies):
    rows = spark.createDataFrame([(i, "[H]\n---", b) for i, b in enumerate(bodies)], "id long, head string, body string")
    out = segment.slices(rows, "id", "head", "body", most=40, cap=400).collect()
    for i, b in enumerate(bodies):
        mine = sorted((r for r in out if r.parent_id == i), key=lambda r: r.slice_index)
        said = "".join(r.text.removeprefix("[H]\n---\n") for r in mine)
        assert [r.slice_index for r in mine] == list(range(len(mine)))
        if "|" not in b:
            assert sorted(said.replace(" ", "").replace("\n", "")) == sorted(b.replace(" ", "").replace("\n", ""))


def test_slices_of_odd_chunks_stay_within_the_cap(spark):
    rows = spark.createDataFrame([(1, "h" * 9000, "word " * 3000), (2, None, None), (3, "h", "😀" * 5000), (4, "", "| a |\n|---|\n" + "| 1 |\n" * 900)], "id long, head string, body string")
    out = segment.slices(rows, "id", "head", "body", most=700, cap=800).collect()
    assert all(-(-len(r.text.encode()) // 4) <= 800 for r in out) and {r.parent_id for r in out} == {1, 2, 3, 4}
    assert all(r.text.startswith("| a |\n|---|") for r in out if r.parent_id == 4)


def test_greedy_pack_against_a_loop(spark):
    r = random.Random(6)
    units = ["x" * r.randint(1, 60) for _ in range(50)]
    want, used = [[]], 0
    for u in units:
        t = -(-len(u) // 4)
        if want[-1] and used + t > 20:
            want.append([])
            used = 0
        want[-1].append(u)
        used += t
    assert spark.createDataFrame([(units,)], "u array<string>").select(segment.greedy_pack(F.col("u"), 20, F.transform("u", segment.estimated_tokens))).first()[0] == want


def test_enumerated_slices(spark):
    body = "1. Part of things\n1) " + "first " * 30 + "\n2) tiny\n3) " + "third " * 30 + "\n| n | rate |\n|---|---|\n| 1 | 5 |\n| rate | 9 |"
    rows = spark.createDataFrame([("d", "[H]", body)], "id string, head string, body string")
    got = [r.text for r in segment.enumerated_slices(rows, "id", "head", "body").orderBy("slice_index").collect()]
    assert sum("| 1 | 5 |" in t for t in got) == 1 and all(t.startswith("[H]") for t in got)
    assert [t for t in got if t.endswith("| rate | 9 |")] and not [t for t in got if t.endswith("|---|---|") or t.endswith("| n | rate |")]
    assert any("2) tiny\n3) third" in t for t in got)
    assert segment.enumerated_slices(rows, "id", "head", "body", keep_header_rows=True).count() == len(got) + 2
    assert one(spark, segment.atomic_units(F.col("x")), "a\nb\n\n| r |\nc") == ["a\nb", "| r |", "c"]
    assert one(spark, segment.table_header(F.col("x")), "t\n| a |\n|---|\n| 1 |") == "| a |\n|---|"


def test_percentiles_differ(spark):
    v = spark.createDataFrame([([4, 1, 3, 2],)], "v array<int>")
    assert tuple(v.select(segment.percentile_floor(F.col("v"), 0.5), segment.percentile_cut(F.col("v"), 0.5)).first()) == (2, 3)


# --- quotes and streams

SOURCE = "1) The rate of the tax is 20 percent of the turnover. 2) It is not paid by small firms, unless they ask for it."


@pytest.mark.parametrize(
    "quote, holds",
    [
        ("The rate of the tax is 20 percent of the turnover", True),
        ("The rate of the tax is 25 percent of the turnover", False),
        ("It is paid by small firms, unless they ask for it", False),
        ("The rate of the tax is 20 percent … unless they ask for it.", True),
        ("unless they ask for it … The rate of the tax is 20 percent", False),
        ("The rate […] of", False),
        ("2) It is not paid by small firms", True),
        ("The rate of the tax is 20  percent", True),
        ("The rate of the tax, is 20 percent of the turnover", False),
    ],
)
def test_quotes(quote, holds):
    assert verify.match(quote, verify.normalised(SOURCE)) is holds


@pytest.mark.parametrize("block_bytes", [1, 4 << 20])
def test_contained_quotes_of_any_length_against_a_loop(spark, block_bytes):
    han = "今天我们在城市的图书馆里读了三本书"
    quotes = [(1, "rate"), (2, "ate of"), (3, "the  rate of"), (4, han[3:12]), (5, "no such"), (6, ""), (7, None), (8, "tax‑free"), (9, "rate"), (None, "free")]
    sources = [(1, "the rate\nof tax-free goods"), (2, "x" + han), (3, None), (4, "crated off"), (5, "rat e of"), (5, "rate")]
    q, s = spark.createDataFrame(quotes, "quote_id long, text string"), spark.createDataFrame(sources, "id long, text string")
    want = {(i, j) for i, a in quotes for j, b in sources if a and b and verify.normalised(a) in verify.normalised(b)}
    got = [tuple(r) for r in verify.contained_quotes(q, s, block_bytes).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {i for i, _ in want} == {1, 2, 3, 4, 8, 9, None}


def test_sanitise_and_highlight(spark):
    good, bad = "Հարկի դրույքաչափը քսան տոկոս է շրջանառությունից", "Հարկի դրույքաչափը տասը տոկոս է շրջանառությունից"
    text, n, rejected, found = verify.sanitise(f"Ա «{good}» և «{bad}» «կարճ»", ["x", good])
    assert (n, rejected, found) == (2, 1, [1]) and good in text and bad not in text and verify.NOTICES["hy"] in text
    assert verify.highlight("abc the quoted words go here xyz", ["the quoted words go here", "short"]) == [("abc ", False), ("the quoted words go here", True), (" xyz", False)]
    rows = spark.createDataFrame([(1, f"«{good}»", [good])], "id long, text string, texts array<string>")
    assert verify.sanitised(rows, rows).first().n_rejected == 0
    assert verify.highlight_segments(rows.withColumnRenamed("texts", "quotes")).count() == 3
    c = spark.createDataFrame([("Coverage: PARTIAL\n\nbody",), ("no header\nhere",)], "t string").select(verify.coverage(F.col("t")).alias("c")).select("c.*").collect()
    assert [tuple(r) for r in c] == [("partial", "\nbody"), (None, "no header\nhere")] or [r.coverage for r in c] == ["partial", None]


SAID = "the rate of the tax is 20 percent of the turnover, and small firms don't pay it unless they ask"
TURNS = [
    (1, 1, "user", SAID),
    (1, 2, "assistant", "The rate of the tax is 25 percent of the turnover"),
    (1, 3, "user", "so " + SAID),
    (1, 4, "assistant", SAID[:50]),
    (2, 1, "user", SAID),
    (2, 2, "assistant", SAID[:40] + " … " + SAID[55:80]),
    (2, 3, "user", None),
    (2, 4, "assistant", "too short"),
    (2, 5, "user", "something else than that was asked here"),
    (2, 6, "assistant", SAID[20:70]),
]


def held(quote, source):
    """Whether the source holds the quote, by trying all ways to go on from each of its parts."""
    parts = [p.strip() for p in quote.split("…")]
    ends = {0}
    for p in parts:
        ends = {i + len(p) for e in ends for i in range(e, len(source)) if source[i : i + len(p)] == p}
    return bool(ends)


def test_sanitised_checks_quotes_of_any_script(spark):
    before = {(c, t + 1): x or "" for c, t, _, x in TURNS}
    want, rows = {}, []
    for c, t, role, x in TURNS:
        if role == "assistant":
            checked = len(x) >= verify.LEAST_QUOTE
            bad = checked and not held(x, before[c, t])
            want[c * 1000 + t] = (verify.NOTICES["ru"] if bad else f"«{x}»", int(checked), int(bad))
            rows.append((c * 1000 + t, f"«{x}»", [before[c, t]]))
    df = spark.createDataFrame(rows, "id long, text string, texts array<string>")
    got = verify.sanitised(df.select("id", "text"), df.select("id", "texts"), letters=None).collect()
    assert {r.id: (r.clean, r.n_quotes, r.n_rejected) for r in got} == want
    assert sorted(w[1:] for w in want.values()) == [(0, 0), (1, 0), (1, 0), (1, 1), (1, 1)]


def test_gate_opens_and_checks(spark):
    deltas = [(c, t, f"«{x}»" if role == "assistant" else x) for c, t, role, x in TURNS]
    sources = [(c, [x for conv, _, role, x in TURNS if conv == c and role == "user"]) for c in (1, 2)]
    rows = G.gate_batch(spark.createDataFrame(deltas, "session long, seq long, delta string"), spark.createDataFrame(sources, "session long, texts array<string>"), letters=None).collect()
    for c, texts in sources:
        quotes = [x for conv, _, role, x in TURNS if conv == c and role == "assistant" and len(x) >= verify.LEAST_QUOTE]
        good = [q for q in quotes if any(held(q, s or "") for s in texts)]
        done = json.loads(next(r.payload for r in rows if r.session == c and r.type == "done"))
        assert (done["accepted"], done["rejected"]) == (len(good), len(quotes) - len(good))
        shown = "".join(r.payload for r in sorted((r for r in rows if r.session == c and r.type == "delta"), key=lambda r: (r.seq, r.n)))
        assert all((f"«{q}»" in shown) == (q in good) for q in quotes) and good


def test_batch_and_stream_ask_the_same_of_quotes():
    fake, law = "Հոդված երեք, որ ոչ մի տեղ չկա այս օրենքում", "Հարկի դրույքաչափը քսան տոկոս է շրջանառությունից"
    foreign = "Это собственные слова отвечающего, а не цитата из закона"
    for text, rejected in [(f"«{foreign}»", 0), (f'"{fake}"', 1), (f'a "{law}" b «{fake}» c {fake}', 1), (f"“{fake}” և «կարճ» և «{foreign}»", 1), (f'"{law}', 0), (f"«{law} \"{fake}\"»", 1)]:
        clean, n, bad, _ = verify.sanitise(text, [law], language="hy")
        gate = G.Gate([law], language="hy")
        shown = gate.feed(text) + gate.flush()
        assert gate.rejected == rejected and (bad >= rejected) and (rejected == 0 or verify.NOTICES["hy"] in shown)
        if text.count('"') != 1 and not text.startswith("«Հարկի"):
            assert clean == shown and bad == rejected
    clean, _, _, _ = verify.sanitise(f'a "{law}" b «{fake}» c {fake}', [law], language="hy")
    assert clean == f'a "{law}" b {verify.NOTICES["hy"]} c {fake}'  # marks go, words outside marks stay


ANSWER = f"COVERAGE: full\n\nSee «{SOURCE[3:52]}», and “{SOURCE[3:30]} 99 {SOURCE[30:50]}”; «an unclosed quote of some length"


def run_gate(parts):
    g = G.Gate([SOURCE], letters=None)
    out = "".join(g.feed(p) for p in parts)
    return out + g.flush(), g.coverage, g.accepted, g.rejected


def test_gate_does_not_depend_on_cuts():
    whole = run_gate([ANSWER])
    assert whole[1:] == ("full", 1, 2) and "99" not in whole[0] and whole[0].endswith(G.CLOSING["ru"])
    for k in range(len(ANSWER) + 1):
        assert run_gate([ANSWER[:k], ANSWER[k:]]) == whole
    r = random.Random(0)
    for _ in range(50):
        cuts = sorted(r.sample(range(len(ANSWER)), 6))
        assert run_gate([ANSWER[a:b] for a, b in zip([0, *cuts], [*cuts, len(ANSWER)], strict=True)]) == whole
    g = G.Gate([SOURCE], letters=None)
    assert g.feed("x" * 64 + "«The rate") == "x" * 64  # nothing of a quote before it is closed


def test_gate_stream_equals_batch(spark, tmp_path):
    parts = [(1, n, ANSWER[a : a + 9], a + 9 >= len(ANSWER)) for n, a in enumerate(range(0, len(ANSWER), 9))] + [(2, 0, "plain", True)]
    rows = [(s, n, d, last, [SOURCE] if n == 0 else None) for s, n, d, last in parts]
    random.Random(1).shuffle(rows)
    schema = "session long, seq long, delta string, is_last boolean, texts array<string>"
    for i in range(0, len(rows), 7):
        spark.createDataFrame(rows[i : i + 7], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = G.gate_stream(stream, letters=None).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    batch = G.gate_batch(spark.createDataFrame(rows, schema), spark.createDataFrame([(1, [SOURCE]), (2, [])], "session long, texts array<string>"), letters=None)
    text = lambda df: {s: "".join(r.payload for r in sorted((r for r in df.collect() if r.session == s and r.type == "delta"), key=lambda r: (r.seq, r.n))) for s in (1, 2)}
    done = lambda df: sorted((r.session, r.payload) for r in df.collect() if r.type == "done")
    out = spark.read.parquet(str(tmp_path / "out"))
    assert text(out)[2] == "plain" and sorted(text(out)[1]) == sorted(text(batch)[1]) and done(out) == done(batch)


def test_frames():
    assert G.frames(["data: a\r", "\n\r\ndata", ": b\n\nda", "ta: c"]) == ["data: a", "data: b", "data: c"]


# --- evaluation


def test_metrics_by_hand(spark):
    ranked = spark.createDataFrame([(1, 10, 1, 0.9), (1, 11, 6, 0.5), (2, 20, 3, 0.4)], "query_id long, id long, rank int, score double")
    gold = spark.createDataFrame([(1, 11), (1, 12), (2, 20), (3, 5)], "query_id long, id long")
    m = {r.query_id: r for r in evaluate.question_metrics(ranked, gold).collect()}
    assert (m[1].hit_5, m[1].hit_8, m[1].recall_8, round(m[1].reciprocal_rank, 6)) == (0, 1, 0.5, round(1 / 6, 6))
    assert (m[2].hit_5, m[2].recall_5, m[3].hit_8, m[3].reciprocal_rank) == (1, 1.0, 0, 0.0)
    runs = ranked.withColumn("retriever", F.lit("a"))
    assert {r.query_id: r.outcome for r in evaluate.compare_lists(runs, gold).collect()} == {1: "rank 6", 2: "rank 3", 3: "MISS"}
    refs = spark.createDataFrame([("Հոդված 5, մաս 2",), ("Հավելված 1, մաս 2",)], "r string").select(evaluate.article_key(F.col("r"))).collect()
    assert [r[0] for r in refs] == ["Հոդված 5", "Հավելված 1, մաս 2"]
    lists = spark.createDataFrame([(1, "a", 1, 1.0), (1, "a", 2, 0.5), (1, "b", 3, 0.4)], "query_id long, id string, rank int, score double")
    assert sorted((r.id, r.rank) for r in evaluate.first_occurrences(lists).collect()) == [("a", 1), ("b", 2)]


def test_best_threshold_is_the_first(spark):
    rows = spark.createDataFrame([(0.9, True), (0.8, True), (0.3, False)], "s double, c boolean")
    best = evaluate.best_threshold(evaluate.threshold_sweep(rows, "s", "c")).first()
    assert (best.t, best.n_correct, best.false_confident, best.false_cautious) == (0.325, 3, 0, 0)


def test_status_and_silence(spark):
    diff = spark.createDataFrame([(1, "same"), (1, "added"), (2, "same"), (3, "removed")], "d long, change string")
    got = {r.d: r.status for r in incremental.document_status(diff, "d", spark.createDataFrame([(2,), (9,)], "d long")).collect()}
    assert got == {1: "changed", 2: "error", 3: "error", 9: "error"}


# --- context and model


def test_context(spark):
    said = spark.createDataFrame([(1, n, "user" if n % 2 == 0 else "assistant", f"m{n}") for n in range(11)] + [(2, 0, "assistant", "x")], "s long, n long, role string, text string")
    rows = context.contextualised(said, "s", "n", "role", "text").collect()
    assert len(rows) == 1 and rows[0].query == "m10" and rows[0].history.startswith("assistant: m3") and rows[0].facts is None
    changed = context.contextualised(said, "s", "n", "role", "text", rewrite=lambda m, h: F.when(F.lit(False), m)).first()
    assert changed.query == "m10"
    parts = spark.createDataFrame([(1, 2, True, "b", "two"), (1, 1, False, "a", "one")], "s long, place int, is_carried boolean, ref string, text string")
    assert context.prompts(parts, ["s"], F.lit("ru"), F.lit(None).cast("string")).first().prompt == 'Answer in: ru\n\n<fresh ref="a">\none\n</fragment>\n\n<carried ref="b">\ntwo\n</fragment>'
    assert context.smallest_input_limit(context.models(spark)).first()[0] == 512


def test_audits(spark):
    pages = spark.createDataFrame([(1, 3, "articles", "5", "hy", 10), (2, 0, "unknown", None, "hy", 10), (3, 1, "articles", "6", "ru", 10)], "id long, n_article long, structure string, number string, body_script string, n_chars long")
    expected = spark.createDataFrame([(1, "5", "hy", False), (2, None, "hy", False), (3, "6", "hy", False), (4, "1", "hy", True)], "id long, number string, script string, is_control boolean")
    assert {r.id: r.verdict for r in context.audit_rows(pages, expected).collect()} == {1: "ok", 2: "failed", 3: "partial", 4: "failed"}
    versions = spark.createDataFrame([(1, "hy", "2021-01-01"), (1, "ru", "2020-01-01"), (1, "en", "2021-01-01")], "id long, lang string, at string")
    assert [r.lang for r in context.stale_translations(versions, "id", "lang", "at", "hy").collect()] == ["ru"]


def test_model(spark):
    for name in model.TABLES:
        assert model.schema_differences(model.empty(spark, name), name) == []
    assert model.schema_differences(spark.range(1), "article_refs") == ["missing from_id", "missing to_id", "surplus id"]
    refs = spark.createDataFrame([(1, 1), (1, 2)], "from_id long, to_id long")
    assert model.broken_rules(refs, "article_refs").first().n == 1
    names = spark.createDataFrame([("002",), ("001",), ("003",)], "name string")
    assert [r.name for r in model.pending(names, names.where("name = '002'")).collect()] == ["001", "003"]
    docs = model.empty(spark, "documents")
    assert tables.retrievable(model.empty(spark, "articles"), docs).count() == 0 and model.orphan_counts(model.empty(spark, "articles"), docs).first()[0] == 0
