"""The stored text index, ranks by covers, and slices by exact tokens, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from provenant.operators import counters, postings, segment, textindex


def texts(n, seed, size=30, length=40):
    r = random.Random(seed)
    return [(i, " ".join(f"t{min(r.randrange(size), r.randrange(size))}" for _ in range(r.randint(0, length)))) for i in range(n)]


def covers(words, terms):
    """All shortest stretches, by trying each."""
    spans = [(a, b) for a in range(len(words)) for b in range(a, len(words)) if terms <= set(words[a : b + 1])]
    return [(a, b) for a, b in spans if not any((c, d) != (a, b) and a <= c and d <= b for c, d in spans)]


def ranked(docs, queries, k):
    want = []
    for q, text in queries:
        terms = set(text.split())
        full = {i: t.split() for i, t in docs if terms and terms <= set(t.split())}
        scores = {}
        for i, t in docs:
            w = t.split()
            if i in full:
                scores[i] = sum(0.1 / (1 + (b - a) - (sum(x in terms for x in w[a : b + 1]) - 1)) for a, b in covers(w, terms)) / len(w)
            elif not full and terms & set(w):
                scores[i] = 0.1 * sum(x in terms for x in w) / len(w)
        best = sorted(((-round(s, 9), i) for i, s in scores.items()))[:k]
        want += [(q, i, n) for n, (_, i) in enumerate(best, 1)]
    return sorted(want)


def found(index, spark, queries, k):
    asked = textindex.query_terms(spark.createDataFrame(queries, "q long, text string"), "q", "text")
    got = [sorted((r.query_id, r.id, r["rank"]) for r in textindex.search(index, asked, k, prune).collect()) for prune in (True, False)]
    assert got[0] == got[1]
    return got[0]


QUERIES = [(1, "t0 t1 t2"), (2, "t28 t29 t27 t26 t25 t24"), (3, "t3"), (4, "nowhere t1 t2"), (5, "nowhere"), (6, ""), (7, "t0 t1 t0 t5 t9"), (8, None), (9, "t10 t11 t12 t13 t14 t15 t16 t17 t18 t19 t20 t21")]


def test_search_against_brute_force_and_after_changes(spark):
    docs = texts(120, 1)
    index = textindex.TextIndex(spark, "index_t1", slices=3, buckets=4)
    index.add(spark.createDataFrame([*docs, (500, None)], "id long, text string"), "id", "text")
    asked = [(q, t or "") for q, t in QUERIES]
    assert found(index, spark, QUERIES, 4) == ranked(docs, asked, 4)

    # a tenth is replaced, some are removed, and one comes back
    changed = {i: t for i, t in texts(120, 2) if i % 10 == 3}
    index.add(spark.createDataFrame(list(changed.items()), "id long, text string"), "id", "text")
    index.remove(spark.createDataFrame([(i,) for i in range(0, 120, 7)], "id long"))
    index.add(spark.createDataFrame([docs[7]], "id long, text string"), "id", "text")
    now = [(i, changed.get(i, t)) for i, t in docs if i % 7 or i == 7]
    assert found(index, spark, QUERIES, 4) == ranked(now, asked, 4)
    rebuilt = index.compacted("index_t2")
    assert found(rebuilt, spark, QUERIES, 4) == ranked(now, asked, 4)
    assert rebuilt.documents().count() == len(now) + 1 and rebuilt.postings().count() == sum(len(set(t.split())) for _, t in now)


def test_a_batch_that_failed_is_not_seen(spark, monkeypatch):
    docs = texts(20, 3)
    index = textindex.TextIndex(spark, "index_t3", slices=2, buckets=2)
    df = spark.createDataFrame(docs, "id long, text string")
    index.add(df, "id", "text")
    before = found(index, spark, QUERIES, 3)
    with monkeypatch.context() as m:
        m.setattr(index, "_commit", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index.add(df, "id", "text")
    assert found(index, spark, QUERIES, 3) == before
    index.add(df, "id", "text")  # once more, as it should have been
    assert found(index, spark, QUERIES, 3) == before


def test_postings_stay_in_their_buckets(spark):
    index = textindex.TextIndex(spark, "index_t4", slices=2, buckets=8)
    index.add(spark.createDataFrame(texts(30, 4), "id long, text string"), "id", "text")
    plan = index.met(spark.createDataFrame([("t1", 1)], "term string, query_id int"))._jdf.queryExecution().executedPlan().toString()
    scan = plan[: plan.index("index_t4_postings")].splitlines()
    depth = len(scan[-1]) - len(scan[-1].lstrip(" :+-"))
    above = [x for x in scan if "Exchange" in x and len(x) - len(x.lstrip(" :+-")) < depth]
    assert "SortMergeJoin" in plan and not [x for x in above if "BroadcastExchange" not in x and "hashpartitioning(id" not in x]


def test_all_covers(spark):
    docs = texts(60, 5, size=8)
    index = textindex.TextIndex(spark, "index_t5", slices=2, buckets=2)
    index.add(spark.createDataFrame(docs, "id long, text string"), "id", "text")
    asked = textindex.query_terms(spark.createDataFrame([(1, "t1 t2 t6")], "q long, text string"), "q", "text")
    got = {r.id: (r.n_covers, r.shortest) for r in textindex.all_covers(index, asked).collect()}
    want = {}
    for i, t in docs:
        if c := covers(t.split(), {"t1", "t2", "t6"}):
            want[i] = (len(c), min(b - a for a, b in c))
    assert got == want


def test_postings_are_read_once_and_scored_in_small_groups(spark, monkeypatch):
    for name, value in {"CHUNK_DOCUMENTS": 7, "CHUNK_TERMS": 90, "GROUP_DOCUMENTS": 9, "QUERY_TILE": 3}.items():
        monkeypatch.setattr(textindex, name, value)
    docs = [*texts(50, 6), (900, "t3 t4"), (901, "t3 t4"), (902, "t4 t3")]
    index = textindex.TextIndex(spark, "index_t6", slices=2, buckets=3)
    named = [(f"d{i:04}", t) for i, t in docs]
    index.add(spark.createDataFrame(named, "id string, text string"), "id", "text")
    index.remove(spark.createDataFrame([("d0900",)], "id string"))
    left = [x for x in named if x[0] != "d0900"]
    assert found(index, spark, QUERIES, 3) == ranked(left, [(q, t or "") for q, t in QUERIES], 3)
    asked = textindex.query_terms(spark.createDataFrame(QUERIES, "q long, text string"), "q", "text")
    plan = textindex.search(index, asked, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet spark_catalog.default.index_t6_postings") == 1 and "SortMergeJoin" not in plan


def test_rounding_is_sparks(spark):
    r = random.Random(3)
    values = [*(r.random() / 10 ** r.randint(0, 7) for _ in range(300)), 0.0000000005, 0.0000000015, 1.0000000025, 0.1 / 3, 0.0]
    want = [x.y for x in spark.createDataFrame([(v,) for v in values], "x double").select(F.round("x", textindex.DIGITS).alias("y")).collect()]
    assert [textindex.rounded(v) for v in values] == want


def concept_scores(docs, concepts):
    """By trying each stretch, as covers does, of places that begin with a root."""
    want = {}
    for q, _, roots, primary in concepts:
        for i, t in docs:
            w = t.split()
            held = [{r for r in roots if x.startswith(r)} for x in w]
            spans = [(a, b) for a in range(len(w)) for b in range(a, len(w)) if set().union(*held[a : b + 1]) == set(roots)]
            least = [(a, b) for a, b in spans if not any((c, d) != (a, b) and a <= c and d <= b for c, d in spans)]
            if least:
                n, p, s = want.get((q, i), (0, 0, 0.0))
                titled = all(any(x.startswith(r) for x in w[:2]) for r in roots)
                score = sum(0.1 / (1 + max(b - a - len(roots) + 1, 0)) for a, b in least) / len(w)
                want[q, i] = (n + 1, p + primary, s + score * (12 if titled else 1) * (2 if primary else 1))
    return {key: (n, p, round(s, 9)) for key, (n, p, s) in want.items()}


def test_concepts_are_scored_where_documents_lie(spark, monkeypatch):
    monkeypatch.setattr(textindex, "CHUNK_DOCUMENTS", 6)
    monkeypatch.setattr(postings, "QUERY_TILE", 2)
    r = random.Random(11)
    docs = [(i, " ".join(r.choice(["abca", "abcde", "abd", "xyz", "xyzzy", "other", "words"]) for _ in range(r.randint(0, 12)))) for i in range(40)]
    concepts = [(1, 1, ["abc", "xyz"], True), (1, 2, ["abd"], False), (2, 1, ["abc", "abcd"], True), (3, 1, ["xyzz"], True), (4, 1, ["none", "abc"], True), (5, 1, ["other"], True), (5, 2, ["abcd"], False)]
    rows = spark.createDataFrame([(q, c, root, n, len(roots), p) for q, c, roots, p in concepts for n, root in enumerate(roots, 1)], "query_id long, concept int, root string, n int, n_roots long, is_primary boolean")
    df = spark.createDataFrame([*docs, (99, None)], "id long, text string")
    title = F.substring_index("text", " ", 2)
    want = concept_scores(docs, concepts)
    got = {(x.query_id, x.id): (x.n_concepts, x.n_primary, x.score) for x in postings.prefix_concepts(df, "id", title, "text", rows).collect()}
    assert got.keys() == want.keys() and all(got[k][:2] == want[k][:2] and abs(got[k][2] - want[k][2]) < 2e-9 for k in want)

    some = postings.prefix_concepts(df.coalesce(1), "id", title, "text", rows, best=2)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
    best = lambda kept: {q: sorted((-n, -s, i) for (p, i), (n, _, s) in kept.items() if p == q)[:2] for q in range(1, 6)}
    few = {(x.query_id, x.id): (x.n_concepts, x.n_primary, x.score) for x in some.collect()}
    assert best(few) == best(got) and few.items() <= got.items() and len(few) <= 5 * 2 * 7


# --- slices


def test_sentences_are_packed_again():
    counter = counters.Estimate()
    unit = "One two three. Four five; six seven. " + "x" * 400 + ". End here."
    pieces = segment.sentence_pieces(unit, 12, counter)
    assert pieces[:2] == ["One two three. Four five; six seven.", "x" * 12] and pieces[-1] == "End here."
    assert all(n <= 12 for n in counter.count(pieces)) and "".join(pieces).replace(" ", "") == unit.replace(" ", "")


def test_sentence_pieces_against_counting_each_time():
    r = random.Random(8)
    counter = counters.Estimate()
    for _ in range(60):
        sentences = ["y" * r.randint(1, 70) + "." for _ in range(r.randint(1, 20))]
        budget, want, held = r.randint(3, 30), [], ""
        for s in sentences:
            if counter.count([s])[0] >= budget:
                want += [held, *counter.cut(s, budget)]
                held = ""
            elif counter.count([f"{held} {s}".strip()])[0] >= budget:
                want, held = [*want, held], s
            else:
                held = f"{held} {s}".strip()
        assert segment.sentence_pieces(" ".join(sentences), budget, counter) == [x for x in [*want, held] if x]


@pytest.fixture(scope="module")
def vocabularies():
    P = pytest.importorskip("public_tokenizers")
    return [counters.vocabulary_file(P.path("byte_bpe_50k.tiktoken"), P.PATTERN), counters.vocabulary_file(P.path("byte_bpe_50k.json")), counters.vocabulary_file(P.path("word_bpe_49k.json"))]


def test_cuts_between_tokens(vocabularies):
    texts = ["Plain words, and more of them. " * 9, "Հոդված 64. ԱԱՀ-ից ազատվում են գործարքները։ " * 6, "😀é" * 40, "a", "", "x" * 300]
    for make in vocabularies[:2]:
        counter = make()
        for text in texts:
            for most in (1, 5, 40):
                parts = counter.cut(text, most)
                assert "".join(parts) == text
                assert all(n <= most or len(p) == 1 for p, n in zip(parts, counter.count(parts)))


def test_exact_slices_keep_budget_cap_and_words(spark, vocabularies):
    head = "[Document] Law\n---"
    bodies = ["word and word; " * 900, "Սովորական տեքստ առանց համարակալման։ " * 200, "| a | b |\n| --- | --- |\n" + "| 1 | some words in a cell |\n" * 200, "| " + "cell " * 900 + "|", "short", "", None, "p one\n\np two\n\n" + "long " * 400]
    rows = spark.createDataFrame([(i, head, b) for i, b in enumerate(bodies)] + [(90, "h " * 3000, "text " * 900), (91, None, "x. " * 700)], "id long, head string, body string")
    make = vocabularies[0]
    got = segment.slices(rows, "id", "head", "body", most=330, cap=400, counter=make).collect()
    counter = make()
    assert {r.parent_id for r in got} == {*range(8), 90, 91}
    for r in got:
        assert r.tokens == counter.count([r.text])[0] <= 400
    for i in range(8):
        mine = sorted((r for r in got if r.parent_id == i), key=lambda r: r.slice_index)
        assert [r.slice_index for r in mine] == list(range(mine[0].n_slices)) and len({r.slice_id for r in mine}) == len(mine)
        assert all(r.text.startswith("[Document]") for r in mine) and all(r.tokens <= 330 + r.text.count("\n") for r in mine)  # line ends between units aren't counted
    assert [r.slice_id for r in got if r.parent_id == 4] == ["4"]
    tables = [r.text for r in got if r.parent_id == 2]
    assert len(tables) > 4 and all("| a | b |\n| --- | --- |" in t for t in tables)


# --- enumerations: markers as they are meant

POINTS = "1. Exemption applies to the deals of article 60.\n2. The following deals are exempt.\n"


def listed(n):
    return POINTS + "\n".join(f"{i}) {'services rendered in the set order and free of duty ' * 3}point {i}." for i in range(1, n + 1))


def rates(n):
    rows = "".join(f"| {i}) | {'income from activities of a kind ' * 9}{i} | {i} |\n" for i in range(1, n + 1))
    return "1. Turnover tax is computed at these rates.\n| | Kind of income | Rate |\n| --- | --- | --- |\n" + rows + "2. The sum is reduced by the table of this article for the period reported on, as computed there."


def test_what_is_an_enumeration(spark):
    cases = {
        listed(20): True,
        rates(10): True,
        "1. a\n2. b\n3. c\n4. d": False,
        "Plain text without any numbers. " * 200: False,
        "\n".join(["12.5 percent of it " + "x" * 600] * 6): False,
        "\n".join(["1)without white space " + "x" * 600] * 6): False,
        "\n".join(["  2.1. a part " + "x" * 600] * 5): True,
        "\n".join(["ա) letter " + "x" * 600, "բ. letter " + "x" * 600] * 3): True,
        "\n".join(["| 7 ) spaced " + "x" * 600] * 5): False,
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, body string").select("i", segment.is_enumeration(F.col("body")).alias("is"))
    assert [r["is"] for r in rows.orderBy("i").collect()] == list(cases.values())


def test_enumerated_slices_carry_leads_headers_and_keep_the_cap(spark):
    head = "[Document] TAX CODE\n---"
    rows = spark.createDataFrame([("a", head, listed(20)), ("b", head, rates(10)), ("c", head, "ա) " + "x" * 900 + "\nբ) " + "y" * 2000 + "\n1) z\n2) " + "w" * 400)], "id string, head string, body string")
    got = segment.enumerated_slices(rows, "id", "head", "body", cap=300).collect()
    a, b, c = ([r for r in sorted(got, key=lambda r: r.slice_index) if r.parent_id == x] for x in "abc")
    assert len(a) >= 18 and all(r.text.startswith("[Document]") for r in got) and len({r.slice_id for r in got}) == len(got)
    assert "2. The following deals are exempt." in next(r.text for r in a if "\n8) " in r.text)
    data = [r.text for r in b if "| 3) |" in r.text]
    assert len(data) == 1 and "Kind of income" in data[0] and sum(")" in r.text and "| Rate |" in r.text for r in b) == 10
    assert not [r for r in b if r.text.split("---\n", 1)[1].strip() == "| | Kind of income | Rate |\n| --- | --- | --- |"]
    assert all(r.tokens <= 300 for r in got) and [r.slice_id for r in c][:3] == ["c::e0", "c::e1~0", "c::e1~1"]
