"""Each operator against brute force on small tables that hold nulls, empty and long texts, ties, repeated rows, extra
columns, and nothing at all."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from provenant.llm import common, decontamination, exact_dedup, mixing, pii, quality, secrets, simhash, substring_dedup, token_counts, token_files, tokens  # noqa: E402
from provenant.llm.components import components  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tie string, fp string, h long"


def words(n, seed, size=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(size)}" for _ in range(n))


def odd_rows():
    base = words(60, 1)
    rows = [(1, base), (2, base), (2, base), (3, None), (4, ""), (None, base + " tail"), (5, "  \t\n "), (6, words(3000, 2, 5000)), (7, words(40, 3) + " " + base), (8, "é" * 50 + " ñ"), (None, None), (9, words(34, 4)), (10, words(36, 5)), (11, "A  B c"), (12, "a b C")]
    return [(i, t, "en", None if i == 3 else f"s{(i or 0) % 3}", 0, "x", "y", 1) for i, t in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts():
    return [(r[0], r[1] or "") for r in odd_rows()]


# --- 6 exact dedup


def test_exact_dedup(spark, odd, none):
    index = exact_dedup.DigestIndex(spark, "index_a", 4)
    got = index.add(odd).collect()
    groups = collections.defaultdict(list)
    for i, t in texts():
        groups[hashlib.sha256(t.encode()).hexdigest()].append(i)
    assert len(got) == len(texts())
    for r in got:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    again = index.add(odd).collect()
    assert not any(r.kept for r in again) and {r.text_sha256: r.keep_id for r in again} == {r.text_sha256: r.keep_id for r in got}
    assert all(r.group_size == 2 * len(groups[r.text_sha256]) for r in again)
    fresh = index.add(spark.createDataFrame([(99, "quite new"), (98, "A  B c")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.kept for r in fresh} == {99: True, 98: False}
    assert index.add(none).count() == 0


def test_batches_may_be_added_again(spark):
    def batch(*rows):
        return spark.createDataFrame(list(rows), "doc_id long, text string")

    def result(df):
        return sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect())

    index = exact_dedup.DigestIndex(spark, "index_b", 4)
    one, two, three = batch((1, "a"), (2, "a"), (3, "b")), batch((4, "a"), (5, "c"), (6, "c")), batch((7, "c"), (8, "a"), (9, "d"))
    first = result(index.add(one, "one"))
    assert first == [(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True)]
    assert result(index.add(one, "one")) == first  # the job failed after the append and ran again
    second = result(index.add(two, "two"))
    assert second == [(4, 2, 3, False), (5, 6, 2, False), (6, 6, 2, True)]
    third = result(index.add(three, "three"))
    assert third == [(7, 6, 3, False), (8, 2, 4, False), (9, 9, 1, True)]
    rows = spark.table("index_b").count()
    assert result(index.add(two, "two")) == second and result(index.add(one, "one")) == first and spark.table("index_b").count() == rows
    # an append that was cut off: half of a batch is there
    spark.table("index_b").where("batch = 'two'").limit(1).withColumns({"batch": F.lit("four"), "seq": F.lit(4).cast("long")}).write.format("parquet").bucketBy(4, "digest").sortBy("digest").mode("append").saveAsTable("index_b")
    four = batch((14, "a"), (15, "c"), (16, "e"))
    assert result(index.add(four, "four")) == [(14, 2, 5, False), (15, 6, 4, False), (16, 16, 1, True)]
    small = index.compacted("index_c")
    assert spark.table("index_c").count() == 5
    assert result(small.add(batch((20, "a"), (21, "f")))) == [(20, 2, 6, False), (21, 21, 1, True)]


# --- what operators share


def test_bitmap_of_likely_keys(spark):
    rows = spark.createDataFrame([(i, str(i % 7)) for i in range(3000)] + [(None, "x"), (None, "x")], "a long, b string")
    for chosen, n in (("a % 50 = 0 or a is null", 61), ("a < 0", 0), ("a >= 0", 3000)):
        keys = rows.where(chosen).distinct()
        got = common.likely_among(rows, keys, ["a", "b"], n)
        assert got.columns == ["a", "b", "likely"] and got.count() == 3002
        assert got.where(chosen).where("not likely").count() == 0
        assert got.where("likely").count() <= rows.where(chosen).count() + 250


# --- 7, 4 tokens


def test_token_counts(odd, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    expected = sorted((str(i), len(t.encode()), n := len(tokenizer.encode(t, add_special_tokens=False).ids), n > 100) for i, t in texts())
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(odd, path, limit=100, part_bytes=500).collect())
    assert got == expected
    assert token_counts.count_tokens(none, path).count() == 0


def test_pieces_encode_as_whole_texts():
    from tokenizers import Tokenizer

    text = tokens.read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    whole, memo = Tokenizer.from_str(text), tokens.IdMemo(text, np.dtype("<u2"), most_bytes=4000, call_size=20)
    r = random.Random(3)
    parts = ["a", "The", "é", "23", ".", ",", "'s", "!", " ", "  ", "\n", "\n\n", "\t", "\xa0", "\x1c", "<|endoftext|>", "_", "²", "\0"]
    for _ in range(1500):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        pieces = [p for batch in tokens.by_bytes([t], 5) for _, part in batch for p in tokens.spaced_pieces(part)]
        memo.learn(set(pieces))
        assert np.frombuffer(b"".join(memo[p] for p in pieces), "<u2").tolist() == whole.encode(t, add_special_tokens=False).ids, t
    assert memo.held_bytes <= 4000 + 60 * tokens.ENTRY_BYTES and len(memo.older) <= 27


def test_words_count_as_in_whole_texts():
    from tokenizers import Tokenizer

    text = tokens.read_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    whole, memo = Tokenizer.from_str(text), tokens.PieceMemo(text, most_bytes=4000, call_size=20)
    r = random.Random(4)
    parts = ["a", "The", "é", "e\u0301", "23", ".", "'s", "!", " ", "  ", "\n", "\t", "\xa0", "\x1c", "<|endoftext|>", "<|startoftext|>", "<|endof", "<", "text|>", "_", "²", "\0"]
    for _ in range(1500):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        words_in = [w for batch in tokens.by_bytes([t], 5) for _, part in batch for w in tokens.words_of(part)]
        memo.learn(set(words_in))
        assert sum(memo[w] for w in words_in) == len(whole.encode(t, add_special_tokens=False).ids), t


def test_a_worker_keeps_its_memo():
    text = tokens.read_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    shared = {"tokenizer": text}
    memo = tokens.kept_memo(shared, tokens.PieceMemo)
    memo.learn({b"one", b"two"})
    assert tokens.kept_memo(shared, tokens.PieceMemo) is memo and {b"one", b"two"} <= set(memo)
    memo.most_bytes = 3 * tokens.ENTRY_BYTES
    memo.learn({b"two", b"three", b"four"})
    assert b"one" in memo.older and b"one" not in memo and {b"two", b"three", b"four"} <= set(memo)


def test_token_files_round_trip(spark, odd, none, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    manifest = token_files.write_token_files(odd, path, f"file://{tmp_path}/out", shards=3, part_bytes=300)
    got = token_files.read_token_files(manifest, rows_per_batch=2, with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in texts()), key=lambda i: (i is not None, i))
    at = 0
    left = collections.Counter((i, tuple(tokenizer.encode(t, add_special_tokens=False).ids + [0])) for i, t in texts())
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        left[r.doc_id, tuple(r.ids)] -= 1
        at += r.n_tokens
    assert not any(left.values())
    assert token_files.encode_and_read_back(none, path).count() == 0


# --- 2 mixing


def water_fill(sizes, weights, most):
    targets, open_, total = {}, set(sizes), sum(sizes.values())
    while True:
        share = (total - sum(targets.values())) / (sum(weights[s] for s in open_) or 1)
        above = {s for s in open_ if weights[s] * share > most * sizes[s]}
        if not above:
            return targets | {s: weights[s] * share for s in open_}
        targets |= {s: most * sizes[s] for s in above}
        open_ -= above


def test_mixing(spark, odd, none):
    r = random.Random(5)
    rows = [(i, words(r.randint(0, 60), i), s) for i, s in enumerate(["big"] * 700 + ["b"] * 40 + ["c"] * 3 + [None] * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, s)), (1, 2, 3, 1), strict=True))
    targets = water_fill(dict(sizes), weights, 3)
    of = {i: s for i, _, s in rows}
    taken = collections.Counter()
    for g in got:
        s = of[g.doc_id]
        assert g.source_size == sizes[s] and abs(g.target - targets[s]) < 1e-6 and g.taken == g.size * g.copies and 0 <= g.copies <= 3
        taken[s] += g.taken
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 15
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mix(odd).count() == len(texts()) and mixing.mix(none).count() == 0


def test_flight_in_blocks_keeps_totals(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 60)
    docs = spark.createDataFrame([(i, "x " * (1 + i % 37), "a" if i % 3 else "b") for i in range(900)], "doc_id long, text string, source string")
    got = mixing.mix(docs, weights=(1, 4)).collect()
    assert len(got) == 900 and len({g.doc_id for g in got}) == 900
    by = collections.defaultdict(lambda: [0, 0])
    for g in got:
        by[g.source_size][0] += g.taken
        by[g.source_size][1] = g.target
    assert all(abs(a - b) <= 3 for a, b in by.values())


# --- 3 decontamination


def edit_distance_within(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_myers_distance_and_pigeonhole():
    r = random.Random(11)
    for _ in range(300):
        item = [f"w{r.randrange(30)}" for _ in range(r.randint(5, 70))]
        text = [f"w{r.randrange(30)}" for _ in range(r.randint(0, 40))]
        if r.random() < 0.7:
            copy = list(item)
            for _ in range(r.randint(0, 8)):
                k = r.randrange(len(copy) + 1)
                copy[k : k + r.randint(0, 1)] = ["z"] * r.randint(0, 1)
            text = text + copy + text[:5]
        masks = collections.defaultdict(int)
        for i, w in enumerate(item):
            masks[w] |= 1 << i
        d = edit_distance_within(item, text)
        assert decontamination.best_distance(masks, len(item), text) == d
        budget = int(0.2 * len(item))
        found = decontamination.Matcher([(1, " ".join(item))], 0.2, 5).find(" ".join(text))
        assert (0 in found) == (d <= budget) and (0 not in found or found[0] >= d)


def test_decontamination(spark, odd, none):
    item = words(30, 77)
    bench = spark.createDataFrame([(5, item), (None, words(12, 78)), (6, None), (7, "short one")], "item_id long, text string")
    changed = item.split()
    changed[3], changed[20] = "other", "words"
    rows = [(1, words(50, 1) + " " + item.upper() + "!"), (2, " ".join(changed)), (3, words(80, 9)), (4, None), (5, words(12, 78)), (6, "short one")]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, items string")
    got = {r.doc_id: r for r in decontamination.find_contamination(docs, bench, block_bytes=50, carry=("items",)).collect()}
    assert {i for i, r in got.items() if r.contaminated} == {1, 2, 5, 6}
    few = decontamination.find_contamination(docs, bench, least_words=5)
    assert {r.doc_id for r in few.where("contaminated").collect()} == {1, 2, 5}
    assert got[1].min_distance == 0 and got[2].min_distance == 2 and got[2].item_ids == "5" and got[5].item_ids == "" and got[3]["items"] == "k"
    assert decontamination.find_contamination(odd, bench).where("contaminated").count() == 0
    assert decontamination.find_contamination(odd, bench.limit(0)).where("kept").count() == len(texts())
    assert decontamination.find_contamination(none, bench).count() == 0


def test_decontamination_of_short_items_and_unspaced_scripts(spark, tmp_path):
    import corpus_pipeline
    from provenant.llm import queries

    han, thai = "今天我们在城市的图书馆里读了三本关于海洋历史的书", "วันนี้เราอ่านหนังสือในห้องสมุด"
    spark.createDataFrame([(1, "short one"), (2, han), (3, "Single"), (4, thai), (5, "!?")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, "a SHORT one!", "1"), (2, "x" + han + "y", "2"), (3, han.replace("图", "画"), "2"), (4, "a single, here", "3"), (5, "กก " + thai, "4")]
    rows += [(6, "short of one", ""), (7, "singles", ""), (8, han[::-1], ""), (9, thai[:12], ""), (10, None, ""), (11, "!?", "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op3_decontamination(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.item_ids for r in got} == {i: items for i, _, items in rows}
    assert {r.min_distance for r in got if r.doc_id in (1, 2, 4, 5)} == {0} and [r.min_distance for r in got if r.doc_id == 3] == [1]
    assert {r.doc_id for r in corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()} == {i for i, _, items in rows if not items}


# --- 5 quality


def test_dual_coordinate_descent_separates():
    r = random.Random(2)
    good = [words(40, i) for i in range(60)]
    bad = [" ".join(r.choice(["AA!!", "BB!!", "x"]) for _ in range(40)) for _ in range(30)]
    f = quality.Features()
    rows, y = [f(t) for t in good + bad], np.array([1.0] * 60 + [0.0] * 30)
    model = quality.fit(rows, y)
    assert all((model.score(x) > 0.5) == (t > 0) for x, t in zip(rows, y, strict=True))


def test_ratios_and_descent_against_direct_solutions():
    r = np.random.default_rng(7)
    rows = [np.sort(r.choice(40, r.integers(3, 12), replace=False)) for _ in range(60)]
    y = np.array([float((x < 12).sum() + r.normal() > 2.5) for x in rows])
    ratios = quality.log_count_ratios(rows, y, least=2)
    held = [[sum(j in x for x, c in zip(rows, y, strict=True) if c == k) for j in range(40)] for k in (0, 1)]
    for j in range(40):
        share = [(held[k][j] + 1) / (sum(held[k]) + 2**quality.BITS) for k in (0, 1)]
        want = np.log(share[1] / share[0]) if held[0][j] + held[1][j] >= 2 else 0.0
        assert abs(ratios[j] - want) < 1e-9
    weights, bias = quality.dual_coordinate_descent(rows, y, ratios, rounds=2000)
    # the dual by projected gradient on a dense matrix, the bias as a column of ones
    m = np.zeros((60, 41))
    for i, x in enumerate(rows):
        m[i, x] = ratios[x] / max(1.0, np.linalg.norm(ratios[x]))
    m[:, 40] = 1
    m *= np.where(y > 0, 1, -1)[:, None]
    gram, alpha = m @ m.T, np.zeros(60)
    step = 1 / np.linalg.eigvalsh(gram)[-1]
    for _ in range(50_000):
        alpha = np.clip(alpha - step * (gram @ alpha - 1), 0, 1)
    best = m.T @ alpha
    loss = lambda w: 0.5 * w @ w + np.maximum(0, 1 - m @ w).sum()
    got = np.append(weights[:40], bias)
    assert loss(got) <= loss(best) + 1e-3 and np.allclose(got, best, atol=0.02)


def test_labelled_sample_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, words(200, i) if i % 2 else "AA!! BB!! " * 50) for i in range(300)] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    for most in (200 << 20, 60_000):
        model = quality.train(docs, labels, most_bytes=most)
        scores = {r.doc_id: r.predicted for r in quality.score(docs, model).collect()}
        assert all(scores[i] == i % 2 for i in range(300))


def test_quality_on_held_out_rows(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score(docs, quality.train(docs, labels)).join(labels, "doc_id").where("held_out")
    right, n = scored.agg(F.count_if(F.col("predicted") == F.col("quality")), F.count("*")).first()
    assert right / n > 0.95
    lone = quality.train(odd, spark.createDataFrame([(1, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int"))
    rows = quality.score(odd, lone).collect()
    assert len(rows) == len(texts()) and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    assert quality.score(none, lone).count() == 0


# --- 8 personal data


def test_base_spans():
    text = "a.b@c.example.com, 10.0.0.255 or 10.0.0.256; 4539 1488 0343 6467 and +44 (20) 7946-0958."
    assert pii.listed(pii.base_spans(text)) == "email:0:17,ip:19:29,card:45:64,phone:69:87"
    assert pii.base_spans("") == [] and pii.base_spans("year 2024, 1 2 3") == []


def test_skip_chain_labels_repeats(spark):
    rows = [(i, f"call +1 (415) 555-{i:04d} now or 555-{i:04d} later, item {i}") for i in range(1000, 1040)] + [(i, f"+1 (415) 555-{i} and +1 (415) 555-{i} on day {i}") for i in range(2000, 2040)] + [(1, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_personal_data(docs, pii.train(docs)).collect()}
    for i in range(1000, 1040):
        assert got[i].n_phone == 1 and got[i].n_added == 1 and got[i].spans.startswith(f"phone:5:22,phone:{rows[0][1].index(' or ') + 4}:")
        assert got[i].base_sha256 == hashlib.sha256(b"phone:5:22").hexdigest()
    assert got[1].spans == "" and got[None].spans == ""


def test_numbers_of_several_words_are_labelled_whole():
    phone, card = "+1 (017) 555-%04d", "4539 1488 0343 6467"
    learned = [f"call {phone % i} or {phone % i} again, {card} and {card} paid" for i in range(1000, 1030)]
    learned += [f"lot {10**9 + i} of {phone % i} on 12 05 {10**6 + i}" for i in range(1000, 1030)]
    model = pii.fit_potentials(*pii.examples_of([pii.Field(t, pii.base_spans(t)) for t in learned]))
    for text, want in [
        ("at +1 (017) 555-7713 or (017) 555-7713, ask", [("phone", "(017) 555-7713")]),
        ("at 017 555 7713 before +1 (017) 555-7713 came", [("phone", "017 555 7713")]),
        ("in 2024 (017) 555-7713 was +1 (017) 555-7713 still", [("phone", "(017) 555-7713")]),
        ("paid by 4539 1488 0343 6467 and 4539.1488.0343.6467, not 4539 1488 0343 6468", [("card", "4539.1488.0343.6467")]),
        ("paid by 4539 1488 0343 6467, ends with 1488 0343 6467.", [("card", "1488 0343 6467")]),
        ("at +1 (017) 555-7713 or (018) 444-1234, ask", []),
    ]:
        spans = pii.added_spans(text, pii.base_spans(text), model)
        assert [(pii.KINDS[k], text[a:b]) for a, k, b in spans] == want, text


def plain_spans(text):
    """The contract's spans by the plain patterns."""
    import re

    def card(x):
        d = [int(c) for c in x if c.isdigit()]
        total = sum(d[-1::-2]) + sum(sum(divmod(2 * n, 10)) for n in d[-2::-2])
        return 12 <= len(d) <= 19 and total % 10 == 0

    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", card),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= sum(c.isdigit() for c in x) <= 15),
    ]
    found = [(m.start(), k, name, m.end()) for k, (name, p, holds) in enumerate(kinds) for m in re.finditer(p, text) if holds(m[0])]
    return [f"{name}:{a}:{b}" for a, _, name, b in sorted(found)]


def test_personal_data_against_plain_patterns(spark, odd, none):
    r = random.Random(6)
    parts = ["a", "b.c", "@", "_", "%", ".", "-", "+", " ", "(", ")", "\n", "é", "1", "23", "255", "256", "007", "10.0.0.1", "x@y.z", "4539 1488 0343 6467", "4539148803436468", "+44 20 7946 0958", "0" * 30, "٣"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 25)))) for i in range(3000)]
    rows += [(i, t) for i, t in texts()] + [(3000, None)] + rows[:5]
    docs = spark.createDataFrame([(i, t, "v", 1, "z") for i, t in rows], "doc_id long, text string, spans string, n_ip int, example string")
    got = collections.Counter()
    for x in pii.find_personal_data(docs, pii.train(docs)).collect():
        listed = x.spans.split(",") if x.spans else []
        got[x.doc_id, x.n_email, x.n_ip, x.n_card, x.n_phone, x.base_sha256, len(listed) - x.n_added] += 1
    want = collections.Counter()
    for i, t in rows:
        spans = plain_spans(t or "")
        n = [sum(s.startswith(k + ":") for s in spans) for k in pii.KINDS]
        want[i, *n, hashlib.sha256(",".join(spans).encode()).hexdigest(), len(spans)] += 1
        assert pii.listed(pii.base_spans(t or "")) == ",".join(spans), t
    assert got == want
    assert pii.find_personal_data(none, pii.train(none)).count() == 0 and pii.find_personal_data(odd, pii.train(odd)).count() == len(texts())


@pytest.mark.parametrize("text", ["0" * 5000 + ".1.1.1", "7" * 10**6, "ab" * 500_000, "1." * 300_000, "a@" * 200_000, "+1" + "-" * 10**6, "1 " * 200_000, "+1 (017) 555-7713 " * 20_000], ids=range(8))
def test_long_runs_take_no_time(text):
    import time

    model = pii.fit_potentials(*pii.examples_of([]))
    began = time.process_time()
    spans = pii.base_spans(text)
    pii.added_spans(text, spans, model)
    assert time.process_time() - began < 60  # quadratic work takes hours
    if len(text) < 10_000:
        assert pii.listed(spans) == f"ip:0:{len(text)}"


def test_field_finds_what_no_pattern_takes():
    """Values written so that no pattern takes them, in documents of their own; what the patterns refuse stays out."""
    r = random.Random(9)

    def card(valid):
        d = [r.randrange(10) for _ in range(15)]
        last = next(x for x in range(10) if pii.luhn("".join(map(str, d)) + str(x)))
        return "".join(map(str, d)) + str(last if valid else (last + 5) % 10)

    learned = [f"pay {card(True)} of lot {card(False)} by {w}{i}@mail.example.com on {r.randrange(10**6)}" for i, w in enumerate(["ann", "bob", "eve"] * 20)]
    model = pii.fit_potentials(*pii.examples_of([pii.Field(t, pii.base_spans(t)) for t in learned]))
    found, wrong = 0, 0
    for i in range(100):
        paid = card(True)
        dotted = "/".join(paid[j : j + 4] for j in range(0, 16, 4))
        text = f"now {dotted} or joe{i}(@)mail.example.com for {card(False)} in {r.randrange(10**6)}"
        assert pii.base_spans(text) == []
        added = pii.added_spans(text, [], model)
        right = {("card", dotted), ("email", f"joe{i}(@)mail.example.com")}
        got = {(pii.KINDS[k], text[a:b]) for a, k, b in added}
        found, wrong = found + len(got & right), wrong + len(got - right)
    assert found >= 190 and wrong == 0


@pytest.mark.parametrize("text", ["a1 b2@c.example.org d3 44444", "4539 1488 0343 6467 and 1488 0343 6467 or 4539-1488.0343 6468"])
def test_loopy_messages_match_enumeration(text):
    """On a chain, and on a tree of edges between numbers, messages are exact; skip edges of all kinds are among them."""
    field = pii.Field(text, pii.base_spans(text))
    if "and" in text:
        field.chain = []  # what is left has no loop
        assert field.repeat and field.alike
    rng = np.random.default_rng(1)
    tables = [(t + t.T) / 2 for t in rng.normal(size=(4, 5, 5))]
    model = pii.Potentials(rng.normal(size=(pii.FEATURES, 5)), *tables)
    n = len(field.places)
    own = model.unary[field.features].sum(1)
    for i, label in enumerate(field.labels):
        if label != pii.OUTSIDE:
            own[i] = -50
            own[i, label] = 0
    own[field.barred] = -50
    total = np.zeros((n, 5))
    edges = [(a, b, t) for e, t in zip(pii.Potentials.EDGES, tables, strict=True) for a, b in getattr(field, e)]
    touched = {x for a, b, _ in edges for x in (a, b)}
    for labels in np.ndindex(*[5 if i in touched else 1 for i in range(n)]):
        p = np.exp(sum(own[i, labels[i]] for i in touched) + sum(t[labels[a], labels[b]] for a, b, t in edges))
        for i in touched:
            total[i, labels[i]] += p
    got = pii.marginals(field, model, rounds=60)
    for i in touched:
        assert np.allclose(got[i], total[i] / total[i].sum(), atol=1e-3)


# --- 9 SimHash


def brute_components(fps, distance):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fps = sorted(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= distance:
                parent[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_fingerprints_and_components(odd, none):
    got = simhash.near_duplicates(odd).collect()
    fps = {}
    for i, t in texts():
        w = t.encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
        fps[i, t] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert sorted(r.fingerprint for r in got) == sorted(format(fps[k], "016x") for k in texts())
    root = brute_components(set(fps.values()), 4)
    least = {}
    for (i, t), f in fps.items():
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    for r in got:
        assert r.component_id == least.get(root[int(r.fingerprint, 16)])
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one_of_each(odd).collect()
    assert kept[0].__fields__ == odd.columns
    assert {r.doc_id for r in kept} == {1, 3, 6, 7, 8, 9, 10, 11} and len(kept) == 8  # 1 stands for its copies and the one with a tail


def pair_of_similarity(r, n, share):
    """Two texts of n five-word shingles each that share about `share` of all their shingles, and the exact share."""
    base = [f"w{r.randrange(10**6)}" for _ in range(n + 4)]
    other = list(base)
    at = int(n * 2 * share / (1 + share))  # the rest is written anew
    other[at + 4 :] = [f"x{r.randrange(10**6)}" for _ in other[at + 4 :]]
    a, b = ({tuple(t[i : i + 5]) for i in range(n)} for t in (base, other))
    return " ".join(base), " ".join(other), len(a & b) / len(a | b)


def test_near_copies_by_similarity(spark):
    r = random.Random(8)
    rows, shares = [], []
    for i in range(1200):
        low, high = [(0.8, 0.82), (0.85, 0.97), (0.1, 0.6), (0.7, 0.79)][i % 4]
        a, b, share = pair_of_similarity(r, r.randint(60, 400), r.uniform(low, high))
        shares.append(share)
        rows += [(2 * i, a), (2 * i + 1, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {x.doc_id for x in simhash.keep_one_of_each(docs).collect()}
    assert all(2 * i in kept for i in range(1200))  # unrelated ones all stay, and of a pair the first
    linked = np.array([2 * i + 1 not in kept for i in range(1200)])
    alike = np.array(shares) >= 0.8
    assert not linked[~alike].any()  # none by the estimate alone
    assert linked[alike & (np.array(shares) < 0.82)].mean() >= 0.95 and linked[np.array(shares) >= 0.85].mean() >= 0.99


@pytest.mark.parametrize("tile", [4096, 7])
def test_groups_of_near_copies_against_brute_force(spark, monkeypatch, tile):
    """Chains of edits, whose ends have little in common, and groups around one text; tiles cut them, links don't depend on it."""
    monkeypatch.setattr(simhash, "SHARED_TILE", tile)
    r = random.Random(9)
    texts = []
    for g in range(12):
        words = [f"g{g}w{i}" for i in range(120)]
        for _ in range(r.choice([2, 10, 40])):
            texts.append(" ".join(words))
            for _ in range(r.randint(1, 3)):
                words[r.randrange(len(words))] = f"n{r.randrange(10**6)}"
    r.shuffle(texts)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(116)} for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    kept = {x.doc_id for x in simhash.keep_one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(kept) >= len(set(root)) and len(kept - set(root)) <= 0.02 * len(texts)  # none is taken out that stays by brute force
    assert set(root) <= kept


def test_nearest_references_agree_as_stated():
    r = np.random.default_rng(5)
    a = r.standard_normal((1500, 64 * simhash.WORDS)).astype(np.float32)
    cosine = 0.889
    b = cosine * a + np.sqrt(1 - cosine**2) * r.standard_normal(a.shape).astype(np.float32)
    for bits, share in simhash.SAME_NEAREST.items():
        cells = simhash.Cells(bits, 4)
        assert abs((cells(a) == cells(b)).mean() - share) < 0.04
    bits, tables = simhash.cell_bits_for(300_000)
    cells = simhash.Cells(bits, tables)
    assert (cells(a) == cells(b)).any(1).mean() > 0.95
    assert all(simhash.cell_bits_for(10**k)[1] <= 2 * 10 ** (k / 4.5) for k in range(3, 11))  # tables grow slowly


def test_keeping_one_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "p", 7, 8), (1, "a b", 5, "p", 7, 8), (2, "a b", 6, "q", 7, 8), (3, None, 6, "q", 7, 8)], "doc_id int, text string, id int, row string, n int, text_hash int")
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [(1, "a b", 5, "p", 7, 8), (3, None, 6, "q", 7, 8)]


@pytest.mark.parametrize("tile", [2048, 8])
def test_links_lose_nothing(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    r = random.Random(4)
    fps = set()
    for _ in range(40):
        f = r.getrandbits(64)
        for _ in range(r.choice([1, 2, 3, 30])):
            fps.add(f)
            f ^= sum(1 << b for b in r.sample(range(64), r.randint(1, 5)))
    signed = spark.createDataFrame([(simhash._signed(f), simhash._signed(f)) for f in fps], "node long, fp long")
    for n in (10, 10**6, 10**9):  # as if there were so many: other numbers of bands
        got = components(simhash.links_by_bits(signed, 4, n)).collect()
        to = {f: f for f in fps} | {x.node % (1 << 64): x.root % (1 << 64) for x in got}
        want = brute_components(fps, 4)
        assert len(set(to.values())) == len(set(want.values()))
        pairs = {(want[f], to[f]) for f in fps}
        assert len(pairs) == len(set(want.values()))


# --- 10 substring dedup


def test_covers():
    for period, cover in substring_dedup.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@pytest.mark.parametrize("window", [3, 10, 35])
def test_substring_dedup(spark, odd, none, window):
    shared = words(90, 50)
    rows = texts() + [(100 + i, words(20 + i, 60 + i) + " " + shared[i * 3 :].partition(" ")[2] + " " + words(7, 80 + i)) for i in range(12)] + [(200, "x " * 90)]
    docs = spark.createDataFrame([(i, t or None) for i, t in rows], "doc_id long, text string")
    w = [(i, t.encode().split()) for i, t in rows]
    count = collections.Counter(tuple(x[k : k + window]) for _, x in w for k in range(len(x) - window + 1))
    want = []
    for i, x in w:
        gone = {k + d for k in range(len(x) - window + 1) if count[tuple(x[k : k + window])] > 1 for d in range(window)}
        want.append((str(i), len(x), len(gone), hashlib.sha256(b" ".join(v for k, v in enumerate(x) if k not in gone)).hexdigest()))
    got = substring_dedup.remove_repeats(docs, window).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(want)
    assert substring_dedup.remove_repeats(none, window).count() == 0


# --- 1 secrets


def test_trigram_queries_hold_for_matches():
    q = secrets.trigram_query
    assert q("[0-9a-f]{24,}") is None and q("ab|cde") is None and q("(abc)?x") is None
    assert q("abcd") == [frozenset({"abc", "bcd"})]
    assert sorted(map(sorted, q("x(foo|bar)+"))) == [["bar", "xba"], ["foo", "xfo"]]
    assert q("a.?bcd") == [frozenset({"bcd"})]


def test_secret_scan(spark, none):
    import re

    rows = [(1, 'é token = "abcdef123" Secret:abcde password:\'xyzxyz\''), (2, "AKIA" + "A" * 20 + " " + "0af" * 9), (3, None), (4, ""), (None, "secret=token:abcdefgh"), (5, "API_KEY=zzzzzz,apikey : yyyyyy"), (5, "API_KEY=zzzzzz,apikey : yyyyyy"), (6, "-----BEGIN RSA PRIVATE KEY-----"), (7, "".join(f"é{'x' * (i % 5)} token={'a' * (i % 11)} " for i in range(1000)))]
    got = secrets.scan(spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, rules int")).collect()
    want = []
    for i, t in rows:
        t = t or ""
        spans = [(m.start(), k, m.end()) for k, r in enumerate(secrets.RULES) for m in re.finditer(r.pattern, t) if len(m[r.group]) >= r.least]
        name = [r.kind for r in secrets.RULES]
        text = [",".join(f"{name[k]}:{a}:{b}" for a, k, b in sorted(s)) for s in (spans, [s for s in spans if s[1] < 3])]
        want.append((str(i), *(sum(k == n for _, k, _ in spans) for n in range(3)), hashlib.sha256(text[1].encode()).hexdigest(), text[0]))
    assert sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in got) == sorted(want)
    assert secrets.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- all of them


CLASHING = "uid h gp g places known n text_hash row likely _slot _part _bits _key0 rules weight base p blocks block rank times source_size target n_docs features quality example spans carry_0 _source digest copies batch node bits cells first tie fp doc_id_2 items kept size"


def test_very_long_texts_repeated_rows_and_clashing_columns(spark, none):
    """One word of 300,000 letters, texts of 40,000 words, rows that repeat, and extra columns with the names that
    operators use themselves: each result is that of the plain texts."""
    from tokenizers import Tokenizer

    long = words(40_000, 1, 9000)
    rows = [(1, "x" * 300_000, "a"), (2, long, "a"), (3, long + " tail", "b"), (3, long + " tail", "b"), (4, "short text", None), (None, None, "b")]
    extra = CLASHING.split()
    docs = spark.createDataFrame([(*r, *[7] * len(extra)) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"`{c}` long" for c in extra)).repartition(3)
    by = lambda df: sorted(map(tuple, df.collect()), key=lambda r: [(x is not None, x) for x in r])
    bench = spark.createDataFrame([(1, " ".join(long.split()[20_000:20_040])), (2, "y" * 100_000)], "item_id long, text string")

    assert all(r.spans == "" for r in secrets.scan(docs).collect())
    sizes = {1: 1, 2: 40_000, 3: 40_001, 4: 2, None: 0}
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == len(rows) and all(r.size == sizes[r.doc_id] and r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in mixed)
    assert {(r.doc_id, r.n_items) for r in decontamination.find_contamination(docs, bench).collect()} == {(1, 0), (2, 1), (3, 1), (4, 0), (None, 0)}
    for name, count in (("word_bpe_49k.json", lambda p: token_counts.count_tokens(docs, p)), ("byte_bpe_50k.json", lambda p: token_files.encode_and_read_back(docs, p))):
        path = public_tokenizers.path(name)
        whole, end = Tokenizer.from_file(path), int(name.startswith("byte"))
        want = sorted((str(i), len(whole.encode(t or "", add_special_tokens=False).ids) + end) for i, t, _ in rows)
        assert sorted((str(r.doc_id), r.n_tokens) for r in count(path).collect()) == want
    model = quality.train(docs, spark.createDataFrame([(1, 0, 0), (2, 1, 0), (3, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int"), held_out_fold=None)
    assert all(0 <= r.score <= 1 for r in quality.score(docs, model).collect())
    exact = by(exact_dedup.DigestIndex(spark, "index_long", 4).add(docs).select("doc_id", "keep_id", "group_size", "kept"))
    assert exact == [(None, None, 1, True), (1, 1, 1, True), (2, 2, 1, True), (3, 3, 2, False), (3, 3, 2, True), (4, 4, 1, True)]
    assert all(r.spans == "" for r in pii.find_personal_data(docs, pii.train(docs)).collect())
    assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()} == {(1, 1), (2, 2), (3, 2), (4, 4), (None, None)}
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 4, None} and kept.count() == 4
    assert {(r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(docs).collect()} == {(1, 1, 0), (2, 40_000, 40_000), (3, 40_001, 40_001), (4, 2, 0), (None, 0, 0)}


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master, applicationId = "spark://host:7077", "app"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session, "x")
    Session.sparkContext.master = "local[4]"
    assert "/x-" in common.shared_dir(Session, "x")


# --- the pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, kinds = docs, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, before, sf)
        kinds.append(name)
        if i < 4:
            assert out.columns == docs.columns
            path = corpus_pipeline.written(out, f"test-{i}")
            if i < 3:
                assert path.count() <= before.count() and path.join(before, "doc_id", "left_anti").count() == 0
            if i == 1:
                assert simhash.keep_one_of_each(path).count() == path.count()  # nothing is left to take out
            if i == 2:
                bench = spark.read.parquet(f"{sf}/benchmark.parquet")
                assert decontamination.find_contamination(path, bench).where("contaminated").count() == 0
            before = path
        else:
            assert out.count() == before.count()
    assert len(kinds) == 5


def test_pipeline_stages_of_odd_and_empty_tables(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    schema = "doc_id long, text string, lang string, source string, n_chars long, size long, row string"
    odd = spark.createDataFrame([(None, None, None, None, None, 1, "x"), (1, "", "en", "s", 0, 1, "x"), (1, "", "en", "s", 0, 1, "x"), (2, "a b c", "en", None, 5, 1, "x")], schema)
    kept = {"quality classifier": [None, 1, 1, 2], "SimHash near-dedup": [1, 2], "benchmark decontamination": [1, 2], "mixing sources to target weights": [2], "token-ID / binary output": [2]}
    before = odd
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.where("false"), sf).count() == 0
        rows = stage(spark, before, sf)
        assert sorted((r.doc_id for r in rows.collect()), key=str) == sorted(kept[name], key=str)
        if name != "token-ID / binary output":
            assert rows.columns == list(corpus_pipeline.COLUMNS)
            before = corpus_pipeline.written(rows, "odd-stage").withColumns({"size": F.lit(1), "row": F.lit("x")})
