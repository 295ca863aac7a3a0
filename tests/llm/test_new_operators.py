"""License scan, vector codes and spelling variants against brute force, on tables that hold nulls, empty and long texts, ties, repeated
rows, extra columns, and nothing at all; and what was mended in earlier operators."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenant.llm import decontamination, license_rules, licenses, mixing, spelling, token_files, vector_codes

DOCS = "doc_id long, text string, source string, word string, n long, label string, spans string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "s", "w", 1, "l", "x") for i, t in rows], DOCS)


# --- 11 license scan

LICENSED = [
    (1, "Licensed under CC BY-NC 4.0."),
    (2, "// Released under the\n//   MIT\n// License.  MIT license"),
    (3, None),
    (4, ""),
    (5, "mit licenseé, MİT license, apache_license apache-license"),
    (6, "cc by cc by cc"),
    (7, "SPDX-License-Identifier: GPL-3.0-or-later"),
    (8, "GNU General Public License, version 3 or any later version. " * 3),
    (None, "MIT License"),
    (9, "You should have received a copy of the GNU Lesser General Public License along with it"),
    (9, "You should have received a copy of the GNU Lesser General Public License along with it"),
    (10, "plain words " * 30000 + "Apache License"),
    (11, "mit dem bus, und mit der bahn"),
]


def brute_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    base = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    found = []
    line = " " + "  ".join(words) + " "
    for i, rule in enumerate(licenses.RULES):
        for m in re.finditer(rule.pattern, line, re.ASCII):
            found.append((line[: m.start()].count(" ") // 2, line[: m.end()].count(" ") // 2, i))
    kept = [x for x in found if not any(y[2] < x[2] and y[0] <= x[0] and y[1] >= x[1] for y in found)]
    labels = {label for _, label in base} | {licenses.RULES[i].label for *_, i in kept}
    places = [i for i, _ in base]
    return len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), sorted(kept)


def test_license_scan_against_brute_force(spark):
    got = licenses.scan_licenses(docs_of(spark, LICENSED)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in LICENSED)
    want = collections.Counter((str(i), *map(str, brute_licenses(t))) for i, t in LICENSED)
    spans = lambda r: sorted((s.first_word, s.end_word, s.rule) for s in r.spans)
    assert collections.Counter((str(r.doc_id), *map(str, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, spans(r)))) for r in got) == want
    by = {r.doc_id: r for r in got}
    assert by[1].labels == "cc-by,cc-by-nc-4.0" and by[7].labels == "gpl-3.0-or-later" and by[7].score == 1 and by[11].labels == "" and by[3].score == 0
    assert by[6].n_base == 2 and (by[6].first_word, by[6].last_word) == (0, 2) and by[5].n_base == 2
    assert licenses.scan_licenses(docs_of(spark, []).where("false")).count() == 0


def test_suppression_against_all_pairs():
    r = random.Random(2)
    for _ in range(200):
        found = [(a, a + r.randint(1, 6), r.randrange(5)) for a in (r.randrange(12) for _ in range(r.randint(0, 12)))]
        found = list(set(found))
        want = sorted(x for x in found if not any(y[2] < x[2] and y[0] <= x[0] and y[1] >= x[1] for y in found))
        assert licenses.unsuppressed(found) == want


def test_there_are_hundreds_of_rules_and_keywords_are_in_what_they_match():
    assert len(licenses.RULES) > 300
    for rule in licenses.RULES:
        fixed = re.sub(r"\(\?:(?:[^()]|\([^()]*\))*\)(?:\?|\{\d+,\d+\})?", " ", rule.pattern)
        assert rule.keywords and set(rule.keywords) <= set(fixed.split()), rule
    assert license_rules.over_words("a b") == " a  b "


# --- 12 vector codes


def brute_codes(rows, entries, rounds, parts):
    kept = sorted((i is None, i, list(v), label) for i, v, label in rows if v and all(x is not None and np.isfinite(x) for x in v))
    m = [[int(np.floor(1024 * x)) for x in v] for _, _, v, _ in kept]
    w = len(m[0]) // parts
    cut = [[v[p * w : (p + 1) * w] for v in m] for p in range(parts)]
    books = [c[:entries] for c in cut]

    def near(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            groups = collections.defaultdict(list)
            for x in cut[p]:
                groups[near(x, books[p])[0]].append(x)
            books[p] = [[sum(c) // len(groups[e]) for c in zip(*groups[e])] if e in groups else books[p][e] for e in range(len(books[p]))]
    found = [[near(cut[p][i], books[p]) for p in range(parts)] for i in range(len(m))]
    errors = [sum(d for _, d in f) for f in found]
    by_label = collections.Counter()
    for (_, _, _, label), e in zip(kept, errors):
        by_label[label] += e
    return [(k[1], "".join(f"{c:02x}" for c, _ in f), e, by_label[k[3]]) for k, f, e in zip(kept, found, errors)], books


def vectors(n, seed, dim=8, distinct=40):
    r = np.random.default_rng(seed)
    some = r.normal(0, 0.3, (distinct, dim)).astype(np.float32)
    return [(i * 3, [float(x) for x in some[r.integers(distinct)]], int(r.integers(3)) if i % 5 else None) for i in range(n)]


VECTORS = "vec_id long, embedding array<float>, label int, code string, n int, position int"


@pytest.mark.parametrize("entries", [4, 16, 256])
def test_vector_codes_against_brute_force(spark, entries):
    rows = vectors(90, entries) + [(1, None, 1), (2, [None] + [0.1] * 7, 1), (4, [float("nan")] + [0.1] * 7, 1), (5, [float("inf")] + [0.1] * 7, 2), (7, [], 2), (8, [-0.0] * 8, 9), (8, [0.5] * 8, 9), (10, [-0.0001] * 8, None), (None, [0.25] * 8, 1)]
    df = spark.createDataFrame([(*r, "x", 0, 0) for r in rows], VECTORS).repartition(5)
    got = vector_codes.compress(df, entries=entries)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    want, books = brute_codes(rows, entries, 4, 4)
    got = got.collect()
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in got) == sorted((str(i), c, e, x) for i, c, e, x in want)
    import hashlib

    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()}


def test_vector_codes_of_odd_tables(spark):
    none = spark.createDataFrame([], VECTORS)
    assert vector_codes.compress(none).count() == 0 and vector_codes.compress(none).columns[0] == "vec_id"
    odd = spark.createDataFrame([(1, [0.1] * 6, 1, "", 0, 0)], VECTORS)
    with pytest.raises(ValueError, match="divide"):
        vector_codes.compress(odd)
    with pytest.raises(Exception, match="component of"):
        vector_codes.compress(spark.createDataFrame([(1, [1e30] * 8, 1, "", 0, 0)], VECTORS)).collect()
    mixed = spark.createDataFrame([(1, [0.1] * 8, 1, "", 0, 0), (2, [0.1] * 4, 1, "", 0, 0)], VECTORS)
    assert [r.vec_id for r in vector_codes.compress(mixed).collect()] == [1]


@pytest.mark.parametrize("spread", [3, 400, 10**6])
def test_trie_distances_against_all_pairs(spread):
    r = np.random.default_rng(spread)
    parts = np.unique(r.integers(-spread, spread, (3000, 5)), axis=0)
    book = r.integers(-spread, spread, (50, 5))
    book[7] = book[3]
    far = ((parts[:, None, :].astype(np.int64) - book[None]) ** 2).sum(2)
    code, error = vector_codes.nearest(parts, book)
    assert (code == far.argmin(1)).all() and (error == far.min(1)).all()
    shuffled = parts[r.permutation(len(parts))]
    leaves, which = vector_codes.distinct_parts(shuffled)
    assert (leaves == parts).all() and (leaves[which] == shuffled).all()


# --- 13 spelling variants


def brute_variants(rows, least_length, least_count, times, drop):
    counts = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % drop == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= least_length:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= least_count}

    def is_near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [x for x in counts if x != w and is_near(w, x)] for w in counts}
    form = {}
    for w, around in near.items():
        if around:
            best = min(around, key=lambda x: (-counts[x], x))
            if counts[best] >= times * counts[w]:
                form[w] = best
    out = []
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, counts[w], len(near[w]), counts.get(form.get(w))))
    return sorted(out, key=str)


def spelled(seed, n=150):
    r = random.Random(seed)
    stems = ["aaaabb", "aaabbb", "colour", "straße", "énergie", "àÿbcdef", "zzzzzz", "people", "library"]
    rows = []
    for i in range(n):
        words = []
        for _ in range(r.randint(0, 60)):
            w = r.choice(stems[: 1 + int(len(stems) * r.random() ** 2)])
            if r.random() < 0.25:
                at, c = r.randrange(len(w)), r.choice("abeéÿ")
                w = r.choice([w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :]])
            words.append(w.upper() if r.random() < 0.1 else w)
        rows.append((i if i % 9 else None, r.choice([" ", ", ", "1"]).join(words)))
    return [*rows, rows[1], rows[1], (7, None), (8, ""), (9, "people" * 9000 + " library " * 4000)]


@pytest.mark.parametrize("filter_bytes", [32 << 20, 64])
def test_spelling_variants_against_brute_force(spark, filter_bytes):
    rows = spelled(3)
    got = spelling.variants(docs_of(spark, rows), times=2, drop_one_in=7, filter_bytes=filter_bytes)
    want = brute_variants(rows, 6, 5, 2, 7)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert any(f for _, f, *_ in want) and any(r != f for _, f, r, *_ in want if f)  # some forms lead on


def test_spelling_of_nothing(spark):
    assert spelling.variants(docs_of(spark, []).where("false")).count() == 0
    assert spelling.variants(docs_of(spark, [(1, "short few words"), (2, None)])).count() == 0


def test_filters_lose_no_word_and_let_few_others_pass():
    r = np.random.default_rng(1)
    words = np.unique(r.integers(97, 123, (20000, 9)).astype(np.uint8), axis=0)
    hashes = spelling._mixed(spelling.word_sums(words))
    shard = spelling.Shard(9, 0, 1, -(-len(words) * spelling.BITS_A_WORD // 512))
    lanes, mask = shard.lane_masks(hashes)
    shard.lanes = np.zeros(shard.blocks * spelling.BLOCK_LANES, np.uint64)
    shard.lanes[lanes] = mask
    assert len(shard.holds(hashes)) == len(words)
    others = spelling._mixed(spelling.word_sums(r.integers(97, 123, (20000, 9)).astype(np.uint8)))
    assert len(shard.holds(others)) < 0.02 * len(others)


def test_spelling_by_many_shards_and_long_chains(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(20)], "word string, form string")
    got = {r.word: r.root for r in spelling.roots(forms).collect()}
    assert got == {f"w{i}": "w20" for i in range(20)}


# --- what was mended


@pytest.mark.parametrize("few", [10_000, 0])
def test_mixing_meets_targets_beside_very_long_documents(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW_SOURCES", few)
    r = random.Random(5)
    rows = []
    for source in range(6):
        sizes = [max(1, int(r.lognormvariate(4.5, 1))) for _ in range(700)] + [20_000] * (source % 3)
        rows += [(len(rows) + i, "w " * n, f"s{source}") for i, n in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    off = mixing.mix(docs).groupBy("source_size").agg((F.abs(F.sum("taken") - F.max("target")) / F.max("target")).alias("off")).collect()
    assert len(off) == 6 and max(x.off for x in off) <= 0.001


def test_items_in_many_blocks_find_what_one_block_does(spark):
    r = random.Random(6)
    word = lambda: f"w{r.randrange(300)}"
    items = [(i if i % 7 else None, " ".join(word() for _ in range(r.randint(6, 12)))) for i in range(40)]
    rows = [(i if i % 5 else None, " ".join([word() for _ in range(20)] + r.choice(items)[1].split() * (i % 2))) for i in range(60)]
    rows += [rows[3], (70, None)]
    docs, bench = docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(map(str, decontamination.find_contamination(docs, bench, block_bytes=b, carry=("source", "n")).collect())) for b in (1 << 20, 300))
    assert one == many and len(one) == len(rows) and any("contaminated=True" in x for x in one)
    plan = decontamination.find_contamination(docs, bench, block_bytes=300)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan  # each block's pass has ended


def test_token_files_are_read_in_bounded_batches(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    docs = docs_of(spark, [(i, "word " * (i * 37 % 900)) for i in range(50)] + [(50, None)])
    from provenant.llm.common import shared_dir

    manifest = token_files.write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), shared_dir(spark, "bounded"))
    whole = sorted(map(tuple, token_files.read_token_files(manifest).collect()))
    assert sorted(map(tuple, token_files.read_token_files(manifest, ids_per_batch=100).collect())) == whole and len(whole) == 51
