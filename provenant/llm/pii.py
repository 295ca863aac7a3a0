"""Personal data: patterns, and a skip-chain conditional random field that makes labels consistent in a document.

Patterns give the base spans: e-mail and IP addresses, card and phone numbers. The field's nodes are the words that
hold a digit or an at sign. Chain edges join neighbours; skip edges join each word to the last one before it with
the same key, its letters and digits without other signs, so repeated and similarly written words share a potential
and edges grow with the text, not with its square. Nodes within base spans are observed; loopy sum-product passes
their labels on. Base spans always stay.

Numbers of several words are nodes too: card and phone numbers that were found, and each maximal run of digit groups
between base spans that have only white space and the signs of numbers between (cut where a part of it is a number of
the document). Their key is all their digits; skip edges join keys of seven or more digits of which one ends with the
other, by tables of the endings that occur in the document, and others join keys that differ in one digit, by tables
of keys with a digit left out. A run that becomes a span takes the place of its words.

What is to be found out: nodes outside base spans that are numbers or hold an at sign, in every document, and words that skip
edges join to a base span. A node's own features don't follow the patterns' way of writing: how many digits it has, whether they
pass the check sum, which signs and whether letters occur, whether four parts are at most 255, what word comes before.
So a card number written with dots or an address with two at signs, which no pattern takes, can be labelled by what it
has in common with those that patterns took. A node that nothing joins to a base span needs a marginal of `least_alone`, others
`least`.

The potentials are fitted by pseudo-likelihood to the nodes of a bounded sample of documents (`most_documents`, those whose ids
have the smallest hashes, and of their nodes at most `most_nodes`, chosen alike): base spans stand for labels, each
to be told from its features and its neighbours with its own label hidden, and what no pattern takes stands for
others; only words and numbers that are joined to base spans without being in one are left out. Nothing but the patterns and the
documents is needed. Inference reads every whole text, a document at a time, without shuffles.

Defined results: a null text is empty and has no spans; repeated rows are tagged each; other columns are ignored;
empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_or_empty

#: Kinds in the order in which spans at one start are listed.
KINDS = ("email", "ip", "card", "phone")
OUTSIDE = len(KINDS)
FEATURES = 1 << 12

# The patterns of the contract, written so that no run of signs is gone through again from each of its
# places. A match of "ip" can only begin where a run of digits does; an address's local part is what stands before an
# at sign, back to the end of the match before it.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_PATTERNS = {
    "email": re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[^\W\d_]")
_NODE = re.compile(r"[^\x20\x09-\x0D]+")
_KEY = re.compile(r"[^0-9A-Za-z]+")
_NODE_SIGN = re.compile(r"[0-9@]")
#: A run's digit groups stand free of letters and at signs; what may be between two of them.
_GROUP = re.compile(r"(?<![^\W_])(?<!@)[0-9]+(?![^\W_])(?!@)")
_BETWEEN = re.compile(r"[\s().\-/\u2010-\u2015]+")
LEAST_ENDING = 7
#: Numbers of more digits are not compared with those that differ in one.
MOST_ALIKE = 24
#: A run of more digits than the first is several numbers, each of up to the second if it has several groups.
MOST_DIGITS, USUAL_DIGITS = 19, 16
SAME_NUMBER, ALIKE = 5.0, 0.5
N_FEATURES = 8
_EDGE_SIGNS = "()[]{}<>.,;:!?\"'*#$%&"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _holds(kind: str, found: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(part) <= 3 and int(part or "0") <= 255 for part in (p.lstrip("0") for p in found.split(".")))
    digits = _digits(found)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted: leftmost matches per kind that don't overlap, less those that don't hold."""
    if not _NODE_SIGN.search(text):
        return []
    found = []
    for number, kind in enumerate(KINDS):
        if kind == "email" and "@" not in text or kind == "phone" and "+" not in text:
            continue
        matches = _addresses(text) if kind == "email" else (m.span() for m in _PATTERNS[kind].finditer(text))
        found += [(a, number, b) for a, b in matches if _holds(kind, text[a:b])]
    return sorted(found)


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _PATTERNS["email"].match(text, at)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _shape(word: str) -> str:
    return re.sub(r"(.)\1{3,}", r"\1\1\1", re.sub(r"[A-Za-z]", "a", re.sub(r"[0-9]", "9", word[-40:])))[:8]


def features_of(text: str, before: str) -> list[int]:
    """Numbers of a node's features: of its digits, signs and parts, and of the word before it."""
    digits = _digits(text)
    n = min(len(digits), 20)
    letters = bool(_LETTER.search(text))
    round_signs = "(" in text and ")" in text
    check = "none" if not 12 <= n <= 19 else str(luhn(digits))
    parts = text.split(".") if len(text) <= 40 else []
    quad = len(parts) == 4 and all(p.isascii() and p.isdigit() and _holds("ip", p) for p in parts)
    tail = text[text.rfind("@") + 1 :] if "@" in text else ""
    plus = "+" in text[:2]
    names = ("bias", f"n{n}{letters}", f"c{check}{letters}", f"p{plus}{letters}{9 <= n <= 15}", f"r{round_signs}{n}{letters}", f"q{quad}", f"e{bool(tail)}{'.' in tail.strip('.')}", f"b{_shape(before)}")
    return [zlib.crc32(name.encode()) % FEATURES for name in names]


def number_runs(text: str, spans: list[tuple[int, int, int]], keys: set[str]) -> list[tuple[int, int, str]]:
    """(start, end, digits) of the runs of digit groups outside `spans`, in order. Where groups of a run end with one of `keys`, or are an
    ending of one, they are a run of their own: the longest ending, or else the fewest groups that hold a key."""
    endings = {k[i:] for k in keys for i in range(len(k) - LEAST_ENDING + 1)}
    lengths = sorted({len(k) for k in keys})
    runs: list[list[tuple[int, int]]] = []
    at = last = 0
    for m in _GROUP.finditer(text):
        a, b = m.span()
        while at < len(spans) and spans[at][2] <= a:
            last, at = max(last, spans[at][2]), at + 1
        if any(start < b and end > a for start, _, end in spans[at : at + len(KINDS)]):
            continue
        if runs and runs[-1][-1][1] >= last and _BETWEEN.fullmatch(text, runs[-1][-1][1], a):
            runs[-1].append((a, b))
        else:
            runs.append([(a, b)])
    out = []

    def add(groups: list[tuple[int, int]]) -> None:
        digits = "".join(text[a:b] for a, b in groups)
        if len(digits) > MOST_DIGITS and len(groups) > 1:  # more than one number: as many groups together as one may have
            at, n = 0, 0
            for i, (a, b) in enumerate(groups):
                if i > at and n + b - a > USUAL_DIGITS:
                    add(groups[at:i])
                    at, n = i, 0
                n += b - a
            add(groups[at:])
        elif len(digits) >= LEAST_ENDING:
            a, b = groups[0][0], groups[-1][1]
            if text[a - 1 : a] == "(" and ")" in text[a:b]:
                a -= 1
            out.append((a - (text[a - 1 : a] == "+"), b, digits))

    for groups in runs:
        j = rest = len(groups)
        while j and lengths:
            digits, ending, holds, i = "", None, None, j
            while i and len(digits) < lengths[-1]:
                i -= 1
                digits = text[slice(*groups[i])] + digits
                if digits in endings:
                    ending = i
                elif holds is None and any(digits[-n:] in keys for n in lengths if n <= len(digits)):
                    holds = i
            first = ending if ending is not None else holds
            if first is None:
                j -= 1
                continue
            if j < rest:
                add(groups[j:rest])
            add(groups[first:j])
            j = rest = first
        if rest:
            add(groups[:rest])
    return sorted(out)


class Field:
    """One document's nodes, edges and observed labels."""

    def __init__(self, text: str, spans: list[tuple[int, int, int]]):
        self.places, keys, feats, self.chain, self.skip, self.repeat, self.alike = [], [], [], [], [], [], []
        last_seen: dict[str, int] = {}
        before, n_before = "", -2
        for n, m in enumerate(_NODE.finditer(text)):
            word = m[0]
            if _NODE_SIGN.search(word):
                core = word.strip(_EDGE_SIGNS)
                start = m.start() + word.find(core) if core else m.start()
                i, key = len(keys), _KEY.sub("", core).lower()
                self.places.append((start, start + len(core) if core else m.end()))
                keys.append(key)
                feats.append(features_of(core, before))
                if n_before == n - 1 and i:
                    self.chain.append((i - 1, i))
                if len(key) >= 5:  # shorter ones recur by chance
                    if key in last_seen:
                        self.skip.append((last_seen[key], i))
                    last_seen[key] = i
                n_before = n
            before = word
        #: from here on nodes are numbers of several words
        self.n_words = len(keys)
        self.labels = np.full(len(keys), OUTSIDE)
        at = 0
        for i, (a, b) in enumerate(self.places):
            while at < len(spans) and spans[at][2] <= a:
                at += 1
            for start, kind, end in spans[at:]:
                if start >= b:
                    break
                if end > a:
                    self.labels[i] = kind
                    break
        self._add_numbers(text, spans, feats)
        self.features = np.array(feats, np.int64).reshape(len(self.places), N_FEATURES)
        group = list(range(len(self.places)))

        def top(i: int) -> int:
            while group[i] != i:
                group[i] = i = group[group[i]]
            return i

        for a, b in self.skip + self.repeat:
            group[top(b)] = top(a)
        group = [top(i) for i in group]
        marked: dict[int, set[int]] = {}
        for i in np.flatnonzero(self.labels != OUTSIDE):
            marked.setdefault(group[i], set()).add(int(self.labels[i]))
        outside = self.labels == OUTSIDE
        #: outside all base spans, but joined by skip edges to a node within one
        self.joined = outside & np.array([g in marked for g in group], bool).reshape(len(group))
        stands = np.array([i >= self.n_words or "@" in text[a:b] for i, (a, b) in enumerate(self.places)], bool)
        #: what is to be found out
        self.open = self.joined | (outside & stands)
        #: labels that a node can't have: a joined one repeats a number or word of the kinds it is joined to, or is outside
        self.barred = np.zeros((len(self.places), OUTSIDE + 1), bool)
        for i in np.flatnonzero(self.joined):
            self.barred[i, [k for k in range(OUTSIDE) if k not in marked[group[i]]]] = True

    def _add_numbers(self, text: str, spans: list[tuple[int, int, int]], feats: list[list[int]]) -> None:
        numbers, end_before = [], 0
        for a, kind, b in spans:
            if KINDS[kind] in ("card", "phone") and a >= end_before and len(digits := _digits(text[a:b])) >= LEAST_ENDING:
                numbers.append((a, b, digits, kind))
                end_before = b
        numbers += [(a, b, digits, OUTSIDE) for a, b, digits in number_runs(text, spans, {n[2] for n in numbers})]
        lengths = sorted({len(n[2]) for n in numbers})
        same: dict[str, int] = {}  # the last node with just these digits
        ends: dict[tuple[str, bool], int] = {}  # the last longer one that ends with them, in base spans and outside
        masked: dict[str, int] = {}  # the last node with these digits but for one
        labels = []
        for a, b, digits, kind in sorted(numbers):
            i = len(self.places)
            endings = [digits[-n:] for n in lengths if n <= len(digits)]
            met = {same[e] for e in endings if e in same} | {ends[e] for base in (True, False) if (e := (digits, base)) in ends}
            self.repeat += [(m, i) for m in sorted(met)]
            same[digits] = i
            for e in endings[:-1]:
                ends[e, kind != OUTSIDE] = i
            if len(digits) <= MOST_ALIKE:
                keys = [f"{digits[:j]}_{digits[j + 1 :]}" for j in range(len(digits))]
                self.alike += [(m, i) for m in sorted({masked[k] for k in keys if k in masked} - met)]
                masked |= dict.fromkeys(keys, i)
            before = text[max(0, a - 40) : a].split()
            self.places.append((a, b))
            labels.append(kind)
            feats.append(features_of(text[a:b], before[-1] if before else ""))
        self.labels = np.concatenate([self.labels, np.array(labels, np.int64)])


class Potentials:
    """Log potentials: of features by label, of neighbouring labels, and of labels joined by the edges of same words,
    of same endings of numbers and of numbers that differ in a digit. The last two are fitted from a start that favours equal
    labels anyway: seven digits don't agree by chance."""

    EDGES = ("chain", "skip", "repeat", "alike")

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray, repeat: np.ndarray | None = None, alike: np.ndarray | None = None):
        same = 2 * np.eye(OUTSIDE + 1) - 1
        self.unary, self.chain, self.skip = unary, chain, skip
        self.repeat = SAME_NUMBER * same if repeat is None else repeat
        self.alike = ALIKE * same if alike is None else alike

    def all(self) -> tuple[np.ndarray, ...]:
        return self.unary, *(getattr(self, e) for e in self.EDGES)


def _neighbour_counts(field: Field, edges: list[tuple[int, int]]) -> np.ndarray:
    counts = np.zeros((len(field.places), OUTSIDE + 1))
    for a, b in edges:
        for x, y in ((a, b), (b, a)):
            if not field.joined[y]:
                counts[x, field.labels[y]] += 1
    return counts


def examples_of(fields: list[Field]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """features (n, N_FEATURES), labels (n), neighbours' labels by kind of edge (n, edges, labels) of the nodes whose label is known. A
    joined node's isn't: it tells nothing, neither itself nor to its neighbours."""
    fields = [f for f in fields if len(f.places)]
    if not fields:
        return np.zeros((0, N_FEATURES), np.int64), np.zeros(0, np.int64), np.zeros((0, len(Potentials.EDGES), OUTSIDE + 1))
    known = ~np.concatenate([f.joined for f in fields])
    near = [np.concatenate([_neighbour_counts(f, getattr(f, e)) for f in fields])[known] for e in Potentials.EDGES]
    return np.concatenate([f.features for f in fields])[known], np.concatenate([f.labels for f in fields])[known], np.stack(near, 1)


def fit_potentials(x: np.ndarray, y: np.ndarray, near: np.ndarray, weight: np.ndarray | None = None, rounds: int = 120, rate: float = 0.5, ridge: float = 1e-4) -> Potentials:
    """Maximise the pseudo-likelihood of examples, each label given its node's features and its neighbours' labels, by
    full-batch gradient steps of per-weight size; weight is how often an example occurs."""
    k = OUTSIDE + 1
    weights = list(Potentials(np.zeros((FEATURES, k)), np.zeros((k, k)), np.zeros((k, k))).all())
    if not len(y):
        return Potentials(*weights)
    weight = np.ones(len(y)) if weight is None else weight
    share = (weight / weight.sum())[:, None]
    truth = np.eye(k)[y]
    starts = [w.copy() for w in weights]
    squares = [np.full_like(w, 1e-8) for w in weights]
    for _ in range(rounds):
        logits = weights[0][x].sum(1) + sum(near[:, e] @ w for e, w in enumerate(weights[1:]))
        p = np.exp(logits - logits.max(1, keepdims=True))
        error = (p / p.sum(1, keepdims=True) - truth) * share
        unary = np.zeros_like(weights[0])
        for column in range(x.shape[1]):
            np.add.at(unary, x[:, column], error)
        for w, start, s, g in zip(weights, starts, squares, (unary, *(near[:, e].T @ error for e in range(near.shape[1]))), strict=True):
            g = g + ridge * (w - start)
            s += g * g
            w -= rate * g / np.sqrt(s)
    return Potentials(weights[0], *((w + w.T) / 2 for w in weights[1:]))


def marginals(field: Field, model: Potentials, rounds: int = 12, damping: float = 0.3) -> np.ndarray:
    """Label marginals by loopy sum-product in log space; nodes in base spans are held to their labels."""
    n, k = len(field.places), OUTSIDE + 1
    own = model.unary[field.features].sum(1)
    seen = field.labels != OUTSIDE
    own[seen] = -50.0
    own[seen, field.labels[seen]] = 0.0
    own[field.barred] = -50.0
    edges = [(a, b, i) for i, e in enumerate(Potentials.EDGES) for a, b in getattr(field, e)]
    if not edges:
        p = np.exp(own - own.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)
    source = np.array([e for a, b, _ in edges for e in (a, b)])
    target = np.array([e for a, b, _ in edges for e in (b, a)])
    kind = np.repeat([i for _, _, i in edges], 2)
    tables = np.stack(model.all()[1:])  # symmetric
    back = np.arange(len(source)) ^ 1
    message, new = np.zeros((len(source), k)), np.empty((len(source), k))
    for _ in range(rounds):
        belief = own.copy()
        np.add.at(belief, target, message)
        free = belief[source] - message[back]
        for label in range(k):  # label by label: memory stays a few rows an edge
            out = free + tables[kind, :, label]
            top = out.max(1)
            new[:, label] = top + np.log(np.exp(out - top[:, None]).sum(1))
        new -= new.max(1, keepdims=True)
        message = damping * message + (1 - damping) * new
    belief = own.copy()
    np.add.at(belief, target, message)
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def added_spans(text: str, spans: list[tuple[int, int, int]], model: Potentials, least: float = 0.8, least_alone: float = 0.9) -> list[tuple[int, int, int]]:
    """Spans that the field adds to the base spans."""
    if not spans and not _NODE_SIGN.search(text):
        return []
    field = Field(text, spans)
    if not field.open.any():
        return []
    p = marginals(field, model)
    added: list[tuple[int, int, int]] = []
    found = np.flatnonzero(field.open & (p.argmax(1) != OUTSIDE) & (p.max(1) >= np.where(field.joined, least, least_alone)))
    numbers = [i for i in found if i >= field.n_words]
    starts = [field.places[i][0] for i in numbers]
    for i in found:
        a, b = field.places[i]
        if i < field.n_words:
            n = bisect_right(starts, a) - 1
            if n >= 0 and b <= field.places[numbers[n]][1]:
                continue  # a word of a number that is added whole
        added.append((a, int(p[i].argmax()), b))
    return added


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def train(docs: DataFrame, most_documents: int = 10_000, most_nodes: int = 200_000) -> Potentials:
    """Potentials from the nodes of a bounded sample of documents. Texts stay on the executors; what comes to the driver
    is one row for each different example, with its number."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    sample = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_documents)

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text").to_pylist():
                x, y, near = examples_of([Field(text, base_spans(text))])
                flat = np.concatenate([x, y[:, None], near.reshape(len(y), -1)], 1).astype("<i4")
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in flat], pa.binary())], ["example"])

    held = rows.where("text rlike '[0-9@]'").join(F.broadcast(sample), "doc_id", "left_semi")
    found = held.mapInArrow(examples, "example binary").groupBy("example").agg(F.count("*").alias("n"))
    chosen = sorted((bytes(r[0]), r[1]) for r in found.orderBy(F.xxhash64("example"), "example").limit(most_nodes).collect())
    flat = np.frombuffer(b"".join(e for e, _ in chosen), "<i4").reshape(len(chosen), N_FEATURES + 1 + len(Potentials.EDGES) * (OUTSIDE + 1))
    near = flat[:, N_FEATURES + 1 :].reshape(len(chosen), len(Potentials.EDGES), OUTSIDE + 1).astype(float)
    return fit_potentials(flat[:, :N_FEATURES].astype(np.int64), flat[:, N_FEATURES].astype(np.int64), near, np.array([n for _, n in chosen], float))


def find_personal_data(docs: DataFrame, model: Potentials) -> DataFrame:
    """One row per row of `docs`: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model.all())

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Potentials(*shared.value)
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            digests, all_spans, n_added = [], [], []
            for text in batch.column("text").to_pylist():
                spans = base_spans(text)
                more = added_spans(text, spans, model)
                kinds = [k for _, k, _ in spans]
                for k, c in enumerate(counts):
                    c.append(kinds.count(k))
                base = listed(spans)
                digests.append(hashlib.sha256(base.encode()).hexdigest())
                all_spans.append(listed(spans + more) if more else base)
                n_added.append(len(more))
            columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(all_spans, pa.string()), pa.array(n_added, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(tag, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
