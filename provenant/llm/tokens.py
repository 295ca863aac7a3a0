"""Encoding whole texts piece by piece.

Texts are cut at boundaries that no token crosses, so that the pieces' tokens joined are the text's tokens, and the
tokenizers library encodes each distinct piece once for as long as a worker process remembers it: a memo outlives the
task that began it. Pieces are held in two generations of `most_bytes` each, with their tokens: when the younger is full,
it takes the older's place, and pieces that come again go to the younger. So memory is bounded whatever the length of
texts, but for what one part of a text adds, and pieces that are common stay.

Why the cuts are safe:
* words: the tokenizer drops white space and its pre-tokenizer never joins what white space separates; ASCII
  white space neither composes with other characters nor occurs in special tokens.
* spaced: each pre-token pattern that holds white space begins with it, and look-ahead only concerns the white
  space itself; so a cut between a character that isn't white space and a following space or line feed is safe.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

_SPACED = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_LONE_STOP = re.compile(r"[.,](?<![^\W_][.,])")
_OTHER_SPACE = re.compile(r"[^\S \n]")
_SAFE_CUT = re.compile(r"(?<=\S)(?=[ \n])")


def words_of(text: str) -> list[bytes]:
    """Runs of bytes other than ASCII white space."""
    return text.encode().split()


def spaced_pieces(text: str) -> list[str]:
    """Pieces that begin with the white space before them, stops and commas apart; joined they are the text."""
    if text.split() == text.replace("\n", " ").split(" ") and "\0" not in text:  # single spaces and line feeds only
        cut = text.replace(" ", "\0 ").replace("\n", "\0\n")
        if not _LONE_STOP.search(text):
            cut = cut.replace(".", "\0.").replace(",", "\0,")
        return cut.split("\0")
    return _SAFE_CUT.split(text) if _OTHER_SPACE.search(text) else _SPACED.findall(text)


def by_bytes(texts: Iterable[str], most: int) -> Iterator[list[tuple[int, str]]]:
    """(index of text, part of it) in lists of about `most` characters; long texts are cut before a space or line
    feed that follows another character."""
    batch: list[tuple[int, str]] = []
    size = 0
    for i, text in enumerate(texts):
        at = 0
        while True:
            end = len(text)
            if end - at > most:
                cut = _SAFE_CUT.search(text, at + most)
                end = cut.start() if cut else end
            batch.append((i, text[at:end]))
            size += end - at
            if size >= most:
                yield batch
                batch, size = [], 0
            at = end
            if at >= len(text):
                break
    if batch:
        yield batch


#: What a remembered piece takes beside its own bytes and its tokens'.
ENTRY_BYTES = 150


class PieceMemo(dict):
    """piece -> number of its tokens, for pieces seen lately."""

    def __init__(self, tokenizer_json: str, most_bytes: int = 128 << 20, call_size: int = 1 << 17):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # in the worker: tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.most_bytes, self.call_size, self.held_bytes = most_bytes, call_size, 0
        self.older: dict = {}
        self.vocabulary = json.loads(tokenizer_json)
        added = self.vocabulary.get("added_tokens") or []
        #: a token that parts pieces, if there is one that takes nothing else with it, and what pieces may not hold then
        self.mark = next(((t["content"], t["id"]) for t in added if not any(t.get(k) for k in ("lstrip", "rstrip", "single_word", "normalized"))), None)
        self.barred = re.compile("[" + "".join(re.escape(t["content"][0]) for t in added) + "]") if added else None

    def learn(self, pieces: set) -> None:
        """Have all these pieces in the younger generation; encode those that neither knows, in calls of about call_size."""
        new = [p for p in pieces if p not in self]
        if self.held_bytes + self.size_of(new) > self.most_bytes:
            self.older = dict(self)
            self.clear()
            self.held_bytes, new = 0, list(pieces)
        self.held_bytes += self.size_of(new)
        if self.older:
            self.update((p, self.older[p]) for p in new if p in self.older)
            new = [p for p in new if p not in self]
        ends = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)))
        cuts = np.flatnonzero(np.diff(ends // self.call_size)) + 1
        for at, to in zip([0, *cuts], [*cuts, len(new)], strict=True):
            if at < to:
                self.encode(new[at:to])

    def size_of(self, pieces: list) -> int:
        """Bytes that the pieces and what is remembered of them take, about."""
        return ENTRY_BYTES * len(pieces) + sum(map(len, pieces))

    def encode(self, pieces: list[bytes]) -> None:
        """Pieces are encoded in one text, parted by a special token: the library takes those out before all else and does
        with what is between as with texts of their own. Pieces in which one could begin are texts of their own."""
        texts = {p: p.decode() for p in pieces}
        joined = [p for p, t in texts.items() if not self.barred.search(t)] if self.mark else []
        if joined:
            content, number = self.mark
            ids = np.array(self.tokenizer.encode_batch_fast([content.join(texts.pop(p) for p in joined)], add_special_tokens=False)[0].ids, np.int64)
            places = np.concatenate([[-1], np.flatnonzero(ids == number), [len(ids)]])
            self.update(zip(joined, (np.diff(places) - 1).tolist(), strict=True))
        found = self.tokenizer.encode_batch_fast(list(texts.values()), add_special_tokens=False)
        self.update(zip(texts, map(len, found), strict=True))


class IdMemo(PieceMemo):
    """piece -> its ids as bytes of the given width, for byte-level tokenizers: of those each id stands for a known
    number of bytes, so pieces can be encoded joined, as the text that they would be, and be told apart after."""

    def __init__(self, tokenizer_json: str, kind: np.dtype, **sizes: int):
        super().__init__(tokenizer_json, **sizes)
        self.kind = kind
        lengths = {i: len(t) for t, i in self.vocabulary["model"]["vocab"].items()}  # one character for each byte
        lengths |= {t["id"]: len(t["content"].encode()) for t in self.vocabulary.get("added_tokens") or ()}
        self.lengths = np.zeros(max(lengths) + 1, np.int64)
        self.lengths[list(lengths)] = list(lengths.values())

    def size_of(self, pieces: list[str]) -> int:
        return ENTRY_BYTES * len(pieces) + (4 + self.kind.itemsize) * sum(map(len, pieces))  # a token a character at most, about

    def encode(self, pieces: list[str]) -> None:
        joined = [p for p in pieces if p and p[0] in " \n" and not p[-1].isspace()]
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(joined)], add_special_tokens=False)[0].ids, np.int64)
        ends = np.cumsum(np.fromiter((len(p.encode()) for p in joined), np.int64, len(joined)))
        reached = np.cumsum(self.lengths[ids])
        cuts = np.searchsorted(reached, ends) + 1
        if len(joined) and (reached[-1] != ends[-1] or (reached[cuts - 1] != ends).any()):  # a tokenizer that changes texts
            joined = []
        else:
            flat, width = ids.astype(self.kind).tobytes(), self.kind.itemsize
            edges = [0, *(cuts * width).tolist()]
            self.update(zip(joined, (flat[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)), strict=True))
        others = [p for p in pieces if p not in self]
        for p, e in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False), strict=True):
            self[p] = np.array(e.ids, self.kind).tobytes()


def kept_memo(shared: dict, kind: type[PieceMemo], *args) -> PieceMemo:
    """The worker process's memo for a broadcast {"tokenizer": json}: a process loads a broadcast's value once and
    hands the same object to each of its tasks, so what the memo has learnt in one serves the next."""
    if "memo" not in shared:
        shared["memo"] = kind(shared["tokenizer"], *args)
    return shared["memo"]


def read_tokenizer(path: str) -> str:
    """The JSON of a tokenizer file, to be broadcast: a vocabulary's size bounds it."""
    with open(path, encoding="utf-8") as f:
        return f.read()
