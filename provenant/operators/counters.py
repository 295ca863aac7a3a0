"""Counters of tokens: what a text costs, and where it may be cut. They travel to executors as plain values."""

from __future__ import annotations

import base64
from collections.abc import Callable
from typing import Any, Protocol

#: Bytes of text that are encoded at once.
PART_BYTES = 1 << 20


class Counter(Protocol):
    def count(self, texts: list[str]) -> list[int]: ...

    def cut(self, text: str, most: int) -> list[str]:
        """Parts of at most `most` tokens, cut between tokens and never within a character."""
        ...


class Estimate:
    """Without a vocabulary: a token for each four bytes begun. Parts have `most` characters, which are no more tokens than that."""

    def count(self, texts: list[str]) -> list[int]:
        return [-(-len(t.encode()) // 4) for t in texts]

    def cut(self, text: str, most: int) -> list[str]:
        return [text[i : i + most] for i in range(0, len(text), most)]


class Vocabulary:
    """Exact, by the content of a tokenizer's file: `tokenizers` JSON, or ranks as tiktoken has them with their pattern."""

    def __init__(self, content: bytes, pattern: str | None = None):
        if pattern:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}
            self._ranks = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        else:
            from tokenizers import Tokenizer

            self._ranks, self._file = None, Tokenizer.from_buffer(content)

    def _borders(self, text: str) -> list[int]:
        """Where tokens begin, in characters; those within a character are left out."""
        if self._ranks:
            starts = self._ranks.decode_with_offsets(self._ranks.encode_ordinary(text))[1]
        else:
            starts = [a for a, _ in self._file.encode(text, add_special_tokens=False).offsets]
        return starts

    def count(self, texts: list[str]) -> list[int]:
        if self._ranks:
            return [len(self._ranks.encode_ordinary(t)) for t in texts]
        found: list[int] = []
        part: list[str] = []
        size = 0
        for i, t in enumerate(texts):
            part.append(t)
            size += len(t)
            if size >= PART_BYTES or i == len(texts) - 1:
                found += [len(e.ids) for e in self._file.encode_batch(part, add_special_tokens=False)]
                part, size = [], 0
        return found

    def cut(self, text: str, most: int) -> list[str]:
        starts, parts, at, i = self._borders(text), [], 0, 0
        while i < len(starts):
            j = i + most
            while i < j < len(starts) and starts[j] <= starts[j - 1]:
                j -= 1  # not within a character
            j = max(j, i + 1)
            while j < len(starts) and starts[j] <= at:
                j += 1  # a character of more tokens than that stays whole
            end = starts[j] if j < len(starts) else len(text)
            parts.append(text[at:end])
            at, i = end, j
        out: list[str] = []
        for part in parts or [text]:  # what begins anew may be encoded in other tokens
            over = self.count([part])[0] > most and len(part) > 1
            out += self.cut(part[: len(part) // 2], most) + self.cut(part[len(part) // 2 :], most) if over else [part]
        return out


def vocabulary_file(path: str, pattern: str | None = None) -> Callable[[], Counter]:
    """A maker of counters: the file is read here, on the driver, and its content goes along."""
    with open(path, "rb") as f:
        content = f.read()
    return _Maker(content, pattern)


class _Maker:
    """Builds its counter once a process."""

    made: dict[Any, Counter] = {}

    def __init__(self, content: bytes, pattern: str | None):
        self.content, self.pattern = content, pattern

    def __call__(self) -> Counter:
        key = (hash(self.content), self.pattern)
        if key not in self.made:
            self.made[key] = Vocabulary(self.content, self.pattern)
        return self.made[key]
