"""Encoding with the tokenizers library, each distinct chunk of text once.

Every alternative of a byte-level BPE's word pattern takes a space only as its first character or within
a run of white space, so a piece always ends before a single space between two other characters. Cutting
there and encoding the chunks gives the ids of the whole text; the tests hold this against whole texts.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_SPACES = re.compile(r"\s\s")
#: A single space between two characters that are not white space.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_AT_ONCE = 500


class Encoder:
    """Texts to little-endian unsigned 32-bit ids. ``most``: chunks held before the table starts afresh."""

    def __init__(self, path: str, most: int = 500_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        self.chunks: dict[str, bytes] = {}  # each with the space before it
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.spaced[[i for s, i in self.tokenizer.get_vocab().items() if s.startswith("Ġ")]] = True

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, plain: set[str], odd: set[str]) -> None:
        """Encode new chunks. Plain ones hold no space, so, many at a time, ids that begin with a space mark where each begins."""
        if "" in plain:
            odd.add("")
        joined = list(plain - odd)
        groups = [joined[i : i + _AT_ONCE] for i in range(0, len(joined), _AT_ONCE)]
        for group, ids in zip(groups, self._batch([" " + " ".join(g) for g in groups]), strict=True):
            bounds = [*np.flatnonzero(self.spaced[ids]).tolist(), len(ids)]
            if len(bounds) != len(group) + 1:  # another kind of vocabulary
                odd.update(group)
                continue
            data = ids.tobytes()
            self.chunks.update(zip(group, [data[4 * a : 4 * b] for a, b in zip(bounds, bounds[1:], strict=False)], strict=True))
        rest = list(odd)
        self.chunks.update(zip(rest, [ids.tobytes() for ids in self._batch([" " + c for c in rest])], strict=True))

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text, as bytes; null counts as empty."""
        if len(self.chunks) > self.most:
            self.chunks.clear()
        get = self.chunks.get
        heads, parts, plain, odd = [], [], set(), set()
        for t in texts:
            t = t or ""
            even = not (_SPACES.search(t) or t[:1].isspace() or t[-1:].isspace())
            head, *part = t.split(" ") if even else _CUT.split(t)
            heads.append(head)
            parts.append(part)
            (plain if even and "<|" not in t else odd).update(set(part).difference(self.chunks))
        if plain or odd:
            self._learn(plain, odd)
        for first, part in zip(self._batch(heads), parts, strict=True):
            yield first.tobytes() + b"".join(list(map(get, part)))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker: a worker runs many tasks, and they share its tables."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
