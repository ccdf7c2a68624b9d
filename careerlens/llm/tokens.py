"""Token ids of whole texts, with a per-worker cache of the ids of space-delimited chunks.

The byte-level BPE vocabulary splits a text into pre-tokens before merging, and a space between two other characters
that are not blank always begins a pre-token. So the ids of a text are the ids of its first chunk followed by those of
every further chunk with its leading space; chunks recur, and each is encoded once per worker. A line feed between two
characters that are not blank is a pre-token of its own, so chunks end there too and the next one begins with it. Texts
with other blanks at a space, or with a special token in them, are encoded whole.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

from careerlens.llm.common import worker_cache

#: Chunks a worker gathers before it forgets those that were not met since the last time. It bounds memory, not results.
CACHE_CHUNKS = 300_000
LINE_END = re.compile(r"\n(?<=\S\n)(?=\S)")


def byte_signs() -> dict[int, int]:
    """The characters that stand for bytes in the vocabulary: printable ones for themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: 256 + i for i, b in enumerate(rest)}


BYTE_SIGNS = byte_signs()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class BlankEdge(Exception):
    """A chunk that is empty or has a blank at an end."""


class Chunks(dict):
    """Ids of the chunks met so far; others are worked out as they are asked for."""

    def __init__(self, ids_of: Callable[[str], bytes]):
        super().__init__()
        self.ids_of = ids_of
        self.before: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        found = self.before.get(chunk) or self.ids_of(chunk)
        if len(self) >= CACHE_CHUNKS:
            self.before = dict(self)
            self.clear()
        self[chunk] = found
        return found


class ChunkEncoder:
    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = Chunks(self.chunk)
        self.model = self.tokenizer.model
        self.marks = {c: self.whole(c) for c in ".,;:!?"}
        self.line_end = self.whole("\n")

    def word(self, word: str, start: str = "\u0120") -> bytes:
        """Ids of a space (``start``) and letters, which are one pre-token: straight from the merges, byte by byte as they
        know them."""
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_SIGNS)
        return array("I", [t.id for t in self.model.tokenize(start + shown)]).tobytes()

    def chunk(self, chunk: str) -> bytes:
        """Ids of a chunk: after a space, or from a line feed on."""
        if chunk.isalpha():
            return self.word(chunk)
        if not chunk or chunk[-1].isspace():
            raise BlankEdge
        mark = self.marks.get(chunk[-1], b"")
        plain = chunk[:-1] if mark else chunk
        if chunk[0] == "\n":
            if plain[1:].isalpha():
                return self.line_end + self.word(plain[1:], "") + mark
            return self.whole(chunk)
        if chunk[0].isspace():
            raise BlankEdge
        return (self.known.get(plain) or self.word(plain)) + mark if plain.isalpha() else self.whole(" " + chunk)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of ``text``."""
        if " \n" in text or any(s in text for s in self.special):
            return self.whole(text)
        first, *rest = (LINE_END.sub(" \n", text) if "\n" in text else text).split(" ")
        if not rest or not first or first[-1].isspace():
            return self.whole(text)
        try:
            return self.whole(first) + b"".join(map(self.known.__getitem__, rest))
        except BlankEdge:
            return self.whole(text)


def encoder(path: str | None = None) -> ChunkEncoder:
    """The worker's encoder for a vocabulary file."""
    path = path or default_vocabulary()
    kept = worker_cache("encoders")
    if path not in kept:
        kept[path] = ChunkEncoder(path)
    return kept[path]
