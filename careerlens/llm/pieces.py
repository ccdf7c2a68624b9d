"""SentencePiece encoding with offsets, and decoding.

A text is normalised through the model's compiled character map: at each place the longest prefix that the map holds is
replaced, anything else is copied by code points, and every normalised byte remembers the source byte where its prefix
began. Spaces become the space mark, and one goes before the text where the model asks for it. Byte-pair merges then
cut the normalised text into pieces (best score first, ties from the left), characters outside the vocabulary become
bytes, and each piece's borders are read off the alignment as a span of bytes of the original text.

Where the map is empty and no piece goes on with a space after another character, a text falls into chunks before
spaces, at line feeds and where a letter meets a sign that no piece has after a letter. Their ids are remembered by the
worker, and the alignment is that of the pieces' own lengths: a mark is one byte of source. All other texts go through
the map whole, with the same result.

Null texts count as empty and have no tokens. Texts of any length are read whole; one chunk of n characters takes
n log n steps. Repeated rows and rows with null ids are encoded like others. An empty table gives an empty result.
Other columns are ignored. Models are byte-pair models without unused pieces.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careerlens.llm.common import columns, worker_cache

MARK = "▁"
MARK_BYTES = MARK.encode()
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BYTE_PAIRS = 2  # the trainer's number for byte-pair models
#: Chunks a worker remembers, and the longest one; they bound memory, not results.
CACHE_CHUNKS, CACHE_CHARS = 800_000, 64
NEVER = float("inf")
LETTER = r"[^\W\d_]"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = raw[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(raw):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}[kind] if kind != 2 else number()
        yield tag >> 3, raw[at:at + size]
        at += size


class CharacterMap:
    """The compiled map: a double-array trie from source strings to places of zero-ended replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.targets = blob[4 + size:]

    def step(self, node: int, byte: int) -> tuple[int, int | None] | None:
        """The node after ``byte`` and the place of a replacement that ends there."""
        at = node ^ byte
        unit = self.units[at] if at < len(self.units) else 0
        if unit & 0x800000FF != byte:
            return None
        at ^= (unit >> 10) << ((unit & 0x200) >> 6)
        return at, self.units[at] & 0x7FFFFFFF if unit >> 8 & 1 else None

    def root(self) -> int:
        return (self.units[0] >> 10) << ((self.units[0] & 0x200) >> 6)

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest prefix of ``raw[at:]`` that the map holds."""
        if not self.units:
            return None
        node, found = self.root(), None
        for i in range(at, len(raw)):
            got = self.step(node, raw[i])
            if got is None:
                break
            node, place = got
            if place is not None:
                found = i + 1 - at, place
        return found and (found[0], self.targets[found[1]:self.targets.index(b"\0", found[1])])


class PieceModel:
    """A model file: vocabulary, normaliser and the encoding and decoding of one text."""

    def __init__(self, raw: bytes):
        self.pieces: list[bytes] = []
        self.types: list[int] = []
        scores: list[float] = []
        trainer: dict = {}
        rules: dict = {}
        for number, value in fields(raw):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append(piece[1])
                scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                self.types.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                rules = dict(fields(value))
        if trainer.get(3, 1) != BYTE_PAIRS or UNUSED in self.types:
            raise ValueError("only byte-pair models without unused pieces are read")
        self.map = CharacterMap(rules.get(2, b""))
        self.dummy, self.squeeze, self.escape = (bool(rules.get(i, 1)) for i in (3, 4, 5))
        self.suffix, fallback = bool(trainer.get(24, 0)), bool(trainer.get(35, 0))
        self.unknown_text = trainer.get(44, " ⁇ ".encode())
        self.unknown = self.types.index(UNKNOWN)
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t in (NORMAL, USER)}
        self.score = {p: scores[i] for p, i in self.ids.items()}
        self.rank = {p.decode(): -scores[i] for p, i in self.ids.items()}
        self.id_of = {p.decode(): i for p, i in self.ids.items()}
        of_byte = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == BYTE}
        self.byte_ids = of_byte if fallback else {}
        self.byte_of = {i: b for b, i in of_byte.items()}
        users = sorted((p for p, t in zip(self.pieces, self.types) if t == USER), key=len, reverse=True)
        self.user = re.compile(b"|".join(map(re.escape, users))) if users else None
        # no merge goes on with a space after another character, with a line feed, or with these after a letter
        pairs = {p[i:i + 2] for p in self.id_of for i in range(len(p) - 1)}
        inner = any(p[1] == MARK != p[0] for p in pairs)
        letter = re.compile(LETTER)
        after = {p[1] for p in pairs if letter.match(p[0])}
        ends = re.escape("".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in after))
        line = "\\n" if not any("\n" in p for p in pairs) else ""
        self.by_chunks = (self.dummy and self.escape and MARK in self.id_of and len(self.byte_ids) == 256
                          and not (self.map.units or self.squeeze or self.suffix or users or inner))
        self.cut = re.compile(f" *{LETTER}++(?![^ {line}{ends}])| *[^ {line}]+| +" + (f"|{line}" if line else ""))
        # what a piece is in a text whose only marks come from spaces
        self.source = [bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(MARK_BYTES, b" ")
                       for i, p in enumerate(self.pieces)]
        self.sizes = np.array([len(p) for p in self.source])
        # of the last byte of a code point that came as bytes: -1 where a byte goes on with one begun before
        lead = lambda b: 1 if b < 0x80 else -1 if b < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
        self.leads = np.array([lead(self.byte_of[i]) if i in self.byte_of else 0 for i in range(len(self.pieces))])
        self.known: dict[str, bytes] = {}

    def prefix(self, raw: bytes, at: int) -> tuple[int, bytes]:
        """How many bytes are read at a place, and what they become."""
        if self.user and (own := self.user.match(raw, at)):
            return len(own[0]), own[0]
        if found := self.map.longest(raw, at):
            return found
        lead = raw[at]
        size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return size, raw[at:at + size]

    def normalised(self, raw: bytes) -> tuple[bytes, list[int]]:
        """The normalised text and, for each of its bytes and its end, the source byte."""
        space = MARK_BYTES if self.escape else b" "
        out, source = bytearray(), []
        at = 0

        def put(some: bytes) -> None:
            out.extend(some)
            source.extend([at] * len(some))

        if self.squeeze:
            while at < len(raw) and (got := self.prefix(raw, at))[1] == b" ":
                at += got[0]
        if at >= len(raw):
            return b"", [0]
        if self.dummy and not self.suffix:
            put(space)
        after_space = self.squeeze
        while at < len(raw):
            size, text = self.prefix(raw, at)
            if after_space:
                text = text.lstrip(b" ")
            if text:
                after_space = self.squeeze and text.endswith(b" ")
                put(text.replace(b" ", space))
            at += size
        if self.squeeze:
            while out.endswith(space):
                at = source[len(out) - len(space)]
                del out[-len(space):], source[-len(space):]
        if self.dummy and self.suffix:
            put(space)
        return bytes(out), source + [at]

    def symbols(self, text: bytes) -> tuple[list[bytes], list[bool]]:
        """Code points and user-defined pieces, and which of them are the latter."""
        out, frozen, at = [], [], 0
        while at < len(text):
            own = self.user.match(text, at) if self.user else None
            if own:
                size = len(own[0])
            else:
                size = 1 if text[at] < 0x80 else 2 if text[at] < 0xE0 else 3 if text[at] < 0xF0 else 4
            out.append(text[at:at + size])
            frozen.append(own is not None)
            at += size
        return out, frozen

    def merged(self, text: bytes) -> list[bytes]:
        """Normalised text to pieces by its best pairs."""
        parts, frozen = self.symbols(text)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int, int]] = []
        score = self.score

        def offer(left: int, right: int) -> None:
            if left >= 0 and right < n and not (frozen[left] or frozen[right]):
                both = parts[left] + parts[right]
                if (value := score.get(both)) is not None:
                    heapq.heappush(heap, (-value, left, right, len(both)))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, left, right, size = heapq.heappop(heap)
            if not parts[left] or not parts[right] or len(parts[left]) + len(parts[right]) != size:
                continue
            parts[left] += parts[right]
            parts[right] = b""
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [p for p in parts if p]

    def merged_short(self, text: str) -> list[str]:
        """As ``merged`` for a short text without user-defined pieces: the ranks of all pairs are kept in a list."""
        parts, rank = list(text), self.rank
        ranks = [rank.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            at = ranks.index(best)
            both = parts[at] + parts[at + 1]
            parts[at:at + 2] = (both,)
            del ranks[at]
            if at:
                ranks[at - 1] = rank.get(parts[at - 1] + both, NEVER)
            if at < len(ranks):
                ranks[at] = rank.get(both + parts[at + 1], NEVER)
        return parts

    def spans(self, raw: bytes) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids of a text's pieces and the span of source bytes of each."""
        text, source = self.normalised(raw)
        ids, out, at, was_unknown = [], [], 0, False
        for piece in self.merged(text):
            begin, end = source[at], source[at + len(piece)]
            at += len(piece)
            found = self.ids.get(piece)
            if found is not None:
                ids.append(found)
                out.append((begin, end))
            elif self.byte_ids:
                ids += [self.byte_ids[b] for b in piece]
                out += [(begin, begin)] * (len(piece) - 1) + [(begin, end)]
            elif was_unknown:
                out[-1] = (out[-1][0], end)
            else:
                ids.append(self.unknown)
                out.append((begin, end))
            was_unknown = found is None and not self.byte_ids
        return ids, out

    def decoded(self, ids: list[int]) -> str:
        out: list[str] = []
        held = bytearray()
        first = self.dummy or self.squeeze

        def flush() -> None:
            at = 0
            while at < len(held):  # a byte outside of a valid code point stands for the replacement character
                lead = held[at]
                size = 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
                try:
                    out.append(held[at:at + size].decode() if size and at + size <= len(held) else "�")
                except UnicodeDecodeError:
                    out.append("�")
                    size = 1
                at += size if out[-1] != "�" or size == 3 and held[at:at + 3] == b"\xef\xbf\xbd" else 1
            held.clear()

        seen = False
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            flush()
            if seen or any(out):
                first = False
            if self.types[i] == CONTROL:
                piece = ""
            elif self.types[i] == UNKNOWN:
                piece = self.unknown_text.decode()
            else:
                piece = self.pieces[i].decode()
                if first and piece.startswith(MARK):
                    piece = piece[1:]
                    seen = not self.squeeze
                piece = piece.replace(MARK, " ")
            out.append(piece)
        flush()
        return "".join(out)

    def chunk(self, text: str) -> bytes:
        """Ids (unsigned 32-bit) of a chunk, without the mark before a text."""
        marked = text.replace(" ", MARK)
        parts = self.merged_short(marked) if len(text) <= CACHE_CHARS else [p.decode() for p in self.merged(marked.encode())]
        try:
            return array("I", [self.id_of[p] for p in parts]).tobytes()
        except KeyError:
            return array("I", [i for p in parts for i in ([self.id_of[p]] if p in self.id_of else
                                                          [self.byte_ids[b] for b in p.encode()])]).tobytes()

    def digest(self, text: str) -> tuple[np.ndarray, str, np.ndarray]:
        """Ids, decoded text, spans (begin, end) of a whole text."""
        if not self.by_chunks or MARK in text:
            ids, spans = self.spans(text.encode())
            return np.array(ids, np.uint32), self.decoded(ids), np.array(spans, np.int64).reshape(-1, 2)
        if not text:
            return np.empty(0, np.uint32), "", np.empty((0, 2), np.int64)
        chunks = self.cut.findall(" " + text)
        known = self.known
        try:
            found = b"".join([known[c] for c in chunks])
        except KeyError:
            if len(known) > CACHE_CHUNKS:
                known.clear()
            new = {c: self.chunk(c) for c in set(chunks) if c not in known}
            known.update((c, x) for c, x in new.items() if len(c) <= CACHE_CHARS)
            found = b"".join([new[c] if c in new else known[c] for c in chunks])
        ids = np.frombuffer(found, np.uint32)
        back = b"".join(map(self.source.__getitem__, ids.tolist()))[1:].decode()
        size, lead = self.sizes[ids], self.leads[ids]
        if (lead > 1).any():
            at = np.flatnonzero(lead > 1)
            size[lead != 0] = lead[lead != 0] == 1
            size[at + lead[at] - 1] = lead[at]
        end = np.cumsum(size)
        return ids, back, np.maximum(np.stack([end - size, end], axis=1) - 1, 0)


def model_of(path: str | None = None) -> PieceModel:
    """The worker's model of a file."""
    path = path or default_model()
    kept = worker_cache("piece-models")
    if path not in kept:
        with open(path, "rb") as file:
            kept[path] = PieceModel(file.read())
    return kept[path]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return columns(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def piece_spans(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, position, id, piece, begin, end (bytes of the original text in UTF-8)."""
    path = model or default_model()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = model_of(path)
        for batch in batches:
            got = [found.digest(t or "") for t in batch["text"]]
            counts = [len(ids) for ids, _, _ in got]
            ids = np.concatenate([np.empty(0, np.uint32)] + [ids for ids, _, _ in got]).astype(np.int32)
            span = np.concatenate([np.empty((0, 2), np.int64)] + [span for _, _, span in got])
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64").repeat(counts).reset_index(drop=True),
                "position": np.concatenate([np.empty(0, np.int64)] + [np.arange(n) for n in counts]), "id": ids,
                "piece": pd.Series([found.pieces[i].decode() for i in ids], dtype=object), "begin": span[:, 0], "end": span[:, 1]})

    return _rows(docs, id_col, text_col).mapInPandas(
        run, "doc_id long, position long, id int, piece string, begin long, end long")


def encoded(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ids."""
    path = model or default_model()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = model_of(path)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"),
                                "ids": [found.digest(t or "")[0].astype(np.int32) for t in batch["text"]]})

    return _rows(docs, id_col, text_col).mapInPandas(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, model: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: doc_id, text. Null ids give an empty text; numbers outside of the vocabulary are an error."""
    path = model or default_model()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = model_of(path)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text": [
                found.decoded([int(i) for i in ids]) if ids is not None else "" for ids in batch["ids"]]})

    rows = columns(rows, doc_id=id_col, ids=ids_col)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInPandas(run, "doc_id long, text string")


def piece_digests(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, spans_crc32 (of the spans' bounds as unsigned 32-bit)."""
    path = model or default_model()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = model_of(path)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids, back, span = found.digest(text or "")
                names = ",".join(map(str, ids.tolist()))
                out.append((doc_id, len(ids), hashlib.sha256(names.encode()).hexdigest(),
                            hashlib.sha256(back.encode()).hexdigest(), zlib.crc32(span.astype("<u4").tobytes())))
            frame = pd.DataFrame(out, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long"
    return _rows(docs, id_col, text_col).mapInPandas(run, kind)
