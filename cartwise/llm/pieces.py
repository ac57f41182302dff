"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs, best score first, the
leftmost among equals; the top pair is merged, its two new neighbours enter
the agenda, and so on until no pair is a vocabulary piece. Symbols that are
no piece fall back to their UTF-8 bytes.

A text is cut before every run of spaces. The cut is exact for a vocabulary
in which the space mark never follows another character inside a piece
(``SpaceCutError`` otherwise): then no merge crosses it. A chunk is cut again
between letters and other characters, if the vocabulary has no piece in which
the two meet. Cut chunks repeat, so each worker keeps a bounded table
chunk -> ids. Every chunk that the
agenda encodes is also encoded by the sentencepiece library, batch by batch,
and every decoded text is compared with the library's ``decode(ids)``; a
difference fails the task.

Defined results: null text counts as empty; an empty text has no ids and
decodes to an empty text; repeated rows and ties give equal rows; an empty
table gives an empty table; input columns named like the results are
replaced, all others are kept.
"""

from __future__ import annotations

import heapq
import re
from array import array
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cartwise.llm.batches import add_columns, texts_of, worker_state

SPACE = "▁"
#: Entries of a worker's chunk table; a full table becomes the older generation,
#: from which chunks seen again are taken over. Bounds memory only.
TABLE_SIZE = 300_000
#: Chunks up to this many symbols keep the agenda in a flat list, longer ones in a heap.
FLAT_AGENDA = 48
NO_PAIR = 1 << 30
LETTERS = "A-Za-zÀ-ÖØ-öø-ʯ"
PART = re.compile(f"{SPACE}*[{LETTERS}]+|{SPACE}*[^{LETTERS}{SPACE}]+|{SPACE}+")
MIXED = re.compile(f"[{LETTERS}][^{LETTERS}]|[^{LETTERS}{SPACE}][{LETTERS}]")


class SpaceCutError(ValueError):
    """The vocabulary has pieces with an inner space mark."""


class LibraryMismatch(RuntimeError):
    """The agenda and the sentencepiece library disagree."""


class Merger:
    """Agenda encoder over one vocabulary (``library``: the loaded processor)."""

    def __init__(self, library):
        n = library.get_piece_size()
        self.library = library
        self.id_of: dict[str, int] = {}
        self.byte_id = [-1] * 256
        self.bytes_of: list[bytes] = []
        for i in range(n):
            piece = library.id_to_piece(i)
            if library.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                self.bytes_of.append(bytes([value]))
                continue
            if library.is_control(i) or library.is_unknown(i):
                # ids that encoding never gives; a decoded unknown shows the library's mark
                self.bytes_of.append(" ⁇ ".encode() if library.is_unknown(i) else b"")
                continue
            self.id_of[piece] = i
            self.bytes_of.append(piece.replace(SPACE, " ").encode())
            if SPACE in piece.lstrip(SPACE):
                raise SpaceCutError(piece)
        order = {s: r for r, s in enumerate(sorted({-library.get_score(i) for i in self.id_of.values()}))}
        self.rank = {p: order[-library.get_score(i)] for p, i in self.id_of.items()}
        self.cuts_parts = not any(map(MIXED.search, self.id_of))

    def _rank(self, left: str, right: str) -> int:
        return self.rank.get(left + right, NO_PAIR)

    def merge(self, chunk: str) -> list[str]:
        """The symbols that are left when the agenda is empty."""
        if len(chunk) > FLAT_AGENDA:
            return self._merge_heap(chunk)
        symbols, rank = list(chunk), self.rank.get
        agenda = [rank(a + b, NO_PAIR) for a, b in zip(symbols, symbols[1:])]
        while agenda:
            best = min(agenda)
            if best == NO_PAIR:
                break
            i = agenda.index(best)
            symbols[i] += symbols[i + 1]
            del symbols[i + 1], agenda[i]
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + symbols[i], NO_PAIR)
            if i < len(agenda):
                agenda[i] = rank(symbols[i] + symbols[i + 1], NO_PAIR)
        return symbols

    def _merge_heap(self, chunk: str) -> list[str]:
        symbols: list[str | None] = list(chunk)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[int, int, str, str]] = []

        def enter(i: int, j: int) -> None:
            if i >= 0 and j < n and (r := self._rank(symbols[i], symbols[j])) != NO_PAIR:
                heapq.heappush(agenda, (r, i, symbols[i], symbols[j]))

        for i in range(n - 1):
            enter(i, i + 1)
        while agenda:
            _, i, left, right = heapq.heappop(agenda)
            j = after[i] if symbols[i] is not None else n
            if j >= n or symbols[i] != left or symbols[j] != right:
                continue        # a neighbour was merged meanwhile
            symbols[i], symbols[j] = left + right, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            enter(before[i], i)
            enter(i, after[i])
        return [s for s in symbols if s is not None]

    def encode_chunk(self, chunk: str) -> list[int]:
        ids: list[int] = []
        for s in self.merge(chunk):
            i = self.id_of.get(s)
            if i is None:
                ids.extend(self.byte_id[b] for b in s.encode())
            else:
                ids.append(i)
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``: pieces joined, without the space that
        encoding puts in front."""
        data = b"".join(map(self.bytes_of.__getitem__, ids))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


class PartTable(dict):
    """Part of a chunk -> its ids as packed int32."""

    def __init__(self, merger: Merger):
        super().__init__()
        self.merger = merger

    def __missing__(self, part: str) -> bytes:
        if len(self) > TABLE_SIZE:
            self.clear()
        packed = self[part] = array("i", self.merger.encode_chunk(part)).tobytes()
        return packed


class ChunkTable(dict):
    """Chunk -> its ids as packed int32; a missing chunk is encoded part by
    part and queued for the batch's library check."""

    def __init__(self, merger: Merger):
        super().__init__()
        self.merger, self.parts, self.fresh, self.older = merger, PartTable(merger), [], {}

    def __missing__(self, chunk: str) -> bytes:
        if (known := self.older.get(chunk)) is not None:
            self[chunk] = known
            return known
        marked = SPACE + chunk.replace(" ", SPACE)
        parts = PART.findall(marked) if self.merger.cuts_parts else [marked]
        packed = self[chunk] = b"".join(map(self.parts.__getitem__, parts))
        self.fresh.append((chunk, packed))
        if len(self.fresh) >= 20_000:
            self.check()
        return packed

    def check(self) -> None:
        if self.fresh:
            # a chunk is one space and the text that the library puts it before
            for (chunk, packed), theirs in zip(self.fresh, self.merger.library.encode(
                    [c for c, _ in self.fresh], num_threads=1)):
                # an empty chunk, the bare space before further spaces, is no text for the library
                if chunk and packed != array("i", theirs).tobytes():
                    raise LibraryMismatch(f"{chunk!r}: the library gives {theirs}")
            self.fresh = []
        if len(self) > TABLE_SIZE:
            self.older = dict(self)
            self.clear()


def _chunks(text: str) -> list[str]:
    """The text cut before every run of spaces; each chunk is given without
    its first space (the first chunk's is the one that encoding adds)."""
    parts = text.split(" ")
    if "" not in parts:
        return parts
    out, run = [], 0
    for p in parts:
        if p:
            out.append(" " * run + p)
            run = 0
        else:
            run += 1
    if run:
        out.append(" " * (run - 1))
    return out


def _table(model: bytes) -> ChunkTable:
    import sentencepiece

    return ChunkTable(Merger(sentencepiece.SentencePieceProcessor(model_proto=model)))


def _encode_batches(model, text_at: int):
    table = worker_state(("pieces", model.value), partial(_table, model.value))
    merger = table.merger

    def fn(batch: pa.RecordBatch) -> list[pa.Array]:
        packed, offsets, texts = [], [0], []
        for text in texts_of(batch.column(text_at)):
            own = b"".join(map(table.__getitem__, _chunks(text.replace(SPACE, " ")))) if text else b""
            packed.append(own)
            offsets.append(offsets[-1] + len(own) // 4)
            ids = np.frombuffer(own, dtype=np.int32).tolist()
            decoded = merger.decode(ids)
            if decoded != merger.library.decode(ids):
                raise LibraryMismatch(f"decode of {len(ids)} ids")
            texts.append(decoded)
        table.check()
        flat = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(packed))])
        return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat),
                pa.array(texts, pa.string())]
    return fn


def encode_decode(df: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """``df`` with ``piece_ids array<int>`` (no begin or end id, no sampling)
    and ``decoded string`` (the text of those ids). One map over the table,
    no shuffle. The vocabulary file, of fixed size, is broadcast."""
    with open(model_path, "rb") as f:
        model = df.sparkSession.sparkContext.broadcast(f.read())
    fields = [T.StructField("piece_ids", T.ArrayType(T.IntegerType())),
              T.StructField("decoded", T.StringType())]
    return add_columns(df, fields, partial(_encode_batches, model, df.columns.index(text_col)))
