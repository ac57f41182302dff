"""Token counts through a two-tier table of pre-token lengths.

A text's token count is the sum of its pre-tokens' counts. Tier one is a
compact table of frequent pre-tokens and their lengths, broadcast. It covers
all rows: each task keeps a heavy-hitter summary of its pre-tokens, of at most
``FREQUENT`` entries whatever it reads, and the summaries are merged in a
tree, whole tables at a time. Tier two is each worker's own bounded table of
the other pre-tokens it has met; the tokenizer library's model encodes those
that are in neither. So pre-tokens are never shuffled, and the summaries only
decide which lengths are at hand first, never a count.

Pre-tokens are cut as the vocabulary file says: special strings first, then
normalisation (NFC, white space, lower case) and the file's pattern. Texts of
``PLAIN`` characters, for which Python's lower case and character classes are
the library's, are cut here; all others by the library's own normaliser and
pre-tokenizer.

Defined results: null text counts as empty; an empty text has no tokens;
special strings inside a text are one token each, as the library's default
has it; nothing is truncated or padded; repeated rows and ties give equal
rows; an empty table gives an empty table; input columns named like the
results are replaced, all others are kept.
"""

from __future__ import annotations

import json
import re
from array import array
from collections import Counter
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwise.llm.batches import add_columns, map_batches, texts_of, worker_state
from cartwise.plans.materialize import materialize

#: Entries of a summary: a pre-token that is more than one in so many of all is sure to be in it.
FREQUENT = 16_384
#: Summaries that are merged in one go.
MERGED = 32
#: Entries of a worker's own table before it starts over; bounds memory only.
TABLE_SIZE = 400_000
LIMIT = 2_048

LETTER = "a-zß-öø-ÿĀ-ſ"
PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-įı-ſ“”‘’–—…€£§°«»¿¡]*")
#: The pattern of the vocabulary file, for lower-cased PLAIN characters.
CUT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[0-9]|[^\\s{LETTER}0-9]+")
#: What the file must say for this cut to be the right one.
EXPECTED_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
EXPECTED_NORMALIZERS = ["NFC", "Replace", "Lowercase"]


def check_vocabulary(vocabulary: str) -> None:
    """Refuse a vocabulary whose texts are cut by other rules."""
    spec = json.loads(vocabulary)
    cut = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"].get("Regex")
    normal = [n["type"] for n in spec["normalizer"]["normalizers"]]
    if cut != EXPECTED_PATTERN or normal != EXPECTED_NORMALIZERS or spec["model"].get("dropout"):
        raise ValueError("the vocabulary file cuts texts by other rules than this operator's")


class Cutter:
    """Texts to pre-tokens, special strings apart."""

    def __init__(self, library):
        self.library = library
        added = [t.content for t in library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None

    def cut(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and the number of special strings."""
        if self.special and "<" in text and (n := len(self.special.findall(text))):
            return [w for part in self.special.split(text) for w in self._cut(part)], n
        return self._cut(text), 0

    def _cut(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text):
            return CUT.findall(text.lower())
        normal = self.library.normalizer.normalize_str(text)
        return [normal[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(normal)]


class Lengths(dict):
    """pre-token -> number of tokens; holds the broadcast tier and what this
    worker has met besides."""

    def __init__(self, library, frequent: dict[str, int]):
        super().__init__(frequent)
        self.model, self.frequent = without_normalizer(library), frequent

    def __missing__(self, word: str) -> int:
        if len(self) > TABLE_SIZE + len(self.frequent):
            self.clear()
            self.update(self.frequent)
        n = self[word] = len(self.model.encode(word, add_special_tokens=False).ids)
        return n


def pack(lengths: dict[str, int]) -> tuple[bytes, bytes]:
    """The compact form that is broadcast: joined words and one or more
    length bytes each (255 carries on)."""
    coded = bytearray()
    for n in lengths.values():
        coded += b"\xff" * (n // 255) + bytes([n % 255])
    return "\n".join(lengths).encode(), bytes(coded)


def unpack(words: bytes, coded: bytes) -> dict[str, int]:
    counts, carry = [], 0
    for b in coded:
        carry += b
        if b != 255:
            counts.append(carry)
            carry = 0
    return dict(zip(words.decode().split("\n"), counts)) if counts else {}


def _library(vocabulary: bytes):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark has one task per core already
    from tokenizers import Tokenizer
    return Tokenizer.from_str(vocabulary.decode())


def without_normalizer(library):
    """The library for pre-tokens, which are normalised already: marks that a
    second normalisation would put in another order stay as they are."""
    from tokenizers import Tokenizer

    spec = json.loads(library.to_str())
    return Tokenizer.from_str(json.dumps(spec | {"normalizer": None}))


def lessened(met: dict[str, int], keep: int) -> dict[str, int]:
    """At most ``keep`` entries: all counts go down by the first one that has
    no place, and those that are used up go (Misra and Gries)."""
    if len(met) <= keep:
        return met
    cut = sorted(met.values(), reverse=True)[keep]
    return {w: n - cut for w, n in met.items() if n > cut}


SUMMARY = "node long, words binary, counts binary"


def _summary_row(node: int, met: dict[str, int], keep: int) -> pa.RecordBatch:
    met = lessened(met, keep)
    return pa.RecordBatch.from_arrays(
        [pa.array([node], pa.int64()), pa.array(["\n".join(met).encode()], pa.binary()),
         pa.array([array("q", met.values()).tobytes()], pa.binary())], names=["node", "words", "counts"])


def _summarise(batches, vocabulary, keep: int):
    """One row per task: the heavy hitters of all its texts' pre-tokens."""
    from pyspark import TaskContext

    cutter = worker_state(("cutter", vocabulary.value), lambda: Cutter(_library(vocabulary.value)))
    met: Counter = Counter()
    for b in batches:
        for text in texts_of(b.column(0)):
            met.update(cutter.cut(text)[0])
            if len(met) > 8 * keep:
                met = Counter(lessened(met, keep))
    met.pop("", None)
    yield _summary_row(TaskContext.get().partitionId(), {w: n for w, n in met.items() if "\n" not in w}, keep)


def _merger(keep: int):
    def merge(table: pa.Table) -> pa.Table:
        met: Counter = Counter()
        for words, counts in zip(table.column("words").to_pylist(), table.column("counts").to_pylist(), strict=True):
            if words:
                met.update(dict(zip(words.decode().split("\n"), array("q", counts), strict=True)))
        return pa.Table.from_batches([_summary_row(table.column("node")[0].as_py() // MERGED, met, keep)])
    return merge


def frequent_lengths(df: DataFrame, text_col: str, vocabulary: bytes, keep: int = FREQUENT) -> dict[str, int]:
    """The frequent pre-tokens of all rows, with lengths. What is exchanged is
    one bounded table per task."""
    held = df.sparkSession.sparkContext.broadcast(vocabulary)
    level = materialize(map_batches(df.select(text_col).filter(F.col(text_col).isNotNull()),
                                    partial(_summarise, vocabulary=held, keep=keep), SUMMARY), "token-summaries")
    while level.count() > 1:
        up = level.groupBy(F.floor(F.col("node") / MERGED))
        level = materialize(up.applyInArrow(_merger(keep), SUMMARY), "token-summaries")
    row = level.first()
    lengths = Lengths(_library(vocabulary), {})
    return {w: lengths[w] for w in bytes(row["words"]).decode().split("\n")} if row and row["words"] else {}


def _count_batches(vocabulary, frequent, text_at: int):
    def tables():
        library = _library(vocabulary.value)
        return Cutter(library), Lengths(library, unpack(*frequent.value))

    cutter, lengths = worker_state(("token counts", vocabulary.value, frequent.value), tables)

    def fn(batch: pa.RecordBatch) -> list[pa.Array]:
        counts = []
        for text in texts_of(batch.column(text_at)):
            words, specials = cutter.cut(text)
            counts.append(sum(map(lengths.__getitem__, words)) + specials)
        return [pa.array(counts, pa.int64())]
    return fn


def count_tokens(df: DataFrame, vocabulary_path: str, text_col: str = "text") -> DataFrame:
    """``df`` with ``n_tokens``. One map over the table; the vocabulary file,
    of fixed size, and the frequent table are broadcast."""
    with open(vocabulary_path, "rb") as f:
        content = f.read()
    check_vocabulary(content.decode())
    sc = df.sparkSession.sparkContext
    frequent = pack(frequent_lengths(df, text_col, content))
    return add_columns(df, [T.StructField("n_tokens", T.LongType())],
                       partial(_count_batches, sc.broadcast(content), sc.broadcast(frequent),
                               df.columns.index(text_col)))
