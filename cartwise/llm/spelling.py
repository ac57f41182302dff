"""Spelling variants: words one edit apart, grouped under the frequent form.

Two words are near if one inserted, deleted or replaced letter turns one into
the other. The edit falls into one half of the shorter word, so the other
half stands in both words: near words share the first or the last half (with
the length). Each word is dealt by hashes of those halves, a bounded number of
words a shard, and each shard builds an FM-index of its words, written one
after the other between delimiters, once forwards and once backwards: the
two directions of a bidirectional index. A search starts at a delimiter,
matches the half that is exact letter by letter, then goes on across the
other half allowing one error, and ends at a delimiter; all along it holds
intervals of suffix ranks only. The words of a shard are searched together,
one letter of all of them a step.

An inserted letter that equals its neighbour could stand in several places;
the search takes the last of them, so each pair is found exactly once and
nothing must be made distinct. Replaced letters are found from both words,
inserted ones from the shorter word and mirrored.

Skew: a half that more words share than a shard should hold is refined: the
half with the error is halved again, and the words are dealt by the half and
the quarter that are exact, until the groups fit. (With all but one letter
given, a group has at most one word per letter and pair of letters.) So
neither the index nor the searches of a shard grow with the vocabulary. Pairs
are counted inside the shard; one row per word leaves it.

Defined results: words shorter than ``MIN_LENGTH`` letters or rarer than
``MIN_COUNT`` don't count; null texts have no words; a null id counts as empty
in the checksum; repeated rows count as often as they occur; an empty table
gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwise.llm.batches import ship_library
from cartwise.plans.materialize import materialize

MIN_LENGTH = 6
MIN_COUNT = 5
#: A near word is the form of another if it is this many times as frequent.
FORM_RATIO = 5
#: Rows (a word is up to four) that a shard holds, about.
SHARD_ROWS = 40_000
#: Words of a shard that are searched together.
SEARCHED = 4_096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Every this many-th occurrence (by checksum) loses a letter in ``damaged``.
DAMAGE = 199


def words_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             min_length: int = MIN_LENGTH) -> DataFrame:
    """(id, word): one row per run of letters of at least ``min_length``, A-Z
    lower-cased."""
    runs = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")),
                                F.lit(rf"([A-Za-zÀ-ÿ]{{{min_length},}})"))
    run = F.col("run")
    ascii_only = F.octet_length(run) == F.char_length(run)
    return df.select(F.col(id_col).alias("id"), F.explode(runs).alias("run")).select(
        "id", F.when(ascii_only, F.lower(run)).otherwise(F.translate(run, UPPER, LOWER)).alias("word"))


def damaged(words: DataFrame) -> DataFrame:
    """The words, each ``DAMAGE``-th (by the crc32 of ``id:word``) without one
    of its letters, also chosen by the checksum."""
    h = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
    at = (F.col("h") % F.char_length("word")).cast("int")
    cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))
    return words.withColumn("h", h).select(
        "id", F.when(F.col("h") % DAMAGE == 0, cut).otherwise(F.col("word")).alias("word"))


def vocabulary(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words that count; combined map-side."""
    return words.filter(F.char_length("word") >= min_length).groupBy("word") \
        .agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


# --- dealing ---------------------------------------------------------------

def _state(m: Column, a: Column, b: Column) -> Column:
    return F.struct(m.cast("int").alias("m"), a.cast("int").alias("a"), b.cast("int").alias("b"))


def _halves(m: Column) -> Column:
    """For a shorter word of ``m`` letters: the last half exact, and the first."""
    half = F.floor(m / 2)
    return F.array(_state(m, F.lit(0), m - half), _state(m, half, F.lit(0)))


def _group(rows: DataFrame) -> DataFrame:
    """Rows of equal group share the state and its exact letters."""
    return rows.withColumn("group", F.xxhash64(
        "m", "a", "b", F.substring("word", F.lit(1), F.col("a")),
        F.expr("substring(word, char_length(word) - b + 1, b)")))


def dealt(vocab: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(shard, word, n, m, a, b): the word with the error allowed behind the
    first ``a`` and before the last ``b`` letters of the shorter word, which
    has ``m``."""
    length = F.char_length("word")
    states = F.concat(_halves(length), F.when(length > MIN_LENGTH, _halves(length - 1)).otherwise(F.array()))
    rows = _group(vocab.select("word", "n", F.inline(states)))
    while True:
        rows = materialize(rows, "spelling-rows")
        window = F.col("m") - F.col("a") - F.col("b")
        crowded = materialize(rows.filter(window > 1).groupBy("group").agg(F.count("*").alias("held"))
                              .filter(F.col("held") > shard_rows), "spelling-crowded")
        if not crowded.head(1):
            break
        middle = F.col("a") + F.floor(window / 2)
        finer = F.array(_state(F.col("m"), F.col("a"), F.col("m") - middle), _state(F.col("m"), middle, F.col("b")))
        split = (F.col("held").isNotNull()) & (window > 1)
        rows = _group(rows.join(crowded, "group", "left").select(
            "word", "n", F.inline(F.when(split, finer).otherwise(
                F.array(_state(F.col("m"), F.col("a"), F.col("b")))))))
    shards = max(1, -(-rows.count() // shard_rows))
    return rows.withColumn("shard", F.pmod("group", F.lit(shards)))


# --- the index of a shard --------------------------------------------------

class Index:
    """FM-index of words (numbered letters from 1, one after the other in
    ``letters``): backward search over the words' reversals reads the words
    themselves from their first letter on."""

    def __init__(self, letters: np.ndarray, lengths: np.ndarray, symbols: int):
        n_words, n = len(lengths), len(letters) + len(lengths)
        ends = np.cumsum(lengths)
        word = np.repeat(np.arange(n_words), lengths)
        place = np.arange(len(letters)) - (ends - lengths)[word]
        starts = ends - lengths + np.arange(n_words)
        text = np.zeros(n, np.int64)
        text[starts[word] + lengths[word] - 1 - place] = letters
        owner = np.repeat(np.arange(n_words), lengths + 1)
        to_end = (starts + lengths)[owner] - np.arange(n)
        # ranks of the suffixes, each up to its delimiter, by doubling
        rank, known, before = text, 1, 0
        while True:
            ahead = np.zeros(n, np.int64)
            ahead[:n - known] = rank[known:]
            ahead[to_end < known] = 0
            values, rank = np.unique(rank * (rank.max() + 1) + ahead, return_inverse=True)
            known *= 2
            if len(values) == before or known > to_end.max():
                break
            before = len(values)
        order = np.argsort(rank, kind="stable")
        self.bwt = np.where(order > 0, text[order - 1], 0)
        self.size, self.symbols, self.n_words = n, symbols, n_words
        # the index of (letter, row) among these is the letter's next interval bound
        self.keys = np.sort(self.bwt * (n + 1) + np.arange(n))
        whole = np.flatnonzero(self.bwt == 0)
        self.words = owner[order[whole]]

    def step(self, letter: np.ndarray, row: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, letter * (self.size + 1) + row)

    def expand(self, lo: np.ndarray, hi: np.ndarray):
        """(item, letter, lo, hi) of every letter that goes on from each interval."""
        width = hi - lo
        few = np.flatnonzero(width <= self.symbols)
        many = np.flatnonzero(width > self.symbols)
        item = np.repeat(few, width[few])
        row = lo[item] + np.arange(len(item)) - np.repeat(np.cumsum(width[few]) - width[few], width[few])
        pair = np.unique(item * (self.symbols + 1) + self.bwt[row])
        item = np.concatenate([pair // (self.symbols + 1), np.repeat(many, self.symbols)])
        letter = np.concatenate([pair % (self.symbols + 1), np.tile(np.arange(1, self.symbols + 1), len(many))])
        item, letter = item[letter > 0], letter[letter > 0]
        low, high = self.step(letter, lo[item]), self.step(letter, hi[item])
        live = high > low
        return item[live], letter[live], low[live], high[live]

    def whole_words(self, lo: np.ndarray, hi: np.ndarray):
        """(item, word) of the intervals that hold a delimiter's place: a whole word is read."""
        first, beyond = self.step(np.zeros_like(lo), lo), self.step(np.zeros_like(hi), hi)
        item = np.flatnonzero(beyond > first)
        return item, self.words[first[item]]


def search(index: Index, letters: np.ndarray, begin: np.ndarray, length: np.ndarray, replaced: tuple, inserted: tuple,
           avoid_next: np.ndarray):
    """(query, word, was inserted) for all words one replaced or inserted
    letter from each query.

    ``letters[begin : begin + length]`` are the queries' letters; a letter may
    be replaced at places replaced[0] <= j < replaced[1] and inserted before
    places inserted[0] <= j <= inserted[1]. An inserted letter must differ from
    the next letter (``avoid_next``) or else from the one before."""
    q = np.arange(len(begin))
    lo, hi = np.zeros(len(q), np.int64), np.full(len(q), index.n_words)
    wrong = [np.empty(0, np.int64)] * 3 + [np.empty(0, bool)]  # query, lo, hi, inserted: one error behind them
    out = []
    for j in range(int(length.max(initial=-1)) + 1):
        last = length[q] == j
        now = np.where(last, 0, letters[np.where(last, 0, begin[q] + j)])
        replace = (replaced[0][q] <= j) & (j < replaced[1][q]) & ~last
        insert = (inserted[0][q] <= j) & (j <= inserted[1][q])
        items = np.flatnonzero(replace | insert)
        item, letter, low, high = index.expand(lo[items], hi[items])
        item = items[item]
        avoid = np.where(avoid_next[q[item]], now[item], letters[begin[q[item]] + max(j - 1, 0)])
        ins = insert[item] & (letter != avoid)
        sub = replace[item] & (letter != now[item])
        # a letter inserted before j: j itself is still to be read
        wrong = [np.concatenate(x) for x in zip(wrong, (q[item[ins]], low[ins], high[ins],
                                                        np.ones(ins.sum(), bool)), strict=True)]
        done = length[wrong[0]] == j
        found, word = index.whole_words(wrong[1][done], wrong[2][done])
        out.append((wrong[0][done][found], word, wrong[3][done][found]))
        wrong = [x[~done] for x in wrong]
        letter_now = letters[begin[wrong[0]] + j]
        wrong[1], wrong[2] = index.step(letter_now, wrong[1]), index.step(letter_now, wrong[2])
        live = wrong[2] > wrong[1]
        wrong = [np.concatenate(x) for x in zip([x[live] for x in wrong], (
            q[item[sub]], low[sub], high[sub], np.zeros(sub.sum(), bool)), strict=True)]
        q, lo, hi, now = q[~last], lo[~last], hi[~last], now[~last]
        lo, hi = index.step(now, lo), index.step(now, hi)
        live = hi > lo
        q, lo, hi = q[live], lo[live], hi[live]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3


def near_in_shard(words: list[str], query: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray):
    """(word, near word, both as numbers in ``words``), each ordered pair once.
    ``words`` are different; ``query`` numbers the ones to search for, which
    have ``m`` letters and their error behind ``a`` and before ``b`` letters."""
    lengths = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    symbols, letters = np.unique(points, return_inverse=True)
    letters = letters.astype(np.int64) + 1
    ends = np.cumsum(lengths)
    first = ends - lengths
    owner = np.repeat(np.arange(len(words)), lengths)
    mirrored = letters[first[owner] + ends[owner] - 1 - np.arange(len(letters))]
    pairs = []
    forward = (b == 0) | ((a > 0) & (a >= b))
    for side, text in ((forward, letters), (~forward, mirrored)):
        if not side.any():
            continue
        index = Index(text, lengths, len(symbols))
        exact, tail = (a, b) if text is letters else (b, a)
        at = np.flatnonzero(side)
        for part in np.array_split(at, -(-len(at) // SEARCHED)):
            k, e, t = m[part], exact[part], tail[part]
            # an edit before letter m - b belongs to the state on its right
            places = (e, k - t - (t > 0)) if text is letters else (e + 1, k - t)
            got, word, longer = search(index, text, first[query[part]], k, (e, k - t), places,
                                       np.full(len(part), text is letters))
            source = query[part][got]
            pairs.append(np.stack([np.concatenate([source, word[longer]]), np.concatenate([word, source[longer]])]))
    return np.concatenate(pairs, 1) if pairs else np.empty((2, 0), np.int64)


NEAR = "word string, n_near long, near_n long, near string"


def _shard(table: pa.Table) -> pa.Table:
    """One row per word that has near words in the shard: how many, and the
    most frequent (ties: the first in code-point order) with its count."""
    column = {c: table.column(c).to_numpy() for c in ("word", "n", "m", "a", "b")}
    words, first, number = np.unique(column["word"], return_index=True, return_inverse=True)
    counts = column["n"][first]
    lengths = np.array([len(w) for w in column["word"]], np.int64)
    asked = lengths == column["m"]
    left, right = near_in_shard(words.tolist(), number[asked],
                                *(column[c][asked].astype(np.int64) for c in ("m", "a", "b")))
    order = np.lexsort((right, -counts[right], left))
    left, right = left[order], right[order]
    new = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]])) if len(left) else np.empty(0, np.int64)
    best = right[new]
    return pa.table({"word": pa.array(words[left[new]], pa.string()),
                     "n_near": pa.array(np.diff(np.append(new, len(left))), pa.int64()),
                     "near_n": pa.array(counts[best], pa.int64()), "near": pa.array(words[best], pa.string())})


def variants(vocab: DataFrame, shard_rows: int = SHARD_ROWS, ratio: int = FORM_RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for (word, n): the near word of
    largest n as form if it is ``ratio`` times as frequent, and the word that
    the forms lead to in the end."""
    vocab = materialize(vocab, "spelling-vocabulary")
    ship_library(vocab.sparkSession)
    rows = dealt(vocab, shard_rows).select("shard", "word", "n", "m", "a", "b")
    near = rows.groupBy("shard").applyInArrow(_shard, NEAR)
    best = near.groupBy("word").agg(F.sum("n_near").alias("n_near"),
                                    F.min(F.struct((-F.col("near_n")).alias("back"), "near")).alias("best"))
    frequent = -F.col("best.back") >= ratio * F.col("n")
    formed = materialize(vocab.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(frequent, F.col("best.near")).alias("form"),
        F.when(frequent, -F.col("best.back")).cast("long").alias("form_n")), "spelling-forms")
    roots = _roots(formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """(word, root): where the links end. Each round doubles the steps taken,
    and a form is ``FORM_RATIO`` times as frequent as its variant, so a few
    rounds do. Both sides of each join are written tables, whose hot keys
    (roots with many variants) can be split."""
    while True:
        links = materialize(links, "spelling-roots")
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if not links.join(onward, "root").head(1):
            return links
        links = links.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
