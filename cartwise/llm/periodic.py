"""Periodic runs of words: passages that repeat at least four times in a row.

A run is a maximal stretch of words whose words ``period`` apart are equal,
at least ``max(MIN_LENGTH, MIN_EXPONENT * period)`` words long; ``period`` is
the smallest one. Runs are found with string synchronising sets. At each
dyadic scale t, every window of t words gets a hash; position i is chosen
when the least hash of the windows at i .. i+t lies at either end. Whether i
is chosen depends on the words i .. i+2t alone, so two places with the same
2t words (their context) are chosen alike, and any t neighbouring positions
hold a chosen one unless they lie inside a region of a far smaller period.

A run of period p in [t, 2t) is at least 4p long, so it has a chosen position
x with x + p chosen too and the same context, and no earlier position shares
it (else the run would have a smaller period). So each chosen position is
compared with the next of equal context only, and their distance, if it is in
[t, 2t), is proposed as a period. Proposals are linear in the text; one of
each chain is extended word by word, so nothing rests on the hashes.

Windows inside a run whose period is at most t/4 are left out of the choice
(there all hashes repeat). Such regions are the runs of the smaller scales,
which are done first; the periods below the smallest scale are found by
comparing neighbours directly.

Documents are cut into words on ASCII white space and handled whole, many in
one go: one map over the table, memory in proportion to the longest text.

Defined results: null and empty texts have no words, no runs and an empty
collapsed text; repeated rows and ids are handled row by row; among runs with
the same bounds the smallest period counts; an empty table gives an empty
result; extra columns are kept unless named like the results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwise.llm.batches import add_columns, slices

MIN_EXPONENT = 4
MIN_LENGTH = 6
#: The smallest scale; smaller periods are compared directly.
FIRST_SCALE = 4
#: Bytes of text handled in one go.
GO_BYTES = 1 << 20
TOP = np.uint64(2**64 - 1)

RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS),
          T.StructField("collapsed", T.StringType())]


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def doubled(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of windows of twice the width (those that run over the end of
    the text are of no use and never looked at)."""
    ahead = np.zeros_like(hashes)
    ahead[:len(hashes) - width] = hashes[width:]
    return mixed(hashes * np.uint64(0x9E3779B97F4A7C15) + np.uint64(width)) + ahead


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of values[i : i + width] for each i that has a full window."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def extended(words: np.ndarray, end: np.ndarray, begin: np.ndarray, at: np.ndarray, period: np.ndarray):
    """The maximal stretches [left, right) with ``period`` around the seeds
    ``at``, compared word by word within each seed's document; a seed that
    has no such pair of words itself gives an empty stretch."""
    def agreeing(place, sign, limit):
        """How many places from ``place`` on, in the given direction, equal the word one period on."""
        count, active, block = np.zeros(len(place), np.int64), np.arange(len(place)), 16
        while len(active):
            steps = count[active, None] + np.arange(block)
            i = place[active, None] + sign * steps
            inside = steps < limit[active, None]
            i = np.where(inside, i, 0)
            same = inside & (words[i] == words[np.where(inside, i + period[active, None], 0)])
            run = np.where(same.all(1), block, same.argmin(1))
            count[active] += run
            active = active[run == block]
            block = min(2 * block, 1 + (1 << 22) // max(1, len(active)))
        return count

    right = agreeing(at, 1, end - period - at)
    left = agreeing(at - 1, -1, at - begin)
    return at - left, at + right + period


def chains(at: np.ndarray, period: np.ndarray, reach: int) -> np.ndarray:
    """One seed per chain of proposals of equal period at most ``reach`` apart."""
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    new = np.ones(len(at), bool)
    new[1:] = (period[1:] != period[:-1]) | (at[1:] - at[:-1] > reach)
    return order[new]


def small_periods(words: np.ndarray, doc: np.ndarray, below: int):
    """(start, end, period) of all runs whose period is below ``below``."""
    found = []
    for p in range(1, min(below, len(words))):
        same = (words[:-p] == words[p:]) & (doc[:-p] == doc[p:])
        edge = np.diff(np.concatenate(([0], same.view(np.int8), [0])))
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = stop + p - start >= max(MIN_LENGTH, MIN_EXPONENT * p)
        found.append(np.stack([start[long], stop[long] + p, np.full(long.sum(), p)], 1))
    return found


def proposals(hashes, last, doc, t, excluded):
    """(position, period) for neighbouring chosen positions of equal context.
    ``last`` is each position's document end."""
    ids = hashes.copy()
    ids[excluded] = TOP
    n = len(ids) - 2 * t + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    least = window_min(ids, t + 1)[:n]
    chosen = (least == ids[:n]) | (least == ids[t:t + n])
    chosen &= (least != TOP) & (np.arange(n) + 2 * t <= last[:n])
    at = np.flatnonzero(chosen)
    context = doubled(hashes, t)[at] ^ mixed(doc[at].astype(np.uint64))
    order = np.argsort(context, kind="stable")
    here, following = at[order[:-1]], at[order[1:]]
    gap = following - here
    good = (context[order[:-1]] == context[order[1:]]) & (doc[here] == doc[following]) & (gap >= t) & (gap < 2 * t)
    return here[good], gap[good]


def find_runs(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows (document, start, length, period) in that order, for documents
    that stand one after the other in ``words`` (numbers), ``sizes`` long."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(words))
    found = small_periods(words, doc, FIRST_SCALE)
    hashes, t = mixed(words.astype(np.uint64) + np.uint64(1)), 1
    while t < FIRST_SCALE:
        hashes, t = doubled(hashes, t), 2 * t
    while True:
        # only documents with room for a run of this scale
        keep = (sizes >= MIN_EXPONENT * t)[doc]
        if not keep.all():
            words, doc, hashes, place = words[keep], doc[keep], hashes[keep], place[keep]
        if not len(words):
            break
        own_size = np.where(sizes >= MIN_EXPONENT * t, sizes, 0)
        own_end = np.cumsum(own_size)
        last, first = own_end[doc], (own_end - own_size)[doc]
        shift = place - np.arange(len(words))
        # windows inside the runs of small periods that the earlier scales found
        rows = np.concatenate(found)
        rows = rows[(4 * rows[:, 2] <= t) & (rows[:, 1] - rows[:, 0] >= t)]
        rows = rows[own_size[np.searchsorted(ends, rows[:, 0], "right")] > 0]
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, np.searchsorted(place, rows[:, 0]), 1)
        np.add.at(cover, np.searchsorted(place, rows[:, 1] - t) + 1, -1)
        at, period = proposals(hashes, last, doc, t, np.cumsum(cover[:-1]) > 0)
        if len(at):
            seeds = chains(at, period, 2 * t)
            at, period = at[seeds], period[seeds]
            left, right = extended(words, last[at], first[at], at, period)
            long = right - left >= np.maximum(MIN_LENGTH, MIN_EXPONENT * period)
            found.append(np.stack([left + shift[at], right + shift[at], period], 1)[long])
        hashes, t = doubled(hashes, t), 2 * t
    rows = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first_of = np.ones(len(rows), bool)
    first_of[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    rows = rows[first_of]
    d = np.searchsorted(ends, rows[:, 0], "right")
    out = np.stack([d, rows[:, 0] - starts[d], rows[:, 1] - rows[:, 0], rows[:, 2]], 1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def analyse(texts: list[bytes]) -> tuple[list[int], list[list[dict]], list[str]]:
    """Word counts, runs and collapsed texts of the documents."""
    number: dict[bytes, int] = {}
    split = [t.split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    coded = np.fromiter((number.setdefault(w, len(number)) for ws in split for w in ws), np.int64, int(sizes.sum()))
    rows = find_runs(coded, sizes)
    runs: list[list[dict]] = [[] for _ in split]
    for d, start, length, period in rows.tolist():
        runs[d].append({"start": start, "length": length, "period": period})
    collapsed = []
    for ws, own in zip(split, runs, strict=True):
        if own:
            change = np.zeros(len(ws) + 1, np.int64)
            for r in own:
                change[r["start"] + r["period"]] += 1
                change[r["start"] + r["length"]] -= 1
            covered = np.cumsum(change[:-1]).tolist()
            ws = [w for w, c in zip(ws, covered, strict=True) if not c]
        collapsed.append(b" ".join(ws).decode())
    return sizes.tolist(), runs, collapsed


def runs_of(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with n_words, runs (by start, then period) and collapsed: the
    words that are in no run after its first period, joined by blanks."""
    at = df.columns.index(text_col)
    run_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def make():
        def columns(batch: pa.RecordBatch) -> list[pa.Array]:
            counts, runs, collapsed = [], [], []
            for part in slices(batch, GO_BYTES):
                texts = part.column(at).cast(pa.binary())
                out = analyse([t.as_py() or b"" for t in texts])
                counts += out[0]
                runs.append(pa.array(out[1], run_type))
                collapsed.append(pa.array(out[2], pa.string()))
            return [pa.array(counts, pa.int64()), pa.concat_arrays(runs) if runs else pa.array([], run_type),
                    pa.concat_arrays(collapsed) if collapsed else pa.array([], pa.string())]
        return columns

    return add_columns(df, FIELDS, make)


def strongest(runs: Column) -> Column:
    """The run of greatest length/period, compared as fractions (ties: the
    smallest start, then period); null without a run."""
    def better(a, b):
        mine, theirs = a["length"] * b["period"], b["length"] * a["period"]
        return (mine < theirs) | ((mine == theirs) & (F.struct(b["start"], b["period"])
                                                      < F.struct(a["start"], a["period"])))
    return F.aggregate(runs, F.lit(None).cast(RUNS.elementType),
                       lambda a, b: F.when(a.isNull() | better(a, b), b).otherwise(a))


def listed(runs: Column) -> Column:
    """``start,length,period`` and a line feed for each run."""
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(
        ",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return F.array_join(lines, "")


def planted(id_col: str, text_col: str) -> Column:
    """The text, in a tenth of the documents (chosen by the id's crc32) with
    the words from a place on replaced by repeats of the first few of them."""
    h = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def repeated(ws):
        n = F.size(ws).cast("long")
        a = g % F.greatest(n, F.lit(1))
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.when(n > 0, F.array_join(F.concat(
            F.slice(ws, F.lit(1), a.cast("int")),
            F.transform(F.sequence(F.lit(0).cast("long"), n - a - 1),
                        lambda i: F.element_at(ws, (a + i % p + 1).cast("int")))), " ")).otherwise("")

    # the array of one array binds the words, which are then cut once
    words = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"))
    return F.when(h % 10 == 0, F.transform(F.array(words), repeated)[0]).otherwise(F.col(text_col))
