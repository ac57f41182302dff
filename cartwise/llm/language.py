"""Language identification by compression.

Texts are lower-cased. For each language a raw-content zstandard dictionary is cut from a bounded
sample of labelled training texts. A text is compressed, block by block, once
with every dictionary; the language whose dictionary gives the fewest bytes
is predicted. Short texts are repeated to fill a block that can be compressed
at all. Blocks keep long texts decidable: without them only the first
few kilobytes would feel the dictionary.

``score`` is the margin of the best over the second-best language, as a
share of the second-best size and scaled by ``FULL_MARGIN`` (1 from there
on). ``rejected`` marks texts without a letter and those whose margin is
under ``min_margin``.

The one thing that is sampled is the dictionaries' content: per language at
most ``samples`` pieces of at most ``piece_chars`` characters, chosen by a hash
of the text, so the driver holds languages x samples x piece_chars characters at
most. Every text is classified whole.

Defined results: null text, or one without a letter, is ``und`` with score 0
and rejected; a tie goes to the language that sorts first (and is rejected,
its margin being 0); equal texts get equal results; with no labelled text
every prediction is ``und``; an empty table gives an empty table; input
columns named like the results are replaced, all others are kept.
"""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwise.llm.batches import add_columns, texts_of, worker_state

UNDETERMINED = "und"
SAMPLES = 512
PIECE_CHARS = 256
#: zstandard level and bytes per block.
LEVEL = 6
BLOCK = 1024
#: A shorter text is repeated to this many bytes: zstandard stores tiny inputs as they are, for any dictionary.
FILL = 256
#: A margin of this share of the second-best size counts as certain.
FULL_MARGIN = 0.10
#: Under this margin a prediction is rejected.
MIN_MARGIN = 0.002


def held_out(id_col: str = "doc_id"):
    """Rows that learning must not see: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(training: DataFrame, text_col: str = "text", lang_col: str = "lang",
        samples: int = SAMPLES, piece_chars: int = PIECE_CHARS) -> dict[str, bytes]:
    """Dictionary content per language, from ``training`` (labelled rows).

    The first pass ranks hashes alone; only the chosen texts are read again,
    so no text is shuffled but the sample's."""
    text = F.col(text_col)
    rows = training.filter(F.col(lang_col).isNotNull() & text.isNotNull() & (F.length(F.trim(text)) > 0)) \
        .select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text).alias("h"), text.alias("text"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang")
             .agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not sizes:
        return {}
    # about four times the wanted number of different texts per language reach the ranking
    near = F.lit(False)
    for lang, n in sizes.items():
        share = min(1.0, 4 * samples / max(n, 1))
        near = near | ((F.col("lang") == lang) & (F.pmod("h", F.lit(1 << 40)) <= int(share * (1 << 40))))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    last = (rows.filter(near).groupBy("lang", "h").agg(F.lit(1).alias("one"))
            .withColumn("r", rank).filter(F.col("r") <= samples)
            .groupBy("lang").agg(F.max("h").alias("last")))
    bounds = {r["lang"]: r["last"] for r in last.collect()}
    chosen = F.lit(False)
    for lang, h in bounds.items():
        chosen = chosen | ((F.col("lang") == lang) & (F.col("h") <= h))
    start = F.pmod(F.col("h"), F.greatest(F.length("text") - piece_chars, F.lit(1))).cast("int") + 1
    pieces = (rows.filter(near & chosen).groupBy("lang", "h")
              .agg(F.min(F.substring("text", start, F.lit(piece_chars))).alias("piece")))
    out: dict[str, list] = {}
    for r in pieces.collect():
        out.setdefault(r["lang"], []).append((r["h"], r["piece"]))
    return {lang: "\n".join(p for _, p in sorted(got)).lower().encode() for lang, got in sorted(out.items())}


def _classify(content: dict[str, bytes], min_margin: float, text_at: int):
    import zstandard as zstd

    langs = sorted(content)
    coders = []
    for lang in langs:
        d = zstd.ZstdCompressionDict(content[lang], dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        coders.append(zstd.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False,
                                          write_checksum=False, write_dict_id=False).compress)

    def one(text: str):
        if not coders or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, True
        data = text.lower().encode()
        if len(data) < FILL:
            data = (data + b" ") * (FILL // len(data) + 1)
        blocks = [data[i:i + BLOCK] for i in range(0, len(data), BLOCK)]
        sizes = [sum(len(c(b)) for b in blocks) for c in coders]
        best = min(sizes)
        at = sizes.index(best)
        others = sizes[:at] + sizes[at + 1:]
        margin = (min(others) - best) / min(others) if others else 1.0
        return langs[at], min(1.0, margin / FULL_MARGIN), margin < min_margin

    def fn(batch: pa.RecordBatch) -> list[pa.Array]:
        got = [one(t) for t in texts_of(batch.column(text_at))]
        return [pa.array([g[i] for g in got], kind) for i, kind in
                enumerate((pa.string(), pa.float64(), pa.bool_()))]
    return fn


def classify(df: DataFrame, content: dict[str, bytes], text_col: str = "text",
             min_margin: float = MIN_MARGIN) -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` and ``rejected``; one map, no shuffle."""
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
              T.StructField("rejected", T.BooleanType())]
    held = df.sparkSession.sparkContext.broadcast(content)
    at = df.columns.index(text_col)
    return add_columns(df, fields, partial(_classify_task, held, min_margin, at))


def _classify_task(held, min_margin, text_at):
    return worker_state(("language", min_margin, text_at, *held.value.items()),
                        partial(_classify, held.value, min_margin, text_at))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             min_margin: float = MIN_MARGIN) -> DataFrame:
    """Learn from the rows of ``df`` that are not held out, classify all."""
    return classify(df, fit(df.filter(~held_out(id_col)), text_col, lang_col), text_col, min_margin)
