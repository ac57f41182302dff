from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartwise.constants import PRICE_STRIP_PATTERN, SESSION_KEY_SEP


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_ms_to_ts(c) -> Column:
    """Epoch milliseconds (long) -> timestamp (session zone)."""
    return F.timestamp_millis(_c(c))


def whole_seconds(c) -> Column:
    """Timestamp -> epoch seconds, sub-seconds floored (same as cast to long)."""
    return F.unix_seconds(_c(c))


def count_if(cond: Column) -> Column:
    """Number of rows where ``cond`` is true (nulls not counted)."""
    return F.count(F.when(cond, F.lit(1)))


def session_key(visitor, seq) -> Column:
    """``visitorid-session_number`` as a string."""
    return F.concat_ws(SESSION_KEY_SEP, _c(visitor).cast("string"), _c(seq).cast("string"))


def safe_int(c) -> Column:
    """String -> int, a decimal fraction cut off (``5.7`` is 5, ``.5`` and
    ``-.5`` are 0); bad strings become null instead of failing (ANSI safe)."""
    # a 0 before the digits stands in for missing ones
    return F.regexp_replace(_c(c), r"^(\s*[+-]?)([0-9]*)\.[0-9]*(\s*)$", "$1" "0" "$2").try_cast("int")


def clean_price(c) -> Column:
    """Keep digits and dots, then cast; ``''`` and ``1.2.3`` become null."""
    return F.regexp_replace(_c(c), PRICE_STRIP_PATTERN, "").try_cast("double")


def class_probability(prob_arr, index: int = 1) -> Column:
    """Element ``index`` of a probability array, null when the array is shorter."""
    arr = _c(prob_arr)
    return F.when(F.size(arr) > index, F.get(arr, index))


def prob_max(prob_arr) -> Column:
    return F.array_max(_c(prob_arr))


HASH_BITS = 60


def key_hash(cols: list[str], seed: int) -> Column:
    """The first ``HASH_BITS`` bits of md5 over the columns as text, joined by
    ``|`` (null: empty), and the seed: a number that any engine can recompute."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]
    digest = F.md5(F.concat_ws("|", *parts, F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def hash_keep(cols: list[str], fraction: float, seed: int) -> Column:
    """Layout-independent keep flag with probability ``fraction``: the same
    rows survive whatever the number of input partitions (unlike
    ``DataFrame.sample``)."""
    return key_hash(cols, seed) < F.lit(round(fraction * (1 << HASH_BITS))).cast("long")
