"""Column-expression helpers. All are built-in Spark expressions, so they stay
inside whole-stage codegen; nothing here calls Python per row."""

from cartwise.functions.expressions import (
    class_probability,
    clean_price,
    count_if,
    epoch_ms_to_ts,
    hash_keep,
    key_hash,
    prob_max,
    safe_int,
    session_key,
    whole_seconds,
)

__all__ = [
    "class_probability", "clean_price", "count_if", "epoch_ms_to_ts", "hash_keep",
    "key_hash", "prob_max", "safe_int", "session_key",
    "whole_seconds",
]
