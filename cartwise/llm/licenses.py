"""License scan: ordered signature rules, in DataFrame functions alone.

A text is reduced to its words (lower-cased; runs of ASCII letters, digits and
all characters beyond ASCII). Texts without any stem of the rules' keywords
stop there. For the others the rules whose keyword occurs are matched; every
match is an interval of words. Matches are ordered by start, then longer
first, then priority, and one that lies inside an earlier one is suppressed:
the version wins over the bare name, the better rule over the weaker one on
the same words. What remains are the detections.

Base phrases are counted at all their places, whatever the rules say of them.

Everything is computed within the row: one map, no shuffle.

Defined results: null text counts as empty; a text without words has no
detections, 0 words and score 0; a rule matches non-overlapping places from
the left; repeated rows get equal results; an empty table gives an empty
table; input columns named like the results are replaced, all others kept.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwise.llm.license_rules import STEMS, Rule, build_rules

#: phrase -> label
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by",
                "mit license": "mit"}
#: Private-use character that marks matches.
MARK = "\ue000"
PLACE = "array<struct<start:int,stop:int,label:string,priority:int,weight:double>>"


def word_line(text: Column) -> Column:
    """The words, lower-cased, each with a space in front, and one at the end."""
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" ")),
                            r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _rule_table(rules: list[Rule]) -> Column:
    return F.from_json(F.lit(json.dumps([r._asdict() for r in rules])),
                       "array<struct<keyword:string,pattern:string,label:string,priority:int,weight:double>>")


def _places(line: Column, rule: Column) -> Column:
    """Intervals [start, stop) of words that the rule matches. A mark is put
    before each match; as a match begins with a space, the mark ends the word
    before it, and that word's number gives the start."""
    line = F.translate(line, MARK, "\ue001")        # another word character
    marked = F.split(F.regexp_replace(line, F.concat(F.lit("("), rule["pattern"], F.lit(")")), F.lit(f"{MARK}$1")), " ")
    starts = F.filter(F.transform(marked, lambda w, i: F.when(F.endswith(w, F.lit(MARK)), i)),
                      lambda i: i.isNotNull())
    return F.zip_with(starts, F.regexp_extract_all(line, rule["pattern"], F.lit(0)), lambda s, m: F.struct(
        s.alias("start"), (s + _spaces(m)).alias("stop"), rule["label"].alias("label"),
        rule["priority"].alias("priority"), rule["weight"].alias("weight")))


def _all_places(line: Column, rules: list[Rule]) -> Column:
    table = F.filter(_rule_table(rules), lambda r: F.contains(line, r["keyword"]))
    return F.flatten(F.transform(table, lambda r: _places(line, r)))


def _ordered(places: Column) -> Column:
    """By start, then longer first, then priority."""
    return F.array_sort(F.transform(places, lambda p: F.struct(
        p["start"].alias("start"), (-p["stop"]).alias("back"), p["priority"].alias("priority"),
        p["label"].alias("label"), p["weight"].alias("weight"))))


#: For the column ``_order``: the furthest stop up to each place. In step k
#: every entry takes over the one 2^k places before it, so the work grows as
#: n log n.
REACH = """
aggregate(
  sequence(0, length(bin(size(_order)))),
  transform(_order, p -> -p.back),
  (acc, k) -> zip_with(
    acc,
    concat(array_repeat(-1, int(least(power(2, k), size(acc)))),
           slice(acc, 1, int(greatest(size(acc) - power(2, k), 0)))),
    (x, y) -> greatest(x, y)))"""

#: The places that reach further than all before them.
UNSUPPRESSED = """
transform(
  filter(zip_with(_order, concat(array(-1), slice(_reach, 1, greatest(size(_reach) - 1, 0))),
                  (p, before) -> named_struct('p', p, 'kept', -p.back > before)),
         x -> x.p is not null and x.kept),
  x -> named_struct('start', x.p.start, 'stop', -x.p.back, 'label', x.p.label, 'priority', x.p.priority,
                    'weight', x.p.weight))"""


def scan(df: DataFrame, text_col: str = "text", rules: list[Rule] | None = None,
         stems: list[str] | None = None, base: dict[str, str] | None = None) -> DataFrame:
    """``df`` with ``n_words``, ``base_places`` and ``detections`` (arrays of
    start, stop, label, priority, weight). With rules of one's own, ``stems``
    must cover their keywords (default then: the keywords)."""
    own = build_rules() if rules is None else rules
    gate = STEMS if rules is None else (stems or sorted({r.keyword for r in own}))
    phrases = BASE_PHRASES if base is None else base
    basic = [Rule(f" {p} ", f" {p}(?= )", label, 0, 1.0) for p, label in phrases.items()]
    keep = [c for c in df.columns if c not in ("n_words", "base_places", "detections", "_line", "_gate", "_all", "_order", "_reach")]
    stem_found = F.lit(False)
    for s in [*gate, *({r.keyword for r in basic} if base is not None else [])]:
        stem_found = stem_found | F.contains("_line", F.lit(s))
    none = F.array().cast(PLACE)
    line = F.col("_line")
    return (df.select(*keep, word_line(F.col(text_col)).alias("_line"))
            .select(*keep, "_line", stem_found.alias("_gate"))
            .select(*keep, (_spaces(line) - 1).cast("long").alias("n_words"),
                    F.when(F.col("_gate"), _all_places(line, basic)).otherwise(none).alias("base_places"),
                    F.when(F.col("_gate"), _all_places(line, own)).otherwise(none).alias("_all"))
            .select(*keep, "n_words", "base_places", _ordered(F.col("_all")).alias("_order"))
            .select(*keep, "n_words", "base_places", "_order", F.expr(REACH).alias("_reach"))
            .select(*keep, "n_words", "base_places", F.expr(UNSUPPRESSED).alias("detections")))


def joined_labels(places: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
