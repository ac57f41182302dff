"""Benchmark decontamination over canonical templates, in DataFrame functions
alone.

Canonical form: words are runs of letters and digits, lower-cased; a number
(digits with inner ``. , : /``) becomes the placeholder *number*, a word of
``UNITS`` the placeholder *unit*. A name (a capitalised word wherever it
stands, but none of ``OPENERS``; an item without lower-case letters has none
that can be told) is met both as the word itself, in any letter case, and as
the placeholder *name*, which any such
capitalised word of a document can fill. A benchmark question asked again with
other numbers, names or units so has a canonical form in common with its item,
and so has a copy in other letter case.

Windows of ``window`` canonical words are hashed and joined, documents
against benchmark items, by equality of the hash. A window has one hash with
its names as words, and one for each set of its names as placeholders; the
places of these (masks) are read from the benchmark first, and documents are
hashed under a mask only where capitalised words stand at all its places. A
window whose placeholders differ must hold at least ``MIN_LITERALS`` words
that are none (a telling window), unless its item has no such window; a window
that is equal word by word needs none. For every alignment of a document with
an item, the values in the matched placeholders are compared: each value of
the item stands for the document's value that most of its places have (the
first in the item among equals), and the windows with another one are no
evidence unless they are equal word by word. An item has leaked into a
document when the alignments hold at least ``min_share`` of the item's telling
windows, or word by word of all its windows.

The documents' windows are not shuffled where the benchmark's windows are few
enough to broadcast (counted first; ``BROADCAST_WINDOWS``), otherwise both
sides are joined by shuffle. Only matched windows are grouped.

An item shorter than a window is also looked for word by word: each length
that such items have is a further window size, its windows literal.

Defined results: null and empty texts match nothing; a text shorter than a
window is one window as a whole (an item, too, where placeholders are
concerned, so it is met with other values only by its whole equal);
items with equal texts are each reported; repeated document rows are reported
once; null ids are kept as a group of their own; empty tables give an empty
result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwise.plans.materialize import materialize

WINDOW = 5
MIN_SHARE = 0.8
MIN_LITERALS = 3
#: Benchmarks with more windows than this are joined by shuffle (about 150 bytes a window).
BROADCAST_WINDOWS = 100_000
NAME_MARK = "\ue002"
#: Mask of the windows that are hashed word by word.
LITERAL = -1
UNITS = [
    "mm", "cm", "dm", "km", "metre", "metres", "meter", "meters", "kilometre", "kilometres", "kilometer",
    "kilometers", "centimetre", "centimetres", "centimeter", "centimeters", "inch", "inches", "foot", "feet",
    "yard", "yards", "mile", "miles", "mg", "kg", "gram", "grams", "kilogram", "kilograms", "ounce", "ounces",
    "pound", "pounds", "tonne", "tonnes", "ml", "cl", "litre", "litres", "liter", "liters", "gallon", "gallons",
    "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months",
    "year", "years", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent", "degrees", "celsius",
    "fahrenheit", "kelvin", "volt", "volts", "watt", "watts", "joule", "joules", "newton", "newtons",
]
#: Words that are capitalised for their place alone, at the start of a text, sentence or line.
OPENERS = [
    "a", "an", "the", "this", "that", "these", "those", "there", "here", "it", "its", "he", "his", "him", "she", "her",
    "they", "their", "them", "we", "our", "you", "your", "my", "me", "who", "whom", "whose", "what", "which", "when",
    "where", "why", "how", "if", "then", "else", "and", "or", "but", "so", "because", "while", "as", "than", "in", "on",
    "at", "by", "for", "from", "of", "to", "with", "without", "into", "after", "before", "between", "during", "is", "are",
    "was", "were", "be", "been", "do", "does", "did", "has", "have", "had", "can", "could", "should", "would", "shall",
    "must", "not", "no", "yes", "each", "every", "all", "some", "any", "both", "one", "two", "three", "now", "suppose",
    "find", "given", "let", "question", "answer",
]
#: Where a capitalised word starts that can be a name.
CAPITAL = (rf"(?=\p{{Lu}}\p{{L}})(?<![\p{{L}}\p{{M}}\p{{Nd}}])"
           rf"(?!(?i:{'|'.join(OPENERS)})(?![\p{{L}}\p{{M}}\p{{Nd}}]))")


def words_of(text: Column) -> Column:
    """Lower-cased words; those that can be names carry ``NAME_MARK`` in front."""
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit(NAME_MARK), F.lit(" "))
    marked = F.regexp_replace(plain, CAPITAL, NAME_MARK)
    # no group under a +: Java's matcher would recurse along a long run of separators
    cut = rf"[^\p{{L}}\p{{M}}\p{{Nd}}{NAME_MARK}.,:/]+|[.,:/](?!\p{{Nd}})|(?<!\p{{Nd}})[.,:/]"
    return F.filter(F.split(F.lower(marked), cut), lambda w: w != "")


def is_marked(word: Column) -> Column:
    return F.ascii(word) == ord(NAME_MARK)


def bare(word: Column) -> Column:
    return F.when(is_marked(word), F.substring(word, 2, 1 << 30)).otherwise(word)


def typed(word: Column) -> Column:
    """number or unit for a bare word that is such a placeholder, else null."""
    return F.when(F.ascii(word) <= ord("9"), F.lit("number")).when(word.isin(UNITS), F.lit("unit"))


def is_slot(word: Column) -> Column:
    return is_marked(word) | typed(word).isNotNull()


def window_hashes(word_hashes: Column, window: int) -> Column:
    """One hash per place of a window; a shorter text is one window."""
    n = F.size(word_hashes)
    return (F.when(n == 0, F.array().cast("array<bigint>"))
            .when(n < window, F.array(F.xxhash64(word_hashes)))
            .otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - (window - 1), F.lit(1))),
                                   lambda i: F.xxhash64(F.slice(word_hashes, i, window)))))


def _with_windows(df: DataFrame, window: int) -> DataFrame:
    return (df.withColumn("words", words_of(F.col("text")))
            .withColumn("bare", F.transform("words", bare))
            .withColumn("hashes", F.transform("bare", lambda w: F.xxhash64(F.coalesce(typed(w), w))))
            .withColumn("windows", window_hashes(F.col("hashes"), window)))


def name_windows(masks: list[int], window: int) -> Column:
    """(at, hash) of the windows of ``words`` that have capitalised words at
    all places of a mask, with names there. A mask is taken where its first
    place meets a capitalised word, so each window comes up once for it."""
    n, words = F.size("words"), F.col("words")
    capitals = F.filter(F.transform(words, lambda w, i: F.when(is_marked(w), i)), lambda i: i.isNotNull())
    by_shape: dict[tuple, list[list[int]]] = {}
    for m in masks:
        places = [i for i in range(window) if m >> i & 1]
        by_shape.setdefault(tuple(p - places[0] for p in places[1:]), []).append(places)

    def form(c, places):
        at = c - places[0]
        ends = zip([-1, *places], [*places, window])
        kept = [F.slice("hashes", at + (a + 2), F.lit(b - a - 1)) for a, b in ends if b - a > 1]
        fits = (at >= 0) & (at <= F.greatest(n - window, F.lit(0)))
        return F.when(fits, F.struct(at.alias("at"), F.xxhash64(F.lit(sum(1 << p for p in places)), *kept).alias("hash")))

    def at_capital(c):
        out = []
        for shape, masks_there in by_shape.items():
            forms = F.array(*[form(c, p) for p in masks_there])
            if shape:
                met = is_marked(F.get(words, c + shape[0]))
                for p in shape[1:]:
                    met = met & is_marked(F.get(words, c + p))
                forms = F.when(met, forms).otherwise(F.array().cast("array<struct<at:int,hash:bigint>>"))
            out.append(forms)
        return F.concat(*out)
    return F.filter(F.flatten(F.transform(capitals, at_capital)), lambda f: f.isNotNull())


def literal_windows(window: int) -> Column:
    """(at, hash of the bare words) of the windows of ``words`` with fewer than
    ``MIN_LITERALS`` words that are no number or unit."""
    n = F.size("words")
    slots = F.filter(F.transform("bare", lambda w, i: F.when(typed(w).isNotNull(), i)), lambda i: i.isNotNull())
    around = F.transform(F.when(n >= window, slots).otherwise(F.array().cast("array<int>")), lambda i: F.sequence(
        F.greatest(i - (window - 1), F.lit(0)), F.least(i, F.greatest(n - window, F.lit(0)))))
    at = F.filter(F.array_distinct(F.flatten(around)), lambda i: F.size(F.filter(
        F.slice("bare", i + 1, window), lambda w: typed(w).isNull())) < MIN_LITERALS)
    return F.transform(at, lambda i: F.struct(i.alias("at"), literal_hash(F.slice("words", i + 1, window)).alias("hash")))


def literal_hash(words: Column) -> Column:
    return F.xxhash64(F.lit("literal"), F.transform(words, bare))


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(hash, mask, item_id, item_key, item_at, item_words, telling, n_telling,
    n_windows): one row for each set of a telling window's names as
    placeholders (``mask``). Another window is met as it is only; where it has
    so many numbers and units that its hash says little, its mask is
    ``LITERAL`` and the hash that of its words."""
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text"))
    placed = F.transform("windows", lambda h, i: F.struct(
        i.alias("item_at"), F.slice("words", i + 1, window).alias("item_words"),
        F.slice("hashes", i + 1, window).alias("item_hashes")))
    def literals(words, slot):
        return F.size(F.filter(words, lambda x: ~slot(x)))
    unmarked = F.transform("words", bare)
    rows = (_with_windows(items, window)
            .withColumn("words", F.when(F.col("text").rlike(r"\p{Ll}"), F.col("words")).otherwise(unmarked))
            .select("item_id", F.xxhash64("text").alias("item_key"), placed.alias("all"))
            .withColumn("n_telling", F.size(F.filter("all", lambda w: literals(w["item_words"], is_slot) >= MIN_LITERALS))))
    names = F.aggregate(F.transform("item_words", lambda w, i: F.when(is_marked(w), F.call_function(
        "shiftleft", F.lit(1), i)).otherwise(0)), F.lit(0), lambda a, x: a + x)
    # names alone tell nothing: one word or more stays
    words_left = literals(F.col("item_words"), lambda x: typed(bare(x)).isNotNull())
    subsets = F.filter(F.sequence(F.lit(0), names), lambda m: (m.bitwiseAND(names) == m) & (
        (m == 0) | (F.bit_count(m) < words_left)))
    plain = words_left >= MIN_LITERALS
    # a hash of an array goes on from the one before, so the documents' pieces between the names give the same
    kept = F.filter("item_hashes", lambda h, i: F.call_function("shiftright", F.col("mask"), i).bitwiseAND(1) == 0)
    telling = (F.col("n_telling") == 0) | (literals(F.col("item_words"), is_slot) >= MIN_LITERALS)
    return (rows.select("item_id", "item_key", "n_telling", F.size("all").alias("n_windows"), F.explode_outer("all").alias("w"))
            .filter(F.col("w").isNotNull()).select("w.*", "item_id", "item_key", "n_telling", "n_windows")
            .withColumn("telling", telling)
            .withColumn("n_telling", F.when(F.col("n_telling") > 0, F.col("n_telling")).otherwise(F.col("n_windows")))
            .withColumn("mask", F.explode(F.when(F.col("telling"), subsets)
                                          .otherwise(F.array(F.when(plain, F.lit(0)).otherwise(F.lit(LITERAL))))))
            .withColumn("hash", F.when(F.col("mask") == LITERAL, literal_hash(F.col("item_words")))
                        .when(F.col("mask") == 0, F.xxhash64("item_hashes")).otherwise(F.xxhash64("mask", kept)))
            .drop("item_hashes").distinct())


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
          min_share: float = MIN_SHARE, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row per (document, leaked item): the id, ``text_key`` (hash of the
    text), item_id, n_matched and n_windows (of the telling windows, or of all
    word by word where that share is larger), share, and kind: ``copy`` when
    all matched windows are equal word by word, else ``reparameterised``."""
    bench = benchmark_windows(benchmark, item_col, item_text_col, window)
    seen = bench.agg(F.count("*"), F.collect_set("mask")).first()
    few, masks = seen[0] <= broadcast_windows, sorted(m for m in seen[1] if m > 0)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    named = name_windows(masks, window) if masks else F.array().cast("array<struct<at:int,hash:bigint>>")
    if LITERAL in seen[1]:
        named = F.concat(named, literal_windows(window))
    # outer: an inner explode makes Catalyst infer a filter that repeats the whole expression
    places = (_with_windows(texts, window)
              .select("id", F.xxhash64("text").alias("text_key"), "words", "windows", named.alias("named"))
              .select("id", "text_key", "words", F.size("windows").alias("n_plain"), F.col("named.at").alias("named_at"),
                      F.posexplode_outer(F.concat("windows", F.col("named.hash"))).alias("place", "hash"))
              .select("id", "text_key", "words", "hash", F.when(F.col("place") < F.col("n_plain"), F.col("place"))
                      .otherwise(F.get("named_at", F.col("place") - F.col("n_plain"))).alias("doc_at")))
    if few:
        met = places.join(F.broadcast(bench), "hash")
    else:       # shuffle hashes alone, and fetch the words of documents with a match afterwards
        keys = places.drop("words").join(bench, "hash")
        held = texts.select(F.col("id").alias("held_id"), F.xxhash64("text").alias("held_key"),
                            words_of(F.col("text")).alias("words"))
        met = keys.join(held, F.col("id").eqNullSafe(F.col("held_id")) & (F.col("text_key") == F.col("held_key")))
    pair = ["id", "text_key", "item_id", "item_key", "n_telling", "n_windows"]
    # a window's own words, not the document's: all hits of a document are held at once behind the join, which with the
    # document's words in each would be memory by the square of its length. They are cut in the join's own loop: behind
    # it, since before it they (and doc_at) would be worked out for every window, and as a projection of its own, since
    # doc_words is read twice by the next
    met = met.select(*pair, "item_at", "item_words", "telling", "doc_at",
                     F.slice("words", F.col("doc_at") + 1, window).alias("doc_words"))
    pairs = F.zip_with(F.zip_with("item_words", "doc_words", lambda i, d: F.struct(
        i.alias("word"), bare(i).alias("item"), bare(d).alias("doc"))), F.sequence(F.col("item_at"), F.col("item_at") + (
            F.size("item_words") - 1)), lambda p, i: F.struct(i.alias("at"), p["item"].alias("item"), p["doc"].alias("doc"),
                                                             is_slot(p["word"]).alias("slot")))
    literal = F.transform("item_words", bare) == F.transform("doc_words", bare)
    # no filter on pairs here: as a join condition it would part the join from the explode, which then buffers its rows
    # an item's window with what is known of it in one number: place, telling, equal word by word
    code = F.col("item_at") * 4 + F.col("telling").cast("int") * 2 + F.col("literal").cast("int")
    hits = (met.withColumns({"pairs": pairs, "literal": literal})
            .select(*pair, (F.col("doc_at") - F.col("item_at")).alias("shift"), code.alias("code"),
                    F.filter("pairs", lambda p: p["slot"]).alias("slots"))
            # all groupings below are finer than this
            .repartition("id", "text_key", "item_id", "item_key"))
    # per alignment and value of the item: the document's values, and the windows that hold another than the commonest
    values = (hits.select(*pair, "shift", "code", F.explode_outer("slots").alias("slot"))
              .groupBy(*pair, "shift", F.col("slot.item").alias("item"), F.col("slot.doc").alias("doc"))
              .agg(F.size(F.collect_set("slot.at")).alias("n"), F.min("slot.at").alias("first"),
                   F.collect_set("code").alias("codes")))
    voted = (values.groupBy(*pair, "shift", "item")
             .agg(F.max(F.struct("n", (-F.col("first")).alias("early"), "doc"))["doc"].alias("best"),
                  F.collect_list(F.struct("doc", "codes")).alias("all"))
             .select(*pair, "shift", F.flatten("all.codes").alias("codes"),
                     F.flatten(F.filter("all", lambda v: ~v["doc"].eqNullSafe(F.col("best")))["codes"]).alias("other")))
    aligned = (voted.groupBy(*pair, "shift")
               .agg(F.array_distinct(F.flatten(F.collect_list("codes"))).alias("codes"),
                    F.flatten(F.collect_list("other")).alias("other"))
               .select(*pair, F.filter(F.array_union(F.array_except("codes", "other"), F.filter(
                   "codes", lambda c: c.bitwiseAND(1) == 1)), lambda c: c.bitwiseAND(3) != 0).alias("codes")))

    def met_windows(bit):
        kept = F.filter("codes", lambda c: c.bitwiseAND(bit) == bit)
        return F.size(F.array_distinct(F.transform(kept, lambda c: F.call_function("shiftright", c, F.lit(2)))))
    best = F.greatest(F.struct((met_windows(2) / F.col("n_telling")).alias("share"), met_windows(2).alias("n_matched"),
                               F.col("n_telling").alias("n_windows")),
                      F.struct((met_windows(1) / F.col("n_windows")).alias("share"), met_windows(1).alias("n_matched"),
                               F.col("n_windows").alias("n_windows")))
    found = (aligned.groupBy(*pair).agg(F.array_distinct(F.flatten(F.collect_list("codes"))).alias("codes"))
            .select("id", "text_key", "item_id", best.alias("best"),
                    F.forall("codes", lambda c: c.bitwiseAND(1) == 1).alias("same"))
            .filter(F.col("best.share") >= min_share)
            .select(F.col("id").alias(id_col), "text_key", "item_id", "best.n_matched", "best.n_windows", "best.share",
                    F.when(F.col("same"), F.lit("copy")).otherwise(F.lit("reparameterised")).alias("kind")))
    short = short_items(benchmark, item_col, item_text_col, window)
    lengths = sorted(r["n"] for r in short.select("n").distinct().collect())        # below the window
    if not lengths:
        return found
    more = short_leaks(texts, short, lengths).select(
        F.col("id").alias(id_col), "text_key", "item_id", F.lit(1).alias("n_matched"), F.lit(1).alias("n_windows"),
        F.lit(1.0).alias("share"), F.lit("copy").alias("kind"))
    # a short item that is the whole text is found by both
    rest = [c for c in found.columns if c not in (id_col, "text_key", "item_id")]
    one = F.struct((F.col("kind") == "copy").alias("copied"), *rest)
    return found.unionByName(more).groupBy(id_col, "text_key", "item_id").agg(F.max(one).alias("one")) \
        .select(id_col, "text_key", "item_id", *[f"one.{c}" for c in rest])


def short_items(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(item_id, n, item_words, hash) of the items of fewer than ``window`` words."""
    words = F.transform(words_of(F.col(text_col)), bare)
    return (benchmark.select(F.col(item_col).alias("item_id"), words.alias("item_words"))
            .withColumn("n", F.size("item_words")).filter((F.col("n") > 0) & (F.col("n") < window))
            .withColumn("hash", F.xxhash64("item_words")).distinct())


def short_leaks(texts: DataFrame, items: DataFrame, lengths: list[int]) -> DataFrame:
    """(id, text_key, item_id) of the documents (id, text) that hold the words
    of a short item one after the other: by the windows' hashes first, then
    word by word in the documents that these name."""
    def windows(ws, k):
        return F.sequence(F.lit(1), F.greatest(F.size(ws) - (k - 1), F.lit(1)))
    def with_words(of_words):       # the array of one array binds the words, which are then cut once
        return F.transform(F.array(F.transform(words_of(F.col("text")), bare)), of_words)[0]
    def hashes_of(ws, k):
        return F.transform(windows(ws, k), lambda i: F.xxhash64(F.slice(ws, i, k)))
    hashes = with_words(lambda ws: F.array_distinct(F.concat(*[hashes_of(ws, k) for k in lengths])))
    keyed = texts.select("id", "text", F.xxhash64("text").alias("text_key"))
    met = (keyed.select("id", "text_key", F.explode_outer(hashes).alias("hash")).join(items, "hash")
           .select(F.col("id").alias("met_id"), F.col("text_key").alias("met_key"), "item_id", "item_words", "n").distinct())
    holds = with_words(lambda ws: F.exists(windows(ws, F.col("n")), lambda i: F.slice(ws, i, F.col("n"))
                                           == F.col("item_words")))
    same = F.col("id").eqNullSafe(F.col("met_id")) & (F.col("text_key") == F.col("met_key"))
    return keyed.join(materialize(met, "short-items-met"), same).filter(holds).select("id", "text_key", "item_id").distinct()


def drop_leaked(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    # written first: a small table of leaks is then broadcast, and the documents are not shuffled
    found = materialize(leaks(docs, benchmark, id_col, text_col, **options)
                        .select(F.col(id_col).alias("leaked_id"), "text_key").distinct(), "leaked-documents")
    same = docs[id_col].eqNullSafe(F.col("leaked_id")) & (F.xxhash64(docs[text_col]) == F.col("text_key"))
    return docs.join(found, same, "left_anti")
