"""URL filter: fixed rules first, association rules for the rest.

A fixed rule names a host and a path; it fits the host and its subdomains when
the url's path starts with the rule's path, and the longest rule that fits
decides. Urls that a fixed rule decides are the labelled ones: Spark's
FP-growth mines combinations of their url tokens with the label, and token
combinations that imply a label with enough confidence and support become
association rules. A rule is pruned when a part of its tokens implies the same
label with no less confidence. The other urls are judged by the mined rules,
found through an inverted index from token to rules.

Tokens are the places of a url (top-level domain, site, first two path
segments, file extension), every host label, path segment, query key, query
value and the fragment, and the words of all these but the values (cut at
``- _ .``); numbers are typed.

Rules of one token come from exact counts. A token that alone implies its
verdict in all its urls, or that all urls have, adds nothing to any combination
(a part would imply the verdict no less surely) and is left out; of tokens that
always occur together one stands for all. These steps lose nothing. FP-growth
finds every frequent combination of the rest, and their number doubles with
each token that urls share loosely; so it is used where no url has more than
``WIDTH`` of these tokens. Where urls have more, the same rules are searched
for over all their tokens: combinations are extended token by token, counted in
bit sets of the urls, and left when no extension can become a rule that says
more than its parts (``searched``). Both ways are exact and no token is dropped.

Defined results: a null url or one without ``://`` has empty host and path,
no rule, and the default verdict; a url that no mined rule fits has the
default verdict too; equally confident rules are decided by support, then by
more tokens, then by name; no labelled url means no mined rules; repeated rows
get equal results; an empty table gives an empty table; input columns named
like the results are replaced, all others kept.
"""

from __future__ import annotations

from collections import Counter
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwise.llm.batches import add_columns, map_batches
from cartwise.plans.materialize import materialize

#: (verdict, host, path)
FIXED_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
               ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Least share, and least number, of the labelled urls that a rule's tokens and label must occur in.
MIN_SUPPORT = 0.002
MIN_COUNT = 5
MIN_CONFIDENCE = 0.8
DEFAULT_VERDICT = "allow"
#: Up to this many tokens to combine in every url FP-growth finds the combinations, beyond it a search.
WIDTH = 12
#: Combinations that a step of the search counts, about.
STEP = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules=FIXED_RULES) -> Column:
    """struct(rule, verdict) of the longest fixed rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Tokens ``place=value``, distinct; places that a url lacks have none."""
    name = F.regexp_replace(host, r":[0-9]*$", "")
    query, fragment = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), F.regexp_extract(url, r"(?s)#(.*)$", 1)
    labels, segments, pairs = F.split(name, r"\."), F.split(path, "/"), F.split(query, "[&;]")
    keys = F.transform(pairs, lambda p: F.substring_index(p, "=", 1))
    values = {
        "tld": F.array(F.regexp_extract(name, r"([^.]+)$", 1)),
        "site": F.array(F.regexp_extract(name, r"([^.]+\.[^.]+)$", 1)),
        "label": labels,
        "host": words(labels),
        "dir1": F.array(F.regexp_extract(path, r"^/([^/]+)", 1)),
        "dir2": F.array(F.regexp_extract(path, r"^/[^/]+/([^/]+)", 1)),
        "dir": segments,
        "path": words(segments),
        "ext": F.array(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)),
        "key": keys,
        "query": words(keys),
        "value": F.transform(F.filter(pairs, lambda p: F.contains(p, F.lit("="))),
                             lambda p: F.regexp_replace(p, r"=[0-9]+$", "=#")),
        "fragment": F.array(fragment),
        "anchor": words(F.array(fragment)),
    }
    def named(place, parts):
        return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(
            F.lit(f"{place}="), F.regexp_replace(F.lower(x), r"^[0-9]+$", "#")))
    return F.array_distinct(F.concat(*[named(k, v) for k, v in values.items()]))


def words(parts: Column) -> Column:
    return F.flatten(F.transform(parts, lambda p: F.split(p, r"[-_.]")))


def token_facts(labelled: DataFrame, least: float) -> dict[str, dict]:
    """Of each token in ``least`` labelled urls or more: n, counts by verdict,
    and sums of its urls' hashes (equal for tokens of the same urls). There
    are at most as many as a url has tokens, divided by the support."""
    row = F.xxhash64(F.array_sort("tokens"))
    sums = [F.count("*").alias("c"), F.sum(F.shiftright("row", 32)).alias("high"),
            F.sum(F.col("row").bitwiseAND(0xFFFFFFFF)).alias("low")]
    by_verdict = labelled.select(F.explode("tokens").alias("token"), "verdict", row.alias("row")) \
        .groupBy("token", "verdict").agg(*sums)
    facts = by_verdict.groupBy("token").agg(
        F.sum("c").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"),
        F.map_from_entries(F.collect_list(F.struct("verdict", "c"))).alias("by")).filter(F.col("n") >= least)
    return {r["token"]: r.asDict() for r in facts.collect()}


def _baskets(held, width: int, tokens_at: int):
    """Batch function: a url's tokens to combine, and whether they are more than ``width``."""
    place = held.value

    def fn(batch: pa.RecordBatch) -> list[pa.Array]:
        kept = [sorted({t for t in tokens or () if t in place}, key=place.get)
                for tokens in batch.column(tokens_at).to_pylist()]
        return [pa.array(kept, pa.list_(pa.string())), pa.array([len(k) > width for k in kept])]
    return fn


def _bit_sets(batches, held):
    """Per batch of (tokens, verdict) one row: its tokens' places, the urls of
    each as a bit set, and the urls of each verdict."""
    place, verdicts = held.value
    for b in batches:
        size = -(-b.num_rows // 8)
        sets: dict[int, bytearray] = {}
        of = {v: bytearray(size) for v in verdicts}
        for k, (tokens, verdict) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            for mask in (of[verdict], *[sets.setdefault(place[t], bytearray(size)) for t in tokens]):
                mask[k >> 3] |= 1 << (k & 7)
        yield pa.RecordBatch.from_arrays([
            pa.array([list(sets)], pa.list_(pa.int32())), pa.array([[*map(bytes, sets.values())]], pa.list_(pa.binary())),
            pa.array([[bytes(of[v]) for v in verdicts]], pa.list_(pa.binary()))], names=["places", "sets", "of"])


def _count_extensions(batches, held):
    """Per block, extension and verdict: the urls of the combination with the
    extension, and those of them that have all later extensions too."""
    for b in batches:
        for row in range(b.num_rows):
            places, sets, of = (b.column(k)[row].as_py() for k in range(3))
            urls = {p: int.from_bytes(x, "little") for p, x in zip(places, sets, strict=True)}
            masks = [int.from_bytes(x, "little") for x in of]
            everything, found, first = sum(masks), [], 0       # every url has one verdict
            for tokens, tail in held.value:
                own = everything
                for t in tokens:
                    own &= urls.get(t, 0)
                later = own
                for k in range(len(tail) - 1, -1, -1) if own else ():
                    with_k = own & urls.get(tail[k], 0)
                    later &= with_k
                    if with_k:
                        found += [(first + k, v, n, (later & m).bit_count()) for v, m in enumerate(masks)
                                  if (n := (with_k & m).bit_count())]
                first += len(tail)
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64()))],
                names=["extension", "verdict", "n", "n_all"])


def searched(baskets: DataFrame, place: dict[str, int], totals: dict[str, int], least: float, min_confidence: float,
             known: dict[tuple[str, str], float], step: int = STEP) -> list[dict]:
    """All rules of two or more tokens of ``baskets`` (mined, verdict) that
    imply their verdict more surely than every part does, among others (see
    ``prune``). ``known``: the confidence of the rules of one token.

    Combinations are extended by tokens of later place only, so each is met
    once. For a verdict an extension is left out if the urls of other verdicts
    stay the same (any combination with it says no more than without it), or
    if too few of the verdict's own are left. A combination is not extended if
    even its own urls of the verdict, against those of other verdicts that
    have all the tokens that could still follow, are no surer than the
    threshold or a part of it. A step takes the combinations met last, so that
    few wait; the urls are counted where they lie."""
    spark = baskets.sparkSession
    verdicts, names = sorted(totals), sorted(place, key=place.get)
    held = spark.sparkContext.broadcast((place, verdicts))
    blocks = materialize(map_batches(baskets.select("mined", "verdict"), partial(_bit_sets, held=held),
                                     "places array<int>, sets array<binary>, of array<binary>"), "url-bit-sets")
    n, rules = sum(totals.values()), []
    # tokens, what may follow, urls by verdict, the surest part by verdict that may still be surpassed
    waiting = [((), tuple(range(len(names))), [totals[v] for v in verdicts], dict.fromkeys(range(len(verdicts)), 0.0))]
    while waiting:
        taken = [waiting.pop()]
        while waiting and sum(len(t[1]) for t in taken) + len(waiting[-1][1]) <= step:
            taken.append(waiting.pop())
        sent = spark.sparkContext.broadcast([t[:2] for t in taken])
        counted = map_batches(blocks, partial(_count_extensions, held=sent),
                              "extension long, verdict int, n long, n_all long") \
            .groupBy("extension", "verdict").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all")).collect()
        sent.unpersist()
        counts: dict[int, list] = {}
        for r in counted:
            counts.setdefault(r["extension"], [[0] * len(verdicts), [0] * len(verdicts)])
            counts[r["extension"]][0][r["verdict"]], counts[r["extension"]][1][r["verdict"]] = r["n"], r["n_all"]
        first = 0
        for tokens, tail, own, surest in taken:
            follow: dict[int, list] = {v: [] for v in surest}
            for k in range(len(tail) - 1, -1, -1):
                has, has_all = counts.get(first + k, ([0] * len(verdicts),) * 2)
                useful = [v for v in surest if has[v] >= least and sum(has) - has[v] < sum(own) - own[v]]
                open_to = {}
                for v in useful:
                    part = max(surest[v], known.get((names[tail[k]], verdicts[v]), 0.0))
                    confidence = has[v] / sum(has)
                    if tokens and confidence >= min_confidence and confidence > part:
                        rules.append({"tokens": sorted(names[t] for t in (*tokens, tail[k])), "verdict": verdicts[v],
                                      "confidence": confidence, "support": has[v] / n})
                        part = confidence
                    best = has[v] / (has[v] + sum(has_all) - has_all[v])
                    if best >= min_confidence and best > part and sum(has) > has[v]:
                        open_to[v] = part
                after = sorted({t for v in open_to for t in follow[v]})
                if after:
                    waiting.append(((*tokens, tail[k]), tuple(after), has, open_to))
                for v in useful:
                    follow[v].append(tail[k])
            first += len(tail)
    return rules


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
         width: int = WIDTH) -> list[dict]:
    """Association rules tokens -> verdict of ``labelled`` (tokens, verdict):
    tokens, verdict, confidence, support and, where tokens stand for others
    that occur in the same urls, ``also`` (token to all of them)."""
    from pyspark.ml.fpm import FPGrowth

    totals = {r["verdict"]: r["count"] for r in labelled.groupBy("verdict").count().collect()}
    n = sum(totals.values())
    if not n:
        return []
    share = min(1.0, max(min_support, MIN_COUNT / n))
    least = share * n * (1 - 1e-9)
    facts = token_facts(labelled, least)
    rules = [{"tokens": [t], "verdict": v, "confidence": c / f["n"], "support": c / n}
             for t, f in facts.items() for v, c in f["by"].items() if c >= least and c >= min_confidence * f["n"]]
    # what can be part of a combination that says more than its parts
    classes: dict[tuple, list[str]] = {}
    for t, f in sorted(facts.items()):
        if f["n"] < n and max(f["by"].values()) < f["n"]:
            classes.setdefault((f["n"], f["high"], f["low"]), []).append(t)
    members = {c[0]: c for c in classes.values()}
    # rare tokens first: they leave few urls to the many tokens that follow
    place = {t: k for k, t in enumerate(sorted(members, key=lambda t: (facts[t]["n"], t)))}
    if len(place) > 1:
        held = labelled.sparkSession.sparkContext.broadcast(place)
        fields = [T.StructField("mined", T.ArrayType(T.StringType())), T.StructField("more", T.BooleanType())]
        baskets = materialize(add_columns(labelled.select("tokens", "verdict"), fields, partial(_baskets, held, width, 0))
                              .select("mined", "verdict", "more"), "url-baskets")
        if baskets.filter("more").head(1):
            rules += searched(baskets, place, totals, least, min_confidence,
                              {(r["tokens"][0], r["verdict"]): r["confidence"] for r in rules})
        else:
            items = baskets.select(F.array_append("mined", F.concat(F.lit("verdict="), "verdict")).alias("items"))
            found = FPGrowth(itemsCol="items", minSupport=share, minConfidence=min_confidence).fit(items).associationRules
            rows = found.filter(F.col("consequent")[0].startswith("verdict=") & (F.size("antecedent") > 1)).select(
                F.array_sort("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], 9, 100).alias("verdict"),
                "confidence", "support").collect()
            rules += [r.asDict() for r in rows]
    return [r | ({"also": also} if len(r["tokens"]) > 1 and (also := {
        t: members[t] for t in r["tokens"] if len(members[t]) > 1}) else {}) for r in prune(rules)]


def prune(rules: list[dict]) -> list[dict]:
    """Without rules of which a part already implies the same verdict with no
    less confidence."""
    kept: list[dict] = []
    index: dict[str, list[int]] = {}
    for r in sorted(rules, key=lambda r: (len(r["tokens"]), r["tokens"], r["verdict"])):
        seen = Counter(k for t in r["tokens"] for k in index.get(t, ()))
        if any(n == len(kept[k]["tokens"]) and kept[k]["verdict"] == r["verdict"]
               and kept[k]["confidence"] >= r["confidence"] for k, n in seen.items()):
            continue
        for t in r["tokens"]:
            index.setdefault(t, []).append(len(kept))
        kept.append(r)
    return kept


def _match(held, tokens_at: int):
    """Batch function: the best mined rule of each row's tokens."""
    best = sorted(held.value, key=lambda r: (-r["confidence"], -r["support"], -len(r["tokens"]), r["tokens"]))
    index: dict[str, list[tuple[int, str]]] = {}
    for k, r in enumerate(best):
        for t in r["tokens"]:
            for same in r.get("also", {}).get(t, [t]):
                index.setdefault(same, []).append((k, t))

    def one(tokens):
        seen = Counter(k for k, _ in {place for t in tokens or () for place in index.get(t, ())})
        fits = [k for k, n in seen.items() if n == len(best[k]["tokens"])]
        if not fits:
            return None, None, None
        r = best[min(fits)]
        return " & ".join(r["tokens"]), r["verdict"], r["confidence"]

    def fn(batch: pa.RecordBatch) -> list[pa.Array]:
        got = [one(t) for t in batch.column(tokens_at).to_pylist()]
        return [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64()))]
    return fn


def judge(pages: DataFrame, url_col: str = "url", rules=FIXED_RULES, min_support: float = MIN_SUPPORT,
          min_confidence: float = MIN_CONFIDENCE, default: str = DEFAULT_VERDICT) -> DataFrame:
    """``pages`` with host, path, rule, verdict, mined_rule and confidence
    (the last two null where a fixed rule decides)."""
    made = ["host", "path", "rule", "verdict", "mined_rule", "confidence", "_url", "_fixed", "_tokens", "_mined"]
    keep = [c for c in pages.columns if c not in made]
    url = F.col("_url")
    parsed = (pages.select(*keep, F.when(F.contains(url_col, F.lit("://")), F.col(url_col)).alias("_url"))
              .select(*keep, "_url", host_of(url).alias("host"), path_of(url).alias("path"))
              .select(*keep, "host", "path", fixed_rule(F.col("host"), F.col("path"), rules).alias("_fixed"),
                      F.coalesce(url_tokens(url, F.col("host"), F.col("path")),
                                 F.array().cast("array<string>")).alias("_tokens")))
    mined = mine(parsed.filter(F.col("_fixed").isNotNull())
                 .select(F.col("_tokens").alias("tokens"), F.col("_fixed.verdict").alias("verdict")),
                 min_support, min_confidence)
    held = pages.sparkSession.sparkContext.broadcast(mined)
    fields = [T.StructField("mined_rule", T.StringType()), T.StructField("_mined", T.StringType()),
              T.StructField("confidence", T.DoubleType())]
    matched = add_columns(parsed, fields, partial(_match, held, parsed.columns.index("_tokens")))
    free = F.col("_fixed").isNull()
    return matched.select(
        *keep, "host", "path", F.col("_fixed.rule").alias("rule"),
        F.coalesce("_fixed.verdict", "_mined", F.lit(default)).alias("verdict"),
        F.when(free, F.col("mined_rule")).alias("mined_rule"), F.when(free, F.col("confidence")).alias("confidence"))
