import re

from cartwise.llm import catalog, license_rules, licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_base(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    places = [(i, label) for phrase, label in licenses.BASE_PHRASES.items() for i in range(len(words))
              if words[i:i + len(phrase.split())] == phrase.split()]
    return len(words), places


def test_rules_are_covered_and_valid():
    rules = license_rules.build_rules()
    assert len(rules) > 300
    for r in rules:
        assert re.compile(r.pattern) and r.pattern.startswith(" ") and "," not in r.label
        assert any(s in f"{r.keyword} " for s in license_rules.STEMS), r


def detections(spark, text, **options):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [(d["start"], d["stop"], d["label"]) for d in licenses.scan(df, **options).first()["detections"]]


def test_longer_and_better_rules_suppress(spark):
    assert detections(spark, "Licensed under CC BY-NC 4.0.") == [(2, 7, "cc-by-nc-4.0")]
    assert detections(spark, "GNU General Public License, version 3 or (at your option) any later version") == [
        (0, 13, "gpl-3-or-later")]
    assert detections(spark, "the MIT License and Apache License, Version 2.0.") == [
        (1, 3, "mit"), (4, 9, "apache-2.0")]
    assert detections(spark, "GPL v2.1") == [(0, 1, "gpl")]
    assert detections(spark, "committed licenses mit licenses") == []
    assert detections(spark, "SPDX-License-Identifier: LGPL-2.1-or-later") == [(0, 8, "lgpl-2.1-or-later")]


def test_own_rules_priority_and_overlap(spark):
    R = license_rules.Rule
    rules = [R(" a b", " a b", "weak", 5, 0.1), R(" a b", " a b", "strong", 1, 0.9), R(" b c", " b c", "over", 9, 0.5),
             R(" b", " b", "inside", 0, 1.0)]
    assert detections(spark, "a b c", rules=rules, stems=["b"]) == [(0, 2, "strong"), (1, 3, "over")]


def test_query_base_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in catalog.op2_license_scan(spark, sf).collect()}
    some = 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        n, places = brute_base(r["text"])
        own = got.pop(r["doc_id"])
        starts = [p for p, _ in places]
        labels = {label for _, label in places}
        assert (own["n_words"], own["n_base"]) == (n, len(places))
        assert own["first_word"] == min(starts, default=None) and own["last_word"] == max(starts, default=None)
        assert own["base_labels"] == ",".join(sorted(labels)) and labels <= {*own["labels"].split(",")} | {""}
        assert 0 <= own["score"] <= 1
        some += bool(places)
    assert some > 10 and not got


def test_edge_rows(spark):
    texts = [None, "", "!!", "cc by cc-by CC  BY", "Mit license", "mit licensed", "K İ É mit license " * 30_000,
             "x" * 60_000, "foo\ue000 mit license \ue000 cc by"]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, detections int")
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    for i, t in enumerate(texts):
        n, places = brute_base(t)
        assert got[i]["n_words"] == n
        assert sorted((p["start"], p["label"]) for p in got[i]["base_places"]) == sorted(places)
    assert len(got[6]["detections"]) == 30_000
    assert licenses.scan(df.limit(0)).count() == 0


def test_suppression_equals_brute_force(spark):
    import random
    R = license_rules.Rule
    rng = random.Random(9)
    words = "a b c d".split()
    rules = [R(f" {w}", f" {w}(?: \\S+){{{n}}}(?= )", f"{w}{n}", rng.randint(0, 9), 0.5) for w in words for n in (1, 2, 4)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.scan(df, rules=rules, stems=words).collect():
        line = f" {' '.join(texts[r['doc_id']].split())} "
        found = sorted((line[:m.start()].count(" "), -(line[:m.start()].count(" ") + m.group().count(" ")), q.priority,
                        q.label) for q in rules for m in re.finditer(q.pattern, line))
        kept, reach = [], -1
        for start, back, _, label in found:
            if -back > reach:
                kept.append((start, -back, label))
                reach = -back
        assert [(d["start"], d["stop"], d["label"]) for d in r["detections"]] == kept


def test_plan_is_one_native_map(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "InArrow" not in plan
