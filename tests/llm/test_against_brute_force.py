"""Operators that SQL cannot express, against plain implementations of their contracts."""

import collections
import hashlib
import random
import re
import zlib

import pytest
import xxhash

from quillspan.llm import decontaminate, licenses, mixing, pii, quality_gbt, quality_rules, registry, sharding, simhash_dedup, suffix_dedup
from quillspan.llm.components import components
from quillspan.llm.run_index import RunIndex

from .helpers import frame, jaccard_groups, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def rows_of(spark, sf_dir, name):
    return {r["doc_id"]: r for r in registry.QUERIES[name](spark, sf_dir).collect()}


def luhn(s):
    return sum(d if i % 2 == 0 else (d * 2 if d < 5 else d * 2 - 9) for i, d in enumerate(map(int, reversed(s)))) % 10 == 0


def plain_pii(t):
    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [(m.start(), 2, "card", m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m)) <= 15]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def test_pii_base_spans_on_random_text():
    rng = random.Random(4)
    for _ in range(3000):
        t = "".join(rng.choice(["a", "b", "@", ".", "-", "+", " ", "(", ")", "1", "2", "255", "300", "_", "é", "4111111111111111", "x@y.z", "\n"]) for _ in range(rng.randrange(1, 25)))
        assert pii.base_spans(t) == plain_pii(t), t


def test_pii_query(spark, sf_dir, documents):
    for i, r in rows_of(spark, sf_dir, "op1_pii").items():
        base = plain_pii(documents[i])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(b[0] == k for b in base) for k in pii.BASE_KINDS]
        assert set(filter(None, text.split(","))) <= set(r["spans"].split(","))


def test_pii_secret_is_added_and_redacted(spark):
    docs = frame(spark, ['x token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" y', "nothing here at all", "mail me a@b.co"] * 5)
    found = pii.detect_pii(docs)
    assert {s["kind"] for r in found.collect() for s in r["spans"]} == {"secret", "email"}
    assert sorted({r["text"] for r in pii.redact(docs, found).collect()}) == ["mail me [email]", "nothing here at all", 'x token = "[secret]" y']


def test_rule_statistics(spark, sf_dir, documents):
    for i, r in rows_of(spark, sf_dir, "op3_quality_rules").items():
        t = documents[i]
        words = WORD.findall(t)
        windows = collections.Counter(zip(words, words[1:], words[2:]))
        covered = {p for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert want == tuple(r[k] for k in quality_rules.STATS)
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_forest_keeps_labelled_good_and_drops_bad(spark):
    out = quality_rules.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    known = out.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("not base_failed")
    assert known.filter("quality = 1").selectExpr("avg(int(kept))").first()[0] >= 0.99
    assert known.filter("quality = 0").selectExpr("avg(int(kept))").first()[0] <= 0.1


def test_boosted_trees_on_held_out_rows(spark):
    rows = registry.QUERIES["op4_quality_gbt"](spark, "/root/testdata/sf0.01").collect()
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    held = [(r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum((s >= 0.5) == (q == 1) for s, q in held) / len(held) >= 0.95
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) >= 0.98


def test_flattened_trees_match_a_walk():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.random((400, 3))
    model = quality_gbt.fit(x, (x[:, 0] + 0.2 * x[:, 1] > 0.6).astype(float), trees=5)

    def walk(row):
        raw = model["bias"]
        for f, e, leaf in zip(model["feature"], model["edge"], model["leaf"]):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + int(row[f[at]] > e[at])
            raw += leaf[at - len(f)]
        return 1 / (1 + np.exp(-raw))

    assert np.allclose(quality_gbt.predict(model, x), [walk(r) for r in x])


def test_run_index_on_small_alphabets():
    rng = random.Random(2)
    for _ in range(200):
        segments = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 8))]
        length = rng.randint(2, 6)
        index = RunIndex(segments)
        hit = index.long_matches(length)
        count = collections.Counter(s[i : i + length] for s in segments for i in range(len(s) - length + 1))
        for s, at in zip(segments, index.starts):
            want = [count[s[i : i + length]] > 1 for i in range(len(s) - length + 1)]
            assert hit[at : at + len(want)].tolist() == want


def plain_repeats(texts, length):
    data = {i: (t or "").encode() for i, t in texts.items()}
    count = collections.Counter(b[k : k + length] for b in data.values() for k in range(len(b) - length + 1))
    out = {}
    for i, b in data.items():
        cover = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                cover[k : k + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, cover) if not c)
        out[i] = (len(b), sum(cover), sum(c and not (k and cover[k - 1]) for k, c in enumerate(cover)), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_query(spark, sf_dir, documents):
    got = {i: tuple(r)[1:] for i, r in rows_of(spark, sf_dir, "op5_repeated_strings").items()}
    assert got == plain_repeats(documents, 400)


@pytest.mark.parametrize("fit", [3, 20, 2000])
def test_repeats_with_hot_anchors(spark, fit):
    """One passage in most texts with different surroundings; small groups force further dealing, level by level."""
    passage = prose(9, 120)
    texts = [prose(100 + i, 30) + " " + (passage if i % 4 else passage[: 450 + i]) + " " + prose(200 + i, 25) for i in range(60)] + ["ab" * 700, "xyz" * 300, "q" * 1000, prose(5, 20) * 8]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in suffix_dedup.remove_repeats(frame(spark, texts), fit=fit).collect()}
    assert got == plain_repeats(dict(enumerate(texts)), 400)


def test_repeats_with_null_and_equal_ids(spark):
    """A null id, one id with two texts, and many equal rows: every row has the result of its text."""
    shared, other = prose(9, 120), prose(12, 150)
    rows = [(None, shared + " a b c"), (2, "x y z " + shared), (2, prose(3, 100)), *[(3, other)] * 30, (None, prose(4, 90) + other[:500])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((str(i), *r) for (i, _), r in zip(rows, plain_repeats(dict(enumerate(t for _, t in rows)), 400).values()))
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == want
    assert suffix_dedup.repeated_spans(docs).selectExpr("max(size(marks))").first()[0] < 20


def test_sharding_law(spark, sf_dir, documents):
    rows = list(registry.QUERIES["op6_sharding"](spark, sf_dir).collect())
    loads, by_text = collections.Counter(), collections.defaultdict(set)
    slots = collections.defaultdict(list)
    for r in rows:
        t = documents[r["doc_id"]]
        assert r["size"] == len(t.encode()) + 8 and r["text_crc32"] == zlib.crc32(t.encode())
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        by_text[t].add(r["shard"])
    assert len(rows) == len(documents) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in by_text.values())
    largest = max(collections.Counter({t: 0 for t in by_text}).keys() and [sum(len(documents[i].encode()) + 8 for i in documents if documents[i] == t) for t in by_text])
    assert max(loads.values()) - min(loads.get(s, 0) for s in range(24)) <= largest


def test_heap_takes_the_least_loaded():
    loads = [0.0] * 3
    assert sharding.place([7, 5, 4, 3, 1], loads) == [0, 1, 2, 2, 1] and loads == [7, 6, 7]


def test_many_buckets_stay_even(spark):
    docs = frame(spark, [prose(i, 5 + i % 90) for i in range(1500)])
    loads = collections.Counter()
    for r in sharding.assign(docs, shards=4, bucket_groups=100).collect():
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) - min(loads.values()) < 0.02 * sum(loads.values()) / 4


def plain_fingerprint(t):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius=2):
    parent = {i: i for i in fps}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if b < a and (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_simhash_query(spark, sf_dir, documents):
    fps = {i: plain_fingerprint(t) for i, t in documents.items()}
    want = plain_components(fps)
    for i, r in rows_of(spark, sf_dir, "op7_simhash_dedup").items():
        assert (r["fingerprint"], r["component_id"]) == (format(fps[i], "016x"), want[i])


@pytest.mark.parametrize("chunk", [2, 2000])
def test_simhash_links_on_dense_fingerprints(spark, chunk):
    rng = random.Random(6)
    fps = {i: v for i, v in enumerate({sum(1 << rng.choice([1, 5, 30, 40, 60, 63]) for _ in range(rng.randrange(7))) % (1 << 64) for _ in range(80)} | {rng.getrandbits(64) for _ in range(50)})}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame_ = spark.createDataFrame([(signed(v),) for v in fps.values()], "fp long")
    roots = {r["node"]: r["root"] for r in components(simhash_dedup.links(frame_, 2, chunk)).collect()}
    want = plain_components(fps)
    groups = collections.defaultdict(set)
    for i, v in fps.items():
        groups[want[i]].add(roots.get(signed(v), signed(v)))
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)


def test_bk_tree_finds_all_within_radius():
    rng = random.Random(3)
    values = [rng.getrandbits(12) for _ in range(300)]
    tree = simhash_dedup.BKTree()
    for v in values:
        tree.add(v)
    for q in range(0, 4096, 97):
        assert sorted(values[k] for k in tree.within(q, 2)) == sorted(v for v in values if (v ^ q).bit_count() <= 2)


def test_components_of_a_long_chain(spark):
    chain = spark.range(300).selectExpr("id as u", "id + 1 as v")
    assert {r["root"] for r in components(chain).collect()} == {0}


def test_mixing_meets_marginals_and_budget(spark, sf_dir):
    from pyspark.sql import functions as F

    docs = mixing.with_features(spark.read.parquet(f"{sf_dir}/documents.parquet").drop("n_chars"))
    cells = docs.groupBy(*mixing.MARGINS).agg(F.sum("n_tokens").alias("tokens"))
    raked = mixing.rake(cells, rounds=24)
    total = raked.agg(F.sum("fitted"), F.first("total")).first()
    assert abs(total[0] - total[1]) < 1e-6 * total[1]
    for m in mixing.MARGINS:
        rows = raked.groupBy(m).agg(F.sum("fitted").alias("f"), F.sum("tokens").alias("t"), F.first("total").alias("n")).collect()
        raw = {r[m]: (r["t"] / r["n"]) ** mixing.TEMPER for r in rows}
        assert all(abs(r["f"] / r["n"] - raw[r[m]] / sum(raw.values())) < 1e-4 for r in rows)
    mixed = mixing.mix(docs, features=docs)
    expected, tokens = mixed.agg(F.sum(F.col("n_tokens") * F.col("probability")), F.sum("n_tokens")).first()
    assert abs(expected / tokens - mixing.KEEP_SHARE) < 0.01


def test_mixing_at_the_shipped_rounds_and_with_given_targets(spark, sf_dir):
    docs = mixing.with_features(spark.read.parquet(f"{sf_dir}/documents.parquet").drop("n_chars"))
    cells = docs.groupBy(*mixing.MARGINS).agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "tokens")
    errors = mixing.marginal_errors(mixing.rake(cells)).collect()
    assert max(abs(r["target"] - r["fitted"]) for r in errors) < 1e-3
    languages = sorted({r["value"] for r in errors if r["margin"] == "lang"})
    wanted = {languages[0]: 0.5, languages[1]: 0.2, "no such language": 0.0}
    got = {r["value"]: r for r in mixing.marginal_errors(mixing.rake(cells, rounds=40, targets={"lang": wanted})).filter("margin = 'lang'").collect()}
    assert all(abs(got[x]["target"] - wanted[x]) < 1e-9 for x in languages[:2]) and abs(sum(r["target"] for r in got.values()) - 1) < 1e-9
    assert max(abs(r["target"] - r["fitted"]) for r in got.values()) < 1e-3


def test_mixing_by_shuffle_equals_broadcast(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one = sorted(tuple(r) for r in mixing.mix(docs).select("doc_id", "probability", "kept").collect())
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", 0)
    assert one == sorted(tuple(r) for r in mixing.mix(docs).select("doc_id", "probability", "kept").collect())


def test_licences(spark):
    mit = (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
    )
    texts = ["x y.\nLicensed under the Apache License, Version 2.0.", mit, "Released under the MIT License. Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: Apache-2.0", "the MIT license is mentioned here", None]
    got = [[(s["licence"], s["sentences"]) for s in r["spans"]] for r in licenses.scan_licences(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got == [[("Apache-2.0", 1)], [("MIT", 2)], [("MIT", 1), ("CC-BY-NC-4.0", 1)], [("Apache-2.0", 1)], [], []]


def test_licences_query(spark, sf_dir, documents):
    """The notices of the tables stand on lines of their own: found by plain comparison of lines."""
    notices = {
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    }
    for i, r in rows_of(spark, sf_dir, "op9_licenses").items():
        want = {notices[x] for x in documents[i].split("\n") if x in notices}
        assert {x for x in r["licences"].split(",") if x and x != "Proprietary"} == want


def test_licence_rules_are_ordered_with_gaps():
    rules = licenses.ordered_rules()
    assert licenses.match_rules([(0, "bsd-grant"), (1, "bsd-source"), (3, "bsd-binary"), (4, "bsd-names")], rules) == [("BSD-3-Clause", 0, 4)]
    assert licenses.match_rules([(0, "bsd-grant"), (1, "bsd-source"), (4, "bsd-binary")], rules) == []


def plain_leaks(documents, items, threshold=0.8):
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s or "").encode().split()
    gram = lambda w: collections.Counter(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else collections.Counter([tuple(w)])
    bags = {k: (low(t), gram(low(t))) for k, t in items.items() if low(t)}
    out = {}
    for i, t in documents.items():
        words = low(t)
        own = set(gram(words)) if words else set()
        for k, (w, bag) in bags.items():
            if len(w) >= 5 and not own & set(bag):
                continue
            best = 0
            for a in range(max(1, len(words) - len(w) + 1)):
                c = gram(words[a : a + len(w)])
                best = max(best, sum((c & bag).values()) / sum((c | bag).values()))
            if best >= threshold:
                out[i, k] = round(best, 9)
    return out


def test_leaks_query(spark, sf_dir, documents):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in registry.QUERIES["op10_decontaminate"](spark, sf_dir).collect()}
    assert got == plain_leaks(documents, items)


def test_leaks_with_edits_short_items_and_blocks(spark, monkeypatch):
    rng = random.Random(8)
    items = {k: prose(k, rng.choice([3, 12, 40])) for k in range(12)}
    texts = []
    for k in range(60):
        w = items[k % 12].split()
        if k % 3 == 1 and len(w) > 30:
            w[rng.randrange(len(w))] = "changed"
        texts.append(prose(500 + k, k) + " " + " ".join(w).upper() + " " + prose(900 + k, k))
    table = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = plain_leaks(dict(enumerate(texts)), items)
    for size in (8 << 20, 500):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        assert (decontaminate.block_count(table) > 1) == (size == 500)
        got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in decontaminate.find_leaks(frame(spark, texts), table).collect()}
        assert got == want
        kept = {r["doc_id"] for r in decontaminate.drop_leaks(frame(spark, texts), table).collect()}
        assert kept == set(range(60)) - {i for i, _ in want}


def test_pipeline_stages_and_result(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        out = stage(spark, docs, sf_dir)
        rows = out.collect()
        assert {r["doc_id"] for r in rows} <= set(before)
        if k == 0:
            verdict = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
            assert {r["doc_id"] for r in rows} == {i for i, v in verdict.items() if v}
        elif k == 1:
            ids = sorted(before)
            assert {r["doc_id"] for r in rows} == {ids[g] for g in jaccard_groups([before[i] for i in ids])}
        elif k == 2:
            items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
            assert {r["doc_id"] for r in rows} == set(before) - {i for i, _ in plain_leaks(before, items)}
        elif k == 4:
            assert {r["doc_id"] for r in rows} == set(before)
        docs = out
    final = corpus_pipeline.run(spark, sf_dir)
    assert sorted(tuple(r) for r in final.collect()) == sorted(tuple(r) for r in rows)
