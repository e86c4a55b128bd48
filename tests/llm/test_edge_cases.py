"""Every operator and stage on nulls, odd texts, repeated rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

from quillspan.llm import decontaminate, licenses, mixing, pii, quality_gbt, quality_rules, sharding, simhash_dedup, suffix_dedup, warc

from .helpers import SCHEMA, frame, odd_texts, prose, with_clashes


def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (7, 1, 0), (12, 0, 0), (9, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")


def bench(spark):
    return spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog today"), (2, None), (3, ""), (4, "two words")], "item_id long, text string")


OPERATORS = {
    "pii": lambda s, d: pii.detect_pii(d),
    "rules": lambda s, d: quality_rules.judge(d, labels(s)),
    "keep": lambda s, d: quality_rules.keep(d, labels(s)),
    "gbt": lambda s, d: quality_gbt.score(d, labels(s)),
    "repeats": lambda s, d: suffix_dedup.remove_repeats(d),
    "sharding": lambda s, d: sharding.assign(d),
    "simhash": lambda s, d: simhash_dedup.near_duplicates(d),
    "keep_one": lambda s, d: simhash_dedup.keep_one(d),
    "mixing": lambda s, d: mixing.mix(d),
    "licences": lambda s, d: licenses.scan_licences(d),
    "leaks": lambda s, d: decontaminate.find_leaks(d, bench(s)),
    "drop_leaks": lambda s, d: decontaminate.drop_leaks(d, bench(s)),
}
ONE_ROW_EACH = {"pii", "rules", "gbt", "repeats", "sharding", "simhash", "mixing", "licences", "drop_leaks"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    base = frame(spark, odd_texts())
    null_cells = spark.createDataFrame([(None, "the of and", None, None, None), (99, None, None, None, None)], SCHEMA)
    docs = with_clashes(base.unionByName(base.filter("doc_id in (7, 1)")).unionByName(null_cells))
    got = OPERATORS[name](spark, docs).count()
    if name in ONE_ROW_EACH:
        assert got == docs.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_empty_benchmark_and_labels(spark):
    docs = frame(spark, odd_texts())
    assert decontaminate.find_leaks(docs, bench(spark).limit(0)).count() == 0
    none = labels(spark).limit(0)
    assert quality_rules.judge(docs, none).filter("kept").count() == quality_rules.judge(docs, none).filter("not base_failed").count()
    assert quality_gbt.score(docs, none).select(F.min("score"), F.max("score")).first() == (0.5, 0.5)


def test_warc_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "a\r\nb", "x\r\n\r\ny" * 300), (4, "c", "x\r\n\r\ny" * 300), (5, "d", "é" * 999), (-6, "e", "WARC/1.1\r\n\r\n" * 200)]
    pages = with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r["page_id"]: r for r in warc.read_archives(spark, warc.resolve_revisits(spark, warc.write_archives(pages))).collect()}
    assert set(got) == {1, 2, 3, 4, 5, -6}
    assert (got[3]["record_type"], got[3]["refers_to"], got[4]["record_type"]) == ("revisit", 4, "response")
    assert got[1]["payload_bytes"] == 0 and got[5]["payload_bytes"] == 1998
    empty = pages.limit(0)
    assert warc.read_archives(spark, warc.resolve_revisits(spark, warc.write_archives(empty))).count() == 0


def test_long_runs_of_digits(spark):
    """Leading zeros do not count, in any part and at any length."""
    texts = [".".join("0" * (n if k == part else 0) + "7" for k in range(4)) for n in (5_000, 100_000) for part in range(4)] + ["0" * 5000 + "256.1.1.1", "0.0.0." + "0" * 9000]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] == "ip"] for r in pii.detect_pii(frame(spark, texts)).collect()}
    assert got == {i: [("ip", 0, len(t))] if i != 8 else [] for i, t in enumerate(texts)}


@pytest.mark.parametrize("cells", [0, 100_000])
def test_names_of_the_input_survive(spark, monkeypatch, cells):
    """Columns named like working columns keep their values; those that mix() makes are replaced."""
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", cells)
    plain = frame(spark, [*odd_texts(), "the token of the mail", prose(2, 60)])
    names = ("ratio", "_id", "_kept", "_salt", "stays", "several", "c0", "own_id", "cell_topic", "cell_salt", "text_hash")
    extra = plain.withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in names}).withColumns({c: F.lit("old") for c in ("topic", "weight", "probability", "kept", "n_tokens")})
    mixed = ["doc_id", "n_tokens", "topic", "weight", "probability", "kept"]
    want = sorted(mixing.mix(plain).select(*mixed).collect())
    got = mixing.mix(extra)
    assert sorted(got.select(*mixed).collect()) == want and sorted(got.columns) == sorted(extra.columns)
    rows = got.collect() + simhash_dedup.keep_one(extra).collect()
    assert all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in names)
    kept = sorted(r["doc_id"] for r in simhash_dedup.keep_one(extra).collect())
    assert kept == sorted(r["doc_id"] for r in simhash_dedup.keep_one(plain).collect()) and len(kept) < len(rows)


@pytest.mark.parametrize("broadcast", [0, 200_000])
def test_warc_null_and_equal_ids(spark, monkeypatch, broadcast):
    """Every row comes back once; a null id is no original while another has the payload; equal ids have one response."""
    monkeypatch.setattr(warc, "BROADCAST_VERDICTS", broadcast)
    long, other = "x" * 1500, "y" * 1200
    rows = [(None, "a", long), (4, "b", long), (2, "c", long), (7, "d", other), (7, "e", other), (None, "f", "z" * 1100), (None, "g", "short")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.read_archives(spark, warc.resolve_revisits(spark, warc.write_archives(pages)), with_payload=True).collect()
    shown = sorted((r["uri"], r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got if r["uri"] not in "de")
    assert shown == [("a", None, "revisit", 4, 1500), ("b", 4, "response", None, 1500), ("c", 2, "revisit", 4, 1500), ("f", None, "response", None, 1100), ("g", None, "response", None, 5)]
    twins = sorted((r["record_type"], r["refers_to"]) for r in got if r["uri"] in "de")
    assert twins == [("response", None), ("revisit", 7)] and {r["payload"] for r in got if r["record_type"] == "response"} == {long, other, "z" * 1100, "short"}


def test_pipeline_stages_on_odd_rows(spark, sf_dir):
    import corpus_pipeline

    for docs in (frame(spark, odd_texts()), spark.createDataFrame([], SCHEMA)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, with_clashes(docs), sf_dir)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == list(corpus_pipeline.COLUMNS)
            out.count()
