"""Work per text of the signals: words are cut once, and arrays are sorted without a comparing lambda."""

from quillspan.operators import stylometry as S


def test_words_are_cut_once_and_sorted_natively(spark):
    docs = spark.createDataFrame([(1, "Some plain words, and more of them. " * 30), (2, "few words"), (3, None)], "doc_id long, text string")
    signals = S.family(S.score_signals(docs), "E")
    plan = signals._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1 and "array_sort(" not in plan
    assert [r["doc_id"] for r in signals.collect()] == [1]
