"""Texts of more sentences than a page shows."""

from quillspan.operators import lexicons as L
from quillspan.operators import stylometry


def test_sentences_after_the_300th_count(spark):
    plain, loud = "The dog of the house sat on the mat and it was old. ", f"We say {L.PHRASES_EN[0]} here. "
    rows = spark.createDataFrame([(1, plain * 400 + loud * 2 + plain * 98)], "doc_id long, text string")
    labels = stylometry.sentence_labels(rows)
    assert [r.pos for r in stylometry.evidence(labels).orderBy("rank").collect()] == [400, 401]
    assert stylometry.sentence_summary(labels).first().sentences == 500
