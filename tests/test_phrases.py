"""The phrase automaton against str.count, text by text and phrase by phrase."""

import random

import pytest

from quillspan.functions import phrases as P
from quillspan.operators import stylometry as S


def plain(texts, phrases):
    return [[t.count(p) for p in phrases] for t in texts]


@pytest.mark.parametrize("segment", [1, 3, 7, 2048])
def test_counts_on_random_texts(monkeypatch, segment):
    monkeypatch.setattr(P, "SEGMENT", segment)
    rng = random.Random(segment)
    for _ in range(60):
        some = tuple(dict.fromkeys("".join(rng.choice("abé ") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 12))))
        texts = ["".join(rng.choice("abéx 😀") for _ in range(rng.randrange(0, 60))) for _ in range(rng.randrange(1, 9))] + ["", "aaaaaaa"]
        assert P.Automaton(some).counts(texts).tolist() == plain(texts, some)


def test_the_lists_and_long_texts():
    some = tuple(dict.fromkeys(p for pair in S.PHRASE_LISTS.values() for each in pair for p in each))
    rng = random.Random(1)
    texts = [" ".join(rng.choice([rng.choice(some), "mot", "x" * rng.randrange(9)]) for _ in range(n)) for n in (0, 1, 50, 3000)] + ["in the realm of " * 2000, "aa" * 5000]
    assert P.Automaton(some).counts(texts).tolist() == plain(texts, some)


def test_every_occurrence_is_matched():
    text, phrase, end = P.Automaton(("aba", "a", "bab")).matches(["ababa", "b"])
    assert sorted(zip(text.tolist(), phrase.tolist(), end.tolist())) == [(0, 0, 3), (0, 0, 5), (0, 1, 1), (0, 1, 3), (0, 1, 5), (0, 2, 4)]


def test_column(spark):
    rows = [(0, "a b a b a"), (1, None), (2, ""), (3, "c")]
    df = spark.createDataFrame(rows, "k int, t string")
    lists = [["a b", "b a"], ["c", "c"], []]
    assert [r[0] for r in df.orderBy("k").select(P.phrase_totals(df.t, lists)).collect()] == [[4, 0, 0], [0, 0, 0], [0, 0, 0], [0, 2, 0]]
    assert [r[0] for r in df.orderBy("k").select(P.phrase_totals(df.t, lists, True)).collect()] == [[2, 0, 0], [0, 0, 0], [0, 0, 0], [0, 2, 0]]


def test_groups_of_a_batch_count_as_the_whole(monkeypatch):
    texts = ["ab" * k + "aba" for k in range(40)] + ["", "aba" * 50]
    machine = P.Automaton(("ab", "aba", "b"))
    seen = []
    matches = P.Automaton.matches
    monkeypatch.setattr(P, "GROUP", 64)
    monkeypatch.setattr(P.Automaton, "matches", lambda self, ts: seen.append(sum(map(len, ts))) or matches(self, ts))
    assert machine.counts(texts).tolist() == plain(texts, machine.phrases)
    assert len(seen) > 10 and max(seen) == 150
    assert machine.counts([]).shape == (0, 3)
