"""Queries on text-quality signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions.numbers import half_up_sql as R
from quillspan.operators import extract as X
from quillspan.operators import lexicons as L
from quillspan.operators import similarity as SIM
from quillspan.operators import stylometry as S
from quillspan.operators.dialect import Oracle
from quillspan.plans.audit import ORACLES as AUDIT_ORACLES
from quillspan.plans.texts import TITLE, _titles
from quillspan.sources.fixtures import view
from quillspan.workspace import spread


def _docs(s, d):
    return spread(view(s, d, "documents"))


# The documents hold none of the phrases; here frequent words are exchanged for some, so that evidence has rows.
SPOKEN = {" of the ": " plays a crucial role in the ", " and the ": ", most several, essential and ", " la ": " il est important de noter ", ". De ": ". De plus, "}


def _spoken(s, d):
    text = F.col("text")
    for old, new in SPOKEN.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return _docs(s, d).select("doc_id", text.alias("text"))


QUERIES = {f"text_signals_{f.lower()}": (lambda s, d, f=f: S.family(S.score_signals(_docs(s, d)), f)) for f in S.FAMILIES} | {
    "text_scores": lambda s, d: S.text_scores(_docs(s, d)),
    "text_rejected": lambda s, d: S.rejected(_docs(s, d)),
    "text_sentences": lambda s, d: S.sentence_summary(S.sentence_labels(_docs(s, d))),
    "text_evidence": lambda s, d: S.evidence(S.sentence_labels(_docs(s, d))),
    "text_sentences_spoken": lambda s, d: S.sentence_summary(S.sentence_labels(_spoken(s, d))),
    "text_evidence_spoken": lambda s, d: S.evidence(S.sentence_labels(_spoken(s, d))),
    "text_problems": lambda s, d: S.problems(S.score_signals(_docs(s, d))),
    "text_site_rollup": lambda s, d: S.site_rollup(S.text_scores(_docs(s, d), keep=("source",)), "source", SIM.title_similarity(_titles(s, d), "source", "doc_id", "title")),
    "page_quality": lambda s, d: S.page_adjusted(S.text_scores(X.main_text(view(s, d, "pages")), "page_id", "main_text"), X.trust_signals(view(s, d, "pages"))).select("page_id", "n_words", "score", "verdict"),
    "text_sample": lambda s, d: S.systematic_sample(_docs(s, d).select("doc_id", "source"), "source", "doc_id", 8),
}

_d = Oracle()
_cols = lambda e: ", ".join(f"{x} AS {n}" for n, x in e.items())


def _prepared(documents: str = "documents") -> str:
    steps = [S.shape_columns(_d), S.count_columns(_d), S.lexical_columns(_d)]
    out = f"WITH c0 AS (SELECT doc_id, source, {_cols(S.cut_columns(_d, 'text'))} FROM {documents}), c1 AS (SELECT * FROM c0 WHERE len(words) >= {S.MIN_WORDS})"
    last = "c1"
    for i, e in enumerate(steps):
        out += f", s{i} AS (SELECT *, {_cols(e)} FROM {last})"
        last = f"s{i}"
    out += f", m AS (SELECT *, greatest({_d.total('marks')}, 1.0::DOUBLE) AS mark_total FROM {last}), en AS (SELECT *, {S.entropy_column(_d)} AS entropy FROM m)"
    out += ", g AS (SELECT doc_id, unnest(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) AS g FROM c1), gc AS (SELECT doc_id, g, count(*) AS c FROM g GROUP BY ALL), fg AS (SELECT doc_id, sum(CASE WHEN c > 1 THEN c ELSE 0 END) / sum(c)::DOUBLE AS repeated_fourgrams FROM gc GROUP BY 1)"
    out += ", lw AS (SELECT doc_id, unnest(list_filter(words, lambda w: length(w) >= 5)) AS w FROM c1), lc AS (SELECT doc_id, w, count(*) AS c FROM lw GROUP BY ALL), tw AS (SELECT doc_id, max(c) / sum(c)::DOUBLE AS top_share FROM lc GROUP BY 1)"
    return out + ", pre AS MATERIALIZED (SELECT en.*, coalesce(repeated_fourgrams, 0) AS repeated_fourgrams, top_share FROM en LEFT JOIN fg USING (doc_id) LEFT JOIN tw USING (doc_id))"


_SIG = S.signals(_d)
SIGNALS = _prepared() + f", sg AS MATERIALIZED (SELECT doc_id, source, n_words, french, {_cols(_SIG)} FROM pre)"
SCORES, _last = SIGNALS, "sg"
for _i, _step in enumerate(S.score_columns(_d)):
    SCORES += f", q{_i} AS (SELECT *, {_cols(_step)} FROM {_last})"
    _last = f"q{_i}"
SCORES += f", ts AS MATERIALIZED (SELECT * FROM {_last})"

# Sentences by lists of phrases and words, written apart from the operator's expressions.
_list = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
_hits = lambda fr, en, test: f"len(list_filter(CASE WHEN french THEN {_list(fr)} ELSE {_list(en)} END, lambda p: {test}))"
_spoken_sql = "text"
for _old, _new in SPOKEN.items():
    _spoken_sql = f"replace({_spoken_sql}, '{_old}', '{_new}')"
SENTENCES = f"""
, se AS (SELECT doc_id, french, mean_len, unnest(sents) AS s, generate_subscripts(sents, 1) - 1 AS pos FROM pre)
, sw AS (SELECT *, lower(s) AS sl, regexp_extract_all(lower(s), '{S.T.WIDE_WORD.replace("'", "''")}') AS ws FROM se)
, sh AS (SELECT *, {_hits(L.PHRASES_FR + L.PHRASES_EN, L.PHRASES_EN, "contains(sl, p)")} AS np, {_hits(L.CONNECTORS_FR, L.CONNECTORS_EN, "starts_with(sl, p)")} > 0 AS opens
  , {_hits(L.WORDS_FR, L.WORDS_EN, "list_contains(ws, p)")} AS nw, {_hits(L.VAGUE_FR, L.VAGUE_EN, "contains(sl, p)")} AS nv FROM sw)
, sc AS (SELECT *, least(100, 28 * np + CASE WHEN opens THEN 22 ELSE 0 END + 10 * nw + CASE WHEN nv >= 2 THEN 8 * nv ELSE 0 END
  + CASE WHEN regexp_matches(s, '(?i)[a-zà-ÿ0-9_’-]+,\\s+[a-zà-ÿ0-9_’-]+\\s+(?:et|and|ou|or)\\s+[a-zà-ÿ0-9_’-]+') THEN 12 ELSE 0 END
  + CASE WHEN len(ws) >= 12 AND abs(len(ws) - mean_len) <= 0.15::DOUBLE * mean_len THEN 8 ELSE 0 END)::INT AS score FROM sh)
, sb AS (SELECT doc_id, pos, substr(s, 1, 300) AS sentence, score, CASE WHEN score >= 50 THEN 'generated' WHEN score >= 22 THEN 'suspect' ELSE 'ok' END AS label, (3 * np + CASE WHEN opens THEN 2 ELSE 0 END + nw)::INT AS evidence FROM sc)
"""
SUMMARY = f"SELECT doc_id, count(*) AS sentences, count(*) FILTER (label = 'generated') AS generated, count(*) FILTER (label = 'suspect') AS suspect, {R('avg(score)', 1)} AS mean_score FROM sb GROUP BY doc_id"
LOUDEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY evidence DESC, pos) AS rank FROM sb WHERE evidence >= 3) WHERE rank <= 6"
_spoken_docs = _prepared(f"(SELECT doc_id, source, {_spoken_sql} AS text FROM documents)")

_page_scores = _prepared(f"(SELECT page_id AS doc_id, NULL AS source, main_text AS text FROM ({AUDIT_ORACLES['page_main_text']}))") + SCORES[len(_prepared()) :]
_TRUST = AUDIT_ORACLES["page_trust"]
_ramp = lambda v, lo, hi, inv=False: S._ramp(_d, v, lo, hi, inv)
ORACLES = {f"text_signals_{f.lower()}": SIGNALS + f" SELECT doc_id, {', '.join(c for c in _SIG if c[0] == f.lower())} FROM sg" for f in S.FAMILIES} | {
    "text_scores": SCORES + f" SELECT doc_id, {', '.join(S.SCORE_COLUMNS)} FROM ts",
    "page_quality": _page_scores + f", tr AS ({_TRUST}) SELECT doc_id AS page_id, n_words, least(100, score + CASE WHEN has_author THEN 0 ELSE 4 END + CASE WHEN has_date THEN 0 ELSE 4 END + CASE WHEN has_comments THEN 0 ELSE 4 END + CASE WHEN external_hosts > 0 THEN 0 ELSE 4 END) AS score, verdict FROM ts JOIN tr ON tr.page_id = ts.doc_id",
    "text_rejected": f"WITH c AS (SELECT doc_id, len({_d.every(S.T.WIDE_WORD, 'lower(trim(coalesce(text, chr(32))))')}) AS word_count FROM documents) SELECT * FROM c WHERE word_count < {S.MIN_WORDS}",
    "text_sentences": _prepared() + SENTENCES + SUMMARY,
    "text_evidence": _prepared() + SENTENCES + LOUDEST,
    "text_sentences_spoken": _spoken_docs + SENTENCES + SUMMARY,
    "text_evidence_spoken": _spoken_docs + SENTENCES + LOUDEST,
    "text_problems": SIGNALS + " " + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS problem, '{s}' AS severity FROM sg WHERE {c} >= {b}" for n, (c, b, s) in S.PROBLEMS.items()),
    "text_site_rollup": SCORES + ", tt AS (" + TITLE.replace("WITH t AS", "WITH tx AS").replace("FROM t WHERE", "FROM tx WHERE") + f"""
, r AS (SELECT source AS site, ws, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM f), p AS (SELECT a.site, len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws)))::DOUBLE AS j FROM r a JOIN r b ON a.site = b.site AND a.r < b.r)
SELECT site, {R('avg(j)', 4)} AS mean_jaccard FROM p GROUP BY site)
, ba AS (SELECT source AS site, count(*) AS texts, avg(score) AS ms, stddev_pop(score) AS sd, avg(value_risk) AS mr FROM ts GROUP BY 1)
, bo AS (SELECT ba.*, list_filter([CASE WHEN texts >= 3 THEN {_ramp('sd', 3, 18, True)} END, CASE WHEN mean_jaccard IS NOT NULL THEN {_ramp('mean_jaccard', 0.15, 0.55)} END], lambda x: x IS NOT NULL) AS parts FROM ba LEFT JOIN tt USING (site))
, bb AS (SELECT *, coalesce(list_sum(parts) / nullif(len(parts), 0), 0) AS bonus FROM bo)
SELECT site, texts, {R('ms', 1)} AS mean_score, {R('sd', 1)} AS spread, {R('bonus', 1)} AS bonus, {R('0.75::DOUBLE * ms + 0.25::DOUBLE * bonus')}::INT AS site_score, {R('0.7::DOUBLE * mr + 0.3::DOUBLE * bonus')}::INT AS site_risk FROM bb""",
    "text_sample": "WITH n AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT doc_id, source FROM n WHERE (r - 1) % greatest(n // 8, 1) = 0 AND r <= greatest(n // 8, 1) * 8",
}
