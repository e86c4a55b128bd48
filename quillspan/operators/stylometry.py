"""Text-quality signals in six families, for triage of a corpus; heuristics, no proof of authorship.

One projection over a table of texts: tokens, sentences and lower-cased text
are cut once, then every signal is a column expression.  A null signal does not
apply to the text and takes no part in its family's mean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.functions.numbers import half_up
from quillspan.functions.phrases import phrase_totals
from quillspan.operators import lexicons as L
from quillspan.operators.dialect import Oracle, Spark
from quillspan.operators.ranks import ranked
from quillspan.workspace import few, materialize

MIN_WORDS = 80
FAMILIES = {"A": 20, "B": 20, "C": 13, "D": 20, "E": 15, "F": 12}
MARK = "␞"
_CAP = "[A-ZÀ-Ý]"


def _ramp(d: Spark, v: str, low: float, high: float, invert: bool = False) -> str:
    x = f"least(greatest((({v}) - {d.real(low)}) / ({d.real(high)} - {d.real(low)}), {d.real(0)}), {d.real(1)})"
    return f"(floor(({f'{d.real(1)} - {x}' if invert else x}) * {d.real(100)} * {d.real(10)} + {d.real(0.5)}) / {d.real(10)})"


def _occurrences(d: Spark, x: str, phrases: list[str]) -> str:
    # most phrases are in no text: a plain search is far cheaper than a replacement
    each = [f"CASE WHEN contains({x}, {d.text(p)}) THEN CAST(round((length({x}) - length(replace({x}, {d.text(p)}, ''))) / {d.real(len(p))}) AS BIGINT) ELSE 0 END" for p in phrases]
    return "(" + " + ".join(each) + ")"


#: Phrase lists by name, for French texts and for others.
PHRASE_LISTS = {
    "phrases": (L.PHRASES_FR + L.PHRASES_EN, L.PHRASES_EN), "first_person": (L.FIRST_PERSON_FR, L.FIRST_PERSON_EN),
    "vague": (L.VAGUE_FR, L.VAGUE_EN), "oral": (L.ORAL_FR + L.ORAL_EN, L.ORAL_EN),
}


def _listed(d: Spark, name: str) -> str:
    """Occurrences of a list's phrases: from the automaton's totals (column hits), in the oracle phrase by phrase."""
    if isinstance(d, Oracle):
        return by_language(d, *(_occurrences(d, "low", phrases) for phrases in PHRASE_LISTS[name]))
    k = 2 * list(PHRASE_LISTS).index(name)
    return by_language(d, f"hits[{k}]", f"hits[{k + 1}]")


def _in(d: Spark, v: str, words: list[str]) -> str:
    return f"{v} IN ({', '.join(d.text(w) for w in words)})"


def _share(d: Spark, words: str, lexicon: list[str]) -> str:
    return d.size(d.filter(words, "w", _in(d, "w", lexicon)))


def _spread(d: Spark, a: str) -> str:
    """Population standard deviation over mean; 0 for a zero mean."""
    mean = d.divide(d.total(a), d.size(a))
    square = d.divide(d.total(d.map(a, "z", "z * z")), d.size(a))
    return f"coalesce({d.divide(f'sqrt(greatest({square} - ({mean}) * ({mean}), {d.real(0)}))', mean)}, {d.real(0)})"


def trimmed(text: str) -> str:
    return f"trim(coalesce({text}, ''))"


def cut_columns(d: Spark, text: str) -> dict[str, str]:
    """First step: what all signals are made from."""
    t = trimmed(text)
    return {"t": t, "low": f"lower({t})", "words": d.every(T.WIDE_WORD, f"lower({t})"), "sents": d.filter(d.map(d.split(d.replace(r"([.!?…])\s+", t, "@1" + MARK), MARK), "s", "trim(s)"), "s", "length(s) > 2"),
            "paras": d.filter(d.map(d.split(d.replace(r"\n\s*\n", t, MARK), MARK), "s", "trim(s)"), "s", "length(s) > 40"), "lines": d.filter(d.map(d.split(t, "\n") if isinstance(d, Oracle) else f"split({t}, '\\n')", "s", "trim(s)"), "s", "s <> ''")}


def shape_columns(d: Spark) -> dict[str, str]:
    """Second step: counts that several signals use."""
    words_in = d.count(T.WIDE_WORD, "lower(s)")
    return {
        "n_words": d.size("words"), "n_sents": f"greatest({d.size('sents')}, 1)", "lens": d.map("sents", "s", f"CAST({words_in} AS DOUBLE)"), "para_lens": d.map("paras", "s", f"CAST({words_in} AS DOUBLE)"),
        "french": f"{_share(d, 'words', L.ENGLISH_HITS)} <= {_share(d, 'words', L.FRENCH_HITS)}",
    }


def by_language(d: Spark, french: str, english: str) -> str:
    return f"CASE WHEN french THEN {french} ELSE {english} END"


def count_columns(d: Spark) -> dict[str, str]:
    """Third step: raw counts by lexicon and pattern."""
    occ = lambda name: _listed(d, name)
    starts = lambda words: " OR ".join(f"{d.starts}(s, {d.text(c)})" for c in words)
    lowered = d.map("sents", "s", "lower(s)")
    heads = d.every(r"(?m)^\s*#{1,4}\s*([^\n<]{4,90})", "t", 1)
    title = d.every(T.WIDE_WORD, f"lower({d.at('lines', 1)})")
    three = d.map(d.steps("1", f"greatest({d.size(title)} - 2, 1)", "1"), "i", d.join(d.slice(title, "i", "3"), " "))
    return {
        "phrases": occ("phrases"), "stock": by_language(d, _share(d, "words", L.WORDS_FR), _share(d, "words", L.WORDS_EN)),
        "connected": by_language(d, d.size(d.filter(lowered, "s", starts(L.CONNECTORS_FR))), d.size(d.filter(lowered, "s", starts(L.CONNECTORS_EN)))),
        "triples": f"({d.count(r'(?i)[a-zà-ÿ0-9_’-]+,\s+[a-zà-ÿ0-9_’-]+\s+(?:et|and|ou|or)\s+[a-zà-ÿ0-9_’-]+', 't')} + {d.count(r'(?i),\s+[^,.;:\n]{4,60},\s+(?:et|and|ou|or)\s+', 't')})",
        "listed": f"CASE WHEN contains(t, ':') THEN {d.count(r'(?:[^,.\n:]{2,45},\s+){2,}[^,.\n:]{2,45}\s*:', 't')} ELSE 0 END", "not_only": d.count("(?:ce n'est pas (?:seulement|juste|simplement)|not (?:just|only|merely))", "low"),
        "superlatives": _share(d, "words", L.SUPERLATIVES), "bullets": d.count(rf"(?m)^\s*(?:[-*•]|\d+\.)\s*(?:\*\*)?{_CAP}[^:\n]{{2,40}}\s*:", "t"),
        "concluded": d.count(r"(?m)^\s*(?:#{1,4}\s*)?(?:en )?(?:conclusion|pour conclure|en résumé|en somme|le mot de la fin|final thoughts|wrapping up)(?:[^a-zà-ÿ]|$)", "low"),
        "n_heads": d.size(heads), "q_heads": d.size(d.filter(heads, "h", "trim(h) LIKE '%?'")), "c_heads": d.size(d.filter(heads, "h", "h LIKE '%:%'")),
        "dashes": _occurrences(d, "t", ["—", " - "]), "slogans": d.size(d.filter("lines", "s", f"length(s) > 8 AND length(s) < 70 AND NOT {d.matches(r'[.!?:]$', 's')} AND {d.matches(chr(40) + '?i),' + r'\s*c' + chr(39) + r'est(?:[^a-zà-ÿ]|$)', 's')}")),
        "title_fits": f"coalesce(length({d.at('lines', 1)}) > 10 AND length({d.at('lines', 1)}) < 90, FALSE)",
        "reinjected": f"CASE WHEN coalesce(length({d.at('lines', 1)}) > 10 AND length({d.at('lines', 1)}) < 90, FALSE) AND {d.size(title)} >= 3 THEN {d.size(d.filter(three, 'g', f'length(g) >= 12 AND instr(substring(low, length({d.at('lines', 1)}) + 1), g) > 0'))} ELSE 0 END",
        "faq": d.count(r"(?m)^\s*(?:#{1,4}\s*)?(?:faq|questions fréquentes|foire aux questions|frequently asked)", "low"),
        "strong_numbers": d.count(r"(?i)\d[\d\s,.]*(?:€|\$|%|km|kg|m²|kwh)|(?:19|20)\d{2}", "t"), "plain_numbers": d.count(r"\d[\d\s,.]*", "t"),
        "mid_caps": d.total(d.map("sents", "s", d.count(rf"[\s(«]{_CAP}[a-zà-ÿ]{{2,}}", "s"))), "first_person": occ("first_person"),
        "corporate": _share(d, "words", L.CORPORATE), "dates": f"({_share(d, 'words', L.MONTHS)} + {d.size(d.filter('words', 'w', d.matches('^(?:19|20)[0-9]{2}$', 'w')))})",
        "vague": occ("vague"), "quotes": d.count("[«\"“][^»\"”]{15,240}[»\"”]" if isinstance(d, Oracle) else "[«\\x22“][^»\\x22”]{15,240}[»\\x22”]", "t"), "oral": occ("oral"),
        "asked": _occurrences(d, "t", ["!", "?"]), "brackets": _occurrences(d, "t", ["("]), "letters": d.total(d.map("words", "w", "length(w)")),
    }


def signals(d: Spark) -> dict[str, str]:
    """Fourth step: score of each signal, 0-100 or null."""
    k = lambda v: f"({v}) * {d.real(1000)} / n_words"
    ramp = lambda v, lo, hi, inv=False: _ramp(d, v, lo, hi, inv)
    mean = "mean_len"
    either = lambda c, v: f"CASE WHEN {c} THEN {d.real(v)} ELSE {d.real(0)} END"
    opens = d.map("sents", "s", f"lower({d.at(d.split(d.replace(r'\s+', 's', ' '), ' '), 1)})")
    numbers = f"(strong_numbers + {d.real(0.5)} * greatest(plain_numbers - strong_numbers, 0))"
    away = f"abs(letters / n_words - CASE WHEN french THEN {d.real(5.4)} ELSE {d.real(4.9)} END)"
    return {
        "a1": ramp(_spread(d, "lens"), 0.25, 0.75, True),
        "a2": ramp(d.divide(d.size(d.filter("lens", "z", f"abs(z - {mean}) <= {d.real(0.25)} * {mean}")), "n_sents"), 0.30, 0.70),
        "a3": f"CASE WHEN {d.size('para_lens')} >= 3 THEN {ramp(_spread(d, 'para_lens'), 0.15, 0.65, True)} END",
        "a4": f"CASE WHEN {_occurrences(d, 't', [','])} >= n_sents THEN {ramp(d.divide(_occurrences(d, 't', [',']), 'n_sents'), 1.1, 2.6)} END",
        "a5": ramp(d.divide(d.size(d.filter("lens", "z", "z <= 4")), "n_sents"), 0.0, 0.12, True),
        "b1": ramp(k("phrases"), 1, 9), "b2": ramp(k("stock"), 3, 22), "b3": ramp(d.divide("connected", "n_sents"), 0.06, 0.30), "b4": ramp(k("triples"), 2, 12), "b5": ramp(k("listed"), 1, 7),
        "b6": ramp(k("not_only"), 0.4, 3), "b7": ramp(k("superlatives"), 2, 14),
        "c1": ramp(k("bullets"), 1, 10), "c2": either("concluded > 0", 70), "c3": f"CASE WHEN n_heads >= 3 THEN {ramp(d.divide('greatest(q_heads, c_heads)', 'n_heads'), 0.4, 0.95)} END", "c4": ramp(k("dashes"), 2.5, 14),
        "c5": either("slogans > 0", 70), "c6": f"CASE WHEN title_fits THEN CASE WHEN reinjected >= 2 THEN {d.real(95)} WHEN reinjected = 1 THEN {d.real(85)} ELSE {d.real(0)} END END", "c7": either("faq > 0", 45),
        "d1": ramp(k(numbers), 2, 18, True), "d2": ramp(k("mid_caps"), 10, 55, True), "d3": ramp(k("first_person"), 0, 6, True), "d4": f"CASE WHEN first_person = 0 AND corporate > 0 THEN {ramp(k('corporate'), 12, 40)} END",
        "d5": ramp(k("dates"), 2, 14, True), "d6": ramp(k("vague"), 5, 28), "d7": ramp(k("quotes"), 0, 3, True),
        "e1": f"({ramp('ttr', 0.42, 0.62, True)} * {d.real(0.6)} + {ramp('ttr', 0.72, 0.85)} * {d.real(0.4)})", "e2": ramp("repeated_fourgrams", 0.02, 0.12),
        "e3": ramp(d.divide(d.size(d.distinct(opens)), "n_sents"), 0.35, 0.75, True), "e4": f"CASE WHEN top_share IS NOT NULL THEN {ramp('top_share', 0.02, 0.07)} END",
        "f1": ramp("entropy", 1.2, 2.6, True), "f2": ramp(k("asked"), 0.5, 8, True), "f3": ramp(k("oral"), 0, 4, True), "f4": either("oral = 0 AND asked = 0 AND first_person = 0", 85), "f5": ramp(k("brackets"), 0.3, 5, True),
        "f6": ramp(away, 1.2, 0.2),
    }


def lexical_columns(d: Spark) -> dict[str, str]:
    """Block type-token ratio and punctuation entropy."""
    block = d.slice("words", "i", "200")
    ttrs = d.map(d.steps("1", "greatest(n_words - 50, 1)", "200"), "i", d.divide(d.size(d.distinct(block)), "least(200, n_words - i + 1)"))
    marks = [f"CAST(length(t) - length(replace(t, {d.text(p)}, '')) AS DOUBLE)" for p in T.PUNCTUATION.replace('"', "").replace("'", "")]
    quote = "CAST(length(t) - length(replace(t, chr(34), '')) AS DOUBLE)"
    apostrophe = "CAST(length(t) - length(replace(t, chr(39), '')) AS DOUBLE)"
    return {"mean_len": d.divide(d.total("lens"), d.size("lens")), "ttr": d.divide(d.total(ttrs), d.size(ttrs)), "marks": d.filter(d.array(*marks, quote, apostrophe), "m", "m > 0")}


def entropy_column(d: Spark) -> str:
    return f"-{d.total(d.map('marks', 'm', 'm / mark_total * log2(m / mark_total)'))}"


def repetition_columns(rows: DataFrame) -> DataFrame:
    """Adds repeated_fourgrams and top_share: counts of 4-grams and of words of five letters or more, inside each row."""
    same = lambda h, i: (F.get(h, i) == F.get(h, i - 1)) | (F.get(h, i) == F.get(h, i + 1))
    positions = lambda h: F.when(F.size(h) > 0, F.sequence(F.lit(0), F.size(h) - 1)).otherwise(F.array().cast("array<int>"))
    # neighbours in sorted order; bound to a lambda variable, so that the array is sorted once (sort_array: array_sort compares through a lambda)
    share = lambda h: F.try_divide(F.size(F.filter(positions(h), lambda i: F.coalesce(same(h, i), F.lit(False)))).cast("double"), F.size(h).cast("double"))
    four = F.transform(F.array(F.sort_array(T.hashed_windows(F.col("words"), 4))), share)[0]
    run = lambda a, w: F.when(w == a["last"], a["run"] + 1).otherwise(F.lit(1).cast("bigint"))
    start = F.struct(F.lit("").alias("last"), F.lit(0).cast("bigint").alias("run"), F.lit(0).cast("bigint").alias("most"))
    step = lambda a, w: F.struct(w.alias("last"), run(a, w).alias("run"), F.greatest(a["most"], run(a, w)).alias("most"))
    most = lambda ws: F.try_divide(F.aggregate(ws, start, step, lambda a: a["most"]).cast("double"), F.size(ws).cast("double"))
    top = F.transform(F.array(F.sort_array(F.filter("words", lambda w: F.length(w) >= 5))), most)[0]
    return rows.withColumns({"repeated_fourgrams": F.coalesce(four, F.lit(0.0)), "top_share": top})


def prepared(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """All columns that the signals read, for texts of at least MIN_WORDS words."""
    d = Spark()
    cut = cut_columns(d, text)
    first = docs.select(key, *keep, F.expr(cut.pop("t")).alias("t")).withColumn("low", F.expr(cut.pop("low").replace(trimmed(text), "t")))
    # words come out of a generator: a filter on them would be pushed below a projection, and they would be cut twice
    first = first.select("*", F.explode(F.array(F.expr(cut.pop("words").replace(f"lower({trimmed(text)})", "low")))).alias("words")).filter(F.size("words") >= MIN_WORDS)
    out = first.select("*", *(F.expr(e.replace(trimmed(text), "t")).alias(n) for n, e in cut.items()))
    out = out.withColumn("hits", phrase_totals(F.col("low"), [each for pair in PHRASE_LISTS.values() for each in pair]))
    for step in (shape_columns(d), count_columns(d), lexical_columns(d)):
        out = out.withColumns({n: F.expr(e) for n, e in step.items()})
    out = out.withColumn("mark_total", F.greatest(F.aggregate("marks", F.lit(0.0), lambda a, x: a + x), F.lit(1.0))).withColumn("entropy", F.expr(entropy_column(d)))
    return repetition_columns(out)


def rejected(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, word_count) of texts that are too short to score; a null text has no words and is one of them."""
    return docs.select(key, F.size(T.wide_words(F.trim(F.col(text)))).cast("bigint").alias("word_count")).filter(F.col("word_count") < MIN_WORDS)


def score_signals(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, n_words, french, one column per signal)."""
    return prepared(docs, key, text, keep).select(key, *keep, "n_words", "french", *(F.expr(e).alias(n) for n, e in signals(Spark()).items()))


def family(rows: DataFrame, letter: str, key: str = "doc_id") -> DataFrame:
    return rows.select(key, *(c for c in rows.columns if len(c) == 2 and c[0] == letter.lower() and c[1].isdigit()))


def _means(d: Spark, columns) -> dict[str, str]:
    out = {}
    for f in FAMILIES:
        own = [c for c in columns if c[0] == f.lower()]
        total = " + ".join(f"coalesce({c}, 0)" for c in own)
        n = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in own)
        out[f] = f"(floor(({total}) / ({n}) * {d.real(10)} + {d.real(0.5)}) / {d.real(10)})"
    return out


def score_columns(d: Spark) -> list[dict[str, str]]:
    """Family means, weights, convergence, verdict and value risk, in steps; the same text for both engines."""
    real = d.real
    e_weight = f"CASE WHEN n_words < 300 THEN CASE WHEN fam_e >= 40 THEN 12 ELSE 0 END WHEN n_words < 600 THEN CASE WHEN fam_e >= 40 THEN 12 ELSE 9 END ELSE {FAMILIES['E']} END"
    weighted = " + ".join(f"fam_{f.lower()} * {'w_e' if f == 'E' else w}" for f, w in FAMILIES.items())
    weights = " + ".join("w_e" if f == "E" else str(w) for f, w in FAMILIES.items())
    live = [f"fam_{f.lower()}" if f != "E" else "CASE WHEN w_e > 0 THEN fam_e ELSE 0 END" for f in FAMILIES]
    strong = " + ".join(f"CASE WHEN {c} >= 40 THEN 1 ELSE 0 END" for c in live)
    return [
        {f"fam_{f.lower()}": e for f, e in _means(d, signals(d)).items()},
        {"w_e": e_weight},
        {"base": f"floor(({weighted}) / ({weights}) + {real(0.5)})", "strong": strong, "peak": f"greatest({', '.join(live)})"},
        {"score": "least(100, base + CASE WHEN strong >= 4 AND peak >= 70 THEN CASE WHEN strong >= 5 THEN 10 ELSE 6 END ELSE 0 END)"},
        {
            "verdict": "CASE WHEN score >= 72 THEN 'very likely generated' WHEN score >= 55 THEN 'likely generated' WHEN score >= 38 THEN 'mixed' ELSE 'likely human' END",
            "value_risk": f"floor(least({real(100)}, score * {real(0.55)} + fam_d * {real(0.30)} + fam_b * {real(0.15)}) + {real(0.5)})",
        },
        {"risk_band": "CASE WHEN value_risk >= 65 THEN 'high' WHEN value_risk >= 45 THEN 'moderate' ELSE 'low' END"},
    ]


SCORE_COLUMNS = ("n_words", "fam_a", "fam_b", "fam_c", "fam_d", "fam_e", "fam_f", "score", "verdict", "value_risk", "risk_band")


def text_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Family means, overall score with the convergence bonus, verdict, value risk."""
    out = score_signals(docs, key, text, keep)
    for step in score_columns(Spark()):
        out = out.withColumns({n: F.expr(e) for n, e in step.items()})
    return out.select(key, *keep, *SCORE_COLUMNS)


def sentence_labels(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, score, label) of every sentence."""
    d = Spark()
    rows = prepared(docs, key, text)
    each = rows.select(key, "french", "mean_len", F.posexplode("sents").alias("pos", "s")).withColumn("sl", F.lower("s")).withColumn("ws", T.wide_words(F.col("s")))
    pick = lambda fr, en: F.expr(by_language(d, fr, en))
    seen = [*PHRASE_LISTS["phrases"], *PHRASE_LISTS["vague"]]
    each = each.withColumn("seen", phrase_totals(F.col("sl"), seen, present=True))
    starts = lambda words: "(" + " OR ".join(f"startswith(sl, {d.text(c)})" for c in words) + ")"
    stock = lambda words: d.size(d.filter("array_distinct(ws)", "w", _in(d, "w", words)))
    each = each.withColumns(
        {
            "n_phrases": pick("seen[0]", "seen[1]"), "opens": pick(starts(L.CONNECTORS_FR), starts(L.CONNECTORS_EN)), "n_stock": pick(stock(L.WORDS_FR), stock(L.WORDS_EN)),
            "n_vague": pick("seen[2]", "seen[3]"), "triple": F.col("s").rlike(r"(?iu)[a-zà-ÿ0-9_’-]+,\s+[a-zà-ÿ0-9_’-]+\s+(?:et|and|ou|or)\s+[a-zà-ÿ0-9_’-]+"),
            "average": (F.size("ws") >= 12) & (F.abs(F.size("ws") - F.col("mean_len")) <= 0.15 * F.col("mean_len")),
        }
    )
    score = 28 * F.col("n_phrases") + F.when(F.col("opens"), 22).otherwise(0) + 10 * F.col("n_stock") + F.when(F.col("n_vague") >= 2, 8 * F.col("n_vague")).otherwise(0) + F.when(F.col("triple"), 12).otherwise(0) + F.when(F.col("average"), 8).otherwise(0)
    each = each.withColumn("score", F.least(score, F.lit(100)).cast("int"))
    evidence = 3 * F.col("n_phrases") + F.when(F.col("opens"), 2).otherwise(0) + F.col("n_stock")
    return each.select(key, "pos", F.substring("s", 1, 300).alias("sentence"), "score", F.when(F.col("score") >= 50, "generated").when(F.col("score") >= 22, "suspect").otherwise("ok").alias("label"), evidence.cast("int").alias("evidence"))


def evidence(labels: DataFrame, key: str = "doc_id", n: int = 6) -> DataFrame:
    """Up to ``n`` sentences per text that speak loudest."""
    w = Window.partitionBy(key).orderBy(F.desc("evidence"), "pos")
    return labels.filter("evidence >= 3").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def sentence_summary(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    return labels.groupBy(key).agg(F.count("*").alias("sentences"), F.count_if(F.col("label") == "generated").alias("generated"), F.count_if(F.col("label") == "suspect").alias("suspect"), half_up(F.avg("score"), 1).alias("mean_score"))


# Problem kinds: signal at or above its bound, and how much it weighs.
PROBLEMS = {
    "cliches": ("b1", 50, "high"), "stock_words": ("b2", 50, "medium"), "connectors": ("b3", 50, "medium"), "even_rhythm": ("a1", 70, "high"),
    "formula_blocks": ("e2", 50, "high"), "keyword_stuffing": ("e4", 60, "medium"), "no_figures": ("d1", 80, "medium"), "faq_template": ("c7", 45, "low"),
}


def problems(scored: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, problem, severity) rows, gravest first."""
    order = {"high": 0, "medium": 1, "low": 2}
    each = [F.when(F.col(c) >= bound, F.struct(F.lit(order[s]).alias("o"), F.lit(name).alias("problem"), F.lit(s).alias("severity"))) for name, (c, bound, s) in PROBLEMS.items()]
    return scored.select(key, F.inline(F.array_sort(F.array_compact(F.array(*each))))).drop("o")


def page_adjusted(scores: DataFrame, trust: DataFrame, key: str = "page_id") -> DataFrame:
    """Scores plus 4 for each of author, date, comments and other hosts that a page lacks."""
    missing = sum((F.when(F.col(c), 0).otherwise(4) for c in ("has_author", "has_date", "has_comments")), F.lit(0)) + F.when(F.col("external_hosts") > 0, 0).otherwise(4)
    return scores.join(trust, key).withColumn("score", F.least(F.lit(100.0), F.col("score") + missing))


def site_rollup(scores: DataFrame, site: str, titles: DataFrame, bursts: DataFrame | None = None, no_author: DataFrame | None = None) -> DataFrame:
    """Site score .75 mean + .25 bonus and risk .7 mean risk + .3 bonus.

    Bonus: mean of what applies among evenness of scores (three texts or more),
    title similarity, publication burst (four days or more), share without author.
    """
    from quillspan.functions.numbers import ramp

    base = scores.groupBy(F.col(site).alias("site")).agg(F.count("*").alias("texts"), F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("spread"), F.avg("value_risk").alias("mean_risk"))
    rows = base.join(titles.select("site", "mean_jaccard"), "site", "left")
    parts = [F.when(F.col("texts") >= 3, ramp(F.col("spread"), 3, 18, True)), F.when(F.col("mean_jaccard").isNotNull(), ramp(F.col("mean_jaccard"), 0.15, 0.55))]
    if bursts is not None:
        rows = rows.join(bursts.select("site", "days", "burst_share"), "site", "left")
        parts.append(F.when(F.col("days") >= 4, ramp(F.col("burst_share"), 0.2, 0.8)))
    if no_author is not None:
        rows = rows.join(no_author.select("site", "no_author_share"), "site", "left")
        parts.append(F.when(F.col("no_author_share").isNotNull(), ramp(F.col("no_author_share"), 0.3, 1.0)))
    kept = F.array_compact(F.array(*parts))
    rows = rows.withColumn("bonus", F.coalesce(F.try_divide(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x), F.size(kept)), F.lit(0.0)))
    return rows.select(
        "site", "texts", half_up(F.col("mean_score"), 1).alias("mean_score"), half_up(F.col("spread"), 1).alias("spread"), half_up(F.col("bonus"), 1).alias("bonus"),
        half_up(0.75 * F.col("mean_score") + 0.25 * F.col("bonus")).cast("int").alias("site_score"), half_up(0.7 * F.col("mean_risk") + 0.3 * F.col("bonus")).cast("int").alias("site_risk"),
    )


def systematic_sample(rows: DataFrame, site: str, key: str, k: int) -> DataFrame:
    """Every n//k-th row of a site by key, at most k; all rows of a site with k or fewer."""
    placed = ranked(rows, [site], F.col(key), label="sample")
    sizes = placed.groupBy(F.col(site).alias("of_site")).agg(F.count("*").alias("of_n"))
    step = F.greatest(F.floor(F.col("of_n") / k), F.lit(1))
    kept = placed.join(few(materialize(sizes, "sample-sizes")), placed[site].eqNullSafe(F.col("of_site"))).filter((F.col("pos") % step == 0) & (F.col("pos") < step * k))
    return kept.select(*rows.columns)
