"""All text-quality signals, family means, scores, problems and the roll-up of a site against the formulas in plain Python."""

import math
import re
import statistics
from collections import Counter

import pytest

from quillspan.operators import lexicons as L
from quillspan.operators import stylometry as S

WORD = re.compile(r"[a-zà-öø-ÿœæ0-9'’-]+")
CAP = "[A-ZÀ-Ý]"


def half_up(x, digits=0):
    return math.floor(x * 10**digits + 0.5) / 10**digits


def ramp(v, low, high, invert=False):
    x = min(max((v - low) / (high - low), 0.0), 1.0)
    return half_up((1 - x if invert else x) * 100, 1)


def spread(xs):
    return statistics.pstdev(xs) / statistics.mean(xs) if xs and statistics.mean(xs) else 0.0


def total(text, phrases):
    return sum(text.count(p) for p in phrases)


def signals(text):
    t = (text or "").strip(" ")
    low = t.lower()
    words = WORD.findall(low)
    if len(words) < 80:
        return None
    n = len(words)
    hit = lambda lexicon: sum(w in lexicon for w in words)
    french = hit(L.ENGLISH_HITS) <= hit(L.FRENCH_HITS)
    pick = lambda fr, en: fr if french else en
    per_k = lambda v: v * 1000 / n
    found = lambda pattern, x=t, flags=re.M: len(re.findall(pattern, x, flags))
    sents = [s for s in (x.strip(" ") for x in re.split("␞", re.sub(r"([.!?…])\s+", "\\1␞", t))) if len(s) > 2]
    paras = [p for p in (x.strip(" ") for x in re.split(r"\n\s*\n", t)) if len(p) > 40]
    lines = [x for x in (y.strip(" ") for y in t.split("\n")) if x]
    lens, para_lens = [len(WORD.findall(s.lower())) for s in sents], [len(WORD.findall(p.lower())) for p in paras]
    m, mean = max(len(sents), 1), statistics.mean(lens)
    out = {"n_words": n}

    out["a1"] = ramp(spread(lens), 0.25, 0.75, True)
    out["a2"] = ramp(sum(abs(x - mean) <= 0.25 * mean for x in lens) / m, 0.30, 0.70)
    out["a3"] = ramp(spread(para_lens), 0.15, 0.65, True) if len(para_lens) >= 3 else None
    out["a4"] = ramp(t.count(",") / m, 1.1, 2.6) if t.count(",") >= m else None
    out["a5"] = ramp(sum(x <= 4 for x in lens) / m, 0.0, 0.12, True)

    name = "[a-zà-ÿ0-9_’-]+"
    triples = found(rf"{name},\s+{name}\s+(?:et|and|ou|or)\s+{name}", t, re.I) + found(r",\s+[^,.;:\n]{4,60},\s+(?:et|and|ou|or)\s+", t, re.I)
    connectors = tuple(pick(L.CONNECTORS_FR, L.CONNECTORS_EN))
    out["b1"] = ramp(per_k(total(low, pick(L.PHRASES_FR + L.PHRASES_EN, L.PHRASES_EN))), 1, 9)
    out["b2"] = ramp(per_k(hit(pick(L.WORDS_FR, L.WORDS_EN))), 3, 22)
    out["b3"] = ramp(sum(s.lower().startswith(connectors) for s in sents) / m, 0.06, 0.30)
    out["b4"] = ramp(per_k(triples), 2, 12)
    out["b5"] = ramp(per_k(found(r"(?:[^,.\n:]{2,45},\s+){2,}[^,.\n:]{2,45}\s*:")), 1, 7)
    out["b6"] = ramp(per_k(found("(?:ce n'est pas (?:seulement|juste|simplement)|not (?:just|only|merely))", low)), 0.4, 3)
    out["b7"] = ramp(per_k(hit(L.SUPERLATIVES)), 2, 14)

    heads = re.findall(r"(?m)^\s*#{1,4}\s*([^\n<]{4,90})", t)
    concluded = found(r"^\s*(?:#{1,4}\s*)?(?:en )?(?:conclusion|pour conclure|en résumé|en somme|le mot de la fin|final thoughts|wrapping up)(?:[^a-zà-ÿ]|$)", low)
    out["c1"] = ramp(per_k(found(rf"^\s*(?:[-*•]|\d+\.)\s*(?:\*\*)?{CAP}[^:\n]{{2,40}}\s*:")), 1, 10)
    out["c2"] = 70.0 if concluded else 0.0
    out["c3"] = ramp(max(sum(h.strip(" ").endswith("?") for h in heads), sum(":" in h for h in heads)) / len(heads), 0.4, 0.95) if len(heads) >= 3 else None
    out["c4"] = ramp(per_k(t.count("—") + t.count(" - ")), 2.5, 14)
    out["c5"] = 70.0 if any(8 < len(x) < 70 and x[-1] not in ".!?:" and re.search(r"(?i),\s*c'est(?:[^a-zà-ÿ]|$)", x) for x in lines) else 0.0
    out["c6"] = None
    if lines and 10 < len(lines[0]) < 90:
        title = WORD.findall(lines[0].lower())
        body = low[len(lines[0]) :]
        again = sum(len(g) >= 12 and g in body for g in (" ".join(title[k : k + 3]) for k in range(max(len(title) - 2, 1)))) if len(title) >= 3 else 0
        out["c6"] = 95.0 if again >= 2 else 85.0 if again else 0.0
    out["c7"] = 45.0 if found(r"^\s*(?:#{1,4}\s*)?(?:faq|questions fréquentes|foire aux questions|frequently asked)", low) else 0.0

    strong, numbers = found(r"\d[\d\s,.]*(?:€|\$|%|km|kg|m²|kwh)|(?:19|20)\d{2}", t, re.I), found(r"\d[\d\s,.]*")
    first, asked, oral = total(low, pick(L.FIRST_PERSON_FR, L.FIRST_PERSON_EN)), t.count("!") + t.count("?"), total(low, pick(L.ORAL_FR + L.ORAL_EN, L.ORAL_EN))
    corporate = hit(L.CORPORATE)
    out["d1"] = ramp(per_k(strong + 0.5 * max(numbers - strong, 0)), 2, 18, True)
    out["d2"] = ramp(per_k(sum(found(rf"[\s(«]{CAP}[a-zà-ÿ]{{2,}}", s) for s in sents)), 10, 55, True)
    out["d3"] = ramp(per_k(first), 0, 6, True)
    out["d4"] = ramp(per_k(corporate), 12, 40) if not first and corporate else None
    out["d5"] = ramp(per_k(hit(L.MONTHS) + sum(bool(re.fullmatch("(?:19|20)[0-9]{2}", w)) for w in words)), 2, 14, True)
    out["d6"] = ramp(per_k(total(low, pick(L.VAGUE_FR, L.VAGUE_EN))), 5, 28)
    out["d7"] = ramp(per_k(found("[«\"“][^»\"”]{15,240}[»\"”]")), 0, 3, True)

    ttrs = [len(set(words[k : k + 200])) / min(200, n - k) for k in range(0, max(1, n - 50), 200)]
    fours, long = Counter(zip(*(words[k:] for k in range(4)))), Counter(w for w in words if len(w) >= 5)
    ttr = statistics.mean(ttrs)
    opens = [re.split(r"\s+", s)[0].lower() for s in sents]
    out["e1"] = ramp(ttr, 0.42, 0.62, True) * 0.6 + ramp(ttr, 0.72, 0.85) * 0.4
    out["e2"] = ramp(sum(c for c in fours.values() if c > 1) / sum(fours.values()), 0.02, 0.12)
    out["e3"] = ramp(len(set(opens)) / m, 0.35, 0.75, True)
    out["e4"] = ramp(max(long.values()) / sum(long.values()), 0.02, 0.07) if long else None

    marks = Counter(c for c in t if c in ".,;:!?…()—«»\"'")
    every = sum(marks.values()) or 1
    out["f1"] = ramp(-sum(c / every * math.log2(c / every) for c in marks.values()), 1.2, 2.6, True)
    out["f2"] = ramp(per_k(asked), 0.5, 8, True)
    out["f3"] = ramp(per_k(oral), 0, 4, True)
    out["f4"] = 85.0 if not oral and not asked and not first else 0.0
    out["f5"] = ramp(per_k(t.count("(")), 0.3, 5, True)
    out["f6"] = ramp(abs(sum(map(len, words)) / n - (5.4 if french else 4.9)), 1.2, 0.2)
    return out


WEIGHTS = {"a": 20, "b": 20, "c": 13, "d": 20, "e": 15, "f": 12}


def scores(sig):
    fam = {}
    for f in WEIGHTS:
        own = [v for k, v in sig.items() if k[0] == f and k[1].isdigit() and v is not None]
        fam[f] = half_up(sum(own) / len(own), 1)
    weights = dict(WEIGHTS)
    if sig["n_words"] < 300:
        weights["e"] = 12 if fam["e"] >= 40 else 0
    elif sig["n_words"] < 600:
        weights["e"] = 12 if fam["e"] >= 40 else 9
    score = half_up(sum(fam[f] * w for f, w in weights.items()) / sum(weights.values()))
    live = [v for f, v in fam.items() if weights[f]]
    strong = sum(v >= 40 for v in live)
    if strong >= 4 and max(live) >= 70:
        score = min(100, score + 6 + (4 if strong >= 5 else 0))
    verdict = "very likely generated" if score >= 72 else "likely generated" if score >= 55 else "mixed" if score >= 38 else "likely human"
    risk = half_up(min(100, score * 0.55 + fam["d"] * 0.30 + fam["b"] * 0.15))
    return {f"fam_{f}": v for f, v in fam.items()} | {"score": score, "verdict": verdict, "value_risk": risk, "risk_band": "high" if risk >= 65 else "moderate" if risk >= 45 else "low"}


TEMPLATE = """Guide complet du plombier à Lyon

# Pourquoi nous choisir ?
De plus, il est important de noter que le plombier à Lyon vous accompagne. En outre, notre équipe, nos outils et nos prix sont crucial et optimal. Par ailleurs, guide complet du plombier à Lyon.

# Combien ça coûte ?
- Prix : 50 € de l'heure, le 3 mars 2024
- Délai : 2 jours
- Qualité : la meilleure

# Que faire ?
Ce n'est pas seulement rapide, mais idéal. De nombreux clients, plusieurs devis et divers travaux : tout est possible. Franchement, j'ai testé (vraiment) ! « Une citation assez longue pour compter ici », dit Martin Dupont — oui.

FAQ
La logistique, c'est sérieux
En conclusion, n'hésitez pas à nous appeler. Ainsi, vous aurez un large éventail de prestations. Ensuite, vos besoins sont notre priorité. Enfin, un service de qualité à votre écoute.
"""
ENGLISH = """The honest truth about wide ranges

However, it's important to note that the tool is not just robust, but seamless and innovative. Furthermore, a wide range of options, a comprehensive guide and peace of mind stands out. Moreover, you and your team will elevate your work in 2021 and in January.

I think this is fine. I tested it! "A long enough quotation to be counted here" said Anna. Many, numerous, various and several things often happen. Honestly, in my opinion, the best amazing deal. In conclusion, look no further than this one for the perfect and ultimate result that this and that with you.

Overall, we tested the thing for the third time with a cost of 30 % and 12 kg. Short. Very short. Ok then."""


COMPANY = "Les salons, les jardins, les terrasses : tout est pour vous et votre famille, nos salons, nos tables et nos fleurs sont dans la maison. Vos repas, vos fêtes, vos mariages : une maison des plaisirs. "


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    docs = [(r["doc_id"], r["source"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(50).collect()]
    extra = [TEMPLATE, ENGLISH, TEMPLATE * 4, ENGLISH * 7, TEMPLATE.replace("\n\n", "\n"), " ".join([ENGLISH, TEMPLATE]), "word " * 79, "mot " * 200, "a b c " * 60, TEMPLATE + "—" * 30 + ENGLISH, COMPANY * 4, None, ""]
    return docs + [(10_000 + k, f"s{k % 2}", x) for k, x in enumerate(extra)]


@pytest.fixture(scope="module")
def frame(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, source string, text string")


def test_every_signal(frame, texts):
    got = {r["doc_id"]: r.asDict() for r in S.score_signals(frame).collect()}
    want = {i: s for i, _, t in texts if (s := signals(t))}
    assert set(got) == set(want) and len(want) > 40
    lit = Counter()
    for i, s in want.items():
        for name, v in s.items():
            w = got[i][name]
            assert (v is None) == (w is None) and (v is None or abs(v - w) < 0.11), (i, name, v, w)
            lit[name] += v not in (None, 0.0)
    assert all(lit[name] for name in want[10_000])  # every signal is at work somewhere


def test_scores(frame, texts):
    want = {i: scores(s) for i, _, t in texts if (s := signals(t))}
    got = {r["doc_id"]: r.asDict() for r in S.text_scores(frame).collect()}
    assert set(got) == set(want)
    for i, w in want.items():
        assert all(got[i][k] == w[k] if isinstance(w[k], str) else abs(got[i][k] - w[k]) < 0.11 for k in w), (i, w, got[i])
    assert len({w["verdict"] for w in want.values()}) >= 3


def test_problems_and_site(frame, texts):
    sig = {i: s for i, _, t in texts if (s := signals(t))}
    bounds = {"cliches": ("b1", 50), "stock_words": ("b2", 50), "connectors": ("b3", 50), "even_rhythm": ("a1", 70), "formula_blocks": ("e2", 50), "keyword_stuffing": ("e4", 60), "no_figures": ("d1", 80), "faq_template": ("c7", 45)}
    want = {(i, name) for i, s in sig.items() for name, (c, least) in bounds.items() if s[c] is not None and s[c] >= least}
    assert {(r["doc_id"], r["problem"]) for r in S.problems(S.score_signals(frame)).collect()} == want
    titles = frame.sparkSession.createDataFrame([("s0", 0.4), ("s1", 0.1)], "site string, mean_jaccard double")
    got = {r["site"]: r for r in S.site_rollup(S.text_scores(frame, keep=("source",)), "source", titles).collect()}
    for site, alike in (("s0", 0.4), ("s1", 0.1)):
        own = [scores(sig[i]) for i, s, _ in texts if s == site and i in sig]
        parts = [ramp(statistics.pstdev([x["score"] for x in own]), 3, 18, True)] if len(own) >= 3 else []
        bonus = statistics.mean([*parts, ramp(alike, 0.15, 0.55)])
        mean, risk = statistics.mean(x["score"] for x in own), statistics.mean(x["value_risk"] for x in own)
        r = got[site]
        assert (r["texts"], r["site_score"], r["site_risk"]) == (len(own), half_up(0.75 * mean + 0.25 * bonus), half_up(0.7 * risk + 0.3 * bonus)) and abs(r["bonus"] - bonus) < 0.11


def test_too_short(frame, texts):
    got = {r["doc_id"]: r["word_count"] for r in S.rejected(frame).collect()}
    assert got == {i: n for i, _, t in texts if (n := len(WORD.findall((t or "").lower()))) < 80}
