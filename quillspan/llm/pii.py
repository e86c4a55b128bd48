"""Personal data by weak supervision.

Four base kinds come from fixed patterns and are always reported.  Further
spans are proposed generously (secrets, local phone numbers, account numbers,
titled names); regex, gazetteer and context labelers vote on each proposal,
expectation-maximisation estimates the labelers' reliabilities from the counts
of vote patterns over all documents, and a logistic span classifier fitted to
the resulting posteriors decides which proposals are reported.

Only counts per (kind, votes, features) reach the driver: at most
4 * 3**5 * 2**FEATURES rows whatever the corpus size.

Null and empty texts have no spans.  Offsets are code points, end exclusive.
Repeated rows give repeated results; extra columns of the input are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.workspace import materialize

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("secret", "local_phone", "account", "name")
KIND_ORDER = {k: i for i, k in enumerate(BASE_KINDS + ADDED_KINDS)}

SPAN_TYPE = "array<struct<kind:string,start:int,end:int,base:boolean>>"
CANDIDATE_TYPE = "array<struct<kind:string,start:int,end:int,votes:array<int>,features:int>>"

# --- fixed patterns of the base kinds -------------------------------------------------
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# --- fixed word lists of the gazetteer labeler ----------------------------------------
SECRET_WORDS = frozenset("token secret password passwd pwd key apikey api_key access_key auth bearer credential".split())
PHONE_WORDS = frozenset("tel phone telephone call mobile cell fax whatsapp telefon téléphone teléfono".split())
ACCOUNT_WORDS = frozenset("account iban card visa mastercard amex konto compte cuenta ssn passport".split())
TITLES = frozenset("mr mrs ms dr prof herr frau mme mlle señor señora".split())
GAZETTEER = {"secret": SECRET_WORDS, "local_phone": PHONE_WORDS, "account": ACCOUNT_WORDS, "name": TITLES}

# --- proposals: wide on purpose, the labelers judge them ------------------------------
_LONG_TOKEN = re.compile(r"(?<![A-Za-z0-9_])(?=[A-Za-z]*+[0-9])[A-Za-z0-9_]{20,}+")
_LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+])\(?[0-9]{2,4}\)?[ .-][0-9]{2,4}(?:[ .-][0-9]{2,4})++(?![0-9A-Za-z])")
_ACCOUNT = re.compile(r"(?<![0-9A-Za-z.-])(?:[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}|[0-9]{9,34})(?![0-9A-Za-z])")
_NAME = re.compile(r"\b(Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Señor|Señora)\.? ([A-ZÀ-Þ][a-zß-ÿ]+(?: [A-ZÀ-Þ][a-zß-ÿ]+)?)")
_WORD_BEFORE = re.compile(r"([^\W\d]+)[^\w]*\Z")

LABELERS = ("shape", "gazetteer", "assignment", "variety", "counter_shape")
FEATURES = 7


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, by start and then kind."""
    out: list[tuple[str, int, int]] = []
    at, end = text.find("@"), 0
    while at >= 0:
        if m := _DOMAIN.match(text, at):
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                end = m.end()
                out.append(("email", start, end))
        at = text.find("@", at + 1)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m[0].split(".")]  # of any length: int() refuses thousands of digits
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                    out.append(("phone", m.start(), m.end()))
    out.sort(key=lambda s: (s[1], KIND_ORDER[s[0]]))
    return out


def _entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def _votes(kind: str, text: str, start: int, end: int) -> tuple[list[int], int]:
    """Votes of the labelers (1 personal, -1 not, 0 abstains) and the feature bits of a proposal."""
    value, before = text[start:end], text[max(0, start - 24) : start]
    after = text[end : end + 2]
    word = m[1].lower() if (m := _WORD_BEFORE.search(before)) else ""
    digits = sum(c.isdigit() for c in value)
    assigned = bool(re.search(r"[=:]\s*[\"']?\Z", before))
    quoted = before[-1:] in "\"'" and before[-1:] != "" and after[:1] == before[-1:]
    varied = _entropy(value) >= 3.0
    if kind == "secret":
        shape = 1 if re.fullmatch(r"[0-9a-f]{32,64}|[A-Z0-9_]{20,}|[A-Za-z0-9_]{24,}", value) else -1
        counter = -1 if re.search(r"(.{2,6})\1{3,}", value) else 0
    elif kind == "local_phone":
        shape = 1 if 7 <= digits <= 11 else -1
        counter = -1 if re.fullmatch(r"(?:19|20)[0-9]{2}[ .-][0-9]{2}[ .-][0-9]{2}|[0-9]{2}[ .-][0-9]{2}[ .-](?:19|20)?[0-9]{2}", value) else 0
    elif kind == "account":
        shape = 1 if value[:2].isalpha() or 13 <= len(value) <= 19 else -1
        counter = -1 if len(set(value)) <= 2 else 0
    else:
        shape, counter, varied = 1 if " " in value else 0, 0, True
        word = word or text[max(0, start - 8) : start].strip(" .").lower()
    votes = [shape, 1 if word in GAZETTEER[kind] else 0, 1 if assigned or quoted else 0, 1 if varied else -1, counter]
    features = sum(
        1 << i
        for i, on in enumerate(
            (assigned, quoted, varied, digits * 2 > len(value), len(value) >= 32, before[-1:].isspace() or not before, word in GAZETTEER[kind])
        )
        if on
    )
    return votes, features


def proposals(text: str, base: list[tuple[str, int, int]]) -> list[dict]:
    """Proposed spans that touch no base span, with votes and features."""
    found: list[tuple[str, int, int]] = []
    if _DIGIT.search(text):
        found += [("secret", m.start(), m.end()) for m in _LONG_TOKEN.finditer(text)]
        found += [("local_phone", m.start(), m.end()) for m in _LOCAL_PHONE.finditer(text)]
        found += [("account", m.start(), m.end()) for m in _ACCOUNT.finditer(text)]
    found += [("name", m.start(2), m.end(2)) for m in _NAME.finditer(text)]
    if not found:
        return []
    found.sort(key=lambda s: (s[1], KIND_ORDER[s[0]]))
    out, edge, later = [], 0, 0
    taken = sorted((s, e) for _, s, e in base)
    for kind, start, end in found:
        while later < len(taken) and taken[later][0] < end:
            edge = max(edge, taken[later][1])
            later += 1
        if start < edge:
            continue
        edge = end
        votes, features = _votes(kind, text, start, end)
        out.append({"kind": kind, "start": start, "end": end, "votes": votes, "features": features})
    return out


_SCANNED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("base", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))),
        ("candidates", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("votes", pa.list_(pa.int32())), ("features", pa.int32())]))),
    ]
)


def _scan(batches):
    for batch in batches:
        base_rows, cand_rows = [], []
        for text in batch.column(1).to_pylist():
            base = base_spans(text) if text else []
            base_rows.append([{"kind": k, "start": s, "end": e} for k, s, e in base])
            cand_rows.append(proposals(text, base) if text else [])
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(base_rows, _SCANNED.field(1).type), pa.array(cand_rows, _SCANNED.field(2).type)], schema=_SCANNED)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, candidates): one pass over the whole texts."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _scan, f"doc_id long, base array<struct<kind:string,start:int,end:int>>, candidates {CANDIDATE_TYPE}"
    )


def estimate_reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, dict]:
    """EM for one kind: ``votes`` are distinct patterns (-1, 0, 1), ``counts`` how often each occurs.

    Returns the posterior of each pattern and the learnt prior and tables
    P(vote | class).  Starts from the majority vote; smoothing keeps a labeler
    that hardly ever votes near uninformative.  No patterns: empty posterior.
    """
    if not len(votes):
        return np.zeros(0), {"prior": 0.5, "tables": np.full((votes.shape[1], 2, 3), 1 / 3)}
    q = 1 / (1 + np.exp(-1.5 * votes.sum(axis=1)))
    one_hot = (votes[:, :, None] == np.array([-1, 0, 1])).astype(float)
    prior, tables = 0.5, None
    for _ in range(rounds):
        weight = np.stack([(1 - q) * counts, q * counts])
        prior = float((weight[1].sum() + 1) / (counts.sum() + 2))
        # labelers are better than chance: each class starts with pseudo-votes on its own side
        pseudo = np.array([[1.2, 1.0, 0.8], [0.8, 1.0, 1.2]])
        raw = np.einsum("cp,plv->lcv", weight, one_hot) + pseudo[None]
        tables = raw / raw.sum(axis=2, keepdims=True)
        log = np.einsum("plv,lcv->pc", one_hot, np.log(tables)) + np.log([1 - prior, prior])
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -60, 60)))
        if np.abs(new - q).max() < 1e-9:
            q = new
            break
        q = new
    return q, {"prior": prior, "tables": tables}


def fit_span_classifier(x: np.ndarray, target: np.ndarray, weight: np.ndarray, rounds: int = 30, ridge: float = 1.0) -> np.ndarray:
    """Weighted logistic regression by Newton steps; soft targets are the EM posteriors."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - target)) + ridge * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def feature_matrix(votes: np.ndarray, features: np.ndarray) -> np.ndarray:
    bits = (features[:, None] >> np.arange(FEATURES)) & 1
    return np.hstack([votes.reshape(len(features), -1), bits]).astype(float)


def train(scanned: DataFrame) -> dict:
    """Per added kind: reliabilities and classifier weights, from pattern counts over all documents."""
    rows = (
        scanned.select(F.explode("candidates").alias("c"))
        .groupBy("c.kind", "c.votes", "c.features")
        .count()
        .toPandas()
        .sort_values(["kind", "features", "votes"], key=lambda s: s.map(str))
    )
    model = {}
    for kind in ADDED_KINDS:
        own = rows[rows["kind"] == kind]
        votes = np.array([list(v) for v in own["votes"]], dtype=int).reshape(len(own), len(LABELERS))
        counts = own["count"].to_numpy(float)
        q, learnt = estimate_reliabilities(votes, counts)
        if len(own):
            learnt["weights"] = fit_span_classifier(feature_matrix(votes, own["features"].to_numpy(int)), q, counts)
        model[kind] = learnt
    return model


def _resolver(model: dict, threshold: float):
    weights = {k: m["weights"] for k, m in model.items() if "weights" in m}
    cut = math.log(threshold / (1 - threshold))

    def run(batches):
        known: dict = {}
        for batch in batches:
            rows = []
            for base, candidates in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                spans = [b | {"base": True} for b in base]
                for c in candidates:
                    key = (c["kind"], tuple(c["votes"]), c["features"])
                    if key not in known:
                        x = feature_matrix(np.array([c["votes"]]), np.array([c["features"]]))[0]
                        w = weights.get(c["kind"])
                        known[key] = w is not None and float(x @ w[:-1] + w[-1]) >= cut
                    if known[key]:
                        spans.append({"kind": c["kind"], "start": c["start"], "end": c["end"], "base": False})
                spans.sort(key=lambda s: (s["start"], KIND_ORDER[s["kind"]]))
                rows.append(spans)
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    return run


def detect_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, model: dict | None = None) -> DataFrame:
    """(doc_id, spans): base spans, and added spans whose classifier score is at least ``threshold``.

    With ``model`` (from :func:`train`) nothing is learnt anew.
    """
    scanned = materialize(scan(docs, id_col, text_col), "pii-scan")
    return scanned.mapInArrow(_resolver(model or train(scanned), threshold), f"doc_id long, spans {SPAN_TYPE}")


def redact(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): each reported span is replaced by ``[kind]``; ids must be unique."""

    def run(batches):
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                parts, at = [], 0
                for s in spans or []:
                    if s["start"] >= at:
                        parts += [text[at : s["start"]], f"[{s['kind']}]"]
                        at = s["end"]
                texts.append(None if text is None else "".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    left = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return left.join(found, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, text string")


def op1_pii(spark, sf_dir: str) -> DataFrame:
    """All documents with counts of the base kinds, their digest, and all spans."""
    from quillspan.workspace import table

    found = detect_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    of_kind = lambda kind: F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        *(F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(shown(base), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"),
    )
