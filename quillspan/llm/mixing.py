"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted per cell (source, language, topic); the cell weights are
raked to target marginals of the three in turn, and each document is kept with
its cell's calibrated probability, drawn from a hash of its id, so that the
kept tokens meet the budget in expectation.

Everything is DataFrame expressions.  The cell table has one row per
combination that occurs; it is joined back by broadcast while it has at most
``BROADCAST_CELLS`` rows and by a salted shuffle join beyond.

Null and empty texts have no tokens and probability 1 of their cell's making;
null sources and languages are cells of their own.  Repeated rows share their
id's draw.  A corpus without tokens keeps every document.  The columns that
``mix`` adds (n_tokens, topic, weight, probability, kept) replace columns of the
input that have their names; all other columns, whatever they are called, stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.workspace import materialize, table

ROUNDS = 8
CUT_ROUNDS = 4
TEMPER = 0.9
KEEP_SHARE = 0.9
SEED = "mix-1"
BROADCAST_CELLS = 100_000
SALTS = 64
MARGINS = ("source", "lang", "topic")

#: Fixed topic word lists (lower case, matched as whole ASCII words); order breaks ties.
TOPICS = {
    "legal": "licensed license released copyright legal law court contract",
    "account": "token password secret account login user card",
    "contact": "mail email phone address call example",
}
DEFAULT_TOPIC = "general"


def topic_pattern(words: str) -> str:
    return r"\b(" + "|".join(words.split()) + r")\b"


def topic(text: Column) -> Column:
    """The topic with most hits, or the default."""
    lower = F.lower(text)
    names = list(TOPICS)
    hits = [F.regexp_count(lower, F.lit(topic_pattern(TOPICS[n]))) for n in names]
    ranked = F.array(*(F.struct(h.alias("hits"), F.lit(-i).alias("rank"), F.lit(n).alias("name")) for i, (n, h) in enumerate(zip(names, hits))))
    # one cheap test saves the three counts for the texts that have none of the words
    any_word = lower.rlike(topic_pattern(" ".join(TOPICS.values())))
    return F.when(any_word, F.array_max(ranked)["name"]).otherwise(F.lit(DEFAULT_TOPIC))


def with_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_tokens (words between ASCII white space) and topic."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumn("n_tokens", F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")).withColumn("topic", topic(text))


def rake(cells: DataFrame, rounds: int = ROUNDS, temper: float = TEMPER, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with ``fitted``: tokens raked to target marginals, and the targets in tokens.

    ``targets`` names shares by marginal and value, as ``{"lang": {"en": 0.6}}``.
    Values not named share what the named ones leave, in proportion to their
    present shares to the power ``temper``; a marginal not named is tempered as a
    whole.  Shares of values that do not occur are given to the others in
    proportion.  Each step is one window per marginal over the cell table, and the table is
    written every CUT_ROUNDS rounds, so plans and lineage stay short.
    """
    everything = Window.partitionBy(F.lit(0))
    out = cells.filter("tokens > 0").withColumn("total", F.sum("tokens").over(everything).cast("double")).withColumn("fitted", F.col("tokens").cast("double"))
    for m in MARGINS:
        own = Window.partitionBy(m)
        raw = F.pow(F.sum("tokens").over(own) / F.col("total"), F.lit(temper))
        if named := (targets or {}).get(m):
            given = F.create_map(*(F.lit(x) for pair in named.items() for x in (pair[0], float(pair[1]))))[F.col(m)]
            out = out.withColumn("_given", given).withColumn("_other", F.when(F.col("_given").isNull(), raw)).withColumn("_own", F.sum("tokens").over(own))
            others = F.sum(F.col("_other") * F.col("tokens") / F.col("_own")).over(everything)
            out = out.withColumn("_raw", F.coalesce("_given", F.lit(max(0.0, 1.0 - sum(named.values()))) * F.col("_other") / others)).drop("_given", "_other", "_own")
            raw = F.col("_raw")
        # each value's raw share counts once: divide it among its cells by tokens
        out = out.withColumn("_raw", raw).withColumn("_part", F.col("_raw") * F.col("tokens") / F.sum("tokens").over(own))
        out = out.withColumn(f"target_{m}", F.col("_raw") / F.sum("_part").over(everything) * F.col("total")).drop("_raw", "_part")
    for i in range(rounds):
        for m in MARGINS:
            out = out.withColumn("fitted", F.col("fitted") * F.col(f"target_{m}") / F.sum("fitted").over(Window.partitionBy(m)))
        if i % CUT_ROUNDS == CUT_ROUNDS - 1:
            out = materialize(out, "mix-rake")
    return out.select(*MARGINS, "tokens", "total", "fitted", *(f"target_{m}" for m in MARGINS))


def marginal_errors(raked: DataFrame) -> DataFrame:
    """(margin, value, target, fitted) as shares of all tokens: how far each marginal of rake()'s result is from its target."""
    each = [raked.groupBy(F.col(m).alias("value")).agg((F.first(f"target_{m}") / F.first("total")).alias("target"), (F.sum("fitted") / F.first("total")).alias("fitted")).select(F.lit(m).alias("margin"), "value", "target", "fitted") for m in MARGINS]
    return reduce(DataFrame.unionByName, each)


def calibrate(raked: DataFrame, keep_share: float = KEEP_SHARE) -> DataFrame:
    """Cells with probability = min(1, rate * fitted / tokens), the rate such that expected tokens meet the budget.

    Cells by descending ratio: those before the first that the rate leaves
    below 1 are kept whole, and the rate shares the rest of the budget.
    """
    by_ratio = Window.partitionBy(F.lit(0)).orderBy(F.desc("ratio"), *MARGINS)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    budget = F.lit(keep_share) * F.col("total")
    out = (
        raked.withColumn("ratio", F.col("fitted") / F.col("tokens"))
        .withColumn("_whole", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
        .withColumn("_rest", F.sum("fitted").over(everything) - F.coalesce(F.sum("fitted").over(before), F.lit(0.0)))
        .withColumn("_rate", (budget - F.col("_whole")) / F.col("_rest"))
        .withColumn("_fits", F.col("_rate") * F.col("ratio") <= 1)
    )
    rate = F.max(F.when(F.col("_fits"), F.col("_rate"))).over(everything)
    first = F.min(F.when(F.col("_fits"), F.col("_whole"))).over(everything)
    probability = F.when(F.col("_whole") < first, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(rate, F.lit(1.0)) * F.col("ratio"))))
    return out.withColumn("probability", F.round(probability, 9)).select(*MARGINS, "ratio", "probability")


def draw(id_col: str, seed: str = SEED) -> Column:
    """A number in [0, 1) from the id."""
    digest = F.md5(F.concat_ws("/", F.lit(seed), F.col(id_col).cast("string")))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(16**12)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_share: float = KEEP_SHARE, rounds: int = ROUNDS, temper: float = TEMPER, features: DataFrame | None = None, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """All rows of ``docs`` with n_tokens, topic, weight (raked over present tokens), probability and kept."""
    rows = with_features(docs, text_col) if features is None else features
    cells = rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens"))
    fitted = materialize(calibrate(rake(cells, rounds, temper, targets), keep_share), "mix-cells").withColumnsRenamed({m: f"cell_{m}" for m in MARGINS})
    names = rows.columns
    rows = rows.toDF(*(f"c{k}" for k in range(len(names))))  # so that no name of the input meets one of the cells
    own = dict(zip(names, rows.columns))
    same = [rows[own[m]].eqNullSafe(fitted[f"cell_{m}"]) for m in MARGINS]
    if fitted.count() <= BROADCAST_CELLS:
        joined = rows.join(F.broadcast(fitted), same, "left")
    else:
        copies = fitted.withColumn("cell_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.join(copies, [*same, F.pmod(F.xxhash64(rows[own[id_col]]), F.lit(SALTS)) == copies["cell_salt"]], "left")
    weight, probability = F.coalesce("ratio", F.lit(1.0)), F.coalesce("probability", F.lit(1.0))
    kept = draw(own[id_col]) < probability
    before = [F.col(own[c]).alias(c) for c in names if c not in ("weight", "probability", "kept")]
    return joined.select(*before, weight.alias("weight"), probability.alias("probability"), kept.alias("kept"))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    features = materialize(with_features(docs).drop("text"), "mix-features")
    mixed = mix(docs, features=features)
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "kept")


def mixing_sql(documents: str = "documents") -> str:
    """The same in DuckDB SQL, raking unrolled."""
    count = lambda words: f"len(regexp_extract_all(lower(coalesce(text, '')), '{topic_pattern(words)}'))"
    names = list(TOPICS)
    case = "CASE " + " ".join(f"WHEN h{i} > 0 AND h{i} >= greatest({', '.join(f'h{j}' for j in range(len(names)))}) THEN '{n}'" for i, n in enumerate(names)) + f" ELSE '{DEFAULT_TOPIC}' END"
    ctes = [
        f"h AS (SELECT doc_id, source, lang, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens, {', '.join(f'{count(TOPICS[n])} AS h{i}' for i, n in enumerate(names))} FROM {documents})",
        f"rows_ AS (SELECT doc_id, source, lang, n_tokens, {case} AS topic FROM h)",
        "c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM rows_ GROUP BY ALL HAVING sum(n_tokens) > 0)",
        "t0 AS (SELECT *, sum(tokens) OVER () AS total, tokens AS fitted FROM c)",
    ]
    last = "t0"
    for k, m in enumerate(MARGINS):
        ctes.append(f"r{k} AS (SELECT *, pow(sum(tokens) OVER (PARTITION BY {m}) / total, {TEMPER}) AS raw_, sum(tokens) OVER (PARTITION BY {m}) AS own_ FROM {last})")
        ctes.append(f"g{k} AS (SELECT * EXCLUDE (raw_, own_), raw_ / sum(raw_ * tokens / own_) OVER () * total AS target_{m} FROM r{k})")
        last = f"g{k}"
    for i in range(ROUNDS):
        for m in MARGINS:
            ctes.append(f"i{i}{m} AS (SELECT * REPLACE (fitted * target_{m} / sum(fitted) OVER (PARTITION BY {m}) AS fitted) FROM {last})")
            last = f"i{i}{m}"
    ctes += [
        f"q AS (SELECT source, lang, topic, tokens, total, fitted, fitted / tokens AS ratio FROM {last})",
        f"s AS (SELECT *, coalesce(sum(tokens) OVER w, 0) AS whole, ({KEEP_SHARE} * total - coalesce(sum(tokens) OVER w, 0)) / (sum(fitted) OVER () - coalesce(sum(fitted) OVER w, 0)) AS rate FROM q WINDOW w AS (ORDER BY ratio DESC, source NULLS FIRST, lang NULLS FIRST, topic NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))",
        "u AS (SELECT *, max(CASE WHEN rate * ratio <= 1 THEN rate END) OVER () AS used, min(CASE WHEN rate * ratio <= 1 THEN whole END) OVER () AS first_ FROM s)",
        "p AS (SELECT source, lang, topic, ratio, round(CASE WHEN whole < first_ THEN 1.0 ELSE least(1.0, greatest(0.0, coalesce(used, 1.0) * ratio)) END, 9) AS probability FROM u)",
    ]
    return (
        "WITH " + ",\n".join(ctes) + "\nSELECT r.doc_id, r.source, r.lang, r.topic, r.n_tokens, round(coalesce(p.ratio, 1.0), 6) AS weight, round(coalesce(p.probability, 1.0), 6) AS probability,"
        f" ('0x' || substr(md5(concat_ws('/', '{SEED}', CAST(r.doc_id AS VARCHAR))), 1, 12))::BIGINT / {float(16**12)!r} < coalesce(p.probability, 1.0) AS kept"
        " FROM rows_ r LEFT JOIN p ON r.source IS NOT DISTINCT FROM p.source AND r.lang IS NOT DISTINCT FROM p.lang AND r.topic IS NOT DISTINCT FROM p.topic"
    )


OP8_SQL = mixing_sql()
