import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, **extra):
    """documents with ids 0.. and the given texts (None allowed)."""
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(seed, n, vocabulary=800):
    rng = random.Random(seed)
    return " ".join("w%dx" % rng.randrange(vocabulary) if rng.random() < 0.7 else rng.choice(["the", "of", "and", "is"]) for _ in range(n))


def odd_texts():
    """Nulls, empty, blank, one word, non-ASCII, very long, ties and repeats."""
    long = prose(1, 40_000)
    return [None, "", " \t\n", "word", "é" * 500, long, long, prose(2, 60), prose(2, 60), prose(2, 60) + " tail", "a" * 3000, " x y", "A!! B!! " * 40]


def with_clashes(df):
    """Extra columns named like ones that operators make."""
    from pyspark.sql import functions as F

    for name in ("fp", "size", "shard", "n", "anchor", "spans", "score", "topic", "weight", "u", "v", "rank", "text_hash", "ratio", "probability", "kept", "_id", "_kept", "_salt", "n_tokens", "stays", "several", "c0", "own_id", "cell_topic"):
        df = df.withColumn(name, F.lit(1))
    return df


def jaccard_groups(texts, least=0.8, width=5):
    bags = []
    for t in texts:
        w = (t or "").lower().encode().split()
        bags.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            same = bags[a] == bags[b]
            if same or (bags[a] & bags[b] and len(bags[a] & bags[b]) / len(bags[a] | bags[b]) >= least):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(texts))]
