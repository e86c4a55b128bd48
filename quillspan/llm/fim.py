"""Fill-in-middle transformation with content-defined chunk memoization.

A document is cut into tokens (runs of letters, or one other character) and two
token positions part it into prefix, middle and suffix.  Finding those positions
needs token counts, and boilerplate or copied passages would be counted again in
every document that holds them.  So a rolling hash cuts each text where its last
``WINDOW`` characters say so, which makes equal passages into equal chunks
wherever they stand; the summary of a chunk (how many tokens, whether it begins
and ends with a letter) is kept in a bounded cache per task and used again only
for a chunk of equal content.  Summaries combine like numbers: counts add up,
less one where a run of letters goes on across the border.  Running counts then
name the chunk that holds a cut, and only that chunk is looked into.

Results do not depend on the cache or on where chunks end.  Rows: one per row of
the input, whatever repeats.  Null texts are empty; empty texts and texts that
hold a sentinel stay plain, as does the share of texts that the draw leaves
plain.  Draws depend on the id alone; a null id draws like the empty string.
Only ``doc_id`` and ``text`` are read, so further columns of any name do no
harm.  A text is worked on alone, in time and memory linear in its length.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.workspace import spread, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of documents rearranged, and of those the percent in suffix-first order.
RATE, SPM = 90, 20
#: Characters that the rolling hash looks back on; one place in AVERAGE ends a chunk, none before LEAST, one at MOST.
WINDOW, AVERAGE, LEAST, MOST = 32, 1024, 256, 8192
#: Characters of chunks that a task remembers.
CACHE = 4_000_000
_SEED = 0x9E3779B1


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def letters(points: np.ndarray) -> np.ndarray:
    low = points | 0x20
    return (low >= 97) & (low <= 122)


def chunk_ends(points: np.ndarray) -> list[int]:
    """Where chunks end: after characters whose rolling hash over the last WINDOW ones says so."""
    n = len(points)
    if n <= LEAST:
        return [n] if n else []
    h = (points ^ (points >> 7)) * np.uint32(_SEED)
    h ^= h >> 15
    width = 1
    while width < WINDOW:  # sums over 1, 2, 4 .. characters, older ones shifted
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    marks = np.flatnonzero((h >> np.uint32(8)) % AVERAGE == 0) + 1
    ends, at = [], 0
    for m in marks.tolist():
        while m - at > MOST:
            at += MOST
            ends.append(at)
        if m - at >= LEAST:
            ends.append(m)
            at = m
    while n - at > MOST:
        at += MOST
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def token_starts(points: np.ndarray) -> np.ndarray:
    """Places of the characters that begin a token."""
    if not len(points):
        return np.empty(0, np.int64)
    letter = letters(points)
    begins = ~letter
    begins[0] = True
    begins[1:] |= letter[1:] & ~letter[:-1]
    return np.flatnonzero(begins)


class Chunks:
    """Summaries of chunks by hash of their content, forgotten in the order of their last use."""

    def __init__(self, size: int = CACHE) -> None:
        self.size, self.held, self.hits = size, 0, 0
        self.known: OrderedDict[int, tuple[bytes, tuple[int, bool, bool]]] = OrderedDict()

    def summary(self, points: np.ndarray) -> tuple[int, bool, bool]:
        """(tokens, begins with a letter, ends with a letter) of a chunk."""
        content = points.tobytes()
        key = hash(content)
        entry = self.known.get(key)
        if entry is not None and entry[0] == content:
            self.known.move_to_end(key)
            self.hits += 1
            return entry[1]
        letter = letters(points)
        edges = (len(token_starts(points)), bool(letter[0]), bool(letter[-1]))
        if entry is not None:
            self.held -= len(entry[0]) // 4
        self.known[key] = (content, edges)
        self.known.move_to_end(key)
        self.held += len(points)
        while self.held > self.size:
            self.held -= len(self.known.popitem(last=False)[1][0]) // 4
        return edges


class Outline:
    """Where the tokens of one text are, by running counts over its chunks."""

    def __init__(self, text: str, chunks: Chunks) -> None:
        self.points = code_points(text)
        self.ends = chunk_ends(self.points)
        self.joined, self.counts = [], [0]  # whether a chunk goes on with the letters before it; tokens begun before each chunk
        at, letter_before = 0, False
        for end in self.ends:
            n, first, last = chunks.summary(self.points[at:end])
            goes_on = letter_before and first
            self.joined.append(goes_on)
            self.counts.append(self.counts[-1] + n - goes_on)
            at, letter_before = end, last
        self.n = self.counts[-1]

    def place(self, k: int) -> int:
        """Code points before token k; all of them for k = n."""
        if k >= self.n:
            return len(self.points)
        c = int(np.searchsorted(self.counts, k, "right")) - 1
        start = self.ends[c - 1] if c else 0
        return start + int(token_starts(self.points[start : self.ends[c]])[k - self.counts[c] + self.joined[c]])


def draws(doc_id) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit draws of a document."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def rearrange(doc_id, text: str | None, chunks: Chunks, rate: int = RATE, spm: int = SPM) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one document."""
    text = text or ""
    outline = Outline(text, chunks)
    h1, h2, h3, h4 = draws(doc_id)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= rate:
        return outline.n, "plain", None, None, text
    a, b = sorted((h1 % (outline.n + 1), h2 % (outline.n + 1)))
    i, j = outline.place(a), outline.place(b)
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    if h4 % 100 < spm:
        return outline.n, "spm", i, j - i, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return outline.n, "psm", i, j - i, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def fill_in_middle(docs: DataFrame, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row; ``rate`` percent are rearranged, ``spm`` percent of them suffix first."""

    def work(batches) -> Iterator:
        import pyarrow as pa

        chunks = Chunks()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = [rearrange(i, t, chunks, rate, spm) for i, t in zip(ids, batch.column("text").to_pylist(), strict=True)]
            n, form, before, middle, output = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    rows = spread(docs.select("doc_id", docs["text"].cast("string").alias("text")))
    return rows.mapInArrow(work, f"doc_id {dict(rows.dtypes)['doc_id']}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of, from output and form alone."""
    between = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, form, cuts and digests of output and restored text of every document."""
    rows = fill_in_middle(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def _draw_sql(k: int) -> str:
    digits = f"sha256('1:' || coalesce(doc_id::varchar, ''))[{8 * k + 1}:{8 * k + 8}]"
    return f"list_sum(list_transform(range(1, 9), lambda i: (instr('0123456789abcdef', {digits}[i]) - 1) * (16 ** (8 - i))::bigint))::bigint"


OP11_SQL = f"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens,
         {_draw_sql(0)} AS h1, {_draw_sql(1)} AS h2, {_draw_sql(2)} AS h3, {_draw_sql(3)} AS h4
  FROM documents
), cut AS (
  SELECT doc_id, text, tokens, len(tokens) AS n, h1 % (len(tokens) + 1) AS c1, h2 % (len(tokens) + 1) AS c2,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {RATE} THEN 'plain'
              WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT doc_id, text, n, form, array_to_string(tokens[1:least(c1, c2)], '') AS prefix,
         array_to_string(tokens[least(c1, c2) + 1:greatest(c1, c2)], '') AS middle, array_to_string(tokens[greatest(c1, c2) + 1:n], '') AS suffix
  FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
