"""Reader of HTML columns: elements of each page as rows of an array, numbered so that "inside" is a comparison.

One Arrow pass over the pages; no shuffle.  Everything after it is column
expressions over the array.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.html_tree import parse
from quillspan.workspace import spread

ELEMENT = "struct<id: int, last: int, depth: int, name: string, attrs: map<string, string>, text: string, joined: string>"


#: Bytes of markup that are trees at once.
GROUP = 1 << 20


def groups(sizes: list[int], most: int = GROUP) -> Iterator[tuple[int, int]]:
    """(start, count) of successive runs of at most ``most`` bytes each, or of one longer page."""
    start = total = 0
    for k, size in enumerate(sizes):
        if k > start and total + size > most:
            yield start, k - start
            start, total = k, 0
        total += size
    if len(sizes) > start:
        yield start, len(sizes) - start


def read_elements(pages: DataFrame, names: tuple[str, ...] = (), hidden: tuple[str, ...] = (), bare: tuple[str, ...] = (), keep: tuple[str, ...] = ("page_id",), html: str = "html", references: str = "all") -> DataFrame:
    """The columns ``keep``, ``runs`` (trimmed pieces of text in page order) and ``elements`` (those of ``names`` and ``bare``).

    ``hidden`` elements are taken out first, with all inside them.  Elements
    ascend by ``id``; those inside one have its ``id < id <= last``.  ``text``
    is the trimmed pieces inside it joined by spaces, ``joined`` the pieces as
    they stand, trimmed as a whole; both are null for ``bare`` names.  Null and
    empty markup has no runs and no elements.  Of character references those are
    decoded that ``references`` names (see ``html_tree.REFERENCES``).
    """
    out_names, wanted, gone = [*keep, "runs", "elements"], frozenset(names) | frozenset(bare), frozenset(hidden)
    texts = frozenset(names)

    def page(markup: str | None) -> tuple[list, list]:
        tree = parse(markup, references)
        out = tree.hidden_by(gone) if gone else None
        runs = [s for at, text, _ in tree.runs if not (out and out[at]) and (s := text.strip())]
        rows = []
        for i in tree.find_all(wanted) if wanted else ():
            if out and out[i]:
                continue
            named = tree.name[i] in texts
            rows.append(
                {
                    "id": i, "last": tree.last[i], "depth": tree.depth[i], "name": tree.name[i], "attrs": list(tree.attrs(i).items()),
                    "text": tree.text(i, " ", out) if named else None, "joined": tree.text(i, "", out, trim=False).strip() if named else None,
                }
            )
        return runs, rows

    def work(batches) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        element = pa.struct([("id", pa.int32()), ("last", pa.int32()), ("depth", pa.int32()), ("name", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("joined", pa.string())])
        for batch in batches:
            # elements are many times their markup: a batch leaves in groups, so memory follows a group or the longest page
            for start, n in groups(pc.binary_length(batch.column(len(keep))).fill_null(0).to_pylist()):
                part = batch.slice(start, n)
                done = [page(x) for x in part.column(len(keep)).to_pylist()]
                arrays = [part.column(k) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([r for r, _ in done], pa.list_(pa.string())), pa.array([e for _, e in done], pa.list_(element))], out_names)

    rows = spread(pages.select(*keep, F.col(html).cast("string").alias("_markup")))
    kinds = dict(pages.select(*keep).dtypes)
    return rows.mapInArrow(work, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + f", runs array<string>, elements array<{ELEMENT}>")


def named(*names: str, within: Column | None = None, elements: str = "elements") -> Column:
    """The elements of these names, inside one element or on the whole page where it is null."""
    found = F.filter(elements, lambda e: e["name"].isin(*names))
    if within is None:
        return found
    return F.filter(found, lambda e: within.isNull() | ((e["id"] > within["id"]) & (e["id"] <= within["last"])))


def first_of(*names: str, elements: str = "elements") -> Column:
    """The first element of the first of these names that the page has; null where it has none of them."""
    return F.coalesce(*(F.try_element_at(named(n, elements=elements), F.lit(1)) for n in names))


def squeezed(c: Column) -> Column:
    """White space, no-break spaces included, as single spaces; trimmed."""
    return F.trim(F.regexp_replace(c, r"[\s\x{A0}]+", " "))
