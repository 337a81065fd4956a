"""Fill-in-the-middle transformation of texts on ropes.

A text is a rope: a balanced tree whose leaves hold ``LEAF`` characters or so
and whose nodes know how many units and code points stand below them.  Two
splits at unit ranks give prefix, middle and suffix; these subtrees and the
sentinels are concatenated in another order, without copying a leaf.  The
inverse finds the sentinels in the output's leaves, splits the output's tree
there and puts the parts back in order.

Units are code points (``unit="char"``) or words with the white space after
them (``unit="word"``).  The cuts of a document follow from a hash of a seed
and its doc_id, so a rerun, or a lost executor, gives the same ones.

Forms: ``plain`` leaves the text as it is, ``psm`` is prefix, suffix, middle,
``spm`` is suffix, prefix, middle.  A text that is empty, or that has a
sentinel in it, is plain, and so is a share of all texts.

Defined results: a null text is an empty one, so plain (``transform_documents``
leaves it null); a null doc_id is drawn
as the empty string is; texts of any length are read whole; equal rows get
equal cuts; an empty table gives an empty result; other columns pass through
``transform_documents``, whatever their names, and ``n_chars`` follows the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, tidy, with_new_text

#: Sentinels before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Per cent of documents that are not plain by lot, and of those the ones that are spm.
CHANGED, SPM = 90, 20
LEAF = 2048
_UNIT = {"char": None, "word": re.compile(r"\s*\S+\s*|\s+")}


class Rope:
    """A leaf (``text``) or a pair of ropes, with the units and code points below."""

    __slots__ = ("chars", "depth", "left", "right", "text", "units")

    def __init__(self, text: str = "", units: int = 0, left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        if left is None:
            self.units, self.chars, self.depth = units, len(text), 0
        else:
            self.units, self.chars, self.depth = left.units + right.units, left.chars + right.chars, 1 + max(left.depth, right.depth)

    def leaves(self) -> Iterator[str]:
        stack = [self]
        while stack:
            node = stack.pop()
            if node.left is None:
                yield node.text
            else:
                stack += [node.right, node.left]

    def __str__(self) -> str:
        return "".join(self.leaves())


EMPTY = Rope()


def unit_ends(text: str, unit: str) -> list[int]:
    """Where the units of a text end, for units that are no code points."""
    return [m.end() for m in _UNIT[unit].finditer(text)]


def build(text: str, unit: str = "char", leaf: int = LEAF) -> Rope:
    """A balanced rope; leaves end where a unit does."""
    if unit == "char":
        level = [Rope(text[k : k + leaf], min(leaf, len(text) - k)) for k in range(0, len(text), leaf)]
    else:
        level, begin, units = [], 0, 0
        for end in unit_ends(text, unit):
            units += 1
            if end - begin >= leaf:
                level.append(Rope(text[begin:end], units))
                begin, units = end, 0
        if begin < len(text):
            level.append(Rope(text[begin:], units))
    while len(level) > 1:
        level = [Rope(left=level[k], right=level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0] if level else EMPTY


def concat(a: Rope, b: Rope) -> Rope:
    """One rope of two, whose depths stay within one of each other where they meet."""
    if not a.chars:
        return b
    if not b.chars:
        return a
    if a.depth > b.depth + 1:
        right = concat(a.right, b)
        if right.depth > a.left.depth + 1:  # lift its left part, so that the depth grows by one at most
            return Rope(left=Rope(left=a.left, right=right.left), right=right.right)
        return Rope(left=a.left, right=right)
    if b.depth > a.depth + 1:
        left = concat(a, b.left)
        if left.depth > b.right.depth + 1:
            return Rope(left=left.left, right=Rope(left=left.right, right=b.right))
        return Rope(left=left, right=b.right)
    return Rope(left=a, right=b)


def split(rope: Rope, at: int, unit: str = "char") -> tuple[Rope, Rope]:
    """The first ``at`` units and the rest, by way of the counts on one path."""
    if at <= 0:
        return EMPTY, rope
    if at >= rope.units:
        return rope, EMPTY
    if rope.left is None:
        place = at if unit == "char" else unit_ends(rope.text, unit)[at - 1]
        return Rope(rope.text[:place], at), Rope(rope.text[place:], rope.units - at)
    if at < rope.left.units:
        a, b = split(rope.left, at, unit)
        return a, concat(b, rope.right)
    a, b = split(rope.right, at - rope.left.units, unit)
    return concat(rope.left, a), b


def find(rope: Rope, what: str, start: int = 0) -> int:
    """Code points before the first ``what`` at or after ``start``, or -1; a hit may lie across leaves."""
    keep, before, seen = len(what) - 1, "", 0
    for text in rope.leaves():
        joined = before + text
        base = seen - len(before)
        if base + len(joined) > start:
            k = joined.find(what, max(0, start - base))
            if k >= 0:
                return base + k
        seen += len(text)
        before = joined[-keep:] if keep else ""
    return -1


def rearrange(text: str, form: str, first: int, second: int, unit: str = "char", sentinels: tuple[str, str, str] = SENTINELS) -> tuple[Rope, int, int]:
    """The output's rope, and the code points of prefix and middle; ``first`` and ``second`` are units, in order."""
    whole = build(text, unit)
    if form == "plain":
        return whole, 0, 0
    head, suffix = split(whole, second, unit)
    prefix, middle = split(head, first, unit)
    marks = {k: Rope(s, 1) for k, s in zip("PSM", sentinels, strict=True)}
    parts = [marks["P"], prefix, marks["S"], suffix] if form == "psm" else [marks["S"], suffix, marks["P"], prefix]
    out = EMPTY
    for part in [*parts, marks["M"], middle]:
        out = concat(out, part)
    return out, prefix.chars, middle.chars


def restore(output: str, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> Rope:
    """The text from an output: its rope is split at the sentinels and the parts change places."""
    rope = build(output)
    if form == "plain":
        return rope
    p, s, m = sentinels
    one, two = (p, s) if form == "psm" else (s, p)
    at_two = find(rope, two, len(one))
    at_m = find(rope, m, at_two + len(two))
    if not output.startswith(one) or at_two < 0 or at_m < 0:
        raise ValueError(f"no {form} output: a sentinel is missing")
    rest, tail = split(rope, at_m)
    middle = split(tail, len(m))[1]
    head, second = split(rest, at_two)
    first, second = split(head, len(one))[1], split(second, len(two))[1]
    prefix, suffix = (first, second) if form == "psm" else (second, first)
    return concat(concat(prefix, middle), suffix)


def draws(doc_id: Column, seed: int = 1) -> Column:
    """Array of four unsigned 32-bit numbers from the SHA-256 of seed and doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])


def form_of(text: Column, h: Column, changed: int = CHANGED, spm: int = SPM, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    marked = F.lit(False)
    for s in sentinels:
        marked = marked | F.contains(text, F.lit(s))
    return F.when((text == "") | marked | (h[2] % 100 >= changed), "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")


def rearranger(unit: str = "char", sentinels: tuple[str, str, str] = SENTINELS):
    """A column function of text, form and draws: struct of output, n (units), prefix_chars and middle_chars."""

    @F.arrow_udf("struct<output:string,n:bigint,prefix_chars:bigint,middle_chars:bigint>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        try:
            for texts, forms, numbers in batches:
                columns: tuple[list, ...] = ([], [], [], [])
                for text, form, h in zip(texts.to_pylist(), forms.to_pylist(), numbers.to_pylist(), strict=True):
                    n = len(text) if unit == "char" else len(unit_ends(text, unit))
                    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
                    rope, prefix, middle = rearrange(text, form, a, b, unit, sentinels)
                    for c, v in zip(columns, (str(rope), n, prefix, middle), strict=True):
                        c.append(v)
                plain = pa.array([f == "plain" for f in forms.to_pylist()], pa.bool_()).to_numpy(zero_copy_only=False)
                lengths = [pa.array(c, pa.int64()) if k == 1 else pa.array(c, pa.int64(), mask=plain) for k, c in enumerate(columns[1:], 1)]
                yield pa.StructArray.from_arrays([pa.array(columns[0], pa.string()), *lengths], ["output", "n", "prefix_chars", "middle_chars"])
        finally:
            tidy()

    return run


def restorer(sentinels: tuple[str, str, str] = SENTINELS):
    """A column function of output and form: the text."""

    @F.arrow_udf("string")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        try:
            for outputs, forms in batches:
                yield pa.array([str(restore(o, f, sentinels)) for o, f in zip(outputs.to_pylist(), forms.to_pylist(), strict=True)], pa.string())
        finally:
            tidy()

    return run


def infill(docs: DataFrame, seed: int = 1, unit: str = "char", changed: int = CHANGED, spm: int = SPM, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """Columns row (all of the document), form, output, n, prefix_chars and middle_chars (null if plain)."""
    lean(docs.sparkSession)
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    known = rows.select("row", F.coalesce("row.text", F.lit("")).alias("t"), draws(F.col("row.doc_id"), seed).alias("h"))
    known = known.withColumn("form", form_of(F.col("t"), F.col("h"), changed, spm, sentinels))
    return known.withColumn("o", rearranger(unit, sentinels)("t", "form", "h")).select("row", "form", "o.*")


def transform_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents with rearranged texts; all other columns as they are."""
    got = infill(docs, **options)
    plain = F.col("form") == "plain"
    return got.select(*with_new_text(docs, "row", F.when(plain, F.col("row.text")).otherwise(F.col("output")), plain))


def infill_report(docs: DataFrame) -> DataFrame:
    """Columns doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    got = infill(docs.select("doc_id", "text"))
    got = got.withColumn("restored", restorer()("output", "form"))
    return got.select(F.col("row.doc_id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
