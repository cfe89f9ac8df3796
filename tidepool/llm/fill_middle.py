"""Fill-in-the-middle with ropes.

A text becomes a balanced tree whose leaves are pieces of it, cut between two units, of LEAF characters or little more. Each node caches how many units and how
many code points lie below it. Splitting at a unit rank walks down one path; inside the one leaf that it ends in, and nowhere else, units are looked
for. The transformation splits twice, and joins the three trees in another order with sentinels between; the way back splits the output's
tree at the sentinels and joins the parts in their old order. No step copies text but the last, which writes the leaves out.

A unit is white space and the word after it, or white space at the end of the text ([ \\t-\\r]*[^ \\t-\\r]+|[ \\t-\\r]+). A document's cuts and form come from
a hash of the seed and its doc_id, so reruns agree. Texts that are empty or hold a sentinel stay plain, so the way back is never in doubt.

Cases. Null text: empty. Null doc_id: its hash is that of the seed and a colon alone. Repeated rows are formatted each for itself, alike if their ids are. Other columns
are ignored, whatever their names. An empty table gives no rows. Texts of any length are taken whole; a word without end is one leaf.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from tidepool.llm.common import documents_of

SPACE = " \t-\r"
_WORD = re.compile(f"[^{SPACE}]+")
_EDGE = re.compile(f"[^{SPACE}](?=[{SPACE}])")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Characters a leaf has at least, if the text goes on.
LEAF = 2048
SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80


@dataclass(frozen=True)
class Rope:
    """A leaf has a text, any other node two parts. units, points: how many lie below."""

    units: int
    points: int
    depth: int = 0
    text: str = ""
    left: "Rope | None" = None
    right: "Rope | None" = None


EMPTY = Rope(0, 0)


def leaf(text: str) -> Rope:
    """White space at the end is a unit of its own: only the last leaf of a text may end so."""
    if not text:
        return EMPTY
    return Rope(len(_WORD.findall(text)) + (text[-1] in " \t\n\v\f\r"), len(text), 0, text)


def join(a: Rope, b: Rope) -> Rope:
    if not a.points or not b.points:
        return a if a.points else b
    return Rope(a.units + b.units, a.points + b.points, 1 + max(a.depth, b.depth), "", a, b)


def joined(parts: list[Rope]) -> Rope:
    """A balanced tree over parts, in order."""
    while len(parts) > 1:
        parts = [join(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0] if parts else EMPTY


def rope(text: str) -> Rope:
    parts, at = [], 0
    while at < len(text):
        edge = _EDGE.search(text, at + LEAF - 1) if at + LEAF <= len(text) else None
        end = edge.end() if edge else len(text)
        parts.append(leaf(text[at:end]))
        at = end
    return joined(parts)


def unit_end(text: str, rank: int) -> int:
    """Code points of the first rank units of a leaf."""
    for k, word in enumerate(_WORD.finditer(text), 1):
        if k == rank:
            return word.end()
    return len(text)


def split(tree: Rope, rank: int, by: str = "units") -> tuple[Rope, Rope]:
    """The first rank units (or code points, by="points") and the rest. Walks down one path; both trees stay as deep as the path at most."""
    lefts, rights = [], []
    while True:
        if rank <= 0 or rank >= getattr(tree, by):
            (rights if rank <= 0 else lefts).append(tree)
            break
        if tree.left is None:
            at = unit_end(tree.text, rank) if by == "units" else rank
            lefts.append(leaf(tree.text[:at]))
            rights.append(leaf(tree.text[at:]))
            break
        below = getattr(tree.left, by)
        if rank < below:
            rights.append(tree.right)
            tree = tree.left
        else:
            lefts.append(tree.left)
            tree, rank = tree.right, rank - below
    left, right = EMPTY, EMPTY
    for part in reversed(lefts):
        left = join(part, left)
    for part in reversed(rights):
        right = join(right, part)
    return left, right


def leaves(tree: Rope) -> Iterator[str]:
    todo = [tree]
    while todo:
        node = todo.pop()
        if node.left is None:
            yield node.text
        else:
            todo += [node.right, node.left]


def written(tree: Rope) -> str:
    return "".join(leaves(tree))


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


@dataclass
class Formatted:
    n: int
    form: str
    output: str
    prefix_chars: int | None = None
    middle_chars: int | None = None


def transform(text: str, doc_id: int | None, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> Formatted:
    whole = rope(text)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= fim_percent:
        return Formatted(whole.units, "plain", text)
    first, second = sorted((h1 % (whole.units + 1), h2 % (whole.units + 1)))
    before, suffix = split(whole, second)
    prefix, middle = split(before, first)
    p, s, m = ((leaf(x), part) for x, part in ((PREFIX, prefix), (SUFFIX, suffix), (MIDDLE, middle)))
    form = "spm" if h4 % 100 < spm_percent else "psm"
    order = (s, p, m) if form == "spm" else (p, s, m)
    out = joined([tree for pair in order for tree in pair])
    return Formatted(whole.units, form, written(out), prefix.points, middle.points)


def restore(output: str, form: str) -> str:
    """The text that transform() had: the output's tree is split at the sentinels. No text with a sentinel is ever rearranged, so each occurs once."""
    if form == "plain":
        return output
    rest, parts, gone, own = rope(output), {}, 0, None
    for at, mark in sorted((output.index(x), x) for x in (PREFIX, SUFFIX, MIDDLE)):
        parts[own], rest = split(rest, at - gone, "points")
        rest, own, gone = split(rest, len(mark), "points")[1], mark, at + len(mark)
    parts[own] = rest
    return written(joined([parts[PREFIX], parts[MIDDLE], parts[SUFFIX]]))


FORMATTED = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
READ = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def format_documents(df: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (null if plain), output: the training text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            done = [transform(text, doc, seed, fim_percent, spm_percent) for doc, text in zip(ids, b.column(1).to_pylist(), strict=True)]
            columns = [(ids, pa.int64()), ([x.n for x in done], pa.int64()), ([x.form for x in done], pa.string()), ([x.prefix_chars for x in done], pa.int64()), ([x.middle_chars for x in done], pa.int64()), ([x.output for x in done], pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns], [x.split()[0] for x in FORMATTED.split(", ")])

    return documents_of(df).mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each output and of the text rebuilt from output and form alone."""

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            outputs, forms = b.column(5).to_pylist(), b.column(2).to_pylist()
            digests = [pa.array([sha(x) for x in outputs], pa.string()), pa.array([sha(restore(x, f)) for x, f in zip(outputs, forms, strict=True)], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *digests], [x.split()[0] for x in READ.split(", ")])

    return formatted.mapInArrow(run, READ)
