"""Near duplicates by SimHash fingerprints, joined in the space of segment bit counts.

A fingerprint of 64 bits is cut into 32 segments of two bits; the counts of set bits per segment are a point whose
Manhattan distance to another point is a lower bound of the Hamming distance of the fingerprints. (Counts are kept in
unary, 0 = 00, 1 = 01, 2 = 11, so that the Manhattan distance of two points is the number of differing bits.)

Range join: the 32 coordinates form ``2 * distance`` blocks. Points within the distance differ in at most ``distance``
blocks, hence share a cell in at least one of the grids laid over ``distance`` blocks (70 grids over 4 of 8 blocks).
Points of a cell are tested by Manhattan distance first, then exactly by Hamming distance. So no link is lost.

Scale: equal fingerprints are one point. Cells are sorted runs in a partition and are compared by shifting whole arrays;
each task hands on a spanning forest of what it finds, not all pairs. A cell with more than ``CELL`` points is put
aside and split into block pairs, so that no task ever holds or compares a whole hot cell. Fingerprints, links and
labels stay in tables.

Null and empty texts have fingerprint zero and are linked like any other. Null ids take part; a component's id is the
smallest id that is not null. Rows that repeat an id count as that document.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.llm.columns import narrowed
from textwarden.llm.components import connected, local_forest
from textwarden.sources.scratch import materialise

SEED = 42
SEGMENTS = 32
LOW_BITS = 0x5555555555555555
CELL = 4096
# Links found before a task folds them into a forest.
LINKS = 1 << 18


def fingerprint(text: str, words: int = 4) -> int:
    """Bits set in more than half of the hashes of the text's word shingles, as an unsigned number."""
    tokens = text.encode().lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
        starts = [0, *(ends[:-words] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = np.array(hashes[at : at + 65_536], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` of every document; ``fp`` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in batch["text"].to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found)], names=["doc_id", "fp"])

    return narrowed(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def unary_counts(fp: Column) -> Column:
    """The 32 counts of two bits each, in unary."""
    upper = F.shiftrightunsigned(fp, 1)
    both, any_ = fp.bitwiseAND(upper).bitwiseAND(LOW_BITS), fp.bitwiseOR(upper).bitwiseAND(LOW_BITS)
    return F.shiftleft(both, 1).bitwiseOR(any_)


def unary_counts_of(fp: np.ndarray) -> np.ndarray:
    low = np.uint64(LOW_BITS)
    upper = fp >> np.uint64(1)
    return ((fp & upper & low) << np.uint64(1)) | ((fp | upper) & low)


def grid_masks(distance: int) -> list[int]:
    """For every choice of ``distance`` of ``2 * distance`` blocks, the bits of their coordinates, as signed longs."""
    if not distance:
        return [-1]
    blocks = 2 * distance
    edges = [2 * (SEGMENTS * b // blocks) for b in range(blocks + 1)]
    bits = [((1 << edges[b + 1]) - 1) ^ ((1 << edges[b]) - 1) for b in range(blocks)]
    masks = [sum(chosen) for chosen in combinations(bits, distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Which pairs are within the distance: the bound first, then the fingerprints themselves."""
    kept = np.flatnonzero(np.bitwise_count(unary_counts_of(a) ^ unary_counts_of(b)) <= distance)
    return kept[np.bitwise_count(a[kept] ^ b[kept]) <= distance]


def _links(a: np.ndarray, b: np.ndarray, aside: bool = False) -> pa.RecordBatch:
    columns = [pa.array(x.view(np.int64)) for x in (a, b)]
    return pa.RecordBatch.from_arrays([*columns, pa.array([aside] * len(a), pa.bool_())], names=["a", "b", "aside"])


class _Forest:
    """Links found so far, folded into a forest when there are many."""

    def __init__(self) -> None:
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []
        self.count = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.a.append(a)
            self.b.append(b)
            self.count += len(a)
        if self.count >= LINKS:
            self.fold()

    def fold(self) -> pa.RecordBatch | None:
        if not self.a:
            return None
        a, b = local_forest(np.concatenate(self.a), np.concatenate(self.b))
        self.a, self.b, self.count = [a], [b], 0
        # A forest that is itself that large goes out.
        return _links(a, b)

    def flushed(self) -> Iterator[pa.RecordBatch]:
        if (batch := self.fold()) is not None:
            self.a, self.b, self.count = [], [], 0
            yield batch


def _compare_runs(run: np.ndarray, fp: np.ndarray, distance: int, forest: _Forest) -> None:
    """All pairs within runs of equal ``run`` values: the array against itself, shifted further and further."""
    starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    sizes = np.diff(np.append(starts, len(run)))
    # Rows left in the run after each row.
    left = np.repeat(starts + sizes, sizes) - np.arange(len(run)) - 1
    rows = np.flatnonzero(left > 0)
    shift = 1
    while len(rows):
        a, b = fp[rows], fp[rows + shift]
        near = _near(a, b, distance)
        forest.add(a[near], b[near])
        shift += 1
        rows = rows[left[rows] >= shift]


def _cells(batches: Iterator[pa.RecordBatch], distance: int, most: int) -> Iterator[pa.RecordBatch]:
    """Links within cells that come as sorted runs; rows of cells over ``most`` points are set aside."""
    forest = _Forest()
    cell, fp, hot = np.empty(0, np.int64), np.empty(0, np.uint64), None
    for batch in batches:
        cell = np.concatenate([cell, batch["cell"].to_numpy()])
        fp = np.concatenate([fp, batch["fp"].to_numpy().view(np.uint64)])
        if not len(cell):
            continue
        # The last run may go on in the next batch.
        end = np.searchsorted(cell, cell[-1])
        if hot is not None and (n := np.searchsorted(cell, hot, "right")):
            yield _links(cell[:n].view(np.uint64), fp[:n], True)
            cell, fp, end = cell[n:], fp[n:], max(end - n, 0)
        yield from _ready(cell[:end], fp[:end], distance, most, forest)
        cell, fp = cell[end:], fp[end:]
        if len(cell) > most:
            hot = cell[0]
            yield _links(cell.view(np.uint64), fp, True)
            cell, fp = cell[:0], fp[:0]
        if forest.count >= LINKS // 2:
            yield from forest.flushed()
    yield from _ready(cell, fp, distance, most, forest)
    yield from forest.flushed()


def _ready(
    cell: np.ndarray, fp: np.ndarray, distance: int, most: int, forest: _Forest
) -> Iterator[pa.RecordBatch]:
    if not len(cell):
        return
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    sizes = np.diff(np.append(starts, len(cell)))
    large = np.repeat(sizes > most, sizes)
    if large.any():
        yield _links(cell[large].view(np.uint64), fp[large], True)
        cell, fp = cell[~large], fp[~large]
    if len(cell):
        _compare_runs(cell, fp, distance, forest)


def _pairs(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Links of one or more block pairs of hot cells, which come sorted by pair and side."""
    forest = _Forest()

    def compare(rows: list[tuple[np.ndarray, np.ndarray]]) -> None:
        side, fp = (np.concatenate(c) for c in zip(*rows, strict=True))
        own, other = fp[side == 0], fp[side == 1]
        if not len(other):  # a block with itself
            other = own
        for x in own:
            near = _near(np.full(len(other), x), other, distance)
            forest.add(np.full(len(near), x), other[near])

    held, current = [], None
    for batch in batches:
        pair = batch["pair"].to_numpy()
        side, fp = batch["side"].to_numpy(), batch["fp"].to_numpy().view(np.uint64)
        cuts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else []
        for a, b in zip(cuts, [*cuts[1:], len(pair)], strict=True):
            if pair[a] != current and held:
                compare(held)
                held = []
                if forest.count >= LINKS // 2:
                    yield from forest.flushed()
            current = pair[a]
            held.append((side[a:b], fp[a:b]))
    if held:
        compare(held)
    yield from forest.flushed()


LINK_SCHEMA = "a long, b long, aside boolean"


def near_links(points: DataFrame, distance: int = 4, cell_points: int = CELL) -> DataFrame:
    """``a, b``: links that connect the distinct fingerprints ``fp`` just as all pairs within the distance do."""
    grids = F.array(*[F.lit(m).cast("long") for m in grid_masks(distance)])
    # A cell goes by the hash of its grid and coordinates; two cells under one hash only mean more tests.
    cells = (
        points.select("fp", unary_counts(F.col("fp")).alias("counts"), F.explode(grids).alias("mask"))
        .select("fp", F.xxhash64("mask", F.col("counts").bitwiseAND(F.col("mask"))).alias("cell"))
        .repartition("cell")
        .sortWithinPartitions("cell")
    )
    found = materialise(cells.mapInArrow(lambda b: _cells(b, distance, cell_points), LINK_SCHEMA), "grid-links")
    links = found.where(~F.col("aside")).select("a", "b")
    aside = found.where("aside").select(F.col("a").alias("cell"), F.col("b").alias("fp"))
    if aside.isEmpty():
        return links
    blocks = aside.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(cell_points)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")).cast("int")
    paired = (
        aside.join(blocks, "cell")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("pair"),
            F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"),
            "fp",
        )
    )
    compared = paired.repartition("pair").sortWithinPartitions("pair").mapInArrow(
        lambda b: _pairs(b, distance), LINK_SCHEMA
    )
    return links.union(compared.select("a", "b"))


def components(marked: DataFrame, distance: int = 4) -> DataFrame:
    """``fp, component_id`` of every distinct fingerprint of a table ``doc_id, fp``."""
    points = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-points")
    roots = connected(near_links(points.select("fp"), distance))
    rooted = points.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id")


def near_duplicates(
    docs: DataFrame, distance: int = 4, words: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id, fingerprint`` (16 hex digits) ``, component_id``."""
    marked = materialise(fingerprints(docs, words, id_col, text_col), "simhash")
    found = components(marked, distance)
    return marked.join(found, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
