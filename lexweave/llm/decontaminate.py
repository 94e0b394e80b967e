"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters and digits of the lower-cased text.  Documents and
benchmark items are joined on shared ``min_tile``-token seeds; each pair that
meets is tiled: again and again the longest common run of unmarked tokens is
found by running Karp-Rabin matching and marked on both sides, so passages are
caught in any order and no token counts twice.  A document is contaminated
with an item if its tiles cover at least ``coverage`` of the item's tokens.
An item of fewer tokens than a seed is its own seed: it must occur whole.

The benchmark is hashed in blocks of at most ``block_tokens`` tokens (or one
longer item), each small enough to broadcast whatever the benchmark's size;
documents are read once per block and never shuffled, so frequent passages
make no hot partition.  One block is broadcast at a time, and a worker keeps
the block it has hashed last.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexweave.llm.runtime import stored_map, text_of
from lexweave.llm.words import ALPHANUMERIC, WordTable, chunks

MIN_TILE = 5
COVERAGE = 0.5
#: About 100 MB of hashes and positions in each worker.
BLOCK_TOKENS = 2_000_000

_BASE = 0xBF58476D1CE4E5B9


class RollingIndex:
    """Karp-Rabin hashes of a token sequence's windows, of any length.

    They come from prefix sums modulo 2**64 and only propose matches: the
    tokens are compared before a tile is marked.
    """

    def __init__(self, tokens: list[int] | np.ndarray):
        self.tokens = np.asarray(tokens, np.uint64)
        n = len(self.tokens)
        power = np.full(n + 1, _BASE, np.uint64)
        inverse = np.full(n + 1, pow(_BASE, -1, 1 << 64), np.uint64)
        power[0] = inverse[0] = 1
        power, self._inverse = np.cumprod(power), np.cumprod(inverse)
        self._sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.tokens * power[:n], dtype=np.uint64)))
        self.marked = np.zeros(n, bool)

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of the windows without marked tokens."""
        n = len(self.tokens) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        marks = np.concatenate(([0], np.cumsum(self.marked)))
        starts = np.flatnonzero(marks[length:] == marks[:n])
        return starts, (self._sums[starts + length] - self._sums[starts]) * self._inverse[starts]

    def free(self, start: int, length: int) -> bool:
        return not self.marked[start : start + length].any()

    def mark(self, start: int, length: int) -> None:
        self.marked[start : start + length] = True


def _longest(sides: tuple[RollingIndex, RollingIndex], least: int, most: int) -> int:
    """The length of the longest unmarked windows with equal hashes; under
    ``least`` if there are none.  Parts of a common window are common too."""
    low, high = least - 1, most
    while low < high:
        length = (low + high + 1) // 2
        if np.isin(sides[0].windows(length)[1], sides[1].windows(length)[1]).any():
            low = length
        else:
            high = length - 1
    return low


def greedy_tiles(pattern: list[int] | np.ndarray, text: list[int] | np.ndarray, min_tile: int, longest: int) -> list[tuple[int, int, int]]:
    """Greedy tiles ``(at, start, length)`` of at most ``longest`` tokens.

    The longest unmarked match is always marked before any shorter one, of
    equally long ones that with the smallest ``at``, then ``start``.
    """
    sides = RollingIndex(pattern), RollingIndex(text)
    tiles: list[tuple[int, int, int]] = []
    most = min(longest, len(sides[0].tokens), len(sides[1].tokens))
    while most >= min_tile:
        length = _longest(sides, min_tile, most)
        if length < min_tile:
            break
        starts, hashes = sides[1].windows(length)
        order = np.argsort(hashes, kind="stable")
        starts, hashes = starts[order], hashes[order]
        places, values = sides[0].windows(length)
        low, high = np.searchsorted(hashes, values, "left"), np.searchsorted(hashes, values, "right")
        following: dict[int, int] = {}  # of the windows of one hash, the first that may be unmarked
        for k in np.flatnonzero(high > low).tolist():
            at = int(places[k])
            if not sides[0].free(at, length):
                continue
            first = int(low[k])
            j = following.get(first, first)
            while j < high[k] and not sides[1].free(int(starts[j]), length):
                j += 1
            following[first] = j
            for i in range(j, int(high[k])):
                start = int(starts[i])
                if sides[1].free(start, length) and np.array_equal(sides[0].tokens[at : at + length], sides[1].tokens[start : start + length]):
                    tiles.append((at, start, length))
                    sides[0].mark(at, length)
                    sides[1].mark(start, length)
                    break
        most = length - 1
    return tiles


class BenchmarkBlock:
    """Token hashes of some items and sorted tables of their seeds."""

    def __init__(self, rows: list[tuple], min_tile: int):
        self.items = [item for item, _ in rows]
        self.tokens: list[np.ndarray] = []
        found: dict[int, tuple[list, list]] = {}
        for _, _, data, offs in chunks(pa.array([text for _, text in rows], pa.large_string())):
            table = WordTable(data, offs, ALPHANUMERIC)
            base = len(self.tokens)
            self.tokens += [table.hashes[table.bounds[k] : table.bounds[k + 1]] for k in range(len(offs) - 1)]
            sizes = np.diff(table.bounds)
            for size in range(1, min_tile + 1):
                at = table.window_starts(size)
                if size < min_tile:  # items of just so many tokens
                    at = at[sizes[table.rows[at]] == size]
                if len(at):
                    seeds, owners = found.setdefault(size, ([], []))
                    seeds.append(table.span_hashes(at, at + size))
                    owners.append((table.rows[at] + base).astype(np.int32))
        self.min_tile = min_tile
        self._tables = {}
        for size, (seeds, owners) in found.items():
            seeds, owners = np.concatenate(seeds), np.concatenate(owners)
            order = np.argsort(seeds, kind="stable")
            small = np.zeros(1 << 22, bool)  # a seed's low bits, to refuse most windows at once
            small[(seeds & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
            self._tables[size] = seeds[order], owners[order], small

    def pairs(self, data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, tiles, covered tokens, longest tile) of pairs that share a seed."""
        if not self._tables:
            return
        table = WordTable(data, offs, ALPHANUMERIC)
        for size in self._tables:
            start, item = self._meetings(table, size)
            row = table.rows[start]
            edge = np.flatnonzero((row[1:] != row[:-1]) | (item[1:] != item[:-1])) + 1
            opens = np.concatenate(([0], edge, [len(start)])) if len(start) else np.zeros(1, int)
            for a, b in zip(opens[:-1].tolist(), opens[1:].tolist(), strict=True):
                tiled = (1, size, size) if size < self.min_tile else self._tile(table, np.unique(start[a:b]), int(item[a]))
                yield row[a], item[a], *tiled

    def _meetings(self, table: WordTable, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(window's first word, item) of equal seeds, by row, item and place."""
        seeds, owners, small = self._tables[size]
        at = table.window_starts(size)
        hashes = table.span_hashes(at, at + size)
        maybe = np.flatnonzero(small[(hashes & np.uint64((1 << 22) - 1)).astype(np.int64)])
        low = np.searchsorted(seeds, hashes[maybe], "left")
        count = np.searchsorted(seeds, hashes[maybe], "right") - low
        maybe, low, count = maybe[count > 0], low[count > 0], count[count > 0]
        seed = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start, item = at[np.repeat(maybe, count)], owners[seed]
        order = np.lexsort((start, item, table.rows[start]))
        return start[order], item[order]

    def _tile(self, table: WordTable, starts: np.ndarray, item: int) -> tuple[int, int, int]:
        """Tiles of one pair; a tile consists of seeds, so the text is cut down
        to runs of seeds, kept apart by a token that no item has."""
        pattern = self.tokens[item]
        apart = np.uint64(0)
        while (pattern == apart).any():
            apart += np.uint64(1)
        parts, longest = [], 0
        for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
            tokens = table.hashes[run[0] : run[-1] + self.min_tile]
            longest = max(longest, len(tokens))
            parts += [tokens, np.array([apart])]
        tiles = greedy_tiles(pattern, np.concatenate(parts), self.min_tile, min(longest, len(pattern)))
        return len(tiles), sum(size for _, _, size in tiles), max((size for _, _, size in tiles), default=0)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_tokens: int) -> Iterator[list[tuple]]:
    """The benchmark in blocks of about ``block_tokens`` tokens."""
    rows = benchmark.select(F.col(id_col).alias("item"), F.lower(text_of(text_col)).alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-size // (4 * block_tokens)))
    for k in range(count):
        yield [tuple(x) for x in rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k).orderBy("item", "text").collect()]


#: The block that this worker process hashed last.
_hashed: dict[str, BenchmarkBlock] = {}


def _block(key: str, shared, min_tile: int) -> BenchmarkBlock:
    if key not in _hashed:
        _hashed.clear()
        _hashed[key] = BenchmarkBlock(shared.value, min_tile)
    return _hashed[key]


def contaminated_pairs(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_tile: int = MIN_TILE,
    coverage: float = COVERAGE,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """One row per document and benchmark item it contains, as written tables:
    ``(id, item, coverage double, tiles int, covered int, longest int)``.

    * null and empty texts of either side take part in no pair; an item of
      fewer than ``min_tile`` tokens is contained where all of it occurs;
    * repeated documents or items give repeated pairs; null ids are kept;
    * other columns are ignored, whatever their names; an empty table on
      either side gives an empty result; long texts are tiled whole.
    """
    context = docs.sparkSession.sparkContext
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType
    item_type = to_arrow_type(item_kind)
    texts = docs.select(F.col(id_col).alias("id"), F.lower(text_of(text_col)).alias("text"))
    schema = f"id {kind}, item {item_kind.simpleString()}, coverage double, tiles int, covered int, longest int"
    result = None
    for rows in _blocks(benchmark, item_col, item_text_col, block_tokens):
        block, key = context.broadcast(rows), uuid.uuid4().hex

        def run(batches, block=block, key=key):
            index = _block(key, block, min_tile)
            for batch in batches:
                for begin, _, data, offs in chunks(batch.column(1)):
                    found = [(row + begin, item, covered / len(index.tokens[item]), tiles, covered, longest) for row, item, tiles, covered, longest in index.pairs(data, offs) if covered >= coverage * len(index.tokens[item])]
                    if found:
                        columns = list(zip(*found, strict=True))
                        yield pa.record_batch(
                            [batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array([index.items[x] for x in columns[1]], item_type), pa.array(columns[2], pa.float64()), *(pa.array(x, pa.int32()) for x in columns[3:])],
                            names=["id", "item", "coverage", "tiles", "covered", "longest"],
                        )

        part = stored_map(texts, run, schema, "pairs").frame
        block.unpersist()
        result = part if result is None else result.unionByName(part)
    return result


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_tile: int = MIN_TILE, coverage: float = COVERAGE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The rows of ``docs``, all columns, whose own text contains no item, as a
    written table.

    Each row is judged where it is read, so nothing is shuffled or joined, and
    rows that share an id are judged apart.  Null and empty texts stay.
    """
    context = docs.sparkSession.sparkContext
    out = docs
    for rows in _blocks(benchmark, item_col, item_text_col, block_tokens):
        block, key = context.broadcast(rows), uuid.uuid4().hex

        def run(batches, block=block, key=key):
            index = _block(key, block, min_tile)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for begin, _, data, offs in chunks(batch.column(batch.num_columns - 1)):
                    for row, item, _, covered, _ in index.pairs(data, offs):
                        if covered >= coverage * len(index.tokens[item]):
                            clean[row + begin] = False
                yield batch.filter(pa.array(clean)).select(list(range(batch.num_columns - 1)))

        out = stored_map(out.withColumn("lexweave_lowered", F.lower(text_of(text_col))), run, docs.schema, "clean").frame
        block.unpersist()
    return out
