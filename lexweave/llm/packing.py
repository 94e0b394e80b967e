"""Sequence packing as a cutting-stock problem solved by column generation.

Documents are tokenised once; each is cut into full sequences, half a sequence
where the rest allows it, and a remainder.  The histogram of remainders is packed by a linear program whose columns are
patterns (how many pieces of each length class share a sequence).  Columns are
priced by an unbounded-knapsack dynamic program over the duals, the LP is
rounded down, and what the rounding leaves, a few pieces per class, is packed
by a bounded subset-sum program.  Patterns are then handed out by rank: the
r-th piece of a class takes the r-th slot that the patterns have for it.

Only the histogram (``capacity`` numbers at most) reaches the driver.  Ranks
are partition counts plus a rank within the partition, so a length that a
third of all documents share is not sorted in one task.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm.runtime import Stored, stored_map, text_of, written
from lexweave.llm.words import BLANK_SEPARATED, WordTable, chunks

CAPACITY = 2048
#: Remainders are rounded up to a multiple of this for the linear program.
GRAIN = 8
#: Words of a generation whose ids a worker remembers; it keeps two of them.
CACHE_WORDS = 450_000
#: Texts tokenised at once.
CHUNK_BYTES = 4 << 20


class WordTokenizer:
    """Ids of whole texts from a tokenizer whose words don't cross blanks.

    The tokenizer's pre-tokenizer ends words at white space, so a text's ids
    are those of its blank-separated parts in order.  A chunk's distinct words
    are found by hash, those not met before are tokenised together, and the
    chunk's ids are gathered from theirs.  Words met since the last change of
    generation outlive the next one, so frequent words are learned once.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self._tokenizer.to_str())
        self._pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self._specials = [x["content"] for x in spec["added_tokens"]]
        suffix = spec["model"]["end_of_word_suffix"]
        vocabulary = self._tokenizer.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[k for token, k in vocabulary.items() if token.endswith(suffix)]] = True
        self._limit = cache_words
        self._ids: dict[bytes, bytes] = {}
        self._older: dict[bytes, bytes] = {}

    def _parts(self, word: str) -> int:
        """How many words the pre-tokenizer makes of a blank-separated one."""
        if word.isalpha() and word.isascii():
            return 1
        return len(self._pattern.findall(unicodedata.normalize("NFC", word).lower()))

    def _learn(self, words: list[bytes]) -> None:
        """Tokenises new words in lines; ids that end a word tell whose they are."""
        lines = [words[k : k + 256] for k in range(0, len(words), 256)]
        parts = [[word.decode() for word in line] for line in lines]
        texts = [" ".join(x) for x in parts]
        for line, part, text, found in zip(lines, parts, texts, self._tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            last = np.flatnonzero(self._ends[ids]) + 1
            counts = np.cumsum([0, *map(self._parts, part)])
            if counts[-1] == len(last) and not any(x in text for x in self._specials):
                bounds = np.concatenate(([0], last))[counts]
                for k, word in enumerate(line):
                    self._ids[word] = ids[bounds[k] : bounds[k + 1]].tobytes()
            else:  # special tokens, letters whose case changes their number
                for word, text_part in zip(line, part, strict=True):
                    self._ids[word] = np.array(self._tokenizer.encode(text_part, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows one after the other, bounds of each row)."""
        table = WordTable(data, offs, BLANK_SEPARATED)
        _, at, which = np.unique(table.hashes, return_index=True, return_inverse=True)
        raw = data.tobytes()
        words = [raw[a:b] for a, b in zip(table.starts[at].tolist(), table.ends[at].tolist(), strict=True)]
        if len(self._ids) > self._limit:
            self._ids, self._older = {}, self._ids
        found = list(map(self._ids.get, words))
        new = [word for word, ids in zip(words, found, strict=True) if ids is None]
        if new:
            known = list(map(self._older.get, new))
            self._ids.update((word, ids) for word, ids in zip(new, known, strict=True) if ids is not None)
            new = [word for word, ids in zip(new, known, strict=True) if ids is None]
            if new:
                self._learn(new)
            found = list(map(self._ids.get, words))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        pool = np.frombuffer(b"".join(found), "<u4")
        firsts = np.cumsum(sizes) - sizes
        each = sizes[which]
        ends = np.cumsum(each)
        ids = pool[np.repeat(firsts[which] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate(([0], ends))[table.bounds]


_tokenizers: dict[tuple[str, int], WordTokenizer] = {}


def _tokenizer(path: str, cache_words: int) -> WordTokenizer:
    """One tokenizer, with what it remembers, for each worker process."""
    if (path, cache_words) not in _tokenizers:
        _tokenizers[path, cache_words] = WordTokenizer(path, cache_words)
    return _tokenizers[path, cache_words]


def _cuts(total: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length): full sequences, then half a sequence if the rest is
    longer, then the rest.  Two rests of over half a sequence would share none."""
    start = 0
    for size in (capacity, capacity // 2):
        while total - start >= size and size:
            yield start, size
            start += size
    if start < total:
        yield start, total - start


def _joined(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Batches of about a chunk: the more text, the more often a word repeats."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.nbytes for x in held) >= limit:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 1, cache_words: int = CACHE_WORDS, chunk_bytes: int = CHUNK_BYTES, keep_tokenizer: bool = True) -> Stored:
    """Written ``(id, part, row, start, length, ids_crc32, doc_tokens)``.

    ``part`` and ``row`` number the pieces by the task that wrote them and
    their order there: ranks that are taken from them later don't depend on
    how the table is split when it is read.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        tokenizer, part, done = _tokenizer(tokenizer_path, cache_words), TaskContext.get().partitionId(), 0
        for batch in _joined(batches, chunk_bytes):
            for first, _, data, offs in chunks(batch.column(1), chunk_bytes):
                rows, out = [], ([], [], [], [])
                ids, bounds = tokenizer.encode(data, offs)
                for k in range(len(offs) - 1):
                    own = ids[bounds[k] : bounds[k + 1]]
                    total = len(own) + 1
                    for start, size in _cuts(total, capacity):
                        check = zlib.crc32(own[start : start + size])
                        rows.append(first + k)
                        for column, value in zip(out, (start, size, check if start + size < total else zlib.crc32(end, check), total), strict=True):
                            column.append(value)
                place = [pa.array(np.full(len(rows), part, np.int32)), pa.array(done + np.arange(len(rows)))]
                done += len(rows)
                yield pa.record_batch([batch.column(0).take(pa.array(rows, pa.int64())), *place, *(pa.array(x, pa.int64()) for x in out)], names=["id", "part", "row", "start", "length", "ids_crc32", "doc_tokens"])
        if not keep_tokenizer:
            _tokenizers.clear()

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return stored_map(texts, run, f"id {kind}, part int, row long, start long, length long, ids_crc32 long, doc_tokens long", "pieces")


# --- The cutting-stock solver, on a histogram of length classes ---------------


def _knapsack(values: np.ndarray, capacity: int) -> tuple[float, Counter]:
    """The multiset of classes 1..len(values) of total size <= capacity that
    is worth most."""
    best = np.zeros(capacity + 1)
    choice = np.zeros(capacity + 1, np.int64)
    for total in range(1, capacity + 1):
        m = min(total, len(values))
        offers = values[:m] + best[total - m : total][::-1]
        k = int(offers.argmax())
        best[total] = best[total - 1]
        if offers[k] > best[total] + 1e-12:
            best[total], choice[total] = offers[k], k + 1
    pattern: Counter = Counter()
    total = capacity
    while total > 0:
        taken = int(choice[total])
        if taken:
            pattern[taken] += 1
        total -= taken or 1
    return float(best[capacity]), pattern


def column_generation(demand: dict[int, int], capacity: int, rounds: int = 2000, gap: float = 5e-4) -> list[tuple[Counter, float]]:
    """LP optimum: patterns over ``demand``'s classes and how often each is used.

    Revised simplex with an explicit basis inverse.  It stops when no column
    prices out, when the Farley bound is within ``gap``, or after ``rounds``.
    """
    classes = np.array(sorted(demand))
    row = {int(size): k for k, size in enumerate(classes)}
    need = np.array([demand[size] for size in row], float)
    basis = [Counter({size: capacity // size}) for size in row]
    inverse = np.diag([1 / (capacity // size) for size in row])
    amounts = inverse @ need
    for _ in range(rounds):
        duals = np.maximum(0.0, inverse.sum(axis=0))  # every column costs one sequence
        values = np.zeros(classes[-1])
        values[classes - 1] = duals
        worth, pattern = _knapsack(values, capacity)
        if worth <= 1 + 1e-9 or duals @ need / worth >= amounts.sum() * (1 - gap):
            break
        column = np.zeros(len(classes))
        for size, count in pattern.items():
            column[row[size]] = count
        step = inverse @ column
        usable = step > 1e-9
        if not usable.any():
            break
        ratios = np.full(len(step), np.inf)
        ratios[usable] = amounts[usable] / step[usable]
        out = int(ratios.argmin())
        pivot = inverse[out] / step[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
        amounts = np.maximum(0.0, amounts - ratios[out] * step)
        amounts[out] = ratios[out]
        basis[out] = pattern
    return [(pattern, float(x)) for pattern, x in zip(basis, amounts, strict=True) if x > 1e-9]


def _fill(left: Counter, capacity: int) -> Counter:
    """The fullest pattern from what is left, its largest class first."""
    top = max(left)
    pattern, sizes = Counter({top: 1}), []
    for size in sorted(left, reverse=True):
        for _ in range(min(left[size] - (size == top), (capacity - top) // size)):
            sizes.append(size)
    reach, steps = 1, []
    room = capacity - top
    full = (1 << (room + 1)) - 1
    for size in sizes:
        steps.append(reach)
        reach |= (reach << size) & full
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    for size, before in zip(reversed(sizes[: len(steps)]), reversed(steps), strict=True):
        if not before >> total & 1:
            pattern[size] += 1
            total -= size
    return pattern


def packing_plan(demand: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """Patterns with whole numbers of uses that cover ``demand`` exactly."""
    left = Counter({size: n for size, n in demand.items() if n > 0})
    plan: list[tuple[Counter, int]] = []
    if not left:
        return plan
    for pattern, amount in sorted(column_generation(dict(left), capacity), key=lambda x: -x[1]):
        use = min(int(amount), *(left[size] // count for size, count in pattern.items()))
        if use > 0:
            plan.append((pattern, use))
            for size, count in pattern.items():
                left[size] -= use * count
    left = +left
    while left:
        pattern = _fill(left, capacity)
        use = max(1, min(left[size] // count for size, count in pattern.items()))
        plan.append((pattern, use))
        left.subtract(Counter({size: use * count for size, count in pattern.items()}))
        left = +left
    return plan


def _ranked(rows: DataFrame, key: str) -> DataFrame:
    """Adds ``rank`` from 0 within ``key``: the counts of the parts before plus
    the place in the own part."""
    inside = Window.partitionBy("part", key).orderBy("row")
    counts = rows.groupBy(key, "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select(F.col(key), "part", F.coalesce("before", F.lit(0)).alias("before"))
    return rows.withColumn("inside", F.row_number().over(inside) - 1).join(before, [key, "part"]).withColumn("rank", F.col("before") + F.col("inside")).drop("before", "inside")


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 1, grain: int = GRAIN, cache_words: int = CACHE_WORDS, chunk_bytes: int = CHUNK_BYTES, keep_tokenizer: bool = True) -> DataFrame:
    """One row per piece: ``(id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset)``, all long but the id.

    Sequences hold at most ``capacity`` ids without gaps.  A document is
    cut at multiples of half of it only.  ``cache_words`` and ``chunk_bytes``
    trade a worker's memory for time, as does keeping its tokenizer for the
    next task; results don't depend on them.

    * null and empty texts have the end id alone; very long texts are cut like
      any other; rows that repeat an id are packed like different documents;
    * a null id is kept; other columns are ignored, whatever their names;
    * an empty table gives an empty result.
    """
    parts = pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id, cache_words, chunk_bytes, keep_tokenizer).frame
    spark = docs.sparkSession
    size = F.ceil(F.col("length") / F.lit(grain)).cast("int")
    parts = parts.withColumn("class", F.when(F.col("length") < capacity, size).otherwise(F.lit(0)))
    histogram = {r[0]: r[1] for r in parts.groupBy("class").count().collect()}  # capacity / grain rows at most
    full = histogram.pop(0, 0)
    rows, sequence = [], full
    if full:
        rows.append((0, 0, full, 0, 1))
    taken: Counter = Counter()
    for pattern, use in packing_plan(histogram, capacity // grain):
        for length_class, count in sorted(pattern.items(), reverse=True):
            rows.append((length_class, taken[length_class], taken[length_class] + use * count, sequence, count))
            taken[length_class] += use * count
        sequence += use
    slots = spark.createDataFrame(rows, "class int, low long, high long, base long, each int")
    # Slots are a few per pattern, so at most a few thousand rows whatever the corpus.
    ranked = _ranked(parts, "class")
    lists = slots.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("low", "high", "base", "each"))).alias("slots"))
    placed = ranked.join(F.broadcast(lists), "class").withColumn("slot", F.expr("filter(slots, s -> s.low <= rank and rank < s.high)[0]"))
    placed = placed.withColumn("sequence_id", (F.col("slot.base") + F.floor((F.col("rank") - F.col("slot.low")) / F.col("slot.each"))).cast("long"))
    placed = written(placed.select("id", "part", "row", "start", "length", "ids_crc32", "doc_tokens", "sequence_id"), "placed")
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "part", "row").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long").alias("offset"))
