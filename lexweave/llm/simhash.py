"""SimHash near-duplicate detection with deletion-variant signatures.

A 64-bit fingerprint is cut into so few segments (``max_bits // 2 + 1``) that
two fingerprints at most ``max_bits`` apart agree in some segment but for one
bit at most.  Each segment is indexed under all its one-wildcard variants;
fingerprints that share a variant meet in one sorted run, where they are
verified by exact Hamming distance.

Distinct fingerprints are indexed, so that a group of copies counts once.  A
run of up to ``run_limit`` fingerprints is linked by breadth-first search,
which reports a spanning forest and never all pairs.  Fingerprints of longer
runs are linked exactly through their full ``max_bits``-wildcard variants:
all that share one are within the distance, so a star to the smallest keeps
the components with as many rows as variants.

With several signatures, all of them share one index: a signature's number is
part of the variant's slot.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.components import connected_components
from lexweave.llm.runtime import arrow_map, small, stored, stored_map, text_of, written
from lexweave.llm.words import mix

BITS = 64
#: Shingles whose bits are summed at once.
_BLOCK = 1 << 15
#: Text of a group of candidates that one task compares.
PART_BYTES = 8 << 20
#: Distance of the hashes of one shingle under consecutive signatures, before mixing.
_SALT = 0xA24BAED4963EE407


def _shingles(text: bytes, size: int) -> np.ndarray:
    """XXH64, seed 42, of each shingle; a text of fewer words is one shingle."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, n) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    size = min(size, n)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts[: n - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)), np.uint64, n - size + 1)


def _fingerprint(text: bytes, size: int, signatures: int = 1) -> list[int]:
    """One fingerprint per signature: the first over the shingles' hashes
    themselves, the others over independent mixtures of them."""
    hashes = _shingles(text, size)
    if not len(hashes):
        return [0] * signatures
    found = []
    for number in range(signatures):
        ones = np.zeros(BITS, np.int64)
        for k in range(0, len(hashes), _BLOCK):
            block = hashes[k : k + _BLOCK]
            block = mix(block + np.uint64(number * _SALT & (1 << 64) - 1)) if number else block
            bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
        found.append(int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]))
    return found


def _fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, signatures: int) -> tuple:
    """Frame, function and schema of :func:`fingerprints`."""
    names = ["fingerprint", *(f"fingerprint_{k}" for k in range(1, signatures))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = np.array([_fingerprint(x.as_py(), shingle, signatures) for x in texts], np.uint64).reshape(-1, signatures)
            yield pa.record_batch([batch.column(0), *(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in found.T)], names=["id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")), run, f"id {kind}, " + ", ".join(f"{x} long" for x in names)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, signatures: int = 1) -> DataFrame:
    """(id, fingerprint long): bit majority of the shingles' XXH64, seed 42.

    Words are runs of bytes other than blanks, A-Z lower-cased; a text of
    fewer words than a shingle is one shingle; one without words has 0.
    Further signatures, if any, follow as ``fingerprint_1`` and so on.
    """
    return arrow_map(*_fingerprints(docs, id_col, text_col, shingle, signatures))


def _segments(max_bits: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment."""
    parts = max_bits // 2 + 1
    cuts = [BITS * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _runs(values: DataFrame, max_bits: int) -> DataFrame:
    """(slot, rest, value): every one-wildcard variant of each segment, sorted
    so that equal ones meet.  The shuffle carries slot and value alone; they
    give the rest, the segment's bits but the wildcard, where it is needed."""
    masks = []
    for low, width in _segments(max_bits):
        for bit in range(low, low + width):
            mask = (((1 << width) - 1) << low) & ~(1 << bit)
            masks.append(mask - ((mask >> 63) << 64))
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = F.col("value").bitwiseAND(F.element_at(F.array(*map(F.lit, masks)), F.pmod("slot", F.lit(BITS)) + 1))
    first = F.col("signature") * BITS
    each = values.select(F.explode(F.sequence(first, first + (BITS - 1))).alias("slot"), "value")
    return each.repartition(parts, F.col("slot"), rest).select("slot", rest.alias("rest"), "value").sortWithinPartitions("slot", "rest", "value")


class _Linker:
    """Verified links inside one run of fingerprints that share a variant."""

    def __init__(self, max_bits: int):
        self.max_bits = max_bits
        self.masks = [np.uint64(((1 << width) - 1) << low) for low, width in _segments(max_bits)]
        self.segment = {low + bit: k for k, (low, width) in enumerate(_segments(max_bits)) for bit in range(width)}
        self.lowest = {low for low, _ in _segments(max_bits)}

    def near(self, x: np.ndarray, slot: int) -> np.ndarray:
        """Whether pairs with difference x are linked by this slot's runs.

        Each pair belongs to one slot: the first segment with one differing
        bit at most, there that bit, or the lowest if none differs.
        """
        slot %= BITS
        k = self.segment[slot]
        found = np.bitwise_count(x) <= self.max_bits
        if slot not in self.lowest:
            found &= (x & self.masks[k]) != 0
        for mask in self.masks[:k]:
            found &= np.bitwise_count(x & mask) > 1
        return found

    def forest(self, prints: np.ndarray, slot: int) -> tuple[list[int], list[int]]:
        """Breadth-first trees over the run's links."""
        rest, left, right = prints, [], []
        while len(rest):
            frontier, rest = [rest[0]], rest[1:]
            while frontier and len(rest):
                node = frontier.pop()
                linked = self.near(rest ^ node, slot)
                if linked.any():
                    found = rest[linked]
                    left += [int(node)] * len(found)
                    right += found.tolist()
                    frontier += list(found)
                    rest = rest[~linked]
        return left, right


def _scan_runs(max_bits: int, run_limit: int):
    """Links within the runs of equal (slot, rest) of sorted partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linker = _Linker(max_bits)
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        overflow = False  # the run that is open has passed the limit

        def emit(slots, left, right):
            a, b = np.asarray(left, np.uint64), np.asarray(right, np.uint64)
            signature = (np.asarray(slots, np.int64) // BITS).astype(np.int32)
            return pa.record_batch([pa.array(signature), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["signature", "a", "b"])

        def closed(slot, rest, prints):
            edge = np.flatnonzero((slot[1:] != slot[:-1]) | (rest[1:] != rest[:-1])) + 1
            starts = np.concatenate(([0], edge))
            sizes = np.diff(np.concatenate((starts, [len(slot)])))
            slots, left, right = [], [], []
            for lag in range(1, 16):  # short runs at once, by distance in the run
                at = np.repeat(np.where((sizes > lag) & (sizes <= 16), sizes - lag, 0), 1)
                if not at.any():
                    break
                use = at > 0
                first = np.repeat(starts[use], at[use]) + np.arange(at[use].sum()) - np.repeat(np.cumsum(at[use]) - at[use], at[use])
                x = prints[first] ^ prints[first + lag]
                for s in np.unique(slot[first]):
                    ours = slot[first] == s
                    good = first[ours][linker.near(x[ours], int(s))]
                    slots += slot[good].tolist()
                    left += prints[good].tolist()
                    right += prints[good + lag].tolist()
            for k in np.flatnonzero(sizes > 16):
                l, r = linker.forest(prints[starts[k] : starts[k] + sizes[k]], int(slot[starts[k]]))
                slots += [int(slot[starts[k]])] * len(l)
                left += l
                right += r
            return emit(slots, left, right)

        for batch in batches:
            if not batch.num_rows:
                continue
            slot, rest, prints = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            prints = prints.view(np.uint64)
            if kept and (kept[0][0][0], kept[0][1][0]) != (slot[0], rest[0]):
                if not overflow:
                    yield closed(*(np.concatenate(x) for x in zip(*kept, strict=True)))
                kept, overflow = [], False
            tail = int(np.flatnonzero((slot != slot[-1]) | (rest != rest[-1]))[-1] + 1) if (slot[0], rest[0]) != (slot[-1], rest[-1]) else 0
            if tail:  # what was kept ends here
                head = int(np.flatnonzero((slot != slot[0]) | (rest != rest[0]))[0])
                if overflow:
                    yield emit(slot[:head], prints[:head], prints[:head])
                    body = (slot[head:tail], rest[head:tail], prints[head:tail])
                    parts = []
                else:
                    body = (slot[:tail], rest[:tail], prints[:tail])
                    parts = kept
                if len(body[0]):
                    yield closed(*(np.concatenate(x) for x in zip(*parts, body, strict=True)))
                elif parts:
                    yield closed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                kept, overflow = [], False
            end = (slot[tail:], rest[tail:], prints[tail:])
            if overflow:
                yield emit(end[0], end[2], end[2])
                continue
            kept.append(end)
            if sum(len(x[0]) for x in kept) > run_limit:  # marked by a loop, linked below
                for part in kept:
                    yield emit(part[0], part[2], part[2])
                kept, overflow = [(end[0][:1], end[1][:1], end[2][:1])], True
        if kept and not overflow:
            yield closed(*(np.concatenate(x) for x in zip(*kept, strict=True)))

    return run


def _wide_links(values: DataFrame, max_bits: int) -> DataFrame:
    """Stars over the full variants with ``max_bits`` wildcards."""
    variants = []
    for bits in combinations(range(BITS), max_bits):
        mask = ~sum(1 << b for b in bits) & ((1 << 64) - 1)
        variants.append(mask - ((mask >> 63) << 64))
    masks = values.sparkSession.createDataFrame([(variants,)], "masks array<bigint>")
    each = values.join(F.broadcast(masks)).select("signature", "value", F.posexplode("masks").alias("n", "mask")).select("signature", "value", "n", F.col("value").bitwiseAND(F.col("mask")).alias("rest"))
    stars = each.groupBy("signature", "n", "rest").agg(F.min("value").alias("least"), F.count("*").alias("size")).where("size > 1")
    return each.join(stars, ["signature", "n", "rest"]).where("value <> least").select("signature", F.col("least").alias("a"), F.col("value").alias("b"))


def _links(values: DataFrame, max_bits: int, run_limit: int) -> DataFrame:
    """``(signature, a, b)`` between distinct ``values(signature int, value)``."""
    if max_bits > 2:
        run_limit = BITS << 40
    found = stored_map(_runs(values, max_bits), _scan_runs(max_bits, run_limit), "signature int, a long, b long", "links").frame
    links = found.where("a <> b")
    wide = found.where("a = b").select("signature", F.col("a").alias("value")).distinct()
    if not wide.isEmpty():
        links = links.unionByName(_wide_links(wide, max_bits))
    return links


def fingerprint_links(prints: DataFrame, max_bits: int = 2, run_limit: int = 8192) -> DataFrame:
    """``(a, b)`` links that keep the components of "at most max_bits apart".

    ``prints``: distinct non-null ``fingerprint`` values.  Full variants of
    more than two wildcards are too many, so beyond two bits every run is
    searched whole, at eight bytes a distinct fingerprint.
    """
    values = prints.select(F.lit(0).alias("signature"), F.col("fingerprint").alias("value"))
    return _links(values, max_bits, run_limit).select("a", "b").distinct()


def _signature_links(rows: DataFrame, signatures: int, max_bits: int, run_limit: int) -> DataFrame:
    """``(a, b)`` between first fingerprints, near under any signature.

    All first fingerprints that share a value of a signature are linked to the
    smallest of them, which stands for the value in its links.
    """
    names = ["fingerprint", *(f"fingerprint_{k}" for k in range(1, signatures))]
    kinds = rows.select(names).distinct()
    pairs = kinds.select("fingerprint", F.inline(F.array(*[F.struct(F.lit(k).alias("signature"), F.col(x).alias("value")) for k, x in enumerate(names)])))
    stands = written(pairs.groupBy("signature", "value").agg(F.min("fingerprint").alias("least")), "stands")
    links = _links(stands.select("signature", "value"), max_bits, run_limit)
    for end in ("a", "b"):
        links = links.join(stands.select("signature", F.col("value").alias(end), F.col("least").alias(f"{end}_least")), ["signature", end])
    shared = pairs.where("signature > 0").join(stands, ["signature", "value"]).select(F.col("fingerprint").alias("a"), F.col("least").alias("b"))
    return links.select(F.col("a_least").alias("a"), F.col("b_least").alias("b")).unionByName(shared).where("a <> b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2, run_limit: int = 8192, signatures: int = 1) -> DataFrame:
    """One row per document: ``(id, fingerprint long, component)``.

    ``component`` is the smallest id reachable over links of fingerprints that
    differ in at most ``max_bits`` bits.  With more than one of ``signatures``,
    documents are linked if their fingerprints are near under any of them: each
    is an independent chance for a pair whose distance scatters about the limit.

    * null and empty texts, and texts of blanks only, have fingerprint 0 and
      are linked like any other;
    * a null id is kept; it is never a component unless all ids of it are null;
    * repeated rows are repeated in the result; other columns are ignored, so
      their names may clash with ours; an empty table gives an empty result.
    """
    rows = stored_map(*_fingerprints(docs, id_col, text_col, shingle, signatures), "fingerprints").frame
    least = written(rows.groupBy("fingerprint").agg(F.min("id").alias("least")), "distinct")
    if signatures == 1:
        links = _links(least.select(F.lit(0).alias("signature"), F.col("fingerprint").alias("value")), max_bits, run_limit)
    else:
        links = _signature_links(rows, signatures, max_bits, run_limit)
    roots = connected_components(links)
    # Both sides of each join below are written tables: so Spark can split the
    # rows of one key, a large component's or a large group of copies'.
    joined = written(roots.join(least, roots.node == least.fingerprint).groupBy("root").agg(F.min("least").alias("component")), "joined")
    named = written(roots.join(joined, "root").select(F.col("node").alias("fingerprint"), "component"), "named")
    labels = written(least.join(named, "fingerprint", "left").select("fingerprint", F.coalesce("component", "least").alias("component")), "labels")
    return rows.join(labels, "fingerprint").select("id", "fingerprint", "component")


def _heads(sets: list[np.ndarray], least: Fraction) -> np.ndarray:
    """For each set the first of its component of "Jaccard similarity at least
    ``least``".

    Breadth-first search through lists of the sets that hold a shingle: what
    is found leaves the search, and all pairs are compared only where no two
    sets are similar.
    """
    sizes = np.array([len(x) for x in sets])
    ends = np.cumsum(sizes)
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(code, kind="stable")
    holders = np.repeat(np.arange(len(sets)), sizes)[order]
    bounds = np.searchsorted(code[order], np.arange(len(values) + 1))
    left = np.ones(len(sets), bool)
    heads = np.arange(len(sets))
    for head in range(len(sets)):
        if not left[head]:
            continue
        left[head] = False
        frontier = [head]
        while frontier and left.any():
            node = frontier.pop()
            mine = code[ends[node] - sizes[node] : ends[node]]
            begin, count = bounds[mine], bounds[mine + 1] - bounds[mine]
            at = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
            common = np.bincount(holders[at], minlength=len(sets))
            found = np.flatnonzero(left & (common * least.denominator >= (sizes + sizes[node] - common) * least.numerator))
            left[found] = False
            heads[found] = head
            frontier += found.tolist()
    return heads


def _part_heads(rows: DataFrame, shingle: int, least: float):
    """Frame, function and schema for ``(group, id, hash, size, parts, head)``:
    each text within its ``(group, part)`` of ``rows``, with the hash of the
    first text that it is similar to there."""
    ratio = Fraction(str(least))
    names = ("group", "id", "hash", "size", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, sets = None, [], []

        def closed():
            columns = [pa.concat_arrays([x[k] for x in held]) for k in range(len(names))]
            return pa.record_batch([*columns, columns[2].take(pa.array(_heads(sets, ratio)))], names=[*names, "head"])

        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            fixed = [batch.column(x) for x in names]
            for k, now in enumerate(zip(*(batch.column(x).to_pylist() for x in ("group", "part")), strict=True)):
                if now != place:
                    if sets:
                        yield closed()
                    place, held, sets = now, [], []
                own = [x.slice(k, 1) for x in fixed]
                if held and held[-1][2].equals(own[2]):  # a repeated row
                    continue
                held.append(own)
                sets.append(np.unique(_shingles(texts[k].as_py(), shingle)))
        if sets:
            yield closed()

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(parts, "group", "part").sortWithinPartitions("group", "part", "id", "hash")
    kind = rows.schema["id"].dataType.simpleString()
    return ordered.select("part", *names, text_of("text").alias("text")), run, f"group long, id {kind}, hash long, size long, parts long, head long"


def similar_heads(rivals: DataFrame, texts: DataFrame, shingle: int = 5, least: float = 0.8, part_bytes: int = PART_BYTES) -> DataFrame:
    """``(hash)`` of the texts that stay of each group of candidates.

    ``rivals(group long, id, hash long, size long)`` name candidates by id and
    text hash, ``size`` being the text's bytes; ``texts(id, hash, text)`` hold
    them.  Within a group, texts are linked if their sets of shingles have a
    Jaccard similarity of ``least`` or more; of each component the text with
    the smallest id and hash stays.  Every pair of a group counts, not only
    those that a fingerprint links.  Texts without words are alike.

    A group of over ``part_bytes`` is dealt out in parts of about so much, of
    16 texts at least, one task each; the first texts of a part meet again in
    the next round, dealt out anew, until they are one part or two rounds find
    nothing.  What is not linked to the bulk of its group by then is compared
    with all of the group, so that the result is that of one part: of any two
    texts that are not linked yet, one at least is not in the bulk.
    """
    rivals = stored(rivals.select("group", "id", "hash", "size"), "candidates").frame

    def compared(dealt: DataFrame, rows: int, label: str) -> DataFrame:
        """The first similar texts within the parts of ``dealt``."""
        named = small(dealt, rows).withColumnsRenamed({"id": "rid", "hash": "rhash"})
        whole = texts.join(named, F.col("id").eqNullSafe(F.col("rid")) & (F.col("hash") == F.col("rhash"))).drop("rid", "rhash")
        return stored_map(*_part_heads(whole, shingle, least), label).frame

    def parts_of(bytes_of: int):
        return F.greatest(F.least(F.ceil(F.sum("size") / bytes_of), F.floor(F.count("*") / 16)), F.lit(1)).cast("long")

    def links(found: DataFrame) -> DataFrame:
        return found.where("hash <> head").select(F.xxhash64("group", "hash").alias("a"), F.xxhash64("group", "head").alias("b"))

    edges, large, idle, meeting = [], None, 0, stored(rivals, "meeting")
    for number in range(1000):
        sizes = written(meeting.frame.groupBy("group").agg(parts_of(part_bytes).alias("parts")), "group-sizes")
        dealt = meeting.frame.join(sizes, "group").withColumn("part", F.pmod(F.xxhash64("hash", F.lit(number)), "parts"))
        found = compared(dealt, meeting.rows, "heads")
        if large is None:
            stays = found.where("parts = 1 and hash = head").select("hash")
            large, found = rivals.join(sizes.where("parts > 1"), "group").drop("parts"), found.where("parts > 1")
        edges.append(links(found))
        rest = stored(found.where("parts > 1 and hash = head").select("group", "id", "hash", "size"), "meeting")
        if not number and not rest.rows:
            return stays
        idle = idle + 1 if rest.rows == meeting.rows else 0
        meeting = rest
        if not rest.rows or idle == 2:
            break

    def rooted(links: list[DataFrame], label: str) -> DataFrame:
        """The texts of large groups with their components' numbers."""
        roots = connected_components(reduce(DataFrame.unionByName, links))
        numbered = large.withColumn("node", F.xxhash64("group", "hash")).join(roots, "node", "left")
        return written(numbered.select("group", "id", "hash", "size", F.coalesce("root", "node").alias("root")), label)

    linked = rooted(edges, "linked")
    bulk = linked.groupBy("group", "root").agg(F.sum("size").alias("bytes")).groupBy("group").agg(F.max_by("root", F.struct("bytes", "root")).alias("bulk"))
    # A task has a part of either side, each of half as many bytes.
    outside = stored(linked.join(bulk, "group").where("root <> bulk").select("group", "id", "hash", "size"), "outside")
    if outside.rows:
        rows, columns = (x.groupBy("group").agg(parts_of(part_bytes // 2).alias(name)) for x, name in ((outside.frame, "rows"), (linked, "columns")))
        grid = written(rows.join(columns, "group").select("group", "rows", "columns"), "grid")
        at = lambda name: F.pmod(F.xxhash64("hash", F.lit(name)), name)
        each = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(name) - 1))
        own = outside.frame.join(grid, "group").withColumn("row", at("rows")).withColumn("column", each("columns"))
        all_of = linked.drop("root").join(grid, "group").withColumn("column", at("columns")).withColumn("row", each("rows"))
        cells = own.unionByName(all_of).select("group", "id", "hash", "size", F.lit(1).cast("long").alias("parts"), (F.col("row") * F.col("columns") + F.col("column")).alias("part"))
        cells = stored(cells, "cells")
        linked = rooted([*edges, links(compared(cells.frame, cells.rows, "crossed"))], "crossed-linked")
    firsts = linked.groupBy("group", "root").agg(F.min(F.struct("id", "hash")).alias("first"))
    return stays.unionByName(firsts.select(F.col("first.hash").alias("hash")))
