"""Substring deduplication with a log-structured fingerprint index.

Every window of ``window`` words has an anchor: the leftmost smallest hash
among its ``gram``-word grams.  Equal windows have equal anchors, so windows
whose anchor occurs once in the index cannot repeat.  Consecutive windows
with one anchor form a *range*, stored as one index entry

    (anchor hash, hash of the range's words, document, first window, windows)

The index is a list of immutable runs.  A run has a file for each bucket of
anchors, sorted by anchor.  A batch is written as a new run; runs are
merge-joined bucket by bucket, each file read once from its beginning to its
end, without a shuffle.  Runs of one level are merged into a run of the next
once there are ``fanout`` of them.  A manifest names the files that count, so
an index can be opened again.

Verification has two steps.  A range that occurs twice as a whole repeats with
all its windows.  Where ranges of an anchor differ (ends of a shared passage,
edits), the windows of one representative of each are hashed by two
independent hashes of 64 bits, down to the words' bytes, and compared, so that
thousands of copies cost as much as two.  A range of an earlier batch may have
to be hashed for a later one, so an index that is kept stores its texts,
compressed, beside the runs.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from lexweave.llm.runtime import PartFile, Stored, arrow_map, read_files, scratch, stored, stored_map, text_of, written
from lexweave.llm.words import BLANK_SEPARATED, SPAN_WORDS, WordTable, chunks, leftmost_minima

_ENTRY = "anchor long, range long, ref long, key long, first int, windows int, salt int"
_FOUND = "anchor long, range long, ref long, key long, first int, windows int"
_ARROW = pa.schema([(x, pa.int64()) for x in ("anchor", "range", "ref", "key")] + [(x, pa.int32()) for x in ("first", "windows", "salt")])
#: Entries of one anchor in a chunk of text that stay together.
_TOGETHER = 2
#: Numbers by which the others are dealt out.
_SALTS = 1 << 20
#: Entries that are read of a file at once.
_READ = 1 << 15
#: Batches in which a table is appended to a new index.
BATCHES = 3


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(ref, key, text): 128 bits of hash that stand for a row's id and text."""
    return docs.select(F.xxhash64(F.col(id_col)).alias("ref"), text_of(text_col).alias("text")).select("ref", F.xxhash64("text").alias("key"), "text")


def _salts(anchors: np.ndarray, hot: np.ndarray, drawn: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(salts, hot anchors, numbers drawn) after a chunk's anchors.

    An anchor's first entries of a task have salt 0 and lie in the anchor's
    bucket.  Once it has more, these get numbers that deal them out to all
    buckets, so that a frequent anchor does not land in one; it is known to
    repeat.  Numbers follow the order of rows, so a repeated task draws them again.
    """
    order = np.argsort(anchors, kind="stable")
    ordered = anchors[order]
    opens = np.concatenate(([0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1))
    sizes = np.diff(np.concatenate((opens, [len(anchors)])))
    rank = np.empty(len(anchors), np.int64)
    rank[order] = np.arange(len(anchors)) - np.repeat(opens, sizes)
    dealt = (rank >= _TOGETHER) | np.isin(anchors, hot)
    salts = np.zeros(len(anchors), np.int32)
    count = int(dealt.sum())
    salts[dealt] = 1 + (drawn + np.arange(count)) % _SALTS
    return salts, np.union1d(hot, ordered[opens][sizes > _TOGETHER]), drawn + count


def _entries(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, drawn = np.zeros(0, np.uint64), 104_729 * TaskContext.get().partitionId()
        for batch in batches:
            for begin, _, data, offs in chunks(batch.column(2)):
                table = WordTable(data, offs, BLANK_SEPARATED)
                starts = table.window_starts(window)
                if not len(starts):
                    continue
                at = np.arange(len(table) - gram + 1)
                grams = table.span_hashes(at, at + gram)
                anchors = leftmost_minima(grams, window - gram + 1)[starts]
                edge = np.flatnonzero((np.diff(anchors) != 0) | (np.diff(starts) != 1)) + 1
                opens = np.concatenate(([0], edge))
                counts = np.diff(np.concatenate((opens, [len(starts)])))
                first = starts[opens]
                rows = table.rows[first]
                take = pa.array(rows + begin)
                found = grams[anchors[opens]]
                salts, hot, drawn = _salts(found, hot, drawn)
                yield pa.record_batch(
                    [
                        pa.array(found.view(np.int64)),
                        pa.array(table.span_hashes(first, first + counts + window - 1).view(np.int64)),
                        batch.column(0).take(take),
                        batch.column(1).take(take),
                        pa.array((first - table.bounds[rows]).astype(np.int32)),
                        pa.array(counts.astype(np.int32)),
                        pa.array(salts),
                    ],
                    names=_ARROW.names,
                )

    return run


# --- Runs ---------------------------------------------------------------------


def _write_buckets(folder: str):
    """Writes rows sorted by bucket to a file for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, file = None, None

        def done():
            return pa.record_batch([pa.array([bucket], pa.int32()), pa.array([file.uri]), pa.array([file.close()], pa.int64())], names=["bucket", "file", "rows"])

        for batch in batches:
            if not batch.num_rows:
                continue
            buckets = batch.column("bucket").to_numpy()
            edges = [0, *(np.flatnonzero(buckets[1:] != buckets[:-1]) + 1).tolist(), len(buckets)]
            for a, b in zip(edges, edges[1:], strict=False):
                if buckets[a] != bucket:
                    if file is not None:
                        yield done()
                    bucket, file = int(buckets[a]), PartFile(folder, _ARROW)
                file.add(batch.slice(a, b - a).select(_ARROW.names))
        if file is not None:
            yield done()

    return run


class _Reader:
    """A run's file, read on in order of its anchors."""

    def __init__(self, uri: str, fresh: bool):
        system, name = pafs.FileSystem.from_uri(uri)
        self._batches = pq.ParquetFile(system.open_input_file(name)).iter_batches(_READ)
        self.fresh, self.columns = fresh, None
        self.load()

    def load(self) -> bool:
        batch = next((x for x in self._batches if x.num_rows), None)
        self.columns = None if batch is None else [batch.column(x).to_numpy() for x in _ARROW.names]
        return batch is not None

    def upto(self, anchor: int) -> Iterator[list[np.ndarray]]:
        """The rows up to and with this anchor."""
        while self.columns is not None:
            n = int(np.searchsorted(self.columns[0], anchor, "right"))
            if n:
                yield [x[:n] for x in self.columns]
            if n < len(self.columns[0]):
                self.columns = [x[n:] for x in self.columns]
                return
            self.load()


def merged(files: list[str], fresh: list[bool]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """(columns, fresh) of the files' rows in order of their anchors; all rows
    of an anchor come together."""
    readers = [x for x in (_Reader(uri, new) for uri, new in zip(files, fresh, strict=True)) if x.columns is not None]
    while readers:
        frontier = min(int(x.columns[0][-1]) for x in readers)
        parts, news = [], []
        for reader in readers:
            for part in reader.upto(frontier):
                parts.append(part)
                news.append(np.full(len(part[0]), reader.fresh))
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
        order = np.argsort(columns[0], kind="stable")
        yield [x[order] for x in columns], np.concatenate(news)[order]
        readers = [x for x in readers if x.columns is not None]


def _groups(anchors: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(anchors[1:] != anchors[:-1])))


def _repeated(fresh_only: bool):
    """Entries whose anchor occurs again, of each bucket's ``(files, fresh)``.

    With ``fresh_only``, those of anchors that the newest run has, too.  Old
    entries that were dealt out lie apart from it: they are not ``sure``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for files, fresh in zip(batch.column("files").to_pylist(), batch.column("fresh").to_pylist(), strict=True):
                for columns, new in merged(files, fresh):
                    group = _groups(columns[0])
                    chosen = (np.bincount(group)[group] > 1) | (columns[6] > 0)
                    sure = np.ones(len(group), bool)
                    if fresh_only:
                        sure = np.bincount(group, new)[group] > 0
                        chosen &= sure | (columns[6] > 0)
                    if chosen.any():
                        yield pa.record_batch([*(pa.array(x[chosen]) for x in columns[:6]), pa.array(sure[chosen])], names=[*_ARROW.names[:6], "sure"])

    return run


def _compacted(folder: str):
    """Merges each bucket's files into one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, files in zip(batch.column("bucket").to_pylist(), batch.column("files").to_pylist(), strict=True):
                file = PartFile(folder, _ARROW)
                for columns, _ in merged(files, [False] * len(files)):
                    file.add(pa.record_batch([pa.array(x) for x in columns], names=_ARROW.names))
                yield pa.record_batch([pa.array([bucket], pa.int32()), pa.array([file.uri]), pa.array([file.close()], pa.int64())], names=["bucket", "file", "rows"])

    return run


@dataclass
class Run:
    """An immutable run: its level and each bucket's files, below the index."""

    level: int
    files: dict[int, list[str]]
    rows: int


@dataclass
class FingerprintIndex:
    """Sorted immutable runs of window fingerprints, oldest first.

    The folder must be one that Arrow reaches.  One process appends at a time.
    """

    spark: SparkSession
    path: str
    window: int = 35
    gram: int = 8
    fanout: int = 4
    buckets: int = 0
    keep_texts: bool = True
    runs: list[Run] = field(default_factory=list)
    text_files: list[str] = field(default_factory=list)
    version: int = 0

    def __post_init__(self):
        if not 0 <= self.window - self.gram < 64 or self.window + 64 >= SPAN_WORDS:
            raise ValueError("a window has at most 63 words more than a gram, and fewer than 448")
        self.buckets = self.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    @classmethod
    def create(cls, spark: SparkSession, path: str | None = None, **options) -> FingerprintIndex:
        return cls(spark, path or scratch(spark, "index"), **options)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        """The index as its newest manifest has it."""
        system, root = pafs.FileSystem.from_uri(path)
        names = [x.path for x in system.get_file_info(pafs.FileSelector(f"{root}/manifests"))]
        with system.open_input_stream(max(x for x in names if x.endswith(".json"))) as stream:
            saved = json.loads(stream.read())
        runs = [Run(x["level"], {int(k): v for k, v in x["files"].items()}, x["rows"]) for x in saved.pop("runs")]
        return cls(spark, path, runs=runs, **saved)

    def _save(self) -> None:
        """Writes the next manifest; it counts once it has its name."""
        self.version += 1
        system, root = pafs.FileSystem.from_uri(self.path)
        system.create_dir(f"{root}/manifests", recursive=True)
        names = ("window", "gram", "fanout", "buckets", "keep_texts", "text_files", "version")
        content = {x: getattr(self, x) for x in names} | {"runs": [{"level": x.level, "files": x.files, "rows": x.rows} for x in self.runs]}
        name = f"{root}/manifests/{self.version:012d}"
        with system.open_output_stream(f"{name}.part") as stream:
            stream.write(json.dumps(content).encode())
        system.move(f"{name}.part", f"{name}.json")

    def drop(self) -> None:
        system, root = pafs.FileSystem.from_uri(self.path)
        if system.get_file_info(root).type == pafs.FileType.Directory:
            system.delete_dir(root)

    def _run(self, level: int, rows: list) -> Run:
        files: dict[int, list[str]] = {}
        for r in rows:  # a few files for each bucket
            files.setdefault(r.bucket, []).append(r.file.removeprefix(f"{self.path}/"))
        return Run(level, files, sum(r.rows for r in rows))

    def _by_bucket(self, runs: list[Run], newest: Run | None = None) -> DataFrame:
        """``(bucket, files, fresh)``, a task for each bucket."""
        rows = []
        for bucket in range(self.buckets):
            files = [(f"{self.path}/{file}", run is newest) for run in runs for file in run.files.get(bucket, ())]
            if files:
                rows.append((bucket, [x for x, _ in files], [x for _, x in files]))
        return self.spark.createDataFrame(rows, "bucket int, files array<string>, fresh array<boolean>").repartition(max(1, len(rows)))

    def append(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", look: bool = True) -> Stored | None:
        """Writes the batch as a run; with ``look``, gives the entries of its
        anchors that are met elsewhere in it or in an older run, from either side."""
        keyed = _keyed(docs, id_col, text_col)
        if self.keep_texts:
            packed = stored(_packed(docs, id_col, text_col).select("ref", "key", "body"), "texts")
            self.text_files += packed.frame.inputFiles() if packed.rows else []
        entries = arrow_map(keyed, _entries(self.window, self.gram), _ENTRY)
        bucket = F.pmod(F.hash("anchor", "salt"), F.lit(self.buckets))  # where the shuffle puts it, too
        ordered = entries.withColumn("bucket", bucket).repartition(self.buckets, "anchor", "salt").sortWithinPartitions("bucket", "anchor")
        run = self._run(0, arrow_map(ordered, _write_buckets(f"{self.path}/runs"), "bucket int, file string, rows long").collect())
        self.runs.append(run)
        met = self.repeated(newest=run) if look else None
        self._save()
        self.compact()
        return met

    def texts(self) -> DataFrame:
        """(ref, key, body) of every text that was appended."""
        return read_files(self.spark, self.text_files, StructType.fromDDL("ref long, key long, body binary"))

    def repeated(self, newest: Run | None = None) -> Stored:
        """Entries whose anchor occurs at least twice in the index; with
        ``newest``, those of the anchors that this run has."""
        found = stored_map(self._by_bucket(self.runs, newest), _repeated(newest is not None), f"{_FOUND}, sure boolean", "met")
        if newest is None:
            return Stored(found.frame.drop("sure"), found.rows, found.folder)
        apart = found.frame.where("not sure").drop("sure")
        if apart.isEmpty():
            return Stored(found.frame.drop("sure"), found.rows, found.folder)
        own = written(found.frame.where("sure").select("anchor").distinct(), "anchors")
        return stored(found.frame.where("sure").drop("sure").unionByName(apart.join(own, "anchor", "left_semi")), "entries")

    def compact(self) -> None:
        """Merges the runs of each level that holds ``fanout`` of them."""
        level = 0
        while len(old := [x for x in self.runs if x.level == level]) >= self.fanout:
            rows = arrow_map(self._by_bucket(old), _compacted(f"{self.path}/runs"), "bucket int, file string, rows long").collect()
            at = self.runs.index(old[0])
            self.runs = [*(x for x in self.runs[:at] if x not in old), self._run(level + 1, rows), *(x for x in self.runs[at:] if x not in old)]
            self._save()
            system, root = pafs.FileSystem.from_uri(self.path)
            for file in (file for run in old for files in run.files.values() for file in files):
                system.delete_file(f"{root}/{file}")
            level += 1


# --- Verification -------------------------------------------------------------


def _packed(docs: DataFrame, id_col: str, text_col: str, others: Sequence[str] = ()) -> DataFrame:
    """(id, ref, key, body): texts compressed for the shuffle.

    Columns named in ``others`` follow as one struct, ``others``.
    """
    columns = [F.col(id_col).alias("id"), F.xxhash64(F.col(id_col)).alias("ref"), F.xxhash64(text_of(text_col)).alias("key"), text_of(text_col).alias("body")]
    if others:
        columns.append(F.struct(*(F.col(f"`{x}`") for x in others)).alias("others"))
    keyed = docs.select(columns)

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            texts = batch.column(3).cast(pa.binary())
            bodies = pa.array([squeeze(x.as_py()) for x in texts], pa.binary())
            yield pa.record_batch([*batch.columns[:3], bodies, *batch.columns[4:]], names=batch.schema.names)

    schema = StructType([*keyed.schema.fields[:3], StructField("body", BinaryType()), *keyed.schema.fields[4:]])
    return arrow_map(keyed, run, schema)


def _expand(window: int):
    """Window hashes of the listed ranges of each text."""

    def run(batches):
        for batch in batches:
            opened = zstandard.ZstdDecompressor()
            bodies = pa.array([opened.decompress(x.as_py()) for x in batch.column("body")], pa.large_binary()).cast(pa.large_string())
            lists = batch.column("ranges")
            flat, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            first, count = flat.field("first").to_numpy(), flat.field("windows").to_numpy()
            for begin, end, data, offs in chunks(bodies):
                table = WordTable(data, offs, BLANK_SEPARATED)
                ours = np.flatnonzero((owner >= begin) & (owner < end))
                each = np.repeat(ours, count[ours])
                step = np.arange(len(each)) - np.repeat(np.cumsum(count[ours]) - count[ours], count[ours])
                at = table.bounds[owner[each] - begin] + first[each] + step
                take = pa.array(each)
                yield pa.record_batch(
                    [pa.array(table.span_hashes(at, at + window, which).view(np.int64)) for which in (0, 1)]
                    + [flat.field(name).take(take) for name in ("anchor", "range", "copies")]
                    + [pa.array(step.astype(np.int32))],
                    names=["low", "high", "anchor", "range", "copies", "step"],
                )

    return run


def repeated_windows(docs: DataFrame, index: FingerprintIndex, entries: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(ref, key, spans)`` per text with repeated windows.

    A span lists ``windows`` windows from word ``first`` on; bit i of ``mask``
    tells whether the i-th repeats.  ``docs`` must hold every text that the
    written table ``entries`` names unless the index keeps texts; then these
    are read.  What is joined is written first, so that Spark can split the
    rows of a frequent anchor or window.
    """
    ranges = stored(entries.groupBy("anchor", "range").agg(F.count("*").alias("copies"), F.min(F.struct("ref", "key", "first", "windows")).alias("rep")), "ranges")
    differ = written(ranges.frame.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("copies").alias("least")).where("kinds > 1 and least = 1").select("anchor"), "differ")
    mixed = ranges.frame.join(differ, "anchor", "left_semi").select("rep.ref", "rep.key", F.struct("anchor", "range", "copies", "rep.first", "rep.windows").alias("range"))
    mixed = written(mixed.groupBy("ref", "key").agg(F.collect_list("range").alias("ranges")), "mixed")
    packed = index.texts() if index.keep_texts else _packed(docs, id_col, text_col).drop("id")
    windows = stored_map(packed.join(mixed, ["ref", "key"]).select("body", "ranges"), _expand(index.window), "low long, high long, anchor long, range long, copies long, step int", "windows")
    # Rows that repeat id and text list a window twice, but it is the same window.
    same = F.xxhash64("anchor", "range", "step")
    twice = windows.frame.groupBy("low", "high").agg(F.max("copies").alias("most"), F.min(same).alias("a"), F.max(same).alias("b")).where("most > 1 or a <> b").select("low", "high")
    again = windows.frame.where("copies = 1").join(written(twice, "twice"), ["low", "high"])
    partial = again.groupBy("anchor", "range").agg(F.bit_or(F.expr("shiftleft(1L, step)")).alias("mask"))
    whole = ranges.frame.where("copies > 1").select("anchor", "range", F.lit(-1).cast("long").alias("mask"))
    flagged = written(whole.unionByName(partial), "flagged")
    windows.drop()
    ranges.drop()
    spans = entries.join(flagged, ["anchor", "range"]).select("ref", "key", F.struct("first", "windows", "mask").alias("span")).distinct()
    return spans.groupBy("ref", "key").agg(F.collect_list("span").alias("spans"))


def _covered(n: int, first: np.ndarray, count: np.ndarray, mask: np.ndarray, window: int) -> np.ndarray:
    """Which of n words lie in a repeated window."""
    step = np.arange(64)
    hit = (step < count[:, None]) & ((mask[:, None] >> step) & 1).astype(bool)
    starts = (first[:, None] + step)[hit]
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    return np.cumsum(change[:n]) > 0


_MADE = ("n_words", "n_removed", "kept_sha256", "kept")


def _rewrite(window: int, texts: bool):
    def run(batches):
        for batch in batches:
            opened = zstandard.ZstdDecompressor()
            lists = batch.column("spans")
            out: list[list] = [[], [], [], []]
            for k in range(batch.num_rows):
                body = opened.decompress(batch.column("body")[k].as_py())
                words, removed = body.split(), 0
                spans = lists[k]
                if spans.is_valid:
                    inner = spans.values
                    gone = _covered(len(words), *(inner.field(x).to_numpy() for x in ("first", "windows", "mask")), window)
                    removed = int(gone.sum())
                    words = [words[j] for j in np.flatnonzero(~gone)]
                kept = b" ".join(words)
                for column, value in zip(out, (len(words) + removed, removed, hashlib.sha256(kept).hexdigest(), (kept if removed else body).decode()), strict=True):
                    column.append(value)
            made = [pa.array(x, kind) for x, kind in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)][: 4 if texts else 3]
            yield pa.record_batch([batch.column("id"), *made, *batch.columns[3:]], names=["id", *_MADE[: len(made)], *batch.schema.names[3:]])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, gram: int = 8, index: FingerprintIndex | None = None, others: Sequence[str] = (), batches: int = BATCHES, texts: bool = True) -> DataFrame:
    """One row per document, as a written table: ``(id, n_words, n_removed,
    kept_sha256, kept)``, without ``kept`` if ``texts`` are not wanted.

    With ``others``, a struct of that name follows: these columns of the same row.

    Removes each word that lies in a window of ``window`` words whose sequence
    also starts elsewhere (another document or the same one).  Words are runs
    of bytes other than blanks.  ``kept`` is the text as it was if nothing is
    removed, else the kept words joined by one space.  With an ``index``, all
    texts appended to it before count as elsewhere, and ``docs`` joins them.
    Without one, ``docs`` is appended to a new one in ``batches``, by the hash
    of the id, and all its runs are merge-joined.

    * null texts have no words; texts shorter than a window lose none; very
      long texts are windowed whole, in linear time;
    * repeated rows count as copies of each other (same id or not), null ids
      are kept and treated like any id; rows that share an id are told apart by
      64 bits of their text's hash; other columns are ignored, whatever their
      names; an empty table gives an empty result.
    """
    if index is None:
        index = FingerprintIndex.create(docs.sparkSession, window=window, gram=gram, keep_texts=False, fanout=2)
        for k in range(batches):
            index.append(docs.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(batches)) == k), id_col, text_col, look=False)
        entries = index.repeated()
        index.drop()
    else:
        entries = index.append(docs, id_col, text_col)
    spans = written(repeated_windows(docs, index, entries.frame, id_col, text_col), "spans")
    entries.drop()
    packed = _packed(docs, id_col, text_col, others)
    rows = packed.join(spans, ["ref", "key"], "left").select("id", "body", "spans", *packed.columns[4:])
    made = [StructField(x, kind) for x, kind in zip(_MADE, (LongType(), LongType(), StringType(), StringType()), strict=True)][: 4 if texts else 3]
    schema = StructType([rows.schema["id"], *made, *rows.schema.fields[3:]])
    return stored_map(rows, _rewrite(index.window, texts), schema, "rewritten").frame
