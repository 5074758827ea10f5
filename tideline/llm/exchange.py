"""Documents in written batches, and questions that batches ask of hash-partitioned tables.

A batch is about a megabyte of whole texts. What it wants to know of its hashes goes, packed and
without repeats, to one task for each range of hashes; that task answers every batch with
packed bits in the order of the question. So a hash costs a few bytes for each batch that has it,
however often it stands in the batch, and no row is ever made for a pair.

Both batches and ranges grow with the data, and a row from each batch to each range would grow with its square. So a
batch writes to FAN outer ranges at most. Beyond that a relay gets what some batches ask of one outer range,
sends it on to the ranges inside, merged, and deals the answers out again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import on_remove, scratch_path, spread
from . import arrow

U64 = np.uint64
#: Bytes of text for each hash range, and for each batch.
RANGE_BYTES, BATCH_BYTES = 16 << 20, 1 << 20
#: The most rows that a batch writes.
FAN = 256
#: Bytes of text whose questions about one outer range meet in a relay, times FAN.
RELAY_BYTES = 4 << 30

_BATCH = "batch bigint, ids array<bigint>, known array<boolean>, sizes array<bigint>, data binary"


def write_batches(docs: DataFrame, id_col: str, text_col: str, most: int = BATCH_BYTES, notes: Callable[[Batch], bytes] | None = None) -> DataFrame:
    """docs as a table of batches in buckets of the batch number: (batch, ids, known, sizes, data), and what ``notes`` says of each batch.

    Replies join it on the batch number, several times; in buckets the texts are moved once, when they are written. A null
    text is empty; ids are whole numbers or null (``known`` false).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = TaskContext.get().partitionId() << 32, 0
        ids: list[np.ndarray] = []
        known: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        data: list[bytes] = []
        held = 0

        def out() -> pa.RecordBatch:
            nonlocal n, held
            own = [np.concatenate(ids), np.concatenate(known), np.concatenate(sizes), b"".join(data)]
            kinds = [pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary()]
            cols = [pa.array([base + n], pa.int64()), *[pa.array([x], t) for x, t in zip(own, kinds, strict=True)]]
            if notes:
                cols.append(pa.array([notes(Batch(*own))], pa.binary()))
            for x in (ids, known, sizes, data):
                x.clear()
            n, held = n + 1, 0
            return pa.RecordBatch.from_arrays(cols, ["batch", "ids", "known", "sizes", "data", "notes"][: len(cols)])

        for b in batches:
            key = b.column(0)
            there = key.is_valid().to_numpy(zero_copy_only=False)
            values = key.fill_null(0).to_numpy(zero_copy_only=False)
            for i, j, text, offsets in arrow.spans(b.column(1), most):
                if held and held + len(text) > most:
                    yield out()
                ids.append(values[i:j])
                known.append(there[i:j])
                sizes.append(np.diff(offsets))
                data.append(text.tobytes())
                held += len(text)
        if ids:
            yield out()

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    spark = docs.sparkSession
    buckets, name = spread(rows), f"tideline_batches_{uuid.uuid4().hex}"
    dealt = rows.mapInArrow(arrow.trimmed(run), _BATCH + (", notes binary" if notes else "")).repartition(buckets, "batch")
    path = scratch_path(spark, "batches")
    on_remove(path, partial(_forget, spark, name))
    with arrow.batches_of(spark, 1000):
        dealt.write.bucketBy(buckets, "batch").sortBy("batch").option("path", path).saveAsTable(name)
    return spark.table(name)


def _forget(spark: SparkSession, name: str) -> None:
    """Take the table out of the catalog when its files go."""
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # noqa: BLE001  the session has stopped, and an in-memory catalog with it
        return


class Batch:
    """One row of write_batches() as arrays."""

    def __init__(self, ids, known, sizes, data: bytes):
        self.ids = np.asarray(ids, np.int64)
        self.known = np.asarray(known, bool)
        sizes = np.asarray(sizes, np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        self.data = np.frombuffer(data, np.uint8)
        #: The order of documents: by id, those without one last and equal.
        self.rank = np.where(self.known, self.ids, np.iinfo(np.int64).max)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def loaded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Batch, dict]]:
    """(number, batch, its further columns as Python values)."""
    for b in batches:
        rest = [n for n in b.schema.names if n not in ("batch", "ids", "known", "sizes", "data")]
        for i in range(len(b)):
            own = Batch(*[b.column(n)[i].values.to_numpy(zero_copy_only=False) for n in ("ids", "known", "sizes")], b.column("data")[i].as_py())
            yield b.column("batch")[i].as_py(), own, {n: b.column(n)[i].as_py() for n in rest}


class Ranges:
    """``n`` ranges of the hash space in proportion to the text, and outer ranges of ``inner`` of them each."""

    def __init__(self, total_bytes: int):
        self.n = max(1, -(-total_bytes // RANGE_BYTES))
        self.inner = -(-self.n // FAN)
        self.relays = max(1, -(-total_bytes // RELAY_BYTES))

    def outer(self, cuts: np.ndarray) -> np.ndarray:
        """The cuts of the outer ranges among those of split()."""
        return np.append(cuts[: self.n : self.inner], cuts[-1])


def ranges(batches: DataFrame) -> Ranges:
    return Ranges(batches.agg(F.sum(F.octet_length("data").cast("bigint"))).first()[0] or 0)


def split(sorted_hashes: np.ndarray, n: int) -> np.ndarray:
    """n + 1 places that cut sorted 64-bit hashes into n ranges of the hash space."""
    if n == 1:
        return np.array([0, len(sorted_hashes)], np.int64)
    edges = np.arange(1, n, dtype=U64) * U64(-(-(1 << 64) // n))
    return np.concatenate([[0], np.searchsorted(sorted_hashes, edges), [len(sorted_hashes)]]).astype(np.int64)


Answer = Callable[[list[bytes]], list[bytes]]
#: ``part`` is an outer range, ``parts`` and ``counts`` the ranges in it that are asked and of how many hashes each.
ASK = "part int, batch bigint, parts binary, counts binary, question binary"


def posed(number: int, rows: np.ndarray, cuts: np.ndarray, given: Ranges) -> Iterator[pa.RecordBatch]:
    """A batch's question, sorted by hash and cut by split(), as rows of ASK."""
    outer, filled = given.outer(cuts), np.flatnonzero(np.diff(cuts))
    at = np.searchsorted(filled, np.arange(len(outer)) * given.inner)
    for part in np.flatnonzero(np.diff(outer)).tolist():
        own = filled[at[part] : at[part + 1]]
        blobs = [own.astype("<i4").tobytes(), (cuts[own + 1] - cuts[own]).astype("<i8").tobytes(), rows[outer[part] : outer[part + 1]].tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int64()), *[pa.array([x], pa.binary()) for x in blobs]], ["part", "batch", "parts", "counts", "question"])


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1 .. for each size, one after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def ask(questions: DataFrame, answer: Answer, given: Ranges, kind: np.dtype | str, width: int = 1) -> DataFrame:
    """(batch, replies): what ``answer`` says to each batch's question, rows of ASK with entries of ``kind``.

    ``answer`` gets the questions of one range and returns a reply to each, ``width`` packed bits for each entry. Replies come as a list of
    (part, reply), one for each outer range.
    """
    size = np.dtype(kind).itemsize
    least = int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def direct(table: pa.Table) -> pa.Table:
        replies = answer(table.column("question").to_pylist())
        return pa.table({"part": table.column("part").cast(pa.int32()), "batch": table.column("batch"), "reply": pa.array(replies, pa.binary())})

    def onward(table: pa.Table) -> pa.Table:
        """What some batches ask of an outer range, as one question to each range in it."""
        parts, counts = _joined(table.column("parts"), "<i4"), _joined(table.column("counts"), "<i8")
        batch = np.repeat(table.column("batch").to_numpy(), [len(x) // 4 for x in table.column("parts").to_pylist()])
        rows = _joined(table.column("question"), f"V{size}")
        order = np.argsort(parts, kind="stable")
        begins = np.cumsum(counts) - counts
        rows = rows[ragged(begins[order], counts[order])]
        ends = np.flatnonzero(np.append(parts[order][1:] != parts[order][:-1], True)) + 1
        cuts, places = np.cumsum(counts[order])[ends - 1], np.append(0, ends)
        pieces = [x.tobytes() for x in np.split(rows, cuts[:-1])]
        of = lambda x, t: pa.array([x[order[a:b]].astype(t).tobytes() for a, b in zip(places[:-1], places[1:], strict=True)], pa.binary())
        return pa.table({"part": pa.array(parts[order][ends - 1], pa.int32()), "via": pa.array(np.full(len(ends), table.column("via")[0].as_py()), pa.int64()), "batches": of(batch, "<i8"), "counts": of(counts, "<i8"), "question": pa.array(pieces, pa.binary())})

    def there(table: pa.Table) -> pa.Table:
        replies = answer(table.column("question").to_pylist())
        return pa.table({"via": table.column("via"), "part": table.column("part").cast(pa.int32()), "batches": table.column("batches"), "counts": table.column("counts"), "reply": pa.array(replies, pa.binary())})

    def back(table: pa.Table) -> pa.Table:
        """The bits of the ranges of an outer range, for each batch in the order of its question."""
        table = table.sort_by("part")
        counts, batch = _joined(table.column("counts"), "<i8"), _joined(table.column("batches"), "<i8")
        sizes = [int(np.frombuffer(x, "<i8").sum()) for x in table.column("counts").to_pylist()]
        said = [np.unpackbits(np.frombuffer(x, np.uint8), count=n * width) for x, n in zip(table.column("reply").to_pylist(), sizes, strict=True)]
        said = np.concatenate(said).reshape(-1, width)
        order = np.argsort(batch, kind="stable")  # within a batch the ranges stay in their order
        begins = np.cumsum(counts) - counts
        said = said[ragged(begins[order], counts[order])]
        last = np.flatnonzero(np.append(batch[order][1:] != batch[order][:-1], True))
        ends = np.cumsum(counts[order])[last]
        replies = [np.packbits(x).tobytes() for x in np.split(said, ends[:-1])]
        part = table.column("part")[0].as_py() // given.inner
        return pa.table({"part": pa.array(np.full(len(last), part), pa.int32()), "batch": pa.array(batch[order][last], pa.int64()), "reply": pa.array(replies, pa.binary())})

    if given.inner == 1:
        dealt = questions.repartition(max(given.n, least), "part")
        replies = dealt.groupBy("part").applyInArrow(direct, "part int, batch bigint, reply binary")
    else:
        hops = max(FAN * given.relays, least)
        dealt = questions.withColumn("via", F.col("part").cast("bigint") * given.relays + F.pmod(F.xxhash64("batch"), F.lit(given.relays))).repartition(hops, "via")
        asked = dealt.groupBy("via").applyInArrow(onward, "part int, via bigint, batches binary, counts binary, question binary").repartition(max(given.n, least), "part")
        said = asked.groupBy("part").applyInArrow(there, "via bigint, part int, batches binary, counts binary, reply binary").repartition(hops, "via")
        replies = said.groupBy("via").applyInArrow(back, "part int, batch bigint, reply binary")
    return replies.groupBy("batch").agg(F.collect_list(F.struct("part", "reply")).alias("replies"))


def bits(replies: list[dict] | None, cuts: np.ndarray, width: int = 1) -> np.ndarray:
    """The replies as one array of ``width`` bits for each asked hash; ``cuts`` are those of the outer ranges."""
    out = np.zeros((int(cuts[-1]), width), bool)
    for r in replies or []:
        a, b = cuts[r["part"]], cuts[r["part"] + 1]
        out[a:b] = np.unpackbits(np.frombuffer(r["reply"], np.uint8), count=int(b - a) * width).reshape(-1, width)
    return out if width > 1 else out[:, 0]


def sorted_groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal rows of keys together, and the group number of each row."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    s = keys[order]
    new[1:] = s[1:] != s[:-1]
    group = np.empty(len(keys), np.int64)
    group[order] = np.cumsum(new) - 1
    return order, group
