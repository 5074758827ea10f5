"""Repeated runs of words by fixed-block anchors.

Every document is a reference: its non-overlapping blocks of ``block`` words are indexed by hash. Every
rolling window of ``block`` words probes the index. A window of ``size`` >= 2 * block - 1 words holds a
whole block of the document that it repeats, so wherever no probe hits, nothing repeats. Hits are
extended to all the ``size``-word windows around them; those are compared in full across documents, and
their union is the maximal exact repeats.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from . import arrow
from .exchange import ASK, U64, Batch, Ranges, ask, bits, loaded, posed, ragged, ranges, split, write_batches

_LOW = U64((1 << 30) - 1)
_CLAIM = np.dtype([("key", "<u8"), ("check", "<u8"), ("doc", "<i8")])


class Windows:
    """The words and windows of one batch."""

    def __init__(self, batch: Batch, block: int, size: int):
        self.batch, self.block, self.size = batch, block, size
        self.start, self.end, self.first = arrow.words(batch.data, batch.offsets)
        self.words = arrow.word_hashes(batch.data, self.start, self.end, 8)
        self.probe_at, probes = arrow.windows(self.words, self.first, block)
        self.asked, self.which, self.count = np.unique(probes, return_inverse=True, return_counts=True)

    def questions(self, number: int, given: Ranges) -> Iterator[pa.RecordBatch]:
        """30 bits of each distinct probe, whether it is one of the batch's own blocks, and whether it stands here twice."""
        owner = np.repeat(self.first[:-1], np.diff(self.first))[self.probe_at]
        is_block = np.zeros(len(self.asked), bool)
        is_block[self.which[(self.probe_at - owner) % self.block == 0]] = True
        packed = (((self.asked >> U64(8)) & _LOW) << U64(2)) | (is_block.astype(U64) << U64(1)) | (self.count > 1).astype(U64)
        return posed(number, packed.astype("<u4"), split(self.asked, given.n), given)

    def candidates(self, replies: list[dict] | None, given: Ranges) -> None:
        """Extends the hits to the whole windows around them, distinct ones in the order of their hash."""
        hit = bits(replies, given.outer(split(self.asked, given.n)))[self.which]
        hits = np.zeros(len(self.words) + 1, np.int64)
        hits[self.probe_at[hit] + 1] = 1
        hits = np.cumsum(hits)  # hits at words before i
        counts = np.maximum(np.diff(self.first) - self.size + 1, 0)
        at = ragged(self.first[:-1], counts)
        doc = np.repeat(np.arange(len(counts)), counts)
        near = hits[at + self.size - self.block + 1] > hits[at]
        self.at, self.doc = at[near], doc[near]
        sums = arrow.prefix_sums(self.words)
        key = arrow.mix(arrow.range_hash(sums, self.at, self.at + self.size))
        other = arrow.prefix_sums(arrow.mix(self.words ^ U64(0x5851F42D4C957F2D)))
        self.check = arrow.mix(arrow.range_hash(other, self.at, self.at + self.size))
        # windows are equal if both hashes are: 128 bits
        order = np.lexsort((self.check, key))
        k, c = key[order], self.check[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        self.entry = np.empty(len(k), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.key, self.check = k[new], c[new]
        self.least = np.full(len(self.key), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.entry, self.batch.rank[self.doc])

    def claims(self, number: int, given: Ranges) -> Iterator[pa.RecordBatch]:
        """The distinct candidate windows and the least document of the batch that has each."""
        rows = np.empty(len(self.key), _CLAIM)
        rows["key"], rows["check"], rows["doc"] = self.key, self.check, self.least
        return posed(number, rows, split(self.key, given.n), given)

    def removed(self, replies: list[dict] | None, given: Ranges) -> np.ndarray:
        """Words covered by a window that also starts in a lesser document."""
        elsewhere = bits(replies, given.outer(split(self.key, given.n)))
        gone = elsewhere[self.entry] | (self.batch.rank[self.doc] > self.least[self.entry])
        edge = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(edge, self.at[gone], 1)
        np.add.at(edge, self.at[gone] + self.size, -1)
        return np.cumsum(edge)[:-1] > 0


def _packed(parts: list[np.ndarray], sizes: list[int]) -> list[bytes]:
    cuts = np.cumsum(sizes)[:-1]
    return [np.packbits(x).tobytes() for x in np.split(parts, cuts)]


def _index(questions: list[bytes]) -> list[bytes]:
    """Which probes meet a block somewhere and stand in more than one place."""
    rows = np.frombuffer(b"".join(questions), "<u4")
    sizes = [len(q) // 4 for q in questions]
    key = rows >> 2
    kinds, which, count = np.unique(key, return_inverse=True, return_counts=True)
    block, twice = np.zeros(len(kinds), bool), count > 1
    block[which[(rows & 2) > 0]] = True
    twice[which[(rows & 1) > 0]] = True
    return _packed((block & twice)[which], sizes)


def _lesser(questions: list[bytes]) -> list[bytes]:
    """For each window of each batch: whether a lesser document elsewhere has it."""
    rows = np.frombuffer(b"".join(questions), _CLAIM)
    sizes = [len(q) // 24 for q in questions]
    order = np.lexsort((rows["check"], rows["key"]))
    k, c, d = rows["key"][order], rows["check"][order], rows["doc"][order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    least = np.minimum.reduceat(d, np.flatnonzero(new)) if len(d) else d
    out = np.zeros(len(rows), bool)
    out[order] = least[np.cumsum(new) - 1] < d
    return _packed(out, sizes)


def dedup(docs: DataFrame, size: int = 13, block: int | None = None, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row for each row of docs: (id, n_words, n_removed, kept_sha256), and ``kept`` and ``spans`` (first and end word of each removed
    run) if with_text.

    A word goes if it lies in a run of ``size`` words that also starts in a document of smaller id.
    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; runs lie in one document and are judged on the input. Ids
    are whole numbers; rows without an id stand after all others and not before one another; rows of one
    id don't remove each other's words. A null text is empty, an empty table gives no rows, other columns are
    not read. Texts are read whole; windows are compared by 128 bits of hash.
    """
    block = block or (size + 1) // 2
    if not 1 <= block <= (size + 1) // 2:
        raise ValueError("a window of size words must hold a whole block")
    batches = write_batches(docs, id_col, text_col)
    given = ranges(batches)

    def probe(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, b, _ in loaded(rows):
            yield from Windows(b, block, size).questions(number, given)

    def claim(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, b, more in loaded(rows):
            w = Windows(b, block, size)
            w.candidates(more["replies"], given)
            yield from w.claims(number, given)

    def finish(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, b, more in loaded(rows):
            w = Windows(b, block, size)
            w.candidates(more["replies"], given)
            gone = w.removed(more["lesser"], given)
            total = np.diff(w.first)
            before = np.concatenate([[0], np.cumsum(gone)])
            lost = before[w.first[1:]] - before[w.first[:-1]]
            digests, texts, spans = [], [], []
            for i in range(len(total)):
                words = b.text(i).split()
                own = gone[w.first[i] : w.first[i + 1]]
                if lost[i]:
                    words = [x for x, g in zip(words, own.tolist(), strict=True) if not g]
                kept = b" ".join(words)
                digests.append(sha256(kept).hexdigest())
                if with_text:
                    texts.append(kept.decode())
                    spans.append(np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))).reshape(-1, 2))
            cols = [pa.array(b.ids, mask=~b.known), pa.array(total), pa.array(lost), pa.array(digests, pa.string())]
            if with_text:
                cols += [pa.array(texts, pa.string()), pa.array([s.tolist() for s in spans], pa.list_(pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays(cols, [id_col, "n_words", "n_removed", "kept_sha256", "kept", "spans"][: len(cols)])

    hits = ask(batches.mapInArrow(arrow.trimmed(probe), ASK), _index, given, "<u4")
    with arrow.batches_of(docs.sparkSession, 16):  # of a megabyte each
        hits = materialize(hits, "replies")  # written, being needed twice
    hit = batches.join(hits, "batch", "left")
    lesser = ask(hit.mapInArrow(arrow.trimmed(claim), ASK), _lesser, given, _CLAIM).withColumnRenamed("replies", "lesser")
    schema = f"`{id_col}` bigint, n_words bigint, n_removed bigint, kept_sha256 string" + (", kept string, spans array<array<bigint>>" if with_text else "")
    return hit.join(lesser, "batch", "left").mapInArrow(arrow.trimmed(finish), schema)
