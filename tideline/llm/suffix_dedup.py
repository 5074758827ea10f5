"""Repeated byte strings by suffix sorting.

Every string of ``need`` bytes has an anchor, the first least hash among its ``SEED``-byte windows; equal strings
have equal anchors at equal places. So a string can only repeat if its anchor does, and if the bytes that all
strings of its start range share, the core, do too. Cores that stand once are out. Start ranges that stand
twice as they are repeat as a whole. What is left is where repeats begin and end: there each start range is
sorted among those of its core by external induced suffix sorting, the core being one symbol, and the
common prefix of neighbours tells which strings repeat. A core of very many start ranges is not sorted in one
place: each start of its ranges is dealt by the hash of its string, so equal strings meet and the rest spreads.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from . import arrow
from .exchange import ASK, U64, Batch, Ranges, ask, bits, loaded, posed, ragged, ranges, split, write_batches
from .induced_sort import Files, suffix_array

SEED = 32
_SENT = "part int, batch bigint, question binary, sides binary"
_ANCHOR = np.dtype([("at", "<u4"), ("low", "<u4"), ("hash", "<u8")])
_CORE = np.dtype([("a", "<u8"), ("b", "<u8"), ("c", "<u8")])
#: With the hash of the longer string's core, where passages are told, too.
_CORES = np.dtype([("a", "<u8"), ("b", "<u8"), ("c", "<u8"), ("d", "<u8")])
_PIECE = np.dtype([("a", "<u8"), ("b", "<u8"), ("left", "<i4"), ("right", "<i4"), ("starts", "<i4")])
_START = np.dtype([("a", "<u8"), ("b", "<u8"), ("key", "<u8"), ("left", "<i4")])
#: Shards of the starts of hot cores for each hash range.
SUBSHARDS = 4


def width(need: int) -> int:
    """Starts in a range: the divisor of the anchor's places next to a ninth of them."""
    places = need - SEED + 1
    return min((d for d in range(1, places + 1) if places % d == 0), key=lambda d: abs(d - places / 9)) if places > 9 else 1


def anchors(batch: Batch, length: int) -> bytes:
    """The place and hash of each anchor of the batch's strings of ``length`` bytes, with the first start that it is the anchor of."""
    data, offsets = batch.data, batch.offsets
    counts = np.maximum(np.diff(offsets) - length + 1, 0)
    starts = ragged(offsets[:-1], counts)
    if not len(starts):
        return b""
    sums = arrow.prefix_sums(arrow.symbols(9)[data])
    at = np.arange(len(data) - SEED + 1)
    seeds = arrow.mix(arrow.range_hash(sums, at, at + SEED))
    low_bits = U64(len(data).bit_length())
    key = ((seeds >> low_bits) << low_bits) | at.astype(U64)  # the first of equal ones is the least
    span = length - SEED + 1
    whole = np.concatenate([key, np.full(-len(key) % span, ~U64(0))]).reshape(-1, span)
    before = np.minimum.accumulate(whole, 1).ravel()
    after = np.minimum.accumulate(whole[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(after[starts], before[starts + span - 1])
    own = (least & ((U64(1) << low_bits) - U64(1))).astype(np.int64)
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    out = np.empty(len(first), _ANCHOR)
    out["at"], out["low"], out["hash"] = own[first], starts[first], seeds[own[first]]
    return out.tobytes()


class Asked:
    """The distinct anchors of one batch, as they are asked about."""

    def __init__(self, notes: bytes):
        self.found = np.frombuffer(notes, _ANCHOR)
        self.hash = self.found["hash"].astype(U64)
        self.asked, self.which, self.count = np.unique(self.hash, return_inverse=True, return_counts=True)

    def questions(self, number: int, given: Ranges) -> Iterator[pa.RecordBatch]:
        """31 bits of each distinct anchor, and whether it stands here twice."""
        packed = ((((self.asked >> U64(8)) & U64((1 << 31) - 1)) << U64(1)) | (self.count > 1).astype(U64)).astype("<u4")
        return posed(number, packed, split(self.asked, given.n), given)


class Pieces:
    """The start ranges of one batch whose anchors repeat, for strings of ``need`` bytes and passages of ``least`` <= need bytes."""

    def __init__(self, batch: Batch, notes: bytes, replies: list[dict] | None, given: Ranges, need: int, least: int):
        self.batch, self.need, self.step, self.given = batch, need, min(width(need), 63), given
        asked = Asked(notes)
        keep = np.flatnonzero(bits(replies, given.outer(split(asked.asked, given.n)))[asked.which])
        all_low = asked.found["low"].astype(np.int64)
        doc = np.searchsorted(batch.offsets, all_low[keep], "right") - 1
        ends = batch.offsets[doc + 1]
        at, low = asked.found["at"][keep].astype(np.int64), all_low[keep]
        high = np.minimum(np.append(all_low, len(batch.data))[keep + 1] - 1, ends - least)
        near, far = (at - high) // self.step, (at - low) // self.step
        k = far - near + 1
        owner = np.repeat(np.arange(len(keep)), k)
        bucket = ragged(near, k)
        # the bytes that all strings of a start range share, cut by distance from the anchor
        self.core = at[owner] - self.step * bucket
        self.passage_end, self.core_end = self.core - self.step + 1 + least, self.core - self.step + 1 + need
        self.from_ = np.maximum(low[owner], self.core - self.step + 1)
        last = ends[owner] - need
        self.to = np.minimum(np.minimum(high[owner], self.core), last)  # below from_ if no whole string starts here
        kind = _CORES if least < need else _CORE
        row = np.zeros(len(owner), kind)
        if len(owner):
            sums = self.sums = arrow.prefix_sums(arrow.symbols(9)[batch.data])
            other = self.other = arrow.prefix_sums(arrow.symbols(77)[batch.data])
            salt = arrow.mix(asked.hash[keep][owner] + bucket.astype(U64))
            row["a"] = arrow.mix(arrow.range_hash(sums, self.core, self.passage_end) ^ salt)
            row["b"] = arrow.mix(arrow.range_hash(other, self.core, self.passage_end) + salt)
            whole = np.flatnonzero(self.to >= self.from_)
            x, y, from_ = self.core[whole], self.to[whole], self.from_[whole]
            shape = ((x - from_) * 64 + (y - from_)).astype(U64)
            row["c"][whole] = arrow.mix(arrow.range_hash(sums, from_, y + need) ^ arrow.mix(arrow.range_hash(other, from_, y + need) + shape)) & ~U64(1)
            if least < need:
                row["d"][whole] = arrow.mix(arrow.range_hash(sums, x, self.core_end[whole]) + arrow.mix(arrow.range_hash(other, x, self.core_end[whole]))) | U64(1)
        # equal ranges share an entry
        names = ("a", "b", "d", "c") if least < need else ("a", "b", "c")
        order = np.lexsort([row[x] for x in names[::-1]])
        row = row[order]
        new = np.append(True, np.logical_or.reduce([row[x][1:] != row[x][:-1] for x in names]))[: len(order)]
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.sample = order[new]  # one occurrence of each entry
        self.rows = row[new]
        self.rows["c"] |= (np.bincount(self.entry, minlength=len(self.sample)) > 1).astype(U64)
        self.cuts = split(self.rows["a"], given.n)

    def core_questions(self, number: int) -> Iterator[pa.RecordBatch]:
        return posed(number, self.rows, self.cuts, self.given)

    def told(self, replies: list[dict] | None) -> None:
        """Which entries stand twice as they are, and which this batch sends to be sorted, whole or, of hot cores, start by start."""
        said = bits(replies, self.given.outer(self.cuts), 4)
        self.passage, self.of_core = said[:, 3], self.rows
        if "d" in self.rows.dtype.names:
            self.of_core = np.empty(len(self.rows), _CORE)
            self.of_core["a"], self.of_core["b"] = arrow.mix(self.rows["a"] ^ self.rows["d"]), arrow.mix(self.rows["b"] + self.rows["d"])
        self.twin, self.sent, hot = said[:, 0], np.flatnonzero(said[:, 1] & ~said[:, 2]), np.flatnonzero(said[:, 1] & said[:, 2])
        i = self.sample[hot]
        starts = self.to[i] - self.from_[i] + 1
        at, owner = ragged(self.from_[i], starts), np.repeat(hot, starts)
        a = b = np.zeros(0, U64)
        if len(at):
            a, b = (arrow.mix(arrow.range_hash(x, at, at + self.need)) for x in (self.sums, self.other))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
        which = np.cumsum(new) - 1
        self.start_at, self.start_of = at[order], which  # places of all starts, and which sent one each is equal to
        self.start_twin = np.bincount(which, minlength=new.sum()) > 1
        self.start_sent, self.start_owner, self.start_key = at[order[new]], owner[order[new]], a[new]
        self.start_cuts = split(self.start_key, SUBSHARDS * self.given.n)

    def sendings(self) -> Iterator[tuple[int, bytes, bytes]]:
        """For each range: the sent pieces, and the bytes before and after their cores."""
        cuts = np.searchsorted(self.sent, self.cuts)
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            own = self.sent[cuts[p] : cuts[p + 1]]
            i = self.sample[own]
            rows = np.empty(len(own), _PIECE)
            rows["a"], rows["b"] = self.of_core["a"][own], self.of_core["b"][own]
            rows["left"], rows["right"] = self.core[i] - self.from_[i], self.to[i] + self.need - self.core_end[i]
            rows["starts"] = self.to[i] - self.from_[i] + 1
            sides = np.stack([self.from_[i], self.core_end[i]], 1).ravel()
            sizes = np.stack([rows["left"], rows["right"]], 1).ravel().astype(np.int64)
            yield p, rows.tobytes(), self.batch.data[ragged(sides, sizes)].tobytes()
        for p in np.flatnonzero(np.diff(self.start_cuts)).tolist():
            own = slice(self.start_cuts[p], self.start_cuts[p + 1])
            at, e = self.start_sent[own], self.start_owner[own]
            i = self.sample[e]
            rows = np.empty(len(at), _START)
            rows["a"], rows["b"], rows["key"], rows["left"] = self.of_core["a"][e], self.of_core["b"][e], self.start_key[own], self.core[i] - at
            sides = np.stack([at, self.core_end[i]], 1).ravel()
            sizes = np.stack([self.core[i] - at, at + self.need - self.core_end[i]], 1).ravel()
            yield self.given.n + p, rows.tobytes(), self.batch.data[ragged(sides, sizes)].tobytes()

    def gone(self, replies: list[dict] | None) -> np.ndarray:
        """Bytes covered by a string that also starts elsewhere; ``replies`` have a bit for each start of each sent piece."""
        n = self.given.n
        edge = np.zeros(len(self.batch.data) + 1, np.int64)
        full = self.twin[self.entry] & (self.to >= self.from_)
        np.add.at(edge, self.from_[full], 1)
        np.add.at(edge, self.to[full] + self.need, -1)
        cuts = np.searchsorted(self.sent, self.cuts)
        alike = self.start_twin.copy()
        for r in replies or []:
            if r["part"] >= n:
                lo, hi = self.start_cuts[r["part"] - n], self.start_cuts[r["part"] - n + 1]
                alike[lo:hi] |= np.frombuffer(r["reply"], bool)
                continue
            own = self.sent[cuts[r["part"]] : cuts[r["part"] + 1]]
            mask = np.frombuffer(r["reply"], "<u8")
            for bit in range(self.step):
                s = self.from_[self.sample[own[(mask >> U64(bit)) & U64(1) > 0]]] + bit
                np.add.at(edge, s, 1)
                np.add.at(edge, s + self.need, -1)
        s = self.start_at[alike[self.start_of]]
        np.add.at(edge, s, 1)
        np.add.at(edge, s + self.need, -1)
        return np.cumsum(edge)[:-1] > 0

    def in_passages(self) -> np.ndarray:
        """Bytes of cores of passages that stand in more than one place."""
        edge = np.zeros(len(self.batch.data) + 1, np.int64)
        told = self.passage[self.entry]
        np.add.at(edge, self.core[told], 1)
        np.add.at(edge, self.passage_end[told], -1)
        return np.cumsum(edge)[:-1] > 0


def _repeating(questions: list[bytes]) -> list[bytes]:
    """Which anchors stand in more than one place."""
    rows = np.frombuffer(b"".join(questions), "<u4")
    _, which, count = np.unique(rows >> 1, return_inverse=True, return_counts=True)
    twice = count > 1
    twice[which[(rows & 1) > 0]] = True
    return [np.packbits(x).tobytes() for x in np.split(twice[which], np.cumsum([len(q) // 4 for q in questions])[:-1])]


def _shared(questions: list[bytes], most: int, kind: np.dtype = _CORE) -> list[bytes]:
    """For each entry: whether it stands twice as it is; whether its core has other entries, and this question is the one to send it; whether
    it has more than ``most``; whether its passage's core stands twice.
    """
    rows = np.frombuffer(b"".join(questions), kind)
    multi, c = rows["c"] & U64(1) > 0, rows["c"] & ~U64(1)
    d = rows["d"] if "d" in kind.names else np.ones(len(rows), U64)  # 0: no whole string starts in the range
    order = np.lexsort((c, d, rows["b"], rows["a"]))
    a, b, c, d, multi = rows["a"][order], rows["b"][order], c[order], d[order], multi[order]
    passage = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
    core = passage.copy()
    core[1:] |= d[1:] != d[:-1]
    entry = core.copy()
    entry[1:] |= c[1:] != c[:-1]
    of_passage, of_core, of_entry = np.cumsum(passage) - 1, np.cumsum(core) - 1, np.cumsum(entry) - 1
    twin, told = np.bincount(of_entry) > 1, np.bincount(of_passage) > 1
    twin[of_entry[multi]] = told[of_passage[multi]] = True
    kinds = np.bincount(of_core[entry])
    out = np.zeros((len(rows), 4), bool)
    out[order, 0] = twin[of_entry] & (d > 0)
    out[order, 1] = entry & (kinds[of_core] > 1) & (d > 0)  # the first of equal entries sends
    out[order, 2] = kinds[of_core] > most
    out[order, 3] = told[of_passage]
    cuts = np.cumsum([len(q) // kind.itemsize for q in questions])[:-1]
    return [np.packbits(x).tobytes() for x in np.split(out, cuts)]


def sort_pieces(pieces: np.ndarray, sides: np.ndarray, step: int, most: int) -> np.ndarray:
    """For each piece a bit for each start whose string also starts in another piece.

    Pieces and sides may be mapped from files. Of the pieces the numbers are in memory, of their symbols at most about ``most`` at once.
    """
    cores = np.lexsort((pieces["b"], pieces["a"]))
    a, b = pieces["a"][cores], pieces["b"][cores]
    core = np.empty(len(pieces), np.int64)
    core[cores] = np.cumsum(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]) + 255
    left, right, starts = (pieces[x].astype(np.int64) for x in ("left", "right", "starts"))
    size = left + right + 2
    start = np.cumsum(size) - size
    mask = np.zeros(len(pieces), U64)
    with tempfile.TemporaryDirectory() as folder:
        files = Files(folder, most)
        text = files.new(int(size.sum()))
        side_at = np.cumsum(left + right) - left - right
        lo = 0
        while lo < len(pieces):
            hi = max(lo + 1, int(np.searchsorted(start, start[lo] + most)))
            own = slice(lo, hi)
            base, until = start[lo], start[hi - 1] + size[hi - 1]
            part = np.empty(until - base, np.int64)
            part[start[own] - base + left[own]] = core[own]
            part[start[own] - base + size[own] - 1] = core.max() + 1 + np.arange(lo, hi)  # no two ends are equal
            at = np.stack([start[own] - base, start[own] - base + left[own] + 1], 1).ravel()
            part[ragged(at, np.stack([left[own], right[own]], 1).ravel())] = sides[side_at[lo] : side_at[hi - 1] + left[hi - 1] + right[hi - 1]]
            text[base:until] = part
            lo = hi
        order, common = suffix_array(text, most, folder, cap=step)
        # the common prefix of neighbouring starts is the least of all between them
        before, least = -1, step
        for lo, hi in files.parts(len(order)):
            at, shared = np.asarray(order[lo:hi]), np.asarray(common[lo:hi])
            owner = np.searchsorted(start, at, "right") - 1
            found = np.flatnonzero(at - start[owner] < starts[owner])
            if not len(found):
                least = min(least, int(shared.min()))
                continue
            value = np.minimum.reduceat(shared[: found[-1] + 1], np.append(0, found[:-1] + 1))
            value[0] = min(value[0], least) if before >= 0 else 0
            pairs = np.flatnonzero(value >= step)
            here = at[found]
            hits = np.concatenate([here[pairs], np.append(before, here[:-1])[pairs]])
            piece = np.searchsorted(start, hits, "right") - 1
            np.bitwise_or.at(mask, piece, U64(1) << (hits - start[piece]).astype(U64))
            before, least = int(here[-1]), int(shared[found[-1] + 1 :].min(initial=step))
    return mask


def sort_starts(starts: np.ndarray, sides: np.ndarray, step: int, most: int) -> np.ndarray:
    """For each start of a hot core whether its string starts elsewhere too: about ``most`` symbols at a time, never parting equal keys."""
    order = np.argsort(starts["key"], kind="stable")
    key, sides = starts["key"][order], sides.reshape(len(starts), step - 1)
    found, lo = np.zeros(len(starts), bool), 0
    while lo < len(order):
        hi = min(len(order), lo + max(1, most // (step + 1)))
        hi = int(np.searchsorted(key, key[hi - 1], "right"))
        own = order[lo:hi]
        pieces = np.empty(len(own), _PIECE)
        pieces["a"], pieces["b"], pieces["left"] = starts["a"][own], starts["b"][own], starts["left"][own]
        pieces["right"], pieces["starts"] = step - 1 - pieces["left"], 1
        found[own] = sort_pieces(pieces, sides[own].ravel(), step, most) > 0
        lo = hi
    return found


class Shard:
    """What batches send to one part, kept in files of the task until all of it is there."""

    def __init__(self, part: int):
        self.part, self.batches, self.counts = part, [], []
        self.folder = tempfile.TemporaryDirectory()
        self.files = [open(f"{self.folder.name}/{n}", "w+b") for n in ("rows", "sides")]

    def add(self, batch: int, rows: bytes, sides: bytes, kind: np.dtype) -> None:
        self.batches.append(batch)
        self.counts.append(len(rows) // kind.itemsize)
        for f, x in zip(self.files, (rows, sides), strict=True):
            f.write(x)

    def settled(self, kind: np.dtype, sort, step: int, most: int) -> pa.RecordBatch:
        """(part, batch, reply) for each batch, by sorting what it and the others sent."""
        held = []
        for f, t in zip(self.files, (kind, np.uint8), strict=True):
            f.flush()
            held.append(np.memmap(f, t, "r") if f.tell() else np.zeros(0, t))
        mask = sort(*held, step, most)
        replies = [m.tobytes() for m in np.split(mask, np.cumsum(self.counts)[:-1])]
        n = len(replies)
        out = pa.RecordBatch.from_arrays([pa.array([self.part] * n, pa.int32()), pa.array(self.batches, pa.int64()), pa.array(replies, pa.binary())], ["part", "batch", "reply"])
        for f in self.files:
            f.close()
        self.folder.cleanup()
        return out


def dedup(
    docs: DataFrame, need: int = 400, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, passage: int | None = None,
    sorted_at_once: int = 1 << 19, hot: int = 1 << 13,
) -> DataFrame:
    """One row for each row of docs: (id, n_bytes, n_removed, n_spans, kept_sha256), with ``passage`` n_passage, and if with_text ``kept``
    (binary), ``kept_text`` (the same without the halves of characters that a cut may leave) and ``spans`` (first and end byte).

    A byte of a text's UTF-8 goes if it lies in a string of ``need`` bytes that starts anywhere else as well, in the same text
    or another; every copy goes. ``n_passage`` tells shorter repeats, which stay: the bytes of passages' cores that stand in more than one
    place. Each string of ``passage``
    bytes that starts anywhere else has a core of at least passage - width(need) + 1 bytes, so none of that length is missed and none
    shorter than its core counts. Strings lie in one text and are judged on the input. Ids are whole numbers or
    null and play no part, so repeated rows remove each other; a null text is empty; an empty table gives no rows;
    other columns are not read. Texts are read whole. A core of more than ``hot`` start ranges is sorted start by start. Cores, start ranges
    that stand twice as they are, and starts of hot cores that stand twice in a batch are compared by 128 bits of hash, the rest by its bytes.
    """
    least = need if passage is None else passage
    step = min(width(need), 63)
    if least > need or least - step + 1 < SEED or need <= SEED:
        raise ValueError(f"need is more than {SEED} bytes, and a passage is no longer than that and has a core of {SEED} bytes")
    batches = write_batches(docs, id_col, text_col, notes=partial(anchors, length=least))
    given, kind = ranges(batches), _CORES if least < need else _CORE

    def first(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for number, notes in zip(b.column("batch").to_pylist(), b.column("notes").to_pylist(), strict=True):
                yield from Asked(notes).questions(number, given)

    def second(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, b, more in loaded(rows):
            yield from Pieces(b, more["notes"], more["anchors"], given, need, least).core_questions(number)

    def third(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, b, more in loaded(rows):
            x = Pieces(b, more["notes"], more["anchors"], given, need, least)
            x.told(more["cores"])
            for p, q, s in x.sendings():
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([number], pa.int64()), pa.array([q], pa.binary()), pa.array([s], pa.binary())], ["part", "batch", "question", "sides"])

    def settle(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts come one after the other."""
        shard = None
        how = lambda part: (_PIECE, sort_pieces) if part < given.n else (_START, sort_starts)
        for b in rows:
            for part, number, question, sides in zip(*[b.column(x).to_pylist() for x in ("part", "batch", "question", "sides")], strict=True):
                if shard is not None and shard.part != part:
                    yield shard.settled(*how(shard.part), step, sorted_at_once)
                    shard = None
                shard = shard or Shard(part)
                shard.add(number, question, sides, how(part)[0])
        if shard is not None:
            yield shard.settled(*how(shard.part), step, sorted_at_once)

    def finish(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, b, more in loaded(rows):
            x = Pieces(b, more["notes"], more["anchors"], given, need, least)
            x.told(more["cores"])
            gone = x.gone(more["repeats"])
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            inner = b.offsets[(b.offsets > 0) & (b.offsets < len(gone))]
            begins[inner] = gone[inner]
            count = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[b.offsets])
            lost = count(gone)
            digests, texts, spans = [], [], []
            for i in range(len(b.ids)):
                text = b.data[b.offsets[i] : b.offsets[i + 1]]
                own = gone[b.offsets[i] : b.offsets[i + 1]]
                kept = (text[~own] if lost[i] else text).tobytes()
                digests.append(sha256(kept).hexdigest())
                if with_text:
                    texts.append(kept)
                    spans.append(np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))).reshape(-1, 2).tolist())
            cols = [pa.array(b.ids, mask=~b.known), pa.array(np.diff(b.offsets)), pa.array(lost), pa.array(count(begins)), pa.array(digests, pa.string())]
            if passage:
                cols += [pa.array(count(x.in_passages()))]
            if with_text:
                cols += [pa.array(texts, pa.binary()), pa.array([t.decode(errors="ignore") for t in texts], pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays(cols, list(fields))

    def replied(to: DataFrame, replies: DataFrame, name: str) -> DataFrame:
        with arrow.batches_of(docs.sparkSession, 16):  # of a megabyte each
            held = materialize(replies, name)
        return to.join(held.withColumnRenamed("replies", name), "batch", "left")

    fields = {id_col: "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}
    fields |= {"n_passage": "bigint"} if passage else {}
    fields |= {"kept": "binary", "kept_text": "string", "spans": "array<array<bigint>>"} if with_text else {}
    known = replied(batches, ask(batches.select("batch", "notes").mapInArrow(arrow.trimmed(first), ASK), _repeating, given, "<u4"), "anchors")
    known = replied(known, ask(known.mapInArrow(arrow.trimmed(second), ASK), partial(_shared, most=hot, kind=kind), given, kind, 4), "cores")
    sent = known.mapInArrow(arrow.trimmed(third), _SENT).repartition(max(given.n, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "part").sortWithinPartitions("part")
    settled = sent.mapInArrow(arrow.trimmed(settle), "part int, batch bigint, reply binary").groupBy("batch").agg(F.collect_list(F.struct("part", "reply")).alias("replies"))
    return replied(known, settled, "repeats").mapInArrow(arrow.trimmed(finish), ", ".join(f"`{name}` {kind_}" for name, kind_ in fields.items()))


def without_repeats(docs: DataFrame, need: int = 400, text_col: str = "text") -> DataFrame:
    """docs with the kept part of each text by the rules of dedup(), without the halves of characters that a cut may leave.

    A null text stays null and an empty one empty, repeated rows lose all that they share, an empty table gives an empty one, and other
    columns stay as they are whatever those are called.
    """
    key, there = "_row", "_there"
    while {key, there} & {*docs.columns}:
        key, there = key + "_", there + "_"
    held = materialize(docs.withColumns({key: F.monotonically_increasing_id(), there: F.col(text_col).isNotNull()}), "rows")
    kept = dedup(held, need, key, text_col).select(F.col(key).alias("kept_key"), F.col("kept_text").alias("kept_part"))
    rest = held.select(F.struct(*[c for c in held.columns if c != text_col]).alias("r"))
    out = rest.join(kept, F.col("r")[key] == F.col("kept_key"))
    return out.select(*[F.when(F.col("r")[there], F.col("kept_part")).alias(c) if c == text_col else F.col("r")[c].alias(c) for c in docs.columns])
