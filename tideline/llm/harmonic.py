"""Harmonic packing of token sequences.

A piece of length l belongs to the reciprocal-capacity class k = capacity // l, and a bin of class k
holds exactly k pieces. No bin looks at another one, so each worker packs its own documents and
nothing is shuffled. Documents are cut where a class is filled to the brim: whole bins first, then
the largest share 1/k of a bin that fits, so a full bin leaves less than k tokens empty.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrow


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else the next from 256 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (chr(256 + i) for i in range(256))
    return [chr(b) if b in prints else next(rest) for b in range(256)]


class _Ids(dict):
    """Ids of runs without white space; an unknown run is encoded when it is asked for."""

    def __init__(self, model, cached: int):
        super().__init__()
        self.whole, self.pieces, self.cached = model, model.model, cached
        self.letters = dict(enumerate(_byte_letters()))

    def __missing__(self, run: str) -> bytes:
        if len(self) >= self.cached:
            self.clear()
        latin = max(run) < "ɐ" and "İ" not in run
        low = run.lower() if latin else run  # the model lowers case; these letters do so one by one
        if latin and low.isalpha():
            spelt = low if low.isascii() else low.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.pieces.tokenize(spelt)]  # letters are one pre-token
            got = np.array(ids, "<u4").tobytes()
        elif latin and low[-1] in ".,!?;:" and low[:-1].isalpha():
            got = self[low[:-1]] + self[low[-1]]  # letters and marks are never merged
        else:
            got = np.array(self.whole.encode(run, add_special_tokens=False).ids, "<u4").tobytes()
        if len(run) <= 64:
            self[run] = got
        return got


#: How a model that lowers case and drops white space says so in its file.
LOWERS = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITS = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}


def drops_space(spec: dict) -> bool:
    """Whether runs without white space are encoded on their own, letters by themselves and in lower case, as _Ids takes it."""
    before = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    bytewise = len(before) == 2 and before[1].get("type") == "ByteLevel" and not before[1].get("add_prefix_space") and not before[1].get("use_regex")
    special = [t for t in spec.get("added_tokens") or [] if any(c.isspace() for c in t["content"]) or t.get("normalized") or t.get("lstrip") or t.get("rstrip")]
    return spec.get("normalizer") == LOWERS and before[0] == SPLITS and bytewise and not special and not spec.get("post_processor") and not spec.get("truncation")


class WordEncoder:
    """Token ids (as little-endian unsigned 32-bit bytes) of a tokenizers model.

    Where the model's file says that it drops white space, that separates what the model encodes, so the ids of a text are those of its runs
    without white space, each looked up in a bounded memory. With any other file the model encodes whole texts.
    """

    def __init__(self, path: str, cached: int = 500_000):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.model = Tokenizer.from_file(path)
        self.by_run = drops_space(json.loads(self.model.to_str()))
        self.ids = _Ids(self.model, cached)

    def encode(self, text: str) -> bytes:
        if not self.by_run or any(c in text for c in "\x1c\x1d\x1e\x1f\x85"):  # Python splits there, the model's pattern does not everywhere
            return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.ids.__getitem__, text.split()))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class Packer:
    """The bins of one worker. ``place`` takes (piece, length) and gives back what has got its place."""

    def __init__(self, capacity: int, smallest: int, first_sequence: int):
        self.capacity, self.next = capacity, first_sequence
        self.shares = [capacity // k for k in range(1, capacity // smallest + 1)]
        self.open: dict[int, list[tuple]] = {}

    def cut(self, n: int) -> list[int]:
        """Lengths of the pieces of a document of n tokens."""
        out = [self.capacity] * (n // self.capacity)
        rest = n % self.capacity
        while rest:
            k = self.capacity // rest  # its class
            share = self.capacity // k
            if k > len(self.shares) or share - rest <= share // 32:
                out.append(rest)  # it nearly fills its share, or is a small tail
                break
            size = self.capacity // (k + 1)
            if k + 1 > len(self.shares):
                out.append(rest)
                break
            out.append(size)
            rest -= size
        return out

    def _close(self, bin_: list[tuple]) -> list[tuple]:
        out, offset = [], 0
        for piece, length in bin_:
            out.append((piece, self.next, offset))
            offset += length
        self.next += 1
        return out

    def place(self, piece, length: int) -> list[tuple]:
        k = self.capacity // length
        got = self.open.setdefault(k, [])
        got.append((piece, length))
        if len(got) < k:
            return []
        del self.open[k]
        return self._close(got)

    def finish(self) -> list[tuple]:
        """Packs what the unfilled bins hold, at most k - 1 pieces of each class, best fit by falling length."""
        rest = sorted((x for b in self.open.values() for x in b), key=lambda x: -x[1])
        self.open = {}
        bins: list[list] = []
        for x in rest:
            best = None
            for b in bins:
                if b[0] >= x[1] and (best is None or b[0] < best[0]):
                    best = b
            if best is None:
                bins.append(best := [self.capacity, []])
            best[0] -= x[1]
            best[1].append(x)
        return [y for b in bins for y in self._close(b[1])]


def pack(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, smallest: int = 64, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """One row for each piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset), and its ``ids`` if with_ids.

    A document is the ids of its text and ``end_id``; a null text is empty and so becomes the one id.
    Each id lies in exactly one piece, and the pieces of a sequence follow one another without a gap
    from offset 0 up to at most ``capacity``. A null id stays null, repeated rows are packed each on
    their own, an empty table gives no piece, and other columns are not read. A sequence number is
    the partition's number above 40 bits and the bin's below, so a task that runs again
    makes the same rows. Memory is one batch of texts, the encoder's bounded memory and the open bins.
    """
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), *[T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))
    kinds = [None, *[pa.int64()] * 6, *[pa.list_(pa.int64())] * with_ids]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        packer = Packer(capacity, smallest, TaskContext.get().partitionId() << 40)
        kind = None

        def rows(placed: list[tuple]) -> pa.RecordBatch:
            cols = [[p[i] for p, _, _ in placed] for i in range(5)] + [[s for _, s, _ in placed], [o for _, _, o in placed]]
            if with_ids:
                cols.append([np.frombuffer(p[5], "<u4").astype(np.int64) for p, _, _ in placed])
            return pa.RecordBatch.from_arrays([pa.array(c, k or kind) for c, k in zip(cols, kinds, strict=True)], [f.name for f in fields])

        for b in batches:
            kind = b.column(0).type
            placed: list[tuple] = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = words.encode(text.as_py() or "") + end
                n, start = len(ids) // 4, 0
                for length in packer.cut(n):
                    own = ids[4 * start : 4 * (start + length)]
                    placed += packer.place((key, start, length, zlib.crc32(own), n, *((own,) if with_ids else ())), length)
                    start += length
                if len(placed) >= 20_000:
                    yield rows(placed)
                    placed = []
            if placed:
                yield rows(placed)
        placed = packer.finish()
        if placed:
            yield rows(placed)
        words.ids.clear()  # a worker that stays for other tasks would keep a hundred megabytes

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(arrow.trimmed(run), T.StructType(fields))
