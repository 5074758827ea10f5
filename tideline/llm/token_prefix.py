"""Exact token counts of every prefix by dynamic programming.

For byte-pair merging, the encoding of a prefix is the encoding of a shorter prefix followed by
one piece. That piece is the only one that ends there, whose own encoding is itself, and which
stays apart from the last piece of the shorter prefix when the two are encoded together. So a
table of (last piece, count) for each prefix follows from the tables before it, and answers
how many tokens any truncation has without encoding it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrow

SPACE = "▁"
#: Texts that a model with any normalisation of its own spells otherwise: ligatures, wide letters, marks apart, odd and repeated spaces.
PROBES = ("x", " ﬁ Ａ e\u0301  x\ty\n\n z ", "½²\u00a0\u3000Å\u212b", "  ", "\u200b.\ufeff")
_RUN = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class PrefixCounter:
    """Counts for one sentencepiece byte-pair model with byte fallback, as its ``encode`` gives them."""

    #: Segments that the two caches keep; beyond it they start anew.
    CACHED = 400_000

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self._check(sp)
        self.scores = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        self.plain_newline = not any("\n" in p for p in self.scores)
        if any(SPACE in p.lstrip(SPACE) for p in self.scores):
            raise ValueError("pieces cross words; segments are not independent")
        #: Pieces that are their own encoding; no other piece can be the last of a prefix.
        self.whole = {p for p in self.scores if self.merge(p) == [p]}
        lengths: dict[str, set[int]] = {}
        for p in self.whole:
            lengths.setdefault(p[-2:] if len(p) > 1 else p, set()).add(len(p))
        #: By the last two characters (or the only one), the lengths of pieces that end so, long ones first.
        self.lengths = {k: tuple(sorted(v | (lengths.get(k[-1], set()) if len(k) > 1 else set()), reverse=True)) for k, v in lengths.items()}
        self.apart: dict[tuple[str, str], bool] = {}
        self.spaced: dict[str, int] = {}
        self.bare: dict[str, int] = {}

    @staticmethod
    def _check(sp) -> None:
        """Reject a model that changes texts before it splits them, or does not put one space before them."""
        for text in PROBES:
            spelt = b"".join(bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.encode() for p in sp.encode(text, out_type=str))
            if spelt.decode() != SPACE + text.replace(" ", SPACE):
                raise ValueError("the model normalises its texts; counts would not be those of the library")

    def merge(self, text: str) -> list[str]:
        """Plain byte-pair merging of a short text: best score first, leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _apart(self, a: str, b: str) -> bool:
        """Whether the pieces stay two when they are encoded together."""
        if len(self.apart) > 1_000_000:
            self.apart.clear()
        got = self.apart[a, b] = self.merge(a + b) == [a, b]
        return got

    def table(self, segment: str) -> list[int]:
        """Tokens of each prefix of a segment, the empty one first."""
        counts, last = [0], [""]
        whole, lengths, apart = self.whole, self.lengths, self.apart
        for end in range(1, len(segment) + 1):
            for n in lengths.get(segment[end - 2 : end]) or lengths.get(segment[end - 1], ()) if end > 1 else lengths.get(segment[0], ()):
                start = end - n
                if start < 0:
                    continue
                piece = segment[start:end]
                if piece in whole:
                    if start:
                        ok = apart.get((last[start], piece))
                        if ok is None:
                            ok = self._apart(last[start], piece)
                        if not ok:
                            continue
                    counts.append(counts[start] + 1)
                    last.append(piece)
                    break
            else:
                char = segment[end - 1]
                counts.append(counts[-1] + len(char.encode()))  # one token for each byte
                last.append(char)
        return counts

    def _count(self, cache: dict[str, int], key: str, segment: str) -> int:
        if len(key) > 64:
            return self.table(segment)[-1]
        if len(cache) >= self.CACHED:
            cache.clear()
        stem = cache.get(key[:-1]) if len(key) > 2 else None
        if stem is not None and segment[-2:] not in self.lengths and segment[-1] in self.whole:
            got = stem + 1  # only the last character itself can end here, so the table goes on by one
        else:
            got = self.table(segment)[-1]
        cache[key] = got
        return got

    def count(self, text: str) -> int:
        """Tokens of the whole text."""
        if not text:
            return 0
        if not self.plain_newline or SPACE in text:
            return sum(self.table(s)[-1] for s in self.segments(text))
        spaced, bare = self.spaced, self.bare
        lines = text.split("\n")
        total = len(lines) - 1
        for k, line in enumerate(lines):
            parts = line.split(" ")
            if "" in parts:
                line = line.replace(" ", SPACE)
                for s in _RUN.findall(line if k else SPACE + line):
                    got = bare.get(s)
                    total += self._count(bare, s, s) if got is None else got
                continue
            if k:
                s = parts.pop(0)
                got = bare.get(s)
                total += self._count(bare, s, s) if got is None else got
            try:
                total += sum(map(spaced.__getitem__, parts))
            except KeyError:
                for s in parts:
                    got = spaced.get(s)
                    if got is None:
                        if s[-1] in ".,!?;:" and len(s) > 1 and s[:-1] not in spaced:
                            self._count(spaced, s[:-1], SPACE + s[:-1])
                        got = self._count(spaced, s, SPACE + s)
                    total += got
        return total

    def segments(self, text: str) -> list[str]:
        """Runs that are encoded on their own; joined they are the text as the model sees it."""
        if not text:
            return []
        runs = _RUN.findall(SPACE + text.replace(" ", SPACE))
        return [x for r in runs for x in re.split("(\n)", r) if x] if self.plain_newline else runs

    def prefix_counts(self, text: str) -> np.ndarray:
        """Tokens of text[:i] for i = 0 .. len(text)."""
        out, total = [0], 0
        for k, s in enumerate(self.segments(text)):
            t = self.table(s)
            out.extend(total + c for c in t[1:])
            total += t[-1]
            if k == 0:
                del out[1]  # the space that the model puts before every text is no prefix of it
        return np.array(out if text else [0], np.int32)

    def fit(self, text: str, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens."""
        return int(np.flatnonzero(self.prefix_counts(text) <= budget)[-1])


_counters: dict[str, PrefixCounter] = {}


def counter(model: str) -> PrefixCounter:
    if model not in _counters:
        _counters[model] = PrefixCounter(model)
    return _counters[model]


def count_tokens(
    docs: DataFrame, model: str, limit: int, id_col: str = "doc_id", text_col: str = "text", tables: bool = False,
    budgets: tuple[int, ...] = (),
) -> DataFrame:
    """One row for each row of docs: (id, n_bytes, n_tokens, over_limit), with ``prefix_tokens``
    (tokens of every prefix, by character) if tables, and ``fits`` (for each of ``budgets``
    the characters of the longest prefix within it).

    A null text counts as empty: no bytes, no tokens. A null id stays null, repeated rows stay
    repeated, an empty table gives none, and other columns are not read. Needs no shuffle; a
    text of any length is counted whole.
    """
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    if tables:
        fields.append(T.StructField("prefix_tokens", T.ArrayType(T.IntegerType())))
    if budgets:
        fields.append(T.StructField("fits", T.ArrayType(T.IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model)
        for b in batches:
            n = [c.count(t) if t else 0 for t in (x.as_py() for x in b.column(1))]
            size = [x or 0 for x in b.column(2).to_pylist()]
            cols = [b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            if tables or budgets:
                got = [c.prefix_counts(t or "") for t in b.column(1).to_pylist()]
                if tables:
                    cols.append(pa.array(got, pa.list_(pa.int32())))
                if budgets:
                    cols.append(pa.array([[int(np.flatnonzero(g <= x)[-1]) for x in budgets] for g in got], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in fields])

    return docs.select(F.col(id_col), F.col(text_col), F.octet_length(text_col).cast("bigint").alias("_bytes")).mapInArrow(arrow.trimmed(run), T.StructType(fields))
