"""External induced suffix sorting.

A text of whole numbers is sorted by its leftmost S-type suffixes: their substrings are named, the string
of names is sorted by recursion, and two induction passes bring in the L-type and then the S-type
suffixes. A pass pulls tuples (symbol, order of the inducing suffix, position, common prefix) off a priority
queue and pushes those of the preceding positions. Queue and passes work in bulk, one range of symbols at a
time: a range is as large as memory allows, and tuples of later ranges wait in sorted runs on disk. A symbol of more suffixes than that is
worked off in blocks, first come first served. Text, types, names, orders and common prefixes are mapped from files
beyond that size, and substrings too many to be named in memory are put in order by two passes of their own.

A tuple's common prefix is that of its inducing suffix and of the one that induced the tuple before it with
its symbol; a suffix that is induced shares one symbol more. Where both inducing suffixes lie in the
range at hand, it is the least common prefix between them. Recursion gives the first ones, in
names, which are turned to symbols.
"""

from __future__ import annotations

import os
import tempfile
from bisect import bisect_left, bisect_right
from collections.abc import Callable

import numpy as np

_TUPLE = np.dtype([("symbol", "<i8"), ("order", "<i8"), ("at", "<i8"), ("common", "<i8")])

Wanted = Callable[[np.ndarray], np.ndarray]


class Files:
    """Arrays of one sort: in memory up to ``held`` entries, else mapped from files in ``folder`` that go with the array."""

    def __init__(self, folder: str, held: int):
        self.folder, self.held = folder, held

    def new(self, n: int, kind: type | str = np.int64) -> np.ndarray:
        """An array of zeros."""
        if n <= self.held:
            return np.zeros(n, kind)
        handle, path = tempfile.mkstemp(dir=self.folder)
        os.close(handle)
        out = np.memmap(path, kind, "w+", shape=(n,))
        os.unlink(path)  # the mapping keeps it
        return out

    def parts(self, n: int) -> list[tuple[int, int]]:
        return [(a, min(n, a + self.held)) for a in range(0, n, self.held)]


class DiskQueue:
    """A priority queue of tuples with bulk pushes and pops; beyond ``files.held`` tuples it writes sorted runs.

    Orders grow from push to push, so of one symbol the tuples of an earlier run come first.
    """

    def __init__(self, files: Files):
        self.files = files
        self.fresh: list[np.ndarray] = []
        self.count = 0
        self.runs: list[list] = []  # [rows, place]

    def push(self, symbol: np.ndarray, order: np.ndarray, at: np.ndarray, common: np.ndarray | int) -> None:
        rows = np.empty(len(at), _TUPLE)
        rows["symbol"], rows["order"], rows["at"], rows["common"] = symbol, order, at, common
        self.fresh.append(rows)
        self.count += len(rows)
        if self.count > self.files.held:
            rows = self._sorted(np.concatenate(self.fresh))
            run = self.files.new(len(rows), _TUPLE)
            run[:] = rows
            self.runs.append([run, 0])
            self.fresh, self.count = [], 0

    @staticmethod
    def _sorted(rows: np.ndarray) -> np.ndarray:
        return rows[np.lexsort((rows["order"], rows["symbol"]))]

    def pop_below(self, symbol: int) -> np.ndarray:
        """All tuples whose symbol is below, sorted by symbol and order."""
        out = []
        for run in self.runs:
            rows, place = run
            run[1] = bisect_left(range(len(rows)), symbol, lo=place, key=lambda i, rows=rows: rows[i]["symbol"])
            out.append(np.array(rows[place : run[1]]))
        self.runs = [r for r in self.runs if r[1] < len(r[0])]
        if self.fresh:
            rows = np.concatenate(self.fresh)
            low = rows["symbol"] < symbol
            out.append(rows[low])
            self.fresh, self.count = [rows[~low]], int((~low).sum())
        return self._sorted(np.concatenate(out)) if out else np.empty(0, _TUPLE)

    def pop_first(self, symbol: int) -> np.ndarray:
        """The first tuples of ``symbol``, below which nothing is left, as many as memory is to hold."""
        out, room = [], self.files.held
        for run in self.runs:
            rows, place = run
            end = bisect_right(range(len(rows)), symbol, lo=place, key=lambda i, rows=rows: rows[i]["symbol"])
            run[1] = min(end, place + room)
            out.append(np.array(rows[place : run[1]]))
            room -= run[1] - place
            if not room:
                break
        self.runs = [r for r in self.runs if r[1] < len(r[0])]
        if room and self.fresh:
            rows = np.concatenate(self.fresh)
            own = np.flatnonzero(rows["symbol"] == symbol)
            own = own[np.argsort(rows["order"][own], kind="stable")][:room]
            out.append(rows[own])
            rest = np.ones(len(rows), bool)
            rest[own] = False
            self.fresh, self.count = [rows[rest]], int(rest.sum())
        return np.concatenate(out) if out else np.empty(0, _TUPLE)


class _Least:
    """The least of values[a..b], ends included, for many a and b."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty(len(a), np.int64)
        level = np.frexp((b - a + 1).astype(float))[1] - 1
        for k in np.unique(level):
            own = level == k
            out[own] = np.minimum(self.levels[k][a[own]], self.levels[k][b[own] - (1 << int(k)) + 1])
        return out


def _commons(symbol: np.ndarray, kind: np.ndarray, carried: np.ndarray, given: np.ndarray, runs: np.ndarray, source: np.ndarray, cap: int) -> np.ndarray:
    """The common prefix of each suffix of a sorted range with the one before it."""
    out = np.zeros(len(symbol), np.uint16)
    here = np.flatnonzero(symbol[1:] == symbol[:-1]) + 1
    now, before = kind[here], kind[here - 1]
    value = np.where(now == 0, 1 + carried[here], np.where(now == 1, 1, np.where(before == 2, given[here], np.minimum(runs[here], runs[here - 1]))))
    out[here] = np.minimum(value, cap)
    inner = here[(now == 1) & (before == 1)]
    out[inner] = cap
    while len(inner):  # from above; each turn settles one more step of the chains
        found = np.minimum(1 + _Least(out)(source[inner - 1] + 1, source[inner]), cap)
        if np.array_equal(found, out[inner]):
            break
        out[inner] = found
    return out


def _ranges(counts: np.ndarray, files: Files) -> list[tuple[int, bool]]:
    """(end, hot) of symbol ranges that hold about ``held`` suffixes each; a symbol with more of them is hot and a range of its own."""
    out: list[tuple[int, bool]] = []
    base, open_, open_group, open_hot = 0, None, None, False
    for a, b in files.parts(len(counts)):
        kinds = np.flatnonzero(counts[a:b])
        if not len(kinds):
            continue
        own = np.asarray(counts[a:b][kinds])
        group = (base + np.cumsum(own) - own) // files.held
        hot = own > files.held
        base += int(own.sum())
        if open_ is not None and (group[0] != open_group or hot[0] or open_hot):
            out.append((open_, open_hot))
        last = np.flatnonzero((group[1:] != group[:-1]) | hot[1:] | hot[:-1])
        out += [(int(a + kinds[i]) + 1, bool(hot[i])) for i in last]
        open_, open_group, open_hot = int(a + kinds[-1]) + 1, group[-1], bool(hot[-1])
    return out + ([(open_, open_hot)] if open_ is not None else [])


class _Since:
    """For each symbol before a suffix of a hot one: the least common prefix since it stood there last."""

    def __init__(self, cap: int):
        self.cap, self.least = cap, {}

    def __call__(self, symbols: np.ndarray, first: np.ndarray, last: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """What the first of each of ``symbols`` in the block carries; their places are first and last."""
        before = np.minimum.accumulate(shared)
        after = np.append(np.minimum.accumulate(shared[::-1])[::-1][1:], self.cap)
        whole = int(before[-1])
        carried = [min(self.least[s], int(before[f])) if s in self.least else 0 for s, f in zip(symbols.tolist(), first.tolist(), strict=True)]
        self.least = {s: min(x, whole) for s, x in self.least.items()}
        self.least.update(zip(symbols.tolist(), after[last].tolist(), strict=True))
        return np.array(carried, np.int64)


def _induce(
    text: np.ndarray, top: int, seeds: np.ndarray, given: np.ndarray, wanted: Wanted, runs: np.ndarray, files: Files, cap: int,
) -> tuple[np.ndarray, np.ndarray]:
    """Positions of seeds and wanted suffixes in suffix order with their common prefixes, from those of the seeds.

    A wanted suffix precedes the one that induces it, and its symbol is not below that one's; before seeds of its own symbol it comes first.
    """
    queue, counts, total = DiskQueue(files), files.new(top + 1), len(seeds)
    for a, b in files.parts(len(seeds)):
        s, c = np.unique(text[seeds[a:b]], return_counts=True)
        counts[s] += c
    for a, b in files.parts(len(text)):
        s, c = np.unique(text[a:b][wanted(np.arange(a, b))], return_counts=True)
        counts[s] += c
        total += int(c.sum())
    out, commons, done, used = files.new(total), files.new(total, np.uint16), 0, 0

    def place(at: np.ndarray, shared: np.ndarray, limit: int, since: _Since | None = None) -> None:
        """Writes sorted suffixes and pushes what they induce from ``limit`` on."""
        nonlocal done
        prior = at - 1
        ahead = np.flatnonzero((prior >= 0) & wanted(prior) & (text[prior] >= limit))
        symbol = text[prior[ahead]]
        by = np.argsort(symbol, kind="stable")
        carried = np.zeros(len(ahead), np.int64)
        a, b = ahead[by[:-1]], ahead[by[1:]]
        alike = np.flatnonzero(symbol[by[:-1]] == symbol[by[1:]])
        if len(alike):
            carried[by[alike + 1]] = _Least(shared)(a[alike] + 1, b[alike])
        if since is not None:
            new = np.append(True, symbol[by[1:]] != symbol[by[:-1]])[: len(by)]
            heads = by[new]
            tails = by[np.append(new[1:], True)[: len(by)]]
            carried[heads] = since(symbol[heads], ahead[heads], ahead[tails], shared)
        queue.push(symbol, done + ahead, prior[ahead], carried)
        out[done : done + len(at)] = at
        commons[done : done + len(at)] = shared
        done += len(at)

    for end, hot in _ranges(counts, files):
        if hot:
            symbol, since, last = end - 1, _Since(cap), None
            while len(rows := queue.pop_first(symbol)):
                shared = np.minimum(1 + rows["common"], cap).astype(np.uint16)
                if last is None:
                    shared[0] = 0
                last = rows["at"][-1]
                place(rows["at"].copy(), shared, symbol, since)
            seeds_from = used
            while used < len(seeds):
                own = np.asarray(seeds[used : used + files.held])
                own = own[: int(np.searchsorted(text[own], end))]
                if not len(own):
                    break
                shared = np.minimum(given[used : used + len(own)], cap).astype(np.uint16)
                if used == seeds_from:
                    shared[0] = 0 if last is None else min(runs[own[0]], runs[last], cap)
                used += len(own)
                place(own, shared, symbol, since)
            continue
        rows = queue.pop_below(end)
        upto = bisect_left(range(len(seeds)), end, lo=used, key=lambda i: text[seeds[i]])
        own = np.asarray(seeds[used:upto])
        at = [rows["at"], own]
        # within a symbol: suffixes induced from outside, then from inside, then seeds
        order = [rows["order"], np.arange(used, upto)]
        common = [rows["common"], np.asarray(given[used:upto], np.int64)]
        source = [np.full(len(rows) + len(own), -1)]
        kind = [np.zeros(len(rows), np.int64), np.full(len(own), 2)]
        used = upto
        front, base = np.concatenate(at), 0
        while len(front):
            prior = front - 1
            inside = np.flatnonzero((prior >= 0) & wanted(prior) & (text[prior] < end))
            at.append(prior[inside])
            source.append(base + inside)
            order.append(np.zeros(len(inside), np.int64))
            common.append(order[-1])
            kind.append(np.ones(len(inside), np.int64))
            base, front = base + len(front), prior[inside]
        at, order, source, kind, common = (np.concatenate(x) for x in (at, order, source, kind, common))
        first = text[at] * 3 + kind
        within = source >= 0
        rank = np.zeros(len(at), np.int64)
        while True:  # each turn settles the suffixes one more step away from what is known
            before = rank
            sequence = np.lexsort((order, first))
            rank = np.empty(len(at), np.int64)
            rank[sequence] = np.arange(len(at))
            if not within.any() or np.array_equal(rank, before):
                break
            order[within] = rank[source[within]]
        back = np.where(within, rank[source], -1)[sequence]
        at, kind, common = at[sequence], kind[sequence], common[sequence]
        place(at, _commons(text[at], kind, common, common, runs[at], back, cap), end)
    return out, commons


def _types(text: np.ndarray, files: Files, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is less than the one after it, and the length of the run of its symbol that it starts with, and one more."""
    n = len(text)
    small, runs = files.new(n, bool), files.new(n, np.uint16)
    small[n - 1], runs[n - 1] = True, 1
    for a, b in reversed(files.parts(n - 1)):
        t = np.asarray(text[a : b + 1])
        differs = np.append(np.flatnonzero(t[:-1] != t[1:]), b - a)
        nxt = differs[np.searchsorted(differs, np.arange(b - a))]
        here, at = nxt < b - a, np.minimum(nxt, b - a - 1)
        small[a:b] = np.where(here, t[at] < t[at + 1], small[b])
        runs[a:b] = np.minimum(nxt - np.arange(b - a) + np.where(here, 1, int(runs[b])), cap)
    return small, runs


def _starts(small: np.ndarray, files: Files) -> np.ndarray:
    """The leftmost of S-type suffixes that follow each other, without the first suffix of all."""
    found = lambda a, b: np.flatnonzero(small[a + 1 : b + 1] & ~small[a:b]) + a + 1
    parts = files.parts(len(small) - 1)
    out, n = files.new(sum(len(found(a, b)) for a, b in parts)), 0
    for a, b in parts:
        own = found(a, b)
        out[n : n + len(own)] = own
        n += len(own)
    return out


def _names(text: np.ndarray, small: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The rank of each substring from a start to the next start; equal ones share it."""
    symbol = np.asarray(text) * 2 + small
    ends = np.append(starts[1:], starts[-1])
    name = np.zeros(len(starts), np.int64)
    live, step = np.arange(len(starts)), 0
    while len(live):
        key = np.full(len(starts), -1, np.int64)
        key[live] = symbol[starts[live] + step]
        order = np.lexsort((key, name))
        new = np.zeros(len(starts), np.int64)
        n, k = name[order], key[order]
        new[1:] = (n[1:] != n[:-1]) | (k[1:] != k[:-1])
        name[order] = np.cumsum(new)
        live = live[starts[live] + step < ends[live]]
        # a substring of its own needs no further symbols
        counts = np.bincount(name)
        live = live[counts[name[live]] > 1]
        step += 1
    return name


def _passes(
    text: np.ndarray, top: int, small: np.ndarray, runs: np.ndarray, seeds: np.ndarray, given: np.ndarray, files: Files, cap: int,
) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes but the last in falling order, and the common prefix of each with the one before it, from the sorted starts."""
    both, common = _induce(text, top, seeds, given, lambda p: ~small[p], runs, files, cap)
    big = sum(int((~small[a:b]).sum()) for a, b in files.parts(len(small)))
    heads, between = files.new(big), files.new(big, np.uint16)  # from the last to the first
    n, least = 0, cap
    for a, b in files.parts(len(both)):
        at, shared = np.asarray(both[a:b]), np.asarray(common[a:b])
        kept = np.flatnonzero(~small[at])
        if not len(kept):
            least = min(least, int(shared.min()))
            continue
        cuts = np.append(0, kept[:-1] + 1)
        value = np.minimum.reduceat(shared[: kept[-1] + 1], cuts)
        value[0] = min(value[0], least)
        least = int(shared[kept[-1] + 1 :].min(initial=cap))
        where = big - 1 - np.arange(n, n + len(kept))
        heads[where] = at[kept]
        # the common prefix with the one before it belongs to that one, as order falls
        follows = where + 1
        fits = follows < big
        between[follows[fits]] = value[fits]
        n += len(kept)
    flipped = files.new(len(text))
    for a, b in files.parts(len(text)):
        flipped[a:b] = top - text[a:b]
    last = len(text) - 1
    return _induce(flipped, top, heads, between, lambda p: small[p] & (p < last), runs, files, cap)


def _names_by_passes(text: np.ndarray, top: int, small: np.ndarray, runs: np.ndarray, starts: np.ndarray, files: Files) -> tuple[np.ndarray, int]:
    """Names as those of _names() and how many there are: starts in the order of their symbols alone put all their substrings in order."""
    queue, counts = DiskQueue(files), files.new(top + 1)
    for a, b in files.parts(len(starts)):
        own = np.asarray(starts[a:b])
        queue.push(text[own], own, own, 0)
        s, c = np.unique(text[own], return_counts=True)
        counts[s] += c
    seeds, n = files.new(len(starts)), 0
    for end, hot in _ranges(counts, files):
        while len(rows := queue.pop_first(end - 1) if hot else queue.pop_below(end)):
            seeds[n : n + len(rows)] = rows["at"]
            n += len(rows)
    falling, _ = _passes(text, top, small, runs, seeds, files.new(len(starts), np.uint16), files, 1)
    names, name, before = files.new(len(starts)), 0, len(text) - 1
    for a, b in files.parts(len(falling)):
        at = np.asarray(falling[len(falling) - b : len(falling) - a])[::-1]
        at = at[(at > 0) & small[at] & ~small[np.maximum(at - 1, 0)]]
        if not len(at):
            continue
        place = np.searchsorted(starts, at)
        size = starts[np.minimum(place + 1, len(starts) - 1)] - at
        one, other = np.append(before, at[:-1]), at
        of_one = np.append(_size(before, starts), size[:-1])
        new = of_one != size
        same = np.flatnonzero(~new)
        while len(same):  # whole symbols of as many pairs as memory is to hold
            k = max(1, int(np.searchsorted(np.cumsum(size[same] + 1), files.held, "right")))
            pairs, same = same[:k], same[k:]
            step = size[pairs] + 1
            cuts = np.cumsum(step) - step
            inner = np.arange(step.sum()) - np.repeat(cuts, step)
            unlike = text[np.repeat(one[pairs], step) + inner] != text[np.repeat(other[pairs], step) + inner]
            new[pairs] = np.logical_or.reduceat(unlike, cuts)
        named = name + np.cumsum(new)
        names[place] = named
        name, before = int(named[-1]), int(at[-1])
    return names, name + 1


def _size(start: int, starts: np.ndarray) -> int:
    """Symbols from a start to the next one; none from the last."""
    k = int(np.searchsorted(starts, start))
    return int(starts[min(k + 1, len(starts) - 1)]) - start


def suffix_array(text: np.ndarray, most: int = 1 << 22, folder: str | None = None, cap: int = (1 << 16) - 2) -> tuple[np.ndarray, np.ndarray]:
    """Start positions of the suffixes in their order, and the common prefix of each with the one before it, up to ``cap``.

    ``most`` is the entries that an array holds in memory; larger ones are mapped from files in a folder of this task alone, which is
    removed at the end.
    Symbols are whole numbers from 0 on; if they go far beyond the text's length they are ranked first, in memory.
    """
    with tempfile.TemporaryDirectory(dir=folder) as own:
        files, n = Files(own, most), len(text)
        top = max((int(np.max(text[a:b])) for a, b in files.parts(n)), default=0)
        if top > 2 * n + (1 << 16) or min((int(np.min(text[a:b])) for a, b in files.parts(n)), default=0) < 0:
            text = np.unique(text, return_inverse=True)[1]
            top = int(text.max())
        ended = files.new(n + 1)
        for a, b in files.parts(n):
            ended[a:b] = np.asarray(text[a:b], np.int64) + 1
        order, common = _sort(ended, top + 1, files, cap)
        return order[1:], common[1:]


def _in_symbols(text: np.ndarray, starts: np.ndarray, order: np.ndarray, names: np.ndarray, files: Files, cap: int) -> np.ndarray:
    """Common prefixes of neighbouring suffixes of the string of names, in symbols of the text."""
    out = files.new(len(order), np.uint16)
    for lo, hi in files.parts(len(order) - 1):
        a, b = np.asarray(order[lo:hi]), np.asarray(order[lo + 1 : hi + 1])
        value = starts[np.minimum(a + names[lo + 1 : hi + 1], len(starts) - 1)] - starts[a]
        live = np.flatnonzero(value < cap)
        while len(live):
            x, y = starts[a[live]] + value[live], starts[b[live]] + value[live]
            live = live[text[x] == text[y]]  # the closing 0 is unlike all others
            value[live] += 1
            live = live[value[live] < cap]
        out[lo + 1 : hi + 1] = np.minimum(value, cap)
    return out


def _sort(text: np.ndarray, top: int, files: Files, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """``text`` ends with its one 0, the least symbol; ``top`` is the largest."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.uint16)
    small, runs = _types(text, files, cap)
    starts = _starts(small, files)
    m = len(starts)
    if n <= files.held:
        names = _names(text, small, starts)
        kinds = int(names.max()) + 1
    else:
        names, kinds = _names_by_passes(text, top, small, runs, starts, files)
    if kinds < m:
        order, named = _sort(names, kinds - 1, files, cap)  # the last start is the closing 0, whose name is the least and its own
    else:
        order, named = files.new(m), files.new(m, np.uint16)
        for a, b in files.parts(m):
            order[names[a:b]] = np.arange(a, b)
    seeds = files.new(m)
    for a, b in files.parts(m):
        seeds[a:b] = starts[order[a:b]]
    falling, common = _passes(text, top, small, runs, seeds, _in_symbols(text, starts, order, named, files, cap), files, cap)
    out, commons = files.new(n), files.new(n, np.uint16)
    out[0] = n - 1
    for a, b in files.parts(n - 1):
        out[n - b : n - a] = falling[a:b][::-1]
        own = np.asarray(common[a:b])[::-1]  # of each with the one above it in the final order
        upper = np.arange(n - b, n - a) + 1
        commons[upper[upper < n]] = own[upper < n]
    return out, commons
