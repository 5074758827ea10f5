import random
from collections import Counter
from math import comb

import brute
import numpy as np
import pytest
from tideline import storage
from tideline.llm import exchange, induced_sort, near_dedup, substring_anchors, suffix_dedup
from tideline.llm.components import components
from tideline.llm.induced_sort import suffix_array
from tideline.llm.near_dedup import _likely, _settle, arrow, classes, keep_one, least_agreement, links_within, signatures
from tideline.llm.substring_anchors import dedup as word_dedup
from tideline.llm.suffix_dedup import dedup as byte_dedup
from tideline.llm.suffix_dedup import without_repeats



@pytest.fixture(scope="module")
def mixed(spark):
    """Passages shared by many texts at many places, near copies, periodic texts."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abdeéio") for _ in range(rng.randint(1, 6)))
    passages = [[word() for _ in range(rng.randint(10, 160))] for _ in range(6)]
    rows = []
    for i in range(120):
        w = [word() for _ in range(rng.randint(0, 120))]
        for p in rng.sample(passages, rng.randint(0, 2)):
            k = rng.randint(0, len(w))
            w[k:k] = p
        if i % 5 == 0 and rows:
            w = rows[rng.randrange(len(rows))][1].split()
            for _ in range(rng.randint(0, 8)):
                if w:
                    w[rng.randrange(len(w))] = word()
        rows.append((i, rng.choice([" ", "\n", "  "]).join(w)))
    rows += [(200, "ab " * 400), (201, "ab " * 300), (202, "x" * 1500), (203, "x" * 900)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_signature_components_agree_as_often_as_the_weighted_similarity():
    rng = np.random.default_rng(1)
    off = []
    for _ in range(40):
        a = rng.integers(0, 9, 40)
        b = np.where(rng.random(40) < 0.6, a, rng.integers(0, 9, 40))
        keys = arrow.mix(rng.integers(1, 1 << 60, 40).astype(np.uint64))
        w = np.concatenate([a, b])
        k = w > 0
        s = signatures(np.repeat([0, 1], 40)[k], np.concatenate([keys, keys])[k], w[k], 2, 512)
        off.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(off)) < 4 * np.std(off) / 40**0.5


def test_near_classes_equal_brute_force(spark, mixed):
    rows, df = mixed
    want = brute.near_classes([t for _, t in rows])
    assert {r.doc_id: r.class_id for r in classes(df).collect()} == {rows[i][0]: rows[c][0] for i, c in want.items()}


def test_links_that_stars_miss_are_found(spark):
    """A chain of texts, each near the next only."""
    base = [f"w{i}" for i in range(300)]
    rows = [(k, " ".join(base[12 * k : 12 * k + 120])) for k in range(12)]
    got = {r.doc_id: r.class_id for r in classes(spark.createDataFrame(rows, "doc_id long, text string"), similar=0.8).collect()}
    assert got == {rows[i][0]: rows[c][0] for i, c in brute.near_classes([t for _, t in rows]).items()}
    assert set(got.values()) == {0}


def test_rows_of_the_same_words_are_told_by_a_digest(spark):
    """Texts on which sums of powers modulo 2^64 agree are still two texts; so are their classes' copies."""
    for n in (1024, 2048):
        bits = [bin(i).count("1") & 1 for i in range(n)]
        rows = [(0, " ".join("ab"[b] for b in bits)), (1, " ".join("ba"[b] for b in bits)), (2, "  ".join("ab"[b] for b in bits))]
        got = {r.doc_id: r.copies for r in classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {0: 2, 1: 1, 2: 2}


def test_signatures_rule_out_what_is_far_and_nothing_near():
    assert least_agreement(150, 1.0) == 150
    k = least_agreement(150, 0.8)
    below = lambda p: sum(comb(150, i) * p**i * (1 - p) ** (150 - i) for i in range(k))
    assert below(0.8) <= 1e-6 and below(0.5) > 0.99


def test_bits_hold_back_no_wanted_row(spark):
    rows = spark.range(5000).withColumnRenamed("id", "node")
    few, all_ = rows.filter("node % 97 = 0"), rows
    got = _likely(rows, "node", few)
    assert few.join(got, "node", "left_anti").count() == 0 and got.count() < 200
    assert _likely(rows, "node", all_).count() == 5000
    assert _likely(rows, "node", rows.limit(0)).count() == 0


def test_pairs_of_a_busy_leader_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "PAIRS", 7)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    rows = [(k, " ".join(base[: rng.randint(60, 100)])) for k in range(90)]
    want = brute.near_classes([t for _, t in rows])
    assert {r.doc_id: r.class_id for r in classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {rows[i][0]: rows[c][0] for i, c in want.items()}


def test_near_classes_of_odd_rows(spark, odd_docs, no_docs):
    rows = classes(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[1].class_id == by[2].class_id == by[3].class_id == 1 and by[1].copies == 3
    assert by[4].class_id == by[5].class_id == by[6].class_id == 4
    assert by[7].class_id == by[8].class_id == 7
    kept = keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 7, 9, 10]
    assert classes(no_docs).count() == 0 and keep_one(no_docs).count() == 0


@pytest.mark.parametrize("size", [13, 5])
def test_word_runs_equal_brute_force(mixed, size):
    rows, df = mixed
    assert brute.plain(word_dedup(df, size, with_text=False).collect()) == brute.plain(brute.word_dedup(rows, size))


def test_word_runs_of_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = word_dedup(odd_docs).collect()
    assert brute.plain(r[:4] for r in got) == brute.plain(brute.word_dedup(rows, 13))
    assert all(len(r.kept.split()) == r.n_words - r.n_removed == r.n_words - sum(b - a for a, b in r.spans) for r in got)
    assert word_dedup(no_docs).count() == 0


@pytest.mark.parametrize("need", [400, 60])
def test_byte_strings_equal_brute_force(mixed, monkeypatch, need):
    monkeypatch.setattr(exchange, "RANGE_BYTES", 10_000)
    rows, df = mixed
    assert brute.plain(byte_dedup(df, need, with_text=False).collect()) == brute.plain(brute.byte_dedup(rows, need))


@pytest.mark.parametrize("fan", [3, 7])
def test_relays_change_nothing(mixed, monkeypatch, fan):
    """Many ranges, few outer ones, several relays of each."""
    monkeypatch.setattr(exchange, "RANGE_BYTES", 2000)
    monkeypatch.setattr(exchange, "RELAY_BYTES", 30_000)
    monkeypatch.setattr(exchange, "FAN", fan)
    rows, df = mixed
    made, real = [], exchange.write_batches
    small = lambda *a, **k: made.append(real(*a, **k, most=4000)) or made[-1]
    monkeypatch.setattr(suffix_dedup, "write_batches", small)
    monkeypatch.setattr(substring_anchors, "write_batches", small)
    assert brute.plain(byte_dedup(df, 60, with_text=False).collect()) == brute.plain(brute.byte_dedup(rows, 60))
    assert brute.plain(word_dedup(df, 13, with_text=False).collect()) == brute.plain(brute.word_dedup(rows, 13))
    assert exchange.ranges(made[0]).inner > 5 and exchange.ranges(made[0]).relays > 1 and made[0].count() > 20


def test_a_batch_writes_a_bounded_number_of_rows():
    """However much text there is, so that rows grow with the batches alone; three sizes."""
    rng = np.random.default_rng(1)
    hashes = np.sort(rng.integers(0, 1 << 63, 50_000, dtype=np.uint64) * np.uint64(2))
    for total in (1 << 30, 30 << 30, 100 << 40):
        given = exchange.Ranges(total)
        rows = list(exchange.posed(0, hashes, exchange.split(hashes, given.n), given))
        assert len(rows) <= exchange.FAN
        assert b"".join(r.column("question")[0].as_py() for r in rows) == hashes.tobytes()
        asked = sum(np.frombuffer(r.column("counts")[0].as_py(), "<i8").sum() for r in rows)
        assert asked == len(hashes)


def test_passages_equal_brute_force(mixed, monkeypatch):
    """Passages of 40 bytes beside strings of 60: at a width of one start the cores are the passages."""
    monkeypatch.setattr(exchange, "RANGE_BYTES", 10_000)
    rows, df = mixed
    assert suffix_dedup.width(60) == 1
    got = byte_dedup(df, 60, with_text=False, passage=40).collect()
    assert brute.plain(r[:5] for r in got) == brute.plain(brute.byte_dedup(rows, 60))
    assert {r.doc_id: r.n_passage for r in got} == {r[0]: r[2] for r in brute.byte_dedup(rows, 40)}


def test_passages_of_the_query_lie_between_brute_force_bounds(mixed):
    rows, df = mixed
    got = byte_dedup(df, 400, with_text=False, passage=240).collect()
    assert brute.plain(r[:5] for r in got) == brute.plain(brute.byte_dedup(rows, 400))
    longest, shortest = ({r[0]: r[2] for r in brute.byte_dedup(rows, k)} for k in (240, 200))
    assert all((200 if longest[r.doc_id] else 0) <= r.n_passage <= shortest[r.doc_id] for r in got)
    assert sum(r.n_passage > 0 and not r.n_removed for r in got) > 10


def test_byte_strings_of_hot_cores_equal_brute_force(mixed, spark, monkeypatch):
    """Cores in most texts with other bytes around them, or with few; their starts are dealt one by one."""
    monkeypatch.setattr(exchange, "RANGE_BYTES", 10_000)
    rng = random.Random(4)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    core, tails = letters(58), [letters(rng.randint(0, 9)) for _ in range(6)]
    rows = mixed[0] + [(1000 + k, letters(rng.randint(0, 90)) + rng.choice(tails) + core + rng.choice(tails) + letters(rng.randint(0, 90))) for k in range(300)]
    rows += [(2000 + k, letters(30) + core[:56] + letters(30)) for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.plain(brute.byte_dedup(rows, 60))
    for hot in (1, 20):
        assert brute.plain(byte_dedup(df, 60, with_text=False, hot=hot).collect()) == want


def test_no_task_sorts_a_hot_core_whole(monkeypatch):
    """The most pieces of one core that a task may get, from what the core's own task answers."""
    rows = np.zeros(500, suffix_dedup._CORE)
    rows["a"], rows["b"], rows["c"] = 7, 9, 2 * np.arange(500)
    said = np.unpackbits(np.frombuffer(suffix_dedup._shared([rows.tobytes()], most=100)[0], np.uint8), count=2000).reshape(-1, 4)
    assert said[:, 1].all() and said[:, 2].all()
    rng = np.random.default_rng(6)
    starts = np.zeros(500, suffix_dedup._START)
    starts["key"], starts["left"] = rng.integers(0, 200, 500), 3
    sides = rng.integers(0, 256, (200, 6))[starts["key"].astype(int)].astype(np.uint8)
    sizes, real = [], suffix_dedup.sort_pieces
    monkeypatch.setattr(suffix_dedup, "sort_pieces", lambda p, *a: sizes.append(len(p)) or real(p, *a))
    got = suffix_dedup.sort_starts(starts, sides.ravel(), 7, 400)
    assert got.tolist() == [(starts["key"] == k).sum() > 1 for k in starts["key"]] and max(sizes) < 100


def test_byte_strings_of_odd_rows(odd_docs, no_docs):
    some = odd_docs.filter("doc_id is null or doc_id not in (7, 8)")
    rows = [(r.doc_id, r.text) for r in some.collect()]
    assert brute.plain(r[:5] for r in byte_dedup(some).collect()) == brute.plain(brute.byte_dedup(rows, 400))
    out = without_repeats(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    by = {r.doc_id: r.text for r in out.collect()}
    assert by[7] == "" and by[4] is None
    assert byte_dedup(no_docs).count() == 0 and without_repeats(no_docs).count() == 0


@pytest.mark.parametrize("most", [1 << 20, 7, 2])
@pytest.mark.parametrize("cap", [1000, 3])
def test_suffix_array_and_common_prefixes(most, cap):
    """Small ``most``: many ranges, symbols of more suffixes than that, substrings named by passes, and arrays and tuples on disk."""
    rng = np.random.default_rng(2)
    for k in range(150 if most > 7 else 60):
        t = rng.integers(0, rng.integers(1, 5), rng.integers(1, 60))
        t = list(np.sort(t)[::-1] if k % 3 == 0 else np.tile(t, 3) if k % 7 == 0 else t)
        want = sorted(range(len(t)), key=lambda i, t=t: t[i:])
        order, common = suffix_array(t, most, cap=cap)
        assert list(order) == want
        for n, (a, b) in enumerate(zip(want, want[1:], strict=False)):
            same = next((x for x in range(len(t)) if max(a, b) + x >= len(t) or t[a + x] != t[b + x]), len(t))
            assert common[n + 1] == min(same, cap)


def test_a_shard_far_larger_than_memory(monkeypatch):
    """What is sorted holds 200 entries of each array in memory; the shard has 60 times as many symbols."""
    rng = np.random.default_rng(11)
    step, n = 9, 700
    pieces = np.zeros(n, suffix_dedup._PIECE)
    pieces["a"] = rng.integers(0, 3, n)
    pieces["left"], pieces["right"] = rng.integers(0, step, n), rng.integers(step - 1, 2 * step - 1, n)
    pieces["starts"] = np.minimum(pieces["left"] + 1, pieces["left"] + pieces["right"] - step + 2)
    sides = rng.integers(97, 99, int(pieces["left"].sum() + pieces["right"].sum())).astype(np.uint8)
    largest, real = [], induced_sort.Files.new
    monkeypatch.setattr(induced_sort.Files, "new", lambda self, k, kind=np.int64: (largest.append((k, self.held)), real(self, k, kind))[1])
    got = suffix_dedup.sort_pieces(pieces, sides, step, 200)
    assert max(k for k, _ in largest) > 60 * 200 and {h for _, h in largest} == {200}
    assert got.tolist() == suffix_dedup.sort_pieces(pieces, sides, step, 1 << 20).tolist()
    at, strings = 0, []
    for p in pieces:
        left, right = sides[at : at + p["left"]].tolist(), sides[at + p["left"] : at + p["left"] + p["right"]].tolist()
        text = [*left, 1000 + int(p["a"]), *right]
        strings.append([tuple(text[k : k + step]) for k in range(p["starts"])])
        at += p["left"] + p["right"]
    count = Counter(x for own in strings for x in own)
    want = [sum((count[x] > 1) << k for k, x in enumerate(own)) for own in strings]
    assert got.tolist() == want and any(want)


def test_shards_in_files_equal_brute_force(mixed):
    """A sort that holds next to nothing, through the whole operator."""
    rows, df = mixed
    assert brute.plain(byte_dedup(df, 60, with_text=False, sorted_at_once=50).collect()) == brute.plain(brute.byte_dedup(rows, 60))


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(i + 1000, i + 1001) for i in range(60)] + [(5000, 5001 + i) for i in range(40)] + [(None, 4), (7, 7)]
    real = [(a, b) for a, b in edges if a is not None and a != b]
    want = brute.roots(real, {x for e in real for x in e})
    assert {r.node: r.component for r in components(spark.createDataFrame(edges, "a int, b int")).collect()} == want
    assert {r.node: r.component for r in components(spark.createDataFrame(edges, "a int, b int"), many=0).collect()} == want
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_links_within_blocks_equal_brute_force():
    rng = random.Random(8)
    base = [rng.choice("abcdefgh") for _ in range(60)]
    texts, group, block = [], [], []
    for g in range(12):
        for _ in range(rng.randint(1, 30)):
            w = base[: rng.randint(0, 60)]
            for _ in range(rng.randint(0, 6)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice("abcdefgh")
            texts.append(" ".join(w).encode())
            group.append(g)
            block.append(rng.randint(0, g % 2))
    part = list(range(len(texts)))
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = links_within(np.frombuffer(b"".join(texts), np.uint8), offsets, np.array(group), np.array(block), np.array(part), 5, 0.8)
    sets = [brute.shingles(t.decode()) for t in texts]
    crossed = {g: len({b for b, h in zip(block, group, strict=True) if h == g}) > 1 for g in group}
    near = [(i, j) for i in part for j in range(i) if group[i] == group[j] and (not crossed[group[i]] or block[i] != block[j]) and total(sets[i]) and total(sets[j]) and brute.jaccard(sets[i], sets[j]) >= 0.8]
    assert {frozenset(p) for p in got} <= {frozenset(p) for p in near}
    assert brute.roots(got, part) == brute.roots(near, part)


def test_links_at_exactly_the_least_similarity():
    """Overlap 4 of 4 and 5, 96 of 108 and 108, and many more pairs of exactly 0.8, and pairs just below it."""
    texts, want = [], []
    for n in [4, *range(8, 400, 4)]:
        w = [f"w{i}" for i in range(2 * n + 8)]
        texts += [w[: n + 4], w[: n + n // 4 + 4], w[: n + 4], w[: n + n // 4 + 5]]  # n of n and n / 4 more; one more still
        want.append((len(texts) - 4, len(texts) - 3))
    w = [f"v{i}" for i in range(200)]
    texts += [w[:112], w[12:124]]
    want.append((len(texts) - 2, len(texts) - 1))
    data = [" ".join(t).encode() for t in texts]
    group = np.repeat(np.arange(len(texts) // 2), 2)
    got = links_within(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in data])]), group, np.zeros(len(texts), int), np.arange(len(texts)), 5, 0.8)
    assert sorted(tuple(sorted(p)) for p in got) == want


def test_settling_links_pairs_at_exactly_the_least_similarity(spark):
    """Cells of a leader that is near neither of the other two, which are at exactly 0.8."""
    texts, want = [], set()
    for k in range(60):
        n = 4 + 4 * k
        w = [f"w{k}x{i}" for i in range(2 * n + 8)]
        texts += [w[:5] + [f"v{k}x{i}" for i in range(n)], w[: n + 4], w[: n + n // 4 + 4]]
        want.add((3 * k + 1, 3 * k + 2))
    nodes = spark.createDataFrame([(i // 3, i, len(t) - 4, " ".join(t)) for i, t in enumerate(texts)], "cell long, node long, total long, text string")
    nobody = spark.createDataFrame([], "node long, component long")
    got = _settle(nodes.drop("text"), nobody, nodes.select("node", "text"), 5, 0.8).collect()
    assert {tuple(sorted(r)) for r in got} == want


def total(c):
    return sum(c.values())


def test_released_batches_leave_the_catalog(spark, mixed):
    with storage.released(spark):
        assert word_dedup(mixed[1]).count() == len(mixed[0])
        held = [t.name for t in spark.catalog.listTables() if t.name.startswith("tideline_batches_")]
    left = [t.name for t in spark.catalog.listTables() if t.name.startswith("tideline_batches_")]
    assert len(held) == len(left) + 1
