import math
import random
import re
from collections import Counter
from urllib.parse import urljoin

import brute
import duckdb
import numpy as np
import pytest
from compare import assert_equal
from pyspark.sql import functions as F
from tideline.llm import mixing, quality_rules, registry, vector_files
from tideline.llm.mixing import TEMPER, sample, sample_table
from tideline.llm.quality_classifier import Discriminant, classify, learned
from tideline.llm.quality_rules import keep_good, measure, verdicts
from tideline.llm.sql import url_sql
from tideline.llm.url_filter import Rule, declared, judge
from tideline.llm.vector_files import top_k
from tideline.storage import materialize

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    g = Counter(brute.grams(w, 3))
    hit = {k for i, x in enumerate(brute.grams(w, 3)) if g[x] > 1 for k in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_measures_equal_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in verdicts(docs).collect()}
    for r in docs.collect():
        n, chars, symbols, lines, repeats = base(r.text)
        g = got[r.doc_id]
        assert tuple(g[1:6]) == (n, chars, symbols, lines, repeats)
        assert g.base_failed == (n < 50 or 100 * repeats > 50 * n)
        assert not (g.base_failed and g.kept)


def test_windows_of_one_hash_are_told_apart(spark, monkeypatch):
    """With a hash of few bits the exact path decides."""
    monkeypatch.setattr(quality_rules, "_LONG", 1 << 62)
    monkeypatch.setattr(quality_rules, "_repeats", lambda f=quality_rules._repeats: f().replace("s IS NULL OR", "true OR"))
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.m for r in measure(df, "m").collect()}
    assert all(got[i].n_repeat_words == base(t)[4] for i, t in enumerate(texts))


def test_junk_goes_and_clean_stays(spark):
    sf = "/root/testdata/sf0.01"
    judged = registry.op7_quality_rules(spark, sf).select("doc_id", "kept", "base_failed")
    rows = judged.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    clean = [r for r in rows if r.quality == 1 and not r.base_failed]
    assert sum(r.kept for r in clean) > 0.98 * len(clean)
    assert sum(r.kept for r in rows if r.quality == 0) < 0.1 * sum(r.quality == 0 for r in rows)


def _limits(spark, rows):
    """Limits by group of made-up texts: (lang, share of marks, share of repeated lines)."""
    docs = spark.createDataFrame([(i, lang, "s", text) for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, source string, text string")
    own, corpus = quality_rules.limits(materialize(measure(docs, "m"), "measured"), "m", "lang", "source", 5.0, 10_000, 50)
    return {r._lang: r._own for r in own.collect()}, corpus.first()._all


def _text(rng, marks=0, copies=0, length=5, again=0):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(length + rng.randint(0, 2)))
    lines = [" ".join(word() for _ in range(6)) for _ in range(12)]
    return "\n".join([*lines, *lines[:copies], *["#" * marks] * bool(marks), *[" ".join(lines[0].split()[:3])] * again])


def test_limits_follow_each_group(spark):
    """Where one group's texts have more of what a ratio counts, its limit rises, and the others' stay."""
    rng = random.Random(7)
    plain = [(g, _text(rng, marks=rng.randint(0, 3), copies=int(rng.random() < 0.1), again=rng.randint(0, 1))) for g in "abc" for _ in range(100)]
    before, all_before = _limits(spark, plain)
    moved = [(g, _text(rng, marks=rng.randint(0, 30), copies=rng.randint(0, 4), length=9, again=rng.randint(0, 4)) if g == "c" else t) for g, t in plain]
    after, all_after = _limits(spark, moved)
    for ratio in quality_rules.RATIOS:
        assert after["c"][ratio] > 1.3 * before["c"][ratio] > 0
        own = lambda x, corpus: (x * 150 - 50 * corpus) / 100  # noqa: E731  without the corpus's share
        assert own(after["a"][ratio], all_after[ratio]) == pytest.approx(own(before["a"][ratio], all_before[ratio]))


def test_limits_of_most_groups_differ(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang", "source", "text")
    own, _ = quality_rules.limits(materialize(measure(docs, "m"), "measured"), "m", "lang", "source", 5.0, 10_000, 50)
    rows = [r._own for r in own.collect()]
    for ratio in quality_rules.RATIOS:
        # where most texts of most groups have none of what a ratio counts, their limits are alike, and the others' are not
        assert len({x[ratio] for x in rows}) > (0.8 if ratio in ("repeat_ratio", "long_words") else 0.15) * len(rows)


def test_quality_of_odd_rows(odd_docs, no_docs):
    rows = verdicts(odd_docs).collect()
    assert sorted(map(str, (r.doc_id for r in rows))) == sorted(map(str, (r.doc_id for r in odd_docs.collect())))
    assert {r.doc_id: tuple(r[1:6]) for r in rows if r.doc_id} == {r.doc_id: base(r.text) for r in odd_docs.collect() if r.doc_id}
    kept = keep_good(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.kept}
    assert verdicts(no_docs).count() == 0 and keep_good(no_docs).count() == 0


def test_native_plans_have_no_python(spark):
    for q in (registry.op7_quality_rules, registry.op2_mixing):
        plan = q(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)



def test_mixing_meets_its_targets(spark):
    """The registered query as it is: its rounds end by what is left, not by a number."""
    sf = "/root/testdata/sf0.01"
    t = registry.op2_mixing(spark, sf).cache()
    total = t.agg(F.sum("tokens")).first()[0]
    assert abs(t.agg(F.sum(F.col("tokens") * F.col("rate"))).first()[0] / total - 1) < 1e-5
    for d, power in TEMPER.items():
        rows = t.groupBy(d).agg(F.sum("tokens").alias("n"), F.sum(F.col("tokens") * F.col("rate")).alias("w")).collect()
        goal = sum(r.n**power for r in rows)
        assert len(rows) > 3 and all(math.isclose(r.w / total, r.n**power / goal, rel_tol=1e-5) for r in rows)
    got = t.agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0]
    assert abs(got / total - 1) < 0.06


def test_mixing_goes_on_until_the_targets_are_met(spark):
    """Sources bound to languages, and one hot source: a few rounds are not enough."""
    rng = random.Random(6)
    rows = [(i, "a b c", "abcd"[min(3, k // 2) if rng.random() < 0.8 else rng.randrange(4)], str(k)) for i in range(1500) for k in [0 if rng.random() < 0.4 else rng.randrange(8)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    n = {d: Counter(r[c] for r in rows) for d, c in (("lang", 2), ("source", 3))}
    targets = {"source": spark.createDataFrame([(s, 1 / 8) for s in n["source"]], "v string, share double"), "lang": spark.createDataFrame([(x, y) for x, y in zip("abcd", (0.1, 0.2, 0.3, 0.4), strict=True)], "v string, share double")}
    out = sample_table(docs, topic=F.lit("t"), tokens=F.col("doc_id") % 3 + 1, targets=targets).collect()
    total = sum(r.tokens for r in out)
    assert all(r.tokens == r.doc_id % 3 + 1 for r in out)
    by = Counter()
    for r in out:
        by[r.lang] += r.tokens * r.rate / total
        by[r.source] += r.tokens * r.rate / total
    assert all(by[s] == pytest.approx(1 / 8, rel=1e-4) for s in n["source"])
    assert [by[x] for x in "abcd"] == pytest.approx([0.1, 0.2, 0.3, 0.4], rel=1e-4)


def test_many_cells_are_raked_alike(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rates = lambda: {r.doc_id: r.rate for r in sample_table(docs, most_rounds=4).collect()}
    few = rates()
    monkeypatch.setattr(mixing, "SMALL", 0)
    assert rates() == pytest.approx(few, abs=2e-6)


def test_targets_that_contradict_each_other_are_told(spark):
    docs = spark.createDataFrame([(i, "a b", "xy"[i % 2], "xy"[i % 2]) for i in range(40)], "doc_id long, text string, lang string, source string")
    share = lambda x: spark.createDataFrame([("x", x), ("y", 1 - x)], "v string, share double")
    with pytest.warns(UserWarning, match="off their target"):
        assert sample_table(docs, most_rounds=3, targets={"source": share(0.2), "lang": share(0.7)}).count() == 40


def test_mixing_equals_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source")
    want = brute.mixed([tuple(r) for r in docs.collect()], TEMPER)
    for r in sample_table(docs).collect():
        topic, tokens, rate, copies = want[r.doc_id]
        assert (r.topic, r.tokens, r.copies) == (topic, tokens, copies) and r.rate == pytest.approx(rate, abs=2e-6)


def test_mixing_of_odd_rows(spark, odd_docs, no_docs):
    rows = sample_table(odd_docs, most_rounds=4).collect()
    assert len(rows) == odd_docs.count() and all(r.rate is not None and r.copies >= 0 for r in rows)
    taken = sample(odd_docs, budget=3.0, most_rounds=4)
    assert taken.columns == odd_docs.columns
    assert taken.count() == sum(r.copies for r in sample_table(odd_docs, budget=3.0, most_rounds=4).collect())
    assert sample_table(no_docs).count() == 0 and sample(no_docs).count() == 0


RULES = registry.URL_RULES
PAGES = [
    (1, "http://x.com/en/1", '<link rel="canonical" href="/fr/9">'),
    (2, "https://x.com/fr/9#a", "<html>"),
    (3, "https://x.com/fr/3", '<META HTTP-EQUIV=refresh content="0; url=http://x.com/fr/9">'),
    (4, "http://a.example.com/en/77", "<link href='//y.com/z' rel=canonical>"),
    (5, "http://y.com/z/?utm_a=1", None),
    (6, None, None),
    (7, "nourl", "x"),
    (8, "HTTP://WWW.Y.COM/z", ""),
    (9, "http://q.com/en/5", "<link rel=canonical href=http://y.com/z>"),
    (10, "http://r.net/a/b?x=1&utm_source=2", '<link rel="canonical" href="c">'),
    (11, "http://r.net/a/c", ""),
    (None, "https://r.net/a/c/", ""),
    (12, "http://www.s.com/fr/x/y.html?utm_source=a&ref=b#c", "<!-- <link rel=canonical href=/en/1> --><script>'<link rel=canonical href=/en/2>'</script>"),
    (13, "https://m.s.com/fr/x/y/", '<link rel="alternate nofollow canonical" href="../../../en/./9?a=1&amp;b=2">'),
    (14, "http://s.com/de/1", '<base href="/es/"><link rel="canonical" href="3"><link rel=not-canonical href=/en/7>'),
    (15, "http://s.com/es/3", '<link href="#x" rel="canonical"><link rel=canonical href="mailto:a@b.com">'),
    (16, "http://t.org/de/1", '<link rel="canonical" href="?p=2">'),
    (17, "http://t.org/de/1?p=2", '<link rel="canonical" href="//t.org/es/5">'),
]
REFERENCES = ["c", "./c", "../c", "../../c/d", "../../../../c", "/c/../d", "/c/./d", "//h.org/a/../b", "?q=1&amp;r=2", "c?x=../y", "http://k.com/a/b/../c", "HTTPS://K.com/..", "c/", ".", "d#e"]


def test_aliases_follow_blocks_and_allows_come_first(spark):
    got = {r.page_id: r for r in judge(spark.createDataFrame(PAGES, "page_id long, url string, html string"), RULES).collect()}
    assert {i: got[i].verdict for i in (1, 2, 3)} == {1: "block", 2: "block", 3: "block"}
    assert got[9].verdict == "block" and got[9].rule == "com/en/"  # its own rule
    assert {i: got[i].verdict for i in (4, 5, 8)} == {4: "allow", 5: "allow", 8: "allow"}  # an allow in the class
    assert (got[6].host, got[6].path, got[6].rule, got[6].verdict) == ("", "", None, "allow")
    assert got[7].host == "" and got[8].host == "www.y.com"
    assert got[10].alias_of == got[11].alias_of == got[None].alias_of == "r.net/a/b?x=1"


def test_declared_addresses_of_odd_markup(spark):
    got = {r.page_id: r for r in judge(spark.createDataFrame(PAGES, "page_id long, url string, html string"), RULES).collect()}
    # comments and scripts name nothing; www., m., .html, the closing slash and tracking are views of one page, whose canonical one is blocked
    assert got[12].alias_of == got[13].alias_of == "s.com/en/9?a=1&b=2" and got[12].verdict == got[13].verdict == "block"
    assert got[14].alias_of == got[15].alias_of == "s.com/de/1" and got[14].verdict == "allow"  # by <base>; fragments and mail are no pages
    assert got[16].alias_of == got[17].alias_of == "t.org/de/1" and {got[16].verdict, got[17].verdict} == {"block"}


def test_references_resolve_as_in_plain_python(spark):
    for base in ("http://a.com/x/y/z.html", "http://a.com", "https://a.com/x/?q=/u/v#w"):
        rows = [(base, f'<link rel="canonical" href="{x}">') for x in REFERENCES]
        got = spark.createDataFrame(rows, "url string, html string").select(declared(F.col("url"), F.col("html")).alias("to")).collect()
        for x, r in zip(REFERENCES, got, strict=True):
            want = urljoin(base, x.replace("&amp;", "&"))
            want = urljoin(want, re.sub("^[^:]*://[^/]*", "", want))  # dot segments of whole addresses go, too
            plain = lambda u: re.sub("^https?", "", u, flags=re.I).rstrip("/").split("#")[0].rstrip("/")
            assert [plain(u) for u in r.to] == [plain(want)], (base, x)


def test_url_sql_equals_the_operator_on_planted_pages(spark):
    """The tables' own pages name no aliases."""
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    db = duckdb.connect()
    db.sql("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    db.executemany("INSERT INTO pages VALUES (?, ?, ?)", PAGES)
    want = db.sql(url_sql(RULES))
    got = judge(df, RULES).select(*want.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


def test_pages_without_an_address_stay_apart(spark):
    df = spark.createDataFrame([(i, None if i % 2 else f"u{i}", None) for i in range(500)] + [(None, "http://a.org/es/", None)] * 3, "page_id long, url string, html string")
    rows = judge(df, RULES).collect()
    assert len(rows) == 503 and Counter((r.verdict, r.alias_of) for r in rows) == {("allow", None): 500, ("block", "a.org/es"): 3}


def test_redirect_chains_equal_brute_force(spark):
    rng = random.Random(6)
    urls = [f"http://h{k}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'de', 'es'])}/{k}" for k in range(80)]
    moves = [(rng.choice(urls), rng.choice(urls)) for _ in range(50)]
    rules = [Rule("block", "com/en/"), Rule("allow", "net/de/"), Rule("block", "org")]

    def own(u):
        host, path = re.match(r"http://([^/]*)(.*)", u).groups()
        best = max((r for r in rules if (host == r.parts[0] or host.endswith("." + r.parts[0])) and path.startswith(r.parts[1])), key=lambda r: len(r.text), default=None)
        return best.action if best else None

    group = brute.roots(moves, urls)
    classes = {}
    for u in urls:
        classes.setdefault(group[u], set()).add(own(u))
    want = {u: own(u) or ("allow" if "allow" in classes[group[u]] else "block" if "block" in classes[group[u]] else "allow") for u in urls}
    pages = spark.createDataFrame([(k, u, None) for k, u in enumerate(urls)], "page_id long, url string, html string")
    got = judge(pages, rules, spark.createDataFrame(moves, "from_url string, to_url string"))
    assert {urls[r.page_id]: r.verdict for r in got.collect()} == want
    assert judge(pages.limit(0), rules).count() == 0


def best(ids, x, k):
    out = []
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q]
        near = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[q]][:k]
        out += [(int(ids[q]), n + 1, int(ids[j]), int(s[j])) for n, j in enumerate(near)]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = np.floor(256 * np.array([r.embedding for r in rows], float)).astype(int)
    assert sorted(map(tuple, registry.op6_exact_top_k(spark, sf).collect())) == best(np.array([r.vec_id for r in rows]), x, 5)


@pytest.mark.parametrize("large", [False, True])
def test_top_k_with_ties_and_odd_rows(spark, large):
    rng = np.random.default_rng(3)
    x = rng.integers(-3, 4, (300, 4)) * ((1 << 24) if large else 1)
    x[100:200] = x[0]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    odd = [(1000, None), (1050, [1.0, None, 2.0, 3.0]), (1100, [float("nan")] * 4), (1150, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4), (1200, []), (1250, [9.0, 9.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = top_k(df, df.filter("vec_id % 50 = 0"), 5, scale=1, shard_rows=64, query_rows=4)
    assert sorted(map(tuple, got.collect())) == best(np.arange(300), x, 5)
    assert top_k(df.limit(0), df.limit(0), 5).count() == 0
    few = df.filter("vec_id < 3")
    assert top_k(few, few.filter("vec_id = 0"), 5).count() == 2


def test_cells_bound_every_component():
    rng = np.random.default_rng(8)
    for x in (rng.integers(-300, 300, (50, 6)), rng.integers(-(1 << 62), 1 << 62, (50, 6)), np.full((3, 2), 7), np.array([[-(1 << 63), (1 << 63) - 1], [(1 << 63) - 1, 0]])):
        low, step, cells = vector_files.quantised(x)
        assert cells.dtype == np.uint8
        for i, row in enumerate(x.tolist()):
            for d, v in enumerate(row):
                at = int(low[d]) + int(step[d]) * int(cells[i, d])
                assert at <= v < at + int(step[d])
        if abs(x.astype(float)).max() < 1e4:
            q = rng.integers(-50, 50, (9, x.shape[1]))
            below, above = vector_files.Approximation(low, step, cells).bounds(q)
            assert (below <= q @ x.T).all() and (q @ x.T <= above).all()


def test_few_exact_vectors_are_read(spark):
    """The approximation is an eighth of the vectors, most shards are not opened for a query, and in open ones most vectors stay unread."""
    rng = np.random.default_rng(9)
    centre = rng.normal(size=(20, 32)) * 3
    x = centre[np.arange(6000) // 300] + rng.normal(size=(6000, 32)) * 0.3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartitionByRange(5, "vec_id")
    rows = vector_files.search(df, df.filter("vec_id % 50 = 0"), 5, 256, 300, 64, "vec_id", "embedding").collect()
    opened = {(r.query_id, r.block): r.read for r in rows}
    assert sum(opened.values()) < 0.02 * 120 * 6000 and len(opened) < 0.3 * 120 * 20
    shard = vector_files._packed(vector_files._usable(df, "vec_id", "embedding", 256), 300).first()
    assert 8 * len(shard.cells) == len(shard.vectors)
    got = top_k(df, df.filter("vec_id % 50 = 0"), 5, shard_rows=300, query_rows=64)
    assert sorted(map(tuple, got.collect())) == best(np.arange(6000), np.floor(256 * x).astype(int), 5)


def test_repeated_vectors_and_queries(spark):
    """Each row competes and is answered as often as it stands."""
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = top_k(df, df.filter("vec_id = 0"), 3, scale=1, shard_rows=2).collect()
    assert sorted(map(tuple, got)) == sorted([(0, 1, 1, 2), (0, 2, 1, 2), (0, 3, 2, 1)] * 2)


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = registry.op10_quality_classifier(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert sum(r.predicted == r.quality for r in rows) > 0.97 * len(rows)
    low = [r for r in rows if r.quality == 0]
    assert sum(r.predicted == 0 for r in low) > 0.9 * len(low)


def test_classifier_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 12)] + [(1, 1, 0), (None, 1, 0), (3, None, 0), (5, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    rows = classify(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert classify(no_docs, labels).count() == 0


def test_scores_do_not_follow_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(map(tuple, classify(docs, labels).collect())) == sorted(map(tuple, classify(docs, turned).collect()))


def test_margins_equal_plain_gaussian_densities():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5)) + 3
    y = (rng.random(300) < 0.3).astype(int)
    x[y == 1] = x[y == 1] * 1.7 + 1
    model = Discriminant(x, y, 0.3, 0.05, (0.6, 0.4))
    z = (x - x.mean(0)) / x.std(0)
    logs, covs = [], [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    common = ((y == 0).sum() * covs[0] + (y == 1).sum() * covs[1]) / len(y)
    for k, prior in ((0, 0.6), (1, 0.4)):
        c = 0.7 * covs[k] + 0.3 * common
        c = 0.95 * c + 0.05 * np.trace(c) / 5 * np.eye(5)
        off = z - z[y == k].mean(0)
        logs.append(np.log(prior) - 0.5 * np.linalg.slogdet(2 * np.pi * c)[1] - 0.5 * np.einsum("ij,jk,ik->i", off, np.linalg.inv(c), off))
    assert np.allclose(model.margin(x), logs[1] - logs[0])
    assert np.allclose(model.score(x), np.exp(logs[1]) / (np.exp(logs[0]) + np.exp(logs[1])))


def test_scores_are_probabilities_of_rows_not_learned_from():
    """Densities of dependent statistics: each is given five times. A calibrated score is still right as often as it says."""
    rng = np.random.default_rng(4)
    y = (rng.random(8000) < 0.7).astype(int)
    x = np.repeat(rng.normal(size=(8000, 3)) + y[:, None] * 0.8, 5, 1) + rng.normal(size=(8000, 15)) * 0.05
    model = learned(x[:4000], y[:4000], (0.3, 0.7))
    score = model.score(x[4000:])
    for lo in (0.2, 0.4, 0.6, 0.8):
        own = (score >= lo) & (score < lo + 0.2)
        assert own.sum() > 100 and abs(y[4000:][own].mean() - score[own].mean()) < 0.08
    assert model.slope < 1


def test_shrinkage_is_chosen_on_folds():
    """Few rows of many dimensions and one covariance: pooling beats two covariances of their own."""
    rng = np.random.default_rng(5)
    y = np.arange(120) % 2
    x = rng.normal(size=(120, 14)) + y[:, None] * 0.5
    model = learned(x, y, (0.5, 0.5))
    assert model.pooled == 1.0
    x = np.where(y[:, None] == 1, 3.0, 0.3) * rng.normal(size=(120, 14))
    assert learned(x, y, (0.5, 0.5)).pooled < 1.0


def test_scores_of_the_query_are_not_all_sure(spark):
    sf = "/root/testdata/sf0.1"
    rows = registry.op10_quality_classifier(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert sum(r.predicted == r.quality for r in rows) > 0.98 * len(rows)
    score, label = np.array([r.score for r in rows]), np.array([r.quality for r in rows])
    assert abs(score.mean() - label.mean()) < 0.02
    assert ((score > 0.001) & (score < 0.999)).mean() > 0.2
    assert -np.where(label == 1, np.log(score), np.log1p(-score)).mean() < 0.05
