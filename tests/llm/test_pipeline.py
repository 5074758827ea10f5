import random
from collections import Counter

import brute
import corpus_pipeline
import pytest
from tideline.llm.mixing import TEMPER
from tideline.llm.quality_rules import verdicts
from tideline.storage import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        docs = materialize(f(spark, docs, SF), "stage")
        out.append(docs)
    return out


def test_documents_keep_their_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_near_copies_leave_one(stages):
    rows = stages[1].orderBy("doc_id").collect()
    classes = brute.near_classes([r.text for r in rows])
    assert {r.doc_id for r in stages[2].collect()} == {rows[c].doc_id for c in classes.values()}


def test_only_good_documents_stay(spark, stages):
    """The verdicts themselves are held against SQL and plain Python elsewhere."""
    assert {r.doc_id for r in stages[1].collect()} == {r.doc_id for r in verdicts(stages[0]).filter("kept").collect()}


def test_repeated_strings_go(stages):
    rows = stages[2].orderBy("doc_id").collect()
    want = {r.doc_id: k.decode(errors="ignore") for r, k in zip(rows, brute.kept_bytes([(r.doc_id, r.text) for r in rows], 240), strict=True)}
    got = stages[3].collect()
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_planted_passages_go_and_clean_texts_stay(spark):
    """Passages of 51 to 70 words in several documents each, at other places; other documents are untouched."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 7)))
    passages = [" ".join(word() for _ in range(rng.randint(51, 70))) for _ in range(20)]
    rows = []
    for i in range(300):
        parts = [" ".join(word() for _ in range(rng.randint(30, 120))) for _ in range(2)]
        rows.append((i, f" {passages[i % 20]} ".join(parts) if i < 100 else " ".join(parts), "en", "s", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)["suffix-array dedup"]
    out = {r.doc_id: r.text for r in stage(spark, materialize(docs, "planted"), SF).collect()}
    assert not any(passages[i % 20] in out[i] for i in range(100))
    assert all(out[i] == rows[i][1] for i in range(100, 300))
    assert all(len(rows[i][1]) - len(out[i]) <= len(passages[i % 20]) + 8 for i in range(100))


def test_mixing_is_that_of_plain_python(stages):
    rows = stages[3].select("doc_id", "text", "lang", "source").collect()
    want = Counter({i: copies for i, (_, _, _, copies) in brute.mixed([tuple(r) for r in rows], TEMPER).items() if copies})
    assert Counter(r.doc_id for r in stages[4].collect()) == want
    assert {tuple(r) for r in stages[4].collect()} <= {tuple(r) for r in stages[3].collect()}


def test_every_sampled_document_is_packed_whole(stages):
    """Pieces of a document follow each other without a gap, as often as it was sampled; sequences are gapless and in bounds."""
    times = Counter(r.doc_id for r in stages[4].collect())
    pieces, sequences = {}, {}
    for r in stages[5].collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces.keys() == times.keys()
    for i, own in pieces.items():
        cover = Counter()
        for start, length, _ in own:
            cover[start] += 1
            cover[start + length] -= 1
        assert {k: v for k, v in cover.items() if v} == {0: times[i], own[0][2]: -times[i]}
    for own in sequences.values():
        ends = [0, *[a + b for a, b in sorted(own)]]
        assert [a for a, _ in sorted(own)] == ends[:-1] and ends[-1] <= 2048


def test_stages_take_odd_and_no_rows(spark, odd_docs, no_docs):
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {}
    for name, docs in (("odd", odd_docs.select(*cols)), ("no", no_docs.select(*cols))):
        kept[name] = []
        for _, f in corpus_pipeline.STAGES:
            docs = materialize(f(spark, docs, SF), "stage")
            kept[name].append([r.doc_id for r in docs.collect()])
    assert kept["no"] == [[]] * 5
    good, one, whole, taken, packed = map(set, kept["odd"])
    assert good == {r.doc_id for r in verdicts(odd_docs).filter("kept").collect()} and one <= good and whole == one
    assert taken <= whole and packed == taken


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).columns == stages[-1].columns
