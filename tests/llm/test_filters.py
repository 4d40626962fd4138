"""Toxicity, decontamination, the pipeline and the registry."""

import random
import time
from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest

import __spark_entry__ as registry
from gaugeflow.llm import decontamination, toxicity
from gaugeflow.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


def test_every_operator_has_its_query():
    assert [sum(n.startswith(f"op{k}_") for n in QUERIES) for k in range(1, 11)] == [1] * 10
    assert set(ORACLES) <= set(QUERIES) and {*QUERIES, "pipeline"} <= set(registry.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "repeats", "decontamination", "pieces"]


def test_held_out_toxicity(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels.filter("doc_id % 5 <> 0"))
    assert (np.diff(model.thresholds) > 0).all()
    scored = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    held = labels.filter("doc_id % 5 = 0").collect()
    false = [r for r in held if r.toxic == 0 and scored[r.doc_id].toxic]
    right = [r for r in held if r.toxic == 1 and scored[r.doc_id].toxic]
    assert len(false) <= 1 and 2 * len(right) >= sum(r.toxic for r in held)
    assert all((r.severity > 0.5) or not r.toxic for r in scored.values())


def graded(n=600):
    rng = random.Random(0)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(80)]
        times = 0 if i % 3 else rng.choice([1, 4, 16])
        for _ in range(times):
            text[rng.randrange(80)] = "VILE"
        docs.append((i, " ".join(text), None, None, None))
        labels.append((i, 1, int(times > 0)))
    return docs, labels


def test_severity_grows_with_what_is_toxic(spark, stored):
    docs, labels = graded()
    stored("labels", labels + [(None, 1, 1), (5, 1, None), (3, 0, 0)], LABELS)
    folder = stored("documents", docs, "doc_id long, text string, lang string, source string, n_chars long")
    df, ls = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(df, ls)
    out = {r.doc_id: r for r in toxicity.scored(df, model).collect()}
    counts = {i: t.count("VILE") for i, t, *_ in docs}
    assert all(out[i].toxic == (c > 0) for i, c in counts.items())
    mean = [np.mean([out[i].severity for i, c in counts.items() if low <= c < high]) for low, high in ((1, 3), (3, 8), (8, 99))]
    assert mean == sorted(mean) and {0, 1, 3} <= {r.grade for r in out.values()}
    kept = toxicity.accepted(df, model)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, c in counts.items() if not c]


def test_toxicity_of_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 1)], LABELS)
    for docs, own in ((awkward, labels), (awkward, labels.limit(0)), (nothing, labels)):
        model = toxicity.train(docs, own)
        assert toxicity.scored(docs, model).count() == docs.count()
        assert toxicity.accepted(docs, model).columns == docs.columns


def test_masks_leave_a_seed_in_every_window():
    window, most = decontamination.WINDOW, 2
    assert decontamination.WINDOW - most >= decontamination.SHARE * window > window - most - 1
    for wrong in combinations(range(window), most):
        assert any(
            all(i + k not in wrong for k, c in enumerate(mask) if c == "1")
            for mask in decontamination.MASKS
            for i in range(window - len(mask) + 1)
        )


def plain_overlaps(text, item):
    """Tokens of the text covered by windows that agree well enough, over all alignments."""
    best = (0, 0)
    size = min(len(item), decontamination.WINDOW)
    for shift in range(-len(item) + 1, len(text)):
        equal = [
            0 <= shift + k < len(text) and text[shift + k] == w for k, w in enumerate(item)
        ]
        covered = set()
        for k in range(len(item) - size + 1):
            if sum(equal[k : k + size]) >= decontamination.SHARE * size - 1e-9:
                covered |= {j for j in range(k, k + size) if 0 <= shift + j < len(text)}
        best = max(best, (len(covered), sum(equal[j] for j in covered)))
    return best


@pytest.mark.parametrize("limit", [decontamination.BLOCK_TOKENS, 30])
def test_overlaps_are_those_of_brute_force(spark, stored, limit):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(60)]
    items = [[rng.choice(words) for _ in range(rng.choice([1, 4, 8, 12, 13, 25]))] for _ in range(25)]
    texts = []
    for i in range(150):
        text = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        if i % 2:
            passage = list(rng.choice(items))
            for _ in range(rng.randint(0, 1 + len(passage) // 6)):
                passage[rng.randrange(len(passage))] = rng.choice(words)
            at = rng.randint(0, len(text))
            text[at:at] = passage
        texts.append(text)
    stored("benchmark", [(i, " ".join(t).upper()) for i, t in enumerate(items)] + [(0, " ".join(items[0])), (99, None), (98, "?")], "item_id long, text string")
    folder = stored("documents", [(i, ", ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    docs, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id): (r.n_overlap, r.n_equal) for r in decontamination.overlaps(docs, bench, limit).collect()}
    expected = {}
    for i, text in enumerate(texts):
        for j, item in enumerate(items):
            found = plain_overlaps(text, item)
            if found[0]:
                expected[i, j] = found
    assert set(got) == set(expected)
    assert got == expected
    dirty = {i for i, _ in expected}
    assert {r.doc_id for r in decontamination.clean(docs, bench, limit).collect()} == set(range(150)) - dirty


def test_passages_are_found_in_any_script_and_case(spark, stored):
    items = [
        "Éai éonleeau pour an été straße œuvre naïve ça où déjà forêt garçon",
        "the quick brown fox jumps over the lazy dog and runs far away today",
        "我们的所有数据都保存在这个很大的表格里面",
        "широкая электрификация южных губерний даст мощный толчок подъёму сельского хозяйства страны и города нашего",
    ]
    texts = [
        "avant " + items[0].upper() + " après",
        "—".join(f"“{w}”" for w in items[1].split()),
        "前面还有别的话" + items[2] + "。后面也有",
        items[3].upper().replace(" ", "…"),
        "rien à voir avec un passage, même en français et déjà assez long pour avoir treize mots",
    ]
    stored("benchmark", list(enumerate(items)), "item_id long, text string")
    folder = stored("documents", list(enumerate(texts)), "doc_id long, text string")
    docs, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    got = decontamination.overlaps(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(i, i) for i in range(4)]
    assert all(r.n_equal == r.item_tokens for r in got)
    assert [(r.doc_id, r.text) for r in decontamination.clean(docs, bench).collect()] == [(4, texts[4])]


def test_decontamination_of_awkward_rows(spark, awkward, nothing):
    bench = spark.createDataFrame([(1, "no id at all"), (2, None)], "item_id long, text string")
    out = decontamination.overlaps(awkward, bench).collect()
    assert [(r.doc_id, r.item_id, r.n_overlap) for r in out] == [(None, 1, 4)]
    kept = decontamination.clean(awkward, bench)
    assert kept.columns == awkward.columns and kept.count() == awkward.count() - 1
    assert decontamination.overlaps(nothing, bench).collect() == []
    assert decontamination.clean(awkward, bench.limit(0)).count() == awkward.count()


def test_pipeline_stages_hand_on_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == columns
        kept = {r.doc_id for r in out.collect()}
        assert kept <= ids and len(kept) > 0.7 * len(ids)
        docs, ids = corpus_pipeline.written(out, f"test-{name}"), kept
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in last.collect()} == ids


def test_repeated_passages_of_short_words_are_cut(spark, stored):
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.choice([3, 3, 4]))) for _ in range(900)]
    passage = " ".join(rng.choice(words) for _ in range(51))
    assert 200 <= len(passage) < 240
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(4)]
    rows = [(0, f"{texts[0]}. {passage}! {texts[1]}"), (1, f"{texts[2]}? {passage}; {texts[3]}")]
    folder = stored("documents", rows, "doc_id long, text string")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = corpus_pipeline.cut_repeats(spark, docs, folder).collect()
    assert all(passage not in r.text for r in got) and len(got) == 2


def test_pipeline_of_awkward_rows(spark, awkward, nothing, stored):
    stored("labels", [(1, 1, 0), (6, 0, 1)], LABELS)
    folder = stored("benchmark", [(1, "no id at all")], "item_id long, text string")
    for docs in (awkward, nothing):
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = corpus_pipeline.written(stage(spark, docs, folder), f"test-{name}")
            assert docs.columns == columns or name == "pieces"


def test_decontamination_with_text_ids_repeated_words_and_short_items(spark, stored):
    word = "ha " * 100_000
    texts = [("a", word), ("b", "nothing of that kind in here"), ("c", "ha ho " * 3_000), (None, "the ha")]
    stored("documents", texts, "doc_id string, text string")
    folder = stored("benchmark", [("x", "ha " * 400), ("y", "the"), ("z", "ha ho " * 20)], "item_id string, text string")
    docs, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    started = time.monotonic()
    got = {(r.doc_id, r.item_id): (r.n_overlap, r.n_equal) for r in decontamination.overlaps(docs, bench, least=5).collect()}
    assert got == {("a", "x"): (400, 400), ("c", "z"): (40, 40)}
    assert time.monotonic() - started < 60
    assert {r.doc_id for r in decontamination.clean(docs, bench, least=5).collect()} == {"b", None}
    assert {r.doc_id for r in decontamination.clean(docs, bench.filter("item_id = 'y'")).collect()} == {"a", "b", "c"}


def test_parts_are_bounded_and_whole():
    sizes = np.array([3, 0, 5, 9, 1, 1, 2])
    parts = list(decontamination.bounded(sizes, 6))
    assert [i for p in parts for i in range(len(sizes))[p]] == list(range(len(sizes)))
    assert all(sizes[p].sum() <= 6 or p.stop - p.start == 1 for p in parts)
    assert list(decontamination.bounded(sizes[:0], 6)) == []
