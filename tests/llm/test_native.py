"""Licence scan, quality cascade and chat formatting."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from gaugeflow.llm import chat, licences, quality
from gaugeflow.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    cursor = con.execute(ORACLES[name])
    columns = sorted(c[0] for c in cursor.description)
    places = [[c[0] for c in cursor.description].index(c) for c in columns]
    expected = sorted(str([r[i] for i in places]) for r in cursor.fetchall())
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == columns
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == expected


def plain_quality(text):
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    often, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(ws), sum(map(len, ws)), symbols, len(lines) - len(set(lines)), len(covered)


def test_quality_of_awkward_rows(awkward):
    out = quality.judged(awkward).collect()
    rows = awkward.select("doc_id", "text").collect()
    got = sorted(
        (str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out
    )
    assert got == sorted((str(r.doc_id), *plain_quality(r.text)) for r in rows)
    assert all(r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words) for r in out)
    assert not any(r.kept for r in out if r.base_failed)


def test_quality_of_an_empty_table(nothing):
    assert quality.judged(nothing).collect() == []


def test_the_order_of_rules_does_not_change_the_verdict(spark):
    docs = quality.measured(spark.read.parquet(f"{SF}/documents.parquet"))
    rules = quality.standard_rules()
    both = docs.select(
        quality.first_rejection(rules).isNull().alias("a"),
        quality.first_rejection(rules[::-1]).isNull().alias("b"),
    )
    assert both.filter("a <> b").count() == 0
    assert 0 < both.filter("a").count() < docs.count()


def test_rules_are_ordered_by_rejection_per_cost(spark):

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    never = quality.Rule("never", lambda: F.lit(False))
    always = quality.Rule("always", lambda: F.length("text") >= 0)
    assert [r.name for r in quality.ordered_by_worth(docs, [never, always])] == ["always", "never"]


def test_clean_labelled_documents_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = quality.judged(docs).join(labels, "doc_id").filter("NOT base_failed").collect()
    assert all(r.kept for r in judged if r.quality == 1)
    assert not any(r.kept for r in judged if r.quality == 0)


def test_licences_of_awkward_rows(spark, awkward, nothing):
    assert licences.scan(awkward).collect() == []
    assert licences.scan(nothing).collect() == []


def test_licence_notices(spark):
    mit = licences.TEMPLATES["MIT"][2]
    rows = [
        (1, "text before\nreleased under the MIT license\nafter"),
        (2, "A\n\n" + mit.replace(" to deal", "\nto deal").upper() + "\n\nB"),
        (3, mit),
        (4, "The license of the MIT is a topic of this text"),
        (None, "Licensed under CC BY-NC 4.0."),
        (6, "Released under the MIT License.\nReleased under the MIT License."),
    ]
    out = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.licence, r.n_units) for r in out} == {
        (1, "MIT", 1), (2, "MIT", 1), (3, "MIT", 1), (None, "CC-BY-NC-4.0", 1), (6, "MIT", 2),
    }


def test_notices_that_share_their_line(spark):
    gpl = licences.TEMPLATES["GPL-3.0"][1]
    rows = [
        (1, f"This file is part of Foo. {gpl} See COPYING. " + "word " * 200),
        (2, "Licensed under the MIT License. See License.txt in the project root for license information."),
        (3, "This work is licensed under the GNU General Public License, version 3."),
        (4, "// Licensed under the\n// MIT License.\nint main() { return 0; }"),
        (5, "other words " * 3000 + gpl + " more of them" * 3000 + " Licensed under CC BY 4.0. the end"),
    ]
    out = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.licence, r.n_units, r.dice) for r in out} == {
        (1, "GPL-3.0", 1, 1.0), (2, "MIT", 1, 1.0), (3, "GPL-3.0", 1, 1.0), (4, "MIT", 1, 1.0),
        (5, "GPL-3.0", 1, 1.0), (5, "CC-BY-4.0", 1, 1.0),
    }


def best_spans(text, size, known, most):
    """(start, length, dice) of the best span of every start, by trying them all."""
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
    for start in range(len(pairs)):
        tried = []
        for length in range(1, min(most, len(pairs) - start) + 1):
            own = set(pairs[start : start + length])
            tried.append((2 * len(own & known) / (len(own) + size), -length))
        dice, length = max(tried)
        if dice >= licences.THRESHOLD and pairs[start] in known:
            yield start, -length, dice


def test_spans_against_trying_all(spark):
    some = {"A": ["one two three four five six seven eight nine ten"], "B": ["one two three four five six", "x y x y z"]}
    words = "one two three four five six seven eight nine ten x y x y z other".split()
    random.seed(5)
    texts = []
    for _ in range(120):
        text = []
        while len(text) < 70:
            at = random.randrange(len(words))
            text += words[at : at + random.randrange(1, 12)]
        texts.append(" ".join(text))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.kind, r.start, r.length, r.dice) for r in licences.spans(docs, some).collect()}
    want, kinds = set(), [t for texts_of in some.values() for t in texts_of]
    for kind, template in enumerate(kinds):
        known = licences.bigrams(template)
        most = int(licences.size_bounds(len(known), licences.THRESHOLD)[1])
        for doc, text in enumerate(texts):
            want |= {(doc, kind, *found) for found in best_spans(text, len(known), known, most)}
    assert got == want and len(want) > 100


def test_overlapping_spans_keep_the_best_licence(spark):
    docs = spark.createDataFrame(
        [(1, "a b c d e f g h"), (2, "a b c d e f z h"), (3, "a b c d e f g h a b c d e f z h")], "doc_id long, text string"
    )
    out = licences.matches(docs, templates={"G": ["a b c d e f g h"], "Z": ["a b c d e f z h"]}, threshold=0.6).collect()
    assert {(r.doc_id, r.licence, r.dice) for r in out} == {(1, "G", 1.0), (2, "Z", 1.0), (3, "G", 1.0), (3, "Z", 1.0)}


@pytest.mark.parametrize("size", [2, 5, 40])
def test_size_bounds_admit_whatever_can_reach_the_threshold(size):
    low, high = licences.size_bounds(size, 0.8)
    for other in range(1, 200):
        best = 2 * min(size, other) / (size + other)
        assert (best >= 0.8) == (low <= other <= high)


CHATS = [
    (1, 1, "assistant", "</s>[INST] ok [/INST]"),
    (1, 0, "user", "<\\s> [\\\\INST] <</SYS>> <<SYS>>"),
    (1, 2, "tool</role>", "a <text> b"),
    (2, 0, "user", None),
    (2, 0, "user", None),
    (2, None, None, "x"),
    (None, 0, "system", ""),
    (4, 0, "assistant", "[" * 50 + "[INST]" * 50 + "<" * 50 + "\n" * 5000),
    (4, 1, "assistant", "plain — 漢字"),
]
CONVERSATIONS = "conv_id long, turn long, role string, text string"


def test_chats_read_back(spark):
    out = chat.conversations(spark.createDataFrame(CHATS, CONVERSATIONS)).collect()
    assert all(r.identical for r in out)
    for r in out:
        mine = [c for c in CHATS if c[0] == r.conv_id]
        mine.sort(key=lambda c: (c[1] is not None, c[1] or 0, c[2] or "", c[3] or ""))
        assert [(t.role, t.text) for t in r.recovered] == [(c[2] or "", c[3] or "") for c in mine]
        inside = [re.sub(r"([\[<])\\(\\*)", r"\1\2", r.formatted[m.start : m.start + m.length]) for m in r.loss_mask]
        assert inside == [c[3] or "" for c in mine if c[2] == "assistant"]


def test_chat_digest_holds_the_planted_conversation(spark):
    rows = chat.digest(spark, spark.createDataFrame(CHATS, CONVERSATIONS)).collect()
    [planted] = [r for r in rows if r.conv_id == -7]
    text = "</s>[INST] ok [/INST]"
    assert planted.n_turns == 2 and planted.loss_chars == len(text)
    assert planted.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    turns = f"user\n{text}\nassistant\n{text}\n"
    assert planted.turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()


def test_the_loss_is_what_lies_under_the_mask(spark):
    out = chat.conversations(spark.createDataFrame(CHATS, CONVERSATIONS))
    expected = {}
    for r in out.collect():
        text = "".join(t.text for t in r.recovered if t.role == "assistant")
        expected[r.conv_id] = len(text), hashlib.sha256(text.encode()).hexdigest()
    got = {r.conv_id: (r.loss_chars, r.loss_sha256) for r in chat.read_back(out).collect()}
    assert got == expected
    shifted = out.withColumn(
        "loss_mask", F.transform("loss_mask", lambda m: F.struct((m.start + 1).alias("start"), m.length.alias("length")))
    )
    moved = {r.conv_id: r.loss_sha256 for r in chat.read_back(shifted).collect()}
    assert any(moved[i] != digest for i, (n, digest) in expected.items() if n)


def test_no_chats(spark):
    assert chat.conversations(spark.createDataFrame([], CONVERSATIONS)).collect() == []
