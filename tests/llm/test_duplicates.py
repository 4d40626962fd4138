"""SimHash groups, components, repeated strings."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from gaugeflow.llm import components, repeats, simhash

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    lowered = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    ws = [w for w in re.split(rb"[\x20\x09-\x0D]+", lowered) if w]
    if not ws:
        return 0
    shingles = [b" ".join(ws[i : i + 3]) for i in range(max(len(ws) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, distance=3):
    """Smallest id reachable, for (id, fingerprint) rows."""
    kinds = sorted({f for _, f in rows})
    root = {f: f for f in kinds}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(kinds):
        for b in kinds[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    low = {}
    for doc_id, f in rows:
        if doc_id is not None:
            low[find(f)] = min(low.get(find(f), doc_id), doc_id)
    return [low.get(find(f)) for _, f in rows]


def test_groups_are_those_of_brute_force(spark, awkward):
    more = spark.read.parquet(f"{SF}/documents.parquet")
    for docs in (awkward, more):
        rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
        expected = [(str(i), f"{f:016x}", c) for (i, f), c in zip(rows, plain_components(rows))]
        got = [(str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.digest(docs).collect()]
        assert sorted(got, key=str) == sorted(expected, key=str)


def test_no_documents_have_no_groups(nothing):
    assert simhash.digest(nothing).collect() == []
    assert simhash.one_of_each(nothing).collect() == []


def test_the_code_is_perfect():
    near, far = simhash.golay_tables()
    assert np.bitwise_count(near).max() == 3 and len(set(near.tolist())) == 2048
    three = np.bitwise_count(near) == 3
    assert (far[three] > 0).all() and (far[~three] == 0).all()


def test_close_fingerprints_share_a_key():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 64, 4000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(a)):
        for bit in rng.choice(64, int(rng.integers(0, 4)), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    maker = simhash.Keys()

    def keys(found):
        out = {}
        for place, key in zip(*maker.of(found)):
            out.setdefault(int(place), set()).add(int(key))
        return out

    first, second = keys(a), keys(b)
    assert all(first[i] & second[i] for i in first)


def test_a_dense_cluster_becomes_one_component(spark):
    rng = random.Random(8)
    center = rng.getrandbits(64)
    found = {center ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(1500)}
    found |= {rng.getrandbits(64) for _ in range(500)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in sorted(found)]
    nodes = spark.createDataFrame(signed, "fingerprint long")
    out = simhash.links(nodes).collect()
    # Within a short run every pair is given, of a long one a spanning set, once per key.
    assert len(out) < 150 * len(found)
    roots = {r.node: r.root for r in components.components(simhash.links(nodes)).collect()}
    ids = list(range(len(signed)))
    expected = Counter(plain_components(list(zip(ids, sorted(found)))))
    groups = Counter(roots.get(s[0], s[0]) for s in signed)
    assert sorted(groups.values()) == sorted(expected.values())


def test_components_of_paths_stars_and_rings(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 400)]
    links += [(1000, i) for i in range(1001, 1500)]
    links += [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)]
    links += [(5, 5), (7, 9), (9, 7), (7, 9), (None, 3)]
    rng.shuffle(links)
    df = spark.createDataFrame(links, "node long, root long").repartition(5)
    got = {r.node: r.root for r in components.components(df).collect()}
    expected = {i: 100 for i in range(101, 401)} | {i: 1000 for i in range(1001, 1500)}
    expected |= {2000 + i: 2000 for i in range(1, 50)} | {9: 7}
    assert got == expected
    assert components.components(df.limit(0)).collect() == []


def copies(n=400, edits=2):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    rows = []
    for group in range(12):
        base = [rng.choice(words) for _ in range(n)]
        for copy in range(5):
            text = list(base)
            for _ in range(edits * (copy > 1)):
                text[rng.randrange(n)] = rng.choice(words)
            rows.append((group * 100 + copy, " ".join(text)))
    rows += [(9000 + i, " ".join(rng.choice(words) for _ in range(n))) for i in range(60)]
    return rows


def test_one_document_of_each_group_stays(spark, stored):
    folder = stored("documents", [(i, t, None, None, None) for i, t in copies(edits=0)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [g * 100 for g in range(12)] + [9000 + i for i in range(60)]


def test_one_of_awkward_rows(awkward):
    kept = simhash.one_of_each(awkward)
    assert kept.columns == awkward.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    texts = [t for _, t in rows if t and t.strip()]
    # Texts without words are near-duplicates of each other.
    assert len(texts) == len(set(texts)) == 8 and len(rows) == 9
    # Rows come in any order; of the copies of the first text the smallest id stays.
    [first] = [r.text for r in awkward.filter("doc_id = 1").collect()]
    ids = {t: i for i, t in rows}
    assert ids[first] == 1 and ids["no id at all"] is None


def test_those_that_stay_are_one_of_each_plain_group(spark, awkward):
    for docs in (awkward, spark.read.parquet(f"{SF}/documents.parquet")):
        rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
        places = plain_components(list(zip(range(len(rows)), (f for _, f in rows))))
        first = {}
        for place, (i, _) in zip(places, rows):
            best = first.get(place)
            first[place] = i if best is None else best if i is None else min(best, i)
        got = [r.doc_id for r in simhash.one_of_each(docs).collect()]
        assert sorted(got, key=str) == sorted(first.values(), key=str)


def test_ids_of_any_type(spark, stored):
    rows = [(f"id {i}", t) for i, t in copies()]
    folder = stored("documents", rows, "doc_id string, text string")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: r.component_id for r in simhash.digest(docs).collect()}
    assert got["id 101"] == "id 100" and got["id 9007"] == "id 9007"
    assert simhash.one_of_each(docs).count() < len(rows)


def plain_repeats(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def mosaics():
    rng = random.Random(4)
    parts = ["".join(rng.choice(["ab", "é", "foo", "bar baz", "x y z", "q"]) for _ in range(rng.randint(5, 60))) for _ in range(12)]
    texts = []
    for _ in range(120):
        pick = [rng.choice(parts) if rng.random() < 0.8 else "".join(rng.choices("abcdefgh", k=17)) for _ in range(rng.randint(0, 6))]
        texts.append("".join(pick))
    return [*texts, None, "", "a" * 500, "ab" * 300, "z" * 39, "z" * 40]


@pytest.mark.parametrize(
    "block, many, at_once, block_bytes", [(10, 2000, 4000, 2 << 20), (20, 2, 5, 2 << 20), (10, 3, 3, 100)]
)
def test_repeated_strings_are_those_of_brute_force(spark, stored, monkeypatch, block, many, at_once, block_bytes):
    monkeypatch.setattr(repeats, "MANY", many)
    monkeypatch.setattr(repeats, "AT_ONCE", at_once)
    monkeypatch.setattr(repeats, "BLOCK_BYTES", block_bytes)
    texts = mosaics()
    folder = stored("documents", list(enumerate(texts)), "doc_id long, text string", 3)
    out = repeats.digest(spark.read.parquet(f"{folder}/documents.parquet"), 40, 10, block).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out}
    expected = plain_repeats([(t or "").encode() for t in texts], 40)
    assert [got[i] for i in range(len(texts))] == expected
    assert sum(e[1] for e in expected) > 1000


def test_a_crowded_anchor_goes_through_the_merge(spark, stored):
    """More contexts than a task merges, all around one common line; some share more with another."""
    rng = random.Random(9)
    line = "the one line that all of them have in common, forty"
    texts = []
    for i in range(repeats.MANY + 60):
        left = "".join(rng.choice("abcdefgh ") for _ in range(25))
        right = "".join(rng.choice("abcdefgh ") for _ in range(25))
        if i % 7 == 0 and texts:
            left = left[:13] + "shared left "
        texts.append(left + line + right)
    folder = stored("documents", list(enumerate(texts)), "doc_id long, text string", 4)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for length in (40, 60):
        out = repeats.digest(docs, length, 10, 10).collect()
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out}
        expected = plain_repeats([t.encode() for t in texts], length)
        assert [got[i] for i in range(len(texts))] == expected
        assert sum(e[1] for e in expected) > 1000


def test_repeats_of_the_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    expected = plain_repeats([rows[i].encode() for i in sorted(rows)], 400)
    out = sorted(repeats.digest(docs).collect())
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out] == expected
    for r in out:
        if "\ufffd" not in r.text:
            assert hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256
    assert all(r.text == rows[r.doc_id] for r in out if not r.n_removed)


def test_repeats_of_awkward_rows(awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    expected = plain_repeats([(t or "").encode() for _, t in rows], 400)
    got = [tuple(r)[:5] for r in repeats.digest(awkward).collect()]
    assert sorted(got, key=str) == sorted(((i, *e) for (i, _), e in zip(rows, expected)), key=str)
    assert repeats.digest(nothing).collect() == [] and repeats.cut(nothing).collect() == []


def test_cutting_keeps_columns_and_characters(spark, awkward, stored):
    cut = repeats.cut(awkward, 40, 10, 10)
    assert cut.columns == awkward.columns
    out = cut.collect()
    assert all(r.severity == "!" and (r.text is None or r.n_chars == len(r.text)) for r in out)
    assert sum(r.text is None for r in out) == 2
    shared = "é" * 30
    rows = [(i, f"{chr(233 + i)}{shared}{chr(333 + i)}", 0) for i in range(3)]
    folder = stored("other", rows, "doc_id long, text string, n_chars long")
    texts = {r.doc_id: r.text for r in repeats.cut(spark.read.parquet(f"{folder}/other.parquet"), 40, 10, 10).collect()}
    assert texts[1] == "êŎ" and texts[2] == "ëŏ"


def plain_passages(texts, least):
    """(runs, words, bytes covered) of word strings that start anywhere else."""
    found = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)] for t in texts]
    words = [[t[a:b] for a, b in bounds] for t, bounds in zip(texts, found)]
    seen = Counter(tuple(w[i : i + least]) for w in words for i in range(len(w) - least + 1))
    out = []
    for w, bounds, t in zip(words, found, texts):
        said = [False] * len(w)
        for i in range(len(w) - least + 1):
            if seen[tuple(w[i : i + least])] > 1:
                said[i : i + least] = [True] * least
        gone = set()
        for i, yes in enumerate(said):
            if yes:
                gone.update(range(bounds[i - 1][1] if i and said[i - 1] else bounds[i][0], bounds[i][1]))
        n = sum(yes and not (i and said[i - 1]) for i, yes in enumerate(said))
        out.append((n, sum(said), gone))
    return out


@pytest.mark.parametrize("many, at_once, block_bytes", [(2000, 2000, 1 << 20), (2, 5, 1 << 20), (3, 3, 120)])
def test_passages_of_over_fifty_words_are_found_below_the_byte_length(spark, stored, monkeypatch, many, at_once, block_bytes):
    monkeypatch.setattr(repeats, "MANY", many)
    monkeypatch.setattr(repeats, "AT_ONCE", at_once)
    monkeypatch.setattr(repeats, "BLOCK_BYTES", block_bytes)
    rng = random.Random(12)

    def prose(n):
        return " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 4))) for _ in range(n))

    shared = [prose(n) for n in (50, 51, 52, 60, 70)]
    texts = [f"{prose(rng.randint(0, 90))} {rng.choice(shared)}{rng.choice([' ', chr(10)])}{prose(rng.randint(0, 90))}" for _ in range(60)]
    # Other white space, glued words, a passage twice in one text, one word only, texts of white space.
    texts += [shared[1].replace(" ", "\t\n"), "x" + shared[1], f"{prose(9)} {shared[4]} {shared[4]}", "ha " * 51, "ha " * 52, " ", "", None]
    raw = [(t or "").encode() for t in texts]
    folder = stored("documents", list(enumerate(texts)), "doc_id long, text string", 3)
    out = sorted(repeats.digest(spark.read.parquet(f"{folder}/documents.parquet")).collect())
    passages, strings = plain_passages(raw, 51), plain_repeats(raw, 400)
    assert [(r.n_passages, r.n_passage_words) for r in out] == [p[:2] for p in passages]
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out] == strings
    assert sum(p[0] > 0 and not s[1] for p, s in zip(passages, strings)) > 20
    for r, t, (_, _, gone), s in zip(out, raw, passages, strings):
        if not s[1]:
            assert r.unique_text == bytes(b for i, b in enumerate(t) if i not in gone).decode()
            assert r.text == t.decode()
