"""Pre-tokens, token files, edit-aware counts and the piece codec."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gaugeflow.llm import pieces, recount, tokenfile
from gaugeflow.llm.arrowtext import blocks
from gaugeflow.llm.pretokens import Encoder
from gaugeflow.llm.registry import BYTE_BPE, PIECES, vocabulary

BPE = vocabulary(BYTE_BPE)
LIBRARY = Tokenizer.from_file(BPE)
ENCODER = Encoder(BPE)
ALPHABET = "ab z'stremvld  \n\t12é漢—’.,!?_ ß́  　"


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def encoded(texts, limit=1 << 21):
    out = [[] for _ in texts]
    for block in blocks(pa.array(texts, pa.string()), limit):
        ids, counts = ENCODER.encode(block)
        ends = np.cumsum(counts)
        for row, a, b in zip(block.rows, ends - counts, ends):
            out[row] += ids[a:b].tolist()
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(ALPHABET, max_size=40), st.text(max_size=20)), max_size=8))
def test_ids_are_those_of_the_library(texts):
    texts = [t and t.encode("utf-8", "ignore").decode() for t in texts]
    assert encoded(texts) == [library(t) for t in texts]


def test_special_names_and_cuts_of_long_texts():
    texts = ["<|endoftext|> a<|endoftext|>", "we'll " * 400 + "<|endoftext|>", "a b c d " * 500]
    assert encoded(texts, 64) == [library(t) for t in texts]


@pytest.mark.parametrize("top", [1, 300, 70_000, 1 << 31])
def test_packed_values_unpack(top):
    rng = np.random.default_rng(top)
    counts = rng.integers(0, 9, 50)
    values = rng.integers(0, top, counts.sum()).astype(np.uint32)
    control, control_at, data, data_at = tokenfile.pack(values, counts)
    assert np.array_equal(tokenfile.unpack(control, data, counts), values)
    ends = np.cumsum(counts)
    for i, (a, b) in enumerate(zip(ends - counts, ends)):
        own = slice(control_at[i], control_at[i + 1]), slice(data_at[i], data_at[i + 1])
        assert np.array_equal(tokenfile.unpack(control[own[0]], data[own[1]], counts[i : i + 1]), values[a:b])


def test_token_files_of_awkward_rows(awkward, monkeypatch):
    monkeypatch.setattr(tokenfile, "BUCKET_TOKENS", 5000)
    files = tokenfile.write(awkward, BPE)
    got = tokenfile.digests(files).collect()
    rows = sorted(
        ((r.doc_id, library(r.text) + [2]) for r in awkward.select("doc_id", "text").collect()),
        key=lambda r: (r[0] is not None, r[0] or 0, len(r[1])),
    )
    start, expected = 0, []
    for doc_id, ids in rows:
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == expected
    first = {r.start: np.frombuffer(r.ids, "<u4").tolist() for r in tokenfile.read(files).collect()}
    assert [first[e[1]] for e in expected] == [ids for _, ids in rows]


def test_frequent_ids_take_less_room(spark, awkward):
    files = tokenfile.write(awkward, BPE)
    counts = {}
    for row in awkward.select("text").collect():
        for i in library(row.text) + [2]:
            counts[i] = counts.get(i, 0) + 1
    ranks = [r.id for r in files.ranks.orderBy("rank").collect()]
    assert ranks == sorted(counts, key=lambda i: (-counts[i], i))


def test_token_files_of_no_rows(nothing):
    assert tokenfile.digests(tokenfile.write(nothing, BPE)).collect() == []


def changed(text, edits):
    for at, remove, insert in edits:
        at = min(max(at or 0, 0), len(text))
        text = text[:at] + (insert or "") + text[at + max(remove or 0, 0) :]
    return text


def test_counts_follow_random_edits(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.choice([0, 3, 50, 900, 3000])))
        if i % 7 == 0:
            text += "<|endoftext" + text
        edits = [
            (rng.randint(-3, len(text) + 5), rng.choice([0, 1, 5, 400]),
             rng.choice([None, "", "|>", " ", "\n\n  ", "it's", "word " * 30]))
            for _ in range(rng.randint(0, 6))
        ]
        rows.append((i, text, edits or None))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    edits = spark.createDataFrame([(r[0], r[2]) for r in rows], f"doc_id long, edits {recount.EDITS}")
    out = recount.recount(recount.build(docs, BPE).join(edits, "doc_id"), BPE).collect()
    assert len(out) == len(rows)
    for r in out:
        _, text, own = rows[r.doc_id]
        after = changed(text, own or [])
        assert r.text == after
        assert (r.n_before, r.n_after) == (len(library(text)), len(library(after)))
        assert sum(r.leaf_tokens) == r.n_after and sum(r.leaf_chars) == len(after)


def test_an_edit_of_a_long_text_encodes_little_again(spark):
    docs = spark.createDataFrame([(1, "some words of prose, " * 5000)], "doc_id long, text string")
    trees = recount.sample_edits(recount.build(docs, BPE))
    [r] = recount.recount(trees, BPE).collect()
    assert r.n_after == len(library(r.text)) and r.n_again < 600


def test_counts_of_awkward_rows(awkward, nothing):
    out = recount.recount(recount.sample_edits(recount.build(awkward, BPE)), BPE).collect()
    before = sorted((str(r.doc_id), len(library(r.text))) for r in awkward.select("doc_id", "text").collect())
    assert sorted((str(r.doc_id), r.n_before) for r in out) == before
    assert all(r.n_after == len(library(r.text)) for r in out)
    assert recount.build(nothing, BPE).collect() == []


def unigram_library(path):
    """The library's own unigram segmentation: the model file with its type set to unigram."""

    def number(raw, i):
        value = shift = 0
        while True:
            value |= (raw[i] & 127) << shift
            shift += 7
            i += 1
            if raw[i - 1] < 128:
                return value, i

    def coded(value):
        out = b""
        while value > 127:
            out += bytes([value & 127 | 128])
            value >>= 7
        return out + bytes([value])

    def fields(raw):
        i = 0
        while i < len(raw):
            start = i
            key, i = number(raw, i)
            content = b""
            if key & 7 == 2:
                size, i = number(raw, i)
                content, i = raw[i : i + size], i + size
            elif key & 7 == 0:
                _, i = number(raw, i)
            else:
                i += 4
            yield key >> 3, raw[start:i], content

    out = b""
    with open(path, "rb") as file:
        for key, whole, content in fields(file.read()):
            if key == 2:  # the trainer's settings, of which 3 is the model type, 1 unigram
                inner = b"".join(w for k, w, _ in fields(content) if k != 3) + b"\x18\x01"
                whole = b"\x12" + coded(len(inner)) + inner
            out += whole
    return sentencepiece.SentencePieceProcessor(model_proto=out)


MODEL = pieces.load(vocabulary(PIECES))


def pieces_of(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    ids, counts = pieces._encoded(batch, pieces.PieceEncoder(MODEL))
    data, ends = pieces.decode(MODEL, ids, counts)
    stops = np.cumsum(counts)
    return (
        [ids[b - c : b].tolist() for b, c in zip(stops, counts)],
        [data[a:b].tobytes().decode() for a, b in zip(ends, ends[1:])],
    )


def plain_pieces(text):
    """Best sum of scores over all segmentations, character by character."""
    text = (" " + text).replace(" ", pieces.MARK) if text else ""
    names = {n: i for n, i in KNOWN.items()}
    best = [(0.0, [])]
    for end in range(1, len(text) + 1):
        options = []
        for start in range(max(0, end - 16), end):
            piece = names.get(text[start:end])
            if piece is not None:
                options.append((best[start][0] + MODEL.scores[piece], best[start][1] + [piece]))
        if text[end - 1] not in names:
            raw = [int(MODEL.byte_ids[b]) for b in text[end - 1].encode()]
            options.append((best[end - 1][0] + MODEL.unknown, best[end - 1][1] + raw))
        best.append(max(options, key=lambda o: o[0]))
    return best[-1][1]


_LIB = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECES))
KNOWN = {
    _LIB.id_to_piece(i): i
    for i in range(_LIB.get_piece_size())
    if not (_LIB.is_control(i) or _LIB.is_unknown(i) or _LIB.is_byte(i))
}


def test_pieces_have_the_best_score():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab the  in\n漢𝄞é▁x,.") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    ids, decoded = pieces_of(texts)
    assert decoded == [t.replace("▁", " ") for t in texts]
    assert ids == [plain_pieces(t) for t in texts]
    assert [len(i) for i in ids] == [
        len(pieces.best_pieces(MODEL, (" " + t).replace(" ", "▁").encode())) if t else 0 for t in texts
    ]


def test_pieces_score_like_the_best_path_of_the_library(spark):
    unigram = unigram_library(vocabulary(PIECES))
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    lines = [x for t in texts for x in t.split("\n") if x and all(c == " " or c in KNOWN for c in x)]
    lines = sorted(lines, key=len)[:200]
    for own, line in zip(pieces_of(lines)[0], lines):
        best = unigram.nbest_encode_as_ids(line, 2)[0]
        assert sum(MODEL.scores[i] for i in own) == sum(MODEL.scores[i] for i in best)


def test_a_double_array_holds_its_keys():
    keys = {b"a": 0, b"ab": 1, b"abc": 2, b"b\xff": 3, "é".encode(): 4}
    base, check, value = pieces.double_array(keys)

    def find(word):
        node = 0
        for byte in word:
            child = base[node] + byte
            if check[child] != node or child == 0:
                return -1
            node = child
        return value[node]

    assert {k: find(k) for k in keys} == keys
    assert [find(w) for w in (b"", b"b", b"abcd", b"c", b"\x00")] == [-1] * 5


def test_piece_codec_of_awkward_rows(awkward, nothing):
    path = vocabulary(PIECES)
    out = pieces.digests(awkward, path).collect()
    assert len(out) == awkward.count() and all(r.restored for r in out)
    assert all((r.n_pieces == 0) == (not t) for r, t in zip(out, [x.text for x in awkward.select("text").collect()]))
    texts = pieces.decoded(pieces.encode(awkward, path), path).collect()
    given_ = sorted((str(r.doc_id), (r.text or "").replace("▁", " ")) for r in awkward.select("doc_id", "text").collect())
    assert sorted((str(r.doc_id), r.text) for r in texts) == given_
    assert pieces.digests(nothing, path).collect() == []
