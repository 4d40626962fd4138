"""Vector codes, prefix trie and page text against brute force."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from gaugeflow.llm import pagetext, prefixtrie, vectorcodes

VECTORS = "vec_id long, embedding array<float>, label int, code string, error string, vector string"
TURNS = "conv_id long, turn long, role string, text string, node string, depth string, chain string"
PAGES = "page_id long, url string, html string, row string, host string, text string, subtrees string"


# --- vector codes


def coded(rows, parts=16, entries=64, rounds=2):
    """The contract by plain integers."""
    kept = [
        (i, [math.floor(256 * x) for x in v], label)
        for i, v, label in rows
        if v and all(x is not None and math.isfinite(x) for x in v)
    ]
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    length = len(kept[0][1])
    kept = [(i, v + [0] * (-length % parts), label) for i, v, label in kept if len(v) == length]
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    book = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book[p]))

    for _ in range(rounds):
        groups = defaultdict(list)
        for c in cut:
            for p in range(parts):
                groups[p, nearest(p, c[p])[1]].append(c[p])
        for (p, k), found in groups.items():
            book[p][k] = [sum(x) // len(found) for x in zip(*found)]
    digest = hashlib.sha256(",".join(str(x) for p in book for e in p for x in e).encode()).hexdigest()
    out, by_label = [], defaultdict(int)
    for (i, _, label), c in zip(kept, cut):
        best = [nearest(p, c[p]) for p in range(parts)]
        error = sum(d for d, _ in best)
        by_label[label] += error
        out.append((i, "".join(f"{k:02x}" for _, k in best), error, label))
    return [(i, code, error, by_label[label], digest) for i, code, error, label in out]


def by_text(rows):
    return sorted(map(str, map(tuple, rows)))


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "!", "!", "!") for r in rows], VECTORS)


def test_vector_codes_equal_plain_arithmetic(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.2, 32)], int(i) % 3) for i in range(150)]
    rows = [(i, v, None if label == 2 else label) for i, v, label in rows]
    rows += [(7, rows[9][1], 1), (7, rows[9][1], 1), (500, rows[0][1], None), (None, rows[3][1], 0)]
    rows += [(600, None, 1), (601, [], 1), (602, [float("nan")] * 32, 1), (603, [None] + rows[0][1][1:], 1)]
    rows += [(604, [float("inf")] * 32, 1), (605, [0.5] * 31, 1), (606, [-0.001953125] * 32, 1)]
    got = vectorcodes.digest(vectors(spark, rows).repartition(5)).collect()
    assert by_text(got) == by_text(coded(rows))


def test_vector_codes_of_few_odd_and_huge_vectors(spark):
    few = [(3, [1.0, -1.0, 0.1], 1), (2, [0.0, 0.0, 0.0], 1)]
    got = vectorcodes.digest(vectors(spark, few)).collect()
    assert by_text(got) == by_text(coded(few))
    huge = [(1, [3e38] * 16, 1), (2, [-3e38] * 16, 1)]
    assert [r.error for r in vectorcodes.digest(vectors(spark, huge)).collect()] == [0, 0]


@pytest.mark.parametrize("rows", [[], [(1, None, 1), (2, [], None)]])
def test_no_vectors_no_codes(spark, rows):
    df = vectorcodes.digest(vectors(spark, rows) if rows else spark.createDataFrame([], VECTORS))
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert df.collect() == []


def test_blocks_are_split_and_decoded(spark, monkeypatch):
    monkeypatch.setattr(vectorcodes, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 16)], 0) for i in range(90)]
    blocks, books = vectorcodes.trained(vectors(spark, rows).coalesce(1))
    codes = vectorcodes.compressed(blocks, books).collect()
    assert by_text((r.vec_id, r.code, r.error) for r in codes) == by_text(r[:3] for r in coded(rows))
    back = {r.vec_id: r.vector for r in vectorcodes.decoded(vectorcodes.compressed(blocks, books), books).collect()}
    for r in codes:
        found = [math.floor(256 * x) for x in rows[r.vec_id][1]]
        assert sum((a - b) ** 2 for a, b in zip(found, back[r.vec_id])) == r.error


# --- prefix trie


def tried(rows):
    """The contract by plain dictionaries."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, x) for _, _, r, x in sorted(found)] for c, found in own.items()}
    made = {}
    for c, found in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = turns.get(c - c % 100, [])[:h] + found[h:]
    nodes = defaultdict(list)
    for c, found in made.items():
        for d in range(len(found) + 1):
            nodes[tuple(found[:d])].append(c)
    children = defaultdict(list)
    for n in nodes:
        if n:
            children[n[:-1]].append(n)
    out = []
    for n, members in nodes.items():
        below = [m for m in nodes if m[: len(n)] == n]
        ends = ",".join(str(c) for c in sorted(members) if len(made[c]) == len(n))
        out.append(
            (
                min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), len(children[n]),
                sum(not children[m] for m in below),
                sum((len(nodes[m]) - 1) * len(m[-1][1]) for m in below if m),
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return out


def talks(spark, rows):
    return spark.createDataFrame([(*r, "!", "!", "!") for r in rows], TURNS)


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def awkward_turns():
    rng = random.Random(3)
    rows = []
    for c in [*range(0, 40), *range(95, 140), 305, 306, 307, 400]:
        for t in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice("ab") * (t + 1)))
    rows += [(500 + c, t, "user", "same") for c in range(40) for t in range(12)]
    rows += [(600, None, None, None), (600, 1, "user", ""), (601, 0, "", None), (None, 0, "user", "nobody")]
    rows += [(602, 0, "system", "𐍈é" * 20_000), (602, 1, "user:1", "x"), (603, 0, "user", "1:x")]
    return rows


def test_trie_equals_plain_prefixes(spark):
    rows = awkward_turns()
    rng = random.Random(4)
    rng.shuffle(rows)
    got = prefixtrie.trie(talks(spark, rows).repartition(4)).select(*NODE).collect()
    assert by_text(got) == by_text(tried(rows))


def test_a_full_sketch_changes_no_result(spark):
    rows = awkward_turns()
    got = prefixtrie.trie(talks(spark, rows), sketch_bytes=1).select(*NODE).collect()
    assert by_text(got) == by_text(tried(rows))


def test_sketch_proves_most_singletons(spark):
    rows = [(c, t, "user", f"{c} {t}" if t else "hello") for c in range(0, 60) for t in range(6)]
    chained = prefixtrie.chains(prefixtrie.turn_digests(talks(spark, rows)))
    width = prefixtrie.sketch_width(360)
    counts = prefixtrie.sketch(chained, width)
    cut = prefixtrie.screened(chained, width, counts).collect()
    # One shared turn, then singletons; a few may collide.
    assert sum(r.head == 2 for r in cut) >= 50
    assert all(r.head >= 2 for r in cut)


def test_ids_of_a_node_over_many_parts(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "IDS_AT_ONCE", 3)
    rows = [(c, 0, "user", "same") for c in range(0, 300, 3)]
    got = prefixtrie.trie(talks(spark, rows)).select(*NODE).collect()
    assert by_text(got) == by_text(tried(rows))


def test_no_turns_no_nodes(spark):
    assert prefixtrie.trie(spark.createDataFrame([], TURNS)).collect() == []


# --- page text


def page(n, article, extra=""):
    return (
        f"<!DOCTYPE html><html><head><title>t{n}</title><script>var x='<p>no</p>'</script></head><body>"
        f"<nav><a href=x>Menu {n}</a></nav>{extra}{article}<footer>&copy; {n}</footer></body></html>"
    )


def texts(spark, rows):
    df = spark.createDataFrame([(*r, "!", "!", "!", "!") for r in rows], PAGES)
    return {r.page_id: r for r in pagetext.digest(df.repartition(3)).collect()}


def test_blocks_and_what_never_is_main_text():
    def found(html):
        root = pagetext.parsed(html)
        tops, marked = pagetext.main_elements(root)
        return pagetext.blocks(tops, set(), set(), marked)

    assert found(
        "<body><header>Site<h1>Site</h1></header><article class='post with-sidebar'><header><h1>A &amp;amp; b</h1>by me"
        "</header><p>one<br>two <b>three</b>&nbsp;\n four<p>five<ul><li>six<li>seven</ul><table><tr><td>1<td>2"
        "<tr><td>3</table><div class=cookieNotice>no</div><div id='ad-1'>no</div><div role=alert>no</div>"
        "<section id=comments><article class=comment><p>no</p></article></section><form>no</form>"
        "<p hidden>no<p style='display: none'>no</article><aside>no</aside></body>"
    ) == ["A &amp; b", "one two three four", "five", "six", "seven", "1 2", "3"]
    assert found("<p>x &am &amp y &#x41;&#66; <div>a < b <!-- no --> c</div><b>last") == ["x &am & y AB", "a < b c", "last"]
    assert found("<title>no</title><style>p{}</style>plain") == ["plain"]
    assert found("<main><p>in</p></main><p>out</p>") == ["in"]
    assert found("<div class='entry-content'><p>in</p></div><div>out</div>") == ["in"]
    assert found("<div " * 3) == [] and found("") == [] and found("<<<>>>") == ["<<<>>>"]
    deep = "<div>" * 20_000 + "deep" + "</div>" * 20_000
    assert found(deep) == ["deep"]


def test_recurring_blocks_of_a_host_go(spark):
    notice = "<div><b>We moved</b> to a new place</div>"
    rows = [(i, "http://a.example/x", page(i, f"<p>own {i}</p>{notice}<p>more {i}</p>")) for i in range(8)]
    rows += [(20 + i, "http://b.example/x", page(i, f"<p>own {i}</p>{notice}")) for i in range(2)]
    got = texts(spark, rows)
    assert got[3].text == "own 3\n\nmore 3" and got[3].n_chars == 13
    assert got[20].text == "own 0\n\nWe moved to a new place"


def test_recurring_words_of_marked_articles_stay(spark):
    quoted = "<p>A passage that many pages quote.</p>"
    rows = [
        (i, "http://a.example/x", page(i, f"<article><p>own {i}</p>{quoted if i % 3 else ''}</article>")) for i in range(30)
    ]
    # Copies of one page are no template either.
    rows += [(100 + i, "http://c.example/x", page(i, "<article><div><p>copied</p></div></article>")) for i in range(40)]
    got = texts(spark, rows)
    assert got[1].text == "own 1\n\nA passage that many pages quote."
    assert got[100].text == "copied"


def test_a_notice_on_nearly_all_pages_goes_from_articles_too(spark):
    rows = [
        (i, "http://a.example/x", page(i, f"<article><p>own {i}</p><p>Sign up!</p></article>")) for i in range(25)
    ]
    assert {r.text for r in texts(spark, rows).values()} == {f"own {i}" for i in range(25)}


def test_awkward_pages(spark):
    words = " ".join(["long"] * 200_000)
    rows = [(1, None, None), (2, "nonsense", ""), (None, "http://a.example", f"<p>{words}"), (3, None, "no tags")]
    rows += [(4, "http://u:p@A.example:80/x", "<article></article>")] * 2
    df = spark.createDataFrame([(*r, "!", "!", "!", "!") for r in rows], PAGES)
    got = pagetext.digest(df).collect()
    assert len(got) == 6
    by_id = {r.page_id: r for r in got}
    assert by_id[1].text == by_id[2].text == by_id[4].text == "" and by_id[1].n_chars == 0
    assert by_id[None].text == words and by_id[3].text == "no tags"
    hosts = spark.createDataFrame([("http://u:p@A.example:80/x",), (None,), ("x",)], "url string")
    assert [r[0] for r in hosts.select(pagetext.host(hosts.url)).collect()] == ["a.example", "", ""]
    assert pagetext.digest(spark.createDataFrame([], PAGES)).collect() == []
