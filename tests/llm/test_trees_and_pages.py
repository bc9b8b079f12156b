"""The manifest, the conversation trie and the page texts against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodgelens.llm import conversation_trie, html_blocks, html_text, merkle_manifest, running

# --- running positions ---------------------------------------------------------------------


def test_positions_and_xors_in_a_hot_key(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", (i * 7919) % 1000, i * 2654435761 % 2**63) for i in range(3000)]
    found = running.numbered(spark.createDataFrame(rows, "k string, o long, x long"), "k", ["o", "x"], ("x",)).collect()
    want = []
    for key in {r[0] for r in rows}:
        total = 0
        for i, (_, o, x) in enumerate(sorted(r for r in rows if r[0] == key)):
            total ^= x
            want.append((key, o, i, total))
    assert sorted((r["k"], r["o"], r["pos"], r["x"]) for r in found) == sorted(want)


# --- manifest ------------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string, n_chars long, g string, digest int, path string"


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def expected_manifest(rows):
    def leaf(doc, text, lang, source, chars):
        fields = (doc, source, lang, chars, text)
        return digest("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields)

    langs = defaultdict(list)
    for doc, text, lang, source, chars, *_ in rows:
        real = leaf(doc, text, lang, source, chars)
        hit = doc is not None and text is not None and zlib.crc32(str(doc).encode()) % 3 == 0
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        langs[lang].append((doc is not None, doc or 0, real, leaf(doc, lower, lang, source, chars) if hit else real))
    order = sorted(langs, key=lambda v: (v is not None, (v or "").encode()))
    trees = {v: tree([r[2] for r in sorted(langs[v])]) for v in order}
    top = tree([trees[v][-1][0] for v in order])
    out = []
    for number, v in enumerate(order):
        for at, (has, doc, real, now) in enumerate(sorted(langs[v])):
            siblings = []
            for levels, here in ((trees[v], at), (top, number)):
                for level in levels[:-1]:
                    run = level[here // 8 * 8 : here // 8 * 8 + 8]
                    siblings += run[: here % 8] + run[here % 8 + 1 :]
                    now = digest(run[: here % 8] + [now] + run[here % 8 + 1 :])
                    here //= 8
            out.append((doc if has else None, real, trees[v][-1][0], top[-1][0], digest(siblings), now, now == top[-1][0]))
    return out


def many_docs():
    rng = random.Random(5)
    langs = [None, "", "en", "de", "é", "zz", *[f"l{i}" for i in range(30)]]
    rows = [
        (rng.randrange(10**6), rng.choice(["Some Text", "lower only", "", None, "É ß Σ"]), rng.choice(langs[:4]) if i < 500 else rng.choice(langs),
         rng.choice(["web", None]), rng.choice([None, 0, 17]), "x", i, None)
        for i in range(700)
    ]
    long = ("Word " * 200_000, "en", "s", 1_000_000, "x", 0, None)
    return [*rows, (None, "No Id", "en", "s", 1, "x", 0, None), (None, None, None, None, None, None, None, None), (3, *long), *rows[:5], *rows[:2]]


@pytest.mark.parametrize("levels", [1, 4])
def test_manifest_equals_brute_force(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle_manifest, "LEVELS", levels)
    monkeypatch.setattr(merkle_manifest, "RUN", 8**levels)
    rows = many_docs()
    found = merkle_manifest.manifest(spark.createDataFrame(rows, DOCS).repartition(5))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, expected_manifest(rows)))


@pytest.mark.parametrize("count", [1, 8, 9, 65])
def test_manifest_of_one_language(spark, count):
    rows = [(i, f"Text {i}", "en", None, i, None, None, None) for i in range(count)]
    found = merkle_manifest.manifest(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(tuple, found)) == sorted(expected_manifest(rows))


def test_manifest_of_nothing(spark):
    assert merkle_manifest.manifest(spark.createDataFrame([], DOCS)).count() == 0


def test_midstates_resume_like_the_whole_hash():
    rng = np.random.default_rng(1)
    nodes = rng.integers(0, 256, (77, 32)).astype(np.uint8)
    levels, states = merkle_manifest.midstate_levels(nodes, 3)
    assert [x.tobytes().hex() for level in levels for x in level] == [x for level in tree([n.tobytes().hex() for n in nodes]) for x in level]
    assert (merkle_manifest.fold_run(nodes, levels[:-1], states) == levels[-1][0]).all()


# --- conversation trie ---------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, depth string, node long, w double"


def expected_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for path, convs in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(convs) - 1) * len(path[-1][1]) if path else 0
    return [
        (c[0], len(p), members[p[:-1]][0] if p else None, len(c), children[p], leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest())
        for p, c in members.items()
    ]


def some_conversations():
    rng = random.Random(11)
    rows = []
    for conv in [*range(60), *range(100, 240, 3), 1_000_000_007]:
        for turn in range(rng.randrange(1, 9)):
            text = rng.choice(["", None, "Hello", "ça va ☕", "same answer"]) if turn < 3 else f"{rng.randrange(3)}"
            rows.append((conv, turn, rng.choice(["user", "user", None]), text, "x", 1, 0.5))
    rows += [(300, None, "user", "null turn"), (300, 0, "user", "first"), (None, 0, "user", "no id"), (301, 5, "user", "w " * 100_000)]
    rows += [(400, i, "user", "chain") for i in range(300)] + [(402, i, "user", "chain") for i in range(180)]
    return [(*r, "x", 1, 0.5)[:7] for r in rows] + [(500, 0, "user", "twice", "x", 1, 0.5)] * 2


@pytest.mark.parametrize("component", [3, 20_000])
def test_trie_equals_brute_force(spark, monkeypatch, component):
    monkeypatch.setattr(conversation_trie, "COMPONENT", component)
    monkeypatch.setattr(conversation_trie, "IDS_PER_BLOCK", 2)
    rows = some_conversations()
    if component == 3:
        rows = [r for r in rows if r[0] is None or r[0] < 130 or r[0] == 400]
    found = conversation_trie.prefix_trie(spark.createDataFrame(rows, TURNS).repartition(5)).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected_trie(rows)))


def test_conversations_that_become_turnless_are_members_of_the_root(spark):
    lonely = next(c for c in range(1000, 1100) if zlib.crc32(str(c).encode()) % 6 > 1 and c % 100)
    rows = [(lonely, 0, "user", "gone", "x", 1, 0.0)]
    found = conversation_trie.prefix_trie(spark.createDataFrame(rows, TURNS)).collect()
    assert [tuple(r) for r in found] == expected_trie(rows) and len(found) == 1


def test_trie_of_nothing(spark):
    assert conversation_trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert conversation_trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x", "", 1, 0.0)], TURNS)).count() == 0


def test_centroid_sums_of_chains_stars_and_random_forests():
    rng = random.Random(3)
    for n in (1, 2, 7, 400):
        for shape in ("chain", "star", "random"):
            parent = [-1] + [i - 1 if shape == "chain" else 0 if shape == "star" else rng.randrange(-1, i) for i in range(1, n)]
            values = [(rng.randrange(9), 1) for _ in range(n)]
            want = [list(v) for v in values]
            for u in reversed(range(n)):
                if parent[u] >= 0:
                    want[parent[u]] = [a + b for a, b in zip(want[parent[u]], want[u], strict=True)]
            assert conversation_trie.centroid_sums(parent, values) == want


# --- page texts ----------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, text string, host int, tokens string"


def texts_of(spark, pages):
    rows = [(i, url, page, "x", 1, "y") for i, (url, page) in enumerate(pages)]
    found = html_text.main_text(spark.createDataFrame(rows, PAGES).repartition(3)).collect()
    assert all(r["n_chars"] == len(r["text"]) and r["url"] == rows[r["page_id"]][1] for r in found)
    return {r["page_id"]: r["text"] for r in found}


def test_markup_decides_what_is_an_article():
    page = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var a = "</p><article>no</article>";</script>
    </head><body class="has-sidebar"><header>Top</header><nav><ul><li>Menu<li>More</ul></nav><div class="ad">Buy</div>
    <article><h1>A &lt;title&gt;</h1><p><b>Bold&nbsp;text<br>  second
    line<p>Unclosed <i>one</i> &eacute;&#8364;&amp</p><aside>Side</aside><form>Name <input></form>
    <p title="a > b">After</p><table><tr><td>1<td>2</table><div class="comments"><p>First!</p></div></article>
    <div id="sidebar"><p>Links</p></div><footer>&copy; x</footer>"""
    kept = [b.text for b in html_blocks.blocks(page) if b.part == html_blocks.ARTICLE]
    assert kept == ["A <title>", "Bold text second line", "Unclosed one é€&", "After", "1", "2"]
    assert not [b for b in html_blocks.blocks(page) if b.part == html_blocks.LOOSE]


@pytest.mark.parametrize("page", ["", "<", "<p", "<!--", "<script>x", "</p></div>", "<p title='", "a < b > c", "&#0;&#xD800;&bogus;", "<b>" * 5000 + "x"])
def test_broken_pages_are_read(page):
    assert all(isinstance(b.text, str) and b.text for b in html_blocks.blocks(page))


def expected_loose(pages):
    """Texts of pages without articles: tokens under a window of a host's three or more pages go."""
    streams = {}
    for i, (url, page) in enumerate(pages):
        host = (url or "").partition("://")[2].split("/")[0]
        found = [b for b in html_blocks.blocks(page or "") if b.part != html_blocks.ARTICLE]
        words = [(w, n) for n, b in enumerate(found) for w in (f"<{b.place}>", *b.text.split(" "))]
        streams[i] = (host, found, words)
    seen = defaultdict(set)
    for host, found, words in streams.values():
        mine = tuple(b.text for b in found if b.part == html_blocks.LOOSE)
        for at in range(len(words) - html_text.LONG + 1):
            seen[host, tuple(w for w, _ in words[at : at + html_text.LONG])].add(mine)
    out = {}
    for i, (host, found, words) in streams.items():
        gone = set()
        for at in range(len(words) - html_text.LONG + 1):
            if len(seen[host, tuple(w for w, _ in words[at : at + html_text.LONG])]) >= html_text.PAGES:
                gone |= set(range(at, at + html_text.LONG))
        lines, place = [], 0
        for block in found:
            size = len(block.text.split(" ")) + 1
            kept = [words[j][0] for j in range(place + 1, place + size) if j not in gone]
            place += size
            if kept and block.part == html_blocks.LOOSE:
                lines.append(" ".join(kept))
        out[i] = "\n".join(lines)
    return out


@pytest.mark.parametrize("slice_tokens", [60, 500_000])
def test_hosts_give_up_what_they_repeat(spark, monkeypatch, slice_tokens):
    monkeypatch.setattr(html_text, "SLICE_TOKENS", slice_tokens)
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    pages = []
    for i in range(24):
        host = ["one.example.org", "two.example.org", "three.example.org/x"][i % 3]
        body = "".join(f"<p>{' '.join(word() for _ in range(rng.randrange(1, 30)))}</p>" for _ in range(3))
        notice = "<div>we use small files on your machine to count how often you come here</div><ul><li>home<li>about<li>terms<li>contact us</ul>"
        pages.append((f"https://{host}/{i}", f"<body>{notice if i % 3 else ''}{body}<div>all rights reserved by the people of this very site {i}</div>"))
    pages += [pages[0], pages[0], pages[0]]  # copies are one page
    pages += [(None, None), (None, "no markup at all"), ("nowhere", ""), ("https://one.example.org/a", "<article><p>we use small files on your machine to count how often you come here</p></article>")]
    found, want = texts_of(spark, pages), expected_loose(pages)
    want[len(pages) - 1] = "we use small files on your machine to count how often you come here"
    assert found == want
    assert "small files" not in found[1] and "small files" not in found[4] and found[0]


@pytest.mark.parametrize(("slice_tokens", "slots"), [(20, 1), (500_000, 1 << 22)])
def test_articles_tell_passages_from_boilerplate(spark, monkeypatch, slice_tokens, slots):
    monkeypatch.setattr(html_text, "SLICE_TOKENS", slice_tokens)
    monkeypatch.setattr(html_text, "SLOTS", slots)
    passage = "the river rose twice that spring and took the old bridge with it"
    notice = "we use small files on your machine to count how often you come here"
    copied = "nobody in the village could say where the letters had come from"
    pages = [("http://a.org/", f"<div>loose page {i}<p>{passage}</p><p>{notice}</p><p>{copied}</p></div>") for i in range(3)]
    pages += [("http://a.org/", f"<article><h1>number {i}</h1><p>{passage}</p></article><div>end {i}</div>") for i in range(2)]
    pages += [("http://a.org/", f"<nav>top</nav><main><p>{passage}</p><p>and more of it</p></main>")]
    pages += [("http://a.org/", f"<article><p>{copied}</p><p>{notice}</p></article>")] * 4  # copies are one article
    pages += [("http://b.org/", f"<div>other page {i}<p>{passage}</p></div>") for i in range(3)]  # articles of another host
    found = texts_of(spark, pages)
    assert [found[i] for i in range(3)] == [f"loose page {i}\n{passage}" for i in range(3)]
    assert [found[3 + i] for i in range(2)] == [f"number {i}\n{passage}\nend {i}" for i in range(2)]
    assert found[5] == f"{passage}\nand more of it"
    assert {found[i] for i in range(6, 10)} == {f"{copied}\n{notice}"}
    assert [found[10 + i] for i in range(3)] == [f"other page {i}" for i in range(3)]


def test_long_pages_and_empty_tables(spark):
    long = "<article>" + "".join(f"<p>paragraph {i} of a very long page</p>" for i in range(40_000)) + "</article>"
    assert texts_of(spark, [("http://a.b/c", long)])[0].count("\n") == 39_999
    assert html_text.main_text(spark.createDataFrame([], PAGES)).count() == 0


def test_hosts_with_fewer_tokens_than_a_long_substring(spark):
    for words in range(1, 9):
        text = " ".join("abcdefgh"[:words])
        assert texts_of(spark, [("http://a.b/c", f"<div>{text}</div>")]) == {0: text}
        assert all(not len(found) for found in html_text.suffix_runs(np.arange(min(words, 7), dtype=np.uint64), np.zeros(min(words, 7), int), 8))


def test_suffix_ranks_equal_prefixes():
    rng = np.random.default_rng(4)
    tokens, page = rng.integers(0, 3, 400).astype(np.uint64), np.sort(rng.integers(0, 9, 400))
    for depth in (1, 3, 5, 8):
        order, rank = html_text.suffix_runs(tokens, page, depth)
        prefix = {i: tuple(tokens[i : i + depth].tolist()) for i in order.tolist()}
        assert sorted(order.tolist()) == [i for i in range(400 - depth + 1) if page[i] == page[i + depth - 1]]
        assert all((prefix[a] == prefix[b]) == (x == y) for a, b, x, y in zip(order.tolist(), order[1:].tolist(), rank, rank[1:], strict=False))
        assert [prefix[i] for i in order.tolist()] == sorted(prefix.values())


def test_packed_rows_are_read_one_at_a_time():
    import pyarrow as pa

    from lodgelens.llm import merkle_manifest

    batch = pa.record_batch({"n": pa.array([1, 2, 3]), "doc_id": pa.array([[1], [2, 3], None])})
    rows = merkle_manifest._rows_of(batch)
    assert next(rows) == {"n": 1, "doc_id": [1]}
    assert list(rows) == [{"n": 2, "doc_id": [2, 3]}, {"n": 3, "doc_id": None}]
