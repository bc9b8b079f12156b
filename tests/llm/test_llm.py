"""The ten operators and the pipeline on small tables, against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodgelens.llm import (
    attention_lm,
    decontaminate,
    embedding_dedup,
    language_id,
    license_scan,
    lm_scoring,
    packing,
    pii,
    shingle_join,
    subwords,
    toxicity,
    url_filter,
    words,
)

SMALL = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, score int, held_out string"
LONG = " ".join(f"word{i % 997} of{i}" for i in range(30_000))


def ids(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    rows = [
        (1, None, "en", 1, "x"),
        (2, "", "en", 1, "x"),
        (3, " \n\t", None, 1, None),
        (4, "12 34 ...", "en", 1, "x"),
        (5, "the same words again and again here", "en", 1, "x"),
        (5, "the same words again and again here", "en", 1, "x"),
        (6, "The SAME words again and again here", "en", 1, "x"),
        (None, "the same words again and again here", "en", None, "x"),
        (7, LONG, "en", 1, "x"),
        (8, LONG + " more", None, 1, "x"),
        (9, "ein kurzer satz mit wörtern für die sprache", "de", 1, "x"),
        (10, "four words only here", "en", 1, "x"),
        (11, "é" * 70 + " naïve,straße ΑΒΓΣ x²½ don't <|endoftext|> 日本語", "fr", 1, "x"),
    ]
    return spark.createDataFrame(rows, KIND).repartition(3)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def sets_of(text):
    w = ids(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_words_split_on_ascii_space_only():
    texts = pa.array(["A\x0bB\x1cc d  E", None, "", "x"])
    split, doc = words.split_words(texts)
    assert split.to_pylist() == ["a", "b\x1cc d", "e", "x"] and doc.tolist() == [0, 0, 0, 3]


def test_slices_keep_every_row():
    texts = ["ab " * 500_000, None, "", *["é z"] * 20_000]
    batch = pa.record_batch([pa.array(texts), pa.array(range(len(texts)))], names=["text", "n"])
    parts = list(words.slices(iter([batch])))
    assert len(parts) > 2 and [n for p in parts for n in p["n"].to_pylist()] == list(range(len(texts)))
    assert [t for p in parts for t in p["text"].to_pylist()] == texts


def test_array_merges_equal_the_library(odd):
    code = subwords.WordEncoder(subwords.default_tokenizer())
    texts = [r["text"] for r in odd.collect()] + ["we're, it's'll &&& 123abc \x1c ﬁ İx " + "a" * 60]
    found, count = code.encode(pa.array(texts))
    ends = np.cumsum(count)
    for text, end, n in zip(texts, ends, count, strict=True):
        assert found[end - n : end].tolist() == code.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_windows_score_each_id_once():
    per_doc = np.array([0, 1, 31, 32, 33, 200])
    stream = np.arange(per_doc.sum()) + 10
    x, y, scored, doc = attention_lm.cut_windows(stream, per_doc, 7)
    ends = np.insert(stream, np.cumsum(per_doc), 7)
    assert y[scored].tolist() == ends.tolist()
    assert np.bincount(doc, weights=scored.sum(1)).tolist() == (per_doc + 1).tolist()
    first = np.append(True, doc[1:] != doc[:-1])
    assert (x[first, 0] == 7).all() and (x[:, 1:][scored[:, 1:]] == y[:, :-1][scored[:, 1:]]).all()


def test_cutting_windows_takes_little_more_than_the_windows():
    import tracemalloc

    per_doc = np.array([300_000, 0, 200_000, 5])
    stream = np.arange(per_doc.sum(), dtype=np.uint16)
    tracemalloc.start()
    try:
        whole = attention_lm.cut_windows(stream, per_doc, 7)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 2 * sum(part.nbytes for part in whole)
    blocks = list(attention_lm.window_blocks(stream, per_doc, 7, 100))
    assert max(len(b[0]) for b in blocks) == 100
    for part, pieces in zip(whole, zip(*blocks, strict=True), strict=True):
        assert (part == np.concatenate(pieces)).all()


def test_attention_learns_and_sums_to_one():
    rng = np.random.default_rng(0)
    size, counts = 50, np.ones(51)
    vocabulary = attention_lm.Vocabulary(size, counts)
    after = np.ones((vocabulary.contexts, len(vocabulary.seen)))
    vocabulary.set_classes(after)
    by_row = np.ones((vocabulary.rows, attention_lm.CLASSES))
    model = attention_lm.Model(vocabulary, *attention_lm.tables(vocabulary, by_row, after), attention_lm.initial(vocabulary.rows))
    # Position 3 repeats position 0: only attention can tell.
    x = rng.integers(0, size, (400, attention_lm.WINDOW))
    y = np.roll(x, 3, axis=1)
    scored = np.ones(x.shape, bool)
    scored[:, :3] = False
    before = model.log_probability(x, y)[scored].mean()
    model.load(model.train(x, y, scored, 150, 0.02, 1))
    assert model.log_probability(x, y)[scored].mean() > before
    one = x[:1].repeat(51, axis=0)
    target = one.copy()
    target[:, 5] = np.arange(51)
    assert np.exp(model.log_probability(one, target)[:, 5]).sum() == pytest.approx(1, abs=1e-3)


def test_scoring_counts_and_base(spark, odd):
    rows = odd.collect()
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0
    tokens = [(r["doc_id"], [*ids(r["text"]), None]) for r in rows]
    counts = Counter(t for i, w in tokens if not held(i) for t in w)
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (str(i), len(w), sum(counts[t] > 0 for t in w), round(sum(np.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in w), 4))
        for i, w in tokens
    )
    found = lm_scoring.score_texts(odd).collect()
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in found)
    assert got == want
    assert {r["train_tokens"] for r in found} == {n} and all(r["score"] < 0 and r["held_out"] == held(r["doc_id"]) for r in found)


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(v - 9 * (v > 9) for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits)))) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            bad = kind == "ip" and any(int(p) > 255 for p in m[0].split("."))
            bad |= kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits))
            bad |= kind == "phone" and not 9 <= len(digits) <= 15
            if not bad:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


HARD = [
    "a@b.c+d@e.f x@@y.z é😀 me@x.org 1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.4 +1 (555) 123-4567. 4111 1111-1111 1111 +12+123456789 " * 100,
    "a" * 100_000 + "@",
    "1" * 50_000,
    "1-" * 20_000,
    "a.b" * 20_000 + "@c" + ".d" * 20_000,
    "+1" + "((" * 20_000,
]


def test_personal_data(spark, odd):
    extra = spark.createDataFrame([(100 + i, t, None, None, None) for i, t in enumerate(HARD)], KIND)
    docs = odd.unionByName(extra)
    texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    want = sorted((str(i), hashlib.sha256(base_spans(t).encode()).hexdigest()) for i, t in texts)
    got = sorted((str(r["doc_id"]), r["base_sha256"]) for r in pii.find_pii(docs).collect())
    assert got == want


def test_checksums_context_and_redaction(spark):
    text = "iban GB82 WEST 1234 5698 7654 32 and GB83 WEST 1234 5698 7654 32, ssn 123-45-6789 é 1.1.1.1@x.org end"
    docs = spark.createDataFrame([(1, text), (2, "123-45-6789"), (3, None)], "doc_id long, text string")
    found = by_id(pii.find_pii(docs))
    kinds = [s.split(":")[0] for s in found[1]["spans"].split(",")]
    assert kinds == ["iban", "ssn", "email", "ip"] and found[2]["spans"] == ""
    clean = by_id(docs.select("doc_id", pii.redacted(F.col("text")).alias("text")))
    assert clean[1]["text"] == "iban [IBAN] and GB83 WEST 1234 5698 7654 32, ssn [SSN] é [EMAIL] end" and clean[3]["text"] is None


def test_toxicity_finds_words_of_toxic_texts(spark, odd):
    rng = np.random.default_rng(1)
    plain = [f"{a}{b}" for a in ("lo", "mi", "ta", "re", "su") for b in ("na", "ve", "ko", "pi")]
    rows, labels = [], []
    for i in range(400):
        text = list(rng.choice(plain, 80))
        if i % 4 == 0:
            for at in rng.integers(0, 80, 5):
                text[at] = str(rng.choice(["worthless", "pathetic", "disgusting"]))
        rows.append((1000 + i, " ".join(text) + f" {i}"))
        labels.append((1000 + i, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    truth = dict(labels)
    found = toxicity.score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(found) == 413 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    held = [r for r in found if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    none = toxicity.score_toxicity(odd, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len(none) == 13 and len({r["score"] for r in none}) == 1


def test_license_texts_in_other_dress(spark):
    mit = dict(license_scan.LICENSES[::-1])["MIT"]
    full = license_scan.LICENSES[1][1]
    rows = [
        (1, "Copyright (c) 2024 Someone\n\n" + full.upper().replace(",", " ;")),
        (2, full + " and more"),
        (3, "some prose\n * Licenced under CC BY-NC 4.0\nmore"),
        (4, None),
        (5, mit),
    ]
    found = by_id(license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [found[i]["license_id"] for i in range(1, 6)] == ["MIT", None, None, None, "MIT"]
    assert found[3]["notices"] == "CC-BY-NC-4.0" and found[4]["notices"] == ""


def dressed(text, name, rng):
    """The same licence as people store it: other wrapping, comments, case, spellings, notices."""
    words = text.split()
    wide = " ".join(words)
    lines, line = [], []
    for w in words:
        line.append(w)
        if rng.random() < 0.2:
            lines.append(" ".join(line))
            line = []
    lines.append(" ".join(line))
    yield wide
    yield "\n".join(words)
    yield "\n".join(lines).upper()
    yield "".join(f" * {x}\r\n" for x in lines)
    yield wide.replace("license", "licence").replace("License", "Licence").replace('"', "\u201c")
    if "permission" in text.lower() or "redistribution" in text.lower():
        yield f"Copyright (c) 2020 A. {wide}"
        yield f"# Copyright 1999-2021, Anna B. Example\n# © the others\n# All rights reserved.\n\n{text}"
        yield f"(c) 2011 X {wide}\n\nCopyright © someone"
        yield f"{name} License Copyright (c) 2020 A and B\u2028{wide}"


def test_every_license_in_other_dress(spark):
    rng = np.random.default_rng(4)
    texts = [(n, t) for n, t in license_scan.LICENSES if "License\n\n" not in t and "(MIT)" not in t]
    titled = {"MIT", "ISC", "Zlib", "BSD-2-Clause", "BSD-3-Clause"}
    rows, want = [], {}
    for name, text in texts:
        for copy in dressed(text, name, rng):
            whole = " License Copyright (c) 2020 A and B\u2028" not in copy or name in titled
            rows.append((len(rows), copy))
            want[len(rows) - 1] = name if whole else None
            for changed in (copy + "\nand more", copy.replace("the", "teh").replace("THE", "TEH").replace("BY", "BI") + "\nx y"):
                rows.append((len(rows), changed))
                want[len(rows) - 1] = None
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", "copyright notice", LONG, "Copyright (c) 2020 A."])]
    rows += [(None, license_scan.LICENSES[0][1])] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license_id", F.lit("x")).withColumn("digest", F.lit(1))
    found = license_scan.scan_licenses(docs).collect()
    assert len(found) == len(rows) and sum(r["doc_id"] is None and r["license_id"] == "MIT" for r in found) == 2
    assert {r["doc_id"]: r["license_id"] for r in found if r["doc_id"] in want} == want
    con = duckdb.connect()
    documents = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())})
    con.register("documents", documents)
    other = con.sql(license_scan.scan_sql()).select("doc_id, canonical_sha256, license_id, notices").fetchall()
    assert sorted(map(repr, other)) == sorted(repr(tuple(r)) for r in found)


def test_a_license_keeps_its_own_words(spark):
    kept = ["provided that the above\ncopyright notice and this\ncopyright notice", "(c) You must retain all", "copyright law"]
    rows = [(i, t) for i, t in enumerate(kept)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", license_scan.canonical(F.col("text")).alias("c"))
    assert [r["c"].count("copyright") + r["c"].count("c you") for r in docs.orderBy("doc_id").collect()] == [2, 1, 1]


def brute_components(sets):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    names = sorted(sets)
    for k, a in enumerate(names):
        for b in names[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in names}


def test_jaccard_components(spark, odd):
    rng = np.random.default_rng(3)
    common = [f"c{i}" for i in range(60)]
    rows = []
    for i in range(60):
        n = int(rng.integers(3, 150))
        text = [f"w{x}" for x in rng.integers(0, 4000, n)]
        rows.append(text + common if i % 3 == 0 else text)
    for i in range(90):  # near copies on both sides of the threshold
        text = list(rows[i % 12])
        for at in rng.integers(0, len(text), int(rng.integers(1, 3))):
            text[at] = f"x{int(rng.integers(0, 1000))}"
        rows.append(text[: len(text) - int(rng.integers(0, 4))])
    table = [(100 + i, " ".join(t)) for i, t in enumerate(rows)]
    docs = spark.createDataFrame(table, "doc_id long, text string").unionByName(odd.select("doc_id", "text")).repartition(5)
    want = {r["doc_id"]: sets_of(r["text"]) for r in docs.collect() if r["doc_id"] is not None}
    roots = brute_components(want)
    found = shingle_join.jaccard_components(docs).collect()
    assert len(found) == docs.count()
    for r in found:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == (len(want[r["doc_id"]]), roots[r["doc_id"]])
    assert len(set(roots.values())) < len(roots) - 20


def test_join_exchanges_are_small(spark):
    """A group key travels as 32 bits next to its owner's count, and repeats of an id need no exchange of their own."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(300))) for i in range(40)], "doc_id long, text string")
    rows = shingle_join._packed_keys(docs, 8).collect()
    keys = shingle_join.set_digests(docs).selectExpr("sum(keys + keys_up) AS n").first()["n"]
    assert sum(len(r["keys"]) for r in rows) == 4 * keys
    assert sum(len(r["held"]) + len(r["owners"]) for r in rows) < keys
    assert sum(np.frombuffer(r["held"], "<u1").sum(dtype=int) for r in rows) == keys
    ids = shingle_join.set_digests(docs).where("doc_id % 4 = 0").select("doc_id", "h1")
    found = shingle_join.sets_of(docs.union(docs.limit(3)), ids)
    assert {r["doc_id"]: r["n"] for r in found.collect()} == {i: 296 for i in range(0, 40, 4)} and found.count() == 10
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = shingle_join.sets_of(docs, ids)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2


def test_tree_bound_keeps_every_link():
    rng = np.random.default_rng(0)
    counts = rng.poisson(4, (80, 64))
    counts[40:] = counts[:40] + rng.integers(0, 2, (40, 64)) * (rng.random((40, 64)) < 0.05)
    side = {"root": np.arange(80), "n": counts.sum(1), "counts": counts}
    x, y = shingle_join.tree_pairs(side, None)
    least = np.minimum(counts[:, None], counts[None]).sum(2)
    near = 9 * least >= 4 * (side["n"][:, None] + side["n"][None])
    want = {(a, b) for a, b in zip(*np.nonzero(near), strict=True) if a < b}
    assert {tuple(sorted(p)) for p in zip(x.tolist(), y.tolist(), strict=True)} == want and len(want) >= 40


def test_tree_compares_sets_inside_a_leaf():
    """Linked sets of different roots in one leaf, and in leaf i of both chunks; negative ids too."""
    rng = np.random.default_rng(1)
    counts = rng.poisson(4, (10, 64)).repeat(2, axis=0)
    counts[1::2, 0] += 1
    root = np.arange(20) - 10
    side = {"root": root, "n": counts.sum(1), "counts": counts}
    x, y = shingle_join.tree_pairs(side, None)
    assert sorted(zip(x.tolist(), y.tolist(), strict=True)) == [(i, i + 1) for i in range(0, 20, 2)]
    left, right = ({k: v[at::2] for k, v in side.items()} for at in (0, 1))
    x, y = shingle_join.tree_pairs(left, right)
    assert sorted(zip(x.tolist(), y.tolist(), strict=True)) == [(i, i) for i in range(10)]
    one = side | {"root": root // 2}
    assert not len(shingle_join.tree_pairs(one, None)[0])


def test_benchmark_leaks(spark, odd):
    item = "In 1998 the engineer Marta walked 12 km from the old harbour to the quiet library near Porto and read 3 books"
    other = item.replace("1998", "2005").replace("Marta", "Elena").replace("12 km", "15 miles").replace("Porto", "Lyon")
    mixed = "in 1998 an engineer ran home and near the library of Porto someone read other books about 12 things"
    rows = [(100, f"Some words before. {item} and after"), (101, f"intro {other}"), (102, mixed), (103, item.lower())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    items = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "", "x"), (4, "only three words", "x")], "item_id long, text string, doc_id string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, items).collect()}
    assert {(100, 1), (101, 1)} <= found and not {d for d, _ in found} & {102, 5, 7, None}
    kept = decontaminate.without_leaks(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len({d for d, _ in found})
    assert decontaminate.find_leaks(docs, items.limit(0)).count() == 0


def leaked(items, text):
    return {i for _, i, _, _ in decontaminate.Templates(list(range(len(items))), items).search(pa.array([text]))}


def test_siblings_do_not_hide_a_leak():
    item = "A train leaves the city of Porto with 120 people and after 3 stops there are 45 people left in it, so how many went?"
    one = item.replace("Porto", "Lyon").replace("120", "300").replace("3 stops", "7 stops").replace("45", "81")
    two = item.replace("Porto", "Turin").replace("120", "90").replace("3 stops", "2 stops").replace("45", "17")
    assert leaked([item], f"{item} {one}") == leaked([item], f"{one} {item} {item} {two}") == {0}
    assert leaked([item, one, two], f"1) {one} 2) {item} 3) {two}") == {0, 1, 2}
    added = item.replace("people left in", "quite happy people left in")
    assert leaked([item], f"{one} and {added} and {two}") == {0}
    numbers = "add 4 8 15 16 23 42 99 7 5 and then halve what you found in the end to get it"
    table = " ".join(str(x * 37 % 101) for x in range(300))
    assert leaked([numbers], f"{table} {numbers} {table}") == {0}
    assert leaked(["4 8 15 16 23 42 99 7 5"], table) == set()
    assert leaked(["4 8 15 16 23 42 99 7 5"], f"{table} 4 8 15 16 23 42 99 7 5 {table}") == {0}


@pytest.mark.parametrize("before", ["", "Question:", "Q:", "A Heading\n", 'He said "no."', "they asked me", "3.", "(12)", "Over."])
def test_opening_word_after_anything(before):
    items = ["What is the capital of France?", "Days have how many long hours", "- Who wrote it down"]
    for i, item in enumerate(items):
        assert leaked(items, f"{before} {item} and so on") == {i}
    assert leaked(items, f"{before} Who wrote it down") == {2}
    assert leaked(items, f"{before} Paris is the capital of France. Weeks have how many long hours? Bob wrote it down") == set()


def test_short_items():
    items = ["Who discovered radium?", "Paris", "New York", "add 12 apples", "7 8 9"]
    assert leaked(items, "It was asked: who discovered Radium, and by whom. Later the answer came.") == {0}
    assert leaked(items, "At noon Who discovered radium? they cried") == {0}
    # Other words, other numbers, or the words apart.
    assert leaked(items, "Bob discovered radium in Paris and New York; who then discovered radium, add 13 apples, 7 8 10") == set()
    assert leaked(items, "then add 12 apples to 6 7 8 9 pears") == {3, 4}
    assert leaked(items, "paris") == {1} and leaked(items, "New York.") == {2}


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 16))
    near = base[:40].repeat(6, axis=0) + rng.normal(size=(240, 16)) * 0.05
    rows = [(i, v.tolist()) for i, v in enumerate(np.vstack([base, near, base[:5], 2 * base[:5]]))]
    odd_rows = [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [None] * 16), (9005, []), (9006, [1.0, 0.0]), (9007, [2.0, 0.0])]
    table = spark.createDataFrame(rows + odd_rows, "vec_id long, embedding array<double>").withColumn("n_links", F.lit("x"))
    found = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(table.repartition(4)).collect()}
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    links = x @ x.T >= 0.95
    truth = links.sum(1) - 1
    got = np.array([found[i]["n_links"] for i in range(len(x))])
    assert (got <= truth).all() and got.sum() >= 0.98 * truth.sum()
    assert [found[i]["n_links"] for i in (9001, 9002, 9003, 9004, 9005, 9006)] == [0, 0, 0, 0, 0, 1]
    assert found[9007]["component_id"] == 9006 and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found.values())


def test_language(spark, odd):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    found = language_id.identify(docs).collect()
    held = [r for r in found if r["held_out"]]
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.9
    rows = language_id.identify(odd).collect()
    assert len(rows) == 13 and all(r["lang_pred"] == "und" for r in rows if r["doc_id"] in (1, 2, 3, 4))
    assert language_id.accepted(odd).count() == 9 and language_id.accepted(odd).columns == odd.columns
    assert {r["lang_pred"] for r in language_id.identify(odd, odd.limit(0)).collect()} == {"und"}


def brute_language(known, text):
    """Out-of-place distance written out, over Counters."""
    def ranks(texts):
        grams = Counter()
        for t in texts:
            for w in "".join(c if c.isalpha() else " " for c in t.lower()).split():
                padded = f" {w} "
                grams.update(w)
                grams.update(padded[i : i + 2] for i in range(len(padded) - 1))
                grams.update(padded[i : i + 3] for i in range(len(padded) - 2))
        number = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
        ordered = sorted(grams, key=lambda g: (-grams[g], number(g)))
        return ordered[: language_id.PROFILE]

    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    own, far = ranks([text]), {}
    for lang, texts in known.items():
        place = {g: i for i, g in enumerate(ranks(texts))}
        far[lang] = sum(min(abs(place[g] - i), language_id.PROFILE) if g in place else language_id.PROFILE for i, g in enumerate(own))
    best = min(sorted(far), key=far.get)
    return best, 1 - far[best] / (language_id.PROFILE * len(own))


def invented(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghij"), 4)) for _ in range(n))


def test_language_equals_brute_force_in_any_number_of_passes(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(None if i % 7 == 0 else i, invented(rng, 12), f"l{i % 23:02d}") for i in range(120)]
    rows += [(500, "", "l01"), (501, None, "l02"), (502, "12 3", "l03"), (503, rows[4][1], "l04"), (503, rows[4][1], "l04")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("_lang", F.lit("x")).repartition(4)
    known = {}
    for i, text, lang in rows:
        if text is not None and zlib.crc32(b"" if i is None else str(i).encode()) % 3 != 1:
            known.setdefault(lang, []).append(text)
    want = sorted((repr(i), *brute_language(known, t)) for i, t, _ in rows)
    for size in (500, 8):
        monkeypatch.setattr(language_id, "LANGUAGES_PER_PASS", size)
        assert len(language_id.profiles(docs)) == -(-len(known) // size)
        found = sorted((repr(r["doc_id"]), r["lang_pred"], r["score"]) for r in language_id.identify(docs).collect())
        assert [f[:2] for f in found] == [w[:2] for w in want]
        assert np.allclose([f[2] for f in found], [w[2] for w in want])


def test_every_language_is_learned(spark):
    rng = np.random.default_rng(7)
    rows = [(None, f"{invented(rng, 3)} {'xyz'[i % 3]}{chr(0x4E00 + i)}", f"l{i:03d}") for i in range(520)]
    rows += [(None, "die Wohnung ist sehr schön und nicht laut", "de")] * 5
    found = language_id.profiles(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert [len(x) for x in found] == [500, 21] and set(found[0]) | set(found[1]) == {r[2] for r in rows}


def test_equal_rows_of_a_large_language_are_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_PER_LANGUAGE", 1)
    rows = [(None, "die Wohnung ist sehr schön", "de")] * 300 + [(None, "the flat is very nice", "en")] * 300
    found = {r["lang_pred"] for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert found == {"de", "en"}


def test_long_texts_count_like_short_ones(monkeypatch):
    text = "Ünïcode and, more words " * 50
    codes, counts = language_id.ngrams(text)
    monkeypatch.setattr(language_id, "CHUNK", 7)
    again = language_id.ngrams(text)
    assert (codes == again[0]).all() and (counts == again[1]).all()


def test_packing(spark, odd):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    docs = docs.where("doc_id IS NULL OR doc_id <> 5").repartition(3)
    rows = packing.pack(docs).toPandas()
    filled = rows.sort_values(["sequence_id", "offset"])
    assert (filled.groupby("sequence_id").length.cumsum() - filled.length == filled.offset).all()
    sizes = rows.groupby("sequence_id").length.sum()
    assert sizes.max() <= 4096 and len(sizes) <= -(-rows.length.sum() // 4096) + 1
    code = subwords.WordEncoder(subwords.default_tokenizer())
    want = Counter()
    for r in docs.collect():
        stream = np.array([*code.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(stream), 4096):
            part = stream[k : k + 4096]
            want[(str(r["doc_id"]), k // 4096, k, len(part), zlib.crc32(part.tobytes()))] += 1
    got = Counter(
        (str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packing.pack(docs).collect()
    )
    assert got == want
    assert packing.pack(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(4097, np.int64)
    counts[rng.integers(1, 4097, 300)] = rng.integers(1, 50, 300)
    if seed == 3:
        counts[:] = 0
        counts[[4096, 1500]] = 5, 1000
    plan = packing.plan_packing(counts)
    used = Counter()
    for n in np.flatnonzero(counts):
        mine = sorted(plan[plan[:, 0] == n].tolist(), key=lambda r: r[1])
        assert mine[0][1] == 0 and mine[-1][2] == counts[n] and all(a[2] == b[1] for a, b in zip(mine, mine[1:], strict=False))
        for _, low, high, each, first, _ in mine:
            for r in range(high - low):
                used[first + r // each] += n
    assert max(used.values()) <= 4096
    if seed == 3:
        assert len(used) == 5 + 500


def test_urls(spark):
    rows = [
        (1, "https://A.Example.ORG/es/x?q=1"),
        (2, "http://example.org/en/17"),
        (3, "http://m.example.org/en/27#a"),
        (4, "http://notexample.org"),
        (5, "ftp://x.com/fr/1"),
        (6, "http://x.com/de/"),
        (7, None),
        (8, "no scheme"),
        (9, "http://spam.net/a?b=1&c=2"),
        (9, "http://spam.net/a?b=1&c=2"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1))
    found = url_filter.judge_urls(pages).collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in found}
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/") and got[2][2] == "example.org/en/1"
    assert got[3][2] == "org/" and got[4] == ("notexample.org", "", None) and got[5][2] == "com/fr/" and got[6][2] == "com/de/"
    assert got[7] == ("", "", None) and got[8] == ("", "", None) and len(found) == 10
    verdicts = {r["page_id"]: r["verdict"] for r in found}
    assert [verdicts[i] for i in (1, 2, 3, 5, 6)] == ["block", "block", "allow", "allow", "block"]
    assert set(verdicts.values()) <= {"allow", "block"}
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


@pytest.mark.parametrize("make", [
    lambda d: lm_scoring.score_texts(d), lambda d: pii.find_pii(d), lambda d: license_scan.scan_licenses(d),
    lambda d: shingle_join.jaccard_components(d), lambda d: language_id.identify(d),
])
def test_empty_tables(odd, make):
    assert make(odd.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    roots = brute_components({i: sets_of(t) for i, t in before.items()})
    passages = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    leaks = {i for i, t in before.items() if any(p in " ".join(t.lower().split()) for p in passages)}
    want = {i for i in before if roots[i] == i and any(c.isalpha() for c in before[i])} - leaks
    got = corpus_pipeline.run(spark, SMALL)
    assert {r["doc_id"] for r in got.select("doc_id").distinct().collect()} == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "benchmark_decontamination", "pii", "best_fit_packing"]


def test_lm_learns_from_every_window(spark):
    """Each training text is stored as ids once, whole, whatever its length."""
    from lodgelens.llm.subwords import default_tokenizer, encoder

    texts = ["", None, "one two three", "word " * 500, *[f"some text number {i} with words" for i in range(60)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = default_tokenizer()
    stored = lm_scoring._gathered(docs, path).where(f"kind = {lm_scoring._IDS}").collect()
    assert len(stored) == len(texts)
    edge = encoder(path).vocabulary
    lengths = np.array([len(r["data"]) // np.dtype(lm_scoring._kind(edge)).itemsize for r in stored])
    assert sum(r["n"] for r in stored) == len(lm_scoring.lm.cut_windows(np.zeros(lengths.sum(), np.int32), lengths, edge)[0])
    assert lengths.max() >= 500 and {r["key"] % lm_scoring.ROUNDS for r in stored} == set(range(lm_scoring.ROUNDS))


def test_lm_positions_left_out_change_nothing():
    """Scores and gradients of a text's later windows leave out what nothing scores; all else is as in full."""
    rng = np.random.default_rng(3)
    size, counts = 60, np.ones(61)
    vocabulary = attention_lm.Vocabulary(size, counts)
    after = rng.poisson(2.0, (vocabulary.contexts, len(vocabulary.seen))).astype(float)
    vocabulary.set_classes(after)
    by_row = rng.poisson(2.0, (vocabulary.rows, attention_lm.CLASSES)).astype(float)
    model = attention_lm.Model(vocabulary, *attention_lm.tables(vocabulary, by_row, after), attention_lm.initial(vocabulary.rows))
    x, y, scored, _ = attention_lm.cut_windows(rng.integers(0, size, 900), np.array([0, 400, 3, 497]), size)
    whole = model.log_probability(x, y)
    picked = list(attention_lm.parts(scored))
    assert sorted(np.concatenate([p for p, _ in picked]).tolist()) == list(range(len(x))) and {s for _, s in picked} == {0, attention_lm.OVERLAP}
    for pick, start in picked:
        assert not scored[pick, :start].any()
        assert model.log_probability(x[pick], y[pick], start) == pytest.approx(whole[pick, start:], abs=1e-5)
    # The gradient against small steps of single weights.
    weights, gradient = model.weights.copy(), model.gradient(x, y, scored)

    def loss(changed):
        model.load(changed)
        return -(model.log_probability(x, y).astype(np.float64) * scored).sum() / scored.sum()

    for at in np.argsort(-np.abs(gradient))[[0, 3, 20, 100]].tolist():
        up, down = weights.copy(), weights.copy()
        up[at] += 0.02
        down[at] -= 0.02
        assert (loss(up) - loss(down)) / 0.04 == pytest.approx(gradient[at], rel=0.05)
    lines = np.vstack([rng.normal(size=(50, 3)), np.zeros((1, 3))])
    row = rng.integers(0, 7, 50)
    want = np.stack([lines[:50][row == r].sum(axis=0) for r in range(9)])
    assert attention_lm.sums_by_row(lines, row, 9) == pytest.approx(want)


def test_lm_rare_words_are_joined(spark, monkeypatch):
    """Words looked up in the task and words joined give the same base; copies and null ids keep their rows."""
    texts = [" ".join(f"w{j % (i + 2)}" for j in range(i)) for i in range(40)]
    rows = [*enumerate(texts), (3, texts[3]), (None, texts[5]), (None, None), (100, ""), (101, texts[39])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = lm_scoring.score_texts(docs).collect()
    monkeypatch.setattr(lm_scoring, "FREQUENT", 1)
    joined = lm_scoring.score_texts(docs).collect()
    order = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"])
    plain, joined = sorted(plain, key=order), sorted(joined, key=order)
    assert len(plain) == len(rows)
    for a, b in zip(plain, joined, strict=True):
        assert a[:5] == b[:5] and a["base_score"] == pytest.approx(b["base_score"])
        assert a["score"] == pytest.approx(b["score"], rel=1e-3)
    by_id = {r["doc_id"]: r["score"] for r in plain}
    assert by_id[39] == by_id[101]
