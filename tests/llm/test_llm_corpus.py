"""Near duplicates, decontamination, repeated strings, main text and the pipeline against brute force."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pricegrid.llm import decontam, htmltext, neardup, repeats
from tricky import documents, frame, prose, words


def shingle_set(text, size=5):
    w = words(text)
    n = min(size, len(w))
    return frozenset(tuple(w[p : p + n]) for p in range(len(w) - n + 1)) if w else frozenset()


def brute_classes(rows, similarity=0.8):
    """Least position of each row's class: components of similar shingle sets; texts without words by equality."""
    sets, root = [shingle_set(r[1]) for r in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            near = both >= similarity * (len(sets[i]) + len(sets[j]) - both) if sets[i] and sets[j] else (rows[i][1] or "") == (rows[j][1] or "")
            if near:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(rows))]


def partition_of(ids, classes):
    by = collections.defaultdict(list)
    for i, c in zip(ids, classes):
        by[c].append(str(i))
    return sorted(sorted(x) for x in by.values())


def test_near_duplicates(spark):
    rows = documents()
    got = neardup.near_duplicates(frame(spark, rows)).collect()
    want = brute_classes(rows)
    assert len(got) == len(rows)
    first = collections.defaultdict(list)
    for r, c in zip(rows, want):
        first[c].append(r[0])
    expect = sorted((str(r[0]), str(min((x for x in first[c] if x is not None), default=None)), len(first[c])) for r, c in zip(rows, want))
    assert sorted((str(r["doc_id"]), str(r["class_id"]), r["class_size"]) for r in got) == expect
    kept = neardup.deduplicated(frame(spark, rows))
    assert kept.columns == frame(spark).columns and kept.count() == len(first)
    assert neardup.near_duplicates(frame(spark, [])).count() == 0


def chain(n, step):
    """Texts of which each is like the next ones, but not like those further on."""
    all_words = prose(99, 4000, 100_000).split(" ")
    return [" ".join(all_words[k * step : k * step + 120]) for k in range(n)]


@pytest.mark.parametrize("small,splits", [(2048, 2), (1, 2), (1, 0)])
def test_no_link_is_lost_in_crowded_buckets(spark, monkeypatch, small, splits):
    monkeypatch.setattr(neardup, "GROUP_TEXTS", small)
    monkeypatch.setattr(neardup, "PAIRED_TEXTS", small // 2)
    monkeypatch.setattr(neardup, "SPLITS", splits)
    shared = prose(50, 60)
    texts = chain(25, 6) + [shared + " " + prose(100 + k, 20) for k in range(25)]
    rows = [(i, t, *documents()[0][2:]) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert got == dict(enumerate(brute_classes(rows)))


def test_copies_without_a_much_repeated_line_are_linked(spark):
    texts = []
    for k in range(40):
        base, line = prose(200 + k, 84, 100_000), prose(300 + k, 16, 100_000)
        texts += [base, " ".join([base] + [line] * 100)]
        assert len(shingle_set(base)) == 80 and len(shingle_set(texts[-1])) == 100
    rows = [(i, t, *documents()[0][2:]) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: i - i % 2 for i in range(len(texts))}


def test_large_buckets_are_compared_whole(spark, monkeypatch):
    shared, rows = prose(60, 70), []
    # One band, so that texts of a bucket share no other; the lengths are of several classes.
    for k in range(30):
        rows += [(2 * k, f"{shared} {prose(400 + k, 10 + k)}"), (2 * k + 1, f"{shared} {prose(400 + k, 10 + k)} {prose(500 + k, 3)}")]
    texts = spark.createDataFrame(rows, "node bigint, text string")
    found = lambda: {r["node"]: r["root"] for r in neardup.near_links(texts, bands=1, rows=1).collect()}
    monkeypatch.setattr(neardup, "signatures", lambda df, *_: df.select("node", F.array(F.lit(7).cast("long")).alias("keys")))
    want = brute_classes(rows)
    for limit in (2048, 8):
        monkeypatch.setattr(neardup, "GROUP_TEXTS", limit)
        monkeypatch.setattr(neardup, "PAIRED_TEXTS", limit // 4)
        got = found()
        assert [got.get(k, k) for k in range(len(rows))] == want
    assert 1 < len(set(want)) < len(rows)


def test_recall_of_pairs_near_the_threshold(spark):
    texts = []
    for k in range(1000):
        words = prose(10_000 + k, 115, 10**6).split(" ")
        cut = 9 + k % 3  # of a hundred shingles each: a similarity of 0.80 to 0.84
        texts += [" ".join(words[:104]), " ".join(words[: 104 - cut] + [w + "z" for w in words[:cut]])]
    assert all(0.8 <= len(a & b) / len(a | b) < 0.85 for a, b in zip(*[map(shingle_set, texts[i::2]) for i in (0, 1)]))
    rows = [(i, t, *documents()[0][2:]) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert sum(got[2 * k + 1] == 2 * k for k in range(1000)) >= 999
    assert {got[i] for i in got} == {2 * (i // 2) for i in got}


def test_texts_of_one_template_equal_brute_force(spark, monkeypatch):
    r, shared = random.Random(77), prose(70, 70)
    own = [prose(7000 + k, 8, 10**6) for k in range(700)]
    texts = [f"{shared} {r.choice(own)} {prose(9000 + k, r.choice([0, 2, 10, 30]), 10**6)}" for k in range(1500)]
    sets = [shingle_set(t) for t in texts]
    number = {x: i for i, x in enumerate(sorted(set().union(*sets)))}
    held = np.zeros((len(texts), len(number)), np.float32)
    for i, x in enumerate(sets):
        held[i, [number[y] for y in x]] = 1
    size = held.sum(axis=1)
    both = held @ held.T
    root = np.arange(len(texts))
    for _ in range(60):
        near = both >= 0.8 * (size[:, None] + size[None, :] - both)
        root = np.where(near, root[None, :], len(texts)).min(axis=1)
    rows = [(i, t, *documents()[0][2:]) for i, t in enumerate(texts)]
    monkeypatch.setattr(neardup, "PAIRED_TEXTS", 16)
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert [got[i] for i in range(len(texts))] == root.tolist() and len(set(root.tolist())) > 100


def test_texts_whose_hashes_agree_are_told_apart(spark, monkeypatch):
    docs = frame(spark)
    clash = F.lit(7).cast("long")
    monkeypatch.setattr(neardup.F, "xxhash64", lambda *c, real=F.xxhash64: clash if len(c) == 1 else real(*c))
    found = docs.select("text", neardup.node_of(docs).alias("node")).distinct().collect()
    monkeypatch.undo()
    assert len({r["node"] for r in found}) == len({r["text"] or "" for r in found})


def test_components(spark):
    r = random.Random(2)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(130)] + [(300 + k, 301 + k) for k in range(60)]
    root = {x: x for p in pairs for x in p}
    for _ in range(100):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    edges = spark.createDataFrame(pairs, "a bigint, b bigint")
    got = {x["node"]: x["root"] for x in neardup.components(edges).collect()}
    assert got == {x: y for x, y in root.items() if x in got} and all(root[x] == x for x in set(root) - set(got))
    assert neardup.components(edges.filter("a < 0")).count() == 0


def test_signatures_estimate_the_probability_jaccard():
    r = np.random.default_rng(4)
    a = {int(x): float(w) for x, w in zip(r.integers(0, 2**63, 60), r.integers(1, 6, 60))}
    b = {x: w * (1 + (x % 3)) for x, w in list(a.items())[:40]} | {int(x): 2.0 for x in r.integers(0, 2**63, 15)}
    exact = sum(1 / sum(max(a.get(y, 0) / a[x], b.get(y, 0) / b[x]) for y in {*a, *b}) for x in a if x in b)
    row = np.repeat([0, 1], [len(a), len(b)])
    element, weight = np.array([*a, *b], np.uint64), np.array([*a.values(), *b.values()])
    signed = neardup.prob_minhash(row, element, weight, 2, 4096)
    assert (signed[0] == signed[1]).mean() == pytest.approx(exact, abs=0.03)
    # Sets beside it change nothing, nor does a common factor of the weights.
    alone = neardup.prob_minhash(np.zeros(len(a), int), element[: len(a)], 3 * weight[: len(a)], 1, 4096)
    assert (alone[0] == signed[0]).all()


def test_links_across_components():
    r = np.random.default_rng(6)
    base = r.integers(0, 2**63, 80)
    sets = [np.unique(np.concatenate([base[: 80 - k % 19], r.integers(0, 2**63, k % 7)])) for k in range(60)] + [np.zeros(0, int)]
    root = r.integers(0, 9, len(sets))
    near = lambda a, b: len(a) and len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b))
    want = {(root[i], root[j]) for i in range(61) for j in range(61) if root[i] < root[j] and near(sets[i], sets[j])}
    got = neardup.cross_links(root, sets, 0.8)
    assert {(root[i], root[j]) for i, j in got} == want and len(got) == len(want)
    assert all(near(sets[i], sets[j]) for i, j in got)


def brute_contamination(rows, items, window=13):
    known = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for p in range(len(w) - n + 1 if w else 0):
            known[tuple(w[p : p + n])].add("" if i is None else str(i))
    out = []
    for r in rows:
        w, hit, names = words(r[1]), set(), set()
        for n in {len(k) for k in known}:
            for p in range(len(w) - n + 1):
                if (k := tuple(w[p : p + n])) in known:
                    hit |= set(range(p, p + n))
                    names |= known[k]
        out.append((str(r[0]), len(w), len(hit), ",".join(sorted(names)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def items():
    text = documents()[12][1].split(" ")
    return [
        (1, " ".join(text[55:75])),
        (10, " ".join(text[58:80]).upper()),
        (2, "ONE two"),
        (3, None),
        (4, "--"),
        (None, prose(8, 6000, 100_000)[:300]),
        (1, "x"),
        (2, "unheard of " + prose(77, 30)),
    ]


@pytest.mark.parametrize("block", [decontam.BLOCK_BYTES, 300])
def test_contamination(spark, block):
    rows = documents()
    benchmark = spark.createDataFrame(items(), "item_id bigint, text string")
    got = decontam.contamination(frame(spark, rows), benchmark, block_bytes=block).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], ",".join(r["items"]), r["contaminated"]) for r in got) == brute_contamination(rows, items())
    assert all(r["n_items"] == len(r["items"]) for r in got)


def test_contamination_of_nothing_and_cut_texts(spark):
    benchmark = spark.createDataFrame(items(), "item_id bigint, text string")
    assert decontam.contamination(frame(spark, []), benchmark).count() == 0
    assert decontam.contamination(frame(spark), benchmark.filter("item_id > 99")).filter("contaminated OR n_hit > 0").count() == 0
    left = decontam.clean(frame(spark), benchmark)
    want = [r for r in brute_contamination(documents(), items()) if not r[4]]
    assert left.columns == frame(spark).columns and left.count() == len(want)
    cut = {(r["doc_id"], r["text"]) for r in decontam.clean(frame(spark), benchmark, spans=True).collect()}
    assert len(cut) == len({(r[0], r[1]) for r in documents()}) and (9, " three") in cut and (10, "; three.") in cut


def brute_repeats(texts, length):
    count = collections.Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if count[t[p : p + length]] > 1:
                gone[p : p + length] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((len(t), int(gone.sum()), runs, bytes(b for b, g in zip(t, gone) if not g)))
    return out


def check_repeats(spark, rows, **settings):
    got = repeats.without_repeats(frame(spark, rows), **settings).collect()
    want = brute_repeats([(r[1] or "").encode() for r in rows], settings.get("length", repeats.LENGTH))
    key = lambda i, x: (str(i), *x)
    assert sorted(key(r["doc_id"], (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]))) for r in got) == sorted(
        key(r[0], w) for r, w in zip(rows, want)
    )


def test_repeats(spark):
    check_repeats(spark, documents())
    assert repeats.without_repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize("hot_copies,group_bytes,partitions", [(1000, 4 << 20, 4), (2, 0, 13)])
def test_repeats_of_any_kind(spark, monkeypatch, hot_copies, group_bytes, partitions):
    """Random texts over two letters repeat all the time; hot texts, hot leads and many buckets make no difference."""
    monkeypatch.setattr(repeats, "HOT_COPIES", hot_copies)
    monkeypatch.setattr(repeats, "GROUP_BYTES", group_bytes)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        r = random.Random(8)
        part = lambda n, letters: "".join(r.choice(letters) for _ in range(n))
        passage = part(70, "abcdefgh")
        texts = [part(r.randrange(120), "ab") for _ in range(20)] + [part(30, "abcdef") + passage[k : k + 50] + part(9, "xyz") for k in range(18)]
        texts += ["ab" * 60, "é" * 40, passage, passage, passage, "abc" * 9 + passage + "abc" * 9]
        check_repeats(spark, [(i, t, *documents()[0][2:]) for i, t in enumerate(texts)], length=20, lead=8)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


PAGES = [
    ("<html><head><title>T &amp; U</title><style>p{}</style></head><body><nav><ul><li>Home</li></ul></nav>"
     "<article><h1>The  title</h1><p><b>First &lt;b&gt; one<br>line<p>Second\n para&nbsp;graph<div class='ad box'>Buy</div>"
     "<section id=comments><p>Nice!</section><aside>More</aside></article><footer>F</footer></body></html>",
     "The title\nFirst <b> one line\nSecond para graph"),
    ("<div class=cookie-notice>We use cookies</div><main><p>Only main</p><form><input name=q><p>no</form></main>", "Only main"),
    ("<article><script>var t='</p><article>';</script>Text<!-- <p>no --> goes on</article ><p>after", "Text goes on"),
    ("<article><p>cut off in a <a href='x", "cut off in a"),
    ("<body class='no-sidebar'><div class='content-wrapper sidebar-layout'><article><p class=notice>n<p>kept</article></div>", "kept"),
    ("<ARTICLE><table><tr><td>a<td>b<tr><td>c</table>1 < 2 &amp;amp; 3</ARTICLE>", "a b\nc\n1 < 2 &amp; 3"),
    ("<main><h1>Title</h1><p>Real body</p></main><article>Teaser one</article><article>Teaser two</article>", "Title\nReal body"),
    ("<main><p>A</p><article>card</article><p>B</p></main>", "A\nB"),
    ("<main><p>Two words</p><article>One</article><article>Two</article><article>Three</article></main>", "Two words\nOne\nTwo\nThree"),
    ("<main><h1>Short</h1><article><p>The article itself</p></article></main>", "The article itself"),
    (None, ""),
    ("", ""),
    ("plain text  only", "plain text only"),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_blocks_of_a_page(page, text):
    assert "\n".join(htmltext.blocks_of(page or "")[0]) == text


def test_main_text(spark):
    rule = "this site belongs to nobody in particular and all its rights are reserved forever"
    rows = [(i, f"http://a.example/{i}", h) for i, (h, _) in enumerate(PAGES)]
    rows += [(100 + k, "https://u@Host.example:80/x", f"<p>{prose(k, 30)}</p><p>{rule}</p><div>{prose(500 + k, 9)} {rule} {prose(900 + k, 2)}</div>") for k in range(5)]
    rows += [(200, "https://other.example/x", f"<p>{rule}</p>"), (201, None, f"<p>{rule}</p>"), (None, None, None), rows[0], rows[10]]
    schema = "page_id bigint, url string, html string, text string, host string, node string, blocks int"
    pages = spark.createDataFrame([(*r, "t", "h", "n", 1) for r in rows], schema)
    got = htmltext.main_text(pages.repartition(3)).collect()
    assert len(got) == len(rows) and {tuple(r)[:2] for r in got} == {r[:2] for r in rows}
    text = {r["page_id"]: r["text"] for r in got}
    assert [text[i] for i in range(len(PAGES))] == [t for _, t in PAGES]
    assert [text[100 + k] for k in range(5)] == [f"{prose(k, 30)}\n{prose(500 + k, 9)} {prose(900 + k, 2)}" for k in range(5)]
    assert text[200] == text[201] == rule and text[None] == ""
    assert htmltext.main_text(pages.filter("page_id < 0")).count() == 0


def test_main_text_of_articles_with_boilerplate_of_the_host(spark):
    rule, shared = "share this story with your friends or sign up for our daily letter", prose(1, 40)
    start = prose(2, 12)  # on every page, but only as a part of a block
    own = [f"{start} {prose(10 + k, 60)}" for k in range(6)]
    rows = [(k, "http://news.example/x", f"<article><p>{x}</p><p>{rule}</p></article>") for k, x in enumerate(own)]
    rows += [(10 + k, "http://copies.example/x", f"<nav>{k}</nav><main><p>{shared}</p><p>{k}</p></main>") for k in range(5)]
    rows += [(20 + k, "http://some.example/x", f"<main><p>{prose(30 + k, 60)}</p><p>{rule if k < 4 else k}</p></main>") for k in range(9)]
    rows += [(40, "http://news.example/y", f"<div>{prose(50, 20)}</div><div>{rule}</div>"), rows[0]]
    got = htmltext.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and [text[k] for k in range(6)] == own and text[40] == prose(50, 20)
    assert [text[10 + k] for k in range(5)] == [f"{shared}\n{k}" for k in range(5)]
    assert [text[20 + k] for k in range(9)] == [f"{prose(30 + k, 60)}\n{rule if k < 4 else k}" for k in range(9)]


def test_pipeline(spark, tmp_path):
    rows = [(i, t, *x) for i, t, *x in documents() if i is not None][:14]
    junk = [(1000 + k, "%%% " + prose(1000 + k, 25).replace(" ", "$$$ ") + " !!!", *documents()[0][2:]) for k in range(60)]
    good = [(2000 + k, prose(2000 + k, 45), *documents()[0][2:]) for k in range(60)]
    all_rows = [r[:5] for r in rows + junk + good]
    spark.createDataFrame(all_rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(r[0], 0, 0) for r in junk] + [(r[0], 1, 0) for r in good]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, good[3][1]), (2, good[4][1])], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            kept = out.collect()
            ids = [r["doc_id"] for r in kept]
            seen.append(collections.Counter(ids))
        docs = spark.createDataFrame(kept, docs.schema) if len(seen) < 5 and name != corpus_pipeline.STAGES[-1][0] else docs
    first, second, third, fourth = seen
    assert all(first[r[0]] == 1 for r in good) and sum(first[r[0]] for r in junk) <= 1
    inputs = [(r[0], r[1]) for r in all_rows if first[r[0]]]
    classes = brute_classes(inputs)
    assert sum(second.values()) == len(set(classes)) and max(second.values()) == 1
    hit = {r[0] for r in brute_contamination([r for r in inputs if second[r[0]]], [(1, good[3][1]), (2, good[4][1])]) if r[4]}
    assert {str(i) for i in second} - {str(i) for i in third} == hit == {str(good[3][0]), str(good[4][0])}
    assert set(fourth) <= set(third) and max(fourth.values()) <= 2
    assert out.count() == sum(fourth.values())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == sum(fourth.values())
