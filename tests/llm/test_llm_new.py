"""Language by compression, hard negatives and repair of conversations against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricegrid.llm import language, negatives, turns
from tricky import documents, frame

FAMILIES = {"aa": "ba be bi bo bu", "cc": "zük zöt zäm zeß zin", "ee": "кот дом лес сад мир"}


def speech(lang, seed, n):
    r, parts = random.Random(seed), FAMILIES[lang].split()
    return " ".join("".join(r.choice(parts) for _ in range(r.randrange(1, 4))) for _ in range(n))


def speakers(n=240):
    extra = documents()[0][4:]
    rows = [(i, speech(lang, i, 3 + i % 40), lang, "s", *extra) for i in range(n) for lang in [sorted(FAMILIES)[i % 3]]]
    rows += [(1000, None, "aa", "s", *extra), (1001, "", "aa", None, *extra), (1002, "12 !!", None, "s", *extra)]
    rows += [(1003, speech("cc", 1, 60_000), None, "s", *extra), (1004, speech("ee", 7, 30), None, "s", *extra), (None, rows[4][1], "cc", "s", *extra)]
    return rows + [rows[5], rows[5]]


def test_languages_of_held_out_rows(spark):
    rows = speakers()
    found = language.languages(frame(spark, rows)).collect()
    assert len(found) == len(rows) and len(found[0]) == len(set(found[0].__fields__)) == 16 - 1 + 3
    by_text = collections.defaultdict(set)
    for r in found:
        by_text[r["text"]].add((r["lang_pred"], r["score"], r["rejected"]))
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert (r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", r["text"] or ""))
    assert all(len(x) == 1 for x in by_text.values())
    held = [r for r in found if r["held_out"] and r["doc_id"] < 1000]
    assert len(held) > 50 and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert {r["doc_id"]: r["lang_pred"] for r in found if r["doc_id"] in (1003, 1004)} == {1003: "cc", 1004: "ee"}


def test_languages_learn_only_from_rows_that_are_not_held_out(spark):
    rows = frame(spark, speakers())
    turned = rows.withColumn("lang", F.when(language.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    pick = lambda df: sorted((str(r["doc_id"]), r["lang_pred"], r["score"]) for r in language.languages(df).collect())
    assert pick(rows) == pick(turned)
    nothing = language.languages(rows.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in nothing} == {("und", 0.0)}
    assert language.languages(frame(spark, [])).count() == 0
    one = language.languages(rows.withColumn("lang", F.lit("only"))).filter("lang_pred = 'only'").select("score").distinct().collect()
    assert [r["score"] for r in one] == [1.0]


def test_smallest_encoding_wins_and_wrong_labels_are_left_out():
    texts = {k: [speech(k, i, 40) for i in range(20)] for k in FAMILIES}
    texts["aa"] += [speech("cc", 99, 200)]
    contents = language.agreed(texts)
    assert speech("cc", 99, 200) not in contents["aa"] and texts["aa"][0] in contents["aa"]
    judge = language.Languages(contents)
    for lang in FAMILIES:
        words = speech(lang, 1234, 50)
        sizes = {k: len(e.compress(words.encode())) for k, e in judge.first.items()}
        assert judge.of(words)[0] == lang == min(sizes, key=sizes.get)


VECTORS = "vec_id bigint, embedding array<float>, label int, score double, block int, rank string"


def vectors(seed, n, width=6, labels=4):
    r = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in np.round(r.normal(size=width), 1)], int(r.integers(labels))) for i in range(n)]
    rows += [(5, rows[3][1], 1), (10, rows[0][1], rows[0][2]), (10, rows[0][1], rows[0][2]), (None, rows[0][1], 0), (20, None, 0), (20, [], 0)]
    rows += [(30, [1.0, None], 0), (30, [float("nan")] * width, 0), (30, [float("inf")] * width, 0), (n + 1, rows[1][1], None), (n + 2, rows[1][1][:3], 1)]
    rows += [(n + 10 + i, rows[0][1], i % 2) for i in range(40)]
    return [(*x, 0.5, 1, "r") for x in rows]


def plain_negatives(rows, every, k=5, m=5):
    part = []
    for i, v, label, *_ in rows:
        if i is not None and v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v):
            part.append((i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v], label))
    out = []
    for a, (i, v, label) in enumerate(part):
        if i % every:
            continue
        ranked = sorted((-sum(x * y for x, y in zip(v, w)), j, b) for b, (j, w, _) in enumerate(part) if b != a)
        own = [(-s, j) for s, j, b in ranked if part[b][2] == label][:k]
        for p, j in own:
            fits = [(-s, x) for s, x, b in ranked if part[b][2] != label and 80 * p <= -100 * s <= 100 * p][:m]
            out += [(i, j, r + 1, x, p, s) for r, (s, x) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("seed,chunk,block", [(1, 4096, 1024), (2, 7, 3), (3, 50, 1)])
def test_hard_negatives(spark, monkeypatch, seed, chunk, block):
    monkeypatch.setattr(negatives, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", block)
    monkeypatch.setattr(negatives, "BLOCKS_A_ROUND", 2)
    monkeypatch.setattr(negatives, "ROUNDS_A_JOB", 2)
    rows = vectors(seed, 150)
    found = negatives.hard_negatives(spark.createDataFrame(rows, VECTORS).repartition(5), F.col("vec_id") % 10 == 0)
    got = sorted(tuple(r) for r in found.collect())
    assert got == plain_negatives(rows, 10) and len(got) > 100


def test_hard_negatives_of_few_rows(spark):
    mine = lambda rows: sorted(tuple(r) for r in negatives.hard_negatives(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 10 == 0).collect())
    assert mine([]) == []
    tail = (0.5, 1, "r")
    assert mine([(10, [1.0], 0, *tail)]) == []
    assert mine([(10, [1.0], 0, *tail), (11, [0.5], 0, *tail), (12, [0.5], 1, *tail)]) == [(10, 11, 1, 12, 32768, 32768)]
    assert mine([(10, [1.0], 0, *tail), (11, [-1.0], 0, *tail), (12, [-1.0], 1, *tail)]) == []  # a negative limit
    assert mine([(10, [1.0], 0, *tail), (11, [0.0], 0, *tail), (12, [0.0], 1, *tail)]) == [(10, 11, 1, 12, 0, 0)]


def test_inner_products_are_exact():
    r = np.random.default_rng(1)
    for most in (10, 1 << 20, 1 << 27):
        a, b = (np.floor(r.uniform(-most, most, (5, 7))) for _ in range(2))
        want = [[max(-(1 << 56), min(1 << 56, sum(int(x) * int(y) for x, y in zip(u, v)))) for v in b] for u in a]
        assert (negatives.inner(a, b) == np.array(want)).all()
    assert negatives.inner(np.full((1, 2), 2.0**40), np.full((1, 2), 2.0**40))[0, 0] == 1 << 56


def plain_repair(rows):
    """Cost and audit by trying, for every row and state, the least (cost, audit) that leads there."""
    follow = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    def inserted(best):
        for _ in range(3):
            for q, (cost, audit) in list(best.items()):
                for r, q2 in follow[q].items():
                    if r != "s":
                        best[q2] = min(best.get(q2, (1 << 40, "")), (cost + 5, audit + "I"))
        return best

    best = inserted({0: (0, "")})
    for initial, fault in rows:
        more, after = 5 if fault == turns.CUT else 0, {}

        def put(q, cost, audit):
            after[q] = min(after.get(q, (1 << 40, "")), (cost, audit))

        for q, (cost, audit) in best.items():
            put(q, cost + 2, audit + "D")
            if fault in (turns.BLANK, turns.DUPLICATE):
                continue
            if initial == "":
                put(q, cost + more, audit + "K")
            if initial in follow[q]:
                put(follow[q][initial], cost + more, audit + "K")
            for r, q2 in follow[q].items():
                if r != "s":
                    put(q2, cost + 1 + more, audit + "R")
        best = inserted(after)
    return min(x for q, x in best.items() if q in (0, 3))


def test_cheapest_edits_are_those_of_all_paths():
    r = random.Random(4)
    for n in [*range(9)] * 60 + [40, 150]:
        rows = [(r.choice(["s", "u", "a", "a", "u", " ", "", "x"]), r.choice([0, 0, 0, 1, 2, 3])) for _ in range(n)]
        assert turns.cheapest(rows) == plain_repair(rows), rows


def test_a_long_conversation_is_searched_in_time():
    r = random.Random(9)
    rows = [(r.choice("uaus"), r.choice([0, 0, 0, 0, 1, 2, 3])) for _ in range(20_000)]
    assert turns.cheapest(rows) == plain_repair(rows)


def plain_conversations(rows):
    one = lambda x: " " if x is None else str(x)
    by = collections.defaultdict(list)
    for c, t, role, text in [r[:4] for r in rows]:
        kind, role, text = zlib.crc32(f"{one(c)}:{one(t)}".encode()) % 20, one(role), one(text)
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        by[c] += [(t, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for c, damaged in by.items():
        damaged.sort(key=lambda x: (x[0] is not None, x[0] or 0, turns_digest(*x[1:])))
        seen, facts = set(), []
        for _, role, text in damaged:
            bare = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
            seen.add((role, text))
            facts.append((role[:1], fault))
        cost, audit = plain_repair(facts)
        known = [t for t, *_ in damaged if t is not None]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(facts, facts[1:]))
        lines, last, left = [], "", iter(damaged)
        for e in audit:
            _, role, text = ("", "", "") if e == "I" else next(left)
            if e != "D":
                role = role if e == "K" else "assistant" if last == "u" else "user"
                lines.append(role + ":" + text)
                last = role[:1] or last
        counts = [sum(f == k for _, f in facts) for k in (1, 2, 3)]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out.append((c, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def turns_digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).digest()


TURNS = "conv_id bigint, turn bigint, role string, text string, times int, pass int, cost string"


def conversations(seed, n):
    r, rows = random.Random(seed), []
    for c in range(n):
        for t in range(r.choice([1, 2, 3, 5, 9])):
            role = r.choice(["user", "assistant", "user", "assistant", "system", None, "User", ""])
            text = r.choice(["Yes.", "No!", "What? ", "and", "", None, " \t", "é.\n", "ok ... then", f"text {r.randrange(9)}."])
            rows.append((r.choice([c, c, c, None]), r.choice([t, t, t, None, t + 7]), role, text, 7, 7, "c"))
    return rows + rows[:5] + [(c, None, None, None, 1, 1, "c") for c in (1, 2, 900)]


@pytest.mark.parametrize("seed", [1, 2])
def test_repaired_conversations(spark, seed):
    rows = conversations(seed, 120)
    got = [tuple(r) for r in turns.repaired(turns.damaged(spark.createDataFrame(rows, TURNS).repartition(4))).collect()]
    assert sorted(got, key=repr) == plain_conversations(rows)
    assert len(got) == len({r[0] for r in rows})


def test_conversations_at_the_edges(spark):
    mine = lambda rows: [tuple(r) for r in turns.repaired(turns.damaged(spark.createDataFrame(rows, TURNS))).collect()]
    assert mine([]) == []
    dropped = next(c for c in range(999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert mine([(dropped, 0, "user", "Hi.", 1, 1, "c")]) == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    long = next(c for c in range(999) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 > 4 for t in (0, 1)))
    rows = [(long, 0, "user", "x" * 1_200_000 + ".", 1, 1, "c"), (long, 1, "assistant", "y.", 1, 1, "c")]
    assert mine(rows) == plain_conversations(rows)
