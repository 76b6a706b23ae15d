"""Small tables with nulls, ties, repeated rows, long texts and columns that clash with those the operators add."""

import random
import re

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, n_words int, size string, node string, "
    "taken int, _order int, _range int, spans string, held_out string, kept string, range int"
)


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(r.choice("abcdefghéü") + r.choice("klmnop") + str(r.randrange(vocabulary)) for _ in range(n))


def documents():
    base, other = prose(1, 120), prose(2, 90)
    near = base.split(" ")
    near[60] = "changed"
    passage = prose(7, 45)
    texts = [
        (0, base, "a"),
        (1, base, "a"),
        (2, base.upper(), "a"),
        (3, " ".join(near), "b"),
        (4, other, "b"),
        (5, None, None),
        (6, "", None),
        (7, " \t\n\r ", "c"),
        (8, "!!! ???", "c"),
        (9, "one two three", "c"),
        (10, "One, two; three.", "c"),
        (11, "one two three four", None),
        (12, prose(3, 60) + " " + passage + " " + prose(4, 70), "a"),
        (13, prose(5, 20) + "\n" + passage + "\n" + prose(6, 30), "é"),
        (14, "tock " * 150, "a"),
        (15, prose(8, 6000, 100_000), "a"),
        (16, "ünïcödé " + passage[:180] + " 中文字 " + prose(9, 12), "a"),
        (None, other, "a"),
        (None, None, "b"),
        (None, prose(10, 40), "b"),
        (4, other, "b"),
        (4, other, "b"),
        (20, prose(11, 40) + " " + base, None),
        (21, "x", "b"),
    ]
    extra = (1, 0.5, 3, "size", "node", 1, 2, 3, "spans", "held", "kept", 9)
    return [(i, t, "en", s, *extra) for i, t, s in texts]


def frame(spark, rows=None, partitions=3):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(partitions)
