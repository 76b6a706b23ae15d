"""Language of texts by compression: the language whose zstandard dictionary makes a text smallest."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pricegrid.llm.common import sent_by_value, stored
from pricegrid.llm.quality import held_out

sent_by_value(__name__)

#: Rows of a language that its dictionaries are cut from, at most, and the texts that are taken first.
SAMPLE_A_LANGUAGE, SHORT_CHARS = 512, 4096

#: Raw content of a language's dictionaries in bytes: for the first look at a text, and for the second one. All second
#: dictionaries together have at most ``ALL_BYTES``; with more languages each gets less.
FIRST_BYTES, SECOND_BYTES, ALL_BYTES = 16 << 10, 64 << 10, 32 << 20

#: A text is encoded in pieces of so many bytes, so that the dictionary counts for all of it.
PIECE_BYTES = 8 << 10

#: A text is looked at again if its two smallest sizes are this near: bytes, or share of the second.
NARROW_BYTES, NARROW_SHARE = 2, 0.03

UNDETERMINED = "und"


def letters(text: Column) -> Column:
    """Lower-case letters and marks of a text, everything else as single spaces; null stays null."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " "))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def samples(documents: DataFrame, rows: int = SAMPLE_A_LANGUAGE) -> dict[str, str]:
    """For each value of ``lang``, letters of its first distinct texts in the order of a hash, short ones before long ones.

    A language gives at most ``rows`` rows, and of these no more than fill its dictionary twice: the driver gets three
    times ``SECOND_BYTES`` characters a language at most.
    """
    known = documents.filter(F.col("lang").isNotNull() & has_letter(F.col("text"))).select("lang", "text", F.xxhash64("text").alias("hash"))
    distinct = known.groupBy("lang", "hash").agg(F.min(F.length("text") > SHORT_CHARS).alias("long"))
    # In two steps, so that a language's first rows are looked for in sixteen tasks, and one gets what these have found.
    order = [F.col("long"), F.col("hash")]
    for keys in (["lang", F.pmod("hash", F.lit(16))], ["lang"]):
        distinct = distinct.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("n") <= rows)
    first = F.broadcast(stored(distinct.select("lang", "hash", "n"), "language-rows"))  # ``rows`` a language at most
    words = letters(F.col("text")).alias("words")
    chosen = known.join(first, ["lang", "hash"]).select("lang", "n", words).groupBy("lang", "n").agg(F.min("words").alias("words"))
    before = Window.partitionBy("lang").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    chosen = chosen.withColumn("used", F.coalesce(F.sum(F.length("words")).over(before), F.lit(0))).filter(F.col("used") < 2 * SECOND_BYTES)
    found: dict[str, list[tuple[int, str]]] = {}
    for r in stored(chosen.select("lang", "n", F.substring("words", 1, SECOND_BYTES).alias("words")), "language-sample").collect():
        found.setdefault(r["lang"], []).append((r["n"], r["words"]))
    return agreed({lang: [w for _, w in sorted(texts)] for lang, texts in sorted(found.items())})


def agreed(found: dict[str, list[str]]) -> dict[str, str]:
    """Contents of dictionaries from sample texts, without those that another language's half of the sample fits better.

    A text whose ``lang`` is wrong, or with a passage in another language, would draw that language's texts to it. A
    language that would lose all its texts keeps them.
    """
    halves = [{lang: texts[h::2] for lang, texts in found.items()} for h in (0, 1)]
    kept: dict[str, list[str]] = {lang: [] for lang in found}
    for texts, other in (halves, halves[::-1]):
        judge = Languages({lang: " ".join(t) for lang, t in other.items()})
        for lang, words in texts.items():
            kept[lang] += [w for w in words if other[lang] and judge.of(w)[0] == lang]
    return {lang: " ".join(kept[lang] or texts) for lang, texts in found.items()}


def _encoders(contents: dict[str, str], size: int, level: int, text_bytes: int, **settings) -> dict[str, zstandard.ZstdCompressor]:
    out = {}
    for lang, content in contents.items():
        raw = content.encode()[:size] or b" "
        dictionary = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        bare = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        chosen = zstandard.ZstdCompressionParameters.from_level(level, source_size=text_bytes, dict_size=len(raw), **bare, **settings)
        dictionary.precompute_compress(compression_params=chosen)
        out[lang] = zstandard.ZstdCompressor(dict_data=dictionary, compression_params=chosen)
    return out


class Languages:
    """Encoders of the learned languages; built by each worker from the dictionaries' contents."""

    def __init__(self, contents: dict[str, str]):
        second = min(SECOND_BYTES, ALL_BYTES // max(1, len(contents)))
        self.first = _encoders(contents, min(FIRST_BYTES, second), 5, PIECE_BYTES)
        self.second = _encoders(contents, second, 12, 256, min_match=3)

    def of(self, words: str) -> tuple[str, float, bool]:
        """Language, score and whether the margin is narrow, for a text's ``letters``."""
        if not self.first:
            return UNDETERMINED, 0.0, True
        raw = words.encode()
        pieces = [raw[a : a + PIECE_BYTES] for a in range(0, len(raw), PIECE_BYTES)]
        sizes = {lang: sum(len(e.compress(p)) for p in pieces) for lang, e in self.first.items()}
        ranked = sorted(sizes, key=lambda lang: (sizes[lang], lang))
        if len(ranked) == 1:
            return ranked[0], 1.0, False
        margin, share = _margin(sizes, ranked)
        if margin > NARROW_BYTES and share > NARROW_SHARE:
            return ranked[0], share, False
        # Each word once, and all of them again, so that what a word costs beyond its copy in the dictionary shows.
        distinct = " ".join(dict.fromkeys(words.split(" "))).encode()
        parts = [distinct[a : a + PIECE_BYTES] for a in range(0, len(distinct), PIECE_BYTES)]
        again = {lang: sum(len(e.compress(p + b" " + p)) for p in parts) for lang, e in self.second.items()}
        ranked = sorted(again, key=lambda lang: (again[lang], sizes[lang], lang))
        margin, share = _margin(again, ranked)
        return ranked[0], share, margin <= NARROW_BYTES


def _margin(sizes: dict[str, int], ranked: list[str]) -> tuple[int, float]:
    best, other = sizes[ranked[0]], sizes[ranked[1]]
    return other - best, (other - best) / max(1, other)


def identified(documents: DataFrame, contents: dict[str, str]) -> DataFrame:
    """Every row of ``documents`` with lang_pred, score and rejected, by dictionaries of ``contents`` (``samples``).

    Needs text, of which nothing but its letters counts; all columns stay, and columns of these names are replaced.
    The text is encoded with each language's dictionary, whole, and the smallest size wins, ties by the language's
    name. ``score`` (0 to 1) is the share by which the next language's size is larger; only one learned language: 1.
    ``rejected`` is true where the margin is too narrow to tell: lang_pred is then the best guess, and a caller who
    wants no guesses filters. A null text, or one without a letter, is ``und`` with score 0, as is everything if
    nothing was learned. Equal texts have equal results; an empty table gives an empty result.
    """
    rows = documents.drop("lang_pred", "score", "rejected")
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    out = T.StructType([*rows.schema.fields, *added])
    shared = documents.sparkSession.sparkContext.broadcast(contents)  # ALL_BYTES at most, as the sample is cut
    words = F.when(has_letter(F.col("text")), letters(F.col("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = Languages(shared.value)
        for batch in batches:
            found = [(UNDETERMINED, 0.0, True) if not x.is_valid else languages.of(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            columns = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], out.names)

    return rows.select(*[F.col(f"`{c}`") for c in rows.columns], words.alias("_letters")).mapInArrow(run, out)


def languages(documents: DataFrame) -> DataFrame:
    """Every row of ``documents`` with held_out, lang_pred, score and rejected, learned from rows that are not held out.

    Needs doc_id, text and lang; a row with a null text or lang teaches nothing, and neither lang nor doc_id counts
    when a text is judged. Columns named as those added are replaced.
    """
    contents = samples(documents.filter(~held_out(F.col("doc_id"))))
    cut = min(SECOND_BYTES, ALL_BYTES // max(1, len(contents)))
    contents = {lang: content[:cut] for lang, content in contents.items()}
    return identified(documents.withColumn("held_out", held_out(F.col("doc_id"))), contents)
