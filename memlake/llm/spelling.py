"""Spelling variants: words one edit apart, found with asymmetric q-chunks.

Of two words one edit apart, the shorter (or, at equal length, the first in code-point order) gives
its two disjoint chunks, its halves; the other gives positional grams: those of a chunk's length
that begin where the chunk does or one further on, as no other gram can be a chunk that one edit has left
whole. One edit preserves one of the two chunks. What is left of the word beside it differs by that
edit too, so of its own two halves one is preserved as well and is made part of the join key: a key
covers about three quarters of a word. Pairs are joined on equal keys, tested for one edit inside
the join, and come out of one key only: of those that fit, the first.

Keys that many words share are counted and split by salt. Words are distinct, so copies of a text
or a word that a third of all rows hold only raise a count, which is summed before the shuffle.

Defined results: null and empty texts have no words; a null id counts as an empty one where occurrences are
altered; words of any length take part whole; a word without near words has no form and is its own root;
forms are at least ``RATIO`` times as frequent as what they stand for, so following them always ends; ties go to the
word first in code-point order; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import discard, written
from memlake.plans.fold import chain_heads
from memlake.plans.skew import SALT, hot_keys, repeat, spread

LETTERS = "[A-Za-z\\u00C0-\\u00FF]"
LEAST_LENGTH = 7
LEAST_COUNT = 2
RATIO = 10
ALTERED = 31
ROWS_PER_KEY = 4096


def occurrences(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST_LENGTH, altered: int = ALTERED) -> DataFrame:
    """``word`` of every run of letters with ``least`` of them; of one in ``altered`` occurrences a letter is gone."""
    runs = F.regexp_extract_all(F.col(text).cast("string"), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))
    run = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"), F.explode(runs).alias("_run"))
    lower = F.translate("_run", string.ascii_uppercase, string.ascii_lowercase)
    run = run.select(lower.alias("word"), F.crc32(F.concat("_key", F.lit(":"), lower).cast("binary")).alias("_h"))
    at = (F.col("_h") % F.length("word")).cast("int")
    less = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
    return run.select(F.when(F.col("_h") % altered == 0, less).otherwise(F.col("word")).alias("word")).filter(F.length("word") >= least)


def vocabulary(docs: DataFrame, least_count: int = LEAST_COUNT, **options) -> DataFrame:
    """``word`` and ``n`` of the words that occur ``least_count`` times or more."""
    return occurrences(docs, **options).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def _part(word: Column, start: Column, end: Column | None = None) -> Column:
    return F.substring(word, start + 1, F.length(word) if end is None else end - start)


def _keys(word: Column, size: Column, more: Column) -> list[Column]:
    """The four keys of a word against words of ``size`` letters that give chunks; ``word`` has ``more`` letters than those.

    A key is a half and a half of the other half; what lies behind the edit is ``more`` further on in ``word``.
    """
    half, of = F.floor(size / 2).cast("int"), F.lit(0)
    front, back = F.floor(half / 2).cast("int"), F.floor((size - half) / 2).cast("int")
    pieces = [
        (_part(word, of, half), _part(word, half, half + back)),
        (_part(word, of, half), _part(word, half + back + more)),
        (_part(word, of, front), _part(word, half + more)),
        (_part(word, front + more, half + more), _part(word, half + more)),
    ]
    return [F.concat(size.cast("string"), F.lit(f"/{i}/"), a, F.lit("/"), b) for i, (a, b) in enumerate(pieces)]


def chunks(words: DataFrame) -> DataFrame:
    """``key``, ``a`` and ``n_a``: the chunks of every word."""
    keys = _keys(F.col("word"), F.length("word"), F.lit(0))
    return words.select(F.explode(F.array(*keys)).alias("key"), F.col("word").alias("a"), F.col("n").alias("n_a"))


def grams(words: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """``key``, ``b`` and ``n_b``: the positional grams of every word, for chunks of words as long or one letter shorter."""
    size = F.length("word")
    longer = F.when(size > least, F.array(*_keys(F.col("word"), size - 1, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    keys = F.concat(F.array(*_keys(F.col("word"), size, F.lit(0))), longer)
    return words.select(F.explode(keys).alias("key"), F.col("word").alias("b"), F.col("n").alias("n_b"))


def near_pairs(words: DataFrame, least: int = LEAST_LENGTH, rows_per_key: int = ROWS_PER_KEY) -> DataFrame:
    """``a``, ``n_a``, ``b``, ``n_b``: every pair of words one edit apart, once.

    Both sides are shuffled: Spark takes the size of the words file for that of their keys, four to eight times
    as many rows, and would send them through the driver.
    """
    given, asked = chunks(words), grams(words, least)
    hot = hot_keys(asked, ["key"], rows_per_key)
    given, asked = repeat(given, hot, ["key"]), spread(asked, hot, ["key"], F.col("b"))
    a, b = F.col("a"), F.col("b")
    size, more = F.length(a), F.length(b) - F.length(a)
    kind = F.split_part("key", F.lit("/"), F.lit(2))
    fits = [x == y for x, y in zip(_keys(a, size, F.lit(0)), _keys(b, size, more))]
    earlier = F.when(kind == "0", False).when(kind == "1", fits[0]).when(kind == "2", fits[0] | fits[1]).otherwise(fits[0] | fits[1] | fits[2])
    found = given.hint("merge").join(asked, ["key", SALT]).filter(((more == 1) | (a < b)) & (F.levenshtein(a, b, 1) == 1) & ~earlier)
    return found.select("a", "n_a", "b", "n_b")


def variants(docs: DataFrame, least: int = LEAST_LENGTH, ratio: int = RATIO, **options) -> DataFrame:
    """``word``, ``n``, ``form``, ``form_n``, ``root`` and ``n_near`` of every word."""
    words = written(vocabulary(docs, least=least, **options), "spelling-words")
    pairs = near_pairs(words, least)
    # both ways, summed before the shuffle
    ways = F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n"))))
    best = pairs.select(ways.alias("_x")).select("_x.*").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rare"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    holds = -F.col("best.rare") >= ratio * F.col("n")
    judged = written(joined.select(
        "word", "n", F.when(holds, F.col("best.near")).alias("form"), F.when(holds, -F.col("best.rare")).alias("form_n"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")), "spelling-forms")
    discard(words)
    heads = chain_heads(judged.filter("form is not null").select(F.col("word").alias("row"), F.col("form").alias("target")))
    return judged.join(heads.withColumnRenamed("row", "word"), "word", "left").select(
        "word", "form", F.coalesce("head", "word").alias("root"), "n", "n_near", "form_n")
