"""Spelling variants: words one edit apart, grouped under the form that is far more frequent.

A word's mask holds for each letter whether it occurs an odd number of times.  An
edit (one code point inserted, deleted or replaced) flips one bit or two, so of
three bands of the mask one at least stays as it is, and two at least where the
lengths differ.

How the work is spread
  * Words are counted by an ordinary aggregation, partly before the shuffle.
  * Each word goes under the value of each band, with its length: words of that
    length are at home there, words one shorter visit (in two bands only, of which
    one must agree).  Meeting is an equi-join on that key.
  * Common values of a band would gather very many words.  So the key also holds
    one of two stretches of the word, before or after its middle: the edit lies on
    one side, so the stretch on the other side is equal.  The key stays exact, and
    it splits every band alike, frequent or not; no size decides.
  * A pair is taken up under the first key it shares, so nothing need be made
    distinct, and the join gives only pairs whose masks differ in two bits at most
    and that are verified by edit distance.
  * Roots are found by doubling: a form is at least ``factor`` times as frequent,
    so a chain has at most log(largest count) steps.

Edge cases: null texts have no words; a null id counts as an empty string; a row
that is repeated counts as often as it occurs.  Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from kmerlake.llm.tables import cut, small

#: Letters of words besides A to Z: U+00C0 to U+00FF.
FIRST_HIGH = 0xC0
BANDS, BAND_BITS = 3, 21


def counted_words(docs: DataFrame, shortest: int = 7, least: int = 2, slips: int | None = 31) -> DataFrame:
    """(word, n) of the words of ``shortest`` code points or more that occur ``least`` times or more.

    Words are runs of letters, A to Z in lower case.  With ``slips`` every word of
    a document loses a letter if that number divides the unsigned crc32 h of
    ``<doc_id>:<word>``: the one at h modulo its length.
    """
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # A shorter run has no word, so the pattern leaves it out at once.
    run = F.explode(F.regexp_extract_all(low, F.lit("([a-z\\u00C0-\\u00FF]{%d,})" % shortest), F.lit(1)))
    words = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run.alias("run"))
    if slips:
        h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
        words = words.withColumns({"h": h, "at": (h % F.length("run")).cast("int")})
        slipped = F.concat(F.substring(F.col("run"), F.lit(1), F.col("at")), F.substring(F.col("run"), F.col("at") + 2, F.length("run")))
        words = words.select(F.when(F.col("h") % slips == 0, slipped).otherwise(F.col("run")).alias("word")).where(F.length("word") >= shortest)
    else:
        words = words.select(F.col("run").alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def parity_mask(word: Column) -> Column:
    """A bit for each letter, set if the letter occurs an odd number of times; neighbours in the alphabet lie in different bands."""

    def bit(letter: Column) -> Column:
        code = F.ascii(letter)
        number = F.when(code < FIRST_HIGH, code - ord("a")).otherwise(code - FIRST_HIGH + 26)
        return F.call_function("shiftleft", F.lit(1).cast("long"), BAND_BITS * (number % BANDS) + F.floor(number / BANDS).cast("int") % BAND_BITS)

    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda mask, letter: F.when(letter == "", mask).otherwise(mask.bitwiseXOR(bit(letter))))


def _band(mask: Column, band: int) -> Column:
    return F.shiftright(mask, BAND_BITS * band).bitwiseAND(F.lit((1 << BAND_BITS) - 1))


def meeting_keys(words: DataFrame) -> DataFrame:
    """(key, band, side, visits, word, n, mask): where each word meets those one edit away."""
    size = F.length("word")

    def rows(visits: bool) -> list[Column]:
        length = size + 1 if visits else size
        before = F.floor((length - 1) / 2).cast("int")
        after = before if visits else before + 1  # a visitor lacks the letter in the middle
        stretches = [F.substring(F.col("word"), F.lit(1), before), F.substring(F.col("word"), after + 1, size)]
        return [
            F.struct(F.xxhash64(F.lit(2 * band + side), length, _band(F.col("mask"), band), stretch).alias("key"), F.lit(band).alias("band"), F.lit(side).alias("side"), F.lit(visits).alias("visits"))
            for band in range(BANDS - visits)
            for side, stretch in enumerate(stretches)
        ]

    return words.select("word", "n", "mask", F.explode(F.array(*rows(False), *rows(True))).alias("k")).select("k.*", "word", "n", "mask")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): each pair of words one edit apart once; ``words`` has word and n, each word once."""
    keyed = meeting_keys(words.withColumn("mask", parity_mask(F.col("word"))))
    other = keyed.select("key", F.col("visits").alias("other_visits"), F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("mask").alias("other_mask"))
    flipped = F.col("mask").bitwiseXOR(F.col("other_mask"))
    first_band = F.when(_band(flipped, 0) == 0, 0).when(_band(flipped, 1) == 0, 1).otherwise(2)
    before = F.floor((F.length("word") - 1) / 2).cast("int")
    first_side = F.when(F.substring(F.col("word"), F.lit(1), before) == F.substring(F.col("other"), F.lit(1), before), 0).otherwise(1)
    return (
        keyed.where("not visits")
        .join(other, "key")
        .where(F.bit_count(flipped) <= 2)
        .where(F.col("other_visits") | (F.col("word") < F.col("other")))
        .where((F.col("band") == first_band) & (F.col("side") == first_side))
        .where(F.levenshtein("word", "other", 1) == 1)
        .select("word", "n", "other", "other_n")
    )


def followed(links: DataFrame, steps: int) -> DataFrame:
    """(word, root): the end of each chain of ``links`` (word, form); chains have ``steps`` links at most and no cycles."""
    reached = links.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        reached = cut(reached)
        on = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        on = F.broadcast(on) if small(on) else on
        reached = reached.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return reached


def spelling_forms(docs: DataFrame, shortest: int = 7, least: int = 2, factor: int = 10, slips: int | None = 31) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word (``counted_words``).

    ``form`` is the near word of largest n (ties: the first in code-point order) if
    that n is ``factor`` times the word's own or more, else null; ``root`` is where
    the forms lead to, the word itself without one.
    """
    words = cut(counted_words(docs, shortest, least, slips))
    pairs = near_words(words)
    both = pairs.select(F.explode(F.array(F.struct("word", "n", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))).alias("p")).select("p.*")
    alone = words.select("word", "n", F.lit(None).cast("string").alias("other"), F.lit(None).cast("long").alias("other_n"))
    best = F.min(F.when(F.col("other").isNotNull(), F.struct((-F.col("other_n")).alias("less"), "other"))).alias("best")
    told = both.union(alone).groupBy("word").agg(F.max("n").alias("n"), F.count("other").alias("n_near"), best)
    wins = -F.col("best.less") >= factor * F.col("n")
    linked = cut(told.select("word", "n", "n_near", F.when(wins, F.col("best.other")).alias("form"), F.when(wins, -F.col("best.less")).alias("form_n")))
    largest = words.agg(F.max("n")).first()[0] or 1
    roots = followed(linked.where("form is not null").select("word", "form"), int(math.log(largest, factor)) + 1)
    return linked.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
