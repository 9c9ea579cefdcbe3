"""Text expressions for search: accent removal, weighted tokens, trigrams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with a mark and their plain forms, in matching order.
_MARKED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿĀāĂăĄąĆćČčĎďĒēĘęĚěĞğĪīİŁłŃńŇňŌōŐőŘřŚśŞşŠšŢţŤťŪūŮůŰűŹźŻżŽž"
_PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyyAaAaAaCcCcDdEeEeEeGgIiILlNnNnOoOoRrSsSsSsTtTtUuUuUuZzZzZz"

# Letters that become two.
_WIDENED = (("Æ", "AE"), ("æ", "ae"), ("Œ", "OE"), ("œ", "oe"), ("ß", "ss"), ("Ø", "O"), ("ø", "o"))


def unaccented(text: Column) -> Column:
    """Latin letters without their marks."""
    plain = F.translate(text, _MARKED, _PLAIN)
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), _WIDENED, plain)


def words(text: Column) -> Column:
    """Lower-case words: maximal runs of letters and digits."""
    pieces = F.split(F.lower(unaccented(text)), r"[^\p{L}\p{N}]+")
    return F.filter(pieces, lambda w: w != F.lit(""))


def search_tokens(*weighted: tuple[str, Column]) -> Column:
    """distinct (token, weight) pairs of several texts, each with its weight letter."""

    def tagged(weight, text):
        return F.transform(F.array_distinct(words(text)), lambda w: F.struct(w.alias("token"), F.lit(weight).alias("weight")))

    return F.array_distinct(F.concat(*[tagged(weight, text) for weight, text in weighted]))


def trigrams(text: Column) -> Column:
    """distinct three-letter windows of each word, padded by two blanks before and one after."""

    def windows(word):
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words(text), windows)))
