"""Analyzers: text to an array of terms. All are Catalyst expressions, so an analyzer is a function of a Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Analyzer = Callable[[Column], Column]


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def words_cased(text: Column) -> Column:
    """Runs of letters and digits in their own case."""
    return F.array_remove(F.split(text, r"[^\p{L}\p{N}]+"), "")


def ngrams(low: int = 2, high: int = 3) -> Analyzer:
    """Character n-grams at every place, short ones first at each; sizes that make no sense are 2 to 3."""
    if low < 1 or high < low:
        low, high = 2, 3

    def analyze(text: Column) -> Column:
        chars = F.split(F.lower(text), "")  # once, and not inside the lambda
        size = F.length(text)
        sizes = F.array(*(F.lit(n) for n in range(low, high + 1)))
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), size)), lambda i: F.transform(F.filter(sizes, lambda n: i + n - 1 <= size), lambda n: F.substring(F.lower(text), i, n)))
        return F.when(F.size(chars) > 0, F.flatten(grams))

    return analyze


def cjk_or_words(text: Column) -> Column:
    """Words, and for runs of Han, kana and Hangul their character pairs in place of a dictionary's words."""
    run = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}ー]"
    runs = F.regexp_extract_all(F.lower(text), F.lit(f"{run}+"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) < 2, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, 2)))))
    return F.concat(words(F.regexp_replace(text, f"{run}+", " ")), pairs)


ANALYZERS: dict[str, Analyzer] = {"words": words, "words_cased": words_cased, "ngram": ngrams(), "cjk": cjk_or_words}


def explain_analyzers(text: Column) -> dict[str, Column]:
    """The same text through every analyzer, by name."""
    return {name: analyze(text) for name, analyze in ANALYZERS.items()}
