"""Text functions of transcripts: Column in, Column out, no Python in the tasks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plenum.functions import constants as C

#: White space as Unicode has it, so that a no-break space counts.
SPACE = r"(?U)\s+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def clean_asr(text: Column) -> Column:
    """A character three times or more becomes two, a word three times or more becomes one, white space one blank."""
    # The three patterns of the cleaning rule.
    text = F.regexp_replace(text, r"(.)\1{2,}", "$1$1")
    text = F.regexp_replace(text, r"(?U)\b(\S+)(?:\s+\1){2,}\b", "$1")
    return F.regexp_replace(F.regexp_replace(text, SPACE, " "), "^ | $", "")


def is_junk(text: Column) -> Column:
    """Fewer than three characters, or no two different ones besides blanks."""
    bare = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return (F.length(bare) < 3) | (F.size(F.array_distinct(F.split(F.replace(bare, F.lit(" ")), ""))) <= 1)


def words(text: Column) -> Column:
    """The words between white space; none for an empty text."""
    return F.array_remove(F.split(text, SPACE), "")


def tokens(text: Column) -> Column:
    """Lower-cased tokens in order: runs of letters and digits (an approximation of a plain text-search parser)."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _strip_prefix(word: Column) -> Column:
    """The word without one prefix letter, if two letters or more are left; else null."""
    return F.when((F.length(word) >= 3) & F.substring(word, 1, 1).isin(*C.PREFIXES), word.substr(F.lit(2), F.length(word)))


def _stem(word: Column) -> Column:
    """The word without the first suffix of the list that it ends in and that leaves two letters; else null."""
    tried = F.when(F.lit(False), F.lit(""))
    for s in C.SUFFIXES:
        tried = tried.when(word.endswith(s) & (F.length(word) >= len(s) + 2), word.substr(F.lit(1), F.length(word) - len(s)))
    return tried


def has_hebrew(text: Column) -> Column:
    """All affixes are Hebrew, so other texts need no look at their words."""
    return text.rlike("[֐-׿]")


def affix_expand(text: Column) -> Column:
    """The text, and behind it each word of three letters or more without its prefix, and the stems of both."""

    def forms(word: Column) -> Column:
        bare = _strip_prefix(word)
        return F.when(F.length(word) >= 3, F.array_compact(F.array(bare, _stem(word), _stem(bare)))).otherwise(F.array().cast("array<string>"))

    whole = F.array_join(F.concat(F.array(text), F.flatten(F.transform(F.split(text, " "), forms))), " ")
    return F.when(has_hebrew(text), whole).otherwise(text)


def prefix_expand(text: Column) -> Column:
    """The older expansion: prefixes only."""
    whole = F.array_join(F.concat(F.array(text), F.array_compact(F.transform(F.split(text, " "), _strip_prefix))), " ")
    return F.when(has_hebrew(text), whole).otherwise(text)


def trigrams(text: Column) -> Column:
    """The set of trigrams of the text's words, each word padded with two blanks before and one behind."""
    padded = F.transform(tokens(text), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: p.substr(i, F.lit(3))))))


def similarity(grams: Column, other: Column) -> Column:
    """Jaccard similarity of two trigram sets, 0 if both are empty."""

    def share(common: Column) -> Column:
        union = F.size(grams) + F.size(other) - common
        return F.when(union == 0, F.lit(0.0)).otherwise(common.cast("double") / union)

    return let(F.size(F.array_intersect(grams, other)), share)


def hebrew_letters(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[֐-׿]"))


def hebrew_ratio(text: Column) -> Column:
    """Share of Hebrew among letters; null without letters."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.when(letters > 0, hebrew_letters(text) / letters)


def hits(text: Column, phrases: tuple[str, ...]) -> Column:
    """How many of the phrases the text holds."""
    return reduce(lambda a, b: a + b, [text.contains(p).cast("int") for p in phrases])


def any_of(text: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in phrases])


def occurrences(text: Column, phrase: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(phrase)))) / len(phrase)).cast("int")


def unique_ratio(own: Column) -> Column:
    return F.size(F.array_distinct(own)) / F.size(own)


def most_repeats(own: Column, n: int = 4) -> Column:
    """How often the most frequent n-gram of the words occurs. Grams are sorted and run lengths folded, so the work
    is not the square of the text's length."""
    grams = F.transform(F.sequence(F.lit(1), F.size(own) - (n - 1)), lambda i: F.array_join(F.slice(own, i, n), " "))
    start = F.struct(F.lit("").alias("g"), F.lit(0).alias("c"), F.lit(0).alias("m"))

    def step(s: Column, g: Column) -> Column:
        c = F.when(s["g"] == g, s["c"] + 1).otherwise(F.lit(1))
        return F.struct(g.alias("g"), c.alias("c"), F.greatest(s["m"], c).alias("m"))

    return F.when(F.size(own) >= n, F.aggregate(F.array_sort(grams), start, step, lambda s: s["m"])).otherwise(F.lit(0))


def repeats(own: Column, n: int = 4, least: int = 3) -> Column:
    """Does some n-gram of the words occur ``least`` times? Hashes of the grams (64 bits) are sorted, and places
    ``least - 1`` apart compared, so that no gram is put together as text."""
    grams = F.transform(F.sequence(F.lit(0), F.size(own) - n), lambda i: F.xxhash64(*[F.get(own, i + j) for j in range(n)]))

    def tied(ranked: Column) -> Column:
        count = F.size(ranked) - (least - 1)
        return (count > 0) & F.exists(F.zip_with(F.slice(ranked, 1, F.greatest(count, F.lit(0))), F.slice(ranked, least, F.greatest(count, F.lit(0))), lambda a, b: a == b), lambda x: x)

    return F.when(F.size(own) >= n, let(F.sort_array(grams), tied)).otherwise(F.lit(False))


def noise_segment(text: Column) -> Column:
    """short, repetitive, gibberish, commercial or jingle, by the first rule that holds; else null."""
    price = text.rlike(C.PRICE)
    phrases = hits(text, C.SEGMENT_AD_PHRASES)
    slogan = text.contains(C.TOO_LOW) & any_of(text, C.BRANDS)

    def rules(own: Column) -> Column:
        n = F.size(own)
        return (
            F.when(n < 5, "short")
            .when((n >= 8) & (unique_ratio(own) < 0.3), "repetitive")
            .when((n >= 12) & repeats(own), "repetitive")
            .when((n < 15) & (hebrew_ratio(text) < 0.3), "gibberish")
            .when((phrases >= 2) | ((phrases >= 1) & price) | (occurrences(text, C.LOWEST_PRICES) >= 2) | slogan, "commercial")
            .when((n <= 8) & any_of(text, C.STATION_JINGLES), "jingle")
        )

    return let(words(text), rules)


def noise_sentence(text: Column) -> Column:
    return let(words(text), lambda own: F.when(F.size(own) < 2, "short").when((F.size(own) >= 6) & (unique_ratio(own) < 0.3), "repetitive"))


def is_ad_index(text: Column) -> Column:
    low, price = F.lower(text), text.rlike(C.PRICE)
    found = hits(low, C.INDEX_AD_PHRASES)
    return (found >= 2) | ((found >= 1) & price) | (occurrences(text, C.LOWEST_PRICES) >= 2) | ((occurrences(text, C.SHEKELS) >= 2) & price) | (text.contains(C.TOO_LOW) & any_of(text, C.BRANDS))


def is_ad_filter(text: Column) -> Column:
    return hits(F.lower(text), C.FILTER_AD_PHRASES) >= 2


def is_jingle(text: Column) -> Column:
    return (F.size(words(text)) <= 8) & any_of(text, C.STATION_JINGLES)


def is_jingle_filter(text: Column, seconds: Column) -> Column:
    low = F.lower(text)
    return (seconds < 15) & (F.size(words(low)) < 20) & any_of(low, C.FILTER_JINGLES)


def quality_penalty(text: Column) -> Column:
    """The factor by which short and repetitive texts lose rank."""

    def factor(own: Column) -> Column:
        n = F.size(own)
        short = F.when(n < 5, 0.3).when(n < 10, 0.7).otherwise(1.0)
        ratio = let(unique_ratio(own), lambda r: F.when((n >= 8) & (r < 0.3), 0.2).when((n >= 8) & (r < 0.4), 0.5).otherwise(1.0))
        again = F.when((n >= 12) & repeats(own), 0.4).otherwise(1.0)
        return short * ratio * again

    return let(words(F.coalesce(text, F.lit(""))), factor)


def similarity_factor(similarity: Column, rank: Column) -> Column:
    """Clamped to 0.3 .. 1; a row with neither counts as 0.5."""
    return F.least(F.greatest(F.coalesce(similarity, rank, F.lit(0.5)) / 0.5, F.lit(0.3)), F.lit(1.0))


def highlight(text: Column, query: str) -> Column:
    """Every occurrence of the query marked, whatever its case."""
    if not query:
        return text
    quoted = "\\Q" + query.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.regexp_replace(text, f"(?iu)({quoted})", "<mark>$1</mark>")


def minutes(seconds: Column) -> Column:
    """m:ss."""
    whole = F.floor(seconds)
    return F.format_string("%d:%02d", F.floor(whole / 60), whole % 60)
