"""Text expressions: words, stems, tokens, slugs, masking. No Python runs per row."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, functions as F

from heliofleet import fixed

# White space as Python's str.strip and \s see it.
SPACE = r"[\s\x1c-\x1f]"
SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def collapsed(text: Column) -> Column:
    """White space runs to single blanks, ends trimmed."""
    return F.btrim(F.regexp_replace(text, rf"(?U){SPACE}+", " "))


def _pieces(text: Column) -> Column:
    return F.split(F.lower(text), "[^a-z0-9]+")


def words(text: Column) -> Column:
    return F.filter(_pieces(text), lambda w: w != "")


def is_term(word: Column) -> Column:
    return (F.length(word) > 1) & ~word.isin(*fixed.STOPWORDS)


def stem(word: Column) -> Column:
    """The first suffix rule that leaves three letters, then a final e is dropped."""
    chain = None
    for suffix, replacement in fixed.STEM_SUFFIXES:
        applies = word.endswith(suffix) & (F.length(word) >= len(suffix) + 3)
        if suffix == "s":
            applies = applies & ~word.endswith("ss")
        cut = F.substr(word, F.lit(1), F.length(word) - len(suffix))
        value = F.concat(cut, F.lit(replacement)) if replacement else cut
        chain = F.when(applies, value) if chain is None else chain.when(applies, value)
    base = chain.otherwise(word)
    return F.when(base.endswith("e") & (F.length(base) > 3), F.substr(base, F.lit(1), F.length(base) - 1)).otherwise(base)


def expanded(found: Column) -> Column:
    """Query words with shorthand followed by the words it stands for."""
    table = F.create_map(*[F.lit(x) for k, v in fixed.QUERY_EXPANSIONS.items() for x in (k, v)])
    return F.flatten(F.transform(found, lambda w: F.concat(
        F.array(w), F.coalesce(F.split(table[w], " "), F.array().cast("array<string>")))))


def kept_words(text: Column, expand: bool = False) -> Column:
    found = _pieces(text)
    return F.filter(expanded(found) if expand else found, is_term)


def tokens(text: Column, expand: bool = False) -> Column:
    """Stemmed terms in order, repeats kept."""
    return F.transform(kept_words(text, expand), stem)


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def sentences(text: Column) -> Column:
    parts = F.split(stripped(text), rf"(?U)(?<=[.!?]){SPACE}+")
    return F.filter(parts, lambda s: s != "")


def mask_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """Secrets replaced rule by rule; ``hits_<rule>`` counts what each rule replaced. A rule's
    pattern only runs on texts that hold one of the literals it cannot match without."""
    # Lower case with the long s folded, as a case-blind Unicode pattern sees letters. Looked at
    # once: no replacement brings in a literal that a later rule needs.
    out = df.withColumn("_plain", F.translate(F.lower(text), "\u017f", "s"))
    for name, pattern, replacement in fixed.SECRET_RULES:
        may = functools.reduce(operator.or_, [F.contains("_plain", F.lit(w)) for w in fixed.SECRET_LITERALS[name]])
        out = (
            out.withColumn("_may", may)
            .withColumn(f"hits_{name}", F.when(F.col("_may"), F.regexp_count(F.col(text), F.lit(pattern))).otherwise(0))
            .withColumn(text, F.when(F.col("_may"), F.regexp_replace(text, pattern, replacement)).otherwise(F.col(text))))
    return out.drop("_may", "_plain")
