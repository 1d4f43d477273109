"""Column expressions on text. All stay inside the JVM; no Python UDF is used."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "一-鿿"
WORD_OR_CJK = rf"[{CJK}]|[\p{{L}}\p{{N}}_&&[^{CJK}]]+"
WORD_OR_CJK_RUN = rf"[{CJK}]+|[\p{{L}}\p{{N}}_&&[^{CJK}]]+"


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Every match of `pattern` in the text, empty array for null text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    """First match or null (Spark's own function gives '' when nothing matches)."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def tokens(text: Column) -> Column:
    """Lower-cased tokens: each CJK character alone, other letters/digits/_ as runs."""
    return matches(F.lower(text), WORD_OR_CJK)


def char_ngrams(text: Column, size: int) -> Column:
    """All substrings of `size` characters, in order."""
    return F.when(
        F.length(text) >= size,
        F.transform(F.sequence(F.lit(1), F.length(text) - (size - 1)), lambda i: F.substring(text, i, size)),
    ).otherwise(F.array().cast("array<string>"))


def ngrams_between(text: Column, low: int, high: int) -> Column:
    return F.concat(*[char_ngrams(text, n) for n in range(low, high + 1)])


def search_tokens(text: Column) -> Column:
    """Distinct index tokens; a CJK run gives its characters and its bigrams.

    Text without CJK takes the short path, which Spark compiles to plain regex calls.
    """
    runs = matches(F.lower(text), WORD_OR_CJK_RUN)
    mixed = F.flatten(
        F.transform(
            runs,
            lambda r: F.when(r.rlike(f"^[{CJK}]"), F.concat(char_ngrams(r, 1), char_ngrams(r, 2))).otherwise(F.array(r)),
        )
    )
    return F.array_distinct(F.when(text.rlike(f"[{CJK}]"), mixed).otherwise(runs))


def bag_tokens(text: Column) -> Column:
    """Like `search_tokens` but with repeats kept (true term frequency)."""
    runs = matches(F.lower(text), WORD_OR_CJK_RUN)
    mixed = F.flatten(
        F.transform(
            runs,
            lambda r: F.when(r.rlike(f"^[{CJK}]"), F.concat(char_ngrams(r, 1), char_ngrams(r, 2))).otherwise(F.array(r)),
        )
    )
    return F.when(text.rlike(f"[{CJK}]"), mixed).otherwise(runs)


def phrases(text: Column) -> Column:
    """Distinct phrase candidates: CJK runs of two or more, Latin words of three or more."""
    return F.array_distinct(matches(F.lower(text), rf"[{CJK}]{{2,}}|[a-z][a-z0-9_\-]{{2,}}"))


def statements(text: Column, min_len: int = 6) -> Column:
    """Sentences of at least `min_len` characters after trimming."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"[。！？.!?]"), strip)
    return F.filter(parts, lambda s: F.length(s) >= min_len)


def strip(text: Column) -> Column:
    """Trim blanks, tabs and line ends on both sides."""
    return F.regexp_replace(text, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def evidence_terms(text: Column) -> Column:
    """Distinct terms used to compare a statement with evidence: CJK runs, Latin words of 3+."""
    return F.array_distinct(matches(F.lower(text), rf"[{CJK}]{{2,}}|[a-z]{{3,}}"))


def section_number(text: Column) -> Column:
    """Clause number: `第 n 条`, then `§ n`, then the first dotted number."""
    return F.coalesce(
        first_match(text, r"第\s*([0-9.]+)\s*条", 1),
        first_match(text, r"§\s*([0-9]+(?:\.[0-9]+)*)", 1),
        first_match(text, r"([A-Z]\.[0-9]+|[0-9]+\.[0-9]+[a-z]?)", 1),
    )


def number_key(number: Column) -> Column:
    """Sort key of a dotted number, so that 33.3 comes before 33.27."""
    return F.transform(F.split(F.regexp_replace(number, r"[^0-9.]", ""), r"\."), lambda p: p.try_cast("int"))


def hash_slot(token: Column, dim: int) -> Column:
    """Stable slot of a token: leading 32 bits of its md5 modulo the dimension."""
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % dim


def contains_any(text: Column, words: list[str]) -> Column:
    """True if any word occurs in the text; the word list is a fixed small rule table."""
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w)
    return hit


def count_contained(text: Column, words: list[str]) -> Column:
    total = F.lit(0)
    for w in words:
        total = total + text.contains(w).cast("int")
    return total


def contained(text: Column, words: list[str]) -> Column:
    """The words of a fixed small list that occur in the text, in list order."""
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: text.contains(w))


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def ratio(num: Column, den: Column, default: float = 0.0) -> Column:
    """num / den as double, `default` when the denominator is zero or null."""
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(default))


def ladder(value: Column, steps: list[tuple[float, str]], bottom: str) -> Column:
    """Label of the first threshold reached, thresholds in falling order."""
    out = F
    for limit, label in steps:
        out = out.when(value >= limit, label)
    return out.otherwise(bottom)
