"""Column functions on text; patterns and word lists are parameters with Persian defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits, invisible characters, and the letters that a match key folds or drops.
LATIN, PERSIAN = "0123456789", "۰۱۲۳۴۵۶۷۸۹"
INVISIBLE = "[\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}\\x{FEFF}]"
FOLD_FROM, FOLD_TO = "أإةيكء ‌", "ااهیک"
ARTICLE_WORD = " - ماده "
SPACE = "(?U)\\s+"


def to_latin_digits(c: Column) -> Column:
    return F.translate(c, PERSIAN, LATIN)


def to_persian_digits(c: Column) -> Column:
    return F.translate(c, LATIN, PERSIAN)


def strip_invisible(c: Column) -> Column:
    """Invisible characters go, then outer white space."""
    return F.regexp_replace(F.regexp_replace(c, INVISIBLE, ""), "(?U)^\\s+|\\s+$", "")


def clean_free_text(c: Column) -> Column:
    """Latin digits, invisible characters as spaces, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(to_latin_digits(c), INVISIBLE, " "), SPACE, " "))


def match_key(c: Column, source: str = FOLD_FROM, target: str = FOLD_TO) -> Column:
    """A key equal for spellings that differ in folded letters; letters of `source` beyond `target` are dropped."""
    return F.translate(c, source, target)


def tokens(c: Column, pattern: str, least: int = 1) -> Column:
    """All matches of the pattern with at least `least` characters."""
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    return found if least <= 1 else F.filter(found, lambda t: F.length(t) >= least)


def search_tokens(c: Column) -> Column:
    return tokens(F.translate(c, "‌", " "), "[\\x{0600}-\\x{06FF}]+|(?U)\\d+")


def vocabulary_tokens(c: Column) -> Column:
    return tokens(c, "[\\x{0600}-\\x{06FF}\\x{200C}]+", 2)


def head_and_tail(c: Column, most: int = 12_000, head: float = 0.4, marker: str = "\n...\n") -> Column:
    """Texts over `most` characters keep their first and last parts."""
    first = int(most * head)
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, first), F.lit(marker), F.right(c, F.lit(most - first)))).otherwise(c)


def truncated(c: Column, most: int, end: str = " ...") -> Column:
    """Trimmed; over `most` characters cut there, trimmed on the right and marked."""
    t = F.trim(c)
    return F.when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most)), F.lit(end))).otherwise(t)


def chunks(c: Column, size: int = 3000, overlap: int = 200, cap: int | None = None) -> Column:
    """Overlapping pieces of the whole text, or of its first `cap` characters; one piece if it is short."""
    t = c if cap is None else F.substring(c, 1, cap)
    starts = F.sequence(F.lit(0), F.greatest(F.length(t) - 1, F.lit(0)), F.lit(size - overlap))
    return F.when(F.length(t) <= size, F.array(t)).otherwise(F.transform(starts, lambda s: F.substring(t, s + 1, F.lit(size))))


def joined_sections(sections: Column, separator: str = "\n\n") -> Column:
    return F.array_join(F.transform(sections, lambda s: s["text"]), separator)


def without_noise(c: Column, phrases: list[str], patterns: list[str], sentinel: str = " \u0001 ") -> Column:
    """Phrases (longest first) and patterns become a sentinel that keeps their neighbours apart."""
    import re

    quoted = [re.escape(p) for p in sorted(phrases, key=len, reverse=True)]
    return F.regexp_replace(c, "|".join([*quoted, *patterns]), sentinel)


def article_ref(law: Column, number: Column, word: str = ARTICLE_WORD) -> Column:
    return F.concat(law, F.lit(word), to_persian_digits(number.cast("string")))


def parsed_ref(ref: Column, word: str = ARTICLE_WORD) -> Column:
    """struct(law, article_number) from the last `word` on; null if there is none or no number follows."""
    import re

    pattern = f"^(.*){re.escape(word)}(.*)$"
    law = F.regexp_extract(ref, pattern, 1)
    number = F.trim(to_latin_digits(F.regexp_extract(ref, pattern, 2))).try_cast("int")
    return F.when(ref.contains(word) & number.isNotNull(), F.struct(F.trim(law).alias("law"), number.alias("article_number")))


def mapped(c: Column, table: dict[str, str], strict: bool = False) -> Column:
    """The table's value for c; for other values c itself, or an error if strict."""
    found = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.trim(c)]
    return F.coalesce(found, F.raise_error(F.concat(F.lit("unknown value: "), c)).cast("string")) if strict else F.coalesce(found, F.trim(c))


def value_in_quote(value: Column, quote: Column) -> Column:
    """Whether any token of the value (longer than one character) occurs in the quote."""
    return F.exists(F.filter(F.split(value, SPACE), lambda t: F.length(t) > 1), lambda t: F.contains(quote, t))
