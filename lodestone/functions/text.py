"""Column builders over text: sizes, token estimates, similarity, lines, normalisation. No UDFs."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that may lead a line, and signs that may end it, without counting for a comparison.
QUALIFIERS = ["public", "private", "internal", "protected", "static", "final", "override", "export", "async"]
TRAILING = ["->", "=>", ":=", "=", ":"]

_CJK = "[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsHangul}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utf16_length(text: Column | str) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return (F.octet_length(F.encode(col(text), "UTF-16BE")) / 2).cast("long")


def utf8_bytes(text: Column | str) -> Column:
    return F.octet_length(col(text)).cast("long")


def is_minified(text: Column | str) -> Column:
    """Lines of over 100 units on average and more than one semicolon in a hundred units."""
    units = utf16_length(text)
    lines = F.regexp_count(col(text), F.lit("\n")) + 1
    return (units / lines > 100) & (F.regexp_count(col(text), F.lit(";")) > units * F.lit(0.01))


def estimate_tokens(text: Column | str) -> Column:
    """About four bytes to a token, a twentieth more; texts with much CJK cost more, minified ones less."""
    units = utf16_length(text)
    base = F.ceil(utf8_bytes(text) / F.lit(4.0) * F.lit(1.05))
    cjk = F.when((units > 0) & (F.regexp_count(col(text), F.lit(_CJK)) > units * F.lit(0.1)), F.lit(1.3)).otherwise(F.lit(1.0))
    small = F.when(is_minified(text), F.lit(0.8)).otherwise(F.lit(1.0))
    return F.ceil(base * (cjk * small)).cast("long")


def lines_kept(text: Column | str) -> Column:
    """Lines with their terminators; an empty text has none."""
    return F.regexp_extract_all(col(text), F.lit("[^\n]*\n|[^\n]+$"), F.lit(0))


def lines(text: Column | str) -> Column:
    """Lines without terminators (LF or CRLF), without the empty one after a last terminator."""
    parts = F.split(col(text), "\r?\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def bigrams(text: Column) -> Column:
    """All pairs of neighbouring characters, repeats included; a single character stands for itself."""
    n = F.char_length(text)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(pairs)


def path_dice(query: str, candidate: Column) -> Column:
    """Set-bigram Dice of a query without white space and a candidate reduced to letters and digits."""
    wanted = re.sub(r"\s+", "", query.lower())
    grams = sorted({wanted[i : i + 2] for i in range(max(1, len(wanted) - 1))} - {""})
    held = F.array_distinct(bigrams(F.regexp_replace(F.lower(candidate), "[^\\p{L}\\p{N}]", "")))
    if not grams:
        return F.lit(0.0)
    own = F.array(*map(F.lit, grams))
    return F.when(F.size(held) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(own, held)) * 2.0 / (F.size(held) + len(grams)))


def multiset_dice(a: Column, b: Column) -> Column:
    """Bigram Dice that counts repeats: twice the shared bigrams over all of both."""
    x, y = bigrams(a), bigrams(b)
    times = lambda grams, g: F.size(F.filter(grams, lambda h: h == g))
    shared = F.aggregate(F.array_distinct(x), F.lit(0), lambda n, g: n + F.least(times(x, g), times(y, g)))
    return F.when(a == b, F.lit(1.0)).when((F.char_length(a) < 2) | (F.char_length(b) < 2), F.lit(0.0)).otherwise(shared * 2.0 / (F.size(x) + F.size(y)))


def _levelled(line: Column | str) -> Column:
    low = F.replace(F.lower(col(line)), F.lit(" "), F.lit(" "))
    low = F.trim(F.regexp_replace(low, "\\s+", " "))
    low = F.regexp_replace(low, f"^(?:{'|'.join(QUALIFIERS)})\\s+", "")
    return F.regexp_replace(low, "[-=_*~]{4,}", "-")


def _without_end_sign(line: Column) -> Column:
    def cut(x: Column) -> Column:
        ended = reduce(Column.__or__, [F.endswith(x, F.lit(sign)) for sign in sorted({t[-1] for t in TRAILING})])
        return F.when(ended, F.regexp_replace(x, f"\\s*(?:{'|'.join(map(re.escape, TRAILING))})\\z", "")).otherwise(x)

    # a one-element array binds the line; the pattern would try each of its places, so it sees only lines that end in a sign
    return F.get(F.transform(F.array(line), cut), 0)


def normalised_line(line: Column | str) -> Column:
    """A whole line as comparisons see it: case, spacing, one leading qualifier, rulers and an end sign set aside."""
    return _without_end_sign(_levelled(line))


def normalised_head(line: Column | str, most: int) -> Column:
    """The first characters of a normalised line, cut before an end sign goes. To show a line, not to compare it."""
    return _without_end_sign(F.substring(_levelled(line), 1, most))


def occurrences(text: Column | str, phrase: Column | str) -> Column:
    """How often a phrase stands in a text without overlap; an empty phrase never does."""
    what = F.lit(phrase) if isinstance(phrase, str) else phrase
    gone = F.replace(col(text), what, F.lit(""))
    n = F.char_length(what)
    return F.when(n == 0, F.lit(0)).otherwise(((F.char_length(col(text)) - F.char_length(gone)) / n).cast("int"))
