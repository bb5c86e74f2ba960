"""Text functions as Column expressions. Sizes and offsets of the retrieval operators are UTF-8 bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALNUM = r"[\p{IsAlphabetic}\p{N}]+"
#: Words that the filtered tokenizer leaves out, longest first.
STOPWORDS = tuple("with will were from that was the its has for and are to on of it is in he by be at as an a".split())


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order; null counts as empty."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(ALNUM), F.lit(0))


def filtered_tokens(text: Column) -> Column:
    """Tokens without stopwords; repeats stay."""
    return F.filter(tokens(text), lambda t: ~t.isin(*STOPWORDS))


def bigrams(words: Column) -> Column:
    """Adjacent pairs of an array as structs (first, second)."""
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("first"), b.alias("second")))
    return F.when(n > 1, pairs).otherwise(F.array().cast("array<struct<first:string,second:string>>"))


def trim_unicode(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    """Parts between Unicode white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: F.length(w) > 0)


def lexical_overlap(query: Column, content: Column) -> Column:
    """Jaccard of the two sets of words; words match without regard to A-Z and a-z, sets are case-sensitive."""
    q, c = F.array_distinct(words(query)), F.array_distinct(words(content))
    return overlap_of_words(q, c, F.array_distinct(F.transform(c, F.lower)))


def overlap_of_words(q: Column, c: Column, low: Column) -> Column:
    """lexical_overlap of distinct words that are worked out before: q of the query, c of the content, low those in lower case."""
    common = F.size(F.filter(q, lambda w: F.array_contains(low, F.lower(w))))
    return F.when((F.size(q) == 0) | (F.size(c) == 0), F.lit(0.0)).otherwise(common / (F.size(q) + F.size(c) - common))


def contains_any(text: Column, *keywords: str) -> Column:
    found = F.lit(False)
    for keyword in keywords:
        found = found | text.contains(keyword)
    return found


def byte_truncate(text: Column, n: Column) -> Column:
    """The longest prefix of whole characters of at most n UTF-8 bytes."""
    cut = F.substring(F.encode(text, "UTF-8"), F.lit(1), F.greatest(n, F.lit(0)))
    size = F.octet_length(cut)
    byte = lambda k: F.coalesce(F.conv(F.hex(F.substring(cut, size - (k - 1), F.lit(1))), 16, 10).cast("int"), F.lit(0))
    # An unfinished character at the end: its first byte is the last, the second last of 3 or more, or the third last of 4.
    drop = F.when(byte(1) >= 0xC0, 1).when((size > 1) & (byte(1) >= 0x80) & (byte(2) >= 0xE0), 2).when((size > 2) & (byte(1) >= 0x80) & (byte(2) >= 0x80) & (byte(3) >= 0xF0), 3).otherwise(0)
    return F.when(F.octet_length(text) <= n, text).otherwise(F.decode(F.substring(cut, F.lit(1), size - drop), "UTF-8"))


def one_line(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" "))


def fixed(x: Column, digits: int = 3) -> Column:
    return F.format_string(f"%.{digits}f", x)


#: Jackson as strict as RFC 8259.
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "maxNestingDepth": "100000", "maxStringLen": "2147483647", "maxNumLen": "2147483647"}


def is_json(text: Column) -> Column:
    """One whole JSON text (RFC 8259); repeated keys are allowed, half a surrogate pair isn't. Spark's parsers read one value and
    leave what follows it unread, so the text is read as the first of two elements: it is whole if the second, its own digest, is
    found right behind it."""
    mark = F.md5(text.cast("binary"))
    read = F.from_json(F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]')), "array<string>", _STRICT)
    high, low = r"\\u[dD][89aAbB][0-9a-fA-F]{2}", r"\\u[dD][c-fC-F][0-9a-fA-F]{2}"
    half = text.rlike(rf"(?<!\\)(?:\\\\)*(?:{high}(?!{low})|(?<!{high}){low})")
    return F.coalesce((F.size(read) == 2) & (F.get(read, F.lit(1)) == mark) & ~half, F.lit(False))


def prompt(instruction: str, context: Column, query: Column, prefix: str = "User Query:") -> Column:
    """Instruction, context and question, a blank line between."""
    return F.concat(F.lit(instruction + "\n\n"), context, F.lit(f"\n\n{prefix} "), query)
