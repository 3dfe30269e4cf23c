"""Text columns: built-in expressions only, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in Unicode; written out because `\\s` means other characters in every engine.
SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Any character but white space.
INK = SPACE.replace("[", "[^", 1)
WORD = r"[\p{L}\p{N}_]+"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD2 = r"[\p{L}\p{N}_]{2,}"
#: Tokens of a language model for each word, where none is at hand.
TOKENS_PER_WORD = 1.33
#: Tokens that frame a message.
FRAME = 4


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize(text) -> Column:
    """White space runs as one space, ends trimmed; '' for null."""
    return F.trim(F.regexp_replace(F.coalesce(_c(text), F.lit("")), f"{SPACE}+", " "))


def words(text, lower: bool = True) -> Column:
    """Runs of letters, digits and underscores; [] for null."""
    text = F.coalesce(_c(text), F.lit(""))
    return F.regexp_extract_all(F.lower(text) if lower else text, F.lit(WORD), F.lit(0))


def long_words(text) -> Column:
    """Lower-cased words of at least two characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit(WORD2), F.lit(0))


def tokens(text) -> Column:
    """Words and single marks, in order; [] for null."""
    return F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(TOKEN), F.lit(0))


def pieces(text) -> Column:
    """Runs between white space."""
    return F.filter(F.split(normalize(text), " "), lambda w: w != "")


def word_count(text) -> Column:
    return F.size(pieces(text))


def model_tokens(text) -> Column:
    """Estimated tokens of a language model: 1.33 a word, rounded half to even."""
    return F.bround(word_count(text) * F.lit(TOKENS_PER_WORD)).cast("int")


def message_tokens(*texts) -> Column:
    """Estimated tokens of framed messages."""
    total = F.lit(0)
    for t in texts:
        total = total + model_tokens(t) + FRAME
    return total


def first_filled(*columns) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.when(_c(c) != "", _c(c)) for c in columns))


def text_of(df, name: str) -> Column:
    """The text of a column of strings, of arrays of strings (joined by spaces), or of records (their first filled text, body or title).

    TypeError for a column of another kind; '' for null.
    """
    kind = df.schema[name].dataType
    if kind.typeName() == "string":
        return F.coalesce(F.col(name), F.lit(""))
    if kind.typeName() == "array" and kind.elementType.typeName() == "string":
        return F.coalesce(F.array_join(name, " "), F.lit(""))
    if kind.typeName() == "struct":
        if parts := [f"{name}.{c}" for c in ("text", "body", "title") if c in kind.names]:
            return F.coalesce(first_filled(*parts), F.lit(""))
    raise TypeError(f"{name} holds {kind.simpleString()}, not text")


def lowered(text, top: int | None = None) -> Column:
    """A text in lower case, or its first top white-space words only."""
    low = F.lower(F.coalesce(_c(text), F.lit("")))
    return low if top is None else F.array_join(F.slice(pieces(low), 1, top), " ")


def name_key(name) -> Column:
    """A name in lower case with single spaces; null for null and blank."""
    return F.when(normalize(name) != "", F.lower(normalize(name)))


def last_part(path) -> Column:
    """What follows the last slash."""
    return F.element_at(F.split(_c(path), "/"), -1)
