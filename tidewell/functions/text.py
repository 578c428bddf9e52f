"""Text functions: the tokeniser, ASCII lower case, word counts, reactions, ids in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: What separates words, as a character class of Java's and RE2's expressions: ASCII blanks and signs but the
#: underscore, and blocks of Unicode signs. Fixed values.
SEPARATORS = (
    r"[\t-\r !-/:-@\[-^`{-~\x{A0}-\x{BF}\x{2000}-\x{206F}\x{20A0}-\x{20CF}"
    r"\x{2E00}-\x{2E7F}\x{2FF0}-\x{2FFF}\x{3000}-\x{301B}\x{301D}-\x{303F}]+"
)
#: Bytes that a reaction may have if it isn't a single character.
MOST_REACTION_BYTES = 6
#: One emoji: a character with modifiers, or several tied by U+200D; two letters of a country's flag; a keycap; a flag
#: whose region is spelt in tag characters.
EMOJI = (
    r"^(?:[\x{1F1E6}-\x{1F1FF}]{2}|[0-9#*]\x{FE0F}?\x{20E3}|\x{1F3F4}[\x{E0020}-\x{E007E}]+\x{E007F})\z|^(?:\p{So}|\p{Sk}|[\x{1F000}-\x{1FAFF}])[\x{FE0F}\x{1F3FB}-\x{1F3FF}\x{20E3}]*"
    r"(?:\x{200D}(?:\p{So}|[\x{1F000}-\x{1FAFF}\x{2640}\x{2642}])[\x{FE0F}\x{1F3FB}-\x{1F3FF}]*)*\z"
)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Lower-cased words in order."""
    return F.filter(F.split(ascii_lower(text), SEPARATORS, -1), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Words that begin behind a blank; one at the start of the text doesn't count."""
    return F.regexp_count(text, F.lit(r"(?<=[ \t\n\x0B\f\r])[^ \t\n\x0B\f\r]")).cast("long")


def reaction(content: Column) -> Column:
    """A reaction's key: an emoji or another single character, a string of at most six bytes, else ``+``."""
    short = (F.octet_length(content) <= MOST_REACTION_BYTES) | (F.char_length(content) == 1) | content.rlike(EMOJI)
    return F.when(short, content).otherwise(F.lit("+"))


def event_id(pubkey: Column, created_at: Column, kind: Column, tags: Column, content: Column) -> Column:
    """The id that an event must have: SHA-256 of its compact JSON form."""

    def quoted(s: Column) -> Column:
        for raw, out in (("\\", "\\\\"), ('"', '\\"'), ("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            s = F.replace(s, F.lit(raw), F.lit(out))
        return F.concat(F.lit('"'), s, F.lit('"'))

    listed = F.transform(tags, lambda t: F.concat(F.lit("["), F.array_join(F.transform(t, quoted), ","), F.lit("]")))
    whole = F.concat(
        F.lit('[0,"'), pubkey, F.lit('",'), created_at.cast("string"), F.lit(","), kind.cast("string"),
        F.lit(",["), F.array_join(listed, ","), F.lit("],"), quoted(content), F.lit("]"),
    )
    return F.sha2(whole, 256)
