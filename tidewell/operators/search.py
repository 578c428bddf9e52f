"""Full-text search by word prefixes, and search of profiles by name."""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.functions import text as text_functions
from tidewell.functions.binding import let
from tidewell.schema import PROFILE, PROFILE_KIND, TEXT_KINDS

#: Words of a query that count, and code points of a name that are indexed.
MOST_WORDS, NAME_LENGTH = 8, 23
#: Hits of a search without a limit of its own.
MOST_HITS = 128


def query_words(query: str) -> list[str]:
    """A query's first words, longest first. Words of one byte are left out: none could match."""
    low = query.translate(str.maketrans(text_functions.UPPER, text_functions.LOWER))
    separators = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: "\\u" + m[1].rjust(4, "0"), text_functions.SEPARATORS)
    found = [w for w in re.split(separators, low) if w][:MOST_WORDS]
    return sorted((w for w in found if len(w.encode()) >= 2), key=lambda w: -len(w.encode()))


def needed_prefix(word: str) -> bytes:
    """The bytes that a word must begin with to match: more than two thirds of the query's word."""
    raw = word.encode()
    return raw[: int(len(raw) / 1.5) + 1]


def has_prefix(word: Column, query_word: str) -> Column:
    prefix = needed_prefix(query_word)
    try:
        return F.startswith(word, F.lit(prefix.decode()))
    except UnicodeDecodeError:
        # The prefix ends inside a character.
        return F.startswith(F.encode(word, "utf-8"), F.lit(prefix))


def has_word(words: Column, query_word: str) -> Column:
    return F.exists(words, lambda x: (F.octet_length(x) >= 2) & has_prefix(x, query_word))


def any_case(text: str) -> str:
    """An expression for a text whose ASCII letters may be of either case."""
    return "".join(f"[{c}{c.upper()}]" if c.isascii() and c.isalpha() else re.escape(c) if c.isascii() else c for c in text)


def has_word_in(content: Column, query_word: str) -> Column | None:
    """The same by one pass over the text, which is neither lowered nor split; None if the prefix ends inside a character."""
    try:
        prefix = needed_prefix(query_word).decode()
    except UnicodeDecodeError:
        return None
    separator = text_functions.SEPARATORS.removesuffix("+")
    return content.rlike(rf"(?:\A|{separator}){any_case(prefix)}")


def matching_words(notes: DataFrame, query: str) -> DataFrame:
    """Notes of the indexed kinds that have a word for each word of the query.

    A test on each row: no table of words, no join and no shuffle. A query without words finds nothing.
    """
    wanted = query_words(query)
    indexed = notes.where(F.col("kind").isin(*TEXT_KINDS))
    if not wanted:
        return indexed.where(F.lit(False))
    content = F.col("content")
    tests = {w: has_word_in(content, w) for w in wanted}
    for test in tests.values():
        if test is not None:
            indexed = indexed.where(test)
    split = [w for w, test in tests.items() if test is None]
    if not split:
        return indexed

    def has_all(words: Column) -> Column:
        return functools.reduce(operator.and_, (has_word(words, w) for w in split))

    return indexed.where(let(text_functions.words(content), has_all))


def search(notes: DataFrame, query: str, limit: int = MOST_HITS, ascending: bool = False) -> DataFrame:
    """Search hits by time and key."""
    order = F.asc if ascending else F.desc
    out = matching_words(notes, query).orderBy(order("created_at"), order("note_key"))
    return out.limit(limit) if limit else out


def tokens(notes: DataFrame) -> DataFrame:
    """note_key, created_at, word, word_index: the table of words of the indexed kinds."""
    indexed = notes.where(F.col("kind").isin(*TEXT_KINDS))
    words = F.posexplode(text_functions.words(F.col("content"))).alias("word_index", "word")
    return indexed.select("note_key", "created_at", words)


def search_tokens(tokens: DataFrame, query: str) -> DataFrame:
    """note_key of the notes that have all words of the query, from a stored table of words.

    Each word's hits are bits; partial aggregation ors them before the shuffle.
    """
    wanted = query_words(query)
    hits = F.lit(0)
    for i, w in enumerate(wanted):
        hits = hits + F.when((F.octet_length("word") >= 2) & has_prefix(F.col("word"), w), 1 << i).otherwise(0)
    rows = tokens.select("note_key", hits.alias("bits")).where("bits > 0")
    full = (1 << len(wanted)) - 1
    return rows.groupBy("note_key").agg(F.bit_or("bits").alias("bits")).where(F.col("bits") == full).select("note_key")


def names(notes: DataFrame) -> DataFrame:
    """key, pubkey, created_at, note_key of each name that a kind-0 note gives; the display name if it differs."""
    profile = F.from_json("content", PROFILE)
    rows = notes.where(F.col("kind") == PROFILE_KIND).select("note_key", "pubkey", "created_at", profile.alias("p"))
    both = F.array_distinct(F.array("p.name", "p.display_name"))
    named = rows.select("note_key", "pubkey", "created_at", F.explode(F.filter(both, lambda n: n.isNotNull())).alias("name"))
    key = F.substring(text_functions.ascii_lower(F.col("name")), 1, NAME_LENGTH)
    return named.select(key.alias("key"), "pubkey", "created_at", "note_key")


def search_names(notes: DataFrame, query: str, limit: int = MOST_HITS, prefix_only: bool = False) -> DataFrame:
    """Names from the query on, in the order of keys, without a pubkey twice in a row.

    The walk has no end but the limit, unless ``prefix_only``. It is taken in
    growing heads of the order till enough are left, so what meets in one task
    is bounded by the limit. Without a limit only equal keys of a pubkey collapse.
    """
    low = query.translate(str.maketrans(text_functions.UPPER, text_functions.LOWER))[:NAME_LENGTH]
    walk = names(notes).where(F.col("key") >= low)
    if prefix_only:
        walk = walk.where(F.startswith("key", F.lit(low)))
    # Rows of one key and pubkey stand side by side: the walk shows the first of them.
    first = F.min_by("note_key", F.struct("created_at", "note_key")).alias("note_key")
    walk = walk.groupBy("key", "pubkey").agg(F.min("created_at").alias("created_at"), first)
    order = ["key", "pubkey"]
    if not limit:
        return walk.orderBy(*order)
    taken = 2 * limit
    while True:
        head = walk.orderBy(*order).limit(taken)
        before = F.lag("pubkey").over(Window.orderBy(*order))
        fresh = head.withColumn("_before", before).where("_before IS NULL OR _before != pubkey").drop("_before")
        n, kept = head.count(), fresh.count()
        if kept >= limit or n < taken:
            return fresh.orderBy(*order).limit(limit)
        taken *= 2


def profile_notes(notes: DataFrame, query: str) -> DataFrame:
    """All kind-0 notes of the pubkeys that have a name from the query on."""
    keys = names(notes).where(F.col("key") >= query.translate(str.maketrans(text_functions.UPPER, text_functions.LOWER))[:NAME_LENGTH])
    return notes.where(F.col("kind") == PROFILE_KIND).join(keys.select("pubkey").distinct(), "pubkey", "left_semi")
