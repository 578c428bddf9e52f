"""Types of the tables. Ids are lower-case hex, times unix seconds, kinds and times LONG:
the sources allow unsigned 32-bit values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAGS = T.ArrayType(T.ArrayType(T.StringType()))

#: What an event's JSON must have; unknown keys are ignored.
EVENT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("pubkey", T.StringType()),
        T.StructField("created_at", T.LongType()),
        T.StructField("kind", T.LongType()),
        T.StructField("tags", TAGS),
        T.StructField("content", T.StringType()),
        T.StructField("sig", T.StringType()),
    ]
)
NOTE = T.StructType([T.StructField("note_key", T.LongType()), *EVENT.fields, T.StructField("flags", T.IntegerType())])

#: Flags of a note.
RUMOR, UNWRAPPED = 2, 4

#: Fields of a profile, the JSON content of a kind-0 note.
PROFILE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("name", "website", "about", "lud16", "banner", "display_name")]
    + [T.StructField("reactions", T.BooleanType())]
    + [T.StructField(n, T.StringType()) for n in ("picture", "nip05", "lud06")]
)

PROFILE_KIND, TEXT_KIND, CONTACTS_KIND, REPOST_KIND, REACTION_KIND, LONG_TEXT_KIND = 0, 1, 3, 6, 7, 30023
GENERIC_REPOST_KIND, ZAP_KIND = 16, 9735
TEXT_KINDS, REPOST_KINDS = (TEXT_KIND, LONG_TEXT_KIND), (REPOST_KIND, GENERIC_REPOST_KIND)

#: Names of the kinds that statistics tell apart. Fixed values.
KIND_NAMES = {
    0: "profile", 1: "text", 3: "contacts", 4: "dm", 5: "delete", 6: "repost", 7: "reaction", 9735: "zap",
    9734: "zap_request", 23194: "nwc_request", 23195: "nwc_response", 27235: "http_auth", 30000: "list",
    30023: "longform", 30315: "status",
}


def is_id(value: Column) -> Column:
    """Whether a string is an id: 64 hexadecimal digits."""
    return F.coalesce(value.rlike("^[0-9a-fA-F]{64}$"), F.lit(False))


def is_replaceable(kind: Column) -> Column:
    """Kinds of which a later note replaces an earlier one of its author. The engine keeps all versions."""
    return kind.isin(0, 3) | kind.between(10_000, 19_999) | kind.between(30_000, 39_999)
