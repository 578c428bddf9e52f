"""Notes made by a program: ids computed and, with a secret key, signed."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tidewell.functions import codecs, crypto
from tidewell.schema import EVENT


def decode_key(text: str) -> tuple[bytes, bytes]:
    """A secret key, in hex or as an nsec entity, and its public key."""
    found = codecs.entity(text) if text.startswith("nsec") else None
    raw = found["id"] if found and found["type"] == "nsec" else text
    secret = bytes.fromhex(raw)
    if len(secret) != 32:
        raise ValueError("a secret key has 32 bytes")
    return secret, crypto.public_key(secret)


def build(content: str, kind: int = 1, tags: Iterable[Iterable[str]] = (), created_at: int = 0, secret: bytes | None = None, pubkey: str = "") -> dict[str, Any]:
    """One event. Without a secret key it has the author that is given and an empty signature."""
    author = crypto.public_key(secret).hex() if secret else pubkey
    note: dict[str, Any] = {"pubkey": author, "created_at": created_at, "kind": kind, "tags": [list(t) for t in tags], "content": content}
    note["id"] = crypto.commitment(note).hex()
    return note | {"sig": crypto.sign(secret, bytes.fromhex(note["id"])).hex() if secret else ""}


def frame(spark: SparkSession, notes: Iterable[Mapping[str, Any]]) -> DataFrame:
    """Events as a DataFrame of the schema that the sources give."""
    return spark.createDataFrame([tuple(n[f] for f in EVENT.fieldNames()) for n in notes], EVENT)
