"""Content as typed blocks: text, hashtags, URLs, mentions by index or entity, payment requests.

A block begins at the start of the content, behind a blank, a sign or any
character beyond ASCII, or at a ``#`` anywhere. What lies between blocks is text.
Positions are code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import types as T

from tidewell.functions.codecs import ENTITY_TYPE, INVOICE_TYPE, arrow_type, decode_invoice, entity, mapped_together, struct

#: Fixed values of the wire format: the scheme of entities, and the prefix and scheme of payment requests.
ENTITY_SCHEME, REQUEST_SCHEME = "nostr:", "lightning:"
LEAST_ENTITY_DIGITS = 59

BLANK = " \t\n\x0b\x0c\r"
INDEX = re.compile(r"#\[(\d{1,3})\]", re.ASCII)
#: Up to a blank, an ASCII sign but the underscore, or a Unicode sign but the wave dash.
HASHTAG = re.compile(
    r"#((?=[^\s#])[^ \t\n\x0b\x0c\r!-/:-@\[-^`{-~ -¿ -⁯₠-⃏⸀-⹿⿰-〛〝-〿]*)"
)
URL = re.compile(r"https?://([A-Za-z0-9.-]+)(/[^ \t\n\x0b\x0c\r?#]*)?([?#][^ \t\n\x0b\x0c\r]*)?", re.IGNORECASE | re.ASCII)
REQUEST = re.compile(rf"(?:{REQUEST_SCHEME})?(lnbc[^ \t\n\x0b\x0c\r]*)", re.IGNORECASE | re.ASCII)
ENTITY = re.compile(
    rf"@?(?:(?i:{ENTITY_SCHEME}))?((note|npub|nsec|nprofile|nevent|nrelay|naddr)([A-Za-z0-9]*))", re.ASCII
)

Block = dict[str, Any]


def block(kind: str, text: str, start: int, **more: Any) -> Block:
    return {"type": kind, "text": text, "start": start, "len": len(text), "mention_index": None, "bech32": None, "invoice": None} | more


def url_at(content: str, at: int, mention_hosts: frozenset[str]) -> tuple[Block, int] | None:
    m = URL.match(content, at)
    if not m:
        return None
    end = m.end()
    if end == len(content) or content[end] in BLANK:
        # A full stop or comma that ends the word isn't part of the address.
        end -= content[end - 1] in ".,"
    if end <= m.start(1):
        return None
    if at and content[at - 1] == "(" and content[end - 1] == ")":
        end -= 1
    if m[1] in mention_hosts and m[2]:
        inner = ENTITY.match(content, m.start(2) + 1)
        if inner and len(inner[3]) >= LEAST_ENTITY_DIGITS and (found := entity(inner[1])):
            return block("mention_bech32", inner[1], inner.start(1), bech32=found), end
    return block("url", content[at:end], at), end


def block_at(content: str, at: int, mention_hosts: frozenset[str]) -> tuple[Block, int] | None:
    """The block that begins at a place, and where it ends."""
    c = content[at]
    if c == "#":
        if m := INDEX.match(content, at):
            return block("mention_index", m[0], at, mention_index=int(m[1])), m.end()
        if m := HASHTAG.match(content, at):
            return block("hashtag", m[1], at + 1), m.end()
    elif c in "hH":
        return url_at(content, at, mention_hosts)
    elif c in "lL":
        if m := REQUEST.match(content, at):
            found = decode_invoice(m[1])
            return block("invoice" if found else "text", m[1], m.start(1), invoice=found), m.end()
    elif c in "n@":
        m = ENTITY.match(content, at)
        if m and len(m[3]) >= LEAST_ENTITY_DIGITS:
            found = entity(m[1])
            return block("mention_bech32" if found else "text", m[1], m.start(1), bech32=found), m.end()
    return None


STARTS = re.compile(r"[#hHlLn@]")


def opens(content: str, at: int) -> bool:
    """Whether a block may begin here."""
    if at == 0 or content[at] == "#":
        return True
    before = content[at - 1]
    return before in BLANK or ord(before) >= 0x80 or not (before.isalnum() or before == "_" or ord(before) < 32)


def parse(content: str | None, mention_hosts: frozenset[str] = frozenset()) -> list[Block]:
    """The blocks of a content, in order."""

    def blocks(content: str) -> Iterator[Block]:
        text_from = at = 0
        while m := STARTS.search(content, at):
            at = m.start()
            found = block_at(content, at, mention_hosts) if opens(content, at) else None
            if found:
                if at > text_from:
                    yield block("text", content[text_from:at], text_from)
                yield found[0]
                text_from = at = found[1]
            else:
                at += 1
        if text_from < len(content):
            yield block("text", content[text_from:], text_from)

    return list(blocks(content or ""))


BLOCK_TYPE = struct(
    type=T.StringType(), text=T.StringType(), start=T.IntegerType(), len=T.IntegerType(), mention_index=T.IntegerType(),
    bech32=ENTITY_TYPE, invoice=INVOICE_TYPE,
)


def blocks_of(contents: list[str | None], mention_hosts: frozenset[str]) -> pa.Array:
    """The blocks of contents, put together by columns: structs in lists take long to convert one by one."""
    told = [parse(v, mention_hosts) for v in contents]
    flat = [b for found in told for b in found]
    columns = [pa.array([b[f.name] for b in flat], arrow_type(f.dataType)) for f in BLOCK_TYPE]
    ends = np.cumsum([0, *map(len, told)], dtype=np.int32)
    type_ = arrow_type(T.ArrayType(BLOCK_TYPE))
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, fields=list(type_.value_type))).cast(type_)


def blocks(content: Column, mention_hosts: frozenset[str] = frozenset()) -> Column:
    """An array of blocks. Links to entities on ``mention_hosts`` count as mentions."""
    return mapped_together(lambda values: blocks_of(values, mention_hosts), T.ArrayType(BLOCK_TYPE))(content)
