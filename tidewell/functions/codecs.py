"""Codecs of the wire format: bech32 entities and payment requests. Pure Python behind Arrow UDFs."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Digits of bech32, and the generator and the two constants of its checksum. Fixed values.
DIGITS = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
CONSTANTS = (1, 0x2BC830A3)
VALUES = {c: i for i, c in enumerate(DIGITS)}
ENTITIES = ("note", "npub", "nsec", "nprofile", "nevent", "nrelay", "naddr")

#: Digits are bytes of five bits. Between them, their letters here, and the alphabets that Python reads and writes by itself.
OF_LETTERS = bytes.maketrans(DIGITS.encode(), bytes(range(32)))
TO_LETTERS = bytes.maketrans(bytes(range(32)), DIGITS.encode())
OF_BASE32 = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", bytes(range(32)))
TO_BASE32 = bytes.maketrans(bytes(range(32)), b"0123456789abcdefghijklmnopqrstuv")

#: What the top digit of a checksum turns the rest by.
TOPS = [0] * 32
for _i, _g in enumerate(GENERATOR):
    for _top in range(32):
        TOPS[_top] ^= _g if _top >> _i & 1 else 0


def step(c: int, v: int) -> int:
    return (c & 0x1FFFFFF) << 5 ^ v ^ TOPS[c >> 25]


#: Digits that a checksum takes at once.
PLACES = 1024


@lru_cache(maxsize=1)
def parts_of_checksums() -> tuple[np.ndarray, np.ndarray]:
    """What each digit adds to a checksum at each place, and where that stands: a checksum is the xor of its digits' parts."""
    parts = np.empty((PLACES, 32), dtype=np.int64)
    now = list(range(32))
    for place in range(PLACES - 1, -1, -1):
        parts[place] = now
        now = [step(c, 0) for c in now]
    return parts.ravel(), np.arange(0, 32 * PLACES, 32)


@lru_cache(maxsize=1024)
def checksum_of_prefix(prefix: str) -> int:
    c = 1
    for v in expanded(prefix):
        c = step(c, v)
    return c


def checksum(prefix: str, digits: bytes) -> int:
    """The checksum of a prefix and what comes behind it."""
    parts, places = parts_of_checksums()
    c = checksum_of_prefix(prefix)
    for at in range(0, len(digits), PLACES - 6):
        # What was summed so far is six digits.
        rest = bytes(five_bit_digits(c, 6)) + digits[at : at + PLACES - 6]
        found = np.frombuffer(rest, np.uint8) + places[PLACES - len(rest) :]
        c = int(np.bitwise_xor.reduce(parts[found]))
    return c


def expanded(prefix: str) -> list[int]:
    return [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix]


def bech32_decode(text: str) -> tuple[str, bytes] | None:
    """Prefix and five-bit digits without the checksum, or None if anything is amiss."""
    if text != text.lower() and text != text.upper():
        return None
    prefix, one, data = text.lower().rpartition("1")
    if not one or not prefix or len(data) < 6 or data.strip(DIGITS):
        return None
    digits = data.encode().translate(OF_LETTERS)
    if checksum(prefix, digits) not in CONSTANTS:
        return None
    return prefix, digits[:-6]


def bech32_encode(prefix: str, data: bytes) -> str:
    return bech32_text(prefix, as_digits(data))


def bech32_text(prefix: str, digits: bytes) -> str:
    sum_ = checksum(prefix, digits + bytes(6)) ^ CONSTANTS[0]
    return prefix + "1" + (digits + bytes(five_bit_digits(sum_, 6))).translate(TO_LETTERS).decode()


def as_digits(data: bytes) -> bytes:
    """Bytes as digits; the last is filled up with zeros."""
    return base64.b32encode(data).rstrip(b"=").translate(OF_BASE32)


def number(digits: bytes) -> int:
    return int(digits.translate(TO_BASE32), 32) if digits else 0


def whole_bytes(digits: bytes) -> bytes:
    """The whole bytes of digits, whatever is left over."""
    n = 5 * len(digits)
    return (number(digits) >> n % 8).to_bytes(n // 8, "big")


def as_bytes(digits: bytes) -> bytes | None:
    """Digits as bytes. What is left over must be less than a digit, and zeros."""
    rest = 5 * len(digits) % 8
    return None if rest >= 5 or digits and digits[-1] & (1 << rest) - 1 else whole_bytes(digits)


def entity(text: str | None) -> dict[str, Any] | None:
    """A bech32 entity: type, id, pubkey, relays, kind, identifier. None if it can't be one."""
    found = bech32_decode(text or "")
    if not found or found[0] not in ENTITIES:
        return None
    kind, raw = found[0], as_bytes(found[1])
    if raw is None:
        return None
    out: dict[str, Any] = {"type": kind, "id": None, "pubkey": None, "relays": [], "kind": None, "identifier": None}
    if kind in ("note", "npub", "nsec"):
        if len(raw) != 32:
            return None
        return out | {"pubkey" if kind == "npub" else "id": raw.hex()}
    at = 0
    while at + 2 <= len(raw):
        tag, n = raw[at], raw[at + 1]
        value = raw[at + 2 : at + 2 + n]
        if len(value) < n:
            return None
        at += 2 + n
        if tag == 0 and kind in ("nevent", "nprofile"):
            if n != 32:
                return None
            out["id" if kind == "nevent" else "pubkey"] = value.hex()
        elif tag == 0 and kind == "naddr":
            out["identifier"] = value.decode("utf-8", "replace")
        elif tag == 0 or tag == 1:
            out["relays"].append(value.decode("utf-8", "replace"))
        elif tag == 2 and kind != "nprofile":
            if n != 32:
                return None
            out["pubkey"] = value.hex()
        elif tag == 3 and n == 4:
            out["kind"] = int.from_bytes(value, "big")
    needed = {"nevent": out["id"], "nprofile": out["pubkey"], "naddr": out["identifier"] is not None and out["pubkey"], "nrelay": out["relays"]}
    return out if needed[kind] else None


#: Millisatoshi of a whole coin, and what the letters behind an amount divide it by. Fixed values.
COIN = 100_000_000_000
DIVISORS = {"": 1, "m": 1000, "u": 1_000_000, "n": 1_000_000_000, "p": 1_000_000_000_000}
EXPIRY = 3600
REQUEST = re.compile(r"ln[a-z]+?(?:(\d+)([munp]?))?$")


def decode_invoice(text: str | None) -> dict[str, Any] | None:
    """A payment request: amount_msat, timestamp, expiry, description, description_hash.

    The signature isn't checked. A fraction of a millisatoshi is refused, and a
    request with neither description nor hash.
    """
    low = (text or "").strip()
    low = low[len("lightning:") :] if low.lower().startswith("lightning:") else low
    found = bech32_decode(low)
    m = found and REQUEST.match(found[0])
    if not m or len(found[1]) < 7 + 104:
        return None
    amount = None
    if m[1]:
        amount, rest = divmod(int(m[1]) * COIN, DIVISORS[m[2]])
        if rest:
            return None
    digits = found[1][:-104]
    out = {"amount_msat": amount, "timestamp": number(digits[:7]), "expiry": EXPIRY, "description": None, "description_hash": None}
    at = 7
    while at + 3 <= len(digits):
        tag, n = DIGITS[digits[at]], number(digits[at + 1 : at + 3])
        field = digits[at + 3 : at + 3 + n]
        if len(field) < n:
            return None
        at += 3 + n
        raw = whole_bytes(field)
        if tag == "d" and out["description"] is None:
            try:
                out["description"] = raw.decode()
            except UnicodeDecodeError:
                return None
        elif tag == "h" and n == 52 and out["description_hash"] is None:
            out["description_hash"] = raw.hex()
        elif tag == "x":
            out["expiry"] = number(field)
    return out if out["description"] is not None or out["description_hash"] else None


def five_bit_digits(value: int, n: int) -> list[int]:
    return [value >> 5 * i & 31 for i in range(n - 1, -1, -1)]


def encode_invoice(amount: str, timestamp: int, description: str, expiry: int = EXPIRY) -> str:
    """A payment request with zeros for a signature, which no decoder here checks. ``amount`` has its letter, or is empty."""
    digits = bytes(five_bit_digits(timestamp, 7))
    for tag, value in (("d", as_digits(description.encode())), ("x", bytes(five_bit_digits(expiry, 7)))):
        digits += bytes([VALUES[tag], *five_bit_digits(len(value), 2)]) + value
    return bech32_text("lnbc" + amount, digits + bytes(104))


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


TEXT, LONG = T.StringType(), T.LongType()
ENTITY_TYPE = struct(type=TEXT, id=TEXT, pubkey=TEXT, relays=T.ArrayType(TEXT), kind=LONG, identifier=TEXT)
INVOICE_TYPE = struct(amount_msat=LONG, timestamp=LONG, expiry=LONG, description=TEXT, description_hash=TEXT)


def arrow_type(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


#: Values that a function of many gets at once, and about how many bytes of them.
TOGETHER, TOGETHER_BYTES = 8192, 16 << 20


def mapped_together(function, returns: T.DataType):
    """An Arrow UDF that applies a function of a list, which gives a list or an array as long, to the values of a column."""

    @F.arrow_udf(returns)
    def run(values: pa.Array) -> pa.Array:
        type_ = arrow_type(returns)
        step = max(1, min(TOGETHER, len(values) * TOGETHER_BYTES // max(1, values.nbytes)))
        told = (function(values.slice(at, step).to_pylist()) for at in range(0, len(values), step))
        parts = [t if isinstance(t, pa.Array) else pa.array(t, type_) for t in told]
        return pa.concat_arrays(parts) if parts else pa.array([], type_)

    return run


def mapped(function, returns: T.DataType):
    """An Arrow UDF that applies a function to each value of a column."""
    return mapped_together(lambda values: [function(v) for v in values], returns)


def bech32_entity(text: Column) -> Column:
    return mapped(entity, ENTITY_TYPE)(text)


def invoice(text: Column) -> Column:
    return mapped(decode_invoice, INVOICE_TYPE)(text)


#: Emoji as 64-bit numbers: first code point, hash of the rest, skin tones. Fixed values of the format.
TONES = range(0x1F3FB, 0x1F400)
JOINER = 0x200D
POINT_SHIFT, HASH_SHIFT, TONE_SHIFTS = 42, 10, (7, 4)
POLYNOMIAL = 0x04C11DB7


def crc_of(points: list[int]) -> int:
    """The CRC of 32-bit numbers, highest bits first; of none it is 0."""
    crc = 0xFFFFFFFF if points else 0
    for p in points:
        for bit in range(31, -1, -1):
            high = crc >> 31 ^ p >> bit & 1
            crc = crc << 1 & 0xFFFFFFFF ^ (POLYNOMIAL if high else 0)
    return crc


def base_points(text: str) -> list[int]:
    """The code points without tones and joiners."""
    return [ord(c) for c in text if ord(c) not in TONES and ord(c) != JOINER]


def emoji_number(text: str | None) -> int | None:
    """The number of an emoji sequence."""
    if not text:
        return None
    tones = [ord(c) - TONES.start + 1 for c in text if ord(c) in TONES][:2]
    base = base_points(text)
    out = (base[0] if base else 0) << POINT_SHIFT | crc_of(base[1:17]) << HASH_SHIFT
    for tone, shift in zip(tones, TONE_SHIFTS, strict=False):
        out |= tone << shift
    return out


def emoji_key(text: Column) -> Column:
    """The number of an emoji as 16 hexadecimal digits; it may need all 64 bits."""
    return mapped(lambda v: None if (n := emoji_number(v)) is None else f"{n:016X}", T.StringType())(text)


#: Letters of country flags, what a keycap stands on, and what ends a region spelt in tag characters. Fixed values.
FLAG_LETTERS, KEYS, TAGS, TAGS_END = range(0x1F1E6, 0x1F200), "0123456789#*", range(0xE0020, 0xE007F), 0xE007F
BLACK_FLAG, WHOLE, KEYCAP = 0x1F3F4, 0xFE0F, 0x20E3
#: Regions with a flag of their own. Fixed values.
REGIONS = ("gbeng", "gbsct", "gbwls")


def flags_and_keycaps() -> Iterator[str]:
    """Emoji of several characters that follow from a rule."""
    for a in FLAG_LETTERS:
        for b in FLAG_LETTERS:
            yield chr(a) + chr(b)
    for c in KEYS:
        yield c + chr(KEYCAP)
        yield c + chr(WHOLE) + chr(KEYCAP)
    for region in REGIONS:
        yield chr(BLACK_FLAG) + "".join(chr(TAGS.start - 0x20 + ord(c)) for c in region) + chr(TAGS_END)


class EmojiReader:
    """Emoji from their numbers. A number has the first character and the tones; the rest is found by its hash among
    what follows from a rule and the sequences that the caller knows."""

    def __init__(self, known: Iterable[str] = ()):
        self.rest: dict[int, list[int]] = {}
        for text in (*flags_and_keycaps(), *known):
            points = base_points(text)
            self.rest[crc_of(points[1:17])] = points[1:17]

    def __call__(self, number: int | None) -> str | None:
        """The emoji, or None if its rest isn't known."""
        if number is None:
            return None
        first, told = number >> POINT_SHIFT, number >> HASH_SHIFT & 0xFFFFFFFF
        if told and told not in self.rest:
            return None
        rest = self.rest[told] if told else []
        tones = [chr(TONES.start + t - 1) for s in TONE_SHIFTS if (t := number >> s & 7)]
        out = chr(first) + "".join(tones[:1])
        tied = first not in FLAG_LETTERS and not (first == BLACK_FLAG and rest and rest[0] in TAGS)
        for p in rest:
            out += (chr(JOINER) if tied and p not in (WHOLE, KEYCAP) else "") + chr(p)
        return out + "".join(tones[1:])


def emoji_text(key: Column, known: Iterable[str] = ()) -> Column:
    """The emoji of a number of 16 hexadecimal digits."""
    held: list[EmojiReader] = []
    sequences = tuple(known)

    def read(value: str | None) -> str | None:
        if not held:
            held.append(EmojiReader(sequences))
        return held[0](int(value, 16)) if value else None

    return mapped(read, T.StringType())(key)
