"""Functions on fixed values: codecs, content blocks, ids, signatures, envelopes."""

from __future__ import annotations

import hashlib
import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.functions import codecs, content, crypto, points, tags, text

HASH_INVOICE = (
    "lnbc12n1pjctuljsp57l6za0xry37prkrz7vuv4324ljnssm8ukr2vrf6qvvrgclsmpyhspp5xqfuk89duzjlt2yg56ym7p3enrfxxltyfpc364qc8nsu3kznkl8s"
    "hp5eugmd894yph7wq68u09gke5x2hmn7mg3zrwd06fs57gmcrjm0uxsxqyjw5qcqpjrzjqd7yw3w4kvhx8uvcj7qusfw4uqre3j56zjz9t07nd2u55yuya3awsrqdlcq"
    "qdzcqqqqqqqqqqqqqqzqqyg9qxpqysgqwm2tsc448ellvf5xem2c95hfvc07lakph9r8hffh704uxqhs22r9s4ly0jel48zv6f7fy8zjkgmjt5h2l4jc9gyj4av42s40qv"
    "ve2ysqwuega8"
)


def test_invoices():
    found = codecs.decode_invoice(HASH_INVOICE)
    assert (found["amount_msat"], found["expiry"], found["description"]) == (1200, 604800, None)
    assert len(found["description_hash"]) == 64
    assert codecs.decode_invoice("lightning:" + HASH_INVOICE) == found
    assert codecs.decode_invoice(HASH_INVOICE[:-1] + "q") is None
    assert codecs.decode_invoice(None) is None


def test_emoji_number():
    assert codecs.emoji_number("👩🏻‍🤝‍👩🏿") == 0x07D1A7747240B0D0


def test_emoji_are_read_back():
    read = codecs.EmojiReader(["👩‍🤝‍👩", "🏴‍☠️"])
    for emoji in ("👩🏻‍🤝‍👩🏿", "🏴‍☠️", "🇺🇸", "1️⃣", "#⃣", "🏴󠁧󠁢󠁥󠁮󠁧󠁿", "👍🏽", "🤙", "+"):
        assert read(codecs.emoji_number(emoji)) == emoji
    assert read(codecs.emoji_number("👨‍👩‍👧")) is None and read(None) is None


@given(st.sampled_from(["", "1m", "7u", "30n", "20p"]), st.integers(0, 2**35 - 1), st.text(max_size=40), st.integers(0, 2**35 - 1))
def test_invoices_round_trip(amount, timestamp, description, expiry):
    found = codecs.decode_invoice(codecs.encode_invoice(amount, timestamp, description, expiry))
    msats = {"": None, "1m": 100_000_000, "7u": 700_000, "30n": 3000, "20p": 2}[amount]
    assert (found["amount_msat"], found["timestamp"], found["description"], found["expiry"]) == (msats, timestamp, description, expiry)


def test_checksums_and_regrouping():
    def bit_by_bit(values: list[int]) -> int:
        c = 1
        for v in values:
            top, c = c >> 25, (c & 0x1FFFFFF) << 5 ^ v
            for i, g in enumerate(codecs.GENERATOR):
                c ^= g if top >> i & 1 else 0
        return c

    # Texts of any length, also beyond what is summed at once, and prefixes of any characters.
    for n in (0, 1, 6, 52, 1017, 1018, 1019, 2036, 2037, 5000):
        digits = bytes((i * i + n) % 32 for i in range(n))
        for prefix in ("npub", "a1", "\u6f22"):
            assert codecs.checksum(prefix, digits) == (bit_by_bit(codecs.expanded(prefix) + list(digits)) if n else codecs.checksum_of_prefix(prefix))
        raw = digits.hex().encode()
        assert codecs.as_bytes(codecs.as_digits(raw)) == raw
        assert codecs.bech32_decode(codecs.bech32_encode("npub", raw)) == ("npub", codecs.as_digits(raw))
    # Five zeros over, bits that aren't zero over, and three zeros over.
    assert [codecs.as_bytes(d) for d in (b"\0", bytes([1, 1]), bytes([1, 4]), b"")] == [None, None, b"\x09", b""]
    name = codecs.bech32_encode("npub", bytes(32))
    assert all(codecs.bech32_decode(t) is None for t in (name[:-1] + "é", name.replace("qq", "qb", 1), name[:9] + name[9:].upper()))


def test_blocks_by_columns():
    npub, invoice = codecs.bech32_encode("npub", bytes(32)), codecs.encode_invoice("25u", 1, "é")
    told = [None, "", "plain", f"#é @{npub} https://a.b/c #[3] {invoice} nostr:{npub}", "#x"]
    wanted = [content.parse(t) for t in told]
    assert content.blocks_of(told, frozenset()).to_pylist() == wanted and content.blocks_of([], frozenset()).to_pylist() == []


@given(st.integers(1, crypto.N - 1))
def test_multiples_of_points(k):
    assert crypto.affine(crypto.times_generator(k)) == crypto.affine(crypto.times(k, crypto.G))
    assert crypto.affine(crypto.add(crypto.times(k, crypto.G), crypto.times(crypto.N - k, crypto.G))) is None


@given(st.binary(min_size=32, max_size=32))
def test_entities_round_trip(key):
    assert codecs.entity(codecs.bech32_encode("npub", key))["pubkey"] == key.hex()
    told = codecs.bech32_encode("nevent", b"\0\x20" + key + b"\1\3abc\2\x20" + key)
    found = codecs.entity(told)
    assert (found["id"], found["relays"], found["pubkey"]) == (key.hex(), ["abc"], key.hex())


@given(st.text())
def test_blocks_cover_the_content(value):
    end = 0
    for b in content.parse(value):
        assert b["start"] >= end and value[b["start"] : b["start"] + b["len"]] == b["text"]
        end = b["start"] + b["len"]


@pytest.mark.parametrize(
    ("value", "wanted"),
    [
        ("http://a,http://b", ["url:http://a", "text:,", "url:http://b"]),
        ("(https://x.y/z)", ["text:(", "url:https://x.y/z", "text:)"]),
        ("see https://a.com/p.", ["text:see ", "url:https://a.com/p", "text:."]),
        ("xhttp://a", ["text:xhttp://a"]),
        ("a#tag-b #[12]", ["text:a", "hashtag:tag", "text:-b ", "mention_index:#[12]"]),
        ("## #", ["text:## #"]),
        ("lnbcxx", ["text:lnbcxx"]),
        ("", []),
    ],
)
def test_blocks(value, wanted):
    assert [f"{b['type']}:{b['text']}" for b in content.parse(value)] == wanted


def test_mentions():
    name = codecs.bech32_encode("npub", bytes(range(32)))
    for told in (name, "@" + name, "nostr:" + name):
        assert [b["type"] for b in content.parse(f"hi {told}!")] == ["text", "mention_bech32", "text"]
    link = f"https://h.example/{name}"
    assert content.parse(link)[0]["type"] == "url"
    assert content.parse(link, frozenset(["h.example"]))[0]["type"] == "mention_bech32"


def test_signatures():
    key = (3).to_bytes(32, "big")
    assert crypto.public_key(key).hex() == "f9308a019258c31049344f85f89d5229b531c845836f99b08601f113bce036f9"
    sig = crypto.sign(key, bytes(32), bytes(32))
    assert sig.hex().startswith("e907831f80848d1069a5371b402410364bdf1c5f8307b0084c55f1ce2dca8215")
    assert crypto.verify(crypto.public_key(key), bytes(32), sig)
    assert not crypto.verify(crypto.public_key(key), bytes([1]) + bytes(31), sig)


def test_signatures_of_many(spark):
    (key, author), (_, rare) = (crypto.new_key() for _ in range(2))
    ids = [hashlib.sha256(bytes([i])).digest() for i in range(100)]
    sigs = points.sign_each(key, ids, bytes(32))
    assert sigs == [crypto.sign(key, i, bytes(32)) for i in ids]
    rows = [(author, i, s) for i, s in zip(ids, sigs, strict=True)]
    rows[3] = (author, ids[4], sigs[3])
    rows[5] = (author, ids[5], sigs[5][:32] + crypto.N.to_bytes(32, "big"))
    rows[6] = (author, ids[6], crypto.P.to_bytes(32, "big") + sigs[6][32:])
    rows[7], rows[8], rows[9] = None, (author, ids[8], sigs[8][:63]), (rare, ids[9], sigs[9])
    # Half of all x have no point; the other half are some author's.
    rows += [(bytes(31) + b"\5", ids[0], sigs[0])] * 40 + [(b"\xff" * 32, ids[0], sigs[0])] * 40
    wanted = [bool(r) and crypto.verify(*r) for r in rows]
    assert points.verify_each(rows) == wanted and sum(wanted) == 94
    told = [tuple(v.hex() for v in r) if r else (None, None, "xyz") for r in rows]
    told = spark.createDataFrame([(n, *r) for n, r in enumerate(told)], "n int, p string, i string, s string").coalesce(1)
    got = told.select("n", crypto.verified(F.col("p"), F.col("i"), F.col("s")).alias("v")).collect()
    assert [r["v"] for r in sorted(got)] == wanted


def test_sums_of_the_curve():
    # Numbers of the field at its ends, and numbers of which the sum is infinity or nothing is left of a table.
    values = [0, 1, crypto.P - 1, 2**256 - 2**32 - 978, 2**255, 977, 2**32]
    assert points.ints(points.mul(points.limbs(values), points.limbs(values[::-1]))) == [a * b % crypto.P for a, b in zip(values, values[::-1], strict=True)]
    numbers = [0, 1, 2, 5, crypto.N - 1, crypto.N - 5, 2**255]
    two = points.Table(crypto.affine(crypto.double((*crypto.G, 1))), 4)
    found = points.sums([points.generator_table(), two], [numbers, [0, 0, 1, 2, 0, 5, (crypto.N - 2**255) * pow(2, -1, crypto.N) % crypto.N]])
    wanted = [0, 1, 4, 9, crypto.N - 1, 5, 0]
    assert [p and tuple(p) for p in found] == [crypto.affine(crypto.times_generator(k)) for k in wanted]


def test_sealed_payloads():
    key = crypto.conversation_key((1).to_bytes(32, "big"), crypto.public_key((2).to_bytes(32, "big")))
    assert key.hex() == "c41c775356fd92eadc63ff5a0dc1da211b268cbea22316767095b2871ea1412d"
    told = crypto.encrypt(key, b"a", (1).to_bytes(32, "big"))
    assert told.startswith("AgAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAABee0G5VSK0/9YypIObAtDKfYEAjD35uVkHyB0F4DwrcNaCXlC")
    assert crypto.decrypt(key, told) == b"a"
    for n in (1, 31, 32, 33, 255, 256, 257, 5000):
        assert crypto.decrypt(key, crypto.encrypt(key, b"x" * n)) == b"x" * n
    with pytest.raises(ValueError):
        crypto.decrypt(key, told[:-4] + "AAA=")


def test_payloads_are_sealed_and_opened_together():
    texts = [b"x" * n for n in (1, 32, 33, 65, 5000, 65535)]
    keys, nonces = [bytes([i]) * 32 for i in range(len(texts))], [bytes([7, i]) * 16 for i in range(len(texts))]
    told = crypto.encrypt_each(keys, texts, nonces)
    assert told == [crypto.encrypt(*one) for one in zip(keys, texts, nonces, strict=True)]
    assert crypto.decrypt_each(keys, told) == texts
    wrong = [told[0][:-4] + "AAA=", told[1], None, "é", told[4], told[5]]
    assert crypto.decrypt_each([*keys[:5], None], wrong) == [None, texts[1], None, None, texts[4], None]
    # The stream of the cipher for a key of 0 to 31, by the standard that defines it, in two blocks.
    stream = crypto.chacha20(bytes(range(32)), bytes.fromhex("000000000000004a00000000"), bytes(128))[64:]
    assert stream.hex().startswith("224f51f3401bd9e12fde276fb8631ded8c131f823d2c06e27e4fcaec9ef3cf78")


def sealed(author: bytes, to: bytes, note: dict) -> dict:
    seal = {"pubkey": crypto.public_key(author).hex(), "created_at": 6, "kind": 13, "tags": []}
    seal["content"] = crypto.encrypt(crypto.conversation_key(author, to), json.dumps(note).encode())
    seal["id"] = crypto.commitment(seal).hex()
    return seal | {"sig": crypto.sign(author, bytes.fromhex(seal["id"])).hex()}


def test_envelopes(spark):
    (a, _), (b, to), (w, wrap), (team, team_pub) = (crypto.new_key() for _ in range(4))
    note = {"created_at": 5, "kind": 14, "tags": [["p", "x"]], "content": "hé"}
    outer, own_key, _ = crypto.private_keys(b)
    gift = crypto.encrypt(crypto.conversation_key(w, to), json.dumps(sealed(a, to, note)).encode())
    in_team = crypto.encrypt(crypto.team_keys(team)[1], json.dumps(sealed(a, team_pub, note)).encode())
    inner = {"created_at": 7, "kind": 1059, "tags": [], "content": gift, "pubkey": wrap.hex()}
    rows = [
        ("01" * 32, 1059, wrap.hex(), gift), ("02" * 32, 1081, team_pub.hex(), in_team),
        ("03" * 32, 1080, outer.hex(), crypto.encrypt(own_key, json.dumps(inner).encode())),
        ("04" * 32, 1059, wrap.hex(), gift[:-4] + "AAA="), ("05" * 32, 1, wrap.hex(), "x"),
    ]
    notes = spark.createDataFrame(rows, "id string, kind long, pubkey string, content string")
    found = crypto.unwrapped(notes, crypto.Keys((a, b), (team,))).collect()
    assert sorted((r["envelope_id"][:2], r["kind"]) for r in found if r["envelope_id"][2:4] == r["envelope_id"][:2]) == [("01", 14), ("02", 14), ("03", 1059)]
    assert sum(r["content"] == "hé" and r["pubkey"] == crypto.public_key(a).hex() for r in found) == 3
    assert all(r["flags"] == 2 and r["sig"][64:] == r["envelope_id"] for r in found)


def test_envelopes_are_opened_in_one_pass(spark):
    """Each envelope is opened once: the rounds are no branches of the plan that begin anew."""
    (a, _), (b, _) = crypto.new_key(), crypto.new_key()
    outer, key, own = crypto.private_keys(a)
    other, other_key, _ = crypto.private_keys(b)
    told = json.dumps({"created_at": 1, "kind": 1, "tags": [], "content": "deep"})
    for i in range(4):
        told = json.dumps({"created_at": i, "kind": 1080, "tags": [], "content": crypto.encrypt(key, told.encode()), "pubkey": outer.hex()})
    rows = [("01" * 32, 1080, outer.hex(), crypto.encrypt(key, told.encode())), ("02" * 32, 1080, other.hex(), crypto.encrypt(other_key, told.encode()))]
    rows += [("03" * 32, 1059, None, "x"), ("04" * 32, 1080, outer.hex(), None), ("05" * 32, 1080, outer.hex(), crypto.encrypt(key, b"[1]"))]
    notes = spark.createDataFrame(rows, "id string, kind long, pubkey string, content string")
    found = crypto.unwrapped(notes, crypto.Keys((a,)))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert [(r["created_at"], r["kind"]) for r in found.collect()] == [(3, 1080), (2, 1080), (1, 1080)]
    deepest = crypto.unwrapped(notes, crypto.Keys((a, b)), depth=9).collect()
    assert sorted(r["content"] for r in deepest if r["kind"] == 1) == ["deep", "deep"] and len(deepest) == 10


def test_tags(spark):
    one, two, three = ("1" * 64, "2" * 64, "3" * 64)
    rows = [
        ([["e", one], ["e", two, "", "x"], ["p", three]],), ([["e", one]],), ([["e", "short"], ["q", three]],), ([],),
        ([["e", one, "", "root"], ["e", two, "", "mention"], ["e", three, "", "reply"]],),
    ]
    t = F.col("tags")
    df = spark.createDataFrame(rows, "tags array<array<string>>")
    got = df.select(tags.reply_target(t), tags.root(t), tags.last_id(t, "e"), tags.first_id(t, "q"), tags.reply_target(t, markers=True)).collect()
    assert [tuple(r) for r in got] == [
        (two, one, two, None, None), (one, one, one, None, one), (None, None, None, three, None), (None, None, None, None, None),
        (two, one, three, None, three),
    ]


def test_reactions_and_words(spark):
    df = spark.createDataFrame([("+",), ("hello",), ("hello world",), ("👩🏻‍🤝‍👩🏿",), ("",), ("🤙",), ("🇺🇸",), ("1️⃣",), ("🏴󠁧󠁢󠁥󠁮󠁧󠁿",), ("🇺🇸🇺🇸",), ("🤙🤙",)], "c string")
    assert [r[0] for r in df.select(text.reaction(F.col("c"))).collect()] == ["+", "hello", "+", "👩🏻‍🤝‍👩🏿", "", "🤙", "🇺🇸", "1️⃣", "🏴󠁧󠁢󠁥󠁮󠁧󠁿", "+", "+"]
    df = spark.createDataFrame([("hello world",), (" a  b",), ("",)], "c string")
    assert [r[0] for r in df.select(text.word_count(F.col("c"))).collect()] == [1, 2, 0]
    df = spark.createDataFrame([("It’s A_b, ÉTÉ—x",)], "c string")
    assert df.select(text.words(F.col("c"))).first()[0] == ["it", "s", "a_b", "ÉtÉ", "x"]
