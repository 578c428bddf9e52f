"""Secret scans, token counts and media columns."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import documents, empty, texts
from tidewell.llm import media, secret_scan, token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def base(text):
    pattern = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    found = [(m.start(), 0, m.end()) for m in re.finditer(pattern, text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found)]


PARTS = ["password", "TOKEN", "api_key", "apikey", "secret", '"', "'", " ", ":", "=", "abcdefgh1", "AKIA", "ABCDEFGHIJKL", "0123456789abcdef" * 2, "é", "\n", "x"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_base_spans(value):
    assert [str(s) for s in secret_scan.base_spans(value)] == base(value)


def test_scan(spark):
    found = secret_scan.scan(documents(spark), WORDS).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r["doc_id"] for r in documents(spark).collect())
    rows = {r["doc_id"]: r for r in found}
    assert len({tuple(r) for r in found}) == len(rows)
    for i, t in enumerate(texts()):
        wanted = base(t or "")
        r = rows[i]
        assert r["base_sha256"] == hashlib.sha256(",".join(wanted).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(w.startswith(k) for w in wanted) for k in ("assign:", "access:", "hex:")]
        assert [s for s in r["spans"].split(",") if s and not s.startswith("guess")] == wanted
    assert secret_scan.scan(empty(spark)).collect() == []


WORDS = secret_scan.ranked_words(public_tokenizers.path("word_bpe_49k.json"))


def guessed(text):
    return [text[s.start : s.end] for s in secret_scan.guessed_spans(text, secret_scan.base_spans(text), WORDS)]


@pytest.mark.parametrize(
    "weak",
    ["password1", "qwertyuiop", "2023-01-05", "aaaaaaaa1", "changeme123", "letmein2020", "mountain", "blue-river", "Thursday", "jane.miller@example.com", "12345"],
)
def test_weak_values_are_cheap(weak):
    assert secret_scan.least_guesses(weak, WORDS) < secret_scan.GUESSES
    assert guessed(f"my passphrase is {weak}, ok") == []


@pytest.mark.parametrize(
    "strong", ["hV9$kq2Lx!", "zX81-mmQpe-77aB", "tr0m#bo4ZZne", "qkzjxvwpytmbnd", "QKZJXVWPYTMBND", "x7#Kq2$%", "9f$Lk2mQ*", "mountain-river-cloud-lantern"]
)
def test_strong_values_are_spans(strong):
    """Whole, whatever their last characters, and by cost alone, letters of one case too."""
    for text in (f"é my passphrase is {strong}, ok", f"the passphrase was {strong}. And", f"passphrase: {strong}"):
        (span,) = secret_scan.guessed_spans(text, secret_scan.base_spans(text), WORDS)
        assert text[span.start : span.end] == strong and str(span).startswith("guess:")


def test_phrases_cost_as_words():
    words = ["mountain", "river", "cloud"]
    by_words = sum(np.log10(WORDS.ranks[w] + 1) + 0.3 for w in words) + 2 * secret_scan.brute("-")
    assert abs(secret_scan.least_guesses("-".join(words), WORDS) - by_words) < 1e-9
    assert len(WORDS.ranks) > 10_000


def alternatives(value):
    """The least guesses over all ways to cut, each cheap segment told anew."""
    cheap = {}
    for a, b, cost in secret_scan.segments(value, WORDS):
        cheap[a, b] = min(cost, cheap.get((a, b), cost))
    ways = [[0.0]] + [[] for _ in value]
    for k in range(1, len(value) + 1):
        ways[k] = [min(ways[k - 1]) + secret_scan.brute(value[k - 1])]
        ways[k] += [min(ways[a]) + cost + 0.3 for (a, b), cost in cheap.items() if b == k]
    return min(ways[-1])


FILL = st.sampled_from(["", "so it goes. ", "é\n", "a line; ", "(see) "])
NAME = st.sampled_from(["password", "my_secret", "DB_PASS", "api key", "PIN", "tokens", "loginName", "pwd2"])
LINK = st.sampled_from([": ", "=", " is ", " was: ", " => ", " := "])
SECRET = st.text(alphabet="abkqzxAKQ0279#$%&*!-_@+", min_size=1, max_size=14) | st.sampled_from(["everything", "required", "2021-03-04", "winter"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(FILL, NAME, LINK, SECRET, st.sampled_from([", ", "; ", ". Then ", "\n", ")"])), max_size=4))
def test_spans_by_construction(parts):
    """Texts put together from contexts and values: a value is a span if all ways to cut it take many guesses and no base span meets it."""
    text, values = "", []
    for fill, name, link, value, after in parts:
        text += fill + name + link
        values.append((len(text), value))
        text += value + after
    base = secret_scan.base_spans(text)
    wanted = []
    for at, value in values:
        end = at + len(value)
        if alternatives(value) >= secret_scan.GUESSES and not any(s.start < end and at < s.end for s in base):
            wanted.append((at, end))
    assert [(s.start, s.end) for s in secret_scan.guessed_spans(text, base, WORDS)] == wanted


def test_planted_credentials():
    """Random credentials of several forms, and values that are none, in prose: precision and recall."""
    r = random.Random(11)
    listed = [w for w, k in WORDS.ranks.items() if w.isascii() and 200 < k < 8000 and len(w) > 3]
    letters, signs = "abcdefghijklmnopqrstuvwxyz", "!#$%&*+?@^~"
    forms = [
        lambda: "".join(r.choice(letters + letters.upper() + "0123456789" + signs) for _ in range(r.randint(9, 20))),
        lambda: "".join(r.choice(letters) for _ in range(r.randint(9, 16))),
        lambda: "-".join(r.choice(listed) for _ in range(4)),
        lambda: "".join(r.choice(letters.upper() + "234567") for _ in range(16)),
    ]
    plain = [
        lambda: r.choice(listed), lambda: r.choice(listed).capitalize(), lambda: f"{r.randint(1970, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}",
        lambda: r.choice(listed) + str(r.randint(0, 99)), lambda: "*" * r.randint(4, 12), lambda: f"{r.choice(listed)}@example.com",
    ]
    told = Counter()
    for i in range(2000):
        secret = i % 2 == 0
        value = r.choice(forms if secret else plain)()
        text = f"{r.choice(listed)} {r.choice(['passphrase', 'my pin', 'DB_PWD', 'login'])}{r.choice([': ', ' is ', ' = '])}{value} {r.choice(listed)}"
        told[secret, guessed(text) == [value]] += 1
    recall, precision = told[True, True] / 1000, told[True, True] / (told[True, True] + told[False, True])
    assert recall > 0.98 and precision > 0.98, told


def test_many_contexts_take_time_in_proportion():
    began = time.perf_counter()
    secret_scan.guessed_spans("password:" * 120_000, [], WORDS)
    secret_scan.guessed_spans("token=" + "abcdefg1" * 40_000 + " passphrase: " + "x" * 300_000 + "@", [secret_scan.Span(0, 0, 320_006)], WORDS)
    spans = secret_scan.guessed_spans("passphrase: zX9$kq2Lm! " * 20_000, [secret_scan.Span(k, 2, k + 1) for k in range(0, 400_000, 23)], WORDS)
    assert len(spans) == 20_000 and time.perf_counter() - began < 40


def test_values_in_the_run_of_a_base_span():
    text = "token=abcdefgh1!pwd=zX9$kq2Lm!"
    assert guessed(text) == ["zX9$kq2Lm!"]


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("DB_PASSWORD='p@9sW0r!d9x'", "p@9sW0r!d9x"), ("my_secret: k#93jQx!2Lw", "k#93jQx!2Lw"), ("dbpass = z@7Kq2!pW9", "z@7Kq2!pW9"),
        ("AWS_SECRET_ACCESS_KEY = q9$kLm2!zR7", "q9$kLm2!zR7"), ("DB_PASS=z@7Kq2!pW9", "z@7Kq2!pW9"), ("passwordOld2: z@7Kq2!pW9", "z@7Kq2!pW9"),
        ("the password is: Xy7$kk!2Qp", "Xy7$kk!2Qp"), ("Authorization: Bearer a$8Kq2!zPmW9", "a$8Kq2!zPmW9"), ("bearer a$8Kq2!zPmW9", "a$8Kq2!zPmW9"),
        ("passphrase: qzxkvjwpmtrbn", "qzxkvjwpmtrbn"), ("password = token = z@7Kq2!pW9", "z@7Kq2!pW9"),
    ],
)
def test_contexts(text, value):
    spans = secret_scan.guessed_spans(text, [], WORDS)
    assert [text[s.start : s.end] for s in spans] == [value]


@pytest.mark.parametrize(
    "text",
    [
        "the secret is everything", "my password is Important.", "login: administrator", "token was required", "password isolation", "passwords: forgotten",
        "token isolatedX9k2#q", "login is john.smith@example.com",
    ],
)
def test_plain_words_are_no_secrets(text):
    assert guessed(text) == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc1q w-Z!", max_size=12))
def test_cheapest_segmentation(value):
    """The dynamic programme against all ways to cut."""
    cheap = secret_scan.segments(value)

    def least(k):
        if not k:
            return 0.0
        cuts = [least(k - 1) + secret_scan.brute(value[k - 1])]
        return min(cuts + [least(a) + c + 0.3 for a, b, c in cheap if b == k])

    assert abs(least(len(value)) - secret_scan.least_guesses(value)) < 1e-9


ALPHABET = st.sampled_from(["a", "the", " ", "  ", "\n", "\t", "é", "日", "😀", "<s>", "tion", "er", ".", ",", "'", "▁", "\x00", "\u3000"])


@settings(max_examples=400, deadline=None)
@given(st.text() | st.lists(ALPHABET, max_size=14).map("".join))
def test_token_counts_are_the_librarys(value):
    counter = _counter()
    assert counter.count(value) == len(counter.model.encode(value))


def _counter(held=[]):  # noqa: B006
    if not held:
        held.append(token_counts.TokenCounter(PIECES, (" the\n a", bytes([1, 1]))))
    return held[0]


def test_full_caches_start_anew(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_SIZE", 5)
    counter = token_counts.TokenCounter(PIECES, ("", b""))
    for t in texts():
        assert counter.count(t or "") == (len(counter.model.encode(t)) if t else 0)


def test_frequent_words_are_of_the_whole_table(spark):
    rows = [(i, f"so {'alpha' if i < 300 else 'gamma'} goes" + " on" * 5000 * (i % 3 == 0)) for i in range(600)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 6), "doc_id long, text string")
    words = token_counts.frequent(docs, PIECES, 60)[0].split("\n")
    assert {" alpha", " gamma", " on"} <= set(words)
    same = spark.createDataFrame([(1, "the same words")] * 500, "doc_id long, text string")
    assert " same" in token_counts.frequent(same, PIECES, 500)[0].split("\n")


def test_count_rows(spark):
    model = token_counts.coder(PIECES)
    rows = {r["doc_id"]: r for r in token_counts.token_counts(documents(spark), PIECES, 100).collect()}
    for i, t in enumerate(texts()):
        n = len(model.encode(t or ""))
        assert tuple(rows[i]) == (i, len((t or "").encode()), n, n > 100)
    assert token_counts.token_counts(empty(spark), PIECES).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=3000))
def test_media_round_trip(payload):
    assert media.read(media.store(payload))[0] == payload


def test_a_plain_decoder_reads_the_frames():
    """Bit by bit, by the tables in the file, with nothing of the store's own reader."""
    data = bytes(i * 7 % 256 for i in range(media.PER_FRAME))
    jpeg = media.frame(data)
    at, tables = 2, {}
    while True:
        marker, size = jpeg[at + 1], int.from_bytes(jpeg[at + 2 : at + 4], "big")
        body = jpeg[at + 4 : at + 2 + size]
        if marker == 0xC4:
            code, symbols, used = 0, {}, 17
            for bits in range(1, 17):
                for _ in range(body[bits]):
                    symbols[f"{code:0{bits}b}"] = body[used]
                    code, used = code + 1, used + 1
                code <<= 1
            tables[body[0]] = symbols
        at += 2 + size
        if marker == 0xDA:
            break
    bits = "".join(f"{b:08b}" for b in jpeg[at:-2].replace(b"\xff\0", b"\xff"))
    place, found = 0, bytearray()

    def symbol(table):
        nonlocal place
        code = ""
        while code not in tables[table]:
            code += bits[place]
            place += 1
        return tables[table][code]

    for _ in range(media.ACROSS * media.DOWN):
        assert symbol(0x00) == 0
        for _ in range(63):
            assert symbol(0x10) == 0x08
            value = int(bits[place : place + 8], 2)
            place += 8
            assert value - 255 * (value < 128) != 0
            found.append(value)
    assert bytes(found) == data and place == len(bits)


def test_changed_media_are_refused():
    stored = bytearray(media.store(b"x" * 192))
    stored[stored.index(b"00dc") + 1] ^= 1
    with pytest.raises(ValueError):
        media.parse(bytes(stored))


def test_inverse_transform():
    assert np.allclose(media.INVERSE @ media.INVERSE.T, np.eye(64), atol=1e-5)
    assert list(media.ZIGZAG[:6]) == [0, 1, 8, 16, 9, 2] and media.ZIGZAG[63] == 63


def test_shots():
    dark, light = np.zeros((12, 63), np.uint8), np.full((12, 63), 250, np.uint8)
    found = media.clips([dark] * 10 + [light] * 5, 40_000)
    assert [(c.start_ms, c.end_ms, c.frames) for c in found] == [(0, 400, 10), (400, 600, 5)]


def test_media_rows(spark):
    stored = media.encode(documents(spark))
    rows = {r["doc_id"]: r for r in media.digests(stored).collect()}
    files = {r["doc_id"]: r["media"] for r in stored.collect()}
    for i, t in enumerate(texts()):
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])
        assert (r["media_bytes"], r["media_sha256"]) == (len(files[i]), hashlib.sha256(files[i]).hexdigest())
    assert tuple(rows[6])[1:] == tuple(rows[7])[1:]
    clips = media.clip_rows(stored).where("doc_id = 6").orderBy("clip").collect()
    assert media.feature([media.Clip(*tuple(c)[2:]) for c in clips]) == rows[6]["feature"]
    assert media.digests(media.encode(empty(spark))).collect() == []
