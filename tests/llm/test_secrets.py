"""Secret scans against a plain version of the base patterns, and made-up keys, digests and identifiers."""

import base64
import hashlib
import random
import string
import time
import uuid

import public_tokenizers
import pyarrow.parquet as pq
import pytest

from panelwise.llm import queries, secrets

NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
VALUE = set(string.ascii_letters + string.digits + "+/_.=-")


@pytest.fixture(scope="module")
def encoding():
    with open(queries.RANKS, "rb") as f:
        return secrets.vocabulary(f.read(), public_tokenizers.PATTERN)


def plain(text):
    """Base spans by looking at one character after the other."""
    out, i = [], 0
    low = "".join(c.lower() if c.isascii() else c for c in text)

    def stretch(at, allowed):
        end = at
        while end < len(text) and text[end] in allowed:
            end += 1
        return end

    while i < len(text):
        end = None
        for name in NAMES:
            if low.startswith(name, i):
                for quote in (1, 0):
                    at = i + len(name)
                    if quote and text[at : at + 1] not in ('"', "'"):
                        continue
                    at = stretch(at + quote if quote else at, " ")
                    if text[at : at + 1] not in (":", "="):
                        continue
                    at = stretch(at + 1, " ")
                    at += text[at : at + 1] in ('"', "'") and at < len(text)
                    stop = stretch(at, VALUE)
                    if stop > at:
                        end = stop
                        if stop - at >= 6:
                            out.append((i, 0, stop))
                        break
                if end:
                    break
        i = end or i + 1
    for kind, begin, allowed, least in ((1, "AKIA", set(string.ascii_uppercase + string.digits), 20), (2, "", set("0123456789abcdef"), 24)):
        i = 0
        while i < len(text):
            stop = stretch(i + len(begin), allowed) if text.startswith(begin, i) else i
            if stop > i + len(begin):
                if stop - i >= least:
                    out.append((i, kind, stop))
                i = stop
            else:
                i += 1
    return sorted(out)


def test_base_spans_equal_plain_version(sf):
    texts = pq.read_table(f"{sf}/documents.parquet", columns=["text"]).column("text").to_pylist()
    r = random.Random(3)
    parts = ["password", "PASSWD", "Secret", "token", "api_key", "ApiKey", "api", "_key", '"', "'", " ", "  ", ":", "=", "AKIA", "ABCD1234", "abcdef01", "0123456789ab", "xyz", "é", "ſecret", "toKen", ".", "-", "\n"]
    texts += ["".join(r.choice(parts) for _ in range(r.randint(1, 40))) for _ in range(4000)]
    found = 0
    for t in texts:
        assert secrets.base_spans(t or "") == plain(t or ""), t
        found += len(plain(t or ""))
    assert found > 1000


def random_string(r, alphabet, n):
    return "".join(r.choice(alphabet) for _ in range(n))


@pytest.mark.parametrize("alphabet, least", [
    (string.ascii_letters + string.digits, 0.97),
    (string.ascii_lowercase + string.digits, 0.97),
    (string.ascii_uppercase + string.digits, 0.97),
    (string.ascii_letters + string.digits + "-_", 0.85),
    (string.ascii_letters, 0.9),
])
def test_random_strings_are_found(encoding, alphabet, least):
    r = random.Random(len(alphabet))
    found = 0
    for i in range(600):
        key = r.choice(string.ascii_letters) + random_string(r, alphabet, r.randint(19, 60)) + "x"
        text = f"le mot {key}, et puis"
        base, added = secrets.find(encoding, text)
        found += any(a <= 10 and b >= 5 + len(key) for a, _, b in base + added)
    assert found / 600 >= least


def test_digests_identifiers_and_words_are_not_added(encoding):
    r = random.Random(5)
    clean = []
    for i in range(300):
        raw = random.Random(i).randbytes(64)
        clean += [hashlib.new(name, raw).hexdigest().upper() for name in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512")]
        clean += [f"sha256-{base64.b64encode(hashlib.sha256(raw).digest()).decode()}", f"sha512:{base64.b64encode(raw).decode()}"]
        clean += [f"data:image/png;base64,{base64.b64encode(raw * 30).decode()}", str(uuid.UUID(bytes=raw[:16]))]
        clean += [random_string(r, string.digits, r.randint(8, 40)), f"2021-03-{i % 28 + 1:02d}T12-30-{i % 60:02d}_{i}"]
    clean += """com.google.common.collect.ImmutableList getElementsByClassName HTTP_STATUS_INTERNAL_SERVER_ERROR
        my-component-name-v2 node_modules/lodash/index.js src/main/java/org/apache/spark/Foo.java x86_64-pc-linux-gnu
        IMG_20210304_123045 utf8mb4_unicode_ci iPhone12ProMax_128GB ISO-8859-1-windows v1.2.3-beta.4+build.567 en_US.UTF-8
        getX509CertV3Ext spark-sql_2.13-4.1.2.jar AWS_SECRET_ACCESS_KEY Donaudampfschiffahrtsgesellschaft ========================
        antidisestablishmentarianism Rindfleischetikettierungsgesetz anticonstitutionnellement otorrinolaringologico
        aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa 0123456789012345678901234567890 abababababababababababababab""".split()
    wrong = [t for t in clean if any(b - a for a, _, b in secrets.find(encoding, t)[1])]
    assert len(wrong) <= len(clean) * 0.002, wrong


def test_parts_of_a_signed_token_are_one_span(encoding):
    r = random.Random(2)
    alphabet = string.ascii_letters + string.digits
    parts = [random_string(r, alphabet, n) for n in (36, 80, 43)]
    text = "bearer " + ".".join(parts) + " ."
    assert secrets.find(encoding, text) == ([], [(7, 3, 7 + sum(map(len, parts)) + 2)])


def test_base_spans_stay_and_nothing_overlaps(encoding):
    r = random.Random(9)
    alphabet = string.ascii_letters + string.digits + "+/=_-. \"':"
    for _ in range(400):
        words = [random_string(r, alphabet, r.randint(1, 60)) for _ in range(6)] + ["token: ", "AKIA" + "A" * 18, "f" * 30]
        r.shuffle(words)
        text = "".join(words)
        base, added = secrets.find(encoding, text)
        assert base == plain(text)
        for a, _, b in added:
            assert all(b <= x or a >= y for x, _, y in base)


def test_long_texts_take_time_by_their_length(encoding):
    r = random.Random(4)
    blob = random_string(r, string.ascii_letters + string.digits, 1_000_000)
    for text in ("a" * 10**6, "ab1" * 400_000, "token=" * 200_000, blob, "password" + " " * 10**6, ("-" * 16 + "a") * 60_000):
        begun = time.perf_counter()
        secrets.find(encoding, text)
        assert time.perf_counter() - begun < 5
    assert secrets.find(encoding, blob)[1] == [(0, 3, len(blob))]


def test_rows_of_the_operator(spark):
    key = "Zx8Qw2Lr9Tv4Bn7Mk3Hp6"
    schema = "doc_id bigint, text string, spans string, n_hex int"
    docs = spark.createDataFrame(
        [(1, f"token = {key} and {key}", "s", 1), (1, None, None, None), (None, "", "s", 1), (2, "é AKIA" + "Q7" * 9, "s", 1)], schema
    )
    got = {(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.spans, r.n_random) for r in
           secrets.find_secrets(docs, queries.RANKS, public_tokenizers.PATTERN).collect()}
    assert got == {
        (1, 1, 0, 0, "assign:0:29,random:34:55", 1),
        (1, 0, 0, 0, "", 0),
        (None, 0, 0, 0, "", 0),
        (2, 0, 1, 0, "access:2:24", 0),
    }
    assert secrets.find_secrets(docs.limit(0), queries.RANKS, public_tokenizers.PATTERN).count() == 0
    empty = hashlib.sha256(b"").hexdigest()
    rows = secrets.find_secrets(docs, queries.RANKS, public_tokenizers.PATTERN).where("doc_id IS NULL").collect()
    assert [r.base_sha256 for r in rows] == [empty]


def test_only_planted_strings_of_the_table_are_added(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    for r in queries.QUERIES["op11_secrets"](spark, sf).collect():
        for kind, a, b in (s.split(":") for s in r.spans.split(",") if s):
            assert kind != "random" or not docs[r.doc_id][int(a) : int(b)].isalpha()
