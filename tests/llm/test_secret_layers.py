"""Secrets behind orders and shapes of layers that a single pass over clean base64 would miss."""

from __future__ import annotations

import base64
import bz2
import gzip
import json
import random
import zlib
from urllib.parse import quote, quote_plus

import pytest
import zstandard

from daybook.llm import secrets

INNER = b"secret = abcdefghij"


def found(wrapped: str, before: str = "q ", after: str = " z") -> bool:
    spans = secrets.find(before + wrapped + after)[1]
    return any(k == 0 and a < len(before + wrapped) and b > len(before) for a, k, b in spans)


@pytest.mark.parametrize("pack", [bytes, zlib.compress, gzip.compress, bz2.compress, zstandard.compress])
def test_base64_of_both_alphabets_behind_anything_and_wrapped(pack):
    rng = random.Random(5)
    for _ in range(60):
        payload = pack(bytes(rng.randint(33, 126) for _ in range(rng.randint(0, 90))) + b" " + INNER + b" >?>?~~")
        for encode in (base64.urlsafe_b64encode, base64.b64encode, base64.encodebytes):
            wrapped = encode(payload).decode().strip()
            for before in ("q ", "https://x.y/", "id_", "a/b-c+"):
                assert found(wrapped, before), (before, wrapped)
                assert "abcdefghij" not in secrets.mask(before + wrapped)


def test_span_of_a_payload_behind_a_path():
    b64 = base64.b64encode(INNER).decode()
    assert secrets.find(f"go x/{b64} z")[1] == [(5, 0, 5 + len(b64))]


ESCAPES = {
    "url": quote,
    "form": quote_plus,
    "every byte": lambda b: "".join(f"%{x:02X}" for x in b),
    "hex": lambda b: "".join(f"\\x{x:02x}" for x in b),
    "unicode": lambda b: "".join(f"\\u{x:04x}" for x in b),
    "python": lambda b: repr(b)[2:-1],
    "json": lambda b: json.dumps(b.decode("latin-1")),
    "url of base64": lambda b: quote(base64.b64encode(b).decode(), safe=""),
}


@pytest.mark.parametrize("escape", ESCAPES)
@pytest.mark.parametrize("pack", [zlib.compress, gzip.compress, bz2.compress, zstandard.compress])
def test_compressed_bytes_under_escapes(escape, pack):
    rng = random.Random(6)
    for _ in range(20):
        payload = pack(bytes(rng.randint(33, 126) for _ in range(rng.randint(0, 60))) + b" " + INNER)
        assert found(ESCAPES[escape](payload)), payload


@pytest.mark.parametrize("pack", [zlib.compress, gzip.compress, bz2.compress, zstandard.compress])
def test_every_member_is_read(pack):
    payload = pack(b"first") + pack(b"second secr") + pack(b"et = abcdefghij") + pack(b"last")
    assert found(base64.b64encode(payload).decode())


def test_text_of_any_encoding_is_scanned():
    text = INNER.decode()
    for raw in (("é " * 9 + text).encode("latin-1"), text.encode("utf-16"), text.encode("utf-16-be"), text.encode("utf-32"), b"\1\2\3\4" * 9 + INNER + b"\0" * 9):
        assert found(base64.b64encode(raw).decode()) and found(base64.b64encode(gzip.compress(raw)).decode()), raw


def test_a_payload_that_unpacks_to_more_than_64_mb_is_read_whole():
    secret = b"\n".join([b"  " * (35 << 20), INNER])
    for pack in (zlib.compress, zstandard.compress):
        assert found(base64.b64encode(pack(secret)).decode())
