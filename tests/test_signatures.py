"""Signatures of whole contents: long mail heads, random and nearly random bytes."""

import random

from artifactlake.functions.classify import content_signature


def test_long_heads_and_random_bytes(spark):
    draw = random.Random(3)
    noise = draw.randbytes(5000)
    head = "Received: " + "x" * 3000 + "\nFrom: a@b\nSubject: c"
    rows = [
        ("mail", (head + "\n\nbody").encode()),
        ("crlf", (head.replace("\n", "\r\n") + "\r\n\r\nbody").encode()),
        ("text", b"hello\n\nfrom: x\nsubject: y"),
        ("random", b"\x01" + noise),
        ("narrow", bytes(1 + x % 150 for x in noise).replace(b"\x08", b"\x09") + b"\xff\x01"),
        ("empty", b""),
    ]
    df = spark.createDataFrame([(n, bytearray(b)) for n, b in rows], "name string, b binary")
    got = {r.name: r.signature.signature for r in content_signature(df, "b", "name").collect()}
    assert got == {"mail": "email", "crlf": "email", "text": "text", "random": "random", "narrow": "unknown", "empty": "empty"}
