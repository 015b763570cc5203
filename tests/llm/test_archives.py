"""WARC round trips and LZ fingerprints against plain Python."""

import base64
import hashlib
import random

import pytest

from pairedsense.llm import lzprint, warc
from pairedsense.session import shared_path
from .helpers import documents, odd_rows, words

PAGES = "page_id long, url string, html string, payload_digest string, n long"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", 1) for i, u, h in rows], PAGES)


def awkward():
    big = "<p>é</p>" * 20
    fake = "x" * 100 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabc"
    return [
        (5, "http://a/1", big), (3, "http://a/2", big), (9, None, big), (4, "u\r\nX: y", "tiny"), (6, "u", "tiny"), (7, "u", None), (8, "u", ""),
        (10, "u", fake), (11, "u", fake), (12, "u", "\r\n\r\n" * 40), (13, "u", "a" * 300_000), (None, "u", big), (5, "http://a/1", big),
    ]


def test_round_trip(spark):
    rows = awkward()
    got = warc.summary(warc.roundtrip(pages(spark, rows))).collect()
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        first = min(j for j, _, h in rows if j is not None and (h or "") == (html or ""))
        again = i is not None and len(raw) >= 100 and i > first
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_read_write_and_dedupe(spark):
    rows = [r for r in awkward() if r[0] is not None][:-1]
    plain, deduped = shared_path(spark, "plain"), shared_path(spark, "deduped")
    warc.write(pages(spark, rows), plain, min_bytes=10**9)
    records = warc.read(spark, plain)
    assert records.filter("record_type = 'response' and sound").count() == len(rows)
    warc.dedupe(spark, plain, deduped)
    again = warc.read(spark, deduped)
    assert again.filter("record_type = 'revisit'").count() == 3 and again.filter("not sound").count() == 0
    full = {r["page_id"]: r["html"] for r in warc.resolve(again).collect()}
    assert full == {i: h or "" for i, _, h in rows}
    assert warc.roundtrip(pages(spark, [])).count() == 0


def lz(raw):
    seen, at = set(), 0
    while at < len(raw):
        n = 1
        while raw[at : at + n] in seen and at + n < len(raw):
            n += 1
        seen.add(raw[at : at + n])
        at += n
    return seen


@pytest.mark.parametrize("seed", range(3))
def test_phrases(seed):
    rng = random.Random(seed)
    for _ in range(200):
        raw = bytes(rng.choice(b"ab") for _ in range(rng.randrange(80))) + words(rng, rng.randrange(20), 5).encode()
        seen = set()
        assert b"".join(lzprint.phrases(raw, seen)) == raw and seen == lz(raw)
        text, other = raw.decode(), words(rng, 10)
        got, sketch = lzprint.Parsed(1, text).edited(other)
        half = len(text) // 2
        assert got == (text[: len(text) - half] + other[:half]).encode()
        assert (sketch == lzprint.Parsed(2, got.decode()).sketch).all()


def test_fingerprints(spark):
    rng = random.Random(9)
    rows = [(i * 3, words(rng, rng.randrange(60), 300) + "é" * rng.randrange(3)) for i in range(120)]
    rows += [(1000, rows[5][1]), (1001, None), (1002, "a")]
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = {r["doc_id"]: r for r in lzprint.fingerprints(documents(spark, rows, extra=True)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for (i, text), (_, following) in zip(order, order[1:] + order[:1]):
        text, following = text or "", following or ""
        half = len(text) // 2
        edit = (text[: len(text) - half] + following[:half]).encode()
        own, changed, after = (lzprint.Parsed(0, t).sketch for t in (text, edit.decode(), following))
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edit).hexdigest())
        assert r["fingerprint"] == lzprint.packed(own) and r["edited_fingerprint"] == lzprint.packed(changed)
        assert (r["near_edited"], r["near_next"]) == (lzprint.likeness(own, changed), lzprint.likeness(own, after))
    assert got[1000]["fingerprint"] == got[15]["fingerprint"] and base64.b64decode(got[1001]["fingerprint"]) == b""


def test_likeness_estimates_the_shared_phrases():
    rng = random.Random(2)
    for _ in range(5):
        a, b = words(rng, 3000, 500), words(rng, 3000, 500)
        both = a[: len(a) // 2] + b[: len(b) // 2]
        x, y = lz(a.encode()), lz(both.encode())
        got = lzprint.likeness(lzprint.Parsed(1, a).sketch, lzprint.Parsed(2, both).sketch)
        assert abs(got - len(x & y) / len(x | y)) < 0.15


def test_fingerprints_of_odd_rows(spark):
    out = lzprint.fingerprints(documents(spark, odd_rows())).collect()
    assert len(out) == 8 and {r["near_edited"] for r in out if r["doc_id"] in (1, 2)} == {1.0}
    assert lzprint.fingerprints(documents(spark, [])).count() == 0
    (one,) = lzprint.fingerprints(documents(spark, [(1, "abcd")])).collect()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
