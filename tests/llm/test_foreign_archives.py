"""Salvage of archives that others wrote: digests in base32 over HTTP bodies, many records in a gzip member."""

import base64
import gzip
import hashlib
import random

from opsloom.llm import warc

b32 = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()


def crawled(i, body, coding=b"", digest=None, payload=None):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n" + coding + b"\r\n" + body
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:{i}>\r\nWARC-Block-Digest: sha1:{b32(block)}\r\nWARC-Payload-Digest: sha1:{digest or b32(payload or body)}\r\n"
    return head.encode() + f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def ids(data):
    return [f["warc-record-id"][7:-1] for _, _, f, _ in warc.salvage(data) if f], [(a, e) for a, e, f, _ in warc.salvage(data) if f is None]


def test_digests_of_other_writers():
    chunked = b"3\r\nabc\r\n2\r\nde\r\n0\r\n\r\n"
    coding = b"Transfer-Encoding: chunked\r\n"
    good = [crawled(0, b"one"), crawled(1, chunked, coding), crawled(2, chunked, coding, payload=b"abcde"), crawled(3, b"x", digest=hashlib.sha1(b"x").hexdigest())]
    assert ids(b"".join(good)) == (["0", "1", "2", "3"], [])
    bad = crawled(4, b"one", digest=b32(b"two"))
    assert ids(bad + good[0]) == (["0"], [(0, len(bad))])
    damaged = crawled(5, b"one").replace(b"text/html", b"text/htmX")
    assert ids(damaged + good[0]) == (["0"], [(0, len(damaged))])


def test_records_of_damaged_members_are_found():
    random.seed(1)
    made = [crawled(i, random.randbytes(600)) for i in range(20)]
    one = gzip.compress(b"".join(made[:8] + [made[8].replace(b"HTTP/1.1", b"HTTP/1.X")] + made[9:]), mtime=0)
    assert ids(one) == ([str(i) for i in range(20) if i != 8], [(0, len(one))])
    whole = gzip.compress(b"".join(made), mtime=0)
    found, gaps = ids(whole[: len(whole) // 2])
    assert found == [str(i) for i in range(len(found))] and 8 <= len(found) <= 10 and gaps == [(0, len(whole) // 2)]
    broken = bytearray(whole)
    broken[-6] ^= 255  # the member's checksum
    after = gzip.compress(crawled(20, b"later"), mtime=0)
    assert ids(bytes(broken) + after) == ([str(i) for i in range(21)], [(0, len(whole))])
