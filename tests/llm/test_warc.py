"""WARC files as an exact round trip, and damaged ones."""

import base64
import gzip
import hashlib
import io

import pytest

from orrery.llm import warc


def test_round_trip(spark, tmp_path):
    rows = [(1, "http://a/ü?x=1", "<p>é</p>"), (2, None, ""), (None, "http://b", "x" * 3_000_000), (4, "u", None), (1, "http://a/ü?x=1", "<p>é</p>")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "page_id long, url string, html string, status string")
    assert sum(r.records for r in warc.write(df, str(tmp_path / "w")).collect()) == 5
    got = warc.read(spark, str(tmp_path / "w")).collect()
    assert {r.status for r in got} == {"ok"} and {r.content_type for r in got} == {"text/html"}
    back = sorted((r.record_id or "", r.target_uri or "", bytes(r.payload).decode()) for r in got)
    assert back == sorted((f"urn:page:{i}" if i else "", u or "", h or "") for i, u, h in rows)
    warc.write(df.limit(0), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0


class Slow(io.BytesIO):
    """Gives few bytes at a time, so that every frame is split somewhere."""

    def read(self, n=-1):
        return super().read(min(7, n) if n > 0 else n)


@pytest.mark.parametrize("kind", [io.BytesIO, Slow])
def test_damage(kind):
    good = [warc.record(bytes([65 + i]) * 500, f"urn:page:{i}", None) for i in range(4)]
    plain = gzip.decompress(good[1])
    bad = bytearray(good[2])
    bad[30] ^= 0xFF
    data = b"".join([b"junk", good[0], gzip.compress(plain.replace(b"BBB", b"BXB")), gzip.compress(plain[:-40]), bytes(bad), gzip.compress(b"no header"), good[3], b"\n", good[0][:-30]])
    got = list(warc.records(kind(data)))
    assert [r["status"] for r in got] == ["ok", "digest", "length", "corrupt", "corrupt", "ok", "truncated"]
    assert got[0]["offset"] == 4 and got[5]["payload"] == b"D" * 500 and data[got[5]["offset"] :].startswith(good[3])
    assert list(warc.records(kind(b""))) == []


def member(payload, *fields, kind="resource"):
    head = ["WARC/1.1", f"WARC-Type: {kind}", *fields, f"Content-Length: {len(payload)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n")


def status(*args, **options):
    return [r["status"] for r in warc.records(io.BytesIO(member(*args, **options)))]


@pytest.mark.parametrize("name", ["md5", "sha1", "sha256", "sha512"])
def test_digests(name):
    raw = hashlib.new(name, b"hello").digest()
    forms = [raw.hex(), raw.hex().upper(), base64.b32encode(raw).decode(), base64.b32encode(raw).decode().rstrip("="), base64.b32encode(raw).decode().lower()]
    for field in ("WARC-Block-Digest", "WARC-Payload-Digest"):
        assert all(status(b"hello", f"{field}: {name}:{x}") == ["ok"] for x in forms)
        assert all(status(b"hellO", f"{field}: {name}:{x}") == ["digest"] for x in forms)
        assert status(b"hello", f"{field}: {name}:bad") == ["digest"]


def test_digests_that_cannot_be_checked():
    assert status(b"x", "WARC-Block-Digest: blake3:abc") == ["unverified"] and status(b"x", "WARC-Block-Digest: abc") == ["unverified"]
    assert status(b"x", "WARC-Block-Digest: sha1:abc", "WARC-Payload-Digest: blake3:abc") == ["digest"] and status(b"x") == ["ok"]
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\nhello"
    good = "WARC-Payload-Digest: sha1:" + hashlib.sha1(b"hello").hexdigest()
    kind = "Content-Type: application/http; msgtype=response"
    assert status(http, kind, good, kind="response") == ["ok"] and status(http + b"!", kind, good, kind="response") == ["digest"] and status(http, good) == ["digest"]
    chunked = http.replace(b"Server: x", b"Transfer-Encoding: chunked")
    assert status(chunked, kind, good) == ["ok"] and status(chunked + b"!", kind, good) == ["unverified"]


def test_plain_files():
    plain = gzip.decompress(warc.record(b"x" * 99, "urn:page:1", None))
    for kind in (io.BytesIO, Slow):
        assert [(r["status"], r["offset"]) for r in warc.records(kind(plain))] == [("plain", 0)] and list(warc.records(kind(b""))) == []


def test_nothing_of_others_is_removed(spark, tmp_path):
    at = tmp_path / "w"
    (at / "folder").mkdir(parents=True)
    (at / "mine.warc.gz").write_bytes(warc.record(b"mine", "urn:page:7", None))
    (at / "folder" / "notes.txt").write_bytes(b"not a WARC file")
    df = spark.createDataFrame([(1, "u", "one")], "page_id long, url string, html string")
    warc.write(df, str(at))
    warc.write(df, str(at))
    assert sorted((r.status, bytes(r.payload or b"")) for r in warc.read(spark, str(at)).collect()) == [("ok", b"mine"), ("ok", b"one"), ("ok", b"one"), ("plain", b"")]
