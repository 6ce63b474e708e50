"""Archives of other writers and broken ones: no record is lost without a word, and no fault ends a job."""

from __future__ import annotations

import gzip
import re

import pytest

from plumbline.llm import warc

R = [warc.record("response", f"urn:page:{i}", f"http://x/{i}", f"2024-01-0{i + 1}T00:00:00Z", b"%d" % i * 5000, None) for i in range(4)]
G = [gzip.compress(r) for r in R]
M = [warc.member(r) for r in R]


def flipped(data: bytes, at: int) -> bytes:
    return data[:at] + bytes([data[at] ^ 0x55]) + data[at + 1 :]


NO_LENGTH = re.sub(rb"\r\nContent-Length: \d+\r\n\r\nHTTP", b"\r\n\r\nHTTP", R[1])
CASES = {
    "two in a stream": (gzip.compress(R[0] + R[1]) + G[2], "012", 0),
    "all in a stream": (gzip.compress(b"".join(R)), "0123", 0),
    "a noted member of two": (warc.member(R[0] + R[1]) + M[2], "012", 0),
    "plain": (b"".join(R), "0123", 0),
    "truncated": (M[0] + M[1] + M[2][: len(M[2]) // 2], "01", 1),
    "truncated within": (G[0] + G[1][:60] + G[2], "02", 1),
    "flipped byte, noted": (M[0] + flipped(M[1], len(M[1]) // 2) + M[2], "02", 1),
    "flipped byte": (G[0] + flipped(G[1], len(G[1]) // 2) + G[2], "02", 1),
    "flipped checksum": (G[0] + flipped(G[1], len(G[1]) - 6) + G[2], "02", 1),
    "no length": (R[0] + NO_LENGTH + R[2], "02", 1),
    "no length, in a stream": (gzip.compress(R[0] + NO_LENGTH + R[2]) + G[3], "023", 1),
    "junk in front": (b"some junk\r\n\x1f\x8b\x08 more\n" + R[0] + R[1], "01", 1),
    "junk between members": (b"junk" * 3 + G[0] + b"xx" * 9 + G[1], "01", 2),
    "junk in a stream": (gzip.compress(b"xx\n" + R[0] + b"yyy\n" + R[1]), "01", 2),
    "short": (R[0] + R[1][:-300], "0", 1),
    "empty": (b"", "", 0),
    "empty member": (gzip.compress(b"") + G[0], "0", 0),
}


def read(path, data: bytes, filters=(), **options):
    (path / "a.warc.gz").write_bytes(data)
    reader = warc.WarcReader({"path": str(path), **options})
    assert not list(reader.pushFilters(list(filters)))
    return [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]


@pytest.mark.parametrize("payload", ["true", "false"])
@pytest.mark.parametrize("case", CASES)
def test_what_is_sound_is_read_and_the_rest_is_a_fault(tmp_path, case, payload):
    data, sound, faults = CASES[case]
    rows = read(tmp_path, data, payload=payload)
    good = [r for r in rows if not r["fault"]]
    assert [r["record_id"][-1] for r in good] == list(sound) and len(rows) - len(good) == faults
    assert payload == "false" or all(r["payload"] == r["record_id"][-1].encode() * 5000 for r in good)


def test_dates_are_pushed_down(tmp_path):
    f = warc.GreaterThan(("date",), "2024-01-02T00:00:00Z"), warc.LessThanOrEqual(("date",), "2024-01-03T00:00:00Z")
    assert [r["record_id"][-1] for r in read(tmp_path, b"".join(M), f)] == ["2"]
    assert [r["record_id"][-1] for r in read(tmp_path, gzip.compress(b"".join(R)), f)] == ["2"]


def test_a_job_goes_on_and_sound_stops(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(CASES["flipped byte"][0])
    (tmp_path / "b.warc").write_bytes(CASES["no length"][0])
    rows = warc.read(spark, str(tmp_path)).collect()
    assert sorted(r.record_id[-1] for r in rows if not r.fault) == ["0", "0", "2", "2"] and sum(bool(r.fault) for r in rows) == 2
    with pytest.raises(Exception, match="Content-Length|gzip member"):
        warc.sound(warc.read(spark, str(tmp_path))).collect()
