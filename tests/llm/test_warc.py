"""Archives: round trips at any chunk size, revisits, damage, odd rows."""

import base64
import gzip
import hashlib
import re
from pathlib import Path

import pytest

from kgloom.llm import warc

SCHEMA = "page_id long, url string, html string, refers_to string, chunk string"
TRICKY = ["\r\n\r\n" * k + x for k in range(4) for x in ("", "a", "\r", "\r\n", "\r\n\r", "\n", "WARC/1.1\r\n\r\n")]
ROWS = [(i, f"http://a/{i}\r\n", x) for i, x in enumerate(TRICKY)] + [(100, None, "é" * 40_000), (101, "", None), (102, "http://b", "x\r\n\r\n" * 20_000), (103, "u", "é" * 40_000), (None, None, "no id"), (104, None, "no id")]


def _digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _expected(rows, least=0):
    data = [(i, (h or "").encode()) for i, _, h in rows]
    found = []
    for i, d in data:
        top = max((j for j, e in data if e == d and j is not None), default=None)
        older = len(d) >= least and top is not None and (i is None or i < top)
        found.append((i, len(d), _digest(d), "revisit" if older else "response", top if older else None))
    return sorted(found, key=str)


def _archived(spark, rows, parts=3, **kw):
    out = warc.archive_dir(spark)
    warc.write_archives(spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(parts), out, **kw)
    return out


@pytest.mark.parametrize("chunk_bytes", [1, 3, 7, 1000, warc.CHUNK_BYTES])
def test_payloads_come_back_whatever_the_chunks(spark, chunk_bytes):
    rows = [r for r in ROWS if chunk_bytes >= 1000 or len(r[2] or "") < 1000]
    out = _archived(spark, rows, chunk_bytes=chunk_bytes)
    assert sorted(map(tuple, warc.read_records(spark, out).collect()), key=str) == _expected(rows)
    whole, data = {i: (h or "").encode() for i, _, h in rows}, {}
    for c in warc.read_chunks(spark, out).orderBy("page_id", "chunk").collect():
        if c.record_type == "response":
            data[c.page_id] = data.get(c.page_id, b"") + c.data
            assert len(c.data) <= chunk_bytes and c.payload_bytes == len(data[c.page_id]) and c.payload_digest == _digest(data[c.page_id])
            assert c.last == (data[c.page_id] == whole[c.page_id])
    assert all(data[i] == whole[i] for i in data) and len(data) == sum(e[3] == "response" for e in _expected(rows))


@pytest.mark.parametrize("groups", [0, warc.BROADCAST_GROUPS])
def test_small_payloads_stay_and_groups_meet_by_either_join(spark, groups):
    out = _archived(spark, ROWS, min_bytes=5, broadcast_groups=groups)
    assert sorted(map(tuple, warc.read_records(spark, out).collect()), key=str) == _expected(ROWS, 5)


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "u", "x"), (1, "u", "x"), (0, "u", "x")]
    found = warc.read_records(spark, _archived(spark, rows)).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in found) == [(0, "revisit", 1), (1, "response", None), (1, "response", None)]
    assert warc.read_records(spark, _archived(spark, [])).count() == 0


def test_files_are_warc_and_damage_is_named(spark):
    out = Path(_archived(spark, [(1, "http://a/", "text " * 50)], parts=1, chunk_bytes=100).removeprefix("file://"))
    file = next(out.glob("part-*.gz"))
    data = gzip.decompress(file.read_bytes())
    heads = re.findall(rb"WARC/1\.1\r\n(.*?)\r\n\r\n", data, re.S)
    assert [re.search(rb"WARC-Type: (\w+)", h)[1] for h in heads] == [b"response", b"continuation", b"continuation"]
    assert b"WARC-Segment-Total-Length: " in heads[-1] and b"WARC-Target-URI: http://a/" in heads[0]
    for broken in (data.replace(b"text text", b"text test", 1), data[:-200], data[:-20], data.replace(b"WARC-Segment-Number: 2", b"WARC-Segment-Number: 3")):
        other = out.parent / f"{out.name}-{len(broken)}-{hash(broken)}"
        other.mkdir()
        (other / "part-0.txt.gz").write_bytes(gzip.compress(broken))
        with pytest.raises(Exception, match="damaged|without its end|out of order"):
            warc.read_records(spark, f"file://{other}").collect()
