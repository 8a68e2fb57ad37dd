from __future__ import annotations

import hashlib
import struct
from collections import defaultdict

import pyarrow.fs as pafs
import pytest
import zstandard

from ledgerlens.llm import warc as W
from ledgerlens.llm.common import file_system

SCHEMA = "page_id long, url string, html string"
BIG, HUGE = "é" * 500, "<p>" + "x\r\n\r\n" * 100_000
ROWS = [(1, "http://a", "small"), (2, "http://a", "small"), (3, None, BIG), (4, "http://b", BIG), (5, "http://c\r\nX: y %41 ü", BIG), (6, "u", None), (7, "u", ""), (8, "u", HUGE), (9, "u", HUGE),
        (5, "http://again", BIG), (None, "u", BIG), (10, "u", "a" * 999), (11, "u", "a" * 999), (12, "u", "a" * 1000), (13, "u", "a" * 1000), (None, "u", "z" * 2000)]


def brute(rows):
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[h or ""].append(i)
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        best = max((x for x in groups[h or ""] if x is not None), default=None)
        revisit = len(body) >= 1000 and i != best
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", best if revisit else None))
    return sorted(out, key=str)


def test_written_and_read_back(spark):
    rows = ROWS + [(100 + i, f"http://x/{i}", f"<html>{'shared passage ' * 40}{i}</html>") for i in range(300)] + [(1000 + i, "u", "copy" * 400) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS payload", "'k' AS key").repartition(3)
    manifest = W.write_archives(df)
    got = W.read_archives(manifest)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    full = W.read_archives(manifest, payloads=True).collect()
    html = {(i, u): (h or "").encode() for i, u, h in rows}
    for r in full:
        assert (r.page_id, r.url) in html
        assert r.record_type == "revisit" and r.payload is None or bytes(r.payload) == html[r.page_id, r.url]
    # each archive: a dictionary in a leading skippable frame, then frames that only it can open
    for row in manifest.collect():
        data = open(file_system(row.path)[1], "rb").read()
        number, size = struct.unpack("<II", data[:8])
        assert number == 0x184D2A5D
        book = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8:8 + size]))
        first = data[8 + size:]
        assert zstandard.get_frame_parameters(first).dict_id == book.dict_id() != 0
        with pytest.raises(zstandard.ZstdError):
            zstandard.ZstdDecompressor().decompressobj().decompress(first)
        assert zstandard.ZstdDecompressor(dict_data=book).decompressobj().decompress(first).startswith(b"WARC/1.1\r\n")


def test_few_records_need_no_dictionary(spark):
    manifest = W.write_archives(spark.createDataFrame(ROWS[:2], SCHEMA).coalesce(1))
    assert sorted(map(tuple, W.read_archives(manifest).collect()), key=str) == brute(ROWS[:2])


def test_long_first_records_still_give_a_dictionary(tmp_path):
    lines = lambda k, n: b"".join(b"<p class=a>passage %s</p>\n" % hashlib.sha256(b"%d %d" % (k, i)).hexdigest().encode() for i in range(n))
    for name, sizes in (("one", [60_000]), ("eight", [10_000] * 8)):
        records = [W.record(k, "u", lines(k, n), "d", None) for k, n in enumerate(sizes + [20] * 50)]
        assert sum(map(len, records[:7])) >= W.SAMPLE_BYTES
        (path, n, _), = W.write_records(iter(records), f"file://{tmp_path}/{name}")
        data = open(path[7:], "rb").read()
        assert struct.unpack("<I", data[:4])[0] == W.DICT_FRAME
        assert n == len(records) and list(W.read_records(path)) == records


def test_archives_turn_over_when_full(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "ARCHIVE_BYTES", 2000)
    monkeypatch.setattr(W, "SAMPLE_BYTES", 30_000)
    records = [W.record(i, "u", hashlib.sha256(str(i).encode()).hexdigest().encode() * 10, "d", None) for i in range(100)]
    done = list(W.write_records(iter(records), f"file://{tmp_path}/a"))
    assert len(done) > 3 and sum(n for _, n, _ in done) == 100
    assert [r for path, _, _ in done for r in W.read_records(path)] == records
    assert len(pafs.LocalFileSystem().get_file_info(pafs.FileSelector(f"{tmp_path}/a"))) == len(done)


def test_damage_is_found(tmp_path):
    data = W.record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None)
    with pytest.raises(ValueError, match="damaged"):
        W.parse(data.replace(b"abc", b"abd"))
    (path, _, _), = W.write_records(iter([data]), f"file://{tmp_path}")
    whole = open(path[7:], "rb").read()
    open(path[7:], "wb").write(whole[:-3])
    with pytest.raises(ValueError, match="ends inside"):
        list(W.read_records(path))


def test_empty_table(spark):
    assert W.read_archives(W.write_archives(spark.createDataFrame([], SCHEMA))).count() == 0
