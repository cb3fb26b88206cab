"""WARC archives: round trips, visits of equal payloads, damaged files, archives of others."""

import gzip
import hashlib
import random

import pytest

from pavelens.llm import archives
from pavelens.llm.archives import archive_frames, member, read_archives, read_members, record

SCHEMA = "frame_id long, image_path string, document string, _to string, member int"
DAY, MEDIA = "2020-01-02T03:04:05Z", "application/geo+json"


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], schema)


def test_frames_come_back_with_kinds_of_equal_payloads(spark, tmp_path):
    r = random.Random(1)
    docs = ["é" * 600, "b" * 999, "c" * 1000, "\0\r\n\r\n" * 400, "", None, "".join(r.choices("abcdef \n", k=3_000_000))]
    rows = [(i, f"https://x.org/{i} a\r\nb", docs[i % 7]) for i in range(70)] + [(None, None, docs[0]), (2, "again", docs[2]), (69, "again", docs[69 % 7])]
    folder = str(tmp_path / "w")
    archive_frames(table(spark, rows), folder)
    got = read_archives(spark, folder, payloads=True).collect()
    assert len(got) == len(rows) and all(x["intact"] and x["problem"] is None for x in got)
    top = {}
    for i, _, text in rows:
        if i is not None:
            top[text or ""] = max(top.get(text or "", -1), i)
    want = []
    for i, a, text in rows:
        data = (text or "").encode()
        to = top[text or ""] if len(data) >= 1000 and i is not None and i != top[text or ""] else None
        want.append((None if i is None else str(i), a and a.replace(" ", "%20").replace("\r", "%0D").replace("\n", "%0A"), "response" if to is None else "revisit",
                     len(data), hashlib.sha1(data).hexdigest(), None if to is None else str(to), data if to is None else None))
    key = lambda x: str(x)
    assert sorted(((x["frame_id"], x["address"], x["record_type"], x["payload_bytes"], x["payload_digest"], x["refers_to"], None if x["payload"] is None else bytes(x["payload"])) for x in got), key=key) == sorted(want, key=key)
    for path in (tmp_path / "w").glob("part-*"):  # other readers of multi-member gzip read the files too
        assert gzip.decompress(path.read_bytes()).count(b"WARC/1.1\r\n") == sum(x["archive"].endswith(path.name) for x in got)
    assert {"payload"} == {*read_archives(spark, folder, payloads=True).columns} - {*read_archives(spark, folder).columns}


def test_empty_tables_and_binary_payloads(spark, tmp_path):
    archive_frames(table(spark, []), str(tmp_path / "e"))
    assert read_archives(spark, str(tmp_path / "e")).count() == 0
    raw = spark.createDataFrame([("a/b", None, bytearray(range(256)))], "frame_id string, image_path string, document binary")
    archive_frames(raw, str(tmp_path / "b"))
    (x,) = read_archives(spark, str(tmp_path / "b"), payloads=True).collect()
    assert (x["frame_id"], x["address"], bytes(x["payload"])) == ("a/b", None, bytes(range(256)))


def test_members_are_read_step_by_step(monkeypatch):
    monkeypatch.setattr(archives, "FEED", 7)
    monkeypatch.setattr(archives, "OUT", 5)
    data = [record(str(k), f"a{k}", bytes([k]) * (k * 50), None if k % 3 else "9", DAY, MEDIA) for k in range(9)]
    whole = b"".join(member(d) + b"\0" * (k % 2) for k, d in enumerate(data))
    got = list(read_members(whole, True))
    assert [x["frame_id"] for x in got] == [str(k) for k in range(9)]
    assert [x["payload_bytes"] for x in got] == [k * 50 for k in range(9)] and all(x["intact"] for x in got)
    assert whole[got[4]["offset"] : got[4]["offset"] + 2] == b"\x1f\x8b"
    both = list(read_members(member(data[1] + data[2]), False))  # two records in one member
    assert [x["frame_id"] for x in both] == ["1", "2"] and both[0]["payload"] is None


@pytest.mark.parametrize(
    "spoil,problem",
    [(lambda d: member(d)[:-20], "ends inside"), (lambda d: b"plain text", "not a gzip"), (lambda d: member(d.replace(b"Content-Length: ", b"Content-Length: 9", 1)), "ends inside|shorter|not end"),
     (lambda d: member(d.replace(b"WARC/1.1", b"HTTP/1.1")), "no record"), (lambda d: member(d.replace(b"Content-Length", b"Content-Width")), "no length"), (lambda d: member(b"x" * 100), "head")],
)
def test_damaged_archives_say_so(spoil, problem):
    import re

    good = record("1", "a", b"abc", None, DAY, MEDIA)
    got = list(read_members(member(good) + spoil(good), True))
    assert got[0]["frame_id"] == "1" and got[0]["intact"]
    assert re.search(problem, got[-1]["problem"]) and not got[-1]["intact"] and len(got) == 2


def test_wrong_digests_are_not_intact():
    good = record("1", "a", b"abc", None, DAY, MEDIA)
    (x,) = read_members(member(good.replace(b"abc", b"abd")), True)
    assert not x["intact"] and x["problem"] is None and x["payload_digest"] == hashlib.sha1(b"abd").hexdigest()
    foreign = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Type: image/png\r\nContent-Length: 4\r\n\r\n\x89PNG\r\n\r\n"
    (x,) = read_members(member(foreign), True)
    assert (x["record_type"], x["payload"], x["intact"], x["frame_id"]) == ("resource", b"\x89PNG", True, None)
