"""WARC archives of exported frame documents: one gzip member per record, written and read back by Spark."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import need

#: Payloads of fewer bytes are never given as a visit of an equal one.
LEAST_BYTES = 1000
#: Compressed bytes fed to zlib, bytes it may give at a time, and bytes that the head of a record may have.
FEED, OUT, HEAD = 1 << 16, 1 << 20, 1 << 20
#: Bytes of payloads in one batch of records.
BATCH_BYTES = 8 << 20
END = b"\r\n\r\n"
# Fixed values of the archive format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "archive string, offset bigint, frame_id string, address string, record_type string, payload_bytes bigint, payload_digest string, refers_to string, intact boolean, problem string"


def _urn(frame: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, frame) if frame is not None else uuid.UUID(int=0)}>"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(frame: str | None, address: str | None, payload: bytes, to: str | None, date: str, media: str) -> bytes:
    """One record. With ``to`` it is a visit that repeats that frame's payload: digest and length of the payload stay, its bytes do not."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: {media}\r\nContent-Length: {len(payload)}".encode() + END
    block = http if to is not None else http + payload
    head = [VERSION, f"WARC-Type: {'response' if to is None else 'revisit'}", f"WARC-Record-ID: {_urn(frame)}", f"WARC-Date: {date}"]
    if address is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", address))
    if frame is not None:
        head.append("WARC-Frame-ID: " + quote(frame, safe=""))
    if to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(to)}", "WARC-Refers-To-Frame-ID: " + quote(to, safe="")]
    head += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: {_sha1(payload)}", f"WARC-Block-Digest: {_sha1(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block + END


def member(data: bytes) -> bytes:
    """``data`` as one gzip member without a time, so that the same record gives the same bytes."""
    z = zlib.compressobj(5, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Broken(ValueError):
    """The archive cannot be read on from here."""


class Member:
    """Bytes of one gzip member, decompressed as they are asked for."""

    def __init__(self, content: memoryview, start: int) -> None:
        self._content, self._at, self._z, self._held = content, start, zlib.decompressobj(31), b""

    def _more(self) -> bool:
        """Whether further bytes came."""
        while not self._z.eof:
            tail = self._z.unconsumed_tail
            if not tail:
                tail = self._content[self._at : self._at + FEED]
                self._at += len(tail)
                if not len(tail):
                    raise Broken("the archive ends inside a record")
            try:
                got = self._z.decompress(tail, OUT)
            except zlib.error as e:
                raise Broken(f"not a gzip member: {e}") from None
            if got:
                self._held += got
                return True
        return False

    def head(self, limit: int = HEAD) -> bytes:
        """Everything before the next empty line, which is passed."""
        seen = 0
        while (at := self._held.find(END, max(0, seen - 3))) < 0:
            seen = len(self._held)
            if seen > limit or not self._more():
                raise Broken("the head of a record does not end")
        out, self._held = self._held[:at], self._held[at + len(END) :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes in pieces."""
        while n:
            if not self._held and not self._more():
                raise Broken("a record is shorter than its length says")
            piece = self._held[:n]
            self._held = self._held[len(piece) :]
            n -= len(piece)
            yield piece

    def ended(self) -> bool:
        return not self._held and not self._more()

    @property
    def end(self) -> int:
        """Where the next member starts, once this one has ended."""
        return self._at - len(self._z.unused_data)


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _length(fields: dict[str, str]) -> int:
    value = fields.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", value):
        raise Broken("a record has no length")
    return int(value)


def _digest(value: str | None) -> str | None:
    """Bare lower-case hexadecimal digits of a ``sha1:`` label in base 32 or base 16."""
    name, _, digits = (value or "").partition(":")
    try:
        return base64.b32decode(digits.upper()).hex() if name.lower() == "sha1" and len(digits) == 32 else digits.lower() if len(digits) == 40 else None
    except ValueError:
        return None


def read_record(m: Member, keep: bool) -> dict:
    version, fields = _fields(m.head())
    if not version.startswith("WARC/"):
        raise Broken("no record starts here")
    kind, left = fields.get("warc-type"), _length(fields)
    block, payload, held, kept, size = hashlib.sha1(), hashlib.sha1(), b"", [], 0
    http = fields.get("content-type", "").startswith("application/http")
    web: dict[str, str] = {}
    for piece in m.take(left):
        block.update(piece)
        if http:
            held += piece
            at = held.find(END)
            if at < 0:
                if len(held) > HEAD:
                    raise Broken("the head of an answer does not end")
                continue
            web, piece, http = _fields(held[:at])[1], held[at + len(END) :], False
        payload.update(piece)
        size += len(piece)
        if keep:
            kept.append(piece)
    if b"".join(m.take(len(END))) != END:
        raise Broken("a record does not end where its length says")
    given = _digest(fields.get("warc-payload-digest"))
    intact = _digest(fields.get("warc-block-digest")) in (None, block.hexdigest())
    frame, to = fields.get("warc-frame-id"), fields.get("warc-refers-to-frame-id")
    out = {"frame_id": unquote(frame) if frame is not None else None, "address": fields.get("warc-target-uri"), "record_type": kind, "refers_to": unquote(to) if to is not None else None, "problem": None}
    if kind == "revisit":
        out |= {"payload_bytes": int(n) if (n := web.get("content-length", "")).isdigit() else None, "payload_digest": given, "intact": intact and given is not None, "payload": None}
    else:
        out |= {"payload_bytes": size, "payload_digest": payload.hexdigest(), "intact": intact and given in (None, payload.hexdigest()), "payload": b"".join(kept) if keep else None}
    return out


def read_members(content: bytes, keep: bool) -> Iterator[dict]:
    """Records of one archive in order. Where it cannot be read on, a last one says why in ``problem``."""
    view, at = memoryview(content), 0
    while at < len(view):
        if view[at] == 0:  # padding between members
            at += 1
            continue
        m = Member(view, at)
        try:
            while not m.ended():
                yield {"offset": at, **read_record(m, keep)}
        except Broken as e:
            yield {"offset": at, "problem": str(e), "intact": False}
            return
        at = m.end


def archive_frames(
    frames: DataFrame, folder: str, frame: str = "frame_id", address: str = "image_path", payload: str = "document", least: int = LEAST_BYTES,
    date: str = "1970-01-01T00:00:00Z", media: str = "text/html; charset=utf-8",
) -> None:
    """Writes the exported document of every frame as a WARC record to new files in ``folder``.

    Of frames whose payloads are equal and have at least ``least`` bytes, the one with the largest ``frame`` is a *response*, the others are *revisit* records that refer to it and hold no payload; all
    other frames are responses. Every record is a gzip member of its own and carries SHA-1 digests of its payload and block.

    How: equal payloads meet by SHA-256 and length on rows without payloads, counted before the shuffle, so a payload that many frames share costs one row per frame. Spark's
    text writer commits the files, so a lost or repeated task leaves none behind: it ends each row with a NUL byte, which is the last byte of every member of
    under 16 MB anyway; behind larger ones it is padding, which readers skip. Files hold what Spark gives a task (``spark.sql.adaptive.advisoryPartitionSizeInBytes``).

    A null payload is empty, text is written in UTF-8, a binary column as it is. A null address is left out, control characters and spaces in it are percent-encoded. A null ``frame`` is always a
    response. Rows that repeat a frame and its payload give records of the same kind. An empty table gives no records; further columns are ignored.
    """
    rows = need(frames, frame, address, payload)
    data = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit("").cast("binary"))
    rows = rows.select(F.col(f"`{frame}`").alias("_frame"), F.col(f"`{address}`").cast("string").alias("_address"), data.alias("_payload"), F.sha2(data, 256).alias("_name"), F.octet_length(data).alias("_n"))
    large = rows.where(F.col("_n") >= least).select("_frame", "_name", "_n")
    first = large.groupBy("_name", "_n").agg(F.max("_frame").alias("_to"), F.count(F.lit(1)).alias("_many")).where("_many > 1").drop("_many")
    again = large.join(first, ["_name", "_n"]).where("_frame <> _to").select("_frame", "_name", F.col("_to").cast("string").alias("_to")).distinct()
    rows = rows.join(again, ["_frame", "_name"], "left").select(F.col("_frame").cast("string").alias("_frame"), "_address", "_payload", "_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for i in range(batch.num_rows):
                row = [batch.column(c)[i].as_py() for c in ("_frame", "_address", "_payload", "_to")]
                held.append(member(record(*row, date, media)))
                size += len(held[-1])
                if size > BATCH_BYTES or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array([x[:-1] if x[-1] == 0 else x for x in held], pa.binary())], ["member"])
                    held, size = [], 0

    members = rows.mapInArrow(write, "member binary").select(F.col("member").cast("string").alias("value"))
    members.write.option("lineSep", "\0").text(folder)


def read_archives(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """Records of all WARC files in ``folder``, whoever wrote them: ``archive``, ``offset`` (where the member starts), ``frame_id``, ``address``, ``record_type``, ``payload_bytes``, ``payload_digest`` (bare lower-case hexadecimal SHA-1,
    both of the full payload, also for visits that repeat one), ``refers_to`` (frame of the response that a visit repeats), ``intact`` (digests agree) and ``problem``; with ``payloads`` also ``payload``.

    How: each archive is read by one task from beginning to end: members are decompressed step by step, records framed by their length, digests taken on the way, so
    besides the compressed archive a task holds one step, and one payload only if payloads are asked for. Spark's ``binaryFile`` source reads the archives from any store
    it knows; it takes files of up to 2 GB.

    An archive that ends early or is damaged gives the records before that and one with ``problem``; a record whose digests disagree is not ``intact``. Records without digests count as intact. An
    empty folder gives none.
    """
    fields = RECORD + (", payload binary" if payloads else "")
    names = [f.split()[0] for f in fields.split(", ")]
    kinds = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    types = [kinds[f.split()[1]] for f in fields.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in held], t) for n, t in zip(names, types)], names)

        for batch in batches:
            for i in range(batch.num_rows):
                held, size = [], 0
                archive = batch.column("path")[i].as_py()
                for r in read_members(batch.column("content")[i].as_buffer(), payloads):
                    held.append({"archive": archive, **r})
                    size += 500 + len(r.get("payload") or b"")
                    if size > BATCH_BYTES:
                        yield out(held)
                        held, size = [], 0
                if held:
                    yield out(held)

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(read, fields)
