"""WARC records in ZIP packages, written and read back by range.

A package is a ZIP file with two stored (uncompressed) members: the WARC file, whose records are one
gzip member each, and a CDXJ index of their offsets. Packages are written with ZIP64 sizes and
offsets, so they may grow past 4 GB. The reader looks at the end of a package, finds its central
directory (the ZIP64 one where there is one), locates the stored members in it, reads the index, and
then reads runs of neighbouring records straight from their place in the package; nothing is
extracted.

Packages lie under the shared folder (or any folder that ``pyarrow.fs`` can reach). Each is written by
one task under a name of its own; only packages named by a task that succeeded are read, so a lost or
repeated task does no harm.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import likely_in, shared_path, stored, text_bytes

WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
PACKAGE_BYTES = 256 << 20
RUN_BYTES = 4 << 20
WARC_DATE = "2024-01-01T00:00:00Z"
# Signatures of the ZIP format, and the profile URI of a revisit.
LOCAL, DESCRIPTOR, CENTRAL = b"PK\x03\x04", b"PK\x07\x08", b"PK\x01\x02"
END, END64, LOCATOR64 = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAX32, MAX16 = 0xFFFFFFFF, 0xFFFF


def base32_sha1(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


# ---- writing ----

class Package:
    """A ZIP package that grows by records and is closed with its index and directory."""

    def __init__(self, place: fs.FileSystem, path: str):
        self.path, self.out, self.at = path, place.open_output_stream(path), 0
        self.entries: list[tuple[bytes, int, int, int]] = []
        self.index: list[str] = []
        self.start_member(WARC_MEMBER)

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def start_member(self, name: str) -> None:
        self.name, self.header_at, self.crc = name.encode(), self.at, 0
        # stored, UTF-8 name, sizes in the data descriptor
        self.write(struct.pack("<4sHHHHHIIIHH", LOCAL, 45, 0x0808, 0, 0, 0x21, 0, MAX32, MAX32,
                               len(self.name), 20) + self.name + struct.pack("<HHQQ", 1, 16, 0, 0))
        self.data_at = self.at

    def data(self, data: bytes) -> None:
        self.crc = zlib.crc32(data, self.crc)
        self.write(data)

    def end_member(self) -> None:
        size = self.at - self.data_at
        self.write(struct.pack("<4sIQQ", DESCRIPTOR, self.crc, size, size))
        self.entries.append((self.name, self.crc, size, self.header_at))

    def record(self, key: str, data: bytes) -> None:
        packed = zlib.compress(data, 4, wbits=31)
        self.index.append(f"{key} {json.dumps({'offset': self.at - self.data_at, 'length': len(packed)})}\n")
        self.data(packed)

    def close(self) -> None:
        self.end_member()
        self.start_member(INDEX_MEMBER)
        self.data("".join(self.index).encode())
        self.end_member()
        start = self.at
        for name, crc, size, header_at in self.entries:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, header_at)
            self.write(struct.pack("<4sHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x0808, 0, 0, 0x21, crc, MAX32,
                                   MAX32, len(name), len(extra), 0, 0, 0, 0, MAX32) + name + extra)
        size, end64 = self.at - start, self.at
        n = len(self.entries)
        self.write(struct.pack("<4sQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, size, start))
        self.write(struct.pack("<4sIQI", LOCATOR64, 0, end64, 1))
        self.write(struct.pack("<4sHHHHIIH", END, 0, 0, MAX16, MAX16, MAX32, MAX32, 0))
        self.out.close()


def record_id(page_id) -> str:
    return f"<urn:page:{'' if pd.isna(page_id) else int(page_id)}>"


def warc_record(page_id, url: str | None, payload: bytes, sha1: str, owner) -> bytes:
    """One WARC/1.1 record: a response, or a revisit of the record ``owner`` if that is not null."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    revisit = not pd.isna(owner)
    block = http.encode() + (b"" if revisit else payload)
    uri = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {WARC_DATE}", f"WARC-Target-URI: {uri}",
            f"WARC-Payload-Digest: sha1:{base32_sha1(sha1)}"]
    if revisit:
        head += [f"WARC-Refers-To: {record_id(owner)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_packages(pages: DataFrame, folder: str, at_least: int = 0, package_bytes: int = PACKAGE_BYTES,
                   id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record per row and returns the packages (path, bytes, records).

    Of rows with equal payloads of at least ``at_least`` bytes the one with the largest id is a
    response and rows of smaller ids revisit it; rows that repeat the largest id are responses too.
    A null payload is empty. A row with a null id is a response and nothing refers to it. An empty
    table gives no package; other columns are ignored."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"),
                        text_bytes(html_col).alias("payload"))
    rows = rows.withColumns({"sha1": F.sha1("payload"), "n": F.octet_length("payload").cast("long")})
    owners = stored(rows.filter((F.col("n") >= at_least) & F.col("id").isNotNull()).groupBy("sha1", "n")
                    .agg(F.max("id").alias("owner"), F.count(F.lit(1)).alias("rows"))
                    .filter("rows > 1").drop("rows"), "payloads")
    owner = F.when(F.col("id") < F.col("owner"), F.col("owner")).alias("owner")
    names = ["id", "url", "payload", "sha1"]
    shared = likely_in(rows, owners, ["sha1", "n"]).join(owners, ["sha1", "n"], "left").select(*names, owner)
    alone = likely_in(rows, owners, ["sha1", "n"], others=True)
    dealt = alone.select(*names, F.lit(None).cast("long").alias("owner")).unionByName(shared)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, base = fs.FileSystem.from_uri(folder)
        place.create_dir(base)
        package, done, n = None, [], 0
        for b in batches:
            for i, url, payload, sha1, own in zip(b["id"].array, b["url"], b["payload"], b["sha1"], b["owner"].array):
                if package is None:
                    package, n = Package(place, f"{base}/pages-{uuid.uuid4().hex}.zip"), 0
                package.record("-" if pd.isna(i) else str(int(i)), warc_record(i, url, payload, sha1, own))
                n += 1
                if package.at >= package_bytes:
                    package.close()
                    done.append((package.path, package.at, n))
                    package = None
        if package is not None:
            package.close()
            done.append((package.path, package.at, n))
        yield pd.DataFrame([(f"{folder.rstrip('/')}/{p.rsplit('/', 1)[1]}", size, k) for p, size, k in done],
                           columns=["path", "bytes", "records"])

    return stored(dealt.mapInPandas(write, "path string, bytes long, records long"), "packages")


# ---- reading ----

def central_directory(file, size: int) -> dict[str, tuple[int, int, int]]:
    """Members by name: compression method, offset of the data and its length."""
    tail_at = max(0, size - (1 << 16) - 22)
    tail = file.read_at(size - tail_at, tail_at)
    end = tail.rfind(END)
    if end < 0:
        raise ValueError("no end of central directory")
    n, length, start = struct.unpack_from("<10xHII", tail, end)
    if MAX16 == n or MAX32 in (length, start):
        at = tail_at + end - 20
        sign, where = struct.unpack("<4s4xQ4x", file.read_at(20, at))
        if sign != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        sign, n, length, start = struct.unpack("<4s28xQQQ", file.read_at(56, where))
        if sign != END64:
            raise ValueError("no ZIP64 end of central directory")
    directory, members, p = file.read_at(length, start), {}, 0
    for _ in range(n):
        sign, method, packed, full, n_name, n_extra, n_comment, header = struct.unpack_from(
            "<4s6xH8xIIHHH8xI", directory, p)
        if sign != CENTRAL:
            raise ValueError("bad central directory entry")
        name = directory[p + 46:p + 46 + n_name].decode()
        extra, q = directory[p + 46 + n_name:p + 46 + n_name + n_extra], 0
        while q + 4 <= len(extra):
            tag, n_field = struct.unpack_from("<HH", extra, q)
            if tag == 1:  # ZIP64: 8 bytes for each of the fields that overflowed, in this order
                values = iter(struct.unpack_from(f"<{n_field // 8}Q", extra, q + 4))
                full = next(values) if full == MAX32 else full
                packed = next(values) if packed == MAX32 else packed
                header = next(values) if header == MAX32 else header
            q += 4 + n_field
        n_name2, n_extra2 = struct.unpack("<26xHH", file.read_at(30, header))
        members[name] = (method, header + 30 + n_name2 + n_extra2, packed)
        p += 46 + n_name + n_extra + n_comment
    return members


def read_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From packages (path, bytes) to runs of neighbouring records: path, start, lengths."""
    for b in batches:
        runs = []
        for path, size in zip(b["path"], b["bytes"]):
            place, base = fs.FileSystem.from_uri(path)
            with place.open_input_file(base) as file:
                members = central_directory(file, size)
                data = [m for name, m in members.items() if name.endswith((".warc", ".warc.gz"))]
                index = [m for name, m in members.items() if name.endswith(".cdxj")]
                if len(data) != 1 or len(index) != 1 or data[0][0] or index[0][0]:
                    raise ValueError(f"{path}: needs one stored WARC member and one stored index")
                lines = file.read_at(index[0][2], index[0][1]).decode().splitlines()
            start, lengths, until = 0, [], 0
            for at, n in sorted((r["offset"], r["length"]) for r in (json.loads(x.split(" ", 1)[1]) for x in lines)):
                if lengths and (at != until or until + n - start > RUN_BYTES):
                    runs.append((path, data[0][1] + start, lengths))
                    lengths = []
                if not lengths:
                    start = at
                lengths.append(n)
                until = at + n
            if lengths:
                runs.append((path, data[0][1] + start, lengths))
        yield pd.DataFrame(runs, columns=["path", "start", "lengths"])


def parse_record(raw: bytes) -> tuple:
    """(page_id, url, payload or None, payload_bytes, digest, type, refers_to) of one WARC record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    field = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[:int(field["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    digest = field["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda s: int(s) if s else None
    page = lambda s: number(s[len("<urn:page:"):-1])
    if field["WARC-Type"] == "response":
        if len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"payload of {field['WARC-Record-ID']} does not match its digest")
    else:
        payload = None
    refers = page(field["WARC-Refers-To"]) if "WARC-Refers-To" in field else None
    return (page(field["WARC-Record-ID"]), field["WARC-Target-URI"], payload, n, digest, field["WARC-Type"], refers)


def read_packages(packages: DataFrame, with_payload: bool = False) -> DataFrame:
    """A row per record of the packages (path, bytes): page_id, url, payload_bytes, payload_digest,
    record_type, refers_to, and the payload of responses if ``with_payload``. Digests are checked."""
    n = int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = stored(packages.select("path", "bytes").repartition(n, "path")
                  .mapInPandas(read_runs, "path string, start long, lengths array<long>"), "runs")

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for b in batches:
            for path, start, lengths in zip(b["path"], b["start"], b["lengths"]):
                place, base = fs.FileSystem.from_uri(path)
                with place.open_input_file(base) as file:
                    run = file.read_at(int(sum(lengths)), int(start))
                rows, at = [], 0
                for k in lengths:
                    rows.append(parse_record(zlib.decompress(run[at:at + int(k)], wbits=31)))
                    at += int(k)
                out = pd.DataFrame(rows, columns=names, dtype=object)
                yield out if with_payload else out.drop(columns="payload")

    schema = ("page_id long, url string, " + "payload binary, " * with_payload
              + "payload_bytes long, payload_digest string, record_type string, refers_to long")
    return runs.repartition(n, "path", "start").mapInPandas(records, schema)


def archive_round_trip(pages: DataFrame, at_least: int = 0) -> DataFrame:
    """Writes ``pages`` into packages under the shared folder and reads every record back."""
    folder = shared_path(pages.sparkSession, "warc")
    return read_packages(write_packages(pages, folder, at_least))
