"""WARC archives in Zstandard: a writer, and a reader that checks what it reads.

An archive begins with a skippable frame that holds its dictionary; then comes one frame for each record. Archives hold
about ARCHIVE_BYTES of records, so a task holds one archive at a time. Each attempt of a task writes files of its own
name in the shared folder; the manifest, a table, names those of the attempts that succeeded, and only they are read.

Defined results: a null payload is empty; rows that repeat the smallest page_id of their payload are all responses; a null
page_id is never the smallest and comes back as null; a null URL is left out of the record. Records that fail a check come
back with `error` set.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.shared import new_path, written

#: Fixed values of the formats: magic numbers of a dictionary's skippable frame and of a Zstandard frame.
SKIPPABLE, FRAME = b"\x5d\x2a\x4d\x18", b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
ARCHIVE_BYTES = 8 << 20
DICTIONARY_BYTES = 16 << 10
#: The dictionary of an archive is trained on its first records, up to so many bytes.
SAMPLE_BYTES = 1 << 20
NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string, payload binary, error string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, first) -> bytes:
    """One record: a revisit without payload if `first` names another page, else a response."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    own = "" if page_id is None else int(page_id)
    revisit = first is not None and first != page_id
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{own}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{int(first)}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """The bytes of one archive; without a dictionary if the records are too few or too small to train one."""
    sample, total = [], 0
    for x in records:
        if total >= SAMPLE_BYTES:
            break
        sample.append(x[: 64 << 10])
        total += len(sample[-1])
    try:
        known = zstandard.train_dictionary(DICTIONARY_BYTES, sample) if len(sample) >= 8 else None
    except zstandard.ZstdError:
        known = None
    packer = zstandard.ZstdCompressor(level=3, dict_data=known, write_content_size=True, write_checksum=True)
    parts = []
    if known:
        stored = zstandard.ZstdCompressor().compress(known.as_bytes())
        parts.append(SKIPPABLE + struct.pack("<I", len(stored)) + stored)
    return b"".join(parts + [packer.compress(x) for x in records])


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _save(folder: str, records: list[bytes]) -> tuple[str, int]:
    store, path = _files(folder)
    store.create_dir(path, recursive=True)
    name = f"part-{uuid.uuid4().hex}.warc.zst"
    with store.open_output_stream(f"{path}/{name}") as out:
        out.write(archive(records))
    return f"{folder}/{name}", len(records)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """pages: (page_id, url, payload binary, first). Returns the manifest, already written: (archive, records)."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, total, done = [], 0, []
        for b in batches:
            for p, u, x, f in zip(b.page_id.astype(object), b.url, b.payload, b["first"].astype(object)):
                held.append(record(None if pd.isna(p) else int(p), u, x, None if pd.isna(f) else int(f)))
                total += len(held[-1])
                if total >= ARCHIVE_BYTES:
                    done.append(_save(folder, held))
                    held, total = [], 0
        if held:
            done.append(_save(folder, held))
        yield pd.DataFrame(done, columns=["archive", "records"])

    return written(pages.mapInPandas(write, "archive string, records long"), "manifest")


def frames(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The decompressed frames of an archive, one at a time; loads the dictionary first, if there is one."""
    data = stream.read(chunk)
    known = None
    if data[:4] == SKIPPABLE:
        size = struct.unpack("<I", data[4:8])[0]
        while len(data) < 8 + size:
            more = stream.read(chunk)
            if not more:
                raise ValueError("dictionary cut short")
            data += more
        stored, data = data[8 : 8 + size], data[8 + size :]
        known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(stored) if stored[:4] == FRAME else stored)
    unpacker = zstandard.ZstdDecompressor(dict_data=known)
    while data or (data := stream.read(chunk)):
        one, parts = unpacker.decompressobj(), []
        while True:
            parts.append(one.decompress(data))
            if one.eof:
                data = one.unused_data
                break
            if not (data := stream.read(chunk)):
                raise ValueError("frame cut short")
        yield b"".join(parts)


def parse(raw: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, uri, payload, error) of one record."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
    error = None
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        error = "no WARC header"
    elif missing := [x for x in NEEDED if x not in fields]:
        error = f"without {missing[0]}"
    elif not fields["Content-Length"].isdigit() or len(rest) != int(fields["Content-Length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        error = "wrong length"
    if error:
        return None, None, None, fields.get("WARC-Type"), None, fields.get("WARC-Target-URI"), None, error
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    sizes = [x.split(b":", 1)[1].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    revisit, said = fields["WARC-Type"] == "revisit", fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    if not gap or not sizes or not sizes[0].isdigit():
        error = "no HTTP header"
    elif revisit and (payload or "WARC-Refers-To" not in fields):
        error = "a revisit with a payload, or of nothing"
    elif not revisit and (len(payload) != int(sizes[0]) or digest(payload) != said):
        error = "payload doesn't match its length or digest"
    page = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
    size = int(sizes[0]) if sizes and sizes[0].isdigit() else None
    return page(fields["WARC-Record-ID"]), size, said, fields["WARC-Type"], page(fields["WARC-Refers-To"]) if revisit else None, fields.get("WARC-Target-URI"), None if revisit else payload, error


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """manifest: (archive, ...). One row for each record (RECORDS); without payloads if they aren't asked for."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in RECORDS.split(", ")]
        for b in batches:
            for name in b.archive:
                store, path = _files(name)
                with store.open_input_stream(path) as stream:
                    rows, total = [], 0
                    for raw in frames(stream):
                        rows.append(parse(raw))
                        if not payloads:
                            rows[-1] = (*rows[-1][:6], None, rows[-1][7])
                        total += len(raw) if payloads else 200
                        if total >= ARCHIVE_BYTES:
                            yield _frame(rows, columns)
                            rows, total = [], 0
                    if rows:
                        yield _frame(rows, columns)

    n = max(1, manifest.count())
    return manifest.select("archive").repartition(n).mapInPandas(read, RECORDS)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    return out.astype({x: "Int64" for x in ("page_id", "payload_bytes", "refers_to")})


def deduplicated(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, first): `first` is the smallest page_id of the rows whose payload is the same, where it has
    min_bytes at least. Digests are grouped without their payloads; a payload that many rows share is one group of ids."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("sha", F.sha1("payload"))
    firsts = p.where(F.length("payload") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return p.join(firsts, "sha", "left").select("page_id", "url", "payload", "first")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the pages as archives and reads the records back, without payloads; a record that fails a check ends the job."""
    folder = new_path(pages.sparkSession, "warc")
    read = read_archives(write_archives(deduplicated(pages, min_bytes), folder), payloads=False)
    return read.where(F.when(F.col("error").isNull(), F.lit(True)).otherwise(F.raise_error(F.col("error")).cast("boolean")))
