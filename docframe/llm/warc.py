"""WARC archives: writing, normalising of monolithic gzip files, reading back by index.

A monolithic archive is one gzip stream over all its records, which nothing can enter in the
middle.  The normaliser inflates it once, writes every record as a gzip member of its own, and
writes a sidecar index with the place of each, so that any record can be read alone.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_lookup, materialize, scratch_path, small_batches

#: Payloads below this many bytes are always stored in full.
REVISIT_BYTES = 1000
#: A new archive begins when one holds this many bytes of records.
ARCHIVE_BYTES = 64 << 20
LEVEL, BLOCK = 3, 1 << 18
#: Most tasks among which the archives are dealt.
TASKS = 20_000
_GZIP = 16 + zlib.MAX_WBITS


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record.  A revisit has no payload; its headers keep the full payload's size and digest."""
    sha = base64.b32encode(bytes.fromhex(digest)).decode("ascii")
    target = "".join(c for c in (url or "") if c >= " " and c != "\x7f")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{sha}",
        f"WARC-Payload-Length: {size}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    body = b"" if revisit else payload
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + body + b"\r\n\r\n"


def split_records(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, body, whole record) of every record in a stream of inflated bytes.

    Holds one record and one block.  Raises ValueError where the stream is not WARC or is cut off.
    """
    held = bytearray()
    blocks = iter(stream)

    def more() -> bool:
        block = next(blocks, None)
        if block is None:
            return False
        held.extend(block)
        return True

    while True:
        at = held.find(b"\r\n\r\n")
        while at < 0:
            before = len(held)
            if not more():
                if held.strip():
                    raise ValueError("a WARC record is cut off in its headers")
                return
            at = held.find(b"\r\n\r\n", max(0, before - 3))
        lines = bytes(held[:at]).decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        if not headers.get("content-length", "").isdecimal():
            raise ValueError(f"a WARC record without a length: {lines[0]!r}")
        end = at + 4 + int(headers["content-length"]) + 4
        while len(held) < end:
            if not more():
                raise ValueError("a WARC record is cut off in its body")
        whole = bytes(held[:end])
        if whole[-4:] != b"\r\n\r\n":
            raise ValueError("a WARC record does not end where its length says")
        del held[:end]
        yield headers, whole[at + 4 : -4], whole


def inflate(file: BinaryIO) -> Iterator[bytes]:
    """The bytes of a gzip file, of one member or many, block by block.

    Zero bytes behind the last member are padding.  Raises ValueError if the last member does not
    end, its checksum included, or if anything else stands behind it.
    """
    machine, ended, members = zlib.decompressobj(_GZIP), True, 0
    while data := file.read(BLOCK):
        while data:
            if ended:
                data = data.lstrip(b"\0")
                if not data:
                    break
                machine, ended, members = zlib.decompressobj(_GZIP), False, members + 1
            try:
                out = machine.decompress(data, BLOCK)
            except zlib.error as e:
                raise ValueError(f"not a gzip stream: {e}") from e
            if out:
                yield out
            ended = machine.eof
            data = machine.unused_data if ended else machine.unconsumed_tail
    # what the machine still holds comes with no more input
    while not ended:
        try:
            out = machine.decompress(machine.unconsumed_tail, BLOCK)
        except zlib.error as e:
            raise ValueError(f"not a gzip stream: {e}") from e
        if out:
            yield out
        ended = machine.eof
        if not out and not ended:
            raise ValueError("the gzip stream is cut off")
    if not members:
        raise ValueError("no gzip stream")


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write monolithic archives; one row (archive, records) for each that was finished.

    ``records``: page_id, url, payload, payload_bytes, payload_digest, refers_to, revisit.  Every
    attempt of a task writes files of its own; only those it returns count, so a lost executor
    leaves unused files and no wrong ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        file = machine = None
        name, size, count, done = "", 0, 0, []

        def close() -> None:
            file.write(machine.flush())
            file.close()
            done.append((f"{folder}/{name}", count))

        for batch in batches:
            for row in range(batch.num_rows):
                page, url, payload, n, digest, refers, revisit = (c[row].as_py() for c in batch.columns)
                if file is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    file, machine = system.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(LEVEL, wbits=_GZIP)
                data = record_bytes(page, url, payload or b"", n, digest, refers, revisit)
                file.write(machine.compress(data))
                size, count = size + len(data), count + 1
                if size >= ARCHIVE_BYTES:
                    close()
                    file = None
        if file is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["archive", "records"])

    return records.select("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to", "revisit").mapInArrow(run, "archive string, records long")


def normalise_file(source: str, folder: str) -> tuple[str, str, int]:
    """Rewrite one archive with a member per record; (archive, index, records).

    The index has one JSON line per record: offset, length, type, id and target.
    """
    system, at = _open(source)
    out_system, root = _open(folder)
    out_system.create_dir(root, recursive=True)
    name, offset, count = uuid.uuid4().hex, 0, 0
    archive, index = f"{name}.warc.gz", f"{name}.idx.jsonl"
    with system.open_input_stream(at, compression=None) as file, out_system.open_output_stream(f"{root}/{archive}", compression=None) as out, out_system.open_output_stream(f"{root}/{index}", compression=None) as idx:
        for headers, _, whole in split_records(inflate(file)):
            machine = zlib.compressobj(LEVEL, wbits=_GZIP)
            member = machine.compress(whole) + machine.flush()
            out.write(member)
            line = {"offset": offset, "length": len(member), "type": headers.get("warc-type"), "id": headers.get("warc-record-id"), "target": headers.get("warc-target-uri")}
            idx.write(json.dumps(line).encode("ascii") + b"\n")
            offset, count = offset + len(member), count + 1
    return f"{folder}/{archive}", f"{folder}/{index}", count


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Normalise every file named in column ``archive``: (archive, index, records) of the new ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [normalise_file(x.as_py(), folder) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in ((0, pa.string()), (1, pa.string()), (2, pa.int64()))], ["archive", "index", "records"])

    return archives.select("archive").mapInArrow(run, "archive string, index string, records long")


def read_member(file: pa.NativeFile, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record of a normalised archive, by its place alone."""
    file.seek(offset)
    (headers, body, _), = split_records([zlib.decompress(file.read(length), _GZIP)])
    return headers, body


def _page(text: str | None) -> int | None:
    found = (text or "").removeprefix("<urn:page:").removesuffix(">")
    return int(found) if found not in ("", "null") else None


def read_archives(archives: DataFrame) -> DataFrame:
    """Every record of the normalised archives (archive, index), read through the index.

    A response's payload is measured anew and must have the size and digest of its headers.
    """

    def rows(archive: str, index: str) -> Iterator[tuple]:
        system, at = _open(archive)
        index_system, index_at = _open(index)
        with system.open_input_file(at) as file, index_system.open_input_stream(index_at, compression=None) as lines:
            rest = b""
            while True:
                block = lines.read(BLOCK)
                found = (rest + block).split(b"\n")
                rest = found.pop()
                for line in map(json.loads, found):
                    headers, body = read_member(file, line["offset"], line["length"])
                    size, digest = int(headers["warc-payload-length"]), base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                    if headers["warc-type"] == "response" and (len(body), hashlib.sha1(body).hexdigest()) != (size, digest):
                        raise ValueError(f"{archive}: the payload of {line['id']} is not what its headers say")
                    yield _page(headers["warc-record-id"]), size, digest, headers["warc-type"], _page(headers.get("warc-refers-to"))
                if not block:
                    return

    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held: list[tuple] = []
                for row in rows(archive, index):
                    held.append(row)
                    if len(held) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), types)], names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), types)], names)

    return archives.select("archive", "index").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def plan_records(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Decide response or revisit for every page (page_id, url, html).

    Of the pages with equal payloads of at least ``least`` bytes the one with the largest page_id
    is the response and all others revisit it, those without an id too; if none has an id, all are
    responses.  If rows repeat the largest page_id, the one of the least url (null first) is the
    response.  Null html is an empty payload.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    same = ["payload_digest", "payload_bytes"]
    # ids and digests only are dealt by digest; payloads move once, to their page's revisit
    large = materialize(rows.where(F.col("payload_bytes") >= least).select("page_id", *same), "digests")
    ids = large.groupBy(*same, "page_id").agg(F.count("*").alias("n"))
    firsts = ids.groupBy(*same).agg(F.max("page_id").alias("response"), F.max_by("n", "page_id").alias("copies"), F.sum("n").alias("n")).where("n > 1 and response is not null").select(*same, "response", "copies")
    firsts = materialize(firsts, "firsts")
    named = join_lookup(large, firsts, same)
    own = F.col("page_id").eqNullSafe(F.col("response"))
    revisits = named.where(~own | (F.col("copies") > 1)).select(F.col("page_id").alias("p"), F.col("payload_digest").alias("d"), F.col("response").alias("refers_to"), own.alias("tied")).distinct()
    out = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("payload_digest") == F.col("d")), "left")
    if not firsts.where("copies > 1").isEmpty():
        tied = F.coalesce("tied", F.lit(False))
        nth = F.row_number().over(Window.partitionBy("d", "p").orderBy(F.col("url").asc_nulls_first()))
        numbered = out.where(tied).withColumn("nth", nth).withColumn("refers_to", F.when(F.col("nth") > 1, F.col("refers_to"))).drop("nth")
        out = out.where(~tied).unionByName(numbered)
    revisit = F.col("refers_to").isNotNull()
    return out.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest", "refers_to", revisit.alias("revisit"))


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages to monolithic archives, normalise them and read every record back.

    Returns page_id, payload_bytes, payload_digest (hex SHA-1), record_type and refers_to of each
    record, all taken from the normalised files.  ``folder`` is a URI of storage that all
    executors share (file:, hdfs:, s3:, gs:), by default in the scratch folder.  Repeated rows
    give records of their own; an empty table gives no archive and an empty result.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or scratch_path(spark, "warc")
    written = materialize(write_archives(plan_records(pages), f"{folder}/monolithic"), "archives")
    # a task takes several archives one after the other where there are more of them than TASKS
    n = max(1, min(TASKS, written.count()))
    normal = materialize(normalise(written.repartition(n, "archive"), f"{folder}/normal"), "archives")
    return read_archives(normal.repartition(n, "archive"))
