"""WARC archives: a writer of one gzip member per record, and a sequential reader.

The reader opens an archive as a stream, inflates member after member incrementally, frames each record by its
Content-Length, and checks block and payload digests; one record is in memory at a time, whatever the archive's size.
A damaged member is reported and skipped. Pages are written as response records, repeats of a payload as revisit records
that name the first page that has it; a revisit's payload digest is held against the response it refers to. Which page is
first is settled on narrow rows (ids and digests); only then do payloads move once, dealt by page, so a payload that
very many pages share is spread like any other.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.plans.storage import Workspace, fresh_path

PREFIX = "urn:page:"
RECORDS = "archive string, record_id string, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to string, payload binary, problems array<string>"
NAMES = [c.split()[0] for c in RECORDS.split(", ")]
DATE = "1970-01-01T00:00:00Z"  # a fixed date, so that a task that runs again writes the same bytes
CHUNK = 1 << 16
#: How a gzip member begins.
MAGIC = b"\x1f\x8b\x08"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass
class Record:
    """One record: its version line, headers (names in lower case) and block."""

    version: str
    headers: dict[str, str]
    block: bytes
    problems: list[str] = field(default_factory=list)

    @property
    def payload(self) -> bytes:
        """Of an HTTP message the body, of other blocks all of it."""
        if self.headers.get("content-type", "").startswith("application/http"):
            return self.block.partition(b"\r\n\r\n")[2]
        return self.block


def record_bytes(headers: dict[str, str], block: bytes, level: int = 6) -> bytes:
    """A record as one gzip member without a time stamp."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    raw = b"WARC/1.1\r\n" + lines.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def members(chunks: Iterable[bytes]) -> Iterator[bytes | ValueError]:
    """The inflated gzip members of a stream that comes in chunks. In place of a damaged or cut one comes an error; reading
    goes on where the next member begins."""
    source = iter(chunks)
    inflate, parts, read = zlib.decompressobj(31), [], bytearray()  # read: the member's bytes so far
    damaged = False
    for chunk in source:
        while chunk:
            read += chunk
            if damaged:  # look for the next beginning; two bytes of one may be here already
                at = read.find(MAGIC)
                if at < 0:
                    del read[:-2]
                    break
                chunk, damaged = bytes(read[at:]), False
                read = bytearray(chunk)
            try:
                parts.append(inflate.decompress(chunk))
            except zlib.error as e:
                yield ValueError(f"damaged gzip member: {e}")
                inflate, parts, damaged = zlib.decompressobj(31), [], True
                chunk, read = bytes(read[1:]), bytearray()
                continue
            chunk = inflate.unused_data
            if inflate.eof:
                yield b"".join(parts)
                inflate, parts, read = zlib.decompressobj(31), [], bytearray()
    if read and not damaged:
        yield ValueError("the archive ends within a gzip member")


def parse_record(raw: bytes) -> Record:
    """Frame one record by its Content-Length and verify its digests; what fails is listed in ``problems``.

    A revisit has its block, the headers of the message, but not its payload; that digest is not of anything here.
    """
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not version.startswith("WARC/"):
        raise ValueError("no WARC record at the start of a gzip member")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    size = headers.get("content-length", "")
    size = int(size) if size.isascii() and size.isdigit() else -1
    record = Record(version, headers, rest[: max(size, 0)])
    if size < 0 or rest[size:] != b"\r\n\r\n":
        record.problems.append("content-length")
    checks = [("warc-block-digest", record.block)]
    if headers.get("warc-type") != "revisit":
        checks.append(("warc-payload-digest", record.payload))
    for name, data in checks:
        given = headers.get(name)
        if given and given != f"sha1:{sha1_base32(data)}":
            record.problems.append(name)
    return record


def read_records(chunks: Iterable[bytes], strict: bool = True) -> Iterator[Record]:
    """The records of an archive, one after another; only one is in memory at a time. A member that is damaged or holds no
    record raises ValueError or, unless ``strict``, gives a record without headers whose one problem says so."""
    for raw in members(chunks):
        try:
            if isinstance(raw, ValueError):
                raise raw
            record = parse_record(raw)
        except ValueError as e:
            if strict:
                raise
            record = Record("", {}, b"", [str(e)])
        yield record


def page_record(page_id: object, url: str | None, payload: bytes, refers_to: object, level: int) -> bytes:
    """The record of a page: a response, or a revisit of the page ``refers_to``."""
    digest = f"sha1:{sha1_base32(payload)}"
    headers = {
        "WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": f"<{PREFIX}{'' if page_id is None else page_id}>", "WARC-Date": DATE, "WARC-Payload-Digest": digest,
        "WARC-Payload-Length": str(len(payload)), "Content-Type": "application/http;msgtype=response",
    }
    if url is not None:
        headers["WARC-Target-URI"] = "".join(url.split("\r")).replace("\n", "")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if refers_to is None:
        block += payload
    else:
        headers |= {"WARC-Refers-To": f"<{PREFIX}{refers_to}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    headers["WARC-Block-Digest"] = f"sha1:{sha1_base32(block)}"
    return record_bytes(headers, block, level)


def with_first_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least_bytes: int = 0, out: str = "__refers_to") -> DataFrame:
    """``pages`` with ``out``: of equal payloads of at least ``least_bytes`` bytes the smallest id, null for that page itself.

    Null html is the empty payload. Rows with a null id refer to the first page like others and are never first
    while another is there.
    """
    payload = F.encode(F.coalesce(F.col(f"`{html_col}`"), F.lit("")), "utf-8")
    sha = F.sha2(payload, 256)
    work = Workspace(pages.sparkSession, "warc")
    ids = work.table("digests", pages.where(F.octet_length(payload) >= least_bytes).select(F.col(f"`{id_col}`").alias("__id"), sha.alias("__sha")))
    first = ids.groupBy("__sha").agg(F.min("__id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = ids.join(first, "__sha").where("refers_to is not null and not (__id <=> refers_to)").distinct()
    again = work.table("revisits", again)
    keyed = pages.withColumn("__key", sha)
    same = keyed[id_col].eqNullSafe(again["__id"]) & (keyed["__key"] == again["__sha"])
    return keyed.join(again, same, "left").select(*(keyed[f"`{c}`"] for c in pages.columns), again["refers_to"].alias(out))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", refers_col: str = "__refers_to", archive_bytes: int = 8 << 20, level: int = 6) -> None:
    """Write rows with ``refers_col`` as .warc.gz files of about ``archive_bytes`` below ``path``.

    A task writes a file under another name and then renames it, so a task that runs again, or twice at once,
    leaves one whole copy of its files. ``path`` is a URI that pyarrow can open from the executors.
    """
    rows = pages.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"),
        F.col(refers_col).alias("refers_to"), F.spark_partition_id().alias("part"),
    )

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        store, root = fs.FileSystem.from_uri(path)
        out, name, size, n, written = None, "", 0, 0, 0

        def close() -> None:
            out.close()
            store.move(name, name.rpartition(".part-")[0])

        for batch in batches:
            for page_id, url, html, refers_to, part in zip(*(batch[c] for c in ("id", "url", "html", "refers_to", "part")), strict=True):
                if out is None:
                    name = f"{root}/pages-{part:06d}-{n:04d}.warc.gz.part-{uuid.uuid4().hex}"
                    out, size, n = store.open_output_stream(name, compression=None), 0, n + 1
                none = page_id is None or page_id != page_id
                data = page_record(None if none else int(page_id), url, html.encode("utf-8", "replace"), None if refers_to is None or refers_to != refers_to else int(refers_to), level)
                out.write(data)
                size, written = size + len(data), written + 1
                if size >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pd.DataFrame({"n": [written]})

    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(root, recursive=True)
    # ids as exact integers: a nullable long would come to pandas as a float
    exact = rows.withColumns({"id": F.col("id").cast("string"), "refers_to": F.col("refers_to").cast("string")})
    exact.mapInPandas(write, "n long").agg(F.sum("n")).collect()


def _opened(path: str):
    """A file of any file system that pyarrow knows, as a stream of its bytes as they are."""
    store, name = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return store.open_input_stream(name, compression=None)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the .warc.gz files below ``path``, in the order of each archive.

    Columns: archive, record_id, record_type, target_uri, payload_digest (bare), payload_bytes, refers_to (record id of a
    revisit), payload (null of revisits), problems (what did not verify; empty if all did). A damaged member gives a row
    whose problems say so, and nulls. Spark lists the files and deals them out; tasks read them in chunks.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("path")

    def read(batches: Iterator) -> Iterator[pd.DataFrame]:
        for archive in (a for batch in batches for a in batch["path"]):
            rows, held = [], 0
            with _opened(archive) as stream:
                for r in read_records(iter(lambda: stream.read(CHUNK), b""), strict=False):  # noqa: B023  used at once
                    h = r.headers
                    revisit = h.get("warc-type") == "revisit"
                    size = h.get("warc-payload-length", "") if revisit else str(len(r.payload))
                    size = int(size) if size.isascii() and size.isdigit() else None
                    told = lambda k: h.get(k, "").strip("<>") or None  # noqa: B023, E731
                    rows.append((archive, told("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-payload-digest", "").removeprefix("sha1:") or None, size if h else None, told("warc-refers-to"), r.payload if h and not revisit else None, r.problems))
                    held += len(r.block)
                    if held > 16 << 20:
                        yield pd.DataFrame(rows, columns=NAMES)
                        rows, held = [], 0
            yield pd.DataFrame(rows, columns=NAMES)

    return files.mapInPandas(read, RECORDS)


def check_revisits(records: DataFrame) -> DataFrame:
    """``records`` with the problem "warc-refers-to" for revisits whose response is missing, or has another payload.

    Revisits are compared as distinct triples of reference, digest and size, combined before they are shuffled, so a
    response that very many pages refer to is one row per task.
    """
    key = ["refers_to", "payload_digest", "payload_bytes"]
    asked = records.where("record_type = 'revisit'").select(*key).distinct()
    there = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    bad = Workspace(records.sparkSession, "warc").table("bad-revisits", asked.join(there, key, "left_anti"))
    if bad.isEmpty():
        return records
    wrong = bad.select(*(F.col(c).alias(f"__{c}") for c in key))
    same = (F.col("record_type") == "revisit") & records["refers_to"].eqNullSafe(wrong["__refers_to"]) & records["payload_digest"].eqNullSafe(wrong["__payload_digest"]) & records["payload_bytes"].eqNullSafe(wrong["__payload_bytes"])
    problems = F.when(F.col("__bad"), F.array_append("problems", F.lit("warc-refers-to"))).otherwise(F.col("problems"))
    return records.join(wrong.withColumn("__bad", F.lit(True)), same, "left").withColumn("problems", problems).select(*records.columns)


def round_trip(pages: DataFrame, least_bytes: int = 0, level: int = 6, **columns) -> DataFrame:
    """Write ``pages`` to new archives in the shared folder and read them back; see :func:`read_archives`.

    Every row gives a record, repeated rows too. Null html is the empty payload, a payload of any length is one record;
    columns but id, url and html are not read, whatever their names. An empty table gives no rows.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc-archives")
    marked = with_first_pages(pages, least_bytes=least_bytes, **{k: v for k, v in columns.items() if k != "url_col"})
    write_archives(marked, path, level=level, **columns)
    return read_archives(spark, path)


def page_rows(records: DataFrame) -> DataFrame:
    """Records of pages as rows: page_id, payload_bytes, payload_digest, record_type, refers_to. The archives are read
    once; revisits are held against their responses. A record that does not verify raises."""
    narrow = Workspace(records.sparkSession, "warc").table("records", records.drop("payload"))
    page = lambda c: F.nullif(F.substring_index(c, PREFIX, -1), F.lit("")).cast("long")
    wrong = F.concat(F.lit("record does not verify: "), F.coalesce("record_id", "archive"), F.lit(" "), F.array_join("problems", ", "))
    sound = F.when(F.size("problems") == 0, F.col("payload_digest")).otherwise(F.raise_error(wrong))
    return check_revisits(narrow).select(page("record_id").alias("page_id"), "payload_bytes", sound.alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))
