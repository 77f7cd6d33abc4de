"""Web archives: a deterministic sharded WARC writer and the reader of what it wrote."""

from __future__ import annotations

import base64
import hashlib
import itertools
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadweave.llm.salting import salted_join
from threadweave.schema import require_columns
from threadweave.session import cut_lineage

# Fixed: terms of the WARC 1.1 format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RESPONSE, REVISIT = "response", "revisit"

SPLITS = 1024  # ranges an interval of ids is divided into when shards are laid out
CHUNK = 1 << 20
MANIFEST_FIELDS = "shard int, sequence int, name string, temporary string, records bigint, bytes bigint, sha1 string"


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and the path in it; a plain path is local."""
    if folder.startswith("file:/") and not folder.startswith("file:///"):
        folder = "file:///" + folder[len("file:"):].lstrip("/")
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)


def base32_digest(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def record_id(page_id: int | None, payload_digest: str) -> str:
    """The same for the same page and payload in every run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {payload_digest}')}>"


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member without a time stamp."""
    head = [("WARC-Type", kind), *fields, ("WARC-Block-Digest", "sha1:" + base32_digest(hashlib.sha1(block).digest())),
            ("Content-Length", str(len(block)))]
    text = VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(text.encode() + block + b"\r\n\r\n") + press.flush()


def page_record(page_id, url, payload, payload_bytes: int, hex_digest: str, refers_to, archived_at: str) -> bytes:
    """The record of one page: a response with its payload, or a revisit of the page ``refers_to``."""
    digest = base32_digest(bytes.fromhex(hex_digest))
    fields = [("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", archived_at)]
    if url is not None:  # no control characters or line breaks in a header
        fields.append(("WARC-Target-URI", "".join(c if c > " " and c != "\x7f" else "".join(
            f"%{b:02X}" for b in c.encode()) for c in url)))
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    fields += [("WARC-Payload-Digest", "sha1:" + digest), ("X-Payload-Length", str(payload_bytes)),
               ("Content-Type", "application/http; msgtype=response")]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    if refers_to is None:
        return _record(RESPONSE, fields, block + payload.encode())
    fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)),
               ("X-Refers-To-Page-ID", str(refers_to))]
    return _record(REVISIT, fields, block)


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its file system, as Spark would take it, so that tasks write where Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def shard_of(rows: DataFrame, id_column: str, size_column: str, shard_bytes: int) -> tuple[Column, int]:
    """The shard of a row, and how many there are: consecutive id ranges of about ``shard_bytes``, the same in every run.

    Ids are counted in equal ranges; a range heavier than a shard is divided further, until it fits or
    holds one id. The driver sees at most ``SPLITS`` counts for each heavy range.
    """
    low, high = rows.agg(F.min(id_column), F.max(id_column)).first()
    if low is None:
        return F.lit(0), 1
    ranges, heavy = [], [(int(low), int(high))]
    while heavy:
        width_of = [max(1, -(-(b - a + 1) // SPLITS)) for a, b in heavy]
        at = F.lit(None).cast("bigint")
        for k, ((a, b), width) in enumerate(zip(heavy, width_of)):
            at = F.when(F.col(id_column).between(a, b), F.lit(k * SPLITS) + F.floor((F.col(id_column) - F.lit(a)) / width)).otherwise(at)
        found = rows.select(at.alias("at"), size_column).filter("at is not null").groupBy("at").agg(F.sum(size_column).alias("n"))
        parts = []
        for r in found.collect():
            (a, b), width = heavy[r["at"] // SPLITS], width_of[r["at"] // SPLITS]
            start = a + r["at"] % SPLITS * width
            parts.append((start, min(b, start + width - 1), r["n"] or 0))
        heavy = [(a, b) for a, b, n in parts if n > shard_bytes and b > a]
        ranges += [(a, b, n) for a, b, n in parts if n <= shard_bytes or b == a]
    starts, filled = [], 0
    for a, _, n in sorted(ranges):
        if starts and filled + n > shard_bytes:
            starts.append(a)
            filled = 0
        elif not starts:
            starts.append(a)
        filled += n
    bounds = F.array(*[F.lit(s).cast("bigint") for s in starts[1:]]) if len(starts) > 1 else F.expr("cast(array() as array<bigint>)")
    return F.coalesce(F.size(F.filter(bounds, lambda s: s <= F.col(id_column))), F.lit(0)), len(starts)


def archive_pages(
    pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html",
    revisit_from: int = 0, shard_bytes: int = 32 << 20, file_bytes: int = 64 << 20,
    archived_at: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Write pages as WARC files in ``folder`` and return the manifest of the files.

    The library's posts hold no web pages, so this takes any table with an integer id, a url and a
    payload text. Of pages with equal payloads of at least ``revisit_from`` bytes the one with the smallest id
    is a response and the others are revisits of it; all smaller ones are responses.

    Records are laid out in consecutive id ranges (shards) and sorted by id in them; a shard rolls to a
    new file once ``file_bytes`` compressed bytes are reached, so equal tables give equal files, byte by
    byte. Headers, digests, lengths and record ids are made anew from the payload. Tasks write under
    temporary names of their own; only the files whose task succeeded are named in the manifest,
    renamed to their final names, and then listed in ``folder/manifest``, which readers go by. A repeated
    task leaves nothing but unnamed temporary files. ``folder`` must be shared by all executors.

    Null payload: empty. Null url: no target header. Null id: in the first shard, without an id header;
    among equal payloads it revisits the smallest id, and is a response if none has an id. Repeated rows
    stay; those with the smallest id of their payload are all responses. Other columns are not read. An
    empty table gives an empty manifest.
    """
    require_columns(pages, [id_column, url_column, payload_column], "pages")
    folder = qualified(pages.sparkSession, folder)
    payload = F.coalesce(F.col(payload_column).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_column).cast("bigint").alias("page_id"), F.col(url_column).cast("string").alias("url"),
        payload.alias("payload"), F.octet_length(payload).cast("bigint").alias("payload_bytes"),
        F.sha1(payload.cast("binary")).alias("digest"),
    )
    facts = cut_lineage(rows.select("page_id", "payload_bytes", "digest"))
    shared = (
        facts.filter(F.col("payload_bytes") >= revisit_from).groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first_id is not null")
        .select("digest", "first_id")
    )
    # Payloads are shuffled once: which page is a revisit travels as narrow rows to the same shard, each
    # sorted right before the page it is about.
    revisits = salted_join(facts, shared, ["digest"], ["page_id"]).filter(~F.col("page_id").eqNullSafe(F.col("first_id"))).select(
        "page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("payload"), "payload_bytes",
        "digest", F.col("first_id").alias("refers_to"),
    )
    shard, n_shards = shard_of(facts, "page_id", "payload_bytes", shard_bytes)
    laid_out = (
        rows.withColumn("refers_to", F.lit(None).cast("bigint")).unionByName(revisits).select("*", shard.alias("shard"))
        .repartition(n_shards, "shard")
        .sortWithinPartitions("shard", "page_id", "digest", F.col("refers_to").asc_nulls_last(), "url")
    )
    manifest = cut_lineage(laid_out.mapInArrow(_writer(folder, file_bytes, archived_at), MANIFEST_FIELDS))
    committed = cut_lineage(manifest.repartition(max(1, manifest.count()), "name").mapInArrow(_committer(folder), MANIFEST_FIELDS))
    listed = committed.drop("temporary")
    listed.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")
    return listed


def _writer(folder: str, file_bytes: int, archived_at: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        attempt = uuid.uuid4().hex
        done: list[dict] = []
        shard, sequence, out, entry, seen = None, 0, None, None, None

        def close():
            nonlocal out
            if out is not None:
                out.close()
                entry["sha1"] = seen.hexdigest()
                done.append(entry)
                out = None

        def put(data: bytes):
            out.write(data)
            seen.update(data)
            entry["bytes"] += len(data)

        revisit = None
        names = ("shard", "page_id", "url", "payload", "payload_bytes", "digest", "refers_to")
        for batch in batches:
            for row in zip(*(batch.column(n) for n in names)):
                at, page_id, url, payload, size, digest, refers_to = (v.as_py() for v in row)
                if refers_to is not None:
                    revisit = page_id, digest, refers_to
                    continue
                refers_to = revisit[2] if revisit and revisit[:2] == (page_id, digest) else None
                if at != shard:
                    close()
                    shard, sequence = at, 0
                if out is None:
                    name = f"pages-{shard:06d}-{sequence:05d}.warc.gz"
                    temporary = f"_temporary/{attempt}/{name}"
                    system.create_dir(f"{base}/_temporary/{attempt}", recursive=True)
                    out, seen = system.open_output_stream(f"{base}/{temporary}", compression=None), hashlib.sha1()
                    entry = {"shard": shard, "sequence": sequence, "name": name, "temporary": temporary, "records": 0, "bytes": 0}
                    put(_record("warcinfo", [
                        ("WARC-Record-ID", record_id(None, name)), ("WARC-Date", archived_at), ("WARC-Filename", name),
                        ("Content-Type", "application/warc-fields"),
                    ], b"format: WARC File Format 1.1\r\n"))
                put(page_record(page_id, url, payload, size, digest, refers_to, archived_at))
                entry["records"] += 1
                if entry["bytes"] >= file_bytes:
                    close()
                    sequence += 1
        close()
        yield pa.RecordBatch.from_pylist(done, MANIFEST_SCHEMA)

    return write


MANIFEST_SCHEMA = pa.schema([
    ("shard", pa.int32()), ("sequence", pa.int32()), ("name", pa.string()), ("temporary", pa.string()),
    ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string()),
])


def _committer(folder: str):
    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                source, target = f"{base}/{row['temporary']}", f"{base}/{row['name']}"
                if system.get_file_info(source).type == pafs.FileType.File:
                    system.move(source, target)
                # A repeated task finds the file in place already.
                if system.get_file_info(target).size != row["bytes"]:
                    raise OSError(f"{row['name']} is not complete")
            yield batch

    return commit


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, each decompressed on its own."""
    press, parts, data = zlib.decompressobj(31), [], b""
    while True:
        data = data or stream.read(CHUNK)
        if not data:
            break
        parts.append(press.decompress(data))
        data = press.unused_data
        if press.eof:
            yield b"".join(parts)
            press, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the archive ends inside a record")


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the block, whose length and digest are verified."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(headers["content-length"])]
    if len(block) != int(headers["content-length"]) or headers["warc-block-digest"] != "sha1:" + base32_digest(hashlib.sha1(block).digest()):
        raise ValueError("a record's block is damaged")
    return headers, block


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """The page records of the files in the folder's manifest.

    ``page_id, url, record_type, payload_digest, payload_bytes, refers_to`` (the id of the response a
    revisit stands for), and ``payload`` (null for revisits) if asked for. Block and payload digests are
    verified; a damaged record fails. One task reads one file at a time, record by record.
    """
    fields = "page_id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint"
    fields += ", payload string" if with_payload else ""
    names = [f.split()[0] for f in fields.split(", ")]
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    schema = pa.schema([(n, kinds[f.split()[1]]) for n, f in zip(names, fields.split(", "))])

    def rows_of(system, path: str) -> Iterator[dict]:
        with system.open_input_stream(path, compression=None) as stream:
            for raw in members(stream):
                headers, block = parse_record(raw)
                if headers["warc-type"] == "warcinfo":
                    continue
                digest = headers["warc-payload-digest"].removeprefix("sha1:")
                payload = block.partition(b"\r\n\r\n")[2] if headers["warc-type"] == RESPONSE else None
                if payload is not None and base32_digest(hashlib.sha1(payload).digest()) != digest:
                    raise ValueError(f"payload of page {headers.get('x-page-id')} is damaged")
                number = lambda key: int(headers[key]) if key in headers else None
                yield {
                    "page_id": number("x-page-id"), "url": headers.get("warc-target-uri"), "record_type": headers["warc-type"],
                    "payload_digest": digest, "payload_bytes": number("x-payload-length") if payload is None else len(payload),
                    "refers_to": number("x-refers-to-page-id"),
                    **({"payload": None if payload is None else payload.decode()} if with_payload else {}),
                }

    folder = qualified(spark, folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                found = rows_of(system, f"{base}/{name}")
                while part := list(itertools.islice(found, 256)):
                    yield pa.RecordBatch.from_pylist(part, schema)

    files = spark.read.parquet(f"{folder}/manifest").select("name")
    return files.repartition(max(1, files.count()), "name").mapInArrow(read, fields)
