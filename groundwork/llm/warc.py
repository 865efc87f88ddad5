"""A WARC writer with one Zstandard dictionary per archive, and its reader.

An archive is a skippable frame (magic 0x184D2A5D) that holds a dictionary trained on the archive's own records,
then one Zstandard frame per record. Pages are written where they are dealt: a task groups its rows in archives of
about `archive_bytes`, trains on a bounded part of them, compresses each record alone, and puts the file in the
shared folder under a name of its own attempt. The manifest of archives is checkpointed; only files that it names
count, so a task that is run again or an executor that is lost leaves at most files that nobody reads.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpoint_dir, materialised

MAGIC = 0x184D2A5D
DICTIONARY_BYTES = 64 << 10
#: Bytes of an archive's records that its dictionary is trained on, evenly spread over them.
TRAINING_BYTES = 3 << 20
LEAST_PAYLOAD = 100
#: Bytes given to the decompressor at once, so that what follows a record is not copied for each record.
STEP = 16 << 10
#: The most tasks that archives are dealt to when they are read; more archives make longer tasks.
READERS = 1 << 16


def with_types(pages: DataFrame) -> DataFrame:
    """pages with payload digest, size, record type and, for revisits, the id of the response.

    Groups of equal payloads are found from (digest, least id, count) with partial aggregation; only digests that
    repeat are joined back, by a join that the adaptive planner can split when one of them holds many rows.
    """
    plain = pages.select("page_id", "url", "html").withColumn("_body", F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    plain = plain.select(
        "page_id", "url", F.col("_body").alias("body"),
        F.sha2(F.col("_body"), 256).alias("payload_digest"), F.octet_length("_body").cast("long").alias("payload_bytes"),
    )
    groups = (
        plain.where(F.col("payload_bytes") >= LEAST_PAYLOAD).groupBy("payload_digest")
        .agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select("payload_digest", "_first")
    )
    found = plain.join(groups, "payload_digest", "left")
    revisit = F.coalesce(F.col("page_id") != F.col("_first"), F.lit(False))
    return found.select(
        "page_id", "url", "payload_digest", "payload_bytes",
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(revisit, F.col("_first")).alias("refers_to"),
        F.when(~revisit, F.col("body")).alias("body"),
    )


def record(page_id, url, digest: str, size: int, kind: str, refers_to, body: bytes | None) -> bytes:
    """One WARC/1.1 record; a revisit has no block."""
    block = (body or b"") if kind == "response" else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {size}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head.insert(2, f"WARC-Refers-To: <urn:page:{refers_to}>")
        head.insert(3, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes], level: int = 3) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes of one archive and each record's place in it."""
    import zstandard

    step = max(1, sum(map(len, records)) // TRAINING_BYTES)
    sample = [r[:131072] for r in records[::step]]
    trained, options = b"", {}
    if len(sample) >= 8:
        try:
            made = zstandard.train_dictionary(DICTIONARY_BYTES, sample, k=256, d=8)
            trained, options = made.as_bytes(), {"dict_data": made}
        except zstandard.ZstdError:  # too little material for a dictionary: the frame is then empty
            pass
    out = bytearray(struct.pack("<II", MAGIC, len(trained)) + trained)
    press = zstandard.ZstdCompressor(level=level, **options)
    spans = []
    for r in records:
        frame = press.compress(r)
        spans.append((len(out), len(frame)))
        out += frame
    return bytes(out), spans


def parse(raw: bytes):
    """(page_id, type, digest, payload length, refers_to, block) of every record of an archive, checked."""
    import zstandard

    magic, size = struct.unpack_from("<II", raw)
    if magic != MAGIC:
        raise ValueError("no leading skippable frame")
    options = {"dict_data": zstandard.ZstdCompressionDict(raw[8 : 8 + size])} if size else {}
    at, view = 8 + size, memoryview(raw)
    while at < len(raw):
        unpress, text = zstandard.ZstdDecompressor(**options).decompressobj(), bytearray()
        while not unpress.eof:
            if at >= len(raw):
                raise ValueError("the last record is cut off")
            text += unpress.decompress(view[at : at + STEP])
            at = min(at + STEP, len(raw)) - len(unpress.unused_data)
        yield _fields(bytes(text))


def _fields(text: bytes):
    head, _, rest = text.partition(b"\r\n\r\n")
    lines = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(lines["Content-Length"])]
    number = lambda s: int(s[len("<urn:page:") : -1]) if s and s != "<urn:page:>" else None
    digest, length = lines["WARC-Payload-Digest"].removeprefix("sha256:"), int(lines["WARC-Payload-Length"])
    if lines["WARC-Type"] == "response" and (len(block) != length or hashlib.sha256(block).hexdigest() != digest):
        raise ValueError(f"damaged record {lines['WARC-Record-ID']}")
    return number(lines["WARC-Record-ID"]), lines["WARC-Type"], digest, length, number(lines.get("WARC-Refers-To")), block


_INDEX = "path string, page_id long, position long, size long"


def write(pages: DataFrame, folder: str | None = None, archive_bytes: int = 24 << 20) -> DataFrame:
    """Writes archives for pages(page_id, url, html) and returns their index: path, page_id, position, size.

    Null html is an empty payload and a null url an empty one. Rows that repeat get a record each: with one page_id
    twice and equal payloads both are responses. A row without page_id is a response and no one refers to it.
    """
    where = folder or f"{checkpoint_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    if "://" not in where:  # Spark may name a local folder by path or with one slash
        where = f"file://{where.removeprefix('file:')}"

    def put(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(where)
        store.create_dir(root, recursive=True)
        held, ids, total = [], [], 0

        def flush():
            raw, spans = archive(held)
            name = f"{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{root}/{name}", compression=None) as f:
                f.write(raw)
            return pa.RecordBatch.from_arrays(
                [pa.array([name] * len(ids)), pa.array(ids, pa.int64()), pa.array([s[0] for s in spans], pa.int64()), pa.array([s[1] for s in spans], pa.int64())],
                names=["path", "page_id", "position", "size"],
            )

        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("page_id", "url", "payload_digest", "payload_bytes", "record_type", "refers_to", "body"))):
                held.append(record(*row))
                ids.append(row[0])
                total += len(held[-1])
                if total >= archive_bytes:
                    yield flush()
                    held, ids, total = [], [], 0
        if held:
            yield flush()

    made = materialised(with_types(pages).mapInArrow(put, _INDEX))
    return made.withColumn("path", F.concat(F.lit(f"{where}/"), "path"))


def read(index: DataFrame) -> DataFrame:
    """Every record of the archives that an index names, read back and checked; an empty index gives none."""

    def get(batches):
        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as f:
                    rows = list(parse(f.read()))
                for k in range(0, len(rows), 500):
                    part = list(zip(*rows[k : k + 500]))
                    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(part, kinds)], names=["page_id", "record_type", "payload_digest", "payload_bytes", "refers_to", "body"])

    names = materialised(index.select("path").distinct())
    # the list is short, so its planner would put it in one task; an archive each, until there are very many
    return names.repartition(max(1, min(names.count(), READERS))).mapInArrow(get, "page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, body binary")
