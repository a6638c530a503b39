"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames and, behind them, a seek table: a skippable
frame with the compressed and the plain size of each, so that a reader finds any frame from the
end of the file.  Records are grouped into frames of about ``FRAME`` bytes (a longer record has a
frame of its own), and an index table maps each record identifier to its bundle, frame and offset
within the frame.  Reading one record opens one frame.

Of records with equal payloads of at least ``LEAST`` bytes one, that with the smallest key, is a
``response``; the others are ``revisit`` records without payload that refer to it.  Payloads move
only where their digest may belong to such a group (a table of digest slots of a fixed size tells),
and then one per group and task; the digests decide, on all rows.

Each task writes files under names of its own and hands on their index entries, of which Spark
keeps those of one attempt per task.  Files of other attempts are in no index; ``sweep`` removes
them.

Cases: a null payload is empty; keys may be null or repeat (nulls come last, and of equal rows one
is the response, the others revisit it); a null address has no header; line ends in an address
are written as ``%0D`` and ``%0A``; an empty table gives no bundle; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import Stored, query, release, scratch, table
from shelfspark.operators.keyed import attach_by_key

LEAST = 100
FRAME = 1 << 18         # plain bytes after which a frame ends
BUNDLE = 1 << 27        # compressed bytes after which a task begins another file
SLOTS = 1 << 20         # slots of digests that occur more than once; the table never has more rows
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")       # name space of addresses (RFC 4122)
# magic numbers of the seekable format
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "record_id string, bundle string, frame int, offset long, length long"


def place(path: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path of a folder or file, local or remote."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pa.fs.FileSystem.from_uri(path)


# --- seekable files ------------------------------------------------------------------------------

class Bundle:
    """Writes one file: ``add`` puts a record into the current frame and tells (frame, offset)."""

    def __init__(self, path: str, frame: int = FRAME):
        fs, inner = place(path)
        self.limit = frame
        self.path, self.out = path, fs.open_output_stream(inner, compression=None)
        self.packer = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.frames: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.plain = self.written = 0

    def add(self, record: bytes) -> tuple[int, int]:
        if self.held and self.plain + len(record) > self.limit:
            self.end_frame()
        at = (len(self.frames), self.plain)
        self.held.append(record)
        self.plain += len(record)
        return at

    def end_frame(self) -> None:
        if self.held:
            packed = self.packer.compress(b"".join(self.held))
            self.out.write(packed)
            self.frames.append((len(packed), self.plain))
            self.written += len(packed)
            self.held, self.plain = [], 0

    def close(self) -> None:
        self.end_frame()
        body = b"".join(struct.pack("<II", *sizes) for sizes in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.out.close()


class Reader:
    """Reads frames of one file by number."""

    def __init__(self, path: str):
        fs, inner = place(path)
        self.file = fs.open_input_file(inner)
        end = self.file.size()
        count, descriptor, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        width = 12 if descriptor & 0x80 else 8
        size = count * width + 9
        lead = struct.unpack("<II", self.file.read_at(8, end - size - 8))
        if magic != SEEKABLE or lead != (SKIPPABLE, size):
            raise ValueError(f"{path} has no seek table")
        raw = self.file.read_at(count * width, end - size)
        self.frames, at = [], 0
        for i in range(count):
            packed, plain = struct.unpack_from("<II", raw, i * width)
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, number: int) -> bytes:
        at, packed, plain = self.frames[number]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=plain)


# --- records -------------------------------------------------------------------------------------

def record_id(digest: str, key: str) -> str:
    """Identifier of the response that holds a payload, known to all that refer to it."""
    return uuid.uuid5(SPACE, f"response {digest} {key}").urn


def warc_record(kind: str, name: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}",
             *[f"{k}: {v}" for k, v in headers], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(record: memoryview | bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case, without angle brackets around identifiers) and block."""
    raw = bytes(record)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    fields = {k.lower(): v[1:-1] if v[:1] == "<" and v[-1:] == ">" else v for k, v in fields.items()}
    return fields, rest[:int(fields["content-length"])]


def _written(folder: str, frame: int):
    """Writes (key, url, digest, refers_key, payload) rows; a null payload stands for a revisit."""
    def made(key, url, digest, first, payload):
        headers = [("Page-Key", key)] if key is not None else []
        if url is not None:
            headers.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
        headers.append(("WARC-Payload-Digest", f"sha256:{digest}"))
        headers.append(("Content-Type", "application/http;msgtype=response"))
        if payload is None:
            name, kind = uuid.uuid4().urn, "revisit"
            headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{record_id(digest, str(first))}>")]
            block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        else:
            name, kind = record_id(digest, str(key)), "response"
            block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
        return name, warc_record(kind, name, headers, block)

    def run(batches):
        bundle = None
        for batch in batches:
            found = []
            columns = [batch.column(c).to_pylist() for c in ("key", "url", "digest", "refers_key")]
            payloads = batch.column("payload")
            for i, (key, url, digest, first) in enumerate(zip(*columns)):
                if bundle is None:
                    bundle = Bundle(f"{folder}/{uuid.uuid4().hex}.warc.zst", frame)
                    bundle.add(warc_record("warcinfo", uuid.uuid4().urn, [("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                payload = payloads[i].as_buffer().to_pybytes() if payloads[i].is_valid else None
                name, record = made(key, url, digest, first, payload)
                found.append((name, bundle.path, *bundle.add(record), len(record)))
                if bundle.written >= BUNDLE:
                    bundle.close()
                    bundle = None
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*found) if found else [()] * 5, (
                pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()))], ["record_id", "bundle", "frame", "offset", "length"])
        if bundle is not None:
            bundle.close()
        release()
    return run


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST,
                   frame: int = FRAME) -> DataFrame:
    """Writes a record for every row into bundles under ``folder`` and its index to ``folder``/index;
    returns the index."""
    spark = pages.sparkSession
    fs, inner = place(f"{folder.rstrip('/')}/bundles")
    fs.create_dir(inner, recursive=True)
    rows = pages.select(F.col(key).cast("string").alias("key"), F.col(key).alias("order"), F.col(url).cast("string").alias("url"),
                        F.encode(F.coalesce(payload, F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = F.struct(F.col("order").isNull().alias("none"), F.col("order"), F.col("url"))
    slim = Stored(rows.where(F.octet_length("payload") >= least).select("digest", first.alias("at"), "key", "url"), "digests")
    groups = Stored(slim.read().groupBy("digest").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1"), "groups")
    # slots of the digests that occur more than once: at most SLOTS rows, whatever the input
    slot = F.conv(F.substring("digest", 1, 5), 16, 10).cast("int")
    slots = F.broadcast(groups.read().select(slot.alias("slot")).distinct())
    sized = rows.withColumn("slot", F.when(F.octet_length("payload") >= least, slot).otherwise(-1))
    alone = sized.join(slots, "slot", "left_anti").select("key", "url", "digest", "payload")
    # of the rest one payload per digest, that of the smallest key, reduced before it is shuffled
    shared = (sized.join(slots, "slot", "left_semi").withColumn("at", first).groupBy("digest")
              .agg(F.min_by(F.struct("key", "url", "payload"), "at").alias("row"))
              .select("row.key", "row.url", "digest", "row.payload"))
    copies = attach_by_key(slim.read(), groups.read(), "digest", "copies").where(F.col("copies").isNotNull())
    # rows equal to the first in key and address: one of them is the response, written above
    equal = copies.where(F.col("at").eqNullSafe(F.col("first")))
    again = equal.withColumn("nth", F.row_number().over(Window.partitionBy("digest").orderBy("key"))).where("nth > 1").drop("nth")
    revisits = copies.where(~F.col("at").eqNullSafe(F.col("first"))).unionByName(again)
    none = F.lit(None).cast("string")
    records = (alone.withColumn("refers_key", none).unionByName(shared.withColumn("refers_key", none))
               .unionByName(revisits.select("key", "url", "digest", F.coalesce(F.col("first.order").cast("string"), F.lit("None")).alias("refers_key"))
                            .withColumn("payload", F.lit(None).cast("binary"))))
    records.mapInArrow(_written(f"{folder.rstrip('/')}/bundles", frame), INDEX).write.parquet(f"{folder.rstrip('/')}/index")
    slim.drop()
    groups.drop()
    return spark.read.schema(INDEX).parquet(f"{folder.rstrip('/')}/index")


def _read(check: bool):
    """Records of (bundle, frame, offset, length) rows that come sorted by bundle and frame."""
    def run(batches):
        path = number = reader = plain = None
        for batch in batches:
            found = []
            for name, bundle, frame, offset, length in zip(*[batch.column(c).to_pylist() for c in ("record_id", "bundle", "frame", "offset", "length")]):
                if bundle != path:
                    reader, path, number = Reader(bundle), bundle, None
                if frame != number:
                    plain, number = memoryview(reader.frame(frame)), frame
                headers, block = parsed(plain[offset:offset + length])
                if headers["warc-record-id"] != name:
                    raise ValueError(f"{bundle}: another record than {name} at {frame}, {offset}")
                payload = block.partition(b"\r\n\r\n")[2] if headers["warc-type"] == "response" else None
                digest = headers["warc-payload-digest"].removeprefix("sha256:")
                if payload is not None and check and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"{name}: payload and digest differ")
                found.append((name, headers["warc-type"], headers.get("page-key"), headers.get("warc-target-uri"), digest, headers.get("warc-refers-to"), payload))
                if len(found) == 100:
                    yield _batch(found)
                    found = []
            if found:
                yield _batch(found)
        release()
    return run


RECORD = "record_id string, record_type string, key string, url string, digest string, refers_id string, payload binary"


def _batch(found):
    kinds = [pa.string()] * 6 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*found), kinds)], [f.split()[0] for f in RECORD.split(", ")])


def read_archives(index: DataFrame, check: bool = True) -> DataFrame:
    """The records of an index, or of some of its rows: identifier, type, key, address, payload
    digest, the record referred to, and the payload (null for revisits).  Frames are dealt to the
    tasks by (bundle, stretch of frames), so that a large bundle is read by many."""
    placed = index.withColumn("stretch", F.floor(F.col("frame") / 16)).repartition("bundle", "stretch")
    return placed.sortWithinPartitions("bundle", "frame", "offset").drop("stretch").mapInArrow(_read(check), RECORD)


def lookup(index: DataFrame, identifiers: DataFrame) -> DataFrame:
    """The records with the given identifiers (column record_id)."""
    return read_archives(index.join(identifiers.select("record_id").distinct(), "record_id"))


def sweep(folder: str, index: DataFrame) -> None:
    """Removes bundles that no index row names: files of attempts that were lost.
    Empty files, which Spark does not list, stay."""
    spark = index.sparkSession
    name = F.substring_index("path", "/", -1)
    present = spark.read.format("binaryFile").load(f"{folder.rstrip('/')}/bundles").select("path", name.alias("name"))
    used = index.select(F.substring_index("bundle", "/", -1).alias("name")).distinct()

    def remove(rows):
        for row in rows:
            fs, inner = place(row.path)
            fs.delete_file(inner)
    present.join(used, "name", "left_anti").foreachPartition(remove)


SQL = f"""
WITH sized AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM sized)
SELECT page_id, payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN payload_bytes >= {LEAST} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST} AND page_id <> first THEN first END AS refers_to
FROM firsts
"""


@query("op12_archives", SQL)
def op12_archives(spark, folder):
    """Every page written into bundles, which are then read back: what the records say."""
    pages = table(spark, folder, "pages")
    into = scratch(spark, "archives")
    back = read_archives(write_archives(pages, into))
    kind = pages.schema["page_id"].dataType
    found = Stored(back.select("record_id", "record_type", F.col("key").cast(kind).alias("page_id"), F.octet_length("payload").cast("long").alias("own_bytes"),
                               F.col("digest").alias("payload_digest"), "refers_id"), "records")
    rows = found.read()
    # what a revisit refers to: responses that are referred to, with the number of those that do
    named = rows.where("refers_id is not null").groupBy("refers_id").agg(F.count(F.lit(1)).alias("times"))
    named = named.join(rows.where("record_type = 'response'").select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"),
                                                                  F.col("own_bytes").alias("their_bytes")), "refers_id")
    return (attach_by_key(rows, named, "refers_id", "times")
            .select("page_id", F.coalesce("own_bytes", "their_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"))
