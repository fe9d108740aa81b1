"""WARC archives: an index of every record first, then coalesced byte-range reads of the selected ones."""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.stored import stored
from siltstone.sources.scratch import shared_folder

END = "\r\n\r\n"
TEXT, NUMBER = pa.string(), pa.int64()
INDEX = pa.schema([("file", TEXT), ("offset", NUMBER), ("length", NUMBER), ("id", TEXT), ("url", TEXT), ("digest", TEXT), ("type", TEXT), ("refers_to", TEXT)])
RECORD = pa.schema([("id", TEXT), ("url", TEXT), ("type", TEXT), ("refers_to", TEXT), ("named", TEXT), ("bytes", NUMBER), ("digest", TEXT), ("payload", pa.binary())])
DATE = "1970-01-01T00:00:00Z"
BITS = 23
HEADER_READ = 64 << 10
READ_BYTES = 8 << 20
GAP_BYTES = 64 << 10


def sha1_base32(data):
    """Bare upper-case base32 of a SHA-1: eight times five hex digits make four letters each."""
    hex_digest = F.sha1(data)
    letter = lambda five, shift: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), (F.shiftright(five, shift).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))
    parts = []
    for i in range(8):
        five = F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 10).cast("long")
        parts += [letter(five, shift) for shift in (15, 10, 5, 0)]
    return F.concat(*parts)


def _http():
    return F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))


def _head():
    """A record's text up to its payload, from id, url, digest, bytes, type and refers_to."""
    url = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20"), F.lit("urn:unknown"))
    block = F.octet_length(_http()) + F.when(F.col("type") == "response", F.col("bytes")).otherwise(0)
    revisit = F.when(F.col("type") == "revisit", F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))).otherwise(F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("type"), F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("none")), F.lit(">\r\nWARC-Date: "), F.lit(DATE),
        F.lit("\r\nWARC-Target-URI: "), url, F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\n"), revisit,
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), block.cast("string"), F.lit(END), _http(),
    )


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = 0) -> DataFrame:
    """Writes a record for each row under folder and returns the index: (file, offset, length, id, url, digest, type, refers_to), ids as strings.

    Records with equal payloads (the html in UTF-8) of min_revisit bytes or more: the one with the
    largest id is a response, the others are revisits of it without a payload; smaller ones are
    responses. Rows whose payload no other row has, by a broadcast bitmap of fixed size over the digests
    that repeat, are written where they are read; only the others are joined with their group. Archives
    are uncompressed files of Spark's text sink with the blank lines between records as its line end,
    so a lost task writes its file anew. The index is made from the archives, a header at a time, and
    is a table in the shared folder.

    Null html is an empty payload, null url is urn:unknown; white space and control characters in a
    url become %20. Repeated rows each get a record. Rows with a null id are responses. An empty table
    writes no record.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), html.alias("html"))
    rows = rows.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("digest", sha1_base32(F.encode("html", "UTF-8"))).withColumn("place", F.pmod(F.xxhash64("digest"), F.lit(1 << BITS)))
    groups = stored(rows.filter((F.col("bytes") >= min_revisit) & F.col("id").isNotNull()).groupBy("digest", "bytes", "place").agg(F.max("id").alias("keeper"), F.count("*").alias("n")).filter("n > 1").drop("n"), "groups")
    bitmap = groups.groupBy(F.shiftright("place", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits"))
    marked = rows.join(F.broadcast(bitmap), F.shiftright("place", 6).cast("int") == F.col("word"), "left")
    repeats = F.coalesce(F.expr("shiftrightunsigned(bits, cast(place & 63 as int)) & 1"), F.lit(0)) == 1
    kind = rows.schema["id"].dataType
    alone = marked.filter(~repeats).select("id", "url", "html", "bytes", "digest", F.lit("response").alias("type"), F.lit(None).cast(kind).alias("refers_to"))
    twins = marked.filter(repeats).join(groups.drop("place"), ["digest", "bytes"], "left").withColumn("other", F.coalesce(F.col("keeper") > F.col("id"), F.lit(False)))
    twins = twins.select("id", "url", "html", "bytes", "digest", F.when(F.col("other"), "revisit").otherwise("response").alias("type"), F.when(F.col("other"), F.col("keeper")).alias("refers_to"))
    value = F.when(F.col("type") == "response", F.concat(_head(), F.col("html"))).otherwise(_head())
    alone.unionByName(twins).select(value.alias("value")).write.option("lineSep", END).option("compression", "none").text(folder)
    return stored(index_archives(pages.sparkSession, folder), "index")


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def index_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(file, offset, length, id, url, digest, type, refers_to) of every record of a folder's archives, a task a file."""
    from pyarrow import fs as pafs

    fs, root = _open(folder)
    names = [f.base_name for f in fs.get_file_info(pafs.FileSelector(root)) if f.is_file and f.base_name.startswith("part-")]

    def run(batches):
        fs, root = _open(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with fs.open_input_file(f"{root}/{name}") as f:
                    found = [{"file": name} | r for r in _records(f)]
                yield pa.RecordBatch.from_pylist(found, INDEX)

    files = spark.createDataFrame([(n,) for n in sorted(names)], "file string").repartition(max(1, len(names)))
    return files.mapInArrow(run, "file string, offset long, length long, id string, url string, digest string, type string, refers_to string")


def _records(f):
    """The header fields of each record, with its place; payloads are passed over."""
    at, size, base, data = 0, f.size(), 0, b""
    while at < size:
        end, want = -1, HEADER_READ
        while end < 0:
            if at + want > base + len(data) and base + len(data) < size or at < base:
                f.seek(at)
                base, data = at, f.read(want)
            end = data.find(b"\r\n\r\n", at - base)
            if end < 0 and base + len(data) >= size:
                raise ValueError("an archive ends inside a header")
            want *= 2
        fields = _fields(data[at - base : end])
        length = end + 4 - (at - base) + int(fields["Content-Length"]) + len(END)
        yield {"offset": at, "length": length, "id": _name(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "type": fields["WARC-Type"], "refers_to": _name(fields.get("WARC-Refers-To"))}
        at += length


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not at a record")
    return dict(x.split(": ", 1) for x in lines[1:])


def _name(x: str | None) -> str | None:
    return x and x.removeprefix("<urn:page:").removesuffix(">")


def parse_record(record: bytes) -> dict:
    """The columns of one record; a wrong length, or a payload of another digest than its header names, raises."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = _fields(head)
    n = int(fields["Content-Length"])
    block, end = rest[:n], rest[n:]
    if len(block) != n or end != END.encode():
        raise ValueError("a record ends elsewhere")
    kind, named, payload = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:"), block.partition(b"\r\n\r\n")[2]
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if kind == "response" and digest != named:
        raise ValueError("a payload isn't what its header says")
    return {"id": _name(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "type": kind, "refers_to": _name(fields.get("WARC-Refers-To")), "named": named, "bytes": len(payload), "digest": digest, "payload": payload}


def coalesced(offsets, lengths, most: int = READ_BYTES, gap: int = GAP_BYTES) -> list[tuple[int, int, list[int]]]:
    """(start, end, places) of the reads that cover sorted ranges: neighbours up to `gap` apart share one of up to `most` bytes."""
    out: list[tuple[int, int, list[int]]] = []
    for i, (a, n) in enumerate(zip(offsets, lengths, strict=True)):
        if out and a - out[-1][1] <= gap and a + n - out[-1][0] <= most:
            start, end, places = out[-1]
            out[-1] = (start, max(end, a + n), places)
            places.append(i)
        else:
            out.append((a, a + n, [i]))
    return out


def read_warc(index: DataFrame, folder: str) -> DataFrame:
    """(id string, url, type, refers_to string, named, bytes, digest, payload) of the records in index, which may be any selection of write_warc's.

    The selected ranges are sorted by file and offset, near ones are read together, and bytes and
    digest are computed from what is read; named is the digest that the header gives. Executors open the archives by their path in the shared
    store (local, hdfs, s3 or gcs, by pyarrow). Revisits have an empty payload; resolve_revisits finds theirs.
    """

    def run(batches):
        fs, root = _open(folder)
        for batch in batches:
            names = batch.column("file").to_pylist()
            cuts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
            for i, j in zip(cuts, [*cuts[1:], len(names)], strict=True):
                with fs.open_input_file(f"{root}/{names[i]}") as f:
                    offsets, lengths = (batch.column(c).slice(i, j - i).to_pylist() for c in ("offset", "length"))
                    for a, b, places in coalesced(offsets, lengths):
                        f.seek(a)
                        data = f.read(b - a)
                        got = [parse_record(data[offsets[p] - a : offsets[p] - a + lengths[p]]) for p in places]
                        yield pa.RecordBatch.from_pylist(got, RECORD)

    wanted = index.select("file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return wanted.mapInArrow(run, "id string, url string, type string, refers_to string, named string, bytes long, digest string, payload binary")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """(id, type, refers_to, bytes, digest) with the revisits' bytes and digest taken from the response of the id that they refer to and the digest that they name: rows that share an id may have different payloads."""
    held = records.select("id", "type", "refers_to", "named", "bytes", "digest")
    origin = held.filter("type = 'response'").select(F.col("id").alias("to"), F.col("bytes").alias("b"), F.col("digest").alias("d")).dropDuplicates(["to", "d"])
    revisits = held.filter("type = 'revisit'").join(origin, (F.col("refers_to") == F.col("to")) & (F.col("named") == F.col("d"))).select("id", "type", "refers_to", F.col("b").alias("bytes"), F.col("d").alias("digest"))
    return held.filter("type = 'response'").drop("named").unionByName(revisits)


def archive_folder(spark) -> str:
    return f"{shared_folder(spark)}/siltstone-warc-{uuid.uuid4().hex}"
