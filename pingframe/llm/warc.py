"""Sharded web archives: range-sorted records, files rolled by compressed size, committed through temporary names and a manifest."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, utf8
from .sharding import number_of

#: Payloads of fewer bytes are never replaced by a revisit.
REVISIT_BYTES = 1000
#: A file is closed when it has so many compressed bytes; a shard holds about so many payload bytes.
ROLL_BYTES = 8 << 20
SHARD_BYTES = 32 << 20
#: A shard is a unit of work and rolls into any number of files, so more of them are not needed.
MOST_SHARDS = 4096
#: Ids that are looked at for each shard to cut them, chosen by hash.
SAMPLED_A_SHARD = 64
#: The date written into all records, so that archives of equal pages are equal.
DATE = "2024-01-01T00:00:00Z"

_NEW = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")      # fixed value: the URL name space of RFC 4122
_END = b"\r\n\r\n"


def _gz(data: bytes) -> bytes:
    """One gzip member without time or name: equal data, equal bytes."""
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _one_line(value: str) -> str:
    """A header value may not break its line."""
    return " ".join(value.split())


def record_bytes(page_id: int | None, url: str | None, payload: bytes, revisit: bool, refers_to: int | None, date: str = DATE) -> bytes:
    """A WARC/1.1 record.  Headers and digests are made from the payload; a revisit has none of it and names the record it repeats."""
    digest = _sha1(payload)
    mark = f"{'' if page_id is None else page_id}|{digest}|{'revisit' if revisit else 'response'}"
    block = b"" if revisit else payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_NEW, mark)}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_one_line(url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    head += [f"X-Payload-Length: {len(payload)}", f"WARC-Payload-Digest: {digest}", f"WARC-Block-Digest: {_sha1(block)}"]
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            head.append(f"X-Refers-To-Page: {refers_to}")
    head += ["Content-Type: text/html", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + _END + block + _END


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a compressed archive; a file that is cut short raises."""
    while data:
        d = zlib.decompressobj(31)
        record = d.decompress(data)
        if not d.eof:
            raise ValueError("archive ends inside a record")
        data = d.unused_data
        head, _, rest = record.partition(_END)
        lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        n = int(fields["Content-Length"])
        block = rest[:n]
        if lines[0] != "WARC/1.1" or rest[n:] != _END or _sha1(block) != fields["WARC-Block-Digest"]:
            raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
        yield fields, block


def repeated_payloads(pages: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload of `least_bytes` or more occurs again, each id once: refers_to is the largest id.

    Counts fold on the map side, so a payload of any number of copies is one
    row per task; the members are then found by their digests.
    """
    d = pages.select("page_id", "digest", "bytes")
    again = (d.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("refers_to"))
             .where("n > 1").select("digest", "refers_to"))
    return d.select("page_id", "digest").distinct().join(again, "digest").select("page_id", "digest", "refers_to")


def shard_cuts(ids: DataFrame, shards: int, key: str = "page_id") -> list:
    """Ascending ids that cut the table into about equal shards: quantiles of the ids whose hash says so, the same whatever the partitions."""
    n = ids.count()
    one_in = max(1, n // (shards * SAMPLED_A_SHARD))
    looked = sorted(r[0] for r in ids.where(F.col(key).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(one_in)) == 0)).select(key).distinct().collect())
    return sorted({looked[len(looked) * i // shards] for i in range(1, shards)}) if looked else []      # about shards * SAMPLED_A_SHARD ids were read


def _open(folder: str):
    return pafs.FileSystem.from_uri(folder)


class _Roller:
    """Writes the records of a shard into files with temporary names; gives a manifest row for each."""

    def __init__(self, folder: str, roll: int):
        self.folder, self.roll, self.out, self.shard, self.seq = folder, roll, None, None, 0
        self.attempt = f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}"
        self.fs, self.root = _open(folder)

    def add(self, shard: int, record: bytes) -> Iterator[tuple]:
        if shard != self.shard:
            yield from self.close()
            self.shard, self.seq = shard, 0
        if self.out is None:
            self.name = f"{self.attempt}-{shard:06d}-{self.seq:05d}.tmp"
            self.fs.create_dir(f"{self.root}/_temporary")
            self.out, self.size, self.records, self.sha = self.fs.open_output_stream(f"{self.root}/_temporary/{self.name}"), 0, 0, hashlib.sha1()
        member = _gz(record)
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.records += 1
        if self.size >= self.roll:
            yield from self.close()

    def close(self) -> Iterator[tuple]:
        if self.out is not None:
            self.out.close()
            self.out = None
            yield self.name, f"part-{self.shard:06d}-{self.seq:05d}.warc.gz", self.shard, self.seq, self.records, self.size, self.sha.hexdigest()
            self.seq += 1


_MANIFEST = "temporary string, file string, shard int, seq int, records long, bytes long, sha1 string"


def _written(batches: Iterator[pa.RecordBatch], folder: str, roll: int) -> Iterator[pa.RecordBatch]:
    """Write rows (shard, page_id, digest, marker, refers_to, url, payload) in order; a marker precedes the rows that it holds for."""
    roller, again, said, rows = _Roller(folder, roll), None, set(), []
    for b in batches:
        for shard, page_id, digest, marker, refers_to, url, payload in zip(*(c.to_pylist() for c in b.columns)):
            if marker == 0:
                again = (page_id, digest, refers_to)
                continue
            repeat = again is not None and again[:2] == (page_id, digest)
            first = repeat and refers_to_self(again) and again not in said
            if first:
                said = {again}                                            # rows of one id and payload follow each other
            rows += roller.add(shard, record_bytes(page_id, url, payload, repeat and not first, again[2] if repeat and not first else None))
        if rows:
            yield _manifest(rows)
            rows = []
    rows += roller.close()
    if rows:
        yield _manifest(rows)


def refers_to_self(marker: tuple) -> bool:
    return marker[0] == marker[2]


def _manifest(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in _MANIFEST.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", roll_bytes: int = ROLL_BYTES,
                   shard_bytes: int = SHARD_BYTES, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write a record per page into `folder` and return its manifest (file, shard, seq, records, bytes, sha1).

    Shards are ranges of the id, cut the same way whatever the partitions, and
    sorted by id, digest and address, so equal tables give equal files.  A task
    writes under temporary names that carry its attempt; only the names that
    successful tasks report reach the manifest, the files get their final names
    from it, and the manifest is written last: its presence says that the
    archive is whole.  Files of lost attempts stay under `_temporary`, which is
    then removed.

    Payload: the html in UTF-8 (null: empty).  Of equal payloads of
    `least_bytes` or more the record of the largest id is the response and the
    others revisit it; of rows that are equal in id and payload one is the
    response.  Null ids come first, and a group of null ids only has its
    first record as response.  Other columns are not read.  An empty table
    gives an empty manifest.  `folder` is a place that driver and executors share.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), utf8(F.col(html)).alias("payload"))
    marked = rows.withColumn("digest", F.sha1("payload"))
    narrow = stored(marked.select("page_id", "digest", F.octet_length("payload").cast("long").alias("bytes")), "warc-digests")
    total = narrow.agg(F.sum("bytes")).first()[0] or 0
    shards = min(MOST_SHARDS, max(1, -(-total // shard_bytes)))
    cuts = shard_cuts(narrow, shards)
    markers = repeated_payloads(narrow, least_bytes).select("page_id", "digest", F.lit(0).alias("marker"), "refers_to", F.lit(None).cast("string").alias("url"),
                                                           F.lit(None).cast("binary").alias("payload"))
    both = markers.unionByName(marked.select("page_id", "digest", F.lit(1).alias("marker"), F.lit(None).cast("long").alias("refers_to"), "url", "payload"))
    order = ["shard", "page_id", "digest", "marker", "url"]
    sent = (both.withColumn("shard", F.when(F.col("page_id").isNull(), 0).otherwise(number_of(F.col("page_id"), cuts))).repartition(shards, "shard").sortWithinPartitions(*order)
            .select("shard", "page_id", "digest", "marker", "refers_to", "url", "payload"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    listed = stored(sent.mapInArrow(lambda it: _written(it, folder, roll_bytes), _MANIFEST), "warc-written")
    _commit(listed, folder)
    manifest = listed.drop("temporary")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")
    fs, root = _open(folder)
    if fs.get_file_info(f"{root}/_temporary").type == pafs.FileType.Directory:
        fs.delete_dir(f"{root}/_temporary")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def _commit(listed: DataFrame, folder: str) -> None:
    """Give the listed files their final names; a repeated task finds them renamed and goes on."""
    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        for b in batches:
            for old, new, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if fs.get_file_info(f"{root}/_temporary/{old}").type == pafs.FileType.File:
                    fs.move(f"{root}/_temporary/{old}", f"{root}/{new}")
                if fs.get_file_info(f"{root}/{new}").size != size:
                    raise OSError(f"{new} is not whole")
            yield pa.RecordBatch.from_arrays([b.column(1)], ["file"])

    done = listed.select("temporary", "file", "bytes").mapInArrow(rename, "file string").count()
    assert done == listed.count()


_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, file string"


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of a committed archive; block digests are verified, a file that is missing or cut short raises.

    A revisit has the length and digest of the payload it repeats, and no payload.
    """
    manifest = spark.read.parquet(f"{folder}/manifest")
    if manifest.isEmpty():
        return spark.createDataFrame([], _READ)
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.gz").load(folder)
             .withColumn("file", F.element_at(F.split("path", "/"), -1)))
    found = files.select(F.col("file").alias("name"), "length")                  # lengths come from the listing, without content
    odd = manifest.join(found, manifest["file"] == found["name"], "full").where("file is null or name is null or bytes <> length").select("file", "name").take(3)
    if odd:
        raise OSError(f"files that differ from the manifest: {odd}")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0), b.column(1)):
                out = []
                for head, block in parse_records(content.as_py()):
                    page, refers = head.get("X-Page-Id"), head.get("X-Refers-To-Page")
                    digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    if head["WARC-Type"] == "response" and hashlib.sha1(block).hexdigest() != digest:
                        raise ValueError("payload digest differs")
                    out.append((page and int(page), head.get("WARC-Target-URI"), int(head["X-Payload-Length"]), digest, head["WARC-Type"],
                                refers and int(refers), block if payloads and head["WARC-Type"] == "response" else None, file.as_py()))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
                for at in range(0, len(out), 1024):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[at:at + 1024]), kinds)], [x.split()[0] for x in _READ.split(", ")])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    return files.select("file", "content").mapInArrow(read, _READ)
