"""A deterministic sharded WARC writer, and the reader of its archives.

Records are range-sorted by (page_id, hashes of payload and url) into shards of about ``SHARD``
bytes, or a ``SHARDS``-th of all if that is more.  Where shards end follows from exact running
byte totals over all records, not from a sample, so reruns write the same files, however
page_ids crowd.  The first records of the shards, ``SHARDS`` at most, are sent to the tasks.
Rows equal in page_id, payload and url that would fill more than a shard are counted before the shuffle and
dealt as pieces of a shard at most, each with its number of copies; there are at most ``SHARDS`` such groups.
A task streams one shard through gzip members, one a record, and starts another file when one
has ``ROLL`` compressed bytes.  A file is written under a temporary name and renamed; names
depend on shard and number only, so a task that runs again replaces a file by the same one.
The manifest, written through Spark's committer when all tasks are done, commits the set:
the reader takes the files that it lists, and fails if one is missing or differs in its SHA-256.

Payloads are the html in UTF-8 (null: empty).  Of records with equal payloads of at least
``SAME`` bytes the one with the largest page_id is a response, the others revisit it.
Headers and digests are generated anew and checked when read.  A record's id is made of page_id, a
hash of payload and url, and its number among rows equal in these, so no two records share one; a
revisit refers to the first of the response's.

Rows with a null page_id are kept as responses or, if equal to a larger one, revisits; rows
equal in page_id and payload are all responses if that page_id is the largest.  A null url has no target header.  An empty
table writes an empty manifest and reads as no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import uuid
import zlib
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_dir, fresh_dir, lean, running, written

SAME = 1000
SHARD = 32 << 20
SHARDS = 65536
ROLL = 16 << 20
#: Bytes of a record besides its payload, about.
HEAD = 512
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "name string, shard bigint, seq int, records bigint, payload_bytes bigint, bytes bigint, sha256 string"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(page_id: int | None, place: str, number: int) -> str:
    tail = hashlib.md5(place.encode()).hexdigest()[:24]
    return f"<urn:scorelake:page:{'none' if page_id is None else page_id}:{tail}-{number}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, place: str = "", number: int = 0, response: str = "") -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit without.

    Place and number tell records of one page_id apart; response is the place of the record that a revisit refers to.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id, place, number)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='%/:=&?~#+!$,;@()*[]' + chr(39))}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to, response, 0)}"]
    head += [f"WARC-Payload-Digest: {_sha1(payload)}", f"WARC-Block-Digest: {_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Roller:
    """The files of a shard, one after another."""

    def __init__(self, uri: str, shard: int, roll: int) -> None:
        from pyarrow import fs

        self.fs, self.path = fs.FileSystem.from_uri(uri)
        self.shard, self.roll, self.seq, self.out = shard, roll, 0, None

    def add(self, data: bytes, payload: int):
        if self.out is None:
            self.name = f"part-{self.shard:08d}-{self.seq:05d}.warc.gz"
            self.temp = f"{self.path}/_temp/{self.name}.{uuid.uuid4().hex}"
            self.out, self.sha, self.bytes, self.records, self.payload = self.fs.open_output_stream(self.temp), hashlib.sha256(), 0, 0, 0
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        packed = z.compress(data) + z.flush()
        self.out.write(packed)
        self.sha.update(packed)
        self.bytes, self.records, self.payload = self.bytes + len(packed), self.records + 1, self.payload + payload
        return self.end() if self.bytes >= self.roll else None

    def end(self):
        if self.out is None:
            return None
        self.out.close()
        self.fs.move(self.temp, f"{self.path}/{self.name}")
        row = (self.name, self.shard, self.seq, self.records, self.payload, self.bytes, self.sha.hexdigest())
        self.out, self.seq = None, self.seq + 1
        return row


def _starts(pieces: DataFrame, limit: int) -> list[tuple[bool, int, str, int]]:
    """The first record of each shard as (has a page_id, page_id, place, piece), in order."""
    order = running(pieces, [F.col("page_id").asc_nulls_first(), F.col("spot"), F.col("piece")], "order", before=(F.col("bytes") + HEAD) * F.col("copies"))
    first = order.groupBy(F.floor(F.col("before") / limit).alias("shard")).agg(F.min(F.struct("page_id", "spot", "piece")).alias("first"))  # nulls are least
    return sorted((r["page_id"] is not None, r["page_id"] or 0, r["spot"], r["piece"]) for (r,) in first.select("first").collect())


def _pieces(groups: DataFrame) -> DataFrame:
    """groups: n equal rows, of which ``per`` fill a shard.  A row for each piece: piece (from 0), start (copies before it), copies."""
    cut = groups.withColumn("piece", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / F.col("per")).cast("int") - 1)))
    cut = cut.withColumn("start", F.col("piece") * F.col("per"))
    return cut.withColumn("copies", F.least("per", F.col("n") - F.col("start"))).drop("n", "per")


def write_archives(pages: DataFrame, uri: str, shard_bytes: int = SHARD, roll: int = ROLL, same: int = SAME) -> str:
    """Writes all pages below uri, in a folder all executors share; returns uri."""
    from pyarrow import fs

    spark = pages.sparkSession
    rows = lean(pages, page_id="bigint", url="string", html="string").withColumn("html", F.coalesce("html", F.lit("")))
    target = F.md5(F.coalesce(F.concat(F.lit("u"), "url"), F.lit("")).cast("binary"))
    rows = rows.withColumn("spot", F.concat(F.sha2(F.col("html").cast("binary"), 256), target))
    sizes = rows.select("page_id", "spot", F.octet_length("html").cast("bigint").alias("bytes"))
    groups = written(sizes.groupBy("page_id", "spot").agg(F.max("bytes").alias("bytes"), F.count("*").alias("n")), "sizes")
    total = groups.agg(F.sum((F.col("bytes") + HEAD) * F.col("n"))).first()[0] or 0
    limit = max(shard_bytes, -(-total // SHARDS))
    groups = groups.withColumn("per", F.greatest(F.lit(1), F.floor(F.lit(limit) / (F.col("bytes") + HEAD))))
    pieces = _pieces(groups)
    starts = spark.sparkContext.broadcast(_starts(pieces, limit))  # about SHARDS rows at most

    @F.pandas_udf("int")
    def shard_of(known: pd.Series, page_id: pd.Series, place: pd.Series, piece: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(starts.value, x) - 1 for x in zip(known.tolist(), page_id.tolist(), place, piece.tolist())], dtype="int32")

    payload = F.substring("spot", 1, 64).alias("payload")
    kept = groups.where(F.col("bytes") >= same).groupBy(payload).agg(F.max(F.struct("page_id", "spot")).alias("top"), F.sum("n").alias("many"))
    kept = written(kept.where("many > 1 and top.page_id is not null").select("payload", F.col("top.page_id").alias("refers_to"), F.col("top.spot").alias("response")), "kept")
    told = pieces.withColumn("payload", payload).join(kept, "payload").where("page_id is null or page_id < refers_to")
    told = told.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "spot", "piece", "start", "copies", "refers_to", "response")

    large = groups.where("n > per").select(F.col("page_id").alias("_i"), F.col("spot").alias("_p"), "n", "per")  # each is more than limit bytes, so at most SHARDS
    plain, repeated = rows, None
    if large.head(1):
        alike = F.col("page_id").eqNullSafe(F.col("_i")) & (F.col("spot") == F.col("_p"))
        plain = rows.join(F.broadcast(large), alike, "left_anti")
        # counted where they lie, so that one row a task and group is shuffled
        once = rows.join(F.broadcast(large), alike).groupBy("page_id", "spot").agg(*[F.first(c).alias(c) for c in ("url", "html", "n", "per")])
        repeated = _pieces(once)
    columns = ["page_id", "url", "html", "spot", "piece", "start", "copies"]
    plain = plain.withColumns({"piece": F.lit(0), "start": F.lit(0).cast("bigint"), "copies": F.lit(1).cast("bigint")}).select(columns)
    records = plain if repeated is None else plain.union(repeated.select(columns))
    # a revisit's row without html comes just before the page, so that html is shuffled once
    both = told.union(records.withColumns({"refers_to": F.lit(None).cast("bigint"), "response": F.lit(None).cast("string")}))
    placed = both.withColumn("shard", shard_of(F.col("page_id").isNotNull(), F.coalesce("page_id", F.lit(0)), "spot", "piece"))
    home, folder = fs.FileSystem.from_uri(uri)
    home.create_dir(f"{folder}/_temp", recursive=True)

    def run(batches):
        at, out, done = None, None, []
        said, refers_to, response = None, None, ""
        last, number = None, 0
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("page_id", "url", "html", "spot", "start", "copies", "refers_to", "response", "shard")]
            for page_id, url, html, place, start, copies, refers, of, shard in zip(*columns):
                if html is None:
                    said, refers_to, response = (page_id, place), refers, of
                    continue
                if shard != at:
                    done.append(out.end() if out else None)
                    at, out = shard, _Roller(uri, shard, roll)
                if last != (page_id, place, start):
                    last, number = (page_id, place, start), start
                told_of = (refers_to, response) if said == (page_id, place) else (None, "")
                payload = html.encode()
                for _ in range(copies):
                    done.append(out.add(record(page_id, url, payload, told_of[0], place, number, told_of[1]), len(payload)))
                    number += 1
        done.append(out.end() if out else None)
        names = [c.split()[0] for c in MANIFEST.split(", ")]
        yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in done if x], pa.schema(list(zip(names, (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string())))))

    order = [F.col("page_id").asc_nulls_first(), F.col("spot"), F.col("piece"), F.col("refers_to").isNull()]
    placed.repartitionById(max(1, len(starts.value)), "shard").sortWithinPartitions("shard", *order).mapInArrow(run, MANIFEST).write.json(f"{uri}/manifest")
    home.delete_dir_contents(f"{folder}/_temp")  # of attempts that failed; the manifest is complete
    return uri


def parse(content: bytes):
    """Records of one archive: page_id, payload_bytes, payload_digest (bare hex), record_type, refers_to.

    Block digests, and payload digests of responses, are checked against the bytes.
    """
    view, at = memoryview(content), 0
    while at < len(view):
        z, parts = zlib.decompressobj(31), []
        while not z.eof and at < len(view):  # a member at a time, in steps, so that no rest is copied again and again
            parts.append(z.decompress(view[at : at + 8192]))
            at += min(8192, len(view) - at) - len(z.unused_data)
        data = b"".join(parts)
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        block = rest[: int(fields["Content-Length"])]
        http, _, payload = block.partition(b"\r\n\r\n")
        kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"]
        if not z.eof or _sha1(block) != fields["WARC-Block-Digest"] or kind == "response" and _sha1(payload) != digest:
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
        size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
        number = lambda f: None if ":none:" in fields.get(f, ":none:") else int(fields[f].split(":")[3])
        yield number("WARC-Record-ID"), size, base64.b32decode(digest[5:]).hex(), kind, number("WARC-Refers-To")


def read_archives(spark: SparkSession, uri: str) -> DataFrame:
    """A row for each record of the archives that the manifest lists."""
    listed = spark.read.schema(MANIFEST).json(f"{uri}/manifest").select("name", "sha256")
    many = listed.count()

    def run(batches):
        from pyarrow import fs

        home, folder = fs.FileSystem.from_uri(uri)
        for b in batches:
            for name, sha256 in zip(b.column("name").to_pylist(), b.column("sha256").to_pylist()):
                with home.open_input_stream(f"{folder}/{name}", compression=None) as f:  # at most ROLL bytes and one record
                    content = f.read()
                if hashlib.sha256(content).hexdigest() != sha256:
                    raise ValueError(f"damaged archive {name}")
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*parse(content)), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names)

    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    names = [c.split()[0] for c in schema.split(", ")]
    return listed.repartition(max(1, min(many, 10_000))).mapInArrow(run, schema)


def round_trip(pages: DataFrame, uri: str | None = None) -> DataFrame:
    """The records of all pages as read back; archives that got no uri of their own are deleted then."""
    spark = pages.sparkSession
    at = write_archives(pages, uri or fresh_dir(spark, "warc"))
    if uri:
        return read_archives(spark, at)
    back = written(read_archives(spark, at), "records")
    drop_dir(spark, at)
    return back
