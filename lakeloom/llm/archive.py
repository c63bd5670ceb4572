"""WARC archives and their index.

Writing.  Each page becomes one WARC/1.0 record, and each record one gzip member, so a record can be
read from its offset alone.  Payloads of at least ``least`` bytes that occur more than once are written in
full by the page with the smallest id (``response``) and referred to by the others (``revisit``).  Files
are sorted by URL key and timestamp, so each is a sorted capture run, and a new one begins after
``FILE_BYTES``.  Spark's text writer puts them on any file system under its commit protocol: the last byte
of a gzip member is that of the record's size, 0 below 16 MB, and stands as the writer's line separator;
a larger record is followed by an empty member, whose last byte is 0.

Reading.  Files are read as binary rows and cut by Content-Length, never by a search for markers, so
payloads may hold anything.  Each run gives one index line per record, in its order.

Index.  Lines are dealt by range of (URL key, timestamp, page id), so even one URL with a third of all
captures spreads over tasks, in as many ranges as keep a task below about ``LINES``.  Each task gets pieces of
sorted runs and merges them with a k-way loser tree; ranges in order are the global capture history.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LEAST = 100  # bytes; smaller payloads are never revisits
FILE_BYTES = 32 << 20
LINES = 500_000
_CAPTURES = "timestamp string, url string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, run string, number long, offset long, length long"
_ORDER = ["url_key", "timestamp", "page_id"]
_URL = r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:www\.)?(\[[^\]]*\]|[^:/?#]*)(?::([0-9]*))?([^?#]*)(\?[^#]*)?"
_EMPTY = zlib.compressobj(9, zlib.DEFLATED, 31).flush()


def url_key(url: Column) -> Column:
    """Sort-friendly key: reversed host labels, then port, path and query; lower case, no scheme, www or fragment.

    What has no host is its own key, in lower case.
    """
    low = F.lower(F.trim(url))
    part = lambda n: F.regexp_extract(low, _URL, n)
    port = F.when(part(2).isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), part(2)))
    key = F.concat(F.array_join(F.reverse(F.split(part(1), r"\.")), ","), port, F.lit(")"), F.when(part(3) == "", "/").otherwise(part(3)), part(4))
    return F.when(F.rlike(low, F.lit(_URL)), key).otherwise(low)


class LoserTree:
    """K-way merge of sorted runs: one comparison per level for each item taken."""

    def __init__(self, runs: Iterable[Iterator]):
        self.runs = [iter(r) for r in runs]
        k = len(self.runs)
        self.heads = [next(r, None) for r in self.runs]
        self.losers = [-1] * max(1, k)  # inner nodes 1..k-1 hold losers, node 0 the winner
        winners = [-1] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            first, last = (a, b) if self._before(a, b) else (b, a)
            winners[node], self.losers[node] = first, last
        self.losers[0] = winners[1] if k > 1 else (0 if k else -1)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def __iter__(self) -> Iterator:
        k = len(self.runs)
        while k and self.heads[at := self.losers[0]] is not None:
            yield self.heads[at]
            self.heads[at] = next(self.runs[at], None)
            node = (at + k) // 2
            while node:
                if self._before(self.losers[node], at):
                    self.losers[node], at = at, self.losers[node]
                node //= 2
            self.losers[0] = at


def records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Pages with digest, size and, for repeated payloads, the page they refer to and its url.

    A null html is an empty payload; a null url an empty one.  Rows that repeat a page id are records
    each; a row never refers to its own id.  Rows with a null page id can't be referred to.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]", "")
    full = pages.select("page_id", url.alias("url"), html.alias("html"), F.monotonically_increasing_id().alias("row"))
    full = full.withColumn("payload_digest", F.sha2("html", 256)).withColumn("payload_bytes", F.octet_length("html").cast("long"))
    # which page refers to which is found on ids and digests; payloads are then dealt by page, never by digest
    slim = full.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull()).select("payload_digest", "page_id", "url")
    least_page = F.min(F.struct("page_id", "url")).alias("first")
    firsts = common.stage(slim.groupBy("payload_digest").agg(least_page, F.count(F.lit(1)).alias("n")).where("n > 1").select("payload_digest", "first"), "firsts")
    refers = slim.select("payload_digest", "page_id").join(firsts, "payload_digest").where("first.page_id < page_id").distinct()
    named = refers.select(F.xxhash64("page_id", "payload_digest").alias("name"), F.col("page_id").alias("own"), F.col("payload_digest").alias("same"), F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_to_url"))
    joined = full.withColumn("name", F.xxhash64("page_id", "payload_digest")).join(named, "name", "left")
    real = (F.col("own") == F.col("page_id")) & (F.col("same") == F.col("payload_digest"))  # (a name that two pages share)
    return joined.where(F.col("own").isNull() | real).drop("name", "own", "same")


def _date(page_id: Column) -> Column:
    """The table has no capture time: a second for each page id since a fixed start, so runs are reproducible."""
    seconds = F.lit(1_704_067_200) + F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(100_000_000))
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def warc_text(rows: DataFrame) -> Column:
    """One whole record."""
    revisit = F.col("refers_to").isNotNull()
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("html")))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    uuid = F.regexp_replace(F.md5(F.concat_ws("|", F.lit("page"), page, F.col("row"), "payload_digest")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    profile = "\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To-Target-URI: "
    head = [
        F.lit("WARC/1.0\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: <urn:uuid:"), uuid,
        F.lit(">\r\nWARC-Date: "), _date(F.col("page_id")), F.lit("\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("payload_digest"), F.lit("\r\nX-Page-ID: "), page, F.lit("\r\nX-Payload-Length: "), F.col("payload_bytes").cast("string"),
        F.when(revisit, F.concat(F.lit(profile), F.col("refers_to_url"), F.lit("\r\nWARC-Refers-To-Date: "), _date(F.col("refers_to")), F.lit("\r\nX-Refers-To-Page-ID: "), F.col("refers_to").cast("string"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n\r\n"),
    ]
    return F.concat(*head)


def member(record: bytes) -> bytes:
    """One record as a gzip member, without the last byte, which is 0 and stands as line separator."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = packer.compress(record) + packer.flush()
    return (data if data[-1] == 0 else data + _EMPTY)[:-1]


@common.tidy
def _members(batches: Iterator[pa.RecordBatch], file_bytes: int) -> Iterator[pa.RecordBatch]:
    file, size, number = 0, 0, 0
    for piece in (p for b in batches for p in common.slices(iter([b]), "record")):
        made, files = [], []
        for record in piece.column("record"):
            data = member(record.as_py())
            if size and size + len(data) > file_bytes:
                file, size = file + 1, 0
            size += len(data) + 1
            made.append(data)
            files.append(file)
        numbers = range(number, number + len(made))
        number += len(made)
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.int32()), pa.array(numbers, pa.int64()), pa.array(made, pa.binary())], names=["file", "number", "value"])


def write(pages: DataFrame, path: str, least: int = LEAST, file_bytes: int = FILE_BYTES) -> None:
    """Write gzip-compressed archives, each sorted by URL key and timestamp."""
    common.ship(pages.sparkSession)
    rows = records(pages, least)
    # the join has dealt the payloads already: its tasks write files each, so they are not shuffled again
    ordered = rows.withColumn("url_key", url_key(F.col("url"))).withColumn("timestamp", _date(F.col("page_id"))).sortWithinPartitions(*_ORDER)
    packed = ordered.select(warc_text(rows).cast("binary").alias("record")).mapInArrow(lambda b: _members(b, file_bytes), "file int, number long, value binary")
    in_order = packed.sortWithinPartitions("file", "number").select("file", F.col("value").cast("string").alias("value"))
    in_order.write.partitionBy("file").option("lineSep", "\0").text(path)


def parse(data: memoryview | bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each record of an archive, one gzip member at a time; raises on a broken one."""
    view, at = memoryview(data), 0
    while at < len(view):
        opener, start = zlib.decompressobj(31), at
        parts = []
        while not opener.eof and at < len(view):  # in pieces, so that what is left over stays small
            parts.append(opener.decompress(view[at : at + (1 << 16)]))
            at = min(at + (1 << 16), len(view))
        at -= len(opener.unused_data)
        if not opener.eof:
            raise ValueError(f"gzip member at {start} doesn't end")
        record = b"".join(parts)
        if not record:  # the empty member behind a large record
            continue
        head, _, rest = record.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if lines[0] != "WARC/1.0":
            raise ValueError(f"no WARC record at {start}")
        headers = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
        size = int(headers["content-length"])
        if rest[size:] != b"\r\n\r\n":
            raise ValueError(f"record at {start} doesn't end")
        yield start, at - start, headers, rest[:size]


@common.tidy
def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split(" ")[0] for f in _CAPTURES.split(", ")]
    kinds = [pa.string() if f.endswith("string") else pa.int64() for f in _CAPTURES.split(", ")]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows: list[tuple] = []
            for number, (offset, length, head, block) in enumerate(parse(memoryview(content.as_buffer()))):
                payload = block.partition(b"\r\n\r\n")[2]
                kind, page = head["warc-type"], head["x-page-id"]
                if kind == "response":
                    size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    if f"sha256:{digest}" != head["warc-payload-digest"]:
                        raise ValueError(f"{path}, {offset}: digest doesn't match its payload")
                else:
                    size, digest = int(head["x-payload-length"]), head["warc-payload-digest"].removeprefix("sha256:")
                refers = head.get("x-refers-to-page-id")
                stamp = "".join(c for c in head["warc-date"] if c.isdigit())
                rows.append((stamp, head["warc-target-uri"], int(page) if page else None, size, digest, kind, int(refers) if refers else None, "/".join(path.split("/")[-2:]), number, offset, length))
                if len(rows) == 10_000:
                    yield made(rows)
                    rows = []
            if rows:
                yield made(rows)


@common.tidy
def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of sorted runs, one run after the other, merged."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    lines = pa.Table.from_batches(parts).combine_chunks()
    runs, keys = lines.column("run").combine_chunks(), [lines.column(c).combine_chunks() for c in _ORDER]
    changes = pc.not_equal(runs.slice(1), runs.slice(0, len(runs) - 1)).to_numpy(zero_copy_only=False).nonzero()[0] + 1
    starts = [0, *changes.tolist(), len(runs)]

    def run(a: int, b: int) -> Iterator[tuple]:
        before = None
        for at in range(a, b):
            page = keys[2][at].as_py()
            line = (keys[0][at].as_py(), keys[1][at].as_py(), page is not None, page or 0)
            if before is not None and line < before:
                raise ValueError(f"run {runs[at]} isn't sorted")
            before = line
            yield *line, at

    order: list[int] = []
    for line in LoserTree(run(a, b) for a, b in zip(starts, starts[1:], strict=False)):
        order.append(line[-1])
        if len(order) == 10_000:
            yield from lines.take(pa.array(order)).combine_chunks().to_batches()
            order = []
    if order:
        yield from lines.take(pa.array(order)).combine_chunks().to_batches()


def captures(spark, path: str) -> DataFrame:
    """One row for each record of the archives under ``path``, as its file has it."""
    common.ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    return files.select("path", "content").mapInArrow(_index, _CAPTURES).withColumn("url_key", url_key(F.col("url")))


def history(lines: DataFrame) -> DataFrame:
    """Index lines in global order of URL key, timestamp and page id, over ordered partitions."""
    parts = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // LINES))
    # a task's lines run by run, in each run's own order; the tree alone compares keys
    dealt = lines.repartitionByRange(parts, *_ORDER).sortWithinPartitions("run", "number")
    return dealt.mapInArrow(_merge, lines.schema)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "warc")
    write(common.table(spark, sf_dir, "pages"), path)
    lines = common.stage(captures(spark, path), "captures")
    return history(lines).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "timestamp")


SQL = None  # its URL keys and timestamps come from the archives; tests compare with a brute-force version
