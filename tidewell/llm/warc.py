"""WARC writing, reading back, and a capture index by external merge.

Records are written by Spark's text writer, one file per task, with the blank lines that end a WARC record as its line
separator, so each file is a WARC file, packed by default, on any storage Spark can reach. Equal payloads are stored once: the row with
the largest id is the response and the others are revisits that name it. Reading back gives every file as a locally sorted
run of captures; runs are cut at common key borders, and the runs of one range are merged by a loser tree in the order of
URL key and timestamp, which gives every URL's capture history in global order.
"""

from __future__ import annotations

import gzip
import re
from base64 import b32encode
from collections.abc import Iterable, Iterator, Sequence
from hashlib import sha1
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import kind, pick, stored
from tidewell.session import new_path

FILE_BYTES = 64 << 20  # of payload in a file of several records
SIZES = (64 << 10, 1 << 20, 16 << 20, 1 << 31)  # largest payloads of the classes that share files
END = "\r\n\r\n"
EPOCH = "2024-01-01 00:00:00"
GZIP = b"\x1f\x8b"  # fixed value: how a gzip stream begins
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # fixed value


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of 20 bytes given as 40 hex digits, by five bytes at a time."""
    letters = F.lit(BASE32)
    out = []
    for group in range(4):
        number = F.conv(F.substring(hex_digest, group * 10 + 1, 10), 16, 10).cast("bigint")
        out += [
            F.substr(letters, (F.shiftright(number, shift).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))
            for shift in range(35, -1, -5)
        ]
    return F.concat(*out)


def _header_safe(value: Column) -> Column:
    """Control characters and spaces as percent codes, so that a value stays on its header line."""
    coded = value
    for code in [*range(0x21), 0x7F]:
        coded = F.replace(coded, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(value.rlike(r"[\x00-\x20\x7F]"), coded).otherwise(value)


def _name(identity: Column) -> Column:
    """Record id of a row."""
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(_header_safe(identity.cast("string")), F.lit("")), F.lit(">"))


def with_decisions(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds bytes, sha1 (hex) and newest: the largest id among rows of equal payload, null where that is the row's own.

    Rows whose payload has fewer than ``least_bytes`` bytes stand for themselves, as do all rows that share the largest id.
    """
    rows = pages.withColumns({"bytes": F.octet_length("payload").cast("bigint"), "sha1": F.sha1("payload")})
    shared = rows.where(F.col("bytes") >= least_bytes).groupBy("sha1", "bytes")
    shared = shared.agg(F.max("id").alias("newest"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    joined = rows.join(shared, ["sha1", "bytes"], "left")
    own = F.col("newest").isNull() | F.col("id").eqNullSafe(F.col("newest"))
    return joined.withColumn("newest", F.when(~own, F.col("newest")))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, compression: str = "gzip") -> None:
    """Write one record per row of (id, url, payload, seconds) as WARC files under ``path``.

    ``seconds`` is the capture time since 1970. Revisit records keep the HTTP header, with the payload's length, and
    leave the payload out. Pages of one class of sizes share files, as many to a file as keep it to about FILE_BYTES or one
    page, so that whoever reads a file may hold it. A table without large pages is one write.
    """
    largest = pages.agg(F.max(F.octet_length("payload"))).first()[0] or 0
    below = -1
    for top in SIZES:
        most = max(1, FILE_BYTES // top)
        _write_some(pages, path, least_bytes, below, top, most, compression)
        if largest <= top:
            break
        below = top


def _write_some(
    pages: DataFrame, path: str, least_bytes: int, below: int, top: int, records_per_file: int, compression: str
) -> None:
    """Records of the pages of more than ``below`` and at most ``top`` bytes."""
    rows = with_decisions(pages, least_bytes).where((F.col("bytes") > below) & (F.col("bytes") <= top))
    revisit = F.col("newest").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        line("Content-Length", F.col("bytes").cast("string")),
        F.lit("\r\n"),
        F.when(revisit, "").otherwise(F.col("payload")),
    )
    profile = F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    date = F.date_format(F.timestamp_seconds("seconds"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _name(F.col("id"))),
        line("WARC-Date", date),
        F.coalesce(line("WARC-Target-URI", _header_safe(F.col("url"))), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        F.when(revisit, F.concat(line("WARC-Refers-To", _name(F.col("newest"))), line("WARC-Profile", profile))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("http").cast("string")),
        F.lit("\r\n"),
        F.col("http"),
    )
    lines = rows.withColumn("http", http).select(record.alias("value"))
    writer = lines.write.option("lineSep", END).option("maxRecordsPerFile", records_per_file)
    writer.mode("append").option("compression", compression).text(path)


def url_key(url: str | None) -> str:
    """Sort key of a URL: host from its top domain down, then path and query, lower-cased, without scheme and fragment."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host = ",".join(reversed((parts.hostname or "").split(".")))
    except ValueError:
        return url.lower()
    return f"{host}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower()


def records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, header fields, block) of the records of a WARC file."""
    at = 0
    while at < len(data):
        top = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:top].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        fields = dict(line.split(": ", 1) for line in lines)
        start = top + 4
        stop = start + int(fields["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} does not end where it says")
        yield at, stop + 4 - at, fields, data[start:stop]
        at = stop + 4


def _page(name: str | None) -> str | None:
    found = re.fullmatch(r"<urn:x-page:(.*)>", name or "")
    return (found[1] or None) if found else None


CAPTURE = (
    "run bigint, place bigint, length bigint, id string, url string, url_key string, date string, record_type string,"
    " payload_bytes bigint, payload_digest string, refers_to string"
)
CAPTURE_NAMES = [part.split()[0] for part in CAPTURE.split(", ")]


def _captures(keep_payload: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                rows = []
                data = batch.column(1)[row].as_buffer().to_pybytes()
                data = gzip.decompress(data) if data[:2] == GZIP else data
                for place, length, fields, block in records(data):
                    top = block.index(b"\r\n\r\n")
                    payload = block[top + 4 :]
                    stated = dict(line.split(": ", 1) for line in block[:top].decode().split("\r\n")[1:])
                    size, digest = int(stated["Content-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response":
                        size, digest = len(payload), b32encode(sha1(payload).digest()).decode()
                    url = fields.get("WARC-Target-URI")
                    rows.append((
                        batch.column(0)[row].as_py(), place, length, _page(fields["WARC-Record-ID"]), url, url_key(url),
                        fields["WARC-Date"], fields["WARC-Type"], size, digest, _page(fields.get("WARC-Refers-To")),
                        *([payload.decode() if fields["WARC-Type"] == "response" else None] if keep_payload else []),
                    ))
                rows.sort(key=lambda capture: (capture[5], capture[6], capture[3] or ""))
                names = [*CAPTURE_NAMES, *(["payload"] if keep_payload else [])]
                integers = {"run", "place", "length", "payload_bytes"}
                for start in range(0, len(rows), 1000):
                    columns = zip(names, zip(*rows[start : start + 1000]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64() if name in integers else pa.string()) for name, c in columns], names
                    )

    return run


def read_archives(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """Captures of all WARC files under ``path``; each file is a run, sorted by URL key, date and id."""
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    files = files.select(F.xxhash64("path").alias("run"), "content")
    return files.mapInArrow(_captures(keep_payload), CAPTURE + (", payload string" if keep_payload else ""))


class LoserTree:
    """Merges sorted sequences: inner nodes keep the loser of their match, so each step replays one path to the root."""

    def __init__(self, runs: Sequence[Sequence], key):
        self.runs, self.key = runs, key
        self.at = [0] * len(runs)
        self.keys = [self._key(run) for run in range(len(runs))]
        self.size = max(1, len(runs))
        self.losers = [-1] * self.size
        for run in range(len(runs)):
            self._replay(run, building=True)

    def _key(self, run: int):
        rows, at = self.runs[run], self.at[run]
        return (0, self.key(rows[at]), run) if at < len(rows) else (1,)  # an ended run loses every match

    def _replay(self, run: int, building: bool = False) -> None:
        winner, node = run, (run + self.size) // 2
        while node:
            other = self.losers[node]
            if other < 0 and building:  # the first to arrive waits for its opponent
                self.losers[node] = winner
                return
            if self.keys[other] < self.keys[winner]:
                self.losers[node], winner = winner, other
            node //= 2
        self.winner = winner

    def __iter__(self) -> Iterator:
        if not self.runs:
            return
        while self.keys[self.winner][0] == 0:
            run = self.winner
            yield self.runs[run][self.at[run]]
            self.at[run] += 1
            self.keys[run] = self._key(run)
            self._replay(run)


def _merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)  # one range of captures, a bounded number of short rows
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    columns = [table[name].to_pylist() for name in ("run", "url_key", "date", "id")]
    runs: dict[int, list[int]] = {}
    for row, run in enumerate(columns[0]):
        runs.setdefault(run, []).append(row)  # rows of a run arrive in its order
    tree = LoserTree(list(runs.values()), lambda row: (columns[1][row], columns[2][row], columns[3][row] or ""))
    merged = table.take(pa.array(list(tree), pa.int64()))
    yield from merged.to_batches(5000)


def merge_captures(captures: DataFrame, rows_per_range: int = 200_000) -> DataFrame:
    """Stored captures in global order of (url_key, date, id): ``position`` grows along it.

    Ranges of that order, of about ``rows_per_range`` captures, are merged independently, so neither a run nor a URL with
    very many captures is held by one task.
    """
    ranges = max(1, -(-captures.count() // rows_per_range))
    order = ["url_key", "date", "id"]
    dealt = captures.repartitionByRange(ranges, *order, "run", "place").sortWithinPartitions("run", *order, "place")
    merged = dealt.mapInArrow(_merged, captures.schema)
    return merged.withColumn("position", F.monotonically_increasing_id())


def archive_index(
    pages: DataFrame,
    least_bytes: int = 0,
    id_column: str = "page_id",
    url_column: str = "url",
    payload_column: str = "html",
    seconds_column: str | None = None,
    path: str | None = None,
) -> DataFrame:
    """Write all pages as WARC records, read the archives back, and return the merged capture index.

    (id, payload_bytes, payload_digest, record_type, refers_to, url, url_key, date, run, place, length, position), one row
    per page. Ids are integers; without ``seconds_column`` a page is captured as many seconds after 2024-01-01 as its id
    says. A null payload is empty, a null URL has no target line and an empty key, a null id is kept and is the smallest;
    rows with equal id and payload are responses if their id is the largest. An empty table gives an empty index; other
    columns are not carried.
    """
    spark = pages.sparkSession
    rows = pick(pages, id=id_column, url=url_column, payload=payload_column, **({"seconds": seconds_column} if seconds_column else {}))
    start = F.unix_timestamp(F.to_timestamp(F.lit(EPOCH)))
    seconds = F.col("seconds") if seconds_column else F.pmod(F.col("id").cast("bigint"), F.lit(10**9)) + start
    rows = rows.withColumns({
        "payload": F.coalesce("payload", F.lit("")),
        "seconds": F.coalesce(seconds.cast("bigint"), start),
    })
    path = path or new_path(spark, "warc")
    write_archives(rows, path, least_bytes)
    index = merge_captures(stored(read_archives(spark, path), "captures"))
    identity = kind(pages, id_column)
    return index.withColumns({name: F.col(name).cast(identity) for name in ("id", "refers_to")})
