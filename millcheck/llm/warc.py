"""Content-addressed WARC archive: payload bytes once by digest, exact record headers apart, records by joins.

An archive is a folder of two tables. payloads has each distinct payload once, under its SHA-256, which is checked
whenever it is read. records has a row per record: its header to the byte, and the digest of its payload. A record is
its header, the payload unless it is a revisit, and two line ends; export joins both and writes gzipped .warc files, one
stream each, which read_files reads back record by record, so that neither a file nor a group must fit into memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millcheck.llm.common import cut

#: The digits of base 32 as RFC 4648 has them, and as conv() writes them.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CONV32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
#: Fixed value: the profile of a record that repeats an earlier payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
END = "\r\n"
LENGTH = re.compile(rb"\r\nContent-Length: *([0-9]+) *\r\n", re.I)


def base32_sha1(payload: Column) -> Column:
    """Upper-case base 32 of the SHA-1; 5 hex digits make 4 base-32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), CONV32, BASE32)


def record_id(id_col: Column, row: Column) -> Column:
    """Names a record by its page's id, percent-encoded, and the number of its row, as ids may repeat. A null id is a lone percent
    sign, which no id becomes."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.url_encode(id_col.cast("string")), F.lit("%")), F.lit(":"), row.cast("string"), F.lit(">"))


def page_id(name: str) -> Column:
    """The page's id that a header field names."""
    pattern = r"^<urn:page:(.*):\d+>$"
    found = F.regexp_extract(field(name), pattern, 1)
    return F.when(field(name).rlike(pattern) & (found != "%"), F.try_url_decode(found))


def header() -> Column:
    """The header of a record with columns id, row, url, response (boolean), refers, refers_row, n_bytes, sha1."""
    uri = F.translate(F.col("url"), "\r\n", "")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    return F.concat(
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", F.when(F.col("response"), "response").otherwise("revisit")),
        line("WARC-Record-ID", record_id(F.col("id"), F.col("row"))),
        line("WARC-Date", F.lit(DATE)),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(F.col("response"), "").otherwise(F.concat(line("WARC-Refers-To", record_id(F.col("refers"), F.col("refers_row"))), line("WARC-Profile", F.lit(PROFILE)))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(F.col("response"), F.col("n_bytes")).otherwise(0).cast("string")),
        F.lit(END),
    )


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_bytes: int = 0) -> None:
    """Writes a record per row of pages.

    A null payload is an empty one; a null url leaves its header out. Of records with equal payloads of at least
    revisit_bytes bytes, those of the smallest id are responses and the others revisit it. Rows that repeat an id with
    its payload are records of the same kind; a null id is never the smallest unless there is no other. Other columns
    are not stored; an empty table writes an empty archive.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # written at once, so that the rows keep their numbers
    facts = cut(rows.select("id", "url", "digest", F.monotonically_increasing_id().alias("row"), F.octet_length("payload").cast("long").alias("n_bytes"), base32_sha1(F.col("payload")).alias("sha1")))
    first = facts.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("f")).select("digest", F.col("f.id").alias("first"), F.col("f.row").alias("first_row"))
    records = facts.join(first, "digest").withColumn("response", F.col("id").eqNullSafe(F.col("first")) | (F.col("n_bytes") < revisit_bytes))
    records = records.withColumn("refers", F.when(~F.col("response"), F.col("first"))).withColumn("refers_row", F.col("first_row"))
    records.select("id", "refers", "digest", header().alias("header")).write.parquet(f"{path}/records")
    # by digest and id, so the copies of one payload are not all dealt to one task; one key, so they move once
    key = lambda digest, i: F.xxhash64(F.col(digest), F.col(i)).alias("k")
    held = rows.select(key("digest", "id"), "digest", "payload").join(first.select(key("digest", "first")).distinct(), "k", "left_semi").dropDuplicates(["k", "digest"])
    held.select("digest", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")


def field(name: str) -> Column:
    found = F.regexp_extract("header", rf"\n{name}: ([^\r\n]*)\r", 1)
    return F.when(found != "", found)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row per record, from its header and the bytes in store: id, refers_to, record_type, target_uri, payload_bytes
    and payload_digest of the full payload, verified (the payload is there, and has both digests and the length)."""
    held = spark.read.parquet(f"{path}/payloads").select("digest", (F.sha2("payload", 256) == F.col("digest")).alias("same"), F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    records = spark.read.parquet(f"{path}/records").select("id", "refers", "digest", field("WARC-Type").alias("record_type"), field("WARC-Target-URI").alias("target_uri"), field("WARC-Payload-Digest").alias("said"), field("Content-Length").cast("long").alias("length"))
    length = F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(0)
    ok = F.coalesce(F.col("same") & (F.col("said") == F.concat(F.lit("sha1:"), F.col("payload_digest"))) & (F.col("length") == length), F.lit(False))
    return records.join(held, "digest", "left").select("id", F.col("refers").alias("refers_to"), "record_type", "target_uri", "payload_bytes", "payload_digest", ok.alias("verified"))


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """id and record, the whole record's text without its two closing line ends."""
    records = spark.read.parquet(f"{path}/records")
    full = spark.read.parquet(f"{path}/payloads").select("digest", F.col("payload").cast("string").alias("payload"))
    responses = records.where(field("WARC-Type") == "response").join(full, "digest").select("id", F.concat("header", "payload").alias("record"))
    return responses.union(records.where(field("WARC-Type") != "response").select("id", F.col("header").alias("record")))


def export(spark: SparkSession, path: str, out: str) -> None:
    """Writes the archive's records as gzipped WARC files, one per task. The text writer ends a row by the two line
    ends that end a record. Responses and revisits are dealt together, so a file has both."""
    reconstruct(spark, path).select("record").write.option("lineSep", END * 2).option("compression", "gzip").text(out)


class Records:
    """Records of one file from what the text reader splits at two line ends. These end a header and a record, and may be within a
    payload too, so pieces are put together again up to the length that the header says. If two line ends and then a
    header or the end of the file do not follow there, or the file ends before, the record is damaged: it has no payload, and reading goes on at the first
    header after its own."""

    def __init__(self) -> None:
        self.head, self.size, self.have, self.n = b"", 0, [], 0

    def begins(self, piece: bytes) -> bool:
        """Begins a record if the piece is a header with a length."""
        length = LENGTH.search(piece + b"\r\n") if piece.startswith(b"WARC/") else None
        if length:
            self.head, self.size, self.have, self.n = piece + b"\r\n\r\n", int(length[1]), [], 0
        return length is not None

    def damaged(self) -> tuple[list[tuple[str, None]], list[bytes]]:
        """The row of a damaged record, and the pieces after the header of the next one, which are to be read again."""
        rows, pieces = [(self.head.decode("utf-8", "replace"), None)], self.have
        self.head, self.have = b"", []
        for i, piece in enumerate(pieces):
            if self.begins(piece.lstrip(b"\r\n")):
                return rows, pieces[i + 1 :]
        return rows, []

    def take(self, pieces: list[bytes], last: bool = False) -> list[tuple[str, bytes | None]]:
        """The records that end with some more pieces; with the last ones of the file all that are left."""
        rows, todo = [], pieces[::-1]
        while todo or (last and self.head):
            if not todo:
                row, again = self.damaged()
                rows += row
                todo = again[::-1]
                continue
            piece = todo.pop()
            if not self.head:
                piece = piece.lstrip(b"\r\n")
                if piece and not self.begins(piece):
                    rows.append((piece.decode("utf-8", "replace"), None))
                continue
            self.have.append(piece)
            self.n += len(piece) + 4 * (len(self.have) > 1)
            if self.n < self.size:
                continue
            # a payload that ends in line ends takes some of those after it: what is left may be the next header
            whole = b"\r\n\r\n".join(self.have)
            rest = whole[self.size :].lstrip(b"\r\n")
            closed = (whole[self.size :] + b"\r\n\r\n").startswith(b"\r\n\r\n")
            if not closed or (rest and not (rest.startswith(b"WARC/") and LENGTH.search(rest + b"\r\n"))):
                row, again = self.damaged()
                rows += row
                todo += again[::-1]
                continue
            rows.append((self.head.decode("utf-8", "replace"), whole[: self.size]))
            self.head = b""
            self.begins(rest)
        return rows


def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records of files, each of which is read from its begin to its end by one task."""
    file, records = None, Records()
    for part in batches:
        out = []
        for name, pieces in part.groupby("file", sort=False)["value"]:
            if name != file:
                out += records.take([], last=True)
                file, records = name, Records()
            out += records.take(list(pieces))
        yield pd.DataFrame(out, columns=["header", "payload"])
    yield pd.DataFrame(records.take([], last=True), columns=["header", "payload"])


def read_files(spark: SparkSession, out: str) -> DataFrame:
    """header and payload of each record of .warc.gz files. What is no header, or has no Content-Length, or ends before
    its payload does, is a row with a null payload; reading goes on at the next header, and no record goes on in another file."""
    lines = spark.read.option("lineSep", END * 2).option("pathGlobFilter", "*.gz").text(out)
    return lines.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file")).mapInPandas(parsed, "header string, payload binary")


def read_back(spark: SparkSession, out: str, id_type: str = "long") -> DataFrame:
    """A row per record of .warc.gz files: id, refers_to (page ids), record_type, target_uri, payload_bytes and
    payload_digest of the full payload (a revisit's is that of its response), verified (the bytes are there, and have the
    digest and length that the headers say)."""
    name = lambda field_name: field(field_name).alias(field_name)
    read = read_files(spark, out).select(
        page_id("WARC-Record-ID").cast(id_type).alias("id"), page_id("WARC-Refers-To").cast(id_type).alias("refers_to"), field("WARC-Type").alias("record_type"), field("WARC-Target-URI").alias("target_uri"), field("WARC-Payload-Digest").alias("said"),
        name("WARC-Record-ID"), name("WARC-Refers-To"), F.octet_length("payload").cast("long").alias("n_bytes"), F.when(field("WARC-Type") == "response", base32_sha1(F.col("payload"))).alias("sha1"),
    )
    read = cut(read)
    of = read.where("record_type = 'response'").select(F.col("WARC-Record-ID").alias("of"), F.col("n_bytes").alias("of_bytes"), F.col("sha1").alias("of_sha1"))
    full = read.where("record_type = 'revisit'").join(of, F.col("WARC-Refers-To") == F.col("of"), "left")
    full = read.where("coalesce(record_type, '') <> 'revisit'").select("*", F.lit(None).cast("string").alias("of"), F.col("n_bytes").alias("of_bytes"), F.col("sha1").alias("of_sha1")).unionByName(full)
    ok = F.coalesce(F.col("said") == F.concat(F.lit("sha1:"), F.col("of_sha1")), F.lit(False)) & ((F.col("record_type") == "response") | (F.col("n_bytes") == 0))
    return full.select("id", "refers_to", "record_type", "target_uri", F.col("of_bytes").alias("payload_bytes"), F.col("of_sha1").alias("payload_digest"), ok.alias("verified"))
