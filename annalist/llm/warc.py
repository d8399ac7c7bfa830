"""Zstandard WARC archives: one frame per record, and the dictionary in the leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annalist.llm.common import bounded_sample, new_folder, pick, prepare

#: Fixed values of the formats: skippable frames (the dictionary's, the first and last of the range), data frames.
DICTIONARY, SKIP_FIRST, SKIP_LAST, FRAME = 0x184D2A5D, 0x184D2A50, 0x184D2A5F, 0xFD2FB528
#: An empty skippable frame, which Spark's text writer puts after each record in place of a line feed.
NOTHING = struct.pack("<II", SKIP_FIRST, 0).decode("ascii")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes | None, length: int, digest: str, refers: int | None, date: str) -> bytes:
    """A response, or without payload a revisit of page ``refers``, whose block keeps the HTTP header alone."""
    name = lambda p: f"<urn:page:{'none' if p is None else p}>"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode() + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: {name(page)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if payload is None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers)}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[int | None, int, str, str, int | None, bytes]:
    """page, payload length, payload digest, type, page referred to, payload; ValueError if headers, lengths or the
    digest of a whole payload are wrong."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC header")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        key, colon, value = line.partition(":")
        if not colon or key.lower() in fields:
            raise ValueError(f"a broken or repeated header line: {line[:60]}")
        fields[key.lower()] = value.strip()
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"} - set(fields):
        raise ValueError(f"missing headers: {sorted(missing)}")
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        raise ValueError(f"a record of type {kind}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("the block's length differs from its header")
    http, found, payload = rest[:-4].partition(b"\r\n\r\n")
    length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), -1)
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if not found or (kind == "response" and (len(payload) != length or base32_sha1(payload) != digest)) or (kind == "revisit" and payload):
        raise ValueError("the payload differs from its length or digest")

    def page(name: str) -> int | None:
        text = name.removeprefix("<urn:page:").removesuffix(">")
        return None if text == "none" else int(text)

    refers = page(fields["warc-refers-to"]) if kind == "revisit" else None
    return page(fields["warc-record-id"]), length, digest, kind, refers, payload


def frame_end(data: memoryview, at: int) -> int:
    """Where the data frame at ``at`` ends, by its frame header and block headers."""
    try:
        flags = data[at + 4]
        single = flags >> 5 & 1
        content = (1, 2, 4, 8)[flags >> 6] if flags >> 6 or single else 0
        end = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + content
        last = False
        while not last:
            block = int.from_bytes(data[end : end + 3], "little")
            last, kind, size = bool(block & 1), block >> 1 & 3, block >> 3
            if kind == 3 or len(data) < end + 3:
                raise ValueError("a broken frame")
            end += 3 + (1 if kind == 1 else size)
        end += 4 * (flags >> 2 & 1)
    except IndexError:
        raise ValueError("a broken frame") from None
    if end > len(data):
        raise ValueError("a frame is cut off")
    return end


def frames(data: memoryview) -> Iterator[bytes]:
    """The content of each data frame of an archive. A leading skippable frame of the dictionary's kind is used for
    all of them (it may itself be compressed); other skippable frames are passed over."""
    at, open_ = 0, zstandard.ZstdDecompressor()
    while at < len(data):
        if len(data) - at < 8:
            raise ValueError("an archive ends inside a frame")
        magic, size = struct.unpack_from("<II", data, at)
        if SKIP_FIRST <= magic <= SKIP_LAST:
            if at + 8 + size > len(data):
                raise ValueError("a skippable frame is cut off")
            if magic == DICTIONARY and at == 0:
                held = bytes(data[8 : 8 + size])
                if held[:4] == struct.pack("<I", FRAME):
                    held = zstandard.ZstdDecompressor().decompressobj().decompress(held)
                open_ = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
            at += 8 + size
        elif magic == FRAME:
            end = frame_end(data, at)
            size = zstandard.frame_content_size(bytes(data[at : at + 18]))
            whole = bytes(data[at:end])
            yield open_.decompress(whole) if size >= 0 else open_.decompressobj().decompress(whole)
            at = end
        else:
            raise ValueError("neither a data frame nor a skippable one")


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; of samples too few to train on, their own bytes."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def write(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 3,
          dictionary_pages: int = 256, dictionary_bytes: int = 65_536, sample_bytes: int = 8_192,
          id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write one record per row into archives below ``folder``.

    Of rows with equal payloads of at least ``least_bytes`` bytes, that of the largest page id is the response; the
    others revisit it, and only their headers are written. A null html is an empty payload; a null id counts as
    smaller than any other; of repeated rows one is the response and the rest revisit it; a null url is left out;
    extra columns are ignored; an empty table gives no record. Payloads are grouped by digest and length, which are
    summed per task first; a payload travels only if it is a response. Each task writes one archive. The dictionary is
    trained on at most ``dictionary_pages`` rows of the smallest hash of their id, ``sample_bytes`` of each.
    """
    spark = prepare(pages.sparkSession)
    rows = pick(pages, page_id=id_col, url=url_col, html=html_col).withColumn("page_id", F.col("page_id").cast("long"))
    rows = rows.withColumn("html", F.coalesce(F.col("html").cast("binary"), F.lit(b"")))
    sample = bounded_sample(rows.select("page_id", F.substring("html", 1, sample_bytes).alias("s")), dictionary_pages, "page_id")
    dictionary = train_dictionary([bytes(r["s"]) for r in sample.collect() if r["s"]], dictionary_bytes)

    named = rows.withColumn("digest", F.sha1("html")).withColumn("length", F.length("html").cast("long"))
    narrow = named.select("page_id", "url", "digest", "length")
    groups = narrow.where(F.col("length") >= least_bytes).groupBy("digest", "length").agg(
        F.max("page_id").alias("_largest"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    # Repeated rows are told apart by number.
    repeats = Window.partitionBy("page_id", "digest").orderBy("url")
    decided = narrow.withColumn("_copy", F.row_number().over(repeats)).join(groups.withColumn("_grouped", F.lit(True)), ["digest", "length"], "left")
    first = F.col("_grouped").isNull() | (F.col("page_id").eqNullSafe(F.col("_largest")) & (F.col("_copy") == 1))
    decided = decided.withColumn("_first", first)
    # A payload is looked up by its row's id and digest in one key, so that it is shuffled once; of rows repeated in
    # both, by number (not as a key of the join, which would shuffle it again).
    key = F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("none")), "digest")
    bodies = named.select(key.alias("_key"), "html").withColumn("_nth", F.row_number().over(Window.partitionBy("_key").orderBy(F.lit(0))))
    full = decided.where("_first").withColumn("_key", key).join(bodies, "_key").where(F.col("_copy") - F.col("_nth") == 0)
    columns = ["page_id", "url", "digest", "length", "_largest", "html"]
    all_rows = full.select(*columns).unionByName(decided.where(~F.col("_first")).withColumn("html", F.lit(None).cast("binary")).select(*columns))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, started = None, False
        for batch in batches:
            if pack is None:
                held = zstandard.ZstdCompressionDict(dictionary)
                pack = zstandard.ZstdCompressor(level=level, dict_data=held, write_checksum=True) if dictionary else zstandard.ZstdCompressor(level=level, write_checksum=True)
            values = zip(*(batch.column(c).to_pylist() for c in columns))
            out = []
            if not started and dictionary:
                out.append(struct.pack("<II", DICTIONARY, len(dictionary)) + dictionary)
            started = True
            for page, url, digest, length, largest, html in values:
                name = base64.b32encode(bytes.fromhex(digest)).decode()
                out.append(pack.compress(record(page, url, html, length, name, largest, date)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    made = all_rows.mapInArrow(packed, "frame binary")
    made.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", NOTHING).option("compression", "none").text(folder)


def read(spark: SparkSession, folder: str, with_payload: bool = False, strict: bool = True) -> DataFrame:
    """The records of all archives below ``folder``: page_id, payload_bytes, payload_digest, record_type, refers_to, error
    (and payload). A broken record or archive raises ValueError; without ``strict`` it is a row of its own whose error
    says what is wrong, and reading goes on with the next record, or with the next archive if frames are broken."""
    prepare(spark)
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()] + [pa.binary()] * with_payload
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error"] + ["payload"] * with_payload

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(data: memoryview) -> Iterator[tuple]:
            try:
                for content in frames(data):
                    try:
                        found = parse(content)
                        yield (*found[:5], None, *found[5:][: int(with_payload)])
                    except ValueError as wrong:
                        if strict:
                            raise
                        yield (None,) * 5 + (str(wrong),) + (None,) * with_payload
            except (ValueError, zstandard.ZstdError) as wrong:
                if strict:
                    raise
                yield (None,) * 5 + (str(wrong),) + (None,) * with_payload

        for batch in batches:
            for content in batch.column("content"):
                held: list[tuple] = []
                for row in rows(memoryview(content.as_buffer())):
                    held.append(row)
                    if len(held) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

    files = spark.read.format("binaryFile").load(folder).where("length > 0").select("content")
    return files.mapInArrow(unpacked, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, error string"
                            + ", payload binary" * with_payload)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write archives into a new shared folder and list their records from the files."""
    folder = new_folder(pages.sparkSession, "warc")
    write(pages, folder)
    return read(pages.sparkSession, folder).drop("error")
