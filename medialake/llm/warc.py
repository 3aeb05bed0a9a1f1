"""WARC derivative builder (operator 10).

Each response record gives two linked records: a ``metadata`` record with the
source's status, headers and digests as warc-fields, and, for a text payload,
a ``conversion`` record with its plain text. Both refer to the response by
``WARC-Refers-To`` and keep its target URI and date; the metadata names the
conversion. Record ids are version-5 UUIDs of the response's id, so building
again gives the same ids. Digests of the new records use the algorithm and
spelling of the source's digest.

A record is a row with its bytes: ``read_warc`` and ``write_warc`` use Spark's
splittable text source with the record separator, so a file is not held whole.
Files of every WARC version are read. Pieces that the separator makes of one
record are put together again by its Content-Length.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import uuid
import zlib
from typing import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medialake.llm import html as H
from medialake.llm import rows as R

VERSION = b"WARC/1.1"
END = "\r\n\r\n"
GAP, MARK = END.encode(), b"WARC/"
#: Records go to Spark in batches of about this size.
BATCH_BYTES = 8 << 20


def digest_like(data: bytes, example: str | None) -> str:
    """``algorithm:value`` of ``data``, spelled as in ``example`` (base32 or
    hexadecimal; SHA-1 in base32 where there is none)."""
    name, _, value = (example or "sha1:").partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ("sha1", "sha256", "sha512", "md5"):
        name, value = "sha1", ""
    d = hashlib.new(name, data)
    return f"{name}:{d.hexdigest() if len(value.strip()) == 2 * d.digest_size else base64.b32encode(d.digest()).decode()}"


def parse_headers(block: bytes) -> list[tuple[str, str]]:
    """Named fields of a header block, without its first line; a line that
    begins with white space continues the one before."""
    out: list[tuple[str, str]] = []
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            k, v = line.split(":", 1)
            out.append((k.strip(), v.strip()))
    return out


def _get(headers: list[tuple[str, str]], name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name), None)


def make_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the final separator."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return VERSION + b"\r\n" + head.encode() + b"\r\n" + block


def dechunk(body: bytes) -> bytes | None:
    """The content of a chunked body, None for what is not one (many crawlers
    store the content and keep the header)."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not size or any(c not in b"0123456789abcdefABCDEF" for c in size):
            return None
        n, at = int(size, 16), end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n:at + n + 2] != b"\r\n":
            return None
        out.append(body[at:at + n])
        at += n + 2


def _inflate(body: bytes, bits: int) -> bytes:
    """All members of a gzip, zlib or raw deflate stream."""
    out = []
    while body:
        d = zlib.decompressobj(bits)
        out.append(d.decompress(body) + d.flush())
        if not d.eof:
            raise zlib.error("cut off")
        body = d.unused_data if bits > 16 and d.unused_data[:2] == b"\x1f\x8b" else b""
    return b"".join(out)


def decode_content(body: bytes, encodings: str) -> bytes | None:
    """``body`` without its content encodings; None where one is unknown or
    the bytes are cut off. A body that is stored decoded stays as it is."""
    for name in reversed([e.strip().lower() for e in encodings.split(",")]):
        try:
            if name in ("gzip", "x-gzip"):
                body = _inflate(body, 31) if body[:2] == b"\x1f\x8b" else body
            elif name == "deflate":
                zipped = len(body) > 1 and body[0] & 15 == 8 and (body[0] << 8 | body[1]) % 31 == 0
                body = _inflate(body, 15 if zipped else -15)
            elif name not in ("", "identity"):
                return None
        except zlib.error:
            return None
    return body


def _named(source_id: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source_id}#{kind}')}>"


def _row(kind: str, **more) -> dict:
    return {"warc_type": kind, "record_id": None, "refers_to": None, "target_uri": None, "warc_date": None, "content_type": None,
            "content_length": None, "block_digest": None, "record": None, "error": None} | more


def derive_record(record: bytes | None) -> list[dict]:
    """The records derived from one response record. Other record types give
    none; what is no record gives one row of type ``invalid``, and so do bytes
    after the record's end and a payload that cannot be decoded."""
    record = bytes(record or b"")
    head, gap, rest = record.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/") or not gap:
        return [_row("invalid", error="no WARC header")]
    warc = parse_headers(head)
    source = _get(warc, "warc-record-id")
    length = _get(warc, "content-length") or ""
    left = length.isdigit() and rest[int(length):].strip(b"\r\n")
    after = [_row("invalid", refers_to=source, error="bytes after Content-Length")] if left else []
    if (_get(warc, "warc-type") or "").lower() != "response":
        return after
    if not source or not length.isdigit() or int(length) > len(rest):
        return [_row("invalid", refers_to=source, error="no record id" if not source else "truncated")]
    block = rest[:int(length)]
    http_head, _, payload = block.partition(b"\r\n\r\n")
    http = parse_headers(http_head)
    status = http_head.split(b"\r\n", 1)[0].decode("utf-8", "replace")
    kind = _get(http, "content-type") or ""
    given = _get(warc, "warc-payload-digest")
    stored = payload
    if any("chunked" in v.lower() for k, v in http if k.lower() == "transfer-encoding"):
        payload = found if (found := dechunk(payload)) is not None else payload
    found = digest_like(payload, given)
    # some crawlers take the digest of the chunked bytes
    valid = given is not None and (given.lower() == found.lower()
                                   or stored is not payload and given.lower() == digest_like(stored, given).lower())
    content = decode_content(payload, ",".join(v for k, v in http if k.lower() == "content-encoding"))
    uri, date = _get(warc, "warc-target-uri"), _get(warc, "warc-date")
    base = [(k, v) for k, v in (("WARC-Refers-To", source), ("WARC-Target-URI", uri), ("WARC-Date", date)) if v]
    out = []

    def add(warc_type: str, content_type: str, body: bytes, record_id: str) -> None:
        digest = digest_like(body, given)
        fields = [("WARC-Type", warc_type), ("WARC-Record-ID", record_id), *base, ("Content-Type", content_type),
                  ("WARC-Block-Digest", digest)]
        out.append(_row(warc_type, record_id=record_id, refers_to=source, target_uri=uri, warc_date=date,
                        content_type=content_type, content_length=len(body), block_digest=digest,
                        record=make_record(fields, body)))

    media = kind.split(";")[0].strip().lower()
    is_text = media.startswith("text/") or media == "application/xhtml+xml"
    conversion = _named(source, "conversion") if is_text and content is not None else None
    about = [("source-record-id", source), ("source-status", status), ("source-payload-digest", given or found),
             ("source-payload-digest-valid", "unknown" if given is None else str(valid).lower()),
             ("source-block-digest", _get(warc, "warc-block-digest") or digest_like(block, given)),
             ("source-payload-length", str(len(payload))), ("conversion-record-id", conversion or "none"),
             *((f"source-header-{k.lower()}", v) for k, v in http)]
    add("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in about).encode(), _named(source, "metadata"))
    if conversion:
        text = _decode(content, kind)
        plain = text if media == "text/plain" else H.visible_text(text)
        add("conversion", "text/plain; charset=utf-8", plain.encode("utf-8", "replace"), conversion)
    elif is_text:
        out.append(_row("invalid", refers_to=source, target_uri=uri, warc_date=date, error="content encoding"))
    return out + after


def _decode(payload: bytes, content_type: str) -> str:
    charset = next((p.split("=", 1)[1].strip(" \"'") for p in content_type.split(";")[1:]
                    if p.strip().lower().startswith("charset=")), "utf-8")
    try:
        return payload.decode(charset, "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


_DERIVED = ("warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, "
            "content_length long, block_digest string, record binary, error string")


def _derive_udf():
    @F.pandas_udf("array<struct<" + ",".join(x.strip().replace(" ", ":") for x in _DERIVED.split(",")) + ">>")
    def derived(records: pd.Series) -> pd.Series:
        return pd.Series([derive_record(r) for r in records], dtype=object)
    return derived


def build_derivatives(responses: DataFrame, record_col: str = "record", id_col: str | None = None) -> DataFrame:
    """The derived records of a table of records (bytes of one record a row),
    with ``id_col`` first where it is named.

    Defined cases: a NULL, empty or cut-off record gives one row of type
    ``invalid`` with the reason; a record that is no response gives none; bytes
    after a record's Content-Length give one more row ``invalid``; chunked,
    gzip and deflate payloads are decoded, and one of another encoding has a
    row ``invalid`` in place of the conversion; an empty payload has an empty
    conversion; repeated records are derived each.
    """
    keep = [R.quoted(id_col).alias("id")] if id_col else []
    rows = responses.select(*keep, F.explode(_derive_udf()(R.quoted(record_col))).alias("d"))
    back = [F.col("id").alias(id_col)] if id_col else []
    return rows.select(*back, "d.*")


def page_responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(id, record): each page as the response record of its fetch. NULL html
    is an empty payload; a NULL URL leaves the target URI out."""
    payload = F.coalesce(R.quoted(html_col), F.lit(""))
    size = F.octet_length(payload).cast("string")
    h = F.md5(F.concat_ws("\x1f", R.quoted(id_col).cast("string"), R.quoted(url_col)).cast("binary"))
    spans = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    uid = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in spans]), F.lit(">"))
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size,
                     F.lit(END), payload)

    def field(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    digest = F.concat(F.lit("sha256:"), F.sha2(payload.cast("binary"), 256))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\n"), field("WARC-Record-ID", uid),
                    field("WARC-Target-URI", R.quoted(url_col)), field("WARC-Date", F.lit(date)),
                    field("WARC-Payload-Digest", digest), F.lit("Content-Type: application/http; msgtype=response\r\n"),
                    field("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"))
    return pages.select(R.quoted(id_col).alias(id_col), F.concat(head, block).cast("binary").alias("record"))


def write_warc(records: DataFrame, path: str, record_col: str = "record", compression: str = "none") -> None:
    """Record bytes as WARC files, one per task."""
    (records.select(R.quoted(record_col).cast("string").alias("value")).filter("value IS NOT NULL")
     .write.option("lineSep", END).option("compression", compression).text(path))


def _record_size(piece: bytes) -> int:
    """Bytes of the record that begins with ``piece`` by its Content-Length, 0
    where there is none."""
    if not piece.startswith(MARK):
        return 0
    head = piece.partition(GAP)[0]
    length = _get(parse_headers(head), "content-length") or ""
    return len(head) + len(GAP) + int(length) if length.isdigit() else 0


def join_pieces(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """Records of the pieces between separators: as many as fill the first
    one's Content-Length exactly. A record that they do not fill so is cut off;
    it is one piece, and the next one begins a record."""
    source, waiting = iter(pieces), []
    while True:
        if not waiting:
            first = next(source, None)
            if first is None:
                return
            waiting.append(first)
        size, have, n = _record_size(waiting[0]), len(waiting[0]), 1
        while have < size:
            if n == len(waiting):
                more = next(source, None)
                if more is None:
                    break
                waiting.append(more)
            have += len(GAP) + len(waiting[n])
            n += 1
        # blank bytes may follow the last record of a file
        over = have - size
        if n > 1 and (over < 0 or waiting[n - 1][max(len(waiting[n - 1]) - over, 0):].strip(b"\r\n")):
            n = 1
        yield GAP.join(waiting[:n])
        del waiting[:n]


def _records_of_splits(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records of the rows of a task, which are pieces in file order, split by split."""
    def pieces():
        last = None
        for b in batches:
            for path, start, value in zip(b["path"], b["start"], b["value"]):
                begins = start == 0 and (path, start) != last
                yield (path, start), bytes(value) if begins else MARK + bytes(value)
                last = (path, start)

    made, size = [], 0
    for _, split in itertools.groupby(pieces(), key=lambda p: p[0]):
        for record in join_pieces(v for _, v in split):
            n = _record_size(record)
            if n and not record[n:].strip(b"\r\n"):
                record = record[:n]
            if record.strip(b"\r\n"):
                made.append(record)
                size += len(record)
            if size > BATCH_BYTES:
                yield pd.DataFrame({"record": made})
                made, size = [], 0
    yield pd.DataFrame({"record": pd.Series(made, dtype=object)})


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record) of the WARC files under ``path``, of every version, without
    final separators. A payload that holds a separator and ``WARC/`` is put
    together again, unless the boundary of two file splits lies between its
    pieces: then it shows up as a cut-off record."""
    text = spark.read.option("lineSep", END + MARK.decode()).text(path)
    rows = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
                       F.col("value").cast("binary").alias("value"))
    return rows.mapInPandas(_records_of_splits, "record binary")
