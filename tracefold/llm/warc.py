"""WARC archives with a two-level capture index, and reading back through it.

Writing. A payload that several pages share is stored once: the capture with the largest page id is the
response, the others are revisit records that refer to it (payloads under ``least_shared`` bytes are always
stored). Each task streams its records, one gzip member each, into archive files in the shared folder and
returns where each record lies.

Index. Captures are range-sorted by key: the URL with its host reversed (``org,example,www)/path``), page id,
digest. Each task writes one index file: compressed blocks of ``block_lines`` sorted lines, and behind them the
file's sparse directory, with the first key and place of each block. The list of the files (first key, name;
one row per file) is the upper level.

Reading. Looked-up keys are range-sorted too. For each key, a binary search in the list gives the file, one in
the file's directory gives the block; the block is one range read, and each capture found there is another.
Payloads are hashed again and held against their header.

Files of lost or repeated tasks are never referred to: only finished tasks return places. Executors reach the
shared folder by ``pyarrow.fs``, whatever its scheme; nothing is kept on local disks.

Edge cases: null and empty html is an empty payload; a null url has the empty key; very long pages are one
record; pages with equal id and payload are records of their own, with one result each; a null page id is the
smallest, and such a page revisits one with an id (with none, all are responses); an empty table writes nothing
and returns nothing; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.llm.common import fresh_path, written

LEAST_SHARED = 1000
BLOCK_LINES = 512
NO_ID = -(1 << 63)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)((?::[0-9]+)?)([^#]*)"


def reversed_host_key(url: Column) -> Column:
    """``http://www.example.org:80/a?b`` -> ``org,example,www:80)/a?b``; other strings stay as they are."""
    host = F.lower(F.regexp_extract(url, URL, 1))
    turned = F.array_join(F.reverse(F.split(host, "[.]")), ",")
    key = F.concat(turned, F.regexp_extract(url, URL, 2), F.lit(")"), F.regexp_extract(url, URL, 3))
    return F.coalesce(F.when(host != "", key).otherwise(url), F.lit(""))


def _store(path: str):
    """File system and path of a URI or an absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def record(url: str | None, page_id: int | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record as a gzip member."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    raw = "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse(member: bytes) -> dict:
    """Fields of a record; a stored payload must have the digest that its header names."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if version != "WARC/1.1" or kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    number = lambda urn: int(n) if (n := urn[len("<urn:page:") : -1]) else None
    refers = number(fields["WARC-Refers-To"]) if kind == "revisit" else None
    return {"page_id": number(fields["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": refers}


CAPTURES = "key string, idk long, digest string, file string, offset long, length long"


def write_archives(pages: DataFrame, folder: str, id_col: str, url_col: str, html_col: str, least_shared: int, date: str, file_bytes: int = 1 << 30) -> DataFrame:
    """Write every page's record below ``folder``; returns ``CAPTURES``, one row per record."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.length("payload")})
    shared = rows.where(F.col("size") >= least_shared).groupBy("digest", "size").agg(F.max("id").alias("kept"), F.count("*").alias("n"))
    rows = rows.join(shared.where("n > 1 AND kept IS NOT NULL").drop("n"), ["digest", "size"], "left")
    rows = rows.withColumn("revisit", F.col("kept").isNotNull() & ~F.col("id").eqNullSafe(F.col("kept")))
    rows = rows.select("id", "url", F.when(~F.col("revisit"), F.col("payload")).alias("payload"), "size", "digest", "kept", "revisit", reversed_host_key(F.col("url")).alias("key"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            places = []
            for r in batch.itertuples(index=False):
                if out is None or at >= file_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                page = None if pd.isna(r.id) else int(r.id)
                body = bytes(int(r.size)) if r.revisit else bytes(r.payload)
                member = record(r.url, page, body, r.digest, int(r.kept) if r.revisit else None, bool(r.revisit), date)
                out.write(member)
                places.append((r.key, NO_ID if page is None else page, r.digest, name, at, len(member)))
                at += len(member)
            yield pd.DataFrame(places, columns=[c.split()[0] for c in CAPTURES.split(", ")])
        if out is not None:
            out.close()

    # a double would lose digits of large ids
    rows = rows.withColumns({"id": F.col("id").cast("string"), "kept": F.col("kept").cast("string")})
    return written(rows.mapInPandas(write, CAPTURES), "captures")


def write_index(captures: DataFrame, folder: str, files: int, block_lines: int) -> list[tuple[list, str]]:
    """Write the index files below ``folder``; returns the upper level: (first key, file name), sorted."""
    order = ["key", "idk", "digest", "file", "offset"]
    ordered = captures.repartitionByRange(files, *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        name, out, at, lines, directory, first = f"{uuid.uuid4().hex}.idx", None, 0, [], [], None
        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                lines.append([row[0], int(row[1]), row[2], row[3], int(row[4]), int(row[5])])
                if len(lines) == block_lines:
                    out = out or store.open_output_stream(f"{base}/{name}", compression=None)
                    at = _put_block(out, at, lines, directory)
                    lines = []
        if lines:
            out = out or store.open_output_stream(f"{base}/{name}", compression=None)
            at = _put_block(out, at, lines, directory)
        if out is not None:
            tail = zlib.compress(json.dumps(directory).encode())
            out.write(tail + len(tail).to_bytes(8, "little"))
            out.close()
            first = json.dumps(directory[0][0])
            yield pd.DataFrame({"first": [first], "name": [name]})

    rows = written(ordered.mapInPandas(write, "first string, name string"), "index").collect()  # one row per index file
    return sorted((json.loads(r["first"]), r["name"]) for r in rows)


def _put_block(out, at: int, lines: list, directory: list) -> int:
    block = zlib.compress("\n".join(map(json.dumps, lines)).encode())
    out.write(block)
    directory.append([lines[0][:3], at, len(block)])
    return at + len(block)


class Index:
    """The captures of a key, by binary search over files and blocks, one block and one directory in memory."""

    def __init__(self, folder: str, upper: list[tuple[list, str]]):
        self.store, self.base = _store(folder)
        self.firsts, self.names = [list(k) for k, _ in upper], [n for _, n in upper]
        self.open_name = self.file = self.directory = self.block_at = None
        self.lines: list = []

    def _directory(self, name: str) -> None:
        if self.open_name != name:
            self.file = self.store.open_input_file(f"{self.base}/{name}")
            size = self.file.size()
            n = int.from_bytes(self.file.read_at(8, size - 8), "little")
            self.directory = json.loads(zlib.decompress(self.file.read_at(n, size - 8 - n)))
            self.starts = [d[0] for d in self.directory]
            self.open_name, self.block_at = name, None

    def _block(self, k: int) -> None:
        if self.block_at != k:
            _, at, n = self.directory[k]
            self.lines = [json.loads(x) for x in zlib.decompress(self.file.read_at(n, at)).decode().split("\n")]
            self.block_at = k

    def captures(self, key: list) -> Iterator[list]:
        """All index lines of ``[key, id, digest]``; equal keys may run over blocks and files."""
        f = max(0, bisect_right(self.firsts, key) - 1)
        while f > 0 and self.firsts[f] == key:
            f -= 1
        while f < len(self.names) and self.firsts[f] <= key:
            self._directory(self.names[f])
            k = max(0, bisect_right(self.starts, key) - 1)
            while k > 0 and self.starts[k] == key:
                k -= 1
            while k < len(self.starts) and self.starts[k] <= key:
                self._block(k)
                yield from [x for x in self.lines if x[:3] == key]
                k += 1
            f += 1


RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_back(keys: DataFrame, folder: str, index_folder: str, upper: list[tuple[list, str]], files: int) -> DataFrame:
    """``keys(key, idk, digest)``, distinct -> ``RESULT``, one row per capture found."""
    ordered = keys.repartitionByRange(files, "key", "idk", "digest").sortWithinPartitions("key", "idk", "digest")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, (store, base), open_files = Index(index_folder, upper), _store(folder), {}
        for batch in batches:
            rows = []
            for key, idk, digest in batch[["key", "idk", "digest"]].itertuples(index=False, name=None):
                for *_, name, at, n in index.captures([key, int(idk), digest]):
                    if name not in open_files:
                        if len(open_files) >= 64:
                            open_files.pop(next(iter(open_files))).close()
                        open_files[name] = store.open_input_file(f"{base}/{name}")
                    rows.append(parse(open_files[name].read_at(n, at)))
            # nullable integers: a double would lose digits of large ids
            kinds = (c.split() for c in RESULT.split(", "))
            yield pd.DataFrame({c: pd.array([r[c] for r in rows], "Int64" if kind == "long" else object) for c, kind in kinds})

    return ordered.mapInPandas(read, RESULT)


def archive_round_trip(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_shared: int = LEAST_SHARED,
    block_lines: int = BLOCK_LINES,
    rows_per_file: int = 1_000_000,
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Write the archives and their index, look every page up and read its record: ``RESULT``."""
    spark = pages.sparkSession
    folder, index_folder = fresh_path(spark, "warc"), fresh_path(spark, "warc-index")
    captures = write_archives(pages, folder, id_col, url_col, html_col, least_shared, date)
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), captures.count() // rows_per_file)
    upper = write_index(captures, index_folder, files, block_lines)
    wanted = pages.select(
        reversed_host_key(F.col(url_col)).alias("key"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("idk"),
        F.sha1(F.coalesce(F.col(html_col), F.lit("")).cast("binary")).alias("digest"),
    ).distinct()
    return read_back(wanted, folder, index_folder, upper, files).withColumnRenamed("page_id", id_col)
