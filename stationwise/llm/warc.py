"""WARC archives: writing, reading back, and merging their sorted capture indexes.

Archives are written by the tasks, a gzip member a record, so that an index entry's offset and length find its record;
a file ends at ``FILE_BYTES`` or ``FILE_RECORDS``.  Reading goes through a file member by member, by the lengths that the
records state, and leaves a run in the shared folder: the file's index entries sorted by URL key and time, as Parquet with
small row groups.  An external merge makes one index of all runs: tasks for ranges of (URL key, time) open about
``FAN_IN`` runs each, read them a row group at a time, and merge them by a loser tree, in as many levels as it takes; so
no task holds more than a row group of each run, the result is globally ordered, and a host or URL with very many captures
spreads over many ranges, as far as its captures differ in time.

Files are known by what the tasks that ended well report; what a lost task leaves behind is never read.  They are opened
through ``pyarrow.fs``, wherever the shared folder lies.

A null html is an empty payload; a null URL leaves its header out and its key empty; control characters
in URLs are percent-encoded.  A record's date is ``EPOCH`` and as many seconds as the page_id (null: 0), modulo 10^9.  Of
records with one payload, at least ``MIN_REVISIT`` bytes long, that with the largest page_id (null: smallest) is the
response and the others revisit it; rows that repeat its id are responses too.  An empty table gives empty archives
and an empty index; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationwise.llm.common import materialize, table, table_path

MIN_REVISIT, FILE_BYTES, FILE_RECORDS = 1_000, 128 << 20, 50_000
FAN_IN, RANGE_ENTRIES, GROUP_ENTRIES, SAMPLED_KEYS = 64, 100_000, 2_000, 10_000
EPOCH, SECONDS = "2024-01-01T00:00:00Z", 1_000_000_000
_IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ENTRY = "url_key string, ts string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, file string, place long, length long"
_ARROW = pa.schema([(f.split()[0], {"string": pa.string(), "long": pa.int64()}[f.split()[1]]) for f in _ENTRY.split(", ")])


def _file(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def with_roles(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """``(page_id, url, html, digest, refers_to)``; ``refers_to`` is null for responses."""
    html = F.coalesce("html", F.lit("")).alias("html")
    pages = pages.select("page_id", "url", html).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    long_ = pages.where(F.octet_length("html") >= min_revisit).select("page_id", "digest")
    shared = long_.groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    revisits = long_.join(shared, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).distinct()
    revisits = revisits.select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), F.col("first").alias("refers_to"))
    same = F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest"))
    return pages.join(revisits, same, "left").drop("r_id", "r_digest")


def records(pages: DataFrame) -> DataFrame:
    """``value``: the WARC record of each row of ``with_roles``."""

    def line(name: str, *value) -> F.Column:
        return F.concat(F.lit(f"{name}: "), *value, F.lit("\r\n"))

    def urn(c: str) -> F.Column:
        return F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))

    revisit = F.col("refers_to").isNotNull()
    url = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    at = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH), "yyyy-MM-dd'T'HH:mm:ssX") + F.pmod(F.coalesce(F.col("page_id").cast("long"), F.lit(0)), F.lit(SECONDS))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.octet_length("html").cast("string")), F.lit("\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    return pages.select(
        F.concat(
            F.lit("WARC/1.1\r\n"),
            line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
            line("WARC-Record-ID", urn("page_id")),
            line("WARC-Date", at),
            F.when(F.col("url").isNull(), F.lit("")).otherwise(line("WARC-Target-URI", url)),
            line("WARC-Payload-Digest", F.lit("sha1:"), F.col("digest")),
            F.when(revisit, F.concat(line("WARC-Refers-To", urn("refers_to")), line("WARC-Profile", F.lit(_IDENTICAL)))).otherwise(F.lit("")),
            line("Content-Type", F.lit("application/http; msgtype=response")),
            line("Content-Length", F.octet_length(block).cast("string")),
            F.lit("\r\n"),
            block,
            F.lit("\r\n\r\n"),
        ).alias("value")
    )


def write_archives(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, file_bytes: int = FILE_BYTES, file_records: int = FILE_RECORDS) -> DataFrame:
    """``(file, records, bytes)`` of the archives written below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, records, size = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], ["file", "records", "bytes"])

        for batch in batches:
            for value in batch.column(0):
                if out is None:
                    name, records, size = f"{path}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    system, place = _file(name)
                    system.create_dir(place.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(place, compression=None)
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip member
                member = pack.compress(value.as_buffer()) + pack.flush()
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= file_bytes or records >= file_records:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    made = records(with_roles(pages, min_revisit)).select(F.col("value").cast("binary"))
    return materialize(made.mapInArrow(run, "file string, records long, bytes long"), "archives")


def members(stream, step: int = 1 << 16) -> Iterator[tuple[bytes, int, int]]:
    """Each gzip member of a stream: what it holds, where it begins and how long it is."""
    held, at = b"", 0
    while True:
        unpack, out, used = zlib.decompressobj(31), [], 0
        while not unpack.eof:
            if not held:
                held = bytes(stream.read(step))
                if not held:
                    if used:
                        raise ValueError("the archive's last record is cut off")
                    return
            out.append(unpack.decompress(held))
            used += len(held) - len(unpack.unused_data)
            held = unpack.unused_data
        yield b"".join(out), at, used
        at += used


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record, by the lengths that the records state."""
    while first := stream.readline():
        if not first.strip():
            continue
        if not first.startswith(b"WARC/1."):
            raise ValueError(f"no WARC record where one should start: {first[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
            headers[name.strip().lower()] = value.strip()
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) < length:
            raise ValueError(f"the record {headers.get('warc-record-id')} is cut off")
        yield headers, block


def read_record(file: str, place: int, length: int) -> tuple[dict[str, str], bytes]:
    """The record that an index entry points to."""
    system, path = _file(file)
    with system.open_input_file(path) as stream:
        stream.seek(place)
        return next(parse(io.BytesIO(zlib.decompress(stream.read(length), 31))))


def url_key(url: str | None) -> str:
    """Host labels from the top domain down, then the rest: ``com,example)/path?query``, lower-cased."""
    rest = (url or "").strip().lower().partition("://")
    rest = rest[2] or rest[0]
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host = rest[:cut].rpartition("@")[2].partition(":")[0]
    return f"{','.join(reversed(host.split('.')))}){rest[cut:].partition('#')[0] or '/'}" if rest else ""


def _page(urn: str | None) -> int | None:
    digits = (urn or "").rpartition(":")[2].rstrip(">")
    return int(digits) if digits.lstrip("-").isdigit() else None


def _entry(headers: dict[str, str], block: bytes, file: str, place: int, length: int) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = headers["warc-type"], headers["warc-payload-digest"].partition(":")[2]
    if kind == "response":
        size, found = len(payload), hashlib.sha1(payload).hexdigest()
        if found != digest:
            raise ValueError(f"the payload of {headers['warc-record-id']} does not have its digest")
    else:
        size = int(next(x.partition(b":")[2] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    url = headers.get("warc-target-uri")
    return url_key(url), headers["warc-date"], _page(headers["warc-record-id"]), url, kind, _page(headers.get("warc-refers-to")), size, digest, file, place, length


def _order(entry: tuple) -> tuple:
    return entry[0], entry[1], entry[2] is not None, entry[2] or 0, entry[8], entry[9]


def _batch(entries: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*entries, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _write_run(entries: Iterator[tuple], path: str) -> tuple[str, int, list[tuple[str, str]]]:
    """Write sorted entries; the run's name, how many it has, and the first key of each row group."""
    import pyarrow.parquet as pq

    name, n, firsts, held = f"{path}/{uuid.uuid4().hex}.run", 0, [], []
    system, place = _file(name)
    system.create_dir(place.rpartition("/")[0], recursive=True)
    with system.open_output_stream(place) as out, pq.ParquetWriter(out, _ARROW) as writer:

        def group() -> None:
            firsts.append(held[0][:2])
            writer.write_batch(_batch(held), row_group_size=GROUP_ENTRIES)
            held.clear()

        for entry in entries:
            held.append(entry)
            n += 1
            if len(held) == GROUP_ENTRIES:
                group()
        if held:
            group()
    return name, n, firsts


def read_runs(files: DataFrame, path: str) -> DataFrame:
    """``(run, entries, firsts)``: a run below ``path`` of each of the archives ``files(file)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                system, place = _file(file)
                with system.open_input_stream(place, compression=None) as stream:
                    found = [_entry(h, b, file, at, n) for raw, at, n in members(stream) for h, b in parse(io.BytesIO(raw))]
                name, n, firsts = _write_run(sorted(found, key=_order), path)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([[{"url_key": k, "ts": t} for k, t in firsts]], _FIRSTS)], ["run", "entries", "firsts"])

    spread = files.select("file").repartition(max(1, files.count()), "file")
    return materialize(spread.mapInArrow(run, "run string, entries long, firsts array<struct<url_key: string, ts: string>>"), "runs")


_FIRSTS = pa.list_(pa.struct([("url_key", pa.string()), ("ts", pa.string())]))


def _part(run: str, lo: tuple | None, hi: tuple | None) -> Iterator[tuple]:
    """A run's entries with keys from ``lo`` to before ``hi``, read a row group at a time."""
    import pyarrow.parquet as pq

    system, place = _file(run)
    with system.open_input_file(place) as source:
        file = pq.ParquetFile(source)
        for g in range(file.num_row_groups):
            seen = file.metadata.row_group(g).column(0).statistics
            if seen is not None and seen.has_min_max and (lo is not None and seen.max < lo[0] or hi is not None and seen.min > hi[0]):
                continue
            for entry in zip(*[c.to_pylist() for c in file.read_row_group(g).columns], strict=True):
                if hi is not None and entry[:2] >= hi:
                    return
                if lo is None or entry[:2] >= lo:
                    yield entry


def merge_runs(runs: list[Iterator], key=_order) -> Iterator:
    """k-way merge by a tree of losers: each inner node keeps the loser of its match, the winner moves on."""
    runs = [iter(r) for r in runs]
    k, done = len(runs), object()

    def following(i: int) -> tuple:
        item = next(runs[i], done)
        return (done, None) if item is done else (key(item), item)

    heads = [following(i) for i in range(k)]

    def less(a: int, b: int) -> bool:
        if heads[a][0] is done or heads[b][0] is done:
            return heads[b][0] is done and heads[a][0] is not done
        return (heads[a][0], a) < (heads[b][0], b)

    losers = [0] * k
    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if less(a, b) else (b, a)
    best = winners[1] if k > 1 else 0
    while k and heads[best][0] is not done:
        yield heads[best][1]
        heads[best] = following(best)
        node = (best + k) // 2
        while node:
            if less(losers[node], best):
                losers[node], best = best, losers[node]
            node //= 2


def _bounds(runs: DataFrame, ranges: int) -> list[tuple[str, str]]:
    """Keys that cut all entries into about equal ranges, from at most about ``SAMPLED_KEYS`` first keys of row groups."""
    keys = runs.select(F.explode("firsts").alias("k")).select("k.*")
    every = max(1, -(-keys.count() // SAMPLED_KEYS))
    drawn = sorted((r.url_key, r.ts) for r in keys.where(F.pmod(F.xxhash64("url_key", "ts"), F.lit(every)) == 0).collect())
    cuts = {drawn[len(drawn) * i // ranges] for i in range(1, ranges)} if drawn else set()
    return sorted(cuts)


def merged_index(runs: DataFrame, path: str, fan_in: int = FAN_IN, range_entries: int = RANGE_ENTRIES) -> DataFrame:
    """All entries of ``read_runs`` in the order of URL key and time over the whole result.

    Runs of the levels between are left below ``path``.
    """
    n_runs, n = runs.agg(F.count(F.lit(1)), F.coalesce(F.sum("entries"), F.lit(0))).first()
    bounds = _bounds(runs, max(1, -(-n // range_entries)))
    edges = [None, *bounds, None]

    def parts(ranges: int, names: list[str]) -> Iterator[tuple]:
        return merge_runs([_part(r, edges[ranges], edges[ranges + 1]) for r in names])

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ranges, names in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name, _, _ = _write_run(parts(ranges, names), path)
                yield pa.RecordBatch.from_arrays([pa.array([ranges], pa.int64()), pa.array([name])], ["range", "run"])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ranges, names in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held: list[tuple] = []
                for entry in parts(ranges, names):
                    held.append(entry)
                    if len(held) == 10_000:
                        yield _batch(held)
                        held = []
                if held:
                    yield _batch(held)

    todo = runs.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(bounds)).cast("long"))).alias("range"), "run")
    while n_runs > fan_in:
        groups = -(-2 * n_runs // fan_in)
        by = todo.groupBy("range", F.pmod(F.xxhash64("run"), F.lit(groups)).alias("g")).agg(F.collect_list("run").alias("names"))  # about half of ``fan_in``
        todo = materialize(by.select("range", "names").repartition("range", "names").mapInArrow(level, "range long, run string"), "runs-merged")
        n_runs = groups
    by = todo.groupBy("range").agg(F.collect_list("run").alias("names"))
    return by.repartitionByRange(len(bounds) + 1, "range").sortWithinPartitions("range").mapInArrow(last, _ENTRY)


def op7_loser_tree_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = table_path(spark, "warc")
    files = write_archives(table(spark, sf_dir, "pages"), path)
    return merged_index(read_runs(files, path), path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = r"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS body FROM pages
), d AS (
  SELECT page_id, url, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p
), g AS (
  SELECT payload_digest, max(page_id) AS first FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT d.page_id, payload_bytes, d.payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN g ON d.payload_digest = g.payload_digest AND payload_bytes >= 1000
"""
