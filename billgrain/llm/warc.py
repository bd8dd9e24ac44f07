"""WARC archives of pages and a globally ordered index of them.

Pages are written as WARC 1.1 records, a payload that several of them share only once: the
others are revisit records that refer to it. Each archive, read back, gives a run of its
captures sorted by URL key and time, cut at common splitters. The slices of a range of keys
from all runs are merged by a loser tree, so ranges one after another are the capture
histories of all URLs in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import parse_qsl, urlencode, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billgrain.llm.common import short_batches, stored, text_of
from billgrain.session import counted_keys

#: Payloads of at least so many bytes are stored once.
SHARED_BYTES = 1000
#: Records of one archive file.
FILE_RECORDS = 1000
#: Captures in a range of the index, about, and sampled keys for each splitter.
RANGE_RECORDS, RANGE_SAMPLE = 20_000, 8
#: The ends of lines and of records, and the profile of revisits.
LINE, END = "\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", captured: Column | None = None) -> DataFrame:
    """``value``: each page's WARC record without the record's end.

    Of pages with equal payloads of ``SHARED_BYTES`` or more, those with the largest id are
    responses and the others revisits of it; null ids never are the largest, and are responses
    where all are null. Null html is an empty payload; a null url is left out of the record.
    """
    when = F.timestamp_seconds(F.lit(1_577_836_800) + F.pmod(F.xxhash64(url_col, id_col), F.lit(31_536_000))) if captured is None else captured
    payload = text_of(html_col)
    rows = pages.select(
        F.col(id_col).alias("id"),
        F.regexp_replace(F.col(url_col), r"[\x00-\x20\x7f]", "").alias("url"),
        when.alias("time"),
        payload.alias("payload"),
        F.octet_length(payload).alias("bytes"),
        F.sha1(payload).alias("digest"),
    )
    shared = rows.where(F.col("bytes") >= SHARED_BYTES).groupBy("digest", "bytes").agg(F.max("id").alias("keeper"), F.count("*").alias("n"))
    _, shared = counted_keys(shared.where("n > 1").drop("n"))
    rows = rows.join(shared, ["digest", "bytes"], "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "), F.col("bytes"), F.lit(END))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    name = lambda id: F.concat(F.lit(f"<{URN}"), F.coalesce(id.cast("string"), F.lit("none")), F.lit(">"))
    header = F.concat_ws(
        LINE,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("id"))),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Date: "), F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("keeper")))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block)),
    )
    return rows.select(F.concat(header, F.lit(END), block).alias("value"))


def write_archives(pages: DataFrame, folder: str, **columns) -> None:
    """Archive files in a new folder. A record ends as a line of this text file does."""
    records(pages, **columns).write.option("lineSep", END).option("maxRecordsPerFile", FILE_RECORDS).text(folder)


def read_records(content: memoryview) -> Iterator[tuple[dict[str, str], memoryview]]:
    """Headers and blocks of an archive."""
    at, data = 0, bytes(content)
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode().split(LINE)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        begin, size = stop + 4, int(headers["Content-Length"])
        yield headers, memoryview(data)[begin : begin + size]
        if data[begin + size : begin + size + 4] != b"\r\n\r\n":
            raise ValueError(f"a record does not end at {begin + size}")
        at = begin + size + 4


def url_key(url: str | None) -> str:
    """Host names from the top domain down, then path and sorted query; without scheme, ``www`` and fragment."""
    if not url:
        return ""
    try:
        parts = urlsplit(url if "//" in url else f"//{url}")
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url.lower()
    query = urlencode(sorted(parse_qsl(parts.query, keep_blank_values=True)))
    mark = f":{port}" if port not in (None, 80, 443) else ""
    return f"{','.join(reversed(host.split('.')))}{mark}){parts.path or '/'}{f'?{query}' if query else ''}"


def capture(headers: dict[str, str], block: memoryview) -> dict:
    """An index entry. The digest of a payload that is there is computed and must be the header's."""
    http, _, payload = bytes(block).partition(b"\r\n\r\n")
    size = int(http.split(b"Content-Length: ")[1].split(b"\r\n")[0])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if headers["WARC-Type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"the payload of {headers['WARC-Record-ID']} is damaged")
    id_of = lambda name: None if (x := headers.get(name, f"<{URN}none>")[1 + len(URN) : -1]) == "none" else x
    return {
        "key": url_key(headers.get("WARC-Target-URI")),
        "time": headers.get("WARC-Date", ""),
        "id": id_of("WARC-Record-ID"),
        "bytes": size,
        "digest": digest,
        "type": headers["WARC-Type"],
        "refers": id_of("WARC-Refers-To"),
    }


def order(entry: dict) -> tuple[str, str, str]:
    return entry["key"], entry["time"], entry["id"] or ""


def merged(runs: list[list[dict]]) -> Iterator[dict]:
    """Sorted runs merged by a loser tree: each entry costs one path from its leaf to the root.

    Inner nodes 1 to k - 1 hold the run that lost there; leaf i hangs below node (i + k) / 2.
    """
    k = len(runs)
    if k == 1:
        yield from runs[0]
        return
    at = [0] * k
    heads: list[tuple | None] = [order(r[0]) if r else None for r in runs]
    before = lambda a, b: heads[b] is None or (heads[a] is not None and (heads[a], a) < (heads[b], b))
    losers, winners = [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if before(a, b) else (b, a)
    winner = winners[1]
    while heads[winner] is not None:
        run = runs[winner]
        yield run[at[winner]]
        at[winner] += 1
        heads[winner] = order(run[at[winner]]) if at[winner] < len(run) else None
        node = (winner + k) // 2
        while node:
            if before(losers[node], winner):
                winner, losers[node] = losers[node], winner
            node //= 2


ENTRY = "key string, time string, id string, bytes long, digest string, type string, refers string"
KINDS = pa.struct([(n, pa.int64() if n == "bytes" else pa.string()) for n in ("key", "time", "id", "bytes", "digest", "type", "refers")])


def splitters(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> list[str]:
    """URL keys that cut the index into ranges of about ``RANGE_RECORDS`` captures.

    A sample of ``RANGE_SAMPLE`` URLs for each range, by a digest of url and id, comes to the driver.
    """
    ranges = -(-pages.count() // RANGE_RECORDS)
    if ranges < 2:
        return []
    sample = pages.select(F.col(url_col).alias("url")).orderBy(F.xxhash64(url_col, id_col)).limit(ranges * RANGE_SAMPLE)
    keys = sorted(url_key(r["url"]) for r in sample.collect())
    return sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)})


def sorted_runs(spark, folder: str, cuts: list[str]) -> DataFrame:
    """``range, salt, run, entries``: each archive's captures, sorted, cut at the splitters."""
    from bisect import bisect_right
    from itertools import groupby

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                entries = sorted((capture(*r) for r in read_records(content.as_buffer())), key=order)
                slices = [(n, [*part]) for n, part in groupby(entries, lambda e: bisect_right(cuts, e["key"]))]
                columns = [pa.array([n for n, _ in slices], pa.int32()), pa.array([path] * len(slices)), pa.array([s for _, s in slices], pa.list_(KINDS))]
                yield pa.RecordBatch.from_arrays(columns, ["range", "run", "entries"])

    short_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
    return files.mapInArrow(run, f"range int, run string, entries array<struct<{', '.join(x.replace(' ', ':') for x in ENTRY.split(', '))}>>")


def merged_index(runs: DataFrame) -> DataFrame:
    """``range, place`` and the fields of each capture: ranges and places in them in the order of keys, times and ids.

    A URL with more captures than a range should hold is cut further, by runs of times.
    """
    sizes = runs.groupBy("range").agg(F.sum(F.size("entries")).alias("n"))

    def merge(group: pa.Table) -> pa.Table:
        group = group.sort_by("run")
        rows = [*merged(group.column("entries").to_pylist())]
        columns = {"range": pa.array([group.column("range")[0].as_py()] * len(rows), pa.int32()), "part": pa.array([group.column("part")[0].as_py()] * len(rows), pa.string()), "place": pa.array(range(len(rows)), pa.int64())}
        return pa.table(columns | {f.name: pa.array([r[f.name] for r in rows], f.type) for f in KINDS})

    # ranges that hold far more than they should, as one URL may, are told apart by key and day
    day = F.transform("entries", lambda e: F.struct(F.concat_ws(" ", e["key"], F.substring(e["time"], 1, 10)).alias("part"), e.alias("e")))
    _, large = counted_keys(sizes.where(F.col("n") > 4 * RANGE_RECORDS).select("range"))
    large = large.withColumn("large", F.lit(True))
    runs = runs.join(large, "range", "left")
    small = runs.where("large IS NULL").select("range", F.lit("").alias("part"), "run", "entries")
    cut = runs.where("large").select("range", "run", F.explode(day).alias("x")).select("range", "x.part", "run", "x.e")
    cut = cut.groupBy("range", "part", "run").agg(F.array_sort(F.collect_list("e")).alias("entries"))
    return small.unionByName(cut.select("range", "part", "run", "entries")).groupBy("range", "part").applyInArrow(merge, f"range int, part string, place long, {ENTRY}")


def archived(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages written to archives in ``folder`` and read back, with their place in the index.

    ``id, payload_bytes, payload_digest, record_type, refers_to, url_key, captured, position``;
    ``position`` counts all captures from 0 in the order of URL key, time and id. Repeated rows
    are records of their own. An empty table gives no rows; other columns are not read.
    """
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType.simpleString()
    write_archives(pages, folder, id_col=id_col, url_col=url_col, html_col=html_col)
    index = stored(merged_index(sorted_runs(spark, folder, splitters(pages, id_col, url_col))))
    parts = index.groupBy("range", "part").agg(F.count("*").alias("n"))
    first = F.coalesce(F.sum("n").over(Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per part
    return index.join(parts.select("range", "part", first.alias("first")), ["range", "part"]).select(
        F.col("id").cast(kind).alias(id_col),
        F.col("bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("refers").cast(kind).alias("refers_to"),
        F.col("key").alias("url_key"),
        F.col("time").alias("captured"),
        (F.col("first") + F.col("place")).alias("position"),
    )
