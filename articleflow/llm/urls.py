"""URL filters: a sorted array of 64-bit digests, memory-mapped by tasks and probed by binary search.

The array file holds the sorted digests, the offsets of the full strings, and the strings. A probe
finds all entries of its digest and confirms the string, so collisions never decide. Spark's own file
distribution gives every executor a local copy, also executors that join later.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from articleflow.session import fresh_path

#: Lists up to this size travel to each executor as one file; larger ones are joined.
MAX_ARRAY_BYTES = 512 << 20
DIGEST = "<u8"


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains, below ``path``; ``verdict`` is allow or block."""

    verdict: str
    host: str
    path: str = ""

    @property
    def key(self) -> str:
        return f"{self.host}{self.path}"


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode())


def pack(entries: Sequence[str]) -> bytes:
    """The array file: count, sorted digests, string offsets, strings; repeated entries count once."""
    keyed = sorted((digest(e), e.encode()) for e in set(entries))
    ends = np.cumsum([0, *(len(e) for _, e in keyed)], dtype=DIGEST)
    digests = np.array([d for d, _ in keyed], DIGEST)
    return b"".join([np.array([len(keyed)], DIGEST).tobytes(), digests.tobytes(), ends.tobytes(), *(e for _, e in keyed)])


class DigestArray:
    """A view over an array file; nothing but the pages that probes touch is read."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n = int(raw[:8].view(DIGEST)[0])
        self.digests = raw[8 : 8 + 8 * n].view(DIGEST)
        self.ends = raw[8 + 8 * n : 16 + 16 * n].view(DIGEST)
        self.strings = raw[16 + 16 * n :]

    def holds(self, probes: Sequence[str]) -> np.ndarray:
        """Whether each probe is an entry."""
        keys = np.fromiter(map(digest, probes), DIGEST, len(probes))
        low = np.searchsorted(self.digests, keys, "left")
        high = np.searchsorted(self.digests, keys, "right")
        found = np.zeros(len(probes), bool)
        for i in np.flatnonzero(high > low):  # digests that occur: confirm the string
            want = probes[i].encode()
            found[i] = any(
                self.strings[int(self.ends[at]) : int(self.ends[at + 1])].tobytes() == want
                for at in range(low[i], high[i])
            )
        return found


def publish(spark: SparkSession, content: bytes) -> str:
    """Write a file to the shared folder and have Spark hand it to every executor; returns its name."""
    if len(content) > MAX_ARRAY_BYTES:
        raise ValueError(f"{len(content)} bytes are too many for one array; use match_large")
    name = f"digests-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{fresh_path(spark, 'urls')}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(content))
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: str) -> list[str]:
    """The host and its parent domains, longest first."""
    parts = host.split(".")
    return [".".join(parts[i:]) for i in range(len(parts))] if host else []


def judge(
    pages: DataFrame, rules: Sequence[Rule], blocked_hosts: Sequence[str] = (), blocked_urls: Sequence[str] = ()
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, listed.

    The longest rule that fits decides; of equally long ones the longer host. Without a rule a page is
    blocked if its host, a parent domain or its whole url is listed, else allowed. ``listed`` says
    whether it is, under a rule too. A null url or one without ``://`` has an empty host and path and is
    allowed, as no rule or list entry can fit; an exact url entry still does. Repeated rows stay, other
    columns are not read. The lists must fit ``MAX_ARRAY_BYTES``; see ``match_large`` for more.
    """
    spark = pages.sparkSession
    by_key = {r.key: r for r in reversed(rules)}
    lengths = sorted({len(r.path) for r in rules}, reverse=True)
    rule_file = publish(spark, pack(list(by_key)))
    list_file = publish(spark, pack([*(f"host {h}" for h in blocked_hosts), *(f"url {u}" for u in blocked_urls)]))
    ddl = "page_id long, host string, path string, rule string, verdict string, listed boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, lists = DigestArray(SparkFiles.get(rule_file)), DigestArray(SparkFiles.get(list_file))
        for batch in batches:
            ids, urls, hosts, paths = (c.to_pylist() for c in batch.columns)
            probes, owner, listings, listing_owner = [], [], [], []
            for i, (url, host, path) in enumerate(zip(urls, hosts, paths, strict=True)):
                names = suffixes(host)
                for name in names:
                    for n in lengths:
                        if n <= len(path):
                            probes.append(name + path[:n])
                            owner.append((i, n, len(name)))
                    listings.append(f"host {name}")
                    listing_owner.append(i)
                if url is not None:
                    listings.append(f"url {url}")
                    listing_owner.append(i)
            best: dict[int, tuple] = {}
            for at in np.flatnonzero(known.holds(probes)):
                i, n, m = owner[at]
                if len(by_key[probes[at]].path) == n:  # the split between host and path is the rule's own
                    best[i] = max(best.get(i, (0, 0, "")), (n + m, m, probes[at]))
            listed = np.zeros(len(ids), bool)
            listed[[listing_owner[at] for at in np.flatnonzero(lists.holds(listings))]] = True
            rule = [best[i][2] if i in best else None for i in range(len(ids))]
            verdict = [
                by_key[r].verdict if r is not None else "block" if listed[i] else "allow" for i, r in enumerate(rule)
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:1], *batch.columns[2:], pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(listed)],
                names=["page_id", "host", "path", "rule", "verdict", "listed"],
            )

    cut = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return cut.mapInArrow(run, ddl)


def match_large(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id of pages whose host, a parent domain or url is an ``entry`` of a list of any size, by a join on digest and string.

    Entries read ``host NAME`` or ``url URL``, as in the array file.
    """
    parts = F.split(host_of(F.col("url")), r"\.")
    names = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("host "), F.array_join(F.slice(parts, i, F.size(parts)), ".")))
    probes = pages.select("page_id", F.explode(F.concat(names, F.array(F.concat(F.lit("url "), F.col("url"))))).alias("entry"))
    keyed = [df.where("entry is not null").withColumn("digest", F.xxhash64("entry")) for df in (probes, entries.select("entry").distinct())]
    return keyed[0].join(keyed[1], ["digest", "entry"], "left_semi").select("page_id").distinct()
