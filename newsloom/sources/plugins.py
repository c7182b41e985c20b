"""Sources as plug-ins: one data source format for each kind of address, over folders of fetched payloads.

A folder holds parquet files of (source_name, url, fetched_at, payload), partitioned as kind=.../ so that a format
reads its own kind only. spark.read.format("news_<kind>").load(folder) gives items (source_name, pos, title,
link, summary, published); every file is a partition, read and parsed by the executors. Filters on
source_name (equality, lists) and on published (from a time on) are pushed down: the first leaves row groups
unread, the second drops items before they reach Spark. Payloads that do not parse have no items.

    register(spark)
    spark.read.format("news_youtube").load(folder)
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition

ITEMS = "source_name string, pos int, title string, link string, summary string, published timestamp"
RAW = "source_name string, url string, fetched_at timestamp, payload string"
#: characters of a summary
SUMMARY = 800


def _time(text: str | None) -> datetime | None:
    if not text:
        return None
    try:
        found = datetime.fromisoformat(text.strip())
    except ValueError:
        try:
            found = parsedate_to_datetime(text.strip())
        except (TypeError, ValueError):
            return None
    return found if found.tzinfo else found.replace(tzinfo=timezone.utc)


def _plain(text: str | None) -> str:
    return " ".join(re.sub(r"<[^>]*>", " ", text or "").split())


def _named(node: ET.Element, *names: str) -> Iterator[ET.Element]:
    return (child for name in names for child in node if child.tag.rsplit("}", 1)[-1] == name)


def _text(node: ET.Element, *names: str) -> str | None:
    return next((child.text for child in _named(node, *names) if child.text), None)


def feed(payload: str) -> Iterator[tuple]:
    """(title, link, summary, published) of RSS 2.0 or Atom."""
    root = ET.fromstring(payload)
    for node in root.iter():
        kind = node.tag.rsplit("}", 1)[-1]
        if kind == "item":
            yield _text(node, "title"), _text(node, "link"), _text(node, "description"), _time(_text(node, "pubDate"))
        elif kind == "entry":
            link = next((child.get("href") for child in _named(node, "link")), None)
            yield _text(node, "title"), link, _text(node, "summary", "content"), _time(_text(node, "published", "updated"))


def videos(payload: str) -> Iterator[tuple]:
    """Items of a channel's Atom feed, or of its JSON list of videos."""
    if payload.lstrip().startswith("<"):
        yield from feed(payload)
        return
    for v in json.loads(payload)["videos"]:
        yield v.get("title"), f"https://www.youtube.com/watch?v={v['videoId']}", v.get("text"), _time(v.get("published"))


def questions(payload: str) -> Iterator[tuple]:
    for d in json.loads(payload)["data"]:
        t = d["target"]
        yield t.get("title"), f"https://www.zhihu.com/question/{t['id']}", " ".join(filter(None, (d.get("detail_text"), t.get("excerpt")))), None


def posts(payload: str) -> Iterator[tuple]:
    """Items of a mirror's feed, with links to the service itself."""
    for title, link, summary, published in feed(payload):
        yield title, re.sub(r"#.*$", "", re.sub(r"^https?://[^/]+/", "https://x.com/", link or "")) or None, summary, published


def notes(payload: str) -> Iterator[tuple]:
    for n in json.loads(payload)["notes"]:
        card = n.get("note", n)
        yield card.get("title") or card.get("desc"), f"https://www.xiaohongshu.com/explore/{n['id']}", card.get("desc"), None


def papers(payload: str) -> Iterator[tuple]:
    for row in json.loads(payload):
        p = row["paper"]
        yield p.get("title"), f"https://huggingface.co/papers/{p['id']}", p.get("summary"), _time(p.get("publishedAt"))


#: parser of each kind's payloads; gateways give plain feeds
PARSERS = {
    "youtube": videos, "zhihu": questions, "twitter": posts, "xhs": notes, "wewe-rss": feed, "hf-papers": papers, "wechat": feed, "http": feed
}


def items_of(kind: str, payload: str | None) -> list[tuple]:
    """Items of a payload; none where it does not parse."""
    try:
        return list(PARSERS[kind](payload or ""))
    except (ET.ParseError, ValueError, KeyError, TypeError, AttributeError):
        return []


class File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, kind: str, folder: str):
        self.kind, self.folder = kind, folder
        self.names: list[str] | None = None
        self.since: datetime | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes names and a first time; Spark applies what is left, and the time again, which costs little."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if isinstance(f, EqualTo) and column == ("source_name",):
                self._only([f.value])
            elif isinstance(f, In) and column == ("source_name",):
                self._only(list(f.value))
            elif isinstance(f, GreaterThan | GreaterThanOrEqual) and column == ("published",):
                since = f.value if f.value.tzinfo else f.value.replace(tzinfo=timezone.utc)
                self.since = max(self.since, since) if self.since else since
                yield f
            else:
                yield f

    def _only(self, names: list) -> None:
        self.names = names if self.names is None else [n for n in self.names if n in names]

    def partitions(self) -> list[File]:
        import pyarrow.fs as fs

        store, root = fs.FileSystem.from_uri(f"{self.folder.rstrip('/')}/kind={self.kind}")
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        return [File(f.path) for f in found if f.is_file and f.path.endswith(".parquet")]

    def read(self, partition: File | None) -> Iterator[tuple]:
        """Items of a file; a folder without files is read as no partition."""
        if partition is None:
            return
        import pyarrow.compute as pc
        import pyarrow.fs as fs
        import pyarrow.parquet as pq

        store, _ = fs.FileSystem.from_uri(self.folder)
        keep = None if self.names is None else pc.field("source_name").isin(self.names)
        with store.open_input_file(partition.path) as f:
            if keep is None:
                tables = (b for b in pq.ParquetFile(f).iter_batches(256, columns=["source_name", "payload"]))
            else:
                tables = pq.read_table(f, columns=["source_name", "payload"], filters=keep).to_batches(256)
            for batch in tables:
                for name, payload in zip(*(batch.column(c).to_pylist() for c in ("source_name", "payload")), strict=True):
                    for pos, (title, link, summary, published) in enumerate(items_of(self.kind, payload)):
                        if self.since is None or (published is not None and published >= self.since):
                            yield name, pos, _plain(title), link, _plain(summary)[:SUMMARY], published


class _News(DataSource):
    kind = "http"

    @classmethod
    def name(cls) -> str:
        return format_of(cls.kind)

    def schema(self) -> str:
        return ITEMS

    def reader(self, schema) -> _Reader:
        return _Reader(self.kind, self.options["path"])


def format_of(kind: str) -> str:
    return "news_" + kind.replace("-", "_")


def register(spark: SparkSession) -> None:
    """The format of every kind. They take filters, for which the session's filter pushdown of Python sources must be on: it is turned on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    for kind in PARSERS:
        spark.dataSource.register(type(f"News_{kind.replace('-', '_')}", (_News,), {"kind": kind}))


def store(payloads: DataFrame, folder: str) -> None:
    """Append fetched payloads (kind and the columns of RAW) to a folder."""
    payloads.write.mode("append").partitionBy("kind").parquet(folder)


def read(spark: SparkSession, folder: str, sources: DataFrame | None = None) -> DataFrame:
    """Items of all kinds, with the kind; of the given sources (source_name) only, where any are given."""
    from pyspark.sql import functions as F

    out = None
    for kind in PARSERS:
        one = spark.read.format(format_of(kind)).load(folder).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out if sources is None else out.join(sources.select("source_name").distinct(), "source_name", "left_semi")
