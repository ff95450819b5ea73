"""A data source of landed feed replies: items, and one attempt row for each reply.

A reply is a JSON line (source, url, status, etag, last_modified, body, category, country, known_ms) in a folder
``feed=..`` of its own; each such folder is a partition of the read.  ``spark.dataSource.register(FeedReplies)`` makes
``spark.read.format("feed_replies")`` known.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from urllib.parse import unquote, urlparse
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ITEMS = "source string, seq int, title string, url string, description string, published_ms bigint, category string, country string"
ATTEMPTS = "source string, url string, status int, outcome string, error_code string, fetched int, accepted int, rejected int, latest_ms bigint, etag string, last_modified string"
#: How far ahead of the clock an item may be.
SKEW_MS = 5 * 60_000


@dataclass
class Feed(InputPartition):
    files: list[str]


@dataclass
class Item:
    title: str | None
    url: str | None
    description: str | None
    published_ms: int | None


def time_ms(value: str | None) -> int | None:
    """A time as feeds write it, RFC 822 or ISO 8601, in milliseconds; none if it can't be read.  Without a zone it is UTC."""
    text = (value or "").strip()
    for read in (parsedate_to_datetime, lambda x: datetime.fromisoformat(x.replace("Z", "+00:00"))):
        try:
            at = read(text)
        except (TypeError, ValueError, IndexError):
            continue
        return round((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp() * 1000)
    return None


def items_of(body: str) -> list[Item]:
    """The items of an RSS or Atom document in order; ParseError for what is no XML."""
    out = []
    local = lambda e: e.tag.rpartition("}")[2]
    for node in ElementTree.fromstring(body).iter():
        if local(node) not in ("item", "entry"):
            continue
        own: dict[str, str] = {}
        for child in node:
            value = child.get("href") if local(child) == "link" and child.get("href") else "".join(child.itertext())
            own.setdefault(local(child), value.strip())
        first = lambda *names: next((own[n] for n in names if own.get(n)), None)  # noqa: B023, E731
        out.append(Item(first("title"), first("link", "guid", "id"), first("encoded", "description", "content", "summary"), time_ms(first("pubDate", "published", "updated", "date"))))
    return out


def accepted(items: list[Item], now_ms: int, age_ms: int) -> list[Item]:
    """Dated items that are neither too old nor ahead, the newest first."""
    fits = [x for x in items if x.published_ms is not None and now_ms - age_ms <= x.published_ms <= now_ms + SKEW_MS]
    return sorted(fits, key=lambda x: (-x.published_ms, x.url or ""))


def read_reply(reply: dict, now_ms: int, age_ms: int, limit: int) -> tuple[list[Item], tuple]:
    """A reply's items, and its attempt (outcome, error_code, fetched, accepted, rejected, latest_ms).

    304 has no items: its attempt is judged by the newest item known before (``known_ms``).
    """
    status, known = int(reply.get("status") or 0), reply.get("known_ms")
    if status == 304:
        outcome = "empty" if known is None else "healthy" if now_ms - known <= age_ms else "stale"
        return [], (outcome, "freshness_unknown" if known is None else None, 0, 0, 0, known)
    if not 200 <= status < 300:
        return [], ("provider_error", f"http_{status}" if status else "network", 0, 0, 0, None)
    try:
        every = items_of(reply.get("body") or "")
    except ElementTree.ParseError:
        return [], ("parse_error", "invalid_xml", 0, 0, 0, None)
    kept = accepted(every, now_ms, age_ms)[:limit]
    return kept, ("healthy" if kept else "empty", None, len(every), len(kept), len(every) - len(kept), max((x.published_ms for x in kept), default=None))


class FeedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        parsed = urlparse(options["path"])
        if parsed.scheme not in ("", "file"):
            raise ValueError("replies have to be in a folder that executors can open")
        self.folder, self.rows = unquote(parsed.path), options.get("rows", "items")
        self.now_ms, self.age_ms, self.limit = (int(options.get(k, d)) for k, d in (("now_ms", 1 << 62), ("age_ms", 1 << 61), ("limit", 1 << 31)))

    def partitions(self) -> list[InputPartition]:
        feeds = sorted(d.path for d in os.scandir(self.folder) if d.is_dir() and d.name.startswith("feed="))
        listed = [sorted(f.path for f in os.scandir(d) if f.is_file() and not f.name.startswith((".", "_"))) for d in feeds]
        return [Feed(files) for files in listed if files]

    def read(self, partition: Feed) -> Iterator[tuple]:
        for path in partition.files:
            with open(path, encoding="utf-8") as lines:
                for line in lines:
                    reply = json.loads(line)
                    items, attempt = read_reply(reply, self.now_ms, self.age_ms, self.limit)
                    if self.rows == "attempts":
                        outcome, error, *counts, latest = attempt
                        yield (reply.get("source"), reply.get("url"), reply.get("status"), outcome, error, *counts, latest, reply.get("etag"), reply.get("last_modified"))
                    else:
                        for i, x in enumerate(items):
                            yield (reply.get("source"), i, x.title, x.url, x.description, x.published_ms, reply.get("category"), reply.get("country"))


class FeedReplies(DataSource):
    """``path``, ``rows`` ("items" or "attempts"), ``now_ms``, ``age_ms`` and ``limit`` are its options; items carry their source's category and country."""

    @classmethod
    def name(cls) -> str:
        return "feed_replies"

    def schema(self) -> str:
        return ATTEMPTS if self.options.get("rows") == "attempts" else ITEMS

    def reader(self, schema) -> DataSourceReader:
        return FeedReader(self.options)
