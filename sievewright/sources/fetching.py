"""Requests from the executors: bounded in number and in bytes, with what failed as rows beside what was read.

A stage that fetches has at most as many partitions as requests may be in flight, and each makes one at a time, so no
counter has to be shared over the cluster. What can't be fetched marks its record and ends nothing else.
"""

from __future__ import annotations

import base64
import json
import time
import urllib.error
import urllib.parse
import urllib.request
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed

#: Bytes read at once, and bytes of bodies that a task holds before it hands them on.
CHUNK, HELD = 64 << 10, 16 << 20

COMMENTS = "issue_key string, pos long, comment string, error string"
BODIES = "issue_key string, pos long, outcome string, text string, bytes long, truncated boolean, error string"


class Refused(Exception):
    """An answer that is not read, as it is of another origin or packed in an unknown way."""


class TooLarge(Exception):
    """An answer that says it is larger than what may be read: a limit, and no failure."""


def auth_header(token: str = "", email: str = "") -> dict[str, str]:
    """Bearer with a token alone, basic with an address too, nothing without a token."""
    if not token:
        return {}
    return {"Authorization": f"Basic {base64.b64encode(f'{email}:{token}'.encode()).decode()}" if email else f"Bearer {token}"}


def retry_after(header: str | None, now: float | None = None) -> float | None:
    """Seconds to wait, given as a number or as an HTTP date."""
    if not header:
        return None
    try:
        return max(0.0, float(header))
    except ValueError:
        pass
    try:
        return max(0.0, parsedate_to_datetime(header).timestamp() - (time.time() if now is None else now))
    except (TypeError, ValueError):
        return None


def backoff(attempt: int, status: int | None, header: str | None = None) -> float | None:
    """Seconds before the next attempt (from 0), or None where another one is no use."""
    if attempt >= 2 or status in (401, 403) or (status is not None and status not in (429, 503) and status < 500):
        return None
    if status in (429, 503):
        asked = retry_after(header)
        return min(60.0, asked if asked is not None else 0.5 * 2**attempt)
    return min(30.0, 0.5 * 2**attempt)


def origin(url: str) -> tuple[str, str, int | None]:
    """Scheme, host and port of a URL; a port that isn't said is the scheme's own."""
    parts = urllib.parse.urlsplit(url)
    return parts.scheme, parts.hostname or "", parts.port or {"http": 80, "https": 443}.get(parts.scheme)


class _SameOrigin(urllib.request.HTTPRedirectHandler):
    """Follows redirects within an origin only: the token must not reach another."""

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        if origin(newurl) != origin(req.full_url):
            raise Refused("redirected to another origin")
        return super().redirect_request(req, fp, code, msg, headers, newurl)


@dataclass(frozen=True)
class Server:
    """The interface that records come from. ``tasks`` bounds the requests in flight, ``pause`` is what waits between attempts."""

    base: str
    headers: dict[str, str] = field(default_factory=dict, repr=False)
    tasks: int = 2
    timeout: float = 30.0
    proxy: bool = True
    pause: Callable[[float], None] = time.sleep

    def open(self, url: str):
        """An open answer, with at most three attempts."""
        opener = urllib.request.build_opener(_SameOrigin, *([] if self.proxy else [urllib.request.ProxyHandler({})]))
        attempt = 0
        while True:
            status, header = None, None
            try:
                return opener.open(urllib.request.Request(url, headers={"Accept": "application/json", **self.headers}), timeout=self.timeout)
            except urllib.error.HTTPError as error:
                status, header, failure = error.code, error.headers.get("Retry-After"), error
            except (urllib.error.URLError, TimeoutError, ConnectionError) as error:
                failure = error
            wait = backoff(attempt, status, header)
            if wait is None:
                raise RuntimeError(f"request failed: {status or type(failure).__name__}") from None
            self.pause(wait)
            attempt += 1

    def json(self, url: str) -> dict:
        """A JSON object by GET."""
        with self.open(url) as answer:
            found = json.load(answer)
        if not isinstance(found, dict):
            raise ValueError("the answer is no JSON object")
        return found

    def body(self, url: str, limit: int) -> tuple[bytes, bool]:
        """(bytes, whether they were cut): at most ``limit`` of them are ever held, whatever an answer says of its length or unpacks to."""
        url = urllib.parse.urljoin(f"{self.base.rstrip('/')}/", url)
        if origin(url) != origin(self.base):
            raise Refused("outside the origin")
        with self.open(url) as answer:
            declared = answer.headers.get("Content-Length", "")
            if declared.isdigit() and int(declared) > limit:
                raise TooLarge(f"{declared} bytes are over the limit")
            packed = answer.headers.get("Content-Encoding", "").lower()
            if packed not in ("", "identity", "gzip", "deflate"):
                raise Refused(f"packed by {packed}")
            unpack, out, came = (zlib.decompressobj(47) if packed in ("gzip", "deflate") else None), bytearray(), 0
            while chunk := answer.read(CHUNK):
                came += len(chunk)
                while chunk:
                    room = limit + 1 - len(out)
                    out += unpack.decompress(chunk, room) if unpack else chunk[:room]
                    if len(out) > limit:
                        return bytes(out[:limit]), True
                    chunk = unpack.unconsumed_tail if unpack else b""
            if declared.isdigit() and came < int(declared) or (unpack and came and not unpack.eof):
                raise RuntimeError("the answer broke off")
            return bytes(out), False

    def probe(self) -> dict:
        """What the server says of itself; fails where it can't be reached."""
        return self.json(f"{self.base.rstrip('/')}/rest/api/2/serverInfo")

    def comments(self, key: str, start: int) -> Iterator[tuple[int, str]]:
        """(pos, comment as JSON) of a record's thread from ``start`` on: each page is asked for where the last one ended.

        Ends with an empty page, at the total that a page tells, or after the bound of pages.
        """
        for _ in range(fixed.COMMENT_PAGES):
            asked = urllib.parse.urlencode({"startAt": start, "maxResults": fixed.COMMENT_PAGE})
            page = self.json(f"{self.base.rstrip('/')}/rest/api/2/issue/{urllib.parse.quote(key, safe='')}/comment?{asked}")
            found, total = page.get("comments") or [], page.get("total") or 0
            yield from ((start + i, json.dumps(comment)) for i, comment in enumerate(found))
            start += len(found)
            if not found or 0 < total <= start:
                return


def later_comments(paged: DataFrame, server: Server) -> DataFrame:
    """issue_key, pos, comment and error: the comments behind those that payloads hold, of records (issue_key, next).

    A page depends on the one before, so a record's pages are asked for by one task. Where one fails, none of the record's pages count: it has a
    row with the error and no comment.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, start in zip(batch["issue_key"], batch["next"], strict=True):
                try:
                    rows = [(key, pos, comment, None) for pos, comment in server.comments(key, int(start))]
                except Exception as error:  # noqa: BLE001  told as the record's error
                    rows = [(key, None, None, f"comments: {_said(error)}")]
                yield pd.DataFrame(rows, columns=["issue_key", "pos", "comment", "error"]).astype({"pos": "Int64"})

    return paged.select("issue_key", "next").repartition(server.tasks).mapInPandas(read, COMMENTS)


def _said(error: Exception) -> str:
    """An error in few words: its kind, and what this module says itself, never what a server wrote."""
    return str(error) if isinstance(error, (Refused, RuntimeError)) else type(error).__name__


def bodies(listed: DataFrame, server: Server, per_file: int, count: int = fixed.ATTACHMENTS_PER_ISSUE, total: int = fixed.ATTACHMENT_BYTES) -> DataFrame:
    """issue_key, pos, outcome, text, bytes, truncated and error of attachments (issue_key, pos, url, gate).

    A record's attachments are fetched in order of place. Those with a ``gate`` have their outcome already; the others may have as
    many bytes as one file may and the record has left, and only what has arrived uses that up. Behind ``count`` scanned ones the
    record's others are not asked for.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, used, files, rows, held = None, 0, 0, [], 0
        frame = lambda: pd.DataFrame(rows, columns=[c.split(" ")[0] for c in BODIES.split(", ")])
        for batch in batches:
            for key, pos, url, gate in zip(batch["issue_key"], batch["pos"], batch["url"], batch["gate"], strict=True):
                if key != now:
                    now, used, files = key, 0, 0
                row = (key, pos, "stop" if files >= count else gate or ("over" if used >= total else "scan"), None, 0, False, None)
                if row[2] == "scan":
                    try:
                        raw, cut = server.body(url, min(per_file, total - used))
                        used, files, held = used + len(raw), files + 1, held + len(raw)
                        row = (key, pos, "scan", raw.decode(errors="replace"), len(raw), cut, None)
                    except TooLarge:
                        row = (key, pos, "failed", None, 0, False, None)
                    except Exception as error:  # noqa: BLE001  told as the record's error
                        row = (key, pos, "failed", None, 0, False, f"attachment: {_said(error)}")
                rows.append(row)
                if held > HELD:
                    yield frame()
                    rows, held = [], 0
        yield frame()

    return listed.select("issue_key", "pos", "url", "gate").repartition(server.tasks, "issue_key").sortWithinPartitions("issue_key", "pos").mapInPandas(read, BODIES)
