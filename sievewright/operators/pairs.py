"""Credential pairs: a user name that stands next to a password, in a URL, on nearby lines, or in one JSON object."""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed
from .rules import folded, holds
from .scan import FINDINGS, byte_places, dealt, is_placeholder, redact, secret_hash

# The patterns of URLs and lines, taken apart so that no two beginnings try the same characters.
_scheme, _userinfo = re.compile(r"\b[a-z]"), re.compile("://" + fixed.URL_USERINFO.partition("://")[2])
_not_scheme, _line = re.compile("[^a-z0-9+.-]"), re.compile(r"(?m)^[^\S\n]*(?=\S)")
_user, _password = (re.compile("(?i)" + pattern.removeprefix(r"(?im)^\s*")) for pattern in (fixed.USER_LINE, fixed.PASSWORD_LINE))
#: What a text with a pair has: a URL's userinfo, a password's name before its sign, or an object's start. Both engines' ideas of white space are let through.
URL_HINT, NAME_HINT, OBJECT_HINT = "://[^:\\s/@]+:[^@\\s/]+@", "(?:pass(?:word|wd)?|secret|key)[\\s\\x1C-\\x1F]*[:=]", "^[\\s\\x1C-\\x1F]*\\{"
HINT = f"(?iU){URL_HINT}|{NAME_HINT}|{OBJECT_HINT}"
#: Plain words one of which stands before a password's sign.
NAMES = ("pass", "secret", "key")


#: The forms of pairs in the order in which they are found: a pair's ``rule_ord``.
FORMS = ("url", "proximity", "json")
#: Rows, and characters of users in them, that the kernel gathers before it hands them on.
ROWS, HELD = 8192, 4 << 20


def encodable(text: str) -> bool:
    """Whether a text out of JSON is Unicode: an escaped lone surrogate is not."""
    try:
        text.encode()
    except UnicodeEncodeError:
        return False
    return True


def url_matches(text: str) -> Iterator[re.Match[str]]:
    """What URL_USERINFO finds: at each ``://`` with a user and a password behind it, if a scheme stands before it. The match is of what lies from there on."""
    cursor, at = 0, text.find("://")
    while at >= 0:
        if at >= cursor and (found := _userinfo.match(text, at)):
            start = at  # back over the scheme's characters, which are no other mark's
            while start > cursor and not _not_scheme.match(text[start - 1]):
                start -= 1
            if (head := _scheme.search(text, start, at)) and head.end() <= at:
                yield found
                cursor = found.end()
        at = text.find("://", at + 3)


def line_matches(pattern: re.Pattern[str], text: str) -> Iterator[re.Match[str]]:
    """What a pattern of lines finds: at the first character of a line that isn't white, whatever blank lines are before it."""
    cursor = 0
    for line in _line.finditer(text):
        if line.end() >= cursor and (found := pattern.match(text, line.end())):
            yield found
            cursor = found.end()


def every_pair(text: str) -> Iterator[tuple[str, str, str]]:
    """(user, password, format) of all pairs of a whole text in order: URL, lines, JSON. A password on a line has some 60 users in its window at most, so their number grows with the text."""
    for m in url_matches(text):
        if not is_placeholder(m[2]):
            yield m[1], m[2], "url"
    at = byte_places(text)
    users, secrets = ([(at(m.start(1)), m[1]) for m in line_matches(pattern, text)] for pattern in (_user, _password))
    places = [place for place, _ in users]
    for place, password in secrets:  # password by password, each with the users in its window in order of place
        if not is_placeholder(password):
            for _, user in users[bisect_left(places, place - fixed.PAIR_DISTANCE) : bisect_right(places, place + fixed.PAIR_DISTANCE)]:
                yield user, password, "proximity"
    if text.lstrip().startswith("{"):
        try:
            whole = json.loads(text)
        except (ValueError, RecursionError):  # no JSON, or nested beyond what can be read
            whole = None
        if isinstance(whole, dict):
            known = set()
            for u in fixed.JSON_USER_KEYS:
                for p in fixed.JSON_PASSWORD_KEYS:
                    user, password = whole.get(u), whole.get(p)
                    if isinstance(user, str) and isinstance(password, str) and user and password and (user, password) not in known and encodable(user) and encodable(password):
                        known.add((user, password))
                        if not is_placeholder(password):
                            yield user, password, "json"


def pairs(text: str) -> list[tuple[str, str, str]]:
    """The first PAIR_HITS of a text's pairs, for a look at one text; scans take every pair."""
    return list(islice(every_pair(text), fixed.PAIR_HITS))


def could_pair(text: Column) -> Column:
    """Whether HINT is in a text. Its parts are only looked for where a plain word of theirs stands."""

    def could(t: Column) -> Column:
        named = F.exists(F.array(folded(t)), lambda low: holds(low, NAMES)) & t.rlike(f"(?iU){NAME_HINT}")
        return (holds(t, ["://"]) & t.rlike(f"(?iU){URL_HINT}")) | (holds(t, ["{"]) & t.rlike(f"(?iU){OBJECT_HINT}")) | named

    return F.exists(F.array(text), could)


def detect(segments: DataFrame, floor: str = "low", cap: int | None = None) -> DataFrame:
    """Pair findings in the layout of the rule scan; they skip allowlist and scoring, as their confidence is always high.

    With ``cap``, what follows a segment's first that many pairs is left out: for a record's cap, which they can't be among.
    """

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0].strip("`") for c in FINDINGS.split(", ")]
        for batch in batches:
            rows, held = [], 0
            for key, ord_, path, text, kind in zip(batch["issue_key"], batch["seg_ord"], batch["field_path"], batch["text"], batch["source_type"], strict=True):
                for i, (user, password, form) in enumerate(islice(every_pair(text), cap)):
                    shown = user if password not in user else "[REDACTED:credential_pair]"
                    rows.append((key, ord_, path, kind, 1, FORMS.index(form), i, "credential_pair", "high", "high", redact(password), secret_hash(password), f"username={shown} password=[REDACTED:credential_pair]", 0, 0, shown, [], None))
                    held += len(shown)
                    if len(rows) == ROWS or held > HELD:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)

    wanted = dealt(segments.select("issue_key", "seg_ord", "field_path", "text", "source_type").where(could_pair(F.col("text"))))
    return wanted.mapInPandas(kernel, FINDINGS)


def url_pairs(segments: DataFrame) -> DataFrame:
    """issue_key, field_path, username, password_hash and preview of URL pairs, without leaving the JVM."""
    text = C.truncate_bytes(F.col("text"), fixed.PAIR_BYTES)
    pattern = f"(?U){fixed.URL_USERINFO}"
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("user"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("password"))
    found = segments.where(F.contains(F.col("text"), F.lit("://"))).select("issue_key", "field_path", F.explode(both).alias("p")).select("issue_key", "field_path", F.col("p.user").alias("username"), F.col("p.password").alias("password"))
    return found.where(~C.is_placeholder(F.col("password"))).select("issue_key", "field_path", "username", C.secret_hash(F.col("password")).alias("password_hash"), C.redact(F.col("password")).alias("redacted_password"))


def band_join(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, distance: int) -> DataFrame:
    """Rows of both sides with one key whose places are at most ``distance`` apart.

    Places fall into bands as wide as the distance, and the left side looks into its own and the two beside it: an equi-join
    on (key, band), so a key with very many rows is spread over its bands.
    """
    bands = left.withColumn("_band", F.explode(F.array(*(F.floor(F.col(left_at) / distance) + d for d in (-1, 0, 1)))))
    other = right.withColumn("_band", F.floor(F.col(right_at) / distance))
    return bands.join(other, [key, "_band"]).where(F.abs(F.col(left_at) - F.col(right_at)) <= distance).drop("_band")
