"""The rule scan: an Arrow kernel for what needs byte offsets and cursor semantics, behind a filter that runs in the JVM.

A rule looks for matches in what lies behind its cursor (nothing before it is seen), and goes on behind each
match, accepted or not. Offsets are bytes of UTF-8. Values never leave the kernel: it gives digests, previews
and masked snippets.
"""

from __future__ import annotations

import hashlib
import logging
import math
import re
import time
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from .allowlist import Entry, check
from .rules import Rule, could_match, rule_set

log = logging.getLogger(__name__)

FINDINGS = "issue_key string, seg_ord long, field_path string, source_type string, detector_ord int, rule_ord int, hit_ord int, rule_id string, severity string, confidence string, redacted_secret string, secret_hash string, snippet string, match_start int, match_end int, username string, `references` array<string>, drop_reason string"


def shannon(value: str) -> float:
    n = len(value)
    counts = Counter(value).values() if n > 256 else map(value.count, dict.fromkeys(value))
    return -sum([c / n * math.log2(c / n) for c in counts]) if n else 0.0


def redact(value: str) -> str:
    return "[REDACTED]" if len(value) < 8 else f"{value[:2]}...{value[-2:]}"


def secret_hash(value: str) -> str:
    return f"sha256:{hashlib.sha256(value.encode()).hexdigest()}"


def marker_for(rule_id: str, value: str) -> str:
    for marker in (f"[REDACTED:{rule_id}]", "[REDACTED]"):
        if not value or value not in marker:
            return marker
    return ""


def window(raw: bytes, start: int, end: int, radius: int = fixed.CONTEXT_BYTES) -> tuple[int, int]:
    """The bytes around a span, moved outwards to whole characters."""
    a, b = max(0, min(start - radius, len(raw))), max(0, min(end + radius, len(raw)))
    while a > 0 and raw[a] & 0xC0 == 0x80:
        a -= 1
    while b < len(raw) and raw[b] & 0xC0 == 0x80:
        b += 1
    return a, max(a, b)


def aws_key_checksum(value: str) -> bool:
    return len(value) == 20 and value[:4] in fixed.AWS_PREFIXES and all(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567" for c in value[4:])


def jwt_structure(value: str) -> bool:
    parts = value.split(".")
    return len(parts) == 3 and all(p and all(c.isascii() and (c.isalnum() or c in "_-") for c in p) for p in parts)


def github_token_checksum(value: str) -> bool:
    body, code = value[4:-6], value[-6:]
    crc, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        crc, at = divmod(crc, 62)
        digits = fixed.BASE62[at] + digits
    return value[:4] in ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "ghw_") and len(value) >= 11 and code == digits


#: The named validators that a rule can ask for. Others accept every value, and are warned of where rules are read.
VALIDATORS: dict[str, Callable[[str], bool]] = {f.__name__: f for f in (aws_key_checksum, jwt_structure, github_token_checksum)}


def valid(name: str | None, value: str) -> bool:
    return name not in VALIDATORS or VALIDATORS[name](value)


def rejection(rule: Rule, value: str, context: str) -> str | None:
    """Why a rule's own filters drop a candidate: the first that fails, in contract order."""
    low = value.lower()
    if rule.min_length is not None and len(value) < rule.min_length:
        return "min_length"
    if rule.min_entropy is not None and shannon(value) < rule.min_entropy:
        return "min_entropy"
    if any(d.lower() in low for d in rule.denylist):
        return "denylist"
    if any(w in low for w in rule.placeholders):
        return "placeholder"
    for name, least, of in (("min_digits", rule.min_digits, "0123456789"), ("min_uppercase", rule.min_uppercase, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("min_lowercase", rule.min_lowercase, "abcdefghijklmnopqrstuvwxyz"), ("min_special_chars", rule.min_special_chars, rule.special_chars)):
        if least is not None and sum([c in of for c in value]) < least:
            return name
    if rule.context_keywords and not any(k.lower() in context.lower() for k in rule.context_keywords):
        return "context_keywords"
    return None if valid(rule.validator, value) else "validator"


def is_placeholder(value: str) -> bool:
    slots = (("<", ">"), ("${", "}"), ("{{", "}}"))
    return value.lower() in fixed.PLACEHOLDERS_EXACT or any(value.startswith(a) and value.endswith(b) for a, b in slots)


def adjusted(base: str, context: bool, random_looking: bool, placeholder: bool) -> str:
    if placeholder or base == "low":
        return "low"
    levels = {"high": ("medium", "high", "high"), "medium": ("low", "medium", "high")}
    return levels[base][context + random_looking]


def byte_places(text: str) -> Callable[[int], int]:
    """The byte offset of a character offset; counted once for the whole text."""
    if text.isascii():
        return lambda i: i
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    places = np.zeros(len(points) + 1, np.int64)
    np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), out=places[1:])
    return lambda i: int(places[i])


#: Seconds that a user's rule may take over one text, where only an engine with a clock can bound it. Beyond that it is left out there, with a warning.
RULE_SECONDS = 10.0


def literal_places(rules: list[Rule]) -> Callable[[str], dict[int, list[int]] | None]:
    """A search for the literals of all rules in one pass: rule number to the places where one of its literals begins, in order.

    It looks at folded text. Where folding changes the number of characters, places can't be told, and the answer is None.
    """
    of: dict[str, list[int]] = {}
    for i, rule in enumerate(rules):
        for literal in rule.literals:
            of.setdefault(literal.casefold(), []).append(i)
    automaton = ahocorasick.Automaton()
    for literal, numbers in of.items():
        automaton.add_word(literal, (len(literal) - 1, numbers))
    if of:
        automaton.make_automaton()

    def places(text: str) -> dict[int, list[int]] | None:
        folded = text.lower() if text.isascii() else text.casefold()
        if len(folded) != len(text):
            return None
        found: dict[int, list[int]] = {}
        for end, (back, numbers) in automaton.iter(folded) if of else ():
            for i in numbers:
                found.setdefault(i, []).append(end - back)
        return {i: sorted(at) for i, at in found.items()}

    return places


def _anchored(rule: Rule, text: str, starts: list[int], last: int | None) -> Iterator[re.Match[str]]:
    """Matches of a rule each of which begins at one of the places."""
    cursor, end = 0, len(text) if last is None else last
    if rule.tails:  # beginnings in one run share what follows it, so that is looked at once for each run
        follows, other = rule.tails
        stops = [m.start() for m in follows.finditer(text)]
        breaks = [m.start() for m in other.finditer(text)] if stops else []
        if not stops:
            return
    for start in starts:
        if start < cursor or start > end:
            continue
        if rule.tails:
            at = bisect_left(breaks, start)
            if at == len(breaks) or (i := bisect_left(stops, breaks[at])) == len(stops) or stops[i] != breaks[at]:
                continue
        found = (rule.first if start == cursor and rule.first else rule.pattern).match(text, start, end)
        if found is not None:
            yield found
            cursor = found.end()


def _searched(rule: Rule, text: str, last: int | None) -> Iterator[tuple[int, re.Match[str]]]:
    """(offset, match): by a search that stays in the text where the pattern allows it, else on slices, within a time."""
    cursor, end, until = 0, len(text) if last is None else last, time.monotonic() + RULE_SECONDS
    while cursor <= end:
        if rule.first is not None:
            found, offset = rule.first.match(text, cursor, end) or rule.pattern.search(text, cursor + 1, end), 0
        else:
            try:
                rest = text[cursor:end] if cursor or end < len(text) else text
                found, offset = (rule.bounded or rule.pattern).search(rest, **({"timeout": max(0.001, until - time.monotonic())} if rule.bounded else {})), cursor
            except TimeoutError:
                log.warning("rule %s took more than %s s over one text and is left out there", rule.rule_id, RULE_SECONDS)
                return
        if found is None:
            return
        if offset + found.end() <= cursor:  # an empty match at the cursor
            cursor += 1
            continue
        yield offset, found
        cursor = offset + found.end()


def matches(rule: Rule, text: str, starts: list[int] | None = None) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, value start, value end) in characters, by the cursor rule. ``starts`` are the places of the rule's literals, where they are known."""
    last = None
    if rule.closing:  # no match can begin behind the last closing mark, where a lazy pattern would try every opening to the text's end
        last = max((m.end(1) for m in rule.closing.finditer(text)), default=-1)
        if last < 0:
            return
    found = ((0, m) for m in _anchored(rule, text, starts, last)) if starts is not None and rule.first is not None else _searched(rule, text, last)
    for offset, m in found:
        a, b = m.span(rule.capture_group) if rule.capture_group <= m.re.groups else m.span()
        if a < 0:
            a, b = m.span()
        yield offset + m.start(), offset + m.end(), offset + a, offset + b


class Masker:
    """Snippets around the hits of one text, with no hit's value left in them.

    All values are looked for in one pass over a snippet, by an automaton that is built once for a text, so neither their number nor what they
    have in common at their beginning makes a snippet dearer. A few are looked for one by one, as most texts have no more.
    """

    def __init__(self, raw: bytes, values: list[tuple[str, str]]):
        self.raw, self.rules = raw, {}
        for value, rule_id in values:
            if value:
                self.rules[value] = min(rule_id, self.rules.get(value, rule_id))
        self.automaton = None
        if len(self.rules) > 4:
            self.automaton = ahocorasick.Automaton()
            for value in self.rules:
                self.automaton.add_word(value, value)
            self.automaton.make_automaton()

    def near(self, text: str) -> list[tuple[str, str]]:
        """The values that stand in a text, longest first."""
        found = {value for _, value in self.automaton.iter(text)} if self.automaton else [value for value in self.rules if value in text]
        return sorted(((value, self.rules[value]) for value in found), key=lambda x: (-len(x[0]), x))

    def snippet(self, start: int, end: int, rule_id: str, value: str) -> str:
        a, b = window(self.raw, start, end)
        before, after = self.raw[a:start].decode(errors="ignore"), self.raw[end:b].decode(errors="ignore")
        out = f"{before}{marker_for(rule_id, value)}{after}"
        for other, of in self.near(out):
            if other in out:
                out = out.replace(other, marker_for(of, other))
        return out.replace(value, marker_for(rule_id, value)) if value and value in out else out


def masked(raw: bytes, start: int, end: int, rule_id: str, value: str, others: list[tuple[str, str]]) -> str:
    """The snippet around a value with it, its sibling hits' values and any other occurrence replaced."""
    return Masker(raw, [*others, (value, rule_id)]).snippet(start, end, rule_id, value)


def scan_text(text: str, rules: list[Rule], issue_key: str, path: str, allowlist: list[Entry], floor: str, drops: bool, places: Callable | None = None) -> list[tuple]:
    """Hits of all rules in one text, in rule and match order; with ``drops`` also those dropped, with the reason."""
    raw, at = text.encode(), byte_places(text)
    known = (literal_places(rules) if places is None else places)(text)
    hits = []
    for rule_ord, rule in enumerate(rules):
        if known is not None and rule.literals and rule_ord not in known:
            continue
        starts = known.get(rule_ord, []) if known is not None and rule.literals else None
        if starts == [] or (starts is None and rule.hinted is not None and not rule.hinted.search(text)):
            continue
        for hit_ord, (s, e, vs, ve) in enumerate(matches(rule, text, starts)):
            value = text[vs:ve]
            bs, be, start, end = at(vs), at(ve), at(s), at(e)
            near = (lambda x, y: raw[slice(*window(raw, x, y))].decode(errors="ignore"))
            why = rejection(rule, value, near(bs, be) if rule.context_keywords else "")
            level = rule.confidence
            if why is None:
                allowed, reason = check(allowlist, value, rule.rule_id, issue_key, path)
                around = near(start, end).lower()
                context = any(w in around for w in fixed.CONTEXT_WORDS)
                level = adjusted(rule.confidence, context, shannon(value) > fixed.ENTROPY_BOOST, is_placeholder(value))
                if allowed:
                    why = f"allowlisted: {reason}" if reason else "allowlisted"
                elif fixed.CONFIDENCES.index(level) < fixed.CONFIDENCES.index(floor):
                    why = "min_confidence"
            hits.append((rule_ord, hit_ord, rule, level, value, bs, be, start, end, why))
    masker = Masker(raw, [(h[4], h[2].rule_id) for h in hits if h[9] is None or drops])
    return [
        (rule_ord, hit_ord, rule.rule_id, rule.severity, level, redact(value), secret_hash(value), masker.snippet(bs, be, rule.rule_id, value), start, end, list(rule.references), why)
        for rule_ord, hit_ord, rule, level, value, bs, be, start, end, why in hits
        if why is None or drops
    ]


class Budget:
    """How much of its cap a record has left, as its segments come by in one task: behind a full one, the record's later segments are not looked at.

    Only what the same task has kept from earlier segments counts, so nothing is left out that could be among the first. A record's segments mostly come together and in
    order, as they are written; where one comes before its turn, the count starts anew.
    """

    def __init__(self, cap: int | None):
        self.cap, self.key, self.last, self.kept = cap, None, -1, 0

    def left(self, key: str, place: int) -> bool:
        if key != self.key or place <= self.last:
            self.key, self.kept = key, 0
        self.last = place
        return self.cap is None or self.kept < self.cap

    def spend(self, n: int) -> None:
        self.kept += n


def kernel(rules: list[Rule], allowlist: list[Entry], floor: str, drops: bool, cap: int | None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """What a task does with its segments."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, places, budget = [c.split(" ")[0].strip("`") for c in FINDINGS.split(", ")], literal_places(rules), Budget(cap)
        for batch in batches:
            rows = []
            for key, ord_, path, text, kind in zip(batch["issue_key"], batch["seg_ord"], batch["field_path"], batch["text"], batch["source_type"], strict=True):
                if not budget.left(key, ord_):
                    continue
                found = scan_text(text, rules, key, path, allowlist, floor, drops, places)
                budget.spend(sum(r[11] is None for r in found))
                rows.extend((key, ord_, path, kind, 0, *r[:10], None, r[10], r[11]) for r in found)
            yield pd.DataFrame(rows, columns=names)

    return each


def scan(segments: DataFrame, rules: list[Rule] | None = None, allowlist: list[Entry] | tuple = (), floor: str = "low", drops: bool = False, cap: int | None = None, spread: bool = False) -> DataFrame:
    """Hits in segments (issue_key, seg_ord, field_path, text, source_type), masked.

    Texts that no rule can match are filtered in the JVM before anything is sent to Python; rules and the
    allowlist travel with the function, as they are a driver's configuration. With ``cap``, segments behind that many kept hits of their record may be left out. With ``spread``, segments
    are dealt out before they are searched: for tables of few row groups, whose texts a few tasks read.
    """
    rules = rule_set() if rules is None else rules
    for rule in rules:
        if rule.validator is not None and rule.validator not in VALIDATORS:
            log.warning("rule %s: no validator is called %s, so all its values pass", rule.rule_id, rule.validator)
    could = could_match(F.col("text"), rules)
    wanted = segments.select("issue_key", "seg_ord", "field_path", "text", "source_type").where(F.col("text").isNotNull())
    if could is not None and spread and cap is None:
        wanted = apart(wanted).where(F.when(F.spark_partition_id() >= 0, could))  # a condition on a task's number stays behind the exchange
    elif could is not None:
        wanted = wanted.where(could)
        wanted = wanted if cap is not None else dealt(wanted)
    return wanted.mapInPandas(kernel(rules, list(allowlist), floor, drops, cap), FINDINGS)


def dealt(rows: DataFrame) -> DataFrame:
    """Rows that cost much for their bytes, dealt out evenly: files and shuffles divide by bytes, which leaves them to a few tasks."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)


def apart(segments: DataFrame) -> DataFrame:
    """Segments dealt out by their places, unsorted and whatever their texts hold."""
    return segments.repartition(2 * segments.sparkSession.sparkContext.defaultParallelism, "issue_key", "seg_ord", "field_path")
