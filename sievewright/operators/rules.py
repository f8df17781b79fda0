"""Detection rules: the built-in set, user rules on top of it, and their compiled form."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed

Q = "'\"\u2018\u2019\u201c\u201d"


class RuleError(ValueError):
    """A rule that can't be used; the message names the rule."""


def _begins_with_character(bare: str) -> bool:
    """Whether a pattern, its escapes and classes replaced by one character each, consumes one before all else, whichever branch it takes."""
    depth, start, branches = 0, 0, []
    for i, c in enumerate(f"{bare}|"):
        depth += (c == "(") - (c == ")")
        if c == "|" and depth == 0:
            branches.append(bare[start:i])
            start = i + 1
    for branch in branches:
        if not (group := re.match(r"\((?:\?:)?", branch)):
            if not re.match(r"[^()\[\]{}?*+|^$\\](?![?*]|\{0)", branch):
                return False
            continue
        depth = 0
        end = next((i for i, c in enumerate(branch) if (depth := depth + (c == "(") - (c == ")")) == 0), len(branch))
        if re.match(r"[?*]|\{0", branch[end + 1 :]) or not _begins_with_character(branch[group.end() : end]):
            return False
    return True


@dataclass(frozen=True)
class Rule:
    """One declarative rule. Levels are parsed leniently, as rule files are written by hand."""

    rule_id: str
    regex: str
    description: str = ""
    severity: str = "medium"
    confidence: str = "medium"
    capture_group: int = 0
    min_length: int | None = None
    min_entropy: float | None = None
    context_keywords: tuple[str, ...] = ()
    denylist: tuple[str, ...] = ()
    ignore_if_contains: tuple[str, ...] = ()
    validator: str | None = None
    enabled: bool = True
    min_digits: int | None = None
    min_uppercase: int | None = None
    min_lowercase: int | None = None
    min_special_chars: int | None = None
    special_chars: str = fixed.SPECIAL_CHARS
    disable_default_placeholders: bool = False
    examples: tuple[str, ...] = ()
    references: tuple[str, ...] = ()
    hint: str = field(default="", compare=False)
    literals: tuple[str, ...] = field(default=(), compare=False)
    run: str = field(default="", compare=False)
    tail: str = field(default="", compare=False)
    marks: tuple[str, ...] = field(default=(), compare=False)

    @classmethod
    def from_record(cls, record: dict) -> Rule:
        """A rule from a file's record; unknown keys are ignored."""
        known = {k: tuple(v) if isinstance(v, list) else v for k, v in record.items() if k in cls.__dataclass_fields__ and v is not None}
        try:
            made = cls(**known)
        except TypeError as error:
            raise RuleError(f"rule {record.get('rule_id', '?')}: {error}") from error
        return replace(made, severity=severity(made.severity), confidence=confidence(made.confidence))

    @cached_property
    def source(self) -> str:
        """The pattern as this engine writes it."""
        return re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), self.regex)

    @cached_property
    def pattern(self) -> re.Pattern[str]:
        try:
            return re.compile(self.source)
        except re.error as error:
            raise RuleError(f"rule {self.rule_id}: {error}") from error

    @cached_property
    def bounded(self) -> regex.Pattern[str] | None:
        """The pattern in the engine that can be told a time; None where that engine can't read it."""
        try:
            return regex.compile(self.source)
        except regex.error:
            return None

    @cached_property
    def first(self) -> re.Pattern[str] | None:
        """The pattern for the place of the cursor, where nothing before it may be seen; None where only a slice of the text can tell.

        Elsewhere a look at what lies before is a look behind the cursor at most by one character, by a word's edge. A pattern that
        begins with such an edge, or with a character, and looks back in no other way needs no slice: at the cursor, an edge is
        where a word's character follows.
        """
        flags, edge, rest = re.fullmatch(r"(?s)((?:\(\?[aimsx]+\))?)((?:\\b)?)(.*)", self.source).groups()
        bare = re.sub(r"\\[^bBA]|\[\^?\]?(?:\\.|[^\]\\])*\]", "c", rest)  # escapes and classes count as one character
        if re.search(r"\(\?[^:]|\^|\\[AB]", bare) or not _begins_with_character(bare):
            return None
        return re.compile(flags + ("(?=\\w)" if edge else "") + rest)

    @cached_property
    def hinted(self) -> re.Pattern[str] | None:
        """The hint for this engine, whose patterns are Unicode by themselves."""
        return re.compile(self.hint.replace("(?iU)", "(?i)").replace("(?U)", "")) if self.hint else None

    @cached_property
    def closing(self) -> re.Pattern[str] | None:
        """Where a match may end: a look-ahead for what follows a lazy stretch, if the pattern ends with plain text behind one."""
        head, lazy, tail = self.regex.rpartition(".*?")
        plain = lazy and tail and re.fullmatch(r"[\w -]*(?:\(\?:[\w |]*\)\??[\w -]*)?", tail)
        return re.compile(f"(?=({tail}))", self.pattern.flags) if plain and head.count("(") == head.count(")") else None

    @cached_property
    def tails(self) -> tuple[re.Pattern[str], re.Pattern[str]] | None:
        """What has to follow the run of characters that the pattern begins with, and what is not in such a run."""
        return (re.compile(f"(?={self.tail})"), re.compile(self.run)) if self.tail else None

    @cached_property
    def placeholders(self) -> tuple[str, ...]:
        return (() if self.disable_default_placeholders else fixed.PLACEHOLDERS_CONTAINED) + tuple(w.lower() for w in self.ignore_if_contains)


def severity(text: str | None) -> str:
    return text.lower() if text and text.lower() in fixed.SEVERITIES else "medium"


def confidence(text: str | None) -> str:
    return text.lower() if text and text.lower() in fixed.CONFIDENCES else "low"


# The built-in rules. ``hint`` is a plain regular expression without which a text has no match (white space in it is both
# engines'). Every match begins with one of the ``literals``, whatever their case; ``marks`` stand,
# in some case, in every text that the hint lets through. Where many beginnings share one long run, ``tail`` has to follow it.
BUILTIN = (
    Rule("aws_access_key_id", rf"\b(?:{'|'.join(fixed.AWS_PREFIXES)})[0-9A-Z]{{16}}\b", severity="high", confidence="high", validator="aws_key_checksum", hint="A[A-Z]{3}[0-9A-Z]{16}", literals=fixed.AWS_PREFIXES),
    Rule("aws_secret_access_key", r"\b[A-Za-z0-9/+]{40}\b", severity="critical", confidence="high", context_keywords=("aws_secret_access_key", "aws secret", "aws_secret", "secret access key"), min_entropy=3.0, min_digits=3, hint="(?i)aws.secret|secret.access.key", marks=("secret",)),
    Rule("github_token", r"\bgh[pousr]_[A-Za-z0-9]{36,255}\b", severity="high", confidence="high", hint="gh[pousr]_", literals=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("github_pat_v2", r"\bgithub_pat_[0-9A-Za-z_]{82}\b", severity="high", confidence="high", hint="github_pat_", literals=("github_pat_",)),
    Rule("gitlab_token", r"\bglpat-[A-Za-z0-9_-]{20}\b", severity="high", confidence="high", hint="glpat-", literals=("glpat-",)),
    Rule("slack_token", r"\bxox[baprs]-[A-Za-z0-9-]{10,72}\b", severity="high", confidence="high", hint="xox[baprs]-", literals=("xoxb-", "xoxa-", "xoxp-", "xoxr-", "xoxs-")),
    Rule("google_api_key", r"\bAIza[0-9A-Za-z_-]{35}\b", severity="medium", confidence="high", hint="AIza", literals=("AIza",)),
    Rule("private_key_block", r"(?s)-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY-----.*?-----END (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY-----", severity="critical", confidence="high", hint="-----END ", literals=("-----BEGIN ",)),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b", severity="medium", confidence="medium", validator="jwt_structure", hint="eyJ", literals=("eyJ",), run=r"[^A-Za-z0-9_-]", tail=r"\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b"),
    Rule("telegram_bot_token", r"\b[0-9]{8,10}:[A-Za-z0-9_-]{35}\b", severity="high", confidence="high", hint="[0-9]{8}:", marks=(":",)),
    Rule("stripe_key", r"\b(?:sk|rk)_(?:live|test)_[0-9a-zA-Z]{24,}\b", severity="high", confidence="high", disable_default_placeholders=True, hint="[sr]k_(?:live|test)_", literals=("sk_live_", "sk_test_", "rk_live_", "rk_test_")),
    Rule("npm_token", r"\bnpm_[A-Za-z0-9]{36,}\b", severity="medium", confidence="high", hint="npm_", literals=("npm_",)),
    Rule("sendgrid_api_key", r"\bSG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}\b", severity="medium", confidence="high", hint="SG\\.", literals=("SG.",)),
    Rule("jdbc_url_with_password", r"\bjdbc:[a-z0-9+]+://[^\s:/@]+:[^\s:/@]+@[^\s]+", severity="high", confidence="medium", hint="jdbc:", literals=("jdbc:",)),
    Rule("db_url_credentials", r"\b(?:postgres|postgresql|mysql|mongodb(?:\+srv)?|redis|mssql|amqp|elasticsearch)://[^\s:/@]*:[^\s:/@]+@[^\s/]+", severity="high", confidence="medium", hint="(?:s|l|b|v|p|h)://", literals=("postgres://", "postgresql://", "mysql://", "mongodb://", "mongodb+srv://", "redis://", "mssql://", "amqp://", "elasticsearch://")),
    Rule("generic_password_assignment", rf"(?i)\b(password|passwd|pwd|secret|token|api[_-]?key)\b\s*[:=]\s*[{Q}]?([^\s<>{{}}{Q}]{{8,}})[{Q}]?", severity="medium", confidence="medium", capture_group=2, min_length=8, min_entropy=2.0, min_digits=1, hint="(?iU)(?:password|passwd|pwd|secret|token|api[_-]?key)[\\s\\x1C-\\x1F]*[:=]", literals=("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key")),
    Rule("generic_api_key_assignment", rf"(?i)\bapi[_-]?key\b\s*[:=]\s*[{Q}]?([A-Za-z0-9_\-]{{16,}})[{Q}]?", severity="low", confidence="medium", capture_group=1, min_digits=1, hint="(?iU)api[_-]?key[\\s\\x1C-\\x1F]*[:=]", literals=("apikey", "api_key", "api-key")),
    Rule("generic_secret_assignment", rf"(?i)\b(?:secret|client[_-]?secret)\b\s*[:=]\s*[{Q}]?([^\s<>{{}}{Q}]{{8,}})[{Q}]?", severity="medium", confidence="medium", capture_group=1, min_digits=1, hint="(?iU)secret[\\s\\x1C-\\x1F]*[:=]", literals=("secret", "clientsecret", "client_secret", "client-secret")),
    Rule("basic_auth_header", r"\bBasic\s+[A-Za-z0-9+/]{16,}={0,2}\b", severity="low", confidence="medium", hint="(?U)Basic[\\s\\x1C-\\x1F]", literals=("Basic",)),
    Rule("bearer_token_generic", r"\bBearer\s+[A-Za-z0-9_\-\.=]{20,}\b", severity="low", confidence="low", hint="(?U)Bearer[\\s\\x1C-\\x1F]", literals=("Bearer",)),
)
BUILTIN = tuple(replace(rule, description=fixed.RULE_TEXTS[rule.rule_id][0], references=fixed.RULE_TEXTS[rule.rule_id][1]) for rule in BUILTIN)


def rule_set(user: list[Rule] | tuple[Rule, ...] = ()) -> list[Rule]:
    """Built-in rules in file order with user rules replacing those of the same id, then the new ones; disabled rules go.

    Every pattern is compiled here, so a bad one fails on the driver.
    """
    merged = {rule.rule_id: rule for rule in BUILTIN}
    merged.update({rule.rule_id: rule for rule in user})
    for rule in merged.values():
        rule.pattern  # noqa: B018  compiles
    return [rule for rule in merged.values() if rule.enabled]


def from_rules(rules: list[Rule]) -> list[Rule]:
    """Just these rules, without the built-in ones."""
    for rule in rules:
        rule.pattern  # noqa: B018  compiles
    return [rule for rule in rules if rule.enabled]


def read_rules(path: str) -> list[Rule]:
    """User rules from a YAML or JSON list on the driver."""
    return [Rule.from_record(record) for record in read_records(path)]


def read_records(path: str) -> list[dict]:
    with open(path, encoding="utf-8") as file:
        text = file.read()
    if not text.strip():
        return []
    try:
        import yaml
    except ImportError:
        import json

        return json.loads(text) or []
    return yaml.safe_load(text) or []


def prefilter(rules: list[Rule]) -> str | None:
    """One Java pattern that every text with a match has a match of; None if some rule gives no hint."""
    hints = [rule.hint for rule in rules]
    return "|".join(f"(?:{h})" for h in hints) if all(hints) else None


def folded(text: Column) -> Column:
    """A text in lower case, as patterns see it that leave case aside, but for the dotted and dotless forms of i: they take the long s for s and the Kelvin sign for k."""
    return F.replace(F.lower(text), F.lit("\u017f"), F.lit("s"))


def holds(text: Column, words: Iterable[str]) -> Column:
    """Whether one of some plain words stands in a text."""
    return reduce(Column.__or__, (F.contains(text, F.lit(word)) for word in sorted(set(words))))


def could_match(text: Column, rules: list[Rule]) -> Column | None:
    """Whether a rule could match a text, for all texts with a match; None if some rule gives no hint.

    A hint is only looked at where a plain word of its rule stands in the text, as a search for words costs a small part of one for patterns.
    """
    if prefilter(rules) is None:
        return None
    cased = [rule for rule in rules if re.search(r"\(\?[a-z]*i", f"{rule.regex} {rule.hint}") and (rule.marks or rule.literals)]
    bare = [rule for rule in rules if not rule.marks and not rule.literals]
    ends: dict[str, list[Rule]] = {}  # rules by what their words end with that is no letter or digit: one search rules them all out
    for rule in rules:
        for end in {re.search("[^A-Za-z0-9]*$", word)[0] for word in rule.marks or rule.literals} if rule not in cased else ():
            ends.setdefault(end, []).append(rule)
    words = [max(re.split("i", word.lower()), key=len) for rule in cased for word in rule.marks or rule.literals]

    def could(t: Column) -> Column:
        parts = [t.rlike(prefilter(bare))] if bare else []
        for end, of in ends.items():
            parts.append(holds(t, [end]) & holds(t, (word for rule in of for word in rule.marks or rule.literals if word.endswith(end))) & t.rlike(prefilter(of)))
        if cased:
            parts.append(F.exists(F.array(folded(t)), lambda low: holds(low, words)) & t.rlike(prefilter(cased)))
        return reduce(Column.__or__, parts)

    return F.exists(F.array(text), could)  # so that the text itself is worked out once
