"""Scalar functions as Column expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def secret_hash(value: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(value, 256))


def fingerprint(hash_: Column, rule_id: Column, issue_key: Column) -> Column:
    """The identity of a finding: secret, rule and issue, joined by the unit separator."""
    return F.concat(F.lit("fp:"), F.sha2(F.concat_ws("\x1f", hash_, rule_id, issue_key), 256))


def merge_key(hash_: Column, rule_id: Column) -> Column:
    return F.concat_ws(":", hash_, rule_id)


def redact(value: Column) -> Column:
    """First and last two characters of values of eight characters or more; nothing of shorter ones."""
    return F.when(F.char_length(value) < 8, F.lit("[REDACTED]")).otherwise(F.concat(F.left(value, F.lit(2)), F.lit("..."), F.right(value, F.lit(2))))


def marker_for(rule_id: Column, value: Column) -> Column:
    """What stands in for a value: never something that holds the value itself."""
    named = F.concat(F.lit("[REDACTED:"), rule_id, F.lit("]"))
    plain = F.lit("[REDACTED]")
    holds = lambda text: (value != "") & F.contains(text, value)
    return F.when(~holds(named), named).when(~holds(plain), plain).otherwise(F.lit(""))


def mask_values(snippet: Column, values: Column, rule_id: Column) -> Column:
    """snippet with every value of an array replaced, longest first, so that no part of one value shows through another."""
    ordered = F.transform(F.reverse(F.array_sort(F.transform(F.filter(values, lambda v: v != ""), lambda v: F.struct(F.length(v).alias("n"), v.alias("v"))))), lambda s: s["v"])
    return F.aggregate(ordered, snippet, lambda text, v: F.replace(text, v, marker_for(rule_id, v)))


def shannon(value: Column) -> Column:
    """Bits per character; 0 for the empty string."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.when(F.char_length(value) == 0, F.lit(0.0)).otherwise(F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c))))


def rank(level: Column, levels: tuple[str, ...]) -> Column:
    """The place of a level in its order; levels are never compared as strings."""
    return F.array_position(F.array(*map(F.lit, levels)), F.lower(level)).cast("int") - 1


def parse_level(text: Column, levels: tuple[str, ...]) -> Column:
    """A level in lower case; null for what is none."""
    return F.when(F.lower(text).isin(*levels), F.lower(text))


def parse_severity(text: Column) -> Column:
    return F.when(F.lower(text).isin(*fixed.SEVERITIES), F.lower(text)).otherwise(F.lit("medium"))


def parse_confidence(text: Column) -> Column:
    return F.when(F.lower(text).isin(*fixed.CONFIDENCES), F.lower(text)).otherwise(F.lit("low"))


def is_placeholder(value: Column) -> Column:
    """The exact form: a word of the list, or nothing but a template slot."""
    slot = lambda a, b: F.startswith(value, F.lit(a)) & F.endswith(value, F.lit(b))
    return F.lower(value).isin(*fixed.PLACEHOLDERS_EXACT) | slot("<", ">") | slot("${", "}") | slot("{{", "}}")


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(F.lower(text), F.lit(word.lower()))
    return found


def adjust_confidence(base: Column, context: Column, random_looking: Column, placeholder: Column) -> Column:
    """A placeholder is low; otherwise the two signs together raise, and their absence lowers, the rule's own level."""
    signs = context.cast("int") + random_looking.cast("int")
    return (
        F.when(placeholder, F.lit("low"))
        .when(base == "high", F.when(signs >= 1, F.lit("high")).otherwise(F.lit("medium")))
        .when(base == "medium", F.when(signs == 2, F.lit("high")).when(signs == 1, F.lit("medium")).otherwise(F.lit("low")))
        .otherwise(F.lit("low"))
    )


def classify_path(path: Column) -> Column:
    starts, holds = lambda p: F.startswith(path, F.lit(p)), lambda p: F.contains(path, F.lit(p))
    return F.when(starts("comment") | holds(".comment"), "comment").when(starts("attachment") | holds(".attachment"), "attachment").when(starts("description"), "description").otherwise("customfield")


def truncate_bytes(text: Column, limit: int) -> Column:
    """The longest prefix of whole characters within ``limit`` bytes."""
    raw = F.encode(text, "UTF-8")
    cut = [F.try_validate_utf8(F.substring(raw, 1, n).cast("string")) for n in range(limit, max(limit - 4, 0), -1)]
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.coalesce(*cut, F.lit("")))


def project_key(issue_key: Column) -> Column:
    return F.substring_index(issue_key, "-", 1)


def in_field(path: Column, scope: Column) -> Column:
    """Whether a field path is the scope or lies below it."""
    return (path == scope) | F.startswith(path, F.concat(scope, F.lit("."))) | F.startswith(path, F.concat(scope, F.lit("[")))


def basename(name: Column) -> Column:
    return F.regexp_extract(name, r"([^/\\]*)$", 1)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(basename(name), r"\.([^.]*)$", 1))


def mime_is_text(mime: Column) -> Column:
    kind = F.lower(F.trim(F.substring_index(F.coalesce(mime, F.lit("")), ";", 1)))
    return F.startswith(kind, F.lit("text/")) | kind.isin(*fixed.TEXT_MIME_TYPES)


def attachment_verdict(name: Column, mime: Column) -> Column:
    """keep or skip: binary kinds are skipped before anything can speak for them."""
    return (
        F.when(F.trim(F.coalesce(name, F.lit(""))) == "", "skip")
        .when(extension(name).isin(*fixed.BINARY_EXTENSIONS), "skip")
        .when(extension(name).isin(*fixed.TEXT_EXTENSIONS) | F.lower(basename(name)).isin(*fixed.TEXT_FILENAMES) | mime_is_text(mime), "keep")
        .otherwise("skip")
    )


def origin(url: Column) -> Column:
    """scheme://host:port with the scheme's own port filled in; null for what is no absolute URL."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)
    host, port = F.lower(F.regexp_extract(rest, r"^(\[[^\]]*\]|[^:]*)", 1)), F.regexp_extract(rest, r":([0-9]+)$", 1)
    usual = F.when(scheme == "https", "443").when(scheme == "http", "80").otherwise("")
    return F.when((scheme != "") & (host != ""), F.concat(scheme, F.lit("://"), host, F.lit(":"), F.when(port == "", usual).otherwise(port)))


def same_origin(url: Column, base: Column) -> Column:
    """Whether fetching ``url``, absolute or relative to ``base``, stays on the base's origin."""
    text = F.trim(F.coalesce(url, F.lit("")))
    absolute = text.rlike("^[A-Za-z][A-Za-z0-9+.-]*:")
    return F.when((text == "") | F.startswith(text, F.lit("//")), F.lit(False)).when(absolute, F.coalesce(origin(text) == origin(base), F.lit(False))).otherwise(origin(base).isNotNull())


def github_checksum_ok(token: Column) -> Column:
    """Whether the last six characters are the base-62 CRC-32 of what lies between prefix and them."""
    body = F.substring(token, F.lit(5), F.char_length(token) - 10)
    crc = F.crc32(F.encode(body, "UTF-8"))
    digit = lambda k: F.substring(F.lit(fixed.BASE62), (F.floor(crc / F.lit(62**k)) % 62 + 1).cast("int"), F.lit(1))
    code = F.concat(*(digit(k) for k in range(5, -1, -1)))
    return token.rlike("^gh[pousr]_|^ghw_") & (F.char_length(token) >= 11) & (F.right(token, F.lit(6)) == code)


def aws_key_ok(value: Column) -> Column:
    return value.rlike(f"^(?:{'|'.join(fixed.AWS_PREFIXES)})[A-Z2-7]{{16}}$")


def jwt_ok(value: Column) -> Column:
    return value.rlike("^[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+$")


def csv_field(text: Column) -> Column:
    """A CSV cell: no terminal sequences or controls, and no leading formula sign."""
    clean = terminal(F.regexp_replace(text, "[\\n\\t]", ""))
    return F.when(clean.rlike("^\\s*[=+\\-@]"), F.concat(F.lit("'"), clean)).otherwise(clean)


def terminal(text: Column) -> Column:
    """Text for a terminal: string sequences with their payload, CSI and two-character sequences and control characters go; line feeds and tabs stay."""
    strings = "(?:\\x1B[\\]PX^_]|[\\x{90}\\x{98}\\x{9D}\\x{9E}\\x{9F}])[^\\x07\\x1B\\x{9C}\\n]{0,8192}(?:\\x07|\\x1B\\\\|\\x{9C}|(?=\\n)|$)?"
    csi = "(?:\\x1B\\[|\\x{9B})[\\x20-\\x3F]{0,64}[\\x40-\\x7E]?"
    return F.regexp_replace(text, f"{strings}|{csi}|\\x1B[\\x20-\\x7E]?|[\\x00-\\x08\\x0B-\\x1F\\x7F\\x{{80}}-\\x{{9F}}]", "")


def normalize_query(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def narrow_query(query: Column, since: Column) -> Column:
    """The query restricted to rows updated since a minute (UTC)."""
    return F.concat(F.lit("("), query, F.lit(") AND updated >= \""), F.date_format(since, "yyyy-MM-dd HH:mm"), F.lit("\""))
