"""Secret scans: candidate words, and a random forest that tells secrets from look-alikes.

A candidate is a word in which, or with the words before it, a built-in rule matches (``operators.rules.BUILTIN``), one that is assigned
to a name of a secret, with or without digits, one with SHORTEST or more token characters that holds a digit, or one that starts like a known
key. A PEM block counts as one word.
Its features are length, transitions between characters, coverage by a dictionary, shares of character
classes, the path, and the words around it; words behind a value can speak for a secret, and none of them clears one. The forest is trained on labelled findings (at most
``LABELLED`` rows) and read out into plain arrays; scoring walks those arrays inside a DataFrame expression,
so that finding, scoring and redacting happen row by row, in the JVM, without a shuffle.

Labelled findings are a table ``FINDINGS``: the candidate (word, and up to AROUND words before and after, joined by spaces), its path, and
1 for a secret or 0 for a false alarm. ``train`` takes any such table. The tables at hold carry none, so ``labelled`` writes
one: from templates of secrets and of look-alikes (mail and network addresses, card numbers, checksums, version strings,
identifiers, placeholders, ordinary words), filled from digests of the row number. ``documents`` has no paths either; its source stands for one.

Defined results: null and empty texts have no findings; a null path counts as no path; repeated rows and a
value that occurs twice are found each time; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import AWS_PREFIXES
from ..operators.rules import BUILTIN, prefilter
from .common import SPACES, Stages, words

#: Labelled findings that a forest is trained on, at most.
LABELLED = 8000
TREES, DEPTH, SEED = 20, 7, 17
THRESHOLD = 0.5
AROUND, SHORTEST = 3, 6
#: Schema of labelled findings.
FINDINGS = "c struct<word: string, before: string, after: string>, path string, secret int"

KNOWN = "(?:AKIA|ASIA|AROA|AIDA|ghp_|gho_|ghs_|github_pat_|glpat-|xox[bpars]-|sk_live_|rk_live_|npm_|SG\\.|AIza|eyJ)"
KEYWORDS = "(?i)(?:passw|pwd|secret|token|api[_-]?key|access[_-]?key|bearer|authorization|credential|private[_-]?key|auth)"
BENIGN = "(?i)(?:example|sample|dummy|placeholder|commit|checksum|sha-?\\d|md5|hash|digest|version|uuid|card|order|invoice|phone|mail|host|addr|ticket|isbn|revision|build)"
#: A name of a secret and the sign that assigns to it.
NAMED = "(?i)(?:passw(?:or)?d|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\\s*[:=]"
TEST_PATH = "(?i)(?:test|example|sample|fixture|mock|docs?/|demo)"
#: Common words of names, hosts and placeholders, longest first.
DICTIONARY = "placeholder|password|example|service|release|version|invoice|sample|secret|change|number|server|domain|client|public|string|update|config|github|https|order|token|local|admin|guest|login|value|build|image|index|param|media|video|mail|user|name|host|test|data|file|date|time|http|demo|your|here|page|blog|html|json|port|com|org|net|www|key|the|and|dev|api|app|img|src|log|ref|xxx"
BIGRAMS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce|ch|ei|ie|la|el|qu|ue|os|do"
FEATURES = ("length", "class_changes", "bigrams", "dictionary", "digits", "upper", "distinct", "hex", "dots", "at", "dashes", "colons", "test_path", "keyword", "benign", "known", "ruled", "assigned", "named", "followed")


#: The built-in rules by where they match: a PEM block; a value assigned to a name or after a header's scheme, maybe some words before; inside a word.
RULES = {rule.rule_id: rule for rule in BUILTIN}
BLOCK = RULES["private_key_block"].regex
ASSIGNED = tuple(RULES[name] for name in ("generic_password_assignment", "generic_secret_assignment", "generic_api_key_assignment"))
HEADERS = tuple(RULES[name] for name in ("basic_auth_header", "bearer_token_generic"))
#: Forty characters that are a key only by the words around hold three digits, so they are candidates without a rule.
INSIDE = "|".join(f"(?:{rule.regex})" for rule in BUILTIN if rule not in (*ASSIGNED, *HEADERS, RULES["private_key_block"], RULES["aws_secret_access_key"]))
#: Words, with a PEM block as one.
PARTS = f"{BLOCK}|(?:(?!-----BEGIN ){SPACES[:1]}^{SPACES[1:-1]})++|-----BEGIN "


def inside(word: Column) -> Column:
    """What rules match inside a word, from the first match to the last; a PEM block as it is; empty if none does."""
    return F.when(word.startswith("-----BEGIN "), F.regexp_extract(word, BLOCK, 0)).otherwise(F.regexp_extract(word, f"(?:{INSIDE})(?:.*(?:{INSIDE}))?", 0))


def assigned(before: Column, word: Column) -> Column:
    """The value in a word that a rule finds assigned to a name, there or before it; empty if there is none."""
    near = F.concat_ws(" ", before, word)
    values = (F.regexp_extract(near, f"(?U){rule.regex}\\S*$", rule.capture_group) for rule in ASSIGNED)
    return F.coalesce(*(F.when(value.rlike("[0-9]"), value) for value in values), F.lit(""))


def announced(before: Column, word: Column) -> Column:
    """The value in a word that follows a header's scheme; empty if there is none."""
    near = F.concat_ws(" ", before, word)
    values = (F.regexp_extract(near, f"(?U){rule.regex.replace('s+', 's+(', 1)})\\S*$", 1) for rule in HEADERS)
    return F.coalesce(*(F.when(value != "", value) for value in values), F.lit(""))


def named(before: Column, word: Column) -> Column:
    """Whether a word is assigned to a name of a secret, there or before it."""
    return F.concat_ws(" ", before, word).rlike(f"{NAMED}+\\s*[\"']?[^\\s:=\"']\\S{{3,}}$")


def candidates(text: Column) -> Column:
    """array<struct<position, word, before, after>>: candidate words with their 0-based places and neighbours."""
    could = text.rlike(f"[0-9]|[A-Z]{{16}}|{KNOWN}[A-Za-z0-9_-]{{12}}")
    side = lambda all_words, start, n: F.array_join(F.slice(all_words, start, n), " ")
    earlier = lambda all_words, i: side(all_words, F.greatest(i - AROUND, F.lit(0)) + 1, F.least(i, F.lit(AROUND)))

    def near(all_words: Column, rules: bool) -> Column:
        marked = F.transform(all_words, lambda w, i: F.struct(i.alias("position"), w.alias("word")))

        def wanted(m: Column) -> Column:
            word, before = m["word"], earlier(all_words, m["position"])
            own = word.rlike(f"[A-Za-z0-9+/_=.~@:-]{{{SHORTEST},}}") & (word.rlike("[0-9]") | word.rlike(f"{KNOWN}[A-Za-z0-9_-]{{12,}}"))
            return own | ((F.length(word) >= 4) & named(before, word)) | ((F.length(word) >= 8) & ((inside(word) != "") | (assigned(before, word) != "") | (announced(before, word) != ""))) if rules else own

        return F.transform(F.filter(marked, wanted), lambda m: F.struct(
            m["position"].alias("position"), m["word"].alias("word"),
            earlier(all_words, m["position"]).alias("before"),
            side(all_words, m["position"] + 2, F.lit(AROUND)).alias("after"),
        ))

    found = lambda all_words, rules: F.get(F.transform(F.array(all_words), lambda w: near(w, rules)), F.lit(0))
    parts = F.when(text.contains("-----END ") & text.rlike(BLOCK), F.regexp_extract_all(text, F.lit(PARTS), F.lit(0))).otherwise(words(text))
    none = F.slice(near(F.array().cast("array<string>"), False), 1, 1)
    return F.when(text.rlike(f"{prefilter(list(BUILTIN))}|(?:{NAMED})"), found(parts, True)).when(could, found(words(text), False)).otherwise(none)


def value_in(c: Column) -> Column:
    """The value of a candidate: what the rules match, or the word without what stands around a value."""
    rule, own = inside(c["word"]), F.greatest(assigned(c["before"], c["word"]), announced(c["before"], c["word"]))
    both = F.when(own.contains(rule), own).when(rule.contains(own), rule).otherwise(c["word"])  # an empty one is in every other
    return F.when((rule == "") & (own == ""), value_of(c["word"])).otherwise(both)


def value_of(word: Column) -> Column:
    """The value in a word, without an assigned name before it and marks around it."""
    return F.regexp_extract(word, "^[^A-Za-z0-9+/_-]*(?:[A-Za-z_][A-Za-z0-9_.-]*[=:]+[^A-Za-z0-9+/_-]*(?=[A-Za-z0-9+/_-]{4}))?(.*?)[^A-Za-z0-9+/=_-]*$", 1)


def name_of(word: Column) -> Column:
    """The name to which a word assigns; empty if it doesn't."""
    return F.regexp_extract(word, "^[^A-Za-z0-9+/_-]*([A-Za-z_][A-Za-z0-9_.-]*)[=:]+[^A-Za-z0-9+/_-]*(?=[A-Za-z0-9+/_-]{4})", 1)


def features(c: Column, path: Column) -> Column:
    """The features of one candidate struct as array<double>, in the order of FEATURES."""
    return F.get(F.transform(F.array(value_in(c)), lambda value: _features(c, value, path)), F.lit(0))


def _features(c: Column, value: Column, path: Column) -> Column:
    before = F.concat_ws(" ", c["before"], name_of(c["word"]))
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    count = lambda pattern: F.coalesce(F.regexp_count(value, F.lit(pattern)), F.lit(0))
    flag = lambda test: F.when(test, 1.0).otherwise(0.0)
    return F.array(
        n,
        count("(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])") / n,
        count(f"(?i)(?=(?:{BIGRAMS}))") / n,
        1.0 - F.length(F.regexp_replace(F.lower(value), DICTIONARY, "")) / n,
        count("[0-9]") / n,
        count("[A-Z]") / n,
        F.size(F.array_distinct(F.split(value, ""))) / n,
        flag(value.rlike("^[0-9a-fA-F]+$")),
        count("\\.").cast("double"),
        flag(value.contains("@")),
        count("-").cast("double"),
        count("[:/]").cast("double"),
        flag(F.coalesce(path, F.lit("")).rlike(TEST_PATH)),
        flag(before.rlike(KEYWORDS)),
        flag(before.rlike(BENIGN)),
        flag(value.rlike(f"^{KNOWN}")),
        flag((inside(c["word"]) != "") | (announced(c["before"], c["word"]) != "")),
        flag(assigned(c["before"], c["word"]) != ""),
        flag(named(c["before"], c["word"])),
        flag(c["after"].rlike(KEYWORDS)),
    )


def labelled(spark: SparkSession, rows: int = LABELLED) -> DataFrame:
    """FINDINGS filled from digests of the row number."""
    h = F.sha2(F.concat(F.lit("finding "), F.col("id").cast("string")), 256)
    g = F.sha2(F.concat(F.lit("around "), F.col("id").cast("string")), 256)
    b64 = F.base64(F.unhex(h))
    alnum = F.translate(b64, "+/=", "")
    part = lambda x, start, n: F.substring(x, start, n)
    number = lambda start, n: F.translate(part(h, start, n), "abcdef", "314159")
    dice = lambda k, n: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n))
    pick = lambda k, *options: F.element_at(F.array(*[o if isinstance(o, Column) else F.lit(o) for o in options]), (dice(k, len(options)) + 1).cast("int"))
    prose = pick(1, "the value of", "we saw that", "in der tat", "il y a", "para que el", "th the ing", "and then or", "", "mail the host", "for the order", "on a version")
    # what stands behind is the same in both classes, and nothing can be learned from it but a name of a secret
    later = pick(2, "and the rest", "of it", "est la", "und dann", "y luego", "ered an", "", "for example", "mail the host", "that.92@mail2.example.com phone", "version 2 of", "order 12 of")
    hexes = pick(3, part(h, 1, 16), part(h, 1, 18), part(h, 1, 24), part(h, 1, 32), part(h, 1, 40), h)
    mixed = pick(4, part(alnum, 1, 16), part(alnum, 1, 20), part(alnum, 1, 32), part(alnum, 1, 40), part(b64, 1, 40))
    body = pick(5, hexes, mixed)
    upper = F.translate(F.upper(part(h, 1, 16)), "0189", "GHIJ")
    name = pick(6, "password", "passwd", "token", "secret", "api_key", "client_secret", "access_key", "db_password", "auth_token")
    quote = pick(7, "\"", "'", "")
    strong = F.concat(part(alnum, 1, 3), pick(22, "$", "!", "@", "#", "%"), part(alnum, 4, 2), pick(23, "$$", "!", "&", "*", "^", "?"), number(1, 2), pick(24, "", part(h, 5, 2), part(alnum, 10, 6), F.lit("!")))
    short = pick(25, part(h, 1, 8), F.concat(part(alnum, 1, 6), number(1, 2)), F.concat(part(alnum, 1, 7), number(1, 2)), strong)
    long = F.translate(F.concat(F.base64(F.unhex(g)), b64, F.base64(F.unhex(F.sha2(g, 256)))), "+/=", "")
    dotted = F.concat(part(long, 1, 20), pick(26, "-", "_", "x"), part(long, 21, 15))
    block = pick(37, "RSA ", "EC ", "DSA ", "OPENSSH ", "PGP ", "")
    mark = pick(27, "=", ":", " = ", ": ")
    key = pick(28, "password", "passwd", "pwd", "secret", "token", "api_key", "api-key", "client_secret", "Password", "API_KEY")
    user = pick(29, "svc", "app", "root", "admin", "db_user", "u1", "")
    store = pick(30, "postgres", "postgresql", "mysql", "mongodb", "mongodb+srv", "redis", "mssql", "amqp", "elasticsearch")
    place = pick(31, "db/app", "db.internal:5432/main", "10.0.0.7:6379/0", "localhost/data", "cache01", "mq.corp.net/v")
    hidden = pick(32, hexes, part(long, 1, 12), short, F.concat(part(long, 1, 5), F.lit("pw"), number(1, 2)))
    secret_part = F.translate(hidden, "@:/", "xyz")
    letters = F.translate(long, "0123456789", "kqzvbjwxyg")
    spoken = F.concat(pick(47, "blue", "summer", "river", "seven", "little", "winter", "golden"), pick(48, "", "-", "_"), pick(49, "stone", "garden", "tiger", "window", "moon", "coffee"), pick(50, "forever", "tonight", "walk", "tree", "again", ""))
    phrase = pick(41, spoken, spoken, part(letters, 1, 14), F.lower(part(letters, 3, 18)), F.concat(F.translate(part(g, 1, 7), "0123456789", "aeionrstlm"), part(letters, 9, 9)), F.concat(F.lower(part(letters, 1, 5)), F.lit("-"), F.lower(part(letters, 6, 7)), F.lit("-"), F.lower(part(letters, 14, 6))))
    item = lambda word, before, after: F.struct(word.alias("word"), before.alias("before"), after.alias("after"))
    positive = pick(
        8,
        item(F.concat(name, F.lit("="), quote, body, quote), prose, later),
        item(F.concat(quote, body, quote), F.concat_ws(" ", prose, name, F.lit("=")), later),
        item(F.concat(quote, body, quote), F.concat_ws(" ", prose, F.concat(name, F.lit(":"))), later),
        item(F.concat(pick(9, *AWS_PREFIXES), upper), prose, later),
        item(part(F.concat(b64, g), 1, 40), F.concat_ws(" ", prose, pick(33, "aws_secret_access_key =", "aws_secret:", "aws secret", "secret access key")), later),
        item(F.concat(pick(10, "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"), part(F.concat(alnum, h), 1, 36)), prose, later),
        item(F.concat(F.lit("github_pat_"), part(long, 1, 22), F.lit("_"), part(F.concat(long, h), 23, 59)), prose, later),
        item(F.concat(F.lit("glpat-"), part(alnum, 1, 20)), prose, later),
        item(F.concat(pick(34, "sk_live_", "sk_test_", "rk_live_", "rk_test_"), part(long, 1, 24)), prose, later),
        item(F.concat(pick(35, "xoxb-", "xoxa-", "xoxp-", "xoxr-", "xoxs-"), number(1, 11), F.lit("-"), part(alnum, 1, 24)), prose, later),
        item(F.concat(F.lit("AIza"), dotted), prose, later),
        item(F.concat(F.lit("eyJ"), part(long, 1, 24), F.lit(".eyJ"), part(long, 25, 30), F.lit("."), part(F.concat(long, h), 55, 43)), prose, later),
        item(F.concat(number(1, 9), F.lit(":"), dotted), prose, later),
        item(F.concat(F.lit("SG."), part(long, 1, 22), F.lit("."), part(long, 23, 43)), prose, later),
        item(F.concat(F.lit("jdbc:"), store, F.lit("://"), F.concat(F.lit("u"), user), F.lit(":"), secret_part, F.lit("@"), place), prose, later),
        item(F.concat(pick(36, "", "url=", "DATABASE_URL="), store, F.lit("://"), user, F.lit(":"), secret_part, F.lit("@"), place), prose, later),
        item(F.concat_ws("\n", F.concat(F.lit("-----BEGIN "), block, F.lit("PRIVATE KEY-----")), F.concat(b64, long), F.concat(long, b64), F.concat(F.lit("-----END "), block, F.lit("PRIVATE KEY-----"))), prose, later),
        item(F.concat(key, F.regexp_replace(mark, " ", ""), quote, short, quote), prose, later),
        item(F.concat(quote, short, quote), F.concat_ws(" ", prose, F.concat(key, F.regexp_replace(mark, " $", ""))), later),
        item(F.base64(F.concat(user, F.lit(":"), short).cast("binary")), F.concat_ws(" ", prose, F.lit("Authorization: Basic")), later),
        item(part(long, 1, 32), F.concat_ws(" ", prose, F.lit("Authorization: Basic")), later),
        item(body, F.concat_ws(" ", prose, F.lit("Authorization: Bearer")), later),
        item(F.concat(key, F.regexp_replace(mark, " ", ""), quote, phrase, quote), prose, later),
        item(F.concat(quote, phrase, quote), F.concat_ws(" ", prose, F.concat(key, F.regexp_replace(mark, " $", ""))), later),
        item(F.concat(key, F.regexp_replace(mark, " ", ""), quote, part(short, 1, 6), quote), prose, later),
        item(strong, prose, pick(46, "is the password", "as your password", "(secret)", "was the token")),
        item(F.concat(name, F.regexp_replace(mark, " ", ""), quote, body, quote, F.lit("###")), prose, later),
    )
    folk = F.translate(part(g, 1, 8), "0123456789", "aeionrstlm")
    negative = pick(
        11,
        item(F.concat(folk, F.lit("."), number(9, 2), F.lit("@mail"), number(11, 1), F.lit(".example.com")), prose, later),
        item(F.concat_ws(".", number(1, 2), number(3, 3), number(6, 2), number(8, 3)), prose, later),
        item(number(1, 16), pick(12, prose, "card", "order"), later),
        item(number(1, 13), prose, later),
        item(F.concat_ws("-", part(h, 1, 8), part(h, 9, 4), part(h, 13, 4), part(h, 17, 4), part(h, 21, 12)), pick(13, prose, "uuid", "id"), later),
        item(part(h, 1, 40), pick(14, "commit", "revision", "merge commit", "build of commit"), later),
        item(h, pick(15, "sha256", "checksum", "digest sha-256", "sha256 hash"), later),
        item(part(h, 1, 32), pick(16, "md5", "checksum md5", "hash"), later),
        item(F.concat(F.lit("https://"), folk, F.lit(".example.com/page/"), number(1, 6)), prose, later),
        item(F.concat(F.lit("2"), number(1, 3), F.lit("-"), number(4, 2), F.lit("-"), number(6, 2), F.lit("T"), number(8, 2), F.lit(":"), number(10, 2)), prose, later),
        item(F.concat(folk, F.lit("_"), pick(17, "user", "value", "index", "config"), F.lit("_"), number(1, 2)), prose, later),
        item(F.concat(name, F.lit("="), pick(18, "your_password_here1", "changeme123example", "xxxxxxxxxxxx1", "example_token_123", "placeholder0000", "<your-token-here-1>")), prose, later),
        item(F.concat(F.lit("version-"), number(1, 1), F.lit("."), number(2, 2), F.lit("."), number(4, 3), F.lit("-release")), prose, later),
        item(F.concat(folk, number(1, 4)), prose, later),
        item(F.concat(name, F.lit("="), quote, hexes, quote), F.lit("for example the dummy"), F.lit("as a sample")),
        item(pick(38, "changeme1", "placeholder1", "your_key_1", "yourpassword1", "xxxxxxxx1", "example_123"), F.concat_ws(" ", prose, F.concat(key, F.lit(":"))), later),
        item(pick(42, "required", "missing", "none", "null", "true", "string", "incorrect", "expired", "invalid", "optional", "unknown", "empty"), F.concat_ws(" ", prose, F.concat(key, F.regexp_replace(mark, " $", ""))), later),
        item(F.concat(key, F.regexp_replace(mark, " ", ""), pick(43, "required", "missing", "None", "null", "true", "string", "hidden", "expired", "invalid", "default")), prose, later),
        item(F.concat(number(1, 3), pick(44, "-", "/", "."), number(4, 3), pick(45, "", ",", ".", "km", "ms")), prose, later),
        item(F.concat(store, F.lit("://"), pick(39, folk, F.concat(folk, number(1, 1))), pick(40, ".example.com/app", ":5432/data", ".internal:6379/0")), prose, later),
    )
    secret = dice(0, 2) == 1
    path = F.when(~secret & (dice(19, 3) == 0), pick(20, "tests/fixtures/data", "docs/example", "mock/sample")).otherwise(pick(21, "src0", "src12", "config/app", "DOC", "issue/description", ""))
    row = F.when(secret, positive).otherwise(negative)
    return spark.range(0, min(rows, LABELLED), 1, 1).select(row.alias("c"), path.alias("path"), secret.cast("int").alias("secret"))


@cache
def _columns(forest: tuple) -> tuple[str, ...]:
    return tuple(",".join(map(str, column)) for column in forest)


def train(findings: DataFrame) -> tuple:
    """(feature, threshold, left, right, chance, roots): the nodes of all trees as flat lists. Leaves lead to themselves."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    stages = Stages(findings.sparkSession)
    kept = stages.keep(findings.limit(LABELLED), "labelled")
    data = stages.keep(kept.select(array_to_vector(features(F.col("c"), F.col("path"))).alias("features"), F.col("secret").cast("double").alias("label")), "features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, maxBins=64, featureSubsetStrategy="sqrt").fit(data.coalesce(1))
    nodes: list[list] = []

    def visit(node) -> int:
        at = len(nodes)
        nodes.append([])
        if node.subtreeDepth() == 0:
            stats = list(node.impurityStats().stats())
            nodes[at] = [0, 0.0, at, at, stats[1] / max(sum(stats), 1e-9)]
        else:
            split = node.split()
            nodes[at] = [split.featureIndex(), split.threshold(), visit(node.leftChild()), visit(node.rightChild()), 0.0]
        return at

    roots = [visit(tree._java_obj.rootNode()) for tree in forest.trees]
    return (*(tuple(column) for column in zip(*nodes, strict=True)), tuple(roots))


_trained: dict = {}


def forest(spark: SparkSession) -> tuple:
    """The forest over the built-in labelled findings, trained once in a driver."""
    if "own" not in _trained:
        _trained["own"] = train(labelled(spark))
    return _trained["own"]


def chance(x: Column, trees: tuple) -> Column:
    """The forest's mean leaf chance for a feature array: each tree is walked from its root over constant arrays."""
    feature, threshold, left, right, leaf, roots = (F.split(F.lit(column), ",").cast(f"array<{kind}>") for column, kind in zip(_columns(trees), ("int", "double", "int", "int", "double", "int"), strict=True))
    let = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  computed once, not at every node
    walk = lambda x, root: F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), root, lambda at, _: F.when(F.get(x, F.get(feature, at)) <= F.get(threshold, at), F.get(left, at)).otherwise(F.get(right, at)))
    return let(x, lambda x: F.aggregate(F.transform(roots, lambda r: F.get(leaf, walk(x, r))), F.lit(0.0), lambda a, p: a + p)) / len(trees[-1])


def findings(text: Column, path: Column, trees: tuple) -> Column:
    """array<struct<position, value, score, secret>> of a text: one for each candidate."""

    def judged(c: Column) -> Column:
        value = value_in(c)
        return F.struct(c["position"].cast("long").alias("position"), value.alias("value"), F.round(chance(features(c, path), trees), 6).alias("score"))

    scored = F.transform(candidates(F.coalesce(text, F.lit(""))), judged)
    return F.transform(scored, lambda f: F.struct(f["position"].alias("position"), f["value"].alias("value"), f["score"].alias("score"), ((f["score"] >= THRESHOLD) & (F.length(f["value"]) > 0)).alias("secret")))


def report(docs: DataFrame, trees: tuple, path: str = "source") -> DataFrame:
    """One row per candidate: doc_id, position, length, preview, secret_hash, score, is_secret. No raw value leaves it."""
    one = docs.select("doc_id", F.explode(findings(F.col("text"), F.col(path), trees)).alias("f"))
    value = F.col("f.value")
    preview = F.when(F.length(value) < 8, F.lit("[REDACTED]")).otherwise(F.concat(F.left(value, F.lit(2)), F.lit("..."), F.right(value, F.lit(2))))
    return one.select("doc_id", F.col("f.position").alias("position"), F.length(value).cast("long").alias("length"), preview.alias("preview"), F.concat(F.lit("sha256:"), F.sha2(value, 256)).alias("secret_hash"), F.col("f.score").alias("score"), F.col("f.secret").alias("is_secret"))


def redact(docs: DataFrame, trees: tuple, marker: str = "[REDACTED]", path: str = "source") -> DataFrame:
    """docs with every secret value in ``text`` replaced, and n_chars brought up to date; all rows stay, and all columns, whatever their names."""
    packed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), findings(docs["text"], docs[path], trees).alias("found"))
    secret = F.transform(F.filter("found", lambda f: f["secret"]), lambda f: f["value"])
    longest_first = F.transform(F.reverse(F.array_sort(F.transform(F.array_distinct(secret), lambda v: F.struct(F.length(v).alias("n"), v.alias("v"))))), lambda s: s["v"])
    text = F.col("row")["text"]
    clean = F.aggregate(longest_first, text, lambda text, value: F.replace(text, value, F.lit(marker)))
    done = packed.select("row", F.when(F.exists("found", lambda f: f["secret"]), clean).otherwise(text).alias("clean"))
    new = {"text": F.col("clean"), **({"n_chars": F.length("clean").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})}
    return done.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
