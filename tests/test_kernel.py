"""The scan kernel on texts: every rule, cursor and offset semantics, filters in order, masking, pairs."""

import time

import pytest

from sievewright.functions import fixed
from sievewright.operators import allowlist, pairs, rules, scan

PAD = "Zk3mQ8vR2tX7wB5nL9cJ4hF6gD1sA0pYeUiToKxMwVbN3qS8rZ5jH2lC7fG4dP9a"


def text_for(rule_id):
    p = PAD
    made = {
        "aws_access_key_id": "key AK" + "IA" + "QRSTUVWXYZ234567 x", "aws_secret_access_key": "aws_secret = " + p[:40],
        "github_token": "gh" + "p_" + p[:36], "github_pat_v2": "github" + "_pat_" + (p + p)[:82], "gitlab_token": "glpat" + "-" + p[:20],
        "slack_token": "xox" + "b-" + p[:24], "google_api_key": "AI" + "za" + p[:35], "jwt": "ey" + f"J{p[:12]}.ey" + f"J{p[:14]}.{p[:12]}",
        "private_key_block": "-----BEGIN RSA PRIVATE" + " KEY-----\n" + p + "\n-----END RSA PRIVATE" + " KEY-----",
        "telegram_bot_token": "110201543:" + p[:35], "stripe_key": "sk_" + "test_" + p[:24], "npm_token": "npm" + "_" + p[:36], "sendgrid_api_key": "S" + f"G.{p[:20]}.{p[:20]}",
        "jdbc_url_with_password": "jdbc:mysql://bob:" + "s3cr3tpw@db/x", "db_url_credentials": "postgres://svc:" + "s3cr3tpw@db",
        "generic_password_assignment": "password = " + p[:12], "generic_api_key_assignment": "api_key: " + p[:20], "generic_secret_assignment": "client-secret=" + p[:12],
        "basic_auth_header": "Basic " + p[:24], "bearer_token_generic": "Bearer " + p[:24],
    }
    return made[rule_id]


@pytest.mark.parametrize("rule", rules.BUILTIN, ids=lambda r: r.rule_id)
def test_each_rule_finds_its_own(rule):
    import re

    text = text_for(rule.rule_id)
    found = scan.scan_text(text, [rule], "K-1", "description", [], "low", False)
    assert [f[2] for f in found] == [rule.rule_id]
    assert re.search(rule.hint.replace("(?iU)", "(?i)").replace("(?U)", ""), text)


@pytest.mark.parametrize("word", ["example", "dummy", "xxxx", "changeme"])
def test_placeholders_are_dropped(word):
    rule = next(r for r in rules.BUILTIN if r.rule_id == "github_token")
    text = "gh" + "p_" + word + PAD[: 36 - len(word)]
    assert scan.scan_text(text, [rule], "K-1", "d", [], "low", False) == []
    assert scan.scan_text(text, [rule], "K-1", "d", [], "low", True)[0][11] == "placeholder"


def test_filters_fail_in_contract_order():
    rule = rules.Rule("r", r"v=(\S+)", capture_group=1, min_length=8, min_entropy=2.0, denylist=("Bad",), min_digits=1, context_keywords=("near",))
    reasons = [scan.rejection(rule, v, c) for v, c in (("short", ""), ("aaaaaaaaaa", ""), ("xbadqwerty1", ""), ("qwertsample1", ""), ("qwertzuiop", ""), ("qwertzuiop1", "far"), ("qwertzuiop1", "NEAR"))]
    assert reasons == ["min_length", "min_entropy", "denylist", "placeholder", "min_digits", "context_keywords", None]


def test_cursor_sees_only_what_lies_behind_it():
    rule = rules.Rule("r", r"\bab")
    assert [m[:2] for m in scan.matches(rule, "abab")] == [(0, 2), (2, 4)]  # the slice starts at a word's edge
    assert list(scan.matches(rules.Rule("e", "x*"), "ab")) == []


def test_offsets_are_bytes_and_windows_whole_characters():
    rule = rules.Rule("r", r"tok-([A-Za-z0-9]+)", capture_group=1)
    text = "ж" * 30 + "tok-" + "Secret99" + "é" * 40
    got = scan.scan_text(text, [rule], "K-1", "d", [], "low", False)[0]
    assert (got[8], got[9]) == (60, 72)
    assert got[7] == "ж" * 23 + "tok-[REDACTED:r]" + "é" * 25


def test_no_value_in_any_snippet():
    texts = ["a " + text_for("github_token") + " b " + text_for("gitlab_token"), "пароль password=" + PAD[:14] + " 🔑 token: " + PAD[20:34], text_for("private_key_block") + text_for("npm_token")]
    for text in texts:
        for hit in scan.scan_text(text, rules.rule_set(), "K-1", "d", [], "low", False):
            for secret in (PAD[:36], PAD[:20], PAD[:14], PAD[20:34]):
                assert secret not in hit[7]


def test_confidence_table():
    assert [scan.adjusted(b, c, e, p) for b, c, e, p in (("high", 1, 1, 0), ("high", 0, 1, 0), ("high", 0, 0, 0), ("medium", 1, 1, 0), ("medium", 1, 0, 0), ("medium", 0, 0, 0), ("low", 1, 1, 0), ("high", 1, 1, 1))] == ["high", "high", "medium", "high", "medium", "low", "low", "low"]


def test_allowlist_is_strict_and_first_match_wins():
    entries = allowlist.compile_entries([{"rule_id": "a", "field": "comment", "reason": "one"}, {"pattern": "^ab", "reason": "two"}, {"project_key": "SEC"}, {"value": "exact"}])
    assert allowlist.check(entries, "abc", "a", "X-1", "comment.comments[0]") == (True, "one")
    assert allowlist.check(entries, "abc", "a", "X-1", "commentary") == (True, "two")
    assert allowlist.check(entries, "zzz", "b", "SEC-9", "d") == (True, None)
    assert allowlist.check(entries, "exact", "b", "X-1", "d")[0]
    assert not allowlist.check(entries, "zzz", "b", "SECOND-1", "d")[0]
    for bad in ({}, {"value": " "}, {"pattern": "("}, {"sha256": "12"}, {"other": "x"}):
        with pytest.raises(allowlist.AllowlistError, match="record 1"):
            allowlist.compile_entries([bad])
    assert "exact" not in repr(entries)


def test_rules_merge_by_id_and_parse_leniently():
    user = [rules.Rule.from_record({"rule_id": "github_token", "regex": "gx_", "severity": "Nonsense", "confidence": "HIGH", "later": 1}), rules.Rule.from_record({"rule_id": "own", "regex": "o", "enabled": False})]
    merged = rules.rule_set(user)
    own = next(r for r in merged if r.rule_id == "github_token")
    assert (own.regex, own.severity, own.confidence, len(merged)) == ("gx_", "medium", "high", 20)
    assert rules.prefilter(merged) is None  # the user's rule gives no hint, so every text is scanned
    with pytest.raises(rules.RuleError, match="bad"):
        rules.rule_set([rules.Rule("bad", "(")])


def test_pairs():
    assert pairs.pairs("x https://bob:s3cret99@host") == [("bob", "s3cret99", "url")]
    assert pairs.pairs("user=a\n" + "x" * 182 + "\npassword=p1") and not pairs.pairs("user=a\n" + "x" * 190 + "\npassword=p1")
    assert len(pairs.pairs("user=a\nuser=b\npassword=p1\npassword=p2")) == 4
    assert pairs.pairs('{"user": "u", "username": "u", "password": "pw1", "pass": "pw1", "n": 1}') == [("u", "pw1", "json")]
    assert pairs.pairs("user=a\npassword=changeme") == []
    assert len(pairs.pairs("user=a\npassword=b\n" * 50_000)) == fixed.PAIR_HITS


def test_every_pair_of_a_text():
    far = "x" * fixed.PAIR_BYTES
    assert pairs.pairs(far + " https://bob:s3cret99@host") == [("bob", "s3cret99", "url")]
    assert pairs.pairs(far + "\nuser=a\npassword=p1") == [("a", "p1", "proximity")]
    assert pairs.pairs(f'{{"user": "u", "note": "{far}", "password": "pw1"}}') == [("u", "pw1", "json")]
    lines = "".join(f"user=u{i}\npassword=p{i}\n{' ' * 200}\n" for i in range(5000))
    assert list(pairs.every_pair(lines)) == [(f"u{i}", f"p{i}", "proximity") for i in range(5000)]


def test_hostile_texts_end_soon():
    began = time.time()
    scan.scan_text("-----BEGIN RSA PRIVATE" + " KEY-----\n" + "x" * 50, rules.rule_set(), "K", "d", [], "low", False)
    scan.scan_text(("-----BEGIN RSA PRIVATE" + " KEY-----\n") * 30_000, rules.rule_set(), "K", "d", [], "low", False)
    for text in ("user=a\npass=b\n" * 150_000, "https://u:p4ssw0rd@h " * 100_000, "a" * (1 << 21)):
        pairs.pairs(text)
    assert time.time() - began < 20


@pytest.mark.parametrize(("text", "hits"), [
    (" ".join(f"pw \u00e9 password=q{i:07d}z" for i in range(6000)), 5500),
    ("-----BEGIN RSA PRIVATE" + " KEY-----\n" + ("-----BEGIN RSA PRIVATE" + " KEY-----\n") * 9000 + "-----END CERTIFICATE-----", 0),
    ("-----END RSA PRIVATE" + " KEY-----\n" + ("-----BEGIN RSA PRIVATE" + " KEY-----\n") * 30000, 0),
])
def test_hostile_texts_take_no_more_than_two_seconds(text, hits):
    start = time.monotonic()
    assert len(scan.scan_text(text, list(rules.BUILTIN), "K-1", "d", [], "low", False)) >= hits
    assert time.monotonic() - start < 6  # two on a machine of its own


def test_masking_leaves_no_value_of_any_hit():
    text = "password=abcdef12 token=abcdef12345 secret=f12345zz password=abcdef12"
    found = scan.scan_text(text, list(rules.BUILTIN), "K-1", "d", [], "low", False)
    assert found and not any(v in f[7] for f in found for v in ("abcdef12", "abcdef12345", "f12345zz"))


def test_pairs_whatever_stands_between_name_and_sign():
    import re

    hint = re.compile(pairs.HINT.replace("(?iU)", "(?i)"))
    for text in ("user=alice\npassword" + " " * 60 + "= hunter2x9", "user=alice\npassword\n= hunter2x9", "user=alice\napi_key\t: hunter2x9", '\n {"user": "alice", "password": "hunter2x9"}\n'):
        assert [p[:2] for p in pairs.pairs(text)] == [("alice", "hunter2x9")]
        assert hint.search(text)


def test_pairs_come_password_by_password():
    text = "user=a\nuser=b\npassword=first111\npassword=second22\n"
    assert [p[:2] for p in pairs.pairs(text)] == [("a", "first111"), ("b", "first111"), ("a", "second22"), ("b", "second22")]


def test_hostile_json_gives_nothing():
    from sievewright.operators import segments

    assert pairs.pairs('{"a":' * 30000 + "1" + "}" * 30000) == []
    assert pairs.pairs('{"user":"\\ud800x","password":"abcdefgh1"}') == []
    assert list(segments.leaves({"a": "\ud800", "b": "fine", "\udfff": "x"})) == [("b", "fine")]


def test_allowlist_patterns_are_bounded_by_time_and_not_by_length():
    entry = allowlist.compile_entries([{"pattern": "needle$"}])
    assert allowlist.check(entry, "x" * 10_000 + "needle", "r", "K-1", "d")[0]
    slow = allowlist.compile_entries([{"pattern": "(a+)+$"}])
    start = time.monotonic()
    assert not allowlist.check(slow, "a" * 5000 + "b", "r", "K-1", "d")[0]
    assert time.monotonic() - start < 5


def test_allowlist_files(tmp_path):
    (tmp_path / "a.json").write_text('[{"rule_id": "jwt", "reason": "old"}]')
    assert allowlist.read_allowlist(str(tmp_path / "a.json"))[0].reason == "old"
    (tmp_path / "b.json").write_text("")
    assert allowlist.read_allowlist(str(tmp_path / "b.json")) == []
    (tmp_path / "c.json").write_text('[{"nonsense": 1}]')
    with pytest.raises(allowlist.AllowlistError, match="c.json: record 1"):
        allowlist.read_allowlist(str(tmp_path / "c.json"))


#: What a tracker is full of, and what a rule for a real secret has to walk past.
HARMLESS = (
    "Could you look at change 4821 before the demo?", "Build 311 broke at packaging; a rerun passed.", "We moved the launch to Friday, room 4C.", "INSERT INTO t (id, label) VALUES (1, 'a');",
    "export LANG=C.UTF-8 EDITOR=vi", 'raise Error("apiKey is not set, see the manual")', "He is the bearer of good tidings.", "Basic knowledge of the tool is enough.", "curl -H 'Authorization: Bearer ${ACCESS}' https://svc.corp/health",
    "The `secret` field is hidden in the form.", "password: missing", "token = <your-token>", "A token lasts for 60 minutes and is then renewed.", "name = value lines are read in order.", "server = mail.corp.example",
    "WARN [worker-2] slow query, 812 ms", "Listening on 127.0.0.1:9090", "Reverted in 9c1e4b7 (short).", "retries: 5, delay: 250ms", "docker run -p 8443:443 web:2.4.1", "The rotation of api keys is described elsewhere.",
    "Picked 0a1b2c3d4e5f60718293a4b5c6d7e8f901234567 onto main.", "sha256: 3a7bd3e2360a3d29eea436fcfb7e44c735d117c42d1c1835420b6b9942dd4f1b", "Span 123e4567-e89b-12d3-a456-426614174000",
    "ssh-ed25519 AAAAC3NzaC1lZDI1NTE5AAAAIKq7Zm2Xr9Wt4Yn3Bv6Lp8Rs1Qd5Hf2Jg0Ad2Xr9Wt4 me@host", "data:image/gif;base64,R0lGODlhAQABAIAAAAAAAP///yH5BAEAAAAALAAAAAABAAEAAAIBRAA7", "postgres://localhost:5432/app",
)


@pytest.mark.parametrize("text", HARMLESS)
def test_look_alikes_are_no_findings(text):
    assert scan.scan_text(text, list(rules.BUILTIN), "K-1", "d", [], "low", False) == []
    assert pairs.pairs(text) == []


@pytest.mark.parametrize("rule_id", ["aws_access_key_id", "gitlab_token", "google_api_key", "slack_token", "jwt", "npm_token", "sendgrid_api_key", "telegram_bot_token", "stripe_key", "github_token", "github_pat_v2"])
def test_a_stranger_in_the_middle_is_a_near_miss(rule_id):
    rule, text = next(r for r in rules.BUILTIN if r.rule_id == rule_id), text_for(rule_id)
    body = max(text.split(" "), key=len)
    place = len(body) - 8
    broken = text.replace(body, f"{body[:place]}!{body[place + 1 :]}")
    assert scan.scan_text(text, [rule], "K-1", "d", [], "low", False)
    if rule_id not in ("slack_token", "jwt", "sendgrid_api_key"):  # whose bodies may end early
        assert scan.scan_text(broken, [rule], "K-1", "d", [], "low", False) == []
    lower = text.replace(body, body[:2].swapcase() + body[2:])
    assert rule_id == "telegram_bot_token" or scan.scan_text(lower, [rule], "K-1", "d", [], "low", False) == []


def test_validators_are_a_registry_that_accepts_unknown_names():
    assert set(scan.VALIDATORS) == {"aws_key_checksum", "jwt_structure", "github_token_checksum"}
    assert scan.valid("nonsense", "x") and scan.valid(None, "x") and not scan.valid("jwt_structure", "a.b")


def test_segments_behind_a_full_record_are_not_looked_at(monkeypatch):
    """The first hits of a record are the same with and without the early stop, wherever batches begin and whatever comes before its turn."""
    import pandas as pd

    looked = []
    whole = scan.scan_text
    monkeypatch.setattr(scan, "scan_text", lambda text, *rest: looked.append(text) or whole(text, *rest))
    rows = [(f"K-{i // 12}", i % 12, f"token = value{i}f8e7d6c5b4a and secret: other{i}f8e7d6c5b4a") for i in range(60)]
    rows[30], rows[33] = rows[33], rows[30]
    frame = pd.DataFrame([(k, o, "d", t, "description") for k, o, t in rows], columns=["issue_key", "seg_ord", "field_path", "text", "source_type"])

    def first(cap, told):
        run = scan.kernel(list(rules.BUILTIN), [], "low", False, told)
        hits = pd.concat(run(iter([frame.iloc[i : i + 7] for i in range(0, 60, 7)])))
        return hits.sort_values(["issue_key", "seg_ord", "detector_ord", "rule_ord", "hit_ord"]).groupby("issue_key").head(cap)[["issue_key", "seg_ord", "rule_id", "secret_hash"]].values.tolist()

    for cap in (1, 5, 8, 1000):
        looked.clear()
        expected, every = first(cap, None), len(looked)
        looked.clear()
        assert first(cap, cap) == expected
        assert len(looked) < every / 2 or cap > 5
