import random
import re

from tallyline.llm import secrets


def plain(text):
    spans = []
    for kind, expression, good in (
        ("assign", r"""(?ia:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", lambda m: len(m[2]) >= 6),
        ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ):
        spans += [(m.start(), m.end(), kind) for m in re.finditer(expression, text) if good(m)]
    return sorted(spans, key=lambda s: (s[0], secrets.KINDS.index(s[2])))


def github(body="a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5", word="ghp_"):
    return word + body + secrets.base62_crc(body.encode()).decode()


def test_base_spans_are_those_of_a_plain_search():
    rng = random.Random(5)
    bits = ["password", "PassWd", "secret", "Token", "tokentoken", "api_key", "APIKEY", "apı_key", "toKen", "ſecret", " ", "  ", "=", ":", '"', "'", "é", "漢", "AKIA", "AKIAAKIA", "ABCD1234", "0a1b2c3d4e5f", "abcdef", "x", "/+", "\n", "zz9", "-=", "K"]
    for _ in range(20000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        data = text.encode()
        got = [s for s in secrets.code_points(data, secrets.byte_spans(data)) if s[2] in secrets.BASE]
        assert got == plain(text), text


def test_checksums():
    good = github()
    assert [s[2] for s in secrets.byte_spans(f"x {good} y".encode())] == ["github"]
    assert [s[2] for s in secrets.byte_spans(github(word="npm_").encode())] == ["npm"]
    assert secrets.byte_spans((good[:-1] + ("0" if good[-1] != "0" else "1")).encode()) == []
    assert secrets.byte_spans(good.upper().encode()) == [] and secrets.byte_spans((good + "A").encode()) == []
    known = "xprv9s21ZrQH143K3QTDL4LXw2F7HEK3wJUD2nW2nRk4stbPy6cq3jPPqjiChkVvvNKmPGJxWUtg6LnF5kejMRNNU3TGtRBeJgk33yuGBxrMPHi"
    assert [s[2] for s in secrets.byte_spans(known.encode())] == ["xprv"]
    assert secrets.byte_spans((known[:-1] + "j").encode()) == []


def test_rows(spark):
    rows = [(1, None, "s"), (2, "", "s"), (None, "token=abcdefg", "s"), (3, "é token = ab AKIA" + "A" * 16, "s"), (3, "é token = ab AKIA" + "A" * 16, "s"), (4, "é " * 100000 + "0123456789abcdef01234567", "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    got = sorted(((r["doc_id"] or 0, r["n_assign"], r["n_access"], r["n_hex"], r["spans"]) for r in secrets.scan_secrets(docs).collect()))
    assert got == [(0, 1, 0, 0, "assign:0:13"), (1, 0, 0, 0, ""), (2, 0, 0, 0, ""), (3, 0, 1, 0, "access:13:33"), (3, 0, 1, 0, "access:13:33"), (4, 0, 0, 1, "hex:200000:200024")]
    assert secrets.scan_secrets(docs.limit(0)).count() == 0


def test_redaction_leaves_no_secret_and_touches_nothing_else(spark):
    rows = [(1, "a token = abcdefgh b", 20), (2, None, 0), (3, "clean é", 99), (4, f"secret: {github()} 0123456789abcdef0123456789 z", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in secrets.redact_secrets(docs).collect()}
    assert got[1] == ("a [REDACTED] b", 14) and got[2] == (None, 0) and got[3] == ("clean é", 99)
    assert got[4] == ("[REDACTED] [REDACTED] z", 23)
    assert all(secrets.byte_spans((t or "").encode()) == [] for t, _ in got.values())


def test_redaction_with_clashing_columns(spark):
    docs = spark.createDataFrame([("password = abcdef123", 3, "x", "y")], "text string, n_chars int, clean string, __clean string")
    got = secrets.redact_secrets(docs).collect()[0]
    assert (got["clean"], got["__clean"]) == ("x", "y") and "abcdef123" not in got["text"] and got["n_chars"] == len(got["text"])
