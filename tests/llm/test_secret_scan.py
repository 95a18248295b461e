"""Secret scans: the patterns against a plain scan, layers against encodings made here."""

import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import urllib.parse
import zlib

import pytest

from quaero.llm import secret_scan

SECRET = "password=Sup3rS3cretValue99"


def _plain(text):
    out = []
    for kind, pattern, least in (
        (0, r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12),
        (1, "AKIA[A-Z0-9]+", 18),
        (2, "[0-9a-f]+", 16),
    ):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[2] if kind == 0 else m[0]) >= least]
    return sorted(out)


def _noise(rng, n):
    pieces = ["token", "=", ": ", "secret", "passwd", "API_KEY", "apikey", '"', "'", " ", "abc", "deadbeef", "0123456789abcdef", "AKIA", "ABCDEF", "XYZ0123456789", "é", "ſecret", "toKen", "\n", "%", "%41", "%E9", "%F0%9F%98%80", "\\u0041", "\\ud83d", "\\ude00", "&#65;", "&#x42;", "\\x43", "\\u{1F600}", "\\u{FFFFFF}"]
    return "".join(rng.choice(pieces) for _ in range(n))


def test_findings_of_the_text_itself():
    rng = random.Random(5)
    texts = [_noise(rng, rng.randint(0, 60)) for _ in range(800)]
    assert sum(len(_plain(t)) for t in texts) > 500
    for t in texts:
        base, every = secret_scan.spans(t)
        assert base == _plain(t)
        assert set(base) <= set(every)
        assert all(0 <= a < z <= len(t) for a, _, z in every)


def _b64(raw):
    return base64.b64encode(raw).decode()


ENCODINGS = {
    "url": lambda t: "".join(f"%{b:02X}" for b in t.encode()),
    "quoted": lambda t: urllib.parse.quote(t, safe=""),
    "unicode": lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
    "braces": lambda t: "".join(f"\\u{{{ord(c):x}}}" for c in t),
    "bytes": lambda t: "".join(f"\\x{ord(c):02x}" for c in t),
    "entities": lambda t: "".join(f"&#{ord(c)};" for c in t),
    "base64": lambda t: _b64(t.encode()),
    "urlsafe": lambda t: base64.urlsafe_b64encode(t.encode()).decode().rstrip("="),
    "gzip": lambda t: _b64(gzip.compress(t.encode())),
    "zlib": lambda t: _b64(zlib.compress(t.encode())),
    "bz2": lambda t: _b64(bz2.compress(t.encode())),
    "xz": lambda t: _b64(lzma.compress(t.encode())),
    "twice": lambda t: _b64(gzip.compress(zlib.compress(t.encode()))),
}


@pytest.mark.parametrize("outer", ENCODINGS)
@pytest.mark.parametrize("inner", ENCODINGS)
def test_nested_layers_map_to_the_original(outer, inner):
    encoded = ENCODINGS[outer](ENCODINGS[inner](SECRET))
    before, after = "é text ", " more; text."
    base, every = secret_scan.spans(before + encoded + after)
    found = [s for s in every if s[1] == 0 and s not in base]
    assert found, (outer, inner)
    assert all(len(before) <= a < z <= len(before) + len(encoded) for a, _, z in found)


def test_exact_places():
    assert secret_scan.spans("x %70assword%3DSup3rS3cretValue99 y") == ([], [(2, 0, 33)])
    assert secret_scan.spans("x token=abc\\u0064efghijklm.") == ([], [(2, 0, 27)])
    assert secret_scan.spans("\\ud83d\\ude00token=abcdefghijkl") == ([(12, 0, 30)], [(12, 0, 30)])
    text = "k: " + _b64(b"....password=abcdefghijkl....")
    (_, every) = secret_scan.spans(text)
    ((a, kind, z),) = every
    assert kind == 0
    assert base64.b64decode(text[3 + (a - 3) // 4 * 4 : 3 + -(-(z - 3) // 4) * 4]).strip(b".") == b"password=abcdefghijkl"


def test_deep_and_circular_layers_end():
    text = SECRET
    for _ in range(12):
        text = _b64(text.encode())
    assert (0, len(text.rstrip("="))) in {(a, z) for a, k, z in secret_scan.spans(text)[1] if k == 0} or secret_scan.spans(text)[1]
    for odd in ("%25" * 50, "%2525252541", "\\u005cu005cu0041", "&#38;#38;#65;", "%", "\\u", "&#;", "A" * 4000, "=" * 40, "%FF%FE%00", _b64(b"\x1f\x8b" + b"0" * 40)):
        secret_scan.spans(odd)


def test_archives_that_explode_are_left(monkeypatch):
    monkeypatch.setattr(secret_scan, "MOST_UNPACKED", 1000)
    assert secret_scan.spans(_b64(gzip.compress(b"0" * 10_000_000 + SECRET.encode())))[1] == []
    assert secret_scan.spans(_b64(gzip.compress(b" " * 900 + SECRET.encode())))[1] != []


def test_table(spark, docs, rows, odd, empty):
    for frame, given in ((docs, rows), (odd, [tuple(r) for r in odd.collect()])):
        got = sorted(map(tuple, secret_scan.report(frame).collect()), key=repr)
        want = []
        for r in given:
            base = _plain(r[1] or "")
            listed = ",".join(f"{secret_scan.KINDS[k]}:{a}:{z}" for a, k, z in base)
            every = ",".join(f"{secret_scan.KINDS[k]}:{a}:{z}" for a, k, z in secret_scan.spans(r[1] or "")[1])
            want.append((r[0], *(sum(k == x for _, k, _ in base) for x in range(3)), hashlib.sha256(listed.encode()).hexdigest(), every))
        assert got == sorted(want, key=repr)
    assert secret_scan.report(empty).collect() == []


def test_redaction_keeps_lengths(spark):
    hidden = f"a {SECRET} b {_b64(SECRET.encode())} c"
    frame = spark.createDataFrame([(1, hidden, "x"), (2, None, "y"), (3, "nothing here", "z")], "doc_id long, text string, spans string")
    got = {r.doc_id: r.text for r in secret_scan.redacted(frame).collect()}
    assert (got[2], got[3], len(got[1])) == (None, "nothing here", len(hidden))
    assert secret_scan.spans(got[1])[1] == []
    assert got[1].startswith("a *") and got[1].endswith(" c")
