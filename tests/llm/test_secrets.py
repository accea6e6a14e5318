import hashlib
import re

from adlens.llm import secrets
from tests.llm.fixtures_llm import AWKWARD, docs

KEY, HEX, BLOB = "AKIA" + "Q1W2E3R4T5Y6U7I8", "0123456789abcdef01234567", "aB3" * 12


def base(text):
    """The contract's rules, word for word."""
    kinds = [("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
              lambda m: len(m[2]) >= 6), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
             ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24)]
    found = [(m.start(), i, m.end(), k) for i, (k, p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m)]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


TEXTS = [
    (10, f'x password = "hunter22" and TOKEN:{HEX} é日 api_key=abc'), (11, "ſecret=abcdefgh toKen=abcdefgh"),
    (12, f"{KEY} then {BLOB} at https://db.example.com/x"), (13, f"{BLOB} alone"), (14, "see https://a.example.com"),
    (15, f"{BLOB}" + " " * 500 + f"{KEY}"), (16, f"user=alice secret=abcdefgh 10.0.0.1 {HEX}{HEX}"),
    (17, "AKIASHORT AKIA" + "X" * 15), (18, "password='' secret=short token==x.y-z_9"),
    (19, f"{KEY}{KEY} " * 50 + "token=abcdef " * 50)]


def run(spark, texts):
    return secrets.digest(secrets.scan(docs(spark, texts)))


def test_base_spans(spark):
    texts = TEXTS + AWKWARD
    got = sorted((r.doc_id or -1, r.base_sha256, r.n_assign + r.n_access + r.n_hex) for r in run(spark, texts).collect())
    want = sorted((d or -1, hashlib.sha256(base(t).encode()).hexdigest(), base(t).count(":") // 2) for d, t in texts)
    assert got == want


def test_weak_parts_need_a_complement(spark):
    spans = {r.doc_id: r.spans for r in run(spark, TEXTS).collect()}
    assert "blob" in spans[12] and "endpoint" in spans[12] and "access" in spans[12]
    assert spans[13] == "" and spans[14] == ""
    assert "blob" not in spans[15] and "access" in spans[15]
    assert [s.split(":")[0] for s in spans[16].split(",")] == ["account", "assign", "endpoint", "hex"]
    for d, t in TEXTS:
        kept = ",".join(s for s in spans[d].split(",") if s.split(":")[0] in secrets.KINDS[:3])
        assert kept == base(t)


def brute_links(text, window=secrets.WINDOW):
    """Every part with the nearest complementary part around it, by comparing all pairs."""
    found = secrets.base_spans(text)
    found = sorted(found + secrets.weak_spans(text, found), key=lambda s: (s[1], s[0], s[2]))
    of = {0: (1, 3, 5), 2: (1, 3, 5), 4: (1, 3, 5), 1: (0, 2, 4), 3: (0, 2, 4), 5: (0, 2, 4)}
    out = []
    for i, (k, a, b) in enumerate(found):
        last = max(((e, s, j) for j, s, e in found[:i] if j in of[k]), default=None)
        first = min(((s, e, j) for j, s, e in found[i + 1:] if j in of[k]), default=None)
        near = []
        if last and max(0, a - last[0]) <= window:
            near.append((max(0, a - last[0]), 0, last[2], last[1], last[0]))
        if first and max(0, first[0] - b) <= window:
            near.append((max(0, first[0] - b), 1, first[2], first[0], first[1]))
        if near:
            _, _, j, s, e = min(near)
            out.append(f"{secrets.KINDS[k]}:{a}:{b}>{secrets.KINDS[j]}:{s}:{e}")
    return ",".join(out)


def test_partners_by_brute_force(spark):
    import random
    r = random.Random(12)
    pieces = [KEY, HEX, BLOB, "https://db.example.com/x", "10.0.0.7", "user=alice", "password: hunter22", "token=abcdefgh", "word", "é日",
              "login: bob", f"secret={HEX}"]
    texts = [(1000 + i, "".join(r.choice(pieces) + " " * r.choice([1, 1, 3, 90, 180, 260]) for _ in range(r.randrange(1, 14)))) for i in range(120)]
    got = {g.doc_id: (g.links, g.n_linked) for g in run(spark, texts + TEXTS).collect()}
    assert sum(n for _, n in got.values()) > 200
    for d, t in texts + TEXTS:
        assert got[d][0] == brute_links(t) and got[d][1] == brute_links(t).count(">"), t


def test_empty(spark):
    assert run(spark, []).count() == 0
