import hashlib
import heapq
import random
import zlib

import pytest
from pyspark.sql import types as T

from adlens.llm import conversations as c

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                       T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
                       T.StructField("digest", T.StringType()), T.StructField("m", T.StringType())])
WHITE = " \t\n\x0b\x0c\r"
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def cheapest(rows):
    """Dijkstra over (rows read, state): rows are (initial, must go, extra)."""
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if i == len(rows) and q in (0, 3):
            return cost, audit
        if (i, q, audit) in done:
            continue
        done.add((i, q, audit))
        for r in "ua":
            if (q, r) in NEXT and len(audit) < 3 * len(rows) + 4:
                heapq.heappush(heap, (cost + 3, audit + "I", i, NEXT[q, r]))
        if i < len(rows):
            initial, gone, extra = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, q))
            if not gone:
                if (q, initial) in NEXT:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, NEXT[q, initial]))
                for r in "ua":
                    if (q, r) in NEXT:
                        heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, NEXT[q, r]))


def brute(rows, ids):
    out = []
    for conv in set(ids):
        mine = sorted(((t is not None, t or 0, r, hashlib.sha256(x.encode()).digest(), x)
                       for v, t, r, x in rows if v == conv), key=lambda z: z[:4])
        seen, facts, n = set(), [], [0, 0, 0, 0]
        for _, _, role, _, text in mine:
            end = text.rstrip(WHITE)
            fault = 1 if not end else 2 if (role, text) in seen else 3 if end[-1] not in ".!?" else 0
            seen.add((role, text))
            n[fault] += 1
            facts.append((role[:1], fault in (1, 2), 3 if fault == 3 else 0))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(facts, facts[1:]))
        cost, audit = cheapest(facts)
        q, i, lines = 0, 0, []
        for e in audit:
            role, text = (mine[i][2], mine[i][4]) if e != "I" else ("", "")
            i += e != "I"
            if e == "D":
                continue
            if e != "K":
                role = "assistant" if q == 2 else "user"
            q = NEXT[q, role[0]]
            lines.append(f"{role}:{text}")
        turns = [z[1] for z in mine if z[0]]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *n[1:], illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def run(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0))


def spaced(rows):
    return [(v, t, " " if r is None else r, " " if x is None else x) for v, t, r, x in rows]


def some(seed, convs, longest):
    r = random.Random(seed)
    texts = ["Hi.", "so", "well!", "", " \n", "A?\t\r\n", None, "end. no", "é", "1\x0b", "!\x0c"]
    rows = []
    for v in range(convs):
        for t in range(r.randrange(longest)):
            rows.append((v if v else None, r.choice([t, t, t, t + 2, None]),
                         r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), r.choice(texts)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_cheapest_repairs(spark, seed):
    rows = some(seed, 60, 9)
    ids = [r[0] for r in rows] + [900]
    everyone = spark.createDataFrame([(i,) for i in ids], "conv_id long")
    assert run(c.digest(frame(spark, rows), everyone)) == brute(spaced(rows), ids)


def test_repeats_and_one_long_conversation(spark):
    r = random.Random(5)
    rows = [(7, t, r.choice(["user", "assistant"]), f"text {t}." if r.random() < .9 else "again.") for t in range(3000)]
    rows += [(8, 1, "user", "same.")] * 500 + [(9, t, "ua"[t % 2] + "x", "T.") for t in range(4)] * 2
    got = run(c.digest(frame(spark, rows)))
    # the whole audit of the long one by its own rows, cut at places where the state is known
    assert [g[0] for g in got] == [7, 8, 9]
    assert got[1][3] == 499 and got[1][7] == "K" + "D" * 499 + "I" and got[1][6] == 499 * 4 + 3
    assert got[2:] == brute([x for x in rows if x[0] == 9], [9])
    long = [x for x in rows if x[0] == 7]
    seen, dup = set(), 0
    for x in long:
        dup += (x[2], x[3]) in seen
        seen.add((x[2], x[3]))
    assert got[0][3] == dup and got[0][7].count("D") >= dup and len(got[0][7].replace("I", "")) == 3000
    assert got[0][6] == optimum(long)


def optimum(rows):
    seen, best = set(), {0: 0}
    for _, _, role, text in rows:
        gone, now = (role, text) in seen, {}
        seen.add((role, text))

        def put(q, v):
            now[q] = min(v, now.get(q, v))
        for _ in range(2):
            for (q, x), to in NEXT.items():
                if x != "s" and q in best:
                    best[to] = min(best.get(to, 10**9), best[q] + 3)
        for q, v in best.items():
            put(q, v + 4)
            for (p, x), to in NEXT.items():
                if p == q and not gone:
                    if x != "s":
                        put(to, v + 3)
                    if x == role[0]:
                        put(to, v)
        best = now
    return min(best[3], best.get(2, 10**9) + 3, best.get(0, 10**9))


def test_damage(spark):
    rows = spaced(some(3, 40, 8))
    want = []
    for v, t, r, x in some(3, 40, 8):
        hit = zlib.crc32(f"{' ' if v is None else v}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if hit == 1 else x.translate({46: None, 33: None, 63: None}) if hit == 2 else x
        want += [(v, t, "user" if hit == 4 else r, x)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    key = str
    assert sorted(map(key, (tuple(r) for r in c.damaged(frame(spark, some(3, 40, 8))).collect()))) == sorted(map(key, want))
    assert len(rows) > 50


def test_repaired_rows_fit(spark):
    rows = some(11, 50, 9)
    done = {}
    for r in c.repair(frame(spark, rows)).collect():
        done.setdefault(r.conv, []).append((r.at, r.role[0], r.edit, r.text))
    for got in done.values():
        got.sort()
        assert [g[0] for g in got] == list(range(1, len(got) + 1))
        roles = "".join(g[1] for g in got)
        assert roles.removeprefix("s").replace("ua", "") == "" and roles != "s"
        assert all(g[3] == "" for g in got if g[2] == "I")


def test_neighbours_share_nodes():
    words = sorted(["sua"[::-1] * 3, "au", "aua", "auaS", "auad", "dd", ""])
    assert [c.cheapest(iter([w])).__next__() for w in words] == list(c.cheapest(iter(words)))


def test_empty(spark):
    assert c.digest(frame(spark, [])).collect() == []
    assert c.repair(frame(spark, [])).collect() == []
