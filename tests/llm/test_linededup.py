import hashlib
import random

from adlens.llm import linededup
from tests.llm.fixtures_llm import AWKWARD, docs


def chunks(text):
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    out, own = [], []
    for i, line in enumerate(lines):
        own.append(line)
        if ((h[i - 1] if i else 0) * 31 + h[i]) % linededup.DIVISOR == 0 or i == len(lines) - 1:
            out.append(own)
            own = []
    return out


def brute(texts):
    first = {}
    for doc_id, text in texts:
        for k, c in enumerate(chunks(text or "")):
            if doc_id is not None and text is not None and len(c) >= 2:
                key = tuple(c)
                first[key] = min(first.get(key, (doc_id, k)), (doc_id, k))
    out = []
    for doc_id, text in texts:
        if text is None or doc_id is None:
            out.append((doc_id or -1, text))
            continue
        kept = [c for k, c in enumerate(chunks(text)) if len(c) < 2 or first[tuple(c)] == (doc_id, k)]
        out.append((doc_id, "\n".join(x for c in kept for x in c)))
    return sorted(out, key=str)


def run(spark, texts):
    got = linededup.dedup(docs(spark, texts))
    assert got.columns == [*docs(spark, texts).columns, "line_dedup"]
    return sorted(((r.doc_id or -1, r.text) for r in got.collect()), key=str)


def test_repeated_passages(spark):
    r = random.Random(5)
    lines = [f"line {i} of the common stock" for i in range(400)]
    passage = lines[:25]
    texts = []
    for i in range(40):
        own = [f"own {i} {j}" for j in range(r.randrange(1, 12))] + (passage if i % 2 else []) + ["", "tail"]
        texts.append((100 - i, "\n".join(own)))
    texts += [(200, texts[1][1]), (201, "\n".join(passage * 3)), (202, "a\nb"), (203, "a\nb")]
    assert run(spark, texts) == brute(texts)
    # shift-resistant: the passage's inner chunks go wherever it stands
    cut = dict(run(spark, texts))
    assert sum(len(t) for _, t in texts) > 1.3 * sum(len(t) for t in cut.values())


def test_awkward(spark):
    texts = AWKWARD + [(30, "\n\n\n"), (31, "x\r\ny\n"), (None, "p\nq\nr\ns"), (32, "p\nq\nr\ns"), (33, "p\nq\nr\ns"),
                       (33, "p\nq\nr\ns"), (34, "\n".join(f"l{i % 50}" for i in range(20000)))]
    assert run(spark, texts) == brute(texts)


def test_empty(spark):
    assert run(spark, []) == []
