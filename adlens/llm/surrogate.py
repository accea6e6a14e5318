"""Personal data: keyed, type-consistent surrogates with collision checks.

Detected entities (mail addresses, phone and card numbers, network addresses,
account and social-security numbers, names after a title) are replaced by
surrogates that a key and the entity alone determine, so every mention of an
entity anywhere in the corpus gets the same surrogate (coreference):

* numbers keep length, layout and country or issuer prefix, cards and account numbers also whether
  their check digits hold, addresses stay valid;
* mail addresses keep the shape of their local part and the top-level domain;
  a domain is an entity of its own, so addresses of one domain share the surrogate domain
  and different domains stay different;
* names are replaced word by word, so that a surname alone is recognisable as the
  one of a full name, also where it is repeated in the text without a title; script, case and
  length class stay, given names end as the title's gender suggests.

Distinctness is checked over the whole corpus: distinct entities of a kind must
have distinct surrogates, and no surrogate may be a real entity. Losers of a
collision (all but the smallest entity) draw again until there are none; from the 16th
draw on, surrogates grow (numbers by digits, network addresses to their long form), so that a
space which the corpus has used up does not keep them from ending, and ``ROUNDS`` draws without an end are an
error. Finding entities takes time in proportion to the text, whatever it holds. Only
entities, never texts, are shuffled for that; a text's surrogates are generated in
its task, and the few redrawn ones reach the texts that hold them by a join on a
hash of the text.

Defined cases: a null text stays null, an empty one empty; null and repeated ids do
not matter (texts are told apart by content); overlapping finds go to the one
that starts first, then to the kind listed first; an empty table gives no rows;
all columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adlens.llm.common import narrow, staged

KEY = "corpus-surrogates"
SHORT = 16  # draws that keep an entity's length
ROUNDS = 200
# --- Fixed values: kinds of entities in the order of the result -----------------
KINDS = ("email", "ip", "iban", "ssn", "card", "phone", "name")
FEMALE = ("mrs", "ms", "miss", "frau", "mme", "madame", "señora", "sra", "г-жа")
MALE = ("mr", "herr", "monsieur", "señor", "sr", "г-н")
# --- end of fixed values ---------------------------------------------------------
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_FIND = re.compile(
    r"(?<![A-Za-z0-9._%+-])[._%+-]*(?P<email>[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})"
    rf"|(?<![\w.])(?P<ip>(?:{_OCTET}\.){{3}}{_OCTET})(?![\w]|\.\d)"
    r"|(?<!\w)(?P<iban>[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?!\w)"
    r"|(?<![\w-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?<![\w.+-])(?P<card>(?:[3-6]\d|2[2-7])\d{2}(?:[\x20-]?\d{4}){2}[\x20-]?\d{1,7})(?![\w-])"
    r"|(?<![\w.-])(?P<phone>\+\d{1,3}[\x20.-]?(?:\(\d{1,4}\)|\d{1,4})(?:[\x20.-]?\d{2,4}){1,4}"
    r"|\(\d{3}\)\x20?\d{3}[\x20.-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-])"
    r"|(?<!\w)(?P<title>Mrs?\.?|Ms\.?|Miss|Herr|Frau|Mme\.?|Madame|Monsieur|Señora?|Sra?\.|г-жа|г-н)"
    r"\x20(?P<name>[^\W\d_a-zß-öø-ÿа-яё][^\W\d_]+(?:\x20[^\W\d_a-zß-öø-ÿа-яё][^\W\d_]+)?)")
_MAY = re.compile(r"[@+]|\d{3}|\d\.\d|(?:Mr|Ms|Miss|Herr|Frau|Mme|Madame|Monsieur|Se.or|Sra?\.|г-)")

_LATIN = ("b c d f g h j k l m n p r s t v w z br cl dr gr kl pr st tr".split(), list("aeiou"), "a", "n")
_CYRILLIC = ("б в г д ж з к л м н п р с т ф х ц ч ш бр гр др кр пр ст тр".split(), list("аеиоу"), "а", "н")


class _Draw:
    """A stream of numbers that the key and the words determine."""

    def __init__(self, key: str, *words: str):
        self.seed, self.count, self.left = "\x00".join(words).encode(), 0, b""
        self.key = hashlib.blake2b(key.encode(), digest_size=32).digest()

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left += hashlib.blake2b(self.seed + self.count.to_bytes(4, "big"), key=self.key).digest()
            self.count += 1
        x, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return x % n

    def like(self, text: str) -> str:
        """Digits for digits, letters for letters of the same case, the rest unchanged."""
        return "".join(str(self.below(10)) if c.isdigit() else chr(97 + self.below(26)) if "a" <= c <= "z"
                       else chr(65 + self.below(26)) if "A" <= c <= "Z" else c for c in text)


def _check_digit(digits: str) -> str:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 - i % 2)
        total += x - 9 * (x > 9)
    return str(-total % 10)


def _account_check(country: str, body: str) -> str:
    """The two check digits of an account number: the whole, rearranged as a number, is 1 modulo 97."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"


def canonical(kind: str, found: str) -> str:
    """What makes two mentions the same entity."""
    if kind == "email":
        return found.lower()
    if kind == "phone":
        digits = "".join(c for c in found if c.isdigit())
        return digits[1:] if len(digits) == 11 and digits[0] == "1" else digits
    if kind in ("iban", "ssn", "card"):
        return "".join(c for c in found if c.isalnum())
    return found


def surrogate(key: str, kind: str, entity: str, attempt: int) -> str:
    """The ``attempt``-th surrogate of a canonical entity (of a mail address: its local part, the domain unchanged)."""
    draw = _Draw(key, kind, entity, str(attempt))
    more = "".join(str(draw.below(10)) for _ in range(2 + attempt // SHORT)) if attempt >= SHORT else ""  # short shapes run out
    if kind == "email":
        local, _, domain = entity.partition("@")
        return f"{draw.like(local)}{more}@{domain}"
    if kind == "domain":
        name, _, top = entity.rpartition(".")
        return f"{draw.like(name)}{more}.{top}"
    if kind == "ip":
        if more:
            return "2001:db8:" + ":".join(f"{draw.below(1 << 16):x}" for _ in range(6))
        return ".".join(str(1 + draw.below(254)) for _ in range(4))
    if kind == "card":
        body = entity[0] + draw.like(entity[1:]) + more
        return body[:-1] + _check_digit(body[:-1]) if _check_digit(entity[:-1]) == entity[-1] else body
    if kind == "iban":
        country, check, body = entity[:2], entity[2:4], draw.like(entity[4:]) + more
        valid = _account_check(country, entity[4:]) == check
        return country + (_account_check(country, body) if valid else draw.like(check)) + body
    if kind == "phone":
        keep = 0 if len(entity) == 10 else max(0, min(2, len(entity) - 6))
        return entity[:keep] + draw.like(entity[keep:]) + more
    if kind in ("surname", "female", "male", "given"):
        onsets, vowels, soft, hard = _CYRILLIC if re.search("[а-яё]", entity) else _LATIN
        size = max(2, (len(entity) + 1) // 3) + attempt // SHORT
        word = "".join(onsets[draw.below(len(onsets))] + vowels[draw.below(len(vowels))] for _ in range(size))
        return word[:-1] + soft if kind == "female" else word + hard if kind == "male" else word
    return draw.like(entity) + more


def _laid_out(found: str, new: str) -> str:
    """``new`` in the layout of ``found``; digits that ``new`` lacks in front stay, those it has more follow the last."""
    places = [i for i, c in enumerate(found) if c.isalnum()]
    out, more = list(found), new[len(places):]
    new = new[: len(places)]
    for i, c in zip(places[len(places) - len(new):], new):
        out[i] = c
    out.insert(places[-1] + 1, more)
    return "".join(out)


def _name_parts(title: str, name: str) -> list[tuple[str, str]]:
    """(kind, canonical) of the words of a name: given names first, the surname last."""
    title = title.lower().rstrip(".")
    given = "female" if title in FEMALE else "male" if title in MALE else "given"
    words = [w.lower() for w in name.split(" ")]
    return [(given, w) for w in words[:-1]] + [("surname", words[-1])]


def _kept(kind: str, canon: str) -> bool:
    """Whether a find is one of its kind after all."""
    if kind != "card":
        return True
    if canon[0] == "2":  # an issuer range that other numbers fall into as well
        return 2221 <= int(canon[:4]) <= 2720 and len(canon) == 16 and _check_digit(canon[:-1]) == canon[-1]
    return 13 <= len(canon) <= 19


def entities(text: str) -> Iterator[tuple[str, int, int, list[tuple[str, str]]]]:
    """(kind, start, end, parts) of the entities of a text; parts are (kind, canonical) to be replaced."""
    if not _MAY.search(text):
        return
    found, named = [], {}
    for m in _FIND.finditer(text):
        kind = m.lastgroup
        if kind == "name":
            parts = _name_parts(m["title"], m["name"])
            named.update(zip(m["name"].split(" "), parts))
            found.append((kind, m.start("name"), m.end("name"), parts))
            continue
        start, end = m.span(kind)
        canon = canonical(kind, text[start:end])
        if _kept(kind, canon):
            parts = [(kind, canon)] + ([("domain", canon.partition("@")[2])] if kind == "email" else [])
            found.append((kind, start, end, parts))
    if named:  # their words without a title, where nothing else was found
        gaps, at = [], 0
        again = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(named, key=len, reverse=True))) + r")(?!\w)")
        for _, start, end, _ in [*found, ("", len(text), len(text), [])]:
            gaps += [("name", w.start(), w.end(), [named[w[0]]]) for w in again.finditer(text, at, start)]
            at = end
        found = sorted(found + gaps, key=lambda f: f[1])
    yield from found


def _cased(word: str, new: str) -> str:
    return new.upper() if word.isupper() and len(word) > 1 else new[:1].upper() + new[1:]


def replace(text: str, key: str, redrawn: dict[tuple[str, str], str]) -> tuple[str, list[int]]:
    """The text with surrogates, and the number of entities of each kind."""
    out, at, counts = [], 0, [0] * len(KINDS)
    for kind, start, end, parts in entities(text):
        found = text[start:end]
        new = [redrawn.get(p) or surrogate(key, *p, 0) for p in parts]
        if kind == "name":
            done = " ".join(map(_cased, found.split(" "), new))
        elif kind == "email":
            done = f"{new[0].partition('@')[0]}@{new[1]}"
            done = done.upper() if found.isupper() else done
        elif kind == "ip":
            done = new[0]
        else:
            done = _laid_out(found, new[0])
        out += [text[at:start], done]
        at = end
        counts[KINDS.index(kind)] += 1
    return "".join([*out, text[at:]]) if out else text, counts


def _detect(key: str):
    schema = pa.schema([("tkey", pa.int64()), ("kind", pa.string()), ("entity", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: set[tuple[int, str, str]] = set()
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for tkey, text in zip(*(c.to_pylist() for c in part.columns)):
                    rows.update((tkey, *p) for _, _, _, parts in entities(text or "") for p in parts)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*sorted(rows)), schema)]
                                             if rows else [pa.array([], f.type) for f in schema], schema=schema)
    return run


def _drawn(key: str):
    schema = pa.schema([("kind", pa.string()), ("entity", pa.string()), ("attempt", pa.int32()), ("new", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, names, attempts = (c.to_pylist() for c in batch.columns)
            new = [surrogate(key, *x) for x in zip(kinds, names, attempts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], schema=schema)
    return run


def mapping(found: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, entity, attempt, new): a distinct surrogate for each entity. ``found``: kind, entity."""
    shape = "kind string, entity string, attempt int, new string"
    all_ = staged(found.select("kind", "entity").distinct().withColumn("attempt", F.lit(0).cast("int"))
                  .mapInArrow(_drawn(key), shape), "pii_entities")
    real = all_.select("kind", F.col("entity").alias("new")).withColumn("real", F.lit(True))
    for _ in range(ROUNDS):
        # of those that drew the same, the one that has drawn least often, then the smallest, keeps it
        taken = all_.groupBy("kind", "new").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("attempt", "entity")).alias("winner"))
        clash = taken.join(real, ["kind", "new"], "left").where("n > 1 OR real")
        losers = staged(all_.join(clash, ["kind", "new"]).where(
            F.col("real") | (F.struct("attempt", "entity") != F.col("winner")))
            .select("kind", "entity", (F.col("attempt") + 1).alias("attempt")).mapInArrow(_drawn(key), shape), "pii_losers")
        if losers.isEmpty():
            return all_
        all_ = staged(all_.join(losers, ["kind", "entity"], "left_anti").unionByName(losers), "pii_entities")
    raise RuntimeError(f"surrogates still collide after {ROUNDS} draws")


_COUNTS = [f"n_{k}" for k in KINDS]


def _replacer(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            texts, counts = [], []
            for text, redrawn in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                new, n = (None, [0] * len(KINDS)) if text is None else replace(
                    text, key, {(r["kind"], r["entity"]): r["new"] for r in redrawn or ()})
                texts.append(new)
                counts.append(n)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[2:], pa.array(texts, pa.string()), *(pa.array(c, pa.int64()) for c in zip(*counts))],
                names=[*batch.schema.names[2:], "new_text", *_COUNTS])
    return run


def anonymise(docs: DataFrame, text_col: str = "text", key: str = KEY, out: str = "pii") -> DataFrame:
    """All columns of ``docs``, the text with surrogates, and a struct ``out`` of the entities found by kind."""
    found = staged(narrow(docs, text=text_col).where("text IS NOT NULL").select(F.xxhash64("text").alias("tkey"), "text")
                   .mapInArrow(_detect(key), "tkey long, kind string, entity string"), "pii_found")
    redrawn = mapping(found, key).where("attempt > 0").select("kind", "entity", "new")
    per_text = staged(found.distinct().join(redrawn, ["kind", "entity"]).groupBy("tkey").agg(
        F.collect_list(F.struct("kind", "entity", "new")).alias("redrawn")), "pii_redrawn")
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select(F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)])
    # Spark broadcasts the redrawn ones if their measured size allows, else joins by shuffle
    rows = rows.withColumn("tkey", F.xxhash64("text")).join(per_text, "tkey", "left").select("text", "redrawn", *names)
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, docs.schema)]
                          + [T.StructField("new_text", T.StringType())] + [T.StructField(n, T.LongType()) for n in _COUNTS])
    done = rows.mapInArrow(_replacer(key), schema)
    return done.select(*[F.col("new_text" if c == text_col else n).alias(c) for n, c in zip(names, docs.columns)],
                       F.struct(*_COUNTS).alias(out))
