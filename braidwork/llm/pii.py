"""Personal data and secrets by bootstrapped contextual extraction.

An instance is a piece of text that looks like an identifier: it has a digit or an @, or is a value behind a colon or an equals sign.
Strict recognisers look for seed entities anywhere, inside unbroken text of any length too. The patterns of an instance are lexical: its
shape, its shape with the literal word that it begins with, its shape class behind the one or two words in front of it, and, for a
value, the key in front of it alone, so that a key that introduces seeds discovers values without a digit. A name or a street without a digit that stands in plain prose is
no instance. Then Spark scores the bipartite graph of instances and patterns in turns: a pattern is worth the mean score of its
instances, damped for support; an instance is worth the best of its patterns, a seed 1 at least. Patterns of high confidence extract all
their instances, those that no recogniser knows among them.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import Table, scratch, write
from ._words import column, map_chunks

ROUNDS = 4
#: A pattern is accepted from this confidence on, with this many distinct instances at least.
CONFIDENCE = 0.6
SUPPORT = 3
#: Patterns with few instances are damped: n / (n + DAMPING).
DAMPING = 1.0
#: An instance that no recogniser knows is worth this share of its best pattern.
DECAY = 0.95
#: A shape of more characters is given as its digest: equal shapes stay equal.
_SPELLED = 64

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![A-Za-z0-9])")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_JWT = re.compile(r"(?<![A-Za-z0-9])eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}", re.A)
_KEY = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,})(?![A-Za-z0-9])")
_CREDENTIALS = re.compile(r"(?<=://)[^\s:/@]+:[^\s:/@]+(?=@)")
_CARD = re.compile(r"(?<![\d.])(?:\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?:\1\d{1,3})?|\d{4}([ -])\d{6}\2\d{4,5}|\d{13,19})(?!\d)", re.A)
_SSN = re.compile(r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\w-])", re.A)
_IP = re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)", re.A)
_PHONE = re.compile(r"(?<![\w+])\+\d{1,3}[ -]?(?:\(\d{2,4}\)|\d{2,4})(?:[ -]?\d{2,4}){2,3}(?!\d)|(?<!\w)\(\d{3}\) ?\d{3}-\d{4}(?!\d)", re.A)
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])", re.A)
_SECRET = re.compile(r"(?<![A-Za-z])(?:password|passwd|pwd|secret|token|api_?key)(?:[\"']?[:=][\"']?(?=[^\s\"',;&]*\d)([^\s\"',;&]+)|[\"']? ?[:=] [\"']?(?=[^\s\"',;&]*\d)([^\s\"',;&]{12,}))", re.I | re.A)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _iban(text: str) -> bool:
    """A solid one is taken by its form, one in groups has to have the right check digits."""
    solid = text.replace(" ", "")
    return solid == text or int("".join(str(int(c, 36)) for c in solid[4:] + solid[:4])) % 97 == 1


def _ip(text: str) -> bool:
    return all(int(n) < 256 and (n == "0" or n[0] != "0") for n in text.split("."))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin and text[begin - 1] in _LOCAL:
            begin -= 1
        while begin < at and not text[begin].isalnum():
            begin += 1
        m = _DOMAIN.match(text, at + 1)
        if m and begin < at:
            yield begin, m.end()
        at = text.find("@", at + 1)


#: In the order of precedence where two overlap.
_RECOGNISERS = (("key", _KEY, None), ("key", _JWT, None), ("credentials", _CREDENTIALS, None), ("card", _CARD, lambda x: _luhn(re.sub("[ -]", "", x))), ("ssn", _SSN, None), ("ip", _IP, _ip), ("phone", _PHONE, None), ("secret", _SECRET, None), ("iban", _IBAN, _iban))


def seeds(text: str) -> list[tuple[int, int, str]]:
    """(begin, end, kind) of the seed entities in a text, sorted, without overlap."""
    found = [(a, b, "email") for a, b in _emails(text)]
    for kind, pattern, good in _RECOGNISERS:
        # of a secret with its name only the value is the entity
        found += [(*(m.span(m.lastindex) if kind == "secret" else m.span()), kind) for m in pattern.finditer(text) if good is None or good(m.group())]
    out: list[tuple[int, int, str]] = []
    for a, b, kind in found:
        place = bisect(out, (a,))
        if not (place and out[place - 1][1] > a) and not (place < len(out) and out[place][0] < b):
            out.insert(place, (a, b, kind))
    return out


def recognise(text: str) -> str | None:
    """The kind of seed entity that the text is as a whole, a secret with its name, or None."""
    if _SECRET.fullmatch(text):
        return "secret"
    return next((kind for a, b, kind in seeds(text) if (a, b) == (0, len(text))), None)


_RUN = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9]+")


def _class(run: str) -> str:
    """9n: digits; a: letters; h: mixed letters and digits, x for hexadecimal, u for capitals; punctuation stands for itself."""
    if run.isascii() and run.isdigit():
        return f"9{len(run)}"
    if run.isascii() and run.isalpha():
        return "a"
    if run.isascii() and run.isalnum():
        kind = "x" if re.fullmatch("[0-9a-f]+", run) else "u" if run.upper() == run else "h"
        return f"{kind}{len(run)}" if len(run) >= 12 else "h"
    return run


def _spelled(shape: str) -> str:
    return shape if len(shape) <= _SPELLED else "digest " + hashlib.md5(shape.encode()).hexdigest()


def patterns(text: str, left: tuple[str, ...]) -> list[str]:
    """The lexical patterns of an instance behind the words left (nearest last)."""
    runs = _RUN.findall(text)
    classes = [_class(r) for r in runs]
    shape = "".join(classes)
    out = [f"shape {_spelled(shape)}"] if shape != "a" else []
    if len(runs) > 1 and runs[0].isalpha() and runs[0].isascii():
        out.append(f"prefix {_spelled(runs[0].lower() + ''.join(classes[1:]))}")
    elif runs and len(runs[0]) >= 12 and (head := re.match("[A-Za-z]{3,4}", runs[0])):
        out.append(f"prefix {head.group()}+{_spelled(shape)}")
    coarse = _spelled(re.sub(r"\d+", "", shape))  # lengths differ behind the same words
    for k in (1, 2):
        if len(left) >= k:
            out.append(f"left {_spelled(' '.join(left[-k:]).lower())} _ {coarse}")
    if left and left[-1][-1] in ":=":
        key = left[-1] if len(left[-1]) > 1 or len(left) < 2 else left[-2] + left[-1]
        out.append(f"key {_spelled(key.lower())}")
    return out


#: A piece of text between spaces, quotes, brackets and list signs, and between a key and its value.
_PIECE = re.compile(r"[^\s,;\"'`<>\[\]{}()|=]+")
_WORD_BEFORE = re.compile(r"\w+[:=]?|[:=]")
_MARKED = re.compile("[0-9@]")
_EDGE = ".:!?%&*#$/\\"


def _instances(text: str) -> list[tuple[int, str, str | None, tuple[str, ...]]]:
    """(start, text, kind, words in front) of all instances: seeds, and what is between them."""
    known = seeds(text)
    spans: list[tuple[int, int, str | None]] = list(known)
    begins = [a for a, _, _ in known]
    last: list[int] | None = None  # an open run of number groups
    for m in _PIECE.finditer(text):
        piece = m.group()
        core = piece.strip(_EDGE)
        begin = m.start() + (piece.find(core) if core else 0)
        end = begin + len(core)
        place = bisect(begins, begin)
        taken = (place and known[place - 1][1] > begin) or (place < len(known) and known[place][0] < end)
        value = begin > 0 and (text[begin - 1] in ":=" or text[max(0, begin - 2) : begin] in (": ", "= ", ':"', '="'))
        if not core or taken or not (value or _MARKED.search(core)):
            last = None
            continue
        number = not any(c.isalpha() for c in core)
        if number and last is not None and begin == last[1] + 1 and text[last[1]] == " ":
            last[1] = end
            spans[-1] = (last[0], end, None)
        else:
            spans.append((begin, end, None))
            last = [begin, end] if number else None
    words = [(w.end(), w.group()) for w in _WORD_BEFORE.finditer(text)]
    ends = [e for e, _ in words]
    out = []
    for a, b, kind in sorted(spans, key=lambda x: x[:2]):
        place = bisect(ends, a)
        out.append((a, text[a:b], kind, tuple(w for _, w in words[max(0, place - 2) : place])))
    return out


def instances(docs: DataFrame) -> DataFrame:
    """(doc_id, start, text, seed, patterns) of each instance; start counts characters from 0.

    Whole texts are searched; only the neighbourhood of a digit, an @, a colon or an equals sign is looked at one by one.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids = column(batch, "doc_id")
        rows = []
        for d, text in enumerate(column(batch, "text").to_pylist()):
            if not text:
                continue
            at = 0
            while (m := _SPOT.search(text, at)) is not None:
                begin, end = _back(text, m.start()), _ahead(text, m.start())
                for start, instance, seed, left in _instances(text[begin:end]):
                    if begin + start >= at:
                        rows.append((d, begin + start, instance, seed, patterns(instance, left)))
                at = end
        if not rows:
            return None
        doc, start, instance, seed, found = zip(*rows)
        return pa.RecordBatch.from_arrays([ids.cast(pa.int64()).take(pa.array(doc)), pa.array(start, pa.int64()), pa.array(instance), pa.array(seed, pa.string()), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "start", "text", "seed", "patterns"])

    return map_chunks(docs.select("doc_id", "text"), "text", run, "doc_id long, start long, text string, seed string, patterns array<string>")


_SPOT = re.compile(r"[0-9@]|[:=][\"']?\s?\S")
_MARK = re.compile("[0-9@:=]")
_TOKEN = re.compile(r"\S*\s*")


def _back(text: str, spot: int, words: int = 3) -> int:
    """Where the token at the spot and so many words in front of it begin."""
    at, seen = spot, 0
    while at > 0:
        if text[at - 1].isspace() and not text[at].isspace():
            seen += 1
            if seen > words:
                return at
        at -= 1
    return 0


def _ahead(text: str, spot: int) -> int:
    """Behind the last of the tokens from the spot on that have a mark or are a value behind one, without a gap of other tokens."""
    end, value = spot, True
    while end < len(text):
        stop = _TOKEN.match(text, end).end()
        marked = _MARK.search(text, end, stop)
        if not value and not marked:
            break
        value = bool(marked) and text[end:stop].rstrip()[-1:] in (":", "=")
        end = stop
    return end


def score_patterns(found: DataFrame, *, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(pattern, confidence, support) after so many rounds over the graph of distinct instances and patterns.

    found is a table like that of instances(). Equal instances behind different words are one node with all their patterns. Null texts
    and instances without a pattern take no part, repeated rows are one; an empty table gives no rows.
    """
    edges = write(found.where("text is not null").select(F.xxhash64("text").alias("node"), F.col("seed").isNotNull().cast("double").alias("seed"), F.explode("patterns").alias("pattern")).groupBy("node", "pattern").agg(F.max("seed").alias("seed")))
    nodes = edges.groupBy("node").agg(F.max("seed").alias("score"))
    held: Table | None = None
    for _ in range(rounds):
        joined = edges.select("node", "pattern", "seed").join(nodes, "node")
        scores = joined.groupBy("pattern").agg((F.sum("score") / (F.count("*") + damping)).alias("confidence"), F.count("*").alias("support"))
        table = Table(scores)
        if held is not None:
            held.release()
        held = table
        nodes = edges.join(held.df, "pattern").groupBy("node").agg(F.greatest(F.max("seed"), F.max("confidence") * DECAY).alias("score"))
    return held.df


def find(docs: DataFrame, *, confidence: float = CONFIDENCE, support: int = SUPPORT, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, start, text, kind, pattern, confidence) of each identifier found.

    kind is that of the recogniser, or 'discovered'; pattern is the accepted pattern with the highest confidence, of
    equals the first in the alphabet, null if only a recogniser knows the instance. Repeated rows give one result, a null doc_id stays
    null, null and empty texts have none. Only doc_id and text are read. An empty table gives no rows.
    """
    with scratch() as settle:
        found = write(instances(docs))
        accepted = score_patterns(found, rounds=rounds).where((F.col("confidence") >= confidence) & (F.col("support") >= support)).select("pattern", "confidence")
        columns = ["doc_id", "start", "text", "seed"]
        wide = found.select(*columns, F.explode_outer("patterns").alias("pattern")).join(accepted, "pattern", "left")
        best = wide.groupBy(*columns).agg(F.min(F.when(F.col("confidence").isNotNull(), F.struct((-F.col("confidence")).alias("less"), "pattern"))).alias("top"))
        kept = best.where(F.col("seed").isNotNull() | F.col("top").isNotNull())
        return settle(kept.select("doc_id", "start", "text", F.coalesce("seed", F.lit("discovered")).alias("kind"), F.col("top.pattern").alias("pattern"), F.round(-F.col("top.less"), 6).alias("confidence")))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_pii": op10_pii}
ORACLE_SQL: dict[str, str] = {}
