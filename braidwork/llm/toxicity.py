"""Toxicity by a weighted finite-state pattern grammar.

Words are mapped to classes (insult, threat, target, negation, reported speech, linking word, other). Five small
weighted transducers each read the classes of a clause and know one thing: an insult, a threat, a target, a negation in
front of either, a report ("she said") in front of either. They are composed into one deterministic machine, whose
weight for a clause is the product of what the five say, so that "you idiot" outweighs "idiot", and "he said you are
not an idiot" is next to nothing. The machines read from left to right: a target or a negation counts for what stands behind it. A
document's score is the sum over its clauses.

The insult and threat words are a seed list, extended from labelled rows (a bounded sample, see Lexicon learning below).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._words import column, hash_spans, hash_word, map_chunks, split_words

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, LINK, END = range(8)
CLASSES = 8

#: Words of each class. Insults and threats are extended by learn_lexicon.
INSULTS = "idiot moron scum trash loser clown stupid pathetic worthless disgusting imbecile dumbass vermin filth".split()
THREATS = "kill hurt destroy beat strangle stab shoot murder".split()
TARGETS = "you your youre yourself u he she they him her them his their these those du dich dir ihr tu te toi vous usted ustedes".split()
NEGATIONS = "not no never none neither nor cannot dont doesnt isnt arent wasnt nicht kein keine nie pas jamais non nunca jamás tampoco".split()
REPORTS = "said says claimed claims called calls quoted quotes wrote writes reported reports alleged allegedly sagte schrieb dit écrit dijo escribió".split()
LINKS = "a an the are is was were be am such so very really as like of and or to will would ll re gonna".split()

#: A document is rejected from this score on: one insult or threat that is neither denied nor reported, and then some.
REJECT = 1.0
INSULT_WEIGHT, THREAT_WEIGHT, TARGET_FACTOR, NEGATION_FACTOR, REPORT_FACTOR = 1.0, 1.2, 1.5, 0.15, 0.3


@dataclass
class Transducer:
    """A complete deterministic weighted automaton over classes: to[state][class], weight[state][class] multiply or add.

    gain is what reading a class in a state adds to the running clause score, factor is what it multiplies later gains by.
    """

    to: list[list[int]]
    gain: list[list[float]] = field(default_factory=list)
    factor: list[float] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.gain = self.gain or [[0.0] * CLASSES for _ in self.to]
        self.factor = self.factor or [1.0] * len(self.to)


def insults() -> Transducer:
    return Transducer([[0] * CLASSES], [[INSULT_WEIGHT if c == INSULT else 0.0 for c in range(CLASSES)]])


def threats() -> Transducer:
    return Transducer([[0] * CLASSES], [[THREAT_WEIGHT if c == THREAT else 0.0 for c in range(CLASSES)]])


def targets(reach: int = 4) -> Transducer:
    """A target makes what follows within reach words heavier; linking words don't use up the reach."""
    to = []
    for s in range(reach + 1):
        to.append([reach if c == TARGET else 0 if c == END else s if c == LINK else max(0, s - 1) for c in range(CLASSES)])
    return Transducer(to, factor=[1.0] + [TARGET_FACTOR] * reach)


def negations(reach: int = 3) -> Transducer:
    """A negation makes what follows within reach words light; linking words and targets don't use up the reach."""
    to = []
    for s in range(reach + 1):
        to.append([reach if c == NEGATION else 0 if c == END else s if c in (LINK, TARGET) else max(0, s - 1) for c in range(CLASSES)])
    return Transducer(to, factor=[1.0] + [NEGATION_FACTOR] * reach)


def reports() -> Transducer:
    """After a word of reporting the rest of the clause is someone else's speech."""
    return Transducer([[1 if c == REPORT else 0 for c in range(CLASSES)], [0 if c == END else 1 for c in range(CLASSES)]], factor=[1.0, REPORT_FACTOR])


def compose(machines: Iterable[Transducer]) -> Transducer:
    """One machine whose states are the reachable tuples of states; gains add up, factors multiply.

    What a word gains is weighed by the factors of the states *before* the word, so a machine looks at what came in front.
    """
    machines = list(machines)
    index, order = {tuple(0 for _ in machines): 0}, [tuple(0 for _ in machines)]
    to: list[list[int]] = []
    gain: list[list[float]] = []
    for state in order:  # grows while it is read
        row, got = [], []
        factor = math.prod(m.factor[s] for m, s in zip(machines, state))
        for c in range(CLASSES):
            nxt = tuple(m.to[s][c] for m, s in zip(machines, state))
            if nxt not in index:
                index[nxt] = len(order)
                order.append(nxt)
            row.append(index[nxt])
            got.append(factor * sum(m.gain[s][c] for m, s in zip(machines, state)))
        to.append(row)
        gain.append(got)
    return Transducer(to, gain)


def grammar() -> Transducer:
    return compose([insults(), threats(), targets(), negations(), reports()])


@dataclass(frozen=True)
class Lexicon:
    """Word hashes and stems of the weighted classes. A stem is a prefix of at most eight bytes that many toxic words share."""

    words: tuple[str, ...] = tuple(INSULTS)
    stems: tuple[str, ...] = ()


def learn_lexicon(docs: DataFrame, labels: DataFrame, *, rows: int = 20_000, min_docs: int = 5, precision: float = 0.97, min_forms: int = 3) -> Lexicon:
    """Seed insults and what labelled documents add to them.

    The classifier is fitted on at most `rows` labelled rows (those with the least hashes of doc_id), the only bound in this
    module. A word becomes an insult if it is in min_docs toxic documents of the sample and at least `precision` of the
    documents with it are toxic; a stem of 4 to 6 letters if so and min_forms different words of toxic documents have it.
    Documents without a label, labels without a document and null labels add nothing. If there is nothing to learn
    from, the lexicon is the seeds.
    """
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("bad")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # broadcast: at most `rows` rows

    def count(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        w = split_words(column(batch, "text"))
        bad = column(batch, "bad").to_numpy(zero_copy_only=False)
        out: dict[tuple[str, str], list[int]] = {}
        size = w.end - w.start
        key = np.unique(np.stack([w.doc.astype(np.uint64), w.hash]), axis=1, return_index=True)[1] if len(w.doc) else []
        raw = w.buffer.tobytes()
        at, stems = -1, set()  # the stems of one document at a time
        for i in key:
            if size[i] > 40 or size[i] < 3:
                continue
            word, d = raw[w.start[i] : w.end[i]].decode("utf-8", "replace"), int(w.doc[i])
            if d != at:
                at, stems = d, set()
            out.setdefault(("word", word), [0, 0])[1 if bad[d] else 0] += 1
            for k in (4, 5, 6):
                stem = word[:k]
                if len(word) > k and stem not in stems and len(stem.encode()) <= 8:
                    stems.add(stem)
                    out.setdefault(("stem", stem), [0, 0])[1 if bad[d] else 0] += 1
        rows_ = [(k, t, n[0], n[1]) for (k, t), n in out.items()]
        if not rows_:
            return None
        k, t, clean, toxic = zip(*rows_)
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(t), pa.array(clean, pa.int64()), pa.array(toxic, pa.int64())], names=["kind", "term", "clean", "toxic"])

    counted = map_chunks(sample, "text", count, "kind string, term string, clean long, toxic long").groupBy("kind", "term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    found = counted.where((F.col("toxic") >= min_docs) & (F.col("toxic") >= precision * (F.col("toxic") + F.col("clean")))).select("kind", "term", "toxic", "clean").collect()
    words = {r.term: r.toxic for r in found if r.kind == "word"}
    forms: dict[str, int] = {}
    for r in found:
        if r.kind == "stem":
            forms[r.term] = sum(w.startswith(r.term) and w != r.term for w in words)
    stems = {s for s, n in forms.items() if n >= min_forms}
    stems = {s for s in stems if not any(s != t and s.startswith(t) for t in stems)}  # the shortest that qualify
    return Lexicon(tuple(sorted(set(INSULTS) | set(words))), tuple(sorted(stems)))


class _Scorer:
    """The composed machine and the class tables as arrays."""

    def __init__(self, lexicon: Lexicon, machine: Transducer) -> None:
        classes: dict[int, int] = {}
        for c, words in ((LINK, LINKS), (REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS), (INSULT, lexicon.words)):
            classes |= {hash_word(w): c for w in words}
        self.keys = np.array(sorted(classes), dtype=np.uint64)
        self.values = np.array([classes[int(k)] for k in self.keys], dtype=np.int8)
        self.bits = np.zeros(1 << 16, dtype=bool)
        self.bits[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.stems: dict[int, np.ndarray] = {}
        for stem in lexicon.stems:
            raw = stem.encode()
            self.stems.setdefault(len(raw), []).append(int.from_bytes(raw, "little"))
        self.stems = {k: np.array(sorted(v), dtype=np.uint64) for k, v in self.stems.items()}
        self.to = np.array(machine.to, dtype=np.int32)
        self.gain = np.array(machine.gain)

    def classes(self, w) -> np.ndarray:
        out = np.zeros(len(w.hash), dtype=np.int8)
        maybe = np.flatnonzero(self.bits[(w.hash & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, w.hash[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == w.hash[maybe]
        out[maybe[hit]] = self.values[at[hit]]
        if self.stems:
            padded = np.concatenate([w.buffer, np.zeros(8, np.uint8)])
            view = np.ndarray(shape=(len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
            head = view[w.start]
            size = w.end - w.start
            for k, stems in self.stems.items():
                part = head & np.uint64((1 << (8 * k)) - 1 if k < 8 else (1 << 64) - 1)
                hit = np.isin(part, stems) & (size > k)
                out[hit & (out == OTHER)] = INSULT
        return out

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str | None]]:
        """Per document: score, matched clauses, weight of the heaviest, and its text."""
        w = split_words(texts)
        score, count, top = np.zeros(w.n), np.zeros(w.n, dtype=np.int64), np.zeros(w.n)
        clause_text: list[str | None] = [None] * w.n
        if not len(w.hash):
            return score, count, top, clause_text
        cls = self.classes(w)
        heavy = (cls == INSULT) | (cls == THREAT)
        if not heavy.any():
            return score, count, top, clause_text
        ends = np.isin(w.buffer, np.frombuffer(b".,;:!?\n()\"", dtype=np.uint8))
        marks = np.concatenate([[0], np.cumsum(ends)])
        new = np.ones(len(w.hash), dtype=bool)  # begins a clause
        new[1:] = (marks[w.start[1:]] > marks[w.end[:-1]]) | (w.doc[1:] != w.doc[:-1])
        clause = np.cumsum(new) - 1
        begin = np.flatnonzero(new)
        stop = np.append(begin[1:], len(w.hash))
        keep = np.unique(clause[heavy])
        at, last = begin[keep].copy(), stop[keep]
        state, total = np.zeros(len(keep), dtype=np.int32), np.zeros(len(keep))
        live = np.arange(len(keep))
        while len(live):  # all clauses in step
            c = cls[at[live]]
            total[live] += self.gain[state[live], c]
            state[live] = self.to[state[live], c]
            at[live] += 1
            live = live[at[live] < last[live]]
        docs = w.doc[begin[keep]]
        np.add.at(score, docs, total)
        np.add.at(count, docs, 1)
        for i in np.lexsort((np.arange(len(keep)), -total)):
            d = docs[i]
            if clause_text[d] is None:
                clause_text[d], top[d] = w.text(begin[keep[i]], stop[keep[i]]), total[i]
        return score, count, top, clause_text


def toxic_clauses(docs: DataFrame, lexicon: Lexicon, *, reject: float = REJECT) -> DataFrame:
    """(doc_id, score, clauses, top_weight, top_clause) of each row of docs that the grammar rejects.

    A null or empty text scores 0 and is not rejected; a null doc_id stays null in its row; repeated rows give repeated rows; of equally
    heavy clauses the first is top_clause. Other columns of docs are not read. An empty table gives no rows.
    """
    scorer = _Scorer(lexicon, grammar())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score, count, top, clause = scorer.score(column(batch, "text"))
        bad = np.flatnonzero(score >= reject)
        arrays = [column(batch, "doc_id").cast(pa.int64()).take(pa.array(bad)), pa.array(np.round(score[bad], 6)), pa.array(count[bad]), pa.array(np.round(top[bad], 6)), pa.array([clause[i] for i in bad], pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "score", "clauses", "top_weight", "top_clause"])

    return map_chunks(docs.select("doc_id", "text"), "text", run, "doc_id long, score double, clauses long, top_weight double, top_clause string")


def drop_toxic(docs: DataFrame, lexicon: Lexicon, *, reject: float = REJECT) -> DataFrame:
    """The rows of docs that the grammar does not reject, with all their columns whatever they are called.

    One pass without a shuffle. A row with a null or empty text stays, one with a null doc_id is judged by its text, repeated rows go or
    stay alike. An empty table gives an empty table.
    """
    scorer = _Scorer(lexicon, grammar())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(scorer.score(column(batch, "text"))[0] < reject))

    return map_chunks(docs, "text", run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxic_clauses(docs, learn_lexicon(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLE_SQL: dict[str, str] = {}
