"""Secret scans with inferred grammars.

Base patterns find labelled credentials of three kinds.  From a bounded sample of each kind's values (the ``SAMPLE``
distinct ones of smallest hash over all documents) a prefix tree is built whose statistically compatible states
are merged into a probabilistic automaton; so are tokens that their shape labels as ordinary (dates, paths, names, words, numbers: ``PLAIN_SHAPE``).  Class frequencies of all occurrences of
tokens that overlap no credential tell what is usual; they have no memory, so that unlabelled secrets among those tokens do not teach them a format.  Then every
credential-like token of every document is scored, with its dots and also without those at its ends: one that is in no base span (it may contain one), is as likely in a kind's format as its own
values are, and is likelier there than in the ordinary automaton by ``MARGIN`` nats a character and than by class frequencies by ``USUAL_MARGIN``, is a span of kind ``inferred``.

Characters are read by class (digits, a-f, other lower case, ...; each other character is a class of its own), evenly likely within it.

Cases:  a null text is empty and has no span; without any credential nothing is inferred and only base spans remain; rows that
repeat get equal results; of spans that start together, base ones stand first, in the order of ``KINDS``; an empty table gives no row; a text
takes time in proportion to its length; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, saved

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex")
LEAST = {"assign": 12, "access": 18, "hex": 16}
TOKEN = min(LEAST.values())
SAMPLE, ALPHA, MARGIN, USUAL_MARGIN = 2000, 0.05, 0.5, 0.1
LONGEST = 256
"""Automata are learned from values of at most so many characters, so that a value costs at most as many states; longer ones are base spans and are scored like others."""
OTHER, PLAIN = "token", "plain"
PLAIN_SHAPE = re.compile(
    r"[0-9]{4}-[0-9]{2}(?:-[0-9]{2})?(?:[T_].*)?|[a-z0-9_.-]*(?:/[a-z_-]+)+(?:\.[a-z0-9]+)?|[a-z]+(?:[_.-][a-z]+)+|(?:[A-Z][a-z]+){2,}|[A-Z]?[a-z]+|[0-9.]+"
)


@cache
def _sets() -> tuple[np.ndarray, np.ndarray]:
    hexa, token = np.zeros(256, bool), np.zeros(256, bool)
    hexa[list(b"0123456789abcdef")] = True
    token[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")] = True
    return hexa, token


def _runs(member: np.ndarray, least: int) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], member.view(np.int8), [0]])))
    start, stop = edge[::2], edge[1::2]
    long = stop - start >= least
    return list(zip(start[long].tolist(), stop[long].tolist(), strict=True))


def scan(text: str) -> tuple[list[tuple[int, int, int, str]], list[tuple[int, int, str]]]:
    """Base spans (start, kind's place, end, secret) and tokens (start, end, text) that overlap none; in code points."""
    base, tokens, _ = candidates(text)
    return base, tokens


def candidates(text: str) -> tuple[list[tuple[int, int, int, str]], list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, tokens that overlap none, and tokens that contain base spans and more."""
    base = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        base += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    data = text.encode("utf-8", "replace")
    raw = np.frombuffer(data, np.uint8)
    plain = len(data) == len(text)
    before = None if plain else np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    at = (lambda i: i) if plain else (lambda i: int(before[i]))
    hexa, token = _sets()
    base += [(at(a), 2, at(b), data[a:b].decode()) for a, b in _runs(hexa[raw], LEAST["hex"])]
    tokens = [(at(a), at(b), data[a:b].decode()) for a, b in _runs(token[raw], TOKEN)]
    met = _met(base, tokens)
    free = [x for i, x in enumerate(tokens) if i not in met]
    return sorted(base), free, [tokens[i] for i in sorted(met) if met[i]]


def _met(base: list[tuple[int, int, int, str]], tokens: list[tuple[int, int, str]]) -> dict[int, bool]:
    """Places of the tokens that overlap base spans, and whether each contains all of these and more; spans of a kind are apart, as
    tokens are, so this takes time in proportion to both."""
    starts, stops = [x[0] for x in tokens], [x[1] for x in tokens]
    inside: dict[int, bool] = {}
    for s, _, e, _ in base:
        for i in range(bisect_right(stops, s), bisect_left(starts, e)):
            inside[i] = inside.get(i, True) and starts[i] <= s and e <= stops[i] and (s, e) != (starts[i], stops[i])
    return inside


# Grammar inference

CLASSES = [("0123456789", "9"), ("abcdef", "a"), ("ghijklmnopqrstuvwxyz", "z"), ("ABCDEF", "A"), ("GHIJKLMNOPQRSTUVWXYZ", "Z")]
CLASS_OF = {c: name for chars, name in CLASSES for c in chars}
WIDTH = {name: math.log(len(chars)) for chars, name in CLASSES}


def learn(values: list[str], alpha: float = ALPHA) -> dict:
    """A probabilistic automaton: state 0 starts; each state has ``n`` visits, ``end`` ends and ``next`` {class: [state, count]}.

    States are visited in breadth-first order; each is merged into the first kept state whose end and branch frequencies,
    and those of all states below, differ by less than the Hoeffding bound at ``alpha``; else it is kept.
    """
    n, end, step = [0], [0], [{}]
    for value in sorted(values):
        at = 0
        n[0] += 1
        for c in value:
            c = CLASS_OF.get(c, c)
            if c not in step[at]:
                step[at][c] = [len(n), 0]
                n.append(0)
                end.append(0)
                step.append({})
            step[at][c][1] += 1
            at = step[at][c][0]
            n[at] += 1
        end[at] += 1
    root = math.sqrt(math.log(2 / alpha) / 2)

    def apart(x: int, y: int) -> bool:
        bound = root * (1 / math.sqrt(n[x]) + 1 / math.sqrt(n[y]))
        if abs(end[x] / n[x] - end[y] / n[y]) > bound:
            return True
        return any(abs(step[x].get(c, (0, 0))[1] / n[x] - step[y].get(c, (0, 0))[1] / n[y]) > bound for c in {*step[x], *step[y]})

    def compatible(x: int, y: int) -> bool:
        todo = [(x, y)]
        while todo:
            x, y = todo.pop()
            if n[x] == 0 or n[y] == 0:
                continue
            if apart(x, y):
                return False
            todo += [(step[x][c][0], step[y][c][0]) for c in step[x].keys() & step[y].keys()]
        return True

    def fold(into: int, tree: int) -> None:
        todo = [(into, tree)]
        while todo:
            x, y = todo.pop()
            n[x] += n[y]
            end[x] += end[y]
            for c, (below, count) in step[y].items():
                if c in step[x]:
                    step[x][c][1] += count
                    todo.append((step[x][c][0], below))
                else:
                    step[x][c] = [below, count]

    kept = [0]
    blue = [(0, c) for c in sorted(step[0])]
    while blue:
        parent, c = min(blue, key=lambda b: (-n[step[b[0]][b[1]][0]], b))
        state = step[parent][c][0]
        same = next((k for k in kept if compatible(k, state)), None)
        if same is None:
            kept.append(state)
        else:
            step[parent][c][0] = same
            fold(same, state)
        inside = set(kept)
        blue = [(k, c) for k in kept for c in sorted(step[k]) if step[k][c][0] not in inside]
    number = {k: i for i, k in enumerate(kept)}
    return {"n": [n[k] for k in kept], "end": [end[k] for k in kept], "next": [{c: [number[t], m] for c, (t, m) in step[k].items()} for k in kept]}


def count_classes(count: dict[str, int], value: str) -> None:
    """Mean log likelihood needs only this of ordinary tokens: how often each class occurs."""
    for c in value:
        c = CLASS_OF.get(c, c)
        count[c] = count.get(c, 0) + 1


def usual(background: dict | None, value: str) -> float:
    """Mean log probability a character among ordinary tokens; evenly likely if there are none."""
    if not background:
        return -math.log(69)
    of = [CLASS_OF.get(c, c) for c in value]
    return sum(math.log((background["count"].get(c, 0) + 0.5) / (background["n"] + 5)) - WIDTH.get(c, 0.0) for c in of) / len(of)


def log_likelihood(automaton: dict, value: str) -> float:
    """Mean log probability a character, the end included; what a state has never seen gets a small share."""
    total, at = 0.0, 0
    for c in value:
        c = CLASS_OF.get(c, c)
        seen = automaton["next"][at].get(c)
        total += math.log(((seen[1] if seen else 0) + 0.01) / (automaton["n"][at] + 0.7)) - WIDTH.get(c, 0.0)
        if seen:
            at = seen[0]
    total += math.log((automaton["end"][at] + 0.01) / (automaton["n"][at] + 0.7))
    return total / (len(value) + 1)


def sample(docs: DataFrame, size: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """(kind, value): per kind, and of ordinary tokens, the ``size`` distinct values of smallest hash over all documents; and (class, n): how often each class occurs in
    all ordinary tokens.

    A task keeps no more than that of its own rows, so what is shuffled is bounded per task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[str, dict[str, int]] = {}
        ordinary: dict[str, int] = {}
        for batch in batches:
            for text in batch.column(0):
                base, tokens = scan(text.as_py() or "")
                for _, k, _, value in base:
                    if len(value) > LONGEST:
                        continue
                    least.setdefault(KINDS[k], {})[value] = _hash(value)
                for _, _, value in tokens:
                    count_classes(ordinary, value)
                    if len(value) <= LONGEST and PLAIN_SHAPE.fullmatch(value):
                        least.setdefault(PLAIN, {})[value] = _hash(value)
            for kind, found in least.items():
                if len(found) > size:
                    least[kind] = dict(sorted(found.items(), key=lambda x: (x[1], x[0]))[:size])
        rows = [(kind, value, h, 0) for kind, found in least.items() for value, h in found.items()]
        rows += [(OTHER, c, 0, n) for c, n in ordinary.items()]
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        types = (pa.string(), pa.string(), pa.int64(), pa.int64())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["kind", "value", "h", "n"])

    rows = docs.select("text").mapInArrow(run, "kind string, value string, h long, n long")
    found = saved(rows.groupBy("kind", "value", "h").agg(F.sum("n").alias("n")), "secret-values")
    parts = [found.where(F.col("kind") == k).orderBy("h", "value").limit(size) for k in (*KINDS, PLAIN)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("kind", "value"), found.where(F.col("kind") == OTHER).select(F.col("value").alias("class"), "n")


def _hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=7).digest(), "big")


def infer(docs: DataFrame) -> dict[str, dict]:
    """Automata by kind, each with ``floor``: the score that all but a twentieth of its own values reach."""

    def run(key: tuple, values: pd.DataFrame) -> pd.DataFrame:
        automaton = learn(values["value"].tolist())
        scores = sorted(log_likelihood(automaton, v) for v in values["value"])
        automaton["floor"] = scores[len(scores) // 20]
        return pd.DataFrame({"kind": [key[0]], "automaton": [json.dumps(automaton)]})

    values, classes = sample(docs)
    learned = values.groupBy("kind").applyInPandas(run, "kind string, automaton string")
    automata = {r["kind"]: json.loads(r["automaton"]) for r in learned.collect()}  # four at most, each from SAMPLE values
    count = {r["class"]: r["n"] for r in classes.collect()}  # a row for each class
    return automata | ({OTHER: {"count": count, "n": sum(count.values())}} if count else {})


def inferred(tokens: list[tuple[int, int, str]], automata: dict[str, dict]) -> list[tuple[int, int]]:
    out = []
    for start, stop, value in tokens:
        inner = value.strip(".")
        left = start + len(value) - len(value.lstrip("."))
        for at, one in ((left, inner), (start, value)) if inner != value else ((start, value),):  # a dot may end the sentence
            if len(one) < TOKEN:
                continue
            ordinary = usual(automata.get(OTHER), one) + USUAL_MARGIN
            if PLAIN in automata:
                ordinary = max(ordinary, log_likelihood(automata[PLAIN], one) + MARGIN)
            scores = ((automata[k]["floor"], log_likelihood(automata[k], one)) for k in KINDS if k in automata)
            if any(score >= max(floor, ordinary) for floor, score in scores):
                out.append((at, at + len(one)))
                break
    return out


def find(docs: DataFrame, automata: dict[str, dict]) -> DataFrame:
    """Per row of (doc_id, text): counts of base spans, their digest, and all spans as kind:start:end."""

    def row(text: str) -> tuple:
        base, free, around = candidates(text)
        taken = {(s, e) for s, _, e, _ in base}
        tokens = free + around
        told = [(s, k, f"{KINDS[k]}:{s}:{e}") for s, k, e, _ in base]
        every = sorted(told + [(s, len(KINDS), f"inferred:{s}:{e}") for s, e in inferred(tokens, automata) if (s, e) not in taken])
        return (
            *(sum(1 for x in base if x[1] == k) for k in range(3)),
            hashlib.sha256(",".join(x[2] for x in told).encode()).hexdigest(), ",".join(x[2] for x in every), len(every) - len(told),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_inferred"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            columns = list(zip(*(row(t.as_py() or "") for t in batch.column(1)), strict=True)) or [[] for _ in types]
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_inferred long"
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return find(docs, infer(docs))
