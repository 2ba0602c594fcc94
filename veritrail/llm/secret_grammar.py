"""Secrets by inferred formats.

Three patterns find the base secrets. Their values are labelled credentials: for each kind a bounded sample of distinct
values (``SAMPLE`` with the smallest hashes, whatever document they stand in) becomes a prefix tree over character
classes, and states whose outgoing and ending frequencies agree within the Hoeffding bound are merged (red and blue
states, one fold at a time) into a probabilistic automaton. A sample of other long tokens gives the automaton of ordinary
text. Then every token of every text is scored, with base secrets in it or not: if some credential automaton accepts it
and explains it better than ordinary text does, by ``margin`` nats a character, its span is added as kind ``format``.
Base spans always stay.

Null and empty texts have no spans. Without labelled credentials nothing is added. Repeated rows are scanned each for
itself. Places are code points, the end is exclusive. Other columns pass through; ones named like an output are replaced.
"""

from __future__ import annotations

import heapq
import json
import math
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritrail.llm.common import prepare
from veritrail.operators.keys import top_per_key

KINDS = ("assign", "access", "hex")
ADDED = "format"
ORDINARY = "ordinary"
# Fixed patterns of the base secrets; letters of the key words stand in either case.
ASSIGN = re.compile(
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"""
    r"""[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run of 16 and more: shorter runs fail
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
LEAST = {"assign": 12, "access": 18}
SAMPLE = 400  # distinct values of each kind that an automaton is inferred from
UNSURE = 4  # visits added to every state when scoring: a path that one sample value made is weak evidence
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                     T.StructField("end", T.IntegerType())])
ARROW_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, number of the kind, end, value) of the base secrets, in order."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end(), m.group(1)) for m in ASSIGN.finditer(text) if len(m.group(1)) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.group()) for m in ACCESS.finditer(text) if len(m.group()) >= LEAST["access"]]
    found += [(m.start(), 2, m.end(), m.group()) for m in HEX.finditer(text)]
    return sorted(found)


def free_tokens(text: str, base: list[tuple[int, int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """(start, end, token) of the tokens that touch no base secret."""
    covered: list[list[int]] = []
    for start, _, end, _ in base:
        if covered and start <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], end)
        else:
            covered.append([start, end])
    at = 0
    for m in TOKEN.finditer(text):
        while at < len(covered) and covered[at][1] <= m.start():
            at += 1
        if at == len(covered) or covered[at][0] >= m.end():
            yield m.start(), m.end(), m.group()


_CLASSES = {c: k for k, chars in (("9", "0123456789"), ("f", "abcdef"), ("z", "ghijklmnopqrstuvwxyz"),
                                  ("F", "ABCDEF"), ("Z", "GHIJKLMNOPQRSTUVWXYZ")) for c in chars}


def symbols(value: str) -> str:
    """The value in character classes; signs stand for themselves."""
    return "".join(_CLASSES.get(c, c) for c in value)


class Automaton:
    """A probabilistic automaton: per state its visits, endings, and counted transitions."""

    def __init__(self, visits=None, endings=None, moves=None, start=0):
        self.visits, self.endings, self.moves, self.start = visits or {}, endings or {}, moves or {}, start

    @classmethod
    def prefix_tree(cls, values: list[str]) -> Automaton:
        tree = cls({0: 0}, {0: 0}, {0: {}})
        for value in values:
            state = 0
            tree.visits[0] += 1
            for symbol in symbols(value):
                if symbol not in tree.moves[state]:
                    new = len(tree.visits)
                    tree.visits[new], tree.endings[new], tree.moves[new] = 0, 0, {}
                    tree.moves[state][symbol] = [new, 0]
                move = tree.moves[state][symbol]
                move[1] += 1
                state = move[0]
                tree.visits[state] += 1
            tree.endings[state] += 1
        return tree

    def _differ(self, a: int, b: int, bound: float) -> bool:
        """Whether the frequencies of two states are too far apart for one state, here or further on."""
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            n, m = self.visits[a], self.visits[b]
            if not n or not m:
                continue
            limit = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.endings[a] / n - self.endings[b] / m) > limit:
                return True
            for symbol in self.moves[a].keys() | self.moves[b].keys():
                x, y = self.moves[a].get(symbol), self.moves[b].get(symbol)
                if abs((x[1] if x else 0) / n - (y[1] if y else 0) / m) > limit:
                    return True
                if x and y:
                    pairs.append((x[0], y[0]))
        return False

    def _fold(self, red: int, blue: int) -> None:
        """Add the tree below ``blue`` onto ``red``."""
        pairs = [(red, blue)]
        while pairs:
            into, gone = pairs.pop()
            self.visits[into] += self.visits.pop(gone)
            self.endings[into] += self.endings.pop(gone)
            for symbol, (target, count) in self.moves.pop(gone).items():
                if symbol in self.moves[into]:
                    self.moves[into][symbol][1] += count
                    pairs.append((self.moves[into][symbol][0], target))
                else:
                    self.moves[into][symbol] = [target, count]

    def merged(self, alpha: float = 0.05) -> Automaton:
        """Merge compatible states until only states that differ are left."""
        bound = math.sqrt(0.5 * math.log(2 / alpha))
        red = [self.start]
        while True:
            inside = set(red)
            blue = [(-move[1], state, symbol) for state in red for symbol, move in self.moves[state].items()
                    if move[0] not in inside]
            if not blue:
                return self
            _, state, symbol = min(blue)
            move = self.moves[state][symbol]
            other = next((r for r in red if not self._differ(r, move[0], bound)), None)
            if other is None:
                red.append(move[0])
            else:
                gone, move[0] = move[0], other
                self._fold(other, gone)

    def log_likelihood(self, value: str, unseen: float | None = None) -> float:
        """The log probability of the value; an unseen step has probability ``unseen``, or makes it minus infinity."""
        state, total = self.start, 0.0
        for symbol in symbols(value):
            move = self.moves[state].get(symbol)
            if move is None:
                if unseen is None:
                    return -math.inf
                total += math.log(unseen)
                continue
            total += math.log(move[1] / (self.visits[state] + UNSURE))
            state = move[0]
        ending = self.endings[state]
        if ending:
            return total + math.log(ending / (self.visits[state] + UNSURE))
        return total + math.log(unseen) if unseen is not None else -math.inf

    def to_json(self) -> str:
        return json.dumps([self.visits, self.endings, self.moves, self.start])

    @classmethod
    def from_json(cls, text: str) -> Automaton:
        visits, endings, moves, start = json.loads(text)
        whole = lambda d: {int(k): v for k, v in d.items()}
        return cls(whole(visits), whole(endings), whole(moves), start)


def labelled_values(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(kind, value): for every kind, and for ordinary tokens, the ``sample`` distinct values with the smallest hashes.

    Every task reads all of its texts and passes on at most ``sample`` values of a kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[str, list[tuple[int, str]]] = {}
        held: dict[str, set[str]] = {}

        def offer(kind: str, value: str) -> None:
            heap, inside = least.setdefault(kind, []), held.setdefault(kind, set())
            rank = -zlib.crc32(value.encode())
            if (len(heap) < sample or (rank, value) > heap[0]) and value not in inside:
                inside.add(value)
                heapq.heappush(heap, (rank, value))
                if len(heap) > sample:
                    inside.discard(heapq.heappop(heap)[1])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                base = base_spans(t) if t else []
                for _, number, _, value in base:
                    offer(KINDS[number], value)
                for _, _, token in free_tokens(t or "", base):
                    offer(ORDINARY, token)
        rows = [(kind, value, -rank) for kind, heap in least.items() for rank, value in heap]
        columns = list(zip(*rows)) if rows else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()),
                                          pa.array(columns[2], pa.int64())], names=["kind", "value", "rank"])

    values = docs.select(F.col(text).alias("text")).mapInArrow(run, "kind string, value string, rank long").distinct()
    return top_per_key(values, ["kind"], [F.col("rank"), F.col("value").desc()], sample, "_n").select("kind", "value")


def infer(values: DataFrame) -> dict[str, str]:
    """One automaton (as JSON) per kind of ``values``, each inferred in a task of its own."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        model = Automaton.prefix_tree(sorted(frame["value"])).merged()
        return pd.DataFrame({"kind": [frame["kind"].iloc[0]], "model": [model.to_json()]})

    return {r.kind: r.model for r in values.groupBy("kind").applyInPandas(run, "kind string, model string").collect()}


class Scorer:
    """Tells tokens that look like the credentials from ordinary ones."""

    MEMO = 100_000

    def __init__(self, models: dict[str, str], margin: float):
        self.ordinary = Automaton.from_json(models[ORDINARY]) if ORDINARY in models else None
        self.credentials = [Automaton.from_json(models[k]) for k in KINDS if k in models]
        self.margin, self.memo = margin, {}

    def score(self, token: str) -> float:
        """Nats a character by which the best credential automaton explains the token better than ordinary text."""
        best = max((a.log_likelihood(token) for a in self.credentials), default=-math.inf)
        if best == -math.inf:
            return best
        plain = self.ordinary.log_likelihood(token, 1e-3) if self.ordinary else len(token) * math.log(1 / 66)
        return (best - plain) / len(token)

    def accepts(self, token: str) -> bool:
        known = self.memo.get(token)
        if known is None:
            if len(self.memo) >= self.MEMO:
                self.memo.clear()
            known = self.memo[token] = self.score(token) >= self.margin
        return known


def find_secrets(docs: DataFrame, text: str = "text", sample: int = SAMPLE, margin: float = 1.0,
                 models: dict[str, str] | None = None) -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans``: arrays of (kind, start, end), by start and then kind."""
    prepare(docs.sparkSession)
    models = infer(labelled_values(docs, text, sample)) if models is None else models
    docs = docs.drop("base_spans", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(models, margin)
        for batch in batches:
            bases, alls = [], []
            for t in batch.column(text).to_pylist():
                base = base_spans(t) if t else []
                found = [(start, number, end) for start, number, end, _ in base]
                added = [(m.start(), len(KINDS), m.end()) for m in TOKEN.finditer(t or "") if scorer.accepts(m.group())]
                names = (*KINDS, ADDED)
                as_rows = lambda spans: [{"kind": names[k], "start": s, "end": e} for s, k, e in spans]
                bases.append(as_rows(found))
                alls.append(as_rows(sorted(found + added)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(bases, ARROW_SPAN), pa.array(alls, ARROW_SPAN)],
                names=[*batch.schema.names, "base_spans", "spans"])

    spans = T.ArrayType(SPAN)
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("base_spans", spans),
                                              T.StructField("spans", spans)]))


def redact(found: DataFrame, text: str = "text", mask: str = "<secret>") -> DataFrame:
    """The text with every stretch covered by ``spans`` replaced by ``mask``; overlapping spans are one stretch."""

    def covered(state, span):
        begin = F.greatest(span["start"], state["at"])
        return F.when(span["end"] <= state["at"], state).otherwise(F.struct(
            F.concat(state["out"], F.substring(F.col(text), state["at"] + 1, begin - state["at"]),
                     F.when((span["start"] < state["at"]) & (state["at"] > 0), F.lit("")).otherwise(F.lit(mask))).alias("out"),
            span["end"].alias("at")))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    whole = F.aggregate("spans", start, covered,
                        lambda s: F.concat(s["out"], F.substring(F.col(text), s["at"] + 1, F.length(text))))
    return found.withColumn(text, F.when(F.size("spans") > 0, whole).otherwise(F.col(text)))
