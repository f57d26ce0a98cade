"""Toxicity by a weighted finite-state pattern grammar over clauses."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm.common import id_remainder, labelled_rows, map_texts, table

#: Labelled rows to learn from, at most about so many; chosen by a hash of the id.
SAMPLE = 12_000
#: Seeds of the insult, threat, target, negation and reported-speech transducers.
INSULT = ["idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "worthless", "pathetic", "disgusting"]
THREAT = ["kill", "hurt", "destroy", "beat", "shoot", "stab"]
TARGET = ["you", "your", "he", "she", "they", "him", "her", "them", "these", "those", "du", "ihr", "sie", "tu", "vous", "vosotros", "ustedes"]
NEGATION = ["not", "never", "no", "isn't", "aren't", "nicht", "kein", "nie", "pas", "jamais", "nunca"]
REPORTED = ["said", "says", "quoted", "reported", "sagte", "dit", "dijo"]
CLAUSE_END = ".;!?\n"
CLAUSE = re.compile(r"[.;!?\n]")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
#: What the composed transducer can say of a word.
PATTERNS = ("insult", "aimed insult", "threat", "aimed threat", "negated", "reported")
FEATURES = (*PATTERNS, "share")
ANY = None


class Transducer:
    """arcs[state][symbol] is a list of (output, weight, next state); ANY stands for all symbols without arcs of their own and, as an output, for a word of no interest. A path counts if it ends in one of `finals`."""

    def __init__(self, start, finals: Iterable, arcs: dict):
        self.start, self.finals, self.arcs = start, set(finals), arcs

    def step(self, state, symbol) -> list[tuple]:
        own = self.arcs[state]
        return own[symbol] if symbol in own else own.get(ANY, [])

    def paths(self, symbols: Iterable) -> list[list[tuple]]:
        """The (output, weight) of every accepted path, by brute force."""
        at = [(self.start, [])]
        for x in symbols:
            at = [(nxt, [*said, (out, w)]) for state, said in at for out, w, nxt in self.step(state, x)]
        return [said for state, said in at if state in self.finals]


def compose(first: Transducer, second: Transducer) -> Transducer:
    """What `second` makes of the outputs of `first`: states are pairs, weights add up, and only reachable states are built."""
    start, arcs, todo = (first.start, second.start), {}, [(first.start, second.start)]
    while todo:
        a, b = state = todo.pop()
        if state in arcs:
            continue
        own = arcs[state] = {}
        for symbol, ways in first.arcs[a].items():
            own[symbol] = [(said, w + v, (c, d)) for out, w, c in ways for said, v, d in second.step(b, out)]
            todo += [nxt for _, _, nxt in own[symbol]]
    return Transducer(start, [s for s in arcs if s[0] in first.finals and s[1] in second.finals], arcs)


def lexicon(words: dict[str, tuple[str, float]]) -> Transducer:
    """Words to classes, with the words' weights on the arcs."""
    return Transducer(0, [0], {0: {w: [(kind, weight, 0)] for w, (kind, weight) in words.items()} | {ANY: [(ANY, 0.0, 0)]}})


def negation(reach: int = 3) -> Transducer:
    """An insult or threat among the next `reach` words is negated; the state counts the words left."""
    arcs = {}
    for k in range(reach + 1):
        on = max(0, k - 1)
        arcs[k] = {"negation": [(ANY, 0.0, reach)], ANY: [(ANY, 0.0, on)]} | {x: [(x, 0.0, on)] for x in ("target", "reported speech")}
        arcs[k] |= {x: [("negated" if k else x, 0.0, on)] for x in ("insult", "threat")}
    return Transducer(0, range(reach + 1), arcs)


def reported_speech() -> Transducer:
    """From a word of reporting on, insults and threats of the clause are reported."""
    same = lambda kinds, state: {x: [(x, 0.0, state)] for x in kinds}
    arcs = {s: {"reported speech": [(ANY, 0.0, 1)]} | same(("target", "negated", ANY), s) for s in (0, 1)}
    arcs[0] |= same(("insult", "threat"), 0)
    arcs[1] |= {x: [("reported", 0.0, 1)] for x in ("insult", "threat")}
    return Transducer(0, (0, 1), arcs)


def target() -> Transducer:
    """Insults and threats are aimed if the clause names a target anywhere: one path says so from the start and must meet a target, the other must not."""
    same = lambda kinds, state: {x: [(x, 0.0, state)] for x in kinds}
    rest, aims = ("negated", "reported", ANY), ("insult", "threat")
    arcs = {
        "start": {x: [(x, 0.0, "none"), (x, 0.0, "hoped")] for x in rest} | {"target": [(ANY, 0.0, "met")]} | {x: [(x, 0.0, "none"), (f"aimed {x}", 0.0, "hoped")] for x in aims},
        "none": same((*rest, *aims), "none") | {"target": []},
    }
    for s in ("hoped", "met"):
        arcs[s] = same(rest, s) | {"target": [(ANY, 0.0, "met")]} | {x: [(f"aimed {x}", 0.0, s)] for x in aims}
    return Transducer("start", ("start", "none", "met"), arcs)


class Grammar:
    """The transducers composed into one, and the weights of its patterns."""

    def __init__(self, learned: dict[str, float] | None = None):
        words = {w: (kind, 1.0) for kind, own in (("insult", INSULT), ("threat", THREAT), ("target", TARGET), ("negation", NEGATION), ("reported speech", REPORTED)) for w in own}
        words |= {w: ("threat" if w in THREAT else "insult", x) for w, x in (learned or {}).items() if w not in words or w in INSULT or w in THREAT}
        self.words = words
        self.bias, self.weights = -2.0, np.array([2.0, 2.5, 1.0, 2.0, -0.5, -0.5, 0.5])

    @cached_property
    def machine(self) -> Transducer:
        return compose(compose(compose(lexicon(self.words), negation()), reported_speech()), target())

    @cached_property
    def marks(self):
        """Finds the insults and threats, any number of them, in one pass."""
        from ahocorasick import Automaton

        found = Automaton()
        for w, (kind, _) in self.words.items():
            if kind in ("insult", "threat"):
                found.add_word(w, len(w))
        found.make_automaton()
        return found

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("machine", "marks")}

    def clause(self, words: list[str]) -> np.ndarray:
        """The weight of each pattern on the clause's accepted path; the transducers accept one path of every clause.

        A state keeps its path's sums only, so work and memory follow the number of words.
        """
        machine, at = self.machine, {self.machine.start: (0.0,) * len(PATTERNS)}
        arcs = machine.arcs
        for x in words:
            new = {}
            for state, sums in at.items():
                own = arcs[state]
                for out, w, nxt in own[x] if x in own else own[ANY]:
                    if out is not ANY:
                        k = PATTERNS.index(out)
                        new[nxt] = (*sums[:k], sums[k] + w, *sums[k + 1 :])
                    else:
                        new[nxt] = sums
            at = new
        return np.array(next(s for state, s in at.items() if state in machine.finals))

    def features(self, text: str) -> np.ndarray:
        """Damped sums over the clauses that hold an insult or threat, and their weight for each clause of the text; marks and clause ends are looked for from left to right, so no part is read twice."""
        low, total, end, found = text.lower(), np.zeros(len(PATTERNS)), -1, False
        for last, n in self.marks.iter(low):
            begin = last + 1 - n
            if begin <= end or (begin and low[begin - 1].isalpha()) or low[last + 1 : last + 2].isalpha():
                continue
            first = max(low.rfind(c, max(end, 0), begin) for c in CLAUSE_END) + 1
            first = max(first, end + 1)
            after = CLAUSE.search(low, last)
            end = after.start() if after else len(low)
            found = True
            total += self.clause(WORD.findall(low[first:end]))
        return np.append(np.log1p(total), total.sum() / (1 + len(text) / 60)) if found else np.zeros(len(FEATURES))

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights @ self.features(text), -30, 30))))

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 400) -> None:
        """Logistic weights of the patterns; insults and threats never count against toxicity."""
        w, b, scale = np.array(self.weights), self.bias, 1e-9 + x.std(axis=0)
        z = x / scale
        w = w * scale
        for _ in range(rounds):
            g = 1 / (1 + np.exp(-np.clip(z @ w + b, -30, 30))) - y
            w -= 2.0 * (z.T @ g / len(y) + 1e-3 * w)
            b -= 2.0 * g.mean()
            w[:4] = np.maximum(0.0, w[:4])
        used = x.std(axis=0) > 0
        self.weights, self.bias = np.where(used, w / scale, self.weights), float(b)


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, least_docs: int = 5, least_odds: float = 3.0, least_share: float = 0.03) -> Grammar:
    """Learns insults, their arcs' weights and the patterns' weights from labels (doc_id, toxic) of a bounded sample of docs.

    A word of any length becomes an insult if its log odds are `least_odds` or more and it is in `least_docs` toxic
    documents and in `least_share` of all toxic ones, so that names and copied passages stay out; its arc weighs its odds
    over `least_odds`. Words of the sample are counted on Spark, and the shares alone bound how many reach the driver.
    """
    grammar = Grammar()
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    chosen, rows = labelled_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), ids, bound)
    rows = rows.select("text", "toxic")
    n = {r["toxic"]: r["count"] for r in chosen.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return grammar

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = sorted(set(WORD.findall(text.lower())))
                for at in range(0, len(words), 10_000):
                    part = words[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([toxic] * len(part), pa.int32())], ["word", "toxic"])

    per = map_texts(rows, split, "word string, toxic int").groupBy("word").agg(F.sum("toxic").alias("bad"), F.count("*").alias("all"))
    odds = F.log((F.col("bad") + 0.5) / n[1]) - F.log((F.col("all") - F.col("bad") + 0.5) / n[0])
    often = max(least_docs, int(n[1] * least_share))
    found = per.filter(F.col("bad") >= often).withColumn("odds", odds).filter(F.col("odds") >= least_odds).collect()
    grammar = Grammar({r["word"]: r["odds"] / least_odds for r in found})
    shipped = docs.sparkSession.sparkContext.broadcast(grammar)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [shipped.value.features(t).tolist() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])

    got = map_texts(rows, measure, "toxic int, x array<double>").toPandas()
    if len(got):
        grammar.fit(np.stack(got["x"]), got["toxic"].to_numpy(float))
    return grammar


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, score for each row, from the whole text alone, so equal texts tie. Null, empty and blank texts match nothing and get the bias; texts of any length count whole, other columns don't matter, and an empty table gives an empty result."""
    shipped = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shipped.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([g.score(t or "") for t in b.column("text").to_pylist()], pa.float64())], ["doc_id", "score"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, score double")


def op4_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    grammar = fit(docs, table(spark, sf_dir, "labels").filter(id_remainder("doc_id", 5) != 0))
    return score(docs, grammar).select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
