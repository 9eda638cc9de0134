"""Toxicity: a lexicon trie intersected with Levenshtein automata, and context windows that tell quotation from abuse.

The intersection is a deterministic automaton that is built as words ask for it: a state is the set of (trie node, edits
so far) that a prefix can be in, so one pass over a word finds every lexicon term within its allowed edits, and most
words die after a few letters.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, held_out, in_slices

#: General insults known before anything is learned.
SEED_TERMS = (
    "asshole", "bastard", "bitch", "clown", "creep", "disgrace", "disgusting", "dumb", "filth", "fool", "freak", "garbage", "idiot", "imbecile", "jerk",
    "loser", "moron", "pathetic", "pig", "retard", "scum", "stupid", "trash", "vermin", "worthless",
)
#: Words that introduce or name a quotation, and words that address a reader, in the languages at hand.
REPORTING = frozenset("said says wrote called quote quoted word term insult phrase sagte schrieb wort zitat dit écrit mot citation dijo escribió palabra cita".split())
ADDRESS = frozenset("you your youre u ur yourself du dich dein ihr tu toi vous ton votre tú te usted vosotros".split())
OPEN, CLOSE, PLAIN = "“«„‹", "”»‟›", '"'
WORD = re.compile(r"[^\W_]+")
WINDOW = 6
PREFIX = 4
STEM_LETTERS = (4, 5, 6)
MISSPELLED, QUOTED, REPORTED, ADDRESSED = 0.6, 0.3, 0.5, 1.5


def edits_allowed(term: str) -> int:
    n = len(term) - 3 * term.endswith("*")  # the letters of a stem say less than those of a word
    return 0 if n < 5 else 1 if n < 9 else 2


class TermAutomaton:
    """Finds (term, edits) for words within edits_allowed(term) insertions, deletions or substitutions of a term.

    A term that ends in * is a stem: any word that begins with it, or within its edits of it, is found.
    """

    def __init__(self, terms: tuple[str, ...]):
        self.children: list[dict[str, int]] = [{}]
        self.room: list[int] = [0]  # of each node, the most edits that a term below it allows
        self.term: list[str | None] = [None]
        self.stems: set[int] = set()
        for t in sorted(set(terms)):
            node = 0
            for c in t.rstrip("*"):
                self.room[node] = max(self.room[node], edits_allowed(t))
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.room.append(0)
                    self.term.append(None)
                node = self.children[node][c]
            self.room[node] = max(self.room[node], edits_allowed(t))
            self.term[node] = t
            if t.endswith("*"):
                self.stems.add(node)
        self.alphabet = frozenset("".join(terms))
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.dead = self._state({})
        self.start = self._state(self._closed({0: 0}))

    def _closed(self, at: dict[int, int]) -> dict[int, int]:
        """With the letters of terms that a word may lack."""
        todo = list(at)
        while todo:
            node = todo.pop()
            for child in self.children[node].values():
                cost = at[node] + 1
                if cost <= self.room[child] and cost < at.get(child, 99):
                    at[child] = cost
                    todo.append(child)
        return at

    def _state(self, at: dict[int, int]) -> int:
        key = frozenset(at.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
        return self.states[key]

    def step(self, state: int, c: str) -> int:
        c = c if c in self.alphabet else "\0"  # all letters outside of the lexicon behave alike
        if c not in self.moves[state]:
            to: dict[int, int] = {}
            for node, cost in self.sets[state]:
                if node in self.stems and cost <= edits_allowed(self.term[node]):
                    to[node] = min(to.get(node, 99), cost)
                if cost + 1 <= self.room[node]:  # a letter too many
                    to[node] = min(to.get(node, 99), cost + 1)
                for letter, child in self.children[node].items():
                    now = cost + (letter != c)
                    if now <= self.room[child]:
                        to[child] = min(to.get(child, 99), now)
            self.moves[state][c] = self._state(self._closed(to))
        return self.moves[state][c]

    def after(self, word: str, state: int | None = None) -> int:
        state = self.start if state is None else state
        for c in word:
            if state == self.dead:
                break
            state = self.step(state, c)
        return state

    def matches(self, state: int) -> list[tuple[str, int]]:
        found = [(self.term[node], cost) for node, cost in self.sets[state] if self.term[node] is not None]
        return sorted((t, cost) for t, cost in found if cost <= edits_allowed(t))

    def lookup(self, word: str) -> list[tuple[str, int]]:
        return self.matches(self.after(word))


class _Live(dict):
    """For each prefix the state after it, 0 (the dead state) for most."""

    def __init__(self, automaton: TermAutomaton):
        self.automaton = automaton

    def __missing__(self, prefix: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[prefix] = s = self.automaton.after(prefix)
        return s


class _Found(dict):
    """For each word the (term, edits) that explains it best, or None."""

    def __init__(self, automaton: TermAutomaton, model: ToxicityModel):
        self.automaton, self.weights, self.benign = automaton, model.weights, model.benign

    def __missing__(self, word: str) -> tuple[str, int] | None:
        if len(self) > 100_000:
            self.clear()
        found = self.automaton.lookup(word)
        best = min(found, key=lambda x: (x[1], -self.weights[x[0]], x[0])) if found else None
        self[word] = best = None if best and best[1] and word in self.benign else best
        return best


@dataclass
class ToxicityModel:
    """weights: of each term. benign: words within reach of a term that clean texts use. coef: of features(), intercept last."""

    weights: dict[str, float]
    benign: frozenset[str]
    coef: tuple[float, ...]
    _ready: tuple | None = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "_ready": None}

    def automaton(self) -> tuple[_Live, _Found]:
        if self._ready is None:
            a = TermAutomaton(tuple(self.weights))
            self._ready = _Live(a), _Found(a, self)
        return self._ready

    def hits(self, text: str) -> list[tuple[str, str, int, float]]:
        """(word, term, edits, weight in its context) of each match, in order."""
        live, find = self.automaton()
        low = text.lower()
        known = {w: f for w in set(WORD.findall(low)) if live[w[:PREFIX]] and (f := find[w])}
        if not known:
            return []
        words = list(WORD.finditer(low))
        out = []
        for k, m in enumerate(words):
            w = m.group()
            if w not in known:
                continue
            term, edits = known[w]
            near = [x.group() for x in words[max(0, k - WINDOW) : k + WINDOW + 1]]
            out.append((w, term, edits, self.weights[term] * MISSPELLED**edits * self.context(low, m.start(), m.end(), near)))
        return out

    @staticmethod
    def context(text: str, start: int, end: int, near: list[str]) -> float:
        """Under 1 for a term that stands in quotation marks or by a word of reporting, over 1 for one by a word of address."""
        left, right = text[max(0, start - 80) : start].rpartition("\n")[2], text[end : end + 80].partition("\n")[0]
        quoted = left.count(PLAIN) % 2 == 1 and PLAIN in right
        quoted |= any(left.rfind(a) > left.rfind(b) and b in right for a, b in zip(OPEN, CLOSE))
        factor = QUOTED if quoted else 1.0
        if not REPORTING.isdisjoint(near):
            factor *= REPORTED
        if not ADDRESS.isdisjoint(near):
            factor *= ADDRESSED
        return factor

    def features(self, text: str | None) -> np.ndarray:
        hits = self.hits(text or "")
        total = sum(h[3] for h in hits)
        return np.array([np.log1p(total), max((h[3] for h in hits), default=0.0), np.log1p(sum(h[3] for h in hits if h[2])), float(len({h[1] for h in hits}))])

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.stack([self.features(t) for t in texts]) if texts else np.zeros((0, 4))
        return _sigmoid(x @ np.array(self.coef[:-1]) + self.coef[-1])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """By Newton's method; ridge keeps the slopes bounded where the classes separate."""
    x1 = np.c_[x, np.ones(len(x))]
    w = np.zeros(x1.shape[1])
    for _ in range(40):
        p = _sigmoid(x1 @ w)
        penal = ridge * np.r_[np.ones(len(w) - 1), 1e-6]
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(penal), x1.T @ (y - p) - penal * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def _lexicon(top: list) -> list[tuple[str, float]]:
    """Of candidates (term, toxic texts, log odds), best first: a stem if it gathers more texts than any word of its own, else the word."""
    chosen: list[tuple[str, float]] = []
    bad = {w: b for w, b, _ in top}
    for w, b, o in top:
        if any(c.endswith("*") and w.startswith(c[:-1]) for c, _ in chosen):
            continue
        if w.endswith("*"):
            if b < 1.3 * max((x for v, x in bad.items() if not v.endswith("*") and v.startswith(w[:-1])), default=1):
                continue
            chosen = [(c, x) for c, x in chosen if not c.startswith(w[:-1])]
        chosen.append((w, o))
    return chosen


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = 3000, seed_terms: tuple[str, ...] = SEED_TERMS) -> ToxicityModel:
    """A model of a bounded sample of labelled rows: of each label the most_rows ids with the smallest hashes, none of them held out.

    An id with several labels counts as toxic if any says so, as does a text that several ids have; of an id that repeats
    one text counts. Null ids, labels or texts teach nothing. The lexicon is seed_terms and all words and stems that
    toxic texts of the sample use far more than clean ones (in at least 4 of them and 1 % of them); words that clean texts
    use although they are within reach of a term are learned as benign. Without both labels only seed_terms count.
    """
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("i")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    chosen = None
    for y in (0, 1):
        part = marked.where(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(most_rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null").join(F.broadcast(chosen), "i")
    texts = texts.groupBy("i", "y").agg(F.min("t").alias("t")).groupBy("t").agg(F.max("y").alias("y"))
    sample = cut(texts)  # at most 2 * most_rows rows
    pieces = F.transform(
        F.regexp_extract_all(F.lower("t"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)),
        lambda w: F.array(w, *(F.when(F.length(w) >= k, F.concat(F.substring(w, 1, k), F.lit("*"))) for k in STEM_LETTERS)),
    )
    words = sample.select("y", F.explode(F.array_distinct(F.flatten(pieces))).alias("w")).where("w is not null")
    counts = words.groupBy("w").agg(F.sum("y").cast("long").alias("bad"), F.sum(1 - F.col("y")).cast("long").alias("good"))
    n = {r[0]: r[1] for r in sample.groupBy("y").count().collect()}
    if not n.get(1) or not n.get(0):
        base = np.log((n.get(1, 0) + 0.5) / (n.get(0, 0) + 0.5))
        return ToxicityModel({t: 1.0 for t in seed_terms}, frozenset(), (2.0, 1.0, 0.0, 0.5, float(min(base, -2.0))))
    odds = F.log((F.col("bad") + 0.5) / (n[1] + 1.0)) - F.log((F.col("good") + 0.5) / (n[0] + 1.0))
    top = counts.where(F.col("bad") >= max(4, 0.01 * n[1])).select("w", "bad", odds.alias("o")).where("o >= 3").orderBy(F.desc(F.col("o") * F.col("bad")), "w").collect()
    weights = {t: 0.5 for t in seed_terms} | {w: float(np.clip(o / 4, 0.5, 1.5)) for w, o in _lexicon(top)}
    automaton = TermAutomaton(tuple(weights))

    def reach(batches):
        for b in batches:
            live = [bool(m := automaton.lookup(w)) and min(c for _, c in m) > 0 for w in b.column(0).to_pylist()]
            yield b.filter(pa.array(live, pa.bool_()))

    spread = counts.where(~F.col("w").endswith("*") & (F.col("good") / n[0] >= F.col("bad") / n[1])).select("w", "good").mapInArrow(reach, "w string, good long")
    benign = frozenset(r[0] for r in spread.collect())  # words of the sample
    model = ToxicityModel(weights, benign, (0.0,) * 5)

    def measure(batches):
        for b in batches:
            x = np.stack([model.features(t) for t in b.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, k]) for k in range(4)), b.column(1)], ["a", "b", "c", "d", "y"])

    got = sample.mapInArrow(measure, "a double, b double, c double, d double, y int").toArrow()  # at most 2 * most_rows rows
    x = np.stack([got.column(k).to_numpy() for k in "abcd"], 1)
    return ToxicityModel(weights, benign, _logistic(x, got.column("y").to_numpy().astype(float)))


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """docs with one more column, 0 to 1, of the whole text. A null text scores as an empty one, equal texts score equally.

    Other columns pass through, repeated rows and empty tables stay as they are; a column named score_col raises.
    """
    if score_col in docs.columns:
        raise ValueError(f"docs has a column {score_col} already")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by fit()
    at = docs.columns.index(text_col)

    def run(batches):
        for b in in_slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.score(b.column(at).to_pylist()))], [*b.schema.names, score_col])

    return docs.mapInArrow(run, docs.select("*", F.lit(0.0).alias(score_col)).schema)
