"""Toxicity scores from a lexicon, misspellings and their contexts.

Terms sit in tries.  A trie is intersected with the Levenshtein automata of
its terms' edit limits: the product's states are sets of (trie node, edits so
far), made deterministic as words need them, so a word is rejected after the
few letters that lead to no term.  The terms are a short fixed list and words
and stems whose document frequency marks labelled toxic texts.

Each hit is scored in its context window: quotation marks around it or a verb
of speech beside it make it a quotation, address of a person makes it abuse.
A logistic regression over the document's counts gives the score.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.runtime import stored_map, text_of
from lexweave.llm.sampling import class_sample, placed
from lexweave.llm.words import ALPHANUMERIC, WordTable, chunks

#: Common English terms of abuse.
SEED_TERMS = ("bastard", "clown", "coward", "cretin", "disgusting", "dumb", "fool", "garbage", "idiot", "imbecile", "jerk", "loser", "moron", "parasite", "pathetic", "pig", "scum", "stupid", "trash", "vermin", "worthless")
#: Words that mark a quotation, and words of address.
SPEECH = frozenset(("according", "alleged", "calls", "called", "describes", "described", "quote", "quoted", "quotes", "reported", "reports", "said", "says", "term", "word", "wrote"))
ADDRESS = frozenset(("are", "re", "you", "your", "yours", "yourself", "u", "he", "she", "they"))
#: Letters that digits and signs stand for.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})
QUOTES = ('"', "“", "”", "„", "«", "»")

#: Labelled texts that are drawn of each class, at most.
PER_CLASS = 3000
#: Words whose weights a worker remembers.
CACHE_WORDS = 200_000
#: Words on either side of a hit.
CONTEXT = 8

_TOKEN_BYTES = ALPHANUMERIC.copy()
_TOKEN_BYTES[[ord("@"), ord("$")]] = True


def edit_limit(term: str) -> int:
    """Edits allowed: none under 4 letters, 1 under 8, else 2."""
    return 0 if len(term) < 4 else 1 if len(term) < 8 else 2


class LexiconAutomaton:
    """Levenshtein automata intersected with a trie, determinised lazily."""

    def __init__(self, terms: dict[str, int]):
        """``terms``: each term's edit limit."""
        self._children: list[dict[str, int]] = [{}]
        self._term: list[str | None] = [None]
        self._slack = [0]  # largest edit limit of the terms below
        for term, limit in sorted(terms.items()):
            node = 0
            self._slack[0] = max(self._slack[0], limit)
            for letter in term:
                if letter not in self._children[node]:
                    self._children[node][letter] = len(self._children)
                    self._children.append({})
                    self._term.append(None)
                    self._slack.append(0)
                node = self._children[node][letter]
                self._slack[node] = max(self._slack[node], limit)
            self._term[node] = term
        self._limits = terms
        self._alphabet = {letter for edges in self._children for letter in edges}
        self._states: dict[frozenset, int] = {}
        self._sets: list[frozenset] = []
        self._next: list[dict[str, int]] = []
        self._final: list[tuple[str, int] | None] = []
        self._start = self._state({0: 0})

    def _state(self, edits: dict[int, int]) -> int:
        """The state of a configuration, closed under missing letters."""
        stack = list(edits.items())
        while stack:
            node, cost = stack.pop()
            if edits[node] < cost or cost + 1 > self._slack[node]:
                continue
            for child in self._children[node].values():
                if cost + 1 <= self._slack[child] and cost + 1 < edits.get(child, 99):
                    edits[child] = cost + 1
                    stack.append((child, cost + 1))
        key = frozenset(edits.items())
        if key not in self._states:
            ends = [(cost, self._term[node]) for node, cost in key if self._term[node] is not None and cost <= self._limits[self._term[node]]]
            best = min(ends, default=None)
            self._states[key] = len(self._sets)
            self._sets.append(key)
            self._next.append({})
            self._final.append((best[1], best[0]) if best else None)
        return self._states[key]

    def _step(self, state: int, letter: str) -> int:
        edits: dict[int, int] = {}
        for node, cost in self._sets[state]:
            for edge, child in self._children[node].items():
                new = cost + (edge != letter)
                if new <= self._slack[child] and new < edits.get(child, 99):
                    edits[child] = new
            if cost + 1 <= self._slack[node] and cost + 1 < edits.get(node, 99):
                edits[node] = cost + 1
        return self._state(edits) if edits else -1

    def match(self, word: str) -> tuple[str, int] | None:
        """(nearest term, edits) within the term's limit; ties by name."""
        state = self._start
        for letter in word:
            symbol = letter if letter in self._alphabet else ""
            edges = self._next[state]
            if symbol not in edges:
                edges[symbol] = self._step(state, symbol)
            state = edges[symbol]
            if state < 0:
                return None
        return self._final[state]


@dataclass
class Lexicon:
    """Terms for fuzzy matching, stems for prefixes, words known to be clean."""

    terms: dict[str, float]
    stems: dict[str, float] = field(default_factory=dict)
    clean: frozenset = frozenset()

    def __post_init__(self):
        self._automaton = LexiconAutomaton({term: edit_limit(term) for term in self.terms})
        self._sizes = sorted({len(x) for x in self.stems})

    def __getstate__(self):
        return (self.terms, self.stems, self.clean)

    def __setstate__(self, state):
        self.terms, self.stems, self.clean = state
        self.__post_init__()

    def weigh(self, word: str) -> tuple[float, int]:
        """(weight, edits) of a word; weight 0 if it is no term."""
        exact = self.terms.get(word)
        if exact is not None:
            return exact, 0
        for size in self._sizes:
            if size > len(word):
                break
            if word[:size] in self.stems:
                return self.stems[word[:size]], 0
        plain = word.translate(LEET)
        found = self._automaton.match(plain)
        if found is None or (word in self.clean):
            return 0.0, 0
        return self.terms[found[0]] * 0.8 ** found[1], found[1]


def induce_lexicon(texts: list[tuple[str, ...]], labels: list[int], least: int = 4, ratio: float = 12.0) -> Lexicon:
    """Words and stems that mark toxic texts, given as their different words,
    by document frequency.

    A stem stands for the words that begin with it if most of them are marks;
    clean words in reach of the automaton are listed so as to spare them.
    """
    toxic, clean, n = Counter(), Counter(), [labels.count(0), labels.count(1)]
    stems, floor = (Counter(), Counter()), max(least, 0.01 * n[1])
    for words, label in zip(texts, labels, strict=True):
        if label:
            toxic.update(words)
            stems[1].update({word[:k] for word in words for k in range(5, len(word) + 1)})
        else:
            clean.update(words)
    stems = ({}, Counter({stem: count for stem, count in stems[1].items() if count >= floor}))
    # A clean word's stems are looked up once, whatever the number of its texts.
    held = {word: found for word in clean if (found := [word[:k] for k in range(5, len(word) + 1) if word[:k] in stems[1]])}
    near = Counter()
    for words, label in zip(texts, labels, strict=True):
        if not label:
            near.update({stem for word in words if word in held for stem in held[word]})
    stems = (near, stems[1])
    odds = lambda a, b: ((a + 0.1) / (n[1] + 0.2)) / ((b + 0.5) / (n[0] + 1))
    terms = {term: 1.0 for term in SEED_TERMS}
    for word, count in toxic.items():
        if count >= max(floor, 0.05 * n[1]) and len(word) >= 3 and odds(count, clean[word]) >= 4 * ratio:
            terms[word] = 1.0
    found: dict[str, float] = {}
    for stem, count in sorted(stems[1].items(), key=lambda x: (len(x[0]), x[0])):
        if count >= floor and odds(count, stems[0][stem]) >= ratio and not any(stem[:k] in found for k in range(5, len(stem))) and stem not in terms:
            if not any(term.startswith(stem) for term in terms):
                found[stem] = 1.0
    draft = Lexicon(terms, found)
    spared = frozenset(word for word, count in clean.items() if word not in terms and draft.weigh(word)[0] and count >= 2 and odds(toxic[word], count) < ratio)
    return Lexicon(terms, found, spared)


def tokens_of(text: str) -> list[str]:
    data = np.frombuffer(text.lower().encode(), np.uint8)
    table = WordTable(data, np.array([0, len(data)]), _TOKEN_BYTES)
    raw = data.tobytes()
    return [raw[a:b].decode() for a, b in zip(table.starts.tolist(), table.ends.tolist(), strict=True)]


FEATURES = 6


class Counts:
    """Feature rows of the texts of a chunk."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self._known: dict[bytes, float] = {}

    def _weights(self, words: list[bytes]) -> list[float]:
        if len(self._known) > CACHE_WORDS:
            self._known.clear()
        found = list(map(self._known.get, words))
        for k, weight in enumerate(found):
            if weight is None:
                found[k] = self._known[words[k]] = self.lexicon.weigh(words[k].decode())[0]
        return found

    def rows(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        table = WordTable(data, offs, _TOKEN_BYTES)
        n = len(offs) - 1
        direct, quoted, aimed = np.zeros(n), np.zeros(n), np.zeros(n)
        words = np.diff(table.bounds)
        if len(table):
            _, at, which = np.unique(table.hashes, return_index=True, return_inverse=True)
            raw = data.tobytes()
            weights = np.array(self._weights([raw[a:b] for a, b in zip(table.starts[at].tolist(), table.ends[at].tolist(), strict=True)]))
            for hit in np.flatnonzero(weights[which] > 0).tolist():
                row, weight = table.rows[hit], weights[which[hit]]
                kind = self._context(table, raw, hit, row, offs)
                if kind == "quoted":
                    quoted[row] += weight
                else:
                    direct[row] += weight
                    aimed[row] += weight * (kind == "aimed")
        density = 100 * direct / np.maximum(words, 1)
        return np.stack((np.ones(n), np.minimum(direct, 1), np.log1p(direct), np.log1p(density), np.log1p(quoted) * (direct == 0), np.log1p(aimed)), axis=1)

    def _context(self, table: WordTable, raw: bytes, hit: int, row: int, offs: np.ndarray) -> str:
        low, high = max(table.bounds[row], hit - CONTEXT), min(table.bounds[row + 1], hit + CONTEXT + 1)
        before = raw[table.starts[low] if low > table.bounds[row] else offs[row] : table.starts[hit]].decode("utf-8", "ignore")
        after = raw[table.ends[hit] : table.ends[high - 1] if high < table.bounds[row + 1] else offs[row + 1]].decode("utf-8", "ignore")
        near = {raw[table.starts[k] : table.ends[k]].decode("utf-8", "ignore") for k in range(max(low, hit - 4), min(high, hit + 5)) if k != hit}
        opened = sum(before.count(q) for q in QUOTES)
        closed = sum(after.count(q) for q in QUOTES)
        if opened % 2 == 1 and closed:
            return "quoted"
        if near & SPEECH and (opened or closed):
            return "quoted"
        return "aimed" if near & ADDRESS else "plain"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logistic(rows: np.ndarray, labels: np.ndarray, weights: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Newton's method with weighted rows."""
    beta = np.zeros(rows.shape[1])
    for _ in range(rounds):
        p = _sigmoid(rows @ beta)
        slope = rows.T @ (weights * (labels - p)) - ridge * beta
        curve = (rows * (weights * p * (1 - p))[:, None]).T @ rows + (ridge + 1e-9) * np.eye(len(beta))
        step = np.linalg.solve(curve, slope)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return beta


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    beta: np.ndarray

    @classmethod
    def fit(cls, texts: list[str], labels: list[int], sizes: dict[int, int], copies: list[int] | None = None) -> ToxicityModel:
        """``sizes``: rows of each class in all, of which ``texts``, each with
        its number of ``copies``, are a sample.

        The lexicon is induced on one half of the sample and weighed on the
        other, then induced on all, so that the weights hold for unseen texts.
        """
        labels_of = np.array(labels, float)
        if len(set(labels)) < 2:
            beta = np.zeros(FEATURES)
            beta[:3] = (-3.0, 3.0, 1.0)
            return cls(Lexicon({term: 1.0 for term in SEED_TERMS}), beta)
        rows = np.zeros((len(texts), FEATURES))
        same: dict[str, str] = {}  # one object for each word
        words = [tuple({same.setdefault(word, word) for word in tokens_of(text)}) for text in texts]
        for part in (0, 1):
            learn = [k for k in range(len(texts)) if k % 2 != part]
            counts = Counts(induce_lexicon([words[k] for k in learn], [labels[k] for k in learn]))
            ours = [k for k in range(len(texts)) if k % 2 == part]
            found = [counts.rows(data, offs) for _, _, data, offs in chunks(pa.array([texts[k].lower() for k in ours], pa.large_string()))]
            rows[ours] = np.concatenate(found) if found else rows[ours]
        drawn: Counter = Counter()
        for label, count in zip(labels, copies or [1] * len(labels), strict=True):
            drawn[label] += count
        weights = np.array([count * sizes[x] / drawn[x] for x, count in zip(labels, copies or [1] * len(labels), strict=True)])
        beta = _logistic(rows, labels_of, weights / weights.mean())
        return cls(induce_lexicon(words, labels), beta)


def fit_toxicity(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS) -> ToxicityModel:
    """Fits on at most ``per_class`` texts of each class, labels 0 and 1.

    ``labels`` are joined by ``id_col``, without the texts; without them the
    label is a column of ``docs``, which then need no id (copies of a text
    count as one).
    """
    ident = F.col(id_col) if id_col in docs.columns else F.lit(None).cast("long")
    own = [] if labels is not None else [F.col(label_col).alias("label")]
    texts = placed(docs.select(ident.alias("id"), F.col(text_col).alias("text"), *own), "id")
    rows = texts if labels is None else texts.drop("text").join(labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")), "id")
    rows = rows.select(F.col("label").cast("int").alias("label"), "place", "bytes").where("label in (0, 1)")
    sample, sizes = class_sample(rows, texts, "label", "text", per_class)
    return ToxicityModel.fit([text for _, text, _ in sample], [label for label, _, _ in sample], sizes, [copies for _, _, copies in sample])


#: The counter of the model that this worker process used last.
_counters: dict[str, Counts] = {}


def _counter(key: str, shared) -> Counts:
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counts(shared.value.lexicon)
    return _counters[key]


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``(id, score double)`` from 0 to 1, as a written table.

    * null and empty texts get the score of a text without hits;
    * very long texts are read whole; ids may repeat or be null; other
      columns are ignored, whatever their names; an empty table is no error;
    * a word within reach of several terms takes the nearest, then the first
      by name; a model fitted on one class only falls back to the fixed terms.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # a lexicon bounded by the sample

    def run(batches):
        counts = _counter(key, shared)
        for batch in batches:
            found = [_sigmoid(counts.rows(data, offs) @ shared.value.beta) for _, _, data, offs in chunks(batch.column(1), 2 << 20)]
            yield pa.record_batch([batch.column(0), pa.array(np.concatenate(found) if found else np.zeros(0))], names=["id", "score"])

    return stored_map(docs.select(F.col(id_col).alias("id"), F.lower(text_of(text_col)).alias("text")), run, f"id {kind}, score double", "scores").frame
