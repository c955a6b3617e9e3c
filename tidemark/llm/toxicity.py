"""Toxicity by a weighted finite-state pattern grammar.

Five transducers read the tokens of a clause and are composed into one deterministic automaton: insult, threat, target, negation and reported speech.
Tokens come from a trie of words, word pairs and word beginnings with weights learned from labelled documents (insults), and from small closed word classes in
English, German, French and Spanish. The insult transducer matches an insulting term, and tells it from one that is said of somebody: a target,
at most GAP tokens (a verb, an article) and the term, or the other way round. The threat transducer matches a verb of harm and its target at most GAP tokens later, and
tells whether a modal verb or auxiliary announced it. The other three say whether the clause has addressed somebody, is being negated, or
reports what others say. What the automaton emits at a match is weighted by that context. A document is scored on its matched clauses, the weight of
each kind of match in each context being learned by logistic regression; a word of harm alone counts for nothing.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample

OTHER, INSULT, HARM, TARGET, NEGATION, REPORT, MODAL = range(7)
SYMBOLS = 7
#: What the composed automaton emits: context of three bits, then kinds of match.
ADDRESSED, NEGATED, REPORTED, TERM, AIMED, THREAT, ANNOUNCED = (1 << i for i in range(7))
#: Closed word classes (fixed values).
HARMS = "kill hurt destroy beat shoot stab töten umbringen schlagen vernichten tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your yours yourself u ur he she they them these those du dich dir ihr euch dein deine tu te toi vous votre tes ton tú ti usted ustedes vosotros tus".split()
NEGATIONS = "not no never none isn't aren't don't nicht kein keine nie niemals ne pas jamais aucun nunca jamás ningún tampoco".split()
REPORTS = "said says say called wrote quoted reported claimed sagte sagt nannte schrieb dit disait appelé écrit dijo dice llamó escribió".split()
MODALS = "will would should must gonna shall i'll we'll werde werden soll sollte muss vais va allons dois devrait voy vamos va debo debería".split()
CLASSES = {w: k for k, words in ((HARM, HARMS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (MODAL, MODALS)) for w in words}
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE = re.compile(r"[.!?;\n]")
#: How many tokens a negation reaches, and may stand between the parts of a pattern.
SCOPE, GAP = 3, 2
PREFIXES = (4, 5, 6, 7)

Machine = dict[tuple[object, int], tuple[object, int]]


def machine(start, step) -> tuple[object, Machine]:
    """The transducer of a step function ``(state, symbol) -> (state, bits)`` over its reachable states."""
    arcs, todo = {}, [start]
    while todo:
        q = todo.pop()
        for a in range(SYMBOLS):
            if (q, a) not in arcs:
                arcs[q, a] = step(q, a)
                todo.append(arcs[q, a][0])
    return start, arcs


def flag_machine(symbol: int, bit: int) -> tuple[object, Machine]:
    """After ``symbol`` every later token of the clause carries ``bit``."""
    return machine(0, lambda q, a: (1 if a == symbol else q, bit if q else 0))


def scope_machine(symbol: int, bit: int, reach: int) -> tuple[object, Machine]:
    """After ``symbol`` the next ``reach`` tokens carry ``bit``."""
    return machine(0, lambda q, a: (reach if a == symbol else max(0, q - 1), bit if q else 0))


def insult_machine() -> tuple[object, Machine]:
    """A term; aimed if a target stands at most GAP tokens before it. A target at most GAP tokens after a term that was not aimed makes that match aimed."""

    def step(q, a):
        target, term = q
        if a == INSULT:
            return ((max(0, target - 1), 0), TERM | AIMED) if target else ((0, GAP + 1), TERM)
        if a == TARGET:
            return (GAP + 1, 0), (AIMED if term else 0)
        return (max(0, target - 1), max(0, term - 1)), 0

    return machine((0, 0), step)


def threat_machine() -> tuple[object, Machine]:
    """A verb of harm and a target at most GAP tokens later; announced if a modal stood at most GAP tokens before the verb."""

    def step(q, a):
        modal, harm, announced = q
        if a == HARM:
            return (0, GAP + 1, bool(modal)), 0
        if a == TARGET and harm:
            return (max(0, modal - 1), 0, False), THREAT | (ANNOUNCED if announced else 0)
        harm = max(0, harm - 1)
        return (GAP + 1 if a == MODAL else max(0, modal - 1), harm, announced and harm > 0), 0

    return machine((0, 0, False), step)


def compose(one: tuple[object, Machine], two: tuple[object, Machine]) -> tuple[object, Machine]:
    """Both machines read the same tokens; what they emit is joined. Only reachable states are kept."""

    def step(q, a):
        (p, x), (r, y) = one[1][q[0], a], two[1][q[1], a]
        return (p, r), x | y

    return machine((one[0], two[0]), step)


@functools.lru_cache
def grammar() -> tuple[list[list[int]], list[list[int]]]:
    """The composed automaton as tables ``next[state][class]`` and ``emitted[state][class]``; state 0 starts a clause."""
    parts = (insult_machine(), threat_machine(), flag_machine(TARGET, ADDRESSED), scope_machine(NEGATION, NEGATED, SCOPE), flag_machine(REPORT, REPORTED))
    start, arcs = functools.reduce(compose, parts)
    states = {start: 0}
    for q, _ in arcs:
        states.setdefault(q, len(states))
    nxt, out = [[0] * SYMBOLS for _ in states], [[0] * SYMBOLS for _ in states]
    for (q, a), (to, bits) in arcs.items():
        nxt[states[q]][a], out[states[q]][a] = states[to], bits
    return nxt, out


class Lexicon:
    """The trie of insulting terms: words, word pairs and word beginnings with weights; the heaviest match at a word counts."""

    def __init__(self, weights: dict[str, float]):
        self.exact = {k[1:]: w for k, w in weights.items() if k[0] == "="}
        self.begin = {k[1:]: w for k, w in weights.items() if k[0] == "^"}
        self.pairs = {k[1:]: w for k, w in weights.items() if k[0] == "+"}
        self.firsts = {k.split(" ")[0] for k in self.pairs}
        self.known: dict[str, tuple[int, float]] = {}

    def read(self, word: str) -> tuple[int, float]:
        got = self.known.get(word)
        if got is None:
            w = max([self.exact.get(word, 0.0), *(self.begin.get(word[:k], 0.0) for k in PREFIXES if len(word) > k)])
            got = (INSULT, w) if w > 0 else (CLASSES.get(word, OTHER), 1.0)
            if len(self.known) < 200_000:
                self.known[word] = got
        return got

    def tokens(self, words: list[str]):
        """``(class, weight)`` of the tokens of a clause: a pair is one token if it weighs more than its words do."""
        k, n = 0, len(words)
        while k < n:
            kind, w = self.read(words[k])
            if words[k] in self.firsts and k + 1 < n:
                pair = self.pairs.get(f"{words[k]} {words[k + 1]}", 0.0)
                if pair > max(x[1] if x[0] == INSULT else 0.0 for x in ((kind, w), self.read(words[k + 1]))):
                    yield INSULT, pair
                    k += 2
                    continue
            yield kind, w
            k += 1


N_FEATURES = 8 * 3 + 5


def features(text: str | None, lexicon: Lexicon, tables) -> tuple[np.ndarray, int, int]:
    """Features of the matched clauses, the number of matches and of matched clauses; all zero for an empty text.

    Per context: the summed weights of terms, of aimed terms, and the threats (announced ones twice). Then the heaviest clause, the number of matches and of matched clauses, and how many of each there are to a word.
    """
    out = np.zeros(N_FEATURES)
    if not text:
        return out, 0, 0
    nxt, emitted = tables
    best, hits, bad, read = 0.0, 0, 0, 0
    for clause in CLAUSE.split(text.lower()):
        words = TOKEN.findall(clause)
        read += len(words)
        q, total, last = 0, 0.0, 0.0
        for kind, w in lexicon.tokens(words):
            bits = emitted[q][kind]
            q = nxt[q][kind]
            if bits < TERM:
                continue
            context = bits & 7
            if bits & TERM:
                out[context] += w
                total, last, hits = total + w, w, hits + 1
            if bits & AIMED:
                out[8 + context] += last
                total += last
            if bits & THREAT:
                n = 2 if bits & ANNOUNCED else 1
                out[16 + context] += n
                total, hits = total + 2 * n, hits + 1
        if total:
            best, bad = max(best, total), bad + 1
    out[:24] = np.log1p(out[:24])
    out[24:] = best, math.log1p(hits), math.log1p(bad), 10 * hits / max(read, 20), 10 * bad / max(read, 20)
    return out, hits, bad


def _terms(frames):
    """Distinct words, pairs and word beginnings per document, counted by label within the batch."""
    for pdf in frames:
        seen = {0: Counter(), 1: Counter()}
        for text, y in zip(pdf["text"], pdf["toxic"], strict=True):
            clauses = [TOKEN.findall(c) for c in CLAUSE.split((text or "").lower())]
            words = {w for c in clauses for w in c}
            terms = {"=" + w for w in words}
            terms.update("^" + w[:k] for w in words for k in PREFIXES if len(w) > k)
            terms.update(f"+{v} {w}" for c in clauses for v, w in zip(c, c[1:], strict=False))
            seen[int(y)].update(terms)
        both = list(seen[0].keys() | seen[1].keys())
        yield pd.DataFrame({"term": both, "n0": [seen[0][t] for t in both], "n1": [seen[1][t] for t in both]})


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 60) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the intercept, which is not penalised."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(a.shape[1]), np.append(np.full(x.shape[1], penalty), 1e-6)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(ridge), a.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, most: int = 12_000, terms: int = 2_000) -> tuple[dict[str, float], np.ndarray, float]:
    """Lexicon weights and context weights from at most ``most`` labelled documents.

    ``labels`` has ``doc_id`` and ``toxic``. Terms are kept if at least 1% of the toxic documents have them and
    their log odds are above ln 4; at most ``terms`` of them, the most telling first.
    """
    spark = docs.sparkSession
    ids = bounded_sample(labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id", most)
    sample = docs.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic")
    counted = sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()
    n = {0: 0, 1: 0} | {int(r["toxic"]): r["n"] for r in counted}
    if not n[0] or not n[1]:
        return {}, np.zeros(N_FEATURES + 1), float(n[1] > 0)
    found = sample.mapInPandas(_terms, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    odds = F.log((F.col("n1") + 0.5) / (n[1] + 1)) - F.log((F.col("n0") + 0.5) / (n[0] + 1))
    gain = (F.col("n1") / n[1] - F.col("n0") / n[0]) * odds
    rows = found.where(F.col("n1") >= max(3, n[1] // 100)).withColumns({"w": odds, "g": gain}).where(F.col("w") > math.log(4)).orderBy(F.desc("g"), "term").limit(terms).collect()
    weights = {r["term"]: float(r["w"]) for r in rows}
    rows = sample.mapInPandas(_featured(spark.sparkContext.broadcast(weights), None), "doc_id long, y double, f array<double>").collect()
    x, y = np.array([r["f"] for r in rows]), np.array([r["y"] for r in rows])
    return weights, fit_logistic(x, y), float(y.mean())


def _featured(weights, model):
    def run(frames):
        lexicon, tables = Lexicon(weights.value), grammar()
        for pdf in frames:
            read = [features(t, lexicon, tables) for t in pdf["text"]]
            f = np.array([x[0] for x in read]).reshape(len(pdf), N_FEATURES)
            if model is None:
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["toxic"].astype(float), "f": list(f)})
            else:
                z = f @ model[:-1] + model[-1]
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": 1 / (1 + np.exp(-np.clip(z, -30, 30))), "n_matches": [x[1] for x in read], "n_clauses": [x[2] for x in read]})

    return run


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score, predicted, n_matches, n_clauses)`` for every row of ``docs``.

    Only the text enters a score. Null and empty texts get the score of a text without matches. Without labels of both kinds
    all scores are equal: 1/2. Repeated rows get equal scores, null ids are passed on, very long texts are read whole; of terms that tell equally much the first
    in code point order are kept. Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    weights, model, _ = learn(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    out = docs.mapInPandas(_featured(shared, model), f"doc_id {id_type}, score double, n_matches long, n_clauses long")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
