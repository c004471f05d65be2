"""Toxicity by a weighted finite-state pattern grammar.

A text is read as sentences of symbols: insults and threats (words or word beginnings with a weight), targets,
negations, speech reports, clause breaks and other words. Small transducers mark what they see: whether an
insult stands in the scope of a negation, inside reported speech, near a target, or is a threat carried out on
a target. They are composed into one machine, and the marked, weighted matches of each clause are the features
of a logistic model. A word outside a matched clause has no influence.

Starting weights are common insults and threats of four languages. More are learned: word beginnings and
words that labelled toxic documents have far more often than others, counted on the cluster over a hash sample
of about ``TRAIN_ROWS`` labelled documents (all, if there are fewer). The logistic model is fitted on the features of the
same sample. Neither id, source, language nor label is an input of a score.

Null and empty texts score like a text without a match. Repeated documents score alike; repeated labels of a document count as toxic
when one of them is. Without labels of both kinds the starting weights are used as they are. An empty table
gives an empty result. Input columns named like a result are replaced.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import append_columns, explode_from, held_out

#: Bound of the labelled sample the grammar's weights and the model are fitted on.
TRAIN_ROWS = 8_000
MOST_TERMS = 2_000
LEAST_STEM, MOST_STEM = 4, 8
#: A learned term has at least this log-likelihood ratio and share of toxic documents.
LEAST_EVIDENCE, LEAST_PRECISION = 20.0, 0.6
START_WEIGHT = 3.0

INSULTS = (
    "idiot moron stupid dumb loser trash scum clown pathetic worthless disgusting imbecile bastard pig "
    "idiote imbécile crétin connard salaud abruti ordure débile "
    "dummkopf trottel arschloch abschaum schwachkopf versager "
    "estúpido imbécil basura escoria inútil payaso gilipollas"
).split()
THREATS = "kill hurt destroy beat strangle tuer frapper détruire töten umbringen schlagen matar golpear destruir".split()
TARGETS = "you your yourself they them he she tu toi vous du dich ihr euch sie usted ustedes vosotros él ella".split()
NEGATIONS = "not no never isn't aren't don't nobody ne pas jamais nicht kein keine nie nunca jamás tampoco".split()
REPORTS = "said says told called claimed wrote quoted according dit disait déclaré sagte sagt behauptet dijo dice escribió".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, BREAK = range(7)
FIXED = {
    **dict.fromkeys(TARGETS, TARGET), **dict.fromkeys(NEGATIONS, NEGATION), **dict.fromkeys(REPORTS, REPORT),
    **dict.fromkeys(THREATS, THREAT),
}
NEGATED, REPORTED, TARGETED, THREATENED = 1, 2, 4, 8
#: Factor on a match's weight for each mark.
FACTORS = {NEGATED: 0.4, REPORTED: 0.6, TARGETED: 1.3, THREATENED: 1.0}
FEATURES = 7
LETTERS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
SENTENCE_END = re.compile(r"[.!?\n|]+")
TOKENS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[,;:()\"]")


@dataclass
class Transducer:
    """Arcs (state, symbol) -> (state, marks); a symbol without an arc takes the state's default."""

    arcs: dict[tuple[int, int], tuple[int, int]]
    default: dict[int, int] = field(default_factory=dict)

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        return self.arcs.get((state, symbol)) or (self.default.get(state, state), 0)


def scope(opens: int, mark: int, reach: int, closes: tuple[int, ...], marked: tuple[int, ...]) -> Transducer:
    """Marks ``marked`` symbols up to ``reach`` symbols after ``opens``; ``closes`` end the scope at once."""
    arcs: dict[tuple[int, int], tuple[int, int]] = {}
    for s in range(reach + 1):
        arcs[s, opens] = (reach, 0)
        for c in closes:
            arcs[s, c] = (0, 0)
        if s:
            for m in marked:
                arcs[s, m] = (s - 1, mark)
    return Transducer(arcs, {s: max(0, s - 1) for s in range(reach + 1)})


NEGATION_SCOPE = scope(NEGATION, NEGATED, 4, (BREAK,), (INSULT, THREAT))
REPORT_SCOPE = scope(REPORT, REPORTED, 12, (), (INSULT, THREAT))
TARGET_SCOPE = scope(TARGET, TARGETED, 6, (BREAK,), (INSULT,))
THREAT_SCOPE = scope(THREAT, THREATENED, 4, (BREAK,), (TARGET,))


class Grammar:
    """The transducers run as one machine whose states are tuples; arcs are kept once built."""

    def __init__(self, *parts: Transducer) -> None:
        self.parts = parts
        self.start = (0,) * len(parts)
        self.arcs: dict[tuple[tuple[int, ...], int], tuple[tuple[int, ...], int]] = {}

    def step(self, state: tuple[int, ...], symbol: int) -> tuple[tuple[int, ...], int]:
        known = self.arcs.get((state, symbol))
        if known is None:
            moves = [p.step(s, symbol) for p, s in zip(self.parts, state, strict=True)]
            known = tuple(m[0] for m in moves), sum(m[1] for m in moves)
            self.arcs[state, symbol] = known
        return known


def factor(marks: int) -> float:
    return math.prod(f for m, f in FACTORS.items() if marks & m)


@dataclass
class Lexicon:
    """Weights of whole words and of word beginnings."""

    words: dict[str, float]
    stems: dict[str, float]

    def weight(self, word: str) -> float:
        best = self.words.get(word, 0.0)
        for k in range(LEAST_STEM, min(MOST_STEM, len(word)) + 1):
            best = max(best, self.stems.get(word[:k], 0.0))
        return best


class Scorer:
    def __init__(self, lexicon: Lexicon, coefficients: list[float]) -> None:
        import ahocorasick

        self.lexicon = lexicon
        self.coefficients = np.array(coefficients)
        self.grammar = Grammar(NEGATION_SCOPE, REPORT_SCOPE, TARGET_SCOPE, THREAT_SCOPE)
        self.finder = ahocorasick.Automaton()
        for term in {*lexicon.words, *lexicon.stems, *THREATS}:
            self.finder.add_word(term, len(term))
        self.finder.make_automaton()

    def sentences(self, text: str) -> list[str]:
        """Sentences in which a term begins a word."""
        starts = sorted({end - n + 1 for end, n in self.finder.iter(text)})
        starts = [s for s in starts if s == 0 or not text[s - 1].isalpha()]
        if not starts:
            return []
        stops = [m.start() for m in SENTENCE_END.finditer(text)]
        found = dict.fromkeys(bisect_right(stops, s) for s in starts)
        return [text[stops[i - 1] if i else 0 : stops[i] if i < len(stops) else len(text)] for i in found]

    def features(self, text: str) -> list[float]:
        """Sums by kind of match, the best clause, matched clauses and distinct matched words."""
        plain = targeted = softened = threats = best = 0.0
        clauses, seen = 0, set()
        for sentence in self.sentences(text.lower()):
            state, clause = self.grammar.start, 0.0
            for token in TOKENS.findall(sentence):
                weight = 0.0
                if token in ',;:()"':
                    symbol = BREAK
                else:
                    symbol = FIXED.get(token, OTHER)
                    if symbol in (OTHER, THREAT):
                        weight = self.lexicon.weight(token)
                        symbol = INSULT if weight else symbol
                state, marks = self.grammar.step(state, symbol)
                if weight:
                    seen.add(token)
                    value = weight * factor(marks)
                    clause += value
                    if marks & (NEGATED | REPORTED):
                        softened += value
                    elif marks & TARGETED:
                        targeted += value
                    else:
                        plain += value
                if marks & THREATENED:
                    threats += 1
                    clause += 1
                if symbol == BREAK or weight:
                    best = max(best, clause)
                if symbol == BREAK:
                    clauses += clause > 0
                    clause = 0.0
            best = max(best, clause)
            clauses += clause > 0
        return [math.log1p(plain), math.log1p(targeted), math.log1p(softened), math.log1p(threats), best, math.log1p(clauses), math.log1p(len(seen))]

    def score(self, text: str) -> float:
        z = self.coefficients[0] + float(np.dot(self.coefficients[1:], self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


#: Without labels: a match of full weight is about even, two are toxic.
START_COEFFICIENTS = [-3.0, 0.5, 0.7, 0.2, 0.3, 0.6, 0.3, 0.3]


def start_lexicon() -> Lexicon:
    return Lexicon(dict.fromkeys(INSULTS, START_WEIGHT), {})


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 50) -> list[float]:
    a = np.c_[np.ones(len(x)), x]
    w = np.zeros(a.shape[1])
    penalty = np.r_[1e-6, np.full(a.shape[1] - 1, ridge)]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def terms_of(text: str) -> set[str]:
    """``=word`` and ``word beginnings`` of a text."""
    words = set(LETTERS.findall(text.lower()))
    stems = {w[:k] for w in words for k in range(LEAST_STEM, min(MOST_STEM, len(w)) + 1)}
    return stems | {f"={w}" for w in words}


def evidence(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    """Log-likelihood ratio of a term's counts against the share of toxic documents."""
    n, p = toxic + clean, n_toxic / (n_toxic + n_clean)
    parts = [(toxic, n * p), (clean, n * (1 - p))]
    return 2 * sum(o * math.log(o / e) for o, e in parts if o)


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, label: str, rows: int) -> DataFrame:
    """About ``rows`` labelled documents that are not held out, chosen by a hash of the id; never a table that grows."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    known = known.groupBy(key).agg(F.max(label).cast("int").alias("_label"))
    share = min(1.0, rows / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64(key, F.lit(2)), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    return docs.join(F.broadcast(chosen), key)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", rows: int = TRAIN_ROWS) -> tuple[Lexicon, list[float]]:
    sample = labelled_sample(docs.select(key, text), labels, key, label, rows)
    sizes = {r[0]: r[1] for r in sample.groupBy("_label").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return start_lexicon(), START_COEFFICIENTS

    def count():
        def work(texts):
            counts = [Counter(terms_of(t.decode(errors="replace")) if t else ()) for t in texts]
            yield [i for i, c in enumerate(counts) for _ in c], [t for c in counts for t in c]

        return work

    terms = explode_from(sample, text, ["_label"], "term string", count)
    table = terms.groupBy("term").agg(F.sum("_label").alias("toxic"), F.count_if(F.col("_label") == 0).alias("clean"))
    table = table.where((F.col("toxic") >= 3) & (F.col("toxic") >= LEAST_PRECISION * (F.col("toxic") + F.col("clean"))))
    found = []
    for term, toxic, clean in table.orderBy(F.desc("toxic"), "term").limit(50 * MOST_TERMS).collect():
        g = evidence(toxic, clean, n_toxic, n_clean)
        if g >= LEAST_EVIDENCE:
            odds = math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))
            found.append((g, term, odds))
    lexicon = start_lexicon()
    for _, term, odds in sorted(found, key=lambda f: (-f[0], f[1]))[:MOST_TERMS]:
        if term[0] == "=":
            lexicon.words[term[1:]] = odds
        else:
            lexicon.stems[term] = odds

    def measure():
        scorer = Scorer(lexicon, START_COEFFICIENTS)

        def work(texts):
            return [[scorer.features(t.decode(errors="replace") if t else "") for t in texts]]

        return work

    rows_ = append_columns(sample.select("_label", text), text, "x array<double>", measure).select("_label", "x").collect()
    x, y = np.array([r[1] for r in rows_]), np.array([r[0] for r in rows_], float)
    return lexicon, fit_logistic(x, y)


def score(docs: DataFrame, model: tuple[Lexicon, list[float]], text: str = "text") -> DataFrame:
    """Documents with ``score`` (0 to 1) and ``predicted`` (1 from 0.5)."""
    lexicon, coefficients = model

    def make():
        scorer = Scorer(lexicon, coefficients)

        def work(texts):
            scores = [scorer.score(t.decode(errors="replace") if t else "") for t in texts]
            return [scores, [int(s >= 0.5) for s in scores]]

        return work

    return append_columns(docs, text, "score double, predicted int", make)


def drop_toxic(docs: DataFrame, model: tuple[Lexicon, list[float]], text: str = "text") -> DataFrame:
    """Documents that the grammar does not reject, columns as they were."""
    lexicon, coefficients = model

    def make():
        scorer = Scorer(lexicon, coefficients)

        def work(texts):
            return [[scorer.score(t.decode(errors="replace") if t else "") >= 0.5 for t in texts]]

        return work

    marked = append_columns(docs, text, "_toxic boolean", make)
    return marked.where("NOT _toxic").select(*[F.col(f"`{c}`") for c in docs.columns])
