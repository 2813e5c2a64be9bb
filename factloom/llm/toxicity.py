"""Toxicity by a weighted finite-state grammar over clauses.

A lexer automaton finds insult and threat terms in the lower-cased text. Every clause that holds one is run,
token by token, through a transducer composed of four: insults and threats, negation (a few tokens after a negating
word), reported speech (from a reporting verb or quotation mark to the end of the clause) and targets (a person word
close before or after). Its outputs name what a term is there: plain, aimed, negated, reported. A score is the
logistic value of a bias plus the weights of these outputs, each times the sum of the matched terms' weights; large sums
grow ever slower and stay below `MOST`. A word is also matched behind an elided beginning (l'idiot).

Closed word classes are listed below. Insult terms and weights are learned from labels: words and word
beginnings whose document counts by label differ by far more than chance, then weights by logistic regression around
the listed prior. Both are fitted on at most `sample` labelled rows (20,000 by default, drawn by a hash of their id), and terms
are as few as those rows prove; scoring reads every whole text. Ids, languages and sources are no inputs of a score.

Edge cases: a null or empty text matches nothing and gets the score of the bias. A null id is not held out. Where a
document has several labels the largest counts; null labels do not count. Without labels the prior and the seed terms
remain. Repeated rows are scored each; an empty table gives an empty result; columns not asked for are not read.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import written

SEEDS = "idiot moron stupid imbécile dummkopf estúpido".split()
THREATS = "kill murder shoot stab strangle hurt tuer frapper töten umbringen matar golpear".split()
TARGETS = "you your yourself he she they them him her tu t toi vous il elle du dich ihr er sie ihn usted él ella".split()
NEGATIONS = "not no never isn't aren't don't without pas jamais nicht kein keine nie nunca sin".split()
REPORTS = "said says say wrote quoted claims reported called dit écrit sagte schrieb dijo escribió".split()
MOST = 12.0
QUOTES = list("\"«»„“”")
PREFIXES = (4, 5, 6, 7)

OUTPUTS = ("insult", "aimed insult", "negated", "reported", "threat", "aimed threat", "late target")
PRIOR = np.array([1.5, 2.0, -0.5, 0.2, 0.3, 2.0, 0.5])
BIAS = -3.0
#: A word, an elided beginning (l'idiot, you're) as its first group and what follows it as its second, or a quotation mark.
_TOKEN = re.compile(r"([^\W_]+)(?:['’]([^\W_]+))?|[\"«»„“”]")
_CLAUSE_END = re.compile(r"[.!?;\n]+")


class Transducer:
    """A deterministic transducer: arcs[state][label] = (next state, output label). A missing label passes as it is."""

    def __init__(self, arcs: dict):
        self.arcs = arcs

    def step(self, state, label: str) -> tuple:
        return self.arcs.get(state, {}).get(label, (state, label))

    def compose(self, other: Transducer, alphabet: str) -> Transducer:
        """This one, then the other on its outputs, over the states that can be reached."""
        arcs, todo = {}, [(0, 0)]
        while todo:
            state = todo.pop()
            if state in arcs:
                continue
            arcs[state] = {}
            for label in alphabet:
                one, middle = self.step(state[0], label)
                two, out = other.step(state[1], middle)
                arcs[state][label] = ((one, two), out)
                todo.append((one, two))
        names = {s: i for i, s in enumerate(sorted(arcs, key=lambda s: s != (0, 0)))}
        return Transducer(
            {names[s]: {a: (names[to], out) for a, (to, out) in row.items()} for s, row in arcs.items()}
        )


# Labels: I insult, H threat, T target, N negation, R report, Q quote, O other; outputs: i negated, r reported,
# D aimed insult, A aimed threat, L a target after a term.
_LABELS = "IHTNRQO"


def _scope(opener: str, length: int, turned: dict) -> Transducer:
    """After `opener`, labels are replaced as `turned` says, over the next `length` tokens."""
    arcs = {0: {opener: (length, opener)}}
    for left in range(1, length + 1):
        arcs[left] = {a: (left - 1, turned.get(a, a)) for a in _LABELS + "ir"} | {opener: (length, opener)}
    return Transducer(arcs)


def _reported() -> Transducer:
    inside = {1: {"I": (1, "r"), "H": (1, "r")}}
    return Transducer({0: {"R": (1, "R"), "Q": (1, "Q")}} | inside)


def _aimed(near: int) -> Transducer:
    """Targets before a term aim it; targets shortly after one give a late target."""
    states = {(b, a): b * (near + 1) + a for b in range(near + 1) for a in range(near + 1)}
    arcs = {}
    for (before, after), name in states.items():
        idle = states[max(0, before - 1), max(0, after - 1)]
        arcs[name] = {x: (idle, x) for x in _LABELS + "ir"}
        arcs[name]["T"] = (states[near, 0], "L" if after else "T")
        for plain, aimed in (("I", "D"), ("H", "A")):
            arcs[name][plain] = (states[0 if before else before, near], aimed if before else plain)
    return Transducer(arcs)


def grammar(negation: int = 3, near: int = 4) -> Transducer:
    negated = _scope("N", negation, {"I": "i", "H": "i"})
    return negated.compose(_reported(), _LABELS).compose(_aimed(near), _LABELS)


_OUT = {"I": 0, "D": 1, "i": 2, "r": 3, "H": 4, "A": 5, "L": 6}
_CLASSES = (
    {w: "R" for w in REPORTS} | {w: "N" for w in NEGATIONS} | {w: "T" for w in TARGETS} | {w: "Q" for w in QUOTES}
)


def _class(token: re.Match) -> str:
    """The class of a word, else of its elided beginning."""
    return _CLASSES.get(token[0].replace("’", "'")) or _CLASSES.get(token[1], "O")


def damped(sums: np.ndarray) -> np.ndarray:
    """Every further hit counts, and ever less."""
    return MOST * (1 - np.exp(-sums / MOST))


@dataclass
class Model:
    """Terms (text, whole word or beginning, weight) and the weights of the outputs."""

    terms: list = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())
    bias: float = BIAS


class Scorer:
    """A compiled model; made once per task."""

    def __init__(self, model: Model):
        import ahocorasick

        self.model, self.rules, self.lexer = model, grammar(), ahocorasick.Automaton()
        found = {(t, True): ("H", 1.0) for t in THREATS}
        found |= {(t, whole): ("I", weight) for t, whole, weight in model.terms}
        by_text: dict[str, dict] = {}
        for (term, whole), what in found.items():
            by_text.setdefault(term, {})[whole] = what
        for term, what in by_text.items():
            self.lexer.add_word(term, (term, what))
        self.lexer.make_automaton()

    def terms_in(self, text: str) -> dict[int, tuple[str, float]]:
        """Start of a word -> what term it is; the longest one, where several begin a word."""
        found = {}
        for end, (term, what) in self.lexer.iter(text):
            start = end + 1 - len(term)
            if start and (text[start - 1].isalnum()):
                continue
            whole = end + 1 == len(text) or not text[end + 1].isalnum()
            hit = what.get(True) if whole and True in what else what.get(False)
            if hit:
                found[start] = hit  # longer terms end later
        return found

    def features(self, text: str | None) -> np.ndarray:
        out = np.zeros(len(OUTPUTS))
        lowered = (text or "").lower()
        terms = self.terms_in(lowered)
        if not terms:
            return out
        ends = [m.end() for m in _CLAUSE_END.finditer(lowered)] + [len(lowered)]
        for clause in sorted({bisect.bisect_right(ends, start) for start in terms}):
            state = 0
            for token in _TOKEN.finditer(lowered, ends[clause - 1] if clause else 0, ends[clause]):
                label, weight = terms.get(token.start()) or terms.get(token.start(2)) or (_class(token), 1.0)
                state, label = self.rules.step(state, label)
                if label in _OUT:
                    out[_OUT[label]] += weight
        return out

    def score(self, text: str | None) -> float:
        value = self.model.bias + float(damped(self.features(text)) @ self.model.weights)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, value))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


_COUNTS = "term string, whole boolean, toxic int, n long, uses long"


#: Terms a task counts before it hands them on.
_HELD = 100_000


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
    uses: dict[int, Counter] = {0: Counter(), 1: Counter()}

    def handed_on() -> Iterator[pa.RecordBatch]:
        for toxic, found in counts.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([t for t, _ in found], pa.string()),
                    pa.array([w for _, w in found], pa.bool_()),
                    pa.array([toxic] * len(found), pa.int32()),
                    pa.array(list(found.values()), pa.int64()),
                    pa.array([uses[toxic][t] for t in found], pa.int64()),
                ],
                names=["term", "whole", "toxic", "n", "uses"],
            )
            found.clear()
            uses[toxic].clear()

    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
            words: Counter = Counter()
            for token in _TOKEN.finditer((text.as_py() or "").lower()):
                words[token[0]] += 1
                if token[2] and len(token[2]) > 1:
                    words[token[2]] += 1
            terms: Counter = Counter()
            for word, n in words.items():
                terms[word, True] += n
                for k in PREFIXES:
                    if len(word) >= k:
                        terms[word[:k], False] += n
            counts[toxic].update(terms.keys())
            uses[toxic].update(terms)
            if len(counts[0]) + len(counts[1]) > _HELD:
                yield from handed_on()
    yield from handed_on()


def learn_terms(rows: DataFrame) -> list[tuple[str, bool, float]]:
    """Terms of toxic rows by the log-likelihood ratio of their document counts, weighted by the ratio of their uses.

    A longer term is kept only where no shorter one says as much.
    """
    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return []
    counted = rows.select("text", "toxic").mapInArrow(_term_counts, _COUNTS)
    of = lambda label, n: F.sum(F.when(F.col("toxic") == label, F.col(n)).otherwise(0)).cast("double")
    by_term = counted.groupBy("term", "whole").agg(
        of(1, "n").alias("a"), of(0, "n").alias("b"), of(1, "uses").alias("c"), of(0, "uses").alias("d")
    )
    by_term = written(by_term, "terms")
    share = toxic / (toxic + clean)
    a, b = F.col("a"), F.col("b")
    part = lambda n, p: F.when(n > 0, n * F.log(n / ((a + b) * p))).otherwise(0.0)
    ratio = 2 * (part(a, share) + part(b, 1 - share))
    least = 2 * math.log(max(2, by_term.count())) + 4
    best = (
        by_term.where((ratio > least) & (a > (a + b) * min(0.9, 3 * share)))
        .select("term", "whole", "a", "b", "c", "d")
        .collect()
    )
    kept: dict[str, float] = {}
    out = []
    for row in sorted(best, key=lambda r: (r["whole"], len(r["term"]), r["term"])):
        weight = math.log((row["c"] + 0.5) / (toxic + 1) * (clean + 1) / (row["d"] + 0.5))
        shorter = max((kept.get(row["term"][:k], 0.0) for k in PREFIXES if k <= len(row["term"])), default=0.0)
        if row["b"] == 0 and shorter or weight <= shorter:
            continue
        if not row["whole"]:
            kept[row["term"]] = weight
        out.append((row["term"], row["whole"], weight / 4))
    return out


def fit_weights(features: np.ndarray, labels: np.ndarray, counts: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps, drawn to the prior weights."""
    x = np.hstack((features, np.ones((len(features), 1))))
    centre = np.append(PRIOR, BIAS)
    w, pull = centre.copy(), np.append(np.full(len(PRIOR), 1.0), 0.01)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (counts * (p - labels)) + pull * (w - centre)
        step = np.linalg.solve((x * (counts * p * (1 - p))[:, None]).T @ x + np.diag(pull), gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> Model:
    """Learn from `labels` (doc_id, toxic) of rows that are not held out."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ids = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most `sample` pairs of numbers are broadcast; whole texts of those rows are read.
    rows = written(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "toxic"), "labelled")
    terms = learn_terms(rows)
    known = {t for t, _, _ in terms}
    model = Model(terms + [(t, True, 1.0) for t in SEEDS if t not in known])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            x = damped(np.array([scorer.features(t) for t in batch.column(0).to_pylist()]).reshape(-1, len(OUTPUTS)))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c) for c in x.T), batch.column(1)], names=[*(f"f{i}" for i in range(len(OUTPUTS))), "toxic"]
            )

    schema = ", ".join(f"f{i} double" for i in range(len(OUTPUTS))) + ", toxic int"
    counted = rows.mapInArrow(run, schema)
    # Equal feature rows are one row with a count; at most `sample` of them, a few numbers each, reach the driver.
    found = np.array(sorted(list(r) for r in counted.groupBy(*counted.columns).count().collect()), float)
    if len(found):
        model.weights, model.bias = fit_weights(found[:, :-2], found[:, -2], found[:, -1])
    return model


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """`keep` columns and `score`, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            values = pa.array([scorer.score(t) for t in batch.column(len(keep)).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], values], names=[*keep, "score"])

    rows = docs.select(*keep, docs[text_col].alias("_text"))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{kinds}, score double")
