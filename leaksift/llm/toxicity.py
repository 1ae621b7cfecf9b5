"""Toxicity: a weighted finite-state pattern grammar over clauses.

Words are tagged as insult, threat, target, negation or reported speech. Small
transducers follow the tags of a clause: one carries negation over the next
words, one carries reported speech to the clause's end, one joins a target to
an insult or threat near it. Their composition is one machine whose output
names the pattern that each insult or threat stands in. A document is scored
from the patterns of its clauses; an insult that is denied or reported is a
pattern of its own with its own weight, so words are never scored alone.

The insult lexicon is learned: stems and words found in toxic documents far
more often than chance allows, over a bounded sample of labelled rows in which
near copies count once. The weights of the patterns are learned on the same
sample. Each text is scored on its own, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaksift.llm.quality import held_out, labelled_sample

SAMPLE_PER_LABEL = 4096
LEXICON_SIZE = 8192
STEMS = range(4, 11)
CERTAINTY = 16.0  # nats by which a stem's share of toxic texts must exceed chance

# Closed word classes in the languages of the corpus.
THREATS = set("""kill killed hurt beat destroy burn stab shoot smash töten umbringen schlagen vernichten tuer frapper brûler
 détruire matar golpear quemar destruir""".split())
TARGETS = set("""you your yours yourself they them their he him she her these those du dich dir dein ihr euch sie ihnen tu toi vous
 ils elles leur tú te ti vosotros ustedes ellos ellas""".split())
NEGATIONS = set("not never no none cannot dont isnt arent wasnt without nicht kein keine nie ohne ne pas jamais sans nunca jamás sin".split())
REPORTS = set("""said says say wrote writes claimed called quoted quote reported allegedly sagte schrieb behauptete zitierte dit
 écrit affirme cité dijo escribió afirmó citó""".split())
INSULTS = set("""idiot moron loser worthless scum stupid disgusting clown trash pathetic dumb imbecile vermin dummkopf abschaum
 crétin ordure imbécil escoria""".split())

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = range(6)
WORD = re.compile(r"[^\W_]+|[.,;:!?\n]")
CLAUSE_ENDS = frozenset(".,;:!?\n")


@dataclass(frozen=True)
class Transducer:
    """Letter to letter: ``step[state][tag]`` is the next state and a mark for the tag's place."""

    step: tuple[tuple[tuple[int, int], ...], ...]


def carried(trigger: int, reach: int) -> Transducer:
    """Marks 1 for ``reach`` places after a ``trigger`` (to the clause's end where ``reach`` is 0)."""
    last = reach or 1

    def row(state: int) -> tuple[tuple[int, int], ...]:
        decayed = state if reach == 0 else max(0, state - 1)
        return tuple((last if tag == trigger else decayed, int(state > 0)) for tag in range(6))

    return Transducer(tuple(row(s) for s in range(last + 1)))


def followed(reach: int) -> Transducer:
    """Marks 1 on a target within ``reach`` places after an insult or threat."""
    def row(state: int) -> tuple[tuple[int, int], ...]:
        return tuple((reach if tag in (INSULT, THREAT) else max(0, state - 1), int(state > 0 and tag == TARGET)) for tag in range(6))

    return Transducer(tuple(row(s) for s in range(reach + 1)))


def composed(parts: list[Transducer]) -> list[list[tuple[int, int]]]:
    """The product machine of transducers that read the same tags; its mark holds one bit per part."""
    sizes = [len(p.step) for p in parts]
    table = []
    for state in range(int(np.prod(sizes))):
        at = np.unravel_index(state, sizes)
        row = []
        for tag in range(6):
            moves = [p.step[int(s)][tag] for p, s in zip(parts, at)]
            row.append((int(np.ravel_multi_index([m[0] for m in moves], sizes)), sum(m[1] << i for i, m in enumerate(moves))))
        table.append(row)
    return table


MACHINE = composed([carried(NEGATION, 3), carried(REPORT, 0), carried(TARGET, 4), followed(3)])
DENIED, REPORTED, AIMED, HIT = 1, 2, 4, 8
# One pattern per kind of anchor and mark of it; and a target that follows one.
PATTERNS = 2 * 8 + 1
FEATURES = PATTERNS + 2


@dataclass
class Grammar:
    """Lexicon and pattern weights; bounded by ``LEXICON_SIZE``."""

    lexicon: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: default_weights())
    scale: np.ndarray = field(default_factory=lambda: np.ones(FEATURES))
    known: dict[str, tuple[int, float]] = field(default_factory=dict)

    def tag(self, word: str) -> tuple[int, float]:
        """Tag and weight of a word: its own entry, or that of its longest stem."""
        weight = self.lexicon.get(word + "$")
        for size in reversed(STEMS):
            if weight is None and len(word) >= size:
                weight = self.lexicon.get(word[:size])
        if weight is None and word in INSULTS:
            weight = 1.0
        if weight is not None:
            return INSULT, weight
        for words, tag in ((THREATS, THREAT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT)):
            if word in words:
                return tag, 1.0
        return OTHER, 0.0

    def patterns(self, text: str | None) -> np.ndarray:
        """Damped weight of each pattern in a text, its strongest insult and its clauses with an anchor."""
        out = np.zeros(FEATURES)
        if not text:
            return out
        words = WORD.findall(text.lower())
        known = self.known
        if len(known) > 200_000:
            known.clear()
        anchored = False
        for w in set(words):
            hit = known.get(w)
            if hit is None:
                hit = known[w] = self.tag(w)
            anchored |= hit[0] in (INSULT, THREAT)
        if not anchored:
            return out
        state, strongest, clauses, here = 0, 0.0, 0, False
        for w in words:
            if w in CLAUSE_ENDS:
                clauses += here
                state, here = 0, False
                continue
            tag, weight = known.get(w) or self.tag(w)
            state, mark = MACHINE[state][tag]
            if tag == INSULT or tag == THREAT:
                out[(tag == THREAT) * 8 + (mark & 7)] += weight
                here = True
                if tag == INSULT and not mark & (DENIED | REPORTED):
                    strongest = max(strongest, weight)
            elif mark & HIT and not mark & (DENIED | REPORTED):
                out[PATTERNS - 1] += 1
        clauses += here
        out[PATTERNS], out[PATTERNS + 1] = strongest, clauses
        return np.log1p(out)

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(rows / self.scale @ self.weights[1:] + self.weights[0], -30, 30)))


def default_weights() -> np.ndarray:
    """Weights where nothing could be learned: plain and aimed patterns count, denied and reported ones do not."""
    w = np.zeros(FEATURES + 1)
    w[0] = -3.0
    for threat in (0, 1):
        for mark in range(8):
            plain = 0.0 if mark & (DENIED | REPORTED) else 2.0 + bool(mark & AIMED)
            w[1 + threat * 8 + mark] = plain * (1.5 if not threat else (1.5 if mark & AIMED else 0.2))
    w[PATTERNS] = 4.0  # a target that follows an insult or threat
    return w


def learned_lexicon(sample: DataFrame, certainty: float = CERTAINTY, size: int = LEXICON_SIZE) -> dict[str, float]:
    """Stems (4 to 10 letters) and whole words (closed by ``$``) that mark toxic texts.

    Texts that share their least five-word shingle hash are near copies and
    count once. A stem is kept when the toxic share of its texts exceeds the
    sample's by more than ``certainty`` nats of log likelihood, and the share
    itself is at least nine in ten. The statistic stands for all lexicon
    entries and is computed by Spark; at most ``size`` come to the driver.
    """
    words = F.filter(F.split(F.lower("_text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    tokens = sample.select("_label", words.alias("_w")).where(F.size("_w") > 0)
    least = F.array_min(F.transform(F.sequence(F.lit(0), F.greatest(F.size("_w") - 5, F.lit(0))),
                                    lambda i: F.xxhash64(F.slice("_w", i + 1, 5))))
    once = tokens.withColumn("_least", least).groupBy("_label", "_least").agg(F.max("_w").alias("_w"))
    stems = F.flatten(F.transform(F.array_distinct("_w"), lambda w: F.concat(
        F.array(F.concat(w, F.lit("$"))), F.transform(F.filter(F.array(*[F.lit(n) for n in STEMS]), lambda n: F.length(w) >= n),
                                                        lambda n: F.substring(w, F.lit(1), n)))))
    found = (once.select("_label", F.explode(F.array_distinct(stems)).alias("stem")).groupBy("stem")
             .agg(F.sum("_label").cast("double").alias("hits"), F.count(F.lit(1)).cast("double").alias("n")))
    base = once.agg(F.avg("_label").alias("_p")).where(F.col("_p").between(1e-9, 1 - 1e-9))
    p, h, n = F.col("_p"), F.col("hits"), F.col("n")
    share = h / n
    gain = h * F.log(share / p) + F.when(n > h, (n - h) * F.log((1 - share) / (1 - p))).otherwise(0.0)
    kept = (found.where(h >= 3).join(base, F.lit(True)).withColumn("gain", gain).where((share >= 0.9) & (F.col("gain") >= certainty))
            .orderBy(F.desc("gain"), "stem").limit(size))
    return {r["stem"]: float(np.log1p(r["hits"] / (r["n"] - r["hits"] + 1)) / np.log(10)) for r in kept.select("stem", "hits", "n").collect()}


def learned_weights(rows: np.ndarray, labels: np.ndarray, totals: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps; each label weighs as it does among all labelled rows."""
    scale = np.where(rows.max(0) > 0, rows.max(0), 1.0)
    x = np.hstack([np.ones((len(rows), 1)), rows / scale])
    seen = {y: max(1, int((labels == y).sum())) for y in (0, 1)}
    weight = np.array([totals.get(int(y), 0) / seen[int(y)] for y in labels])
    weight = weight / weight.mean()
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 0.05)
    ridge[0] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (labels - p)) - ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        w = w + step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w, scale


def fitted(docs: DataFrame, labels: DataFrame, label: str, learn: Column, key: str, text: str, per_label: int) -> Grammar:
    sample, totals = labelled_sample(docs, labels, label, learn, key, text, per_label)
    if not totals.get(0) or not totals.get(1):
        return Grammar()
    grammar = Grammar(learned_lexicon(sample))
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"_key": batch[key], "_label": batch["_label"],
                                "_f": [shared.value.patterns(t).tolist() for t in batch["_text"]]})

    kind = dict(docs.dtypes)[key]
    # Patterns of a bounded number of texts.
    rows = sample.mapInPandas(match, f"_key {kind}, _label int, _f array<double>").toPandas().sort_values("_key")
    y = rows["_label"].to_numpy(np.float64)
    if len(set(y)) < 2:
        return grammar
    grammar.weights, grammar.scale = learned_weights(np.array(rows["_f"].tolist()), y, totals)
    return grammar


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, fold: int = 0, key: str = "doc_id",
                    text: str = "text", per_label: int = SAMPLE_PER_LABEL, threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``; every row and column kept, nothing shuffled.

    Learned from at most ``per_label`` texts of each label outside the held-out
    fold. A null or empty text has no clause and gets the score of a text
    without patterns; a null key is not held out; without labels of both kinds
    the fixed lexicon and weights score alone; rows with equal text get equal
    scores; an empty table gives an empty one. Columns of ``docs`` called like
    a new one are replaced.
    """
    grammar = fitted(docs, labels, label, ~held_out(F.col(key), folds, fold), key, text, per_label)
    grammar.known = {}
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        model = shared.value
        rows = np.array([model.patterns(t) for t in texts]).reshape(len(texts), FEATURES)
        return pd.Series(model.score(rows))

    score = score.asNondeterministic()  # keeps a later filter from computing it twice
    scored = docs.withColumn("held_out", held_out(F.col(key), folds, fold)).withColumn("score", score(F.col(text)))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
