"""Toxicity by a weighted finite-state grammar: transducers for insult, threat, target, negation and reported speech are
composed, and the clauses that they match are scored."""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchspark.llm.common import append_arrow, crc_of_id, hash_sample, strings, table

#: Labelled rows that the lexicon and the weights are learned from.
TRAIN_ROWS = 12_000

# Closed word classes of the grammar, in the languages at hand.
TARGETS = {"you", "your", "youre", "he", "she", "they", "them", "him", "her", "du", "dich", "dir", "ihr", "euch", "sie", "tu", "toi", "te", "vous", "ils", "elle", "tú", "usted", "ustedes", "ellos", "ella"}
NEGATIONS = {"not", "no", "never", "isnt", "arent", "nicht", "kein", "keine", "nie", "pas", "jamais", "non", "nunca", "jamás"}
REPORTS = {"said", "says", "called", "quoted", "wrote", "claimed", "sagte", "nannte", "schrieb", "disait", "appelé", "écrit", "dijo", "llamó", "escribió"}
THREATS = {"kill": 2.0, "hurt": 1.5, "destroy": 1.0, "töten": 2.0, "tuer": 2.0, "matar": 2.0}

WORD = re.compile(r"[^\W\d_]+")
BREAK = re.compile(r"[.!?;:\n]")
SHORTEST, LONGEST = 3, 9


class Transducer:
    """States count down the words for which a trigger still acts; ``step`` gives the next state and the factor on a hit."""

    def __init__(self, trigger: str, reach: int, factor: float):
        self.trigger, self.reach, self.factor = trigger, reach, factor

    def step(self, state: int, symbol: str) -> tuple[int, float]:
        if symbol == self.trigger:
            return self.reach, 1.0
        return max(0, state - 1), self.factor if state else 1.0


class Grammar:
    """The composition of the context transducers over the alphabet I(nsult) H(threat) T(arget) N(egation) R(eport) o(ther).

    A clause's words pass through all components at once: an insult or threat emits its weight times the factors of the
    states that the context has left the components in. A target after the insult counts as well (read backwards).
    """

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon  # "=word" whole words, "stem" word beginnings
        self.parts = [Transducer("T", 5, 1.5), Transducer("N", 3, 0.2), Transducer("R", 8, 0.4)]
        self.table: dict[tuple[tuple[int, ...], str], tuple[tuple[int, ...], float]] = {}
        self.finder = ahocorasick.Automaton()
        for term in [*lexicon, *("=" + w for w in THREATS)]:
            self.finder.add_word(term.lstrip("="), True)
        self.finder.make_automaton()

    def __getstate__(self):
        return self.lexicon

    def __setstate__(self, lexicon):
        self.__init__(lexicon)

    def weight(self, word: str) -> float:
        """The weight of the most specific entry: the whole word, else its longest known beginning."""
        if "=" + word in self.lexicon:
            return self.lexicon["=" + word]
        for k in range(min(len(word), LONGEST), SHORTEST - 1, -1):
            if word[:k] in self.lexicon:
                return self.lexicon[word[:k]]
        return 0.0

    def symbol(self, word: str) -> tuple[str, float]:
        w = self.weight(word)
        if w > 0:
            return "I", w
        if word in THREATS:
            return "H", THREATS[word]
        return ("T" if word in TARGETS else "N" if word in NEGATIONS else "R" if word in REPORTS else "o"), 0.0

    def _move(self, state: tuple[int, ...], symbol: str) -> tuple[tuple[int, ...], float]:
        key = (state, symbol)
        if key not in self.table:
            steps = [p.step(s, symbol) for p, s in zip(self.parts, state)]
            self.table[key] = tuple(s for s, _ in steps), float(np.prod([f for _, f in steps]))
        return self.table[key]

    def clause(self, words: list[str]) -> tuple[float, list[str]]:
        """The heaviest match of a clause and the matched words; bare threats without a target do not count."""
        marks = [self.symbol(w) for w in words]
        state, total, found = (0,) * len(self.parts), 0.0, []
        for i, (symbol, w) in enumerate(marks):
            before = state[0]
            state, factor = self._move(state, symbol)
            if symbol in "IH":
                follows = any(s == "T" for s, _ in marks[i + 1 : i + 4])
                if symbol == "H" and not (before or follows):
                    continue
                total = max(total, w * factor * (1.5 if follows and not before else 1.0))
                found.append(words[i])
        return total, found

    def features(self, text: str) -> list[float]:
        """Strongest clause, logarithm of the sum over clauses, distinct matched words, matches per word of the text."""
        low = text.lower()
        best, total, found, size, done = 0.0, 0.0, [], 0, -1
        for end, _ in self.finder.iter(low):
            if end < done:
                continue
            lo = max((low.rfind(c, 0, end) for c in ".!?;:\n"), default=-1) + 1
            stop = BREAK.search(low, end)
            done = stop.start() if stop else len(low)
            score, words = self.clause(WORD.findall(low, max(lo, 0), done))
            if words:
                best, total = max(best, score), total + score
                found += words
        if found:
            size = low.count(" ") + 1
        return [best, float(np.log1p(total)), float(np.log1p(len(set(found)))), 10 * len(found) / max(size, 10)]


class ToxicityModel:
    def __init__(self, grammar: Grammar | None, beta: np.ndarray | None, prior: float = 0.0):
        self.grammar, self.beta, self.prior = grammar, beta, prior

    def score(self, text: str) -> float:
        if self.beta is None:
            return self.prior
        z = float(np.dot(self.beta, [*self.grammar.features(text), 1.0]))
        return 1 / (1 + float(np.exp(-min(max(z, -30.0), 30.0))))


def learn_lexicon(train: DataFrame, least_share: float = 0.01, least_odds: float = 1.8, prior_rows: float = 12.0) -> dict[str, float]:
    """Log-odds weights of words and word beginnings that stand in more toxic than clean texts.

    ``train`` has ``t`` (text) and ``y``. Terms are counted once per text and summed by Spark; only terms in at least
    ``least_share`` of the toxic texts are returned to the driver, at most (terms per text / least_share) of them. A term's
    odds are shrunk as if ``prior_rows`` more rows of the usual mixture held it.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("t"), F.lit(r"\p{L}+"), F.lit(0)))
    stems = F.flatten(F.transform(F.filter("w", lambda w: F.length(w) > SHORTEST), lambda w: F.transform(F.sequence(F.lit(SHORTEST), F.least(F.length(w) - 1, F.lit(LONGEST))), lambda k: F.substring(w, F.lit(1), k))))
    terms = F.array_distinct(F.concat(F.transform("w", lambda w: F.concat(F.lit("="), w)), stems))
    n1, n = train.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("*")).first()
    if not n1 or n1 == n:
        return {}
    base = n1 / n
    counts = train.select("y", words.alias("w")).select("y", F.explode(terms).alias("term")).groupBy("term").agg(F.sum("y").alias("n1"), F.count("*").alias("n"))
    share = (F.col("n1") + prior_rows * base) / (F.col("n") + prior_rows)
    odds = F.log(share / (1 - share)) - F.lit(float(np.log(base / (1 - base))))
    rows = counts.filter(F.col("n1") >= max(3.0, least_share * n1)).select("term", odds.alias("w")).filter(F.col("w") > least_odds).collect()
    return {r["term"]: round(r["w"], 4) for r in rows}


def fit_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", train_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Lexicon and clause weights from about ``train_rows`` labelled rows (a documented bound, chosen by a hash of the id and
    broadcast to the documents). The lexicon is learned on two thirds of them, the weights of its features on the others, so
    that chance words of the lexicon do not count as evidence. Without rows of both classes all scores are the label's mean."""
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y"))
    chosen = hash_sample(known, train_rows, "i", known.count())
    train = docs.select(F.col(doc_id).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(chosen), "i")
    part = F.pmod(F.xxhash64("i", F.lit("fold")), F.lit(3))
    lexicon = learn_lexicon(train.filter(part != 0))
    grammar = Grammar(lexicon)

    def features(column):
        got = np.array([grammar.features(t) for t in strings(column)]).reshape(-1, 4)
        return tuple(pa.array(got[:, k]) for k in range(4))

    rows = append_arrow(train.filter(part == 0), ["t"], {f"f{k}": "double" for k in range(4)}, features, keep=["i", "y"]).orderBy("i").toPandas()
    y = rows["y"].to_numpy(float)
    if len(y) == 0 or y.min() == y.max():
        return ToxicityModel(None, None, float(y.mean()) if len(y) else 0.0)
    x = np.column_stack([rows[[f"f{k}" for k in range(4)]].to_numpy(), np.ones(len(y))])
    beta = np.zeros(5)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (p - y) + 0.05 * beta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(5), g)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return ToxicityModel(Grammar(lexicon), beta)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``toxicity_score`` in [0, 1].

    Defined results: NULL, empty or wordless text matches no clause and gets the score of the bias; equal texts get equal
    scores; other columns are carried on, one of the name ``toxicity_score`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a lexicon bounded by least_share

    def score(column):
        return (pa.array([shared.value.score(t) for t in strings(column)], pa.float64()),)

    return append_arrow(docs, [text], {"toxicity_score": "double"}, score, keep)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document, learned from four fifths of the labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = crc_of_id() % 5 == 0
    model = fit_toxicity(docs, labels.filter(~held))
    return score_toxicity(docs, model, keep=["doc_id"]).select("doc_id", held.alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= 0.5).cast("int").alias("predicted"))
