"""Operator 4: hierarchical language identification.

A text's whole lower-cased UTF-8 bytes are counted as trigrams in 2^13 hashed places, square-rooted and scaled to unit
length. One-versus-one linear support vector machines first choose the language family; within it, one-versus-one
machines of its languages choose the language. Each machine's margin is turned into a probability by a logistic fit.

Fitting takes a sample of every language, about `per_language` of its distinct texts, chosen by a hash at a rate found by
an aggregate over the labels; features are counted on the executors. Each pair of languages is one machine. Prediction
reads every whole text, on any number of executors, and moves no rows.

Defined cases: `und` with score 1 where the text is null or has no letter; where no label was learned, every other
text gets `und` with score 0; null ids and repeated rows are predicted row by row; ties between machines go to the
language first in alphabetical order; an empty table gives an empty result. Only the named columns are read, so
further columns can't clash.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlink.llm.common import bucket, map_columns, table

PLACES = 1 << 13
PER_LANGUAGE = 500
#: Families by ISO 639-1 code; a language not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "pl", "cs", "uk", "bg", "sk", "sr", "hr", "sl"),
}
_LETTER = re.compile(r"[^\W\d_]")  # letters, and numbers that are no digits


def has_letter(text: str | None) -> bool:
    """Whether a character of Unicode's letter categories stands in the text; numbers such as ½ or Ⅷ are none."""
    return any(m.group().isalpha() for m in _LETTER.finditer(text or ""))


def family_of(lang: str) -> str:
    return next((name for name, langs in FAMILIES.items() if lang in langs), lang)


def counts(text: str) -> np.ndarray:
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8).astype(np.uint32)
    key = (b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)) * np.uint32(2654435761)
    return np.bincount(key >> np.uint32(19), minlength=PLACES)


def features(text: str) -> np.ndarray:
    x = np.sqrt(counts(text).astype(np.float32))
    return x / np.float32(np.sqrt(x @ x) or 1)


@dataclass
class Rows:
    """Feature vectors held by their places; only those of one machine are ever dense at once."""

    places: list[np.ndarray]
    n: list[np.ndarray]

    def __getitem__(self, mask: np.ndarray) -> Rows:
        at = np.flatnonzero(mask).tolist()
        return Rows([self.places[i] for i in at], [self.n[i] for i in at])

    def dense(self) -> np.ndarray:
        x = np.zeros((len(self.places), PLACES), np.float32)
        for i, (p, n) in enumerate(zip(self.places, self.n, strict=True)):
            x[i, p] = np.sqrt(n.astype(np.float32))
        return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


@dataclass
class Machine:
    """One against another: weights, bias, and the logistic fit of the margin. Positive: `one`."""

    one: str
    other: str
    weights: np.ndarray
    bias: float
    slope: float

    @classmethod
    def fit(cls, one: str, other: str, x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 80) -> Machine:
        """Squared-hinge SVM by accelerated gradient descent; both sides weigh alike. y: True for `one`."""
        sign = np.where(y, 1.0, -1.0).astype(np.float32)
        weight = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (~y).sum())).astype(np.float32)
        w, b = np.zeros(x.shape[1], np.float32), np.float32(0)
        v, c, step = w.copy(), b, np.float32(0.25)
        for k in range(rounds):
            slack = np.maximum(0, 1 - sign * (x @ v + c)) * weight * sign * 2
            new_w, new_b = v + step * (slack @ x - penalty * v), c + step * slack.sum()
            pace = np.float32(k / (k + 3))
            v, c = new_w + pace * (new_w - w), new_b + pace * (new_b - b)
            w, b = new_w, new_b
        margins, slope = (x @ w + b) * sign, 1.0
        for _ in range(25):  # Newton's method for the slope of p = 1 / (1 + exp(-slope * margin))
            p = 1 / (1 + np.exp(-np.clip(slope * margins, -30, 30)))
            slope += float((weight * margins * (1 - p)).sum() - 1e-3 * slope) / float((weight * margins**2 * p * (1 - p)).sum() + 1e-3)
            slope = min(max(slope, 0.1), 50.0)
        return cls(one, other, w, float(b), slope)


@dataclass
class Stage:
    """Machines for each pair of names, in order."""

    names: list[str]
    machines: list[Machine] = field(default_factory=list)

    @classmethod
    def fit(cls, names: list[str], x: Rows, y: np.ndarray) -> Stage:
        pairs = itertools.combinations(sorted(names), 2)
        return cls(sorted(names), [Machine.fit(a, b, x[m].dense(), y[m] == a) for a, b in pairs for m in [(y == a) | (y == b)]])

    def choose(self, x: np.ndarray) -> tuple[str, float]:
        if len(self.names) == 1:
            return self.names[0], 1.0
        votes, chance = dict.fromkeys(self.names, 0.0), dict.fromkeys(self.names, 0.0)
        for m in self.machines:
            p = 1 / (1 + np.exp(-np.clip(m.slope * (float(x @ m.weights) + m.bias), -30, 30)))
            votes[m.one if p >= 0.5 else m.other] += 1
            chance[m.one] += p
            chance[m.other] += 1 - p
        best = max(self.names, key=lambda n: (votes[n], chance[n]))
        return best, float(chance[best] / (len(self.names) - 1))


@dataclass
class Model:
    families: Stage | None
    languages: dict[str, Stage]

    @classmethod
    def fit(cls, x: Rows, langs: list[str]) -> Model:
        if not langs:
            return cls(None, {})
        y, f = np.array(langs), np.array([family_of(n) for n in langs])
        return cls(Stage.fit(sorted(set(f)), x, f), {g: Stage.fit(sorted(set(y[f == g])), x[f == g], y[f == g]) for g in sorted(set(f))})

    def predict(self, text: str | None) -> tuple[str, float]:
        if not has_letter(text):
            return "und", 1.0
        if self.families is None:
            return "und", 0.0
        x = features(text)
        group, p = self.families.choose(x)
        lang, q = self.languages[group].choose(x)
        return lang, p * q


def _featurer():
    def call(langs, texts):
        rows = [counts(t) for t in texts]
        places = [np.flatnonzero(r) for r in rows]
        return {"lang": langs, "places": [p.astype(np.int32) for p in places], "n": [r[p].astype(np.int32) for r, p in zip(rows, places, strict=True)]}

    return call


def learn(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """labelled: lang, text, both not null. About per_language distinct texts of each language reach the driver."""
    spark = labelled.sparkSession
    spread = F.pmod(F.xxhash64("text", F.lit("language")), F.lit(1 << 20))
    sizes = labelled.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect()  # a row a language
    if not sizes:
        return Model.fit(Rows([], []), [])
    rates = spark.createDataFrame([(r["lang"], int((1 << 20) * min(1.0, per_language / max(1, r["n"])))) for r in sizes], "lang string, rate long")
    sample = labelled.join(F.broadcast(rates), "lang").where(spread < F.col("rate")).select("lang", "text").distinct()
    rows = map_columns(sample, _featurer, "lang string, places array<int>, n array<int>").collect()
    rows.sort(key=lambda r: (r["lang"], r["places"], r["n"]))
    return Model.fit(Rows([np.array(r["places"], np.int32) for r in rows], [np.array(r["n"], np.int32) for r in rows]), [r["lang"] for r in rows])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    known = docs.sparkSession.sparkContext.broadcast(model)  # a machine of PLACES numbers for each pair of languages

    def make():
        guess = known.value.predict

        def call(ids, held_out, texts):
            got = [guess(t) for t in texts]
            return {"doc_id": ids, "held_out": held_out, "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

        return call

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (bucket(id_col, 4) == 2).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return map_columns(rows, make, "doc_id long, held_out boolean, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = docs.where((bucket("doc_id", 4) != 2) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text")
    return predict(docs, learn(labelled))


QUERIES = {"op4_language_id": op4_language_id}
ORACLES: dict[str, str] = {}
