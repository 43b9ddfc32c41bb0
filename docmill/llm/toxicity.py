"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: words, and word beginnings of four to six letters, are graded by a
lower confidence bound of their share of toxic documents among the labelled ones. Features
are densities of each grade, the best grade, second-person words near lexicon words, capitals,
punctuation and obfuscation rates. Labelled documents are scored with their own counts taken
out of the lexicon. Trees are fitted on one part of them, the isotonic map on the other.

The fit uses at most ``max_labels`` labelled rows, chosen by a hash of the id; scoring covers
every document. Rows held out (``crc32(id) mod folds = 0``) are never learned from.

Edge cases: null and empty texts are scored like any other from their (zero) features; with
no labels, or labels of one kind only, every score is that kind's share (0 without labels);
with too few for a fitting and a calibration part that hold both kinds, the trees are
fitted on all of them and their raw score stands; null labels are skipped, of contradicting labels the larger counts; repeated rows are scored
each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter

import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm._common import Scratch, free_name, held, let_go, small_batches, table

GRADES = (0.8, 0.55, 0.35)
BEGINNINGS = (4, 5, 6)
# Second-person words of the corpus languages.
YOU = frozenset("you your yours u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch ti tú usted ustedes vuestro".split())
FEATURES = (
    "strong medium weak best n_strong near_you capitals shouting punctuation exclaim mixed repeats symbols log_words".split()
)
_WORD = re.compile(r"\w+")
_MIXED = re.compile(r"\b(?=\w*[a-zA-Z])(?=\w*[0-9@$*])[\w@$*]{3,}|[a-zA-Z]+[*@$#]+[a-zA-Z]+")
_REPEAT = re.compile(r"([a-zA-Z])\1\1|\b(?:[a-zA-Z][.\-_ ]){3,}[a-zA-Z]\b")
_UPPER = re.compile(r"[A-ZÄÖÜÉÈÀÑ]{2,}")
_MARK, _RUN = re.compile(r"[0-9@$*#]"), re.compile(r"[\w@$*#]*")
_SPELLED = re.compile(r"[.\-_ ][a-zA-Z][.\-_ ][a-zA-Z][.\-_ ]")


def _in_word(text: str, i: int) -> bool:
    return 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")


def count_shouting(text: str) -> int:
    """Words of two or more capitals."""
    return sum(not _in_word(text, m.start() - 1) and not _in_word(text, m.end()) for m in _UPPER.finditer(text))


def count_mixed(text: str) -> int:
    """Matches of ``_MIXED``, sought only in runs of word characters and marks that hold a digit or mark."""
    n = end = 0
    for m in _MARK.finditer(text):
        at = m.start()
        if at >= end:
            start = at
            while start > end and (text[start - 1] in "@$*#" or _in_word(text, start - 1)):
                start -= 1
            end = _RUN.match(text, at).end()
            n += len(_MIXED.findall(text[start:end]))
    return n


def count_repeats(text: str, letters: set[str]) -> int:
    """Matches of ``_REPEAT``; two cheap searches tell the texts that have none."""
    if any(3 * c in text for c in letters if c.isascii()) or _SPELLED.search(text):
        return len(_REPEAT.findall(text))
    return 0


def terms(word: str) -> list[str]:
    return [word, *(f"^{word[:k]}" for k in BEGINNINGS if len(word) > k)]


def bound(toxic: int, clean: int, z: float = 1.6) -> float:
    """Lower end of the Wilson interval of toxic / (toxic + clean)."""
    n = toxic + clean
    if n <= 0 or toxic <= 0:
        return 0.0
    p = toxic / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def features(text: str | None, grade) -> list[float]:
    """``grade`` maps lower-case words to their lower bounds."""
    text = text or ""
    words = _WORD.findall(text.lower())
    n, chars = max(1, len(words)), max(1, len(text))
    graded = grade(words)
    best = max(graded, default=0.0)
    hits = [i for i, g in enumerate(graded) if g >= GRADES[2]] if best >= GRADES[2] else []
    tiers = [0, 0, 0]
    for i in hits:
        tiers[0 if graded[i] >= GRADES[0] else 1 if graded[i] >= GRADES[1] else 2] += 1
    near = sum(any(w in YOU for w in words[max(0, i - 5) : i + 6]) for i in hits)
    strong = {words[i] for i in hits if graded[i] >= GRADES[0]}
    used = set(text)
    alphabet = set(filter(str.isalpha, used))
    upper, letters = sum(map(text.count, filter(str.isupper, used))), max(1, sum(map(text.count, alphabet)))
    marks = sum(map(text.count, ".,;:!?\"'()-"))
    return [
        tiers[0] / n, tiers[1] / n, tiers[2] / n, best, float(len(strong)), near / n,
        upper / letters, count_shouting(text) / n, marks / chars, sum(map(text.count, "!?")) / chars,
        count_mixed(text) / n, count_repeats(text, alphabet) / n, sum(map(text.count, "#*$%&@|<>")) / chars, math.log1p(len(words)),
    ]


class Grader:
    """Best lower bound of a word's terms; remembers words."""

    CACHED = 150_000

    def __init__(self, lexicon: dict[str, tuple[int, int]]):
        self.lexicon, self.known = lexicon, {}
        self.score = {t: bound(*c) for t, c in lexicon.items()}

    def __call__(self, words: list[str]) -> list[float]:
        if len(self.known) > self.CACHED:
            self.known = {}
        known, score = self.known, self.score
        for w in set(words).difference(known):
            known[w] = max(score.get(t, 0.0) for t in terms(w))
        return list(map(known.__getitem__, words))

    def without(self, toxic: int):
        """Grades as they would be had one document of that label not been counted."""
        known: dict[str, float] = {}

        def grade(word: str) -> float:
            if word not in known:
                own = [self.lexicon[t] for t in terms(word) if t in self.lexicon]
                known[word] = max((bound(a - toxic, b - 1 + toxic) for a, b in own), default=0.0)
            return known[word]

        return lambda words: list(map(grade, words))


def learn_lexicon(labelled: DataFrame, min_docs: int, lexicon_terms: int) -> dict[str, tuple[int, int]]:
    """The ``lexicon_terms`` best graded terms of (text, toxic), with their counts."""

    def run(batches):
        let_go()
        for b in batches:
            counts = (Counter(), Counter())
            for text, toxic in zip(b["text"], b["toxic"], strict=True):
                own = {t for w in set(_WORD.findall((text or "").lower())) for t in terms(w)}
                counts[int(toxic == 1)].update(own)
            names = list(counts[0].keys() | counts[1].keys())
            if names:
                yield pd.DataFrame({"term": names, "toxic": [counts[1][t] for t in names], "clean": [counts[0][t] for t in names]})

    sums = labelled.select("text", "toxic").mapInPandas(run, "term string, toxic long, clean long").groupBy("term")
    sums = sums.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where((F.col("toxic") >= min_docs) & (F.col("toxic") > F.col("clean") / 2))
    best = sums.orderBy((F.col("toxic") + 1) / (F.col("toxic") + F.col("clean") + 3), "toxic", "term", ascending=[False, False, True])
    return {r["term"]: (r["toxic"], r["clean"]) for r in best.limit(lexicon_terms).collect()}


def with_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    score_col: str = "score",
    folds: int = 5,
    max_labels: int = 20_000,
    lexicon_terms: int = 20_000,
    min_docs: int = 3,
    trees: int = 20,
    depth: int = 4,
) -> DataFrame:
    """``docs`` and the score of each row's own text."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    scratch = Scratch(docs.sparkSession)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold(F.col(id_col), folds) != 0))
    known = known.groupBy(F.col(id_col).alias("_k")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    chosen = scratch.cut(known.orderBy(F.xxhash64("_k"), "_k").limit(max_labels), "labels")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    # at most max_labels rows of two numbers: safe to broadcast
    labelled = scratch.cut(rows.join(F.broadcast(chosen), rows["_id"] == F.col("_k")).select("_id", "text", "toxic"), "labelled")
    n = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        scratch.clear()
        return docs.withColumn(score_col, F.lit(1.0 if n.get(1) else 0.0))
    grader, of_fit = Grader(learn_lexicon(labelled, min_docs, lexicon_terms)), uuid.uuid4().hex
    shape = ", ".join(f"{f} double" for f in FEATURES)

    def own(batches):
        for b in batches:
            made = [features(t, grader.without(int(y == 1))) for t, y in zip(b["text"], b["toxic"], strict=True)]
            yield pd.concat([b[["_id", "toxic"]].reset_index(drop=True), pd.DataFrame(made, columns=FEATURES, dtype=float)], axis=1)

    @F.pandas_udf("array<double>")
    def every(texts: pd.Series) -> pd.Series:
        grade = held(("grader", of_fit), lambda: grader)
        return pd.Series([features(t, grade) for t in texts])

    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    train = assemble.transform(scratch.cut(labelled.mapInPandas(own, f"_id {kind}, toxic int, {shape}"), "training")).coalesce(4)
    part = F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(3))
    model = GBTClassifier(featuresCol="features", labelCol="toxic", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=5, maxBins=64)
    kinds = {(r["fit"], r["toxic"]) for r in train.select((part != 0).alias("fit"), "toxic").distinct().collect()}
    whole = len(kinds) < 4  # too few labels for two parts with both kinds: trees on all of them, no map
    fitted = model.fit(train.where(F.lit(True) if whole else part != 0).select("features", "toxic"))
    vector, raw, extra = (free_name(docs, f"_{c}") for c in ("features", "raw", "tree"))
    fitted.setFeaturesCol(vector).setProbabilityCol(f"{extra}p").setRawPredictionCol(f"{extra}r").setPredictionCol(f"{extra}c")
    scored = lambda df: fitted.transform(df).withColumn(raw, vector_to_array(f"{extra}p")[1])
    out = scored(docs.withColumn(vector, array_to_vector(every.asNondeterministic()(F.col(text_col)))))
    level = F.col(raw)
    if not whole:
        calibration = scored(train.where(part == 0).select(F.col("features").alias(vector), "toxic")).select(raw, F.col("toxic").cast("double").alias("label"))
        iso = IsotonicRegression(featuresCol=raw, labelCol="label", predictionCol=f"{extra}i").fit(calibration)
        out, level = iso.transform(out), F.col(f"{extra}i")
    scratch.clear()
    # a thousandth of the raw score keeps the order inside a level
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), level * 0.999 + F.col(raw) * 0.001))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], score.alias(score_col))


def fold(c, folds: int):
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % folds


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, **options) -> DataFrame:
    """(id, held_out, score, predicted) of every document."""
    scored = with_scores(docs.select(id_col, text_col), labels, id_col, text_col, score_col="score", folds=folds, **options)
    return scored.select(id_col, (fold(F.col(id_col), folds) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose own text scores under a half."""
    score = free_name(docs, "_score")
    return with_scores(docs, labels, id_col, text_col, score_col=score, **options).where(F.col(score) < 0.5).drop(score)


def op5_toxicity(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
