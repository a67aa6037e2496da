"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from hirelake.llm.common import bounded, documents, reachable, settle

#: Labelled rows that a fit reads at most: those of the lowest hashes of doc_id.
FIT_ROWS = 20_000
#: Words that a fit adds to the lexicon at most, and what it asks of them.
LEARNED, MIN_DOCUMENTS, MIN_PRECISION, MIN_DEVIATIONS = 500, 5, 0.5, 8.0
TREES, DEPTH = 20, 4
#: Every so many-th fit row calibrates the scores instead of growing trees.
CALIBRATION_FOLDS = 4
#: Words between an insult and a second person that count as near.
NEAR = 5

INSULTS = frozenset("""
arse arsehole ass asshole bastard bitch bollocks bullshit clown coward creep cretin cunt degenerate dickhead dimwit disgusting douche
dumb dumbass dumbo dunce fool freak fuck fucker fucking garbage halfwit idiot idiotic idiots imbecile jackass jerk liar loser losers
lowlife lunatic moron moronic morons nitwit parasite pathetic pig piss prick psycho pussy repulsive retard retarded scum scumbag shit
shitty shut sicko simpleton slut stupid stupidity sucks thug trash twat twit vermin vile wanker weirdo whore worthless
abschaum arsch arschloch blöd blödmann depp dreckig dumm dummkopf fotze hurensohn idioten miststück schlampe schwachkopf trottel versager wichser
abruti batard bâtard bouffon con connard connasse crétin débile imbécile merde minable ordure pourri salaud salope
basura cabron cabrón estúpido gilipollas idiota imbecil imbécil inutil inútil mierda patético payaso perdedor puta puto
""".split()) - {"con"}  # an everyday word of another of the languages
SECOND_PERSON = frozenset("""you your yours yourself u ur thou thee du dich dir dein deine deiner euch euer ihr tu te toi ton ta tes vous votre vos
tú ti contigo tuyo usted ustedes vosotros os vuestro""".split())
_WORD = re.compile(r"[^\W_]+")
_ODD = re.compile(r"[^\s.,;:()\"]*[0-9@$*!|+][^\s.,;:()\"]*")
_LONG_RUN = re.compile(r"(.)\1{2,}")
_PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t", "*": None})
_MARKS = re.compile(r"[!?]")
_MARK_RUNS = re.compile(r"[!?]{2,}")
_CAPITALS = re.compile(r"[^\W\d_a-zß-öø-ÿ]")
FEATURES = ("insults", "insult_rate", "learned", "learned_rate", "near_second_person", "second_person_rate", "capital_rate", "shouted_rate",
            "mark_rate", "mark_run_rate", "hidden_insults", "hidden_rate", "odd_rate", "log_words")


def features(text: str, learned: frozenset[str]) -> list[float]:
    """FEATURES of a text: rates are per word (capitals per character), counts on a log scale."""
    exact = _WORD.findall(text)
    words = [w.lower() for w in exact]
    n = max(1, len(words))
    insults = [i for i, w in enumerate(words) if w in INSULTS]
    found = sum(w in learned for w in words) if learned else 0
    persons = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near = 0
    for i in insults:
        at = bisect_left(persons, i)
        near += any(abs(persons[j] - i) <= NEAR for j in (at - 1, at) if 0 <= j < len(persons))
    odd = hidden = 0
    for token in _ODD.findall(text):
        if any(c.isalpha() for c in token):
            odd += 1
            plain = token.lower().translate(_PLAIN)
            starred = token.lower().strip("*!")
            hidden += starred not in INSULTS and (plain in INSULTS or plain.rstrip("i") in INSULTS or "*" in starred.strip("!") and _starred(starred))
    stop, stretched = 0, False
    for run in _LONG_RUN.finditer(text):
        if run[1].isalpha():
            if run.start() >= stop:  # a word with several long runs is looked at once
                start, stop = run.span()
                while start and text[start - 1].isalpha():
                    start -= 1
                while stop < len(text) and text[stop].isalpha():
                    stop += 1
                stretched = _LONG_RUN.sub(r"\1", text[start:stop].lower()) in INSULTS
            hidden += stretched
    return [math.log1p(len(insults)), len(insults) / n, math.log1p(found), found / n, math.log1p(near), len(persons) / n,
            len(_CAPITALS.findall(text)) / max(1, len(text)), sum(len(w) > 2 and w.isupper() for w in exact) / n,
            len(_MARKS.findall(text)) / n, len(_MARK_RUNS.findall(text)) / n, math.log1p(hidden), hidden / n, odd / n, math.log1p(len(words))]


_SHAPES = frozenset(w[:i] + "*" * k + w[i + k:] for w in INSULTS for i in range(1, len(w)) for k in range(1, len(w) - i + 1))


def _starred(token: str) -> bool:
    """Some letters of an insult are replaced by stars, the first is not."""
    return token in _SHAPES


def in_fit(doc_id="doc_id"):
    """Rows whose labels may be learned from: crc32 of the id as text is not a multiple of 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 0


def _own_text(batch: pa.RecordBatch) -> pa.Array:
    return batch.column("text")


def _row_text(batch: pa.RecordBatch) -> pa.Array:
    return pc.struct_field(batch.column("row"), "text")


def _featured(docs: DataFrame, learned: frozenset[str], keep: tuple[str, ...], text=_own_text) -> DataFrame:
    """The columns ``keep`` of ``docs`` and features, made from the text (a null one is empty). Of the texts only what
    is kept goes back to the JVM."""
    reachable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, text):
            rows = np.array([features(t or "", learned) for t in text(batch).to_pylist()]).reshape(-1, len(FEATURES))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, len(FEATURES), dtype=np.int32)), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists], [*keep, "features"])

    schema = StructType([*(docs.schema[c] for c in keep), StructField("features", ArrayType(DoubleType()))])
    return docs.mapInArrow(run, schema).withColumn("features", array_to_vector("features"))


class ToxicityModel:
    """Fitted trees, calibration and learned words. Without examples of both classes the score is the share of label 1."""

    def __init__(self, trees, calibration, learned: frozenset[str], share: float):
        self.trees, self.calibration, self.learned, self.share = trees, calibration, learned, share

    def score(self, docs: DataFrame) -> DataFrame:
        """(doc_id, score) for each row of ``docs``: whole texts; null and empty texts too."""
        if self.trees is None:
            return documents(docs).select("doc_id", F.lit(float(self.share)).alias("score"))
        return self._scored(_featured(documents(docs), self.learned, ("doc_id",))).select("doc_id", "score")

    def filtered(self, docs: DataFrame) -> DataFrame:
        """The rows of ``docs`` whose score is under 0.5, as they were. The features travel with the rows: no join."""
        if self.trees is None:
            return docs.filter(F.lit(self.share < 0.5))
        rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
        scored = self._scored(_featured(rows, self.learned, ("row",), _row_text))
        return scored.filter("score < 0.5").select(*(F.col(f"row.`{c}`") for c in docs.columns))

    def _scored(self, featured: DataFrame) -> DataFrame:
        margins = self.trees.transform(featured).withColumn("margin", vector_to_array("rawPrediction")[1])
        return self.calibration.transform(margins).withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "score")))


def _learned_words(fit: DataFrame, share: float) -> frozenset[str]:
    """Words that occur in many more label-1 documents than chance gives; the deviations are those of a binomial."""
    words = fit.select("toxic", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("word")).filter("word <> ''")
    counted = words.groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("k")).filter(
        (F.col("k") >= MIN_DOCUMENTS) & (F.col("k") >= MIN_PRECISION * F.col("n")))
    deviation = (F.col("k") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    best = counted.select("word", deviation.alias("z")).filter(F.col("z") >= MIN_DEVIATIONS).orderBy(F.desc("z"), "word").limit(LEARNED)
    return frozenset(r["word"] for r in best.collect())


def fit_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """Fit on labelled rows of ``docs`` outside the held-out fifth, at most ``fit_rows`` of them (lowest hashes of doc_id).

    A doc_id that is labelled more than once counts as label 1 if any of its labels is 1; labels other than 0 and 1,
    and null ones, are left out. The bounded list of ids is broadcast, so no text is moved for the fit.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & in_fit()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = settle(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows), "fit-labels")
    found = documents(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    fit = settle(found, "fit-documents")
    seen = fit.agg(F.count("*").alias("n"), F.sum("toxic").alias("k")).first()
    share = (seen["k"] or 0) / max(1, seen["n"])
    if not 0 < share < 1:
        return ToxicityModel(None, None, frozenset(), share)
    learned = _learned_words(fit, share)
    rows = settle(_featured(fit, learned, ("doc_id", "toxic")), "fit-features").withColumn("label", F.col("toxic").cast("double"))
    calibrates = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(CALIBRATION_FOLDS)) == 0
    growing, held = rows.filter(~calibrates), rows.filter(calibrates)
    classes = held.agg(F.countDistinct("label")).first()[0], growing.agg(F.countDistinct("label")).first()[0]
    if classes[1] < 2:
        return ToxicityModel(None, None, frozenset(), share)
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, minInstancesPerNode=5, seed=7).fit(growing)
    margins = trees.transform(held if classes[0] == 2 else rows).select("label", vector_to_array("rawPrediction")[1].alias("margin"))
    calibration = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="score").fit(margins)
    return ToxicityModel(trees, calibration, learned, share)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from a score of 0.5), a row for each row of ``docs``.

    A null text is scored as an empty one; a null doc_id is not held out; whole texts of any length are read; repeated
    rows each get a row, and of rows that repeat a doc_id one is learned from, that of the least text hash; other columns
    are left out; empty tables give no rows.
    """
    scored = fit_toxicity(docs, labels).score(docs)
    return scored.select("doc_id", F.coalesce(~in_fit(), F.lit(False)).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
