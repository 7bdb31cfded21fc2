"""Operator 6, toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Three disjoint parts of the labelled training rows, by crc32 of the id, teach one thing each: a lexicon of words and
word beginnings that stand out in toxic texts, the trees over dense features of whole texts, and the calibration of
the trees' margin. The features are the lexicon's densities, how near its hits are to words of address, and the rates of
capitals, punctuation and disguised spelling. Scoring takes one pass over the texts and no shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, text_batches

#: About so many labelled rows are used to fit; of more, a fixed random part is drawn by hash of the id.
FIT_ROWS = 30_000
#: In how many toxic texts a lexicon entry must stand, and how much likelier than in clean texts it must be.
LEXICON_SUPPORT, LEXICON_ODDS = 5, 20.0
#: Hashes that decide if a row is drawn are compared with a share of this number.
_WHOLE = 1 << 53
#: Distinct words of which a worker keeps the findings between batches.
CACHE_WORDS = 400_000
PREFIXES = (3, 4, 5)
EDGE = ".,;:!?\"'()[]{}|<>«»“”„-_/\\"
#: Words of address in the four languages.
ADDRESS = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch sie ihnen tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "+": "t"})
VOWELS = str.maketrans("", "", "aeiou*#")
FEATURES = (
    "hits", "hit_density", "weight_density", "most_weight", "repeated_hits", "near_address", "address_density", "disguised_hits", "disguised_rate",
    "capital_letters", "capital_words", "exclamations", "questions", "punctuation", "drawn_out", "digits", "log_words",
)


def forms(word: str) -> list[str]:
    """What the lexicon can hold of a word: itself and its beginnings (marked ^)."""
    return [word, *("^" + word[:n] for n in PREFIXES if len(word) > n)]


@dataclass
class Lexicon:
    """Weights of word forms, and of the consonants of its whole words for words with letters blotted out."""

    weights: dict[str, float]

    def __post_init__(self) -> None:
        self.bones = {b: w for word, w in sorted(self.weights.items()) if word[0] != "^" and len(b := word.translate(VOWELS)) > 2}

    def find(self, raw: str) -> tuple[float, bool, bool, bool, bool]:
        """Of a word as written: weight, whether found only in disguise, word of address, all capitals, odd spelling."""
        word = raw.lower().strip(EDGE)
        weight = max((self.weights.get(f, 0.0) for f in forms(word)), default=0.0) if word else 0.0
        odd = any(c in "*@$#+!013457" for c in word) and any(c.isalpha() for c in word)
        disguised = False
        if odd and not weight:
            plain = word.translate(LEET)
            weight = max((self.weights.get(f, 0.0) for f in forms(plain)), default=0.0) or ("*" in word or "#" in word) * self.bones.get(word.translate(VOWELS), 0.0)
            disguised = weight > 0
        return weight, disguised, word in ADDRESS, len(word) > 2 and raw.isupper(), odd


class _Findings(dict):
    """Word to its code, a row of ``rows``; codes are shared by words with equal findings."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon, self.codes, self.rows = lexicon, {}, []

    def __missing__(self, word: str) -> int:
        found = self.lexicon.find(word)
        if found not in self.codes:
            self.codes[found] = len(self.rows)
            self.rows.append(found)
        code = self.codes[found]
        if len(self) < CACHE_WORDS:
            self[word] = code
        return code


def measure(text: str, findings: _Findings) -> list[float]:
    """The dense features of one whole text, in the order of FEATURES."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(text)
    codes = np.array([findings[w] for w in words], dtype=np.int64)
    table = np.array(findings.rows, dtype=np.float64)[codes]
    weight, disguised, address, capital, odd = table.T
    hits, calls = np.flatnonzero(weight), np.flatnonzero(address)
    near = 0
    if len(hits) and len(calls):
        at = np.searchsorted(calls, hits)
        gap = np.minimum(np.abs(calls[np.minimum(at, len(calls) - 1)] - hits), np.abs(calls[np.maximum(at - 1, 0)] - hits))
        near = int((gap <= 5).sum())
    letters = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    marks = [text.count(c) for c in "!?.,;:"]
    drawn = sum(map(text.count, ("!!", "??", "aaa", "eee", "ooo", "iii", "uuu", "...")))
    return [
        float(len(hits)), len(hits) / n, float(weight.sum()) / n, float(weight.max()), float(len(hits) - len(set(codes[hits].tolist()))), float(near), len(calls) / n, float(disguised.sum()),
        float(odd.sum()) / n, letters / size, float(capital.sum()) / n, marks[0] / size, marks[1] / size, sum(marks) / size, drawn / size, sum(map(text.count, "0123456789")) / size, math.log1p(n),
    ]


def features(docs: DataFrame, lexicon: Lexicon, keep: list[str], text_col: str = "text", within: bool = False) -> DataFrame:
    """The columns ``keep`` of each row with ``x``, the features of its text; null texts count as empty.

    ``within``: the text is a field of the first column kept and so goes to Python once only.
    """
    held = docs.sparkSession.sparkContext.broadcast(lexicon)  # words of about FIT_ROWS texts at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        findings = _Findings(held.value)
        for batch in batches:
            texts = pc.struct_field(batch.column(0), text_col) if within else batch.column(len(keep))
            rows = [measure(text.as_py() or "", findings) for text in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(rows, pa.list_(pa.float64()))], [*keep, "x"])

    text_batches(docs.sparkSession)
    kinds = dict(docs.dtypes)
    own = docs.select(*keep) if within else docs.select(*keep, F.col(text_col).cast("string"))
    return own.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", x array<double>")


def learn_lexicon(texts: DataFrame) -> Lexicon:
    """Word forms that stand out in toxic texts; ``texts`` has text and label. What is collected is bounded by these texts, about half of FIT_ROWS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [Counter(), Counter()]
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = {raw.strip(EDGE) for raw in set((text.as_py() or "").lower().split())}
                counts[label].update({form for word in words if word for form in forms(word)})
            forms_seen = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(forms_seen, pa.string()), *(pa.array([c[f] for f in forms_seen], pa.int64()) for c in counts)], ["form", "clean", "toxic"])

    sizes = dict(texts.groupBy("label").count().collect())
    clean, toxic = max(sizes.get(0, 0), 1), max(sizes.get(1, 0), 1)
    odds = (F.col("toxic") / toxic) / ((F.col("clean") + 0.5) / clean)
    counts = texts.select("text", "label").mapInArrow(run, "form string, clean long, toxic long").groupBy("form").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    best = counts.where((F.col("toxic") >= LEXICON_SUPPORT) & (odds >= LEXICON_ODDS))
    return Lexicon({row["form"]: float(row["weight"]) for row in best.select("form", F.log(odds).alias("weight")).collect()})


@dataclass
class Model:
    """What ``fit`` learned; without trees every text gets ``base``."""

    lexicon: Lexicon
    base: float
    trees: GBTClassificationModel | None = None
    curve: IsotonicRegressionModel | None = None


def _margin(df: DataFrame, trees: GBTClassificationModel) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return trees.transform(df.withColumn("features", array_to_vector("x"))).withColumn("margin", vector_to_array("rawPrediction")[1])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, seed: int = 42, id_col: str = "doc_id") -> Model:
    """Learn from labelled rows whose crc32(id as text) mod 5 is not 0; ``labels`` has the id and toxic (0 or 1).

    Null labels and ids are left out; an id with both labels is toxic. Where a part lacks one of the two classes, the model gives the share of toxic
    labels (0 without labels).
    """
    part = F.crc32(F.col(id_col).cast("string")) % 5
    known = labels.where(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull() & (part != 0)).groupBy(id_col).agg(F.max(F.col("toxic").cast("int")).alias("label"))
    total, toxic = known.agg(F.count("*"), F.sum("label")).first()
    base = float(toxic or 0) / max(total, 1)
    share = min(1.0, fit_rows / max(total, 1))
    drawn = known.where(F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(_WHOLE)) < int(share * _WHOLE)).withColumn("part", part)
    # About fit_rows rows of three numbers: small at any size of the input.
    texts = cut(docs.select(id_col, "text").join(F.broadcast(drawn), id_col).select("text", "label", "part"), "labelled")
    seen = {(row["part"], row["label"]) for row in texts.select("part", "label").distinct().collect()}
    if not {(p, y) for p in (1, 2, 3, 4) for y in (0, 1)} <= seen:
        return Model(Lexicon({}), base)
    lexicon = learn_lexicon(texts.where("part in (1, 2)"))
    rows = cut(features(texts.where("part in (3, 4)"), lexicon, ["label", "part"]), "features")
    train = rows.where("part = 3").select(array_to_vector("x").alias("features"), F.col("label").cast("double").alias("label"))
    trees = GBTClassifier(maxIter=16, maxDepth=3, stepSize=0.3, seed=seed, minInstancesPerNode=4).fit(train)
    held = _margin(rows.where("part = 4").select("x", F.col("label").cast("double").alias("label")), trees)
    curve = IsotonicRegression(featuresCol="margin").fit(held.select("margin", "label"))
    return Model(lexicon, base, trees, curve)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, text_col: str = "text", out: str = "score") -> DataFrame:
    """The columns ``keep`` of each row (its id if not given) with ``out``, from the text alone; null and empty texts, too.

    The calibrated value has steps; a hundredth of the plain logistic value of the margin orders texts within a step.
    Repeated rows stay separate, an empty table gives no rows, other columns are carried along or ignored. A very long
    text is measured whole.
    """
    keep = ["doc_id"] if keep is None else keep
    return _scored(docs, model, keep, text_col).select("row.*", F.col("score").alias(out))


def _scored(docs: DataFrame, model: Model, keep: list[str], text_col: str) -> DataFrame:
    """(row, score): the columns ``keep`` in a struct of their own, so that no name can clash."""
    row = F.struct(*keep).alias("row")
    if model.trees is None:
        return docs.select(row, F.lit(model.base).alias("score"))
    within = text_col in keep and dict(docs.dtypes)[text_col] == "string"
    rows = docs.select(row) if within else docs.select(row, F.col(text_col).alias("text"))
    rows = _margin(features(rows, model.lexicon, ["row"], text_col if within else "text", within), model.trees)
    rows = model.curve.setPredictionCol("level").transform(rows.select("row", "margin"))
    level = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("level")))
    return rows.select("row", (0.99 * level + 0.01 / (1 + F.exp(-2 * F.col("margin")))).alias("score"))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more, by a model fitted on the labelled rows among them."""
    return _scored(docs, fit(docs, labels), docs.columns, text_col).where(F.col("score") < threshold).select("row.*")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLE_SQL: dict[str, str] = {}
