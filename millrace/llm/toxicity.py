"""Toxicity: boosted trees over dense features of a text, with isotonic calibration.

The insults that count are a fixed list and word beginnings learnt from the labelled documents. What a document's own
label taught isn't used when the trees learn from it: its fold's features come from the other folds' words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import written

#: About so many labelled documents of a label are learnt from at most; drawn by hash.
MOST = 6_000
#: Folds of the id's hash that are learnt from; the last one calibrates. Fold 0 is held out.
FOLDS = (1, 2, 3, 4)
#: Learnt word beginnings: their lengths, the toxic documents that must have one, how much likelier those must be to
#: have it than others, and how many of the most frequent ones are taken.
LENGTHS, LEAST, RATIO, LEARNT = (4, 5, 6, 7), 5, 20.0, 5_000
TREES, DEPTH, STEP = 20, 3, 0.2
SEED = 20240607
#: Words between an insult and a word of the second person that count as near; characters read at once.
NEAR, PIECE = 5, 1 << 20
#: Share of the trees' own probability in a score, so that documents in one calibrated step stay in order.
OWN = 0.001

#: Insults and words of the second person in four languages.
INSULTS = frozenset(
    """
    idiot idiots idiotic stupid moron morons moronic loser losers scum trash garbage clown clowns worthless pathetic disgusting
    dumb dumbass fool foolish imbecile cretin retard retarded jerk bastard asshole bitch whore slut pig vermin filth filthy freak
    creep liar ugly useless coward hate shit shitty crap fuck fucking damn bollocks wanker twat prick dick dickhead jackass
    dummkopf idiotisch trottel arschloch scheisse abschaum versager depp hurensohn wichser widerlich
    idiote imbécile connard connasse salope pute merde crétin abruti ordure minable
    estúpido estúpida imbécil cabrón puta mierda gilipollas pendejo basura asqueroso inútil
    """.split()
)
SECOND = frozenset("you your yours yourself yourselves u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro".split())
LOOKALIKE = str.maketrans("013457@$!|", "oieastasil")

FEATURES = (
    "words", "insults", "insult_rate", "kinds", "hidden", "hidden_rate", "near_second", "second_rate", "near_rate",
    "capital_rate", "shout_rate", "punctuation_rate", "exclaim_rate", "longest_exclaim", "masked_rate", "stretched_rate", "spaced_rate",
    "learnt", "learnt_rate", "learnt_kinds",
)
INSULT, HIDDEN, YOU, SHOUT, MASKED, STRETCHED, SINGLE, KNOWN = (1 << k for k in range(8))


#: What surrounds words.
EDGES = "".join(chr(k) for k in range(33, 192) if not chr(k).isalnum()) + "«»‘’“”„…–—¿¡"
#: Characters by class below 256: 1 large letters, 2 others, 3 signs, 4 ! and ?; all above are letters.
LARGE, SMALL, SIGN, EXCLAIM = 1, 2, 3, 4
CLASSES = np.array([0 if not chr(k).isalpha() and (k < 33 or k > 126 or chr(k).isdigit()) else EXCLAIM if chr(k) in "!?" else LARGE if chr(k).isupper() else SMALL if chr(k).isalpha() else SIGN for k in range(256)], np.uint8)
STRETCH, LONE = re.compile(r"([^\W\d_])\1\1"), re.compile(r"(?<!\S)(?:\w[\s.*-]{1,2}){2,}\w(?![^\s.,!?])")


def unmasked(word: str) -> str:
    """The insult that a disguised word stands for, or ''.

    Digits and signs that look like letters are read as those, separators within are dropped, letters that repeat three
    times or more are taken once or twice, and an asterisk stands for any letter.
    """
    low = re.sub(r"^[^\w*@$!|]+|[^\w*@$]+$", "", word.lower())
    if not low.isascii() and not any(c.isalpha() for c in low):
        return ""
    plain = re.sub(r"[.\-_~'’]", "", low).translate(LOOKALIKE)
    for k in (1, 2):
        short = re.sub(r"(.)\1{2,}", lambda m: m[1] * k, plain)
        if short in INSULTS:
            return short
    if "*" in plain and sum(c.isalpha() for c in plain) >= 2:
        for insult in INSULTS:
            if len(insult) == len(plain) and all(a in (b, "*") for a, b in zip(plain, insult, strict=True)):
                return insult
    return ""


def insult_of(word: str) -> str:
    """The insult that a word is or, up to 40 characters, stands for; else ''."""
    bare = word.strip(EDGES).lower()
    if bare in INSULTS:
        return bare
    if len(word) > 40 or bare.isalpha() and word[0] not in "*@$!|" and word[-1] not in "*@$" and not STRETCH.search(bare):
        return ""
    return unmasked(word)


class Kinds(dict):
    """A word's flags, and above them a bit for each fold that has learnt one of its beginnings; made as words come."""

    def __init__(self, lexicon: dict[str, int]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        bare = word.strip(EDGES)
        low = bare.lower()
        insult = insult_of(word)
        flags = (INSULT if insult == low else HIDDEN) if insult else 0
        if low in SECOND:
            flags |= YOU
        if bare.isalpha():
            flags |= SINGLE if len(bare) == 1 else SHOUT if bare.isupper() else 0
        elif len(bare) > 1:
            flags |= (SHOUT if word.isupper() else 0) | (MASKED if re.search(r"[^\W\d_][\d@$!|*][^\W\d_]", bare[:4096]) else 0)
        if STRETCH.search(low):
            flags |= STRETCHED
        for k in LENGTHS:
            flags |= self.lexicon.get(low[:k], 0) << 8
        self[word] = flags
        return flags


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces of about PIECE characters, cut at white space, or in a word that is longer."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            gap = re.compile(r"\s").search(text, end, end + PIECE)
            end = gap.end() if gap else end + PIECE
        yield text[at:end]
        at = end


class Reader:
    """Reads texts; lexicon has the learnt word beginnings, each with a bit for every fold that may use it."""

    def __init__(self, lexicon: dict[str, int]):
        self.kinds = Kinds(lexicon)

    def features(self, text: str, fold: int = 0) -> list[float]:
        """The dense features of a whole text, in the order of FEATURES; all zero for an empty one. fold: whose bit counts."""
        flags, insults, learnt, classes, hidden, longest = [], set(), set(), np.zeros(5, np.int64), 0, 0
        for piece in _pieces(text):
            words = piece.split()
            kind = np.fromiter(map(self.kinds.__getitem__, words), np.int32, len(words))
            known = (kind >> (8 + fold) & 1).astype(bool)
            kind = (kind & 255 | known * KNOWN).astype(np.uint8)
            insults.update(insult_of(words[k]) for k in np.flatnonzero(kind & (INSULT | HIDDEN)))
            learnt.update(words[k].strip(EDGES).lower()[:8] for k in np.flatnonzero(known))
            flags.append(kind)
            code = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
            classes += np.bincount(CLASSES[np.minimum(code, 255)], minlength=5)
            if "!!" in piece or "??" in piece or "!?" in piece or "?!" in piece:
                longest = max(longest, max(len(m) for m in re.findall(r"[!?]{2,}", piece)))
            if np.count_nonzero(kind & SINGLE) > 2:
                for m in LONE.finditer(piece):
                    joined = re.sub(r"[\s.*-]", "", m[0]).lower()[:40]
                    hits = [x for x in INSULTS if len(x) > 3 and x in joined]
                    hidden, insults = hidden + bool(hits), insults | set(hits)
        flag = np.concatenate(flags) if flags else np.zeros(0, np.uint8)
        n, chars, letters = max(1, len(flag)), max(1, int(classes.sum())), max(1, int(classes[LARGE] + classes[SMALL]))
        share = lambda bit: float(np.count_nonzero(flag & bit)) / n
        bad, you = np.flatnonzero(flag & (INSULT | HIDDEN | KNOWN)), np.flatnonzero(flag & YOU)
        near = int((np.searchsorted(you, bad + NEAR, "right") > np.searchsorted(you, bad - NEAR)).sum())
        hidden += int(np.count_nonzero(flag & HIDDEN))
        total = int(np.count_nonzero(flag & INSULT)) + hidden
        return [
            float(np.log1p(len(flag))), float(np.log1p(total)), total / n, float(len(insults)), float(np.log1p(hidden)), hidden / n,
            float(np.log1p(near)), share(YOU), near / n, float(classes[LARGE]) / letters, share(SHOUT), float(classes[SIGN] + classes[EXCLAIM]) / chars, float(classes[EXCLAIM]) / chars,
            float(np.log1p(longest)), share(MASKED), share(STRETCHED), share(SINGLE),
            float(np.log1p(np.count_nonzero(flag & KNOWN))), share(KNOWN), float(len(learnt)),
        ]


def text_features(lexicon: dict[str, int]):
    """A function of text and fold columns: the features as array<double>, zeros for null."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        reader = Reader(lexicon)
        for texts, folds in batches:
            yield pd.Series([reader.features(t, f) if t else [0.0] * len(FEATURES) for t, f in zip(texts, folds, strict=True)], texts.index)

    return read


def held_out_fold(doc_id: str | Column = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds; a null id reads as an empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def _sample(known: DataFrame, most: int) -> DataFrame:
    """At most about most rows of each label, drawn by a hash of the id; all if there are fewer. A written table."""
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two labels
    rate = F.lit(1.0)
    for label, n in counts.items():
        rate = F.when(F.col("label") == label, most / max(n, most)).otherwise(rate)
    return written(known.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) / (1 << 30) < rate))


def learnt_words(rows: DataFrame) -> dict[str, int]:
    """Word beginnings that toxic documents of rows (fold, label, text) have RATIO times as often as others.

    Bit 0 of a value: it holds over all folds; bit f: it holds without fold f. A beginning counts once for each word
    that follows it in a label and fold, so what many copies of one passage have in common counts once.
    """
    size = {(r.fold, r.label): r.n for r in rows.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()}
    word = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    pair = F.zip_with("words", F.slice("words", F.lit(2), F.size("words")), lambda w, after: F.struct(w.alias("w"), F.xxhash64(after).alias("after")))
    each = rows.select("fold", "label", word.alias("words")).select("fold", "label", F.explode(pair).alias("p")).distinct()
    parts = F.array(*(F.when(F.length("p.w") >= k, F.substring("p.w", 1, k)) for k in LENGTHS))
    each = each.select("fold", "label", "p.after", F.explode(F.array_compact(parts)).alias("part")).distinct()
    counts = each.groupBy("part").agg(*(F.count(F.when((F.col("fold") == f) & (F.col("label") == y), 1)).alias(f"n{f}{y}") for f in FOLDS for y in (0, 1)))
    mask = F.lit(0)
    for bit in (0, *FOLDS):
        used = [f for f in FOLDS if f != bit]
        toxic, other = (reduce(Column.__add__, (F.col(f"n{f}{y}") for f in used)) for y in (1, 0))
        n, m = (max(1, sum(size.get((f, y), 0) for f in used)) for y in (1, 0))
        mask = mask + F.when((toxic >= LEAST) & (toxic / n >= RATIO * (other + 0.5) / m), 1 << bit).otherwise(0)
    toxic = reduce(Column.__add__, (F.col(f"n{f}1") for f in FOLDS))
    best = counts.select("part", mask.alias("mask"), toxic.alias("toxic")).where("mask > 0").orderBy(F.desc("toxic"), "part").limit(LEARNT)
    return {r.part: r.mask for r in best.collect()}  # LEARNT rows at most


class Toxicity:
    """Words, trees and their calibration, learnt from rows (fold, label, text); a constant score if a label is missing.

    The trees are fitted on all but the last fold and calibrated on that; where that lacks a label, on the others again.
    """

    def __init__(self, rows: DataFrame):
        self.trees: GBTClassificationModel | None = None
        self.steps: IsotonicRegressionModel | None = None
        self.lexicon: dict[str, int] = {}
        fits = rows.where(F.col("fold") != FOLDS[-1])
        seen = {r.label for r in fits.select("label").distinct().collect()}
        self.constant = float(1 in seen)
        if seen != {0, 1}:
            return
        self.lexicon = learnt_words(rows)
        read = written(rows.select("fold", "label", text_features(self.lexicon)("text", "fold").alias("x")))
        fits, last = read.where(F.col("fold") != FOLDS[-1]), read.where(F.col("fold") == FOLDS[-1])
        gbt = GBTClassifier(labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, minInstancesPerNode=3, maxBins=64, seed=SEED)
        self.trees = gbt.fit(fits.select(array_to_vector("x").alias("features"), F.col("label").cast("double")))
        both = {r.label for r in last.select("label").distinct().collect()} == {0, 1}
        self.steps = IsotonicRegression(labelCol="label", featuresCol="p").fit(self._own(last if both else fits).select("p", F.col("label").cast("double")))

    def _own(self, rows: DataFrame) -> DataFrame:
        judged = self.trees.transform(rows.withColumn("features", array_to_vector("x")))
        return judged.withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")

    def score(self, rows: DataFrame) -> DataFrame:
        """rows (text and others) with score instead of text: the calibrated probability of label 1."""
        if self.trees is None:
            return rows.withColumn("score", F.lit(self.constant)).drop("text")
        read = rows.withColumn("x", text_features(self.lexicon)("text", F.lit(0))).drop("text")
        calibrated = self.steps.setFeaturesCol("p").setPredictionCol("step").transform(self._own(read))
        mixed = (1 - OWN) * F.col("step") + OWN * F.col("p")
        return calibrated.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), mixed))).drop("x", "p", "step")


def judge(docs: DataFrame, labels: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs (doc_id, text).

    labels has doc_id and toxic (0 or 1, others and nulls are not used); of an id's several labels the mean decides, a
    half is 1. Rows in fold 0 of the id's hash are held out: nothing is learnt from them. Null texts read as empty;
    empty texts have the score of zero features. Null ids have no label. Equal texts have equal scores. Without labels,
    or with one kind of them, all scores are that label's (0 without). About most documents of a label are learnt from.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.when(F.avg("toxic") >= 0.5, 1).otherwise(0).alias("label"))
    drawn = _sample(known.where(held_out_fold() != 0), most)  # 2 * most rows of two numbers
    rows = docs.select("doc_id", held_out_fold().alias("fold"), "text")
    model = Toxicity(written(rows.join(F.broadcast(drawn), "doc_id")))
    scored = model.score(rows)
    return scored.select("doc_id", (F.col("fold") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
