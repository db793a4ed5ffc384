"""Language identification in two steps: family, then one-versus-one linear SVMs inside it.

Features are hashed byte n-grams (1 to 3, over lower-cased letters with single
blanks between words) of the whole text, square-rooted and normalised.  A
linear classifier names the language family; one linear SVM for each pair of
languages of that family votes for the language.

The classifiers are fitted on a bounded sample: at most ``PER_LANGUAGE``
labelled texts of each language, the lowest by hash of their id.  Each machine is
trained by a task of its own; only names and weights reach the driver.

Defined results: ``und`` with score 0 for null texts, texts without a letter,
and all texts if nothing is labelled; rows with a null label are not learned
from; repeated ids count once in the sample; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from knockon.llm.common import is_held_out, shared_table

UNDETERMINED = "und"
#: Labelled texts of one language that the classifiers learn from.
PER_LANGUAGE = 400
DIMENSIONS = 1 << 12
#: Letters of one text whose n-grams are counted at once.
COUNT_CHUNK = 1 << 20

#: Family of a language code; a language not listed is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic",
    "no": "germanic", "is": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "sk": "slavic", "bg": "slavic",
    "sr": "slavic", "hr": "slavic",
}

#: Word characters that are no letters and no decimal digits: number forms, fractions, circled numbers.
_NUMBERS = frozenset(c for c in map(chr, range(128, 0x110000)) if c.isnumeric() and not c.isdecimal() and not c.isalpha())
_BLANKS = dict.fromkeys(map(ord, _NUMBERS), " ")
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters_of(text: str | None) -> str:
    """Lower-cased letters, words parted and framed by single blanks; empty without letters."""
    low = (text or "").lower()
    if not low.isascii() and not _NUMBERS.isdisjoint(low):
        low = low.translate(_BLANKS)
    words = _NOT_LETTERS.sub(" ", low).strip()
    return f" {words} " if words else ""


def features(letters: str) -> np.ndarray:
    """Normalised square roots of the hashed n-gram counts."""
    data = np.frombuffer(letters.encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    counts = np.zeros(DIMENSIONS, np.float64)
    for at in range(0, len(data), COUNT_CHUNK):
        part = data[at:at + COUNT_CHUNK + 2]
        new = min(COUNT_CHUNK, len(data) - at)  # n-grams that start in this part
        grams = [part[:new], (part[:-1] * 257 + part[1:])[:new]]
        grams.append((part[:-2] * 66049 + part[1:-1] * 257 + part[2:])[:new])
        for order, gram in enumerate(grams):
            slot = ((gram * np.uint32(2654435761)) >> np.uint32(16) ^ np.uint32(order * 977)) % np.uint32(DIMENSIONS)
            counts += np.bincount(slot, minlength=DIMENSIONS)
    root = np.sqrt(counts)
    return root / max(np.linalg.norm(root), 1e-12)


def linear_svm(x: np.ndarray, y: np.ndarray, penalty: float = 10.0, rounds: int = 60) -> np.ndarray:
    """Weights (the last is the bias) of an L1-loss SVM, by dual coordinate descent.

    Rows with y = 0 take no part, so all machines share one feature table.  The
    classes weigh the same in total.
    """
    rows = np.flatnonzero(y)
    limit = np.where(y > 0, 1 / max((y > 0).sum(), 1), 1 / max((y < 0).sum(), 1)) * penalty * len(rows) / 2
    alpha, weights, bias = np.zeros(len(y)), np.zeros(x.shape[1], x.dtype), 0.0
    norms = np.einsum("ij,ij->i", x, x) + 1.0
    draw = np.random.default_rng(11)
    for _ in range(rounds):
        moved = 0.0
        for i in draw.permutation(rows):
            step = (1 - y[i] * (float(x[i] @ weights) + bias)) / norms[i]
            new = min(max(alpha[i] + step, 0.0), limit[i])
            if new != alpha[i]:
                change = (new - alpha[i]) * y[i]
                weights += x.dtype.type(change) * x[i]
                bias += change
                moved = max(moved, abs(change))
                alpha[i] = new
        if moved < 1e-3:
            break
    return np.append(weights, bias)


def family_of(lang: str, families: dict[str, str]) -> str:
    return families.get(lang, f"only {lang}")


def machines_of(langs: list[str], families: dict[str, str]) -> list[tuple[str | None, str, str]]:
    """(family, a, b) for each pair of languages of a family, and (None, a, b) for each pair of families."""
    within = {}
    for lang in sorted(set(langs)):
        within.setdefault(family_of(lang, families), []).append(lang)
    return [(None, a, b) for a, b in combinations(sorted(within), 2)] + [
        (f, a, b) for f in sorted(within) for a, b in combinations(within[f], 2)]


def vote(machines: dict[tuple[str, str], np.ndarray], x: np.ndarray, alone: str) -> tuple[str, float]:
    """The label with most votes (ties: larger margins, then name) and a score from 0 to 1."""
    if not machines:
        return alone, 1.0
    margin = {}
    for (a, b), w in machines.items():
        m = float(x @ w[:-1] + w[-1])
        for label, own in ((a, m), (b, -m)):
            votes, total, least = margin.get(label, (0, 0.0, np.inf))
            margin[label] = (votes + (own > 0), total + own, min(least, own))
    best = max(sorted(margin), key=lambda k: margin[k][:2])
    return best, float(1 / (1 + np.exp(-2 * np.clip(margin[best][2], -20, 20))))


class LanguageModel:
    """Family classifier and the pairwise machines inside each family."""

    def __init__(self, x: np.ndarray, langs: list[str], families: dict[str, str]):
        names = np.array(langs, dtype=object)
        family = np.array([family_of(lang, families) for lang in langs], dtype=object)
        weights = {}
        for f, a, b in machines_of(langs, families):
            of = family if f is None else names
            weights[f, a, b] = linear_svm(x, np.where(of == a, 1.0, np.where(of == b, -1.0, 0.0)))
        self._assemble(langs, families, weights)

    @classmethod
    def trained(cls, langs: list[str], families: dict[str, str], weights: dict) -> LanguageModel:
        """The model of machines that are trained already."""
        model = cls.__new__(cls)
        model._assemble(langs, families, weights)
        return model

    def _assemble(self, langs: list[str], families: dict[str, str], weights: dict) -> None:
        self.families = {(a, b): w for (f, a, b), w in weights.items() if f is None}
        self.alone = family_of(langs[0], families) if langs else None
        self.within = {}
        for lang in langs:
            own = family_of(lang, families)
            if own not in self.within:
                self.within[own] = ({(a, b): w for (f, a, b), w in weights.items() if f == own}, lang)

    def predict(self, text: str | None) -> tuple[str, float]:
        letters = letters_of(text)
        if not letters or self.alone is None:
            return UNDETERMINED, 0.0
        x = features(letters)
        family, sure = vote(self.families, x, self.alone)
        machines, alone = self.within[family]
        lang, own = vote(machines, x, alone)
        return lang, sure * own


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, limit: int) -> DataFrame:
    """(lang, text): at most ``limit`` texts with letters of each language, spread by a hash of the id.

    A cheap pass counts the labels; the hash bound it gives leaves a few rows
    over the limit, and only those are ranked.
    """
    usable = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    usable = usable.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col("id")))
    spot = F.pmod(F.xxhash64(F.col("id"), F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    near = (usable.join(F.broadcast(counts), "lang")  # one row a language
            .where(spot * F.col("n") < 2 * limit + 50)
            .groupBy("lang", "id").agg(F.max("text").alias("text")))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id", F.lit("langid")), "id")
    return near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= limit).select("lang", "text")


def train_machine(rows: pd.DataFrame) -> pd.DataFrame:
    """The weights of one machine from its rows (machine, side, lang, x), taken in the order of (lang, x)."""
    rows = rows.iloc[sorted(range(len(rows)), key=list(zip(rows["lang"], rows["x"])).__getitem__)]
    x = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(-1, DIMENSIONS)
    weights = linear_svm(x, rows["side"].to_numpy())
    return pd.DataFrame({"machine": rows["machine"].iloc[:1], "weights": [weights.astype(np.float64).tobytes()]})


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        limit: int = PER_LANGUAGE, families: dict[str, str] | None = None) -> LanguageModel:
    """Fit on the bounded sample: tasks make the features and train a machine each (26 MB of features at most
    for four languages); the driver gets the weights (33 KB a machine)."""
    families = FAMILIES if families is None else families
    rows = shared_table(labelled_sample(docs, id_col, text_col, lang_col, limit), "langid-sample")
    langs = sorted(r.lang for r in rows.select("lang").distinct().collect())
    machines = machines_of(langs, families)
    if not machines:
        return LanguageModel.trained(langs, families, {})

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: features(letters_of(t)).astype(np.float32).tobytes())

    sides = [(lang, i, side) for i, (f, a, b) in enumerate(machines) for lang in langs for name, side in ((a, 1.0), (b, -1.0))
             if (family_of(lang, families) if f is None else lang) == name]
    members = docs.sparkSession.createDataFrame(sides, "lang string, machine int, side double")
    got = (rows.select("lang", packed("text").alias("x")).join(F.broadcast(members), "lang")  # a few rows a language
           .groupBy("machine").applyInPandas(train_machine, "machine int, weights binary").collect())
    return LanguageModel.trained(langs, families, {machines[r.machine]: np.frombuffer(r.weights) for r in got})


def language_column(docs: DataFrame, model: LanguageModel, text: Column) -> Column:
    """struct(lang, score) for each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fitted = sent.value
        for texts in batches:
            yield pd.DataFrame([fitted.predict(t) for t in texts], columns=["lang", "score"])
    return run(text)


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
            **options) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score."""
    model = fit(docs, id_col, text_col, lang_col, **options)
    return (docs.select(F.col(id_col).alias("id"), language_column(docs, model, F.col(text_col)).alias("p"))
            .select("id", is_held_out(F.col("id")).alias("held_out"),
                    F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score")))


def keep_identified(docs: DataFrame, text_col: str = "text", accept: list[str] | None = None,
                    **options) -> DataFrame:
    """Rows whose language is found (and in ``accept`` if given), with all their columns.

    Without ``accept`` only ``und`` goes, and if nothing is labelled, texts without a letter.
    """
    model = fit(docs, text_col=text_col, **options)
    if accept is None and model.alone is None:
        @F.pandas_udf("boolean")
        def lettered(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: bool(letters_of(t)))
        return docs.where(lettered(F.col(text_col)))
    found = language_column(docs, model, F.col(text_col)).getField("lang")
    kept = found != UNDETERMINED if accept is None else found.isin(list(accept))
    return docs.where(kept)
