"""Toxicity scores from a lexicon trie met by Levenshtein automata, read in context.

The lexicon holds a few fixed insults and the words and word stems that labelled
texts show to be toxic (log-likelihood ratio over a bounded sample).  Each word
of a text becomes a Levenshtein automaton that walks the trie, so misspelled and
inflected forms are found without listing them.  A window of words around every
match tells quotation and reporting from abuse and direct address.  A logistic
regression over these match features gives the score.

Bound of the sample: ``PER_CLASS`` labelled texts of either label, the lowest by
hash of their id; class weights restore the share of all labelled rows.

Defined results: null text counts as empty text, which gets the score of a text
without matches; without labels only the fixed insults count; a document with
several labels is toxic if one of them says so; null labels are skipped; extra
columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knockon.llm.common import is_held_out, shared_table

PER_CLASS = 2500
THRESHOLD = 0.3
#: Words on either side of a match that make up its context.
CONTEXT = 6
#: What a learned term needs: log-likelihood ratio, times its share among clean texts, and of the
#: different words that unrelated texts would have before it.
LEAST_EVIDENCE, LEAST_RATIO, LEAST_SETTINGS = 24.0, 30.0, 0.5
#: Toxic texts a learned term is in, and their share of all toxic texts of the sample.
LEAST_TEXTS, LEAST_SHARE = 6, 0.015
#: Most terms learned, and rounds of learning.
MOST_TERMS, ROUNDS = 400, 6
#: Shortest and longest stem learned.
STEMS = range(3, 9)
#: Word forms a task remembers before it starts anew.
CACHE = 400_000

#: Insults that need no labels.
INSULTS = ("clown", "disgusting", "dumbass", "idiot", "imbecile", "loser", "moron", "pathetic",
           "scum", "scumbag", "stupid", "trash", "vermin", "worthless")
#: Words that report speech.
REPORTING = frozenset("said says say quote quoted quotes called calls wrote writes claimed term word words "
                      "dijo dice sagte sagt schrieb dit écrit appelé".split())
#: Words of direct address.
ADDRESS = frozenset("you your yours u ur youre du dich dein ihr euch sie tu te toi vous votre tú ti usted".split())
#: Opening and closing quotation marks.
QUOTES = "\"“”„«»‘’'"

_WORD = re.compile(r"[^\W_]+")


def allowed_edits(term: str) -> int:
    """Edits within which a form still counts as the term."""
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


class Trie:
    """Terms by letter; a node is (children, entries (term, is a stem, weight), most edits allowed below)."""

    def __init__(self, terms: dict[tuple[str, bool], float]):
        self.root = self._node({(t, s): (t, s, w) for (t, s), w in terms.items()}, 0)
        self.near = re.compile("|".join(self._shapes(terms)) or r"(?!)")
        self.reach = max((len(t) + allowed_edits(t) for t, _ in terms), default=0) + 1

    @staticmethod
    def _shapes(terms) -> list[str]:
        """Patterns that every form within d edits of a term fits: its length, and one of d + 1 pieces of the
        term unchanged, at most d letters from its place."""
        shapes: dict[tuple[int, bool], set[str]] = {}
        for term, stem in terms:
            d = allowed_edits(term)
            cuts = [round(i * len(term) / (d + 1)) for i in range(d + 2)]
            shapes.setdefault((len(term), stem), set()).update(
                f".{{{max(0, x - d)},{x + d}}}{re.escape(term[x:y])}" for x, y in zip(cuts, cuts[1:]))
        out = []
        for (n, stem), pieces in sorted(shapes.items()):
            d = allowed_edits("x" * n)
            out.append(f"(?=.{{{n - d},{'' if stem else n + d}}}$)(?:{'|'.join(sorted(pieces))})")
        return out

    def _node(self, terms: dict, depth: int) -> tuple:
        below: dict[str, dict] = {}
        entries = []
        for key, (term, stem, weight) in sorted(terms.items()):
            if len(term) == depth:
                entries.append((term, stem, weight))
            else:
                below.setdefault(term[depth], {})[key] = (term, stem, weight)
        children = {letter: self._node(own, depth + 1) for letter, own in below.items()}
        limit = max([allowed_edits(t) for t, _, _ in entries] + [c[2] for c in children.values()], default=-1)
        return children, entries, limit

    def match(self, word: str) -> tuple[str, int, float] | None:
        """(term, edits, weight) of the nearest term, or None.

        The automaton's state after some letters of the trie is the row of edit
        distances to each prefix of the word; a branch ends when no entry can
        come back within the edits that the terms below it allow.  Letters beyond
        the longest term and its edits change neither its distance nor its stem's.
        """
        word = word[:self.reach]
        if not self.near.match(word):
            return None
        best = None
        stack = [(self.root, list(range(len(word) + 1)))]
        while stack:
            (children, entries, _), row = stack.pop()
            for term, stem, weight in entries:
                edits = min(row) if stem else row[-1]
                if edits <= allowed_edits(term) and (best is None or (edits, -weight, term) < best[0]):
                    best = (edits, -weight, term), (term, edits, weight)
            for letter, node in children.items():
                new = [row[0] + 1]
                for j, own in enumerate(word):
                    new.append(min(row[j] + (own != letter), row[j + 1] + 1, new[j] + 1))
                if min(new) <= node[2]:
                    stack.append((node, new))
        return best and best[1]


class Detector:
    """Matches of the lexicon in a text, and the features they give."""

    def __init__(self, terms: dict[tuple[str, bool], float], benign: frozenset[str] = frozenset()):
        self.terms, self.benign = dict(terms), benign
        self.trie = Trie(self.terms)
        self.cache: dict[str, tuple | None] = {}

    def __getstate__(self):
        return self.terms, self.benign

    def __setstate__(self, state):
        self.__init__(*state)

    def form(self, word: str) -> tuple[str, int, float] | None:
        try:
            return self.cache[word]
        except KeyError:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            found = None if word in self.benign or len(word) < 3 else self.trie.match(word)
            self.cache[word] = found
            return found

    def features(self, text: str | None) -> list[float]:
        """Plain matches (sum of weights, largest), near, quoted, distinct terms, density, address."""
        low = (text or "").lower()
        words = _WORD.findall(low)
        hot = {w for w in set(words) if self.form(w)}
        plain = strongest = near = quoted = address = 0.0
        terms = set()
        if hot:
            spans = [m.span() for m in _WORD.finditer(low)]
            for i, word in enumerate(words):
                if word not in hot:
                    continue
                term, edits, weight = self.form(word)
                terms.add(term)
                around = words[max(0, i - CONTEXT):i + CONTEXT + 1]
                if is_quoted(low, spans, i) or not REPORTING.isdisjoint(around):
                    quoted += weight
                elif edits:
                    near += weight / (1 + edits)
                else:
                    plain += weight
                    strongest = max(strongest, weight)
                address += not ADDRESS.isdisjoint(around)
        total = plain + near + quoted
        return [np.log1p(plain), strongest, np.log1p(near), np.log1p(quoted), np.log1p(len(terms)),
                np.log1p(100 * total / max(len(words), 1)), np.log1p(address)]


def is_quoted(text: str, spans: list[tuple[int, int]], i: int) -> bool:
    """A quotation mark opens in the words before and closes in the words after word ``i``."""
    before = text[spans[max(0, i - CONTEXT)][0]:spans[i][0]]
    after = text[spans[i][1]:spans[min(len(spans) - 1, i + CONTEXT)][1]]
    if not any(q in before for q in QUOTES) or not any(q in after for q in QUOTES):
        return False
    return bool(re.search(rf"(?:^|[^\w])[{QUOTES}]\w[^{QUOTES}]*$|[{QUOTES}]$", before)
                and re.search(rf"^[^{QUOTES}]*[{QUOTES}](?:[^\w]|$)", after))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
           limit: int) -> tuple[DataFrame, dict[int, int]]:
    """(id, label, text) of the bounded sample, and how many labelled rows each class has."""
    marked = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
              .where(F.col("id").isNotNull() & F.col("label").isNotNull() & ~is_held_out(F.col("id")))
              .groupBy("id").agg(F.max("label").alias("label")))
    counts = {r.label: r.n for r in marked.where("label in (0, 1)").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64("id", F.lit("toxicity"))
    chosen = [marked.where(F.col("label") == y).orderBy(order, "id").limit(limit) for y in (0, 1)]
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    joined = texts.join(F.broadcast(chosen[0].union(chosen[1])), "id").groupBy("id", "label").agg(
        F.max("text").alias("text"))
    return shared_table(joined, "toxicity-sample"), counts


def term_counts(texts: DataFrame) -> DataFrame:
    """(term, stem, n0, n1, settings): texts of either label with the word, or with a longer word
    from the stem, and how many different words come before it in toxic texts.

    ``settings`` is the bits set in a map of 64, so near copies of one text add nothing to it.
    """
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, before = (Counter(), Counter()), Counter()
        for batch in batches:
            for text, label in zip(batch.text, batch.label):
                words = _WORD.findall((text or "").lower())
                last = dict(zip(words[1:], words)) if label else {}
                keys: dict[tuple[str, bool], int] = {}
                for word in set(words):
                    bit = 1 << zlib.crc32(last.get(word, "").encode()) % 63
                    if len(word) >= 3:
                        keys[word, False] = bit
                    for n in STEMS:
                        if n < len(word):
                            keys[word[:n], True] = keys.get((word[:n], True), 0) | bit
                seen[label].update(keys.keys())
                if label:
                    for key, bits in keys.items():
                        before[key] |= bits
        rows = [(t, s, seen[0][t, s], n, before[t, s]) for (t, s), n in seen[1].items()]
        rows += [(t, s, n, 0, 0) for (t, s), n in seen[0].items() if (t, s) not in seen[1]]
        yield pd.DataFrame(rows, columns=["term", "stem", "n0", "n1", "settings"])
    return (texts.mapInPandas(count, "term string, stem boolean, n0 long, n1 long, settings long")
            .groupBy("term", "stem").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"),
                                         F.bit_count(F.bit_or("settings")).alias("settings")))


def telling_terms(texts: DataFrame, least: float) -> list:
    """Terms in ``least`` toxic texts with enough evidence, strongest first, then longest."""
    sizes = {r.label: r.n for r in texts.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return []
    n0, n1 = float(sizes[0]), float(sizes[1])
    share1 = F.lit(n1 / (n0 + n1))
    total = F.col("n0") + F.col("n1")
    evidence = 2 * (F.col("n1") * F.log(F.col("n1") / (total * share1))
                    + F.when(F.col("n0") > 0, F.col("n0") * F.log(F.col("n0") / (total * (1 - share1)))).otherwise(0.0))
    expected = LEAST_SETTINGS * 63 * (1 - F.exp(-F.col("n1") / 63.0))
    ratio = ((F.col("n1") + 0.5) / n1) / ((F.col("n0") + 0.5) / n0)
    return (term_counts(texts).where((F.col("n1") >= least) & (F.col("settings") >= expected))
            .withColumn("evidence", evidence).withColumn("ratio", ratio)
            .where((F.col("evidence") >= LEAST_EVIDENCE) & (F.col("ratio") >= LEAST_RATIO))
            .orderBy(F.desc("evidence"), F.desc(F.length("term")), "stem", "term").limit(MOST_TERMS).collect())


def holds_term(terms):
    """UDF: some word is a term, unedited."""
    words = {t for t, stem in terms if not stem}
    stems = {t for t, stem in terms if stem}
    lengths = sorted({len(t) for t in stems})

    @F.pandas_udf("boolean")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: any(w in words or any(w[:n] in stems for n in lengths)
                                       for w in set(_WORD.findall((t or "").lower())))).astype(bool)
    return run


def learn_terms(texts: DataFrame, fixed: dict[tuple[str, bool], float]) -> dict[tuple[str, bool], float]:
    """Toxic words and stems with their weights.

    Each round looks only at texts that hold no term yet, so a part of a known
    term, or a word that merely comes with one, gains no evidence from it.
    """
    terms: dict[tuple[str, bool], float] = {}
    least = max(LEAST_TEXTS, LEAST_SHARE * texts.where("label = 1").count())
    for _ in range(ROUNDS):
        rest = texts.where(~holds_term({**fixed, **terms})("text"))
        new: dict[tuple[str, bool], float] = {}
        for row in telling_terms(rest, least):
            if not any(t.startswith(row.term) or row.term.startswith(t) for t, _ in new):
                new[row.term, row.stem] = float(min(1.0, np.log(row.ratio) / np.log(100)))
        room = MOST_TERMS - len(terms)
        terms.update(list(new.items())[:room])  # strongest evidence first
        if not new or len(new) >= room:
            break
    return terms


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (the last is the intercept) by Newton steps with a ridge on the slopes."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (y - p)) - penalty @ beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(curve, slope)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


class ToxicityModel:
    """A detector and the regression over its features."""

    def __init__(self, detector: Detector, beta: np.ndarray):
        self.detector, self.beta = detector, beta

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.detector.features(text), self.beta[:-1]) + self.beta[-1], -30, 30))))


#: Without labels: one plain insult gives 0.6, none 0.03.
DEFAULT_BETA = np.array([1.0, 3.2, 0.5, 0.2, 0.3, 0.0, 0.3, -3.5])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", limit: int = PER_CLASS) -> ToxicityModel:
    """Learn terms, harmless look-alikes and the regression from the bounded sample."""
    fixed = {(word, False): 1.0 for word in INSULTS}
    texts, counts = sample(docs, labels, id_col, text_col, label_col, limit)
    terms = learn_terms(texts, fixed)
    if not terms and len(counts) < 2:
        return ToxicityModel(Detector(fixed), DEFAULT_BETA)
    detector = Detector({**fixed, **terms})

    @F.pandas_udf("array<string>")
    def near_forms(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: sorted(w for w in set(_WORD.findall((t or "").lower()))
                                          if (m := detector.form(w)) and m[1]))

    clean = (texts.where("label = 0").select(F.explode(near_forms("text")).alias("form"))
             .distinct())  # forms of a bounded sample of texts
    detector = Detector(detector.terms, frozenset(r.form for r in clean.collect()))

    @F.pandas_udf("array<double>")
    def feature_row(batch: pd.Series) -> pd.Series:
        return batch.map(detector.features)

    rows = texts.select("label", feature_row("text").alias("x")).collect()
    if not rows:
        return ToxicityModel(detector, DEFAULT_BETA)
    y = np.array([r.label for r in rows], float)
    used = {0: (y == 0).sum(), 1: (y == 1).sum()}
    weight = np.array([counts[int(v)] / used[int(v)] for v in y])
    weight *= len(y) / weight.sum()
    return ToxicityModel(detector, logistic(np.array([r.x for r in rows]), y, weight))


def score_column(docs: DataFrame, model: ToxicityModel, text: Column) -> Column:
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fitted = sent.value
        for texts in batches:
            yield pd.Series([fitted.score(t) for t in texts], dtype=float)
    return run(text)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", **options) -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    model = fit(docs, labels, id_col, text_col, label_col, **options)
    return (docs.select(F.col(id_col).alias("id"), score_column(docs, model, F.col(text_col)).alias("score"))
            .select("id", is_held_out(F.col("id")).alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted")))
