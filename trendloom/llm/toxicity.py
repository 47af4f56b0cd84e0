"""Toxicity scores by weak supervision.

1. A bounded sample of labelled training rows (SAMPLE; rows with crc32(doc_id) mod 4 = 2 are never in it)
   teaches which word stems mark toxic texts. Samples of the same words and label count once.
2. The stems found are dealt to many lexicon voters; pattern voters look at how dense and how varied the
   marks are and at stems seen in capitals, others without any stem at shouting, repeated marks and address
   forms. Every voter votes toxic (1) or clean (-1) or abstains (0).
3. A generative label model fits, by expectation maximisation, each voter's rates of voting under either
   class. Correlations that remain within a class are estimated too, and a voter's weight is divided by
   how many voters it effectively repeats.
4. A linear (logistic) classifier learns the model's posterior labels from the voters' outputs and
   strengths. It scores all rows in one pass without a shuffle; the model is broadcast and its size is bounded by
   STEMS.

Defined results: a null or empty text has no words and gets the score of a text without marks; repeated rows
get equal scores; a text of any length is read whole; a null id is scored like any other and never trained on; with no labelled
rows only the fixed lexicon votes; an empty table gives an empty table. Other columns may have any names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_of_id, whole_row

#: Labelled rows that the model is fitted on at most, stems kept at most, and lexicon voters.
SAMPLE, STEMS, VOTERS = 20_000, 4096, 12
#: Features besides those of the lexicon voters.
PATTERNS = 8
THRESHOLD = 0.3
#: Common insults (fixed values).
LEXICON = ["clown", "disgusting", "dumb", "garbage", "idiot", "imbecile", "jerk", "loser", "moron", "pathetic", "scum", "stupid", "trash", "ugly", "worthless"]
#: Toxic samples that a stem must mark; by chance a stem of clean texts gets there with odds of about 1e-5.
LEAST = 5
#: Lengths of the stems; 0 is the whole word.
LENGTHS = (4, 5, 6, 0)
_word = re.compile(r"[^\W\d_]+")
_repeated = re.compile(r"[!?]{2}|\*{3}")
_address = re.compile(r"\b(?:you|u)(?: are|'re| r) (?:an?|so|such|the)\b|\b(?:shut up|get lost)\b", re.IGNORECASE)


def stems_of(word: str) -> set[str]:
    return {f"{word}$" if not n else word[:n] for n in LENGTHS if not n or len(word) >= n}


@dataclass
class Model:
    stems: dict[str, int]
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def features(self, text: str, memo: dict[str, int]) -> np.ndarray:
        """For each lexicon voter whether it fires; then how many voters do, marks, kinds, share and capitals; then,
        whatever the stems, shouting, repeated marks and address forms."""
        fired, marks, kinds, capitals, n, loud = np.zeros(VOTERS), 0, set(), 0, 0, 0
        for word in text.split():
            n += 1
            loud += len(word) > 2 and word.isupper()
            hit = memo.get(word, -2)
            if hit == -2:
                hit = -1
                for part in _word.findall(word):
                    for stem in stems_of(part.lower()):
                        hit = max(hit, self.stems.get(stem, -1))
                if len(memo) > 1 << 20:
                    memo.clear()
                memo[word] = hit
            if hit >= 0:
                fired[hit] = 1
                marks += 1
                kinds.add(word.lower())
                capitals += word.isupper()
        return np.concatenate([fired, [min(fired.sum(), 3), math.log1p(marks), math.log1p(len(kinds)), min(1.0, 20 * marks / max(n, 1)), min(capitals, 1), loud > 2 and 3 * loud > n, bool(_repeated.search(text)), bool(_address.search(text))]])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((x - self.mean) @ self.weights[1:] + self.weights[0], -30, 30)))


def votes_of(x: np.ndarray) -> np.ndarray:
    """Votes of all voters for each row of features. Lexicon voters only ever accuse; patterns also acquit."""
    lexicon = x[:, :VOTERS].astype(np.int8)
    some, marks, kinds, share = (x[:, VOTERS + k] for k in range(4))
    patterns = [np.where(marks > 0, 1, -1), np.where(kinds > 1, 1, np.where(marks == 0, -1, 0)), np.where(share > 0.2, 1, np.where(share == 0, -1, 0)), np.where(some > 1, 1, np.where(some == 0, -1, 0))]
    # capitals, and what does not depend on the stems, accuse or abstain
    return np.column_stack([lexicon, *[p.astype(np.int8) for p in patterns], x[:, VOTERS + 4 :].astype(np.int8)])


def label_model(votes: np.ndarray, prior: float, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the toxic class for each row, the voters' accuracies, and their weights after correlation.

    prior is the class share to begin with. Rates are smoothed by one vote of each kind for each class.
    """
    kinds = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    accused = (votes == 1).sum(axis=1) > (votes == -1).sum(axis=1)
    post = np.where(accused, 0.9, prior / 4)
    weight = np.ones(votes.shape[1])
    accuracy = np.full(votes.shape[1], 0.5)
    for k in range(rounds):
        both = np.stack([1 - post, post])
        rates = (np.einsum("cn,nmv->cmv", both, kinds) + 1) / (both.sum(axis=1)[:, None, None] + 3)
        prior = (post.sum() + 1) / (len(post) + 2)
        if k % 10 == 0:  # what correlation the class does not explain
            left = votes - np.einsum("cn,cm->nm", both, rates[:, :, 2] - rates[:, :, 0])
            spread = left.std(axis=0) + 1e-9
            rho = (left.T @ left) / max(1, len(left)) / spread[:, None] / spread[None, :]
            np.fill_diagonal(rho, 0)
            weight = 1 / (1 + np.clip(np.abs(rho), 0, 1).sum(axis=1))
        logit = math.log(prior / (1 - prior)) + np.einsum("nmv,mv,m->n", kinds, np.log(rates[1]) - np.log(rates[0]), weight)
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        right = prior * rates[1, :, 2] + (1 - prior) * rates[0, :, 0]
        accuracy = right / np.maximum(1e-9, right + prior * rates[1, :, 0] + (1 - prior) * rates[0, :, 2])
    return post, accuracy, weight


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Newton's method for soft labels y; gives the means of x and the weights, the first for the constant."""
    mean = x.mean(axis=0)
    a = np.column_stack([np.ones(len(x)), x - mean])
    ridge = np.diag([1e-6, *[penalty] * x.shape[1]])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, w


def _signature(words: set[str]) -> int:
    """A hash of the whole set of words: texts of different words differ in it."""
    return xxhash.xxh3_64_intdigest("\n".join(sorted(words)))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """text and toxic of at most ``most`` labelled rows, those of the smallest hash; held-out rows are left out.

    The sample of labels is small by its limit, so that it is broadcast and the texts stay in place. Where ids repeat, so that more rows than that have a
    sampled label, repeated rows count once, and of those that differ the ``most`` with the smallest hash of id, label and text are taken.
    """
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.pmod(crc32_of_id(), F.lit(4)) != 2))
    sample = usable.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic")).orderBy(F.xxhash64("_id"), "_id", "_toxic").limit(most)
    labelled = docs.select(F.col("doc_id").alias("_doc"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), F.col("_doc") == F.col("_id"))
    if docs.select(F.col("doc_id").alias("_doc")).join(F.broadcast(sample), F.col("_doc") == F.col("_id")).count() > most:  # reads ids only
        key = F.xxhash64("_id", "_toxic", "text").alias("_key")
        picked = labelled.select(key).distinct().orderBy("_key").limit(most)
        labelled = labelled.withColumn("_key", key).join(F.broadcast(picked), "_key", "left_semi").dropDuplicates(["_key"])
    return labelled.select("text", F.col("_toxic").alias("toxic"))


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stem, toxic or not, and signature of the text, for each stem of each text."""
    for batch in batches:
        out: dict[str, list] = {"stem": [], "toxic": [], "signature": []}
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = {w.lower() for w in _word.findall(text)}
            found = {s for w in words for s in stems_of(w)}
            out["stem"] += found
            out["toxic"] += [toxic] * len(found)
            out["signature"] += [_signature(words) >> 1] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(out["stem"], pa.string()), pa.array(out["toxic"], pa.int32()), pa.array(out["signature"], pa.int64())], ["stem", "toxic", "signature"])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    rows = training_rows(docs, labels)
    counted = (
        rows.mapInArrow(_stem_counts, "stem string, toxic int, signature long")
        .distinct()  # the same words count once for each label
        .groupBy("stem").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    )
    good = counted.where((F.col("bad") >= LEAST) & (F.col("bad") >= 0.95 * F.col("n"))).orderBy(F.desc("bad"), F.length("stem"), "stem").limit(STEMS)
    found = {r["stem"]: r["bad"] for r in good.collect()}
    # a longer stem stands for a shorter one if it explains nearly all of it; else the shorter one stands for both
    narrow = {s for s, n in found.items() if any(t != s and t.startswith(s) and m >= 0.9 * n for t, m in found.items())}
    stems: list[str] = []
    for s in sorted((found.keys() - narrow) | {f"{w}$" for w in LEXICON}, key=lambda s: (len(s), s)):
        if not any(s[:n] in stems for n in LENGTHS if n and n < len(s)):
            stems.append(s)
    model = Model({s: xxhash.xxh32_intdigest(s) % VOTERS for s in stems})

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([model.features(t, memo).tolist() for t in batch.column(0).to_pylist()], pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

    sample = rows.mapInArrow(vote, "x array<double>, toxic int").toPandas()
    if len(sample):
        x = np.array(sample["x"].tolist())
        post, _, _ = label_model(votes_of(x), float(np.clip(sample["toxic"].mean(), 0.01, 0.5)))
    else:  # nothing to learn from: the words of the fixed lexicon against texts without marks
        x = np.repeat([*[np.zeros(VOTERS + PATTERNS)] * len(LEXICON), *[model.features(w, {}) for w in LEXICON]], 20, axis=0)
        post = np.repeat([0.0, 1.0], len(x) // 2)
    model.mean, model.weights = logistic(x, post)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """row (all columns of docs as one) and score (double, 0 to 1) for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo: dict[str, int] = {}
        for batch in texts:
            m = shared.value
            x = [m.features(t or "", memo) for t in batch.to_pylist()]
            yield pa.array(m.score(np.array(x)) if x else np.zeros(0))

    udf = F.arrow_udf(run, "double")
    return docs.select(whole_row(docs), udf("text").alias("score"))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels)).select("row.doc_id", "score")
    return scored.select(F.col("doc_id").cast("long"), (F.pmod(crc32_of_id(), F.lit(4)) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score below the threshold, with the columns of docs."""
    return score(docs, fit(docs, labels)).where(F.col("score") < THRESHOLD).select("row.*")
