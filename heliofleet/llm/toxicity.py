"""Toxicity by weak supervision.

1. Words and word beginnings that mark labelled toxic texts are mined from a bounded sample.
2. They are dealt into lexicons and patterns, each of them a voter: toxic, clean or no opinion.
3. A generative label model estimates by expectation-maximisation how often each voter votes either way
   given the hidden label, then the voters' correlations given the posterior; a voter that repeats others
   counts for less, and the model is fitted again. It sees votes alone: no text's own label takes part,
   and every text starts from the same prior, the share of toxic rows in the sample.
4. A linear classifier on the mined features learns the posterior labels, and scores every text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from heliofleet.llm.linear import fit_logistic, sigmoid
from heliofleet.llm.sampling import class_share, labelled_sample
from heliofleet.llm.tables import staged
from heliofleet.llm.words import ROW_BYTES, blocks, split_words

PER_CLASS = 5000       # labelled rows per class used for fitting
FEATURES = 1000        # mined words and beginnings: size of the classifier, which bounds the driver's matrix; texts are read whole
LEXICONS = 6           # word voters; as many pattern voters
LEAST_SUPPORT = 3
BEGINNINGS = (4, 5, 6, 7, 8)
_TRIM = re.compile(r"^[\W_]+|[\W_]+$")


def _kinds(word: str) -> list[str]:
    """The word and its beginnings, without marks at its ends."""
    plain = _TRIM.sub("", word)
    if not plain:
        return []
    return ["w:" + plain] + [f"p{n}:" + plain[:n] for n in BEGINNINGS if len(plain) > n]


def _hits(block: pa.RecordBatch, wanted: dict | None):
    """(row, feature) of each distinct feature of each text; with ``wanted``, as numbers and only those."""
    words = split_words(block.column("text"), lower=True)
    names: dict = {} if wanted is None else wanted
    owners, ids = [], []
    for code, word in enumerate(words.vocab.to_pylist()):
        for kind in _kinds(word):
            if wanted is None:
                owners.append(code)
                ids.append(names.setdefault(kind, len(names)))
            elif kind in wanted:
                owners.append(code)
                ids.append(wanted[kind])
    owners, ids = np.array(owners, np.int64), np.array(ids, np.int64)
    if not len(owners) or not len(words.codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), names
    starts = np.searchsorted(owners, np.arange(len(words.vocab) + 1))
    counts = np.diff(starts)
    some = counts[words.codes] > 0
    codes, rows = words.codes[some], words.rows[some]
    pairs = np.unique(rows * len(words.vocab) + codes)
    rows, codes = pairs // len(words.vocab), pairs % len(words.vocab)
    each = counts[codes]
    ends = np.cumsum(each)
    take = np.repeat(starts[codes] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)
    found = np.unique(np.repeat(rows, each) * len(names) + ids[take])
    return found // len(names), found % len(names), names


def _count(batches):
    for batch in batches:
        for block in blocks(batch, "text", ROW_BYTES):
            y = block.column("y").to_numpy()
            rows, ids, names = _hits(block, None)
            toxic = np.bincount(ids[y[rows] == 1], minlength=len(names))
            clean = np.bincount(ids[y[rows] == 0], minlength=len(names))
            yield pa.RecordBatch.from_arrays([pa.array(list(names), pa.string()), pa.array(toxic), pa.array(clean)], names=["feature", "toxic", "clean"])


def _collect_hits(wanted: dict):
    def run(batches):
        for batch in batches:
            for block in blocks(batch, "text", ROW_BYTES):
                rows, ids, _ = _hits(block, wanted)
                cuts = np.searchsorted(rows, np.arange(block.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("y"), lists], names=["doc_id", "y", "hits"])
    return run


def voters(x: np.ndarray, kinds: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Votes (1 toxic, 0 clean, -1 none) of each text: lexicons, patterns, counts and absences."""
    votes = []
    for kind in (0, 1):
        own = np.flatnonzero(kinds == kind)
        for k in range(LEXICONS):
            some = x[:, own[k::LEXICONS]].any(axis=1) if len(own) else np.zeros(len(x), bool)
            votes.append(np.where(some, 1, -1))
        any_ = x[:, own].any(axis=1) if len(own) else np.zeros(len(x), bool)
        votes.append(np.where(any_, -1, 0))  # nothing of this kind at all
    number, strength = x.sum(axis=1), x @ odds
    votes.append(np.where(number >= 2, 1, np.where(number == 0, 0, -1)))
    votes.append(np.where(number >= 5, 1, -1))
    votes.append(np.where(strength >= np.median(strength[strength > 0]) if (strength > 0).any() else False, 1, -1))
    votes.append(np.where(strength < 4, 0, -1))
    return np.stack(votes, axis=1)


def label_model(votes: np.ndarray, prior: float, rounds: int = 40):
    """Posterior of the toxic label for each text.

    ``prior`` is the chance of any text being toxic before the votes. Returns (posterior, vote probabilities, discounts).
    """
    n, m = votes.shape
    seen = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    value = np.where(votes == -1, 0, 2 * votes - 1).astype(float)
    chance = np.empty((2, m, 3))

    def correlations(rest):
        spread = np.sqrt((rest ** 2).mean(axis=0)) + 1e-9
        return (rest.T @ rest) / n / np.outer(spread, spread)

    # to begin with, voters that repeat each other outright share one voice
    discount = 1 / np.clip((correlations(value - value.mean(axis=0)) ** 2).sum(axis=1), 1, None)
    for turn in range(2):
        chance[1] = np.array([0.5, 0.1, 0.4])
        chance[0] = np.array([0.5, 0.4, 0.1])
        for _ in range(rounds):
            odds = np.log(prior / (1 - prior)) + (seen * np.log(chance[1] / chance[0])).sum(axis=2) @ discount
            post = sigmoid(odds)
            for c, p in ((1, post), (0, 1 - post)):
                chance[c] = (np.einsum("n,nmv->mv", p, seen) + 0.5) / (p.sum() + 1.5)
        if turn:
            break
        # correlations of the votes given the label: what the votes share beyond it
        mean = {c: chance[c] @ np.array([0.0, -1.0, 1.0]) for c in (0, 1)}
        rest = value - (post[:, None] * mean[1] + (1 - post[:, None]) * mean[0])
        discount = 1 / np.clip(np.abs(correlations(rest)).sum(axis=1), 1, None)
    return post, chance, discount


def fit(docs: DataFrame, labels: DataFrame, label: str, train, per_class: int = PER_CLASS):
    """Mined features and their weights: ``(names, weights)``; names are empty without labels of both classes."""
    share = class_share(labels, label, train)
    sample = staged(labelled_sample(docs, labels, label, train, per_class), "toxicity-sample")
    sizes = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return {}, np.array([np.log(share / (1 - share))])
    odds = (F.log((F.col("toxic") + 0.5) / (sizes[1] + 1)) - F.log((F.col("clean") + 2) / (sizes[0] + 1)))
    mined = (sample.mapInArrow(_count, "feature string, toxic long, clean long").groupBy("feature")
             .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(F.col("toxic") >= LEAST_SUPPORT)
             .withColumn("odds", odds).where("odds >= 2.5")
             .orderBy(F.desc(F.col("odds") * F.log1p("toxic")), "feature").limit(FEATURES).toPandas())
    if not len(mined):
        return {}, np.array([np.log(share / (1 - share))])
    names = {f: i for i, f in enumerate(mined["feature"])}
    found = sample.mapInArrow(_collect_hits(names), "doc_id long, y int, hits array<int>").toPandas().sort_values("doc_id")
    x = np.zeros((len(found), len(names)), np.float32)
    for i, hits in enumerate(found["hits"]):
        x[i, np.asarray(hits, int)] = 1
    y = found["y"].to_numpy()
    kinds = np.array([0 if f.startswith("w:") else 1 for f in names])
    votes = voters(x, kinds, mined["odds"].to_numpy())
    post, _, _ = label_model(votes, (y == 1).mean())
    # the posterior's classes, not the labels', are brought to their shares of the corpus
    weight = (post * share / post.sum() + (1 - post) * (1 - share) / (1 - post).sum()) * len(post)
    return names, fit_logistic(x, post, weight, ridge=0.5, steps=10)


def _score(names: dict, weights: np.ndarray, whole: bool):
    def run(batches):
        for batch in batches:
            for block in blocks(batch, "text", ROW_BYTES):
                total = np.full(block.num_rows, weights[-1])
                if names:
                    rows, ids, _ = _hits(block, names)
                    total += np.bincount(rows, weights[ids], minlength=block.num_rows)
                keep = block.schema.names if whole else ["doc_id"]
                yield pa.RecordBatch.from_arrays([*(block.column(n) for n in keep), pa.array(sigmoid(total))], names=[*keep, "score"])
    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, train, label: str = "toxic",
                   doc_id: str = "doc_id", text: str = "text", carry: tuple = ()) -> DataFrame:
    """``doc_id``, the columns named in ``carry`` and ``score`` (0 to 1, higher: label 1 likelier) of every whole text.

    ``train`` maps an id column's name to the condition under which a row's label may be learned.
    Null and empty texts have no features and get the base score; repeated rows are scored each, equal texts
    equally. A very long text is read in parts to its end. Further columns are not read, whatever their names.
    Without labels of both classes every text gets the share of ones. An empty table gives no rows.
    """
    names, weights = fit(docs, labels, label, train)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
                       *(F.col(c).alias(f"c_{c}") for c in carry))
    kinds = "".join(f"`c_{c}` {docs.schema[c].dataType.simpleString()}, " for c in carry)
    scored = rows.mapInArrow(_score(names, weights, bool(carry)), f"doc_id long, {'text string, ' if carry else ''}{kinds}score double")
    return scored.select("doc_id", *(F.col(f"c_{c}").alias(c) for c in carry), "score")
