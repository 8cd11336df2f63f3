"""Quality by compression: zstandard dictionaries of good and bad text.

Two dictionaries are trained on labelled text, one per class. A text is cut into pieces of
``PIECE`` bytes, each compressed on its own under either dictionary, so a long text keeps the
contrast of a short one and every byte counts. How many bytes more the bad dictionary needs than
the good one, divided by the bytes of the text, is the only input of the score: logistic
regression on labelled texts that the dictionaries were not trained on calibrates it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from heliofleet.llm.linear import fit_logistic, sigmoid
from heliofleet.llm.sampling import class_share, labelled_sample
from heliofleet.llm.tables import staged

PER_CLASS = 2000       # labelled rows per class used for fitting
PIECES = 40_000        # pieces per class that a dictionary is trained on, drawn from all pieces of those rows
DICTIONARY, PIECE, LEVEL = 112_640, 256, 3
SCALE = 20             # brings differences to about one before the regression, whose ridge they meet
EMPTY = 8              # bytes added to the size that divides, so that a few letters say little


def cut(data: bytes) -> list[bytes]:
    return [data[i:i + PIECE] for i in range(0, len(data), PIECE)]


def compressors(good: bytes, bad: bytes) -> list:
    out = []
    for content in (good, bad):
        book = zstandard.ZstdCompressionDict(content)
        book.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(dict_data=book, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def difference(data: bytes, pair) -> float:
    """Compressed size under bad less that under good, per byte of the whole text; 0 for an empty one."""
    sizes = [sum(len(one.compress(piece)) for piece in cut(data)) for one in pair]
    return (sizes[1] - sizes[0]) / (len(data) + EMPTY)


def dictionary(pieces: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"".join(pieces) or b" " * 16


def _cut_batches(batches):
    for batch in batches:
        for doc_id, text, y in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "y"))):
            pieces = cut(text.encode())
            yield pa.RecordBatch.from_arrays(
                [pa.array([doc_id] * len(pieces), pa.int64()), pa.array([y] * len(pieces), pa.int32()),
                 pa.array(np.arange(len(pieces))), pa.array(pieces, pa.binary())], names=["doc_id", "y", "at", "piece"])


def _difference_batches(books):
    def run(batches):
        pair = compressors(*books)
        for batch in batches:
            values = [difference(t.encode(), pair) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(values, pa.float64())], names=["doc_id", "y", "difference"])
    return run


def fit(docs: DataFrame, labels: DataFrame, label: str, train, per_class: int = PER_CLASS):
    """``(books, weights)``: two dictionaries, and slope and intercept of the calibration.

    At most ``per_class`` labelled rows of each class are used, whole. Half of them, by hash of the id,
    are for the dictionaries (``PIECES`` pieces a class, by hash over all their pieces), half for the
    calibration; with too few rows for that, all serve both. Without both classes: ``(None, share of ones)``.
    """
    share = class_share(labels, label, train)
    half = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(2)).cast("int")
    sample = staged(labelled_sample(docs, labels, label, train, per_class).withColumn("half", half), "quality-sample")
    sizes = {(r.y, r.half): r.n for r in sample.groupBy("y", "half").agg(F.count("*").alias("n")).collect()}
    if len({y for y, _ in sizes}) < 2:
        return None, share
    halves = [sample.where(F.col("half") == h) if len(sizes) == 4 else sample for h in (0, 1)]
    pieces = halves[0].select("doc_id", "text", "y").mapInArrow(_cut_batches, "doc_id long, y int, at long, piece binary")
    books = []
    for y in (1, 0):
        drawn = pieces.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", "at", F.lit(7)), "doc_id", "at", "piece").limit(PIECES).collect()
        books.append(dictionary([bytes(r.piece) for r in sorted(drawn, key=lambda r: (r.doc_id, r.at, bytes(r.piece)))]))
    known = halves[1].select("doc_id", "text", "y").mapInArrow(_difference_batches(books), "doc_id long, y int, difference double").toPandas()
    known = known.sort_values(["doc_id", "difference"])
    y = known["y"].to_numpy(float)
    weight = np.where(y == 1, share / max(y.sum(), 1), (1 - share) / max((1 - y).sum(), 1)) * len(y)
    return books, fit_logistic(SCALE * known[["difference"]].to_numpy(), y, weight, ridge=0.05)


def _score(books, weights):
    def run(batches):
        pair = compressors(*books)
        for batch in batches:
            x = SCALE * np.array([difference(t.encode(), pair) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sigmoid(x * weights[0] + weights[1]), pa.float64())], names=["doc_id", "score"])
    return run


def score_quality(docs: DataFrame, labels: DataFrame, train, label: str = "quality",
                  doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score`` (0 to 1, higher: label 1 likelier) of every whole text.

    ``train`` maps an id column's name to the condition under which a row's label may be learned.
    Null and empty texts are scored as the empty text; repeated rows are scored each, equal texts
    equally. A very long text is compressed piece by piece to its end. Further columns of either table
    are not read, whatever their names. Without labels of both classes every text gets the share of
    ones. An empty table gives no rows.
    """
    books, weights = fit(docs, labels, label, train)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    if books is None:
        return rows.select("doc_id", F.lit(float(weights)).alias("score"))
    return rows.mapInArrow(_score(books, weights), "doc_id long, score double")
