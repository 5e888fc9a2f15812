"""Subject areas of documents: complement naive Bayes, refined by expectation-maximization, calibrated per subject.

The unit of the model is the sentence, since a note has a subject when enough of its sentences are about it. Every
sentence is a bag of hashed words and word pairs; its class is one of the subjects or none of them. Labels of a
document say which classes its sentences may have. Starting from counts over labelled documents, each round scores
all sentences of all documents with complement naive Bayes weights, restricted to the labels where there are any, and
adds up expected counts anew, unlabelled documents at a lower weight. A document's subjects follow from the share of
its sentences in each class, by a logistic curve for each subject fitted to the labelled documents.

The model is a matrix of fixed size (buckets x classes) whatever the corpus; only it and sums of its shape travel.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import forget, spread, stored

BUCKET_BITS = 17
BUCKETS = 1 << BUCKET_BITS
#: How likely none of its labels is for a sentence of a labelled document at first, against one label.
FIRST_NONE = 0.2


_MATTER = re.compile(r"\A\ufeff?\s*---[ \t]*\r?\n.*?\n(?:---|\.\.\.)[ \t]*(?=\r?\n|\Z)", re.S)
_SKIPPED = re.compile(r"^[ \t]{0,3}(?:#{1,6}[ \t]|```|~~~).*$", re.M)
_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|[.!?…](?=[\s\"'»”)])|[\n\r\v\f\x85\u2028\u2029]")
_STOP = frozenset(".!?…\n\r\v\f\x85\u2028\u2029")
#: Words remembered by a task with their hashes.
MOST_WORDS = 1_000_000


def tokens_of(text: str) -> list[str]:
    """The words of a Markdown note in lower case, and a mark (one of _STOP) wherever a sentence or line ends.

    Front matter, headings and the lines of fences themselves are left out.
    """
    return _TOKEN.findall(_SKIPPED.sub("", _MATTER.sub("", unicodedata.normalize("NFC", text), count=1)).lower())


def _word_hash(word: str) -> int:
    return -1 if word in _STOP else int.from_bytes(hashlib.blake2b(word.encode(), digest_size=4).digest(), "little") >> 1


def hashed(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of words and of pairs of adjacent words, sentence by sentence, and how many each sentence has.

    ``codes`` are hashes of words, -1 where a sentence ends.
    """
    word = codes >= 0
    sentence = np.cumsum(~word)[word]
    codes = codes[word].astype(np.uint64)
    if not len(codes):
        return np.empty(0, np.int32), np.empty(0, np.int32)
    pair = sentence[1:] == sentence[:-1]
    two = ((codes[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (codes[1:] * np.uint64(0xC2B2AE3D27D4EB4F)))[pair]
    mixed = lambda x: ((x * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
    flat, owner = np.concatenate([mixed(codes), mixed(two ^ (two >> np.uint64(29)))]), np.concatenate([sentence, sentence[1:][pair]])
    _, sizes = np.unique(owner, return_counts=True)
    return flat[np.argsort(owner, kind="stable")], sizes.astype(np.int32)


class _Hashes(dict):
    """Hashes of words, worked out when first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = code = _word_hash(word)
        return code


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = _Hashes()
    for batch in batches:
        if len(memo) > MOST_WORDS:
            memo = _Hashes()
        docs = [tokens_of(text) for text in batch.column(2).to_pylist()]
        # One run of codes for the batch; a mark between two documents ends the sentence before it.
        codes = np.concatenate([np.empty(0, np.int64), *(np.append(np.fromiter(map(memo.__getitem__, words), np.int64, len(words)), -1) for words in docs)])
        flat, sizes = hashed(codes)
        begins = (codes >= 0) & np.append(True, codes[:-1] < 0)[: len(codes)]
        ends = np.cumsum([len(words) + 1 for words in docs]).astype(np.int64)
        sentences = np.append(0, np.cumsum(begins)[ends - 1]) if len(docs) else np.zeros(1, np.int64)
        buckets = np.append(0, np.cumsum(sizes))[sentences]
        lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(buckets, flat), lists(sentences, sizes)], ["id", "mask", "flat", "sizes"])


def complement_weights(counts: np.ndarray, n_class: np.ndarray, alpha: float) -> np.ndarray:
    """Buckets x classes: minus the log probability of a bucket outside the class, centred and weighted by rarity for each bucket."""
    others = counts.sum(0, keepdims=True) - counts
    theta = (alpha + others) / (alpha * counts.shape[1] + others.sum(1, keepdims=True))
    w = -np.log(theta)
    rarity = np.log((n_class.sum() + 1) / (counts.sum(0) + 1)).clip(0) / np.log(n_class.sum() + 1)
    return np.ascontiguousarray(((w - w.mean(0, keepdims=True)) * rarity).T.astype(np.float32))


def posteriors(weights: np.ndarray, prior: np.ndarray, flat: np.ndarray, sizes: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Class probabilities of each sentence; allowed: one row of booleans for each sentence."""
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    score = np.zeros((len(sizes), weights.shape[1]), np.float64)
    full = sizes > 0
    if full.any():
        score[full] = np.add.reduceat(weights[flat], starts[full], axis=0)
    score = np.where(allowed, score + prior, -np.inf)
    score -= score.max(1, keepdims=True)
    p = np.exp(score)
    return p / p.sum(1, keepdims=True)


def _unpack(batch: pa.RecordBatch):
    """Flat buckets, sentence sizes, the document of each sentence, its number of sentences, and what its labels allow."""
    per_doc = batch.column(3).value_lengths().to_numpy(zero_copy_only=False)
    sizes = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = batch.column(2).flatten().to_numpy(zero_copy_only=False)
    mask = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
    return flat, sizes, np.repeat(np.arange(len(per_doc)), per_doc), per_doc, mask


def _allowed(mask: np.ndarray, classes: int) -> np.ndarray:
    """mask: bits of the labelled subjects, -1 without labels. The last class, none, is always allowed."""
    bits = (mask[:, None] >> np.arange(classes)) & 1
    out = (bits == 1) | (mask[:, None] < 0)
    out[:, -1] = True
    return out


def _expect(weights: np.ndarray | None, prior: np.ndarray, classes: int, unlabelled: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n_class = np.zeros((classes, BUCKETS)), np.zeros(classes)
        for batch in batches:
            flat, sizes, owner, _, mask = _unpack(batch)
            if not len(sizes):
                continue
            allowed = _allowed(mask, classes)[owner]
            if weights is None:
                p = allowed * np.where(np.arange(classes) == classes - 1, FIRST_NONE, 1.0)
                p = p / p.sum(1, keepdims=True)
            else:
                p = posteriors(weights, prior, flat, sizes, allowed)
            p = p * np.where(mask < 0, unlabelled, 1.0)[owner][:, None]
            each = np.repeat(np.arange(len(sizes)), sizes)
            for c in range(classes):
                total[c] += np.bincount(flat, weights=p[each, c], minlength=BUCKETS)
            n_class += p.sum(0)
        at = np.flatnonzero(total.sum(0) > 0)
        cols = [pa.array(np.append(at, -1).astype(np.int32))] + [pa.array(np.append(total[c][at], n_class[c])) for c in range(classes)]
        yield pa.RecordBatch.from_arrays(cols, ["bucket", *(f"n{c}" for c in range(classes))])

    return run


def _gather(docs: DataFrame, weights: np.ndarray | None, prior: np.ndarray, classes: int, unlabelled: float) -> tuple[np.ndarray, np.ndarray]:
    """Expected counts (classes x buckets) and sentences by class. One row for each bucket reaches the driver."""
    names = [f"n{c}" for c in range(classes)]
    rows = docs.mapInArrow(_expect(weights, prior, classes, unlabelled), "bucket int, " + ", ".join(f"{n} double" for n in names)).groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    at = rows["bucket"].to_numpy()
    sums = np.stack([rows[n].to_numpy() for n in names])
    counts = np.zeros((classes, BUCKETS))
    counts[:, at[at >= 0]] = sums[:, at >= 0]
    return counts, sums[:, at < 0].sum(1)


def _share(weights: np.ndarray, prior: np.ndarray, classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes, owner, per_doc, mask = _unpack(batch)
            share = np.zeros((len(per_doc), classes))
            if len(sizes):
                p = posteriors(weights, prior, flat, sizes, np.ones((len(sizes), classes), bool))
                for c in range(classes):
                    share[:, c] = np.bincount(owner, weights=p[:, c], minlength=len(per_doc)) / np.maximum(per_doc, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(per_doc.astype(np.int32)), pa.FixedSizeListArray.from_arrays(pa.array(share.ravel()), classes).cast(pa.list_(pa.float64()))], ["id", "mask", "n_sentences", "share"]
            )

    return run


def fit_curve(x: np.ndarray, y: np.ndarray, start: tuple[float, float] = (20.0, -3.4), ridge: float = 0.02, wrong: float = 0.02) -> tuple[float, float]:
    """Slope and offset of the logistic curve of y on x, drawn towards ``start`` where there are few cases.

    All cases take part. Labels may be wrong: the share of wrong ones (``wrong`` at first) is estimated with the curve by
    expectation-maximization, each label counting as the mixture of what it says and its opposite.
    """
    curve = _logistic(x, y, start, ridge)
    for _ in range(50):
        p = np.clip(1 / (1 + np.exp(-np.clip(curve[0] * x + curve[1], -500, 500))), 1e-9, 1 - 1e-9)
        agree = np.where(y > 0.5, p, 1 - p)
        flipped = wrong * (1 - agree) / (wrong * (1 - agree) + (1 - wrong) * agree)
        new = _logistic(x, y * (1 - flipped) + (1 - y) * flipped, start, ridge)
        wrong = float(np.clip(flipped.mean() if len(x) else wrong, 1e-4, 0.2))
        done = abs(new[0] - curve[0]) + abs(new[1] - curve[1]) < 1e-4
        curve = new
        if done:
            break
    return curve


def _logistic(x: np.ndarray, y: np.ndarray, start: tuple[float, float], ridge: float) -> tuple[float, float]:
    """The ridge regression behind fit_curve, by Newton steps with halving."""

    def loss(a: float, b: float) -> float:
        z = a * x + b
        return float(np.sum(np.logaddexp(0, z) - y * z) + ridge / 2 * ((a - start[0]) ** 2 + (b - start[1]) ** 2))

    a, b = start
    now = loss(a, b)
    while True:
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -500, 500)))
        w = p * (1 - p)
        g = np.array([(p - y) @ x + ridge * (a - start[0]), (p - y).sum() + ridge * (b - start[1])])
        h = np.array([[w @ (x * x) + ridge, w @ x], [w @ x, w.sum() + ridge]])
        step, size = np.linalg.solve(h, g), 1.0
        while size > 1e-6 and loss(a - size * step[0], b - size * step[1]) > now:
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
        new = loss(a, b)
        if now - new < 1e-9:  # the loss is convex and falls with every step
            return float(a), float(b)
        now = new


def assign_subjects(
    documents: DataFrame, labels: DataFrame, subjects: list[str], *, id: str, text: str, subject: str = "subject", rounds: int = 4, alpha: float = 0.05, unlabelled: float = 0.1, max_calibration: int = 50_000, least: float = 0.5
) -> DataFrame:
    """(<id>, subject, share double, probability double): each document's subjects, those of probability ``least`` and more.

    ``labels`` has <id> and the subject, one row for each; a null subject means that the document has none, unknown
    names are ignored. A document labelled several times has all the subjects it was given. All labelled documents
    train the model; the calibration curves take at most ``max_calibration`` of them, those of smallest hash. Rows with
    a null id are ignored, null and empty texts have no subject; repeated ids are judged one by one and come out once
    for each different result. Without labels or documents the result is empty. Whole texts are read, all documents
    count, whatever their language.
    """
    names = sorted(set(subjects))
    classes = len(names) + 1
    if classes > 60:
        raise ValueError("at most 59 subjects")
    spark = documents.sparkSession
    kind = documents.schema[id].dataType.simpleString()
    code = F.coalesce(F.element_at(F.create_map(*[x for k, n in enumerate(names) for x in (F.lit(n), F.lit(1 << k))]), F.lower(F.trim(F.col(subject)))), F.when(F.col(subject).isNull(), F.lit(0)))
    masks = labels.select(F.col(id).alias("id"), code.cast("long").alias("bit")).filter("id is not null and bit is not null").groupBy("id").agg(F.bit_or("bit").alias("mask"))
    rows = documents.select(F.col(id).alias("id"), F.col(text).alias("text")).filter("id is not null and text is not null")
    told = spread(rows, "id").join(masks, "id", "left").select("id", F.coalesce("mask", F.lit(-1)).alias("mask"), "text")
    docs = stored(told.mapInArrow(_features, f"id {kind}, mask bigint, flat array<int>, sizes array<int>"))
    empty = spark.createDataFrame([], f"`{id}` {kind}, subject string, share double, probability double")
    labelled = docs.filter("mask >= 0")
    prior = np.zeros(classes)
    counts, n_class = _gather(labelled, None, prior, classes, 1.0)
    if not counts.any():
        return empty
    # The first rounds settle which sentences of the labelled documents carry their labels; then all documents join in.
    for k in range(rounds + 2):
        prior = np.log((n_class + 1) / (n_class.sum() + classes))
        counts, n_class = _gather(labelled if k < 2 else docs, complement_weights(counts, n_class, alpha), prior, classes, unlabelled)
    prior = np.log((n_class + 1) / (n_class.sum() + classes))
    share_of = lambda some: some.mapInArrow(_share(complement_weights(counts, n_class, alpha), prior, classes), f"id {kind}, mask bigint, n_sentences int, share array<double>").filter("n_sentences > 0")
    known = share_of(labelled.orderBy(F.xxhash64("id")).limit(max_calibration)).select("mask", "share").toArrow()
    shares = share_of(docs)
    mask, share = known["mask"].to_numpy(), np.array(known["share"].to_pylist()).reshape(-1, classes)
    curves = [fit_curve(share[:, k], ((mask >> k) & 1).astype(float)) for k in range(classes - 1)]
    table = F.array(*[F.struct(F.lit(n).alias("subject"), F.lit(k).alias("at"), F.lit(a).alias("slope"), F.lit(b).alias("offset")) for k, (n, (a, b)) in enumerate(zip(names, curves))])
    told = shares.select("id", "share", F.explode(table).alias("s")).withColumn("x", F.get("share", F.col("s.at")))
    told = told.withColumn("probability", 1 / (1 + F.exp(-(F.col("x") * F.col("s.slope") + F.col("s.offset")))))
    out = stored(told.filter(F.col("probability") >= least).select(F.col("id").alias(id), F.col("s.subject").alias("subject"), F.col("x").alias("share"), "probability").distinct())
    forget(docs)
    return out
