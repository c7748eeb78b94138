"""Toxicity by class-conditional Kneser-Ney language models.

Two word bigram models are trained, on documents labelled toxic and on ordinary ones.  Both
back off through their class's continuation counts to one distribution of pooled
continuation counts of all documents, labelled or not, so an expression that a class hardly shows gets the same probability
from either model and says nothing.  Counts are of documents, one for all copies of a text,
and those below ``MIN_EVIDENCE`` count as not shown.  A
document's evidence is the difference of the two log-likelihoods, normalised by length,
over the whole text and over its most toxic stretches of a few words, since an insult in a
long text vanishes in the mean.  A logistic regression on a held-out part of the training
rows turns these figures into a probability.

Words are hashed to ``2**WORD_BITS`` buckets.  Training counts every labelled row outside fold 0, and
reads every text once without its label for the continuation counts; the model holds the bigrams that reach
``MIN_EVIDENCE``, 24 bytes each.  Texts are joined with labels where they lie up to ``BROADCAST_ROWS``
training rows, and shuffled beyond.  Scoring reads every text once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamframe.llm import _bytes as B
from roamframe.plans.scratch import stored
from roamframe.plans.workers import prepared

#: Training rows of three integers that a join broadcasts; more are joined by a shuffle of the texts, and none is left out.
BROADCAST_ROWS = 1 << 21
WORD_BITS = 18
#: The words' pairs with contexts lie in 1,024 parts of so many bits each; a task holds a part's
#: different pairs, and so many more before it drops repeated ones.
_PART_BITS, HELD_PAIRS = 2 * WORD_BITS - 10, 1 << 22
#: Documents of a class from which an expression counts; absolute discount.
MIN_EVIDENCE, DISCOUNT = 4, 0.75
#: Lengths, in words, of the stretches whose largest mean counts.
STRETCHES = (1, 8, 32)
#: Buckets that no word has: the context of a text's first word, and of document counts.
_START, _DOCUMENT = 0, 1


class Model(NamedTuple):
    """Log-likelihood ratios (toxic over ordinary) of words and bigrams, and the regression's weights."""

    backoff: np.ndarray  # (2, words): class probability without context
    rest: np.ndarray  # (2, words): share of a context's mass that backs off
    keys: np.ndarray  # bigrams, sorted
    direct: np.ndarray  # (2, bigrams): discounted probability of a bigram by itself
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


def _documents(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, words, contexts) as buckets; bucket 0 starts a text."""
    for first, data, offsets in B.text_chunks(column):
        hashes, where = B.word_hashes(data, offsets, B.ALNUM)
        words = (hashes & np.uint64(2**WORD_BITS - 1)).astype(np.int64)
        words[words <= _DOCUMENT] = _DOCUMENT + 1
        before = np.empty_like(words)
        before[1:] = words[:-1]
        before[where[:-1][where[:-1] < len(words)]] = _START
        for k in range(len(offsets) - 1):
            yield first + k, words[where[k] : where[k + 1]], before[where[k] : where[k + 1]]


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a hash of their set of runs of five words, which only copies share."""
    for batch in batches:
        digests = []
        for _, data, offsets in B.text_chunks(batch.column("text")):
            hashes, where = B.word_hashes(data, offsets, B.ALNUM)
            for k in range(len(offsets) - 1):
                words = hashes[where[k] : where[k + 1]]
                runs = np.unique(B.window_hashes(words, min(5, max(1, len(words)))))
                digests.append(xxhash.xxh3_128_digest(runs.tobytes()))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, type=pa.binary())], [*batch.schema.names, "sketch"])


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketched rows without their text."""
    for batch in _sketched(batches):
        yield batch.select(["doc_id", "y", "fold", "sketch"])


def _begins(keys: np.ndarray, low: int) -> np.ndarray:
    """Where runs begin in sorted keys that are the same but for the bits of ``low``."""
    return np.flatnonzero(np.r_[[True] * (len(keys) > 0), (keys[1:] ^ keys[:-1]) > low])


def _packed(keys: np.ndarray) -> bytes:
    """Sorted, different 32-bit keys as compressed byte planes of their steps."""
    steps = np.diff(keys, prepend=np.uint32(0)).astype("<u4")
    return pa.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 4 * n, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel(), dtype=np.uint32)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different (word, context) pairs of each batch, packed by parts of the words."""
    for batch in batches:
        keys = [np.unique((w << WORD_BITS) | u) for _, w, u in _documents(batch.column("text"))]
        if keys:
            keys = np.concatenate(keys)
            keys.sort()
            keys = keys[_begins(keys, 0)]
            first = _begins(keys, 2**_PART_BITS - 1)
            n = np.diff(first, append=len(keys))
            inside = [_packed((keys[a : a + m] & (2**_PART_BITS - 1)).astype(np.uint32)) for a, m in zip(first, n, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[first] >> _PART_BITS, type=pa.int32()), pa.array(n, type=pa.int32()), pa.array(inside, type=pa.binary())], ["part", "n", "packed"]
            )


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different contexts of every word, from rows of which those of a part follow each other."""

    def counted(part: int, held: list[np.ndarray]) -> pa.RecordBatch:
        words, n = np.unique(np.unique(np.concatenate(held)) >> WORD_BITS, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64) + (part << (_PART_BITS - WORD_BITS))), pa.array(n.astype(np.int64))], ["w", "n"])

    at, held, size, limit = None, [], 0, HELD_PAIRS
    for batch in batches:
        for part, n, packed in zip(*(batch.column(c).to_pylist() for c in ("part", "n", "packed")), strict=True):
            if part != at:
                if held:
                    yield counted(at, held)
                at, held, size, limit = part, [], 0, HELD_PAIRS
            held.append(_unpacked(packed, n))
            size += n
            if size > limit:
                held = [np.unique(np.concatenate(held))]
                size = len(held[0])
                limit = max(HELD_PAIRS, 2 * size)
    if held:
        yield counted(at, held)


def _continuations(docs: DataFrame) -> np.ndarray:
    """Different contexts of every word over all documents."""
    pairs = prepared(docs.select("text")).mapInArrow(_pairs, "part int, n int, packed binary")
    # a row a bucket at most
    found = pairs.repartition("part").sortWithinPartitions("part").mapInArrow(_contexts, "w bigint, n bigint").toArrow()
    pooled = np.zeros(2**WORD_BITS)
    pooled[found["w"].to_numpy()] = found["n"].to_numpy()
    return pooled


def _bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per (context, word) and group per batch, of groups 0 and 1 in a, of 2 and 3 in b; group is class and part of the training rows."""
    for batch in batches:
        group = batch.column("grp").to_numpy(zero_copy_only=False)
        keys = []
        for row, w, u in _documents(batch.column("text")):
            single = (_DOCUMENT << WORD_BITS) | np.append(w, _DOCUMENT)
            keys.append(np.unique(np.concatenate([(u << WORD_BITS) | w, single])) << 2 | int(group[row]))
        if keys:
            keys = np.concatenate(keys)
            keys.sort()
            first = _begins(keys, 3)
            of, group = keys[first] >> 2, (keys & 3).astype(np.int8)
            del keys
            # two counts of 31 bits in a value
            sums = [np.add.reduceat(np.array(one)[group], first) for one in ((1, 1 << 32, 0, 0), (0, 0, 1, 1 << 32))]
            yield pa.RecordBatch.from_arrays([pa.array(of), *map(pa.array, sums)], ["k", "a", "b"])


def _evidence(model: Model, words: np.ndarray, before: np.ndarray) -> np.ndarray:
    """A document's figures: mean log ratio, and the largest mean over stretches."""
    if not len(words):
        return np.zeros(1 + len(STRETCHES))
    p = model.rest[:, before] * model.backoff[:, words]
    if len(model.keys):
        key = (before << WORD_BITS) | words
        at = np.minimum(np.searchsorted(model.keys, key), len(model.keys) - 1)
        p = p + np.where(model.keys[at] == key, model.direct[:, at], 0.0)
    ratio = np.log(p[0]) - np.log(p[1])
    total = np.concatenate([[0.0], np.cumsum(ratio)])
    out = [total[-1] / len(ratio)]
    for n in STRETCHES:
        n_here = min(n, len(ratio))
        out.append((total[n_here:] - total[:-n_here]).max() / n_here)
    return np.array(out)


def _figures(batches: Iterator[pa.RecordBatch], model: Broadcast) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_evidence(model.value, w, u) for _, w, u in _documents(batch.column("text"))]
        flat = np.stack(rows) if rows else np.zeros((0, 1 + len(STRETCHES)))
        yield pa.RecordBatch.from_arrays([batch.column("y"), *(pa.array(flat[:, k]) for k in range(flat.shape[1]))], ["y", *(f"f{k}" for k in range(flat.shape[1]))])


def _scores(batches: Iterator[pa.RecordBatch], model: Broadcast) -> Iterator[pa.RecordBatch]:
    m = model.value
    for batch in batches:
        rows = [_evidence(m, w, u) for _, w, u in _documents(batch.column("text"))]
        flat = (np.stack(rows) - m.mean) / m.scale if rows else np.zeros((0, 1 + len(STRETCHES)))
        score = 1 / (1 + np.exp(-np.clip(flat @ m.weights[1:] + m.weights[0], -30, 30)))
        at = batch.schema.get_field_index("text")
        kept = [c for i, c in enumerate(batch.columns) if i != at]
        names = [n for i, n in enumerate(batch.schema.names) if i != at]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(score)], [*names, "score"])


def _grouped(rows: DataFrame) -> DataFrame:
    """(u, w, g0 to g3): documents per context and word in each of the groups of rows(text, grp)."""
    found = prepared(rows).select("text", "grp").mapInArrow(_bigrams, "k bigint, a bigint, b bigint")
    counts = found.groupBy("k").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    groups = [c for half, g in (("a", 0), ("b", 2)) for c in (F.col(half).bitwiseAND(2**32 - 1).alias(f"g{g}"), F.shiftright(half, 32).alias(f"g{g + 1}"))]
    return counts.select(F.shiftright("k", WORD_BITS).alias("u"), F.col("k").bitwiseAND(2**WORD_BITS - 1).alias("w"), *groups)


def _language_model(counts: DataFrame, groups: dict[int, tuple[int, ...]], pooled: np.ndarray) -> Model:
    """Kneser-Ney tables from counts(u, w, g0 to g3); groups: the count groups of toxic (0) and ordinary (1); pooled: contexts of every word."""
    size = 2**WORD_BITS
    sums = [sum((F.col(f"g{g}") for g in groups[c]), F.lit(0)).alias(f"n{c}") for c in (0, 1)]
    rows = counts.select("u", "w", *sums)
    per_document, shown_by = F.col("u") == _DOCUMENT, [F.col(f"n{c}") for c in (0, 1)]
    contexts_of = [F.sum((~per_document & (n > 0)).cast("long")).alias(f"c{c}") for c, n in enumerate(shown_by)]
    documents_of = [F.max(F.when(per_document, n).otherwise(0)).alias(f"d{c}") for c, n in enumerate(shown_by)]
    # a row a bucket at most
    by_word = rows.filter(F.col("w") != _DOCUMENT).groupBy("w").agg(*contexts_of, *documents_of).toArrow()
    by_context = rows.filter(~per_document).groupBy("u").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    # an expression is shown by both classes as soon as one shows it, or its ratio would turn on the threshold;
    # a training text of n words has n of these rows at most
    top = rows.filter(~per_document & (F.greatest(*shown_by) >= MIN_EVIDENCE)).toArrow()

    contexts, documents = np.zeros((2, size)), np.zeros((2, size))
    at = by_word["w"].to_numpy()
    for c in (0, 1):
        contexts[c, at], documents[c, at] = by_word[f"c{c}"].to_numpy(), by_word[f"d{c}"].to_numpy()
    shared = (pooled + 0.5) / (pooled.sum() + 0.5 * size)
    shown = (documents >= MIN_EVIDENCE).any(axis=0)
    clear = np.where(shown, np.maximum(contexts - DISCOUNT, 0.0), 0.0)
    total = np.maximum(contexts.sum(axis=1, keepdims=True), 1.0)
    backoff = clear / total + (1 - clear.sum(axis=1, keepdims=True) / total) * shared

    seen = np.zeros((2, size))
    for c in (0, 1):
        seen[c, by_context["u"].to_numpy()] = by_context[f"n{c}"].to_numpy()
    tu = top["u"].to_numpy()
    keys = (tu << WORD_BITS) | top["w"].to_numpy()
    direct, kept = np.zeros((2, len(keys))), np.zeros((2, size))
    for c in (0, 1):
        direct[c] = np.maximum(top[f"n{c}"].to_numpy() - DISCOUNT, 0.0) / np.maximum(seen[c, tu], 1.0)
        np.add.at(kept[c], tu, direct[c])
    order = np.argsort(keys)
    keys, direct = keys[order], direct[:, order]
    k = 1 + len(STRETCHES)
    return Model(backoff, np.maximum(1 - kept, 1e-6), keys, direct, np.zeros(k), np.ones(k), np.zeros(k + 1))


def _regression(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps: means, scales, weights with the constant first."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    ridge = np.diag([1e-3] + [1.0] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def fold(doc_id: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo 5; 0 is never trained on."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)).cast("int")


def _broadcast_if_few(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def _training(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, y, fold) of the rows to train on, one of the copies of a text, and (text, y, fold) of those whose doc_id several rows have."""
    usable = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y")).withColumn("fold", fold()).filter("fold <> 0")
    ids = _broadcast_if_few(stored(usable.withColumnRenamed("doc_id", "__id"), "labels"))
    labelled = prepared(docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("__id")).select("doc_id", "text", "y", "fold"))
    kind = dict(docs.dtypes)["doc_id"]
    thin = stored(labelled.mapInArrow(_thin, f"doc_id {kind}, y int, fold int, sketch binary"), "sketches")
    several = thin.groupBy("doc_id").agg((F.count("*") > 1).alias("several"))
    best = thin.join(several, "doc_id").groupBy("sketch", "y").agg(F.min(F.struct("several", "doc_id", "fold")).alias("q"))
    best = stored(best.select("sketch", "y", "q.*"), "training")
    again = best.filter("several").select(F.col("sketch").alias("__sketch"), F.col("doc_id").alias("__id"))
    if again.isEmpty():
        return best.select("doc_id", "y", "fold"), labelled.select("text", "y", "fold").limit(0)
    texts = labelled.join(again.select("__id").distinct(), F.col("doc_id") == F.col("__id"), "left_semi")
    texts = texts.mapInArrow(_sketched, f"doc_id {kind}, text string, y int, fold int, sketch binary")
    texts = texts.join(again, (F.col("doc_id") == F.col("__id")) & (F.col("sketch") == F.col("__sketch")), "left_semi").dropDuplicates(["sketch", "y"])
    return best.filter("not several").select("doc_id", "y", "fold"), stored(texts.select("text", "y", "fold"), "repeated")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit both language models and the regression on all labelled rows outside fold 0.

    ``labels`` has doc_id and toxic (0 or 1; null rows are ignored, of several labels the
    largest counts).  Without a row of each class, the model scores every text alike.
    """
    docs = docs.select("doc_id", "text")
    chosen, repeated = _training(docs, labels)
    chosen = _broadcast_if_few(chosen.withColumnRenamed("doc_id", "__id"))
    # groups: toxic and ordinary, each in the part for the models alone and the part for the regression
    group = ((1 - F.col("y")) * 2 + (F.col("fold") == 4).cast("int")).cast("bigint").alias("grp")
    rows = docs.join(chosen, F.col("doc_id") == F.col("__id")).select("text", "y", "fold").unionByName(repeated)
    counts = stored(_grouped(rows.select("text", group)), "bigrams")
    context = docs.sparkSession.sparkContext
    pooled = _continuations(docs)
    early = context.broadcast(_language_model(counts, {0: (0,), 1: (2,)}, pooled))
    names = [f"f{k}" for k in range(1 + len(STRETCHES))]
    # 36 bytes a training row of one fold
    sample = rows.filter("fold = 4").select("text", "y").mapInArrow(partial(_figures, model=early), ", ".join(["y int", *(f"{x} double" for x in names)])).toArrow()
    model = _language_model(counts, {0: (0, 1), 1: (2, 3)}, pooled)
    early.destroy()
    y = sample["y"].to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return model._replace(weights=np.r_[np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), np.zeros(len(names))])
    mean, scale, weights = _regression(np.stack([sample[x].to_numpy() for x in names], axis=1), y)
    return model._replace(mean=mean, scale=scale, weights=weights)


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns ``keep`` and ``score`` of every row; null and empty texts score by the constant alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = dict(docs.dtypes)
    fields = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "score double"])
    return prepared(docs).select(*keep, "text").mapInArrow(partial(_scores, model=shared), fields)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; repeated rows get a row each, and a null doc_id is not held out."""
    scored = score(docs, train(docs, labels), "doc_id")
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score is below one half, with its columns."""
    packed = docs.select(F.struct("*").alias("__row"), "text")
    model = train(docs, labels)
    return score(packed, model, "__row").filter("score < 0.5").select("__row.*")
