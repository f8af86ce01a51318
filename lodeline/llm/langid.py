"""Language identification by averaged embeddings of hashed subwords and a linear softmax.

A text is lower-cased, everything but letters becomes a boundary, and each run of
one to five bytes is a feature with an embedding of its own. The embeddings of a
text are averaged, and a linear layer with softmax gives the languages. Both are
trained by stochastic gradient descent on a bounded sample of labelled documents:
at most ``SAMPLE_DOCS`` per language, ``PIECES`` pieces of each. Of
more than ``MOST_LANGUAGES`` labels the most frequent are learned, ties by name; the
model counts the others, and their documents are predicted like all. The
temperature of the softmax and the score below which an answer is rejected come
from documents of the sample that were not trained on.

As the layer is linear, a feature's embedding times the layer is a row of a table
with one column per language; whole texts are predicted from that table, whose
size is bounded by its parameters.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; the
same for all if nothing is labelled; ties go to the first language by name.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

SAMPLE_DOCS = 1200
PIECES = 3
SHORTEST, LONGEST = 24, 320
MOST_LANGUAGES = 256
BUCKET_BITS = 16
DIMENSIONS = 16
ORDERS = (1, 2, 3, 4, 5)
EPOCHS = 3
BATCH = 64
RATE = 0.5
SEED = 11
# Share of right answers that calibration may reject, and the highest limit.
WRONGLY_REJECTED = 0.0005
HIGHEST_LIMIT = 0.5
UNKNOWN = "und"
_MIX = np.uint32(0x9E3779B1)
# Bytes of a text whose features are held at a time.
SLICE = 1 << 18
# Bytes of ASCII that are no letters stand for a boundary.
_LETTERS = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def _letters(text: str) -> np.ndarray:
    """Bytes of a text with a boundary at either end; runs of boundaries are one."""
    raw = _LETTERS[np.frombuffer(f" {text.lower()} ".encode(errors="replace"), np.uint8)]
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
    return raw[keep]


def _runs(raw: np.ndarray) -> list[np.ndarray]:
    """Buckets of all runs of bytes by their length, each in the order of their starts."""
    raw = raw.astype(np.uint32)
    found, rolled = [], np.zeros(len(raw), np.uint32)
    for order in ORDERS:
        if order > len(raw):
            break
        rolled = (rolled[: len(raw) - order + 1] + np.uint32(1)) * _MIX ^ raw[order - 1 :]
        mixed = (rolled ^ (rolled >> np.uint32(15))) * _MIX
        found.append(mixed >> np.uint32(32 - BUCKET_BITS))
    return found


def features(text: str) -> np.ndarray:
    """Buckets of all runs of bytes of a text."""
    return np.concatenate(_runs(_letters(text)))


def mean_embedding(text: str, table: np.ndarray) -> np.ndarray:
    """Mean row of the table over the features of a text, which are counted slice by slice."""
    raw = _letters(text)
    if len(raw) <= SLICE:
        return table[np.concatenate(_runs(raw))].mean(axis=0, dtype=np.float64)
    counts = np.zeros(len(table), np.int64)
    for start in range(0, len(raw), SLICE):
        for buckets in _runs(raw[start : start + SLICE + ORDERS[-1] - 1]):
            counts += np.bincount(buckets[:SLICE], minlength=len(table))
    return counts @ table.astype(np.float64) / counts.sum()


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Model:
    """Languages in order of name, the table of features, and what calibration found.

    ``left_out`` counts the labels that were not learned, and their documents.
    """

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    limit: float = 0.0
    left_out: tuple[int, int] = (0, 0)

    def logits(self, text: str) -> np.ndarray:
        return mean_embedding(text, self.table) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the answer is rejected."""
        if not text or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, True
        scores = _softmax(self.logits(text)[None, :] / self.temperature)[0]
        best = int(scores.argmax())
        return self.languages[best], float(min(1.0, scores[best])), bool(scores[best] < self.limit)


def _softmax(logits: np.ndarray) -> np.ndarray:
    raised = np.exp(logits - logits.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[int], languages: list[str], seed: int = SEED) -> Model:
    """Embeddings and layer by stochastic gradient descent over shuffled batches."""
    draw = np.random.default_rng(seed)
    embeddings = draw.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)
    layer = np.zeros((DIMENSIONS, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    bags = [features(t) for t in texts]
    wanted = np.array(labels)
    steps = EPOCHS * -(-len(bags) // BATCH)
    done = 0
    for _ in range(EPOCHS):
        order = draw.permutation(len(bags))
        for start in range(0, len(order), BATCH):
            chosen = order[start : start + BATCH]
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            sizes = np.array([len(bags[i]) for i in chosen])
            flat = np.concatenate([bags[i] for i in chosen])
            ends = np.cumsum(sizes)
            means = np.add.reduceat(embeddings[flat], ends - sizes, axis=0) / sizes[:, None].astype(np.float32)
            error = _softmax(means @ layer + bias).astype(np.float32)
            error[np.arange(len(chosen)), wanted[chosen]] -= 1
            back = (error @ layer.T) / sizes[:, None].astype(np.float32)
            layer -= rate * (means.T @ error) / len(chosen) * 8
            bias -= rate * error.mean(axis=0)
            touched, place = np.unique(flat, return_inverse=True)
            change = np.empty((len(touched), DIMENSIONS), np.float32)
            spread = np.repeat(back, sizes, axis=0)
            for d in range(DIMENSIONS):
                change[:, d] = np.bincount(place, weights=spread[:, d], minlength=len(touched))
            embeddings[touched] -= rate * 8 * change
    return Model(languages, embeddings @ layer, bias.astype(np.float64))


def calibrate(model: Model, texts: list[str], labels: list[int]) -> Model:
    """Set the temperature that fits the scores best, and the limit of rejection."""
    if not texts or len(model.languages) < 2:
        return model
    logits = np.array([model.logits(t) for t in texts])
    wanted = np.array(labels)
    rows = np.arange(len(wanted))
    grid = np.geomspace(0.05, 8, 60)
    model.temperature = float(min(grid, key=lambda t: -np.log(_softmax(logits / t)[rows, wanted] + 1e-12).mean()))
    scores = _softmax(logits / model.temperature)
    right = scores.argmax(axis=1) == wanted
    if right.any():
        model.limit = min(HIGHEST_LIMIT, float(np.quantile(scores.max(axis=1)[right], WRONGLY_REJECTED)))
    return model


def labelled_pieces(
    docs: DataFrame, sample_docs: int = SAMPLE_DOCS, most_languages: int = MOST_LANGUAGES
) -> tuple[list[str], list[tuple[str, int, int]], tuple[int, int]]:
    """Languages of the labelled documents, pieces of a sample, and what was left out.

    A piece is a text, language and document. Documents are drawn by the hash of
    their id and text with twice the share that gives their language
    ``sample_docs`` of them; equal rows are one, and the least hashes are kept, at
    most so many. The pieces stand at hashed places. Left out are the labels beyond the
    ``most_languages`` most frequent, as numbers of labels and of documents.
    """
    known = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = known.groupBy("lang").count()
    counts = sizes.orderBy(F.desc("count"), "lang").limit(most_languages + 1).collect()  # one row per language
    left_out = (0, 0)
    if len(counts) > most_languages:
        counts = counts[:most_languages]
        labels, labelled = sizes.agg(F.count("*"), F.sum("count")).first()
        left_out = labels - len(counts), labelled - sum(row["count"] for row in counts)
    counts = sorted(counts, key=lambda row: row["lang"])
    languages = [row["lang"] for row in counts]
    if not languages:
        return [], [], left_out
    chances = F.create_map(*[x for row in counts for x in (F.lit(row["lang"]), F.lit(min(1.0, 2 * sample_docs / row["count"])))])
    drawn = F.pmod(F.xxhash64("doc_id", "text", F.lit(SEED)), F.lit(1 << 30)) < chances[F.col("lang")] * (1 << 30)

    def piece(number: int):
        chance = lambda salt, low, high: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(high - low)) + low
        size = chance(100 + number, SHORTEST, LONGEST + 1).cast("int")
        room = F.greatest(F.lit(1), F.length("text") - size)
        at = (F.pmod(F.xxhash64("doc_id", F.lit(200 + number)), room) + 1).cast("int")
        return F.substring(F.col("text"), at, size)

    drawn_pieces = known.where(drawn).select("lang", F.xxhash64("doc_id", "text").alias("doc"), F.array(*map(piece, range(PIECES))).alias("pieces"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("doc", "pieces"))
    kept = drawn_pieces.distinct().withColumn("_place", place).where(F.col("_place") <= sample_docs).drop("_place")
    rows = sorted(tuple(r) for r in kept.collect())  # at most ``sample_docs`` of each language
    place = {lang: i for i, lang in enumerate(languages)}
    return languages, [(text, place[lang], doc) for lang, doc, found in rows for text in found if text and has_letter(text)], left_out


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, most_languages: int = MOST_LANGUAGES) -> Model:
    """A calibrated model from the labelled rows of ``doc_id, text, lang``; a fifth of the sample calibrates."""
    languages, pieces, left_out = labelled_pieces(docs, sample_docs, most_languages)
    if left_out[0]:
        warnings.warn(f"{left_out[0]} labels of {left_out[1]} documents are not learned", stacklevel=2)
    if not pieces:
        return Model([], np.zeros((1, 0), np.float32), np.zeros(0), left_out=left_out)
    held = [p for p in pieces if p[2] % 5 == 0]
    rest = [p for p in pieces if p[2] % 5] or pieces
    model = train([p[0] for p in rest], [p[1] for p in rest], languages)
    model.left_out = left_out
    return calibrate(model, [p[0] for p in held], [p[1] for p in held])


def held_out() -> Column:
    """Whether a document must not be learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``language``: a struct of ``lang_pred``, ``score`` and ``rejected`` from the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in text], columns=["lang_pred", "score", "rejected"])

    return docs.withColumn("language", predict("text"))


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents whose language is found and not rejected, in the columns they came with."""
    model = fit(docs.where(~held_out()))
    found = identify(docs.select(F.struct(*docs.columns).alias("_row"), "text"), model)
    return found.where(~F.col("language.rejected")).select("_row.*")
