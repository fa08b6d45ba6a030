"""Hierarchical language identification.

One-versus-rest linear SVMs choose the language family; within it, one linear
SVM for each pair of languages votes.  Features are frequencies of hashed
letter trigrams, other characters counting as a blank, so a text's margin is
the mean of its trigrams' weights and a batch of texts is scored by one lookup.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._tokens import Texts, lean, pack, texts_of, trimmed, unpack
from lodestone.llm.mixing import draw

UNKNOWN = "und"
#: Language families by ISO 639-1 code; a language that isn't listed belongs to the family "other".
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "lb", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
}
#: Documents of each language that training takes, about.
TRAIN_PER_LANG = 400
#: Languages that training tells apart, the most frequent labels: a noisy label column can't grow the sample.
MAX_LANGS = 256
#: Documents that training takes over all languages, about; many languages have fewer each.
MAX_ROWS = 8192
BUCKETS = 8192
_PIECE = 1 << 18


def family(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang.split("-")[0].lower() in langs), "other")


@cache
def _letters() -> np.ndarray:
    """By code point: the lower-case letter, or 32 for what is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def _pieces(texts: Texts) -> Iterator[tuple[int, Texts]]:
    """Texts in runs of about ``_PIECE`` bytes, each with the number of its first text."""
    at, n = 0, len(texts.offsets) - 1
    while at < n:
        stop = int(np.searchsorted(texts.offsets, texts.offsets[at] + _PIECE, "right")) - 1
        stop = min(max(stop, at + 1), n)
        a, b = texts.offsets[at], texts.offsets[stop]
        yield at, Texts(texts.data[a:b], texts.offsets[at : stop + 1] - a)
        at = stop


def trigrams(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text number) of every trigram that holds a letter; two blanks stand between texts."""
    codes = np.frombuffer(texts.data.tobytes().decode().encode("utf-32-le"), np.uint32)
    heads = np.r_[0, np.cumsum((texts.data & 0xC0) != 0x80)]
    ends = heads[texts.offsets]
    n = len(ends) - 1
    doc = np.repeat(np.arange(n), np.diff(ends))
    padded = np.full(len(codes) + 2 * n + 2, 32, np.uint32)
    owner = np.zeros(len(padded), np.int64)
    at = np.arange(len(codes)) + 2 * doc + 2
    padded[at] = _letters()[codes]
    owner[at] = doc
    a, b, c = padded[:-2], padded[1:-1], padded[2:]
    own = np.maximum(np.maximum(owner[:-2], owner[1:-1]), owner[2:])
    real = (a != 32) | (b != 32) | (c != 32)
    h = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (c * np.uint32(0xC2B2AE3D))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (h[real] >> np.uint32(19)).astype(np.int64), own[real]


@dataclass
class Model:
    """Weights of ``planes`` hyperplanes: first one per family, then one per pair of languages of a family."""

    families: list[str]
    langs: dict[str, list[str]]
    pairs: dict[str, list[tuple[int, int]]]
    weights: np.ndarray
    bias: np.ndarray

    def predict(self, texts: Texts) -> tuple[list[str], np.ndarray]:
        n = len(texts.offsets) - 1
        margins, seen = np.zeros((n, len(self.bias))), np.zeros(n, np.int64)
        for at, piece in _pieces(texts):
            bucket, own = trigrams(piece)
            k = len(piece.offsets) - 1
            seen[at : at + k] = count = np.bincount(own, minlength=k)
            for j in range(len(self.bias)):
                margins[at : at + k, j] = np.bincount(own, self.weights[j][bucket], minlength=k) / np.maximum(count, 1)
        margins += self.bias
        out, score = [UNKNOWN] * n, np.zeros(n)
        for i in np.flatnonzero(seen > 0) if self.families else []:
            out[i], score[i] = self._decide(margins[i])
        return out, score

    def _decide(self, m: np.ndarray) -> tuple[str, float]:
        f = int(np.argmax(m[: len(self.families)]))
        chance = _logistic(2 * m[f]) if len(self.families) > 1 else 1.0
        name = self.families[f]
        langs, at = self.langs[name], len(self.families)
        for other in self.families[:f]:
            at += len(self.pairs[other])
        votes, least = np.zeros(len(langs)), np.full(len(langs), np.inf)
        for j, (a, b) in enumerate(self.pairs[name]):
            x = m[at + j]
            votes[a if x > 0 else b] += 1
            least[a], least[b] = min(least[a], x), min(least[b], -x)
        best = max(range(len(langs)), key=lambda i: (votes[i], least[i]))
        return langs[best], float(chance * (_logistic(2 * least[best]) if len(langs) > 1 else 1.0))


def _logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def _svm(x: np.ndarray, own: np.ndarray, y: np.ndarray, c: float = 1.0, epochs: int = 30) -> np.ndarray:
    """Weights, the last one being the bias, of a linear SVM over the rows ``own`` of x, by dual coordinate descent.

    The loss is the squared hinge; y is +1 or -1; rows of x end with a 1.
    """
    # both sides weigh the same, however many rows they have
    side = np.where(y > 0, len(y) / (2 * max((y > 0).sum(), 1)), len(y) / (2 * max((y < 0).sum(), 1)))
    diagonal = 1 / (2 * c * side)
    norm = np.array([x[i] @ x[i] for i in own]) + diagonal
    w, alpha, rng = np.zeros(x.shape[1]), np.zeros(len(y)), np.random.Generator(np.random.PCG64(7))
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            row = x[own[i]]
            g = y[i] * (row @ w) - 1 + diagonal[i] * alpha[i]
            new = max(alpha[i] - g / norm[i], 0)
            if new != alpha[i]:
                moved = max(moved, abs(new - alpha[i]))
                w += (new - alpha[i]) * y[i] * row
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """A model from (language, trigram buckets, their frequencies) rows; they are held once more, as one matrix of 4-byte numbers."""
    langs = sorted({lang for lang, *_ in rows})
    families = sorted({family(x) for x in langs})
    of = {f: [x for x in langs if family(x) == f] for f in families}
    pairs = {f: list(combinations(range(len(of[f])), 2)) for f in families}
    if not rows:
        return Model([], {}, {}, np.zeros((0, BUCKETS)), np.zeros(0))
    x = np.zeros((len(rows), BUCKETS + 1), np.float32)
    for i, (_, at, value) in enumerate(rows):
        x[i, at] = value
    # the spread of each feature, without a second matrix
    mean, square = x[:, :-1].mean(0, dtype=np.float64), np.einsum("ij,ij->j", x[:, :-1], x[:, :-1], dtype=np.float64) / len(x)
    scale = 1 / (np.sqrt(np.maximum(square - mean * mean, 0)) + 1e-4) / np.sqrt(BUCKETS)
    x[:, :-1] *= scale.astype(np.float32)
    x[:, -1] = 1
    y = np.array([lang for lang, *_ in rows])
    fam = np.array([family(v) for v in y])
    every = np.arange(len(y))
    planes = [_svm(x, every, np.where(fam == f, 1.0, -1.0)) if len(families) > 1 else np.zeros(BUCKETS + 1) for f in families]
    for f in families:
        for a, b in pairs[f]:
            own = np.flatnonzero((y == of[f][a]) | (y == of[f][b]))
            planes.append(_svm(x, own, np.where(y[own] == of[f][a], 1.0, -1.0)))
    return Model(families, of, pairs, np.array([w[:-1] for w in planes]) * scale, np.array([w[-1] for w in planes]))


def train(docs: DataFrame, per_lang: int = TRAIN_PER_LANG, max_langs: int = MAX_LANGS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from the labelled rows of ``docs``: a sample of about ``per_lang`` of each language, drawn by id, whole texts.

    Rows without text, language or id are not learned from, nor are labels
    beyond the ``max_langs`` most frequent ones (ties by name).  The sample has
    about ``MAX_ROWS`` rows at most, whatever the size of ``docs``.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter("id is not null and text is not null and lang is not null")
    often = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()
    each = min(per_lang, MAX_ROWS // max(len(often), 1))
    share = {r["lang"]: min(1.0, each / r["count"]) for r in often}
    if not share:
        return fit([])
    lean()
    fraction = F.element_at(F.create_map(*[F.lit(x) for kv in share.items() for x in kv]), F.col("lang"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                bucket, _ = trigrams(texts_of(batch.column(1).slice(i, 1)))
                counts = np.bincount(bucket, minlength=BUCKETS)
                at = np.flatnonzero(counts)
                out.append(pack(at.astype(np.uint16), (counts[at] / max(len(bucket), 1)).astype(np.float32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], names=["id", "lang", "f"])

    got = rows.filter(F.col("lang").isin(*share) & (draw(F.col("id"), "lang") < fraction)).select(F.col("id").cast("long"), "text", "lang").mapInArrow(features, "id long, lang string, f binary").collect()
    learned = [(r["lang"], *unpack(bytes(r["f"]))) for r in sorted(got, key=lambda r: (r["id"], r["lang"], bytes(r["f"])))]
    return fit([r for r in learned if len(r[1])])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1) added; lang_pred is ``und`` and score 0 where the text is null or has no letter.

    Columns of these names are replaced.
    """

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def guess(texts: pa.Array) -> pa.Array:
        lean()
        lang, score = model.predict(texts_of(texts))
        trimmed()
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["lang_pred", "score"])

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(F.struct(*kept).alias("doc"), guess(F.col(text_col).cast("string")).alias("g"))
    return rows.select("doc.*", "g.lang_pred", "g.score")
