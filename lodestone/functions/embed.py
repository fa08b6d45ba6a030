"""Embedders: anything with ``dim`` and ``embed(df, text_col) -> df with vec``."""

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import tokens


class Embedder(Protocol):
    dim: int

    def embed(self, df: DataFrame, text_col: str) -> DataFrame: ...


class NoEmbedder:
    dim = 0

    def embed(self, df: DataFrame, text_col: str) -> DataFrame:
        return df.withColumn("vec", F.lit(None).cast("array<double>"))


class HashingEmbedder:
    """Signed hashed token counts, normalised: needs no model, and equal texts have equal vectors."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, df: DataFrame, text_col: str) -> DataFrame:
        dim = self.dim
        h = F.transform(tokens(F.col(text_col)), lambda w: F.xxhash64(w))

        @F.pandas_udf("array<double>")
        def run(hashes):
            def one(x):
                v = np.zeros(dim)
                x = np.asarray(x, np.int64)
                np.add.at(v, x % dim, np.where((x >> 32) & 1, 1.0, -1.0))
                n = np.linalg.norm(v)
                return v / n if n else v

            return hashes.map(one)

        return df.withColumn("vec", run(h))


class WordPiece:
    """Greedy longest-match word pieces with ``##`` continuations."""

    def __init__(self, vocab: dict[str, int], max_len: int = 128, unk: str = "[UNK]", cls: str = "[CLS]", sep: str = "[SEP]", pad: str = "[PAD]"):
        self.vocab, self.max_len = vocab, max_len
        self.unk, self.cls, self.sep, self.pad = (vocab.get(t, 0) for t in (unk, cls, sep, pad))

    @staticmethod
    def split(text: str) -> list[str]:
        """Words at blanks, tabs and line ends; each ASCII punctuation character by itself."""
        out, word = [], []
        for c in text.lower():
            mark = c < "\x7f" and not c.isalnum() and c > " "
            if c in " \t\n\r" or mark:
                if word:
                    out.append("".join(word))
                    word = []
                if mark:
                    out.append(c)
            else:
                word.append(c)
        return [*out, "".join(word)] if word else out

    def pieces(self, word: str) -> list[int]:
        raw, at, out = word.encode(), 0, []
        while at < len(raw):
            for end in range(len(raw), at, -1):
                piece = self.vocab.get(("##" if at else "") + raw[at:end].decode("utf-8", "replace"))
                if piece is not None:
                    out.append(piece)
                    at = end
                    break
            else:
                out.append(self.unk)
                at += 1
        return out

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """(ids, mask), padded to ``max_len``."""
        ids = [self.cls]
        for word in self.split(text):
            ids += self.pieces(word)
        ids = [*ids[: self.max_len - 1], self.sep]
        gap = self.max_len - len(ids)
        return ids + [self.pad] * gap, [1] * len(ids) + [0] * gap


class OnnxEmbedder:
    """A local ONNX encoder with a word-piece vocabulary; one session per worker, batch by batch."""

    def __init__(self, model_path: str, vocab: dict[str, int], dim: int = 384, max_len: int = 128, pooling: str = "mean"):
        self.model_path, self.vocab, self.dim, self.max_len, self.pooling = model_path, vocab, dim, max_len, pooling

    def embed(self, df: DataFrame, text_col: str) -> DataFrame:
        path, vocab, max_len, pooling = self.model_path, self.vocab, self.max_len, self.pooling

        @F.pandas_udf("array<double>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            import onnxruntime

            session, pieces = onnxruntime.InferenceSession(path), WordPiece(vocab, max_len)
            names = {i.name for i in session.get_inputs()}
            for texts in batches:
                ids, mask = (np.array(x, np.int64) for x in zip(*(pieces.encode(t or "") for t in texts), strict=True))
                feed = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
                hidden = session.run(None, {k: v for k, v in feed.items() if k in names})[0]
                out = hidden[:, 0] if pooling == "cls" else (hidden * mask[..., None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1)
                size = np.linalg.norm(out, axis=1, keepdims=True)
                yield pd.Series(list(out / np.where(size > 0, size, 1)))

        return df.withColumn("vec", run(F.col(text_col)))
