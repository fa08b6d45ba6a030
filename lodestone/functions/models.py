"""Embedding models by name, loaded from local folders: this engine fetches nothing."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from pathlib import Path

from lodestone.functions.embed import Embedder, HashingEmbedder, NoEmbedder, OnnxEmbedder

NONE, DEFAULT = "none", "all-MiniLM-L6-v2"


@dataclass(frozen=True)
class ModelInfo:
    key: str
    dim: int = 0
    max_length: int = 128
    pooling: str = "mean"


# Names, dimensions, lengths and pooling of the public models that can be chosen.
MODELS = {
    m.key: m
    for m in (
        ModelInfo("all-MiniLM-L6-v2", 384, 128, "mean"),
        ModelInfo("all-MiniLM-L12-v2", 384, 128, "mean"),
        ModelInfo("multi-qa-MiniLM-L6-cos-v1", 384, 512, "mean"),
        ModelInfo("bge-small-en-v1.5", 384, 512, "cls"),
        ModelInfo("bge-base-en-v1.5", 768, 512, "cls"),
    )
}


def resolve(key: str) -> ModelInfo:
    """A model of the table, the default one for "", ``none``, or ``hash-N`` for hashed words in N dimensions."""
    if key == NONE:
        return ModelInfo(NONE)
    if key.startswith("hash-") and key[5:].isdigit() and int(key[5:]) > 0:
        return ModelInfo(key, int(key[5:]))
    if (found := MODELS.get(key or DEFAULT)) is None:
        raise ValueError(f"unknown model {key!r}; one of {', '.join([*sorted(MODELS), NONE, 'hash-N'])}")
    return found


def model_dir(key: str) -> Path:
    return Path(os.environ.get("LODESTONE_MODELS", "models")) / key


def load_tokenizer(path: str | Path, max_length: int = 0) -> tuple[dict[str, int], int]:
    """(vocabulary, length) of a tokenizer file; a length of the model's wins over the file's, 128 is for neither."""
    found = json.loads(Path(path).read_text())
    vocab = (found.get("model") or {}).get("vocab")
    if not isinstance(vocab, dict) or not vocab:
        raise ValueError(f"no word-piece vocabulary in {path}")
    return {str(k): int(v) for k, v in vocab.items()}, max_length or (found.get("truncation") or {}).get("max_length") or 128


def missing(info: ModelInfo) -> list[Path]:
    """Files that a model lacks in its folder."""
    if info.key not in MODELS:
        return []
    return [p for p in (model_dir(info.key) / "model.onnx", model_dir(info.key) / "tokenizer.json") if not p.exists()]


def embedder(key: str) -> Embedder:
    info = resolve(key)
    if info.key == NONE:
        return NoEmbedder()
    if info.key not in MODELS:
        return HashingEmbedder(info.dim)
    if lacks := missing(info):
        raise FileNotFoundError(f"put these files in place: {', '.join(map(str, lacks))}")
    vocab, length = load_tokenizer(model_dir(info.key) / "tokenizer.json", info.max_length)
    return OnnxEmbedder(str(model_dir(info.key) / "model.onnx"), vocab, info.dim, length, info.pooling)
