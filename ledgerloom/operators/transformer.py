"""Forward passes of small transformer encoders in NumPy: texts to unit vectors, and (query, passage) pairs to relevance scores.

A model is a folder with `model.safetensors` and `tokenizer.json` in the public layout of BERT-like encoders.  Its sizes are read off
the weights.  Weights are memory-mapped and prepared once a Python worker; texts of like length share a batch, so little is padded.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOOR, EPSILON, LONGEST = 1e-8, 1e-12, 512
_TYPES = {"F64": np.float64, "F32": np.float32, "F16": np.float16, "I64": np.int64, "I32": np.int32}


def layer_norm(x: np.ndarray, scale: np.ndarray, shift: np.ndarray) -> np.ndarray:
    centred = x - x.mean(-1, keepdims=True)
    return centred * (scale / np.sqrt((centred * centred).mean(-1, keepdims=True) + EPSILON)) + shift


def gelu(x: np.ndarray) -> np.ndarray:
    """The tanh form."""
    return x / (1 + np.exp(-2 * np.sqrt(2 / np.pi) * (x + 0.044715 * x * x * x)))


def softmax(x: np.ndarray) -> np.ndarray:
    grown = np.exp(x - np.max(x, axis=-1, keepdims=True))
    return grown / np.sum(grown, axis=-1, keepdims=True)


def read_weights(path: str) -> dict[str, np.ndarray]:
    """Tensors of a safetensors file: a length, a JSON table of names, types, shapes and offsets, then the bytes."""
    with open(path, "rb") as f:
        size = int.from_bytes(f.read(8), "little")
        table = json.loads(f.read(size))
    raw = np.memmap(path, np.uint8, "r", 8 + size)
    return {name: raw[slice(*t["data_offsets"])].view(_TYPES[t["dtype"]]).reshape(t["shape"]) for name, t in table.items() if name != "__metadata__"}


def snapshot(model: str, cache: str) -> str:
    """Folder of a model: `model` itself if it is one, else its newest snapshot in a cache of the public hub's layout. FileNotFoundError if there is none."""
    if (Path(model) / "model.safetensors").exists():
        return model
    found = sorted((Path(cache) / f"models--{model.replace('/', '--')}" / "snapshots").glob("*/model.safetensors"), key=lambda p: p.stat().st_mtime)
    if not found:
        raise FileNotFoundError(f"no weights of {model} in {cache}")
    return str(found[-1].parent)


class Encoder:
    """An encoder's weights, prepared: the three projections of attention as one matrix each layer."""

    def __init__(self, weights: Mapping[str, np.ndarray], heads: int | None = None) -> None:
        root = next(k for k in weights if k.endswith("embeddings.word_embeddings.weight")).removesuffix("embeddings.word_embeddings.weight")
        own = {k.removeprefix(root): np.asarray(v, np.float32) for k, v in weights.items()}
        self.words, self.places, self.types = (own[f"embeddings.{k}_embeddings.weight"] for k in ("word", "position", "token_type"))
        self.first = own["embeddings.LayerNorm.weight"], own["embeddings.LayerNorm.bias"]
        width = self.words.shape[1]
        self.heads = heads or max(1, width // 32)
        count = 1 + max((int(m[1]) for k in own if (m := re.match(r"encoder\.layer\.(\d+)\.", k))), default=-1)
        self.layers = []
        for n in range(count):
            at = f"encoder.layer.{n}."
            three = [f"{at}attention.self.{k}" for k in ("query", "key", "value")]
            pair = lambda name, at=at: (own[f"{at}{name}.weight"], own[f"{at}{name}.bias"])
            self.layers.append((np.concatenate([own[f"{k}.weight"] for k in three]).T.copy(), np.concatenate([own[f"{k}.bias"] for k in three]), *(pair(k) for k in ("attention.output.dense", "attention.output.LayerNorm", "intermediate.dense", "output.dense", "output.LayerNorm"))))
        head = next((k for k in ("classifier", "linear") if f"{k}.weight" in weights), None)
        self.head = (np.asarray(weights[f"{head}.weight"], np.float32), np.asarray(weights[f"{head}.bias"], np.float32)) if head else None

    def first_states(self, ids: np.ndarray, mask: np.ndarray, types: np.ndarray) -> np.ndarray:
        """Last hidden state of the first token of each row."""
        rows, length = ids.shape
        x = layer_norm(self.words[ids] + self.places[:length] + self.types[types], *self.first)
        wide = x.shape[2] // self.heads
        hidden = np.where(mask[:, None, None, :] > 0, np.float32(0), np.float32(-1e4))
        for projections, bias, joined, norm, up, down, last in self.layers:
            q, k, v = (x @ projections + bias).reshape(rows, length, 3, self.heads, wide).transpose(2, 0, 3, 1, 4)
            seen = softmax(q @ k.swapaxes(-1, -2) / np.float32(np.sqrt(wide)) + hidden) @ v
            seen = seen.transpose(0, 2, 1, 3).reshape(rows, length, -1)
            x = layer_norm(x + seen @ joined[0].T + joined[1], *norm)
            x = layer_norm(x + gelu(x @ up[0].T + up[1]) @ down[0].T + down[1], *last)
        return x[:, 0]


def _batches(tokenizer, inputs: Sequence, size: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """(places in the input, ids, mask, types) by rising length, cut to LONGEST tokens."""
    tokenizer.no_padding()
    tokenizer.enable_truncation(LONGEST)
    coded = tokenizer.encode_batch(list(inputs))
    order = sorted(range(len(coded)), key=lambda i: len(coded[i].ids))
    for at in range(0, len(order), size):
        own = order[at : at + size]
        longest = max(1, *(len(coded[i].ids) for i in own))
        filled = np.zeros((3, len(own), longest), np.int64)
        for r, i in enumerate(own):
            n = len(coded[i].ids)
            filled[0, r, :n], filled[1, r, :n], filled[2, r, :n] = coded[i].ids, 1, coded[i].type_ids
        yield own, filled[0], filled[1], filled[2]


def _load(folder: str):
    from tokenizers import Tokenizer

    return Encoder(read_weights(f"{folder}/model.safetensors")), Tokenizer.from_file(f"{folder}/tokenizer.json")


def text_encoder(folder: str, batch: int = 32) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """Loader for `embed.ModelEmbedder`: texts to float32 vectors of unit length (first token's state, floor 1e-8); (0, width) for none."""

    def load() -> Callable[[list[str]], np.ndarray]:
        model, tokenizer = _load(folder)

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), model.words.shape[1]), np.float32)
            for own, ids, mask, types in _batches(tokenizer, texts, batch) if texts else ():
                x = model.first_states(ids, mask, np.zeros_like(types))
                out[own] = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), FLOOR)
            return out

        return encode

    return load


def pair_scores(model: Encoder, tokenizer, pairs: Sequence[tuple[str, str]], batch: int = 16) -> np.ndarray:
    """Raw scores of (query, passage) pairs, the higher the more relevant; empty for none."""
    out = np.zeros(len(pairs), np.float32)
    if model.head is None:
        raise ValueError("the model has no scoring head")
    for own, ids, mask, types in _batches(tokenizer, pairs, batch) if len(pairs) else ():
        out[own] = (model.first_states(ids, mask, types) @ model.head[0].T + model.head[1])[:, 0]
    return out


def pair_scorer(folder: str, batch: int = 16) -> Callable[[Column, Column], Column]:
    """A `score` for `fusion.rerank`: an Arrow-batched column function of (query, text). Null sides count as empty texts."""

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model, tokenizer = _load(folder)
        for q, t in batches:
            yield pd.Series(pair_scores(model, tokenizer, list(zip(q.fillna(""), t.fillna(""), strict=True)), batch), dtype="float64")

    return run
