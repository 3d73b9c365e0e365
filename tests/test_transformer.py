import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import embed, fusion, transformer

tokenizers = pytest.importorskip("tokenizers")
WIDTH, LAYERS, VOCABULARY = 64, 2, ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "sales", "rose", "fell", "in", "the", "year", "costs"]


def write_model(folder, root=""):
    rng = np.random.default_rng(4)
    shapes = {"embeddings.word_embeddings.weight": (len(VOCABULARY), WIDTH), "embeddings.position_embeddings.weight": (512, WIDTH), "embeddings.token_type_embeddings.weight": (2, WIDTH), "embeddings.LayerNorm.weight": (WIDTH,), "embeddings.LayerNorm.bias": (WIDTH,)}
    for n in range(LAYERS):
        at = f"encoder.layer.{n}."
        for k in ("attention.self.query", "attention.self.key", "attention.self.value", "attention.output.dense"):
            shapes |= {f"{at}{k}.weight": (WIDTH, WIDTH), f"{at}{k}.bias": (WIDTH,)}
        shapes |= {f"{at}intermediate.dense.weight": (96, WIDTH), f"{at}intermediate.dense.bias": (96,), f"{at}output.dense.weight": (WIDTH, 96), f"{at}output.dense.bias": (WIDTH,)}
        for k in ("attention.output.LayerNorm", "output.LayerNorm"):
            shapes |= {f"{at}{k}.weight": (WIDTH,), f"{at}{k}.bias": (WIDTH,)}
    weights = {root + k: rng.normal(0, 0.3, s).astype(np.float32) for k, s in shapes.items()}
    weights |= {"classifier.weight": rng.normal(0, 0.3, (1, WIDTH)).astype(np.float32), "classifier.bias": np.array([0.1], np.float32)}
    table, at = {}, 0
    for k, v in weights.items():
        table[k] = {"dtype": "F32", "shape": list(v.shape), "data_offsets": [at, at + v.nbytes]}
        at += v.nbytes
    head = json.dumps(table | {"__metadata__": {}}).encode()
    folder.mkdir(exist_ok=True)
    (folder / "model.safetensors").write_bytes(len(head).to_bytes(8, "little") + head + b"".join(v.tobytes() for v in weights.values()))
    t = tokenizers.Tokenizer(tokenizers.models.WordLevel({w: k for k, w in enumerate(VOCABULARY)}, "[UNK]"))
    t.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    t.post_processor = tokenizers.processors.TemplateProcessing(single="[CLS] $A [SEP]", pair="[CLS] $A [SEP] $B:1 [SEP]:1", special_tokens=[("[CLS]", 2), ("[SEP]", 3)])
    t.save(str(folder / "tokenizer.json"))
    return {k.removeprefix(root): v.astype(np.float64) for k, v in weights.items()}


def one(w, ids, types):
    """The forward pass of one text, written out token by token and head by head."""

    def norm(v, name):
        return w[f"{name}.weight"] * (v - v.mean()) / np.sqrt(v.var() + 1e-12) + w[f"{name}.bias"]

    x = [norm(w["embeddings.word_embeddings.weight"][i] + w["embeddings.position_embeddings.weight"][p] + w["embeddings.token_type_embeddings.weight"][t], "embeddings.LayerNorm") for p, (i, t) in enumerate(zip(ids, types))]
    for n in range(LAYERS):
        at = f"encoder.layer.{n}."
        q, k, v = ([w[f"{at}attention.self.{s}.weight"] @ h + w[f"{at}attention.self.{s}.bias"] for h in x] for s in ("query", "key", "value"))
        new = []
        for a, own in enumerate(x):
            parts = []
            for h in range(0, WIDTH, 32):
                e = np.array([q[a][h : h + 32] @ kb[h : h + 32] / np.sqrt(32) for kb in k])
                e = np.exp(e - e.max())
                parts.append(sum(y * vb[h : h + 32] for y, vb in zip(e / e.sum(), v)))
            s = norm(own + w[f"{at}attention.output.dense.weight"] @ np.concatenate(parts) + w[f"{at}attention.output.dense.bias"], f"{at}attention.output.LayerNorm")
            u = w[f"{at}intermediate.dense.weight"] @ s + w[f"{at}intermediate.dense.bias"]
            g = 0.5 * u * (1 + np.tanh(np.sqrt(2 / np.pi) * (u + 0.044715 * u**3)))
            new.append(norm(s + w[f"{at}output.dense.weight"] @ g + w[f"{at}output.dense.bias"], f"{at}output.LayerNorm"))
        x = new
    return x[0]


def coded(*texts):
    ids, types = [2], [0]
    for k, t in enumerate(texts):
        own = [VOCABULARY.index(x) if x in VOCABULARY else 1 for x in t.split()] + [3]
        ids, types = ids + own, types + [k] * len(own)
    return ids[:512], types[:512]


def test_text_encoder_against_one_text_at_a_time(tmp_path):
    w = write_model(tmp_path / "m")
    texts = ["sales rose in the year", "", "costs", "costs fell and sales rose", "sales " * 700]
    got = transformer.text_encoder(str(tmp_path / "m"), 2)()(texts)
    for t, v in zip(texts[:4], got):
        x = one(w, *coded(t))
        assert np.allclose(v, x / np.linalg.norm(x), atol=1e-4)
    assert np.allclose(np.linalg.norm(got, axis=1), 1, atol=1e-5) and transformer.text_encoder(str(tmp_path / "m"))()([]).shape == (0, WIDTH)


def test_pair_scorer_and_rerank(spark, tmp_path):
    w = write_model(tmp_path / "m", "bert.")
    rows = [(1, k + 1, "sales rose", t) for k, t in enumerate(["costs fell", "sales rose in the year", "the year", None])]
    df = spark.createDataFrame(rows, "qid int, rank int, query string, text string")
    want = [float(w["classifier.weight"][0] @ one(w, *coded("sales rose", r[3] or "")) + 0.1) for r in rows]
    out = {r["text"]: (r["rerank_score"], r["rank"]) for r in fusion.rerank(df, 4, transformer.pair_scorer(str(tmp_path / "m"), 2)).collect()}
    assert np.allclose([out[r[3]][0] for r in rows], want, atol=1e-3)
    assert [out[r[3]][1] for r in rows] == [1 + sum(x > y for x in want) for y in want]


def test_embedder_and_loader(spark, tmp_path):
    write_model(tmp_path / "m")
    e = embed.ModelEmbedder(transformer.text_encoder(str(tmp_path / "m")))
    df = spark.createDataFrame([("a", "sales rose"), ("b", None)], "chunk_id string, text string")
    assert all(abs(sum(x * x for x in r["vector"]) - 1) < 1e-4 for r in embed.embed(df, e).collect())
    assert embed.embed(df.where(F.lit(False)), e).count() == 0
    assert transformer.snapshot(str(tmp_path / "m"), "/nowhere") == str(tmp_path / "m")
    with pytest.raises(FileNotFoundError):
        transformer.snapshot("some/model", str(tmp_path))
