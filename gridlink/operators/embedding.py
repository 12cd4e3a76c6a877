"""Name similarity by sentence embeddings: a local model graph, masked mean pooling, unit vectors, cosine.

No model ships with the library. An encoder is anything with encode(texts) -> (token vectors, attention masks); the two
optional scorers load one from the folder that an environment setting names, checked by digest, once in each Python
worker. Names are encoded by Arrow batches, each distinct name of a batch once; `embed_distinct` does so for a whole
column, by a join on the distinct names.

Defined cases: null and blank names have no vector and score 0; a zero vector stays zero and scores 0; a mask that
selects no token is an error; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import importlib.util
import os
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from pathlib import Path
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlink.functions import vectors
from gridlink.operators import resolve as rs

# The model whose published figures this one's can be held against.
MODEL_ID = "sentence-transformers/all-MiniLM-L6-v2"
MODEL_REVISION = "1110a243fdf4706b3f48f1d95db1a4f5529b4d41"
MODEL_LICENSE = "apache-2.0"
DIGESTS = {
    "fp32": "e3fe9a9a8c877bd5ca0deebb6303aba138acc6818440211377afaca1ba78b511",
    "int8": "eebed71d4f7671a4d8093decee1fb23018992e139813f30d502bf16ee408208e",
    "tokenizer": "da0e79933b9ed51798a3ae27893d3c5fa4a201126cef75586296df9b4d2c62a0",
}
MAX_TOKENS, PAD_TOKEN, PAD_ID = 128, "[PAD]", 0
QUANTIZED_OPERATORS = ("DynamicQuantizeLinear", "MatMulInteger", "QGemm", "QLinearMatMul")
EXPECTED_QUANTIZED = ("DynamicQuantizeLinear", "MatMulInteger")
REPLACED_BY = {"Gemm": "QGemm", "MatMul": "MatMulInteger"}
EXPECTED_CONVERSION = {"Gemm": (0, 0, 0), "MatMul": (36, 48, 12)}

FOLDER_SETTING = "GRIDLINK_MODEL_DIR"


class Encoder(Protocol):
    def encode(self, texts: Sequence[str]) -> tuple[Any, Any]:
        """Token vectors [text, token, dimension] and attention masks [text, token]."""


@dataclass(frozen=True)
class Artifact:
    """A file that must be there with this SHA-256."""

    path: Path
    sha256: str

    def problem(self) -> str | None:
        if not self.path.is_file():
            return f"artifact missing at {self.path}"
        digest = hashlib.sha256()
        with self.path.open("rb") as f:
            while part := f.read(1 << 20):
                digest.update(part)
        if digest.hexdigest() != self.sha256:
            return f"artifact checksum mismatch at {self.path}: expected {self.sha256}, got {digest.hexdigest()}"
        return None


class FolderNotSet(RuntimeError):
    """The environment names no folder of models."""


class OperatorMismatch(RuntimeError):
    """A quantized graph that isn't the one whose figures are known."""


def artifacts(kind: str, environ: Mapping[str, str] | None = None) -> tuple[Artifact, Artifact]:
    """Model and tokenizer of fp32 or int8; both share one tokenizer."""
    folder = (os.environ if environ is None else environ).get(FOLDER_SETTING)
    if not folder:
        raise FolderNotSet(f"{FOLDER_SETTING} is not set; it names the folder that holds {kind}/model.onnx and fp32/tokenizer.json")
    return Artifact(Path(folder) / kind / "model.onnx", DIGESTS[kind]), Artifact(Path(folder) / "fp32" / "tokenizer.json", DIGESTS["tokenizer"])


def model_identity(kind: str) -> dict[str, str]:
    return {"model_id": MODEL_ID, "revision": MODEL_REVISION, "checksum_sha256": DIGESTS[kind], "license": MODEL_LICENSE}


def probe(kind: str, environ: Mapping[str, str] | None = None) -> str | None:
    """Why the scorer can't be had, the cheapest look first; None if it can."""
    for name in ("onnxruntime", "tokenizers"):
        if importlib.util.find_spec(name) is None:
            return f"the {name!r} package is not installed"
    try:
        needed = artifacts(kind, environ)
    except FolderNotSet as e:
        return str(e)
    return next((p for p in (a.problem() for a in needed) if p), None)


class GraphEncoder:
    """A local model graph and its tokenizer, opened where it is first used and never sent to another process."""

    def __init__(self, model: str, tokenizer: str):
        self.model, self.tokenizer, self._open = model, tokenizer, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_open": None}

    def encode(self, texts: Sequence[str]) -> tuple[Any, Any]:
        if self._open is None:
            import onnxruntime
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(self.tokenizer)
            tokenizer.enable_padding(pad_token=PAD_TOKEN, pad_id=PAD_ID)
            tokenizer.enable_truncation(max_length=MAX_TOKENS)
            self._open = tokenizer, onnxruntime.InferenceSession(self.model, providers=["CPUExecutionProvider"])
        tokenizer, session = self._open
        got = tokenizer.encode_batch(list(texts))
        mask = np.array([g.attention_mask for g in got], np.int64)
        feed = {"input_ids": np.array([g.ids for g in got], np.int64), "attention_mask": mask, "token_type_ids": np.array([g.type_ids for g in got], np.int64)}
        return session.run(None, feed)[0], mask


def pool(tokens: Any, mask: Any) -> np.ndarray:
    """Mean over the tokens that the mask selects, as unit vectors. tokens [text, token, dimension], mask [text, token]."""
    tokens, mask = np.asarray(tokens, np.float64), np.asarray(mask, np.float64)
    many = mask.sum(1)
    if (many == 0).any():
        raise ValueError("attention mask selects no tokens to pool")
    mean = (tokens * mask[:, :, None]).sum(1) / many[:, None]
    norm = np.sqrt((mean * mean).sum(1, keepdims=True))
    return mean / np.where(norm == 0, 1.0, norm)


def embedder(encoder: Encoder, at_once: int = 64) -> Callable[[Column], Column]:
    """A column function from names to unit vectors; null and blank names have none."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for names in batches:
            distinct = [n for n in dict.fromkeys(names) if n is not None and n.strip()]
            known: dict[str, np.ndarray] = {}
            for k in range(0, len(distinct), at_once):
                some = distinct[k : k + at_once]
                known.update(zip(some, pool(*encoder.encode(some)), strict=True))
            yield pd.Series([known.get(n) for n in names], dtype=object)

    return embed


def embed_distinct(rows: DataFrame, encoder: Encoder, name_col: str = "name") -> DataFrame:
    """rows with `prepared`, each distinct name of the table encoded once and joined back."""
    names = rows.select(F.col(name_col).alias("_name")).distinct().withColumn("prepared", embedder(encoder)(F.col("_name")))
    return rows.join(names, F.col(name_col).eqNullSafe(F.col("_name")), "left").drop("_name")


def similarity(a: Column, b: Column) -> Column:
    """Cosine moved to 0..1; 0 where either side has no vector or a zero one."""
    return vectors.cosine01(a, b)


def scorer(name: str, encoder: Encoder) -> rs.Scorer:
    return rs.Scorer(name, embedder(encoder), similarity)


def _loader(kind: str) -> Callable[[], rs.Scorer]:
    def load() -> rs.Scorer:
        model, tokenizer = artifacts(kind)
        return scorer(f"embed-{kind}", GraphEncoder(str(model.path), str(tokenizer.path)))

    return load


for _kind in ("fp32", "int8"):
    rs.register_optional(f"embed-{_kind}", lambda kind=_kind: probe(kind), _loader(_kind))


def operators_present(counts: DataFrame) -> DataFrame:
    """counts (op_type, n) to the quantized operator types among them, one row with a sorted array."""
    return counts.where(F.col("op_type").isin(*QUANTIZED_OPERATORS)).agg(F.array_sort(F.collect_set("op_type")).alias("present"))


def conversion_census(counts: DataFrame) -> DataFrame:
    """counts (op_type, n): for each matrix operator how many were converted, are left, and were there in all."""
    def of(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("op_type") == name, F.col("n"))), F.lit(0).cast("long"))

    both = F.array(*(F.struct(F.lit(old).alias("op_type"), of(new).alias("converted"), of(old).alias("remaining")) for old, new in REPLACED_BY.items()))
    rows = counts.agg(both.alias("rows")).select(F.inline("rows"))
    return rows.withColumn("fp32", F.col("converted") + F.col("remaining"))


def verify_quantized(counts: DataFrame) -> dict[str, tuple[int, int, int]]:
    """The census (converted, in all, remaining) of the known int8 graph; any other graph is an error."""
    present = tuple(operators_present(counts).first()["present"])
    if present != EXPECTED_QUANTIZED:
        raise OperatorMismatch(f"the graph's quantized operators are {list(present)}, expected {list(EXPECTED_QUANTIZED)}")
    found = {r["op_type"]: (r["converted"], r["fp32"], r["remaining"]) for r in conversion_census(counts).collect()}
    if found != EXPECTED_CONVERSION:
        raise OperatorMismatch(f"the graph's matrix operators (converted, in all, left) are {found}, expected {EXPECTED_CONVERSION}")
    return found
