"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads windows of ``WINDOW`` bytes, gives every position a probability per language, and the probabilities
of all positions of a text are averaged. Windows cover the whole text without overlap. It is trained on the driver, by
backpropagation through time, on at most ``PER_LANGUAGE`` documents of every language that ``learnable`` marks, taken in
order of a hash of their ids, and at most ``SAMPLE_WINDOWS`` windows of each; every language with a learnable text that
holds a letter is learned.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; rows without language are predicted and
not learned from; without any row to learn from all texts are ``und``; rows with one id are predicted each; further
columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hammertrail.llm.gru import Adam, BiGru, softmax

WINDOW, UNITS = 96, 4
PER_LANGUAGE, SAMPLE_WINDOWS = 750, 4
STEPS, BATCH, RATE = 160, 256, 0.03
#: Windows that run through the network together.
TOGETHER = 4096

LETTER = regex.compile(r"\p{L}")


def windows(raw: bytes) -> np.ndarray:
    """The bytes of a text in rows of ``WINDOW``, the last one filled up with zeros."""
    rows = -(-len(raw) // WINDOW)
    out = np.zeros(rows * WINDOW, np.uint8)
    out[: len(raw)] = np.maximum(np.frombuffer(raw, np.uint8), 1)  # 0 marks the filling alone
    return out.reshape(rows, WINDOW)


class LanguageModel:
    def __init__(self, languages: list[str], seed: int = 3):
        random = np.random.default_rng(seed)
        self.languages, self.net = languages, BiGru(UNITS, random)
        self.params = {
            "bytes": (0.3 * random.normal(size=(256, 6 * UNITS))).astype(np.float32),
            "out": (0.3 * random.normal(size=(2 * UNITS, len(languages)))).astype(np.float32),
            "bias": np.zeros(len(languages), np.float32),
            **self.net.params,
        }

    def train(self, rows: np.ndarray, targets: np.ndarray, steps: int = STEPS, seed: int = 5) -> None:
        """Cross entropy of every position of every window, by backpropagation through time."""
        random, adam = np.random.default_rng(seed), Adam(self.params, RATE)
        n_langs = len(self.languages)
        for step in range(steps):
            adam.rate = RATE * (1 - 0.9 * step / steps)
            pick = random.integers(0, len(rows), min(BATCH, len(rows)))
            x = rows[pick].T
            real = (x > 0).astype(np.float32)[:, :, None]
            states, memory = self.net.forward(self.params["bytes"][x], keep=True)
            error = softmax(states @ self.params["out"] + self.params["bias"])
            error[:, np.arange(len(pick)), targets[pick]] -= 1
            error *= real / real.sum()
            flat, flat_error = states.reshape(-1, 2 * UNITS), error.reshape(-1, n_langs)
            grad_inputs, grads = self.net.backward(error @ self.params["out"].T, memory)
            by_byte = np.zeros((256, 6 * UNITS), np.float32)
            np.add.at(by_byte, x.ravel(), grad_inputs.reshape(-1, 6 * UNITS))
            adam.step(grads | {"bytes": by_byte, "out": flat.T @ flat_error, "bias": flat_error.sum(axis=0)})

    def summed(self, rows: np.ndarray) -> np.ndarray:
        """Per window the sum over its positions of their language probabilities."""
        ids = np.ascontiguousarray(rows.T).astype(np.intp)
        ahead, back = self.net.read(self.params["bytes"], ids)
        out_ahead, out_back = self.params["out"][:UNITS], self.params["out"][UNITS:]
        ones = np.ones((len(self.languages), len(self.languages)), np.float32)
        total = np.zeros((len(rows), len(self.languages)), np.float32)
        for a, b, x in zip(ahead, back, ids, strict=True):
            p = a @ out_ahead
            p += b @ out_back
            p += self.params["bias"]
            np.exp(p, out=p)  # states lie in -1..1 and the weights are small, so this can't overflow
            p /= p @ ones
            if not x.all():
                p *= (x > 0)[:, None]
            total += p
        return total

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities of the positions of each text."""
        cut = [windows(raw) for raw in texts]
        rows = np.concatenate([np.zeros((0, WINDOW), np.uint8), *cut])
        owner = np.repeat(np.arange(len(texts)), [len(x) for x in cut])
        sums = np.zeros((len(texts), len(self.languages)))
        for at in range(0, len(rows), TOGETHER):
            np.add.at(sums, owner[at : at + TOGETHER], self.summed(rows[at : at + TOGETHER]))
        return sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-9)


def trained(docs: DataFrame, learnable: Column) -> LanguageModel | None:
    rows = docs.filter(learnable & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    place_of = F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id"))
    ids = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("_h")).withColumn("_place", place_of)
    ids = ids.filter(F.col("_place") <= PER_LANGUAGE).select("doc_id", "lang")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, parts = [], []
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                made = windows(text.encode()) if LETTER.search(text) else []
                for k in np.linspace(0, len(made) - 1, min(len(made), SAMPLE_WINDOWS)).astype(int):
                    langs.append(lang)
                    parts.append(made[k].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(parts, pa.binary())], ["lang", "part"])

    # For every language at most PER_LANGUAGE ids are joined, and SAMPLE_WINDOWS times as many windows come to the driver.
    sample = rows.join(ids.distinct(), ["doc_id", "lang"], "left_semi").select("lang", "text").mapInArrow(cut, "lang string, part binary").toArrow()
    if not sample.num_rows:
        return None
    languages = sorted(set(sample["lang"].to_pylist()))
    place = {x: k for k, x in enumerate(languages)}
    kept = sorted((place[x], part) for x, part in zip(sample["lang"].to_pylist(), sample["part"].to_pylist(), strict=True))
    model = LanguageModel(languages)
    model.train(np.frombuffer(b"".join(p for _, p in kept), np.uint8).reshape(-1, WINDOW), np.array([k for k, _ in kept]))
    return model


def identify(docs: DataFrame, learnable: Column) -> DataFrame:
    """(doc_id, lang_pred, score), one row per row of ``docs``."""
    model = trained(docs, learnable)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            good = [k for k, x in enumerate(texts) if model and x and LETTER.search(x)]
            if good:
                pooled = model.pooled([texts[k].encode() for k in good])
                for k, row in zip(good, pooled, strict=True):
                    names[k], scores[k] = model.languages[int(row.argmax())], float(min(1.0, row.max()))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")
