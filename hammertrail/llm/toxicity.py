"""Toxicity scores from a bidirectional gated recurrent network with attention pooling over characters and words.

A word is read as the sum of its own vector and the mean of the vectors of its character n-grams (three and four
characters, ends marked), all by hash. Windows of ``WINDOW`` words overlap by half and cover the whole text; in a
window the states of all words are pooled by attention and give one probability, and the score of a text is the
largest one of its windows, so a short toxic passage is not averaged away.

The network is trained on the driver, by backpropagation through time, on at most ``SAMPLE`` toxic and twice as many
other labelled documents that ``learnable`` marks, in order of a hash of their ids; this bound is on training alone. A
text counts in training by the highest window of the whole text, which the executors find before each epoch, so the
driver holds one window per text. One in about ``HELD_OUT`` of the sample, by hash, is left out of training; its whole
texts, read in the same way, set the bias, so that a score of one half separates its two kinds best, where a false alarm
weighs as much as ``ALARM`` misses.

Defined cases: a text without words, or null, scores 0; without labelled texts of both kinds every text scores 0; rows
with one id are scored each; several labels of one id count each; further columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hammertrail.llm.gru import Adam, BiGru, sigmoid, softmax
from hammertrail.session import cut_lineage

WINDOW, STRIDE, UNITS, CHANNELS = 32, 16, 4, 8
WORD_SLOTS, GRAM_SLOTS = 1 << 13, 1 << 13
SAMPLE = 1500
EPOCHS, BATCH, RATE = 5, 128, 0.02
HELD_OUT, ALARM = 6, 5.0
#: Windows that run through the network together, and distinct words a task remembers.
TOGETHER, REMEMBERED = 4096, 200_000

#: ASCII characters other than letters, digits and the underscore separate words.
BREAKS = bytes(c if c >= 128 or chr(c).isalnum() or c == 95 else 32 for c in range(256))
NO_WORD = 0


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(BREAKS).split()


def slots(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot of every word; slots of the n-grams of its bytes, word after word; and how many n-grams each word has."""
    raw = [b"\x02%b\x03" % w for w in words]
    of_word = np.fromiter((zlib.crc32(w) for w in raw), np.uint32, len(raw)).astype(np.intp) % WORD_SLOTS
    joined = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(raw)), np.fromiter(map(len, raw), np.intp, len(raw)))
    found, owners = [], []
    for n in (3, 4):
        code = np.full(max(0, len(joined) - n + 1), n, np.uint32)
        for k in range(n):
            code = (code ^ joined[k : k + len(code)]) * np.uint32(16777619)
        code ^= code >> np.uint32(15)
        whole = owner[: len(code)] == owner[n - 1 :]
        found.append((code[whole] % np.uint32(GRAM_SLOTS)).astype(np.intp))
        owners.append(owner[: len(code)][whole])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return of_word, np.concatenate(found)[order], np.bincount(owners, minlength=len(raw))


def window_starts(n: int) -> range:
    """Starts of the overlapping windows over n words."""
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE) if n else range(0)


class ToxicityModel:
    def __init__(self, seed: int = 11):
        random = np.random.default_rng(seed)

        def normal(scale: float, *shape: int) -> np.ndarray:
            return (scale * random.normal(size=shape)).astype(np.float32)

        self.net = BiGru(UNITS, random)
        self.params = {
            "words": normal(0.05, WORD_SLOTS, CHANNELS), "grams": normal(0.1, GRAM_SLOTS, CHANNELS),
            "gates": normal(0.5, CHANNELS, 6 * UNITS), "gate_bias": np.zeros(6 * UNITS, np.float32),
            "attend": normal(0.5, 2 * UNITS, 2 * UNITS), "query": normal(0.5, 2 * UNITS),
            "out": normal(0.5, 2 * UNITS), "bias": np.zeros(1, np.float32), **self.net.params,
        }
        self.forget()

    def forget(self) -> None:
        """Row 0 of the gate inputs stands for no word."""
        self.known: dict[bytes, int] = {}
        self.gate_inputs = [np.zeros((1, 6 * UNITS), np.float32)]
        self.count = 1

    def vectors(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros((len(words), CHANNELS), np.float32)
        for at in range(0, len(words), 8192):
            of_word, grams, sizes = slots(words[at : at + 8192])
            starts = np.cumsum(sizes) - sizes
            out[at : at + 8192] = self.params["words"][of_word] + np.add.reduceat(self.params["grams"][grams], starts, axis=0) / sizes[:, None].astype(np.float32)
        return out

    def word_ids(self, texts: list[str]) -> list[np.ndarray]:
        """Rows of the gate input table for the words of each text; new words are added to it."""
        split = [words_of(text) for text in texts]
        if self.count > REMEMBERED:
            self.forget()
        new = list(set().union(*split).difference(self.known)) if split else []
        if new:
            self.known.update(zip(new, range(self.count, self.count + len(new)), strict=True))
            self.count += len(new)
            self.gate_inputs.append(self.vectors(new) @ self.params["gates"] + self.params["gate_bias"])
        return [np.fromiter(map(self.known.__getitem__, words), np.intp, len(words)) for words in split]

    def logits(self, windows: np.ndarray) -> np.ndarray:
        """One number per window of rows of the gate input table, by attention over the states."""
        if len(self.gate_inputs) > 1:
            self.gate_inputs = [np.concatenate(self.gate_inputs)]
        table, p, out = self.gate_inputs[0], self.params, np.zeros(len(windows), np.float32)
        out_ahead, out_back = p["out"][:UNITS], p["out"][UNITS:]
        for at in range(0, len(windows), TOGETHER):
            ids = np.ascontiguousarray(windows[at : at + TOGETHER].T)
            ahead, back = self.net.read(table, ids)
            total = np.zeros(ids.shape[1], np.float32)
            weight = np.full(ids.shape[1], 1e-9, np.float32)
            for a, b, x in zip(ahead, back, ids, strict=True):
                seen = a @ p["attend"][:UNITS]
                seen += b @ p["attend"][UNITS:]
                np.tanh(seen, out=seen)
                share = np.exp(seen @ p["query"])
                if not x.all():
                    share *= x != NO_WORD
                weight += share
                total += share * (a @ out_ahead + b @ out_back)
            out[at : at + TOGETHER] = total / weight + p["bias"][0]
        return out

    @staticmethod
    def cut(ids: np.ndarray) -> np.ndarray:
        starts = window_starts(len(ids))
        padded = np.zeros((starts[-1] + WINDOW) if len(starts) else 0, np.intp)
        padded[: len(ids)] = ids
        return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE] if len(starts) else np.zeros((0, WINDOW), np.intp)

    def best(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Highest number of the windows of each whole text, minus infinity without words, and the first window that has it."""
        made = [self.cut(ids) for ids in self.word_ids(texts)]
        counts = np.array([len(x) for x in made], np.int64)
        best, at = np.full(len(texts), -np.inf), np.zeros(len(texts), np.int64)
        if counts.sum():
            owner, logits = np.repeat(np.arange(len(texts)), counts), self.logits(np.concatenate(made))
            np.maximum.at(best, owner, logits)
            hit = np.flatnonzero(logits == best[owner])[::-1]
            at[owner[hit]] = hit
            at -= np.where(counts > 0, np.cumsum(counts) - counts, 0)
        return best, at

    def scores(self, texts: list[str]) -> np.ndarray:
        best, _ = self.best(texts)
        return np.where(np.isfinite(best), sigmoid(best), 0.0)

    def set_bias(self, best: np.ndarray, toxic: np.ndarray) -> None:
        """Move the bias so that zero separates the highest windows of the two kinds best."""
        yes, no = np.sort(best[toxic == 1]), np.sort(best[toxic == 0])
        levels = np.unique(best[np.isfinite(best)])
        middles = (levels[1:] + levels[:-1]) / 2
        if len(middles):
            missed = np.searchsorted(yes, middles) / len(yes)
            alarms = 1 - np.searchsorted(no, middles) / len(no)
            self.params["bias"] -= np.float32(middles[int((missed + ALARM * alarms).argmin())])

    def learn(self, windows: list[list[bytes]], toxic: np.ndarray, adam: Adam, epoch: int, random: np.random.Generator) -> None:
        """One epoch of cross entropy over one window per text, by backpropagation through time."""
        vocabulary = sorted(set().union(*windows))
        of_word, grams, sizes = slots(vocabulary)
        parts = (of_word, grams, sizes, np.cumsum(sizes) - sizes)
        place = {w: k for k, w in enumerate(vocabulary, 1)}
        rows = np.zeros((len(windows), WINDOW), np.intp)
        for row, words in zip(rows, windows, strict=True):
            row[: len(words)] = [place[w] for w in words]
        order, per_epoch = random.permutation(len(windows)), -(-len(windows) // BATCH)
        for step in range(per_epoch):
            pick = order[step * BATCH : (step + 1) * BATCH]
            adam.rate = RATE * (1 - 0.8 * (epoch * per_epoch + step) / (EPOCHS * per_epoch))
            self._step(adam, rows[pick].T, toxic[pick].astype(np.float32), parts)
        self.forget()

    def _step(self, adam: Adam, x: np.ndarray, target: np.ndarray, parts: tuple) -> None:
        p = self.params
        used, inverse = np.unique(x, return_inverse=True)
        inverse = inverse.reshape(x.shape)
        words = used[used != NO_WORD] - 1
        all_words, all_grams, all_sizes, all_starts = parts
        word_slots, sizes = all_words[words], all_sizes[words]
        starts = np.cumsum(sizes) - sizes
        grams = all_grams[np.repeat(all_starts[words] - starts, sizes) + np.arange(sizes.sum())]
        vectors = p["words"][word_slots] + np.add.reduceat(p["grams"][grams], starts, axis=0) / sizes[:, None].astype(np.float32)
        shift = int(used[0] == NO_WORD)
        table = np.zeros((len(used), 6 * UNITS), np.float32)
        table[shift:] = vectors @ p["gates"] + p["gate_bias"]
        states, memory = self.net.forward(table[inverse], keep=True)
        seen = np.tanh(states @ p["attend"])
        score = seen @ p["query"]
        score[x == NO_WORD] = -1e9
        share = softmax(score.T).T
        values = states @ p["out"]
        logit = (share * values).sum(axis=0) + p["bias"][0]
        error = (sigmoid(logit) - target) / len(target)
        g_values = share * error
        g_share = values * error
        g_score = share * (g_share - (share * g_share).sum(axis=0))
        g_seen = g_score[:, :, None] * p["query"] * (1 - seen * seen)
        g_states = g_values[:, :, None] * p["out"] + g_seen @ p["attend"].T
        flat = states.reshape(-1, 2 * UNITS)
        g_inputs, grads = self.net.backward(g_states, memory)
        g_table = np.zeros_like(table)
        np.add.at(g_table, inverse.ravel(), g_inputs.reshape(-1, 6 * UNITS))
        g_table = g_table[shift:]
        g_vectors = g_table @ p["gates"].T
        g_words, g_grams = np.zeros_like(p["words"]), np.zeros_like(p["grams"])
        np.add.at(g_words, word_slots, g_vectors)
        np.add.at(g_grams, grams, np.repeat(g_vectors / sizes[:, None].astype(np.float32), sizes, axis=0))
        adam.step(grads | {
            "words": g_words, "grams": g_grams, "gates": vectors.T @ g_table, "gate_bias": g_table.sum(axis=0),
            "attend": flat.T @ g_seen.reshape(-1, 2 * UNITS), "query": (g_score[:, :, None] * seen).sum(axis=(0, 1)),
            "out": flat.T @ g_values.ravel(), "bias": np.array([error.sum()], np.float32),
        })


def trained(docs: DataFrame, labels: DataFrame, learnable: Column) -> ToxicityModel | None:
    marked = labels.filter(F.col("toxic").isNotNull()).select("doc_id", (F.col("toxic") == 1).cast("int").alias("_toxic"))
    marked = marked.filter(learnable).withColumn("_h", F.xxhash64("doc_id"))
    # At most 3 * SAMPLE ids are broadcast; their whole texts stay with the executors, and a window of each comes to the driver.
    kinds = [marked.filter(F.col("_toxic") == k).orderBy("_h", "doc_id").limit((2 - k) * SAMPLE).select("doc_id", "_toxic") for k in (0, 1)]
    sample = docs.select("doc_id", "text").join(F.broadcast(kinds[0].unionByName(kinds[1])), "doc_id")
    held = F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(HELD_OUT)) == 0
    sample = cut_lineage(sample.select(F.col("doc_id").cast("long"), "text", F.col("_toxic").alias("toxic"), held.alias("held")))
    kinds_of = {(r.held, r.toxic) for r in sample.filter(F.trim(F.coalesce("text", F.lit(""))) != "").select("held", "toxic").distinct().collect()}
    if {toxic for _, toxic in kinds_of} != {0, 1}:
        return None
    apart = len(kinds_of) == 4
    model, random = ToxicityModel(), np.random.default_rng(13)
    adam = Adam(model.params, RATE)
    for epoch in range(EPOCHS):
        windows, _, toxic = highest(model, sample.filter(~F.col("held")) if apart else sample)
        good = [k for k, x in enumerate(windows) if x]
        if not good:
            return None
        model.learn([windows[k] for k in good], toxic[good], adam, epoch, random)
    if apart:
        _, best, toxic = highest(model, sample.filter("held"))
        model.set_bias(best, toxic)
    return model


def highest(model: ToxicityModel, sample: DataFrame) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """The words of the highest window of each whole text, its number, and whether the text is toxic."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch["text"].to_pylist()]
            best, at = model.best(texts)
            words = [b" ".join(words_of(x)[k * STRIDE : k * STRIDE + WINDOW]) for x, k in zip(texts, at.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["toxic"], pa.array(words, pa.binary()), pa.array(best)], ["doc_id", "toxic", "words", "best"])

    rows = sample.select("doc_id", "text", "toxic").mapInArrow(read, "doc_id long, toxic int, words binary, best double").toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("toxic", "ascending"), ("words", "ascending")])
    return [x.split() for x in rows["words"].to_pylist()], rows["best"].to_numpy(), rows["toxic"].to_numpy()


def score(docs: DataFrame, labels: DataFrame, learnable: Column) -> DataFrame:
    """(doc_id, score), one row per row of ``docs``; ``learnable`` is an expression on ``doc_id``."""
    model = trained(docs, labels, learnable)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch["text"].to_pylist()]
            scores = model.scores(texts) if model else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores.astype(np.float64))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(predict, "doc_id long, score double")
