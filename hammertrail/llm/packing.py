"""Packing token sequences by cutting-stock column generation.

Each text is tokenized once. A document longer than a sequence gives whole sequences and one rest; the rests are
packed. Their lengths, rounded up to ``STEP`` tokens, form a histogram of at most ``CAPACITY / STEP`` classes, the
only thing that reaches the driver. There the linear program over patterns (how many rests of each class fill one
sequence) is solved by column generation: a simplex basis over the classes, and a knapsack by dynamic programming
that prices the best new pattern. Patterns are used as often as the program says, rounded down; what remains is
packed by first fit decreasing. Classes are then joined to their places: the rests of a class are ranked, by prefix
sums over (class, hash) cells and inside each cell, and the ranks of a class are dealt to the patterns in turn.

Defined cases: a null text is an empty text, which still has its end token; rows with the same id are separate
documents; further columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import itertools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hammertrail.llm.common import unit_hash
from hammertrail.session import cut_lineage

CAPACITY, STEP, END = 2048, 8, 1
UNITS = CAPACITY // STEP
#: Hash cells per class, so that a class with a third of all rows is ranked in many tasks.
CELLS = 64
#: Distinct pieces of text whose ids a task remembers.
REMEMBERED = 200_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in vocabularies of bytes: itself if it prints, else the next after 255."""
    printed = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printed]
    return {b: chr(b) for b in printed} | {b: chr(256 + k) for k, b in enumerate(others)}


#: Letters whose lower case and kind are the same everywhere; texts of these, printable ASCII and white space are cut here.
LATIN = "À-ÖØ-öø-\u012f\u0131-\u017f"
PLAIN = re.compile(rf"[\x20-\x7e\t\n\x0b\x0c\r{LATIN}]*")
#: The pattern by which the tokenizer cuts lower-cased text, for these characters.
CUT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LATIN}]+|[0-9]|[^\sa-z0-9{LATIN}]+")


class PieceTokenizer:
    """Ids of texts from the remembered ids of their pieces.

    A piece is what the tokenizer cuts a lower-cased text into: a word, a digit, a run of signs. White-space chunks
    with other characters, or with the start of a special token, go through the whole tokenizer and are remembered
    too. Beyond ``REMEMBERED`` entries the older half is forgotten.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(b"".join(self._runs(text)), "<u4") for text in texts]

    def _runs(self, text: str) -> Iterator[bytes]:
        if PLAIN.fullmatch(text) and "<|" not in text:
            yield from self._plain(text)
            return
        # Runs of plain chunks between others; ASCII white space, at which bytes are split, is never inside a token.
        chunks, plain = [x.decode() for x in text.encode().split()], []
        for chunk in chunks:
            if PLAIN.fullmatch(chunk) and "<|" not in chunk:
                plain.append(chunk)
                continue
            yield from self._plain(" ".join(plain))
            plain = []
            if chunk not in self.chunks:
                self._forget(self.chunks)
                self.chunks[chunk] = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
            yield self.chunks[chunk]
        yield from self._plain(" ".join(plain))

    def _plain(self, text: str) -> Iterator[bytes]:
        cut, known = CUT.findall(text.lower()), self.pieces
        new = set(cut).difference(known)
        if new:
            self._forget(known)
            new = set(cut).difference(known)
        for piece in new:
            letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            known[piece] = struct.pack(f"<{len(found := self.model.tokenize(letters))}I", *[token.id for token in found])
        return map(known.__getitem__, cut)

    @staticmethod
    def _forget(known: dict) -> None:
        if len(known) > REMEMBERED:
            for key in list(itertools.islice(known, REMEMBERED // 2)):
                del known[key]


def token_pieces(docs: DataFrame, path: str) -> DataFrame:
    """The pieces of every document: whole sequences, then the rest."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize = PieceTokenizer(path)
        for batch in batches:
            made = []
            texts = [x or "" for x in batch["text"].to_pylist()]
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), tokenize(texts), strict=True):
                ids = np.append(ids, np.uint32(END)).astype("<u4")
                for at in range(0, len(ids), CAPACITY):
                    piece = ids[at : at + CAPACITY]
                    made.append((doc_id, at, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
            columns = list(zip(*made, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, PIECES)


def priced_patterns(prices: np.ndarray) -> np.ndarray:
    """Knapsack by dynamic programming: for every class the pattern of most worth that holds it, best first.

    Class k + 1 takes k + 1 units of the room.
    """
    n = len(prices)
    worth, fill = np.zeros(n + 1), np.zeros((n + 1, n), np.int16)
    for room in range(1, n + 1):
        options = worth[room - 1 :: -1][:room] + prices[:room]
        k = int(options.argmax())
        if options[k] > worth[room - 1]:
            worth[room], fill[room] = options[k], fill[room - 1 - k]
            fill[room, k] += 1
        else:
            worth[room], fill[room] = worth[room - 1], fill[room - 1]
    classes = np.arange(n)
    patterns = fill[n - 1 - classes].copy()
    patterns[classes, classes] += 1
    order = np.argsort(-(worth[n - 1 - classes] + prices), kind="stable")
    return patterns[order]


def _exchange(basis: np.ndarray, inverse: np.ndarray, out: int, column: np.ndarray) -> np.ndarray:
    """Put ``column`` at place ``out`` of the basis; returns the new inverse."""
    direction = inverse @ column
    pivot = inverse[out] / direction[out]
    basis[:, out] = column
    inverse = inverse - np.outer(direction, pivot)
    inverse[out] = pivot
    return inverse


def solve_patterns(demand: np.ndarray, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Column generation for min sum(x), patterns @ x >= demand, x >= 0: the basis patterns (rows) and their x.

    The first basis is greedy: sequences are filled with the largest classes that are left until one runs out, and each
    such pattern stands for the class that it used up. A round prices patterns once and brings in those that still gain. ``rounds`` only bounds the polish of the program: any basis met on the way packs all rests.
    """
    classes = np.flatnonzero(demand)
    n = len(demand)
    basis = np.diag((n // (classes + 1)).astype(float))
    inverse, greedy = np.diag(1.0 / np.diag(basis)), []
    left = demand[classes].astype(float)
    while (left > 0).any():
        pattern, room = np.zeros(len(classes)), n
        for k in np.flatnonzero(left > 0)[::-1]:
            pattern[k], room = room // (classes[k] + 1), room % (classes[k] + 1)
        used = np.flatnonzero(pattern)
        gone = used[(left[used] / pattern[used]).argmin()]
        left = np.maximum(left - pattern * (left[gone] / pattern[gone]), 0.0)
        left[gone] = 0.0
        greedy.append((int(gone), pattern))
    for gone, pattern in reversed(greedy):  # a pattern holds only classes that run out with it or later
        inverse = _exchange(basis, inverse, gone, pattern)
    x = np.maximum(inverse @ demand[classes], 0.0)
    for _ in range(rounds):
        prices = np.zeros(n)
        prices[classes] = np.maximum(0.0, inverse.sum(axis=0))
        gained = False
        for column in priced_patterns(prices)[:, classes].astype(float):
            if column @ inverse.sum(axis=0) <= 1 + 1e-7:
                continue
            direction = inverse @ column
            up = direction > 1e-9
            if not up.any():
                continue
            ratios = np.full(len(x), np.inf)
            ratios[up] = x[up] / direction[up]
            out = int(ratios.argmin())
            step = ratios[out]
            x = x - step * direction
            x[out] = step
            inverse = _exchange(basis, inverse, out, column)
            gained = True
        if not gained:
            break
        x = np.maximum(inverse @ demand[classes], 0.0)
    patterns = np.zeros((len(classes), n), np.int64)
    patterns[:, classes] = basis.T.round().astype(np.int64)
    return patterns, x


def first_fit(demand: np.ndarray) -> list[np.ndarray]:
    """Patterns for a small rest of the demand, largest classes first."""
    n, made, left = len(demand), [], demand.copy()
    while left.any():
        pattern, room = np.zeros(n, np.int64), n
        for k in range(n - 1, -1, -1):
            take = min(int(left[k]), room // (k + 1))
            pattern[k] += take
            left[k] -= take
            room -= take * (k + 1)
        made.append(pattern)
    return made


def plan(histogram: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """Places of each class: (class, first rank, rests per sequence, sequences, first sequence)."""
    demand = np.zeros(UNITS, np.int64)
    for k, n in histogram.items():
        demand[k - 1] = n
    patterns, x = solve_patterns(demand)
    uses = np.floor(x + 1e-9).astype(np.int64)
    chosen = [(p, int(u)) for p, u in zip(patterns, uses, strict=True) if u]
    left = demand - sum((p * u for p, u in chosen), np.zeros(UNITS, np.int64))
    # A pattern may offer more places than there are rests; places without a rest stay empty.
    chosen += [(p, 1) for p in first_fit(np.maximum(left, 0))]
    places, rank, sequence = [], np.zeros(UNITS, np.int64), 0
    for pattern, use in chosen:
        for k in np.flatnonzero(pattern):
            places.append((int(k) + 1, int(rank[k]), int(pattern[k]), use, sequence))
            rank[k] += pattern[k] * use
        sequence += use
    return places


def packed(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per piece with its sequence and its offset there."""
    pieces = cut_lineage(token_pieces(docs, path or vocabulary()))
    pieces = pieces.withColumn("class", F.ceil(F.col("length") / STEP).cast("int"))
    pieces = pieces.withColumn("cell", unit_hash(F.col("doc_id"), F.col("start")) % CELLS)
    cells = cut_lineage(pieces.groupBy("class", "cell").agg(F.count("*").alias("_n")))
    histogram = {r["class"]: r["n"] for r in cells.groupBy("class").agg(F.sum("_n").alias("n")).collect()}
    places = plan(histogram)
    before = Window.partitionBy("class").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("class", "cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("class", "cell").orderBy("doc_id", "start", "ids_crc32")
    ranked = (
        pieces.withColumn("_rank", F.row_number().over(inside)).join(cells, ["class", "cell"])
        .withColumn("_rank", F.col("_rank") + F.col("_before") - 1)
    )
    table = {k: np.array([p[1:] for p in places if p[0] == k], np.int64) for k in histogram}
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, ranks = batch["class"].to_numpy(), batch["_rank"].to_numpy()
            sequence = np.zeros(len(kinds), np.int64)
            for k in np.unique(kinds):
                mine = kinds == k
                first, each, _, base = table[int(k)].T
                at = np.searchsorted(first, ranks[mine], side="right") - 1
                sequence[mine] = base[at] + (ranks[mine] - first[at]) // each[at]
            yield batch.select(names).append_column("sequence_id", pa.array(sequence))

    placed = ranked.select(*names, "class", "_rank").mapInArrow(assign, f"{PIECES}, sequence_id long")
    order = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "doc_id", "start", "ids_crc32")
    offset = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("offset", offset.cast("long"))
