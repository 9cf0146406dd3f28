"""Packing documents into sequences: linear grouping of the long pieces, then best fit of the short ones."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from quadlab.llm.common import written

#: Pieces longer than a sequence over one of LONG_FROM go through the grouped configurations; the bound that needs fewest sequences holds.
CAPACITY, GROUPS, LONG_FROM = 2048, 96, (5, 3, 2)
#: Texts in these characters tokenize alike in both libraries that hold the vocabulary; others take the slower one.
_PLAIN = re.compile(r"[\x01-\x7e\xa1-ɏ‐-‧]*")
#: White space other than single spaces and line ends between words: such texts are encoded whole.
_ODD = (*"\t\x0b\x0c\r\x1c\x1d\x1e\x1f", "  ", "\n\n", " \n", "\n ")


class _Encoder(dict):
    """Token ids as little-endian bytes; remembers what each space-separated chunk becomes."""

    def __init__(self, path: str, most: int = 1_500_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.most, self.whole = most, Tokenizer.from_file(path)
        ranks = path.removesuffix(".json") + ".tiktoken"
        self.fast = None
        if os.path.exists(ranks):
            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        out = self[chunk] = array("I", self.fast.encode_ordinary(chunk)).tobytes()  # native order: little-endian on what Spark runs on
        return out

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if self.fast is None or "<|" in text or not _PLAIN.fullmatch(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _ODD):
            return np.array(self.fast.encode_ordinary(text), dtype="<u4").tobytes()
        # one scan each: a chunk is a line end, or a word with the space before it
        return b"".join(map(self.__getitem__, text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")))


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of every row: its token ids, a closing 0, cut if longer than ``capacity``.

    The first piece of a long document is the short one. A null or empty text is the closing 0 alone. ``tokenizer_path`` must
    exist on every executor. Single spaces and line ends between non-space characters always part tokens in this vocabulary, so chunks are
    encoded once and remembered; texts with other white space are encoded whole.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _Encoder(tokenizer_path)
        for pdf in batches:
            texts = [enc.ids(t or "") + b"\0\0\0\0" for t in pdf["text"]]
            n = np.array([len(t) // 4 for t in texts])
            pieces = -(-n // capacity)
            row = np.repeat(np.arange(len(texts)), pieces)
            piece = np.arange(len(row)) - np.repeat(pieces.cumsum() - pieces, pieces)
            to = n[row] - (pieces[row] - piece - 1) * capacity
            at = np.maximum(to - capacity, 0)
            parts = [texts[r][4 * i:4 * j] for r, i, j in zip(row.tolist(), at.tolist(), to.tolist())]
            out = {"doc_id": pdf["doc_id"].to_numpy()[row], "piece": piece, "start": at, "length": to - at, "ids_crc32": [zlib.crc32(p) for p in parts]}
            yield pd.DataFrame(out | ({"ids": [np.frombuffer(p, "<i4") for p in parts]} if with_ids else {}))

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(
        run, "doc_id string, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    ).withColumn("doc_id", F.col("doc_id").cast("long"))


def _best_pattern(sizes: list[int], worth: np.ndarray, capacity: int) -> np.ndarray:
    """Multiset of sizes within capacity that is worth most: a knapsack, one more item at a time."""
    before = np.arange(capacity + 1)[:, None] - np.array(sizes)[None, :]
    fits, before = before >= 0, np.maximum(before, 0)
    best, choices = np.zeros(capacity + 1), []
    for _ in range(capacity // min(sizes)):
        v = np.where(fits, best[before] + worth, -1.0)
        pick = v.argmax(axis=1)
        v = v[np.arange(capacity + 1), pick]
        choices.append(np.where(v > best + 1e-12, pick, -1))
        best = np.maximum(best, v)
    out, c = np.zeros(len(sizes), dtype=np.int64), capacity
    for choice in reversed(choices):
        if choice[c] >= 0:
            out[choice[c]] += 1
            c -= sizes[choice[c]]
    return out


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often to use each so that no demand is exceeded: the rounded-down solution of the cutting-stock
    program, its columns generated by knapsacks (revised simplex over one basis of ``len(sizes)`` patterns)."""
    k = len(sizes)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    d = np.array(demand, dtype=float)
    for _ in range(40 * k):
        inverse = np.linalg.inv(basis)
        worth = np.maximum(inverse.sum(axis=0), 0)
        pattern = _best_pattern(sizes, worth, capacity)
        if worth @ pattern <= 1 + 1e-9:
            break
        x, step = inverse @ d, inverse @ pattern
        ratio = np.where(step > 1e-12, x / np.where(step > 1e-12, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = pattern
    x = np.linalg.inv(basis) @ d
    return [(basis[:, j].astype(np.int64), int(np.floor(x[j] + 1e-9))) for j in range(k) if x[j] >= 1 - 1e-9]


def _take(queue: list[list[int]], n: int) -> list[tuple[int, int]]:
    """The next n items of a queue of (length, count), and empty places when it runs dry."""
    out = []
    while n and queue:
        t = min(n, queue[0][1])
        out.append((queue[0][0], t))
        queue[0][1] -= t
        n -= t
        if not queue[0][1]:
            queue.pop(0)
    return out + ([(0, n)] if n else [])


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS,
         long_from: tuple[int, ...] = LONG_FROM) -> list[tuple[int, tuple[int, ...]]]:
    """The plan of fewest sequences among those for each bound between long and short pieces."""
    return min((_plan(histogram, capacity, groups, x) for x in long_from), key=lambda runs: sum(n for n, _ in runs))


def _plan(histogram: dict[int, int], capacity: int, groups: int, long_from: int) -> list[tuple[int, tuple[int, ...]]]:
    """How many sequences hold which lengths, from the number of pieces of each length.

    Long pieces, sorted by length, are cut into groups of equal cardinality and rounded up to the longest of their group;
    few-size configurations are optimised for the rounded instance; actual lengths take the places of their group; pieces left
    over by rounding the configurations down, and the short ones, go by best fit, longest first. All steps work on runs of equal sequences:
    the work depends on the number of lengths, never on the number of documents.
    """
    runs: list[tuple[int, tuple[int, ...]]] = []
    if histogram.get(capacity):
        runs.append((histogram[capacity], (capacity,)))
    long = [[n, c] for n, c in sorted(histogram.items(), reverse=True) if capacity // long_from < n < capacity and c]
    rest = {n: c for n, c in histogram.items() if 0 < n <= capacity // long_from and c}
    total = sum(c for _, c in long)
    open_: list[tuple[int, tuple[int, ...]]] = []
    if total:
        per = -(-total // groups)
        queues = []
        while long:
            queues.append([[n, c] for n, c in _take(long, per) if n])
        # several groups that round to one size are one size of the configurations
        merged: dict[int, list[list[int]]] = defaultdict(list)
        for q in queues:
            merged[q[0][0]] += q
        sizes = sorted(merged, reverse=True)
        demand = [sum(c for _, c in merged[s]) for s in sizes]
        for pattern, times in configurations(sizes, demand, capacity):
            slots = [_take(merged[sizes[j]], times) for j in range(len(sizes)) for _ in range(pattern[j])]
            at = 0
            while at < times:
                n = min(s[0][1] for s in slots)
                open_.append((n, tuple(s[0][0] for s in slots if s[0][0])))
                for s in slots:
                    if s[0][1] == n:
                        s.pop(0)
                    else:
                        s[0] = (s[0][0], s[0][1] - n)
                at += n
        for q in merged.values():
            for n, c in q:
                rest[n] = rest.get(n, 0) + c
    space: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    free: list[int] = []

    def add(n: int, held: tuple[int, ...]) -> None:
        left = capacity - sum(held)
        if not space[left]:
            insort(free, left)
        space[left].append((n, held))

    for n, held in open_:
        add(n, held)
    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            i = bisect_left(free, length)
            if i == len(free):
                add(-(-n // (capacity // length)), ())
                continue
            left = free[i]
            count, held = space[left].pop()
            if not space[left]:
                free.pop(i)
            t = min(n, count)
            if t < count:
                add(count - t, held)
            add(t, (*held, length))
            n -= t
    for left in space:
        runs += [r for r in space[left] if r[1]]
    return runs


def places(runs: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """``length, first rank, count, first sequence, offset`` of every place of every run."""
    used: dict[int, int] = defaultdict(int)
    out, base = [], 0
    for n, held in runs:
        offset = 0
        for length in held:
            out.append((length, used[length], n, base, offset))
            used[length] += n
            offset += length
        base += n
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to every row of ``pieces`` (written tables: they are read twice), by column ``length``.

    The driver sees one count per length. Pieces are ranked within their length in salted parts, so one length may hold any share
    of the rows; a piece's rank names its place. The table of places has some tens of rows per length, whatever the number of pieces.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(n < 1 or n > capacity for n in histogram):
        raise ValueError("a piece is empty or longer than a sequence")
    salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    others = [c for c in pieces.columns if c != "length"]
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(*others), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    within = Window.partitionBy("length", "__salt").orderBy(*others)
    ranked = (salted.withColumn("__row", F.row_number().over(within) - 1).join(starts, ["length", "__salt"])
              .withColumn("__rank", F.col("__row") + F.col("__from")))
    slots = spark.createDataFrame(places(plan(histogram, capacity)) or [(0, 0, 0, 0, 0)],
                                  "length long, __first long, __count long, __base long, offset long")
    return (ranked.join(F.broadcast(slots), "length").where("__rank >= __first and __rank < __first + __count")
            .withColumn("sequence_id", F.expr("__base + __rank - __first"))
            .select(*pieces.columns, "sequence_id", "offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece of every row of ``docs``.

    Only ``doc_id`` and ``text`` are used; null texts count as empty; repeated rows are packed each; an empty table gives no rows.
    """
    return pack(written(tokenized_pieces(docs, tokenizer_path, capacity)), capacity)


def sequences(pieces_with_ids: DataFrame) -> DataFrame:
    """``sequence_id, ids`` from packed pieces that still carry ``ids``: at most ``capacity`` ids each."""
    return (pieces_with_ids.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
            .select("sequence_id", F.flatten(F.col("p.ids")).alias("ids")))
