"""Passages that repeat across texts: MinHash banding of paragraphs, exact checks, and clusters of what to remove."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from quadlab.llm.common import checked, clean, fresh, release, written
from quadlab.llm.set_links import components_of_alike
from quadlab.llm.shingles import WordHashes, mixed, permutations, shingle_hashes

#: Five bands of two rows meet 99.4 % of the paragraph pairs at a similarity of 0.8, and 99.98 % at 0.9.
BANDS, ROWS, SEED = 5, 2, 113
#: Similarity (percent) of five-word shingle sets, and how many words a removed passage has at least.
PERCENT, SHINGLE, MIN_WORDS = 80, 5, 25
#: One of so many sentence ends, and one of so many other words, end a paragraph inside a line.
SENTENCES, OTHERS = 16, 512
#: Anchors are runs of GRAM words, the least hash of each GAP neighbours: two texts that share GRAM + GAP - 1 = 48 words share an anchor in them.
GRAM, GAP = 16, 33
#: Texts are read together, up to about so many characters at once.
TOGETHER = 1_000_000


class Words:
    """The words of several texts, one text after the other: hashes of their lower-cased forms, where they begin and end in their text (code points), and after which a paragraph ends.

    The words of text ``i`` are those from ``first[i]`` up to ``upto[i]``; each distinct word is hashed once.
    """

    def __init__(self, texts: list[str], cache: WordHashes):
        raws = [t.encode("utf-8", "surrogatepass") for t in texts]
        raw = b" ".join(raws)
        heads = np.cumsum([0] + [len(r) + 1 for r in raws])[:-1]
        b = np.frombuffer(raw, dtype=np.uint8)
        space = np.concatenate(([True], (b == 32) | ((b >= 9) & (b <= 13)), [True]))
        edges = np.flatnonzero(space[1:] != space[:-1])
        first, last = edges[0::2], edges[1::2] - 1
        self.n = len(first)
        ends = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(last - first + 1, dtype=np.int64)))
        letters = np.frombuffer(raw.lower(), dtype=np.uint8)[~space[1:-1]]
        coded = pa.Array.from_buffers(pa.large_binary(), self.n, [None, pa.py_buffer(ends), pa.py_buffer(letters)]).dictionary_encode()
        self.h = cache.of(coded.dictionary)[coded.indices.to_numpy()]
        self.first = np.searchsorted(first, heads)
        self.upto = np.append(self.first[1:], self.n)
        counts = self.upto - self.first
        chars = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum((b & 0xC0) != 0x80)))
        base = np.repeat(chars[heads], counts)
        self.start, self.end = chars[first] - base, chars[last + 1] - base
        self.lines = np.searchsorted(first, np.flatnonzero(b == 10))
        end = b[last]
        # after which words a paragraph ends inside a line: places chosen by a hash of the two words before, so that copies are cut alike wherever they stand
        before = np.zeros(self.n, dtype=np.uint64)
        before[1:] = self.h[:-1]
        before[self.first[counts > 0]] = 0
        pick = mixed(self.h + np.uint64(3) * before)
        stops = (end == 33) | (end == 46) | (end == 63)
        self.inside = np.flatnonzero((stops & (pick % np.uint64(SENTENCES) == 0)) | (pick % np.uint64(OTHERS) == 1)) + 1

    def bounds(self) -> np.ndarray:
        """Where paragraphs begin, and the number of words: at line ends, at ``inside`` and where a text begins."""
        return np.unique(np.concatenate((self.first, self.lines, self.inside, [self.n])))


def together(rows: Iterator[tuple], text: int) -> Iterator[list[tuple]]:
    """``rows`` in lists whose texts, at place ``text``, have about TOGETHER characters."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[text]) + 1
        if size > TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def paragraphs(text: str | None) -> list[tuple[int, int, int]]:
    """Start, end (code points) and number of words of each paragraph."""
    if not text:
        return []
    with np.errstate(over="ignore"):
        w = Words([text], WordHashes())
        b = w.bounds().tolist()
    return [(int(w.start[i]), int(w.end[j - 1]), j - i) for i, j in zip(b, b[1:])]


def _run_shingles(h: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of the runs of ``lengths`` words from ``at``, one run after the other, and where each run's begin; short runs have one."""
    counts = np.maximum(lengths - SHINGLE + 1, 1)
    starts = counts.cumsum() - counts
    flat = np.empty(int(counts.sum()), dtype=np.uint64)
    long = lengths >= SHINGLE
    if long.any():
        within = np.arange(len(flat)) - np.repeat(starts, counts)
        keep = np.repeat(long, counts)
        flat[keep] = shingle_hashes(h, SHINGLE)[(np.repeat(at, counts) + within)[keep]]
    for n in range(1, min(SHINGLE, len(h) + 1)):
        some = np.flatnonzero(lengths == n)
        if len(some):
            flat[starts[some]] = shingle_hashes(h, n)[at[some]]
    return flat, starts


def _last_least(x: np.ndarray, n: int) -> np.ndarray:
    """Where the least of each ``n`` neighbours of ``x`` is, the last one of equals."""
    least, at, width = x, np.arange(len(x)), 1
    while width < n:
        step = min(width, n - width)
        a, b = least[:-step], least[step:]
        later = b <= a
        least, at, width = np.where(later, b, a), np.where(later, at[step:], at[:-step]), width + step
    return at


def _lists(values: np.ndarray, counts: np.ndarray, none: np.ndarray | None = None) -> pa.Array:
    """Lists of the next ``counts`` values each, null where ``none``."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values), mask=None if none is None else pa.array(none))


class _Anchors:
    """Anchors of a text, chosen by the words around them alone, and hashes of the stretches between them.

    A stretch reaches from an anchor's first word to the next anchor's last one; the outer ones reach to the ends of the text. There is one more of them than of anchors.
    """

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def of(self, w: Words) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """The anchors of all texts, one after the other, and which text each is of."""
        n, h = w.n, w.h
        if len(self.up) < n:
            base = 0x9E3779B97F4A7C15
            self.up, self.down = (np.cumprod(np.full(2 * n, x, dtype=np.uint64)) for x in (base, pow(base, -1, 2**64)))
        total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(h * self.up[:n])))
        at, grams = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        if n >= GRAM + GAP - 1:
            grams = mixed((total[GRAM:] - total[:-GRAM]) * self.down[:n - GRAM + 1])
            # the windows that lie in one text, by their last gram
            whole = np.concatenate([np.arange(i + GAP - 1, j - GRAM + 1) for i, j in zip(w.first.tolist(), w.upto.tolist())])
            at = np.unique(_last_least(grams, GAP)[whole - GAP + 1])
        of = np.searchsorted(w.first, at, side="right") - 1
        first, upto = w.first[of], w.upto[of]
        next_ = np.append(of[1:] == of[:-1], False) if len(of) else np.empty(0, dtype=bool)
        low, high = first.copy(), upto.copy()
        low[1:][next_[:-1]] = at[:-1][next_[:-1]]
        high[next_] = at[1:][next_[:-1]] + GRAM

        def named(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            return mixed((total[j] - total[i]) * self.down[i] + (j - i).astype(np.uint64)).view(np.int64)

        before, after = np.maximum(at - GAP, first), np.minimum(at + GRAM + GAP, upto)
        return {"at": (at - first).astype(np.int32), "gram": grams[at].view(np.int64), "right": named(at, high), "head": np.where(low == first, named(low, at + GRAM), 0), "before": named(before, at),
                "after": named(at + GRAM - 1, after), "low": (low - first).astype(np.int32), "high": (high - first).astype(np.int32),
                "start": w.start[at].astype(np.int32), "end": w.end[at + GRAM - 1].astype(np.int32),
                "left_start": w.start[low].astype(np.int32), "right_end": w.end[high - 1].astype(np.int32)}, of


_ANCHOR = {"at": "int", "gram": "long", "right": "long", "head": "long", "before": "long", "after": "long", "low": "int", "high": "int", "start": "int", "end": "int", "left_start": "int", "right_end": "int"}


def paragraph_table(docs: DataFrame) -> DataFrame:
    """``doc_id, th, k, start, end, at, n_words, h, bands`` of every paragraph; ``h`` names its sequence of lower-cased words, ``at`` is the place of its first word.

    The first paragraph of a text has the text's anchors, one array a field (``a_at``, ``a_gram``, ...).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, anchors, (a, b) = WordHashes(), _Anchors(), permutations(BANDS * ROWS, SEED)
        band = np.arange(BANDS, dtype=np.uint64)[:, None]

        def encoded(ids: list, ths: list, w: Words) -> pa.RecordBatch:
            bounds = w.bounds()
            first, lengths = bounds[:-1], np.diff(bounds)
            of = np.searchsorted(w.first, first, side="right") - 1
            heads = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            flat, starts = _run_shingles(w.h, first, lengths)
            low = np.empty((BANDS * ROWS, len(of)), dtype=np.uint64)
            for i in range(BANDS * ROWS):
                x = flat * a[i] + b[i]
                low[i] = np.minimum.reduceat(x ^ (x >> np.uint64(32)), starts)
            raw = memoryview(w.h.tobytes())
            names = [xxhash.xxh64_intdigest(raw[8 * i:8 * (i + n)], seed=n) for i, n in zip(first.tolist(), lengths.tolist())]
            bands = mixed(mixed(low[0::2]) * np.uint64(3) + low[1::2] + band).T.ravel().view(np.int64)
            out = {"doc_id": pa.array(ids, pa.int64()).take(pa.array(of)), "th": np.array(ths, dtype=np.int64)[of], "k": np.arange(len(of), dtype=np.int32) - np.repeat(heads, np.diff(np.append(heads, len(of)))),
                   "start": w.start[first], "end": w.end[bounds[1:] - 1], "at": first - w.first[of], "n_words": lengths,
                   "h": np.array(names, dtype=np.uint64).view(np.int64), "bands": _lists(bands, np.full(len(of), BANDS))}
            found, text = anchors.of(w)
            counts = np.zeros(len(of), dtype=np.int64)
            counts[heads] = np.searchsorted(text, of[heads], side="right") - np.searchsorted(text, of[heads])
            out |= {f"a_{f}": _lists(values, counts, counts == 0) for f, values in found.items()}
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int32()) if c in ints else pa.array(x) for c, x in out.items()], list(out))

        ints = {"k", "start", "end", "at", "n_words"}
        with np.errstate(over="ignore"):
            for batch in batches:
                for rows in together(zip(*(c.to_pylist() for c in batch.columns)), 2):
                    ids, ths, texts = map(list, zip(*rows))
                    w = Words(texts, cache)
                    if w.n:
                        yield encoded(ids, ths, w)

    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    more = "".join(f", a_{f} array<{t}>" for f, t in _ANCHOR.items())
    return rows.mapInArrow(run, f"doc_id long, th long, k int, start int, end int, at int, n_words int, h long, bands array<long>{more}")


def _looked_up(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """What ``asked`` (``doc_id, th, kind, at, n, name, own``) wants to know of texts, in one pass over them.

    Kind 2: ``words``, the distinct shingles of the ``n`` words from ``at``. Kinds 0 and 1: of the GAP words to the left or right of an anchor at ``at``, the nearest
    first, ``levels`` (hashes of the first one, two, ... of them) and ``chars`` (their outer ends).
    """
    names = ["doc_id", "th", "kind", "name", "own", "words", "levels", "chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        weights = mixed(np.arange(1, GAP + 1, dtype=np.uint64))
        places = np.arange(GAP)

        def answers(ids: pa.Array, ths: pa.Array, of: np.ndarray, asked: pa.StructArray, w: Words) -> Iterator[pa.RecordBatch]:
            kind, at, n, name, own = (asked.field(f).to_numpy() for f in ("kind", "at", "n", "name", "own"))
            at = w.first[of] + at

            def batch(some: np.ndarray, *lists: pa.Array) -> pa.RecordBatch:
                which = pa.array(of[some])
                return pa.RecordBatch.from_arrays([ids.take(which), ths.take(which), pa.array(kind[some]), pa.array(name[some]), pa.array(own[some]), *lists], names)

            some = np.flatnonzero(kind == 2)
            if len(some):
                flat, starts = _run_shingles(w.h, at[some], n[some])
                sizes = np.diff(np.append(starts, len(flat)))
                row = np.repeat(np.arange(len(some)), sizes)
                order = np.lexsort((flat, row))
                flat, row = flat[order], row[order]
                new = np.append(True, (flat[1:] != flat[:-1]) | (row[1:] != row[:-1]))
                yield batch(some, _lists(flat[new].view(np.int64), np.bincount(row[new], minlength=len(some))), pa.nulls(len(some), pa.list_(pa.int64())), pa.nulls(len(some), pa.list_(pa.int32())))
            some = np.flatnonzero(kind < 2)
            if len(some):
                left, at = (kind[some] == 0)[:, None], at[some]
                room = np.where(left[:, 0], at - w.first[of[some]], w.upto[of[some]] - at - GRAM)
                near = np.where(left, at[:, None] - 1 - places, at[:, None] + GRAM + places).clip(0, w.n - 1)
                held = places < room[:, None]
                levels = mixed(np.cumsum(mixed(w.h[near] + weights), axis=1))[held].view(np.int64)
                chars = np.where(left, w.start[near], w.end[near])[held].astype(np.int32)
                counts = held.sum(axis=1)
                yield batch(some, pa.nulls(len(some), pa.list_(pa.int64())), _lists(levels, counts), _lists(chars, counts))

        with np.errstate(over="ignore"):
            for batch in batches:
                ids, ths, asked, texts = batch.columns
                offsets, flat = asked.offsets.to_numpy(), asked.values
                for some in together(enumerate(texts.to_pylist()), 1):
                    i, j = some[0][0], some[-1][0] + 1
                    of = np.repeat(np.arange(j - i), np.diff(offsets[i:j + 1]))
                    yield from answers(ids[i:j], ths[i:j], of, flat[offsets[i]:offsets[j]], Words([t for _, t in some], cache))

    lists = asked.groupBy("doc_id", "th").agg(F.collect_set(F.struct("kind", "at", "n", "name", "own")).alias("asked"))
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("t"), "text")
    rows = lists.join(texts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))).select("doc_id", "th", "asked", "text")
    return rows.mapInArrow(run, "doc_id long, th long, kind int, name long, own long, words array<long>, levels array<long>, chars array<int>")


def numbered(texts: DataFrame) -> DataFrame:
    """``doc_id, th, no`` of distinct texts: gapless numbers in the order that says which copy is the first."""
    order = [F.col("doc_id").isNull(), "doc_id", "th"]
    rows = written(texts.select("doc_id", "th").distinct().orderBy(*order).select("doc_id", "th", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND(2**33 - 1).alias("i")))
    counts = {p: n for p, n in rows.groupBy("p").count().collect()}
    before = [0]
    for p in range(max(counts, default=0)):
        before.append(before[-1] + counts.get(p, 0))
    out = written(rows.select("doc_id", "th", (F.get(F.lit(before), F.col("p")) + F.col("i")).alias("no")))
    release(rows)
    return out


def _text(place: str) -> Column:
    return F.shiftright(place, 31)


def _at(place: str) -> Column:
    return F.col(place).bitwiseAND(2**31 - 1)


def _apart(place: str, other: str, words: Column | int) -> Column:
    """Whether ``place`` is in another text than ``other``, or beyond the ``words`` words there."""
    return (_text(place) != _text(other)) | (_at(place) >= _at(other) + words)


class _Exact:
    """Runs of words that stand earlier too, around the anchors that texts share.

    Stretches between anchors are known by their hashes. Where a run ends between two anchors (an end), it is followed word by word, as far as any earlier text shares them: of all texts with
    the anchor, one for each sequence of GAP words beside it is asked; the hashes of the first one, two, ... words around the anchor meet in an aggregation.
    A place is one number: that of its text in the order of copies, then that of its first word (31 bits).
    """

    def __init__(self, paras: DataFrame):
        heads = paras.where("k = 0 and a_at is not null")
        self.numbers = numbered(heads)
        shared = written(heads.select(F.explode("a_gram").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"))
        row = F.inline(F.arrays_zip(*[F.col(f"a_{f}").alias(f) for f in _ANCHOR]))
        n = self.numbers.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "no")
        every = heads.join(n, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))).select("doc_id", "th", "no", row)
        hits = written(every.join(checked(shared), "gram").withColumn("own", F.shiftleft("no", 31) + F.col("at")).drop("no"))
        first_word = F.col("own") - F.col("at")
        stretches = hits.select("doc_id", "th", "own", "at", F.col("high").alias("upto"), F.col("start"), F.col("right_end").alias("end"), F.col("right").alias("seg")).unionByName(
            hits.where("low = 0").select("doc_id", "th", first_word.alias("own"), F.col("low").alias("at"), (F.col("at") + GRAM).alias("upto"), F.col("left_start").alias("start"), "end", F.col("head").alias("seg")))
        firsts = stretches.groupBy("seg").agg(F.min("own").alias("from"), F.count("*").alias("n")).where("n > 1").select("seg", "from")
        firsts = written(firsts.join(self._ids(), _text("from") == F.col("no")).drop("no"))
        # equal stretches are equally long
        self.inner = written(stretches.join(firsts, "seg").where((F.col("own") != F.col("from")) & _apart("own", "from", F.col("upto") - F.col("at")))
                             .select("doc_id", "th", "own", "at", "upto", "start", "end", "first_doc_id"))
        kept = written(hits.groupBy("gram").agg(F.min("own").alias("kept")))
        slim = hits.select("gram", "doc_id", "th", "own", "start", "end")
        done = self.inner.select(F.col("own").alias("from"), (F.col("own") - F.col("at") + F.col("upto") - GRAM).alias("last"))
        ends = [slim.join(done, F.col("own") == F.col("last"), "left_anti"), slim.join(done, F.col("own") == F.col("from"), "left_anti")]
        self.ends = written(reduce(DataFrame.unionByName, [e.withColumn("kind", F.lit(i)) for i, e in enumerate(ends)])
                            .join(kept, "gram").where((F.col("own") != F.col("kept")) & _apart("own", "kept", GRAM)))
        grams = self.ends.select("kind", "gram").distinct()
        sides = hits.select("gram", "own", F.inline(F.array(F.struct(F.lit(0).alias("kind"), F.col("before").alias("around")), F.struct(F.lit(1).alias("kind"), F.col("after").alias("around")))))
        # aggregated before the join by anchor, which would bring all copies of a very frequent passage into one task; a semi-join would be moved below the aggregation
        self.refs = written(sides.groupBy("kind", "gram", "around").agg(F.min("own").alias("own")).join(grams, ["kind", "gram"]).drop("around"))
        release(shared, hits, firsts, kept)

    def _ids(self) -> DataFrame:
        return self.numbers.select("no", F.col("doc_id").alias("first_doc_id"))

    def asked(self) -> DataFrame:
        """The contexts that are needed: of ends, and of what they may be copied from. They are named by their anchor."""
        rows = self.refs.select("kind", "own", "gram").unionByName(self.ends.select("kind", "own", "gram")).distinct()
        return (rows.withColumn("no", _text("own")).join(self.numbers, "no")
                .select("doc_id", "th", "kind", _at("own").cast("int").alias("at"), F.lit(0).alias("n"), F.col("gram").alias("name"), "own"))

    def spans(self, known: DataFrame) -> DataFrame:
        """``doc_id, th, at, upto, start, end, first_doc_id``: runs of words by place."""
        placed = known.where("kind < 2").select("kind", "own", F.col("name").alias("gram"), "levels", "chars")
        key = F.xxhash64("kind", "gram", "level", "hash").alias("key")
        first = written(placed.select("own", "kind", "gram", F.posexplode("levels").alias("level", "hash")).groupBy(key)
                        .agg(F.min("own").alias("source"), F.count("*").alias("n")).where("n > 1").select("key", "source"))
        clean(first)
        asking = placed.join(self.ends.select("kind", "own"), ["kind", "own"], "left_semi").select("own", "kind", "gram", F.posexplode("levels").alias("level", "hash"))
        best = (asking.select("kind", "own", "level", key).join(first, "key").where((F.col("own") != F.col("source")) & _apart("own", "source", GRAM))
                .groupBy("kind", "own", "source").agg(F.max(F.col("level") + 1).alias("run")).groupBy("kind", "own").agg(F.max(F.struct("run", "source")).alias("best")))
        both = self.ends.join(best, ["kind", "own"], "left").join(placed.select("kind", "own", "chars"), ["kind", "own"])
        both = both.withColumns({"source": F.coalesce("best.source", "kept"), "run": F.coalesce("best.run", F.lit(0)), "at": _at("own").cast("int")})
        room = F.when(_text("own") == _text("source"), F.floor((F.col("own") - F.col("source") - GRAM) / 2).cast("int")).otherwise(GAP)
        found = both.withColumn("l", F.least("run", room)).withColumn("edge", F.get("chars", F.col("l") - 1)).join(self._ids(), _text("source") == F.col("no"))
        left = F.col("kind") == 0
        outer = found.select("doc_id", "th", F.when(left, F.col("at") - F.col("l")).otherwise(F.col("at")).cast("int").alias("at"),
                             (F.col("at") + GRAM + F.when(left, 0).otherwise(F.col("l"))).cast("int").alias("upto"), F.when(left & (F.col("l") > 0), F.col("edge")).otherwise(F.col("start")).alias("start"),
                             F.when(~left & (F.col("l") > 0), F.col("edge")).otherwise(F.col("end")).alias("end"), "first_doc_id")
        return self.inner.drop("own").unionByName(outer)


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, th, start, end, n_words, first_doc_id`` of each passage to remove (code points, end exclusive).

    Paragraphs with the same words are one class; classes that share a band are compared on whole five-word shingle sets (``components_of_alike``);
    components of the links are clusters. Of each
    cluster the first paragraph (by ``doc_id``, text, place) stays. Runs of equal words around shared anchors (``_Exact``) are added, wherever lines and sentences
    end: any 48 equal words hold an anchor. What overlaps or touches is one passage, reported if it has ``min_words`` words.

    Null or empty texts have no paragraphs; rows without ``doc_id`` come last in the order and report a null id; a repeated row repeats nothing (it is the same
    document); rows that share an id but not the text are told apart by ``th``. An empty table gives no rows.
    """
    paras = written(paragraph_table(docs))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "k", "start", "end", "at", "n_words")
    banded = paras.select("h", F.explode("bands").alias("band"))
    open_ = written(banded.groupBy("band").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low != high").select("band"))
    buckets = written(banded.join(checked(open_), "band").select(F.col("band").alias("key"), F.col("h").alias("id")).distinct())
    release(open_)
    near = buckets.select(F.col("id").alias("h")).distinct()
    again = paras.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h", F.lit(True).alias("again"), F.lit(False).alias("near"))
    told = written(again.unionByName(near.select("h", F.lit(False).alias("again"), F.lit(True).alias("near"))).groupBy("h").agg(F.max("again").alias("again"), F.max("near").alias("near")))
    # later steps read only the paragraphs that repeat or share a band, without bands and anchors
    marked = written(paras.select("doc_id", "th", "k", "start", "end", "at", "n_words", "h").join(checked(told), "h"))
    reps = written(marked.groupBy("h").agg(F.min(place).alias("first"), F.max("again").alias("again"), F.max("near").alias("near")))
    exact = _Exact(paras)
    release(paras, told)
    asked = exact.asked().unionByName(reps.where("near").select("first.doc_id", "first.th", F.lit(2).alias("kind"), "first.at", F.col("first.n_words").alias("n"), F.col("h").alias("name"), F.lit(0).cast("long").alias("own")))
    known = written(_looked_up(asked, docs))
    release()
    sets = known.where("kind = 2").select(F.col("name").alias("id"), F.col("words").alias("shingles")).dropDuplicates(["id"])
    parts = components_of_alike(buckets, sets, PERCENT)
    clusters = (reps.join(parts.withColumnRenamed("node", "h"), "h", "left").withColumn("cluster", F.coalesce("component", "h")))
    kept = clusters.groupBy("cluster").agg(F.min("first").alias("kept"), F.count("*").alias("n"), F.bool_or("again").alias("again")).where("n > 1 or again")
    gone = written(clusters.select("h", "cluster").join(kept.select("cluster", "kept"), "cluster").select("h", "kept"))
    alike = written(marked.join(gone, "h").where(~place.eqNullSafe(F.col("kept")))
             .select("doc_id", "th", "at", (F.col("at") + F.col("n_words")).alias("upto"), "start", "end", F.col("kept.doc_id").alias("first_doc_id")))
    release(marked, buckets, reps, gone)
    spans = written(alike.unionByName(exact.spans(known)))
    release(alike, known, exact.inner, exact.ends, exact.refs, exact.numbers)
    row = Window.partitionBy("doc_id", "th").orderBy("at", "upto")
    before = F.max("upto").over(row.rowsBetween(Window.unboundedPreceding, -1))
    runs = (spans.withColumn("new", F.coalesce((F.col("at") > before).cast("int"), F.lit(1)))
            .withColumn("run", F.sum("new").over(row.rowsBetween(Window.unboundedPreceding, 0))))
    merged = runs.groupBy("doc_id", "th", "run").agg(F.min("at").alias("at"), F.max("upto").alias("upto"), F.min("start").alias("start"), F.max("end").alias("end"),
                                                     F.min("first_doc_id").alias("first_doc_id"))
    return (merged.withColumn("n_words", F.col("upto") - F.col("at")).where(F.col("n_words") >= min_words)
            .select("doc_id", "th", "start", "end", "n_words", "first_doc_id"))


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the repeated passages cut from ``text``; other columns pass through."""
    d, t, s, h = (fresh(docs.columns, x) for x in ("__d", "__t", "__spans", "__h"))
    spans = (repeats(docs, min_words).groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(s))
             .select(F.col("doc_id").alias(d), F.col("th").alias(t), s))
    both = docs.withColumn(h, F.xxhash64("text")).join(spans, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.col(h) == F.col(t)), "left")
    none = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = F.aggregate(s, none, lambda a, x: F.struct(x["end"].alias("at"), F.concat(a["out"], F.substr("text", a["at"] + 1, x["start"] - a["at"])).alias("out")),
                       lambda a: F.concat(a["out"], F.substr("text", a["at"] + 1)))
    text = F.when(F.col(s).isNull(), F.col("text")).otherwise(rest)
    return both.select(*[text.alias(c) if c.lower() == "text" else F.col(c) for c in docs.columns])
