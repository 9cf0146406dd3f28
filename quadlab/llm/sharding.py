"""Dealing documents into shards of near equal bytes that keep linked documents together: balanced label propagation."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, functions as F

from quadlab.llm.common import written
from quadlab.operators.ranking import global_running

#: Shards, and the bytes that each document takes besides its text.
SHARDS, OVERHEAD = 40, 16
#: Children of a document in the tree of its equal texts, rounds of either kind at most, and the cells that moves between two shards fall in.
FAN, ROUNDS, GAINS, CELLS = 64, 12, 3, 16
#: Share by which linked documents may exceed an equal share while they move; what is over at the end, at the end of the order by text, is dealt out with the others.
SLACK = 0.25


def nodes_of(docs: DataFrame) -> DataFrame:
    """``node, doc_id, size, text_crc32, text`` of each row, written: ``node`` names the row, ``text`` is the hash of its text (null: of the empty one)."""
    t = F.coalesce(F.col("text"), F.lit(""))
    return written(docs.select(F.col("doc_id"), (F.octet_length(t).cast("long") + OVERHEAD).alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"),
                               F.xxhash64(t).alias("text")).withColumn("node", F.monotonically_increasing_id()))


def equal_text_links(nodes: DataFrame, quota: int, fan: int = FAN) -> DataFrame:
    """Links ``a, b`` (nodes, b < a) that tie equal texts together in trees: a node has about ``fan`` children at most, so no node is hot.

    A group whose bytes come near the quota of a shard, or beyond, can't stay whole in any case and is tied in parts of about a quarter of a shard.
    """
    groups = written(nodes.groupBy("text").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).where("n > 1"))
    parts = F.when(F.col("bytes") * 10 > quota * 9, F.ceil(F.col("bytes") * 4 / quota)).otherwise(1)
    members = written(nodes.select("node", "text").join(groups.select("text", "n", parts.cast("long").alias("parts")), "text")
                      .select("node", "text", F.pmod(F.xxhash64("node"), "parts").alias("part"), F.ceil(F.col("n") / F.col("parts")).alias("n")))
    links = []
    while True:
        most = members.agg(F.max("n")).first()[0] or 0
        rows = members.withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(len(links))), F.ceil(F.col("n") / fan)))
        heads = written(rows.groupBy("text", "part", "chunk").agg(F.min("node").alias("head"), F.max(F.ceil(F.col("n") / fan)).alias("n")))
        links.append(rows.drop("n").join(heads.drop("n"), ["text", "part", "chunk"]).where("node != head").select(F.col("node").alias("a"), F.col("head").alias("b")))
        if most <= fan:
            break
        members = heads.select(F.col("head").alias("node"), "text", "part", "n")
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def _wishes(state: DataFrame, links: DataFrame) -> DataFrame:
    """``node, size, from, to, gain, cell`` of each node with more neighbours in another shard than in its own; ``links`` says who (a) sees whom (b)."""
    seen = links.join(state.select(F.col("node").alias("b"), F.col("shard").alias("there")), "b")
    votes = seen.groupBy(F.col("a").alias("node"), "there").agg(F.count("*").alias("n"), F.min("b").alias("by"))
    both = votes.join(state, "node")
    away, here = F.col("there") != F.col("shard"), F.col("there") == F.col("shard")
    best = both.groupBy("node", "size", F.col("shard").alias("from")).agg(
        F.max(F.when(away, F.struct("n", "there", "by"))).alias("best"), F.coalesce(F.max(F.when(here, F.col("n"))), F.lit(0)).alias("own"))
    more = F.col("best.n") - F.col("own")
    return best.where(more > 0).select("node", "size", "from", F.col("best.there").alias("to"), F.least(F.floor(F.log2(more)), F.lit(GAINS - 1)).cast("int").alias("gain"),
                                       F.pmod(F.xxhash64("best.by"), F.lit(CELLS)).cast("int").alias("cell"))


def admitted(cells: list[tuple[int, int, int, int, int]], held: list[int], quota: int) -> list[tuple[int, int, int, int]]:
    """Which cells ``from, to, gain, cell`` may move, from their bytes: greatest gain first, then the largest, while the target stays within its quota.

    What leaves a shard makes room in it, so cells are asked again until none is let in. ``held`` (bytes per shard) is brought up to date.
    """
    left, taken = sorted(cells, key=lambda c: (-c[2], -c[4], c)), []
    while True:
        rest = []
        for c in left:
            if held[c[1]] + c[4] <= quota:
                held[c[1]] += c[4]
                held[c[0]] -= c[4]
                taken.append(c[:4])
            else:
                rest.append(c)
        if len(rest) == len(left):
            return taken
        left = rest


def _bytes(state: DataFrame, shards: int) -> list[int]:
    found = {r["shard"]: r["s"] for r in state.groupBy("shard").agg(F.sum("size").alias("s")).collect()}
    return [found.get(j, 0) for j in range(shards)]


def propagated(state: DataFrame, links: DataFrame, shards: int, quota: int, rounds: int = ROUNDS) -> DataFrame:
    """``state`` (``node, size, shard``) after documents moved to where their neighbours are, no shard taking more than ``quota`` bytes.

    First each node follows those that it links to (b < a): that gathers a tree around its root, level by level. Then every node follows the majority of all its
    neighbours, every other node in turn, which helps those whose root is in a full shard. A round is three joins by node; the driver sees the bytes of each
    cell (a pair of shards, a gain, a hash of the family), ``shards ** 2 * GAINS * CELLS`` at most, and answers which may move. Stops early when none may.
    """
    spark = state.sparkSession
    held = _bytes(state, shards)
    up = links.select("a", "b")
    all_ = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    for phase in ("up", "all"):
        idle = 0
        for r in range(rounds):
            turn = F.pmod(F.xxhash64("a"), F.lit(2)) == r % 2
            wishes = written(_wishes(state, up if phase == "up" else all_.where(turn)))
            cells = [tuple(x) for x in wishes.groupBy("from", "to", "gain", "cell").agg(F.sum("size")).collect()]
            free = admitted(cells, held, quota)
            idle = 0 if free else idle + 1
            if free:
                table = spark.createDataFrame(free, "from int, to int, gain int, cell int")
                moved = wishes.join(F.broadcast(table), ["from", "to", "gain", "cell"]).select("node", "to")
                state = written(state.join(moved, "node", "left").select("node", "size", F.coalesce("to", "shard").alias("shard")))
            if not cells and phase == "up" or idle > (phase == "all"):
                break
    return state


def _level(held: list[int], more: int) -> int:
    """The height to which ``more`` bytes fill shards that hold ``held``."""
    low, high = 0, max(held, default=0) + more
    while low < high:
        mid = (low + high + 1) // 2
        if sum(max(0, mid - h) for h in held) <= more:
            low = mid
        else:
            high = mid - 1
    return low


def _interval(bounds: list[int]) -> Column:
    """Which interval of running bytes (in halves, so that a row lies where its middle is) a row falls in."""
    at = F.col("cum_size") * 2 - F.col("size")
    return F.least(F.size(F.filter(F.array(*[F.lit(2 * b).cast("long") for b in bounds]), lambda b: b <= at)), F.lit(len(bounds))).cast("int")


def filled(fillers: DataFrame, held: list[int]) -> DataFrame:
    """``node, shard`` of documents that may go anywhere (``node, size, text``): they even out shards that hold ``held`` bytes.

    Documents go by classes of size (powers of two), large ones first; a class is cut into one interval per shard, by its share of the room that is left. What a
    class left uneven, at most a document per shard, the smaller ones make up for. Equal texts stand side by side in the order. The driver sees bytes by class and shard.
    """
    sized = fillers.select("node", "size", "text", F.floor(F.log2("size")).cast("int").alias("class")).withColumn("down", -F.col("class"))
    rows = written(global_running(sized, ["down", "text", "node"], ["size"]).select("node", "size", "class", "cum_size"))
    classes = sorted(rows.groupBy("class").agg(F.sum("size").alias("s"), F.min(F.col("cum_size") - F.col("size")).alias("start")).collect(), reverse=True)
    held, left, placed = list(held), sum(c["s"] for c in classes), F.lit(None).cast("int")
    for c in classes:
        level = _level(held, left)
        room = [max(0, level - h) for h in held]
        whole = max(1, sum(room))
        bounds, at = [], 0
        for x in room[:-1]:
            at += x
            bounds.append(c["start"] + at * c["s"] // whole)
        shard = _interval(bounds)
        for r in rows.where(F.col("class") == c["class"]).groupBy(shard.alias("shard")).agg(F.sum("size").alias("s")).collect():
            held[r["shard"]] += r["s"]
        left -= c["s"]
        placed = F.when(F.col("class") == c["class"], shard).otherwise(placed)
    return rows.select("node", placed.alias("shard"))


def _released(state: DataFrame, nodes: DataFrame, shards: int, quota: int) -> DataFrame:
    """``state`` without the rows, at the end of the order by text, that stand beyond the quota of their shard."""
    held = _bytes(state, shards)
    if max(held) <= quota:
        return state
    rows = global_running(state.join(nodes.select("node", "text"), "node"), ["shard", "text", "node"], ["size"])
    before = [sum(held[:j]) for j in range(shards)]
    start = F.get(F.array(*[F.lit(b).cast("long") for b in before]), F.col("shard"))
    return written(rows.where(F.col("cum_size") - start <= quota).select("node", "size", "shard"))


def shards_of(nodes: DataFrame, links: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``node, shard`` of every row of ``nodes`` (``node, size, text``), from links ``a, b`` between nodes.

    Linked documents start where a hash of their node says and are propagated; a shard's quota is an equal share of all bytes, and some slack on the way. The others fill the rest.
    """
    total = nodes.agg(F.sum("size")).first()[0] or 0
    quota = -(-total // shards)
    ids = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    start = F.pmod(F.xxhash64("node", F.lit("start")), F.lit(shards)).cast("int")
    linked = written(nodes.select("node", "size").join(ids, "node", "left_semi").withColumn("shard", start))
    state = _released(propagated(linked, links, shards, quota + int(SLACK * quota)), nodes, shards, quota)
    fillers = nodes.select("node", "size", "text").join(state.select("node"), "node", "left_anti")
    return state.select("node", "shard").unionByName(filled(fillers, _bytes(state, shards)))


def sharded(docs: DataFrame, links: DataFrame | None = None, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of each row of ``docs`` (``doc_id``, ``text``; other columns are ignored).

    The law is ``bytes``: shards hold near equal bytes (text and overhead), and of what is linked as much as fits lies in one shard. Equal texts are linked, and the pairs ``a, b``
    of document ids in ``links``. A null text is as an empty one. Rows without an id and repeated rows are placed like all others, each by itself; rows
    that share an id have the links of one of them. ``slot`` counts up from 0 within a shard; ``grown_shard`` is null under this law. An empty table gives no rows.
    """
    nodes = nodes_of(docs)
    total = nodes.agg(F.sum("size")).first()[0] or 0
    ties = equal_text_links(nodes, -(-total // shards))
    if links is not None:
        known = nodes.where("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("node"))
        a, b = (known.select(F.col("doc_id").alias(s), F.col("node").alias(f"n{s}")) for s in "ab")
        pairs = links.select("a", "b").join(a, "a").join(b, "b").where("na != nb")
        ties = ties.unionByName(pairs.select(F.greatest("na", "nb").alias("a"), F.least("na", "nb").alias("b"))).distinct()
    placed = written(nodes.join(shards_of(nodes, written(ties), shards), "node"))
    counts = defaultdict(int, {r["shard"]: r["count"] for r in placed.groupBy("shard").count().collect()})
    before = F.get(F.array(*[F.lit(sum(counts[i] for i in range(j))).cast("long") for j in range(shards)]), F.col("shard"))
    rows = global_running(placed, ["shard", "node"], out="at")
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") - 1 - before).alias("slot"),
                       F.lit(None).cast("int").alias("grown_shard"))
