"""Secrets in texts: a trigram inverted index picks the texts that each rule's pattern has to read."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import _constants as C, _parser

from pyspark.sql import Column, DataFrame, functions as F

from quadlab.llm.common import fresh


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``value`` is the group whose length counts; shorter matches are dropped after matching."""
    kind: str
    pattern: str
    value: int
    at_least: int
    ignore_case: bool = False


# The three base kinds, then those the method adds.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # the same matches as runs of any length, of which those under 24 are dropped
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("url_password", r"(?<![a-z])[a-z]+://[A-Za-z0-9._-]+:[^\x20\x09-\x0D@/]+@", 0, 10),
)

_MOST = 64


def _strings(parsed) -> list[set[str] | None]:
    """A pattern as a row of parts: the few strings a part can match, or None for anything (a match may be empty there)."""
    out: list[set[str] | None] = []
    for op, arg in parsed:
        if op is C.LITERAL:
            out.append({chr(arg)})
        elif op is C.IN and all(o is C.LITERAL or o is C.RANGE for o, _ in arg):
            chars = {chr(c) for o, a in arg for c in ([a] if o is C.LITERAL else range(a[0], a[1] + 1))}
            out.append(chars if len(chars) <= 8 else None)
        elif op is C.SUBPATTERN:
            out += _strings(arg[3])
        elif op is C.BRANCH:
            whole: set[str] | None = set()
            for way in arg[1]:
                parts = _strings(way)
                joined = reduce(_product, parts, {""})
                whole = None if whole is None or joined is None else whole | joined
            out.append(whole)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, inner = arg
            one = reduce(_product, _strings(inner), {""})
            if one is not None and low == 0 and high == 1:
                out.append(one | {""})
            elif one is not None and low == high and low <= 4:
                out += [one] * low
            else:
                out += [one] * (low if one is not None and low <= 4 else 0) + [None]
        else:
            out.append(None)
    return out


def _product(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    if a is None or b is None or len(a) * len(b) > _MOST:
        return None
    return {x + y for x in a for y in b}


def trigram_query(rule: Rule) -> list[list[frozenset[str]]]:
    """What every text with a match must hold, lower-cased: for each run of the pattern (all needed), the ways to match it
    (one needed), each the set of its trigrams (all needed). Empty if the pattern has no such run: then every text is read."""
    runs: list[set[str]] = [{""}]
    for part in _strings(_parser.parse(rule.pattern)):
        joined = _product(runs[-1], part)
        if joined is None:
            runs.append(part if part is not None else {""})
        else:
            runs[-1] = joined
    query = []
    for run in runs:
        ways = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in (x.lower() for x in run)}
        if all(ways):
            query.append(sorted((w for w in ways if not any(v < w for v in ways)), key=sorted))
    return query


def trigrams(rules: tuple[Rule, ...] = RULES) -> list[str]:
    return sorted({t for r in rules for ways in trigram_query(r) for way in ways for t in way})


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The inverted index, for the trigrams that some rule asks for: ``trigram, doc_id, text_hash``.

    Trigrams are of the text with A-Z lower-cased.
    """
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), low.alias("low"))
    held = F.filter(F.array(*[F.when(F.contains("low", F.lit(t)), t) for t in trigrams(rules)]), lambda t: t.isNotNull())
    return rows.select("doc_id", "text_hash", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, text_hash, kinds``: texts whose postings satisfy the Boolean trigram query of a rule that has one."""
    names = trigrams(rules)
    if not names:
        return index.select("doc_id", "text_hash", F.array().cast("array<string>").alias("kinds")).where("false")
    has = {t: F.bool_or(F.col("trigram") == t).alias(f"t{i}") for i, t in enumerate(names)}
    both = index.groupBy("doc_id", "text_hash").agg(*has.values())
    at = {t: F.col(f"t{i}") for i, t in enumerate(names)}
    kinds = []
    for r in rules:
        query = trigram_query(r)
        if query:
            ok = reduce(Column.__and__, [reduce(Column.__or__, [reduce(Column.__and__, [at[t] for t in sorted(way)]) for way in ways]) for ways in query])
            kinds.append(F.when(ok, r.kind))
    return both.select("doc_id", "text_hash", F.filter(F.array(*kinds), lambda k: k.isNotNull()).alias("kinds")).where("size(kinds) > 0")


def _spans(rule: Rule, text: Column, rank: int) -> Column:
    """All leftmost non-overlapping matches of a rule as ``start, rank, kind, end`` (code points), short ones dropped.

    The texts between matches come from a split by the same pattern; their lengths and those of the matches add up to the places.
    """
    pattern = ("(?i)" if rule.ignore_case else "") + rule.pattern
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = found if not rule.value else F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.value))
    steps = F.zip_with(F.transform(gaps, lambda g: F.length(g)), F.zip_with(found, value, lambda m, v: F.struct(F.length(m).alias("n"), F.length(v).alias("v"))),
                       lambda g, m: F.struct(g.alias("g"), m["n"].alias("n"), m["v"].alias("v")))
    span = "struct<start:int,rank:int,kind:string,end:int>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        begin, end = acc["at"] + s["g"], acc["at"] + s["g"] + s["n"]
        one = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        more = F.when(s["v"] >= rule.at_least, F.concat(acc["spans"], F.array(one))).otherwise(acc["spans"])
        return F.struct(F.coalesce(end, begin).alias("at"), more.alias("spans"))

    empty = F.array().cast(f"array<{span}>")
    return F.when(F.size(found) > 0, F.aggregate(steps, start, step, lambda a: a["spans"])).otherwise(empty)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with a new last column ``spans``: ``start, rank, kind, end`` of every secret, by start, then rule.

    Rules with mandatory trigrams read only the texts that the index gives them; the others read all. Null texts count as empty; repeated rows each get
    their spans; other columns pass through; places are code points, ends exclusive.
    """
    if "spans" in {c.lower() for c in docs.columns}:
        raise ValueError("column spans is taken")
    d, t, h, k = (fresh(docs.columns, x) for x in ("__d", "__t", "__h", "__k"))
    picked = candidates(postings(docs, rules), rules).select(F.col("doc_id").alias(d), F.col("text_hash").alias(t), F.col("kinds").alias(k))
    rows = docs.withColumn(h, F.xxhash64("text")).join(picked, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.col(h) == F.col(t)), "left")
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = []
    for i, r in enumerate(rules):
        spans = _spans(r, text, i)
        if trigram_query(r):
            spans = F.when(F.array_contains(k, r.kind), spans).otherwise(F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>"))
        parts.append(spans)
    return rows.select(*docs.columns, F.array_sort(F.concat(*parts)).alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def base_digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of each row."""
    out = scan(docs.select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["rank"] < 3)

    def count(rank: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")

    counts = [count(r).alias(n) for r, n in enumerate(("n_assign", "n_access", "n_hex"))]
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
