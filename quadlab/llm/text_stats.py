"""Counts over the whole of a text, computed inside tasks."""

from __future__ import annotations

import math
import re
import zlib

import numpy as np

from quadlab.llm.shingles import WordHashes, shingle_hashes

_SYMBOL = re.compile(r"[#*$%&|<>]")
# Very common words of the languages a collection of web text holds most.
COMMON = frozenset((
    "the of and to in is that for it was on are as with be by this at from or an have not they which you his had but "
    "der die und das von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach bei "
    "de la que el en los se del las un por con no una su para al lo como más pero sus le ya o este sí porque "
    "le les des et une du dans qui pour pas au sur par avec ce il sont plus ne se ou son mais").split())


def base_counts(text: str | None, cache: WordHashes) -> dict[str, float]:
    """What quality rules and features look at; all zero for a null or empty text.

    ``n_dup_lines``: lines with a word that equal an earlier line. ``n_repeat_words``: words covered by three-word windows that occur at least twice.
    """
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    out = {"n_words": n, "n_chars": len(text), "word_chars": len(b"".join(words).decode("utf-8", "surrogatepass")),
           "n_symbols": len(_SYMBOL.findall(text))}
    lines = [x for x in raw.split(b"\n") if x.strip()]
    out["n_lines"], out["n_dup_lines"] = len(lines), len(lines) - len(set(lines))
    h = cache.of(words)
    out["n_repeat_words"] = 0
    if n >= 3:
        windows = shingle_hashes(h, 3)
        _, back, count = np.unique(windows, return_inverse=True, return_counts=True)
        again = np.flatnonzero(count[back] > 1)
        covered = np.zeros(n, dtype=bool)
        for i in range(3):
            covered[again + i] = True
        out["n_repeat_words"] = int(covered.sum())
    out["n_distinct"] = len(np.unique(h)) if n else 0
    return out


def features(text: str | None, cache: WordHashes, counts: dict[str, float] | None = None) -> list[float]:
    """Shape of a text as numbers; none names its language, source or id."""
    text = text or ""
    c = counts or base_counts(text, cache)
    n, chars, lines = max(c["n_words"], 1), max(c["n_chars"], 1), max(c["n_lines"], 1)
    words = text.split()
    upper = sum(map(str.isupper, words))
    title = sum(map(str.istitle, words))
    alpha = sum(map(str.isalpha, words))
    digit = sum(1 for w in words if any(x.isdigit() for x in w)) if any(x.isdigit() for x in text) else 0
    common = sum(1 for w in words if w.lower().strip(".,;:!?") in COMMON)
    ends = text.count(".") + text.count("!") + text.count("?")
    raw = text.encode("utf-8", "surrogatepass")
    squeezed = len(zlib.compress(raw, 1)) / max(len(raw), 1)
    longest = max(map(len, words), default=0)
    lengths = c["word_chars"] / n
    bars = text.count("|")
    return [math.log1p(c["n_words"]), lengths, c["n_symbols"] / n, c["n_dup_lines"] / lines, c["n_repeat_words"] / n, c["n_distinct"] / n,
            upper / n, title / n, alpha / n, digit / n, common / n, ends / n, text.count(",") / n, squeezed, math.log1p(longest), math.log1p(n / lines),
            bars / n, text.count("!") / n, math.log1p(c["n_lines"]), sum(not x.isascii() for x in words) / n, len(set(words)) / math.sqrt(n), chars / n]


FEATURES = ("log_words", "mean_word", "symbols", "dup_lines", "repeats", "distinct", "upper", "title", "alpha", "digits", "common", "ends", "commas",
            "squeezed", "longest", "line_words", "bars", "exclaims", "log_lines", "accented", "richness", "char_words")
