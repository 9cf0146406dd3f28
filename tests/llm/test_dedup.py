"""Near-duplicates, passages and lines against brute force, with odd rows."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings, strategies as st

from quadlab.llm import components, line_dedup, near_dedup, passage_dedup, set_links
from quadlab.llm.shingles import WordHashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __h string, __d long"


def prose(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def rows_of(texts, sites=4):
    return [(i, t, "en", f"s{i % sites}", len(t or ""), "x", 7) for i, t in enumerate(texts)]


def word_sets(text, size):
    w = [x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not w:
        return set()
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} or {tuple(w)}


def brute_components(sets, percent):
    ids = list(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_components_of_chain_hub_and_repeats(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, x) for x in range(101, 160)] + [(3, 2), (2, 3), (5, 5), (None, 4), (200, 201)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}


def test_no_edges_no_components(spark):
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return out


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_duplicates_like_brute_force(spark, size, percent):
    rng = random.Random(size)
    texts = [None, "", "  \n ", "one", "One", "two words", "a b c", "A  b\tc"]
    for _ in range(6):
        base = prose(rng, rng.choice([30, 120, 300]))
        texts += [" ".join(edited(rng, base, k % 9)) for k in range(12)]
    texts += [" ".join(prose(rng, 6000))] * 2
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs, size, percent).collect()}
    sets = {i: word_sets(t, size) for i, t in enumerate(texts)}
    want = brute_components(sets, percent)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (i == r.component_id) for i, r in got.items())
    left = near_dedup.deduplicated(docs, size, percent)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == set(want.values())


def test_near_duplicates_of_odd_rows(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "x y z"), (2, "a b c d"), (3, "x y z"), (None, "x y z"), (None, None), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (2, 1, False), (3, 1, False), (4, 4, True), (None, None, True), (None, None, True)], key=str)
    assert sorted((r.doc_id for r in near_dedup.deduplicated(docs).collect()), key=str) == [1, 4, None, None]
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_prefixes_lose_no_pair(spark):
    rng = random.Random(5)
    sets = {}
    for g in range(5):
        base = [rng.randrange(10**9) for _ in range(rng.choice([10, 40, 100]))]
        for k in range(12):
            s = set(base)
            for x in rng.sample(base, min(len(base) - 1, rng.randrange(0, 9))):
                s.discard(x)
                s.add(rng.randrange(10**9))
            sets[g * 100 + k] = s
    members = set_links.ordered_sets(spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, shingles array<long>")).withColumn("component", F.col("id"))
    found = {tuple(sorted((r.a, r.b))) for r in set_links.prefix_pairs(members, 85).collect()}
    want = {(x, y) for x in sets for y in sets if x < y and 100 * len(sets[x] & sets[y]) >= 85 * len(sets[x] | sets[y])}
    assert want and want <= found


def test_prefixes_of_pages_of_one_template_do_not_meet(spark):
    """Sets with 100 shared and 17 own elements are 0.75 alike: none may be paired at 0.85, whatever their number."""
    rows = [(i, [*range(100), *range(1000 + 17 * i, 1017 + 17 * i)]) for i in range(3000)]
    members = set_links.ordered_sets(spark.createDataFrame(rows, "id long, shingles array<long>")).withColumn("component", F.col("id"))
    e = members.first()
    short = e.n - -(-2 * e.n * 85 // 185) + 1
    assert all(x.c == 1 for x in e.e[:short])  # the shared element is no key of the smaller side
    assert set_links.prefix_pairs(members, 85).count() == 0


@given(st.text(alphabet="ab.!? \n\tcdé", max_size=300))
@settings(max_examples=60, deadline=None, derandomize=True)
def test_paragraphs_hold_every_word_once(text):
    got = passage_dedup.paragraphs(text)
    assert [w for s, e, _ in got for w in text[s:e].encode().lower().split()] == text.encode().lower().split()
    assert all(len(text[s:e].encode().split()) == n > 0 for s, e, n in got)
    assert all(a[1] <= b[0] for a, b in zip(got, got[1:])) and all("\n" not in text[s:e] for s, e, _ in got)


def test_texts_are_read_together_as_if_alone():
    hashed = []

    class Counted(WordHashes):
        def of(self, words):
            hashed.extend(words)
            return super().of(words)

    rng = np.random.default_rng(7)
    texts = ["", " ", "\n\n", "é ü.\nB", "end.\n", *[" ".join(f"W{i}" for i in rng.integers(0, 90, n)) for n in (47, 48, 300, 2000)], "\n x", ""]
    with np.errstate(over="ignore"):
        w = passage_dedup.Words(texts, Counted())
        assert len(hashed) == len(set(hashed)) == len({x for t in texts for x in t.lower().split()})
        found, of = passage_dedup._Anchors().of(w)
        for i, t in enumerate(texts):
            alone = passage_dedup.Words([t], WordHashes())
            part = slice(w.first[i], w.upto[i])
            assert all(np.array_equal(getattr(w, f)[part], getattr(alone, f)) for f in ("h", "start", "end"))
            b = w.bounds()
            assert np.array_equal(np.unique(np.append(b[(b >= w.first[i]) & (b < w.upto[i])] - w.first[i], alone.n)), alone.bounds())
            own = passage_dedup._Anchors().of(alone)[0]
            assert all(np.array_equal(v[of == i], own[f]) for f, v in found.items())


def test_repeated_passages_are_found_and_others_left(spark):
    rng = random.Random(3)
    own = [". ".join(" ".join(prose(rng, 9)) for _ in range(30)) + "." for _ in range(12)]
    passage = ". ".join(" ".join(prose(rng, 10)) for _ in range(8)) + "."
    near = passage.split()
    near[40] = "other"
    texts = list(own)
    texts[2] += "\n" + passage
    texts[5] = passage + "\n" + texts[5]
    half = len(texts[7]) // 2
    texts[7] = texts[7][:half] + " " + passage + " " + texts[7][half:]
    texts[9] += "\n" + " ".join(near)
    texts += [None, "", "short"]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    got = passage_dedup.repeats(docs).collect()
    assert {r.doc_id for r in got} == {5, 7, 9} and {r.first_doc_id for r in got} == {2}
    for r in got:
        words = set(texts[r.doc_id][r.start:r.end].split())
        assert len(words & set(passage.split() + ["other"])) >= 0.9 * len(words) and r.n_words >= 25
    clean = {r.doc_id: r.text for r in passage_dedup.without_repeats(docs).collect()}
    assert [clean[i] for i in (0, 1, 2, 3, 12, 13, 14)] == [texts[i] for i in (0, 1, 2, 3, 12, 13, 14)]
    assert own[9] in clean[9] and len(clean[9]) < len(texts[9]) - 200


@pytest.mark.parametrize("stop", [0, 9])
def test_passages_copied_into_lines_are_found_whole(spark, stop):
    rng = random.Random(11 + stop)

    def text(n):
        return [w + "." if stop and rng.randrange(stop) == 0 else w for w in prose(rng, n)]

    texts, planted = [], {}
    for i in range(40):
        passage, hosts = text(51 + i % 10), [text(150), text(150)]
        for k, host in enumerate(hosts):
            at = rng.randrange(1, 149)
            texts.append(host[:at] + passage + host[at:])
            planted[2 * i + k] = (at, passage)
    texts.append(["again"] * 300)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in passage_dedup.repeats(docs).collect()}
    assert set(got) == {*range(1, 80, 2), 80}
    for i in range(1, 80, 2):
        at, passage = planted[i]
        found = " ".join(texts[i])[got[i].start:got[i].end].split()
        assert got[i].first_doc_id == i - 1 and " ".join(passage) in " ".join(found) and got[i].n_words == len(found) <= len(passage) + 2
    assert passage_dedup.GRAM <= 300 - got[80].n_words < 300


def test_a_run_is_followed_along_the_text_that_shares_most(spark):
    """A third text copies 60 words, of which an earlier one has the first 36, the last 36 or the middle."""
    rng, texts, planted = random.Random(21), [], {}
    for i in range(40):
        passage = prose(rng, 60)
        part = [passage[:36], passage[24:], passage[10:46]][i % 3]
        for k, p in enumerate((part, passage, passage)):
            host, at = prose(rng, 120), rng.randrange(1, 119)
            texts.append(host[:at] + p + host[at:])
        planted[3 * i + 2] = " ".join(passage)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: " ".join(texts[r.doc_id])[r.start:r.end] for r in passage_dedup.repeats(docs).collect()}
    assert sum(p in got.get(i, "") for i, p in planted.items()) == 40


def test_every_run_of_48_words_is_found(spark):
    rng, texts = random.Random(5), []
    for i in range(60):
        words = prose(rng, rng.randrange(60, 400))
        for _ in range(rng.randrange(4)):
            if texts:
                src = rng.choice(texts)
                n = min(rng.choice([30, 48, 55, 70, 120]), len(src))
                at, to = rng.randrange(len(src) - n + 1), rng.randrange(len(words))
                words[to:to] = src[at:at + n]
        texts.append(words)
    texts.append(texts[3] * 120 + prose(rng, 30_000))  # a very long text
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {}
    for r in passage_dedup.repeats(docs).collect():
        at = len(" ".join(texts[r.doc_id])[:r.start].split())
        found.setdefault(r.doc_id, set()).update(range(at, at + r.n_words))
    seen, lost, all_ = {48: set(), 16: set()}, 0, 0
    for i, t in enumerate(texts[:-1]):
        cover = {}
        for n, grams in seen.items():
            cover[n] = {k for j in range(len(t) - n + 1) if tuple(t[j:j + n]) in grams for k in range(j, j + n)}
        all_ += len(cover[48])
        lost += len(cover[48] - found.get(i, set()))
        assert found.get(i, set()) <= cover[16]
        for n, grams in seen.items():
            grams.update(tuple(t[j:j + n]) for j in range(len(t) - n + 1))
    assert all_ > 2000 and lost <= 0.002 * all_
    assert len(found[60]) >= 0.99 * 120 * len(texts[3]) and max(found[60]) < 120 * len(texts[3])


def test_passages_of_odd_rows(spark):
    rng = random.Random(4)
    text = ". ".join(" ".join(prose(rng, 10)) for _ in range(8)) + "."
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None)], "doc_id long, text string")
    assert {(r.doc_id, r.first_doc_id) for r in passage_dedup.repeats(docs).collect()} == {(None, 1)}
    assert passage_dedup.repeats(docs.limit(0)).count() == 0


def test_lines_like_brute_force(spark):
    rng = random.Random(8)
    common = ["  shared line ", "shared line", "Terms apply.", "x"]
    texts = [None, "", "\n\n"] + ["\n".join(rng.choice([*common, f"own {rng.randrange(40)}", " ", f"u{i}"]) for _ in range(12)) for i in range(60)]
    texts += ["long " * 30000 + "\nshared line"]
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 9}", len(t or ""), "x", 7) for i, t in enumerate(texts)]
    sites, first = {}, {}
    for i, t, _, s, *_ in rows:
        for k, x in enumerate((t or "").split("\n")):
            key = x.strip(" \t\n\r\x0b\f")
            if t is not None and key:
                sites.setdefault(key, set()).add(s or "")
                first.setdefault(key, (i, k))
    spread = {x for x, s in sites.items() if len(s) >= 6}
    assert 0 < len(spread) < len(sites)
    want = {}
    for i, t, *_ in rows:
        kept = [x for k, x in enumerate((t or "").split("\n")) if x.strip() not in spread or first[x.strip()] == (i, k)]
        want[i] = None if t is None else "\n".join(kept)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = line_dedup.remove_boilerplate(docs)
    assert got.columns == [*docs.columns, "n_removed"]
    assert {r.doc_id: r.text for r in got.collect()} == want
    left = line_dedup.without_boilerplate(docs)
    assert left.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in left.collect()} == {i: (t, len(t or "")) for i, t in want.items() if t == texts[i] or t.strip()}


def test_lines_of_odd_rows(spark):
    rows = [(1, "a\nb", "s1"), (1, "a\nb", "s1"), (None, "a\nc", "s2"), (None, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(((r.doc_id, r.text, r.n_removed) for r in line_dedup.remove_boilerplate(docs, 3).collect()), key=str)
    assert got == sorted([(1, "a\nb", 0), (1, "a\nb", 0), (None, "c", 1), (None, "", 1)], key=str)
    assert line_dedup.remove_boilerplate(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        line_dedup.remove_boilerplate(docs.withColumnRenamed("source", "N_removed"))


def test_stars_need_no_step(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(components, "cut", lambda df, f=components.cut: cuts.append(1) or f(df))
    stars = spark.createDataFrame([(1, 5), (7, 1), (3, 9), (9, 3), (4, 4), (None, 2)], "a long, b long")
    assert sorted(map(tuple, components.connected_components(stars).collect())) == [(1, 1), (3, 3), (5, 1), (7, 1), (9, 3)]
    assert len(cuts) == 1


def test_texts_are_numbered_in_the_order_of_copies(spark):
    rows = [(None, 4), (-3, 8), (2**40, 1), (2**40, -1), (-3, 8)]
    got = passage_dedup.numbered(spark.createDataFrame(rows, "doc_id long, th long").repartition(3)).collect()
    assert sorted((r.no, r.doc_id, r.th) for r in got) == [(0, -3, 8), (1, 2**40, -1), (2, 2**40, 1), (3, None, 4)]


def test_least_of_neighbours_is_the_last_of_equals():
    x = np.random.default_rng(2).integers(0, 6, 200)
    for n in (1, 2, 7, passage_dedup.GAP):
        assert passage_dedup._last_least(x, n).tolist() == [max(range(i, i + n), key=lambda j: (-x[j], j)) for i in range(len(x) - n + 1)]
