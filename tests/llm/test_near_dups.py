import random
import re
import string

import numpy as np
import pyarrow as pa
import pytest
from frames import CLASHES, DOCS, clashing, frame, hard_rows, twins, words
from hypothesis import given, settings, strategies as st

from opswell.llm import components, near_dups, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingle_set(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def plain(rows, width, percent):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs."""
    sets = [shingle_set(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and 100 * common >= percent * (len(a) + len(sets[j]) - common):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    return sorted(((d, len(sets[i]), low.get(find(i)), d is not None and d == low.get(find(i))) for i, (d, _) in enumerate(rows)), key=key)


def found(spark, rows, width=3, percent=85):
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width, percent).collect()
    return sorted(map(tuple, got), key=lambda r: tuple((x is not None, x or 0) for x in r))


def copies(n, length, edits, seed):
    """n copies of a text with words changed here and there."""
    r = random.Random(seed)
    source = words(seed, length).split()
    out = []
    for _ in range(n):
        own = list(source)
        for _ in range(r.randint(0, edits)):
            own[r.randrange(length)] = f"w{r.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("slab", [40, 3000, shingles.SLAB])
def test_words_and_sets(slab, monkeypatch):
    monkeypatch.setattr(shingles, "SLAB", slab)
    texts = [r[1] for r in hard_rows()]
    hashes, counts = shingles.word_hashes(pa.array(texts, pa.string()))
    every = [w for t in texts for w in WORD.findall((t or "").translate(LOWER))]
    assert counts.tolist() == [len(WORD.findall(t or "")) for t in texts]
    seen = {}
    assert all(seen.setdefault(w, h) == h for w, h in zip(every, hashes.tolist())) and len(set(seen.values())) == len(seen)
    for width in (1, 3, 5):
        values, sizes = shingles.shingle_sets(pa.array(texts, pa.string()), width)
        assert sizes.tolist() == [len(shingle_set(t, width)) for t in texts] and len(values) == sizes.sum()


def test_words_that_polynomials_confuse(spark):
    for power in range(8, 15):
        s, t = twins(power)
        hashes, _ = shingles.word_hashes(pa.array([f"{s} {t} {s}"]))
        assert hashes[0] == hashes[2] != hashes[1]
        sets, sizes = shingles.shingle_sets(pa.array([f"x {s} y z w", f"x {t} y z w"]), 3)
        assert sizes.tolist() == [3, 3] and len(set(sets.tolist())) == 5
    s, t = twins(10)
    rows = [(1, f"x {s} y z"), (2, f"x {t} y z")]
    assert found(spark, rows) == plain(rows, 3, 85)


def test_minima_of_long_and_short_sets(monkeypatch):
    values, sizes = shingles.shingle_sets(pa.array([words(i, n) for i, n in enumerate((5, 3000, 1, 40, 9000, 2))]), 3)
    want = near_dups._minima(values, sizes)
    for chunk in (7, 100, 4000):
        monkeypatch.setattr(near_dups, "_CHUNK", chunk)
        assert (near_dups._minima(values, sizes) == want).all()


def test_estimate_is_near_the_similarity():
    base = words(1, 800).split()
    for share in (0.5, 0.8, 0.95):
        other = base[: int(800 * share)] + words(2, 800 - int(800 * share)).split()
        texts = [" ".join(base), " ".join(other)]
        m = near_dups._packed(near_dups._minima(*shingles.shingle_sets(pa.array(texts), 3)))
        a, b = (shingle_set(t, 3) for t in texts)
        chance = 0.5**near_dups.BITS
        estimate = (near_dups.equal_fields(m[0], m[1:])[0] / near_dups.HASHES - chance) / (1 - chance)
        real = len(a & b) / len(a | b)
        share = chance + (1 - chance) * real
        assert abs(estimate - real) < near_dups.SLACK * (share * (1 - share) / near_dups.HASHES) ** 0.5 / (1 - chance)


def test_groups_of_copies(spark):
    texts = copies(60, 120, 6, 1) + copies(40, 30, 2, 2) + [words(3, 200)] * 30 + [words(i, 50) for i in range(10, 30)]
    rows = list(enumerate(texts))
    random.Random(1).shuffle(rows)
    assert found(spark, rows) == plain(rows, 3, 85)
    assert found(spark, rows, 5, 80) == plain(rows, 5, 80)


def test_large_groups_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BUCKET_BLOCK", 8)
    monkeypatch.setattr(near_dups, "CLUSTER_BLOCK", 900)
    rows = list(enumerate(copies(70, 100, 8, 5) + copies(20, 400, 10, 6)))
    assert found(spark, rows) == plain(rows, 3, 85)


def test_hard_rows(spark):
    rows = [(r[0], r[1]) for r in hard_rows()]
    assert found(spark, rows) == plain(rows, 3, 85)
    assert found(spark, []) == []
    assert found(spark, [(4, None), (None, ""), (5, "a")]) == plain([(4, None), (None, ""), (5, "a")], 3, 85)


def test_threshold_is_exact(spark):
    """17 of 20 shingles is a link at 85, 16 of 19 is none."""
    w = [f"x{i}" for i in range(30)]
    rows = [(1, " ".join(w[:22])), (2, " ".join(w[:19])), (3, " ".join(w[3:24])), (4, " ".join(w[:18]))]
    assert found(spark, rows) == plain(rows, 3, 85)


def test_one_of_each_keeps_columns_and_rows_without_words(spark):
    docs = clashing(frame(spark, hard_rows()))
    kept = near_dups.one_of_each(docs, 5, 80)
    assert kept.columns == docs.columns and kept.first()["kept"] == "own kept"
    want = [r for r in plain([(r[0], r[1]) for r in hard_rows()], 5, 80) if r[1]]
    rows = kept.collect()
    groups = {}
    for i, (d, t, *_) in enumerate(hard_rows()):
        if shingle_set(t, 5):
            groups.setdefault(frozenset(shingle_set(t, 5)), []).append(d)
    blank = [r for r in rows if not shingle_set(r.text, 5)]
    assert len(blank) == sum(not shingle_set(r[1], 5) for r in hard_rows())
    assert len(rows) - len(blank) <= len(groups) <= len(want)
    assert sum(r.text == "One" for r in rows) == 1


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 30), st.lists(st.tuples(st.integers(0, 29), st.integers(0, 29)), max_size=40))
def test_linked_members_are_components(n, links):
    near = {(a % n, b % n) for a, b in links} | {(b % n, a % n) for a, b in links}
    c = near_dups._linked(lambda i, rest: np.array([(i, int(j)) in near for j in rest], bool), n)
    root = list(range(n))
    for _ in range(n):
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    assert [c[i] == c[j] for i in range(n) for j in range(n)] == [root[i] == root[j] for i in range(n) for j in range(n)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(2000, 2000)]
    random.Random(2).shuffle(edges)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(50)}, 2000: 2000}


def test_whole_table(spark, tables):
    from opswell.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in tables.documents.collect()]
    got = sorted(map(tuple, QUERIES["op7_minhash_dedup"](spark, tables.folder).collect()))
    assert got == plain(rows, 3, 85) and CLASHES and DOCS
