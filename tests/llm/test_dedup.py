"""Exact, near, substring and suffix dedup against brute force."""

import hashlib
import itertools
import random
from collections import Counter

import pytest

from tidewell.llm import near_dedup, suffix_dedup
from tidewell.llm.exact_dedup import drop_exact_copies, exact_dedup, quotient_filters, repeated_fingerprints
from tidewell.llm.near_dedup import near_components
from tidewell.llm.substring_dedup import substring_dedup
from tidewell.llm.suffix_dedup import neighbours_common, suffix_array

ASCII = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def low(text):
    return (text or "").encode().translate(ASCII)


def test_exact_dedup(make, corpus):
    got = exact_dedup(make(corpus)).collect()
    assert len(got) == len(corpus)
    groups: dict = {}
    for i, t, *_ in corpus:
        groups.setdefault(low(t), []).append(i)
    ids = {hashlib.sha256(k).hexdigest(): v for k, v in groups.items()}
    for r in got:
        members = ids[r.text_sha256]
        assert r.group_size == len(members) and r.keep_id == max((m for m in members if m is not None), default=None)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert exact_dedup(make(corpus[:0] + [(1, "a")]).limit(0)).count() == 0
    left = drop_exact_copies(make(corpus))
    assert left.count() == len(groups) and left.columns == make(corpus).columns


def test_quotient_filters_merge_without_loss(spark):
    r = random.Random(1)
    fps = [r.choice([r.getrandbits(64), 5, 1 << 63, (1 << 64) - 1]) - (1 << 63) for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in fps], "fp long").repartition(7)
    got = {x.fp: x.n for x in repeated_fingerprints(quotient_filters(df, 5), 5).collect()}
    assert got == {k: n for k, n in Counter(fps).items() if n > 1}


def shingles(text, n):
    w = low(text).split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@pytest.mark.parametrize("size", [2, 5])
def test_near_components(make, corpus, size):
    got = {(r.doc_id, r.n_shingles): r for r in near_components(make(corpus), size, 80).collect()}
    sets = [(i, shingles(t, size)) for i, t, *_ in corpus]
    comp = {i: i for i, _ in sets}

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
            x, y = sorted((top(i), top(j)))
            comp[y] = x
    for i, s in sets:
        r = got[i, len(s)]
        assert r.component_id == (top(i) if i is not None else None)
        assert r.kept == (i is None or i == top(i))
    assert near_components(make(corpus[:2]).limit(0), size).count() == 0


def test_near_components_of_repeated_ids(make):
    """A doc_id on several rows is one node: it links the texts of its rows."""
    words = [" ".join(f"w{k}x{i}" for i in range(30)) for k in range(4)]
    rows = [(3, words[0]), (7, words[0]), (7, words[1]), (5, words[2]), (9, words[1]), (9, words[1]), (11, words[3])]
    got = {(r.doc_id, r.component_id, r.kept) for r in near_components(make(rows), 2).collect()}
    assert got == {(3, 3, True), (7, 3, False), (9, 3, False), (5, 5, True), (11, 11, True)}


def test_near_copies_lose_no_link(spark):
    """Recall on a table with planted copies, against an exact join on all shingles: every component is found."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r.component_id for r in near_components(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), 2).collect()}
    sets, held = {r.doc_id: shingles(r.text, 2) for r in rows}, {}
    for i, s in sets.items():
        for x in s:
            held.setdefault(x, []).append(i)
    shared = Counter(p for ids in held.values() for p in itertools.combinations(sorted(ids), 2))
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    assert links and all(got[a] == got[b] for a, b in links)


def test_near_links_survive_small_blocks(make, corpus, monkeypatch):
    """Tiny blocks make every bucket and cluster many tasks; the components stay."""
    want = {(r.doc_id, r.component_id) for r in near_components(make(corpus), 2).collect()}
    f, g = near_dedup.across_clusters, near_dedup.links_in_clusters
    monkeypatch.setattr(near_dedup, "across_clusters", lambda *a: f(*a, block=3))
    monkeypatch.setattr(near_dedup, "links_in_clusters", lambda *a: g(*a, block=3))
    assert {(r.doc_id, r.component_id) for r in near_components(make(corpus), 2).collect()} == want


def test_signatures_estimate_similarity():
    a = near_dedup.shingle_set(" ".join(map(str, range(1000))), 2)
    b = near_dedup.shingle_set(" ".join(map(str, range(100, 1100))), 2)
    x, y = (near_dedup.signature(s, 2000) for s in (a, b))
    assert (x == y).mean() == pytest.approx(899 / 1099, abs=0.03)


def test_substring_dedup(make, corpus):
    got = sorted((r.doc_id if r.doc_id is not None else 1 << 62, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(make(corpus), 13).collect())
    key = lambda i: 1 << 62 if i is None else i
    first: dict = {}
    for i, t, *_ in corpus:
        w = (t or "").encode().split()
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, 1 << 62), key(i))
    want = []
    for i, t, *_ in corpus:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < key(i):
                gone[k : k + 13] = [True] * 13
        want.append((key(i), len(w), sum(gone), hashlib.sha256(b" ".join(x for x, y in zip(w, gone) if not y)).hexdigest()))
    assert got == sorted(want)


@pytest.mark.parametrize("span", [40, 400])
def test_suffix_dedup(make, corpus, span):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(make(corpus), span, min(64, span // 4)).collect())
    n: Counter = Counter()
    for _, t, *_ in corpus:
        b = (t or "").encode()
        n.update(b[k : k + span] for k in range(len(b) - span + 1))
    want = []
    for i, t, *_ in corpus:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - span + 1):
            if n[b[k : k + span]] > 1:
                gone[k : k + span] = b"\1" * span
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        want.append((i if i is not None else -1, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(b, gone) if not y)).hexdigest()))
    assert got == sorted(want)


@pytest.mark.parametrize("heavy", [1, 200])
def test_heavy_prefixes_are_lengthened(make, corpus, monkeypatch, heavy):
    """Prefixes over the budget get longer ones, step by step; stretches stay runs of windows, groups decide them, and the rows stay."""
    from tidewell.llm import repeats

    rows = [r for r in corpus if r[0] != 500]
    finds = (lambda: substring_dedup(make(rows), 13), lambda: suffix_dedup.suffix_dedup(make(rows), 40, 10))
    want = [sorted(map(str, f().collect())) for f in finds]
    seen = []
    f = repeats.longer
    monkeypatch.setattr(repeats, "longer", lambda s, k, level: seen.append(level) or f(s, k, level))
    monkeypatch.setattr(repeats, "GROUP_BYTES", heavy)
    assert [sorted(map(str, f().collect())) for f in finds] == want
    assert 0 in seen and (heavy > 1 or max(seen) > 1)


def test_prefixes_grow_to_the_window():
    from tidewell.llm import repeats
    from tidewell.llm.substring_dedup import word_kind
    from tidewell.llm.suffix_dedup import byte_kind

    assert [repeats.room(word_kind(13, 8), n)[0] for n in range(5)] == [8, 10, 11, 12, 13]
    sizes = [repeats.room(byte_kind(400, 64), n)[0] for n in range(9)]
    assert sizes == [64, 232, 316, 358, 379, 389, 394, 397, 398]


def test_an_anchor_of_most_texts(make, monkeypatch):
    """One line in every text, all different around it: its prefix is too heavy and is lengthened, and the tree decides what is left of it; hot anchors change no row."""
    from tidewell.llm import repeats

    r = random.Random(9)
    line = [f"w{i}" for i in range(10)]
    side = [[f"{s}{k}" for k in range(4)] for s in "abc"]
    rows = [(i, " ".join([*(f"x{i}y{k}" for k in range(20)), *side[i % 3], *line, *(r.choice(["p", "q"]) for _ in range(8)), *(f"z{i}y{k}" for k in range(20))])) for i in range(150)]
    want = sorted(map(str, substring_dedup(make(rows), 13).collect()))
    rows_in: list[int] = []
    f = repeats.in_groups
    monkeypatch.setattr(repeats, "in_groups", lambda s, d, g: rows_in.append(s.count()) or f(s, d, g))
    monkeypatch.setattr(repeats, "GROUP_BYTES", 4000)
    assert sorted(map(str, substring_dedup(make(rows), 13).collect())) == want
    assert len(rows_in) > 1 and sum(rows_in[1:]) > 0
    monkeypatch.setattr(repeats, "SAMPLE", 1)
    monkeypatch.setattr(repeats, "HOT_SAMPLE", 2)
    assert len(repeats.hot_anchors(make(rows).selectExpr("text", "doc_id AS place"), substring_kind())) > 5
    assert sorted(map(str, substring_dedup(make(rows), 13).collect())) == want


def substring_kind():
    from tidewell.llm.substring_dedup import word_kind

    return word_kind(13, 8)


def test_substring_operators_on_empty_tables(make, corpus):
    empty = make(corpus[:1]).limit(0)
    assert substring_dedup(empty, 13).count() == 0 and suffix_dedup.suffix_dedup(empty, 40, 10).count() == 0


def test_equal_stretches_fold_before_they_are_grouped(make, monkeypatch):
    """A passage of many texts, in two surroundings, is a few rows when groups are made, however many texts there are."""
    from tidewell.llm import repeats

    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*(f"a{i}x{k}" for k in range(3)), *words, *(f"b{i}x{k}" for k in range(3))])) for i in range(200)]
    sizes = []
    f = repeats.in_groups
    monkeypatch.setattr(repeats, "in_groups", lambda s, d, g: sizes.append((s.count(), s.agg({"n": "max"}).first()[0])) or f(s, d, g))
    got = substring_dedup(make(rows), 13).collect()
    assert sum(r.n_removed for r in got) == 199 * 60 and sizes[0][1] == 200


def test_suffix_tree_nodes():
    """Every maximal repeat of random words at least so long is a node, and deeper ones exist."""
    from tidewell.llm.substring_dedup import internal_nodes, suffix_tree

    import numpy as np

    r = random.Random(2)
    span = 3
    bodies = [np.array([r.randint(0, 2) for _ in range(r.randint(3, 9))], np.uint64) for _ in range(30)]
    windows = np.array([len(b) - span + 1 for b in bodies])
    stretch, offset, common = suffix_tree([b.tobytes() for b in bodies], windows, span)
    suffixes = [tuple(bodies[s][o:].tolist()) for s, o in zip(stretch, offset)]
    assert suffixes == sorted(suffixes) and len(suffixes) == windows.sum()
    got = {(d, suffixes[a][:d]): b - a + 1 for d, a, b in internal_nodes(common, span)}
    prefixes = Counter(s[:d] for s in suffixes for d in range(span, len(s) + 1))
    branching = {p for p, n in prefixes.items() if n > 1 and (len({s[len(p) : len(p) + 1] for s in suffixes if s[: len(p)] == p}) > 1 or p in suffixes)}
    assert set(got) == {(len(p), p) for p in branching} and all(prefixes[p] == n for (_, p), n in got.items())
    assert max(d for d, _ in got) > span


@pytest.mark.parametrize("letters", ["ab", "abcdefghijklmnop"])
def test_the_suffix_array_decides(letters, monkeypatch):
    """Windows by the array equal windows by brute force, on random and periodic bytes; without the array nothing but cutless windows is found."""
    import numpy as np

    r = random.Random(6)
    base = "".join(r.choice(letters) for _ in range(400))
    bodies = list({(base[(a := r.randrange(300)) : a + r.randint(60, 90)] + "".join(r.choice(letters) for _ in range(r.randint(0, 30)))).encode() for _ in range(40)} | {b"ab" * 40, b"z" * 70})
    times = np.array([1 + (k % 7 == 0) for k in range(len(bodies))])
    got = set(zip(*(x.tolist() for x in suffix_dedup.repeated(bodies, times, 50))))
    n = Counter(b[k : k + 50] for b in bodies for k in range(len(b) - 49))
    want = {(i, k) for i, b in enumerate(bodies) for k in range(len(b) - 49) if n[b[k : k + 50]] > 1 or times[i] > 1}
    assert got == want
    monkeypatch.setattr(suffix_dedup, "right_runs", lambda data, cut, end, span: (np.arange(len(cut)), np.zeros(len(cut), np.int64)))
    assert len(suffix_dedup.repeated(bodies, np.ones(len(bodies), int), 50)[0]) < len(want) / 2


def test_linear_grouping_sorts_suffixes():
    r = random.Random(5)
    for _ in range(500):
        t = [r.randint(0, r.choice([0, 1, 3, 9])) for _ in range(r.randint(0, 50))]
        order = suffix_array(t)
        assert order == sorted(range(len(t)), key=lambda i: t[i:])
        for k in range(1, len(t)):
            a, b = t[order[k - 1] :], t[order[k] :]
            h = next((h for h, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert neighbours_common(t, order)[k] == h


def test_anchors_do_not_depend_on_the_length_of_a_text(make):
    """The hashes of the passage's first and last eight bytes first differ at bit 21, which the places of a long text used to take up; those between are larger."""
    passage, filler = "wdbxhaccier6bye8", "".join(random.Random(3).choices("abcdefghijklmnopqrstuvwxyz", k=(1 << 21) + 100))
    got = suffix_dedup.suffix_dedup(make([(1, passage), (2, filler + passage)]), 16, 8)
    assert sorted(map(tuple, got.select("doc_id", "n_removed", "n_spans").collect())) == [(1, 16, 1), (2, 16, 1)]
