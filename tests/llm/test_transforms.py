"""Benchmark decontamination, vector codes and fill-in-the-middle."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from tests.llm.test_scans import same, unique, views
from tidewell.llm import decontamination, fill_in_middle, vector_codes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(UPPER))


@pytest.fixture(scope="module")
def items(corpus):
    """(item_id, text): passages of documents, short items, copies, blanks, an item in two rows and one that repeats a word."""
    text = {r[0]: r[1] for r in corpus}
    cut = lambda i, a, b: " ".join(text[i].split()[a:b])
    return [
        (1, "Before " + cut(500, 100, 160).upper() + " after"), (2, cut(500, 15_000, 15_010)), (3, cut(500, 700, 709)), (12, cut(300, 20, 50)), (13, cut(300, 20, 50)), (4, "é É ß, ß\tß"), (5, "x"), (6, None), (7, " .. "),
        (8, "ab " * 40), (9, cut(100, 30, 60)), (9, cut(100, 5, 40)), (None, cut(5, 0, 30)), (10, "nowhere to be found in any of these documents as one"), (11, "AB-ab_ab"),
    ]


def frame(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, "item_id long, text string").withColumns({c: F.lit(0) for c in ("doc_id", "n", "runs", "items", "pass", "word")})


def brute(rows, items, width=10):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(len(w), width)
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for r in rows:
        w, hit, found = words(r[1]), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (who := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= who
        ids = sorted(str(x) for x in found if x is not None)
        out.append((r[0], len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.drop("items").collect()), key=str)


def test_decontamination_matches_windows_by_brute_force(spark, make, corpus, items):
    got = decontamination.contamination(make(corpus), frame(spark, items))
    assert rows_of(got) == brute(corpus, items)
    few = decontamination.contamination(make(corpus), frame(spark, items), pass_bytes=900)
    assert len(decontamination.passes(decontamination.items_of(frame(spark, items), "item_id", "text"), 10, 900)) > 2
    assert rows_of(few) == brute(corpus, items)


def test_decontamination_matches_sql(spark, make, corpus, items):
    rows = unique(corpus)
    c = views(rows)
    c.sql("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    same(c, decontamination.oracle_sql(), decontamination.contamination(make(rows), frame(spark, items)).drop("items"))


def test_decontamination_of_empty_tables(spark, make, corpus, items):
    assert decontamination.contamination(make(corpus).limit(0), frame(spark, items)).count() == 0
    none = decontamination.contamination(make(corpus), frame(spark, items).limit(0)).collect()
    assert len(none) == len(corpus) and not any(r.contaminated for r in none) and sum(r.n_words for r in none) == sum(len(words(r[1])) for r in corpus)
    assert decontamination.longest_matches(make(corpus), frame(spark, []), 10).count() == 0


@pytest.mark.parametrize("pass_bytes", [1 << 20, 900])
def test_decontaminated_keeps_all_columns_of_clean_rows(spark, make, corpus, items, pass_bytes):
    clean = sorted(((r[0], r[1]) for r, b in zip(corpus, (brute([r], items)[0] for r in corpus)) if not b[-1]), key=str)
    docs = make(corpus)
    got = decontamination.decontaminated(docs, frame(spark, items), pass_bytes=pass_bytes)
    assert got.columns == docs.columns and sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == clean


def test_longest_matches_are_those_of_all_places(spark, make, items):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice("abc") for _ in range(60))) for i in range(30)] + [(40, "ab " * 500), (41, None)]
    tests = [(1, " ".join(r.choice("abc") for _ in range(40))), (2, rows[3][1][:50]), (3, "ab ab ab ab ab ab z"), (4, "c")]
    want = {}
    for i, t in tests:
        w = words(t)
        n = min(len(w), 5)
        for k in range(len(w) - n + 1):
            for d, text in rows:
                x = words(text)
                for p in range(len(x)):
                    m = 0
                    while p + m < len(x) and k + m < len(w) and x[p + m] == w[k + m]:
                        m += 1
                    if m >= n:
                        key = (str(i), k)
                        want[key] = min(want.get(key, (0,)), (-m, d, p))
    got = {(g.item_id, g.start): (-g.length, g.doc_id, g.word) for g in decontamination.longest_matches(make(rows), frame(spark, tests), 5).collect()}
    assert got == want


def test_suffix_array_orders_by_the_depth_asked_for():
    r = np.random.default_rng(1)
    for text in (r.integers(0, 3, 200), np.zeros(300, np.int64), r.integers(0, 1 << 30, 50), np.zeros(0, np.int64)):
        order = decontamination.suffix_array(text, int(text.max(initial=0)) + 1, 40)
        cut = [tuple(text[i : i + 40]) for i in order]
        assert sorted(order) == list(range(len(text))) and cut == sorted(cut)


def test_one_word_all_through_a_long_text(spark, make):
    """200,000 equal words against an item of 500: equal windows are searched once, so locations stay in proportion."""
    got = decontamination.contamination(make([(1, "ab " * 200_000)]), frame(spark, [(k, "ab " * 500) for k in range(3)])).first()
    assert (got.n_words, got.n_hit, got.n_items) == (200_000, 200_000, 3)


VECTORS = "vec_id long, embedding array<float>, label int"


def vector_rows(n=300, dim=32, seed=2):
    r = np.random.default_rng(seed)
    rows = [(int(i), [float(np.float32(x)) for x in r.normal(size=dim) / 4], int(r.integers(0, 4)) if i % 7 else None) for i in r.permutation(n)]
    rows += [(1000 + k, rows[0][1], 9) for k in range(100)]
    return rows + [(2000, None, 1), (2001, [None] + rows[1][1][1:], 1), (2002, [float("nan")] + rows[1][1][1:], 1), (2003, rows[1][1][1:] + [float("-inf")], 1), (None, rows[2][1], 1), (5, rows[3][1], 2), (6, rows[4][1], 2), (6, rows[4][1], 2)]


def by_hand(rows, parts, entries, rounds, scale=256):
    ok = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = lambda v: np.array_split(np.array([int(np.floor(scale * float(x))) for x in v], dtype=object), parts)
    xs = [cut(r[1]) for r in ok]
    books = [[list(x[p]) for x in xs[:entries]] for p in range(parts)]

    def find(x, book):
        far = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in book]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for x in xs:
                held.setdefault(find(x[p], books[p])[0], []).append(x[p])
            for e, of in held.items():
                books[p][e] = [sum(c) // len(of) for c in zip(*of)]
    found = [[find(x[p], books[p]) for p in range(parts)] for x in xs]
    errors = [sum(d for _, d in f) for f in found]
    by_label = {}
    for r, e in zip(ok, errors):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    said = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{e:02x}" for e, _ in f), d, by_label[r[2]], said) for r, f, d in zip(ok, found, errors)), key=str)


def codes(df, **how):
    return sorted((tuple(r) for r in vector_codes.compress_vectors(df, **how).drop("label").collect()), key=str)


@pytest.mark.parametrize("few", [True, False])
def test_vector_codes_match_plain_integers(spark, few, monkeypatch):
    from pyspark.sql import functions as F

    if not few:
        monkeypatch.setattr(vector_codes, "FEW_ROWS", 0)
    rows = vector_rows()
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("z") for c in ("vec", "code", "error", "part", "n", "of", "to", "salt")})
    assert codes(df.repartition(5), parts=4, entries=16) == by_hand(rows, 4, 16, 2)
    assert codes(df.limit(9).coalesce(1), parts=2, entries=64) == by_hand(rows[:9], 2, 64, 2)  # fewer rows than entries


def test_vector_codes_match_sql(spark):
    rows = vector_rows(200, 64)
    c = duckdb.connect()
    c.sql("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    c.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    same(c, vector_codes.oracle_sql(), vector_codes.compress_vectors(spark.createDataFrame(rows, VECTORS)).drop("label"))


def test_vector_codes_of_odd_tables(spark):
    of = lambda rows: spark.createDataFrame(rows, VECTORS)
    assert codes(of([])) == [] and codes(of([(1, None, 1), (2, [float("nan")] * 16, None)])) == []
    for bad in ([(1, [0.0] * 16, 1), (2, [0.0] * 32, 1)], [(1, [0.0] * 15, 1)], [(1, [1e30] * 16, 1)]):
        with pytest.raises(ValueError):
            codes(of(bad))
    with pytest.raises(ValueError):
        codes(of([(1, [0.0] * 16, 1)]), entries=300)


def test_decoded_vectors_have_the_error_told(spark):
    rows = vector_rows(120, 32)
    df = spark.createDataFrame(rows, VECTORS)
    coded, books = vector_codes.compress(df, parts=4, entries=16)
    first = {r[0]: r[1] for r in rows if r[0] is not None and r[0] < 120 and r[0] not in (5, 6)}
    seen = 0
    for r in vector_codes.decoded(coded, books).collect():
        if r.vec_id in first:
            x = np.floor(np.array(first[r.vec_id]) * 256)
            assert ((x - np.array(r.vec) * 256) ** 2).sum() == r.error
            seen += 1
    assert seen == len(first)


TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = [(700, "ends in blanks \n\t"), (701, " no break space é"), (702, "has <S> in it " * 9), (703, "<P>"), (704, "almost <P and S> " * 9), (705, "< S <" * 30), (None, "no id"), (None, None), (706, "a\x00b c"), (707, "\U0001f600 " * 50)]


def test_fill_in_middle_by_hand(make, corpus):
    rows = corpus + ODD + [(k, "one two  three\nfour five six ") for k in range(800, 900)]
    got = fill_in_middle.fill_in_middle(make(rows)).collect()
    assert len(got) == len(rows) and {r.form for r in got} == {"plain", "psm", "spm"}
    text = {}
    for i, t, *_ in rows:
        text.setdefault(i, []).append(t or "")
    for r in got:
        whole = fill_in_middle.restored(r.output, r.form)
        assert whole in text[r.doc_id] and hashlib.sha256(r.output.encode()).hexdigest() == r.output_sha256
        units = TOKEN.findall(whole)
        assert "".join(units) == whole and r.n == len(units)
        h = hashlib.sha256(f"42:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        a, b, c, d = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
        if not whole or any(m in whole for m in ("<P>", "<S>", "<M>")) or c % 100 >= 50:
            assert (r.form, r.output, r.prefix_chars, r.middle_chars) == ("plain", whole, None, None)
            continue
        low, high = sorted((a % (r.n + 1), b % (r.n + 1)))
        p, m, s = ("".join(units[x:y]) for x, y in ((0, low), (low, high), (high, r.n)))
        assert (r.prefix_chars, r.middle_chars) == (len(p), len(m))
        assert (r.form, r.output) == (("spm", f"<S>{s}<P>{p}<M>{m}") if d % 100 < 80 else ("psm", f"<P>{p}<S>{s}<M>{m}"))


def test_fill_in_middle_matches_sql_and_takes_empty_tables(make, corpus):
    rows = unique(corpus + [x for x in ODD if x[0] != 706])
    same(views(rows), fill_in_middle.oracle_sql(), fill_in_middle.with_restored_digest(fill_in_middle.fill_in_middle(make(rows))))
    assert fill_in_middle.with_restored_digest(fill_in_middle.fill_in_middle(make(rows).limit(0))).count() == 0


def test_units_of_a_long_text_take_linear_time():
    for text in (" " * 2_000_000, "a" * 2_000_000, "a " * 1_000_000):
        assert fill_in_middle.unit_ends(text)[-1] == len(text)
