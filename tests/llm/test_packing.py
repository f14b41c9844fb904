"""Mixing, packing and the pipeline."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tidewell.llm import mixing, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_equal_the_tokenizers_library():
    enc, tok = packing.encoder(PATH), Tokenizer.from_file(PATH)
    for t in ["", " ", "a  b\n\n c \n\n", "<|endoftext|> x <|endo", "é  \t x  ", "don't 'll 12,3.. __x", " x y", "日本 語", "\x00 \x01", "a" * 5000]:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_cut():
    assert packing.cut(1, 1024) == [(0, 1)] and packing.cut(1024, 1024) == [(0, 1024)]
    assert packing.cut(2050, 1024) == [(0, 2), (2, 1024), (1026, 1024)] and packing.cut(2048, 1024) == [(0, 1024), (1024, 1024)]


@pytest.mark.parametrize("capacity", [10, 64])
def test_plans_hold_every_piece_and_come_near_the_bound(capacity):
    r = np.random.default_rng(capacity)
    for n in (1, 7, 300, 5000):
        lengths = r.integers(1, capacity + 1, n)
        h = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
        plan = packing.solve(h, capacity)
        held: dict = {}
        for config, times in plan:
            assert times > 0 and sum(s * k for s, k in config.items()) <= capacity
            for s, k in config.items():
                held[s] = held.get(s, 0) + k * times
        assert held == h
        big = sum(v for s, v in h.items() if 2 * s > capacity)  # no two of these share a sequence
        assert sum(t for _, t in plan) <= 1.03 * max(big, -(-int(lengths.sum()) // capacity)) + 2


def test_knapsack_prices():
    value, config = packing.priced(np.array([0.6, 0.35, 0.1]), np.array([6, 4, 1]), 10)
    assert config == {6: 1, 4: 1} or value == pytest.approx(1.0)
    assert value == pytest.approx(max(0.6 * a + 0.35 * b + 0.1 * c for a in range(2) for b in range(3) for c in range(11) if 6 * a + 4 * b + c <= 10))


@pytest.mark.parametrize("lengths,best_fit_is_far", [(range(1, 1025), False), (range(257, 500), True)])
def test_linear_program_decides_on_full_histograms(lengths, best_fit_is_far, caplog):
    """Most sequences come from the program, near its bound; where two kinds of triples must be mixed, best-fit alone is far off."""
    r = np.random.default_rng(1)
    h = {s: int(50 + r.integers(0, 100)) for s in lengths}
    with caplog.at_level("INFO", packing.log.name):
        plan = packing.solve(h, 1024)
    by_program, by_best_fit, bound = caplog.records[-1].args
    held: dict = {}
    for config, times in plan:
        assert times > 0 and sum(s * k for s, k in config.items()) <= 1024
        for s, k in config.items():
            held[s] = held.get(s, 0) + k * times
    assert held == h
    total = sum(t for _, t in plan) - h.get(1024, 0)
    assert by_program + by_best_fit == total and by_program > 0.8 * total
    alone = sum(t for _, t in packing.best_fit({s: n for s, n in h.items() if s < 1024}, 1024))
    assert bound <= min(total, alone) + 1e-6 and total <= 1.06 * bound
    assert total < 0.95 * alone if best_fit_is_far else total <= 1.01 * alone


def test_every_length_is_covered():
    for h in ({1: 1}, {5: 3, 9: 10**9, 1: 1}, {s: int(1e6 / s**1.3) + 1 for s in range(1, 64)}):
        configs, bound = packing.cover(h, 64)
        for s, n in h.items():
            assert sum(dict(c).get(s, 0) * x for c, x in configs.items()) >= n * (1 - 1e-6)
        assert sum(configs.values()) >= bound * (1 - 1e-6)


def test_pack_documents(make, corpus):
    got = packing.pack_documents(make(corpus), PATH, 64, 2).collect()
    tok = Tokenizer.from_file(PATH)
    want = []
    for i, t, *_ in corpus:
        ids = np.asarray(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want += [(i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), 64))]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    room: dict = {}
    for r in got:
        room.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in room.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(make(corpus).limit(0), PATH).count() == 0


@pytest.mark.parametrize("weights", [{"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1.0, "b": 0.37, "c": 0.0131}, {"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}])
def test_mixing_keeps_the_given_weights_at_every_slot(make, weights):
    """Less than a block of deviation from the weights themselves, however many slots there are."""
    rows = [(i, "x" * 9, "en", s) for s, n, base in (("a", 2500, 0), ("b", 1500, 10_000), ("c", 1000, 20_000)) for i in range(base, base + n)]
    got = sorted(mixing.mix(make(rows), weights, block_chars=10).collect(), key=lambda r: r.slot)
    assert len(got) == 5000 and [r.slot for r in got] == list(range(5000))
    assert all(r.release <= r.slot < r.deadline for r in got if r.on_target)
    share = {s: w / sum(weights.values()) for s, w in weights.items()}
    done, on_target = dict.fromkeys("abc", 0), sum(r.on_target for r in got)
    for r in got[:on_target]:
        assert r.on_target
        done[r.source] += 1
        assert all(abs(done[s] - (r.slot + 1) * share[s]) < 1 for s in "abc")
    size = {"a": 2500, "b": 1500, "c": 1000}
    assert on_target == min(int(size[s] / share[s] + 1e-9) for s in "abc") and len({(r.source, r.block) for r in got}) == 5000


def test_mixing_order_does_not_depend_on_partitions(spark, make, corpus):
    want = sorted(map(str, mixing.mix(make(corpus), block_chars=300).collect()))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert sorted(map(str, mixing.mix(make(corpus), block_chars=300).collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_mixing_bounds_its_schedule(make, corpus):
    """Fewer slots, larger blocks: nothing is lost."""
    got = mixing.mix(make(corpus), block_chars=1, slots=16).collect()
    assert len(got) == len(corpus) and max(r.slot for r in got) < 16 + 3


def test_mixing_odd_rows(make, corpus):
    got = mixing.mix(make(corpus), block_chars=500)
    assert got.count() == len(corpus)
    assert got.filter("NOT on_target OR (slot >= release AND slot < deadline)").count() == len(corpus)
    assert mixing.in_schedule_order(make(corpus)).count() == len(corpus)
    assert mixing.mix(make(corpus).limit(0)).count() == 0
    assert mixing.mix(make(corpus), {"nowhere": 1.0}).count() == len(corpus)
    one = mixing.mix(make(corpus), {"s1": 1.0}, block_chars=500).collect()
    assert len(one) == len(corpus) and max(r.slot for r in one if r.source == "s1") < min(r.slot for r in one if r.source != "s1")
    kept = mixing.with_slots(make(corpus), "at")
    assert kept.count() == len(corpus) and kept.columns == [*make(corpus).columns, "at"]


def test_pipeline_against_its_stages_by_hand(spark, make, corpus, tmp_path):
    """Stage by stage without the stages' code: rules and slots in another engine's SQL, copies by brute force, pieces by the tokenizers library."""
    import duckdb

    from tests.llm.test_dedup import low, shingles
    from tidewell.llm import quality

    rows = [r for r in corpus if r[0] not in (600, None)] + [(601, "shared words " * 3 + "and so on and on we go with twenty words or more in this one", "en", "s0")]
    make(rows).select(*corpus_pipeline.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    good = {i for i, ok in c.sql(f"SELECT doc_id, kept FROM ({quality.oracle_sql()})").fetchall() if ok}
    text = {i: t for i, t, *_ in rows if i in good}
    last = {}
    for i in text:
        last[low(text[i])] = max(last.get(low(text[i]), -1), i)
    left = sorted(last.values())
    comp = {i: i for i in left}
    find = lambda i: i if comp[i] == i else find(comp[i])
    sets = {i: shingles(text[i], 5) for i in left}
    for a in left:
        for b in left:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    kept = [i for i in left if find(i) == i]
    c.sql(f"CREATE TABLE rest AS SELECT doc_id, text, lang, coalesce(source, '') AS source FROM documents WHERE doc_id IN ({', '.join(map(str, kept))})")
    c.sql("DROP TABLE documents; ALTER TABLE rest RENAME TO documents")
    slot = {r[0]: r[4] for r in c.sql(f"SELECT doc_id, source, chars, block, slot FROM ({mixing.oracle_sql()})").fetchall()}
    tok = Tokenizer.from_file(PATH)
    pieces = []
    for i in kept:
        ids = np.asarray(tok.encode(text[i] or "", add_special_tokens=False).ids + [2], "<u4")
        pieces += [(i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), 1024))]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(pieces)
    by: dict = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    first = []
    for k in range(len(by)):  # numbered without gaps
        at = 0
        for r in sorted(by[k], key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        first.append(min(slot[r.doc_id] for r in by[k]))
    assert first == sorted(first)  # by the earliest slot in them
    lengths = dict(zip(*(x.tolist() for x in np.unique([p[3] for p in pieces], return_counts=True))))
    assert len(by) == sum(n for _, n in packing.solve(lengths, 1024))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mix_sources", "pack"]


def test_pipeline_rows_follow_the_weights(spark, make, tmp_path):
    """Other target weights, other rows: pieces of a length and sequences go by slot."""
    import random

    from tests.llm.conftest import prose

    r = random.Random(8)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(900)]
    rows = [(i, prose(r, 4000, words), "en", "ab"[i % 2]) for i in range(24)]
    docs = make(rows).select(*corpus_pipeline.COLUMNS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    key = lambda got: sorted(tuple(x) for x in got)
    one, two = ({w: corpus_pipeline.run(spark, str(tmp_path), {"a": w, "b": 1 - w}).collect() for w in (0.9, 0.1)}).values()
    assert one and key(one) != key(two)
    assert key(x[:5] for x in one) == key(x[:5] for x in two)  # the same pieces, all of them
    for w, got in ((0.9, one), (0.1, two)):
        slot = {x.doc_id: x.slot for x in mixing.mix(docs, {"a": w, "b": 1 - w}).collect()}
        full = sorted((x.sequence_id, slot[x.doc_id]) for x in got if x.length == 1024)
        assert len(full) > 20 and [s for _, s in full] == sorted(s for _, s in full)
        assert {x.sequence_id for x in got} == set(range(max(x.sequence_id for x in got) + 1))


def test_pipeline_on_an_empty_table(spark, make, tmp_path):
    import corpus_pipeline

    make([(1, "x")]).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
