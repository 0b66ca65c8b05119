"""Neighbours, quality, packing and mixing, against brute force, round trips and held-out accuracy."""

import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from granary.llm import ann, mixing, packing, quality, queries

TOKENS = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


def _best(ids, x, q, k):
    s = (x * x[list(ids).index(q)]).sum(1)
    order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
    return [ids[j] for j in order], [s[j] for j in order]


def test_neighbours_of_a_small_table_are_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 8)).round(2) * rng.uniform(0.5, 3, (300, 1))
    x[50:90] = x[40]  # many equal vectors: ties go to the smaller id
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(400, None, 0), (420, [], 0), (440, [0.0] * 8, 0), (460, [float("nan")] * 8, 0), (480, [float("inf")] + [1.0] * 7, 0), (500, [None] + [1.0] * 7, 0), (None, [1.0] * 8, 0), (520, [1.0, 2.0], 0), (521, [1.0, 1.0], 0)]
    df = spark.createDataFrame(rows + odd + rows[:1], "vec_id long, embedding array<double>, score int")
    got = defaultdict(list)
    for r in ann.nearest(df, block=100, queries=7).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == {i for i in range(300) if i % 20 == 0} | {520}
    assert got.pop(520) == [(1, 521, 3.0)]
    for q, found in got.items():
        ids, scores = _best(np.arange(300), x, q, 20)
        assert [v for _, v, _ in found] == ids and [r for r, _, _ in found] == list(range(1, 21))
        assert np.allclose([s for _, _, s in found], scores, rtol=0, atol=1e-12)
    assert ann.nearest(df.limit(0)).count() == 0


def test_forest_recall():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((4000, 64))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    ids = np.arange(4000)
    q, v, _ = ann.search_block(ids, x, ids[:100], x[:100], 20)
    recall = np.mean([len(set(v[q == i]) & set(_best(ids, x, i, 20)[0])) / 20 for i in range(100)])
    assert recall >= 0.9
    held = np.mean([len(c) for c in ann.Forest(x).candidates(x[:20], 1400)])
    assert held < 4000 * 0.7  # it isn't a scan


def _junk(rng):
    words = [f"w{rng.randrange(300)}" for _ in range(rng.randint(20, 80))]
    kind = rng.randrange(3)
    return " ".join(w.upper() + "!!" for w in words) if kind == 0 else " | ".join(words) if kind == 1 else " ".join(w for w in words[:8] for _ in range(9))


def test_neighbours_of_any_magnitude():
    rng = np.random.default_rng(3)
    for size in (1e-100, 1e-30, 1.0, 1e19, 1e150, 1e300):
        x = rng.standard_normal((300, 8)) * size
        q, v, s = ann.search_block(np.arange(300), x, np.arange(0, 300, 20), x[::20], 5)
        assert len(q) == 15 * 5 and (np.bincount(q, minlength=300)[::20] == 5).all()
        if size <= 1e150:
            for i in range(0, 300, 20):
                assert v[q == i].tolist() == _best(np.arange(300), x, i, 5)[0]


def test_training_rows_are_bounded(spark):
    """Many rows of one doc_id count as one, and the features that come to the driver have a bound."""
    df = _docs(spark, [(1, f"text number {i}", "s") for i in range(500)] + [(i, f"good words here {i}", "s") for i in range(2, 60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    seen, own = [], quality.fit
    quality.fit = lambda rows, y, *a, **k: (seen.append((len(rows), sum(len(i) for i, _ in rows))), own(rows, y, *a, **k))[1]
    try:
        quality.train(df, labels)
        quality.train(df, labels, most_features=400)
    finally:
        quality.fit = own
    assert 40 < seen[0][0] < 60 and 0 < seen[1][0] < seen[0][0] and seen[1][1] <= 400


def test_quality_on_held_out_rows(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randint(20, 80))) + "." if i % 4 else _junk(rng), "s") for i in range(900)]
    df = _docs(spark, [*rows, (None, None, None), (5000, "", None)])
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(900)] + [(None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality(df, labels, most=500).collect()}
    assert len(got) == 902 and all(0 <= r.score <= 1 for r in got.values())
    held = [i for i in range(900) if got[i].held_out]
    assert held == [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == int(i % 4 > 0) for i in held]) > 0.95
    assert all(r.predicted == int(r.score >= 0.3) for r in got.values())
    again = {r.doc_id: r.score for r in quality.quality(df.select("n_chars", "source", "text", "doc_id", "lang"), labels, most=500).collect()}
    assert again == {i: r.score for i, r in got.items()}


def test_quality_without_labels(spark):
    df = _docs(spark, [(1, "a b c", "s")])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.quality(df, none).collect()] == [0.5]
    assert quality.good_documents(df, none).columns == df.columns
    assert quality.quality(df.limit(0), none).count() == 0


def test_factor_sum_is_all_pairs():
    rng = np.random.default_rng(3)
    m = quality.Machine(0.3, rng.standard_normal(9), rng.standard_normal((9, 4)))
    i, x = np.array([0, 3, 8]), np.array([0.5, -1.0, 2.0])
    z = 0.3 + m.w[i] @ x + sum((m.v[i[a]] @ m.v[i[b]]) * x[a] * x[b] for a in range(3) for b in range(a))
    assert np.allclose(m.scores([(i, x), (i[:1], x[:1])]), [1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-(0.3 + m.w[0] * 0.5)))])


def test_patterns_cover_the_demand():
    rng = np.random.default_rng(4)
    for n, sizes in ((0, 64), (1, 64), (40, 64), (3000, 64)):
        demand = np.bincount(np.minimum(sizes - 1, rng.geometric(0.07, n)) - 0, minlength=sizes)[:sizes]
        plan = packing.patterns(demand, sizes)
        assert (sum((t * c for t, c in plan), np.zeros(sizes, int)) == demand).all()
        assert all((c * np.arange(1, sizes + 1)).sum() <= sizes for _, c in plan)
        least = (demand * np.arange(1, sizes + 1)).sum() / sizes
        assert sum(t for t, _ in plan) <= least * 1.02 + 2


def test_encoder_is_the_tokenizer():
    rng = random.Random(12)
    plain = "abcXYZ 019'\"!?.,_-<|>\t\n\x0bäÖßıſñÉ’—…sStTrReEvVmMlLdD²½ªµ×÷"
    odd = plain + "İΣςａ\u0301\u00a0\x1c\x85\u3000日本\U0001f600ﬁẞ"
    texts = ["".join(rng.choice(a) for _ in range(rng.randint(0, 60))) for a in (plain, odd) for _ in range(2000)]
    texts += ["I'll we've they're it's don't I'm he'd 's 'S ''s !'s", "<|endoftext|>a<|startoftext|>", "ÀÉ" * 50, "ΑΣ ΣΑΣ", "a_b __ _1", "ﬀ ²3"]
    want = Tokenizer.from_file(TOKENS).encode_batch(texts, add_special_tokens=False)
    for t, got, e in zip(texts, packing.Encoder(TOKENS)(texts), want):
        assert np.frombuffer(got, "<u4").tolist() == e.ids, t


def test_packing_round_trip(spark):
    rng = random.Random(6)
    texts = [None, "", " ", "<|endoftext|> special", "it's a test of spaces\x1c!", "naïve café ﬁ", "x" * 9000, "long words " * 3000]
    texts += [" ".join(rng.choice(["alpha", "beta,", "GAMMA", "δέλτα", "42", "don't"]) for _ in range(rng.randint(1, 700))) for _ in range(120)]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(7, texts[7], "s")]
    df = _docs(spark, rows).withColumnRenamed("lang", "class").withColumnRenamed("source", "length")
    ids = [e.ids + [1] for e in Tokenizer.from_file(TOKENS).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    cover, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack(df, TOKENS).collect():
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert (r.ids_crc32, r.doc_tokens, len(part)) == (zlib.crc32(part.tobytes()), len(ids[r.doc_id]), r.length)
        cover[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, x in enumerate(ids):
        want = [(a, min(2048, len(x) - a)) for a in range(0, len(x), 2048)]
        assert sorted(cover[i]) == sorted(want * (2 if i == 7 else 1))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert sorted(sequences) == list(range(len(sequences)))
    total = sum(map(len, ids)) + len(ids[7])
    assert len(sequences) <= 1.05 * total / 2048 + 2
    assert packing.pack(df.limit(0), TOKENS).count() == 0


def test_packing_in_the_order_of_files(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["one", "two", "three"]) for _ in range(rng.choice((20, 20, 300)))), "s") for i in range(600)]
    _docs(spark, rows).repartitionByRange(5, "doc_id").sortWithinPartitions("doc_id").write.parquet(f"{tmp_path}/docs")
    packed = packing.pack(spark.read.parquet(f"{tmp_path}/docs"), TOKENS, in_order=True).collect()
    assert sorted(r.doc_id for r in packed) == list(range(600))
    by = defaultdict(list)
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        by[r.length].append((r.sequence_id, r.doc_id))
    assert all([d for _, d in sorted(x)] == sorted(d for _, d in x) for x in by.values())


def _targets(sizes, weights, share=1.5, repeats=2.0):
    """Water-filling by bisection: the level at which the capped targets reach the share."""
    want = min(share * sum(sizes), repeats * sum(sizes))
    lo, hi = 0.0, 1e12
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(repeats * s, mid * w) for s, w in zip(sizes, weights)) < want else (lo, mid)
    return [min(repeats * s, hi * w) for s, w in zip(sizes, weights)]


def test_targets_match_water_filling(spark):
    rng = random.Random(7)
    for _ in range(6):
        n = rng.randint(1, 9)
        sizes = [rng.choice([0, 1, 10, 1000, 10**6]) * rng.randint(1, 9) for _ in range(n)] + [5]
        weights = [(3, 1, 2)[i % 3] for i in range(n + 1)]
        df = spark.createDataFrame([(chr(97 + i), x) for i, x in enumerate(sizes)], "source string, size long").repartition(3)
        got = sorted(mixing.plan(df).collect(), key=lambda r: r.number)
        assert [r.source for r in got] == [chr(97 + i) for i in range(n + 1)] and [r.source_size for r in got] == sizes
        assert np.allclose([r.target for r in got], _targets(sizes, weights), rtol=1e-6, atol=1e-3)
        assert [r.lo for r in got] == [sum(x.quota for x in got[:i]) for i in range(n + 1)]


def test_mix(spark):
    rng = random.Random(8)
    names = ["b", "a", "é", "Z", None, "tiny"]
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 60))), names[min(rng.randrange(9), 4)]) for i in range(1500)]
    rows += [(2000, "only three words", "tiny"), (2001, None, "tiny"), (2001, None, "tiny"), (2002, "", "empty")]
    df = _docs(spark, rows)
    got = mixing.mix(df.withColumnRenamed("lang", "target").withColumnRenamed("n_chars", "taken"), carried=False).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, _targets([sizes[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))])))
    by = defaultdict(int)
    own = defaultdict(list)
    for i, t, s in rows:
        own[i].append((size(t), s))
    for r in got:
        n, s = own[r.doc_id][0]
        assert (r.size, r.source_size) == (n, sizes[s]) and np.isclose(r.target, goal[s], rtol=1e-6) and 0 <= r.taken <= 2 * r.size
        by[s] += r.taken
    for s, n in sizes.items():
        assert abs(by[s] - goal[s]) <= max(2, 0.01 * goal[s])
    again = {(r.doc_id, r.taken) for r in mixing.mix(df.repartition(5), carried=False).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def _reversed(t, bits):
    return int(format(t, f"0{bits}b")[::-1], 2) if bits else 0


def test_slots_of_a_stretch_are_counted(spark):
    rng = random.Random(3)
    for bits in (0, 1, 5, 9):
        lo, hi = sorted((rng.randint(0, 1 << bits), rng.randint(0, 1 << bits)))
        lo, hi = (0, 1) if not bits else (lo, max(hi, lo + 1)) if lo < 1 << bits else (lo - 1, hi)
        want = [t for t in range(1 << bits) if lo <= _reversed(t, bits) < hi]
        rows = spark.range(hi - lo).select(mixing.slot_of(F.col("id"), F.lit(lo), F.lit(hi), bits).alias("t"), "id").orderBy("id").collect()
        assert [r.t for r in rows] == want


def test_the_mix_is_near_its_weights_from_its_beginning(spark):
    """Slots against the schedule made one by one; every stretch of the mix has each source's share."""
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randint(0, 90)), rng.choice("aabc")) for i in range(2500)]
    df = _docs(spark, rows)
    plan = {r.number: r for r in mixing.plan(df.select("source", mixing.n_words(df.text).alias("size"))).collect()}
    total = sum(p.quota for p in plan.values())
    bits = (total - 1).bit_length()
    seen, want = dict.fromkeys(plan, 0), {}
    for t in range(1 << bits):
        for i, p in plan.items():
            if p.lo <= _reversed(t, bits) < p.hi:
                want[t] = (i, seen[i] % p.blocks)
                seen[i] += 1
    got = mixing.mix_pieces(df).orderBy("slot", "start").collect()
    assert {r.slot: (r.source_index, r.block) for r in got} == want
    size = {i: len(t.split()) for i, t, _ in rows}
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.start and r.start + r.length <= size[r.doc_id] and r.length > 0
        taken[r.doc_id] += r.length
    mixed = mixing.mix(df).collect()
    assert {r.doc_id: r.taken for r in mixed if r.taken} == taken
    first = {}
    for r in got:
        first[r.doc_id] = min(r.slot, first.get(r.doc_id, r.slot))
    assert {r.doc_id: r.slot for r in mixed if r.taken} == first
    share = {i: p.target / sum(x.target for x in plan.values()) for i, p in plan.items()}
    words, by = 0, defaultdict(int)
    for r in got:
        words += r.length
        by[r.source_index] += r.length
        each = max(p.source_size / p.blocks for p in plan.values()) + 1
        assert all(abs(by[i] - share[i] * words) <= 4 * each + 0.02 * words for i in plan)
    order = [(r.source_index, r.slot) for r in got]
    assert [s for _, s in order] == sorted(s for _, s in order)
    # the documents' order is that of their first words
    names = sorted({s for _, _, s in rows})
    out = [r.source for r in mixing.mixed_documents(df).collect()]
    for k in range(400, len(out), 200):
        for i, n in enumerate(names):
            docs = sum(1 for _, t, s in rows if s == n and t)
            assert abs(out[:k].count(n) / k - (plan[i].quota / plan[i].blocks * docs) / len(out)) < 0.08


def test_mix_is_what_sql_says(spark, tmp_path):
    rng = random.Random(12)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice((0, 3, 30, 400)))), rng.choice([None, "é", "\U0001f600", *"aaaaabcdefghij"])) for i in range(900)]
    rows += [(2000, "only three words", "tiny"), (2001, None, "tiny"), (2002, "", "empty"), (None, "a text of no id", "b"), (2003, "w " * 30000, "large")]
    _docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.sql(queries.ORACLE_SQL["op10_mixing"]).fetchall(), key=str)
    got = queries.op10_mixing(spark, str(tmp_path))
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken", "slot"]
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_many_sources_are_joined_by_a_shuffle(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), "en", rng.choice([None, "é", "\U0001f600", *"abcdefghij"]), 0) for i in range(300)] + [(300, "", "en", "empty", 0), (301, "w " * 30000, "en", "large", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    told = lambda: {r.doc_id: (r.source, r.size, r.source_size, round(r.target, 6), r.taken, r.slot, r.ranges) for r in mixing.mix(df).collect()}
    want = told()
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 3)
    assert told() == want and len(want) == 302
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixed_documents(spark):
    rng = random.Random(9)
    rows = [(i, "  ".join(f"d{i}x{k}" for k in range(rng.randint(0, 30))), "ab"[i % 2]) for i in range(400)]
    df = _docs(spark, rows)
    taken = {r.doc_id: r for r in mixing.mix(df).collect()}
    words = defaultdict(int)
    for r in mixing.mixed_documents(df).collect():
        assert r.n_chars == len(r.text)
        for w in r.text.split():
            words[w] += 1
    for i, t, _ in rows:
        told = [0] * len(t.split())
        for a, b, n in taken[i].ranges:
            for k in range(a, b):
                told[k] += n
        assert [words[w] for w in t.split()] == told and sum(told) == taken[i].taken
    assert mixing.mixed_documents(df).columns == df.columns
    assert mixing.mixed_documents(df.limit(0)).count() == 0
