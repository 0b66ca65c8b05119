"""Near-dedup and line dedup against brute force."""

import random
from types import SimpleNamespace

import numpy as np
import pytest

from granary.llm import common, linededup, minhash
from granary.llm.common import WordIds, shingles

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _docs(spark, texts, ids=None):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, DOCS)


def _sets(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def _components(rows, percent):
    """rows: (doc_id, text). The smallest doc_id that each reaches."""
    near = {}
    for a, ta in rows:
        for b, tb in rows:
            x, y = _sets(ta), _sets(tb)
            if a == b or x and y and 100 * len(x & y) >= percent * len(x | y):
                near.setdefault(a, set()).add(b)
    low = {a: a for a, _ in rows}
    while True:
        new = {a: min([low[a]] + [low[b] for b in near.get(a, ())]) for a in low}
        if new == low:
            return low
        low = new


def _near_copies(seed, bases=4, copies=7, words=60):
    rng = random.Random(seed)
    out = []
    for _ in range(bases):
        base = [f"w{rng.randrange(500)}" for _ in range(words)]
        for k in range(copies):
            w = list(base)
            for _ in range(k // 2):
                w[rng.randrange(words)] = f"x{rng.randrange(10)}"
            out.append(" ".join(w))
    rng.shuffle(out)
    return out


def test_near_duplicates_match_brute_force(spark):
    texts = [*_near_copies(1), None, "", "   ", "one two", "ONE two", "one  TWO three", "Aa bb cc dd ee", "aA bb cc dd ee", "İa bb cc dd ee"]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in minhash.near_duplicates(_docs(spark, texts), 85).collect()}
    want = _components(rows, 85)
    assert len(got) == len(texts)
    for i, t in rows:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(_sets(t)), want[i], want[i] == i)


def test_a_chain_is_one_component_and_open_buckets_are_settled(spark):
    words = [f"w{i}" for i in range(100)]
    chain = [" ".join(f"c{k}_{i}" if k > i else w for i, w in enumerate(words)) for k in range(0, 12)]
    texts = chain + _near_copies(9, 2, 9, 40)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(_docs(spark, texts), 85).collect()}
    assert got == _components(list(enumerate(texts)), 85)


def _templates(seed, docs, words=120, own=20):
    """Texts of one template, each with `own` words of its own, in places of their own."""
    rng = random.Random(seed)
    base = [f"t{i}" for i in range(words)]
    out = []
    for d in range(docs):
        w, at = list(base), rng.randrange(words - own)
        w[at : at + own - d % 5] = [f"o{d}_{k}" for k in range(own - d % 5)]
        out.append(" ".join(w))
    return out


def test_templates_match_brute_force(spark, monkeypatch):
    """Many texts of one template just above and under the threshold, in open buckets of any size."""
    texts = _templates(3, 60, 120, 12) + _templates(4, 60, 100, 6) + _near_copies(8, 2, 9, 40)
    want = _components(list(enumerate(texts)), 85)
    for small in (0, 16):
        monkeypatch.setattr(minhash, "SMALL", small)
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(_docs(spark, texts), 85).collect()}
        assert got == want
    assert 3 < len(set(want.values())) < len(texts)


def test_rare_pairs_lose_no_link(spark):
    rng = random.Random(6)
    base = [rng.randrange(2**63) for _ in range(40)]
    sets = [sorted({*rng.sample(base, rng.randint(20, 40)), *(rng.randrange(2**63) for _ in range(rng.randint(0, 6)))}) for _ in range(150)]
    df = spark.createDataFrame([(i, i // 3, s, minhash._parity(np.array(s, np.uint64)).tolist()) for i, s in enumerate(sets)], "class long, comp long, s array<long>, parity array<long>")
    got = {(r.a, r.b) for r in minhash.rare_pairs(df, 80).collect()}
    links = {(a, b) for b in range(150) for a in range(b) if a // 3 != b // 3 and 100 * len({*sets[a]} & {*sets[b]}) >= 80 * len({*sets[a]} | {*sets[b]})}
    assert links and links <= got


def test_many_texts_of_one_template(spark):
    """None is linked, and no pair is made but those of the first round."""
    texts = _templates(5, 3000, 140, 24)
    rows = minhash.near_duplicates(_docs(spark, texts), 85).collect()
    assert len(rows) == 3000 and all(r.kept for r in rows)


def test_near_duplicates_odd_rows(spark):
    same = "a b c d e f g"
    got = minhash.near_duplicates(_docs(spark, [same, same, "other words stand here now", same, None], [7, 7, 9, None, 3])).collect()
    told = sorted([(r.doc_id, r.component_id, r.kept) for r in got], key=str)
    assert told == sorted([(7, 7, True), (7, 7, True), (9, 9, True), (None, None, True), (3, 3, True)], key=str)
    assert minhash.near_duplicates(_docs(spark, ["x"]).limit(0)).count() == 0
    # a doc_id that stands for two texts ties their groups together
    a, b = "p q r s t u v", "k l m n o p q"
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(_docs(spark, [a, b, a, b], [4, 5, 1, 1])).collect()}
    assert got == {4: 1, 5: 1, 1: 1}


def test_clashing_columns_stay(spark):
    df = _docs(spark, ["a b c d e", "a b c d e", "z"]).selectExpr("doc_id", "text", "lang as n", "source as component_id", "n_chars as kept")
    out = minhash.dedup(df)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == {0, 2}


def test_shingles_of_short_texts():
    ids = WordIds(4)
    assert len(shingles("a b", ids)) == 1 and len(shingles("a b", ids)) == len(shingles("A  b\n", ids))
    assert (shingles("a b", ids) == shingles("A\tB", ids)).all()
    assert len(shingles(" ".join(map(str, range(100))), ids)) == 96
    assert not len(shingles(" " * 0, ids))


def lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def _edited(rng, x, most, letters="abc"):
    b = list(x)
    for _ in range(rng.randint(0, most)):
        k = rng.random()
        if b and k < 0.33:
            b.pop(rng.randrange(len(b)))
        elif k < 0.66:
            b.insert(rng.randint(0, len(b)), rng.choice(letters))
        elif b:
            b[rng.randrange(len(b))] = rng.choice(letters)
    return "".join(b)


def test_banded_distance(spark):
    rng = random.Random(3)
    rows = [(a, _edited(rng, a, 5, "abé\U0001f600")) for a in ("".join(rng.choice("abé\U0001f600") for _ in range(rng.randint(0, 14))) for _ in range(150))]
    df = spark.createDataFrame(rows, "a string, b string")
    for k in (1, 2, 3):
        for r in df.select("a", "b", linededup.edit_distance_at_most(df.a, df.b, k).alias("r")).collect():
            assert r.r == (lev(r.a, r.b) <= k)


def _lines(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdef") for _ in range(rng.randint(5, 30))) for _ in range(8)]
    lines = [_edited(rng, x, 3) for x in base for _ in range(6)]
    rng.shuffle(lines)
    return ["\n".join(lines[i : i + 3]) for i in range(0, len(lines), 3)]


def _dedup(rows, edits, least):
    """rows: (doc_id, text) by doc_id, all different."""
    first = {}
    for d, t in rows:
        for i, x in enumerate(t.split("\n")):
            if len(x) >= least:
                first.setdefault(x, (d, i))
    links = {(a, b) for a in first for b in first if a != b and lev(a, b) <= edits}
    out = {}
    for d, t in rows:
        keep, exact, near = [], 0, 0
        for i, x in enumerate(t.split("\n")):
            if len(x) >= least and first[x] != (d, i):
                exact += 1
            elif len(x) >= least and any(first[b] < (d, i) for a, b in links if a == x):
                near += 1
            else:
                keep.append(x)
        out[d] = ("\n".join(keep), exact, near)
    return out, {(min(first[a], first[b]), max(first[a], first[b])) for a, b in links}


def test_line_dedup_matches_brute_force(spark):
    rows = list(enumerate(_lines(5)))
    df = _docs(spark, [t for _, t in rows])
    for k in (1, 2):
        want, links = _dedup(rows, k, 5)
        assert {(tuple(r.a), tuple(r.b)) for r in linededup.line_links(df, k, 5).collect()} == links
        got = {r.doc_id: (r.text, r.n_exact, r.n_near) for r in linededup.line_dedup(df, k, 5).collect()}
        assert got == want


def test_one_edit_links_at_every_place(spark):
    """Every place and kind of one edit, and pairs of them, so that the sketches and shifts are all met."""
    rng = random.Random(11)
    lines = set()
    for n in (16, 17, 18, 19, 33, 50):
        base = "".join(rng.choice("abcdefgh é") for _ in range(n))
        lines.add(base)
        for k in range(n + 1):
            lines |= {base[:k] + "x" + base[k:], base[:k] + "y" + base[k + 1 :], base[:k] + base[k + 1 :]}
    lines = sorted(x for x in lines if len(x) >= 16)
    rng.shuffle(lines)
    rows = [(i, "\n".join(lines[i : i + 4])) for i in range(0, len(lines), 4)]
    first = {x: (d, k) for d, t in rows for k, x in enumerate(t.split("\n"))}
    by = {}
    for x in lines:
        for k in range(len(x) + 1):
            by.setdefault(x[:k] + x[k + 1 :], set()).add(x)
    near = {tuple(sorted((first[a], first[b]))) for v in by.values() for a in v for b in v if a < b and lev(a, b) <= 1}
    near |= {tuple(sorted((first[a], first[b]))) for a in lines for b in by.get(a, ()) if a != b and lev(a, b) <= 1}
    assert {(tuple(r.a), tuple(r.b)) for r in linededup.line_links(_docs(spark, [t for _, t in rows], [d for d, _ in rows])).collect()} == near


def test_line_dedup_odd_rows(spark):
    long = "a line that is long enough to count"
    texts = [None, "", "\n\n", long, long + "\nshort\n" + long + "!", "short\nshort", long]
    df = _docs(spark, texts, [0, 1, 2, 3, 4, 5, None]).withColumnRenamed("lang", "lines").withColumnRenamed("source", "at")
    out = linededup.line_dedup(df)
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns[:5] == df.columns
    assert [got[i].text for i in (0, 1, 2, 3, 4, 5, None)] == [None, "", "\n\n", long, "short", "short\nshort", long]
    assert (got[4].n_lines, got[4].n_exact, got[4].n_near) == (3, 1, 1)
    assert linededup.line_dedup(df.limit(0)).count() == 0
    twice = linededup.line_dedup(_docs(spark, [long, long], [1, 1])).collect()
    assert [r.text for r in twice] == [long, long]


def test_short_repeats_go_with_exact_chars(spark):
    texts = ["Les.\n\n  \nAnd ornd.", "And ornd.\n\nLes\n  ", "Les.\nLes", "Les.", "a line that is long enough\nLes.", "a line that is long enough!\nx\nx"]
    df = _docs(spark, [*texts, "\n\n", ""])
    got = {r.doc_id: (r.text, r.n_lines, r.n_exact, r.n_near) for r in linededup.line_dedup(df, exact_chars=1).collect()}
    want = [("Les.\n\n  \nAnd ornd.", 4, 0, 0), ("\nLes\n  ", 4, 1, 0), ("", 2, 2, 0), ("", 1, 1, 0), ("a line that is long enough", 2, 1, 0), ("x", 3, 1, 1), ("\n\n", 3, 0, 0), ("", 1, 0, 0)]
    assert [got[i] for i in range(8)] == want
    assert [r.text for r in linededup.line_dedup(df).orderBy("doc_id").collect()][:5] == texts[:5]


def test_line_dedup_is_native(spark, capsys):
    linededup.line_dedup(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).explain("formatted")
    plan = capsys.readouterr().out
    assert "Join" in plan and not any(x in plan for x in ("Python", "Arrow", "Cartesian", "NestedLoop"))


def test_large_buckets_are_cut_again(spark, monkeypatch):
    """All buckets count as large, so every link is found by the rounds."""
    monkeypatch.setattr(linededup, "SMALL", 1)
    rows = list(enumerate(_lines(6)))
    for k in (1, 2):
        links = _dedup(rows, k, 5)[1]
        assert {(tuple(r.a), tuple(r.b)) for r in linededup.line_links(_docs(spark, [t for _, t in rows]), k, 5).collect()} == links


def test_a_family_of_lines(spark):
    """Lines that differ in a counter alone: many share a segment, few are within one edit."""
    head, tail = "the same words stand before the number of this line ", " and these after it"
    numbers = [7 * i + 100_000 for i in range(6_000)]
    rows = [(d, "\n".join(f"{head}{k}{tail}" for k in numbers[d * 100 : d * 100 + 100])) for d in range(60)]
    got = {(tuple(r.a), tuple(r.b)) for r in linededup.line_links(_docs(spark, [t for _, t in rows])).collect()}
    first = {str(k): (i // 100, i % 100) for i, k in enumerate(numbers)}
    want = {tuple(sorted((first[x], first[x[:p] + c + x[p + 1 :]]))) for x in first for p in range(6) for c in "0123456789" if c != x[p] and x[:p] + c + x[p + 1 :] in first}
    assert got == want and len(want) > 1000


def test_a_doc_id_with_several_texts(spark):
    """A line that another text of the same doc_id has lost stays where it stands alone."""
    one, two, b = "AAAA a line of the first text one", "BBBB a line of a second text two", "CCCC this line occurs in two places"
    rows = [(0, b), (1, f"{one}\n{two}"), (1, f"{b}\n{one[:-3]}xyz"), (1, f"{one}\n{two}"), (None, b)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, _th string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text, r.n_exact, r.n_near) for r in linededup.line_dedup(df).collect())
    assert got == sorted([(0, b, 0, 0), (1, f"{one}\n{two}", 0, 0), (1, f"{one}\n{two}", 0, 0), (1, f"{one[:-3]}xyz", 1, 0), (-1, b, 0, 0)])


@pytest.mark.parametrize("one_task", [minhash.ONE_TASK, 0])
def test_components_by_one_task_and_by_rounds(spark, monkeypatch, one_task):
    monkeypatch.setattr(minhash, "ONE_TASK", one_task)
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(130)] + [(i + 1, i) for i in range(1000, 1040)] + [(7, 7), (-5, 2**62)]
    low = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in low:
        for a, b in edges:
            if a != b:
                low[a] = low[b] = min(low[a], low[b])
    spark.sparkContext.setJobGroup(f"components {one_task}", "")
    got = minhash.components(spark.createDataFrame(edges, "a long, b long"))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"components {one_task}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r.node: r.comp for r in got.collect()} == low and got.count() == len(low)
    assert jobs <= 6 or not one_task  # rounds plan and compile some ten stages each on the driver
    assert minhash.components(spark.createDataFrame([(4, 4)], "a long, b long")).count() == 0


def test_heap_is_returned_once_it_has_grown():
    calls, total = [], [100]
    jvm = SimpleNamespace(totalMemory=lambda: total[0], maxMemory=lambda: 1000, gc=lambda: calls.append(total[0]) or total.__setitem__(0, total[0] * 3 // 4))
    of = SimpleNamespace(_jvm=SimpleNamespace(java=SimpleNamespace(lang=SimpleNamespace(Runtime=SimpleNamespace(getRuntime=lambda: jvm)))), sparkContext=SimpleNamespace(applicationId="a test's own"))
    for now in (500, 501, 600, 1000, 930, 938):
        total[0] = now
        common.heap_returned(of)
    assert calls == [501, 600, 1000, 938]
