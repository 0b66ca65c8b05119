"""Near-duplicate documents by MinHash with tensored banding, confirmed on full shingle sets.

Two small collections of m half-keys each (r minhashes per half-key) give m * m table keys: table (i, j) has
the pair of half-keys (a_i, b_j). So 2 * m * r minhashes a document serve m * m tables of 2 * r hashes.
A pair of similarity s shares a table with probability (1 - (1 - s^r)^m)^2.

Equal sets are one class before any key is made. Within a table bucket every member is first held
against the bucket's smallest class, which is linear in the bucket. Buckets whose members still lie in more
than one component afterwards are open, and all their pairs across components that may link are confirmed, so no link is lost. In a
small open bucket they are made as they are. Large ones first get a few more rounds against other members, so that a large group of near
copies grows together; those still open then (texts from one template, each other's near miss) are joined on
the rarest shingles of their sets instead: two sets that are similar enough share one of the few rarest of the smaller set, and there
a template's shingles, which all members have, don't come up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordIds, clean, mapped, mixed, released, shingles, staged

#: Half-keys in each collection, minhashes in a half-key, words in a shingle.
HALVES, ROWS, WIDTH = 8, 2, 5
#: A sketch has 2^SKETCH_BITS bits.
SKETCH_BITS = 10
#: Counts that tell rare shingles from common ones: 2^COUNT_BITS of them (1 MB) go to the driver and to every task.
COUNT_BITS = 16
#: Classes of an open bucket whose pairs are made at once; those of larger ones are joined on their rarest shingles.
SMALL = 16
#: Rounds at most in which the members of large open buckets are held against one of them.
ROUNDS = 2
#: Ids up to this many (about 2 MB) are broadcast to pick texts; more are joined by a shuffle.
BROADCAST_IDS = 100_000
#: Edges up to this many (1.6 MB) are joined up by one task; more in rounds of joins.
ONE_TASK = 100_000


def _half_keys(s: np.ndarray, halves: int, rows: int) -> np.ndarray:
    """The 2 * halves half-keys of a set of shingle hashes."""
    count = 2 * halves * rows
    with np.errstate(over="ignore"):
        seeds = mixed(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        mult, add = seeds[:count] | np.uint64(1), seeds[count:]
        low = np.empty(count, np.uint64)
        for i in range(count):
            x = s * mult[i] + add[i]
            low[i] = (x ^ (x >> np.uint64(32))).min()
        keys = low.reshape(2 * halves, rows)
        out = mixed(keys[:, 0])
        for r in range(1, rows):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + keys[:, r])
    return out


def _parity(s: np.ndarray) -> np.ndarray:
    """SKETCH bits: each tells whether an odd number of the set's hashes fall on it. Where two sketches differ, so do the sets."""
    odd = np.bincount((s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, halves: int = HALVES, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """A row per document: doc_id, n (set size), s1 and s2 (128-bit id of the set), half (half-keys), parity (a sketch).
    n is 0 and the rest null without words or with a null text."""

    def start():
        ids = WordIds()

        def one(text: str | None) -> tuple:
            s = shingles(text, ids, width)
            if not len(s):
                return 0, None, None, None, None
            return len(s), *np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64).tolist(), _half_keys(s, halves, rows).view(np.int64), _parity(s)

        def run(batch: dict[str, list]) -> dict[str, list]:
            out = [one(text) for text in batch["text"]]
            return {"doc_id": batch["doc_id"]} | {c: [x[i] for x in out] for i, c in enumerate(("n", "s1", "s2", "half", "parity"))}

        return run

    return mapped(clean(docs, "doc_id", "text"), start, "doc_id long, n long, s1 long, s2 long, half array<long>, parity array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """id, s (sorted shingle hashes) of the documents in wanted (column id)."""
    wanted = wanted.select("id").distinct()
    n = wanted.count()
    picked = clean(docs, "doc_id", "text").join(F.broadcast(wanted) if n <= BROADCAST_IDS else wanted, F.col("doc_id") == F.col("id"), "left_semi")

    def start():
        ids = WordIds()

        def run(batch: dict[str, list]) -> dict[str, list]:
            s = [shingles(text, ids, width).view(np.int64) for text in batch["text"]]
            d = [np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), np.int64).tolist() for x in s]
            return {"id": batch["doc_id"], "s1": [x[0] for x in d], "s2": [x[1] for x in d], "s": s}

        return run

    return mapped(picked, start, "id long, s1 long, s2 long, s array<long>")


def _class_sets(docs: DataFrame, need: DataFrame, width: int) -> DataFrame:
    """class, s of the classes in need (class, rep, s1, s2), written once. A doc_id may stand on several rows with several
    texts, so a class is told by its doc_id and its set's 128 bits."""
    need = need.select("class", "rep", F.col("s1").alias("c1"), F.col("s2").alias("c2"))
    sets = _sets(docs, need.select(F.col("rep").alias("id")), width)
    sets = sets.join(need, (sets.id == need.rep) & (sets.s1 == need.c1) & (sets.s2 == need.c2)).groupBy("class").agg(F.first("s").alias("s"))
    return staged(sets, "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough."""
    left = sets.select(F.col("class").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("class").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    inter = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * inter >= percent * (F.size("sa") + F.size("sb") - inter)).select("a", "b")


def _may_link(a: str, b: str, percent: int):
    """Whether two sets of sizes n{a}, n{b} may be similar enough: sets of similarity t differ by at most (1 - t) / (1 + t) of
    the sum of their sizes, and by as many shingles at least as their sketches by bits."""
    differ = sum((F.bit_count(F.col(f"p{a}")[k].bitwiseXOR(F.col(f"p{b}")[k])) for k in range((1 << SKETCH_BITS) // 64)), F.lit(0))
    return differ * (100 + percent) <= (F.col(f"n{a}") + F.col(f"n{b}")) * (100 - percent)


def _first_table(a: str, b: str, halves: int):
    """Whether table t{a} is the first in which the two meet: no half-key before its own two is common to both. So a pair
    that many tables have is made once."""
    same = lambda k: F.col(f"h{a}")[k] == F.col(f"h{b}")[k]
    i, j = F.floor(F.col(f"t{a}") / halves), F.col(f"t{a}") % halves
    out = F.lit(True)
    for k in range(halves - 1):
        out = out & ~((i > k) & same(k)) & ~((j > k) & same(halves + k))
    return out


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, comp of all edges (a, b) in one task. A root takes the larger roots that it meets, so it is the smallest node of its own."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([root(x) for x in up], pa.int64())], names=["node", "comp"])


def components(edges: DataFrame) -> DataFrame:
    """node, comp: the smallest node that each node of the edges (a, b) reaches.

    Up to ONE_TASK edges are joined up by one task: a round is some ten stages, which the driver plans and compiles however few rows they
    have. With more, every round a node takes the smallest label among its neighbours' and then its label's label, so long
    chains shorten by doubling. Labels are written to the shared folder each round.
    """
    once = staged(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if once.count() <= ONE_TASK:
        labels = staged(once.coalesce(1).mapInArrow(_united, "node long, comp long"), "labels")
        released(once)
        return labels
    both = staged(once.union(once.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    released(once)
    old = labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("low"))
        step = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "low").alias("comp"))
        up = step.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        new = staged(step.join(up, "comp", "left").select("node", "was", F.least("comp", F.coalesce("top", "comp")).alias("comp")), "labels")
        released(old)
        old, labels = new, new.select("node", "comp")
        if new.where("comp <> was").isEmpty():
            released(both)
            return labels


def _open(members: DataFrame) -> DataFrame:
    """The members (key, comp, ...) of buckets that lie in several components, with the bucket's size."""
    split = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("key", "size")
    return members.join(split, "key")


def _relabelled(comp_of: DataFrame, labels: DataFrame) -> DataFrame:
    """comp_of (class, comp) after the labels (node, comp) of components."""
    new = labels.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    return staged(comp_of.join(new, "comp", "left").select("class", F.coalesce("to", "comp").alias("comp")), "comps")


def _merged(comp_of: DataFrame, found: DataFrame) -> DataFrame:
    """comp_of after more links a, b of classes, which tie the components that they lie in."""
    side = lambda x: comp_of.select(F.col("class").alias(x), F.col("comp").alias(f"c{x}"))
    tied = found.join(side("a"), "a").join(side("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    return _relabelled(comp_of, components(tied))


def _untried(pairs: DataFrame, done: list[DataFrame]) -> DataFrame:
    """The pairs without those of any earlier round."""
    for tried in done:
        pairs = pairs.join(tried, ["a", "b"], "left_anti")
    return pairs


def _those_that_may(pairs: DataFrame, about: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches leave room for a link."""
    side = lambda x: about.select(F.col("class").alias(x), F.col("n").alias(f"n{x}"), F.col("parity").alias(f"p{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(_may_link("a", "b", percent)).select("a", "b")


def _lead_pairs(open_: DataFrame, turn: int, halves: int, about: DataFrame, percent: int) -> DataFrame:
    """a, b: the members of open buckets, each with one of its bucket in another component that the turn picks. A turn looks
    at its part of the tables, as members of one group meet in most."""
    open_ = open_.where(F.floor(F.col("table") / halves) % ROUNDS == turn).select("key", "class", "comp")
    drawn = open_.withColumn("draw", F.xxhash64("class", F.lit(turn)))
    lead = drawn.groupBy("key").agg(F.min("draw").alias("draw"))
    lead = drawn.join(lead, ["key", "draw"]).select("key", F.col("class").alias("lead"), F.col("comp").alias("own"))
    met = open_.join(lead, "key").where("comp <> own").select(F.least("class", "lead").alias("a"), F.greatest("class", "lead").alias("b")).distinct()
    return _those_that_may(met, about, percent)


def _small_pairs(open_: DataFrame, percent: int, halves: int) -> DataFrame:
    """a, b: pairs across components of small open buckets that may link, each made in one table."""
    side = lambda x: open_.select("key", F.col("table").alias(f"t{x}"), F.col("class").alias(x), F.col("n").alias(f"n{x}"), F.col("parity").alias(f"p{x}"), F.col("half").alias(f"h{x}"), F.col("comp").alias(f"c{x}"))
    may = (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _may_link("a", "b", percent) & _first_table("a", "b", halves)
    return side("a").join(side("b"), "key").where(may).select("a", "b").distinct()


def rare_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """a, b: the pairs across components of sets (class, comp, s, parity) that may be similar enough, by prefixes of their rarest shingles.

    Shingles are ordered by about how many sets have them, as a table of 2^COUNT_BITS counts by their hash says: any order that is the
    same for all sets is right, and a rare shingle is early in it. Of sets
    x and y, x no larger, that share t / (1 + t) * (|x| + |y|) shingles, one of these is among the first |x| - 2t / (1 + t) * |x| + 1 of x
    and the first |y| - t * |y| + 1 of y. Pairs that can't share enough after the one that they meet at aren't made, nor those that
    have met at the shingle before.
    """
    slots = F.explode(F.transform("s", lambda x: x.bitwiseAND((1 << COUNT_BITS) - 1)))
    told = sets.select(slots.alias("slot")).groupBy("slot").agg(F.count("*").alias("n")).toArrow()  # 2^COUNT_BITS rows at most
    counts = np.zeros(1 << COUNT_BITS, np.int64)
    counts[np.array(told.column("slot"), np.int64)] = np.array(told.column("n"), np.int64)

    def start():
        def run(rows: dict[str, list]) -> dict[str, list]:
            out = {c: [] for c in ("class", "comp", "n", "shingle", "place", "prev")}
            for c, comp, s in zip(rows["class"], rows["comp"], rows["s"]):
                s, n = np.array(s, np.int64), len(s)
                first = n - -(-n * percent // 100) + 1
                s = s[np.lexsort((s, counts[s & ((1 << COUNT_BITS) - 1)]))[:first]].tolist()
                for k, v in zip(out, ([c] * len(s), [comp] * len(s), [n] * len(s), s, range(1, len(s) + 1), [None, *s[:-1]])):
                    out[k] += v
            return out

        return run

    place = staged(mapped(sets.select("class", "comp", "s"), start, "class long, comp long, n long, shingle long, place long, prev long"), "places")
    # shingles of one component pair nothing
    open_ = place.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("shingle")
    place = place.join(open_, "shingle").join(sets.select("class", "parity"), "class")
    side = lambda x, df: df.select("shingle", F.col("class").alias(x), F.col("comp").alias(f"c{x}"), F.col("n").alias(f"n{x}"), F.col("place").alias(f"at{x}"), F.col("parity").alias(f"p{x}"), F.col("prev").alias(f"prev{x}"))
    index = side("a", place.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * (2 * percent) / (100 + percent)) + 1))
    smaller = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    left = F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb")) + 1
    may = (F.col("ca") != F.col("cb")) & smaller & (100 * F.col("na") >= percent * F.col("nb")) & ((100 + percent) * left >= percent * (F.col("na") + F.col("nb"))) & _may_link("a", "b", percent)
    may = may & F.coalesce(F.col("preva") != F.col("prevb"), F.lit(True))  # where the shingles before are the same the two have met there
    return index.join(side("b", place), "shingle").where(may).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, halves: int = HALVES, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    Documents are linked when 100 * |intersection| >= percent * |union| of their shingle sets.
    component_id is the smallest doc_id reachable; kept tells whether it is the row's own. A null or
    wordless text is linked with nothing. Rows of a null doc_id are linked with nothing, have a null component_id
    and are kept. Rows that repeat a doc_id are one node; each gets its own n_shingles. An empty table gives none.
    """
    sig = staged(signatures(docs, halves, rows, width), "signatures")
    linked = sig.where("n > 0 and doc_id is not null")
    classes = staged(linked.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("half").alias("half"), F.first("parity").alias("parity"), F.first("n").alias("n")).withColumn("class", F.monotonically_increasing_id()), "classes")
    tables = F.array(*[F.xxhash64(F.col("half")[i], F.col("half")[halves + j], F.lit(i * halves + j)) for i in range(halves) for j in range(halves)])
    rows_ = classes.select("class", F.posexplode(tables).alias("table", "key"))
    lead = rows_.groupBy("key").agg(F.min("class").alias("lead"), F.max("class").alias("last")).where("lead < last").select("key", "lead")
    shared = staged(rows_.join(lead, "key").select("key", "table", "lead", "class"), "buckets")
    tried = staged(shared.where("lead < class").select(F.col("lead").alias("a"), F.col("class").alias("b")).distinct(), "pairs")
    sets = _class_sets(docs, classes.join(shared.select("class").distinct(), "class", "left_semi"), width)
    edges = staged(_confirmed(tried, sets, percent), "links")
    comp_of = _relabelled(staged(shared.select("class", F.col("class").alias("comp")).distinct(), "comps"), components(edges))
    about, done = classes.select("class", "n", "parity", "half"), [tried]
    for turn in range(ROUNDS + 1):
        open_ = staged(_open(shared.join(comp_of, "class")), "open")
        large = open_.where(F.col("size") > SMALL)
        if turn == ROUNDS or large.isEmpty():
            break
        pairs = staged(_untried(_lead_pairs(large, turn, halves, about, percent), done), "pairs")
        done.append(pairs)
        found = staged(_confirmed(pairs, sets, percent), "links")
        links = found.count()
        if links:
            comp_of = _merged(comp_of, found)
        if 10 * links < pairs.count():  # what is left isn't growing together
            open_ = staged(_open(shared.join(comp_of, "class")), "open")
            large = open_.where(F.col("size") > SMALL)
            break
    more = staged(_small_pairs(open_.where(F.col("size") <= SMALL).join(about, "class"), percent, halves), "small")
    parts = [more]
    few = large.select("class", "comp").distinct()
    if not few.isEmpty():
        parts.append(staged(rare_pairs(sets.join(few, "class").join(about.select("class", "parity"), "class"), percent), "rare"))
        more = more.union(parts[-1]).distinct()
    found = staged(_confirmed(staged(_untried(more, done), "more"), sets, percent), "links")
    if not found.isEmpty():
        comp_of = _merged(comp_of, found)
    # classes, and the ids that have several rows, give the components of doc_ids
    low = comp_of.join(classes.select("class", "rep"), "class").groupBy("comp").agg(F.min("rep").alias("low"))
    named = staged(comp_of.join(low, "comp").select("class", "low"), "low")
    comp = classes.select("class", "s1", "s2", "rep").join(named, "class", "left").select("s1", "s2", F.coalesce("low", "rep").alias("component"))
    named = staged(linked.select("doc_id", "s1", "s2").join(comp, ["s1", "s2"]).select("doc_id", "component").distinct(), "named")
    released(shared, sets, edges, open_, found, *parts, *done)
    again = named.groupBy("doc_id").agg(F.count("*").alias("k"), F.min("component").alias("component"))
    if not again.where("k > 1").isEmpty():
        merged = components(named.join(again.where("k > 1").select("doc_id", F.col("component").alias("b")), "doc_id").select(F.col("component").alias("a"), "b"))
        again = again.join(merged, F.col("component") == F.col("node"), "left").select("doc_id", F.coalesce("comp", "component").alias("component"))
    out = sig.select("doc_id", "n").join(again.select("doc_id", "component"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def dedup(docs: DataFrame, percent: int = 80, **how) -> DataFrame:
    """docs without the near copies: of each component the rows of the smallest doc_id stay."""
    gone = near_duplicates(docs, percent, **how).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
