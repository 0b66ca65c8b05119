"""Line dedup by a segment-partition edit join, with DataFrame functions only.

A line is cut into k + 1 segments of near equal length (k: the edits allowed). If a line y is within k edits
of a line x that is no shorter, one of y's segments stands unchanged in x, at a place that differs from its own
by at most as many characters as the edits to its left and right allow. So y's segments go into
an index keyed by length, segment number and content; x probes it with the few substrings that may match,
for each length from n - k to n. Keys are hashes, made while the texts are scanned; only lines of which
a key is another line's too are fetched.

Lines that meet in a small bucket are paired, and a pair is verified by a banded bit-parallel edit distance whose band of 2k + 1
diagonals is one word of bits. In a large bucket (a family of lines that share a segment) nothing is paired: what the segment leaves of
each line is a line again, still within the same edits of its partners, and goes through the same join under the bucket's
key. Each round leaves less of the lines, till the buckets are small or a few characters are left; so the work follows the lines
and their true links, not the square of a family.

A line's occurrence goes when an earlier occurrence (by doc_id, then line number) of the same line or of a
line within k edits exists. This asks for no chains of links, so one join settles it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import released, running, staged

#: Edits allowed, and the characters from which a line is looked at; shorter lines always stay.
EDITS, MIN_CHARS = 1, 16
#: Keys of a bucket whose lines are paired at once; a larger one goes through another round.
SMALL = 16
#: Rows up to this many (about 2 MB of ids) are broadcast to pick texts; more are joined by a shuffle.
BROADCAST_IDS = 100_000
_INDEX = -1
_OCC = ("doc", "copy", "at")


def _segment(i: int, r: Column, parts: int) -> tuple[Column, Column]:
    """Start (from 0) and length of segment i of r characters; the last segments have one more where they can't be equal."""
    base, more = F.floor(r / parts).cast("int"), (r % parts).cast("int")
    if i == 0:
        return F.lit(0), base + (more >= parts).cast("int")
    return base * i + F.greatest(F.lit(0), more - (parts - i)), base + (more >= parts - i).cast("int")


def _shifts(i: int, longer: int, edits: int) -> list[int]:
    """Where segment i of the shorter line may stand in one that is longer: at most i edits lie before it and at most edits - i
    after it, and the shifts on both sides add up to the difference of the lengths."""
    return [s for s in range(-edits, edits + 1) if abs(s) <= i and abs(longer - s) <= edits - i]


def _keys(text: Column, n: Column, longer: int, edits: int, bucket: Column | None = None) -> list[tuple[Column, Column]]:
    """(key or null, what the segment leaves of the text) of a text of n characters. `longer` is _INDEX for an index's text, or
    by how much a probe is longer than the indexed texts that it looks for."""
    extra, parts, out = max(longer, 0), edits + 1, []
    r = n - extra
    for i in range(parts):
        start, length = _segment(i, r, parts)
        for shift in [0] if longer == _INDEX else _shifts(i, longer, edits):
            at = start + shift
            key = F.xxhash64(*([bucket] if bucket is not None else []), r, F.lit(i), F.substring(text, at + 1, length))
            # a shift to the left may begin before the text, one to the right may end after it
            fits = (r > 0) & (at >= 0) & (at + length <= n)
            out.append((F.when(fits, key), F.concat(F.substring(text, 1, at), F.substring(text, at + length + 1, n))))
    return out


def _roles(edits: int) -> list[int]:
    """An index's text, and the probes. One edit between texts of equal length leaves a segment in its own place, so
    there the index is its own probe."""
    return [_INDEX, *range(1 if edits == 1 else 0, edits + 1)]


def edit_distance_at_most(a: Column, b: Column, edits: int) -> Column:
    """Whether strings a and b are within `edits` edits: Levenshtein distance along a band of 2 * edits + 1
    diagonals, whose column differences are the bits of two words.

    Step j takes character j of b. Bit i of `eq` tells whether it equals the character of a on diagonal i.
    `d` marks diagonal steps of cost 0, `hp` and `hn` horizontal steps of cost +1 and -1; the next column's
    vertical steps follow. The distance is followed down the lowest diagonal, then along a's last row.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1
    long = lambda x: F.lit(x).cast("long")
    n, m = F.char_length(a), F.char_length(b)

    def step(acc: Column, j: Column, s: Column) -> Column:
        # j counts from 1; a's characters on the band are j - edits .. j + edits, and get() gives null outside
        c = F.get(s["y"], j - 1)
        eq = None
        for i in range(width):
            bit = F.when(F.coalesce(F.get(s["x"], j - 1 - edits + i) == c, F.lit(False)), long(1 << i)).otherwise(long(0))
            eq = bit if eq is None else eq.bitwiseOR(bit)

        def moved(v: Column) -> Column:
            d, vp, vn = v["d"], acc["vp"], acc["vn"]
            hp = vn.bitwiseOR(F.bitwise_not(d.bitwiseOR(vp)).bitwiseAND(long(full)))
            hn = d.bitwiseAND(vp)
            down = F.shiftright(d, 1)
            at = edits * 2 - (j - (n - edits))  # the bit of a's last row, once the band has passed it
            bit = lambda z: F.call_function("shiftright", z, at).bitwiseAND(long(1))
            cost = F.when(j <= n - edits, F.lit(1) - F.shiftright(d, 2 * edits).bitwiseAND(long(1))).otherwise(F.when(at >= 0, bit(hp) - bit(hn)).otherwise(0))
            return F.struct(hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp)).bitwiseAND(long(full))).alias("vp"), down.bitwiseAND(hp).alias("vn"), (acc["dist"] + cost).cast("long").alias("dist"))

        d = lambda q: ((q.bitwiseAND(acc["vp"]) + acc["vp"]).bitwiseXOR(acc["vp"])).bitwiseOR(q).bitwiseOR(acc["vn"]).bitwiseAND(long(full))
        zero = F.transform(F.array(eq), lambda q: F.struct(d(q).alias("d")))  # an array of one names a value that is used often
        # the end can lower the distance by 2 * edits at most
        return F.when(acc["dist"] > 3 * edits + 1, acc).otherwise(F.get(F.transform(zero, moved), F.lit(0)))

    # the character arrays stay out of the state, which is copied at each step
    start = F.struct(long((full >> edits) << edits).alias("vp"), long(0).alias("vn"), long(edits).alias("dist"))
    both = F.array(F.struct(F.split(a, "").alias("x"), F.split(b, "").alias("y")))
    run = F.get(F.transform(both, lambda s: F.aggregate(F.sequence(F.lit(1), m), start, lambda acc, j: step(acc, j, s), lambda acc: acc["dist"])), F.lit(0))
    short = F.greatest(n, m) <= edits
    return F.when(F.abs(n - m) > edits, F.lit(False)).when(short, F.lit(True)).when(F.least(n, m) == 0, F.lit(False)).when(n < edits, F.levenshtein(a, b) <= edits).otherwise(run <= edits)


def _trimmed(a: Column, b: Column) -> Column:
    """Structs of a and b without (most of) their common beginning and end, which the distance doesn't depend on: while the
    first or last half of the shorter one is common, it goes."""
    state = F.array(F.struct(a.alias("a"), b.alias("b")))
    for _ in range(7):

        def less(s: Column, end: bool) -> Column:
            half = F.floor(F.least(F.char_length(s["a"]), F.char_length(s["b"])) / 2).cast("int")
            part = (lambda x: F.right(x, half)) if end else (lambda x: F.left(x, half))
            rest = (lambda x: F.left(x, F.char_length(x) - half)) if end else (lambda x: F.substring(x, half + 1, F.char_length(x)))
            return F.when((half > 0) & (part(s["a"]) == part(s["b"])), F.struct(rest(s["a"]).alias("a"), rest(s["b"]).alias("b"))).otherwise(s)

        state = F.transform(F.transform(state, lambda s: less(s, False)), lambda s: less(s, True))
    return state


def _looked_at(line: Column, min_chars: int, exact_chars: int | None) -> Column:
    """Whether a line's repeats go: those of min_chars characters, and with exact_chars those of as many that aren't blank."""
    long = F.char_length(line) >= min_chars
    return long if exact_chars is None else long | ((F.char_length(line) >= exact_chars) & line.rlike(r"(?U)\S"))


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with _copy, and doc, copy, text of each different row with a doc_id. _copy is 0, or where a doc_id has several texts their
    number in the order of a hash; equal rows have the same number."""
    own = lambda x: x.where("doc_id is not null").select(F.col("doc_id").alias("doc"), F.col("_copy").alias("copy"), "text")
    again = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select(F.col("doc_id").alias("_id"))
    if again.isEmpty():
        docs = docs.withColumn("_copy", F.lit(0).cast("long"))
        return docs, own(docs)
    hashed = docs.select("doc_id", F.xxhash64("text").alias("_th")).join(again, F.col("doc_id") == F.col("_id"), "left_semi").distinct()
    told = staged(running(staged(hashed, "again"), ["doc_id"], "_th", F.lit(1), "_copy", 16), "copies").select(F.col("doc_id").alias("_id"), "_th", "_copy")
    named = docs.join(told, (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_th")), "left")
    docs = named.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce("_copy", F.lit(0).cast("long")).alias("_copy"))
    return docs, own(docs).dropDuplicates(["doc", "copy"])


def _buckets(keyed: DataFrame) -> DataFrame:
    """key, size: the keys that two lines or more have, one of them in the index."""
    told = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("role").alias("r"), F.min("u").alias("lo"), F.max("u").alias("hi"))
    return told.where((F.col("r") == _INDEX) & (F.col("lo") < F.col("hi"))).select("key", "size")


def _met(texts: DataFrame, firsts: DataFrame, edits: int) -> DataFrame:
    """The first round: key, size, role, u, doc, copy, at, line, rest of the lines that share a key. firsts holds the keys; the texts of
    the few documents that are asked for are read again."""
    n_keys = len(firsts.schema["keys"].dataType.names)
    roles = [role for role in _roles(edits) for _ in _keys(F.lit(""), F.lit(0), role, edits)]
    u = F.xxhash64(*_OCC).alias("u")
    keyed = firsts.select(*_OCC, u, F.explode(F.array(*[F.struct(F.col(f"keys.k{j}").alias("key"), F.lit(roles[j]).alias("role"), F.lit(j).alias("j")) for j in range(n_keys)])).alias("e")).select(*_OCC, "u", "e.*").where("key is not null")
    ask = F.struct("at", "key", "size", "role", "j", "u")
    asked = staged(keyed.join(_buckets(keyed), "key").groupBy("doc", "copy").agg(F.collect_list(ask).alias("asked")), "asked")  # a list of a text's own lines
    if asked.count() <= BROADCAST_IDS:
        texts = texts.join(F.broadcast(asked.select("doc", "copy")), ["doc", "copy"], "left_semi")
    # one split a text, and each line once: exploding the places beside the lines would copy all lines to every place
    lines = F.transform(F.array(F.split("text", "\n")), lambda ls: F.transform("asked", lambda x: F.struct(x.alias("x"), F.get(ls, x["at"]).alias("line"))))
    found = texts.join(asked, ["doc", "copy"]).select("doc", "copy", F.explode(F.get(lines, F.lit(0))).alias("e")).select("doc", "copy", "e.x.*", "e.line")
    rest, j = F.lit(None).cast("string"), 0
    for role in _roles(edits):
        for _, left in _keys(F.col("line"), F.char_length("line"), role, edits):
            rest = F.when(F.col("j") == j, left).otherwise(rest)
            j += 1
    out = staged(found.withColumn("rest", rest).drop("j"), "lines")
    released(asked)
    return out


def _again(hot: DataFrame, edits: int) -> DataFrame:
    """Another round over what large buckets left of their lines."""
    n = F.char_length("rest")
    told = F.lit(None)
    for role in _roles(edits):
        made = F.array(*[F.struct(key.alias("key"), left.alias("rest")) for key, left in _keys(F.col("rest"), n, role, edits, F.col("key"))])
        told = F.when(F.col("role") == role, made).otherwise(told)
    keyed = hot.select("role", "u", *_OCC, "line", F.explode(told).alias("e")).select("role", "u", *_OCC, "line", "e.*").where("key is not null")
    return staged(keyed.join(_buckets(keyed), "key"), "lines")


def _links(met: DataFrame, edits: int) -> DataFrame:
    """a, b (doc, copy, at; a before b) of the lines within the edits among those that share a key."""
    side = lambda x: met.select("key", F.col("role").alias(f"r{x}"), F.struct(*_OCC).alias(x), F.col("line").alias(f"l{x}"))
    probes = (F.col("rb") != _INDEX) | (F.col("a") < F.col("b")) if edits == 1 else F.col("rb") != _INDEX
    pairs = side("a").where(F.col("ra") == _INDEX).join(side("b"), "key").where(probes & (F.col("a") != F.col("b")))
    near = F.get(F.transform(_trimmed(F.col("la"), F.col("lb")), lambda s: edit_distance_at_most(s["a"], s["b"], edits)), F.lit(0))
    return pairs.where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _plan(docs: DataFrame, edits: int, min_chars: int, exact_chars: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """doc_id, text, _others (a struct of the other columns) and _copy of docs; firsts: doc, copy, at of the first occurrences; links: a, b (doc, copy, at), each pair once. Only lines of
    min_chars are linked."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    docs, texts = _numbered(docs.select("doc_id", "text", F.struct(*others, F.lit(0).alias("_")).alias("_others")))  # so no name clashes
    lines = texts.select("doc", "copy", F.posexplode(F.split("text", "\n")).alias("at", "line")).where(_looked_at(F.col("line"), min_chars, exact_chars))
    n = F.char_length("line")
    keys = [F.when(n >= min_chars, key) for role in _roles(edits) for key, _ in _keys(F.col("line"), n, role, edits)]
    told = F.struct(*_OCC, F.struct(*[key.alias(f"k{j}") for j, key in enumerate(keys)]).alias("keys"))
    firsts = lines.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), told.alias("told")).groupBy("h1", "h2").agg(F.min("told").alias("told"))
    firsts = staged(firsts.select("told.*"), "firsts")
    met = _met(texts, firsts, edits)
    links = None
    while True:
        # texts that are shorter than the segments are many leave nothing to cut
        hot = (F.col("size") > SMALL) & (F.char_length("rest") - F.greatest("role", F.lit(0)) > edits)
        found = staged(_links(met.where(~hot), edits), "links")
        links = found if links is None else links.unionAll(found)
        large, done = met.where(hot), met
        last = large.isEmpty()
        if not last:
            met = _again(large, edits)
        released(done)
        if last:
            return docs, firsts.select(*_OCC), links.distinct()


def line_links(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """a, b: the first occurrences (doc, at) of each two different lines within `edits` edits, a before b; copy_a, copy_b: which
    of the texts of a doc_id that has several."""
    at = lambda x: F.struct(f"{x}.doc", f"{x}.at").alias(x)
    return _plan(docs, edits, min_chars)[2].select(at("a"), at("b"), F.col("a.copy").alias("copy_a"), F.col("b.copy").alias("copy_b"))


def line_dedup(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, exact_chars: int | None = None) -> DataFrame:
    """docs with `text` less its repeated lines, and with n_lines, n_exact, n_near, n_links.

    A line of at least min_chars characters goes when the same line or one within `edits` edits occurs earlier,
    by (doc_id, line number); shorter lines stay, but with exact_chars a line of as many characters that isn't blank
    goes too when the same line occurs earlier. n_exact counts lines gone as a repeat of the same line, n_near those gone
    for a similar earlier one alone, n_links the links that the document's first occurrences have. Rows that are equal in
    doc_id and text are one document and keep the same lines; different texts of one doc_id are documents of their own, in the order of a
    hash. A null text stays null, with zeros; a row of a null doc_id is left alone. All other columns stay; an empty table
    gives an empty one.
    """
    columns = docs.columns
    docs, firsts, links = _plan(docs, edits, min_chars, exact_chars)
    ends = F.explode(F.array(F.struct("a", F.lit(False).alias("lost")), F.struct(F.col("b").alias("a"), F.lit(True).alias("lost"))))
    linked = links.select(ends.alias("e")).select("e.a.*", "e.lost").groupBy(*_OCC).agg(F.max("lost").alias("lost"), F.count("*").alias("n"))
    told = firsts.join(linked, [*_OCC], "left").groupBy("doc", "copy").agg(F.collect_list("at").alias("_ats"), F.collect_list(F.when(F.col("lost"), F.col("at"))).alias("_lost"), F.sum("n").alias("_links"))
    told = told.withColumnsRenamed({"doc": "_doc", "copy": "_number"})
    known = docs.where("doc_id is not null").join(told, (F.col("doc_id") == F.col("_doc")) & (F.col("_copy") == F.col("_number")), "left")
    nameless = docs.where("doc_id is null")
    out = known.unionByName(nameless, allowMissingColumns=True).withColumn("_lines", F.split("text", "\n"))
    count = F.size("_lines")
    short = F.filter(F.sequence(F.lit(0), count - 1), lambda k: ~_looked_at(F.get("_lines", k), min_chars, exact_chars))
    nothing = F.array().cast("array<int>")
    out = out.withColumns({"_short": short, "_own": F.array_except(F.coalesce("_ats", nothing), F.coalesce("_lost", nothing))})
    out = out.withColumn("_stay", F.concat("_short", "_own"))
    rest = F.array_join(F.transform(F.array_sort("_stay"), lambda k: F.get("_lines", k)), "\n")
    known = F.col("doc_id").isNotNull() & F.col("text").isNotNull()
    zero = lambda x: F.when(known, F.coalesce(x, F.lit(0))).otherwise(0).cast("long")
    firsts_n = F.when(F.col("_ats").isNull(), 0).otherwise(F.size("_ats"))
    return out.select(
        *[F.when(known & (F.size("_stay") < count), rest).otherwise(F.col("text")).alias("text") if c == "text" else F.col("doc_id") if c == "doc_id" else F.col("_others")[c].alias(c) for c in columns],
        F.when(F.col("text").isNull(), 0).otherwise(count).cast("long").alias("n_lines"),
        zero(count - F.size("_short") - firsts_n).alias("n_exact"),
        zero(firsts_n - F.size("_own")).alias("n_near"),
        zero(F.col("_links")).alias("n_links"),
    )
