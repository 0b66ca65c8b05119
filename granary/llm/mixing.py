"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents, in the order of a digest, are cut into blocks of equal numbers of words. A source's quota of blocks is
its stretch of the cumulative weights. Slot t of the mix has the van der Corput point of t (its bits reversed) and takes a
block of the source in whose stretch the point falls: the k-th slot of a source takes its block k mod (number of blocks), so
all blocks are used before one is used again, and every stretch of the mix has the sources near their weights.

Which slot is the k-th of a source is counted, not looked up: the points of a stretch that end in given bits are an arithmetic
series, so the slot's bits follow one by one from the first. Documents so find their slots row by row, without a table of slots, a join
or a sort, for any number of sources and words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import n_words, running, staged, sub_bits

#: Words in a block, the least number of blocks in a source that has so many words, the weights in the order of sources.
BLOCK_WORDS, LEAST_BLOCKS, WEIGHTS = 1024, 256, (3, 1, 2)
#: Of all words the mix has so many times, and no source or document more than so many times its own.
SHARE, REPEATS = 1.5, 2.0
#: The plan of so many sources (about 10 MB) is broadcast; of more it is joined by a shuffle.
BROADCAST_SOURCES = 100_000


def _offsets(told: DataFrame, value: Column, name: str) -> DataFrame:
    """told (with _part and _row) with `name`: the sum of value over the rows before, in the order of _part and _row. One row a
    partition comes to the driver."""
    starts, at = [], 0
    for r in sorted(told.groupBy("_part").agg(F.sum(value).alias("k")).collect()):
        starts.append((r["_part"], at))
        at += r["k"]
    starts = told.sparkSession.createDataFrame(starts, "_at int, _start long")
    before = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    told = told.join(F.broadcast(starts), F.col("_part") == F.col("_at"))
    return told.withColumn(name, F.col("_start") + F.coalesce(F.sum(value).over(before), F.lit(0))).drop("_at", "_start")


def plan(sized: DataFrame, weights=WEIGHTS, block_words: int = BLOCK_WORDS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """A row a source, by code point, null last: source, number, source_size, target, blocks, quota, and its stretch lo to hi of
    the points. sized: source, size.

    A source's target is its weight's part of share * all words; it stops at repeats * its size, and the excess goes to the others
    by weight until none is above: the level (words a unit of weight) goes up as long as sources fill up below it, one
    aggregation a step.
    """
    told = sized.groupBy("source").agg(F.sum("size").alias("n")).orderBy(F.col("source").asc_nulls_last())
    told = staged(told.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "sources")
    told = _offsets(told, F.lit(1), "number")
    told = told.withColumn("_weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights)).cast("int")))
    most = F.col("n") * F.lit(float(repeats))
    level, full = 0.0, F.lit(False)
    while True:
        sums = told.agg(F.sum("n").alias("all"), F.sum(F.when(full, most).otherwise(0.0)).alias("given"), F.sum(F.when(full, 0.0).otherwise(F.col("_weight"))).alias("rest")).first()
        if not sums["rest"] or (share * sums["all"] - sums["given"]) / sums["rest"] <= level:
            break
        level = (share * sums["all"] - sums["given"]) / sums["rest"]
        full = F.lit(level) * F.col("_weight") > most
    told = told.withColumn("target", F.when(full, most).otherwise(F.lit(level) * F.col("_weight")))
    told = told.withColumn("blocks", F.greatest(F.lit(1), F.least("n", F.greatest(F.lit(LEAST_BLOCKS), F.ceil(F.col("n") / block_words)))).cast("long"))
    quota = F.least(F.floor(F.col("target") * F.col("blocks") / F.col("n") + 0.5), F.floor(F.col("blocks") * float(repeats))).cast("long")
    told = staged(told.withColumn("quota", F.when(F.col("n") > 0, quota).otherwise(0)), "quotas")
    out = _offsets(told, F.col("quota"), "lo")
    return out.select("source", "number", F.col("n").alias("source_size"), "target", "blocks", "quota", "lo", (F.col("lo") + F.col("quota")).alias("hi"))


def slot_of(k: Column, lo: Column, hi: Column, bits: int) -> Column:
    """The slot, of 2^bits, that is the k-th (from 0) of those whose points lie in lo to hi - 1.

    From the first bit of the slot, the last of the point: if more than k points of the stretch go on with 0, so does the
    slot; else it goes on with 1, and that many are passed over. `ends` are the point's bits known so far.
    """
    shift = lambda x, n: F.call_function("shiftright", x, n)
    up = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n)

    def step(s: Column, i: Column) -> Column:
        before = lambda x: shift(x - s["ends"] - 1, i + 1)  # noqa: E731  points below x that end in these bits and a 0, less one
        zeros = before(hi) - before(lo)
        return F.when(s["k"] < zeros, s).otherwise(F.struct((s["k"] - zeros).alias("k"), (s["ends"] + up(i)).alias("ends"), (s["slot"] + up(F.lit(bits - 1) - i)).alias("slot")))

    none = F.lit(0).cast("long")
    start = F.struct(k.cast("long").alias("k"), none.alias("ends"), none.alias("slot"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), start, step, lambda s: s["slot"]) if bits else none


_div = lambda x, y: F.call_function("div", x, y)


def block_start(b: Column, size: Column, blocks: Column) -> Column:
    """First word of block b: the first size % blocks blocks have one word more than the others."""
    return b * _div(size, blocks) + F.least(b, size % blocks)


def block_of(word: Column, size: Column, blocks: Column) -> Column:
    """The block in which a word (from 0) of the source lies."""
    each, more = _div(size, blocks), size % blocks
    return F.when(word < more * (each + 1), _div(word, each + 1)).otherwise(more + _div(word - more * (each + 1), each))


def _placed(docs: DataFrame, weights, block_words: int, share: float, repeats: float) -> tuple[DataFrame, int]:
    """docs (with _size and _h) with their places: _at (words of the source before), the columns of plan() in _s; and the bits of a slot."""
    light = docs.select("source", F.col("_size").alias("size"))
    told = staged(plan(light, weights, block_words, share, repeats), "mix")
    sums = told.agg(F.count("*").alias("k"), F.coalesce(F.max("hi"), F.lit(0)).alias("total")).first()
    bits = sub_bits(docs.count() // max(1, sums["k"]))
    about = told.select(F.col("source").alias("_source"), F.struct(*told.columns).alias("_s"))
    placed = running(docs, ["source"], "_h", F.col("_size"), "_at", bits, ["doc_id", "_size"])
    placed = placed.join(F.broadcast(about) if sums["k"] <= BROADCAST_SOURCES else about, F.col("source").eqNullSafe(F.col("_source")))
    return placed.drop("_source"), max(0, (int(sums["total"]) - 1).bit_length())


def _sized(docs: DataFrame) -> DataFrame:
    """The order within a source is that of the first 60 bits of the MD5 of doc_id, then of doc_id and size."""
    digest = F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 15), 16, 10).cast("long")
    return docs.withColumns({"_size": n_words(F.col("text")), "_h": F.coalesce(F.shiftleft(digest, 3), F.lit(0).cast("long"))})


def mix(docs: DataFrame, weights=WEIGHTS, block_words: int = BLOCK_WORDS, share: float = SHARE, repeats: float = REPEATS, carried: bool = True) -> DataFrame:
    """docs (doc_id, text, source and others) with size, source_size, target, taken, slot, and ranges.

    size is the text's number of words, 0 for a null. ranges lists (from, to, times): words of the text that the mix takes,
    with how often; taken is their sum. slot is the first slot of the mix that takes words of the text, null without any.
    Reruns agree: the order within a source is that of a digest of doc_id. A null source is a source of its own, the last.
    Without `carried` only doc_id and source come along. Rows that repeat are separate documents. An empty table gives none.
    """
    return _mix(docs, weights, block_words, share, repeats, carried)[0].drop("_place")


def _mix(docs: DataFrame, weights=WEIGHTS, block_words: int = BLOCK_WORDS, share: float = SHARE, repeats: float = REPEATS, carried: bool = True) -> tuple[DataFrame, int]:
    """What mix() gives, with _place (places in the source and its plan), and the bits of a slot."""
    keep = docs.columns
    sized = _sized(docs)
    if not carried:
        keep = ["doc_id", "source"]
        sized = staged(sized.select("doc_id", "source", "_size", "_h"), "sizes")
    placed, bits = _placed(sized, weights, block_words, share, repeats)
    s = lambda c: F.col(f"_s.{c}")
    more = F.when(s("source_size") > 0, s("quota") % s("blocks")).otherwise(0)  # so many blocks are taken once more than the others
    end, split = F.col("_at") + F.col("_size"), block_start(more, s("source_size"), s("blocks"))
    cut = F.when(s("source_size") > 0, F.least(F.greatest(split, F.col("_at")), end) - F.col("_at")).otherwise(0)
    times = _div(s("quota"), s("blocks"))
    part = lambda a, b, n: F.struct(a.cast("long").alias("from"), b.cast("long").alias("to"), n.cast("long").alias("times"))
    ranges = F.filter(F.array(part(F.lit(0), cut, times + 1), part(cut, F.col("_size"), times)), lambda r: (r["to"] > r["from"]) & (r["times"] > 0))
    out = placed.withColumn("_ranges", ranges)
    taken = F.aggregate("_ranges", F.lit(0).cast("long"), lambda acc, r: acc + (r["to"] - r["from"]) * r["times"])
    # the mix takes a text's first block first: blocks go into slots in their order
    slot = F.when(F.size("_ranges") > 0, slot_of(block_of(F.col("_at"), s("source_size"), s("blocks")), s("lo"), s("hi"), bits))
    own = ("size", "source_size", "target", "taken", "slot", "ranges", "_place")
    return out.select(*[F.col(f"`{c}`") for c in keep if c not in own], F.col("_size").alias("size"), s("source_size").alias("source_size"), s("target").alias("target"), taken.alias("taken"), slot.alias("slot"), F.col("_ranges").alias("ranges"), F.struct("_at", "_s").alias("_place")), bits


def _slot(word: Column, copy: Column, bits: int) -> Column:
    """The slot that takes word `word` of the text for the copy-th time (from 0)."""
    s = lambda c: F.col(f"_place._s.{c}")
    return slot_of(block_of(F.col("_place._at") + word, s("source_size"), s("blocks")) + copy * s("blocks"), s("lo"), s("hi"), bits)


def mix_pieces(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: slot, source_index, block, doc_id, start, length, copy; by slot and start it is the order of training. A piece is the words
    from `start` of a document that lie in the slot's block; copy counts from 0 how often the mix has taken them before."""
    out, bits = _mix(docs.select("doc_id", "text", "source"), **how)
    s = lambda c: F.col(f"_place._s.{c}")
    at = F.col("_place._at")
    rows = out.where(F.size("ranges") > 0).withColumn("_block", F.explode(F.sequence(block_of(at, s("source_size"), s("blocks")), block_of(at + F.col("size") - 1, s("source_size"), s("blocks")))))
    rows = rows.withColumn("copy", F.explode(F.filter(F.transform(F.sequence(F.lit(0), _div(s("quota") - 1, s("blocks")).cast("int")), lambda c: c.cast("long")), lambda c: F.col("_block") + c * s("blocks") < s("quota"))))
    first = F.greatest(block_start(F.col("_block"), s("source_size"), s("blocks")) - at, F.lit(0))
    last = F.least(block_start(F.col("_block") + 1, s("source_size"), s("blocks")) - at, F.col("size"))
    slot = slot_of(F.col("_block") + F.col("copy") * s("blocks"), s("lo"), s("hi"), bits)
    return rows.select(slot.alias("slot"), s("number").alias("source_index"), F.col("_block").alias("block"), "doc_id", first.alias("start"), (last - first).alias("length"), "copy")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """docs as the mix takes them, in its order: a document taken whole twice stands twice, each time at the slot that takes its first
    words; of one that is taken in part the words within are joined by one space. n_chars follows the text. Documents without
    words aren't in the mix. Partitions are stretches of the mix, one after another and each in order, so files written from them are the mix's order."""
    out, bits = _mix(docs, **how)
    times = F.flatten(F.transform("ranges", lambda r: F.transform(F.sequence(F.lit(1).cast("long"), r["times"]), lambda k: F.struct(r["from"].alias("from"), r["to"].alias("to"), k.alias("copy")))))
    # the two ranges of one document, taken in the same copy, are one text again
    copies = F.array_distinct(F.transform("_times", lambda t: t["copy"]))
    own = lambda k: F.filter("_times", lambda t: t["copy"] == k)
    row = lambda k: F.struct(k.alias("copy"), F.array_min(F.transform(own(k), lambda t: t["from"])).alias("from"), F.array_max(F.transform(own(k), lambda t: t["to"])).alias("to"))
    rows = out.withColumn("_times", times).withColumn("_row", F.explode(F.transform(copies, row)))
    slot = _slot(F.col("_row.from"), F.col("_row.copy") - 1, bits)
    words = F.slice(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)), (F.col("_row.from") + 1).cast("int"), (F.col("_row.to") - F.col("_row.from")).cast("int"))
    text = F.when((F.col("_row.from") == 0) & (F.col("_row.to") == F.col("size")), F.col("text")).otherwise(F.array_join(words, " "))
    named = {"text": F.col("_text").alias("text"), "n_chars": F.char_length("_text").cast("long").alias("n_chars")}
    rows = rows.select(*[F.col(f"`{c}`") for c in docs.columns], text.alias("_text"), slot.alias("_slot"), F.col("_place._at").alias("_from"))
    # slots hold equal numbers of words, so equal stretches of slots make even partitions, without a sample
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionById(n, F.floor(F.col("_slot") / F.lit(float(1 << bits)) * n).cast("int")).sortWithinPartitions("_slot", "_from")
    return rows.select(*[named.get(c, F.col(f"`{c}`")) for c in docs.columns])
