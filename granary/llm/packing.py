"""Packing of token sequences by cutting-stock column generation.

Documents longer than a sequence give whole sequences and a rest. The rests' lengths, in classes of a few tokens, make a
cutting-stock problem: a linear program over patterns (how many pieces of each class fill a sequence) whose columns are
priced by a knapsack dynamic program. Rounded patterns are then dealt to the pieces by their ranks within the class.
The program has one row a class, so the driver's part has the same size for any corpus.
"""

from __future__ import annotations

import functools
import os
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import mapped, running, staged, sub_bits

#: Tokens of a sequence, tokens of a length class, id that ends a document.
TOKENS, GRAIN, END = 2048, 8, 1
#: Tokenized words kept in memory by a Python worker (about 120 MB), and words that are tokenized at once.
CACHE, AT_ONCE = 600_000, 8192


def knapsack(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best value of a multiset of items whose sizes (item i: i + 1) fit, and its counts."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        n = min(c, len(values))
        got = values[:n] + best[c - 1 :: -1][:n] if c > 1 else values[:1] + best[0]
        i = int(got.argmax())
        best[c], pick[c] = (got[i], i) if got[i] > best[c - 1] else (best[c - 1], -1)
    counts, c = np.zeros(len(values), int), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            counts[pick[c]] += 1
            c -= pick[c] + 1
    return float(best[capacity]), counts


def patterns(demand: np.ndarray, capacity: int, rounds: int = 4000) -> list[tuple[int, np.ndarray]]:
    """(times, counts by size - 1) that cover the demand exactly: demand[i] pieces of size i + 1.

    The linear program's columns are generated till no pattern has a value above 1 at the current prices (or
    for `rounds` rounds); its solution is rounded down, and the few pieces left go into sequences by best fit.
    """
    demand = demand.astype(int).copy()
    sizes = np.flatnonzero(demand)
    out: list[tuple[int, np.ndarray]] = []
    if not len(sizes):
        return out
    m = len(sizes)
    columns = np.zeros((m, m))
    columns[np.arange(m), np.arange(m)] = capacity // (sizes + 1)
    inverse = np.diag(1.0 / columns.diagonal())
    x = inverse @ demand[sizes]
    for _ in range(rounds):
        price = inverse.sum(0)
        values = np.zeros(sizes[-1] + 1)
        values[sizes] = np.maximum(price, 0)
        value, counts = knapsack(values, capacity)
        if value <= 1 + 1e-9:
            break
        column = counts[sizes].astype(float)
        step = inverse @ column
        up = step > 1e-10
        ratio = np.full(m, np.inf)
        ratio[up] = x[up] / step[up]
        k = int(ratio.argmin())
        x -= ratio[k] * step
        x[k] = ratio[k]
        x[x < 0] = 0
        row = inverse[k] / step[k]
        inverse -= np.outer(step, row)
        inverse[k] = row
        columns[:, k] = column
    for k in np.argsort(-x, kind="stable"):
        counts = np.zeros(len(demand), int)
        counts[sizes] = columns[:, k].round().astype(int)
        used = counts > 0
        times = int(min(np.floor(x[k] + 1e-9), (demand[used] // counts[used]).min()))
        if times > 0:
            out.append((times, counts))
            demand -= times * counts
    while demand.any():  # best fit of what rounding left: the fullest sequence that the largest piece allows
        left, counts = capacity, np.zeros(len(demand), int)
        for i in range(len(demand) - 1, -1, -1):
            while demand[i] and i + 1 <= left:
                take = min(int(demand[i]), left // (i + 1))
                counts[i] += take
                demand[i] -= take
                left -= take * (i + 1)
        out.append((1, counts))
    return out


#: Characters of which lower case, composition and letter classes mean the same here and in the tokenizer: ASCII, and Latin
#: letters that are one code point, without the dotted capital I.
_ODD = re.compile("[^\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f\u2018\u2019\u201c\u201d\u2013\u2014\u2026]")
#: The tokenizer's words within such text: endings after an apostrophe, runs of letters, digits one by one, runs of the rest.
_WORDS = re.compile(r"[^\W\d_]+|\d|'s|'t|'re|'ve|'m|'ll|'d|(?:[^\s\w]|_)+")


class Encoder:
    """Ids of texts as little-endian 32-bit bytes, the same as the tokenizer's.

    Tokens don't cross words, so each word is tokenized once and remembered, up to a bound. New words are tokenized as one text, and
    its ids are cut where a token ends a word. Texts with characters whose words this
    module can't tell, or with the start of a special token, are cut at white space alone, at which the tokenizer
    always cuts.
    """

    def __init__(self, file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.file, self.known = file, {}
        # the same model for what is a lower-case word already
        self.plain = Tokenizer.from_file(file)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.plain.get_vocab(with_added_tokens=False)
        suffix = getattr(self.plain.model, "end_of_word_suffix", None)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool) if suffix else None
        if suffix:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    @functools.cached_property
    def tokenizer(self):
        """The file's tokenizer itself, for texts that are not made of plain words."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.file)

    def learn(self, words: list[str], cut: bool) -> None:
        """Remembers the ids of words; with `cut` each is a single word to the tokenizer."""
        for at in range(0, len(words), AT_ONCE):
            part = words[at : at + AT_ONCE]
            if cut and self.ends is not None:
                ids = np.array(self.plain.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
                ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
                if len(ends) == len(part):
                    raw, ends = ids.tobytes(), ends.tolist()
                    self.known.update(zip(part, [raw[a:b] for a, b in zip([0, *ends], ends)]))
                    continue
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self.known[w] = np.array(e.ids, "<u4").tobytes()

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        split, words, chunks = [], set(), set()
        for t in texts:
            odd = t and (_ODD.search(t) or "<|" in t)
            split.append((t.translate(SPACES).split(" ") if odd else _WORDS.findall(t.lower())) if t else [])
            (chunks if odd else words).update(split[-1])
        if len(self.known) + len(words) + len(chunks) > CACHE:
            self.known = {}
        self.learn(list(words.difference(self.known)), True)
        self.learn(list(chunks.difference(self.known)), False)
        find = self.known.__getitem__
        return [b"".join(map(find, words)) for words in split]


@functools.cache
def encoder(file: str) -> Encoder:
    """One encoder for a Python worker, whose tasks share what it remembers."""
    return Encoder(file)


def pieces(docs: DataFrame, tokenizer_file: str, tokens: int = TOKENS, end: int = END, in_order: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, rid: the documents' tokens and the end id, cut every `tokens` ids. With
    in_order also file and row, the place in the files that docs was read from."""
    place = ["file", "row"] if in_order else []
    docs = docs.select("doc_id", "text", *([F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")] if in_order else []))

    def start():
        ids_of, ended = encoder(tokenizer_file), np.array([end], "<u4").tobytes()

        def run(rows: dict[str, list]) -> dict[str, list]:
            out = {c: [] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", *place)}
            for doc_id, ids, *at in zip(rows["doc_id"], ids_of(rows["text"]), *[rows[c] for c in place]):
                ids += ended
                total = len(ids) // 4
                for a in range(0, total, tokens):
                    part = ids[4 * a : 4 * (a + tokens)]
                    for c, v in zip(out, (doc_id, a, len(part) // 4, zlib.crc32(part), total, *at)):
                        out[c].append(v)
            return out

        return run

    cut = mapped(docs, start, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", file string, row long" if in_order else ""), rows=64)
    return cut.withColumn("rid", F.monotonically_increasing_id())


#: The white space at which words are separated; other white space is left to the tokenizer.
SPACES = {c: " " for c in (9, 10, 11, 12, 13)}


def pack(docs: DataFrame, tokenizer_file: str, tokens: int = TOKENS, grain: int = GRAIN, end: int = END, in_order: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece of docs (doc_id, text).

    Each id of a document, the end id included, lies in one piece; the pieces of a sequence fill it from 0 without gaps and
    have at most `tokens` ids. sequence_id counts from 0 without gaps. A null text is empty: the end id alone. Rows that repeat
    are packed each for itself. An empty table gives none. The pieces of a length class go into sequences in the order of a
    hash; with in_order, which needs docs to be read from files, in the order of the files' names and rows.
    """
    spark = docs.sparkSession
    cut = staged(pieces(docs, tokenizer_file, tokens, end, in_order), "pieces")
    cut = cut.withColumns({"class": F.floor((F.col("length") + (grain - 1)) / grain).cast("int"), "_h": F.xxhash64("rid")})
    told = {r["class"]: r["n"] for r in cut.groupBy("class").agg(F.count("*").alias("n")).collect()}  # at most tokens / grain rows
    capacity = tokens // grain
    demand = np.array([told.get(i + 1, 0) for i in range(capacity)])
    full, demand[-1] = int(demand[-1]), 0
    plan = patterns(demand, capacity)
    if full:
        one = np.zeros(capacity, int)
        one[-1] = 1
        plan.insert(0, (full, one))
    rows, done, sequence = [], np.zeros(capacity, int), 0
    for times, counts in plan:
        for i in np.flatnonzero(counts):
            each = int(counts[i])
            rows.append((int(i) + 1, int(done[i]), int(done[i]) + each * times, each, sequence))
            done[i] += each * times
        sequence += times
    # as many rows as the patterns have classes: a bound that the vocabulary of classes sets, not the corpus
    deal = F.broadcast(spark.createDataFrame(rows, "_c int, _lo long, _hi long, _each long, _first long"))
    if in_order:
        ranked = running(cut, ["class"], "row", F.lit(1), "_rank", 0, ["start"], F.col("file"))
    else:
        ranked = running(cut, ["class"], "_h", F.lit(1), "_rank", sub_bits(cut.count(), 400_000), ["rid"])
    met = ranked.join(deal, (F.col("class") == F.col("_c")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    placed = met.withColumn("sequence_id", F.col("_first") + F.floor((F.col("_rank") - F.col("_lo")) / F.col("_each")).cast("long"))
    within = Window.partitionBy("sequence_id").orderBy(F.col("class").desc(), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(within), F.lit(0)).alias("offset")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset)
