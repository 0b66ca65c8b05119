"""Sharding, HTML text, secrets, media."""

import hashlib
import itertools
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import htmltext, media, secrets, sharding

DOCS = "doc_id long, text string, shard string, slot string"
TEXTS = [None, "", "a", "é" * 100, "a", "x" * 5000, "line\nline"]


def _docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "s", "p") for i, t in zip(ids or range(len(texts)), texts)], DOCS)


def test_shards(spark):
    texts = [TEXTS[i % len(TEXTS)] for i in range(600)]
    rows = sharding.sharded(_docs(spark, texts, [None if i % 50 == 0 else i % 500 for i in range(600)]), [1.0] * 24).collect()
    assert len(rows) == 600
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 24)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert len({(r.doc_id, r.shard) for r in rows}) == len({r.doc_id for r in rows})
    sizes = {(r.doc_id, r.size, r.text_crc32) for r in rows}
    assert sizes == {(None if i % 50 == 0 else i % 500, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in enumerate(texts)}
    assert sharding.sharded(_docs(spark, ["x"]).limit(0), [1.0]).count() == 0


def test_many_equal_rows_leave_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 100)
    df = spark.range(20_000).selectExpr("if(id % 2 = 0, null, id % 10) as doc_id", "'same' as text")
    out = sharding.sharded(df, [1.0] * 4)
    rows = out.withColumn("task", F.spark_partition_id()).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == 20_000 and all(sorted(s) == list(range(len(s))) for s in by.values())
    own = [r.task for r in rows if r.doc_id is None]
    assert len(own) == 10_000 and len(set(own)) > 1


def test_shards_follow_weights_and_move_little(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "'t' as text")
    rows = sharding.sharded(df, [1.0, 3.0, 2.0], 2.0).collect()
    n = [sum(r.shard == k for r in rows) for k in range(3)]
    assert max(abs(x / 20_000 - w / 6) for x, w in zip(n, (1, 3, 2))) < 0.02
    assert abs(sum(r.grown_shard == 3 for r in rows) / 20_000 - 2 / 8) < 0.02
    with pytest.raises(ValueError):
        sharding.shard_of(df.doc_id, [1.0, 0.0])


def test_minimum_cut_matches_all_labellings():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 8)
        u = [rng.uniform(-2, 2) for _ in range(n)]
        e = [(i, j, rng.random()) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]

        def cost(y):
            return sum((u[i] >= 0) != y[i] and abs(u[i]) for i in range(n)) + sum(w for i, j, w in e if y[i] != y[j])

        assert abs(cost(htmltext.minimum_cut(u, e)) - min(map(cost, itertools.product((True, False), repeat=n)))) < 1e-9


PAGE = """<!DOCTYPE html><html><head><title>No title</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu one</a><li><a href="/b">Menu two</a></ul></nav><div class="cookie-notice">We use cookies on this site, please accept them.</div>
<article><h1>The  title</h1><p>First &amp; <b>bold</b> text,<br>with a break.<p>Second paragraph is here&nbsp;too.</p><!-- <p>comment</p> -->
<div class="ad">Buy this thing now.</div><form><p>Your name please.</p></form><section id="comments"><p>Great article, I liked it very much indeed.</p></section></article>
<aside><p>Related stories you may like.</p></aside><footer>&copy; 2020 Site.</footer></body></html>"""


def test_html_text(spark):
    want = "The title\nFirst & bold text, with a break.\nSecond paragraph is here too."
    pages = [PAGE, None, "", "<p>", "plain text that has no markup at all, but is long enough to be one.", "<article><p>" + "very long words " * 20000]
    df = spark.createDataFrame([(i, f"u{i}", p, "x") for i, p in enumerate(pages)], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in htmltext.extract(df).collect()}
    assert got[0].text == want and got[0].n_chars == len(want)
    assert [got[i].text for i in (1, 2, 3)] == ["", "", ""]
    assert got[5].text == ("very long words " * 20000).strip()
    assert htmltext.extract(df.limit(0)).count() == 0


BASE = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def _base(text):
    out = [(m.start(), 0, m.end()) for m in BASE.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


CODE = """base = "AKz9-"
private_key = base + 'q8T!x' + "77zz"
db_pwd: str = "hunter2$Long"
other = "hello world"
greeting = "AKz9-q8T!x77zz"
"apiKey": "abcdEFGH1234"
api_key = "changeme-changeme"
if token == "abc": pass
"""


def test_elements_without_an_end_and_nested_ones():
    told = "This is a long sentence of the article that has to stay in the text of the page."
    for tag in ("button", "select", "svg", "math", "object", "audio", "video", "canvas", "template"):
        page = f"<html><body><div><{tag}></div><article><p>{told}</p><p>{told}</p></article></body></html>"
        assert htmltext.main_text(page) == f"{told}\n{told}", tag
    for tag in ("svg", "object"):
        page = f"<article><p>{told}</p><{tag}><{tag}>in</{tag}><p>Hidden words that are no part of the article.</p></{tag}><p>{told}</p></article>"
        assert htmltext.main_text(page) == f"{told}\n{told}", tag
    page = f"<article><h2><button>How does it work?</button></h2><p>{told} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p></article>"
    assert htmltext.main_text(page) == f"How does it work?\n{told} x=2 holds."
    assert htmltext.main_text(f"<article><p>{told}</p></article><script>let a = '{told}'") == told


def test_secret_spans(spark):
    rng = random.Random(2)
    parts = ["password", "ToKen", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGHIJKLMNOPQ", "0123456789abcdef", "é", "\n", "secret_key", "xyz123-_/+", "ſecret", "apikey", "Key"]
    texts = [None, "", CODE, "a" * 100_000] + ["".join(rng.choice(parts) for _ in range(40)) for _ in range(200)]
    got = {r.doc_id: r for r in secrets.secrets(_docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        told = _base(t or "")
        assert got[i].base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert set(filter(None, told.split(","))) <= set(got[i].spans.split(","))
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [told.count(k) for k in ("assign", "access", "hex")]
    lexed = {CODE[int(a) : int(b)] for k, a, b in (s.split(":") for s in got[2].spans.split(",")) if k == "lexed"}
    assert lexed == {"AKz9-", "q8T!x", "77zz", "hunter2$Long"}


@pytest.mark.parametrize(
    "text, want",
    [
        ('os.environ["CLIENT_SIGNING_KEY"] = "q8T!x77zzAKz9"', ["q8T!x77zzAKz9"]),
        ("config['client_secret']='q8T!x77zzAKz9'", ["q8T!x77zzAKz9"]),
        ('names["a"] = "q8T!x77zzAKz9"', []),
        ('signing_key =\n    "q8T!x77zzAKz9"\nother = 1', ["q8T!x77zzAKz9"]),
        ('"signing_key":\r\n  "q8T!x77zzAKz9"', ["q8T!x77zzAKz9"]),
        ('signing_key:\n  "q8T!x77zzAKz9": 1', []),
        ('signing_key = (\n    "q8T!x77"\n    "zzAKz9"\n)\nother = "zzzQ8T!x77"', ["q8T!x77", "zzAKz9"]),
        ('signing_key = "q8T!x77" +\n  "zzAKz9"', ["q8T!x77", "zzAKz9"]),
        ('signing_key = "q8T!x77"\n  + "zzAKz9"', ["q8T!x77", "zzAKz9"]),
        ('signing_key = "q8T!x77" \\\n  + "zzAKz9"', ["q8T!x77", "zzAKz9"]),
        ('signing_key = ("q8T!x77") + ("zz")\nsigning_key = (("q8T!x77") + "zzAKz9")', ["q8T!x77", "zzAKz9"]),
        ('signing_key = \\\n  "q8T!x77zzAKz9"', ["q8T!x77zzAKz9"]),
        ('signing_keys = ["q8T!x77zzAKz9", "none"]\nsigning_key = [\n "zz8T!x77zzAK"]', ["zz8T!x77zzAK"]),
        ('signing_key = "q8Ttrue!x77<none"', ["q8Ttrue!x77<none"]),
        ('signing_key = "yourQ8T!x77password"', ["yourQ8T!x77password"]),
        ("signing_key = b'q8T!x77zzAKz9'", ["q8T!x77zzAKz9"]),
        ('signing_key = rb"""q8T!x77zzAKz9"""\nother = 1', ["q8T!x77zzAKz9"]),
        ('signing_key = """\nq8T!x77zzAKz9\n"""', ["\nq8T!x77zzAKz9\n"]),
        ('signing_key = "q8T!\\x7877zzAKz9"', ["q8T!\\x7877zzAKz9"]),
        ("signing_key: |\n  q8T!x77zzAKz9\nother: zzz8T!x77zzAK", ["q8T!x77zzAKz9"]),
        ("signing_key: >-\n  q8T!x77z\n  zAKz9q8T\nother: 1", ["q8T!x77z", "zAKz9q8T"]),
        ('a = ""\nsigning_key = a + "" + "q8T!x77zzAKz9"', ["q8T!x77zzAKz9"]),
        ('signing_key = "your-signing-key-9"\nsigning_key = "<SIGNING-key-9>"\nsigning_key = "Password-None"', []),
    ],
)
def test_lexed_values(text, want):
    assert [text[a:b] for a, k, b in secrets.scan(text) if k == 3] == want


@pytest.mark.parametrize("n", [10, 1000, 4087, 4088, 5000, 60_000])
def test_one_rule_for_values_of_any_length(n):
    rng = random.Random(n)
    text = f'a = "{"".join(rng.choices("ghijkLMNOP246+", k=n))}"\nsigning_key = a + "q8T!x77zz"\n'
    assert [b - a for a, k, b in secrets.scan(text) if k == 3] == [n, 9]
    text = f'a = "{"g" * n * 9}"\nsigning_key = a + "q8T!x77zz" + "hello"\n'
    assert [text[a:b] for a, k, b in secrets.scan(text) if k == 3] == ["q8T!x77zz"]
    text = f'x["{"a" * n}_SIGNING_KEY"] = "q8T!x77zz"\n'
    assert [text[a:b] for a, k, b in secrets.scan(text) if k == 3] == ["q8T!x77zz"]
    lines = [f"{rng.getrandbits(256):064X}"[:40] + "+z" for _ in range(-(-n // 42))]
    text = "private_key: |\n  ---- BEGIN KEY ----\n" + "".join(f"  {x}\n" for x in lines) + "  ---- END KEY ----\n"
    assert [text[a:b] for a, k, b in secrets.scan(text) if k == 3] == lines


def test_joined_facts_tell_what_the_joined_text_does():
    rng = random.Random(5)
    bits = ["change", "me", "exam", "ple", "<", ">", "your", "you", "r", "-", "pass", "word", "_", " ", "\u212aey", "\u017fecret", "\u0130", "ap\u0131", "tru", "E", "none", "nul", "l", "xx", "q8T", "${", "*", "**", "placeholder", "\u03a3", "m", "y", "todo", "A1b2C3d4"]
    held = [(secrets.Value(x, (0, len(x))), x) for x in bits]
    above = 0
    for k in range(30_000):
        parts = [rng.choice(held if k % 2 else held[: len(bits)]) for _ in range(rng.randrange(2, 7))]
        value, text = secrets.Value(parts=tuple(v for v, _ in parts)), "".join(x for _, x in parts)
        want = secrets.literal_score(text)
        assert abs(value.score() - want) < 1e-12, text
        above += want > 0
        if len(text) < 6000 and k % 100 == 0:
            held.append((value, text))
    assert 5000 < above < 25_000
    value = secrets.Value("q8T!x77z", (0, 8))
    want = value.score()
    for _ in range(5000):
        value = secrets.Value(parts=(value, value))
    assert abs(value.score() - want) < 1e-12


def test_names_that_refer_to_themselves_cost_a_reference():
    import time
    import tracemalloc

    tracemalloc.start()
    began = time.time()
    for line in ("token = token + token\n", 'token = token + ""\n', 'token = "" + token + "q8T!x77z"\n', "a_token = token\n"):
        spans = secrets.scan('token = "abcdefgh"\n' + line * 3000)
        assert len(spans) <= 4000
    assert time.time() - began < 30 and tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


def _png(rows, width, colour, filters):
    body = b"".join(bytes([f]) + r for f, r in zip(filters, rows))
    head = struct.pack(">IIBBBBB", width, len(rows), 8, colour, 0, 0, 0)
    return media.SIGNATURE + media._chunk(b"IHDR", head) + media._chunk(b"tEXt", b"x") + media._chunk(b"IDAT", zlib.compress(body)) + media._chunk(b"IEND", b"")


@pytest.mark.parametrize("colour", [0, 2, 4, 6])
def test_png_filters_undone(colour):
    rng = np.random.default_rng(colour)
    step, width, height = media.SAMPLES[colour], 5, 12
    x = rng.integers(0, 256, (height, width * step)).astype(int)
    filters, rows = [k % 5 for k in range(height)], []
    for i in range(height):
        up = x[i - 1] if i else np.zeros_like(x[0])
        out = []
        for j in range(width * step):
            a, b, c = (x[i][j - step] if j >= step else 0), up[j], (up[j - step] if j >= step else 0)
            p = a + b - c
            guess = [0, a, b, (a + b) // 2, min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]][filters[i]]
            out.append((x[i][j] - guess) % 256)
        rows.append(bytes(out))
    assert (media.decode_png(_png(rows, width, colour, filters)) == x).all()


def test_png_damage_is_seen():
    good = media.encode_png(np.arange(640, dtype=np.uint8).reshape(10, 64))
    assert (media.decode_png(good) == np.arange(640, dtype=np.uint8).reshape(10, 64)).all()
    for i in range(0, len(good)):
        with pytest.raises(media.MediaError):
            media.decode_png(good[:i] + bytes([good[i] ^ 1]) + good[i + 1 :])
        with pytest.raises(media.MediaError):
            media.decode_png(good[:i])


def test_media_round_trip(spark):
    texts = [*TEXTS, "y" * 64, "z" * 65, "é\0\0"]
    got = {r.doc_id: r for r in media.media_features(media.to_media(_docs(spark, texts))).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        whole = data + bytes(-len(data) % 64 if data else 64)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(data), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]))
        assert len(got[i].feature) == 16
    assert (got[2].media_sha256, got[2].feature) == (got[4].media_sha256, got[4].feature)
    assert media.media_features(media.to_media(_docs(spark, ["x"]).limit(0))).count() == 0


def test_pages_match_all_labellings():
    """Whole generated pages: the labels are those of least cost among all, and the cut is right more often than each block's own costs."""
    rng, weights = random.Random(7), htmltext.classifier()
    wrong = own = flipped = tried = 0
    for _ in range(400):
        page, content = htmltext.example(rng)
        found = htmltext.blocks(page)
        u, e = htmltext.log_odds(found, weights), htmltext.edges(found)
        got = htmltext.labels(found, weights)
        text = [b.text for b, k in zip(found, got) if k]
        assert htmltext.main_text(page).split("\n") == (text or [""])
        wrong += sum((b.text in content) != k for b, k in zip(found, got))
        own += sum((b.text in content) != (x >= 0) for b, x in zip(found, u))
        flipped += sum((x >= 0) != k for x, k in zip(u, got))
        if len(found) <= 12:
            tried += 1

            def cost(y):
                return sum(abs(x) for x, k in zip(u, y) if (x >= 0) != k) + sum(w for i, j, w in e if y[i] != y[j])

            assert abs(cost(got) - min(map(cost, itertools.product((True, False), repeat=len(found))))) < 1e-9
    assert tried >= 20 and flipped >= 100 and wrong < 0.85 * own


def test_cut_and_hostile_pages_are_linear():
    import time

    began = time.time()
    for part in ("<a ", "<!", "</", "<!--", '<p class="', "<svg>", "<a '\"", "<script>", '"x" ', "<button>"):
        htmltext.main_text("<p>text stays</p><a " + part * 40_000)
        htmltext.main_text(part * 40_000)
    assert time.time() - began < 20
    told = "A sentence of the article that is long enough to be read as such."
    assert htmltext.main_text(f"<article><p>{told}</p><p>{told}<a " + '"x" ' * 20) == f"{told}\n{told}"


def test_names_of_the_page_are_no_boilerplate():
    told = "A sentence of the article that is long enough to be read as such. " * 6
    want = f"The title of it\n{told.strip()}"
    for start, end in (('<div class="blog-search">', "</div>"), ('<div class="main-menu-open page"><article>', "</article></div>"), ('<div class="has-sidebar">', "</div>"), ('<div class="page-header layout"><main>', "</main></div>")):
        page = f'<body><nav><a href="/">Home</a></nav>{start}<h1>The title of it</h1><p>{told}</p>{end}<div class="sidebar"><p>Other stories of the day.</p></div></body>'
        assert htmltext.main_text(page) == want, start
