"""The Spark surface: tables, modes, volumes, functions, the data source, streams, and the path policy."""

import datetime
import string
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granary import functions, operators, sources, streaming
from granary.limits import Limits
from granary.paths import unsafe_reason
from granary.plans import authoring as write
from granary.plans import coded

MEMBERS = [("a/one.txt", b"hello " * 30), ("b.bin", bytes(range(256))), ("../up", b"x")]


def _files(spark, **named):
    return spark.createDataFrame([(k, v) for k, v in named.items()], "path string, content binary")


def test_passwords_by_archive(spark):
    """A column holds each archive's own password; a null one means none, and an archive that needs none ignores it."""
    rows = [("one", coded.zip_aes(MEMBERS, b"p1"), "p1"), ("two", coded.zip_traditional(MEMBERS, b"p2"), "p2"), ("wrong", coded.zip_aes(MEMBERS, b"p3"), "p4"), ("none", coded.zip_aes(MEMBERS, b"p5"), None), ("open", write.zip_archive(MEMBERS), "p6")]
    df = spark.createDataFrame(rows, "path string, content binary, pw string")
    got = {(r.path, r.name): bytes(r.content) for r in operators.contents(df, "zip", mode="PERMISSIVE", password="pw").where("error is null").collect()}
    assert got == {(p, n): b for p in ("one", "two", "open") for n, b in MEMBERS}
    told = {r.path: r.error.kind if r.error else None for r in operators.verify(df, "zip", password="pw").collect()}
    assert told == {"one": None, "two": None, "open": None, "wrong": "wrong_password_or_corrupt", "none": "password_required"}


def test_entries_contents_verify(spark):
    df = _files(spark, one=write.zip_archive(MEMBERS), two=write.zip_archive(MEMBERS[:1]))
    e = operators.entries(df, "zip")
    assert e.groupBy("path").count().orderBy("path").collect() == [("one", 3), ("two", 1)]
    assert [r.unsafe_path_reason for r in e.where("path = 'one'").orderBy("idx").collect()] == [None, None, "traversal"]
    c = {(r.path, r.name): bytes(r.content) for r in operators.contents(df, "zip").collect()}
    assert c == {("one", n): b for n, b in MEMBERS} | {("two", *MEMBERS[0][:1]): MEMBERS[0][1]}
    assert [r.name for r in operators.contents(df, "zip", idx=[1, 9]).collect()] == ["b.bin"]
    assert [(r.ok, r.members, r.output_bytes) for r in operators.verify(df, "zip").orderBy("path").collect()] == [(True, 3, 437), (True, 1, 180)]
    assert operators.archives(df, "zip").agg(F.sum("entries")).first()[0] == 4


def test_modes(spark):
    good = write.zip_archive(MEMBERS, zipfile.ZIP_STORED)
    bad = bytearray(good)
    bad[good.index(b"x", good.index(b"../up"))] ^= 1
    df = _files(spark, bad=bytes(bad), cut=good[:50], none=None)
    rows = {(r.path, r.name): r.error for r in operators.contents(df, "zip", mode="PERMISSIVE").collect()}
    assert rows[("bad", "a/one.txt")] is None and rows[("bad", None)].kind == "checksum" and rows[("bad", None)].member_index == 2
    assert rows[("cut", None)].kind == "format" and rows[("none", None)].kind == "format"
    assert operators.contents(df, "zip", mode="DROPMALFORMED").count() == 2
    with pytest.raises(Exception, match="bad|cut|none"):
        operators.contents(df, "zip").collect()
    with pytest.raises(ValueError):
        operators.contents(df, "zip", mode="OTHER")
    v = {r.path: (r.ok, r.error.kind) for r in operators.verify(df, "zip").collect()}
    assert v == {"bad": (False, "checksum"), "cut": (False, "format"), "none": (False, "format")}
    limited = operators.entries(df.where("path = 'bad'"), "zip", mode="PERMISSIVE", limits=Limits(max_files=1)).collect()
    assert [(r.error.kind, r.error.limit) for r in limited] == [("limit_exceeded", "max_files")]
    assert operators.entries(df.limit(0), "zip").count() == 0


def test_rpm_tags_without_a_name_keep_their_number(spark):
    tags = [("p", "main", i, t, "string", [], [t_.encode()]) for i, (t, t_) in enumerate([(1000, "pkg"), (1004, "sum"), (1098, "/usr"), (999999, "own")])] + [("p", "signature", 0, 4321, "int32", [7], [])]
    df = spark.createDataFrame(tags, "path string, section string, position int, tag long, value_type string, ints array<long>, bytes array<binary>")
    got = {(r.section, r.tag_name): (r.texts, r.ints) for r in functions.named_tags(df).collect()}
    assert got == {("main", "NAME"): (["pkg"], []), ("main", "SUMMARY"): (["sum"], []), ("main", "PREFIXES"): (["/usr"], []), ("main", "999999"): (["own"], []), ("signature", "4321"): ([], [7])}


def test_safe_paths_judges_whole_urls(spark, tmp_path):
    from granary.plans import queries

    urls = ["https://host/" + "a/" * 400 + "b", "https://host/" + "a/" * 400 + "../b", "https://host/" + "a/" * 400 + "b\0"]
    spark.createDataFrame([(5 * i + 3, u) for i, u in enumerate(urls)], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r.reason for r in queries.safe_paths(spark, str(tmp_path)).collect()}
    assert got == {3: None, 8: "traversal", 13: "nul"}


def test_package_tables(spark):
    rpm = _files(spark, p=write.rpm_archive("pkg", MEMBERS, "xz"))
    named = {r.tag_name: (r.texts, r.ints) for r in functions.named_tags(operators.rpm_tags(rpm)).where("section = 'main'").collect()}
    assert named["NAME"] == (["pkg"], []) and len(named["SIZE"][1]) == 1
    tags = functions.tag_map(operators.rpm_tags(rpm)).where("section = 'main'").first().tags
    assert bytes(tags[1000]["bytes"][0]) == b"pkg"
    deb = _files(spark, p=write.deb_archive(MEMBERS, "zstd"))
    assert [r.kind for r in operators.deb_members(deb).orderBy("idx").collect()] == ["version", "control", "data"]
    assert bytes(operators.deb_member_contents(deb).where("idx = 0").first().content) == b"2.0\n"
    assert [r.section for r in operators.entries(deb, "deb").orderBy("idx").collect()] == ["control", "data", "data", "data"]
    cpio = _files(spark, p=write.cpio_archive([("link", b"target")], mode=0o120777))
    assert bytes(operators.symlink_targets(cpio).first().content) == b"target"
    seven = _files(spark, p=write.sevenzip_archive(MEMBERS))
    assert operators.folders_7z(seven).first().coders[0].method == "lzma2" and operators.pack_streams_7z(seven).count() == 1
    view = operators.members(deb=operators.entries(deb, "deb"), sevenz=operators.entries(seven, "7z"), zip=operators.entries(_files(spark, z=write.zip_archive(MEMBERS)), "zip"))
    assert sorted((r.format, r["count"]) for r in view.groupBy("format").count().collect()) == [("7z", 3), ("deb", 4), ("zip", 3)]


def test_volumes(spark):
    data = write.sevenzip_archive(MEMBERS)
    parts = {f"x.7z.{k + 1:03d}": data[k * 60 : (k + 1) * 60] for k in range(-(-len(data) // 60))}
    whole = operators.assemble_volumes(_files(spark, **parts, single=b"s"))
    assert {r.path: (bytes(r.content), r.volumes) for r in whole.collect()} == {"x.7z": (data, len(parts)), "single": (b"s", 1)}
    del parts["x.7z.002"]
    rows = operators.entries(operators.assemble_volumes(_files(spark, **parts)), "7z", mode="PERMISSIVE").collect()
    assert [(r.error.kind, r.error.expected) for r in rows] == [("missing_volume", "x.7z.002")]


def test_sql_functions(spark):
    functions.register(spark)
    text = b"hello unix compress\n" * 50
    _files(spark, z=write.zip_archive(MEMBERS)).createOrReplaceTempView("zips")
    _files(spark, s=write.z_stream(text)).createOrReplaceTempView("streams")
    got = spark.sql("SELECT e.name, e.size FROM zips, LATERAL archive_entries(content, 'zip') e ORDER BY e.idx").collect()
    assert [(r.name, r.size) for r in got] == [(n, len(b)) for n, b in MEMBERS]
    assert spark.sql("SELECT sum(c.size) FROM zips, LATERAL archive_contents(content, 'zip') c").first()[0] == 437
    assert spark.sql("SELECT v.ok, v.error_kind FROM streams, LATERAL archive_verify(content, 'zip') v").first() == (False, "format")
    assert bytes(spark.sql("SELECT unpack_stream(content) FROM streams").first()[0]) == text
    assert spark.sql("SELECT stream_format(content) FROM streams").first()[0] == "unix_compress"
    assert bytes(spark.sql("SELECT archive_extract(content, 'zip', 1) FROM zips").first()[0]) == MEMBERS[1][1]


def test_sources_and_streams(spark, tmp_path):
    sources.register(spark)
    for k in range(3):
        (tmp_path / f"{k}.zip").write_bytes(write.zip_archive(MEMBERS[: k + 1]))
    (tmp_path / "note.txt").write_bytes(b"x")
    assert operators.entries(sources.read_archives(spark, str(tmp_path), "*.zip"), "zip").count() == 6
    (tmp_path / "note.txt").unlink()
    read = lambda t: spark.read.format("granary").option("format", "zip").option("table", t).load(str(tmp_path))
    assert read("entries").count() == 6 and read("archives").count() == 3
    assert sorted(bytes(r.content) for r in read("contents").where("idx = 1").collect()) == [MEMBERS[1][1]] * 2
    files = streaming.stream_archives(spark, str(tmp_path), "*.zip")
    q = streaming.stream_table(files, "contents", "zip").writeStream.format("memory").queryName("got").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("got").count() == 6


def test_stream_tables(spark):
    df = _files(spark, a=write.z_stream(b"abc" * 99))
    assert operators.stream_info(df).first().maximum_code_bits == 16
    r = operators.unpack_streams(df).first()
    assert (r.format, r.size, r.frames_decoded, r.checksums_verified) == ("unix_compress", 297, 1, 0)


def test_columns(spark):
    row = spark.range(1).select(
        functions.filetime_timestamp(F.lit("132000000000000000").cast("decimal(20,0)")).alias("t"),
        functions.filetime_timestamp(F.lit("18446744073709551615").cast("decimal(20,0)")).alias("far"),
        functions.dos_timestamp(F.lit((40 << 9) | (2 << 5) | 29), F.lit((12 << 11) | (30 << 5) | 5)).alias("d"),
        functions.dos_timestamp(F.lit((41 << 9) | (2 << 5) | 31), F.lit(0)).alias("no"),
        functions.unix_mode_7z(F.lit(0o100644 << 16 | 0x8000).cast("long")).alias("m"),
        functions.cpio_kind(F.lit(0o120777)).alias("k"),
    ).first()
    assert row.t == datetime.datetime(2019, 4, 17, 18, 40) and row.far is None
    assert row.d == datetime.datetime(2020, 2, 29, 12, 30, 10) and row.no is None
    assert (row.m, row.k) == (0o100644, "symlink")


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="/\\.:aZ\0\né" + string.digits, max_size=8), min_size=1, max_size=40))
def test_path_policy_column_is_the_function(spark, names):
    df = spark.createDataFrame([(n,) for n in [*names, "", None, "..", "a/..", "..a/b", "C:x", "//h/s"]], "name string")
    for r in df.select("name", functions.unsafe_path_reason(df.name).alias("got")).collect():
        assert r.got == unsafe_reason(r.name)


def test_whatever_a_reader_trips_over_is_a_typed_row(spark):
    from granary import schemas
    from granary.operators import tables

    def rows(content, ctx):
        yield {"ok": True, "members": 1, "output_bytes": 0}
        if content == b"bad":
            [][1]

    df = _files(spark, good=b"good", bad=b"bad")
    out = tables._table(df, rows, schemas.VERIFY, "PERMISSIVE", None, 1000, None).collect()
    assert {(r.path, r.error and r.error.kind) for r in out} == {("bad", "internal"), ("bad", None), ("good", None)}
    assert tables._table(df, rows, schemas.VERIFY, "DROPMALFORMED", None, 1000, None).count() == 2
