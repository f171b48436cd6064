"""Record files, layouts and index text."""

import os

import pytest

from seqmine.functions.bits import SYNC_HEX
from seqmine.operators import classify as cl
from seqmine.sources import index_text, layout, records

SYNC = bytes.fromhex(SYNC_HEX)


def bcd(n):
    return (n // 10) * 16 + n % 10


def full_record(n, width=2352):
    code = n + 150
    header = bytes([bcd(code // 4500), bcd(code // 75 % 60), bcd(code % 75), 2])
    return SYNC + header + bytes([n % 256]) * (width - 16)


@pytest.fixture
def image(tmp_path):
    path = tmp_path / "image.bin"
    path.write_bytes(b"\7" * 7 + b"".join(full_record(n) for n in range(40)) + b"cut tail")
    return str(path)


def test_records_split_and_decoded(spark, image):
    df = records.read_records(spark, image, 2352, offset=7, split_bytes=2352 * 6)
    assert df.rdd.getNumPartitions() == 7
    rows = cl.decode_header(df).orderBy("pos").collect()
    assert [r.pos for r in rows] == [r.header_pos for r in rows] == list(range(40))
    assert all(r.sync_errors == 0 and r.mode == 2 and not r.is_audio for r in rows)
    assert bytes(rows[9].raw) == full_record(9)


def test_position_bounds_reach_the_reader(spark, image):
    df = records.read_records(spark, image, 2352, offset=7, split_bytes=2352 * 6)
    some = records.export_range(df, 10, 20)
    assert [r.pos for r in some.orderBy("pos").collect()] == list(range(10, 21))
    reader = records.BoundedRecordReader(image, 2352, 7, 2352 * 6)
    from pyspark.sql.datasource import GreaterThanOrEqual, LessThan
    assert list(reader.pushFilters([GreaterThanOrEqual(("pos",), 10), LessThan(("pos",), 12)])) == []
    assert [(p.first, p.last) for p in reader.partitions()] == [(10, 12)]


def test_layouts(spark, image, tmp_path):
    audio = bytes([1, 0, 0x64, 0] * 2) + bytes(2328)
    files = {
        "sub": b"".join(full_record(n, 2448) for n in range(8)),
        "nosync": b"\1" * 20 + b"".join(audio if n % 4 == 1 else bytes([n]) * 2336 for n in range(12)),
        "plain": bytes(range(256)) * 80, "tiny": b"x" * 100,
        "three": b"".join(full_record(n) for n in range(3)),
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    paths = spark.createDataFrame([(image,)] + [(str(tmp_path / n),) for n in files], "path string")
    got = {os.path.basename(r.path): (r.width, r.offset) for r in layout.detect_layout(paths).collect()}
    assert got == {"image.bin": (2352, 7), "sub": (2448, 0), "nosync": (2336, 20), "plain": (2048, 0),
                   "tiny": (2048, 0), "three": (2048, 0)}


LINES = ["#:0|ID:a[0]|Type:Video|Sectors:0-5|Loop:yES|Rate:15/2", "#:1|ID:b|Type:Audio", "#:2|ID:c|Type:X|Sectors:-3-5",
         "#:3|ID:d|Type:X|Sectors:1-2|:v", "#:4|ID:e:f|Type:X|Sectors:1-2", "", "   ", "; note", "Filename:x.bin",
         "#:5|ID:g|Type:X|Sectors:1-2|#:5", "#:6|ID:h|Type:X|Sectors:1-2|Loop:maybe|Rate:1/0"]


def test_index_lines(spark):
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(LINES)], "i int, line string")
    parsed = index_text.parse_lines(lines)
    got = {r.i: (r.kind, r.reason) for r in parsed.collect()}
    assert got == {0: ("item", None), 1: ("bad", "missing key"), 2: ("item", None), 3: ("bad", "empty key"),
                   4: ("bad", "field"), 5: ("blank", None), 6: ("blank", None), 7: ("comment", None),
                   8: ("source", None), 9: ("bad", "duplicate key"), 10: ("item", None)}
    typed = index_text.typed_fields(parsed.where("kind = 'item'"),
                                    {"#": "int", "Sectors": "range", "Loop": "yes_no", "Rate": "fraction"})
    rows = {r.i: r for r in typed.collect()}
    assert (rows[0]["#"], rows[0].Sectors_1, rows[0].Sectors_2, rows[0].Loop, rows[0].Rate_1, rows[0].Rate_2,
            rows[0].error) == (0, 0, 5, True, 15, 2, None)
    assert rows[2].error.startswith("Sectors: not range") and rows[10].error == "Loop: not yes_no: maybe"


def test_index_files(spark, tmp_path):
    good = [index_text.HEADER, "Filename:x.bin", *LINES[:2]]
    (tmp_path / "good").write_text("\n".join(good))
    (tmp_path / "headless").write_text("\n".join(good[1:]))
    (tmp_path / "twice").write_text("\n".join(good + ["Filename:y.bin"]))
    items, bad = index_text.read_index(spark, str(tmp_path))
    assert [os.path.basename(r.src) for r in items.collect()] == ["good"]
    reasons = {(os.path.basename(r.src), r.reason) for r in bad.collect()}
    assert {("good", "missing key"), ("headless", "no header"), ("twice", "several sources")} <= reasons


def test_illegal_index_keys():
    with pytest.raises(ValueError):
        _render("a", "a")
    for key in ("", "a:b", "ID"):
        with pytest.raises(ValueError):
            _render(key)


def _render(*keys):
    return index_text.render_items(None, [(k, None) for k in keys])


def test_number_lookups():
    assert cl.parse_number("12") == ("index", 12, 0)
    assert cl.parse_number("@7.3") == ("sector", 7, 3)
    assert cl.parse_number(" #9.0") == ("header", 9, 0)
    for bad in ("", "1x2", "12.", "%4", "-1"):
        with pytest.raises(ValueError):
            cl.parse_number(bad)


def test_records_are_written_in_order_and_any_bytes(spark, tmp_path):
    n, width = 300, 2352
    body = lambda k: bytes([k % 256]) * (width - 2) + bytes([0x0A if k % 2 else 0xFF, k * 7 % 256])
    df = spark.createDataFrame([(k, body(k)) for k in range(n)], "pos long, raw binary").repartition(5)
    path = str(tmp_path / "out")
    records.write_records(df, "raw", path, order=["pos"], width=width)
    files = [p for p, _ in records.list_files(path)]
    assert b"".join(open(p, "rb").read() for p in files) == b"".join(map(body, range(n)))
    assert all(name.startswith("part-") for name in os.listdir(path))
    again = records.read_records(spark, path, width, split_bytes=width * 7)
    assert sorted(bytes(r.raw) for r in again.collect()) == sorted(map(body, range(n)))
    assert again.where("pos = 3").count() == len(files)
    with pytest.raises(ValueError):
        records.write_records(df, "raw", path)
    records.write_records(df.limit(0), "raw", str(tmp_path / "none"))
    assert not (tmp_path / "none").exists() or records.list_files(str(tmp_path / "none")) == []


def test_folders_of_records(spark, tmp_path):
    rows = [(k, "a/b" if k % 3 == 0 else None if k % 3 == 1 else "ü", bytes([k, 10])) for k in range(40)]
    df = spark.createDataFrame(rows, "pos long, kind string, raw binary").repartition(3)
    path = str(tmp_path / "out")
    records.write_records(df, "raw", path, partition_by="kind", order=["pos"])
    found = {}
    for p, _ in records.list_files(path):
        found.setdefault(os.path.basename(os.path.dirname(p)), []).append(open(p, "rb").read())
    want = lambda kind: b"".join(r[2] for r in rows if r[1] == kind)
    assert {k: b"".join(v) for k, v in found.items()} == {
        "kind=a%2Fb": want("a/b"), "kind=__HIVE_DEFAULT_PARTITION__": want(None), "kind=%C3%BC": want("ü")}


def test_unequal_records_are_refused_and_leave_nothing(spark, tmp_path):
    path = tmp_path / "out"
    for bad in (b"abc", b"", None):
        df = spark.createDataFrame([(1, b"ab"), (2, bad)], "pos long, raw binary").coalesce(1)
        with pytest.raises(Exception):
            records.write_records(df, "raw", str(path), order=["pos"])
        assert not path.exists() or os.listdir(path) == []


def test_attempts_that_are_not_committed_go(tmp_path):
    writer = records.RecordWriter(str(tmp_path), None, None)
    staging = tmp_path / writer.staging
    staging.mkdir()
    for name in ("part-000000-first.bin", "part-000000-second.bin"):
        (staging / name).write_bytes(name.encode())
    writer.commit([records.Written([("part-000000-second.bin", 1)]), None])
    assert os.listdir(tmp_path) == ["part-000000-second.bin"]


def test_constant_payloads(spark):
    cases = [(b"", True, True), (bytes(9), True, True), (b"\1" + bytes(8), False, False), (b"\1\2" + bytes(3) + b"\3\4" + bytes(3), False, True),
             (b"\1\2" + bytes(3) + b"\3\4\0\1", False, False), (b"\1\2" + bytes(3) + b"\3", False, True), (b"\1\2" * 5, False, False),
             (bytes(5 * 5000), True, True), (None, None, None)]
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k int, raw binary")
    from pyspark.sql import functions as F
    found = df.select("k", cl.is_constant_payload(F.col("raw")).alias("a"), cl.is_constant_payload(F.col("raw"), group=5, head=2).alias("b")).orderBy("k").collect()
    assert [(r.a, r.b) for r in found] == [(c[1], c[2] if k != 2 else True) for k, c in enumerate(cases)]


def test_padded_names(spark):
    from pyspark.sql import functions as F
    from seqmine.sources import export
    df = spark.createDataFrame([(7,), (12345,)], "n int")
    out = export.artifact_manifest(df, base=F.lit("x"), extension=F.lit("png"), content=F.lit("c"), number=F.col("n"), digits=F.lit(3))
    assert [r.artifact for r in out.orderBy("n").collect()] == ["x[007].png", "x[12345].png"]
