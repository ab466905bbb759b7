"""The DBN source against files written here, and the command line."""

import struct

import numpy as np
import pytest
import zstandard

from ticklattice.__main__ import main
from ticklattice.params import FEATURES
from ticklattice.sources.dbn import RECORD, SCHEMA, as_mbo, mbo_records, read_dbn

DAY = 1_746_403_200_000_000_000  # 2025-05-05


def mbo(k, action=b"A", side=b"B", price=100_000_000_000, ts=None, size=5):
    return np.array([(14, 0xA0, 1, 77, DAY, 1000 + k, price, size, 128, 0, action, side, DAY + k * 1000 if ts is None else ts, 0, k)], RECORD).tobytes()


def other(words):
    return struct.pack("<BBHIQ", words, 0x16, 1, 77, DAY) + bytes(4 * words - 16)


def whole(*records):
    return b"DBN\x02" + struct.pack("<I", 100) + bytes(100) + b"".join(records)


def test_records_of_other_kinds_are_counted_and_left_out(spark, tmp_path):
    data = whole(mbo(0), other(20), mbo(2, b"T", b"N", 2**63 - 1), other(14), mbo(4, ts=2**64 - 1))
    (tmp_path / "a.dbn").write_bytes(data)
    (tmp_path / "b.dbn.zst").write_bytes(zstandard.compress(data))
    rows = read_dbn(spark, str(tmp_path), "ES").orderBy("file", "seq").collect()
    assert [r.seq for r in rows] == [0, 2, 4] * 2 and {r.instrument for r in rows} == {"ES"}
    first, trade, timeless = rows[3:]
    assert (first.ts_ns, first.action, first.side, first.order_id, first.price_nanos, first.size, first.instrument_id) == (DAY, "A", "B", 1000, 100_000_000_000, 5, 77)
    assert (trade.action, trade.side, trade.price_nanos) == ("T", "N", None) and timeless.ts_ns is None
    events = as_mbo(read_dbn(spark, str(tmp_path / "a.dbn"))).orderBy("seq").collect()
    assert [(e.seq, e.instrument, e.ts_us, e.price_ticks) for e in events] == [(0, "77", DAY // 1000, 10000), (2, "77", DAY // 1000 + 2, 0)]


def test_any_cut_of_a_stream_gives_the_same_records():
    data = b"".join(mbo(k) if k % 3 else other(4 + k % 5) for k in range(40))
    for cut in (1, 50, 57, 333):
        seen, rest, n = [], b"", 0
        for at in range(0, len(data), cut):
            rest += data[at : at + cut]
            rows, where, count, used = mbo_records(rest)
            seen += [(int(i) + n, int(r["sequence"])) for i, r in zip(where, rows, strict=True)]
            n, rest = n + count, rest[used:]
        assert not rest and n == 40 and seen == [(k, k) for k in range(40) if k % 3]


def test_missing_damaged_and_empty_files(spark, tmp_path):
    with pytest.raises(Exception, match="nothing.dbn"):
        read_dbn(spark, str(tmp_path / "nothing.dbn")).count()
    (tmp_path / "cut.dbn").write_bytes(whole(mbo(0))[:-3])
    with pytest.raises(Exception, match="ends within a record"):
        read_dbn(spark, str(tmp_path / "cut.dbn")).collect()
    (tmp_path / "text.dbn").write_bytes(b"hello, world")
    with pytest.raises(Exception, match="no DBN file"):
        read_dbn(spark, str(tmp_path / "text.dbn")).collect()
    (tmp_path / "empty.dbn").write_bytes(whole())
    empty = read_dbn(spark, str(tmp_path / "empty.dbn"))
    assert empty.count() == 0 and empty.columns == [c.split()[0] for c in SCHEMA.split(", ")]


def test_command_line_writes_features_and_reports_missing_dates(spark, tmp_path):
    start = DAY + 49_000 * 10**9
    for name in ("SPY", "ES"):
        (tmp_path / name).mkdir()
        book = [mbo(k, b"A", b"B" if k % 2 else b"A", (100 + (1 + k % 5) * (-1 if k % 2 else 1)) * 10**9, start + k * 10**8) for k in range(60)]
        (tmp_path / name / "20250505.mbo.dbn.zst").write_bytes(zstandard.compress(whole(*book)))
    out = tmp_path / "out"
    assert main(["20250505,20250506", "SPY", "ES", "--source", str(tmp_path), "--out", str(out), "--normalised", str(tmp_path / "z")]) == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "z" / "date=20250505")).count() > 0
    made = spark.read.option("header", True).option("inferSchema", True).csv(str(out / "date=20250505"))
    assert {r.instrument for r in made.select("instrument").distinct().collect()} == {"SPY", "ES"}
    assert set(FEATURES) < set(made.columns) and made.where("midprice IS NOT NULL").count() > 0
    assert not (out / "date=20250506").exists()


def test_a_damaged_date_does_not_spoil_the_others(spark, tmp_path):
    start = DAY + 49_000 * 10**9
    for name in ("SPY", "ES"):
        (tmp_path / name).mkdir()
        good = whole(*[mbo(k, b"A", b"B" if k % 2 else b"A", (100 + (-1 if k % 2 else 1)) * 10**9, start + k * 10**8) for k in range(40)])
        (tmp_path / name / "20250505.dbn").write_bytes(good)
        (tmp_path / name / "20250507.dbn").write_bytes(good[:-3])
    out = tmp_path / "out"
    assert main(["20250505,20250507", "SPY", "ES", "--source", str(tmp_path), "--out", str(out), "--format", "parquet", "--whole-day"]) == 1
    assert (out / "date=20250505").exists() and not (out / "date=20250507").exists()
    assert read_dbn(spark, str(tmp_path / "SPY"), mode="PERMISSIVE").groupBy("file").count().count() == 2
