"""Gzip JSON lines: order, absent keys, bad lines."""

import gzip

import pytest

from ranktide.sources import io as IO

SCHEMA = "n int, name string"


@pytest.fixture()
def folder(tmp_path):
    """Four files of 5, 0, 40 and 5 lines, the third of several members; a bad line far behind."""
    at = 0
    for part, lines in enumerate((5, 0, 40, 5)):
        members = []
        for _ in range(lines):
            row = '{"n": %d, "extra": [1]}' % at if at % 3 else '{"name": "row %d", "n": %d}' % (at, at)
            members.append(gzip.compress((("{broken" if at == 48 else row) + "\n").encode()))
            at += 1
        (tmp_path / f"part {part}.jsonl.gz").write_bytes(b"".join(members) or gzip.compress(b""))
    return str(tmp_path)


@pytest.mark.parametrize("n", [0, 1, 4, 5, 6, 30, 45, 46, 48])
def test_first_lines_in_file_order(spark, folder, n):
    got = IO.read_jsonl_gz(spark, folder, _schema(), ["name", "n"], n)
    assert got.columns == ["name", "n"]
    assert sorted((r["n"], r["name"]) for r in got.collect()) == [(i, None if i % 3 else f"row {i}") for i in range(n)]


def _schema():
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(SCHEMA)


def test_a_bad_line_fails_only_where_it_is_read(spark, folder):
    for n in (49, 50, None):
        with pytest.raises(Exception, match="(?i)malformed"):
            IO.read_jsonl_gz(spark, folder, _schema(), sample_size=n).collect()


def test_blank_lines_fail(spark, tmp_path):
    (tmp_path / "a.gz").write_bytes(gzip.compress(b'{"n": 1}\n \n{"n": 2}\n'))
    assert [r["n"] for r in IO.read_jsonl_gz(spark, str(tmp_path), _schema(), sample_size=1).collect()] == [1]
    with pytest.raises(Exception, match="blank line"):
        IO.read_jsonl_gz(spark, str(tmp_path), _schema()).collect()


def test_sample_of_other_files_is_refused(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"n": 1}\n')
    assert IO.read_jsonl(spark, str(tmp_path), _schema()).count() == 1
    with pytest.raises(ValueError):
        IO.read_jsonl(spark, str(tmp_path), _schema(), sample_size=1)


def test_more_than_there_is(spark, tmp_path):
    (tmp_path / "a.gz").write_bytes(gzip.compress(b'{"n": 1}\n{"n": 2}'))
    assert [r["n"] for r in IO.read_jsonl(spark, str(tmp_path), _schema(), sample_size=10).collect()] == [1, 2]
