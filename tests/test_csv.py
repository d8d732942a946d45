"""The CSV reader against Python's own, on files cut into many blocks."""

import csv
import io
import random

import pytest

from tallygate.sources.readers import read, read_csv


@pytest.fixture
def small_blocks(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "64b", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def expected(text: str) -> list:
    rows = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    return [(k + 2, *(dict(zip(rows[0], r, strict=True)).get(c) or None for c in ("id", "result"))) for k, r in enumerate(rows[1:])]


def found(df) -> list:
    return sorted((r.line, r.id, r.result) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_blocks_within_quoted_cells(small_blocks, tmp_path, seed):
    """Cells with newlines, quotes and commas, longer than blocks; the order of columns differs by file."""
    r = random.Random(seed)
    files = {}
    for k in range(3):
        out = io.StringIO(newline="")
        names = r.sample(["id", "result", "note"], 3)
        w = csv.writer(out, lineterminator=r.choice(["\n", "\r\n"]), quoting=r.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]))
        w.writerow(names)
        for _ in range(r.choice([0, 3, 40])):
            w.writerow(["".join(r.choices(["a", "bc", '"', ",", "\n", "\r\n", '""', " ", "x" * 30, '"\n"'], [6, 6, 1, 1, 1, 1, 1, 2, 1, 1], k=r.randint(0, 12))) or "-" for _ in names])
            if r.random() < 0.1:
                out.write("\n")
        files[tmp_path / f"f{k}.csv"] = out.getvalue()
    for p, text in files.items():
        p.write_text(text, newline="")
    df = read_csv(small_blocks, [str(p) for p in files])
    got = sorted((row.file.rsplit("/", 1)[1], row.line, row.id or "", row.result or "") for row in df.collect())
    assert got == sorted((p.name, line, i or "", x or "") for p, text in files.items() for line, i, x in expected(text))
    assert df.where("_error IS NOT NULL").count() == 0


def test_one_file_is_many_tasks(small_blocks, tmp_path):
    text = "id,result\n" + "".join(f'"{i}\nof ""many""",draw\n' for i in range(50))
    (tmp_path / "a.csv").write_text(text)
    df = read_csv(small_blocks, str(tmp_path / "a.csv"))
    assert found(df) == expected(text) and len(expected(text)) == 50
    assert small_blocks.read.text(str(tmp_path / "a.csv")).rdd.getNumPartitions() > 10


def test_odd_files(spark, tmp_path):
    """Stray quotes, a byte order mark, blank lines, no newline at the end, an open quote, empty files."""
    cases = [
        'id,result\n5" pipe,draw\n"a"b,draw\nx"y","z"\n',
        "\ufeffid,result\na,draw",
        '\n\nid,result\n\n"a\n\nb",draw\n\n',
        'id,result\na,"open\nb,c\n',
        "id,result\n,\n",
        '"id","result"\n"""",""\n',
        "id,result\n",
        "",
    ]
    for k, text in enumerate(cases):
        path = tmp_path / f"{k}.csv"
        path.write_text(text, encoding="utf-8", newline="")
        got = found(read(spark, str(path)))
        want = [(2, "a", None)] if "open" in text else expected(text.removeprefix("\ufeff"))
        assert [g[:2] for g in got] == [w[:2] for w in want], text
        assert "open" in text or got == want


def test_uneven_records_are_errors(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,result\na,draw\nb\nc,"dr,aw"\nd,draw,x\n')
    (tmp_path / "b.csv").write_text("id,baseline,candidate\na,1,2\nb,one,2\nc,,\n")
    bad = sorted((r.file[-5:], r.line, r._error) for r in read_csv(spark, [str(tmp_path / f) for f in ("a.csv", "b.csv")]).collect() if r._error)
    assert [b[:2] for b in bad] == [("a.csv", 3), ("a.csv", 5), ("b.csv", 3)]
    assert all(b[2].startswith("InvalidCsv:") for b in bad)


def test_a_long_cell(spark, tmp_path):
    """A cell of a million quotes and newlines needs no stack."""
    cell = '"\n' * 500_000
    (tmp_path / "a.csv").write_text("id,result\n" + '"' + cell.replace('"', '""') + '",draw\n', newline="")
    (row,) = read_csv(spark, str(tmp_path / "a.csv")).collect()
    assert row.id == cell and row.result == "draw" and row.line == 2
