"""Text files: types, NULL, headers, comments, projections, separators, compression, errors."""

import datetime as dt
import gzip
from decimal import Decimal

import pytest

from rivulet.plans.graph import Graph, run
from rivulet.plans.syntax import LanguageError

ALL = "a INTEGER, b BIGINT, c DECIMAL, e VARCHAR, f CHAR(8), g DATETIME, h DATE"
LINES = ["+5\t-9999999999\t1.250\tx y\tabcdefgh\t2001-02-03 04:05:06\t1999-12-31", "-7\t0\t-3\t\tzzzzzzzz\t2048-01-01 00:00:00\t1856-01-01"]
ROWS = [
    (5, -9999999999, Decimal("1.25"), "x y", "abcdefgh", dt.datetime(2001, 2, 3, 4, 5, 6), dt.date(1999, 12, 31)),
    (-7, 0, Decimal(-3), "", "zzzzzzzz", dt.datetime(2048, 1, 1), dt.date(1856, 1, 1)),
]


def put(path, lines):
    path.write_text("".join(x + "\n" for x in lines))
    return str(path)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_all_types(spark, tmp_path):
    f = put(tmp_path / "in.txt", LINES)
    assert rows(run(spark, f'r = read[file="{f}", format="{ALL}", mode="text"];')) == ROWS


def test_schema_file_header_comments_projection(spark, tmp_path):
    f = put(tmp_path / "in.txt", ["a\tb\tc\te\tf\tg\th", "# one", LINES[0], "# two", LINES[1]])
    s = put(tmp_path / "format.txt", [ALL])
    got = run(spark, f'r = read[file="{f}", formatFile="{s}", mode="text", skipHeader="true", comment="#", output="e,a"];')
    assert rows(got) == [("x y", 5), ("", -7)]
    with pytest.raises(LanguageError):
        run(spark, f'r = read[file="{f}", formatFile="{s}", mode="text", output="nope"];')


def test_null_only_in_nullable_fields(spark, tmp_path):
    f = put(tmp_path / "in.txt", ["1\t\\N\t\\N", "\\N\tx\t\\N"])
    assert rows(run(spark, f'r = read[file="{f}", format="a INTEGER NULL, b VARCHAR NULL, c VARCHAR", mode="text"];')) == [(1, None, "\\N"), (None, "x", "\\N")]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        run(spark, f'r = read[file="{f}", format="a INTEGER, b VARCHAR NULL, c VARCHAR", mode="text"];').collect()


def test_malformed_lines_end_the_query(spark, tmp_path):
    f = put(tmp_path / "in.txt", ["1\t2", "3"])
    with pytest.raises(Exception, match="invalid input record"):
        run(spark, f'r = read[file="{f}", format="a INTEGER, b INTEGER", mode="text"];').collect()


def test_separators_and_globs(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1|2;3|4;")
    (tmp_path / "b.txt").write_text("5|6")
    got = run(spark, f'r = read[file="{tmp_path}/*.txt", format="a INTEGER, b INTEGER", mode="text", fieldSeparator="|", recordSeparator=";"];')
    assert sorted(rows(got)) == [(1, 2), (3, 4), (5, 6)]


def test_write_and_compression(spark, tmp_path):
    text = """g = generate[output="CAST(RECORDCOUNT AS INTEGER) AS i, CASE WHEN RECORDCOUNT = 1LL THEN NULL ELSE 1.5e0 END AS d, CAST(1.50 AS DECIMAL) AS m, CAST('1999-01-02 03:04:05' AS DATETIME) AS t", numRecords=2];
    w = write[file="OUT", mode="text", headerFile="OUT.h", formatFile="OUT.f"]; g -> w;"""
    out = str(tmp_path / "out.gz")
    Graph.parse(text.replace("OUT", out)).run(spark)
    lines = [x for p in sorted((tmp_path / "out.gz").glob("part-*.gz")) for x in gzip.open(p, "rt").read().splitlines()]
    assert sorted(lines) == ["0\t1.500000000\t1.5\t1999-01-02 03:04:05", "1\t\\N\t1.5\t1999-01-02 03:04:05"]
    assert spark.read.text(out + ".h").first()[0] == "i\td\tm\tt"
    assert spark.read.text(out + ".f").first()[0] == "i INTEGER,d DOUBLE PRECISION NULL,m DECIMAL,t DATETIME"
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        Graph.parse(text.replace("OUT", out)).run(spark)


def test_header_of_empty_output(spark, tmp_path):
    text = f'g = generate[output="RECORDCOUNT AS i, RECORDCOUNT AS j"]; f = filter[where="i < 0LL"]; w = write[file="{tmp_path}/o", mode="text", header="true"]; g -> f; f -> w;'
    Graph.parse(text).run(spark)
    assert {p.read_text() for p in (tmp_path / "o").glob("part-*")} == {"i\tj\n"}


def test_sorted_output_is_in_order(spark, tmp_path):
    text = f'g = generate[output="RECORDCOUNT % 7LL AS k, RECORDCOUNT AS i", numRecords=50]; s = sort[key="k DESC", key="i"]; w = write[file="{tmp_path}/o", mode="text"]; g -> s; s -> w;'
    Graph.parse(text).run(spark)
    got = [tuple(map(int, x.split("\t"))) for p in sorted((tmp_path / "o").glob("part-*")) for x in p.read_text().splitlines()]
    assert got == sorted(((i % 7, i) for i in range(50)), key=lambda x: (-x[0], x[1]))


def test_binary_mode_is_parquet(spark, tmp_path):
    Graph.parse(f'g = generate[output="RECORDCOUNT AS i", numRecords=3]; w = write[file="{tmp_path}/o"]; g -> w;').run(spark)
    assert sorted(rows(run(spark, f'r = read[file="{tmp_path}/o"];'))) == [(0,), (1,), (2,)]


def test_organized_tables(spark, tmp_path):
    from rivulet.functions.types import parse_format
    from rivulet.sources.organized import read_organized

    for minor, day, batch in ((1, "20240101", 7), (1, "20240102", 8), (2, "20240102", 9)):
        folder = tmp_path / f"3_2/sales/5/{minor}/{day}/{batch}"
        folder.mkdir(parents=True)
        for serial in range(2):
            put(folder / f"serial_{serial:05d}", [f"{batch}\t{serial}"])
    fields = parse_format("a INTEGER, b INTEGER")
    got = read_organized(spark, str(tmp_path), 3, 2, "sales", 5, fields, "MinorNumber = 1 AND Date > CAST('2024-01-01' AS DATE) OR BatchId = 9")
    assert sorted(rows(got.visible())) == [(8, 0), (8, 1), (9, 0), (9, 1)]
    assert len(read_organized(spark, str(tmp_path), 3, 2, "sales", 5, fields).df.inputFiles()) == 6
    with pytest.raises(LanguageError):
        read_organized(spark, str(tmp_path), 3, 2, "sales", 5, fields, "BatchId = 1")


def test_command_line(spark, tmp_path, capsys):
    from rivulet.__main__ import main

    script = put(tmp_path / "s", ['g = generate[output="RECORDCOUNT AS k, RECORDCOUNT % 2LL AS m", numRecords=6];'])
    main(["--file", script, "--compile"])
    plan = put(tmp_path / "plan", [capsys.readouterr().out])
    main(["--plan", plan, "--output", str(tmp_path / "out")], spark)
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect())[:2] == ["0\t0", "1\t1"]
    m = put(tmp_path / "m", ['m = map[format="k INTEGER, v INTEGER"]; e = emit[key="k"]; m -> e;'])
    r = put(tmp_path / "r", ['r = reduce[]; g = sort_group_by[key="k", output="k, SUM(v) AS v"]; r -> g;'])
    lines = put(tmp_path / "lines", ["1\t2", "1\t3", "2\t4"])
    main(["--map", m, "--reduce", r, "--input", lines, "--output", str(tmp_path / "sums"), "--numreduces", "3"], spark)
    assert sorted(x[0] for x in spark.read.text(str(tmp_path / "sums")).collect()) == ["1\t5", "2\t4"]


def test_partitioning(spark):
    from rivulet.operators import exchange, shape

    a, b = shape.generate(spark, "RECORDCOUNT AS k, 'a' AS s", 20), shape.generate(spark, "RECORDCOUNT AS k, 'b' AS s", 5)
    parts = exchange.hash_partition(a, 3, ["k"])
    assert parts.df.rdd.getNumPartitions() == 3 and parts.df.count() == 20
    both = exchange.concatenated([a, shape.sort(b, ["k DESC"])])
    assert [tuple(r) for r in shape.filter_rows(both, None, 22).visible().collect()][-2:] == [(4, "b"), (3, "b")]
    assert exchange.collected([a, b]).df.count() == 25 and exchange.to_all(a).df.count() == 20


def test_blank_lines_are_lines_after_a_header(spark, tmp_path):
    for name in ("a.txt", "b.txt"):
        put(tmp_path / name, ["head", "", "  ", "x", ""])
    with gzip.open(tmp_path / "c.txt.gz", "wt") as f:
        f.write("head\nhead\n\n")
    (tmp_path / "d.txt").write_text("")
    (tmp_path / "e.txt").write_text("head")
    got = rows(run(spark, f'r = read[file="{tmp_path}/*", format="a VARCHAR", mode="text", skipHeader="true"];'))
    assert sorted(x for (x,) in got) == sorted(["", "  ", "x", ""] * 2 + ["head", ""])


def test_a_header_is_skipped_once_in_a_file_of_many_splits(spark, tmp_path):
    f = put(tmp_path / "in.txt", ["k", *map(str, range(3000))])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        df = run(spark, f'r = read[file="{f}", format="k INTEGER", mode="text", skipHeader="true"];')
        assert df.rdd.getNumPartitions() > 3 and sorted(x for (x,) in rows(df)) == [*range(3000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_print_with_frequency_and_predicate(spark):
    from rivulet.operators import shape

    r = shape.generate(spark, "RECORDCOUNT AS a", 20)
    for n, frequency, where, want in ((3, 2, "a > 10LL", [12, 14, 16]), (5, 7, None, [0, 7, 14]), (2, 1, "a > 10LL", [11, 12]), (9, 2, "a % 2LL = 1LL", [])):
        said = []
        assert shape.printed(r, n, frequency, where, said.append) is r
        assert [int(x) for x in said] == want


def test_binary_write_to_a_folder_for_each_row(spark, tmp_path):
    text = f"""g = generate[output="RECORDCOUNT AS i, CASE WHEN RECORDCOUNT % 2LL = 0LL THEN 'even' ELSE 'odd' END AS dir", numRecords=6];
    w = write[connect="{tmp_path}/o", file="dir", mode="binary", headerFile="{tmp_path}/h", formatFile="{tmp_path}/f"]; g -> w;"""
    Graph.parse(text).run(spark)
    assert {p.name for p in (tmp_path / "o").iterdir() if p.is_dir()} == {"dir_=even", "dir_=odd"}
    assert sorted(r["i"] for r in spark.read.parquet(f"{tmp_path}/o/dir_=odd").collect()) == [1, 3, 5]
    assert spark.read.text(f"{tmp_path}/h").first()[0] == "i\tdir" and spark.read.text(f"{tmp_path}/f").first()[0] == "i BIGINT,dir VARCHAR"


def test_shared_folder(spark, tmp_path):
    from rivulet import session

    path = session.shared_path(spark, "x")
    spark.range(3).write.parquet(path)
    session.remove(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    session.remove(spark, path)

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            getCheckpointDir = staticmethod(lambda: None)
            master = "yarn"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Cluster)
