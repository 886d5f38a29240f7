"""Records over line and split borders against Python's csv; archives with a partition a member."""

import csv
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.sources import records, zip_members
from tessera.sources.archives import archive_lines, text_lines

COLUMNS = "archive string, member string, member_no int, line_no long, header string, text string"


def random_text(rng, n):
    def cell():
        kind = rng.randrange(6)
        words = "".join(rng.choice(["a", "é", " ", "x1", "-"]) for _ in range(rng.randrange(4)))
        inner = "".join(rng.choice(["a", ";", '""', "\n", "é", "\n\n", " "]) for _ in range(rng.randrange(6)))
        return [words, f'"{inner}"', f'{words}z"q', f'"{inner}"tail', '""', f'"{inner}"y"y'][kind]

    return "".join(";".join(cell() for _ in range(rng.randrange(1, 5))) + "\n" for _ in range(n))


def by_csv(text):
    return [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=";") if r]


def as_lines(texts):
    rows = []
    for k, text in enumerate(texts):
        cut = text.split("\n")[: -1 if text.endswith("\n") else None]
        rows += [("a", f"m{k}", k, n, cut[0], line) for n, line in enumerate(cut)]
    return rows


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1 << 16])
def test_records_of_random_members(spark, monkeypatch, block):
    monkeypatch.setattr(records, "BLOCK", block)
    rng = random.Random(block)
    texts = ["h1;h2\n" + random_text(rng, rng.randrange(40)) for _ in range(25)] + ['"h\n1";h2\nx;"y\n"\n']
    rows = as_lines(texts)
    rng.shuffle(rows)
    got = {}
    for r in records.whole_records(spark.createDataFrame(rows, COLUMNS).repartition(4)).withColumn("fields", records.fields(F.col("text"))).collect():
        got.setdefault(r["member_no"], []).append((r["line_no"], r["text"], r["fields"], r["header"]))
    for k, text in enumerate(texts):
        found = [x for x in sorted(got[k]) if x[1] != ""]
        assert [f for _, _, f, _ in found] == by_csv(text)
        assert {h for *_, h in found} == {'"h\n1";h2' if k == 25 else "h1;h2"}


def test_named_columns_and_rows_without_a_number(spark):
    rows = as_lines(['a;"b ""c""";d\n1;"x\ny;z";3\n\n4\n']) + [("bad.zip", None, None, None, None, None)]
    whole = records.whole_records(spark.createDataFrame(rows, COLUMNS))
    assert whole.where("archive = 'bad.zip'").count() == 1
    got = sorted(tuple(r) for r in records.named(whole, ["a", 'b "c"', "none", "d"]).drop("archive", "member", "member_no").collect())
    assert got == [(1, "1", "x\ny;z", None, "3"), (4, "4", None, None, None)]


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 13, 64, 500])
def test_a_file_cut_at_any_byte(spark, tmp_path, size):
    rng = random.Random(size)
    texts = {f"f{k}.csv": "h1;h2\n" + random_text(rng, rng.randrange(2, 6 if size < 8 else 30)) for k in range(2)}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode("latin-1"))
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        lines = text_lines(spark, str(tmp_path))
        rows = lines.select("archive", "line_no", "text", "header").collect()
        whole = records.whole_records(lines).withColumn("fields", records.fields(F.col("text"))).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    for name, text in texts.items():
        own = sorted((r["line_no"], r["text"]) for r in rows if r["archive"].endswith(name))
        assert own == list(enumerate(text.split("\n")[:-1]))
        assert [r["fields"] for r in sorted((r for r in whole if r["archive"].endswith(name)), key=lambda r: r["line_no"]) if r["text"] != ""] == by_csv(text)


def test_many_fields_take_time_in_proportion(spark):
    wide = spark.range(30).select(F.expr("array_join(transform(sequence(1, 20000), x -> if(x % 2 = 0, concat('\"', x, ';\"\"\"'), 'v')), ';')").alias("text"))
    assert wide.select(F.size(records.fields(F.col("text"))).alias("n")).distinct().collect()[0]["n"] == 20000


@pytest.fixture
def archives(tmp_path):
    def write(name, members):
        with zipfile.ZipFile(tmp_path / name, "w", zipfile.ZIP_DEFLATED) as z:
            for member, text in members.items():
                z.writestr(member, text.encode("latin-1"))

    write("one_2023.zip", {"a.csv": "h;g\n1;é\n", "b.csv": "h\n2\n3\n", "c.txt": "no", "d.csv": ""})
    write("two_2024.zip", {"a.csv": "h\n4\n", "sub/b.csv": "h\r\n5\r6\n"})
    (tmp_path / "bad_2024.zip").write_bytes(b"no archive")
    with zipfile.ZipFile(tmp_path / "torn_2025.zip", "w", zipfile.ZIP_STORED) as z:
        z.writestr("x.csv", "h\nline one\n")
    torn = (tmp_path / "torn_2025.zip").read_bytes()
    (tmp_path / "torn_2025.zip").write_bytes(torn.replace(b"line one", b"line 0ne"))
    return tmp_path


def test_a_partition_a_member_and_errors_in_rows(spark, archives):
    lines = zip_members.member_lines(spark, str(archives))
    got = sorted((r["archive"].split("/")[-1], r["member"] or "", -1 if r["line_no"] is None else r["line_no"], r["text"] or "", r["year"], bool(r["error"])) for r in lines.collect())
    assert got == [
        ("bad_2024.zip", "", -1, "", 2024, True), ("one_2023.zip", "a.csv", 0, "h;g", 2023, False), ("one_2023.zip", "a.csv", 1, "1;é", 2023, False), ("one_2023.zip", "b.csv", 0, "h", 2023, False), ("one_2023.zip", "b.csv", 1, "2", 2023, False), ("one_2023.zip", "b.csv", 2, "3", 2023, False),
        ("torn_2025.zip", "x.csv", -1, "", 2025, True), *([("torn_2025.zip", "x.csv", 0, "h", 2025, False), ("torn_2025.zip", "x.csv", 1, "line 0ne", 2025, False)] if any(g[0] == "torn_2025.zip" and g[2] == 0 for g in got) else []),
        ("two_2024.zip", "a.csv", 0, "h", 2024, False), ("two_2024.zip", "a.csv", 1, "4", 2024, False), ("two_2024.zip", "sub/b.csv", 0, "h", 2024, False), ("two_2024.zip", "sub/b.csv", 1, "5", 2024, False), ("two_2024.zip", "sub/b.csv", 2, "6", 2024, False),
    ]
    assert lines.rdd.getNumPartitions() == 7
    assert zip_members.member_lines(spark, f"{archives}/*_2023.zip").rdd.getNumPartitions() == 3


def test_filters_reach_the_plan(spark, archives):
    lines = zip_members.member_lines(spark, str(archives))
    late = lines.where("year >= 2024 and member = 'a.csv'")
    assert late.rdd.getNumPartitions() == 1 and {r["text"] for r in late.collect()} == {"h", "4"}
    assert lines.where("year in (2023)").rdd.getNumPartitions() == 3
    assert {r["text"] for r in lines.where("member like 'sub/%' and line_no > 0").collect()} == {"5", "6"}


def test_readers_agree(spark, archives):
    names = ["archive", "member", "member_no", "line_no", "header", "text"]
    plain = archive_lines(spark, str(archives))
    assert plain.where("error is not null").count() == 2
    a, b = ({(r["archive"].split("/")[-1], *r[1:]) for r in df.where("error is null").select(*names).collect()} for df in (plain, zip_members.member_lines(spark, str(archives))))
    assert {r for r in a if "torn" not in r[0]} == {r for r in b if "torn" not in r[0]}


def test_a_large_member_is_streamed(spark, tmp_path):
    """A member of over 1 GB of text: a worker's memory stays far below it."""
    block = ("x" * 999 + "\n").encode() * 1000
    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z, z.open("big.csv", "w", force_zip64=True) as part:
        for _ in range(1030):
            part.write(block)
    reader = zip_members.MemberReader({"path": str(tmp_path / "big.zip")})
    (only,) = reader.partitions()
    n = most = 0
    for batch in reader.read(only):
        n, most = n + batch.num_rows, max(most, batch.nbytes)
    assert n == 1_030_000 and most < 16 << 20


def test_written_archives_read_back(spark, tmp_path):
    rows = [(f"z_{k % 3}_2020.zip", f"m{k % 2}.csv", k, f"{k};é" if k > 5 else "h;g") for k in range(600)]
    done = zip_members.write_archives(spark.createDataFrame(rows, "archive string, member string, line_no long, text string").repartition(5), f"file://{tmp_path}/out").collect()
    assert {tuple(r) for r in done} == {(f"z_{k}_2020.zip", 2) for k in range(3)}
    got = {(r["archive"].split("/")[-1], r["member"], r["text"]) for r in zip_members.member_lines(spark, f"file://{tmp_path}/out").collect()}
    assert got == {(a, m, t) for a, m, _, t in rows}


def test_lines_are_read_a_few_times(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = as_lines(["h;t\n" + "".join(f'{n};"x\ny"\n' for n in range(50))])
    lines = spark.createDataFrame(rows, COLUMNS)
    whole = records.whole_records(lines.mapInArrow(count, lines.schema))
    assert sorted(r["line_no"] for r in whole.collect()) == [0, *range(1, 100, 2)]
    # Open members, closed ones, states, and rows without a number.
    assert seen.value <= 4 * len(rows)
