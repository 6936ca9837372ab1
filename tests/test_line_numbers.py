"""Line numbers of text files that many tasks read in blocks, and errors that name a line."""

import random

import pytest

from trailmill.plans.shared_store import Store
from trailmill.sources import files


@pytest.fixture
def small_blocks(spark):
    names = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_numbers_across_blocks(spark, tmp_path, small_blocks):
    rng = random.Random(2)
    want = set()
    for name, n, end in (("a.txt", 400, "\n"), ("b.txt", 1, ""), ("c.txt", 150, "\r\n"), ("d.txt", 3, "")):
        lines = ["x" * rng.choice([0, 0, 1, 30, 900]) + f"é{k}" * rng.choice([0, 1]) for k in range(n)]
        lines[-1] += "end"
        (tmp_path / name).write_bytes(((end or "\n").join(lines) + end).encode())
        want |= {(name, k, x) for k, x in enumerate(lines, 1)}
    (tmp_path / "empty.txt").write_text("")
    rows = files.numbered_lines(spark, str(tmp_path), Store(spark, "t")).collect()
    assert {(r["file"].rsplit("/", 1)[-1], r["line"], r["value"]) for r in rows} == want and len(rows) == len(want)


def test_good_lines_come_with_their_numbers(spark, tmp_path, small_blocks):
    lines = ["# note", "", *[f'{{"id": "k{k}", "n": {k}}}' for k in range(120)], "   "]
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    rows = files.checked_jsonl(spark, str(tmp_path / "x.jsonl"), "id string, n int", Store(spark, "t"), ("id",), "id").collect()
    assert sorted((r["line"], r["id"], r["n"]) for r in rows) == [(k + 3, f"k{k}", k) for k in range(120)]


@pytest.mark.parametrize(
    ("bad", "said"),
    [
        ({50: "{broken"}, "x.jsonl:50: not an object of the schema"),
        ({7: "[1]", 90: '"text"', 3: "12"}, r"x.jsonl:3: not an object of the schema \(and 2 more\)"),
        ({9: '{"id": "  ", "n": 1}'}, "x.jsonl:9: no id"),
        ({9: '{"n": 1}', 11: '{"id": "k1", "n": 1}'}, "x.jsonl:9: no id; x.jsonl:11: repeats id"),
        ({100: '{"id": "z", "n": "many"}'}, "x.jsonl:100: not an object of the schema"),
    ],
)
def test_a_bad_line_is_named(spark, tmp_path, small_blocks, bad, said):
    lines = ["# first", *[f'{{"id": "k{k}", "n": {k}}}' for k in range(2, 121)]]
    lines[1] = '{"id": "k1", "n": 1}'
    for number, text in bad.items():
        lines[number - 1] = text
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    with pytest.raises(ValueError, match=f"^{said}$"):
        files.checked_jsonl(spark, str(tmp_path / "x.jsonl"), "id string, n int", Store(spark, "t"), ("id",), "id")
