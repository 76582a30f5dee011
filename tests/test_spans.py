import csv
import io
import random

import pytest

from casegraph.sources import spans, tables


def write(path, name, text):
    with open(f"{path}/{name}", "w", encoding="utf-8", newline="") as f:
        f.write(text)


def brute(text):
    """Rows by the csv module; places by counting characters."""
    out, at, held, first = [], 0, "", 0
    for n, line in enumerate(text.splitlines(keepends=True) if "\r" not in text else text.split("\n")):
        line = line if "\r" not in text else line + "\n"
        if not held:
            start, first = at, n
        held += line
        at += len(line)
        if held.count('"') % 2 == 0:
            if first and held.strip():
                out.append((first, start, at, *[x.strip() for x in next(csv.reader(io.StringIO(held)))]))
            held = ""
    return out


@pytest.mark.parametrize("split", ["64", "1000", "128m"])
@pytest.mark.parametrize("last", ["", "\n"])
def test_rows_and_places_do_not_depend_on_splits(spark, tmp_path, split, last):
    rng = random.Random(split + last)
    rows = []
    for i in range(120):
        words = [rng.choice(["plain", "größe", "漢字", 'say ""hi""', "two\nlines", "a,b", ""]) for _ in range(2)]
        rows.append(f"{i}," + ",".join(f'"{w}"' if set(w) & set('",\n') else w for w in words))
        if rng.random() < 0.1:
            rows.append("")
    text = "id, First Name ,note\n" + "\n".join(rows) + last
    write(tmp_path, "calls.csv", text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = spans.record_spans(spark, str(tmp_path))
        assert got.columns == ["file", "seq", "start", "end", "id", "First Name", "note"]
        told = sorted(tuple("" if v is None else v for v in r[1:]) for r in got.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert told == brute(text)


def test_places_are_those_of_whole_texts(spark, tmp_path):
    text = "from,to\r\n\r\nA 1,B 2\r\nC, D \r\n"
    write(tmp_path, "x.csv", text)
    got = sorted(tuple(r[1:]) for r in spans.record_spans(spark, str(tmp_path)).collect())
    whole = tables.record_lines(spark.createDataFrame([("c", "d", text)], "case_id string, doc_id string, text string"), ["from", "to"])
    assert got == sorted(tuple(r[2:]) for r in whole.collect()) == [(2, 11, 20, "A 1", "B 2"), (3, 20, 27, "C", "D")]


def test_several_files_and_a_header_only(spark, tmp_path):
    write(tmp_path, "a.csv", "k,v\n1,x\n2,y")
    write(tmp_path, "b.csv", "k,v\n3,z\n")
    write(tmp_path, "c.csv", "k,v\n")
    got = sorted((r.file[-5:], r.seq, r.start, r.end, r.k, r.v) for r in spans.record_spans(spark, str(tmp_path)).collect())
    assert got == [("a.csv", 1, 4, 8, "1", "x"), ("a.csv", 2, 8, 11, "2", "y"), ("b.csv", 1, 4, 8, "3", "z")]
