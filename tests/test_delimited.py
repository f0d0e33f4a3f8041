import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandmill.sources import delimited

FIELD = r' *(?:"(?:[^"]|"")*" *|[^"\t]*)'


def plain(line):
    """Reason and values of one line, by regular expressions."""
    if not re.fullmatch(f"{FIELD}(?:\t{FIELD})*", line, re.S):
        return "quoting", None
    parts, rest = [], line
    while True:
        m = re.match(FIELD, rest, re.S)
        parts.append(m[0])
        if m.end() == len(rest):
            break
        rest = rest[m.end() + 1 :]
    if len(parts) != 7:
        return "column_count", None
    v = []
    for p in parts:
        p = p.strip(" ")
        if p.startswith('"'):
            p = p[1:-1].replace('""', '"').strip(" ")
        v.append(p)
    whole = lambda x: re.fullmatch("[0-9]+", x) and int(x) < 2**63
    level = re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", v[3])
    if not v[0] or not all(whole(v[i]) for i in (1, 2, 4, 5, 6)) or not level or not 0 <= float(v[3]) <= 1 or int(v[4]) > int(v[6]):
        return "invalid_value", None
    return "", (v[0], int(v[1]), int(v[2]), float(v[3]), int(v[4]), int(v[5]), int(v[6]))


def run(lines, chunk=1024):
    typed, reason, offset = delimited.tokenize(pa.array(lines, pa.string()), chunk=chunk)
    return [(r, tuple(c[i].as_py() for c in typed) if not r else None) for i, r in enumerate(reason)], offset


CASES = [
    "a\t1\t2\t0.5\t1\t1\t2", '"a\tb"\t1\t2\t.5\t1\t1\t2', '"a""q" \t 1\t2\t1e-1\t1\t1\t2', 'a"b\t1\t2\t0.5\t1\t1\t2', '"a\t1\t2\t0.5\t1\t1\t2', '"a"b\t1\t2\t0.5\t1\t1\t2',
    "a\t1\t2\t0.5\t1\t1", "a\t1\t2\t0.5\t1\t1\t2\t3", "\t1\t2\t0.5\t1\t1\t2", "a\t1\t2\t1.5\t1\t1\t2", "a\t1\t2\t0.5\t3\t1\t2", "a\t1\t9223372036854775807\t0.5\t1\t1\t2",
    "a\t1\t9223372036854775808\t0.5\t1\t1\t2", '""\t1\t2\t0.5\t1\t1\t2', "é\t1\t2\t0.5\t-1\t1\t2", "a\t0001\t2\t0\t000\t1\t2", '"a\nb"\t1\t2\t0.5\t1\t1\t2', "a\t１\t2\t0\t0\t1\t2", "a\t1\t2\tNaN\t1\t1\t2", '"',
]


@pytest.mark.parametrize("chunk", [1, 3, 64, 1024])
def test_cases_do_not_depend_on_chunks(chunk):
    got, _ = run(CASES, chunk)
    assert got == [plain(x) for x in CASES]


piece = st.sampled_from(['"', '""', "\t", " ", "a", "1", "0.5", "-1", "é", '"x"', "1\t2", "\r"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(piece, max_size=18).map("".join), min_size=1, max_size=6), st.integers(1, 40))
def test_against_regular_expressions(lines, chunk):
    assert run(lines, chunk)[0] == [plain(x) for x in lines]


def test_offsets():
    _, offset = run(CASES)
    assert list(offset[3:8]) == [1, 16, 3, 13, 16]
    assert offset[14] == 11  # bytes, not letters


def test_composition_equals_one_run():
    classes = np.random.default_rng(1).integers(0, 5, 5000).astype(np.uint8)
    assert (delimited.states_before(classes, 7) == delimited.states_before(classes, 5000)).all()


def test_table(spark):
    rows = [(1, "a\t1\t2\t0.5\t1\t1\t2\r", "x"), (2, None, "x"), (3, "  ", "x"), (4, "# note", "x"), (5, "track q", "x"), (6, "a\t1", "x"), (7, "a\t1", "x"), (8, "\t" * 6, "x"), (9, "k" * 200_000, "x"), (None, "a", None)]
    df = spark.createDataFrame(rows, "line_id bigint, raw_line string, reason string")
    broken = {(r.line_id, r.reason) for r in delimited.broken_lines(df).collect()}
    assert broken == {(6, "column_count"), (7, "column_count"), (8, "invalid_value"), (9, "column_count"), (None, "column_count")}
    assert [tuple(r) for r in delimited.valid_lines(df).collect()] == [(1, "a", 1, 2, 0.5, 1, 1, 2)]
    assert delimited.parse_lines(df.limit(0)).count() == 0
