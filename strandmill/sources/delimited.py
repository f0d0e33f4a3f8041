"""Called-sites lines to typed rows, broken lines set apart with a reason.

A quote-aware finite-state machine runs over the raw bytes of all lines of an
Arrow batch at once. The bytes are cut into chunks of equal length regardless
of line ends; for each chunk the machine's effect is worked out for every state
it might start in (all chunks side by side), the chunks' effects are composed
from left to right, and with the start states known each byte gets its state.
A line end resets the machine, so a broken quote spoils its own line only.
No row is looked at in a Python loop; Spark partitions the lines.

Rules. Blank lines and lines that begin with ``#``, ``track `` or ``browser ``
are no rows. One ending carriage return and blanks around a column are ignored.
Reasons, the first that holds:

``quoting``        a double quote that neither encloses a whole column nor is
                   doubled inside one (offset: the offending quote or byte, for
                   an open quote the end of the line)
``column_count``   not as many columns as the schema (offset: start of the
                   first surplus column, or the end of the line)
``invalid_value``  an empty text column; a count that is not a whole number
                   from 0 to 2**63-1 in digits alone; a level that is no decimal
                   number from 0 to 1; meth_count above coverage (offset: start
                   of the first bad column; for the last rule of meth_count)

Offsets are in bytes of the line's UTF-8 form, from 0. Null lines are no rows;
an empty table gives an empty result; lines may be of any length; columns of
the input with the names of output columns are left out unless kept by name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: kind of each column: t text, n count, f share
COLUMNS = (("chrom", "t"), ("start", "n"), ("end", "n"), ("level", "f"), ("meth_count", "n"), ("unmeth_count", "n"), ("coverage", "n"))
CHUNK = 1024

OPEN, PLAIN, QUOTED, CLOSING, AFTER, BAD = range(6)
OTHER, BLANK, TAB, QUOTE, END = range(5)
#: next state by byte class (rows) and state (columns, in the order above)
STEP = np.array(
    [
        [PLAIN, PLAIN, QUOTED, BAD, BAD, BAD],
        [OPEN, PLAIN, QUOTED, AFTER, AFTER, BAD],
        [OPEN, OPEN, QUOTED, OPEN, OPEN, BAD],
        [QUOTED, BAD, CLOSING, QUOTED, BAD, BAD],
        [OPEN, OPEN, OPEN, OPEN, OPEN, OPEN],
    ],
    np.uint8,
)
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord(" ")], _CLASS[ord("\t")], _CLASS[ord('"')] = BLANK, TAB, QUOTE


def chunk_effects(classes: np.ndarray) -> np.ndarray:
    """(chunks, states): where each chunk leads from every start state."""
    at = np.tile(np.arange(6, dtype=np.uint8), (len(classes), 1))
    for i in range(classes.shape[1]):
        at = STEP[classes[:, i, None], at]
    return at


def compose(effects: np.ndarray, start: int = OPEN) -> np.ndarray:
    """Start state of each chunk."""
    out = np.empty(len(effects), np.uint8)
    for i, effect in enumerate(effects):
        out[i] = start
        start = effect[start]
    return out


def states_before(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """State of the machine before each byte (one more at the end)."""
    n = len(classes)
    wide = np.full(-(-max(n, 1) // chunk) * chunk, END, np.uint8)
    wide[:n] = classes
    wide = wide.reshape(-1, chunk)
    at = compose(chunk_effects(wide))
    out = np.empty(wide.shape, np.uint8)
    for i in range(chunk):
        out[:, i] = at
        at = STEP[wide[:, i], at]
    return out.ravel()[:n]


def _counts(text: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(which are counts, their values)."""
    digits = pc.utf8_ltrim(text, characters="0")
    size = pc.binary_length(digits)
    ok = pc.and_(pc.match_substring_regex(text, r"^[0-9]+$"), pc.or_(pc.less(size, 19), pc.and_(pc.equal(size, 19), pc.less_equal(digits, "9223372036854775807"))))
    value = pc.if_else(ok, pc.if_else(pc.equal(size, 0), "0", digits), None)
    return ok.to_numpy(zero_copy_only=False), pc.cast(value, pa.int64())


def _shares(text: pa.Array) -> tuple[np.ndarray, pa.Array]:
    ok = pc.match_substring_regex(text, r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    plain = pc.replace_substring_regex(pc.if_else(ok, text, None), r"^\+", "")
    try:
        value = pc.fill_null(pc.cast(plain, pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    except pa.ArrowInvalid:  # an exponent that no double holds
        value = np.array([float(x) if x is not None else np.nan for x in plain.to_pylist()])
    good = (value >= 0) & (value <= 1)
    return good, pa.array(value, mask=~good)


def tokenize(lines: pa.Array, columns=COLUMNS, chunk: int = CHUNK) -> tuple[list[pa.Array], np.ndarray, np.ndarray]:
    """(typed columns, reason or "", offset or -1) of each line, none null or skipped."""
    k, width = len(lines), len(columns)
    joined = pc.binary_join_element_wise(lines.cast(pa.large_string()), pa.array([""] * k, pa.large_string()), pa.scalar("\n", pa.large_string()))
    begins = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + k + 1]
    buffer = np.frombuffer(joined.buffers()[2], np.uint8)[begins[0] : begins[-1]]
    begins = begins - begins[0]
    ends = begins[1:] - 1
    classes = _CLASS[buffer]
    classes[ends] = END
    state = states_before(classes, chunk)

    # a line is bad where the machine enters BAD, or ends inside quotes
    after = STEP[classes, state]
    enters = np.flatnonzero((after == BAD) & (state != BAD))
    line_of = np.searchsorted(ends, enters)
    reason, offset = np.full(k, "", object), np.full(k, -1, np.int64)
    bad, first = np.unique(line_of, return_index=True)
    reason[bad], offset[bad] = "quoting", enters[first] - begins[bad]
    open_end = state[ends] == QUOTED
    reason[open_end], offset[open_end] = "quoting", (ends - begins[:-1])[open_end]

    splits = np.flatnonzero(((classes == TAB) & (state != QUOTED) & (state != BAD)) | (classes == END))
    first_field = np.searchsorted(splits, begins[:-1])
    fields = np.searchsorted(splits, ends) - first_field + 1
    wrong = (fields != width) & (reason == "")
    reason[wrong] = "column_count"
    more = wrong & (fields > width)
    offset[wrong] = (ends - begins[:-1])[wrong]
    offset[more] = splits[first_field[more] + width - 1] + 1 - begins[:-1][more]

    good = np.flatnonzero(reason == "")
    starts = np.concatenate([[0], splits[:-1] + 1]) if len(splits) else np.zeros(0, np.int64)
    # every field with the tab or line end behind it: these cover the buffer without gaps
    flat = pa.LargeStringArray.from_buffers(len(splits), pa.py_buffer(np.append(starts, len(buffer)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buffer)))
    typed, wrong_column = [], np.full(len(good), width)
    for c, (_, kind) in enumerate(columns):
        text = pc.utf8_trim(pc.utf8_rtrim(flat.take(pa.array(first_field[good] + c)), characters="\t\n"), characters=" ")
        if pc.any(pc.starts_with(text, '"')).as_py():
            inner = pc.replace_substring(pc.utf8_slice_codeunits(text, 1, -1), '""', '"')
            text = pc.if_else(pc.starts_with(text, '"'), pc.utf8_trim(inner, characters=" "), text)
        if kind == "t":
            ok, value = pc.not_equal(text, "").to_numpy(zero_copy_only=False), text.cast(pa.string())
        else:
            ok, value = _counts(text) if kind == "n" else _shares(text)
        wrong_column[~ok & (wrong_column == width)] = c
        typed.append(value)
    names = [name for name, _ in columns]
    if "meth_count" in names and "coverage" in names:
        m, v = names.index("meth_count"), names.index("coverage")
        over = pc.fill_null(pc.greater(typed[m], typed[v]), False).to_numpy(zero_copy_only=False)
        wrong_column[over & (wrong_column == width)] = m
    broken = np.flatnonzero(wrong_column < width)
    reason[good[broken]] = "invalid_value"
    offset[good[broken]] = starts[first_field[good[broken]] + wrong_column[broken]] - begins[good[broken]]
    # back to all lines, null where a line is broken
    place = np.full(k, -1)
    fine = wrong_column == width
    place[good[fine]] = np.flatnonzero(fine)
    index = pa.array(place, mask=place < 0)
    return [v.take(index) for v in typed], reason, offset


def parse_lines(lines: DataFrame, text_col: str = "raw_line", keep: tuple[str, ...] = ("line_id",), columns=COLUMNS) -> DataFrame:
    """(keep..., the typed columns, reason, error_offset); reason is null for valid lines."""
    kinds = {"t": (pa.string(), "string"), "n": (pa.int64(), "bigint"), "f": (pa.float64(), "double")}
    text = F.col(text_col)
    rows = lines.where(text.isNotNull() & text.rlike(r"[^ \r\n]") & ~text.rlike(r"\A(#|track |browser )"))
    # tabs alone do not make a line blank; one carriage return at the end is dropped
    rows = rows.select(*keep, F.regexp_replace(text, r"\r\z", "").alias("__line"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            typed, reason, offset = tokenize(batch.column(len(keep)), columns)
            bad = reason != ""
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], *(v.cast(kinds[kind][0]) for v, (_, kind) in zip(typed, columns)), pa.array(reason, pa.string(), mask=~bad), pa.array(offset, pa.int64(), mask=~bad)],
                names=[*keep, *(n for n, _ in columns), "reason", "error_offset"],
            )

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    schema = ", ".join([*kept, *(f"`{n}` {kinds[kind][1]}" for n, kind in columns), "reason string", "error_offset bigint"])
    return rows.mapInArrow(run, schema)


def valid_lines(lines: DataFrame, **params) -> DataFrame:
    return parse_lines(lines, **params).where("reason is null").drop("reason", "error_offset")


def broken_lines(lines: DataFrame, text_col: str = "raw_line", keep: tuple[str, ...] = ("line_id",), **params) -> DataFrame:
    return parse_lines(lines, text_col, keep, **params).where("reason is not null").select(*keep, "reason", "error_offset")
