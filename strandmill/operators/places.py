"""Places of reads in a genome by votes of their seeds.

A seed is frequent in a large genome (10 three-letter digits: two thousand places in
40 million bases), but a place counts from ``min_seeds`` = 2 equal seeds on, so reads
look up pairs of their seeds: two codes a given distance apart. Each place with m
equal seeds comes up once for each of its m (m - 1) / 2 pairs, which tells m and its
first seed; no place is left out. Where single seeds have few places, they are looked
up instead, with the same result.

The genome is written once to the shared folder. A task goes over it in spans of ``SPAN``
bases with ``READS`` reads at a time, so its memory depends on neither; hits never leave the
task, and so are no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.conversion import parse_conversion
from ..session import materialize

BLOCK = 32
#: bases of the genome and reads held at a time, and bytes of reads or regions
SPAN, READS, BYTES = 1 << 22, 1 << 18, 3 << 24
#: bits of a hit: read, offset in the span, number of the seed
O_BITS, I_BITS = 26, 18
_U, _LOW = np.uint64, np.uint64(0xFFFFFFFF)
_READ_SHIFT, _I_MASK = _U(O_BITS + I_BITS), _U((1 << I_BITS) - 1)


def stored(blocks: DataFrame) -> tuple[list[str], int, int]:
    """(files, first and last block id) of the blocks, written in order of their ids; runs a job."""
    table = materialize(blocks.select(F.col("block_id").cast("long"), "seq").repartitionByRange("block_id").sortWithinPartitions("block_id"), "genome")
    low, high = table.agg(F.min("block_id"), F.max("block_id")).first()
    return [f if "://" in f or f.startswith("file:") else f"file://{f}" for f in table.inputFiles()], low or 0, -1 if high is None else high


def letters(files: list[str], start: int, end: int) -> np.ndarray:
    """Bytes of the positions from ``start``, the first of a block, to before ``end``; 0 where the genome has none."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    source = fs.FileSystem.from_uri(files[0])[0]
    first, last = start // BLOCK, (end - 1) // BLOCK
    table = ds.dataset([fs.FileSystem.from_uri(f)[1] for f in files], filesystem=source, format="parquet").to_table(columns=["block_id", "seq"], filter=(ds.field("block_id") >= first) & (ds.field("block_id") <= last))
    out = np.zeros((last - first + 1, BLOCK), np.uint8)
    for batch in table.to_batches(max_chunksize=1 << 16):
        ids, (data, offsets) = batch.column(0).to_numpy() - first, bytes_of(batch.column(1))
        size = np.diff(offsets)
        if (size == BLOCK).all():
            out[ids] = data.reshape(-1, BLOCK)
        else:
            out.reshape(-1)[np.repeat(ids * BLOCK - offsets[:-1], size) + np.arange(len(data))] = data
    return out.reshape(-1)[: end - start]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without nulls."""
    text = column.cast(pa.large_binary())
    if not len(text):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def digit_table(conversion: str) -> np.ndarray:
    """Digit of each byte as in ``three_letter_code``; 255 for no letter."""
    t = np.zeros(256, np.uint8)
    for b, x in zip("ACGT", parse_conversion(conversion).three_letter):
        t[ord(b)] = t[ord(b.lower())] = int(x)
    t[0] = 255
    return t


def codes(digits: np.ndarray, k: int) -> np.ndarray:
    """Base-3 value of the k digits from each place of the last axis on."""
    kind = np.uint32 if k <= 20 else _U
    part, width, whole, done = digits.astype(kind), 1, None, 0
    while True:
        if k & width:
            n = digits.shape[-1] - done - width + 1
            whole = part if whole is None else whole[..., :n] * kind(3**width) + part[..., done : done + n]
            done += width
        if 2 * width > k:
            return whole
        part = part[..., :-width] * kind(3**width) + part[..., width:]
        width *= 2


def _coded(digits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray | None]:
    """(code at each place of the genome, are its letters there; None: all are)."""
    if len(digits) < k:
        return np.zeros(0, np.uint32), None
    if not (digits == 255).any():
        return codes(digits, k), None
    bad = np.concatenate([[0], np.cumsum(digits == 255)])
    return codes(np.where(digits == 255, 0, digits).astype(np.uint8), k), bad[k:] == bad[:-k]


def _key(a: np.ndarray, b: np.ndarray | None, k: int) -> np.ndarray:
    """32 bits for a code or a pair of codes; equal for equal ones."""
    if 3 ** (k if b is None else 2 * k) <= 1 << 32:
        return a if b is None else a * np.uint32(3**k) + b
    key = a.astype(_U)
    if b is not None:
        key *= _U(0xD6E8FEB86659FD93)
        key += b
    key ^= key >> _U(32)
    key *= _U(0x9E3779B97F4A7C15)
    return (key >> _U(32)).astype(np.uint32)


def _sieve(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte, bit) of a key in a table of asked keys."""
    h = (key * np.uint32(0x9E3779B1)) >> np.uint32(6)
    return h >> np.uint32(3), np.uint8(128) >> (h & np.uint32(7)).astype(np.uint8)


def asked(reads: np.ndarray, ok: np.ndarray, k: int, apart: int, rows: np.ndarray | None = None, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sorted numbers of key, read and seed, table of the keys) of seeds (``apart`` 0) or of pairs with ``apart`` - 1 seeds between.

    ``rows`` are the reads' numbers; ``before`` leaves out first seeds from that of each read on.
    """
    n, bits = reads.shape[1] - apart, max(1, (reads.shape[1] - 1).bit_length())
    key = _key(reads[:, :n].ravel(), reads[:, apart:].ravel() if apart else None, k)
    rows = np.arange(len(reads), dtype=_U) if rows is None else rows.astype(_U)
    of = (rows[:, None] << _U(bits) | np.arange(n, dtype=_U)).ravel()
    use = ok[:, :n] & ok[:, apart:]
    use = (use if before is None else use & (np.arange(n) < before[:, None])).ravel()
    key, of = (key, of) if use.all() else (key[use], of[use])
    table = np.zeros(1 << 26, bool)
    table[(key * np.uint32(0x9E3779B1)) >> np.uint32(6)] = True
    of |= key.astype(_U) << _U(32)
    of.sort()
    return of, np.packbits(table)


def _found(ask, table, reads: np.ndarray, genome: np.ndarray, there: np.ndarray | None, k: int, step: int, apart: int, bias: int):
    """Hits as numbers (read, offset + bias, seed) of what is asked in a part of the genome."""
    far, bits = apart * step, _U(max(1, (reads.shape[1] - 1).bit_length()))
    index = [np.zeros(0, _U)]
    for a in range(0, len(genome) - far, 1 << 18):
        b = min(len(genome) - far, a + (1 << 18))
        key = _key(genome[a:b], genome[a + far : b + far] if apart else None, k)
        byte, bit = _sieve(key)
        use = (table[byte] & bit) != 0
        if there is not None:
            use &= there[a:b] & there[a + far : b + far]
        use = np.flatnonzero(use)
        index.append(key[use].astype(_U) << _U(32) | (use + a).astype(_U))
    index = np.concatenate(index)
    index.sort()
    exact = 3 ** (2 * k if apart else k) <= 1 << 32
    for a in range(0, len(index), 1 << 18):
        part = index[a : a + (1 << 18)]
        low = np.searchsorted(ask, part & ~_LOW)
        count = np.searchsorted(ask, part | _LOW, "right") - low
        hit = np.flatnonzero(count)
        low, count, pos = low[hit], count[hit], part[hit] & _LOW
        ends = np.cumsum(count)
        at = 0
        while at < len(count):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 20), "right")))
            c = count[at:to]
            q = ask[np.arange(int(c.sum())) + np.repeat(low[at:to] - (np.cumsum(c) - c), c)] & _LOW
            p = np.repeat(pos[at:to], c)
            seed = q & ((_U(1) << bits) - _U(1))
            q >>= bits
            if not exact:
                r, i, g = q.astype(np.int64), seed.astype(np.int64), p.astype(np.int64)
                same = genome[g] == reads[r, i]
                if apart:
                    same &= genome[g + far] == reads[r, i + apart]
                q, p, seed = q[same], p[same], seed[same]
            q <<= _READ_SHIFT
            q |= seed
            p += _U(bias)
            p -= seed * _U(step)
            p <<= _U(I_BITS)
            q |= p
            yield q
            at = to


def span_votes(reads: np.ndarray, ok: np.ndarray, digits: np.ndarray, own: int, k: int, step: int, top: int, min_seeds: int = 2, head: bool = True, tail: bool = True, pairs: bool | None = None, held: dict | None = None):
    """(hits of each read, repeats of each read, votes) in a span of the genome.

    ``digits`` are those of the span and as many after it as a read may reach, the first
    ``own`` are the span's. Repeats are the votes beyond the first at any offset. Votes are
    rows (read, seeds, first seed, offset) of the ``top`` best of each read, in order.
    Offsets before the span count where it is the ``head`` of the genome, those from
    ``own`` on where it is the ``tail``. ``pairs`` forces how votes are found;
    ``held`` keeps what is asked from one span to the next.
    """
    n, bias = reads.shape[1], (reads.shape[1] - 1) * step
    hits = np.zeros(len(reads), np.int64)
    if len(digits) < k:
        return hits, hits.copy(), np.zeros((0, 4), np.int64)
    genome, there = _coded(digits, k)
    mine = genome[:own] if there is None else genome[:own][there[:own]]
    if 3**k <= 1 << 24:
        table = np.bincount(mine, minlength=3**k)
        each = table[reads]
    else:
        order = np.sort(mine)
        each = (np.searchsorted(order, reads.ravel(), "right") - np.searchsorted(order, reads.ravel())).reshape(reads.shape)
    hits = np.where(ok, each, 0).sum(axis=1)
    if pairs is None:
        pairs = min_seeds > 1 and n < 512 and hits.sum() > 2 * len(reads) * n * (n - 1)
    if not pairs and hits.sum() > 1 << 24 and len(reads) > 1:
        half = len(reads) // 2
        parts = [span_votes(reads[a:b], ok[a:b], digits, own, k, step, top, min_seeds, head, tail, False) for a, b in ((0, half), (half, len(reads)))]
        parts[1][2][:, 0] += half
        return tuple(np.concatenate(x) for x in zip(*parts))
    held, keys = {} if held is None or not pairs else held, []
    for apart in range(1, n) if pairs else (0,):
        if apart not in held:
            held[apart] = asked(reads, ok, k, apart)
        keys += _found(*held[apart], reads, genome, there, k, step, apart, bias)
    del genome
    parts, keys = keys, np.empty(sum(map(len, keys)), _U)
    at = 0
    for i, part in enumerate(parts):
        keys[at : at + len(part)] = part
        at, parts[i] = at + len(part), None  # not twice in memory
    keys.sort()
    repeats, votes, at = np.zeros(len(reads), np.int64), [np.zeros((0, 4), np.int64)], 0
    while at < len(keys):
        # whole reads, some two million hits at a time
        last = keys[min(at + (1 << 21), len(keys) - 1)] >> _READ_SHIFT
        to = int(np.searchsorted(keys, (last + _U(1)) << _READ_SHIFT))
        part = keys[at:to]
        at = to
        place = part >> _U(I_BITS)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        seeds = np.diff(np.append(first, len(part)))
        if pairs:
            seeds = ((1 + np.sqrt(1 + 8 * seeds)) / 2 + 0.5).astype(np.int64)
        use = seeds > 1 if min_seeds > 1 else np.ones(len(seeds), bool)
        if not (head and tail):
            offset = place[first] & _U((1 << O_BITS) - 1)
            use &= (head | (offset >= _U(bias))) & (tail | (offset < _U(own + bias)))
        first, seeds = first[use], seeds[use].astype(_U)
        place, seed = place[first], part[first] & _I_MASK
        repeats += np.bincount((place >> _U(O_BITS)).astype(np.int64), seeds - 1, len(reads)).astype(np.int64)
        if min_seeds > 2:
            place, seed, seeds = place[seeds >= min_seeds], seed[seeds >= min_seeds], seeds[seeds >= min_seeds]
        votes.append(span_best(place, seeds, seed, top, bias))
    return hits, repeats, np.concatenate(votes)


def span_few(reads: np.ndarray, ok: np.ndarray, genome: np.ndarray, there: np.ndarray | None, own: int, k: int, step: int, top: int, head: bool, tail: bool, limit: np.ndarray, held: dict) -> np.ndarray:
    """Votes as of ``span_votes`` without most of those that can't be among the best of their reads.

    Neighbours that overlap have by far the most places. They are looked up only for first seeds
    before each read's ``limit``; a place that has more than them is found, with all its seeds, by
    the other pairs. For that seeds two apart must touch, so that the one between is equal too.
    """
    n, bias = reads.shape[1], (reads.shape[1] - 1) * step
    keys, rows = [], np.flatnonzero(limit)
    for apart in range(1, n):
        if apart > 1 and apart not in held:
            held[apart] = asked(reads, ok, k, apart)
        ask = held[apart] if apart > 1 else asked(reads[rows], ok[rows], k, 1, rows, limit[rows])
        # equal seeds as bits, with those between where the two touch
        bits = _U((2 << apart) - 1 if apart * step <= k else 1 << apart | 1)
        for q in _found(*ask, reads, genome, there, k, step, apart, bias):
            seed = q & _I_MASK
            q ^= seed
            q |= bits << seed
            keys.append(q)
    parts, keys = keys, np.empty(sum(map(len, keys)), _U)
    at = 0
    for i, part in enumerate(parts):
        keys[at : at + len(part)] = part
        at, parts[i] = at + len(part), None  # not twice in memory
    keys.sort()
    votes, at = [np.zeros((0, 4), np.int64)], 0
    while at < len(keys):
        last = keys[min(at + (1 << 21), len(keys) - 1)] >> _READ_SHIFT
        to = int(np.searchsorted(keys, (last + _U(1)) << _READ_SHIFT))
        part = keys[at:to]
        at = to
        place = part >> _U(I_BITS)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        equal, place = np.bitwise_or.reduceat(part & _I_MASK, first), place[first]
        if not (head and tail):
            offset = place & _U((1 << O_BITS) - 1)
            use = (head | (offset >= _U(bias))) & (tail | (offset < _U(own + bias)))
            equal, place = equal[use], place[use]
        lowest = np.bitwise_count((equal & (~equal + _U(1))) - _U(1)).astype(_U)
        votes.append(span_best(place, np.bitwise_count(equal).astype(_U), lowest, top, bias))
    return np.concatenate(votes)


def limits(found: np.ndarray, reads: int, n: int, top: int) -> np.ndarray:
    """For each read the first seed from which on two neighbours of a later place are no more among its ``top`` best votes."""
    limit = np.full(reads, n, np.int64)
    if len(found):
        last = np.flatnonzero(np.append(found[1:, 0] != found[:-1, 0], True))
        full = last[np.diff(last, prepend=-1) >= top]
        limit[found[full, 0]] = np.where(found[full, 1] > 2, 0, found[full, 2])
    return limit


def span_best(place: np.ndarray, seeds: np.ndarray, seed: np.ndarray, top: int, bias: int) -> np.ndarray:
    """``best`` for places that are numbers (read, offset + bias), sorted as single numbers."""
    offset = place & _U((1 << O_BITS) - 1)
    if seeds.max(initial=0) > 511 or seed.max(initial=0) > 511:
        row = (place >> _U(O_BITS)).astype(np.int64)
        return best(np.stack([row, seeds.astype(np.int64), seed.astype(np.int64), offset.astype(np.int64) - bias], axis=1), top)
    key = (place ^ offset) << _U(18) | (_U(511) - seeds) << _U(35) | seed << _U(O_BITS) | offset
    key.sort()
    row = key >> _U(44)
    key = key[first_of(row, top)]
    low = lambda bits: (key & _U((1 << bits) - 1)).astype(np.int64)
    return np.stack([(key >> _U(44)).astype(np.int64), 511 - (low(44) >> 35), low(35) >> 26, low(26) - bias], axis=1)


def first_of(rows: np.ndarray, top: int) -> np.ndarray:
    """Are rows among the ``top`` first of their value? Equal values lie together."""
    use = np.ones(len(rows), bool)
    use[top:] = rows[top:] != rows[:-top]
    return use


def merged(before: np.ndarray, more: np.ndarray, top: int) -> np.ndarray:
    """``best`` of both, each in that order; all offsets of ``more`` are greater."""
    if not len(before):
        return more
    votes = np.concatenate([before, more])
    if votes[:, 1:3].max() > 511 or len(votes) > 1 << 24:
        return best(votes, top)
    # rows of equal votes stay in order of their offsets
    key = (votes[:, 0] << 42 | (511 - votes[:, 1]) << 33 | votes[:, 2] << 24 | np.arange(len(votes))).astype(_U)
    key.sort()
    key = key[first_of(key >> _U(42), top)]
    return votes[(key & _U((1 << 24) - 1)).astype(np.int64)]


def best(votes: np.ndarray, top: int) -> np.ndarray:
    """The ``top`` first rows of each read by most seeds, first seed and offset, in that order."""
    votes = votes[np.lexsort((votes[:, 3], votes[:, 2], -votes[:, 1], votes[:, 0]))]
    return votes[first_of(votes[:, 0], top)]


def ranks(rows: np.ndarray) -> np.ndarray:
    """Number from 1 inside each run of equal values."""
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, np.int64)
    return np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows)))) + 1


def _seeds(seqs: pa.Array, k: int, step: int, conversion: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(codes of the seeds of each read, are they in it, most letters of a read)."""
    data, offsets = bytes_of(seqs)
    size = np.diff(offsets)
    wide = max(k, int(size.max(initial=0)))
    rows, n = np.zeros((len(size), wide), np.uint8), (wide - k) // step + 1
    rows[np.arange(wide) < size[:, None]] = data
    table = digit_table(conversion)
    ok = np.arange(n) * step + k <= size[:, None]
    lut = np.where(table == 255, 0, table).astype(np.uint8)
    return np.concatenate([np.zeros((0, n), np.uint32), *(codes(lut[rows[a : a + (1 << 15)]], k)[:, ::step] for a in range(0, len(rows), 1 << 15))]), ok, wide


def _spans(files, low: int, high: int, wide: int, conversion: str):
    """(first position, bases, digits of them and of ``wide`` more) of each span of the genome."""
    table, end = digit_table(conversion), (high + 1) * BLOCK
    for at in range(low * BLOCK, end, SPAN):
        to = min(end, at + SPAN)
        yield at, to - at, table[letters(files, at, min(end, to + wide))]


def _whole(files, low: int, high: int, own: np.ndarray, ok: np.ndarray, wide: int, k: int, step: int, conversion: str, top: int, min_seeds: int, few: bool | None = False):
    """(hits, offsets, votes with offsets in the genome) of some reads' ``_seeds``.

    ``few`` forces votes by ``span_few``, without hits and offsets; None takes it where hits are many.
    """
    n, reads = own.shape[1], len(own)
    hits = np.zeros(reads, np.int64)
    offsets, found, held, lean = hits.copy(), np.zeros((0, 4), np.int64), {}, {}
    able = few is not False and min_seeds == 2 and 2 <= n <= I_BITS and 2 * step <= k and 3**k <= 1 << 24
    asks = np.bincount(own[ok], minlength=3**k) if able else None
    for at, size, digits in _spans(files, low, high, wide, conversion):
        head, tail = at == low * BLOCK, at + size == (high + 1) * BLOCK
        genome, there = _coded(digits, k) if able else (None, None)
        if able and (few or asks @ np.bincount(genome[:size] if there is None else genome[:size][there[:size]], minlength=3**k) > 2 * reads * n * (n - 1)):
            votes = span_few(own, ok, genome, there, size, k, step, top, head, tail, limits(found, reads, n, top), lean)
        else:
            h, r, votes = span_votes(own, ok, digits, size, k, step, top, min_seeds, head, tail, None, held)
            hits += h
            offsets += h - r
        votes[:, 3] += at
        found = merged(found, votes, top)
    return hits, offsets, found


def _counted(files, low: int, high: int, seqs: pa.Array, k: int, step: int, conversion: str, chains: bool | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hits, offsets) of some reads. ``chains`` forces how offsets are counted.

    An offset with m equal seeds has m - 1 pairs of equal seeds without an equal one between
    them, so hits less such pairs are the offsets. Neighbours that overlap are one word of
    ``k + step`` letters, and words are counted; seeds further apart that still touch have
    equal ones between them; the other pairs are few and looked up.
    """
    own, ok, wide = _seeds(seqs, k, step, conversion)
    n, words = own.shape[1], step <= k and 3 ** (k + step) <= 1 << 24

    def plain():
        parts = [_whole(files, low, high, own[a : a + READS], ok[a : a + READS], wide, k, step, conversion, 1, 2)[:2] for a in range(0, max(1, len(own)), READS)]
        return tuple(np.concatenate(x) for x in zip(*parts))

    if 3**k > 1 << 24 or n >= 512 or chains is False:
        return plain()
    word = lambda a, b: a * np.uint32(3**step) + b % np.uint32(3**step)
    single, double = np.zeros(3**k, np.int64), np.zeros(3 ** (k + step) if words else 0, np.int32)
    for _, size, digits in _spans(files, low, high, k + step, conversion):
        genome, there = _coded(digits, k)
        single += np.bincount(genome[:size] if there is None else genome[:size][there[:size]], minlength=len(single))
        if words and len(genome) > step:
            more = word(genome[:-step], genome[step:])[:size]
            more = more if there is None else more[(there[:-step] & there[step:])[:size]]
            double += np.bincount(more, minlength=len(double)).astype(np.int32)
    hits = np.where(ok, single[own], 0).sum(axis=1)
    if chains is None and hits.sum() <= 2 * len(own) * n * (n - 1):
        return plain()
    offsets, held, bias = hits.copy(), {}, (n - 1) * step
    for i in range(n - 1 if words else 0):
        offsets -= np.where(ok[:, i + 1], double[word(own[:, i], own[:, i + 1])], 0)
    del double
    for _, size, digits in _spans(files, low, high, wide, conversion):
        genome, there = _coded(digits, k)
        for apart in range(1, n):
            if apart * step <= k and (words or apart > 1):
                continue
            if apart not in held:
                held[apart] = asked(own, ok, k, apart)
            for q in _found(*held[apart], own, genome[: size + apart * step], there, k, step, apart, bias):
                read, seed = (q >> _READ_SHIFT).astype(np.int64), (q & _I_MASK).astype(np.int64)
                pos = ((q >> _U(I_BITS)) & _U((1 << O_BITS) - 1)).astype(np.int64) - bias + seed * step
                for b in range(1, apart):
                    same = genome[pos + b * step] == own[read, seed + b]
                    if there is not None:
                        same &= there[pos + b * step]
                    read, seed, pos = read[~same], seed[~same], pos[~same]
                offsets -= np.bincount(read, minlength=len(own))
    return hits, offsets


def _regions(files, low: int, high: int, starts: np.ndarray, length: int, held: dict) -> np.ndarray:
    """``length`` letters from each start, 0 where the genome has none."""
    out = np.zeros((len(starts), length), np.uint8)
    start, end, size = low * BLOCK, (high + 1) * BLOCK, 8 * SPAN
    for at in range(start, end, size):
        pick = np.flatnonzero((starts >= at) & (starts < at + size))
        if len(pick):
            if at not in held:
                held.clear()
                held[at] = np.append(letters(files, at, min(end, at + size + length)), np.zeros(length, np.uint8))
            view = np.lib.stride_tricks.sliding_window_view(held[at], length)
            for some in np.array_split(pick, 1 + len(pick) * length // BYTES):
                out[some] = view[starts[some] - at]
    return out


def _strings(rows: np.ndarray) -> pa.Array:
    """A string a row, without zeros."""
    there = rows != 0
    if there.all():
        return pa.StringArray.from_buffers(len(rows), pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1])), pa.py_buffer(np.ascontiguousarray(rows)))
    ends = np.append(0, np.cumsum(there.sum(axis=1))).astype(np.int32)
    return pa.StringArray.from_buffers(len(rows), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows[there])))


def _map(reads: DataFrame, k: int, keep: tuple[str, ...], run, schema: str, most: int = READS, most_bytes: int = BYTES) -> DataFrame:
    """``run`` over tables of (read_idx, seq, keep...), as many reads at a time as are held."""

    def chunks(batches):
        held, rows, size = [], 0, 0
        for batch in batches:
            held, rows, size = [*held, batch], rows + batch.num_rows, size + batch.nbytes
            if rows + batch.num_rows > most or size > most_bytes:
                yield from run(pa.Table.from_batches(held).combine_chunks())
                held, rows, size = [], 0, 0
        if rows:
            yield from run(pa.Table.from_batches(held).combine_chunks())

    few = reads.where(F.length("seq") >= k).select(F.col("read_idx").cast("long"), "seq", *keep)
    # each task goes over the genome, so there are no more of them than cores
    return few.coalesce(reads.sparkSession.sparkContext.defaultParallelism).mapInArrow(chunks, schema)


def hit_counts(reads: DataFrame, blocks: DataFrame, k: int, step: int, conversion: str = "ct") -> DataFrame:
    """(read_idx, hits, offsets) of the reads with a hit: equal seeds, and offsets they point to."""
    files, low, high = stored(blocks)

    def run(table):
        hits, offsets = _counted(files, low, high, table.column(1).chunk(0), k, step, conversion)
        use = np.flatnonzero(hits)
        yield pa.RecordBatch.from_arrays([table.column(0).chunk(0).take(pa.array(use)), pa.array(hits[use]), pa.array(offsets[use])], names=["read_idx", "hits", "offsets"])

    # counts take less memory than votes, so a task goes over the genome for four times as many reads
    return _map(reads, k, (), run, "read_idx long, hits long, offsets long", 4 * READS, 2 * BYTES)


def candidates(
    reads: DataFrame, blocks: DataFrame, genome_length: int, read_length: int, k: int, step: int, top: int = 5, *, min_seeds: int = 2, conversion: str = "ct", region: int = 0, keep: tuple[str, ...] = (), chrom: str = "chr_sim", finish: tuple | None = None
) -> DataFrame:
    """(read_idx, chrom, start, seeds, cand_rank): most voted offsets, first seen first.

    ``region`` adds seq and region, that many bases from start (less at the genome's end),
    and ``keep`` names further columns of the reads. A read_idx is on one row.
    ``finish``, (function of a batch, schema), is applied to batches where they are made, so
    that regions need not leave the task; a batch has all candidates of its reads.
    """
    files, low, high = stored(blocks)
    carry = ("seq", *keep) if region else keep
    kinds = dict(reads.select(*carry).dtypes) if carry else {}

    def run(table):
        held = {}
        votes = _whole(files, low, high, *_seeds(table.column(1).chunk(0), k, step, conversion), k, step, conversion, top, min_seeds, None)[2]
        start, rank = np.minimum(np.maximum(votes[:, 3], 0), genome_length - read_length), ranks(votes[:, 0]).astype(np.int32)
        use = start >= 0
        votes, start, rank = votes[use], start[use], rank[use]
        # regions of many rows at once, since their starts lie all over the genome, and rows sent in parts
        some, many = max(1, min(1 << 16, BYTES // max(1, region))), max(1, 2 * BYTES // max(1, region))
        around, since, at = None, 0, 0
        while at < len(votes):
            to = min(len(votes), at + some)
            if to < len(votes):  # whole reads
                cut = int(np.searchsorted(votes[:, 0], votes[to, 0]))
                to = cut if cut > at else int(np.searchsorted(votes[:, 0], votes[at, 0], "right"))
            part = slice(at, to)
            row = pa.array(votes[part, 0])
            columns = [table.column(0).chunk(0).take(row), pa.array([chrom]).take(pa.array(np.zeros(len(row), np.int64))), pa.array(start[part]), pa.array(votes[part, 1]), pa.array(rank[part])]
            columns += [table.column(c).chunk(0).take(row) for c in carry]
            if region:
                if around is None or to > since + len(around):
                    around, since = _regions(files, low, high, start[at : max(to, at + many)], region, held), at
                columns.append(_strings(around[at - since : to - since]))
            batch = pa.RecordBatch.from_arrays(columns, names=["read_idx", "chrom", "start", "seeds", "cand_rank", *carry, *(["region"] if region else [])])
            batch = batch.filter(pa.compute.not_equal(batch.column(batch.num_columns - 1), "")) if region else batch
            yield finish[0](batch) if finish else batch
            at = to

    names = ", ".join(["read_idx long, chrom string, start long, seeds long, cand_rank int", *(f"{c} {kinds[c]}" for c in carry), *(["region string"] if region else [])])
    return _map(reads, k, keep, run, finish[1] if finish else names)
