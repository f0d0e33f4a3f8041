"""Places by pairs of seeds, by single seeds and by hand."""

import numpy as np
import pyarrow as pa
import pytest
from collections import Counter

from strandmill.operators import places


def by_hand(reads, genome, k, step, top):
    """(hits, offsets, top votes) of each read; letters as digits, 255 for none."""
    out = []
    for r in reads:
        votes, first = Counter(), {}
        for i, s in enumerate(range(0, len(r) - k + 1, step)):
            for p in range(len(genome) - k + 1):
                if list(genome[p : p + k]) == list(r[s : s + k]):
                    votes[p - s] += 1
                    first.setdefault(p - s, i)
        order = sorted((-n, first[o], o) for o, n in votes.items() if n > 1)[:top]
        out.append((sum(votes.values()), len(votes), [(-n, i, o) for n, i, o in order]))
    return out


@pytest.mark.parametrize("k,step", [(3, 1), (3, 2), (12, 5)])
@pytest.mark.parametrize("pairs", [True, False])
def test_votes(k, step, pairs):
    rng = np.random.default_rng(k * 10 + step)
    genome = rng.integers(0, 3 if k < 10 else 2, 300).astype(np.uint8)
    genome[150:] = genome[:150]  # repeats
    genome[[70, 71, 200]] = 255
    reads = [np.where(genome[a : a + 30] == 255, 1, genome[a : a + 30]) for a in rng.integers(0, 270, 20)] + [genome[280:300], genome[:k]]
    codes, ok = np.zeros((len(reads), (30 - k) // step + 1), np.uint32), np.zeros((len(reads), (30 - k) // step + 1), bool)
    for j, r in enumerate(reads):
        c = places.codes(r, k)[::step]
        codes[j, : len(c)], ok[j, : len(c)] = c, True
    want = by_hand(reads, genome, k, step, 5)
    for cut in (300, 128):
        total, votes = np.zeros((2, len(reads)), np.int64), np.zeros((0, 4), np.int64)
        for at in range(0, 300, cut):
            to = min(300, at + cut)
            h, r, v = places.span_votes(codes, ok, genome[at : min(300, to + 30)], to - at, k, step, 5, 2, at == 0, to == 300, pairs)
            total += [h, h - r]
            v[:, 3] += at
            votes = places.merged(votes, v, 5)
        got = [(*total[:, j].tolist(), [tuple(x) for x in votes[votes[:, 0] == j, 1:].tolist()]) for j in range(len(reads))]
        assert got == want


@pytest.mark.parametrize("k,step", [(3, 1), (4, 2), (3, 4), (6, 5), (8, 8)])
def test_offsets_by_pairs_without_an_equal_seed_between(monkeypatch, k, step):
    rng = np.random.default_rng(k * 10 + step)
    genome = rng.choice(list(b"ACGT"), 320).astype(np.uint8)
    genome[160:] = genome[:160]
    genome[[200, 215, 230]] = ord("A")
    genome[64:96] = 0  # a block that is missing
    genome[310:] = 0
    reads = [np.where(genome[a : a + 40] == 0, ord("C"), genome[a : a + 40]) for a in rng.integers(0, 280, 20)] + [genome[296:310], genome[:k]]
    monkeypatch.setattr(places, "letters", lambda files, start, end: genome[start:end])
    digits = places.digit_table("ct")
    want = [x[:2] for x in by_hand([digits[r] for r in reads], np.where(genome == 0, 255, digits[genome]), k, step, 1)]
    seqs = pa.array([r.tobytes().decode() for r in reads])
    for span in (1 << 22, 64):
        monkeypatch.setattr(places, "SPAN", span)
        for chains in (True, False):
            hits, offsets = places._counted([], 0, 9, seqs, k, step, "ct", chains)
            assert list(zip(hits.tolist(), offsets.tolist())) == want


@pytest.mark.parametrize("k,step", [(3, 1), (4, 2)])
def test_neighbours_are_looked_up_only_where_they_can_count(monkeypatch, k, step):
    rng = np.random.default_rng(k)
    genome = rng.choice(list(b"ACGT"), 640).astype(np.uint8)
    genome[320:] = genome[:320]
    genome[[350, 415, 430]] = ord("A")
    genome[64:96] = 0
    reads = [np.where(genome[a : a + 18] == 0, ord("C"), genome[a : a + 18]) for a in rng.integers(0, 620, 40)] + [genome[626:640], genome[:k]]
    monkeypatch.setattr(places, "letters", lambda files, start, end: genome[start:end])
    own, found, sizes = places.digit_table("ct"), places._found, []
    want = [x[2] for x in by_hand([own[r] for r in reads], np.where(genome == 0, 255, own[genome]), k, step, 5)]

    def counted(*given):
        for q in found(*given):
            sizes.append(len(q))
            yield q

    monkeypatch.setattr(places, "_found", counted)
    seeds = places._seeds(pa.array([r.tobytes().decode() for r in reads]), k, step, "ct")
    total = {}
    for span in (1 << 22, 160, 64):
        monkeypatch.setattr(places, "SPAN", span)
        sizes.clear()
        votes = places._whole([], 0, 19, *seeds, k, step, "ct", 5, 2, True)[2]
        assert [[tuple(x) for x in votes[votes[:, 0] == j, 1:].tolist()] for j in range(len(reads))] == want
        total[span] = sum(sizes)
    assert total[64] < 0.95 * total[1 << 22]


def test_reads_need_all_their_blocks(spark, tmp_path):
    from oracle import compare
    from strandmill.plans import oracles, views

    ids = [i for i in range(100) if i not in (0, 13, 14, 40, 57, 79)]
    spark.createDataFrame([(i,) for i in ids], "p_partkey long").coalesce(1).write.parquet(f"{tmp_path}/part")
    spark.createDataFrame([(i, i % 7) for i in range(3000)], "event_id long, user_id long").coalesce(1).write.parquet(f"{tmp_path}/events")
    (tmp_path / "d").mkdir()
    for name in ("part", "events"):
        next((tmp_path / name).glob("*.parquet")).rename(tmp_path / "d" / f"{name}.parquet")
    compare(spark, str(tmp_path / "d"), lambda s, d: views.genome_reads(s, d), f"with {oracles.GREADS} select read_idx, start0, seq from gr")


def test_model_filter_writes_its_rows_once(spark, monkeypatch):
    from strandmill.operators import correct

    tags, own = [], correct.materialize
    monkeypatch.setattr(correct, "materialize", lambda df, tag: tags.append(tag) or own(df, tag))
    rows = [(i, 50 if i % 2 else 10, "50M", 0, 0, "ACGT" * 12, "I" * 48) for i in range(40)]
    sam = spark.createDataFrame(rows, "line_no long, mapq int, cigar string, tlen int, flag int, seq string, qual string")
    labels = spark.createDataFrame([(i, float(i % 2 == 0)) for i in range(20)], "line_no long, label double")
    assert sorted(r.line_no for r in correct.model_filter(sam, labels).collect()) == list(range(1, 40, 2))
    assert tags == ["features"]


def test_compared(spark):
    from strandmill.operators import align

    df = spark.createDataFrame([(1, "ACGTT", "ACGCA"), (2, "TTAC", "CTA"), (3, "CG", "TG")], "read_idx long, seq string, region string")
    assert [tuple(r) for r in align.compared(df, "mismatches").orderBy("read_idx").collect()] == [(1, 1), (2, 2), (3, 1)]
    assert [tuple(r) for r in align.compared(df, "score").orderBy("read_idx").collect()] == [(1, 2), (2, 2), (3, 1)]


def arrow_steps(df):
    return df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")


def test_gapped_scores_stay_in_the_task(spark, data):
    # regions of candidates are scored where they are found; one row a read leaves the task
    from strandmill.plans import queries

    assert arrow_steps(queries.align_reads(spark, data)) == 1


def test_hits_are_counted_without_a_shuffle(spark, data):
    from strandmill.plans import queries

    plan = queries.seed_hits(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan.partition("MapInArrow")[0]


def test_mismatches_are_counted_where_candidates_are_found(spark, data):
    from strandmill.plans import queries

    df = queries.conv_mismatches(spark, data)
    assert arrow_steps(df) == 1 and df.columns == ["read_idx", "cand_rank", "mismatches"]


def test_parts_of_candidates(spark, monkeypatch):
    """Spans, groups of regions and batches decide how candidates come, not which."""
    from strandmill.operators import align

    rng = np.random.default_rng(3)
    genome = "".join(rng.choice(list("ACGT"), 640)) + "".join(rng.choice(list("ACGT"), 10))
    genome = genome[:320] * 2 + genome[640:]
    blocks = spark.createDataFrame([(i, genome[32 * i : 32 * i + 32]) for i in range(21)], "block_id long, seq string")
    reads = spark.createDataFrame([(i, genome[a : a + 50].replace("C", "T")) for i, a in enumerate(rng.integers(0, 590, 40).tolist())], "read_idx long, seq string")
    every = lambda: sorted(map(tuple, places.candidates(reads, blocks, len(genome), 50, 6, 5, region=90).collect()))
    scored = lambda: sorted(map(tuple, align.align(reads, blocks, len(genome), 50, 6).collect()))
    found, best = every(), scored()
    assert {r[6] for r in found} <= {genome[r[2] : r[2] + 90] for r in found} and len(best) == 40
    # the candidates' own scores, the better candidate on ties
    told = dict(zip([(r[0], r[4]) for r in found], align.local_scores([r[5] for r in found], [genome[r[2] : r[2] + 150] for r in found]).tolist()))
    assert [(r[0], r[3], r[4]) for r in best] == [max(((i, c, s) for (i, c), s in told.items() if i == j), key=lambda x: (x[2], -x[1])) for j in range(40)]
    for size in (1, 90 * 7, 90 * 40):
        # functions of tasks are sent with this module's own numbers
        run = places._map
        monkeypatch.setattr(places, "_map", lambda r, k, keep, f, schema, n=size: run(r, k, keep, small(f, n), schema))
        assert every() == found and scored() == best
        monkeypatch.setattr(places, "_map", run)


def small(f, size):
    def g(table):
        from strandmill.operators import places as there

        there.BYTES, there.SPAN, own = size, 64, (there.BYTES, there.SPAN)
        try:
            yield from f(table)
        finally:
            there.BYTES, there.SPAN = own

    return g
