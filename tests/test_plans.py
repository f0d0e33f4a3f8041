"""Tables of a row a base are never broadcast, whatever Spark makes of their size."""

from strandmill.functions import sequence
from strandmill.operators import correct, pileup
from strandmill.plans import roundtrips, views


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_calls_do_not_broadcast_the_genome(spark, data):
    assert "BroadcastHashJoin" not in plan_of(pileup.call_ref_anchored(views.sam(spark, data), views.genome(spark, data)))


def test_scanned_calls_do_not_broadcast_the_genome(spark, data, monkeypatch):
    seen = []
    monkeypatch.setattr(roundtrips, "written", lambda lines, **o: seen.append(plan_of(lines)) or "/nowhere")
    monkeypatch.setattr(roundtrips.textfiles, "read_bed", lambda *a: None)
    roundtrips.bed7_scan(spark, data)
    assert "BroadcastHashJoin" not in seen[0]


def test_motifs_do_not_broadcast_the_genome(spark, data):
    assert "BroadcastHashJoin" not in plan_of(correct.site_motifs(views.truth(spark, data), views.genome(spark, data), 1))


def test_motifs_across_runs_and_gaps(spark):
    letters = {p: "ACGT"[p * 7 % 4] for p in range(200) if p not in (40, 41, 64)}
    g = spark.createDataFrame([("c", p, b) for p, b in letters.items()], "chrom string, pos bigint, base string")
    sites = g.select("chrom", "pos").union(spark.createDataFrame([("c", 1000), ("d", 5)], "chrom string, pos bigint"))
    for flank in (0, 1, 3, 40):
        want = {p: "".join(letters.get(q, "") for q in range(p - flank, p + flank + 1)) for p in letters}
        assert {r.pos: r.motif for r in correct.site_motifs(sites, g, flank).collect()} == want


def test_motifs_at_great_positions(spark):
    letters = {(1 << 57) + p: "ACGT"[p * 7 % 4] for p in range(100) if p != 40}
    g = spark.createDataFrame([("c", p, b) for p, b in letters.items()], "chrom string, pos bigint, base string")
    want = {p: "".join(letters.get(q, "") for q in range(p - 1, p + 2)) for p in letters}
    assert {r.pos: r.motif for r in correct.site_motifs(g.select("chrom", "pos"), g, 1).collect()} == want


def test_calls_by_hand_across_runs(spark):
    genome = {("c", p): "CCAGTC"[p * 5 % 6] for p in range(300) if p not in (70, 71)} | {("d", p): "C" for p in range(10)}
    g = spark.createDataFrame([(*at, b) for at, b in genome.items()], "chrom string, pos bigint, base string")
    text = "CTTACGCNTC" * 20
    rows = [(k, "cd"[i % 9 == 0], 4 if i % 7 == 0 else 0, 1 + i * 13 % 290, cigar, text[i : i + n]) for i, (k, cigar, n) in enumerate([("a", "50M", 50), ("b", "10S20M3I70M", 103), ("a", "5M4D60M2N9M", 74), ("b", "150M", 80), ("a", "10=5M5X5M", 25), ("b", "64M64M", 128)] * 8)]
    rows += [("a", "c", 0, -5, "20M", text[:20]), ("a", "c", 0, 64, "1M", "C"), ("b", None, 0, 5, "9M", text[:9])]
    sam = spark.createDataFrame(rows, "sample string, rname string, flag int, pos bigint, cigar string, seq string")
    bases = sequence.aligned_bases(pileup.mapped(sam), ["sample", "rname"], emit="M", ref_ops="MDN", read_ops="MIS").collect()
    for keys in ((), ("sample",)):
        want = {}
        for b in bases:
            if genome.get((b.rname, b.ref_pos)) == "C":
                n = want.setdefault((*(b[k] for k in keys), b.rname, b.ref_pos), [0, 0, 0])
                n[0] += b.base == "C"
                n[1] += b.base == "T"
                n[2] += 1
        got = {(*(r[k] for k in keys), r.chrom, r.pos): [r.meth_count, r.unmeth_count, r.coverage] for r in pileup.call_ref_anchored(sam, g, "ct", keys).collect()}
        assert got == want and len(got) > 50


def test_reads_meet_the_genome_in_pieces(spark, data):
    # the join sees a row a piece of a read, bases come after it
    plan = plan_of(pileup.call_ref_anchored(views.sam(spark, data), views.genome(spark, data)))
    assert "LeftSemi" not in plan and plan.index("explode(filter(") < plan.index("SortMergeJoin")
