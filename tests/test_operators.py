import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandmill.functions import conversion, sequence
from strandmill.operators import adapters, align, correct, evaluate, pileup, qc, sampling, simulate, umi
from strandmill.plans import pipeline, report
from strandmill.config import Settings, overlay


def dna(r, n):
    return "".join(r.choice("ACGT") for _ in range(n))


def test_conversion_parse():
    for text, tag in {"C>T": "ct", "c->t": "ct", "A_G": "ag", "g - a": "ga", "TC": "tc", "a-to-g": "at", "c-to-t": "ct", "A-to-G": "at"}.items():
        assert conversion.parse_conversion(text).tag == tag
    assert len(conversion.REGISTRY) == 12 and conversion.REGISTRY["ct"].complement_converted == "A"
    for bad in ("a2g", "x", "", "cc"):
        with pytest.raises(ValueError):
            conversion.parse_conversion(bad)


def walk(cigar, pos, seq, emit, ref_ops, read_ops):
    import re

    out, ref, read = [], pos - 1, 0
    for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar):
        n = int(n)
        if op in emit:
            out += [(ref + j, seq[read + j]) for j in range(n) if read + j < len(seq)]
        ref += n if op in ref_ops else 0
        read += n if op in read_ops else 0
    return [(i, *x) for i, x in enumerate(out)]


def test_cigar_expansion(spark):
    cigars = ["10M", "3S4M2S", "2M2I4M", "3M2D5M", "2M3N4M", "5=3X", "2H8M2H", "3P4M", "20M", "0M4M", "*", "4M0I4M", "1S2M1I2D1N3M5S"]
    r = random.Random(3)
    rows = [(i, c, 7 + i, dna(r, 10)) for i, c in enumerate(cigars)]
    sam = spark.createDataFrame(rows, "line_no int, cigar string, pos int, seq string")
    for emit, ref, read in (("M=X", "MDN=X", "MIS=X"), ("M", "MDN", "MIS")):
        got = sorted(tuple(x) for x in sequence.aligned_bases(sam, ["line_no"], emit, ref, read).collect())
        assert got == sorted((i, *x) for i, c, p, s in rows for x in walk(c, p, s, emit, ref, read))


def trim_plain(seq, adapter):
    for i in range(len(seq) - 5):
        o = min(len(seq) - i, len(adapter))
        m = sum(a == b for a, b in zip(seq[i : i + o], adapter))
        if m >= 6 and 1 - m / o <= 0.1:
            return i
    return None


def test_adapter_trim(spark):
    r, ad = random.Random(5), adapters.ADAPTERS["illumina_universal"]
    seqs = ["", "ACG", ad, ad[:6], ad[1:], None] + [dna(r, 30) + ad[: r.randint(4, 13)] for _ in range(60)] + [dna(r, 20) + ad.replace("C", "T") + dna(r, 5) for _ in range(20)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "read_idx int, seq string")
    got = {x.read_idx: x.cut_at for x in adapters.trim(df, ad).collect()}
    for i, s in enumerate(seqs):
        cuts = [c for c in (trim_plain(s, ad), trim_plain(s, ad.replace("C", "T"))) if c is not None] if s else []
        assert got[i] == (min(cuts) if cuts else None), (i, s)


def score_plain(read, ref, m):
    """Three matrices, cell by cell; gaps that skip reference bases are one long."""
    low, best = -(10**9), 0
    M, X, Y = ([[v] * (len(ref) + 1) for _ in range(len(read) + 1)] for v in (0, low, low))
    for i in range(1, len(read) + 1):
        for j in range(1, len(ref) + 1):
            M[i][j] = max(0, max(M[i - 1][j - 1], X[i - 1][j - 1], Y[i - 1][j - 1]) + int(m["ACGT".index(ref[j - 1]), "ACGT".index(read[i - 1])]))
            best = max(best, M[i][j])
        for j in range(1, len(ref) + 1):
            X[i][j] = M[i][j - 1] - 4
            Y[i][j] = max(M[i - 1][j] - 4, Y[i - 1][j] - 1)
    return best


def test_local_scores():
    r = random.Random(7)
    pairs = []
    for _ in range(30):
        ref = dna(r, r.randint(20, 60))
        a = r.randint(0, 10)
        read = list(ref[a : a + 15])
        for _ in range(r.randint(0, 3)):
            k = r.randrange(len(read))
            read[k : k + 1] = r.choice([[], [r.choice("ACGT")], [read[k], r.choice("ACGT"), r.choice("ACGT")]])
        pairs.append(("".join(read), ref))
    m = align.score_matrix("ct")
    assert align.local_scores(*zip(*pairs)).tolist() == [score_plain(a, b, m) for a, b in pairs]
    assert align.local_scores([], []).tolist() == []


def test_local_scores_in_any_integers():
    # of all bytes and lengths: the kind of integers follows the reads
    r = random.Random(8)
    for size in (60, 99, 140):
        ref = dna(r, size + 20)
        pairs = [(ref[10 : 10 + n], ref) for n in (0, 1, 30, size)] + [(ref[10:40] + "A" + ref[40:size], ref), ("acgtn", "ACGTA"), ("ACG", "")]
        for conversion in ("ct", "ag", "gt"):
            m = align.score_matrix(conversion)
            want = [score_plain(a.upper().replace("N", "A"), b, m) for a, b in pairs]
            assert align.local_scores(*zip(*pairs), conversion).tolist() == want
            assert align.local_scores(*(pa.array(x) for x in zip(*pairs)), conversion).tolist() == want


def test_aligner_finds_true_place(spark):
    made = simulate.simulate_reads(spark, 4000, 60, 60, conversion_rate=0.0, error_rate=0.01, mode="se")
    g = made["genome"]
    hits = align.align(made["reads"], pipeline.blocks_of(g), 4000, 60, 12)
    assert hits.count() >= 50
    sam = align.to_sam(made["reads"], hits)
    assert sam.count() == 60 and sam.where("flag = 4").count() == 60 - hits.count()
    calls = pileup.call_ref_anchored(sam, g)
    assert calls.where("coverage < meth_count + unmeth_count").count() == 0


def test_pipeline_runs(spark):
    s = overlay(Settings(), {"simulation": {"genome_length": 3000, "num_reads": 150, "read_length": 50}})
    got = pipeline.run_simulated(spark, s).collect()
    assert sorted(r["rank"] for r in got) == [1, 2, 3, 4, 5]
    with pytest.raises(AttributeError):
        overlay(Settings(), {"no_such": 1})


def test_ranking_fixture(spark):
    rows = [("B", 0.8242), ("A", 0.9247), ("C", 0.7241)]
    got = evaluate.ranked(spark.createDataFrame(rows, "aligner string, f1_score double")).orderBy("rank").collect()
    assert [r.aligner for r in got] == ["A", "B", "C"]


def test_metrics_edges(spark):
    truth = spark.createDataFrame([("c", i, i % 2) for i in range(6)], "chrom string, pos bigint, methylated int")
    calls = spark.createDataFrame([("x", "c", 1, 0.9), ("x", "c", 3, 0.1), ("x", "c", 2, 0.5), ("y", "c", 99, 0.9)], "aligner string, chrom string, pos bigint, level double")
    m = {r.aligner: r for r in evaluate.with_status(spark.createDataFrame([("x",), ("y",), ("z",)], "aligner string"), calls, truth).collect()}
    assert (m["x"].tp, m["x"].fp, m["x"].tn, m["x"].fn, m["x"].status) == (1, 0, 1, 1, "ok")
    assert m["y"].status == "no_overlap" and m["z"].status == "no_output"
    one = evaluate.level_correlation(calls.where("pos = 1"), truth, ["aligner"]).collect()
    assert one[0].level_correlation is None


def test_sampling(spark):
    df = spark.range(500).withColumnRenamed("id", "read_idx").withColumn("seq", F.lit("A"))
    a = {r.read_idx for r in sampling.sample_reads(df, 50).collect()}
    assert len(a) == 50 and a == {r.read_idx for r in sampling.sample_reads(df.repartition(7), 50).collect()}
    assert a != {r.read_idx for r in sampling.sample_reads(df, 50, seed=1).collect()}
    assert sampling.sample_reads(df, 9999).count() == 500
    assert sampling.sample_percent(df, 0.01).count() == 1 and sampling.sample_percent(df.limit(0), 5).count() == 0
    assert {r.read_idx for r in sampling.sample_percent(df, 10).collect()} == a
    assert sampling.sample_pairs(df, df.where("read_idx < 20"), 50).count() == 20
    assert sampling.head(df, 7).count() == 7


def test_umi(spark):
    rows = [(0, "acgt"), (1, "ACGT"), (2, None), (3, "AC"), (4, "AC-T"), (5, " ACGT ")]
    df = spark.createDataFrame(rows, "read_idx bigint, umi string").withColumn("umi", umi.standard(F.col("umi")))
    assert {(r.read_idx, r.umi) for r in umi.dedup(df).collect()} == {(0, "ACGT"), (4, "ACNT")}
    s = umi.stats(df).first()
    assert (s.reads_with_umi, s.unique_umis, s.duplicate_groups, s.singleton_groups, s.duplication_rate) == (4, 2, 1, 1, 0.5)
    assert umi.stats(df.limit(0)).first().duplication_rate == 0.0
    names = [("@r BX:Z:acgtn", "acgtn"), ("@a:1:2:3:4:5:6 1:N:0:ACGTACGT", "ACGTACGT"), ("@read_ACGTACGT 1", "ACGTACGT"), ("@plain", None)]
    got = spark.createDataFrame(names, "name string, want string").withColumn("got", umi.from_header(F.col("name"))).collect()
    assert all(r.got == r.want for r in got)


def test_quality(spark):
    df = spark.createDataFrame([(0, "ACGTN", "IIIII"), (1, "GG", "!!"), (2, "ACGTACGT", "55555555")], "read_idx int, seq string, qual string")
    t = qc.totals(df).first()
    assert (t.total_reads, t.total_bases) == (3, 15)
    assert qc.length_summary(df).first().n50 == 8
    assert {(r.mean_quality, r.reads) for r in qc.read_quality(df).collect()} == {(40, 1), (0, 1), (20, 1)}
    p = {r.position: r for r in qc.per_base_quality(df).collect()}
    assert (p[0].med, p[0].min, p[0].max) == (20, 0, 40)
    assert "<h1>" in report.quality_report(df)


def test_sequence_columns(spark):
    df = spark.createDataFrame([("ACGTN",), ("",), ("acgt",)], "s string")
    got = df.select(sequence.reverse_complement(F.col("s")).alias("r"), conversion.three_letter_code(F.col("s"), "ct").alias("d"), sequence.words_2bit(F.col("s")).alias("w")).collect()
    assert got[0].r == "NACGT" and got[0].d == "01210" and [int(x) for x in got[0].w] == [0b0011100100 ]
    assert got[1].d == "" and list(got[1].w) == []
    full = spark.createDataFrame([("T" * 32,)], "s string").select(sequence.words_2bit(F.col("s")).alias("w")).first().w
    assert int(full[0]) == 2**64 - 1


def test_correction(spark):
    rows = [(0, 30, "50M", "=", 200, "chr", "C" * 2), (1, 10, "30S20M", "other", 200, "chr", "C" * 4), (2, 30, "6S4M", "chr", -2000, "chr", "A" * 10), (3, 30, "*", "*", 0, "chr", "")]
    sam = spark.createDataFrame(rows, "line_no int, mapq int, cigar string, rnext string, tlen int, rname string, seq string")
    ids = lambda df: sorted(r.line_no for r in df.collect())
    assert ids(correct.filter_mapq(sam)) == [0, 2, 3]
    assert ids(correct.filter_pair(sam)) == [0, 3]
    assert ids(correct.filter_clip(sam)) == [0, 3]
    kept, rejected = correct.split_unconverted(sam)
    assert ids(kept) == [0, 2, 3] and ids(rejected) == [1]
    motifs = spark.createDataFrame([("ACGC",), ("AAA",), ("TTT",)], "m string")
    assert [r.m for r in correct.match_iupac(motifs, "m", "CGY, AAA").collect()] == ["ACGC", "AAA"]
    assert correct.flank_for(100) == 1


def test_simulation_is_repeatable(spark):
    a = simulate.simulate_reads(spark, 2000, 40, 50, mode="pe")
    b = simulate.simulate_reads(spark, 2000, 40, 50, mode="pe")
    rows = lambda x: sorted(map(tuple, x["reads"].collect()))
    assert rows(a) == rows(b) and len(rows(a)) == 80
    assert all(len(r[3]) == len(r[4]) == 50 for r in rows(a))
    rate = np.mean([r.methylated for r in a["truth"].collect()])
    assert 0.6 < rate < 0.8


def test_large_samples_match_the_ordered_draw(spark, monkeypatch):
    from strandmill.operators import sampling

    df = spark.range(5000).withColumnRenamed("id", "read_idx")
    small = {r.read_idx for r in sampling.sample_reads(df, 700).collect()}
    monkeypatch.setattr(sampling, "ONE_TASK", 10)
    assert {r.read_idx for r in sampling.sample_reads(df, 700).collect()} == small
    assert sampling.sample_reads(df, 9000).count() == 5000


def test_quality_by_ordinal_or_read_offset(spark):
    sam = spark.createDataFrame([(1, 0, "c", 1, "2S3M", "GGCTC", "!!5&+")], "line_no bigint, flag int, rname string, pos bigint, cigar string, seq string, qual string")
    got = {o: [(r.pos, r.converted_quals, r.unconverted_quals) for r in pileup.per_base(sam, by_read_offset=o).orderBy("pos").collect()] for o in (False, True)}
    assert got[False] == [(1, "", "!"), (2, "!", ""), (3, "", "5")]
    assert got[True] == [(1, "", "5"), (2, "&", ""), (3, "", "+")]


def test_deep_site_in_parts(spark, monkeypatch):
    monkeypatch.setattr(pileup, "LINES", 4)
    rows = [(i, 0, "c", 1, "1M", "C" if i % 3 else "T", chr(40 + i)) for i in range(20)]
    sam = spark.createDataFrame(rows, "line_no bigint, flag int, rname string, pos bigint, cigar string, seq string, qual string").repartition(5)
    r = pileup.per_base(sam).first()
    assert r.unconverted_quals == "".join(chr(40 + i) for i in range(20) if i % 3) and r.converted_quals == "".join(chr(40 + i) for i in range(0, 20, 3))
    assert (r.unconverted_count, r.converted_count) == (13, 7)


def test_mates_have_their_own_adapters(spark):
    one, two = adapters.ADAPTERS["illumina_universal"], adapters.ADAPTERS["nextera"]
    rows = [(1, 1, "ACGTACGT" + one), (1, 2, "GGTTGGTT" + two), (2, 2, "GGTTGGTT" + one), (3, None, None)]
    df = spark.createDataFrame(rows, "read_idx int, mate int, seq string")
    cut = lambda **k: {(r.read_idx, r.mate): r.seq for r in adapters.trim_mates(df, one, **k).collect()}
    assert cut(second=two) == {(1, 1): "ACGTACGT", (1, 2): "GGTTGGTT", (2, 2): "GGTTGGTT" + one, (3, None): None}
    assert cut()[2, 2] == "GGTTGGTT"


def test_umi_layout_from_all_reads(spark):
    r = random.Random(2)
    rows = [("head", i, f"@r{i}_{dna(r, 10 if i % 4 else 9)} x", "A" * 20) for i in range(300)]
    rows += [("front", i, f"@q{i}", dna(r, 8) + "A" * 12) for i in range(300)] + [("back", i, f"@q{i}", "A" * 12 + dna(r, 8)) for i in range(300)] + [("none", i, None, "A" * 20) for i in range(300)]
    df = spark.createDataFrame(rows, "library string, read_idx bigint, name string, seq string")
    got = {x.library: (x.location, x.pattern, x.length) for x in umi.detect(df).collect()}
    assert got == {"head": ("header", "simple", 10), "front": ("inline_5prime", None, None), "back": ("inline_3prime", None, None), "none": ("none", None, None)}


def test_two_bit_words_round_trip(spark):
    r = random.Random(3)
    rows = [(i, dna(r, n)) for i, n in enumerate((0, 1, 31, 32, 33, 64, 100))]
    df = spark.createDataFrame(rows, "i int, s string")
    got = df.select("i", sequence.bases_2bit(sequence.words_2bit(F.col("s")), F.length("s")).alias("t")).collect()
    assert {x.i: x.t for x in got} == dict(rows)
    assert [align.seed_length_for(g) for g in (100, 3**8 + 1, 3 * 10**9)] == [8, 9, 20]
