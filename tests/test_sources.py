import gzip

import pytest
from pyspark.sql import functions as F

from strandmill.operators import pileup
from strandmill.sources import fastq, textfiles


def write_fastq(path, n, opener=open):
    # qualities that begin with @ or + and names of different length make splitting hard
    rows = [(f"@r{i}{'x' * (i % 7)}", "ACGTN"[i % 5] * (3 + i % 11), ("@" if i % 2 else "+") + "I" * (2 + i % 11)) for i in range(n)]
    with opener(path, "wt") as f:
        f.writelines(f"{a}\n{b}\n+\n{c}\n" for a, b, c in rows)
        f.write("@partial\nACGT\n")
    return rows


@pytest.mark.parametrize("split", [7, 64, 1 << 20])
def test_fastq_splits_lose_nothing(spark, tmp_path, split):
    rows = write_fastq(tmp_path / "a.fastq", 200)
    got = fastq.with_read_idx(fastq.read_fastq(spark, str(tmp_path / "a.fastq"), split)).orderBy("read_idx").collect()
    assert [(r.name, r.seq, r.qual) for r in got] == rows
    assert [r.read_idx for r in got] == list(range(200))


def test_fastq_gzip_and_empty(spark, tmp_path):
    rows = write_fastq(tmp_path / "a.fastq.gz", 50, gzip.open)
    assert fastq.read_fastq(spark, str(tmp_path / "*.gz")).count() == len(rows)
    (tmp_path / "e.fastq").write_text("")
    assert fastq.read_fastq(spark, str(tmp_path / "e.fastq")).count() == 0


def test_fastq_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, f"@n{i}", "ACGT", "IIII") for i in range(300)], "read_idx bigint, name string, seq string, qual string")
    out = textfiles.single_file(textfiles.fastq_lines(df.repartition(5)), str(tmp_path / "o.fastq"))
    got = fastq.with_read_idx(fastq.read_fastq(spark, out)).orderBy("read_idx").select("read_idx", "name", "seq", "qual")
    assert got.collect() == df.collect()
    assert got.select(fastq.bare_name().alias("b")).first().b == "n0"


def test_fasta(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">c1 first\nacgt\nAC\n>c2\r\nGG\r\n>empty\n>c1\nTTTT\n")
    got = {r.chrom: r.seq for r in textfiles.read_fasta(spark, str(tmp_path / "g.fa")).collect()}
    assert got == {"c1": "TTTT", "c2": "GG"}
    df = spark.createDataFrame([("c", "ACGT" * 50, 200)], "chrom string, seq string, length int")
    out = textfiles.single_file(textfiles.fasta_lines(df), str(tmp_path / "o.fa"))
    assert open(out).read().split("\n")[1] == ("ACGT" * 20)
    assert textfiles.read_fasta(spark, out).first().seq == "ACGT" * 50
    assert "".join(r.seq for r in textfiles.fasta_blocks(df, 64).orderBy("block_id").collect()) == "ACGT" * 50


def test_fasta_blocks_over_splits(spark, tmp_path):
    r = __import__("random").Random(4)
    contigs = {f"c{i}": "".join(r.choice("ACGTN") for _ in range(n)) for i, n in enumerate((1, 70, 31, 32, 33, 900, 2500))}
    text = ">c5\nAAAA\n>empty\n>\nGG\n" + "".join(f">{c} note\r\n" + "".join(s[i : i + 61].lower() + "\r\n" for i in range(0, len(s), 61)) for c, s in contigs.items())
    (tmp_path / "g.fa").write_text(text, newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        got = textfiles.read_fasta_blocks(spark, str(tmp_path / "g.fa"), 32).orderBy("chrom", "block_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    whole: dict = {}
    for x in got:
        whole.setdefault(x.chrom, []).append(x)
    assert {c: "".join(x.seq for x in rows) for c, rows in whole.items()} == contigs
    assert all([x.block_id for x in rows] == list(range(len(rows))) and all(len(x.seq) == 32 for x in rows[:-1]) for rows in whole.values())


def test_sam(spark, tmp_path):
    lines = ["@HD\tVN:1.6", "r1\t0\tc\t5\t60\t4M\t*\t0\t0\tACGT\tIIII\tNM:i:1\tAS:i:9", "short\t1", "r2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII", "r3\tx\tc\t1\t1\t1M\t*\t0\t0\tA\tI"]
    (tmp_path / "a.sam").write_text("\n".join(lines) + "\n")
    got = textfiles.read_sam(spark, str(tmp_path / "a.sam")).orderBy("line_no").collect()
    assert [(r.qname, r.flag) for r in got] == [("r1", 0), ("r2", 4), ("r3", None)]
    assert got[0].tags == {"NM": "1", "AS": "9"} and got[1].tags == {}
    sam = textfiles.read_sam(spark, str(tmp_path / "a.sam")).where("qname <> 'r3'")
    out = textfiles.single_file(textfiles.sam_lines(sam), str(tmp_path / "o.sam"), textfiles.sam_header([("c", 10)]))
    assert textfiles.read_sam(spark, out).count() == 2
    assert pileup.mapped(sam).count() == 1


def test_bed_and_per_base(spark, tmp_path):
    sites = spark.createDataFrame([("c", 3, 0.03125, 1, 31, 32), ("b", 9, 1.0, 5, 0, 5)], "chrom string, pos bigint, level double, meth_count bigint, unmeth_count bigint, coverage bigint")
    out = textfiles.single_file(textfiles.bed7_lines(sites), str(tmp_path / "o.bed"))
    assert open(out).read() == "b\t9\t10\t1.0000\t5\t0\t5\nc\t3\t4\t0.0312\t1\t31\t32\n"
    assert textfiles.read_bed(spark, out).where("coverage = 32").first().level == 0.0312
    rows = spark.createDataFrame([("c", 1, "+", 'I"', 2, "", 0, 0.0)], "chrom string, pos bigint, strand string, converted_quals string, converted_count bigint, unconverted_quals string, unconverted_count bigint, unconverted_rate double")
    path = textfiles.write_per_base(rows, str(tmp_path / "o.csv"))
    raw = open(path, "rb").read()
    assert raw.startswith(b"\xef\xbb\xbfref,pos") and b'c,1,+,"I""",2,"",0,0.000000' in raw


def test_results(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"results": [{"aligner": "a", "f1_score": 0.5}, {"aligner": "b", "f1_score": 0.25}]}')
    df = textfiles.read_results(spark, str(tmp_path / "r.json"))
    assert df.count() == 2
    textfiles.write_results(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/results_json")).agg(F.sum("f1_score")).first()[0] == 0.75
