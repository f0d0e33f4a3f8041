import json
import os
import random

import pytest
from pyspark.sql import functions as F

from strandmill import config
from strandmill.__main__ import main
from strandmill.operators import adapters, simulate
from strandmill.plans import pipeline
from strandmill.sources import textfiles


def two_contigs(seed=1):
    r = random.Random(seed)
    return {c: "".join(r.choice("ACGT") for _ in range(n)) for c, n in (("c1", 700), ("c2", 517))}


def cut_reads(contigs, n=80, length=60, seed=2):
    """(read_idx, chrom, start, seq): fully converted at every other C."""
    r, rows = random.Random(seed), []
    for i in range(n):
        c = r.choice(sorted(contigs))
        at = r.randrange(len(contigs[c]) - length)
        rows.append((i, c, at, "".join("T" if b == "C" and (at + k) % 2 else b for k, b in enumerate(contigs[c][at : at + length]))))
    return rows


def frames(spark, rows, contigs, **extra):
    data = [(i, 1, f"@r{i}_{'ACGTACGT' if i % 4 == 0 else 'TTGACC' + 'ACGT'[i % 4] + 'ACGT'[i // 4 % 4]} x", s, "I" * len(s), f"s{i % 2}") for i, _, _, s in rows]
    reads = spark.createDataFrame(data, "read_idx bigint, mate int, name string, seq string, qual string, sample string")
    genome = spark.createDataFrame([(c, s, len(s)) for c, s in contigs.items()], "chrom string, seq string, length int")
    truth = spark.createDataFrame([(c, k, (k + 1) % 2) for c, s in contigs.items() for k, b in enumerate(s) if b == "C"], "chrom string, pos bigint, methylated int")
    return reads, genome, truth


def test_contigs_on_one_axis(spark):
    contigs = two_contigs()
    rows = cut_reads(contigs)
    reads, genome, truth = frames(spark, rows, contigs)
    done = pipeline.run(spark, reads, genome, truth, config.Settings())
    sam = {r.line_no: (r.rname, r.pos - 1) for r in done["sam"].where("flag = 0").collect()}
    assert len(sam) >= 78 and all(sam[i] == (c, at) for i, c, at, _ in rows if i in sam)
    scores = {r.sample: r for r in done["scores"].collect()}
    assert set(scores) == {"s0", "s1"} and all(r.status == "ok" and r.f1_score > 0.98 for r in scores.values())
    assert done["ranking"].count() == 1


def test_sample_without_calls_and_empty_input(spark):
    contigs = two_contigs()
    reads, genome, truth = frames(spark, cut_reads(contigs, 20), contigs)
    odd = reads.limit(1).withColumn("read_idx", F.lit(1000).cast("bigint")).withColumn("sample", F.lit("none")).withColumn("seq", F.lit("GGGGGGGGGGGGGGG"))
    done = pipeline.run(spark, reads.unionByName(odd).unionByName(odd.withColumn("seq", F.lit(None).cast("string"))), genome, truth, config.Settings())
    assert {r.sample: r.status for r in done["scores"].collect()} == {"s0": "ok", "s1": "ok", "none": "no_output"}
    assert pipeline.run(spark, reads.limit(0), genome, truth, config.Settings())["calls"].count() == 0


def test_preprocessing_and_strategies(spark):
    contigs = two_contigs()
    rows = [(i, c, at, s + adapters.ADAPTERS["illumina_universal"]) for i, c, at, s in cut_reads(contigs, 60)]
    reads, genome, truth = frames(spark, rows, contigs)
    given = {"adapters": {"trim": True}, "umi": {"dedup": True, "location": "header"}, "correction": {"strategies": ["mapq", "clip", "pair", "unconverted", "consensus", "context"], "max_unconverted": 8}}
    s = config.overlay(config.Settings(), given)
    ready = pipeline.preprocess(reads.withColumn("mate", F.lit(1)), s).collect()
    assert all(len(r.seq) <= 60 for r in ready)
    umis = {(i % 2, "ACGTACGT" if i % 4 == 0 else (i % 4, i // 4 % 4)) for i in range(60)}
    assert len(ready) == len(umis)
    done = pipeline.run(spark, reads, genome, truth, s)
    kept, rejected = done["sam"].count(), done["rejected"].count()
    assert kept + rejected == len(ready) and done["sam"].where("length(seq) - length(replace(seq, 'C', '')) > 8").count() == 0
    assert done["calls"].where("level < 0 or level > 1").count() == 0
    with pytest.raises(ValueError, match="strategy"):
        pipeline.correct_reads(done["sam"], config.overlay(s, {"correction": {"strategies": ["other"]}}))


def test_run_on_files(spark, tmp_path):
    made = simulate.simulate_reads(spark, 3000, 120, 50, mode="pe", error_rate=0.0)
    for m in (1, 2):
        textfiles.single_file(textfiles.fastq_lines(made["reads"].where(F.col("mate") == m)), f"{tmp_path}/r{m}.fastq")
    truth = made["truth"].orderBy("pos").select(F.concat_ws("\t", "chrom", F.col("pos").cast("string"), (F.col("pos") + 1).cast("string"), F.col("methylated").cast("string")).alias("value"))
    textfiles.single_file(truth, f"{tmp_path}/truth.bed")
    bases = "".join(r.base for r in made["genome"].orderBy("pos").collect())
    (tmp_path / "g.fa").write_text(f">chr_sim\n{bases}\n")
    config.write({"correction": {"strategies": ["mapq", "unconverted"], "max_unconverted": 20}}, f"{tmp_path}/s.json")
    out = tmp_path / "out"
    assert main(["run", "--config", f"{tmp_path}/s.json", "--reads", f"{tmp_path}/r1.fastq", "--reads2", f"{tmp_path}/r2.fastq", "--reference", f"{tmp_path}/g.fa", "--truth", f"{tmp_path}/truth.bed", "--out", str(out)]) == 0
    flags = {int(line.split("\t")[1]) for p in (out / "sam").glob("part-*") for line in p.read_text().splitlines()}
    assert flags <= {77, 99, 147} and 99 in flags
    scores = [json.loads(x) for p in (out / "results_json").glob("part-*") for x in p.read_text().splitlines()]
    assert scores[0]["sample"] == "all" and scores[0]["f1_score"] > 0.8
    assert "<h1>Results</h1>" in (out / "report.html").read_text() and "Totals" in (out / "quality.html").read_text()
    assert textfiles.read_bed(spark, str(out / "calls")).count() > 100


def test_scanned_outputs_beside_the_own_aligner(spark, tmp_path):
    contigs = two_contigs()
    reads, genome, truth = frames(spark, cut_reads(contigs), contigs)
    reads = reads.withColumn("sample", F.lit("one"))
    done = pipeline.run(spark, reads, genome, truth, config.Settings())
    sam = textfiles.single_file(textfiles.sam_lines(done["sam"].drop("AS")), f"{tmp_path}/a.sam")
    bed = textfiles.single_file(textfiles.bed7_lines(done["calls"].where("coverage > 1")), f"{tmp_path}/a.bed")
    both = pipeline.run(spark, reads, genome, truth, config.Settings(), others=(pipeline.Scanned("by_sam", sam=sam), pipeline.Scanned("by_bed", bed=bed)))
    rows = {r.aligner: r for r in both["scores"].collect()}
    assert rows["by_sam"].f1_score == rows["seed_extend"].f1_score and rows["by_bed"].sites_called < rows["by_sam"].sites_called
    assert {r.aligner for r in both["ranking"].collect()} == {"seed_extend", "by_sam", "by_bed"}


def test_batch_and_report(spark, tmp_path):
    path = config.write(config.batch(4), f"{tmp_path}/b.json")
    samples = config.load_batch(path)
    assert [w["group"] for w, _ in samples] == ["control", "control", "treated", "treated"] and samples[1][1].conversion == "ag"
    small = [(w, config.overlay(s, {"simulation": {"genome_length": 1500, "num_reads": 60, "read_length": 50}})) for w, s in samples[:2]]
    broken = ({"sample": "bad", "group": "treated"}, config.overlay(small[0][1], {"conversion": "xx"}))
    results = pipeline.run_batch(spark, [*small, broken])
    assert results.where("status = 'ok'").count() == 10
    assert results.where("sample = 'bad'").first().status.startswith("error")
    textfiles.write_results(results, str(tmp_path / "res"))
    assert main(["report", str(tmp_path / "res" / "results_json"), "--out", f"{tmp_path}/page.html"]) == 0
    page = open(f"{tmp_path}/page.html").read()
    assert "F1 by sample" in page and "sample_1" in page
    assert os.path.exists(path)
