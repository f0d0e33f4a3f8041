"""``python -m strandmill COMMAND``: a thin command line over the operators."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import Settings, batch, load, load_batch, overlay, write
from .operators import evaluate, pileup, qc, sampling, simulate, umi
from .plans import pipeline, report
from .sources import fastq, textfiles


def save(done: dict, reads, out: str) -> None:
    """What a run found: parts written by the tasks, small reports by the driver."""
    done["sam"].select(*textfiles.SAM_FIELDS, "sample").write.mode("overwrite").option("sep", "\t").csv(f"{out}/sam")
    textfiles.bed7_lines(done["calls"]).write.mode("overwrite").text(f"{out}/calls")
    if "rejected" in done:
        textfiles.fastq_lines(done["rejected"].select(F.col("line_no").alias("read_idx"), F.col("qname").alias("name"), "seq", "qual")).write.mode("overwrite").text(f"{out}/rejected")
    pages = {"quality.html": report.quality_report(reads)}
    if "scores" in done:
        textfiles.write_results(done["scores"], out)
        pages["report.html"] = report.html_page("Results", {"Samples": report.html_table(done["scores"].orderBy("sample"), "f1_score"), "Ranking": report.html_table(done["ranking"].orderBy("rank"), "f1_score")})
        print(report.text_table(done["ranking"].orderBy("rank")))
    os.makedirs(out, exist_ok=True)
    for name, page in pages.items():
        with open(f"{out}/{name}", "w") as f:
            f.write(page)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="strandmill")
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *options: [c := sub.add_parser(name), *(c.add_argument(o, **k) for o, k in options)]
    out, conv = ("--out", {"required": True}), ("--conversion", {"default": "ct"})
    add("simulate", out, conv, ("--genome-length", {"type": int, "default": 50_000}), ("--num-reads", {"type": int, "default": 5_000}), ("--read-length", {"type": int, "default": 100}), ("--seed", {"type": int, "default": 42}))
    add("run", ("--config", {}), conv, ("--reads", {}), ("--reads2", {}), ("--reference", {}), ("--truth", {}), ("--out", {}), ("--genome-length", {"type": int, "default": 50_000}), ("--num-reads", {"type": int, "default": 5_000}), ("--read-length", {"type": int, "default": 100}))
    add("extract", ("reads", {}), out, ("--num-reads", {"type": int, "default": 5_000}), ("--seed", {"type": int, "default": 42}))
    add("perbase", ("sam", {}), out, conv, ("--min-qual", {"type": int, "default": 0}))
    add("evaluate", ("bed", {}), ("truth", {}), ("--name", {"default": "calls"}))
    add("qc", ("reads", {}), out)
    add("umi", ("reads", {}), out)
    add("report", ("results", {}), out)
    add("demo", out)
    add("batch-demo", out, ("--samples", {"type": int, "default": 4}))
    add("list-aligners")
    a = p.parse_args(argv)
    if a.command == "list-aligners":
        print("\n".join([*pipeline.REGISTRY, *(f"{n}: {'found' if ok else 'missing'}" for n, ok in pipeline.available_tools().items())]))
        return 0
    spark = SparkSession.builder.appName("strandmill").getOrCreate()
    if a.command == "simulate":
        made = simulate.simulate_reads(spark, a.genome_length, a.num_reads, a.read_length, conversion=a.conversion, mode="se", seed=a.seed)
        os.makedirs(a.out, exist_ok=True)
        textfiles.single_file(textfiles.fastq_lines(made["reads"]), f"{a.out}/reads.fastq")
        truth = made["truth"].orderBy("pos").select(F.concat_ws("\t", "chrom", F.col("pos").cast("string"), (F.col("pos") + 1).cast("string"), F.col("methylated").cast("string")).alias("value"))
        textfiles.single_file(truth, f"{a.out}/truth.bed")
        genome = pipeline.blocks_of(made["genome"], 1 << 20).groupBy(F.lit("chr_sim").alias("chrom")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_id", "seq"))), lambda x: x["seq"]), "").alias("seq"))
        textfiles.single_file(textfiles.fasta_lines(genome), f"{a.out}/reference.fa")
    elif a.command == "run":
        s = load(a.config) if a.config else overlay(Settings(), {"conversion": a.conversion, "simulation": {"genome_length": a.genome_length, "num_reads": a.num_reads, "read_length": a.read_length}})
        if not a.reads:
            print(report.text_table(pipeline.run_simulated(spark, s).orderBy("rank")))
            return 0
        if not (a.reference and a.out):
            p.error("run on given reads needs --reference and --out")
        mates = [fastq.with_read_idx(fastq.read_fastq(spark, path)).withColumn("mate", F.lit(m)) for m, path in ((1, a.reads), (2, a.reads2)) if path]
        reads = mates[0].unionByName(mates[1]) if len(mates) > 1 else mates[0]
        if len(mates) > 1:
            s = overlay(s, {"mode": "pe"})
        truth = textfiles.read_bed(spark, a.truth, textfiles.BED4).select("chrom", F.col("start").alias("pos"), "methylated") if a.truth else None
        save(pipeline.run(spark, reads, textfiles.read_fasta_blocks(spark, a.reference, pipeline.BLOCK), truth, s), reads, a.out)
    elif a.command == "report":
        results = textfiles.read_results(spark, a.results)
        page = report.samples_report(results) if "sample" in results.columns and "grp" in results.columns else report.html_page("Results", {"Ranking": report.html_table(results.orderBy(F.desc("f1_score")), "f1_score")})
        with open(a.out, "w") as f:
            f.write(page)
    elif a.command == "demo":
        s = overlay(Settings(), {"simulation": {"genome_length": 20_000, "num_reads": 2_000, "read_length": 50}})
        scores = pipeline.run_simulated(spark, s)
        textfiles.write_results(scores, a.out)
        print(report.text_table(scores.orderBy("rank")))
    elif a.command == "batch-demo":
        os.makedirs(a.out, exist_ok=True)
        results = pipeline.run_batch(spark, load_batch(write(batch(a.samples), f"{a.out}/batch.json")))
        textfiles.write_results(results, a.out)
        with open(f"{a.out}/samples.html", "w") as f:
            f.write(report.samples_report(results))
        print(report.text_table(evaluate.overall_ranking(results.where("aligner is not null")).orderBy("rank")))
    elif a.command == "evaluate":
        calls = textfiles.read_bed(spark, a.bed).select("chrom", F.col("start").alias("pos"), "level").withColumn("aligner", F.lit(a.name))
        truth = textfiles.read_bed(spark, a.truth, textfiles.BED4).select("chrom", F.col("start").alias("pos"), "methylated")
        print(report.text_table(evaluate.metrics(calls, truth, ["aligner"])))
    elif a.command == "perbase":
        textfiles.write_per_base(pileup.per_base(textfiles.read_sam(spark, a.sam), a.conversion, a.min_qual), a.out)
    else:
        reads = fastq.with_read_idx(fastq.read_fastq(spark, a.reads))
        if a.command == "extract":
            textfiles.save_lines(textfiles.fastq_lines(sampling.sample_reads(reads, a.num_reads, a.seed)), a.out)
        elif a.command == "qc":
            with open(a.out, "w") as f:
                f.write(report.quality_report(reads))
            print(report.text_table(qc.grade(reads.where("length(qual) > 0"), reads.where("seq <> ''"))))
        elif a.command == "umi":
            keyed = reads.withColumn("umi", umi.standard(umi.from_header(F.col("name"))))
            textfiles.save_lines(textfiles.fastq_lines(umi.dedup(keyed)), a.out)
            print(report.text_table(umi.stats(keyed)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
