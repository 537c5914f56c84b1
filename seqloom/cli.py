"""Command line: one command per flow."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import DataFrame

from seqloom.plans import flows
from seqloom.session import build_session


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="seqloom", description=__doc__)
    parser.add_argument("--master", default=None)
    parser.add_argument("--log", default=None, help="also write messages and summaries to this file")
    sub = parser.add_subparsers(dest="command", required=True)

    c = sub.add_parser("piles", help="assign k-mers of two FASTA files to piles")
    c.add_argument("--file1", required=True)
    c.add_argument("--file2", required=True)
    c.add_argument("--label1", default="file1")
    c.add_argument("--label2", default="file2")
    c.add_argument("--k", nargs="+", type=int, default=[9])
    c.add_argument("--outdir", default=".")
    c.add_argument("--keep-ambiguous", action="store_true")

    c = sub.add_parser("annotate", help="add reference state to pile tables")
    c.add_argument("--input", nargs="+", required=True)
    c.add_argument("--ref", required=True)
    c.add_argument("--outdir", default=".")
    c.add_argument("--track-ref-proteins", action="store_true")
    c.add_argument("--split-categories", action="store_true")
    c.add_argument("--keep-ambiguous", action="store_true")

    c = sub.add_parser("count", help="rows per category of a split output")
    c.add_argument("folder", nargs="?", default=".")

    c = sub.add_parser("compare", help="compare database and de novo peptide lists")
    c.add_argument("--db", nargs="+", required=True)
    c.add_argument("--denovo", nargs="+", required=True)
    c.add_argument("--output", default="overlap_results")

    c = sub.add_parser("dedup", help="collapse identical and contained sequences")
    c.add_argument("input_fasta")
    c.add_argument("--output_prefix", default=None)
    c.add_argument("--output_dir", default=".")
    c.add_argument("--name-semantics", action="store_true")

    c = sub.add_parser("match", help="find peptides in proteins, L and I equal")
    c.add_argument("--peptides", required=True)
    c.add_argument("--fasta", required=True)
    c.add_argument("--out", required=True)

    c = sub.add_parser("parse-hits", help="filter and summarize alignment hits")
    c.add_argument("--tool", required=True)
    c.add_argument("--blast_tsv", required=True)
    c.add_argument("--min_pident", type=float, default=90.0)
    c.add_argument("--max_mismatch", type=int, default=1)
    c.add_argument("--out", required=True)

    c = sub.add_parser("list-to-fasta", help="number the peptides of a list")
    c.add_argument("--peptides", required=True)
    c.add_argument("--tool", required=True)
    c.add_argument("--out", required=True)

    for name, text in (("isoforms-to-fasta", "proteins of an isoform report"),
                       ("extract-modified", "bare peptides of modified sequences"),
                       ("extract-tokens", "bare peptides of token lists"),
                       ("filter-length", "distinct lines of more than seven letters")):
        c = sub.add_parser(name, help=text)
        c.add_argument("input")
        c.add_argument("output")

    c = sub.add_parser("quality", help="prediction metrics, matched against unmatched")
    c.add_argument("--instanovo", required=True)
    c.add_argument("--reference", required=True)
    c.add_argument("--out", default="quality")
    return parser


def _run(spark, a: argparse.Namespace) -> list[DataFrame]:
    match a.command:
        case "piles":
            return [flows.assign_piles(spark, a.file1, a.file2, a.outdir, a.label1, a.label2, a.k, a.keep_ambiguous)]
        case "annotate":
            return list(flows.annotate_piles(spark, a.input, a.ref, a.outdir, a.track_ref_proteins,
                                             a.split_categories, a.keep_ambiguous).values())
        case "count":
            return [flows.count_categories(spark, a.folder)]
        case "compare":
            return [flows.compare_lists(spark, a.db, a.denovo, a.output)]
        case "dedup":
            return [flows.dedup_fasta(spark, a.input_fasta, a.output_dir, a.output_prefix, a.name_semantics)]
        case "match":
            return [flows.match_exact(spark, a.peptides, a.fasta, a.out)]
        case "parse-hits":
            return [flows.parse_hits(spark, a.tool, a.blast_tsv, a.out, a.min_pident, a.max_mismatch)]
        case "list-to-fasta":
            flows.list_to_fasta(spark, a.peptides, a.tool, a.out)
        case "isoforms-to-fasta":
            return [flows.isoforms_to_fasta(spark, a.input, a.output)]
        case "extract-modified":
            flows.extract_modified(spark, a.input, a.output)
        case "extract-tokens":
            flows.extract_token_lists(spark, a.input, a.output)
        case "filter-length":
            flows.filter_by_length(spark, a.input, a.output)
        case "quality":
            return [flows.prediction_quality(spark, a.instanovo, a.reference, a.out)]
    return []


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    handlers: list[logging.Handler] = [logging.StreamHandler(sys.stdout)]
    if args.log:
        handlers.append(logging.FileHandler(args.log, mode="w"))
    log = logging.getLogger("seqloom")
    log.setLevel(logging.INFO)
    log.handlers = handlers
    spark = build_session(master=args.master)
    try:
        for summary in _run(spark, args):
            log.info("%s", "\t".join(summary.columns))
            for row in summary.collect():  # summaries have a bounded number of rows
                log.info("%s", "\t".join("" if v is None else str(v) for v in row))
    except ValueError as error:
        log.error("ERROR: %s", error)
        return 1
    return 0
