"""Command line: detect and mask personal data in text from arguments, a file, lines or standard input.

    python -m veilframe [--model DIR] [--lines] [-f FILE | -] [--json] [--argmax] [--stats] [--dump-tokens | --dump-logprobs] [TEXT ...]
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .operators.detect import RunStats
from .operators.tokens import bpe_tokens
from .plans import api
from .schema import DOCS
from .serve import server
from .shipping import ship
from .sources import readers
from .sources.sinks import logprob_dump, token_dump


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veilframe", description=__doc__)
    p.add_argument("text", nargs="*")
    p.add_argument("-f", "--file", help="a file; - for standard input")
    p.add_argument("-l", "--lines", action="store_true", help="one document per line")
    p.add_argument("-j", "--json", action="store_true", help="spans instead of masked text")
    p.add_argument("--argmax", action="store_true", help="best label of each token instead of the constrained search")
    p.add_argument("--stats", action="store_true", help="counts and seconds on standard error")
    p.add_argument("--dump-tokens", action="store_true", help="token ids, one per line")
    p.add_argument("--dump-logprobs", action="store_true", help="number, id and log probabilities of each token, one per line")
    p.add_argument("--model", help="folder of a trained model; without it rules score")
    p.add_argument("--no-specials", action="store_true", help="special-token literals are ordinary text")
    p.add_argument("--vocabulary", help="rank file; without it pretokens are tokens")
    p.add_argument("--ctx", type=int, default=Config.n_ctx)
    p.add_argument("--batch", type=int, default=Config.batch)
    p.add_argument("--serve", type=int, metavar="PORT", help="answer HTTP requests on this machine instead")
    p.add_argument("--linger", type=int, default=Config.linger_ms, help="milliseconds to gather requests")
    p.add_argument("--skip-beta", type=float, default=0.0)
    return p


def documents(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.text and not args.file:
        text = " ".join(args.text)
        return readers.from_words(spark, [text]) if not args.lines else readers.doc_lines(spark.createDataFrame([(0, text)], DOCS)).select(F.col("line_no").cast("long").alias("doc_id"), F.col("line").alias("text"))
    if args.file in (None, "-"):
        return readers.from_stdin(spark, args.lines)
    return readers.line_files(spark, args.file) if args.lines else readers.whole_files(spark, args.file).select("doc_id", "text")


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    config = Config(n_ctx=args.ctx, batch=args.batch, argmax=args.argmax, skip_beta=args.skip_beta, vocabulary=args.vocabulary, model=args.model, specials=not args.no_specials, linger_ms=args.linger)
    spark = SparkSession.builder.appName("veilframe").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    ship(spark)
    if args.serve is not None:
        server(args.serve, config, api.prepared(spark, config)[0]).serve_forever()
    began = time.time()
    docs = documents(spark, args)
    stats = RunStats.of(spark)
    if args.dump_tokens:
        rows = token_dump(bpe_tokens(docs, api.prepared(spark, config)[0], config.specials)).orderBy("doc_id", "pos").select(F.col("id").cast("string"))
    elif args.dump_logprobs:
        rows = logprob_dump(api.logprobs(docs, config)).orderBy("doc_id", "t").select("line")
    elif args.json:
        rows = api.span_records(docs, config, stats=stats).orderBy("doc_id").select("json")
    else:
        rows = api.redact(docs, config, stats=stats).orderBy("doc_id").select("masked")
    n = 0
    for r in rows.select(F.col(rows.columns[0]).cast("binary")).toLocalIterator():  # a console holds one document at a time
        sys.stdout.buffer.write(bytes(r[0] or b"") + b"\n")
        n += 1
    sys.stdout.buffer.flush()
    if args.stats:
        print(f"records {n}, seconds {time.time() - began:.2f}", file=sys.stderr)
        if not (args.dump_tokens or args.dump_logprobs):
            print(stats, file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
