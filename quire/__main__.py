"""Command line: ``python -m quire prepare|embed ...``."""

from __future__ import annotations

import argparse
import json


def main(argv=None):
    ap = argparse.ArgumentParser(prog="quire")
    sub = ap.add_subparsers(dest="cmd", required=True)
    p = sub.add_parser("prepare", help="sources -> corpus, vocabulary, tokenised examples, plan")
    for src in ("discharge", "radiology", "articles", "diagnosis", "procedure", "hcpcs"):
        p.add_argument(f"--{src}", help=f"path or glob of the {src} source")
    p.add_argument("--out", required=True)
    p.add_argument("--max-length", type=int, default=128)
    p.add_argument("--vocab-size", type=int, default=30522)
    e = sub.add_parser("embed", help="patient JSON -> embeddings")
    e.add_argument("--json", required=True)
    e.add_argument("--layout", default="lines", choices=["lines", "object"])
    e.add_argument("--out", required=True)
    e.add_argument("--limit-rows", type=int)
    e.add_argument("--batch-size", type=int, default=64)
    for a in (p, e):
        a.add_argument("--master", default="local[*]")
        a.add_argument("--shuffle-partitions", type=int, default=200)
    args = ap.parse_args(argv)
    from quire.session import get_session
    spark = get_session(master=args.master, shuffle_partitions=args.shuffle_partitions)
    if args.cmd == "prepare":
        from quire.plans.training import prepare_training_data
        paths = {s: getattr(args, s) for s in ("discharge", "radiology", "articles", "diagnosis",
                                               "procedure", "hcpcs") if getattr(args, s)}
        print(json.dumps(prepare_training_data(spark, paths, args.out, args.max_length, args.vocab_size)))
    else:
        from quire.plans.embedding import embed_patients
        print(embed_patients(spark, args.json, args.out, args.layout, args.limit_rows,
                             batch_size=args.batch_size))


if __name__ == "__main__":
    main()
