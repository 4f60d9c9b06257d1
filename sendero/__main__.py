"""Command line entry (spark-submit friendly):

    python -m sendero recommend  --profiles P.csv --interactions I.csv --out DIR [--k 10 --n 3]
    python -m sendero inverse    --profiles P.csv --interactions I.csv --out DIR [--k 10 --n 3]
    python -m sendero index      --profiles P.csv --interactions I.csv --out DIR [--force]
    python -m sendero evaluate   --profiles P.csv --interactions I.csv --out DIR [--n 10]
    python -m sendero prompts    --profiles P.csv --interactions I.csv --out DIR [--k 6 --n 3 --template T.txt]

Inputs may also be the driver's table folder (``--tables DIR``).  Outputs
are Parquet folders under ``--out``.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame

from sendero.session import get_session


def _pipeline(spark, args):
    from sendero.plans.pipeline import Pipeline

    if args.tables:
        return Pipeline(spark, args.tables)
    return Pipeline.from_csv(spark, args.profiles, args.interactions)


def _write(df: DataFrame, out: str, name: str) -> None:
    df.write.mode("overwrite").parquet(os.path.join(out, name))


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="sendero")
    ap.add_argument("command", choices=["recommend", "inverse", "index", "evaluate", "prompts"])
    ap.add_argument("--profiles")
    ap.add_argument("--interactions")
    ap.add_argument("--tables")
    ap.add_argument("--out", required=True)
    ap.add_argument("--k", type=int)
    ap.add_argument("--n", type=int)
    ap.add_argument("--force", action="store_true")
    ap.add_argument("--template")
    ap.add_argument("--model")
    args = ap.parse_args(argv)
    if not args.tables and not (args.profiles and args.interactions):
        ap.error("give --tables or both --profiles and --interactions")

    spark = get_session(app=f"sendero-{args.command}")
    p = _pipeline(spark, args)
    from sendero.functions import fixed

    if args.command == "recommend":
        k, n = args.k or fixed.DIRECT_TOP_K, args.n or fixed.TOP_N
        _write(p.topk_places(k), args.out, "candidatos")
        _write(p.recommend_direct(k, n), args.out, "recomendaciones")
    elif args.command == "inverse":
        k, n = args.k or fixed.INVERSE_TOP_K, args.n or fixed.TOP_N
        _write(p.topk_users(k), args.out, "candidatos")
        _write(p.recommend_inverse(k, n), args.out, "usuarios_recomendados")
    elif args.command == "index":
        from sendero.sources import index as IX

        places = IX.VectorIndex(spark, os.path.join(args.out, IX.PLACES), IX.PLACE_METADATA)
        places.ingest(IX.place_index_rows(p.place_texts, p.place_vectors), force=args.force)
        users = IX.VectorIndex(spark, os.path.join(args.out, IX.USERS), IX.USER_METADATA)
        users.ingest(IX.user_index_rows(p.user_index_rows, p.user_document_vectors), force=args.force)
    elif args.command == "prompts":
        from sendero.operators import prompts as PR

        k, n = args.k or fixed.DIRECT_TOP_K, args.n or fixed.TOP_N
        template = open(args.template, encoding="utf-8").read() if args.template else None
        _write(PR.direct_prompts(p.user_texts, p.topk_places(k), n, template, args.model), args.out, "prompts")
    elif args.command == "evaluate":
        from sendero.operators import evaluate as E

        n = args.n or 10
        out = None
        for protocol in ("temporal", "leave_one_out"):
            if protocol == "temporal":
                cutoff = E.temporal_cutoff(p.interactions)
                tp, rel = p.for_training(E.temporal_train(p.interactions, cutoff)), E.temporal_relevant(p.interactions, cutoff)
            else:
                rel, train = E.leave_one_out(p.interactions)
                tp = p.for_training(train)
            m = E.ranking_metrics(E.user_ranking_stats(tp.topk_places(n), rel, p.profiles), n, protocol)
            out = m if out is None else out.unionByName(m)
        _write(out, args.out, "metricas")


if __name__ == "__main__":
    main()
