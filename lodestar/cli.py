"""python -m lodestar.cli insert STORE PATH... | search STORE QUERY [--hybrid] | delete STORE --doc ID --prefix URI --since DATE --until DATE | embed TEXT... [--model FILE --tokenizer FILE]"""

from __future__ import annotations

import argparse

from lodestar.operators.filters import DocIdEq, RangeIsoDate, SourceUriPrefix
from lodestar.plans.config import EngineConfig
from lodestar.plans.engine import Engine
from lodestar.session import get_session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    insert = commands.add_parser("insert")
    insert.add_argument("store")
    insert.add_argument("paths", nargs="+")
    insert.add_argument("--encoding", default="utf-8")
    search = commands.add_parser("search")
    search.add_argument("store")
    search.add_argument("query")
    search.add_argument("--hybrid", action="store_true")
    search.add_argument("--top-k", type=int, default=10)
    delete = commands.add_parser("delete")
    delete.add_argument("store")
    delete.add_argument("--doc")
    delete.add_argument("--prefix")
    delete.add_argument("--since")
    delete.add_argument("--until")
    delete.add_argument("--batch", type=int, default=1000)
    embed = commands.add_parser("embed")
    embed.add_argument("texts", nargs="+")
    embed.add_argument("--model")
    embed.add_argument("--tokenizer")
    embed.add_argument("--dim", type=int, default=64)
    args = parser.parse_args(argv)
    if args.command == "embed":
        embedder = Engine(get_session(), EngineConfig(model_path=args.model, tokenizer_path=args.tokenizer, dim=args.dim)).embedder
        for text, vector in zip(args.texts, embedder.embed(args.texts), strict=True):
            print(f"{text}\t{embedder.model_id}\t{len(vector)}\t" + " ".join(f"{x:.6f}" for x in vector))
        return 0
    engine = Engine(get_session(), EngineConfig(store_root=args.store))
    if args.command == "insert":
        for path in args.paths:
            for row in engine.ingest_files(path, args.encoding).collect():
                print(f"rejected {row['path']}: {row['reason']}")
        print(engine.repo_counts())
    elif args.command == "search":
        hits = engine.search_hybrid(args.query, args.top_k) if args.hybrid else engine.search_text(args.query, args.top_k)
        for rank, hit in enumerate(hits.collect(), 1):
            print(f"{rank}. {hit['score']:.4f} {hit['chunk_id']} {hit['preview'][:60]}")
    else:
        clauses = [DocIdEq(value=args.doc)] if args.doc else []
        clauses += [SourceUriPrefix(prefix=args.prefix)] if args.prefix else []
        clauses += [RangeIsoDate(key="extracted_at", low=args.since, high=args.until)] if args.since or args.until else []
        print(engine.delete_by_filter(clauses, args.batch))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
