"""Commands: `scan` a repository, `ask` a question."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from functools import partial

from quarry.operators.embed import HashEmbedder, HttpEmbedder
from quarry.operators.search import DEFAULT_K, HIT, SearchQuery
from quarry.operators.store import Store
from quarry.plans.services import ScanResult, ask, scan, session
from quarry.schemas import RECORD_TYPES
from quarry.sources.files import clone_folder, git_clone, load
from quarry.sources.settings import Settings, SettingsError, load_settings

#: Exit codes: done, bad usage, failed.
OK, USAGE, FAILED = 0, 2, 3


def duration(seconds: float) -> str:
    return f"{int(seconds) // 60}m {int(seconds) % 60:02d}s" if seconds >= 60 else f"{seconds:.1f}s"


def scan_summary(r: ScanResult) -> str:
    repo = r.repository
    head = [f"Repository:          {repo.name}", f"Branch:              {repo.branch}", f"Commit:              {repo.commit_sha[:7]}"]
    if r.already_indexed:
        return "\n".join([*head, "This commit is already indexed; nothing to do."])
    rest = (
        ("Files scanned", r.files_scanned), ("Records created", r.records_created), ("Records inserted", r.records_inserted), ("Records failed", r.records_failed), ("Redaction failed", r.redaction_failed),
        ("Embeddings created", r.embeddings_created), ("Embeddings failed", r.embeddings_failed), ("Duration", duration(r.seconds)),
    )
    return "\n".join([*head, *(f"{name + ':':<21}{value}" for name, value in rest)])


#: Keys of a hit as JSON, in order.
JSON_KEYS = ("repository", *HIT[1:], "score")


def hits_json(rows: Sequence) -> str:
    return json.dumps([{k: r["repository_name" if k == "repository" else k] for k in JSON_KEYS} for r in rows], indent=2, ensure_ascii=False)


def hits_text(question: str, rows: Sequence) -> str:
    out = [f"Question: {question}", ""]
    for i, r in enumerate(rows, 1):
        out += [f"{i}. {r['repository_name']}", f"   File:   {r['file_path']}:{r['line_start']}-{r['line_end']}", f"   Symbol: {r['symbol_name'] or ''}", "   Match:  semantic", f"   Score:  {r['score']:.2f}", ""]
    return "\n".join(out) if rows else "\n".join([*out, "No matches."])


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quarry")
    commands = top.add_subparsers(dest="command", required=True)
    s = commands.add_parser("scan", help="index a repository")
    s.add_argument("--repo")
    s.add_argument("--path")
    s.add_argument("--branch")
    s.add_argument("--search", action="extend", nargs="+", default=[])
    s.add_argument("--force", action="store_true")
    a = commands.add_parser("ask", help="search what is indexed")
    a.add_argument("question")
    a.add_argument("--repo", action="extend", nargs="+", default=[])
    a.add_argument("--branch")
    a.add_argument("--record-type", action="extend", nargs="+", default=[])
    a.add_argument("--top-k", type=int, default=DEFAULT_K)
    a.add_argument("--min-score", type=float)
    a.add_argument("--format", choices=("text", "json"), default="text")
    a.add_argument("--include-stale", action="store_true")
    a.add_argument("--include-other-models", action="store_true")
    for c in (s, a):
        c.add_argument("--config")
        c.add_argument("--store", help="folder of the store")
    return top


def embedder(settings: Settings):
    e = settings.embedding
    if e.endpoint and e.api_key:
        return HttpEmbedder(e.endpoint, e.model, e.dimension, e.api_key, e.model_version)
    print("no embedding service is set: vectors are hashes of words", file=sys.stderr)
    return HashEmbedder(min(e.dimension, 256))


def main(argv: Sequence[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return OK if e.code in (0, None) else USAGE
    try:
        settings = load_settings(args.config)
    except SettingsError as e:
        print(e, file=sys.stderr)
        return USAGE
    root = args.store or settings.storage.path
    if args.command == "scan" and bool(args.repo) == bool(args.path):
        print("give one of --repo and --path", file=sys.stderr)
        return USAGE
    unknown = [t for t in getattr(args, "record_type", []) if t not in RECORD_TYPES]
    if unknown or not root or (args.command == "ask" and not args.question.strip()):
        print(f"unknown record type {unknown[0]}" if unknown else "a store folder and a question are needed", file=sys.stderr)
        return USAGE
    try:
        store = Store(session(), root)
        if args.command == "scan":
            clone = partial(git_clone, folder=clone_folder(store.spark)) if args.repo else git_clone
            print(scan_summary(scan(store, load(args.path, args.repo, args.branch, clone), embedder(settings), settings, args.search, args.force)))
            return OK
        q = SearchQuery((), None, args.repo, args.branch, args.record_type, args.top_k, args.min_score, args.include_stale, args.include_other_models)
        found = ask(store, args.question, embedder(settings), q)
        rows = [] if found is None else found.collect()  # at most k
        print(hits_json(rows) if args.format == "json" else hits_text(args.question, rows))
        return OK
    except Exception as e:  # noqa: BLE001
        print(f"failed: {e}", file=sys.stderr)
        return FAILED


if __name__ == "__main__":
    sys.exit(main())
