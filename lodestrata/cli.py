"""Command line: ``python -m lodestrata.cli --path FOLDER COMMAND ...``; results as JSON lines."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import DataFrame

from lodestrata.api import Engine
from lodestrata.operators.semantic import HttpExtractor, RuleExtractor
from lodestrata.operators.vectors import HashingEmbedder, HttpEmbedder
from lodestrata.session import local_session
from lodestrata.sources.checkout import Managed
from lodestrata.sources.store import read_state, write_report

#: Commands with what they take.
COMMANDS = {
    "ingest": "prompts*", "ingest-file": "source kind? label?", "import-repo": "source", "remove-repo": "root", "agent-sync": "home", "search": "query", "search-lexical": "query", "search-slow": "query",
    "browse": "type?", "visualize": "query", "stats": "", "semantic-refresh": "most?", "embedding-refresh": "", "benchmark": "cases report", "benchmark-hybrid": "cases report", "managed-repos-refresh": "list", "managed-repos-status": "",
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodestrata")
    top.add_argument("--path", required=True, help="folder of the engine")
    top.add_argument("--archive", help="recording archive, read before a search if it is newer")
    top.add_argument("--limit", type=int, default=24)
    top.add_argument("--types", nargs="*")
    top.add_argument("--embedder", nargs=2, metavar=("URL", "MODEL"))
    top.add_argument("--extractor", nargs=2, metavar=("URL", "MODEL"))
    top.add_argument("--force", action="store_true")
    sub = top.add_subparsers(dest="command", required=True)
    for name, takes in COMMANDS.items():
        one = sub.add_parser(name)
        for word in takes.split():
            one.add_argument(word.rstrip("?*"), nargs=word[-1] if word[-1] in "?*" else None)
    return top


def run(engine: Engine, a: argparse.Namespace) -> DataFrame | dict:
    embedder = HttpEmbedder(*a.embedder) if a.embedder else HashingEmbedder()
    state = a.path.removeprefix("file://").rstrip("/") + "/managed-repositories.json"
    if a.archive and a.command in ("search", "search-lexical", "search-slow", "browse", "visualize", "stats"):
        engine.ingest_if_newer(a.archive)
    match a.command:
        case "ingest":
            return engine.ingest(archive=a.archive, prompts=a.prompts)
        case "ingest-file":
            return engine.ingest(sources=[a.source], kind=a.kind, label=a.label)
        case "import-repo":
            return engine.ingest(repositories=[a.source])
        case "remove-repo":
            engine.remove_repository(a.root)
            return engine.stats()
        case "agent-sync":
            known = [os.path.join(a.home, *p) for p in (("memories", "MEMORY.md"), ("memories", "USER.md"), ("AgentSessions",))]
            return engine.ingest(sources=[p for p in known if os.path.exists(p)])
        case "search":
            return engine.search_hits(a.query, a.limit, a.types)
        case "search-lexical":
            return engine.search_lexical(a.query, a.limit, a.types)
        case "search-slow":
            return engine.search_hybrid(a.query, a.limit, a.types, embedder=embedder)
        case "browse":
            return engine.browse(a.type, a.limit)
        case "visualize":
            return engine.visualize(a.query)
        case "stats":
            return engine.stats()
        case "semantic-refresh":
            return engine.refresh_semantic(HttpExtractor(*a.extractor) if a.extractor else RuleExtractor(), int(a.most) if a.most else None)
        case "embedding-refresh":
            return engine.refresh_embeddings(embedder)
        case "benchmark" | "benchmark-hybrid":
            report = engine.benchmark(a.cases, embedder=embedder if a.command == "benchmark-hybrid" else None)
            write_report(a.report.removesuffix(".json"), os.path.basename(a.cases), report)
            return report
        case "managed-repos-refresh":
            with open(a.list, encoding="utf-8") as f:
                managed = [Managed(**m) for m in json.load(f)]
            return engine.refresh_managed(managed, state, a.force)
        case "managed-repos-status":
            return read_state(engine.spark, state)
    raise ValueError(a.command)


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    done = run(Engine(local_session(), a.path), a)
    if isinstance(done, dict):
        print(json.dumps(done))
    else:
        for line in done.toJSON().toLocalIterator():
            print(line)


if __name__ == "__main__":
    main()
