"""Command line: import, search, list, show, stats, verify, index, inspect and export an archive.

    python -m talktree STORE import INPUT
    python -m talktree STORE search 'words "a phrase" -not role:user' [--messages] [--sort newest]
"""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from talktree.functions.values import parse_day
from talktree.operators import export, index, reader, search, verify
from talktree.operators.store import Store
from talktree.plans.query import DAY, MODES, PATHS, SCOPES, SORTS, parse_query
from talktree.sources.exports import inspect_input


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="talktree", description=__doc__.split("\n")[0])
    p.add_argument("store", help="folder of the archive, in any store that Spark reaches")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("import", "inspect"):
        sub.add_parser(name).add_argument("input", help="a ZIP, a JSON file or a folder")
    for name in ("stats", "verify", "index"):
        sub.add_parser(name)
    s = sub.add_parser("search")
    s.add_argument("text")
    s.add_argument("--messages", action="store_true", help="messages, not conversations")
    s.add_argument("--path", choices=PATHS, default="current")
    s.add_argument("--scope", choices=SCOPES, default="all")
    s.add_argument("--match", choices=MODES, default="contains")
    for name in ("role", "title", "exact", "exclude", "source"):
        s.add_argument(f"--{name}")
    one = sub.add_parser("list")
    for q in (s, one):
        q.add_argument("--sort", choices=SORTS, default="relevance" if q is s else "updated")
        q.add_argument("--limit", type=int, default=20)
        q.add_argument("--offset", type=int, default=0)
        q.add_argument("--after")
        q.add_argument("--before")
    r = sub.add_parser("show")
    r.add_argument("conversation_id")
    r.add_argument("--path", choices=PATHS, default="current")
    r.add_argument("--limit", type=int, default=50)
    r.add_argument("--offset", type=int, default=0)
    r.add_argument("--around")
    r.add_argument("--hide-internal", action="store_true")
    e = sub.add_parser("export")
    e.add_argument("folder")
    e.add_argument("--format", choices=(*export.FORMATS, "both"), default="both")
    e.add_argument("--path", choices=PATHS, default="current")
    e.add_argument("--from", dest="date_from")
    e.add_argument("--to", dest="date_to")
    e.add_argument("--include-internal", action="store_true")
    return p


def _print(rows: DataFrame) -> None:
    for line in rows.toJSON().collect():  # one page
        print(line)


def _day(text: str | None, end: bool = False) -> float | None:
    if not text:
        return None
    day = parse_day(text)
    if day is None:
        raise SystemExit(f"not a date: {text}")
    return day + DAY * end


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("talktree").getOrCreate()
    store = Store(spark, a.store)
    if a.command == "import":
        print(json.dumps(store.import_path(a.input)))
    elif a.command == "inspect":
        for name, rows in inspect_input(spark, a.input).items():
            print(name)
            _print(rows)
    elif a.command == "stats":
        _print(verify.stats(store.archive()))
    elif a.command == "verify":
        report = verify.verify(store.archive(), store.table("import_warnings"))
        print(json.dumps(report, default=str))
        return 0 if report["ok"] else 1
    elif a.command == "index":
        print(store.build_index())
    elif a.command == "list":
        found = search.list_conversations(store.archive(), a.sort, _day(a.after), _day(a.before, True))
        _print(search.summaries(search.page(found, a.limit, a.offset)))
    elif a.command == "show":
        _print(reader.get_messages(store.archive(), a.conversation_id, a.path, a.limit, a.offset, not a.hide_internal, a.around).select("page_index", "node_id", "role", "create_time", "text"))
    elif a.command == "search":
        q = parse_query(a.text, path=a.path, scope=a.scope, match_mode=a.match, role=a.role, title=a.title, exact=a.exact, exclude=a.exclude, source=a.source, after=a.after, before=a.before, limits=True)
        if q.errors:
            print("; ".join(q.errors), file=sys.stderr)
            return 2
        archive, postings = store.indexed()
        scores, shown = None, None
        if postings is not None and q.has_body:
            shown = index.relevance_page(archive, postings, q, a.limit, store.lengths()) if a.messages and not a.offset else None
            scores = index.bm25_postings(archive, postings, q, store.lengths())
            archive = index.narrowed(archive, postings, q)
        if a.messages:
            found = (search.search_messages(archive, q, bm25=scores) if shown is None else shown).select("conversation_id", "node_id", "role", "score", "reasons", "snippet")
            _print(search.page(found, a.limit, a.offset, search.MAX_MESSAGES))
        else:
            _print(search.summaries(search.page(search.search_conversations(archive, q, a.sort, scores), a.limit, a.offset)))
    elif a.command == "export":
        formats = export.FORMATS if a.format == "both" else (a.format,)
        archive = store.archive()
        options = {"path": a.path, "include_internal": a.include_internal}
        content = export.rendered(archive, formats, **options, date_from=_day(a.date_from), date_to=_day(a.date_to, True))
        names = export.file_names(archive.conversations, formats)
        print(json.dumps(export.write_files(content.join(names, ["conversation_id", "format"]), a.folder)))
        rows = export.manifest(archive, content, **options)
        export.write_manifests(rows, a.folder)
        store.append("exports", export.export_log(rows, datetime.now(timezone.utc).isoformat(timespec="seconds"), options))
    return 0


if __name__ == "__main__":
    sys.exit(main())
