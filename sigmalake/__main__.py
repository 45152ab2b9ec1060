"""Command line: index, search, serve, put, export, dcg and perf; see --help of each."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from . import api
from .config import Settings
from .operators import index as index_tables
from .operators.progress import observed, reported
from .plans import evaluate
from .sources import labels as label_table
from .sources import wiki


def build_index(spark: SparkSession, dump: str, out: str, settings: Settings, say=lambda s: print(s, flush=True)) -> None:
    """Reads a dump up to its cap, and writes the index tables to ``out``, which must not exist.

    With a cap, files after it are not read. Tasks are reported while they run;
    the counts come from the passes that write.
    """
    from pyspark.sql import functions as F

    began = time.monotonic()
    with reported(spark, "scan", say):
        if settings.max_formula_count is None:
            pages = wiki.with_formulas(wiki.read_dump(spark, dump))
        else:
            pages, files = wiki.scan_until(spark, dump, settings.max_formula_count)
            say(f"files: {len(files)} of {len(wiki.dump_files(spark, dump))}")
        pages, seen = observed(pages.select("page_id", "title", "mathes"), pages=F.count("*"))
        pages.write.parquet(f"{out}/scan")
    pages = spark.read.parquet(f"{out}/scan")
    say(f"pages: {seen.get['pages']}, scanned in {time.monotonic() - began:.0f} s")
    with reported(spark, "index", say):
        wiki.formulas(pages).write.parquet(f"{out}/numbered")
        counted = index_tables.write(index_tables.build(pages, spark.read.parquet(f"{out}/numbered"), settings), f"{out}/index")
    say(", ".join(f"{k}: {v}" for k, v in counted.items()) + f", indexed in {time.monotonic() - began:.0f} s")


def perf(spark: SparkSession, index, labels, settings: Settings) -> None:
    """Search seconds of every labelled query: min, max, avg, median, count."""
    took = []
    for r in label_table.all_queries(labels).toLocalIterator():
        began = time.monotonic()
        api.search_json(index, r.query, settings=settings)
        took.append((time.monotonic() - began,))
    evaluate.latency(spark.createDataFrame(took, "seconds double"), "seconds").show()


def server(index, labels: str | None, port: int, settings: Settings):
    """HTTP server of searches and labels, a thread for each request.

    GET /api/search/QUERY/PAGE?size=N, GET or DELETE /api/label/QUERY/URL,
    PUT /api/label/QUERY/URL/RELEVANCE, GET /api/dcg/K. Labels are kept in the
    table at ``labels``; without one their paths are not found.
    """
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from urllib.parse import parse_qs, unquote, urlsplit

    spark = index.pages.sparkSession

    def answer(method: str, path: str) -> str | None:
        url = urlsplit(path)
        root, kind, *rest = [unquote(p) for p in [*url.path.split("/")[1:], ""]]
        rest = rest[:-1]
        if root != "api":
            return None
        if kind == "search" and method == "GET" and rest:
            size = int(parse_qs(url.query).get("size", ["10"])[0])
            return api.search_json(index, rest[0], int(rest[1]) if len(rest) > 1 else 1, size, settings)
        if labels is None:
            return None
        if kind == "label" and method == "PUT" and len(rest) in (2, 3):
            return api.put_label_json(spark, labels, rest[0], rest[1], int(rest[2]) if len(rest) > 2 else 0)
        if kind == "label" and method == "DELETE" and len(rest) == 2:
            return api.put_label_json(spark, labels, rest[0], rest[1], 0)
        if kind == "label" and method == "GET" and len(rest) == 2:
            return api.label_json(label_table.read(spark, labels), *rest)
        if kind == "dcg" and method == "GET" and len(rest) == 1:
            return api.dcg_json(index, label_table.read(spark, labels), int(rest[0]), settings)
        return None

    class Handler(BaseHTTPRequestHandler):
        def reply(self):
            try:
                text = answer(self.command, self.path)
            except Exception as e:  # whatever is wrong with a request is its own answer
                text = api.failure(str(e))
            if text is None:
                self.send_error(404)
                return
            body = text.encode()
            self.send_response(200)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        do_GET = do_PUT = do_DELETE = reply

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer(("", port), Handler)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="python -m sigmalake", description=__doc__)
    for switch in ("adjust", "reconstruct", "reorder", "gen"):
        p.add_argument(f"--no-{switch}", action="store_true", help="a normalisation step left out; the same at indexing and search")
    p.add_argument("--limit", type=int, default=Settings.max_formula_count, help="formulas to index; 0: all")
    p.add_argument("--formula-weight", type=float, default=Settings.formula_weight)
    p.add_argument("--page-weight", type=float, default=Settings.page_weight)
    command = p.add_subparsers(dest="command", required=True)

    def add(name: str, *arguments, **optional):
        own = command.add_parser(name)
        for a in arguments:
            own.add_argument(a)
        for a, (kind, default) in optional.items():
            own.add_argument(a, type=kind, nargs="?", default=default)

    add("index", "dump", "out")
    add("search", "index", "query", page=(int, 1), size=(int, 10))
    add("serve", "index", port=(int, 8080), labels=(str, None))
    add("put", "labels", "query", "url", "relevance")
    add("export", "labels", "file")
    add("dcg", "index", "labels", "k")
    add("perf", "index", "labels")
    return p


def main(args: list[str]) -> None:
    a = parser().parse_args(args)
    settings = Settings(not a.no_adjust, not a.no_reconstruct, not a.no_reorder, not a.no_gen, a.limit or None, a.formula_weight, a.page_weight)
    spark = SparkSession.builder.appName("sigmalake").getOrCreate()
    if a.command == "index":
        build_index(spark, a.dump, a.out, settings)
    elif a.command == "search":
        print(api.search_json(index_tables.read(spark, a.index), a.query, a.page, a.size, settings))
    elif a.command == "serve":
        server(index_tables.opened(index_tables.read(spark, a.index)), a.labels, a.port, settings).serve_forever()
    elif a.command == "put":
        print(api.put_label_json(spark, a.labels, a.query, a.url, int(a.relevance)))
    elif a.command == "export":
        with open(a.file, "w", encoding="utf-8") as f:
            f.write(label_table.export_json(label_table.read(spark, a.labels)))
    elif a.command == "dcg":
        print(api.dcg_json(index_tables.read(spark, a.index), label_table.read(spark, a.labels), int(a.k), settings))
    elif a.command == "perf":
        perf(spark, index_tables.opened(index_tables.read(spark, a.index)), label_table.read(spark, a.labels), settings)


if __name__ == "__main__":
    main(sys.argv[1:])
