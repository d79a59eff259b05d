"""Command line: build, query, bench, clean, export."""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path


def _session(cores: str):
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master(f"local[{cores}]").appName("triplespark").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def bench(store, folder: str, warm_up: int = 5, timed: int = 20, log: str | None = None, show_stat: bool = False) -> list[dict]:
    """Each query file of a folder: the least time of the timed runs, over planning and execution; with
    `show_stat` one run that gives the counters instead: phases, operators, rows and selectivities."""
    found = []
    for path in sorted(Path(folder).glob("*.sparql")) + sorted(Path(folder).glob("*.rq")):
        text = path.read_text(encoding="utf-8")
        if show_stat:
            found.append({"query": path.stem} | store.profile(text))
            continue
        times, rows = [], 0
        for k in range(warm_up + timed):
            began = time.perf_counter()
            rows = store.sparql(text).count()
            if k >= warm_up:
                times.append(time.perf_counter() - began)
        found.append({"query": path.stem, "seconds": round(min(times), 4), "rows": rows, "shape": store.shape(text)})
    if log:
        Path(log).write_text("".join(json.dumps(x) + "\n" for x in found), encoding="utf-8")
    return found


def repl(store, read=input) -> None:
    """`sparql <path>` prints a query's result, `exit` ends."""
    while True:
        try:
            line = read("> ").strip()
        except EOFError:
            return
        command, _, rest = line.partition(" ")
        if command == "exit":
            return
        if command == "sparql" and rest:
            try:
                began = time.perf_counter()
                store.show(Path(rest.strip()).read_text(encoding="utf-8"))
                print(f"{time.perf_counter() - began:.3f} s")
            except (OSError, ValueError) as e:
                print(e)
        elif command:
            print("Not supported command")


def server(port: int = 8000):
    """An HTTP server whose root answers that it is there."""
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            found = self.path == "/"
            body = json.dumps({"statusCode": 200, "message": "Hello World!"} if found else {"statusCode": 404, "message": "Not found"}).encode()
            self.send_response(200 if found else 404)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer(("0.0.0.0", port), Handler)


def main(args: list[str] | None = None) -> int:
    from triplespark.operators.renumber import METHODS
    from triplespark.sources import ntriples
    from triplespark.sources.store import Store

    parser = argparse.ArgumentParser(prog="triplespark", description=__doc__)
    parser.add_argument("--cores", default="*")
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("build", help="N-Triples files to a store")
    p.add_argument("store")
    p.add_argument("source")
    p.add_argument("--renumber", choices=METHODS, default="none")
    p.add_argument("--full-index", action="store_true")
    p.add_argument("--literal-dict", action="store_true")
    p.add_argument("--spread", action="store_true")
    p = sub.add_parser("query", help="ask a store; without a file, read commands")
    p.add_argument("store")
    p.add_argument("--sparql")
    p.add_argument("--preload", action="store_true")
    p.add_argument("--no-prescan", action="store_true", help="neither count selective patterns first nor bound variables by them")
    p.add_argument("--explain", action="store_true")
    p.add_argument("--profile", action="store_true", help="seconds by phase, rows and steps")
    p.add_argument("--dot", action="store_true")
    p.add_argument("--out", help="write the result as Parquet")
    p = sub.add_parser("bench", help="time the query files of a folder")
    p.add_argument("store")
    p.add_argument("folder")
    p.add_argument("--warm-up", type=int, default=5)
    p.add_argument("--timed", type=int, default=20)
    p.add_argument("--log")
    p.add_argument("--show-stat", action="store_true", help="counters of one run instead of times")
    p = sub.add_parser("clean", help="N-Triples without unreadable statements")
    p.add_argument("source")
    p.add_argument("target")
    p = sub.add_parser("export", help="a store as N-Triples, graph, GraphML or ids")
    p.add_argument("store")
    p.add_argument("target")
    p.add_argument("--format", choices=("ntriples", "graph", "graphml", "ids", "histograms"), default="ntriples")
    p = sub.add_parser("index", help="print the first rows of a sorted copy")
    p.add_argument("store")
    p.add_argument("name")
    p.add_argument("--limit", type=int, default=20)
    p = sub.add_parser("serve", help="answer HTTP requests")
    p.add_argument("--port", type=int, default=8000)
    a = parser.parse_args(args)
    if a.command == "serve":
        server(a.port).serve_forever()
        return 0
    spark = _session(a.cores)
    if a.command == "build":
        store = Store.build(spark, a.source, a.store, a.full_index, a.literal_dict, a.renumber, a.spread)
        print(json.dumps(store.counts().first().asDict()))
    elif a.command == "clean":
        ntriples.clean(spark, a.source, a.target)
    else:
        store = Store.open(spark, a.store, getattr(a, "preload", False))
        store.prescan = not getattr(a, "no_prescan", False)
        if a.command == "bench":
            for x in bench(store, a.folder, a.warm_up, a.timed, a.log, a.show_stat):
                print(json.dumps(x))
        elif a.command == "index":
            print(store.index(a.name, a.limit))
        elif a.command == "export":
            {"ntriples": lambda: ntriples.write(store.triples(), a.target), "graph": lambda: ntriples.write_graph(store.triples(), a.target),
             "graphml": lambda: ntriples.write_graphml(store.triples(), a.target), "ids": lambda: store.write_ids(a.target),
             "histograms": lambda: store.write_histograms(a.target)}[a.format]()
        elif a.sparql:
            text = Path(a.sparql).read_text(encoding="utf-8")
            if a.explain or a.dot:
                print(store.explain(text) if a.explain else store.dot(text))
            elif a.profile:
                print(json.dumps(store.profile(text)))
            elif a.out:
                store.sparql(text).write.parquet(a.out)
            else:
                store.show(text)
        else:
            repl(store)
    return 0


if __name__ == "__main__":
    sys.exit(main())
