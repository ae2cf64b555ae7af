"""python -m millrace.cli parse|replay|test-parser|run|serve: the pipeline from a shell."""

from __future__ import annotations

import argparse
import json
import sys
import threading
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import api, config
from millrace.operators import parsers, serialize
from millrace.plans import pipeline
from millrace.session import ship
from millrace.sources import readers


def _spark() -> SparkSession:
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def accepting(spark: SparkSession, text: str, name: str | None, cfg: config.Config) -> list[dict]:
    """Name and status of every parser (or the named one) that accepts the text."""
    own = [p for p in parsers.REGISTRY if name in (None, p.name)]
    df = spark.createDataFrame([(text,)], "t string")
    said = df.select(*[F.coalesce(p.accept(F.col("t"), cfg), F.lit(False)).alias(p.name) for p in own]).first()
    out = []
    for p in own:
        if said[p.name]:
            r = parsers.parse(df.withColumn("p", F.lit(p.name)), "t", "p", "r", cfg, parsers.REGISTRY).select(F.to_json("r.fields").alias("f"), "r.status", "r.notes").first()
            out.append({"parser": p.name, "status": r["status"], "fields": {e["k"]: e.get("v") for e in json.loads(r["f"])}, "notes": r["notes"]})
    return out


def _serve(spark: SparkSession, cfg: config.Config, events: DataFrame, port: int) -> int:
    surface = api.server(spark, lambda: events, cfg, port=port)
    print(f"http://127.0.0.1:{surface.server_address[1]}", file=sys.stderr)
    try:
        surface.serve_forever()
    except KeyboardInterrupt:
        pass
    finally:
        surface.server_close()
    return 0


def main(argv: list[str] | None = None) -> int:
    a = argparse.ArgumentParser(prog="millrace")
    sub = a.add_subparsers(dest="cmd", required=True)
    one = sub.add_parser("parse", help="parse one message (argument or standard input)")
    one.add_argument("text", nargs="?")
    many = sub.add_parser("replay", help="parse the lines of a file")
    many.add_argument("file")
    many.add_argument("--summary", action="store_true")
    many.add_argument("--api", action="store_true", help="serve the replayed events over HTTP until interrupted")
    many.add_argument("--api-port", type=int, default=8080)
    box = sub.add_parser("serve", help="the HTTP surface alone, to look at what messages parse to")
    box.add_argument("--api-port", type=int, default=8080)
    test = sub.add_parser("test-parser", help="which parsers accept a message")
    test.add_argument("text")
    test.add_argument("--parser")
    live = sub.add_parser("run", help="listen, parse and deliver as configured")
    live.add_argument("--spool", default="spool")
    live.add_argument("--checkpoint", default="checkpoint")
    for p in (one, many, test, live, box):
        p.add_argument("--config")
    args = a.parse_args(argv)
    try:
        cfg = config.load(args.config) if args.config else config.Config()
    except config.ConfigError as e:
        print(f"configuration: {e}", file=sys.stderr)
        return 2
    spark = _spark()
    if args.cmd == "parse":
        text = args.text if args.text is not None else sys.stdin.read().rstrip("\n")
        print(pipeline.parse_events(readers.inline(spark, text, transport="cli"), cfg).select(serialize.spool_json().alias("j")).first()["j"])
    elif args.cmd == "replay":
        events = pipeline.parse_events(readers.read_files(spark, args.file, cfg.limits.max_message_bytes), cfg)
        shown = pipeline.summary(events.orderBy("file_line_number")) if args.summary else events.orderBy("file_line_number").select(serialize.spool_json().alias("j"))
        for r in shown.toLocalIterator():
            print("  ".join("-" if x is None else str(x) for x in r))
        if args.api:
            return _serve(spark, cfg, events.persist(), args.api_port)
    elif args.cmd == "serve":
        return _serve(spark, cfg, pipeline.parse_events(readers.replay(spark, []), cfg), args.api_port)
    elif args.cmd == "test-parser":
        if args.parser and args.parser not in {p.name for p in parsers.REGISTRY}:
            print(f"no parser named {args.parser}", file=sys.stderr)
            return 2
        got = accepting(spark, args.text, args.parser, cfg)
        for g in got:
            print(json.dumps(g, ensure_ascii=False))
        return 0 if got else 1
    else:
        from millrace.streaming import jobs

        held: dict[int, DataFrame] = {}

        def keep(i: int) -> Callable[[DataFrame], None]:
            def each(events: DataFrame) -> None:
                # the latest events of each listener, bounded, for the HTTP surface
                rows = pipeline.recent(events, 1000)
                held[i] = spark.createDataFrame(rows.collect(), rows.schema)

            return each

        for i, stream in enumerate(jobs.listeners(spark, cfg)):
            jobs.run(stream, cfg, args.spool, f"{args.checkpoint}/{i}", each=keep(i) if cfg.api else None)
        if cfg.api:
            none = pipeline.parse_events(readers.replay(spark, []), cfg)
            latest = lambda: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), held.values(), none)
            surface = api.server(spark, latest, cfg, cfg.api.get("host", "127.0.0.1"), int(cfg.api.get("port", 8080)))
            threading.Thread(target=surface.serve_forever, daemon=True).start()
        spark.streams.awaitAnyTermination()
    return 0


if __name__ == "__main__":
    sys.exit(main())
