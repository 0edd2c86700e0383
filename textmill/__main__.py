"""Commands: crawl, ingest, discover, search, export, init."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql import SparkSession

from textmill.operators import export
from textmill.operators.store import Store
from textmill.plans import crawler
from textmill.sources import sinks
from textmill.sources.config import EMBEDDERS, STRATEGIES, Config, _seconds, load_yaml, template

VERSION = "1.0.0"
#: Flags and the settings they change.
CRAWL = {
    "--output": "output_dir", "--rate-limit": "rate_limit", "--workers": "workers", "--max-depth": "max_depth", "--include": "includes", "--exclude": "excludes",
    "--use-browser": "use_browser", "--user-agent": "user_agent", "--timeout": "timeout_s", "--resume": "resume",
}
INGEST = {"--chunk-strategy": "chunk_strategy", "--max-tokens": "max_tokens", "--embedder": "embedder", "--embedding-model": "embedding_model", "--embedding-batch": "embedding_batch"}
DISCOVER = ("--max-depth", "--include", "--exclude", "--user-agent")


def _add(p: argparse.ArgumentParser, flags: dict[str, str]) -> None:
    """Flags that weren't given stay out of the result, so that they don't win over a file."""
    defaults = Config()
    for flag, name in flags.items():
        kind = type(getattr(defaults, name))
        names = [flag, "-o"] if flag == "--output" else [flag]
        more = {"dest": name, "default": argparse.SUPPRESS}
        if kind is bool:
            p.add_argument(*names, action="store_true", **more)
        elif kind is tuple:
            p.add_argument(*names, action="append", **more)
        else:
            p.add_argument(*names, type=_seconds if name == "timeout_s" else kind, choices={"chunk_strategy": STRATEGIES, "embedder": EMBEDDERS}.get(name), **more)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("textmill", description=__doc__)
    p.add_argument("--version", action="version", version=VERSION)
    p.add_argument("--verbose", "-v", action="store_true", default=argparse.SUPPRESS)
    commands = p.add_subparsers(dest="command", required=True)
    for name, flags, about in (("crawl", CRAWL, "Fetch a site and write its pages as Markdown"), ("ingest", CRAWL | INGEST, "Fetch a site and index it"), ("discover", {k: CRAWL[k] for k in DISCOVER}, "List the URLs of a site's sitemap")):
        c = commands.add_parser(name, help=about)
        c.add_argument("url", nargs="?" if name == "ingest" else None, default="")
        c.add_argument("--verbose", "-v", action="store_true", default=argparse.SUPPRESS)
        _add(c, flags)
        if name == "ingest":
            c.add_argument("--config", default="")
    c = commands.add_parser("search", help="Search what was indexed")
    c.add_argument("query")
    c.add_argument("--top", type=int, default=5)
    c.add_argument("--source", default=Config().output_dir)
    c.add_argument("--format", choices=("pretty", "json"), default="pretty")
    c = commands.add_parser("export", help="Write what was indexed as files")
    c.add_argument("--format", choices=export.FORMATS, default="jsonl")
    c.add_argument("--include-vectors", action="store_true")
    c.add_argument("--output", "-o", default="")
    c.add_argument("--source", default=Config().output_dir)
    c = commands.add_parser("init", help="Print a settings file to start from")
    c.add_argument("url")
    c.add_argument("--output", "-o", default="")
    return p


def settings(args: argparse.Namespace) -> Config:
    """Defaults, then the file, then the flags that were given."""
    given = {k: tuple(x for part in v for x in part.split(",")) if isinstance(v, list) else v for k, v in vars(args).items() if k not in ("command", "url", "config")}
    if args.url:
        given["seed_url"] = args.url
    text = Path(args.config).read_text() if getattr(args, "config", "") else ""
    return load_yaml(text, **given).validate()


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None, **parts: object) -> int:
    out = out or sys.stdout
    args = parser().parse_args(argv)
    if args.command == "init":
        if not urlsplit(args.url).scheme:
            print(f"not a URL: {args.url}", file=sys.stderr)
            return 1
        if not args.output:
            print(template(args.url), end="", file=out)
        elif Path(args.output).exists():
            print(f"{args.output} exists", file=sys.stderr)
            return 1
        else:
            Path(args.output).write_text(template(args.url))
        return 0
    try:
        cfg = settings(args) if args.command in ("crawl", "ingest", "discover") else None
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    spark = spark or SparkSession.builder.appName("textmill").getOrCreate()
    spark.sparkContext.setLogLevel("INFO" if getattr(args, "verbose", False) else "WARN")
    if args.command == "crawl":
        row = crawler.crawl(spark, cfg, **parts).first()
        print(f"{row['pages_crawled']} pages, {row['errors']} errors, in {cfg.output_dir}", file=out)
    elif args.command == "ingest":
        store = crawler.ingest(spark, cfg, **parts)
        print(f"{store.manifest()['chunks']} chunks in {crawler.store_path(cfg.output_dir)}", file=out)
    elif args.command == "discover":
        n = 0
        job = crawler.Crawl(cfg, **parts)
        for d in job.discoverers:
            for r in d.discover(spark, cfg.seed_url).toLocalIterator():
                print(r["url"], file=out)
                n += 1
        print(f"\nTotal URLs found: {n}", file=out)
    elif args.command == "search":
        found = Store(spark, crawler.store_path(args.source)).search(args.query, args.top)
        lines = [r["line"] for r in (export.result_json(found) if args.format == "json" else export.result_text(found)).collect()]  # at most --top lines
        if not lines:
            print("No results found.", file=sys.stderr)
        elif args.format == "json":
            print("[\n  " + ",\n  ".join(lines) + "\n]", file=out)
        else:
            print("\n\n".join(lines), file=out)
    elif args.command == "export":
        chunks = Store(spark, crawler.store_path(args.source)).with_vectors()
        if not args.output:
            for r in export.lines(chunks, args.format, args.include_vectors).toLocalIterator():
                print(r["line"], file=out)
        elif args.format == "markdown" and Path(args.output).is_dir():
            sinks.write_markdown_folder(chunks, args.output)
        else:
            export.export(chunks, args.output, args.format, args.include_vectors)
    return 0


if __name__ == "__main__":
    sys.exit(main())
